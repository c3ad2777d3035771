import random
import re
import textwrap

import pytest

import brute
from test_plans import plan
from voltaic.llm import licenses, queries

TEXTS = ["Released under the MIT License\nnothing else", "UNDER THE MIT-LICENSE, under the mit license.", "under the mitt license",
         "Apache License, Version 2.0 and Apache License Version 2", "cc by nc cc-by-nc cc by\nnc", "under the\nmit license",
         "Licensed under the Apache License, Version 2.0.", "mit", "© under the mit license é",
         "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
         "files (the Software), to deal in the Software without any restriction, including without limitation the rights to use, copy, "
         "modify, merge, publish, distribute, sublicense, or sell copies of the Software in 2020",
         "rights reserved\nall", "All Rights Reserved (copyright)", "the of and to " * 500]


def expected(text):
    w = brute.words(text)
    places = [(label, i) for p, label in licenses.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    found = {}
    for line in (text or "").split("\n"):
        held = set(brute.words(line))
        for label, template in licenses.TEMPLATES:
            own = set(licenses.template_words(template))
            share = len(own & held) / len(own)
            if len(own & held) >= 0.9 * len(own) - 1e-9:
                found[label] = max(share, found.get(label, 0))
    base = {label for label, _ in places}
    starts = [i for _, i in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | set(found))), 1.0 if places else max(found.values(), default=0.0))


def rows_of(monkeypatch, spark, docs):
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    return queries.op5_licenses(spark, "unused").collect()


def test_edge_rows_and_licenses(spark, monkeypatch):
    docs = brute.edge_docs(spark, brute.EDGE_TEXTS + TEXTS)
    got = rows_of(monkeypatch, spark, docs)
    want = sorted(((r["doc_id"], *expected(r["text"])) for r in docs.collect()), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert {r["labels"] for r in got} >= {"mit", "apache-2", "cc-by-nc", "all-rights-reserved", ""}


def test_empty_table(spark, monkeypatch):
    assert rows_of(monkeypatch, spark, brute.empty_docs(spark)) == []


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.75, 1.0])
def test_the_filters_lose_no_pair(spark, threshold):
    templates = [("a", "alpha beta gamma delta"), ("b", "beta gamma epsilon"), ("c", "zeta"), ("d", "alpha zeta eta theta iota kappa")]
    vocabulary = sorted({w for _, t in templates for w in t.split()}) + ["x", "y"]
    texts = ["\n".join(" ".join(v for k, v in enumerate(vocabulary) if (i * 37 + j * 11) >> k & 1) for j in range(3)) for i in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["block"], r["template"]) for r in licenses.matches(docs, templates, threshold).collect()}
    want = {(i, j, t) for i, text in enumerate(texts) for j, line in enumerate(text.split("\n")) for t, (_, own) in enumerate(templates)
            if len(set(own.split()) & set(line.split())) >= threshold * len(own.split()) - 1e-9}
    assert got == want and want


def test_words_are_ordered_by_the_documents_that_hold_them(spark):
    docs = spark.createDataFrame([(1, "a a a b"), (2, "a c"), (3, "a b c"), (4, None)], "doc_id long, text string")
    assert licenses.word_order(docs, ["a", "b", "c", "d"]) == ["d", "b", "c", "a"]
    assert re.match("mit", licenses.PHRASES[0][1])


def test_notices_are_found_however_lines_are_broken(spark, monkeypatch):
    long = [(label, t) for label, t in licenses.TEMPLATES if len(t) > 100]
    assert {label for label, _ in long} == {"mit", "apache-2", "bsd", "gpl", "isc"}
    filler = "lorem ipsum dolor sit amet " * 40
    shapes = {"one line": lambda t: filler + t + " " + filler,
              "wrapped": lambda t: "\n".join(textwrap.wrap(filler + t + " " + filler, 78)),
              "comment": lambda t: filler + "\n" + "\n".join(" * " + x for x in textwrap.wrap(t, 30)),
              "a word a line": lambda t: "\r\n".join((filler + t).split())}
    texts = [(label, shape(t)) for label, t in long for shape in shapes.values()]
    texts += [("all-rights-reserved", "x\nCopyright (c) 2015 The Regents of the University of California. All rights reserved.\nx")]
    texts += [("apache-2", "mit\nLicensed under the Apache\nLicense, Version 2.0")]
    # the words of a notice far from each other are no notice, on one line or on many
    far = [" ".join(w + " " + filler for w in "copyright all rights reserved".split()),
           "\n".join(w + " " + filler for w in licenses.template_words(long[0][1]))]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate([*texts, *(("", t) for t in far)])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows_of(monkeypatch, spark, docs)}
    for i, (label, _) in enumerate(texts):
        assert got[i]["labels"] == label and got[i]["score"] >= 0.9
    for i in range(len(texts), len(texts) + len(far)):
        assert got[i]["labels"] == "" and got[i]["score"] == 0.0


@pytest.mark.parametrize("threshold", [0.5, 0.75, 1.0])
def test_every_window_is_looked_at(spark, threshold):
    templates = [("a", "alpha beta gamma delta"), ("b", "beta gamma epsilon beta"), ("c", "zeta")]
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", *["x"] * 30]) + rng.choice(["", "\n"])
                      for _ in range(rng.randint(0, 120))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (set(r["matched"]), r["containment"]) for r in licenses.scan(docs, templates=templates, threshold=threshold).collect()}
    for i, text in enumerate(texts):
        w, want = text.split(), {}
        for label, t in templates:
            own, (across, within) = set(t.split()), licenses.reach(t, threshold)
            blocks = [(w, across), *((line.split(), within) for line in text.split("\n"))]
            best = max((len(own & set(x[k:k + n])) / len(own) for x, n in blocks for k in range(len(x))), default=0.0)
            if best and best >= threshold:
                want[label] = best
        assert got[i] == (set(want), max(want.values(), default=0.0))


def test_any_run_of_a_notice_lies_in_a_row(spark):
    label, text = max(licenses.TEMPLATES, key=lambda t: len(t[1]))
    texts = ["pad " * k + text + " tail" * (1200 - k) for k in range(0, 1200, 37)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert licenses.stride_of(text) >= max(licenses.reach(text))
    assert {(tuple(r["matched"]), r["containment"]) for r in licenses.scan(docs).collect()} == {((label,), 1.0)}


def test_the_scan_is_a_join_and_a_long_text_has_few_rows(spark, monkeypatch):
    tables = {}
    real = licenses.stored
    monkeypatch.setattr(licenses, "stored", lambda df, name: tables.setdefault(name, real(df, name)))
    long = ("lorem ipsum the of a software " * 170_000) + licenses.TEMPLATES[0][1] + " dolor" * 10
    out = licenses.scan(spark.createDataFrame([(1, long), (2, "x")], "doc_id long, text string"))
    shape = plan(out, "simple")
    assert shape.count("BroadcastHashJoin") >= 1 and "Python" not in shape
    assert [r["matched"] for r in out.orderBy("doc_id").collect()] == [["mit"], []]
    assert tables["license-documents"].selectExpr("max(size(rows))").first()[0] < 60
