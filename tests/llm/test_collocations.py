import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import brute
from voltaic.llm import collocations, queries

PIECE, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def counts(rows, max_words):
    f = Counter()
    for lang, text in rows:
        for piece in PIECE.split(brute.lower(text)):
            w = WORD.findall(piece)
            for m in range(1, max_words + 1):
                f.update(("und" if lang is None else lang, tuple(w[i:i + m])) for i in range(len(w) - m + 1))
    return f


def mined(rows, max_words=3, min_count=10, percent=50, top=2000):
    f = counts(rows, max_words)
    n = Counter()
    for (lang, p), c in f.items():
        n[lang] += c if len(p) == 1 else 0
    often = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= min_count}
    around = Counter()
    for (lang, p), c in often.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                around[lang, p[i:i + m]] = max(around[lang, p[i:i + m]], c)
    out = []
    for (lang, p), a in often.items():
        if (lang, p) in around and 100 * around[lang, p] >= percent * a:
            continue
        score, _, left, r = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]])
                                for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, r, n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(x[0], k, *x[1:]) for k, x in enumerate(own, 1)]
    return sorted(ranked)


def corpus():
    rng = random.Random(3)
    words = ["New", "york", "of", "the", "La", "été", "naïve", "don't", "x\xa0y", "a-b", "你好", "Ünï", "*"]
    texts = []
    for i in range(120):
        t = " ".join(rng.choice(words) for _ in range(rng.randrange(25)))
        for mark in (". ", ",", "\t", "\r\n", "; New York City ", "  "):
            t = t.replace(" ", mark, 1) if rng.random() < 0.5 else t + mark
        texts.append((rng.choice(["en", "fr", None, "und", ""]), t))
    return texts + [("en", "the the the the the"), ("en", "a " * 40), (None, None), ("fr", ""), ("en", ".,;")]


def run(spark, rows, **options):
    docs = spark.createDataFrame([(t, lang, 1, "p") for lang, t in rows], "text string, lang string, n int, phrase string")
    got = collocations.collocations(docs.repartition(3), **options)
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got.collect())


@pytest.mark.parametrize("options", [{}, {"max_words": 4, "min_count": 3}, {"max_words": 2, "min_count": 1, "top": 7},
                                     {"min_count": 2, "slices": 1, "block_bytes": 50, "bits": 16}, {"min_count": 1, "subsume_percent": 100, "bits": 18}])
def test_against_plain_python(spark, options):
    rows = corpus()
    want = mined(rows, options.get("max_words", 3), options.get("min_count", 10), options.get("subsume_percent", 50), options.get("top", 2000))
    assert len(want) > 2 and run(spark, rows, **options) == want


def test_stripes_hold_totals_and_extensions(spark):
    docs = spark.createDataFrame([("en", "a b, a b a"), ("en", "A c")], "lang string, text string")
    got = collocations.stripes(docs, 1, min_count=2, slices=4).collect()
    totals = Counter()
    for r in got:
        totals[r["prefix"]] += r["total"]
    assert totals == {"a": 4, "b": 2, "c": 1}
    assert [(r["prefix"], x["next"], x["n"]) for r in got for x in r["extensions"]] == [("a", "b", 2)]


def test_products_beyond_64_bits_are_exact(spark):
    a, left, r = 9_999_999_999_999, 10_000_000_000_019, 12_345_678_901_237
    spark.createDataFrame([(a, left, r)], "a long, l long, r long").createOrReplaceTempView("big")
    exact = "decimal(38,0)"
    q = f"(cast(1000000 as {exact}) * cast(a as {exact}) * cast(a as {exact})) div (cast(l as {exact}) * cast(r as {exact}))"
    assert spark.sql(f"SELECT {q} AS s FROM big").first()["s"] == 1_000_000 * a * a // (left * r)


def test_blocks_are_cut_between_pieces():
    texts = ["one two. three four, five", "", "six seven\neight", "no end here at all " * 5]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    blocks = list(collocations._blocks(raw, offsets, 10))
    assert b"".join(b.tobytes() for b, _, _ in blocks) == raw.tobytes()
    for block, bounds, first in blocks[:-1]:
        assert block[-1:].tobytes() in (b".", b",", b"\n") or int(bounds[-1]) == len(block)
        assert 0 <= first < len(texts)


def test_hashes_follow_the_strings():
    one = collocations.string_hashes(pa.array(["ab", "", "ba", "a", "é", "ab", ""], pa.large_string()))
    assert len(set(one.tolist())) == 5 and one[0] == one[5] and one[1] == one[6]


def test_edge_rows(spark):
    docs = brute.edge_docs(spark)
    got = collocations.collocations(docs).collect()
    want = mined([(r["lang"], r["text"]) for r in docs.collect()])
    assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got) == want


def test_empty_table(spark):
    assert collocations.collocations(brute.empty_docs(spark)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = sorted(tuple(r) for r in queries.op11_collocations(spark, sf).collect())
    assert got == mined([(r["lang"], r["text"]) for r in docs])
