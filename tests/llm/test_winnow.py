import random

import pytest

import brute
from voltaic.llm import queries, winnow


def expected(text, items, span=10):
    n, hit, ids = brute.contaminated(text, items, span)
    return n, hit, len(ids), brute.sha256(",".join(ids)), hit > 0


def run(monkeypatch, spark, docs, bench):
    monkeypatch.setattr(queries, "table", lambda s, d, name: docs if name == "documents" else bench)
    return queries.op8_decontaminate(spark, "unused").collect()


def corpus():
    rng = random.Random(11)
    draw = lambda n, v: " ".join(f"{rng.choice('abc')}{rng.randrange(v)}" for _ in range(n))
    items = [(i, draw(rng.choice([10, 12, 25, 60]), 40)) for i in range(12)]
    items += [(100, "a1 b2 c3"), (101, "b7"), (102, draw(9, 9)), (103, draw(5, 4)), (104, ""), (105, None), (None, draw(15, 30)), (2, draw(14, 9)),
              (106, "a1 " * 30), items[3]]
    texts = []
    for _ in range(80):
        text = draw(rng.choice([0, 3, 9, 10, 40, 200]), 40)
        for _ in range(rng.randrange(3)):
            w = brute.words(rng.choice(items)[1])
            if w:
                at = rng.randrange(len(w))
                text += " " + " ".join(w[at:at + rng.choice([8, 9, 10, 11, 30])]).upper() + " - " + draw(4, 40)
        texts.append(text)
    return texts + ["a1 " * 45, "x " + "a1 " * 9, "a1, b2. C3"], items


@pytest.mark.parametrize("span,gram", [(10, 5), (10, 10), (10, 1), (6, 4)])
def test_every_shared_window_is_found(spark, span, gram):
    texts, items = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bits in (20, 7):  # a full bitmap screens nothing and loses nothing
        got = winnow.shared_spans(docs, bench, span, gram, bits=bits).collect()
        assert len(got) == len(texts)
        for r in got:
            n, hit, ids = brute.contaminated(texts[r["doc_id"]], items, span)
            places = {i for h in r["hits"] for s in h["spans"] for i in range(s["start"], s["end"])}
            assert (r["n_words"], len(places), sorted({h["item_id"] for h in r["hits"]})) == (n, hit, ids)
        if gram != 5:
            break


def test_edge_rows(spark, monkeypatch):
    texts, items = corpus()
    docs = brute.edge_docs(spark, brute.EDGE_TEXTS + texts + [brute.LONG + " " + (items[1][1] + " ") * 40])
    bench = spark.createDataFrame([(i, t, "q", 1) for i, t in [*items, (200, "w5x w6x w7x w8x w9x w10x w11x w12x w13x w14x w15x")]],
                                  "item_id long, text string, words string, n int")
    got = run(monkeypatch, spark, docs, bench)
    bench_rows = [(r["item_id"], r["text"]) for r in bench.collect()]
    want = sorted(((r["doc_id"], *expected(r["text"], bench_rows)) for r in docs.collect()), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_empty_tables(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert run(monkeypatch, spark, brute.empty_docs(spark), bench) == []
    docs = brute.edge_docs(spark)
    assert {(r["n_hit"], r["contaminated"]) for r in run(monkeypatch, spark, docs, bench.where("false"))} == {(0, False)}


@pytest.mark.parametrize("n", [200, 400])
def test_what_falls_short_of_a_window_meets_in_no_row(spark, monkeypatch, n):
    """Documents and items that share nine words: candidates follow their number, not its square."""
    shared = " ".join(f"s{i}" for i in range(9))
    docs = spark.createDataFrame([(i, f"d{i} {shared} e{i} f{i}") for i in range(n)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"x{i} {shared} y{i} z{i}") for i in range(n)], "item_id long, text string")
    tables = {}
    real = winnow.stored
    monkeypatch.setattr(winnow, "stored", lambda df, name, *a: tables.setdefault(name, real(df, name, *a)))
    assert winnow.shared_spans(docs, bench).where("size(hits) > 0").count() == 0
    candidates = tables["winnow-documents"].selectExpr("sum(size(own))").first()[0]
    assert 0 < candidates <= 3 * n and tables["winnow-named"].count() == 0


def test_spans_are_whole_stretches(spark):
    text = "a b c d e f g h i j k l m n"
    docs = spark.createDataFrame([(1, f"x {text} y {text} z"), (2, "l m n")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, text), (2, "l m n")], "item_id long, text string")
    got = {r["doc_id"]: sorted((h["item_id"], [tuple(s) for s in h["spans"]]) for h in r["hits"])
           for r in winnow.shared_spans(docs, bench).collect()}
    assert got == {1: [("1", [(1, 15), (16, 30)]), ("2", [(12, 15), (27, 30)])], 2: [("2", [(0, 3)])]}


def test_carried_rows_keep_every_column(spark):
    docs = brute.edge_docs(spark)
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    got = winnow.shared_spans(docs, bench, carry=docs.columns)
    assert sorted(map(str, got.select("row.*").collect())) == sorted(map(str, docs.collect()))
    assert got.where("size(hits) > 0").count() == 3
