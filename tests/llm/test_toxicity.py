import math
import random
import zlib

import pyspark.sql.functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from voltaic.llm import queries, toxicity


def all_maximal(scores, start=0):
    """The maximal scoring segments by their definition: the best one (shortest), then left and right of it."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 1e-9 and (best is None or total > best[2] + 1e-9 or (abs(total - best[2]) <= 1e-9 and j - i < best[1] - best[0] - 1)):
                best = (i, j + 1, total)
    if best is None:
        return []
    i, j, total = best
    return all_maximal(scores[:i], start) + [(start + i, start + j, total)] + all_maximal(scores[j:], start + j)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.0, 1.13, 2.37, 5.71]), max_size=40))
def test_one_scan_finds_every_maximal_segment(values):
    drift = 0.31
    hits = [(i, v) for i, v in enumerate(values) if v > drift]
    got = toxicity.segments(hits, drift)
    want = all_maximal([v - drift if v > drift else -drift for v in values])
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert all(abs(x[2] - y[2]) < 1e-6 for x, y in zip(got, want, strict=True))


def test_the_rate_solves_its_equation():
    points = [(-0.1, 0.99), (4.0, 0.009), (6.0, 0.001)]
    rate = toxicity.solve_rate(points)
    assert abs(sum(p * 2.718281828459045 ** (rate * s) for s, p in points) - 1) < 1e-6 and rate > 0
    assert toxicity.solve_rate([(-0.1, 1.0)]) == 1.0


def test_longer_texts_need_more_evidence():
    one = toxicity.p_value([6.0], 100, 1.0, 0.1)
    assert one < toxicity.p_value([6.0], 10_000, 1.0, 0.1)
    assert toxicity.p_value([6.0, 6.0], 100, 1.0, 0.1) < one


def test_the_sum_tail_is_that_of_random_scores():
    rng = random.Random(5)
    sums = []
    for _ in range(20_000):
        g, total = 0.0, 0.0
        for _ in range(6):
            g += rng.expovariate(1.0)
            total -= math.log(g)
        sums.append(total)
    for t in (-6.0, -3.0, 0.6, 3.0):
        assert abs(toxicity.sum_tail(6, t) - sum(x >= t for x in sums) / len(sums)) < 0.012
    for r, t in ((2, 30.0), (5, 60.0)):  # the limit for large sums
        limit = math.exp(-t + (r - 1) * math.log(t) - math.lgamma(r + 1) - math.lgamma(r))
        assert abs(toxicity.sum_tail(r, t) / limit - 1) < 0.1
    tails = [toxicity.sum_tail(60, float(t)) for t in range(-300, 300, 20)]
    assert all(a >= b >= 0 for a, b in zip(tails, tails[1:])) and tails[0] > 0.999 and tails[-1] < 1e-60


def test_every_moderate_passage_of_a_long_text_counts():
    n, rate, k = 20_000, 1.0, 0.05
    score = lambda many, over: toxicity.posterior(
        toxicity.p_value([math.log(k * n) + over] * many, n, rate, k), 0.05)
    assert score(6, 1.0) < 0.3 < 0.99 < score(20, 1.0) <= score(40, 1.0) <= 1.0
    assert score(6, 1.7) < score(10, 1.7) and score(10, 1.7) > 0.95
    assert score(400, 0.5) == 1.0  # no overflow
    # passages that chance alone brings are no evidence, however many
    assert score(1, 0.0) < 0.1 and score(3, 0.05) < 0.1 and score(40, -0.5) < 0.1


def test_a_long_text_with_many_moderate_passages_is_toxic(spark):
    model = toxicity.Model(scores={"slur": 4.0}, drift=0.05, rate=1.0, k=0.05, prior=0.05)
    def text(many, words=600, filler="plain"):
        return " ".join(" ".join(["slur"] + [filler] * (words // many - 1)) for _ in range(many))
    one = toxicity.segments([(0, 4.0)], 0.05)[0][2]
    assert one - math.log(0.05 * 600) > 0
    docs = spark.createDataFrame([(m, text(m)) for m in (1, 5, 20)], "doc_id long, text string")
    got = {r["row"]["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert got[1] < 0.3 < got[20]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in queries.op7_toxicity(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(rows) == 10_000
    for r in rows.values():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(rows[x["doc_id"]]["predicted"], x["toxic"]) for x in labels if rows[x["doc_id"]]["held_out"]]
    found = sum(p and y for p, y in held) / sum(y for _, y in held)
    wrong = sum(p and not y for p, y in held) / sum(not y for _, y in held)
    assert found > 0.88 and wrong < 0.025


def corpus(spark, n=400):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice("the of and to in is it for on as with by at from that this".split()) + rng.choice(["", "", "er", "ing"])
             for _ in range(rng.randint(30, 200))]
        if i % 5 == 0:
            at = rng.randrange(len(w) - 10)
            for j in range(at, at + 10, 2):
                w[j] = rng.choice(["vileword", "nastyword", "Grössling"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_passages_are_found_and_held_out_labels_unused(spark):
    docs, labels = corpus(spark)
    model = queries.toxicity_model(docs, labels)
    assert {w for w in model.scores if "*" not in w} >= {"vileword", "nastyword", "grössling"}
    assert all(any(w.startswith(t.rstrip("*")) for w in ("vileword", "nastyword", "grössling")) for t in model.scores)
    other = labels.withColumn("toxic", F.when(queries.id_remainder(4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert queries.toxicity_model(docs, other) == model
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.score(docs, model).select("row.doc_id", "score", "passages").collect():
        toxic = r["doc_id"] % 5 == 0
        assert (r["score"] >= 0.3) == toxic and bool(r["passages"]) == toxic
        w = brute.words(texts[r["doc_id"]])
        for p in r["passages"]:
            assert {w[p["start"]], w[p["end"] - 1]} <= {"vileword", "nastyword", "grössling"}


def test_edge_rows_and_empty_tables(spark):
    docs, labels = corpus(spark)
    model = queries.toxicity_model(docs, labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (3, 0)], labels.schema)))
    edge = brute.edge_docs(spark, [*brute.EDGE_TEXTS, "vileword nastyword", brute.LONG + " vileword nastyword" * 4])
    got = toxicity.score(edge, model, carry=edge.columns).collect()
    assert len(got) == edge.count() and got[0]["row"].asDict().keys() == dict.fromkeys(edge.columns).keys()
    assert sum(r["score"] >= 0.3 for r in got) == 2
    assert toxicity.score(brute.empty_docs(spark), model).collect() == []
    for none in (labels.where("false"), labels.where("toxic = 0")):
        unsure = toxicity.score(docs, queries.toxicity_model(docs, none)).collect()
        assert not any(r["score"] >= 0.3 or r["passages"] for r in unsure)
    assert queries.toxicity_model(brute.empty_docs(spark), labels).scores == {}
