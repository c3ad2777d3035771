import math
import zlib

import numpy as np

import brute
from voltaic.llm import quality, queries


def auc(pairs):
    good = [s for s, y in pairs if y]
    bad = [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op6_quality(spark, sf).collect()
    assert len(rows) == 10_000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert auc(held) > 0.93
    kept = [s >= 0.3 for s, y in held if y]
    dropped = [s < 0.3 for s, y in held if not y]
    assert sum(kept) / len(kept) > 0.95 and sum(dropped) / len(dropped) > 0.75


def test_labels_of_held_out_rows_and_negative_labels_change_nothing(spark):
    sf = "/root/testdata/sf0.001"
    described = quality.features(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE nullif(quality, 0) END quality")
    a, b = (queries.quality_model(described, x) for x in (labels, other))
    assert a.prior == b.prior and np.allclose(a.weights, b.weights)


def test_the_minimum_is_that_of_the_non_negative_risk():
    rng = np.random.default_rng(1)
    x_p, x_n = rng.normal(1, 1, (400, 3)), rng.normal(-1, 1, (100, 3))
    add = lambda x: np.c_[np.ones(len(x)), x]
    p, u = add(x_p[:200]), add(np.r_[x_p[200:], x_n])
    m = [(x.T @ x / len(x), x.mean(0)) for x in (u, p)]

    def risk(w, prior):
        negative = ((1 + u @ w) ** 2).mean() / 4 - prior * ((1 + p @ w) ** 2).mean() / 4
        return prior * ((1 - p @ w) ** 2).mean() / 4 + max(0, negative)
    for prior in (0.3, 0.67, 0.99):
        w = quality.minimise(*m[0], *m[1], prior, ridge=1e-9)
        unbiased = np.linalg.solve(m[0][0], 2 * prior * m[1][1] - m[0][1])
        others = [unbiased, *(w + rng.normal(0, 0.05, 4) for _ in range(200))]
        assert risk(w, prior) <= min(risk(o, prior) for o in others) + 0.01
    w = quality.minimise(*m[0], *m[1], 0.67)
    assert auc([(s, True) for s in add(x_p) @ w] + [(s, False) for s in add(x_n) @ w]) > 0.95


def test_prior_from_a_histogram():
    # unlabelled: 300 good spread like the positives, 100 bad in the lowest bin
    assert math.isclose(quality.estimate_prior([(0, 160, 20), (1, 120, 40), (2, 120, 40)], 0.3), 0.75)


def test_edge_rows_and_empty_tables(spark):
    docs = brute.edge_docs(spark)
    described = quality.features(docs)
    labels = spark.createDataFrame([(90, 1), (95, 1), (95, 0), (None, 1), (91, None)], "doc_id long, quality int")
    got = quality.score(described, queries.quality_model(described, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    none = quality.score(described, queries.quality_model(described, labels.where("false"))).collect()
    assert {r["score"] for r in none} == {0.5}
    empty = quality.features(brute.empty_docs(spark))
    assert quality.score(empty, queries.quality_model(empty, labels)).collect() == []
