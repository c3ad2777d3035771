import random

import pytest

from pyspark.sql import functions as F

import brute
from test_plans import plan
from voltaic.llm import line_runs, queries


def corpus():
    rng = random.Random(2)
    common = ["  Read more  ", "read MORE", "\tÉTÉ\x0b", "", "   ", "x", "Share\r", "SHARE"]
    texts = []
    for i in range(60):
        lines = [rng.choice(common) for _ in range(rng.randrange(4))] + [f"own line {i}", f"rare {i % 30}"]
        rng.shuffle(lines)
        texts.append("\n".join(lines * rng.choice([1, 1, 2])) + rng.choice(["", "\n"]))
    return texts


def check(rows, got, **options):
    want = brute.drop_lines([r["text"] for r in rows], **options)
    assert sorted(((r["doc_id"], *w) for r, w in zip(rows, want, strict=True)), key=str) == sorted(
        ((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got), key=str)


@pytest.mark.parametrize("batches,fanout,min_docs,min_chars", [(4, 2, 10, 1), (1, 2, 3, 1), (5, 3, 2, 0), (7, 2, 10, 4), (3, 9, 1, 1)])
def test_any_batches_and_levels_give_the_same_rows(spark, batches, fanout, min_docs, min_chars):
    docs = brute.edge_docs(spark, brute.EDGE_TEXTS + corpus())
    got = line_runs.drop_common_lines(docs, min_docs, min_chars, batches, fanout).collect()
    check(docs.collect(), got, min_docs=min_docs, min_chars=min_chars)


def test_runs_are_merged_by_levels_and_leave_decided_keys_out(spark):
    runs = line_runs.LineRuns(spark, min_docs=3, fanout=2)
    batch = lambda *kv: spark.createDataFrame([(bytearray(k), n) for k, n in kv], line_runs.RUN_SCHEMA)
    runs.add(batch((b"a", 3), (b"b", 1)))
    runs.add(batch((b"a", 9), (b"b", 1)))
    assert [len(x) for x in runs.levels] == [0, 1]
    assert {bytes(r["hash"]): r["n"] for r in runs.run(runs.levels[1][0]).collect()} == {b"a": 3, b"b": 2}
    runs.add(batch((b"b", 1), (b"c", 1)))
    assert [len(x) for x in runs.levels] == [1, 1]
    assert {bytes(r["hash"]) for r in runs.common().collect()} == {b"a", b"b"}


def test_runs_are_joined_in_their_order(spark):
    runs = line_runs.LineRuns(spark, min_docs=3, fanout=9)
    batch = spark.range(2000).selectExpr("md5(cast(id as string)) AS k", "1L AS n").selectExpr("unhex(k) AS hash", "n")
    for k in range(2):
        runs.add(batch.where(f"n + {k} > 0"))
    left, right = runs.levels[0]
    name = runs.write(runs.dealt(batch.withColumn("batch", F.lit(0))), "batch")
    with line_runs.ordered_scans(spark):
        for rows, scans in ((runs.merged(left, right), 2), (runs.undecided(runs.run(name).where("batch = 0").select("hash", "n")), 3)):
            rows.collect()
            shape = plan(rows, "simple").split("== Initial Plan ==")[0]
            assert shape.count("Bucketed: true") == scans and shape.count("SortMergeJoin") == scans - 1
            assert "Exchange" not in shape and "Sort [" not in shape
    assert runs.common().count() == 0
    runs.add(batch)
    assert runs.common().count() == 2000
    runs.drop()
    assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == "false"


def test_empty_table(spark):
    assert line_runs.drop_common_lines(brute.empty_docs(spark)).collect() == []


def test_carried_rows(spark):
    docs = brute.edge_docs(spark)
    got = line_runs.drop_common_lines(docs, carry=docs.columns)
    assert sorted(map(str, got.select("row.*").collect())) == sorted(map(str, docs.collect()))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r["doc_id"]: (n, d, brute.sha256(k)) for r, (n, d, k) in zip(rows, brute.drop_lines([r["text"] for r in rows]), strict=True)}
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in queries.op10_line_dedup(spark, sf).collect()} == want
