"""Upserts that appear at once, and deep pages from range counts."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from test_plans import plan
from voltaic.operators import paging as L
from voltaic.operators import publish as P

SCHEMA = "day string, k string, v double"
KEYS = ["day", "k"]


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def table(spark, path):
    return sorted(tuple(r) for r in P.read_published(spark, path).select("day", "k", "v").collect())


def test_upserts_switch_at_once(spark, tmp_dir, monkeypatch):
    path = f"{tmp_dir}/t"
    assert P.publish_upsert(rows(spark, *[(f"d{i}", "a", float(i)) for i in range(5)]), path, KEYS, ["day"]) == 1
    old = table(spark, path)
    batch = rows(spark, ("d1", "a", 9.0), ("d1", "b", 9.0), ("d3", "a", 9.0), ("d7", "z", 9.0))

    # a crash behind the last day and before the switch
    def crash(*_):
        raise RuntimeError("killed")
    with monkeypatch.context() as m:
        m.setattr(P, "_names", lambda s, p, real=P._names: crash() if "/gen=2" in p else real(s, p))
        with pytest.raises(RuntimeError):
            P.publish_upsert(batch, path, KEYS, ["day"])
    assert glob.glob(f"{path}/gen=2/day=d7/*.parquet") and table(spark, path) == old
    # a crash between two days
    for f in glob.glob(f"{path}/gen=2/day=d3/*.parquet"):
        os.remove(f)
    assert table(spark, path) == old
    reader = P.read_published(spark, path)
    assert P.publish_upsert(batch, path, KEYS, ["day"]) == 2
    assert reader.count() == len(old)  # a reader keeps the table it began with
    want = dict(((d, k), v) for d, k, v in old) | {("d1", "a"): 9.0, ("d1", "b"): 9.0, ("d3", "a"): 9.0, ("d7", "z"): 9.0}
    assert table(spark, path) == sorted((d, k, v) for (d, k), v in want.items())
    assert {d: g for d, g in P.manifest(spark, path).items()} == {"day=d0": 1, "day=d1": 2, "day=d2": 1, "day=d3": 2, "day=d4": 1, "day=d7": 2}
    assert not glob.glob(f"{path}/gen=2/day=d0*")  # untouched days are not written again


def test_replays_empty_batches_order_and_vacuum(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    batch = spark.createDataFrame([("d1", "a", 1.0, 1), ("d1", "a", 2.0, 2), ("d é/=", "b", None, 3)], SCHEMA + ", ord int")
    schema = batch.drop("ord").schema
    assert P.read_published(spark, path, schema).count() == 0
    for n in (1, 2, 3, 4):
        assert P.publish_upsert(batch, path, KEYS, ["day"], order=["ord"]) == n
        assert table(spark, path) == [("d é/=", "b", None), ("d1", "a", 2.0)] or table(spark, path) == [("d1", "a", 2.0), ("d é/=", "b", None)]
    assert P.publish_upsert(batch.where("false"), path, KEYS, ["day"], order=["ord"]) == 4
    assert P.vacuum(spark, path) == [1, 2] and P.generations(spark, path) == [3, 4] and len(table(spark, path)) == 2
    with pytest.raises(ValueError, match="belong to the key"):
        P.publish_upsert(batch, path, ["k"], ["day"])


def test_only_the_days_asked_for_are_read(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    P.publish_upsert(rows(spark, *[(f"d{i}", "a", 1.0) for i in range(5)]), path, KEYS, ["day"])
    one = P.read_published(spark, path).where("day = 'd3'")
    assert one.count() == 1 and "d3" in plan(one).split("PartitionFilters")[1].split("\n")[0]


@pytest.mark.parametrize("ranges", [1, 4, 9])
def test_deep_pages_read_their_ranges_only(spark, ranges):
    rng = random.Random(4)
    data = list({(rng.choice([None, *range(40)]), f"c{rng.randrange(50)}") for _ in range(900)})
    df = spark.createDataFrame([(t, c, i) for i, (t, c) in enumerate(data)], "timestamp int, code_insee string, i int")
    pages = L.RankedPages(df, ranges=ranges)
    want = [r["i"] for r in L.newest_first(df).collect()]
    assert pages.total == len(data) and (ranges == 1 or len(pages.counts) > 1)
    for offset in (0, 1, len(data) // 10, len(data) // 2, len(data) - 3, len(data), len(data) + 10):
        got = [r["i"] for r in pages.page(50, offset).collect()]
        assert got == want[offset:offset + 50]
        some, skipped = pages.ranges_of(50, offset)
        assert len(some) <= 2 + 50 // min(pages.counts.values()) and skipped <= offset
    if ranges > 1:
        shape = plan(pages.page(5, len(data) // 10))
        assert "_range" in shape.split("PartitionFilters")[1].split("\n")[0]
    with pytest.raises(ValueError):
        pages.page(0)


def test_pages_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "timestamp int, code_insee string")
    pages = L.RankedPages(empty)
    assert pages.total == 0 and pages.page(10).collect() == [] and F is not None


@pytest.mark.parametrize("by", [(), ("zone",)])
def test_a_carried_state_gives_the_rows_of_the_full_scan(spark, tmp_dir, by):
    from voltaic.operators import windows as W
    rng = random.Random(12)
    points = []
    for zone in ("n", "s", "w"):
        level = 100.0
        for h in range(300):
            if rng.random() < 0.08:
                level = rng.choice([60.0, 100.0, 140.0, None])
            points.append((zone, f"2025-{1 + h // 100:02d}-{1 + h % 100 // 5:02d} {h % 5:02d}:00:00", {"gaz": 100.0}, level))
    series = spark.createDataFrame(points, "zone string, t string, sources map<string,double>, consommation_mw double")
    series = series.withColumn("timestamp", F.col("t").cast("timestamp_ntz")).drop("t")
    series = series if by else series.where("zone = 's'")
    asked = []

    def since(upto):
        def build(at):
            asked.append(at)
            out = series.where(F.col("timestamp") <= F.lit(upto).cast("timestamp_ntz"))
            return out if at is None else out.where(F.col("timestamp") >= F.lit(at).cast("timestamp_ntz"))
        return build
    for upto in ("2025-01-09 00:00:00", "2025-01-09 00:00:00", "2025-02-03 02:00:00", "2025-02-03 03:00:00", "2025-03-30 00:00:00"):
        got = W.advance_run_start(spark, f"{tmp_dir}/state", since(upto), by=by)
        want = W.balance_run_start(series.where(F.col("timestamp") <= F.lit(upto).cast("timestamp_ntz")), by=by)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert asked[0] is None and asked[1:4] == ["2025-01-09 00:00:00"] * 2 + ["2025-02-03 02:00:00"]
