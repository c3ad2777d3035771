"""Late rows, status changes and delta versions of the streams."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from voltaic.operators import lifecycle as Y
from voltaic.streaming import accounting as TA
from voltaic.streaming import deltas as D
from voltaic.streaming import status as TS
from voltaic.streaming import streams as T

T0 = dt.datetime(2025, 2, 20, 10, 0)
SCHEMA = "code_insee_region string, libelle_region string, date_heure timestamp_ntz"


def land(spark, root, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")


def source(spark, root, schema=SCHEMA):
    return spark.readStream.schema(schema).parquet(f"{root}/in")


def hours(n):
    return T0 + dt.timedelta(hours=n)


def test_statuses_change_without_a_new_reading(spark, tmp_dir):
    out = f"{tmp_dir}/out"

    def run(rows):
        before = spark.read.parquet(out).count() if os.path.exists(out) else 0
        land(spark, tmp_dir, rows)
        TS.run_status_changes(spark, TS.stream_status_changes(source(spark, tmp_dir), 24, 168), out, f"{tmp_dir}/ckpt")
        rows = sorted((r.code_insee, r.previous_status or "", r.status, r.last_seen_at) for r in spark.read.parquet(out).collect())
        return len(rows) - before, rows

    new, rows = run([("a", "A", hours(0)), ("a", "later", hours(1)), ("b", "B", hours(0)), (None, "x", hours(0)), ("c", "C", None)])
    assert rows == [("a", "", "active", hours(1)), ("b", "", "active", hours(0))]
    # the watermark stands at 28 - 4 = 24 hours: b's last reading is exactly 24 hours behind it, which is not stale yet
    new, rows = run([("a", "A", hours(28))])
    assert new == 0
    new, rows = run([("a", "A", hours(29))])
    assert new == 1 and ("b", "active", "stale", hours(0)) in rows
    new, rows = run([("a", "A", hours(200))])
    assert new >= 1 and ("b", "stale", "inactive", hours(0)) in rows
    new, rows = run([("b", "B2", hours(201))])
    assert new == 1 and ("b", "inactive", "active", hours(201)) in rows
    assert not [r for r in rows if r[0] == "c"]
    names = {r.nom_region for r in spark.read.parquet(out).where("code_insee = 'b'").collect()}
    assert names == {"B"}  # of the first reading, as the batch has it


@pytest.mark.parametrize("step", [1, 5])
def test_last_changes_are_what_the_batch_says(spark, tmp_dir, step):
    rows = [(f"r{i}", f"R{i}", hours(i * 7 % 400)) for i in range(60)]
    rows.sort(key=lambda r: r[2])
    for k in range(step):
        land(spark, tmp_dir, rows[k * len(rows) // step:(k + 1) * len(rows) // step])
        TS.run_status_changes(spark, TS.stream_status_changes(source(spark, tmp_dir), 24, 168), f"{tmp_dir}/out", f"{tmp_dir}/ckpt")
    changes = spark.read.parquet(f"{tmp_dir}/out").groupBy("code_insee").agg(F.max_by("status", F.struct(
        "last_seen_at", F.array_position(F.array(*map(F.lit, ("active", "stale", "inactive"))), F.col("status")))).alias("status"))
    now = max(r[2] for r in rows) - dt.timedelta(hours=4)
    batch = Y.mark_status(Y.last_seen(spark.createDataFrame(rows, SCHEMA)), str(now), 24, 168)
    assert sorted(changes.collect()) == sorted(batch.select("code_insee", "status").collect())


def test_what_was_read_is_kept_a_repeat_or_late(spark, tmp_dir):
    def run():
        TA.run_audited(source(spark, tmp_dir), lambda s: T.stream_dedup(s, ["code_insee_region", "date_heure"], "date_heure"),
                       f"{tmp_dir}/out", f"{tmp_dir}/ckpt", f"{tmp_dir}/audit", "job", "rte", "2025-02-21 00:00:00")
    land(spark, tmp_dir, [("a", "A", hours(0)), ("a", "A", hours(0)), ("b", "B", hours(10))])
    run()
    land(spark, tmp_dir, [("a", "A", hours(1)), ("b", "B", hours(10)), ("c", "C", hours(6)), ("d", "D", hours(7))])
    run()
    run()  # nothing new: no record
    records = spark.read.parquet(f"{tmp_dir}/audit")
    assert [(r.status, r.record_count) for r in records.orderBy("record_count", F.col("job_id")).collect()] == [("success", 1), ("success", 2)]
    r = TA.accounting_report(records).first()
    # hours(6) is exactly the watermark of the second run: behind it
    assert (r.read, r.kept, r.repeats, r.late) == (7, 3, 2, 2) and r.read == r.kept + r.repeats + r.late


def sizes(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/*.parquet"))


def test_batches_write_their_own_keys_only(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    rows = lambda ids, v: spark.range(ids).select("id", F.lit(v).alias("v"), F.md5(F.col("id").cast("string")).alias("s"))
    D.write_delta(rows(50_000, 0), 0, path, ["id"])
    for b in range(1, 6):
        D.write_delta(rows(10, b), b, path, ["id"])
    assert all(sizes(f"{path}/v={b}-{b}") * 100 < sizes(f"{path}/v=0-0") for b in range(1, 6))
    got = D.read_deltas(spark, path)
    assert got.count() == 50_000 and {r.v for r in got.where("id < 10").collect()} == {5} and got.where("v = 0").count() == 49_990


def test_tiers_are_merged_and_replays_change_nothing(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    batch = lambda *r: spark.createDataFrame(r, "k string, first long, last long, name string, x long")
    write = lambda b, df: D.write_delta(df, b, path, ["k"], greatest=["last"], least=["first"], keep_non_null=["name"], fanout=2)
    write(0, batch(("a", 5, 5, "A", 0), ("b", 1, 1, None, 0)))
    write(1, batch(("a", 3, 4, None, 1)))
    assert D._live(D.versions(spark, path)) == [(0, 1)]
    write(2, batch(("a", 9, 9, None, None), ("c", 7, 7, "C", 2)))
    write(2, batch(("a", 9, 9, None, None), ("c", 7, 7, "C", 2)))
    assert D._live(D.versions(spark, path)) == [(0, 1), (2, 2)]
    write(3, batch(("b", 2, 2, "B", 3)))
    assert D._live(D.versions(spark, path)) == [(0, 3)]
    write(3, batch(("b", 2, 2, "B", 3)))  # a replay of a merged batch is covered by the merged version
    want = [("a", 3, 9, "A", None), ("b", 1, 2, "B", 3), ("c", 7, 7, "C", 2)]
    assert sorted(tuple(r) for r in D.read_deltas(spark, path).collect()) == want
    write(4, batch(("d", 1, 1, "D", 4)))
    assert D.versions(spark, path) == [(0, 3), (4, 4)]  # merged ones are gone
    os.remove(f"{path}/v=4-4/_SUCCESS")  # an unfinished version is not there
    assert sorted(tuple(r) for r in D.read_deltas(spark, path).collect()) == want
