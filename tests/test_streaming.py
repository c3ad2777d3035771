"""Streaming operators over files landed in several micro-batches."""

import datetime as dt
import os

from pyspark.sql import functions as F

from voltaic.streaming import streams as T

SCHEMA = "code string, date_heure timestamp_ntz, mw double, ord long"


def land(spark, root, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(os.path.join(root, "in", name))


def src(spark, root):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(os.path.join(root, "in"))


T0 = dt.datetime(2025, 2, 20, 10, 0)


def test_upsert_across_batches_and_replay(spark, tmp_dir):
    land(spark, tmp_dir, "b1", [("11", T0, 1.0, 1), ("11", T0, 2.0, 2), ("84", T0, 5.0, 3)])
    table, ckpt = os.path.join(tmp_dir, "table"), os.path.join(tmp_dir, "ckpt")
    T.stream_upsert(src(spark, tmp_dir), table, ["code", "date_heure"], ["ord"], checkpoint=ckpt)
    land(spark, tmp_dir, "b2", [("11", T0, 7.0, 4), ("11", T0 + dt.timedelta(minutes=15), 3.0, 5)])
    T.stream_upsert(src(spark, tmp_dir), table, ["code", "date_heure"], ["ord"], checkpoint=ckpt)
    # a restart with nothing new leaves the table as it is
    T.stream_upsert(src(spark, tmp_dir), table, ["code", "date_heure"], ["ord"], checkpoint=ckpt)
    got = sorted((r.code, r.date_heure, r.mw) for r in T.read_upserted(spark, table).collect())
    assert got == [("11", T0, 7.0), ("11", T0 + dt.timedelta(minutes=15), 3.0), ("84", T0, 5.0)]


def test_national_windows_and_alert_dedup(spark, tmp_dir):
    rows = [("11", T0 + dt.timedelta(minutes=15 * i), float(i), i) for i in range(40)]
    land(spark, tmp_dir, "b1", rows)
    long = src(spark, tmp_dir).select("date_heure", F.lit("eolien").alias("source_name"),
                                      F.col("mw").alias("valeur_mw"))
    out = os.path.join(tmp_dir, "nat")
    q = (T.stream_national(long).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(tmp_dir, "c2")).trigger(availableNow=True).start())
    q.awaitTermination()
    res = spark.read.parquet(out)
    # windows end at most 4 hours before the newest reading; the zero reading is not positive
    last = T0 + dt.timedelta(minutes=15 * 39)
    assert res.agg(F.max("window_end")).first()[0] == last - dt.timedelta(hours=4)
    assert res.count() == 22  # slots 1..22 (slot 0 has 0 MW; later windows not final yet)
    alerts = spark.createDataFrame(
        [(1, "11", "under_production", T0), (1, "11", "under_production", T0 + dt.timedelta(hours=2)),
         (1, "11", "under_production", T0 + dt.timedelta(days=1))],
        "user_id int, region_code string, alert_type string, sent_at timestamp_ntz")
    adir = os.path.join(tmp_dir, "alerts")
    alerts.write.parquet(adir)
    s = spark.readStream.schema(alerts.schema).parquet(adir)
    aout = os.path.join(tmp_dir, "aout")
    q = (T.stream_alert_dedup(s).writeStream.format("parquet").option("path", aout)
         .option("checkpointLocation", os.path.join(tmp_dir, "c3")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.read.parquet(aout).count() == 2
