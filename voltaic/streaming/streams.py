"""Structured Streaming operators.

The reference pulls the last 240 minutes every 15 minutes; here the landed
files are a streaming file source, the 240-minute overlap becomes a 4-hour
watermark, and corrections (last write wins) go through ``foreachBatch``
upserts. Tests and the catalog run them with ``availableNow``; production
uses ``processingTime="15 minutes"``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from voltaic.operators.dedup import dedup_keep_last
from voltaic.operators.upsert import upsert_table
from voltaic.streaming.deltas import read_deltas, write_delta

LOOKBACK = "4 hours"
SLOT = "15 minutes"


def stream_bronze(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                  glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Landed files as a stream (explicit schema; new files are picked up per trigger)."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "json":
        r = r.option("multiLine", True)
    return r.load(path)


def event_time(sdf: DataFrame, ts: str) -> DataFrame:
    """Watermarks need TIMESTAMP (not NTZ): cast in the UTC session."""
    return sdf.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_dedup(sdf: DataFrame, keys: Sequence[str], ts: str, delay: str = LOOKBACK) -> DataFrame:
    """Drop exact re-deliveries of a key inside the look-back (first arrival kept).

    Corrections of a key (last write wins) are not repeats; they go through
    ``stream_upsert``.
    """
    return event_time(sdf, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def _run(writer, trigger: dict | None) -> StreamingQuery:
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()


def stream_upsert(sdf: DataFrame, path: str, keys: Sequence[str], order: Sequence[str],
                  checkpoint: str, partition_by: Sequence[str] = (), trigger: dict | None = None,
                  wait: bool = True) -> StreamingQuery:
    """Idempotent upsert of every micro-batch into the table at ``path``.

    Within a batch the last row per key in ``order`` wins; across batches the
    later batch overwrites matched keys. The order columns are not stored. Unpartitioned tables get the batch's keys
    as a version of its own (``deltas``), so a replayed batch rewrites the same version and nothing
    else is copied; partitioned tables rewrite only the touched partitions.
    """
    keys, order, parts = list(keys), list(order), list(partition_by)

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        inc = dedup_keep_last(batch, keys, order)
        if parts:
            upsert_table(spark, path, inc, keys, partition_by=parts, order=order)
            return
        write_delta(inc.drop(*order), batch_id, path, keys)

    q = _run(sdf.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint), trigger)
    if wait:
        q.awaitTermination()
    return q


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    """The table written by ``stream_upsert`` (unpartitioned form) or ``merge_last_seen``, one row per key."""
    return read_deltas(spark, path)


def stream_national(long: DataFrame, ts: str = "date_heure", source: str = "source_name",
                    mw: str = "valeur_mw", delay: str = LOOKBACK, slot: str = SLOT) -> DataFrame:
    """National positive MW per (15-minute window, source), appended once final.

    A window is final when the watermark (max event time - 4 h) passes its end.
    """
    s = event_time(long, ts).withWatermark(ts, delay).where(F.col(mw) > 0)
    return (s.groupBy(F.window(ts, slot).alias("window"), source)
             .agg(F.sum(F.col(mw).cast("decimal(28,4)")).cast("double").alias("mw"),
                  F.count(F.lit(1)).alias("readings"))
             .select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                     F.col("window.end").cast("timestamp_ntz").alias("window_end"), source, "mw", "readings"))


def stream_last_seen(readings: DataFrame, code: str = "code_insee_region", label: str = "libelle_region",
                     ts: str = "date_heure") -> DataFrame:
    """Running first/last reading per region (stateful, update mode)."""
    return readings.where(F.col(code).isNotNull() & F.col(ts).isNotNull()).groupBy(
        F.col(code).alias("code_insee")).agg(
        F.min_by(label, ts).alias("nom_region"), F.min(ts).alias("first_seen_at"),
        F.max(ts).alias("last_seen_at"))


def merge_last_seen(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink for T05: a batch's regions as changed keys of the region table."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        write_delta(batch.withColumn("status", F.lit("active")), batch_id, path, ["code_insee"], greatest=["last_seen_at"],
                    least=["first_seen_at"], keep_non_null=["nom_region"])
    return merge


def stream_alert_dedup(alerts: DataFrame, user: str = "user_id", region: str = "region_code",
                       alert_type: str = "alert_type", sent_at: str = "sent_at",
                       delay: str = "1 day") -> DataFrame:
    """At most one alert per (user, region, type, calendar day) on a stream."""
    s = event_time(alerts, sent_at).withColumn("day", F.to_date(F.col(sent_at)))
    return s.withWatermark(sent_at, delay).dropDuplicatesWithinWatermark([user, region, alert_type, "day"])
