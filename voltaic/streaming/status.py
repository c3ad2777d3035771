"""Status changes of regions while the stream runs (T05 with Y02's rules): state with event-time timers.

A region's state is its first and last reading, its name and its status. A
reading makes it active; a timer on event time makes it stale, then inactive,
when the watermark has left its last reading behind by more than the threshold
(strictly, as ``mark_status`` compares), so changes come out without a new
reading. The state needs the RocksDB state store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from voltaic.constants import DEFAULT_INACTIVE_HOURS, DEFAULT_STALENESS_HOURS
from voltaic.session import env_int

LOOKBACK = "4 hours"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE_SCHEMA = ("code_insee string, nom_region string, previous_status string, status string, first_seen_at timestamp, "
                 "last_seen_at timestamp")
HOUR = 3_600_000


def _processor(stale: int, inactive: int) -> StatefulProcessor:
    """The processor of a region; defined here so that it travels by value with the tasks."""
    class Status(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("seen", "first long, last long, label string, status string")

        def row(self, key, before, first, last, label, status):
            import pandas as pd
            stamp = lambda ms: pd.Timestamp(ms, unit="ms")
            return pd.DataFrame({"code_insee": [key[0]], "nom_region": [label], "previous_status": [before], "status": [status],
                                 "first_seen_at": [stamp(first)], "last_seen_at": [stamp(last)]})

        def due(self, status, last, now):
            """(status at this watermark, next timer); a timer a millisecond behind the threshold keeps it strict."""
            if last + inactive * HOUR < now:
                return "inactive", None
            if last + stale * HOUR < now:
                return "stale", last + inactive * HOUR + 1
            return status, last + stale * HOUR + 1

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            first = last = label = None
            for part in rows:
                at = part["at"].astype("int64")
                lo, hi = int(at.min()), int(at.max())
                if first is None or lo < first:
                    first, label = lo, part["label"].iloc[int(at.values.argmin())]
                last = hi if last is None else max(last, hi)
            before = None
            if self.state.exists():
                old_first, old_last, old_label, before = self.state.get()
                first, label = (old_first, old_label) if old_first <= first else (first, label)
                last = max(last, old_last)
            self.state.update((first, last, label, "active"))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(last + stale * HOUR, timerValues.getCurrentWatermarkInMs()) + 1)
            if before != "active":
                yield self.row(key, before, first, last, label, "active")

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            first, last, label, before = self.state.get()
            status, timer = self.due(before, last, timerValues.getCurrentWatermarkInMs())
            if timer is not None:
                self.handle.registerTimer(timer)
            if status != before:
                self.state.update((first, last, label, status))
                yield self.row(key, before, first, last, label, status)

        def close(self):
            pass
    return Status()


def stream_status_changes(readings: DataFrame, stale_hours: int | None = None, inactive_hours: int | None = None,
                          code: str = "code_insee_region", label: str = "libelle_region", ts: str = "date_heure",
                          delay: str = LOOKBACK) -> DataFrame:
    """code_insee, nom_region, previous_status, status, first_seen_at, last_seen_at of every status change.

    Rows without a code or a time have no part in it. Thresholds as in ``mark_status``. Sets the session's state
    store to RocksDB, which timers need.
    """
    stale = env_int("STALENESS_THRESHOLD_HOURS", DEFAULT_STALENESS_HOURS) if stale_hours is None else stale_hours
    inactive = env_int("INACTIVE_THRESHOLD_HOURS", DEFAULT_INACTIVE_HOURS) if inactive_hours is None else inactive_hours
    readings.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    rows = readings.where(F.col(code).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(code).alias("code_insee"), F.col(label).alias("label"), F.col(ts).cast("timestamp").alias("at_time"))
    rows = rows.withWatermark("at_time", delay).withColumn("at", F.unix_millis("at_time"))
    return rows.groupBy("code_insee").transformWithStateInPandas(
        _processor(stale, inactive), outputStructType=CHANGE_SCHEMA, outputMode="Append", timeMode="EventTime")


def run_status_changes(spark: SparkSession, changes: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> None:
    """Append the changes to the files ``out``."""
    q = (changes.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
         .trigger(**(trigger or {"availableNow": True})).start())
    q.awaitTermination()
