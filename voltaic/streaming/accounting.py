"""What became of a stream's rows: read = kept + repeats + late (T02, T04, T06), as S09 audit records.

Rows behind the watermark leave a stateful operator without a trace in its
output. ``run_audited`` counts rows before and after the operator as observed
metrics and adds the operator's own counts of dropped repeats and dropped late
rows, batch by batch, from the progress events; the audit table gets one record
per batch. A windowed aggregate drops late rows after partial aggregation, so
its count of them is no row count; ``window_accounting`` takes the readings of
the windows still open from the state store instead: late is what was read and
is in no window, emitted or open.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from voltaic.sources.sinks import AUDIT_SCHEMA, audit_append

COUNTS = ("read", "kept", "repeats", "late")


class _Progress(StreamingQueryListener):
    """Counts per batch of the queries of one run; ``ended`` is set when a query has sent its last event."""

    def __init__(self):
        self.batches: dict[str, dict[int, dict[str, int]]] = {}
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        seen = p.observedMetrics
        count = lambda name: (seen[name].asDict().get("n") or 0) if name in seen else 0
        own = {"read": count("read"), "kept": count("kept"), "late": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
               "repeats": sum(s.customMetrics.get("numDroppedDuplicateRows", 0) for s in p.stateOperators)}
        batch = self.batches.setdefault(str(p.runId), {}).setdefault(p.batchId, dict.fromkeys(COUNTS, 0))
        for k in COUNTS:
            batch[k] += own[k]

    def onQueryTerminated(self, event):  # noqa: N802
        self.ended.setdefault(str(event.runId), threading.Event()).set()


def run_audited(source: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, audit: str,
                job: str, name: str, ts: str, fmt: str = "parquet", trigger: dict | None = None, wait_seconds: float = 60.0) -> None:
    """Run ``operator`` over the stream ``source`` into the files ``out``; one audit record per batch that read rows."""
    spark = source.sparkSession
    listener = _Progress()
    spark.streams.addListener(listener)
    try:
        rows = operator(source.observe("read", F.count(F.lit(1)).alias("n"))).observe("kept", F.count(F.lit(1)).alias("n"))
        q = (rows.writeStream.format(fmt).outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
             .trigger(**(trigger or {"availableNow": True})).start())
        run = str(q.runId)
        q.awaitTermination()
        # events come in order, but behind the query's end
        if not listener.ended.setdefault(run, threading.Event()).wait(wait_seconds):
            raise TimeoutError(f"no end of {name} seen by the listener")
    finally:
        spark.streams.removeListener(listener)
    done = [(b, c) for b, c in sorted(listener.batches.get(run, {}).items()) if any(c.values())]
    if done:
        entries = [(f"{job}/{run}/{b}", None, name, "success", c["kept"], None, json.dumps(c)) for b, c in done]
        audit_append(spark.createDataFrame(entries, AUDIT_SCHEMA).withColumn("timestamp", F.lit(ts).cast("timestamp")), audit)


def accounting_report(audit: DataFrame) -> DataFrame:
    """source, read, kept, repeats, late: totals of the audit records of streams."""
    parsed = audit.select("source", F.from_json("details", ", ".join(f"{c} long" for c in COUNTS)).alias("c"))
    return parsed.groupBy("source").agg(*[F.sum(f"c.{c}").alias(c) for c in COUNTS])


def window_accounting(spark: SparkSession, audit: DataFrame, emitted: DataFrame, checkpoint: str, readings: str = "readings",
                      operator_id: int = 0) -> DataFrame:
    """source, read, final, open, late of a windowed aggregate (T04): readings of the emitted windows, of those in the
    state, and the rest of what was read."""
    state = spark.read.format("statestore").option("operatorId", operator_id).load(checkpoint)
    open_ = state.agg(F.coalesce(F.sum("value.count"), F.lit(0)).alias("open"))
    final = emitted.agg(F.coalesce(F.sum(readings), F.lit(0)).alias("final"))
    return (accounting_report(audit).select("source", "read").withColumns({"final": final.scalar(), "open": open_.scalar()})
            .withColumn("late", F.col("read") - F.col("final") - F.col("open")))
