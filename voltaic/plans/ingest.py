"""One ingest run as Spark jobs: Bronze landing -> Silver day layout -> Gold fact upsert.

Each stage is one Spark write whose row count is observed during the write;
every stage appends an audit record. The stage table replaces the reference's
result dict: a Bronze failure stops the run (``failure``), a later failure
leaves it ``partial``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaic.functions.calendar import date_key
from voltaic.operators.aggregates import unpivot_sources
from voltaic.operators.upsert import upsert_table
from voltaic.plans import silver
from voltaic.session import scratch_path
from voltaic.sources import sinks

FACT_KEYS = ["day", "id_region", "id_date", "id_source"]


def silver_to_fact(silver_df: DataFrame) -> DataFrame:
    """Silver readings -> Gold fact rows (A03 unpivot, natural keys, day partition column)."""
    long = unpivot_sources(silver_df, ["code_insee_region", "date_heure"])
    return long.select(F.to_date("date_heure").alias("day"), F.col("code_insee_region").alias("id_region"),
                       date_key("date_heure").alias("id_date"), F.col("source_name").alias("id_source"),
                       "valeur_mw")


def ingest_run(spark: SparkSession, raw: DataFrame, root: str, job_id: str, ts: str
               ) -> tuple[DataFrame, DataFrame]:
    """Land ``raw`` readings under ``root``, build Silver and merge the batch into the Gold fact.

    Returns (stages, run): one row per stage (stage, status, rows, error) and
    the run status. Re-running a batch leaves the Gold fact unchanged.
    """
    audit = f"{root}/audit"
    stages: list[tuple] = []

    def record(stage: str, status: str, rows: int | None, error: str | None = None) -> None:
        stages.append((stage, status, rows, error))
        sinks.audit_append(sinks.audit_entry(spark, job_id, stage, status, rows, ts, error=error), audit)

    bronze = f"{root}/bronze/job_id={job_id}"
    try:
        rows = sinks.observed_write(raw, lambda d: d.write.mode("overwrite").parquet(bronze))
        record("bronze", "success", rows)
    except Exception as e:  # noqa: BLE001 - the stage table carries the failure
        record("bronze", "failure", None, str(e))
        return sinks.stage_report(spark, stages)

    silver_df = None
    try:
        silver_df, _ = silver.transform_readings(spark.read.parquet(bronze))
        rows = sinks.observed_write(silver_df, lambda d: sinks.write_silver_daily(d, f"{root}/silver"))
        record("silver", "success", rows)
    except Exception as e:  # noqa: BLE001
        record("silver", "failure", None, str(e))
        return sinks.stage_report(spark, stages)

    try:
        # staged first (the batch's rows counted as they are written), then merged into the touched days
        stage = scratch_path(spark, f"gold-stage-{job_id}")
        rows = sinks.observed_write(silver_to_fact(silver_df), lambda d: d.write.mode("overwrite").parquet(stage))
        upsert_table(spark, f"{root}/gold/fact_energy", spark.read.parquet(stage), FACT_KEYS, partition_by=["day"])
        record("gold", "success", rows)
    except Exception as e:  # noqa: BLE001
        record("gold", "failure", None, str(e))
    return sinks.stage_report(spark, stages)
