"""Ingest run: stage table, failure semantics and re-run idempotence."""

import os

from pyspark.sql import functions as F

from voltaic.plans import standins as S
from voltaic.plans.ingest import ingest_run

SF = "/root/testdata/sf0.001"
TS = "2024-01-31 00:00:00"


def _table(stages):
    return {r.stage: (r.status, r.rows) for r in stages.collect()}


def test_run_counts_and_rerun_is_idempotent(spark, tmp_dir):
    raw = S.raw_readings(spark, SF)
    stages, run = ingest_run(spark, raw, tmp_dir, "j1", TS)
    t = _table(stages)
    assert t["bronze"] == ("success", raw.count()) and run.first().run_status == "success"
    gold = spark.read.parquet(os.path.join(tmp_dir, "gold", "fact_energy"))
    first = sorted(tuple(r) for r in gold.collect())
    assert len(first) == t["gold"][1]  # a fresh table holds exactly the batch
    ingest_run(spark, raw, tmp_dir, "j1", TS)
    again = sorted(tuple(r) for r in spark.read.parquet(os.path.join(tmp_dir, "gold", "fact_energy")).collect())
    assert again == first
    audit = spark.read.parquet(os.path.join(tmp_dir, "audit"))
    assert audit.where(F.col("status") == "success").count() == 6


def test_bronze_failure_stops_the_run(spark, tmp_dir):
    blocker = os.path.join(tmp_dir, "bronze")
    open(blocker, "w").close()  # a file where the Bronze folder should be
    stages, run = ingest_run(spark, S.raw_readings(spark, SF), tmp_dir, "j2", TS)
    assert _table(stages) == {"bronze": ("failure", None)} and run.first().run_status == "failure"


def test_gold_failure_leaves_the_run_partial(spark, tmp_dir):
    os.makedirs(os.path.join(tmp_dir, "gold"))
    open(os.path.join(tmp_dir, "gold", "fact_energy"), "w").close()  # Gold target is not a table
    stages, run = ingest_run(spark, S.raw_readings(spark, SF), tmp_dir, "j3", TS)
    t = _table(stages)
    assert t["bronze"][0] == "success" and t["silver"][0] == "success" and t["gold"][0] == "failure"
    assert run.first().run_status == "partial"
