"""Plan-shape checks: the properties the operators rely on at scale."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from voltaic.operators.dedup import dedup_keep_last
from voltaic.operators.joins import nearest_centroid

SMOKE = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_keep_last_reduces_before_the_shuffle(spark):
    # one key holds a third of the rows
    df = spark.range(30000).select((F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))).alias("k"),
                                   F.col("id").alias("ord"))
    p = plan(dedup_keep_last(df, ["k"], ["ord"]))
    assert "WindowGroupLimit" in p and "Partial" in p
    out = dedup_keep_last(df, ["k"], ["ord"]).where("k = 0").first()
    assert out.ord == 29997


def test_serving_filters_reach_the_scan(spark):
    p = plan(entry_mod.queries()["l07_apply_filters"](spark, SMOKE))
    assert "GreaterThanOrEqual(l_shipdate" in p and "LessThan(l_shipdate" in p


def test_nearest_centroid_is_a_projection(spark):
    df = spark.createDataFrame([(48.9, 2.3), (43.3, 5.4)], "lat double, lon double")
    out = nearest_centroid(df, "lat", "lon")
    p = plan(out)
    assert "Exchange" not in p and "Join" not in p
    assert [r.region_code for r in out.collect()] == ["11", "93"]


def test_star_join_dimensions_are_not_shuffled(spark):
    p = plan(entry_mod.queries()["j01_star_join"](spark, SMOKE), "simple")
    assert "SortMergeJoin" not in p or "BroadcastHashJoin" in p
    assert "BroadcastExchange" in p


@pytest.mark.parametrize("name", sorted(entry_mod.queries()))
def test_no_cross_products(spark, name):
    p = plan(entry_mod.queries()[name](spark, SMOKE), "simple")
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p  # no row-at-a-time Python UDF anywhere


def _hot(spark, n=30000):
    """One key holds a third of the rows."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1000 + 1).cast("string").alias("k"),
        F.col("id").alias("ord"),
        F.concat(F.lit("L"), F.col("id").cast("string")).alias("label"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("id"))).alias("ts"))


def test_hot_keys_are_combined_before_the_shuffle(spark):
    from voltaic.operators.dedup import daily_alert_dedup, distinct_first_label
    df = _hot(spark)
    first = distinct_first_label(df, "k", "label", ["ord"])
    p = plan(first, "simple")  # physical tree, top-down: the partial aggregate sits below the exchange
    assert "partial_min_by" in p and p.index("partial_min_by") > p.index("Exchange hashpartitioning")
    assert first.where("k = '0'").first().label == "L0"
    alerts = df.select(F.lit(1).alias("user_id"), F.col("k").alias("region_code"), F.lit("t").alias("alert_type"),
                       F.col("ts").alias("sent_at"), F.col("ord").alias("alert_id"))
    ded = daily_alert_dedup(alerts, tie=["alert_id"])
    assert "partial_min_by" in plan(ded)
    assert ded.where("region_code = '0'").count() == alerts.where("region_code = '0'") \
        .select(F.to_date("sent_at")).distinct().count()


def test_forward_fill_windows_are_bucketed(spark):
    from voltaic.operators.nulls import null_forward_fill
    df = _hot(spark).withColumn("v", F.when(F.col("ord") % 7 == 0, F.col("ord").cast("double")))
    out = null_forward_fill(df, ["v"], ["k"], "ts")
    p = plan(out, "extended")
    # every window over the rows is partitioned by entity and time bucket, never by the entity alone
    assert "_ff_bucket" in p
    row = out.where("k = '0' and ord = 3").first()
    assert row.v == 0.0  # carried from ord 0 (same key, earlier time)
