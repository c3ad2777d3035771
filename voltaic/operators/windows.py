"""Window operators (W03-W05); forward fill and keep-last live in nulls/dedup."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltaic.constants import NATIONAL_BALANCE_TOLERANCE
from voltaic.functions.columns import js_round
from voltaic.functions.maps import map_total_positive
from voltaic.operators.aggregates import balance_state
from voltaic.session import checkpoint_root


def balance_runs(series: DataFrame, tol: float = NATIONAL_BALANCE_TOLERANCE,
                 by: Sequence[str] = (), bucket: str = "month", materialize: bool = True) -> DataFrame:
    """W03 for every point: supply/demand state (±tol) and the start of its run.

    Production = rounded positive total, consumption rounded (the chart's
    values). A point without consumption (NULL or 0) has state ``no_data`` and
    breaks every run. Gaps-and-islands: a run starts where the state differs
    from the previous point's; the run start is the latest such start at or
    before the point.

    Scale: the previous point comes from a window per (series, time bucket)
    plus a small per-bucket summary for the first point of each bucket, so no
    window holds a whole series. The point table (one row per timestamp and
    series) feeds three branches; with ``materialize`` it is checkpointed to
    the shared checkpoint folder once instead of being recomputed per branch.
    """
    return _runs(balance_points(series, tol, by), by, bucket, materialize)


def balance_points(series: DataFrame, tol: float = NATIONAL_BALANCE_TOLERANCE, by: Sequence[str] = ()) -> DataFrame:
    """timestamp, prod, conso, state of every point of a series."""
    pts = series.select(*by, "timestamp", js_round(map_total_positive("sources")).alias("prod"),
                        js_round(F.col("consommation_mw")).alias("conso"))
    return pts.withColumn("state", balance_state("prod", "conso", tol))


def _runs(pts: DataFrame, by: Sequence[str], bucket: str, materialize: bool) -> DataFrame:
    by = list(by)
    pts = pts.withColumn("_b", F.date_trunc(bucket, F.col("timestamp")))
    if materialize:
        checkpoint_root(pts.sparkSession)
        pts = pts.checkpoint(eager=True)
    w = Window.partitionBy(*by, "_b").orderBy("timestamp")
    pts = pts.withColumn("_prev", F.lag("state").over(w))
    # last state of every bucket, carried to the next bucket's first point
    summ = pts.groupBy(*by, "_b").agg(F.max_by("state", "timestamp").alias("_last"))
    wb = Window.partitionBy(*by).orderBy("_b")
    summ = summ.select(*by, "_b", F.lag("_last").over(wb).alias("_carry"))
    pts = pts.join(summ, on=[*by, "_b"], how="left")
    prev = F.coalesce(F.col("_prev"), F.col("_carry"))
    pts = pts.withColumn("_start", F.when(prev.isNull() | (prev != F.col("state")) |
                                          (F.col("state") == "no_data"), F.col("timestamp")))
    # run start = latest start at or before the point, again two-level
    wr = Window.partitionBy(*by, "_b").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    pts = pts.withColumn("_run_in", F.max("_start").over(wr))
    bs = pts.groupBy(*by, "_b").agg(F.max("_start").alias("_bmax"))
    bs = bs.select(*by, "_b", F.max("_bmax").over(wb.rowsBetween(Window.unboundedPreceding, -1))
                   .alias("_run_carry"))
    pts = pts.join(bs, on=[*by, "_b"], how="left")
    return pts.select(*by, "timestamp", "prod", "conso", "state",
                      F.coalesce(F.col("_run_in"), F.col("_run_carry")).alias("run_start"))


def _newest(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    last = F.max_by(F.struct("timestamp", "prod", "conso", "state", "run_start"), "timestamp")
    g = runs.groupBy(*by).agg(last.alias("_l")) if by else runs.agg(last.alias("_l")).where("_l IS NOT NULL")
    return g.select(*by, "_l.*")


def _shown(newest: DataFrame) -> DataFrame:
    return newest.withColumn("run_start", F.when(F.col("state").isin("surplus", "deficit"), F.col("run_start")))


def balance_run_start(series: DataFrame, tol: float = NATIONAL_BALANCE_TOLERANCE,
                      by: Sequence[str] = ()) -> DataFrame:
    """State of the newest point and since when it holds.

    ``run_start`` is NULL when the newest point is balanced or has no
    consumption (the chart then shows no 'since' time).
    """
    return _shown(_newest(balance_runs(series, tol, by), by))


def carried_runs(state: DataFrame | None, series: DataFrame, tol: float = NATIONAL_BALANCE_TOLERANCE,
                 by: Sequence[str] = ()) -> DataFrame:
    """W03 carried on: the newest point of every series with the start of its run, from the state so far (such rows)
    and the points behind it.

    The state's point takes part as the first point of the new ones: a run that reaches back to it began where the
    state says. Points at or before a series' state are left out; corrections of them need a state from before them.
    """
    by = list(by)
    pts = balance_points(series, tol, by)
    if state is None:
        return _newest(_runs(pts, by, "month", True), by)
    known = state.select(*by, F.col("timestamp").alias("_at"), F.col("run_start").alias("_since"))
    # one row per series: as many as there are regions
    behind = pts.join(known.select(*by, "_at"), by, "left") if by else pts.withColumn("_at", known.select("_at").scalar())
    new = behind.where(F.col("_at").isNull() | (F.col("timestamp") > F.col("_at"))).drop("_at")
    runs = _newest(_runs(new.unionByName(state.select(*by, "timestamp", "prod", "conso", "state")), by, "month", True), by)
    both = runs.join(known, by, "left") if by else runs.withColumns({c: known.select(c).scalar() for c in ("_at", "_since")})
    reaches = F.col("run_start") == F.col("_at")
    return both.withColumn("run_start", F.when(reaches, F.col("_since")).otherwise(F.col("run_start"))).drop("_at", "_since")


def advance_run_start(spark: SparkSession, path: str, series_since: Callable[[str | None], DataFrame],
                      tol: float = NATIONAL_BALANCE_TOLERANCE, by: Sequence[str] = ()) -> DataFrame:
    """W03 from a persisted state: reads the state at ``path`` (one row per series), asks ``series_since`` for the points
    behind the oldest of them (None: for all), writes the new state as the next version and returns the rows of
    ``balance_run_start``. ``series_since`` puts its bound into the scan, so only new buckets are read."""
    done = _versions(spark, path)
    state = spark.read.parquet(f"{path}/v={done[-1]}") if done else None
    since = state.agg(F.min("timestamp").cast("string")).first()[0] if done else None
    target = f"{path}/v={done[-1] + 1 if done else 0}"
    carried_runs(state, series_since(since), tol, by).write.mode("overwrite").parquet(target)
    return _shown(spark.read.parquet(target))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions under ``path``, from the listing."""
    jvm = spark.sparkContext._jvm  # noqa: SLF001 - Hadoop FileSystem listing
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/_SUCCESS")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    return sorted(int(st.getPath().getParent().getName()[2:]) for st in fs.globStatus(p) or [])


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, n: int,
                    rank_col: str = "rank") -> DataFrame:
    """The first ``n`` rows per group (row_number <= n, planned as a group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def last_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The newest ``n`` rows (top-n, no full sort)."""
    return df.orderBy(F.col(order).desc()).limit(n)
