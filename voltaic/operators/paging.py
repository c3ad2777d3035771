"""Filters, ordering and exact paging."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaic.constants import (
    MAINTENANCE_DEFAULT_LIMIT, MAINTENANCE_MAX_LIMIT, METEO_DEFAULT_LIMIT, METEO_MAX_LIMIT,
    PERIOD_PRESETS,
)
from voltaic.functions.columns import end_of_day_bound
from voltaic.session import scratch_path


def apply_filters(df: DataFrame, region: str | None = None, start: str | None = None,
                  end: str | None = None, source: str | None = None,
                  region_col: str = "code_insee", ts_col: str = "horodatage",
                  source_col: str = "source_name") -> DataFrame:
    """L07 (+P18): optional AND-ed filters; a date-only ``end`` covers the whole day.

    Plain predicates on columns, so Catalyst pushes them into the scan.
    """
    out = df
    if region is not None:
        out = out.where(F.col(region_col) == region)
    if start is not None:
        out = out.where(F.col(ts_col) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        bound, inclusive = end_of_day_bound(end)
        out = out.where(F.col(ts_col) <= bound if inclusive else F.col(ts_col) < bound)
    if source is not None:
        out = out.where(F.col(source_col) == source)
    return out


def newest_first(df: DataFrame, ts: str = "timestamp", tie: tuple = ("code_insee",)) -> DataFrame:
    """ORDER BY ts DESC, then the tie-break columns ascending (a total order)."""
    return df.orderBy(F.col(ts).desc(), *[F.col(t).asc() for t in tie])


def page(df: DataFrame, limit: int, offset: int = 0, ts: str = "timestamp",
         tie: tuple = ("code_insee",)) -> tuple[DataFrame, DataFrame]:
    """Exact page of already-pivoted records and the exact total.

    Returns (page rows, one-row frame ``total_records``). ``limit`` 1..1000.
    """
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be in 1..1000 and offset >= 0")
    rows = newest_first(df, ts, tie).offset(offset).limit(limit)
    total = df.agg(F.count(F.lit(1)).alias("total_records"))
    return rows, total


class RankedPages:
    """L02 for deep pages: rows range-partitioned once in page order, so that counts per range say where a page lies.

    ``page`` sums the counts up to its offset, skips the ranges before it unread and sorts the ranges it lies in
    (one, or neighbours at a border), cut by a filter on the partition column of the stored table. Rows that are
    equal in all order columns lie in one range. The total comes from the same counts. The order is a total one:
    rows may only tie if they are equal in it.
    """

    def __init__(self, df: DataFrame, ts: str = "timestamp", tie: tuple = ("code_insee",), ranges: int | None = None):
        spark = df.sparkSession
        self.order = [F.col(ts).desc(), *[F.col(t).asc() for t in tie]]
        ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        path = scratch_path(spark, "ranked-pages")
        ranged = df.repartitionByRange(ranges, *self.order).withColumn("_range", F.spark_partition_id())
        ranged.write.partitionBy("_range").parquet(path)
        self.rows = spark.read.schema(ranged.schema).parquet(path)
        self.counts = {r["_range"]: r["count"] for r in self.rows.groupBy("_range").count().collect()}  # a row per range
        self.total = sum(self.counts.values())

    def ranges_of(self, limit: int, offset: int) -> tuple[list[int], int]:
        """(ranges that hold the page, rows of the ranges before them)."""
        some, skipped, at = [], 0, 0
        for k in sorted(self.counts):
            if at + self.counts[k] <= offset:
                skipped = at + self.counts[k]
            elif at < offset + limit:
                some.append(k)
            at += self.counts[k]
        return some, skipped

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        if not 1 <= limit <= 1000 or offset < 0:
            raise ValueError("limit must be in 1..1000 and offset >= 0")
        some, skipped = self.ranges_of(limit, offset)
        rows = self.rows.where(F.col("_range").isin(some)) if some else self.rows.where(F.lit(False))
        return rows.drop("_range").orderBy(*self.order).offset(offset - skipped).limit(limit)


def meteo_regional(meteo: DataFrame, region: str | None = None, start: str | None = None,
                   end: str | None = None, limit: int = METEO_DEFAULT_LIMIT,
                   ts: str = "timestamp", region_col: str = "code_insee") -> DataFrame:
    """Newest-first weather rows, default 500, at most 5000."""
    if not 1 <= limit <= METEO_MAX_LIMIT:
        raise ValueError(f"limit must be in 1..{METEO_MAX_LIMIT}")
    f = apply_filters(meteo, region=region, start=start, end=end, region_col=region_col, ts_col=ts)
    return f.orderBy(F.col(ts).desc(), F.col(region_col).asc()).limit(limit)


def maintenance_events(events: DataFrame, region: str | None = None,
                       limit: int = MAINTENANCE_DEFAULT_LIMIT, start_col: str = "start_date",
                       region_col: str = "code_insee", id_col: str = "event_id") -> DataFrame:
    """Newest outage start first, default 100, at most 500."""
    if not 1 <= limit <= MAINTENANCE_MAX_LIMIT:
        raise ValueError(f"limit must be in 1..{MAINTENANCE_MAX_LIMIT}")
    f = events if region is None else events.where(F.col(region_col) == region)
    return f.orderBy(F.col(start_col).desc_nulls_last(), F.col(id_col).asc()).limit(limit)


def capacity_regional(capacity: DataFrame, region: str | None = None, year: int | None = None) -> DataFrame:
    """Capacity rows ordered by region asc, year desc, source asc; no limit."""
    f = capacity
    if region is not None:
        f = f.where(F.col("code_insee_region") == region)
    if year is not None:
        f = f.where(F.col("annee") == year)
    return f.orderBy(F.col("code_insee_region").asc(), F.col("annee").desc(), F.col("source_name").asc())


def period_bounds(ref: str, preset: str = "7d") -> tuple[str, str]:
    """The preset's bounds (both inclusive) as text, for filters that reach a scan."""
    end = datetime.fromisoformat(ref)
    return str(end - timedelta(days=PERIOD_PRESETS[preset])), str(end)


def last_period(df: DataFrame, ts: str, ref: str, preset: str = "7d") -> DataFrame:
    """Rows within the last 24 h / 7 d / 30 d before an explicit reference time."""
    days = PERIOD_PRESETS[preset]
    ref_ts = F.lit(ref).cast("timestamp_ntz")
    return df.where((F.col(ts) >= ref_ts - F.expr(f"INTERVAL {days} DAYS")) & (F.col(ts) <= ref_ts))
