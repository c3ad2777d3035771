"""Asset lifecycle of regions (Y01-Y03): discovery, staleness, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaic.constants import DEFAULT_INACTIVE_HOURS, DEFAULT_STALENESS_HOURS
from voltaic.operators.dedup import distinct_first_label
from voltaic.operators.joins import diff_known
from voltaic.operators.upsert import upsert_region_seen
from voltaic.session import env_int


def discover_regions(readings: DataFrame, dim_region: DataFrame, now: str,
                     code: str = "code_insee_region", label: str = "libelle_region",
                     order: tuple = ("date_heure",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions seen in a batch -> (new, updated, merged dimension)."""
    seen = distinct_first_label(readings, code, label, list(order),
                                code_alias="code_insee", label_alias="nom_region")
    new, updated = diff_known(seen, dim_region, "code_insee")
    merged = upsert_region_seen(dim_region, seen, now)
    return new, updated, merged


def mark_status(dim_region: DataFrame, now: str, stale_hours: int | None = None,
                inactive_hours: int | None = None) -> DataFrame:
    """Inactive first (from active or stale), then stale (from active); strict ``<``.

    Thresholds not given come from ``STALENESS_THRESHOLD_HOURS`` and
    ``INACTIVE_THRESHOLD_HOURS`` of the environment, else the defaults (24, 168).
    A soft status change: no row is ever removed. Adds ``previous_status``.
    """
    if stale_hours is None:
        stale_hours = env_int("STALENESS_THRESHOLD_HOURS", DEFAULT_STALENESS_HOURS)
    if inactive_hours is None:
        inactive_hours = env_int("INACTIVE_THRESHOLD_HOURS", DEFAULT_INACTIVE_HOURS)
    now_ts = F.lit(now).cast("timestamp_ntz")
    seen = F.col("last_seen_at").cast("timestamp_ntz")
    inactive_bound = now_ts - F.expr(f"INTERVAL {int(inactive_hours)} HOURS")
    stale_bound = now_ts - F.expr(f"INTERVAL {int(stale_hours)} HOURS")
    st = F.col("status")
    new = (F.when(st.isin("active", "stale") & (seen < inactive_bound), "inactive")
            .when((st == "active") & (seen < stale_bound), "stale")
            .otherwise(st))
    return dim_region.withColumn("previous_status", st).withColumn("status", new)


def lifecycle_summary(marked: DataFrame, code: str = "code_insee") -> DataFrame:
    """Per new status, how many regions changed."""
    return changed_regions(marked, code).groupBy("status").agg(F.count(F.lit(1)).alias("changed"))


def changed_regions(marked: DataFrame, code: str = "code_insee") -> DataFrame:
    """The regions whose status changed, one row each."""
    return marked.where(F.col("status") != F.col("previous_status")).select("status", F.col(code).alias("code"))


def last_seen(readings: DataFrame, code: str = "code_insee_region", label: str = "libelle_region",
              ts: str = "date_heure") -> DataFrame:
    """Region dimension from readings: first label, first and last reading; status active."""
    g = readings.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("code_insee")).agg(
        F.min_by(label, ts).alias("nom_region"), F.min(ts).alias("first_seen_at"),
        F.max(ts).alias("last_seen_at"))
    return g.withColumn("status", F.lit("active"))
