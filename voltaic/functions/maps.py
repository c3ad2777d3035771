"""Expressions over the per-record ``sources`` map (source -> MW)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltaic.constants import CARBON_BAND_TOP, CARBON_BANDS, CARBON_GAUGE_MAX
from voltaic.functions.columns import as_col

__all__ = [
    "positive_only", "map_total_positive", "map_as_text", "entries_as_text",
    "carbon_band", "carbon_gauge_value", "any_nonzero",
]


def positive_only(m) -> Column:
    """P20: keep only strictly positive MW entries."""
    return F.map_filter(as_col(m), lambda k, v: v > 0)


def map_total_positive(m) -> Column:
    """Sum of the positive MW values of a map (0.0 for none), exact in decimal."""
    acc_t = "decimal(38,4)"
    total = F.aggregate(F.map_values(positive_only(m)), F.lit(0).cast(acc_t),
                        lambda acc, v: (acc + v.cast("decimal(20,4)")).cast(acc_t))
    return total.cast("double")


def any_nonzero(m) -> Column:
    """A record survives unless every source value is exactly 0 (NULL counts as non-zero)."""
    return F.exists(F.map_values(as_col(m)), lambda v: v.isNull() | (v != 0))


def entries_as_text(entries) -> Column:
    """Sorted array<struct<key,value>> -> 'key:value;...' with 4-decimal fixed point values."""
    return F.array_join(
        F.transform(entries, lambda e: F.concat(
            e.getField("key"), F.lit(":"),
            F.coalesce(e.getField("value").cast("decimal(18,4)").cast("string"), F.lit("null")))),
        ";")


def map_as_text(m) -> Column:
    """Deterministic text of a map (entries sorted by key); used to compare results."""
    return entries_as_text(F.array_sort(F.map_entries(as_col(m))))


def carbon_band(c) -> Column:
    """Intensity band label."""
    x = as_col(c)
    expr = None
    for bound, label in CARBON_BANDS:
        expr = F.when(x < bound, label) if expr is None else expr.when(x < bound, label)
    return expr.otherwise(CARBON_BAND_TOP)


def carbon_gauge_value(c) -> Column:
    """Value shown on the gauge (capped)."""
    return F.least(as_col(c), F.lit(float(CARBON_GAUGE_MAX)))

