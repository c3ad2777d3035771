"""Calendar decomposition of timestamps (P15) and date keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaic.functions.columns import as_col

__all__ = ["calendar_parts", "date_key", "from_date_key", "iso_weekday"]


def iso_weekday(ts) -> Column:
    """ISO weekday 1 (Monday) .. 7 (Sunday)."""
    return (F.weekday(as_col(ts)) + 1).cast("int")


def date_key(ts) -> Column:
    """Natural surrogate key yyyyMMddHHmm as bigint (stable across re-runs).

    Integer arithmetic on the calendar fields (no string formatting per row).
    """
    t = as_col(ts)
    return (F.year(t).cast("long") * 100000000 + F.month(t) * 1000000 + F.dayofmonth(t) * 10000
            + F.hour(t) * 100 + F.minute(t))


def from_date_key(key) -> Column:
    """Inverse of ``date_key``: bigint yyyyMMddHHmm -> timestamp_ntz."""
    k = as_col(key)
    return F.make_timestamp_ntz(
        (k / 100000000).cast("int"), (k / 1000000 % 100).cast("int"), (k / 10000 % 100).cast("int"),
        (k / 100 % 100).cast("int"), (k % 100).cast("int"), F.lit(0))


def calendar_parts(df: DataFrame, ts_col: str, prefix: str = "") -> DataFrame:
    """Day, month, year, hour, minute, ISO weekday and weekend flag (Sat/Sun)."""
    ts = F.col(ts_col)
    wd = iso_weekday(ts)
    return df.withColumns({
        f"{prefix}jour": F.dayofmonth(ts),
        f"{prefix}mois": F.month(ts),
        f"{prefix}annee": F.year(ts),
        f"{prefix}heure": F.hour(ts),
        f"{prefix}minute": F.minute(ts),
        f"{prefix}jour_semaine": wd,
        f"{prefix}est_weekend": wd >= 6,
    })
