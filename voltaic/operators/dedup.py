"""De-duplication.

Keep-last and keep-first reduce map-side before the shuffle (partial group
limit, or ``min_by`` partial aggregation), so a key that holds a large share
of the rows is cut to one row per map task instead of being shipped whole to
one reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltaic.functions.columns import as_col


def _order_struct(order: Sequence):
    return F.struct(*[as_col(o) for o in order])


def dedup_keep_last(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The last row per key in load order (``order`` must be a total order per key).

    ``row_number() = 1`` over the key, newest first: Spark plans it as a
    partial group limit before the shuffle (one row per key per map task)
    and a final one after, so a hot key is reduced before it moves.
    A key column absent from the frame means the step is skipped, as for a
    batch that lacks the column altogether.
    """
    if not keys or any(k not in df.columns for k in keys):
        return df
    w = Window.partitionBy(*keys).orderBy(*[as_col(o).desc() for o in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row per key in ``order``."""
    payload = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*payload), _order_struct(order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def distinct_first_label(df: DataFrame, code: str, label: str, order: Sequence,
                         code_alias: str | None = None, label_alias: str | None = None) -> DataFrame:
    """Unique code with the first non-blank label seen (load order)."""
    lab = F.col(label)
    clean = df.where(F.col(code).isNotNull() & (F.trim(F.col(code).cast("string")) != "")
                     & lab.isNotNull() & (F.trim(lab) != ""))
    return clean.groupBy(F.col(code).alias(code_alias or code)).agg(
        F.min_by(lab, _order_struct(order)).alias(label_alias or label))


def distinct_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct combinations of ``cols`` (partial aggregation before the shuffle)."""
    return df.select(*cols).distinct()


def daily_alert_dedup(df: DataFrame, user: str = "user_id", region: str = "region_code",
                      alert_type: str = "alert_type", sent_at: str = "sent_at",
                      tie: Sequence | None = None) -> DataFrame:
    """At most one alert per (user, region, type, calendar day); the earliest is kept."""
    day = F.to_date(F.col(sent_at))
    keyed = df.withColumn("_day", day)
    order = [sent_at] + list(tie or [])
    out = dedup_keep_first(keyed, [user, region, alert_type, "_day"], order)
    return out.drop("_day")
