"""Declarative null handling.

Order of application is DROP -> FILL_ZERO -> FORWARD_FILL -> FLAG. Flag
columns are always added so the output schema does not depend on the batch.
Metrics are returned as a one-row DataFrame computed in a single pass over the
input; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DROP, FILL_ZERO, FORWARD_FILL, FLAG = "drop", "fill_zero", "forward_fill", "flag"


def null_drop(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop a row if any of ``cols`` is NULL."""
    cols = [c for c in cols if c in df.columns]
    return df.dropna(how="any", subset=cols) if cols else df


def null_fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL -> 0.0."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in cols})


def null_forward_fill(df: DataFrame, cols: Sequence[str], entity: Sequence[str], order: str,
                      bucket: str = "month") -> DataFrame:
    """Previous non-NULL value per entity in time order; leading NULLs stay NULL.

    Two-level scan so that no window holds an entity's whole history:
    rows are filled inside (entity, time bucket) partitions, and the value
    carried into each bucket comes from a small per-bucket summary table.
    """
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    entity = list(entity)
    b = "_ff_bucket"
    keyed = df.withColumn(b, F.date_trunc(bucket, F.col(order)))
    w_in = (Window.partitionBy(*entity, b).orderBy(order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = keyed.withColumns({f"_ff_{c}": F.last(F.col(c), ignorenulls=True).over(w_in) for c in cols})

    # last non-null value of each bucket, then carried across buckets
    summary = keyed.groupBy(*entity, b).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_last_{c}") for c in cols])
    w_b = (Window.partitionBy(*entity).orderBy(b)
           .rowsBetween(Window.unboundedPreceding, -1))
    carry = summary.select(*entity, b, *[F.last(F.col(f"_last_{c}"), ignorenulls=True).over(w_b)
                                         .alias(f"_carry_{c}") for c in cols])
    out = filled.join(carry, on=[*entity, b], how="left")
    return out.withColumns({c: F.coalesce(F.col(f"_ff_{c}"), F.col(f"_carry_{c}")) for c in cols}) \
        .select(*df.columns)


def null_flag(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep the NULL, add ``<col>_is_null`` (always present)."""
    cols = [c for c in cols if c in df.columns]
    return df.withColumns({f"{c}_is_null": F.col(c).isNull() for c in cols})


def _by_strategy(df: DataFrame, rules: Mapping[str, str], strategy: str) -> list[str]:
    return [c for c, s in rules.items() if s == strategy and c in df.columns]


def quality_metrics(df: DataFrame, rules: Mapping[str, str], source: str,
                    cleaned: DataFrame | None = None) -> DataFrame:
    """One row: input rows, NULLs per rule column before cleaning, rows dropped,
    values filled, values flagged, output rows."""
    drop = _by_strategy(df, rules, DROP)
    fill = _by_strategy(df, rules, FILL_ZERO) + _by_strategy(df, rules, FORWARD_FILL)
    flag = _by_strategy(df, rules, FLAG)
    ruled = [c for c in rules if c in df.columns]
    dropped = F.lit(False)
    for c in drop:
        dropped = dropped | F.col(c).isNull()
    kept = ~dropped
    aggs = [F.count(F.lit(1)).alias("input_rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"nulls__{c}") for c in ruled]
    aggs.append(F.count_if(dropped).alias("rows_dropped"))
    filled = F.lit(0)
    for c in _by_strategy(df, rules, FILL_ZERO):
        filled = filled + F.count_if(kept & F.col(c).isNull())
    aggs.append(filled.cast("long").alias("_fill_zero"))
    flagged = F.lit(0)
    for c in flag:
        flagged = flagged + F.count_if(kept & F.col(c).isNull())
    aggs.append(flagged.cast("long").alias("values_flagged"))
    m = df.agg(*aggs)
    nulls = F.map_from_arrays(
        F.array(*[F.lit(c) for c in ruled]) if ruled else F.array().cast("array<string>"),
        F.array(*[F.col(f"nulls__{c}") for c in ruled]) if ruled else F.array().cast("array<bigint>"))
    m = m.withColumn("nulls_found", F.map_filter(nulls, lambda k, v: v > 0))
    ffill = _by_strategy(df, rules, FORWARD_FILL)
    if ffill and cleaned is not None:
        # a forward-filled value counts only if the fill produced one: NULLs among
        # kept rows before, minus NULLs left after. The two one-row aggregates are
        # stacked and folded (no join).
        before = df.agg(*[F.count_if(kept & F.col(c).isNull()).alias(f"_before_{c}") for c in ffill])
        after = cleaned.agg(*[(-F.count_if(F.col(c).isNull())).alias(f"_before_{c}") for c in ffill])
        delta = before.unionByName(after).agg(
            sum((F.sum(F.col(f"_before_{c}")) for c in ffill), F.lit(0)).cast("long").alias("_ff"))
        m = m.withColumn("_k", F.lit(1)).unionByName(delta.withColumn("_k", F.lit(2)),
                                                     allowMissingColumns=True)
        m = m.agg(*[F.max(c).alias(c) for c in m.columns if c not in ("_k", "nulls_found")],
                  F.first("nulls_found", ignorenulls=True).alias("nulls_found"))
        filled_ff = F.coalesce(F.col("_ff"), F.lit(0))
    else:
        filled_ff = F.lit(0)
    return m.select(
        F.lit(source).alias("source"),
        F.col("input_rows"),
        F.col("nulls_found"),
        F.col("rows_dropped"),
        (F.col("_fill_zero") + filled_ff).cast("long").alias("values_filled"),
        F.col("values_flagged"),
        (F.col("input_rows") - F.col("rows_dropped")).alias("output_rows"),
    )


def apply_quality_rules(df: DataFrame, rules: Mapping[str, str], source: str,
                        entity: Sequence[str] | None = None, order: str | None = None,
                        bucket: str = "month", dedup=None) -> tuple[DataFrame, DataFrame]:
    """Apply a rule set; returns (clean frame, one-row metrics frame).

    ``dedup`` (frame -> frame) runs after the drop and before the fills, so forward fill never sees duplicates;
    NULL counts and dropped rows are always those of ``df`` as it came in.
    """
    out = null_drop(df, _by_strategy(df, rules, DROP))
    if dedup is not None:
        out = dedup(out)
    out = null_fill_zero(out, _by_strategy(df, rules, FILL_ZERO))
    ff = _by_strategy(df, rules, FORWARD_FILL)
    if ff:
        if order is None:
            raise ValueError("forward fill needs an order column")
        out = null_forward_fill(out, ff, entity or [], order, bucket=bucket)
    out = null_flag(out, _by_strategy(df, rules, FLAG))
    return out, quality_metrics(df, rules, source, cleaned=out if ff and dedup is None else None)
