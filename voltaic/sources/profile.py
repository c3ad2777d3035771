"""Schema profile of a table in one aggregation pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile_schema(df: DataFrame, hash_long_text: Sequence[str] = ()) -> DataFrame:
    """Per column type, NULL count, a sample value (the minimum) and the total row count.

    One ``agg`` over the table, then the wide row is unpivoted to one row per column.
    """
    aggs = [F.count(F.lit(1)).alias("_total")]
    for i, (name, dtype) in enumerate(df.dtypes):
        c = F.col(name)
        aggs.append(F.count_if(c.isNull()).alias(f"_n{i}"))
        sample = F.min(c)
        sample = F.md5(sample) if name in hash_long_text else sample.cast("string")
        aggs.append(sample.alias(f"_s{i}"))
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(name).alias("column_name"), F.lit(dtype).alias("data_type"),
                              F.col(f"_n{i}").alias("null_count"), F.col(f"_s{i}").alias("sample_value"))
                     for i, (name, dtype) in enumerate(df.dtypes)])
    return wide.select(F.inline(rows), F.col("_total").alias("total_rows"))
