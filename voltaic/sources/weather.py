"""Hourly weather payloads (S15) and their normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_hourly_payload(df: DataFrame, keys=("code_insee",), hourly: str = "hourly") -> DataFrame:
    """Struct of parallel arrays -> one row per hour.

    Arrays are cut to the shortest one first (``arrays_zip`` would pad with
    NULL); rows without temperature are dropped; wind and cloud keep NULLs.
    """
    h = F.col(hourly)
    names = ["time", "temperature_2m", "wind_speed_10m", "cloudcover"]
    n = F.least(*[F.coalesce(F.size(h[c]), F.lit(0)) for c in names])
    zipped = F.arrays_zip(*[F.slice(h[c], 1, n).alias(c) for c in names])
    rows = df.select(*keys, F.inline(zipped))
    return (rows.where(F.col("temperature_2m").isNotNull())
                .select(*keys, F.col("time"), F.col("temperature_2m").cast("double").alias("temperature_c"),
                        F.col("wind_speed_10m").cast("double").alias("wind_speed_10m"),
                        F.col("cloudcover").cast("double").alias("cloudcover_pct")))


def normalize_meteo(df: DataFrame, tz: str = "Europe/Paris", time_col: str = "time") -> DataFrame:
    """Local ``yyyy-MM-ddTHH:mm`` -> UTC timestamp; rows without time or temperature dropped."""
    local = F.try_to_timestamp(F.col(time_col), F.lit("yyyy-MM-dd'T'HH:mm"))
    out = df.withColumn("timestamp", F.to_utc_timestamp(local, tz).cast("timestamp_ntz"))
    return out.dropna(subset=["timestamp", "temperature_c"]).drop(time_col)
