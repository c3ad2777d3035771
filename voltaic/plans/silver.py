"""Silver transforms: raw feed rows -> cleaned, de-duplicated, typed tables.

Order of steps for every dataset: drop NULL keys -> keep-last per key ->
fill / flag (one rule for all datasets, so forward fill never sees
duplicates).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaic.constants import (
    CAPACITY_QUALITY_RULES, DROP_COLUMNS, ERA5_QUALITY_RULES, MW_CAST_COLUMNS, RENAME_MAP,
    RTE_QUALITY_RULES, THERMAL_MW, THERMAL_RAW,
)
from voltaic.functions.columns import (
    clean_text, kelvin_to_celsius, parse_mw, parse_utc, safe_double, wind_speed,
)
from voltaic.operators.dedup import dedup_keep_last
from voltaic.operators.nulls import apply_quality_rules, null_drop
from voltaic.operators.joins import nearest_centroid
from voltaic.constants import FRANCE_LAT_MAX, FRANCE_LAT_MIN, FRANCE_LON_MAX, FRANCE_LON_MIN


def drop_artifacts(df: DataFrame, cols: Sequence[str] = DROP_COLUMNS) -> DataFrame:
    """Drop artefact columns when present."""
    return df.drop(*[c for c in cols if c in df.columns])


def safe_numeric(df: DataFrame, cols: Sequence[str] = MW_CAST_COLUMNS) -> DataFrame:
    """text/number -> double, unparsable -> NULL, for the columns present."""
    return df.withColumns({c: safe_double(c) for c in cols if c in df.columns})


def rename_columns(df: DataFrame, mapping=RENAME_MAP) -> DataFrame:
    """Raw feed names -> Silver names (absent names ignored)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def parse_times(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """ISO text with offset -> UTC wall-clock ``timestamp_ntz`` (session TZ is UTC)."""
    return df.withColumns({c: parse_utc(c).cast("timestamp_ntz") for c in cols if c in df.columns})


def readings_columns(raw: DataFrame, include_thermal: bool = True) -> DataFrame:
    """Row-local part of the readings Silver step (P01-P04); usable on a stream.

    With ``include_thermal`` (D19) a ``thermique`` feed column is typed and
    kept as ``thermique_mw`` instead of being lost.
    """
    df = drop_artifacts(raw)
    extra = [THERMAL_RAW] if include_thermal and THERMAL_RAW in df.columns else []
    df = safe_numeric(df, list(MW_CAST_COLUMNS) + extra)
    if "consommation" in df.columns:
        df = df.withColumn("consommation", safe_double("consommation"))
    df = rename_columns(df, {**RENAME_MAP, **({THERMAL_RAW: THERMAL_MW} if extra else {})})
    return parse_times(df, ["date_heure"])


def transform_readings(raw: DataFrame, order: Sequence[str] = ("load_ordinal",),
                       keys: Sequence[str] = ("code_insee_region", "date_heure"),
                       rules=RTE_QUALITY_RULES) -> tuple[DataFrame, DataFrame]:
    """Regional readings -> Silver (P01-P04, K01, N01/N04); returns (silver, metrics)."""
    df = readings_columns(raw)
    if THERMAL_MW in df.columns:
        rules = {**rules, THERMAL_MW: "flag"}
    return apply_quality_rules(df, rules, "rte", dedup=lambda d: dedup_keep_last(d, list(keys), list(order)).drop(*order))


def transform_capacity(raw: DataFrame, order: Sequence[str] = ("load_ordinal",),
                       rules=CAPACITY_QUALITY_RULES) -> tuple[DataFrame, DataFrame]:
    """Capacity CSV rows -> Silver: typed MW, keep-last per (region, filiere), rules."""
    df = raw
    if "puissance_installee_mw" in df.columns:
        df = df.withColumn("puissance_installee_mw", safe_double("puissance_installee_mw"))
    keys = ["code_insee_region", "filiere"]
    return apply_quality_rules(df, rules, "capacity", dedup=lambda d: dedup_keep_last(d, keys, list(order)))


def bbox_filter(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Keep points inside the metropolitan bounding box (inclusive); pushes to Parquet."""
    return df.where(F.col(lat).between(FRANCE_LAT_MIN, FRANCE_LAT_MAX)
                    & F.col(lon).between(FRANCE_LON_MIN, FRANCE_LON_MAX))


def transform_climate(grid: DataFrame, rules=ERA5_QUALITY_RULES, aggregate: str = "mean",
                      order: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Climate grid -> Silver per (region, valid_time).

    P14 bbox, P08 wind speed (unless present), P09 Kelvin -> Celsius, J08
    nearest region centroid, then per (region, valid_time) either the mean
    over grid points (default) or keep-last in ``order``; then FILL_ZERO for
    wind / radiation and per-region FORWARD_FILL of temperature.
    """
    df = bbox_filter(grid)
    if "wind_speed_100m" not in df.columns:
        df = df.withColumn("wind_speed_100m", wind_speed("u100", "v100"))
    df = df.withColumn("temperature_c", kelvin_to_celsius("t2m"))
    df = nearest_centroid(df, "latitude", "longitude", out="region_code")
    keys = ["region_code", "valid_time"]
    df = null_drop(df, keys)
    if aggregate == "mean":
        df = df.groupBy(*keys).agg(
            F.avg("wind_speed_100m").alias("wind_speed_100m"),
            F.avg(F.col("temperature_c").cast("decimal(18,4)")).cast("double").alias("temperature_c"),
            F.avg("ssrd").alias("ssrd"),
            F.count(F.lit(1)).alias("grid_points"))
    else:
        df = dedup_keep_last(df.select(*keys, "wind_speed_100m", "temperature_c", "ssrd", *order),
                             keys, list(order)).drop(*order)
    return apply_quality_rules(df, rules, "era5", entity=["region_code"], order="valid_time", bucket="month")


def transform_maintenance(raw: DataFrame, order: Sequence[str] = ("load_ordinal",)) -> DataFrame:
    """Outage events -> Silver: UTC times, MW parsed, text cleaned, keep-last per event_id."""
    df = raw.withColumns({
        "start_date": parse_utc("start_date").cast("timestamp_ntz"),
        "end_date": parse_utc("end_date").cast("timestamp_ntz"),
        "unavailable_mw": parse_mw("unavailable_mw") if dict(raw.dtypes).get("unavailable_mw") == "string"
        else F.col("unavailable_mw").cast("double"),
        "description": clean_text("description"),
    })
    df = df.where(F.col("event_id").isNotNull() & (F.col("event_id") != ""))
    df = dedup_keep_last(df, ["event_id"], list(order))
    return df.drop(*[o for o in order if o in df.columns])
