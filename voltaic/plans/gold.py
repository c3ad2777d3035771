"""Gold layer built from the bound driver tables: fact, dimensions, records, series.

Each builder is a lazy DataFrame; the catalog composes them. Reused inputs are
cheap to recompute at test scale; on a cluster the fact and the record table
are the natural points to persist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaic.operators.aggregates import national_by_timestamp, production_records
from voltaic.operators.dedup import dedup_keep_last
from voltaic.operators.joins import star_join
from voltaic.plans import silver, standins

FACT_KEYS = ["id_region", "id_date", "id_source"]
FACT_COLS = ["id_region", "id_date", "id_source", "valeur_mw", "facteur_charge", "consommation_mw"]


# Load order of staged rows. (batch, position) repeats in the bound data, so the
# values themselves break remaining ties: the order is total over distinct outcomes.
LOAD_ORDER = ["load_batch", "load_pos", "valeur_mw", "facteur_charge", "consommation_mw"]


def fact_from_staged(staged: DataFrame) -> DataFrame:
    """K01 on staged rows: keep-last per (region, date key, source) in load order."""
    rows = standins.to_fact_rows(staged)
    return dedup_keep_last(rows, FACT_KEYS, LOAD_ORDER).select(*FACT_COLS)


def fact(spark: SparkSession, d: str, region: str | None = None, start: str | None = None,
         end: str | None = None, source: str | None = None) -> DataFrame:
    """Gold fact; optional filters on key columns are applied *before* keep-last.

    Filtering on key columns commutes with keep-last per key, and on the
    staged rows the time bound reaches the ship-date column of the Parquet
    scan (``PushedFilters``).
    """
    from voltaic.operators.paging import apply_filters
    staged = standins.fact_staged(spark, d)
    if any(v is not None for v in (region, start, end, source)):
        staged = apply_filters(staged, region=region, start=start, end=end, source=source,
                               region_col="region_code", ts_col="ts", source_col="source_name")
    return fact_from_staged(staged)


def prod_long(spark: SparkSession, d: str, stored_time: bool = False, **filters) -> DataFrame:
    """Fact ⋈ region ⋈ time ⋈ source, flat rows of the serving query (optional L07 filters).

    ``stored_time`` joins the stored time dimension; otherwise the instant comes from the date key.
    """
    time = standins.dim_time(spark, d) if stored_time else None
    j = star_join(fact(spark, d, **filters), standins.dim_region(spark, d), time, standins.dim_source(spark))
    return j.select("code_insee", "nom_region", "horodatage", "source_name", "valeur_mw",
                    "facteur_charge", "consommation_mw")


def records(spark: SparkSession, d: str, **filters) -> DataFrame:
    """A01 records over the whole fact (or the filtered part of it)."""
    return production_records(prod_long(spark, d, **filters))


def records_long(recs: DataFrame) -> DataFrame:
    """Records back to (code, ts, source, MW) rows (at most |sources| per record)."""
    return recs.select("code_insee", "region", "timestamp", "facteur_charge", "consommation_mw",
                       F.explode("sources").alias("source_name", "valeur_mw"))


def national(spark: SparkSession, d: str, **filters) -> DataFrame:
    """A08 national series (optional L07 filters, applied to the fact's scan)."""
    return national_by_timestamp(records(spark, d, **filters))


def silver_readings(spark: SparkSession, d: str):
    """(Silver readings, quality metrics)."""
    return silver.transform_readings(standins.raw_readings(spark, d))


def meteo(spark: SparkSession, d: str) -> DataFrame:
    """Weather fact: keep-last per (region, hour) in load order."""
    rows = standins.meteo_rows(spark, d)
    return dedup_keep_last(rows, ["code_insee", "timestamp"], ["load_ordinal"]).drop("load_ordinal")


def capacity(spark: SparkSession, d: str, brand: str | None = None) -> DataFrame:
    """A07 over the bound capacity register (year taken from its column)."""
    from voltaic.operators.aggregates import capacity_by_region_source
    raw = standins.capacity_raw(spark, d, brand=brand)
    return capacity_by_region_source(raw, "coderegion", "region", "filiere", "puismaxinstallee",
                                     ["load_ordinal"], year_col="annee")


def maintenance(spark: SparkSession, d: str, statuses=None) -> DataFrame:
    """Outage Silver (optionally one scrape's reports)."""
    return silver.transform_maintenance(standins.maintenance_raw(spark, d, statuses=statuses))
