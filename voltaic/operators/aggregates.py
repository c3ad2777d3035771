"""Aggregations.

Record model of the serving layer: one row per (region, timestamp) with a
``sources`` map (source -> MW), ``facteur_charge`` and ``consommation_mw``.
Maps are built with ``collect_list`` per (region, timestamp): after the fact
key (region, timestamp, source) is unique, a group holds at most one entry per
source, so no group grows with the data. Every aggregate here is
partial-aggregated before its shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaic.constants import (
    FILIERE_MAP, REGION_BALANCE_TOLERANCE, SOURCE_COLUMN_MAP, SOURCES, THERMAL_MW, THERMAL_SOURCE,
)
from voltaic.functions.columns import canonical_region_code, js_round, kw_to_mw, safe_double
from voltaic.functions.maps import map_total_positive, positive_only
from voltaic.operators.joins import factor_map

# ----------------------------------------------------------------------------
# Pivot and unpivot
# ----------------------------------------------------------------------------


def production_records(long: DataFrame, code: str = "code_insee", name: str = "nom_region",
                       ts: str = "horodatage", source: str = "source_name", mw: str = "valeur_mw",
                       load_factor: str = "facteur_charge", conso: str = "consommation_mw",
                       drop_all_zero: bool = True) -> DataFrame:
    """A01 core: flat (region, ts, source, MW) rows -> one record per (region, ts).

    ``sources`` is a map ordered by source name; ``facteur_charge`` and
    ``consommation_mw`` come from the first source by name. Records whose
    sources are all exactly 0 are dropped (a NULL value counts as non-zero).
    """
    entry = F.struct(F.col(source).alias("key"), F.col(mw).cast("double").alias("value"))
    first = F.min_by(F.struct(F.col(load_factor).cast("double").alias("fc"),
                              F.col(conso).cast("double").alias("conso")), F.col(source))
    value = F.col(mw)
    rec = (long.groupBy(F.col(code).alias("code_insee"), F.col(name).alias("region"),
                        F.col(ts).alias("timestamp"))
               .agg(F.array_sort(F.collect_list(entry)).alias("_e"), first.alias("_f"),
                    F.bool_or(value.isNull() | (value != 0)).alias("_keep")))
    if drop_all_zero:
        rec = rec.where(F.col("_keep"))
    return rec.select("code_insee", "region", "timestamp",
                      F.map_from_entries("_e").alias("sources"),
                      F.col("_f.fc").alias("facteur_charge"),
                      F.col("_f.conso").alias("consommation_mw"))


def production_wide(long: DataFrame, keys: Sequence[str] = ("code_insee", "horodatage"),
                    source: str = "source_name", mw: str = "valeur_mw",
                    sources: Sequence[str] = SOURCES, drop_all_zero: bool = False) -> DataFrame:
    """One column per source (fixed list), one aggregation on the keys.

    ``drop_all_zero`` leaves out rows whose MW are all exactly 0, as A01 does (a NULL counts as non-zero).
    """
    value = F.col(mw).cast("double")
    wide = long.groupBy(*keys).agg(*[F.max(F.when(F.col(source) == s, value)).alias(s) for s in sources],
                                   F.bool_or(value.isNull() | (value != 0)).alias("_keep"))
    return (wide.where("_keep") if drop_all_zero else wide).drop("_keep")


def unpivot_sources(wide: DataFrame, ids: Sequence[str],
                    mapping: Mapping[str, str] = SOURCE_COLUMN_MAP,
                    source_col: str = "source_name", value_col: str = "valeur_mw",
                    include_thermal: bool = True) -> DataFrame:
    """Wide Silver rows -> long rows for the mapped sources; NULL MW dropped.

    D19: a ``thermique_mw`` column, when present, becomes source ``thermique``
    (``include_thermal=False`` restores the 8-source behaviour).
    """
    if include_thermal and THERMAL_MW in wide.columns:
        mapping = {**mapping, THERMAL_MW: THERMAL_SOURCE}
    present = [c for c in mapping if c in wide.columns]
    if not present:
        return wide.select(*ids, F.lit(None).cast("string").alias(source_col),
                           F.lit(None).cast("double").alias(value_col)).limit(0)
    base = wide.select(*ids, *[F.col(c).cast("double").alias(c) for c in present])
    long = base.unpivot(list(ids), present, "_col", value_col)
    names = F.create_map(*[x for c in present for x in (F.lit(c), F.lit(mapping[c]))])
    return (long.where(F.col(value_col).isNotNull())
                .select(*ids, F.element_at(names, F.col("_col")).alias(source_col), value_col))


# ----------------------------------------------------------------------------
# Loader summaries and capacity
# ----------------------------------------------------------------------------


def fact_summary(fact: DataFrame, region: str = "id_region", source: str = "id_source",
                 date: str = "id_date", mw: str = "valeur_mw",
                 load_factor: str = "facteur_charge") -> DataFrame:
    """Row count, distinct regions/sources/dates, avg MW (2 dp), rows with load factor."""
    return fact.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct(region).alias("regions"),
        F.count_distinct(source).alias("sources"),
        F.count_distinct(date).alias("dates"),
        F.round(F.avg(F.col(mw).cast("decimal(18,4)")).cast("double"), 2).alias("avg_mw"),
        F.count(load_factor).alias("rows_with_load_factor"),
    )


def fact_count(fact: DataFrame) -> DataFrame:
    """COUNT(*) as a one-row frame."""
    return fact.agg(F.count(F.lit(1)).alias("n"))


def status_summary(dim_region: DataFrame, status: str = "status") -> DataFrame:
    """Count per lifecycle status."""
    return dim_region.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def filiere_map(mapping: Mapping[str, str] = FILIERE_MAP) -> Column:
    return F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])


def canonical_source(c, mapping: Mapping[str, str] = FILIERE_MAP) -> Column:
    """lower/trim label -> one of the 8 sources; unknown -> NULL (caller drops)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.element_at(filiere_map(mapping), F.lower(F.trim(col)))


def capacity_by_region_source(raw: DataFrame, code: str, name: str, filiere: str, kw: str,
                              order: Sequence[str], year_col: str | None = None,
                              year: int | None = None) -> DataFrame:
    """Installed MW per (region, source[, year]) from a raw register.

    Labels canonicalised (P11), region codes normalised (P12), kW -> MW (P13);
    sum rounded to 2 dp, groups <= 0 dropped; region name = last seen in
    ``order``; year from ``year_col`` when given, else the ``year`` argument.
    """
    staged = raw.select(
        canonical_region_code(F.col(code)).alias("code_insee_region"),
        F.col(name).alias("_name"),
        canonical_source(filiere).alias("source_name"),
        kw_to_mw(F.col(kw)).alias("_mw"),
        (safe_double(F.col(year_col)).try_cast("int") if year_col else F.lit(year).cast("int")).alias("annee"),
        F.struct(*[F.col(o) for o in order]).alias("_ord"),
    ).where(F.col("code_insee_region").isNotNull() & F.col("source_name").isNotNull())
    agg = staged.groupBy("code_insee_region", "source_name", "annee").agg(
        F.round(F.sum(F.col("_mw").cast("decimal(28,6)")), 2).cast("double").alias("puissance_installee_mw"),
        F.max_by("_name", "_ord").alias("libelle_region"))
    return (agg.where(F.col("puissance_installee_mw") > 0)
               .select("code_insee_region", "libelle_region", "source_name", "annee",
                       "puissance_installee_mw"))


# ----------------------------------------------------------------------------
# Dashboard analytics over records
# ----------------------------------------------------------------------------


def national_by_timestamp(records: DataFrame, sources: Sequence[str] = (*SOURCES, THERMAL_SOURCE)) -> DataFrame:
    """Per timestamp, sum of positive MW per source and sum of non-NULL consumption.

    One aggregation on the timestamp with a partial sum per source of the fixed list (the production sources
    and the thermal feed column); the map holds the sources with a positive reading.
    """
    def total(s: str):
        v = F.try_element_at("sources", F.lit(s))
        return F.sum(F.when(v > 0, v.cast("decimal(28,4)"))).cast("double").alias(f"_mw_{s}")

    names = sorted(sources)
    sums = records.groupBy("timestamp").agg(*[total(s) for s in names],
                                            F.sum(F.col("consommation_mw").cast("decimal(28,4)")).cast("double")
                                            .alias("consommation_mw"))
    entries = F.array(*[F.struct(F.lit(s).alias("key"), F.col(f"_mw_{s}").alias("value")) for s in names])
    return sums.select("timestamp", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("sources"),
                       "consommation_mw")


def national_meteo(meteo: DataFrame, ts: str = "timestamp", temp: str = "temperature_c",
                   wind: str = "wind_speed_10m", cloud: str = "cloudcover_pct",
                   null_as_zero: bool = False) -> DataFrame:
    """National means per timestamp: temperature and wind 1 dp, cloud 0 dp.

    Default mean skips NULLs; ``null_as_zero`` reproduces the dashboard's
    division by all rows (NULL counted as 0).
    """
    def mean(c):
        d = F.col(c).cast("decimal(18,4)")
        if null_as_zero:
            return F.sum(F.coalesce(d, F.lit(0))).cast("double") / F.count(F.lit(1))
        return F.sum(d).cast("double") / F.count(c)
    return meteo.groupBy(F.col(ts).alias("timestamp")).agg(
        js_round(mean(temp), 1).alias("temperature_c"),
        js_round(mean(wind), 1).alias("wind_speed_10m"),
        js_round(mean(cloud), 0).alias("cloudcover_pct"))


def latest_by_region(records: DataFrame) -> DataFrame:
    """A10: newest record per region with its total positive MW and consumption."""
    last = F.max_by(F.struct("timestamp", "region", "sources", "consommation_mw"), "timestamp")
    g = records.groupBy("code_insee").agg(last.alias("_l"))
    return g.select("code_insee", F.col("_l.region").alias("region"),
                    F.col("_l.timestamp").alias("timestamp"),
                    F.col("_l.sources").alias("sources"),
                    map_total_positive(F.col("_l.sources")).alias("total_mw"),
                    F.col("_l.consommation_mw").alias("consommation_mw"))


def balance_state(prod, conso, tol: float) -> Column:
    """surplus / deficit / balanced by relative gap; no_data without consumption."""
    p = F.col(prod) if isinstance(prod, str) else prod
    c = F.col(conso) if isinstance(conso, str) else conso
    ratio = (p - c) / c
    return (F.when(c.isNull() | (c == 0), "no_data")
             .when(ratio > tol, "surplus").when(ratio < -tol, "deficit").otherwise("balanced"))


def region_balance(latest: DataFrame, tol: float = REGION_BALANCE_TOLERANCE) -> DataFrame:
    """Per region ratio (prod - conso) / conso and its state (±15 %)."""
    c = F.col("consommation_mw")
    return latest.select(
        "code_insee", "region", "timestamp", "total_mw", "consommation_mw",
        F.when(c.isNull() | (c == 0), None).otherwise((F.col("total_mw") - c) / c).alias("ratio"),
        balance_state("total_mw", "consommation_mw", tol).alias("state"))


def latest_point(series: DataFrame) -> DataFrame:
    """The single newest row of a (timestamp, sources, consommation_mw) series."""
    last = F.max_by(F.struct(*series.columns), "timestamp")
    return series.agg(last.alias("_l")).select("_l.*").where(F.col("timestamp").isNotNull())


def total_mw(series: DataFrame) -> DataFrame:
    """Rounded total positive MW at the newest timestamp."""
    return latest_point(series).select(
        "timestamp", js_round(map_total_positive("sources")).alias("total_mw"))


def _ranked_entries(m) -> Column:
    """Positive entries as array<struct<neg_mw, source, mw>> sorted by MW desc, name asc."""
    return F.array_sort(F.transform(F.map_entries(positive_only(m)), lambda e: F.struct(
        (-e["value"]).alias("neg_mw"), e["key"].alias("source"), e["value"].alias("mw"))))


def dominant_source(series: DataFrame) -> DataFrame:
    """The source with the largest positive MW at the newest timestamp (name breaks ties)."""
    lp = latest_point(series)
    top = F.element_at(_ranked_entries("sources"), 1)
    return lp.select("timestamp", top["source"].alias("source"), top["mw"].alias("mw"))


def top_sources(records: DataFrame, n: int = 7, by: Sequence[str] = ("code_insee",)) -> DataFrame:
    """Per group, the newest record's positive sources sorted by MW, top ``n``.

    The ranking is an array sort inside each (at most |sources|-entry) record.
    """
    last = F.max_by(F.struct("timestamp", "sources"), "timestamp")
    g = records.groupBy(*by).agg(last.alias("_l"))
    ranked = F.slice(_ranked_entries(F.col("_l.sources")), 1, n)
    return g.select(*by, F.col("_l.timestamp").alias("timestamp"),
                    F.posexplode(ranked).alias("_p", "_e")).select(
        *by, "timestamp", (F.col("_p") + 1).alias("rank"),
        F.col("_e.source").alias("source"), F.col("_e.mw").alias("mw"))


def carbon_intensity_expr(m, factors: Mapping[str, float] | None = None) -> Column:
    """A15 on one map: round(Σ mw·factor / Σ mw) over positive MW; 0 without production.

    Computed in exact decimal arithmetic so the result does not depend on the
    summation order; unknown sources weigh 0 but their MW counts.
    """
    fm = factor_map(factors)
    ents = F.map_entries(positive_only(m))
    acc_t = "decimal(38,6)"
    zero = F.lit(0).cast(acc_t)
    w = F.aggregate(ents, zero, lambda acc, e: (acc + e["value"].cast("decimal(20,4)")
                    * F.coalesce(F.element_at(fm, e["key"]), F.lit(0.0)).cast("decimal(12,4)")).cast(acc_t))
    t = F.aggregate(ents, zero, lambda acc, e: (acc + e["value"].cast("decimal(20,4)")).cast(acc_t))
    return F.when(t == 0, F.lit(0.0)).otherwise(F.floor(w / t + F.lit(0.5)).cast("double"))


def carbon_intensity(series: DataFrame, factors: Mapping[str, float] | None = None,
                     keep: Sequence[str] = ("timestamp",)) -> DataFrame:
    """A15 + A16: intensity per row of a sources series, its band and gauge value."""
    from voltaic.functions.maps import carbon_band, carbon_gauge_value
    ci = carbon_intensity_expr("sources", factors)
    return series.select(*keep, ci.alias("intensity")).withColumns({
        "band": carbon_band("intensity"), "gauge": carbon_gauge_value("intensity")})


def carbon_series(series: DataFrame, n: int = 96, factors: Mapping[str, float] | None = None) -> DataFrame:
    """Intensity of the newest ``n`` points (top-n by time, not a full sort)."""
    last = series.orderBy(F.col("timestamp").desc()).limit(n)
    return carbon_intensity(last, factors).select("timestamp", "intensity")


def capacity_latest_year(capacity: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per source the row of the highest year (smallest region code on ties), MW rounded."""
    pick = F.min_by(F.struct("annee", "code_insee_region", "puissance_installee_mw"),
                    F.struct((-F.col("annee")).alias("a"), F.col("code_insee_region").alias("c")))
    g = capacity.where(F.col("source_name").isNotNull()).groupBy(*by, "source_name").agg(pick.alias("_r"))
    return g.select(*by, "source_name", F.col("_r.annee").alias("annee"),
                    F.coalesce(js_round(F.col("_r.puissance_installee_mw")), F.lit(0.0)).alias("puissance"))


def prod_vs_conso(series: DataFrame) -> DataFrame:
    """Rounded production and consumption; surplus zone = production when above."""
    prod = js_round(map_total_positive("sources"))
    conso = js_round(F.col("consommation_mw"))
    return series.select("timestamp", prod.alias("prod"), conso.alias("conso")).withColumn(
        "surplus_zone", F.when(F.col("conso").isNotNull() & (F.col("prod") > F.col("conso")), F.col("prod")))


def source_universe(records: DataFrame) -> DataFrame:
    """Sorted union of source keys over all records (one row)."""
    keys = records.select(F.explode(F.map_keys("sources")).alias("source")).distinct()
    return keys.agg(F.sort_array(F.collect_list("source")).alias("sources"))


def time_extent(df: DataFrame, ts: str, region: str) -> DataFrame:
    """First and last timestamp, number of rows and of regions processed (``regions_processed`` names them)."""
    per_region = df.groupBy(region).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"), F.count(F.lit(1)).alias("n"))
    return per_region.agg(F.min("lo").alias("start"), F.max("hi").alias("end"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                          F.count(region).alias("regions"))


def regions_processed(df: DataFrame, region: str) -> DataFrame:
    """The regions processed, one row each."""
    return df.select(F.col(region).alias("region")).where("region IS NOT NULL").distinct()


def region_directory(records: DataFrame, code: str = "code_insee", name: str = "region",
                     order: Sequence[str] = ("timestamp",), collation: str = "fr") -> DataFrame:
    """Distinct regions (first non-blank name) ordered by name, locale-aware."""
    from voltaic.operators.dedup import distinct_first_label
    d = distinct_first_label(records, code, name, order, code_alias="code_insee", label_alias="region")
    return d.orderBy(F.collate(F.col("region"), collation), "code_insee")


def active_regions(records: DataFrame) -> DataFrame:
    """Number of regions with data and records per region."""
    return records.groupBy("code_insee").agg(F.count(F.lit(1)).alias("data_points")) \
        .agg(F.count(F.lit(1)).alias("active_regions"), F.sum("data_points").alias("data_points"))


def data_points(records: DataFrame, code: str) -> DataFrame:
    """Records for one region."""
    return records.where(F.col("code_insee") == code).agg(F.count(F.lit(1)).alias("data_points"))


def emission_factor_dim(raw: DataFrame) -> DataFrame:
    """Typed emission-factor dimension, latest year per (filiere, source).

    Several lines of one key and year are resolved by the largest factors
    (CO2, then CH4, N2O, publisher), so the pick is a total order. Output
    column ``factor`` (kg CO2 per MWh = g per kWh) feeds J10.
    """
    typed = raw.select(
        F.lower(F.trim("filiere")).alias("filiere"),
        F.lower(F.trim("source_energie")).alias("source_name"),
        F.col("facteur_emission_co2_kg_mwh").try_cast("double").alias("co2_kg_mwh"),
        F.col("facteur_emission_ch4_kg_mwh").try_cast("double").alias("ch4_kg_mwh"),
        F.col("facteur_emission_n2o_kg_mwh").try_cast("double").alias("n2o_kg_mwh"),
        F.col("source").alias("reference"),
        F.col("annee").try_cast("int").alias("annee"),
    )
    last = F.max_by(F.struct("co2_kg_mwh", "ch4_kg_mwh", "n2o_kg_mwh", "reference", "annee"),
                    F.struct("annee", "co2_kg_mwh", "ch4_kg_mwh", "n2o_kg_mwh", "reference"))
    g = typed.groupBy("filiere", "source_name").agg(last.alias("_r"))
    return g.select("filiere", "source_name", "_r.*").withColumn("factor", F.col("co2_kg_mwh"))


def load_factor(long: DataFrame, capacity: DataFrame, region: str = "id_region", source: str = "id_source",
                mw: str = "valeur_mw", out: str = "facteur_charge") -> DataFrame:
    """P17 (D07): MW / installed capacity, by (region, source) when known, else by source.

    ``capacity`` has (region, source, puissance_installee_mw) with region NULL
    for national figures. A missing or zero capacity gives NULL (``try_divide``).
    The capacity side is reduced to one row per (region, source) first (the
    latest ``annee`` when the register has years, else the largest value), so
    the joins never multiply fact rows; it is a dimension-sized side.
    """
    mw_cap = F.col("puissance_installee_mw").cast("double")
    pick = (F.max_by(mw_cap, F.struct(F.col("annee"), mw_cap)) if "annee" in capacity.columns
            else F.max(mw_cap))
    reg = capacity.where(F.col(region).isNotNull()).groupBy(
        F.col(region).alias("_cr"), F.col(source).alias("_cs")).agg(pick.alias("_cap_r"))
    nat = capacity.where(F.col(region).isNull()).groupBy(F.col(source).alias("_ns")).agg(pick.alias("_cap_n"))
    j = (long.join(reg, (F.col(region) == F.col("_cr")) & (F.col(source) == F.col("_cs")), "left")
             .join(nat, F.col(source) == F.col("_ns"), "left"))
    cap = F.coalesce(F.col("_cap_r"), F.col("_cap_n"))
    return j.withColumn(out, F.try_divide(F.col(mw).cast("double"), cap.cast("double"))) \
            .drop("_cr", "_cs", "_cap_r", "_ns", "_cap_n")


def side_by_side(*frames: DataFrame) -> DataFrame:
    """Combine one-row frames with distinct columns into one row, without a join.

    The rows are stacked (``unionByName`` with missing columns as NULL) and
    folded with ``first(ignorenulls)`` per column.
    """
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    cols = [c for f in frames for c in f.columns]
    return out.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])
