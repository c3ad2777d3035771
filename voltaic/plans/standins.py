"""Bindings of the driver's tables to the energy schemas.

The energy feeds are not part of the test data, so every operator is bound to
rows of the driver tables that carry the same *schema*. A binding only renames
and re-types columns (and joins a dimension name in); it does no work of the
operator it feeds — duplicates, NULLs, bad text and time zones all come from
the data and are handled by the library code downstream.

Each binding has a Spark builder and the equivalent DuckDB CTE (used by the
oracle SQL), kept next to each other.

FIXED VALUES of the bindings (role of each driver value):
  part.p_type   -> source:  ECONOMY nucleaire, LARGE eolien, MEDIUM solaire,
                            PROMO hydraulique, SMALL gaz, STANDARD bioenergies
  events.event_type -> raw feed column: click nucleaire, view eolien,
                            purchase solaire, signup hydraulique, error gaz
  part.p_type   -> capacity label: ECONOMY Nucléaire, LARGE Éolien terrestre,
                            MEDIUM Photovoltaïque, PROMO Hydraulique - lacs,
                            SMALL Thermique gaz, STANDARD Bioénergies
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaic.constants import DEFAULT_SOURCES, FILIERE_MAP
from voltaic.functions.calendar import date_key, from_date_key

P_TYPE_SOURCE = [
    ("ECONOMY", "nucleaire"), ("LARGE", "eolien"), ("MEDIUM", "solaire"),
    ("PROMO", "hydraulique"), ("SMALL", "gaz"), ("STANDARD", "bioenergies"),
]
EVENT_COLUMN = [
    ("click", "nucleaire"), ("view", "eolien"), ("purchase", "solaire"),
    ("signup", "hydraulique"), ("error", "gaz"),
]
P_TYPE_FILIERE = [
    ("ECONOMY", "Nucléaire"), ("LARGE", "Éolien terrestre"), ("MEDIUM", "Photovoltaïque"),
    ("PROMO", "Hydraulique - lacs"), ("SMALL", "Thermique gaz"), ("STANDARD", "Bioénergies"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(col, pairs, default):
    expr = None
    for k, v in pairs:
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(default)


def _sql_case(col: str, pairs, default: str) -> str:
    q = lambda x: x.replace("'", "''")
    arms = " ".join(f"WHEN '{q(k)}' THEN '{q(v)}'" for k, v in pairs)
    return f"CASE {col} {arms} ELSE {default} END"


# ---------------------------------------------------------------------------
# Staged production rows (lineitem ⋈ supplier ⋈ part)
# region = supplier nation, ts = ship date, source = part type,
# MW = 10·quantity − 100, load factor = discount, consumption = price / 100,
# load order = (orderkey, linenumber); that pair repeats in the data, so keep-last
# breaks the remaining ties on the values (plans.gold.LOAD_ORDER)
# ---------------------------------------------------------------------------

def fact_staged(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount",
        "l_extendedprice", "l_shipdate", "l_returnflag")
    sup = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    part = table(spark, d, "part").select("p_partkey", "p_type")
    j = li.join(sup, li.l_suppkey == sup.s_suppkey).join(part, li.l_partkey == part.p_partkey)
    return j.select(
        F.col("s_nationkey").cast("string").alias("region_code"),
        F.col("l_shipdate").alias("ts"),
        _case(F.col("p_type"), P_TYPE_SOURCE, F.lower("p_type")).alias("source_name"),
        (F.col("l_quantity") * 10 - 100).alias("valeur_mw"),
        F.col("l_discount").alias("facteur_charge"),
        (F.col("l_extendedprice") / 100).alias("consommation_mw"),
        F.col("l_orderkey").alias("load_batch"),
        F.col("l_linenumber").alias("load_pos"),
        F.col("l_returnflag").alias("batch_tag"),
    )


SQL_FACT_STAGED = f"""fact_staged AS (
  SELECT CAST(s.s_nationkey AS VARCHAR) AS region_code,
         l.l_shipdate AS ts,
         {_sql_case('p.p_type', P_TYPE_SOURCE, 'lower(p.p_type)')} AS source_name,
         l.l_quantity * 10 - 100 AS valeur_mw,
         l.l_discount AS facteur_charge,
         l.l_extendedprice / 100 AS consommation_mw,
         l.l_orderkey AS load_batch,
         l.l_linenumber AS load_pos,
         l.l_returnflag AS batch_tag
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
                  JOIN part p ON l.l_partkey = p.p_partkey)"""


def to_fact_rows(staged: DataFrame) -> DataFrame:
    """Staged rows -> Gold fact columns (natural keys, id_date = yyyyMMddHHmm)."""
    return staged.select(
        F.col("region_code").alias("id_region"), date_key("ts").alias("id_date"),
        F.col("source_name").alias("id_source"), "valeur_mw", "facteur_charge", "consommation_mw",
        "load_batch", "load_pos")


# SQL: fact after keep-last per (region, ts, source) in load order
SQL_FACT = """fact AS (
  SELECT region_code AS id_region, CAST(strftime(ts, '%Y%m%d%H%M') AS BIGINT) AS id_date,
         source_name AS id_source, valeur_mw, facteur_charge, consommation_mw
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY region_code, ts, source_name
                                     ORDER BY load_batch DESC, load_pos DESC, valeur_mw DESC,
                                              facteur_charge DESC, consommation_mw DESC) AS rn
        FROM fact_staged) x
  WHERE rn = 1)"""


def dim_region(spark: SparkSession, d: str) -> DataFrame:
    """Region dimension from ``nation``: code = nation key, name = nation name."""
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").cast("string").alias("id_region"),
                    F.col("n_nationkey").cast("string").alias("code_insee"),
                    F.col("n_name").alias("nom_region"))


SQL_DIM_REGION = """dim_region AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS id_region, CAST(n_nationkey AS VARCHAR) AS code_insee,
         n_name AS nom_region FROM nation)"""


def region_attrs(spark: SparkSession, d: str) -> DataFrame:
    """Region dimension with attributes: population = customers of the nation, area = its suppliers
    (NULL for a nation without suppliers)."""
    r = dim_region(spark, d).select("code_insee", "nom_region")
    pop = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("code_insee")) \
        .agg(F.count(F.lit(1)).alias("population"))
    area = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("code_insee")) \
        .agg(F.count(F.lit(1)).cast("double").alias("superficie_km2"))
    return r.join(pop, "code_insee", "left").join(area, "code_insee", "left") \
        .select("code_insee", "nom_region", "population", "superficie_km2")


SQL_REGION_ATTRS = """region_attrs AS (
  SELECT r.code_insee, r.nom_region, p.population, a.superficie_km2 FROM dim_region r
  LEFT JOIN (SELECT CAST(c_nationkey AS VARCHAR) AS code_insee, COUNT(*) AS population FROM customer GROUP BY 1) p
    ON r.code_insee = p.code_insee
  LEFT JOIN (SELECT CAST(s_nationkey AS VARCHAR) AS code_insee, CAST(COUNT(*) AS DOUBLE) AS superficie_km2
             FROM supplier GROUP BY 1) a ON r.code_insee = a.code_insee)"""


def dim_source(spark: SparkSession) -> DataFrame:
    """Source dimension: the 8 production sources (fixed; a literal table, broadcast)."""
    rows = ", ".join(f"('{s}', '{s}', {str(g).lower()})" for s, g in DEFAULT_SOURCES)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {rows} AS t(id_source, source_name, is_green)"))


SQL_DIM_SOURCE = "dim_source AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{s}', '{s}', {str(g).lower()})" for s, g in DEFAULT_SOURCES) + \
    ") t(id_source, source_name, is_green))"


def dim_time(spark: SparkSession, d: str) -> DataFrame:
    """Time dimension: every distinct ship instant of ``lineitem`` (a superset of the fact's)."""
    li = table(spark, d, "lineitem").select(date_key("l_shipdate").alias("id_date")).distinct()
    return li.select("id_date", from_date_key("id_date").alias("horodatage"))


SQL_DIM_TIME_LI = """dim_time AS (
  SELECT DISTINCT CAST(strftime(l_shipdate, '%Y%m%d%H%M') AS BIGINT) AS id_date,
         strptime(strftime(l_shipdate, '%Y%m%d%H%M'), '%Y%m%d%H%M') AS horodatage FROM lineitem)"""


def dim_time_from(fact: DataFrame) -> DataFrame:
    """Time dimension: distinct date keys of the fact, back to timestamps."""
    return fact.select("id_date").distinct().select("id_date", from_date_key("id_date").alias("horodatage"))


SQL_DIM_TIME = """dim_time AS (
  SELECT DISTINCT id_date, strptime(CAST(id_date AS VARCHAR), '%Y%m%d%H%M') AS horodatage FROM fact)"""

SQL_PROD_LONG = """prod_long AS (
  SELECT r.code_insee, r.nom_region, t.horodatage, s.source_name, f.valeur_mw, f.facteur_charge,
         f.consommation_mw
  FROM fact f JOIN dim_region r ON f.id_region = r.id_region
              JOIN dim_time t ON f.id_date = t.id_date
              JOIN dim_source s ON f.id_source = s.id_source)"""

# records of the serving layer, flattened: sources as sorted 'source:MW' text
SQL_RECORDS = """records AS (
  SELECT code_insee, nom_region AS region, horodatage AS timestamp,
         string_agg(source_name || ':' || COALESCE(CAST(CAST(valeur_mw AS DECIMAL(18,4)) AS VARCHAR), 'null'),
                    ';' ORDER BY source_name) AS sources_text,
         COUNT(*) AS n_sources,
         arg_min(facteur_charge, source_name) AS facteur_charge,
         arg_min(consommation_mw, source_name) AS consommation_mw
  FROM prod_long GROUP BY 1, 2, 3
  HAVING bool_or(valeur_mw IS NULL OR valeur_mw <> 0))"""

# long rows of the kept records
SQL_REC_LONG = """rec_long AS (
  SELECT p.* FROM prod_long p JOIN records r
    ON p.code_insee = r.code_insee AND p.horodatage = r.timestamp)"""

# national series: positive MW per (ts, source); consumption summed over records
SQL_NATIONAL = """nat_src AS (
  SELECT horodatage AS timestamp, source_name,
         CAST(SUM(CAST(valeur_mw AS DECIMAL(28,4))) AS DOUBLE) AS mw
  FROM rec_long WHERE valeur_mw > 0 GROUP BY 1, 2),
nat_conso AS (
  SELECT timestamp, CAST(SUM(CAST(consommation_mw AS DECIMAL(28,4))) AS DOUBLE) AS consommation_mw
  FROM records GROUP BY 1),
national AS (
  SELECT c.timestamp, c.consommation_mw,
         COALESCE((SELECT string_agg(s.source_name || ':' || CAST(CAST(s.mw AS DECIMAL(18,4)) AS VARCHAR),
                                     ';' ORDER BY s.source_name)
                   FROM nat_src s WHERE s.timestamp = c.timestamp), '') AS sources_text,
         COALESCE((SELECT SUM(CAST(s.mw AS DECIMAL(38,4))) FROM nat_src s WHERE s.timestamp = c.timestamp), 0)
           AS total_pos
  FROM nat_conso c)"""

SQL_GOLD = ",\n".join([SQL_FACT_STAGED, SQL_FACT, SQL_DIM_REGION, SQL_DIM_SOURCE, SQL_DIM_TIME_LI,
                       SQL_PROD_LONG])


# ---------------------------------------------------------------------------
# Raw regional readings (events): one raw feed record per event.
# region = user, time slot = 15-minute slot of ts written as Paris winter
# local time (+01:00), the event value lands in the column of its type as
# text ('ND' when above 150 for signup), consumption = 10·props.k,
# load order = event_id.
# ---------------------------------------------------------------------------

def raw_readings(spark: SparkSession, d: str) -> DataFrame:
    return raw_readings_from(table(spark, d, "events"))


def raw_readings_from(events: DataFrame) -> DataFrame:
    """Raw readings from an ``events`` frame (batch or stream)."""
    ev = events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    slot = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 900) * 900)
    local = slot + F.expr("INTERVAL 1 HOUR")
    cols = {}
    for etype, col in EVENT_COLUMN:
        txt = F.col("value").cast("string")
        if col == "hydraulique":
            txt = F.when(F.col("value") > 150, F.lit("ND")).otherwise(txt)
        cols[col] = F.when(F.col("event_type") == etype, txt)
    return ev.select(
        F.col("user_id").cast("string").alias("code_insee_region"),
        F.concat(F.lit("Region "), F.col("user_id").cast("string")).alias("libelle_region"),
        F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:00")).alias("date_heure"),
        *[c.alias(k) for k, c in cols.items()],
        (F.get_json_object("props", "$.k").cast("double") * 10).alias("consommation"),
        F.col("event_id").alias("load_ordinal"),
    )


SQL_RAW_READINGS = "raw_readings AS (\n  SELECT CAST(user_id AS VARCHAR) AS code_insee_region,\n" \
    "         'Region ' || CAST(user_id AS VARCHAR) AS libelle_region,\n" \
    "         strftime(time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') || '+01:00'" \
    " AS date_heure,\n" + "".join(
        f"         CASE WHEN event_type = '{e}' THEN "
        + ("CASE WHEN value > 150 THEN 'ND' ELSE CAST(value AS VARCHAR) END" if c == "hydraulique"
           else "CAST(value AS VARCHAR)") + f" END AS {c},\n" for e, c in EVENT_COLUMN) + \
    "         CAST(json_extract_string(props, '$.k') AS DOUBLE) * 10 AS consommation,\n" \
    "         event_id AS load_ordinal\n  FROM events)"


def raw_readings_damaged(spark: SparkSession, d: str) -> DataFrame:
    """Raw readings whose 'ND' records lost their region code, with an artefact column (``column_68``)."""
    raw = raw_readings(spark, d)
    lost = F.coalesce(F.col("hydraulique") == "ND", F.lit(False))
    return raw.withColumns({"code_insee_region": F.when(~lost, F.col("code_insee_region")),
                            "column_68": F.col("libelle_region")})


SQL_RAW_DAMAGED = SQL_RAW_READINGS + """,
damaged AS (
  SELECT CASE WHEN hydraulique = 'ND' THEN NULL ELSE code_insee_region END AS code_insee_region, libelle_region,
         CAST(substr(date_heure, 1, 19) AS TIMESTAMP) - INTERVAL 1 HOUR AS date_heure,
         consommation AS consommation_mw, TRY_CAST(trim(nucleaire) AS DOUBLE) AS nucleaire_mw,
         TRY_CAST(trim(eolien) AS DOUBLE) AS eolien_mw, TRY_CAST(trim(solaire) AS DOUBLE) AS solaire_mw,
         TRY_CAST(trim(hydraulique) AS DOUBLE) AS hydraulique_mw, TRY_CAST(trim(gaz) AS DOUBLE) AS gaz_mw, load_ordinal
  FROM raw_readings)"""

# Silver readings in SQL: cast, rename, UTC, keep-last per (region, slot), drop null keys
SQL_SILVER = SQL_RAW_READINGS + """,
silver AS (
  SELECT code_insee_region, libelle_region, date_heure, consommation_mw, nucleaire_mw, eolien_mw,
         solaire_mw, hydraulique_mw, gaz_mw
  FROM (SELECT code_insee_region, libelle_region,
               CAST(substr(date_heure, 1, 19) AS TIMESTAMP) - INTERVAL 1 HOUR AS date_heure,
               consommation AS consommation_mw,
               TRY_CAST(trim(nucleaire) AS DOUBLE) AS nucleaire_mw,
               TRY_CAST(trim(eolien) AS DOUBLE) AS eolien_mw,
               TRY_CAST(trim(solaire) AS DOUBLE) AS solaire_mw,
               TRY_CAST(trim(hydraulique) AS DOUBLE) AS hydraulique_mw,
               TRY_CAST(trim(gaz) AS DOUBLE) AS gaz_mw,
               ROW_NUMBER() OVER (PARTITION BY code_insee_region,
                                  CAST(substr(date_heure, 1, 19) AS TIMESTAMP)
                                  ORDER BY load_ordinal DESC) AS rn
        FROM raw_readings) x
  WHERE rn = 1 AND code_insee_region IS NOT NULL AND date_heure IS NOT NULL)"""


# ---------------------------------------------------------------------------
# Weather rows (events): region = user, hour of ts; temperature from click and
# view values, wind from all but error, cloud from all but purchase.
# ---------------------------------------------------------------------------

def meteo_rows(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    et = F.col("event_type")
    return ev.select(
        F.col("user_id").cast("string").alias("code_insee"),
        F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("timestamp"),
        F.when(et.isin("click", "view"), F.col("value") / 10 - 5).alias("temperature_c"),
        F.when(et != "error", F.col("value") / 20).alias("wind_speed_10m"),
        F.when(et != "purchase", F.col("value") / 5).alias("cloudcover_pct"),
        F.col("event_id").alias("load_ordinal"),
    )


SQL_METEO_ROWS = """meteo_rows AS (
  SELECT CAST(user_id AS VARCHAR) AS code_insee, date_trunc('hour', ts) AS timestamp,
         CASE WHEN event_type IN ('click', 'view') THEN value / 10 - 5 END AS temperature_c,
         CASE WHEN event_type <> 'error' THEN value / 20 END AS wind_speed_10m,
         CASE WHEN event_type <> 'purchase' THEN value / 5 END AS cloudcover_pct,
         event_id AS load_ordinal
  FROM events),
meteo AS (
  SELECT code_insee, timestamp, temperature_c, wind_speed_10m, cloudcover_pct
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY code_insee, timestamp ORDER BY load_ordinal DESC) AS rn
        FROM meteo_rows) x WHERE rn = 1)"""


# ---------------------------------------------------------------------------
# Capacity register rows (part): region code = size written as 'N.0',
# label by part type, kW = retail price with a decimal comma, year by price.
# ---------------------------------------------------------------------------

def capacity_raw(spark: SparkSession, d: str, brand: str | None = None) -> DataFrame:
    """Capacity register rows; ``brand`` keeps one operator's re-delivered part of it."""
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_size", "p_retailprice", "p_brand")
    if brand is not None:
        p = p.where(F.col("p_brand") == brand)
    return p.select(
        F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("coderegion"),
        F.concat(F.lit("Region "), F.col("p_size").cast("string")).alias("region"),
        _case(F.col("p_type"), P_TYPE_FILIERE, F.col("p_type")).alias("filiere"),
        F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(",")).alias("puismaxinstallee"),
        F.when(F.col("p_retailprice") < 950, 2023).otherwise(2024).alias("annee"),
        F.col("p_partkey").alias("load_ordinal"),
    )


def capacity_silver_raw(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the capacity CSV as Silver receives them: MW as text ('n.c.' from 990 up), no region code for size 50."""
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    return p.select(F.when(F.col("p_size") < 50, F.col("p_size").cast("string")).alias("code_insee_region"),
                    _case(F.col("p_type"), P_TYPE_FILIERE, F.col("p_type")).alias("filiere"),
                    F.when(F.col("p_retailprice") >= 990, F.lit("n.c.")).otherwise(F.col("p_retailprice").cast("string"))
                    .alias("puissance_installee_mw"), F.col("p_partkey").alias("load_ordinal"))


SQL_CAPACITY_SILVER_RAW = f"""capacity_silver_raw AS (
  SELECT CASE WHEN p_size < 50 THEN CAST(p_size AS VARCHAR) END AS code_insee_region,
         {_sql_case('p_type', P_TYPE_FILIERE, 'p_type')} AS filiere,
         CASE WHEN p_retailprice >= 990 THEN NULL ELSE p_retailprice END AS puissance_installee_mw,
         p_partkey AS load_ordinal
  FROM part)"""


def sql_capacity(suffix: str = "", brand: str | None = None) -> str:
    """CTEs ``capacity_raw<suffix>``, ``cap_staged<suffix>``, ``capacity<suffix>`` (P11-P13 + A07)."""
    where = f" WHERE p_brand = '{brand}'" if brand is not None else ""
    return f"""capacity_raw{suffix} AS (
  SELECT CAST(p_size AS VARCHAR) || '.0' AS coderegion, 'Region ' || CAST(p_size AS VARCHAR) AS region,
         {_sql_case('p_type', P_TYPE_FILIERE, 'p_type')} AS filiere,
         replace(CAST(p_retailprice AS VARCHAR), '.', ',') AS puismaxinstallee,
         CASE WHEN p_retailprice < 950 THEN 2023 ELSE 2024 END AS annee,
         p_partkey AS load_ordinal
  FROM part{where}),
cap_staged{suffix} AS (
  SELECT CAST(CAST(TRY_CAST(trim(coderegion) AS DOUBLE) AS BIGINT) AS VARCHAR) AS code_insee_region,
         region, """ + _sql_case("lower(trim(filiere))", list(FILIERE_MAP.items()), "NULL") + f""" AS source_name,
         TRY_CAST(replace(puismaxinstallee, ',', '.') AS DOUBLE) / 1000.0 AS mw,
         annee, load_ordinal
  FROM capacity_raw{suffix}),
capacity{suffix} AS (
  SELECT code_insee_region, arg_max(region, load_ordinal) AS libelle_region, source_name, annee,
         CAST(ROUND(SUM(CAST(mw AS DECIMAL(28,6))), 2) AS DOUBLE) AS puissance_installee_mw
  FROM cap_staged{suffix}
  WHERE code_insee_region IS NOT NULL AND code_insee_region <> '0' AND source_name IS NOT NULL
  GROUP BY code_insee_region, source_name, annee
  HAVING CAST(ROUND(SUM(CAST(mw AS DECIMAL(28,6))), 2) AS DOUBLE) > 0)"""


# capacity in SQL after P11-P13 + A07
SQL_CAPACITY = sql_capacity()


def emission_raw(spark: SparkSession, d: str) -> DataFrame:
    """Emission-factor register lines (part): sector by part type, energy = brand, CO2 = retail
    price / 10, CH4 = size / 100, N2O = size / 1000 kg/MWh, publisher = part name, year by price."""
    p = table(spark, d, "part").select("p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    return p.select(
        F.concat(F.lit(" "), _case(F.col("p_type"), P_TYPE_FILIERE, F.col("p_type"))).alias("filiere"),
        F.col("p_brand").alias("source_energie"),
        (F.col("p_retailprice") / 10).alias("facteur_emission_co2_kg_mwh"),
        (F.col("p_size") / 100).alias("facteur_emission_ch4_kg_mwh"),
        (F.col("p_size") / 1000).alias("facteur_emission_n2o_kg_mwh"),
        F.col("p_name").alias("source"),
        F.when(F.col("p_retailprice") < 950, 2023).otherwise(2024).alias("annee"),
    )


SQL_EMISSION_RAW = f"""emission_raw AS (
  SELECT ' ' || {_sql_case('p_type', P_TYPE_FILIERE, 'p_type')} AS filiere, p_brand AS source_energie,
         p_retailprice / 10 AS co2, p_size / 100 AS ch4, p_size / 1000 AS n2o, p_name AS reference,
         CASE WHEN p_retailprice < 950 THEN 2023 ELSE 2024 END AS annee
  FROM part)"""


# ---------------------------------------------------------------------------
# Outage events (orders ⋈ customer ⋈ nation): id from customer and order day
# (so repeated reports of one event occur), area = customer's nation name,
# MW = total price as text with a decimal comma, description padded.
# ---------------------------------------------------------------------------

def maintenance_raw(spark: SparkSession, d: str, statuses: Sequence[str] | None = None) -> DataFrame:
    """Outage reports; ``statuses`` keeps the reports of one scrape (order status as scrape tag)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                         "o_orderdate", "o_orderpriority")
    if statuses is not None:
        o = o.where(F.col("o_orderstatus").isin(list(statuses)))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select(
        F.concat(F.lit("EVT-"), F.col("o_custkey").cast("string"), F.lit("-"),
                 F.date_format("o_orderdate", "yyyyMMdd")).alias("event_id"),
        F.concat(F.lit("Unit "), F.col("o_custkey").cast("string")).alias("unit_name"),
        F.col("n_name").alias("affected_area"),
        F.col("o_orderpriority").alias("event_type"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start_date"),
        F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("end_date"),
        F.replace(F.col("o_totalprice").cast("string"), F.lit("."), F.lit(",")).alias("unavailable_mw"),
        F.concat(F.lit("  status  "), F.col("o_orderstatus"), F.lit("   order \t"),
                 F.col("o_orderkey").cast("string"), F.lit(" ")).alias("description"),
        F.col("o_orderkey").alias("load_ordinal"),
    )


SQL_MAINTENANCE_RAW = """maint_raw AS (
  SELECT 'EVT-' || CAST(o.o_custkey AS VARCHAR) || '-' || strftime(o.o_orderdate, '%Y%m%d') AS event_id,
         'Unit ' || CAST(o.o_custkey AS VARCHAR) AS unit_name,
         n.n_name AS affected_area, o.o_orderpriority AS event_type,
         o.o_orderdate AS start_date, o.o_orderdate + INTERVAL 1 DAY AS end_date,
         o.o_totalprice AS unavailable_mw,
         '  status  ' || o.o_orderstatus || '   order ' || chr(9) || CAST(o.o_orderkey AS VARCHAR) || ' '
           AS description,
         o.o_orderkey AS load_ordinal
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
maintenance AS (
  SELECT event_id, unit_name, affected_area, event_type, start_date, end_date, unavailable_mw,
         trim(regexp_replace(description, '[\\t\\n\\x0b\\f\\r \\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'))
           AS description
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY load_ordinal DESC) AS rn
        FROM maint_raw) x WHERE rn = 1)"""


def sql_maintenance(suffix: str = "", statuses: Sequence[str] | None = None) -> str:
    """CTEs ``maint_raw<suffix>`` and ``maintenance<suffix>``, optionally one scrape's reports."""
    sql = SQL_MAINTENANCE_RAW
    if statuses is not None:
        join = "JOIN nation n ON c.c_nationkey = n.n_nationkey)"
        sql = sql.replace(join, join[:-1] + " WHERE o.o_orderstatus IN ("
                          + ", ".join(f"'{x}'" for x in statuses) + "))")
    return sql.replace("maint_raw", f"maint_raw{suffix}").replace("maintenance AS (", f"maintenance{suffix} AS (")


def outage_pages(spark: SparkSession, d: str) -> DataFrame:
    """Outage pages rendered from the outage reports: one table row per report, the reports of ten
    consecutive order keys per page (so a page stays small whatever the key distribution). Rows of
    priority '4-NOT SPECIFIED' carry their id only in ``data-event-id``; rows of '5-LOW' have no MW cell."""
    m = maintenance_raw(spark, d)
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")),
                                        F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cell = lambda cls, c: F.concat(F.lit(f'<td class="{cls}">'), esc(c), F.lit("</td>"))
    row = F.concat(
        F.lit('<tr class="event-row" data-event-id="'), esc("event_id"), F.lit('">'),
        F.when(F.col("event_type") == "4-NOT SPECIFIED", F.lit('<td class="event-id"></td>'))
         .otherwise(cell("event-id", "event_id")),
        cell("unit-name", "unit_name"), cell("area", "affected_area"), cell("event-type", "event_type"),
        cell("start-date", "start_date"), cell("end-date", "end_date"),
        F.when(F.col("event_type") == "5-LOW", F.lit(""))
         .otherwise(F.concat(F.lit('<td class="unavail-mw"> '), esc("unavailable_mw"), F.lit(" </td>"))),
        cell("description", "description"), F.lit("</tr>\n"))
    pages = m.groupBy(F.floor(F.col("load_ordinal") / 10).alias("page_id")).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("load_ordinal", row.alias("r")))).getField("r"), "")
        .alias("_rows"))
    return pages.select(
        "page_id", F.concat(F.lit("https://outages.example/page/"), F.col("page_id").cast("string")).alias("url"),
        F.concat(F.lit("<html><body><table>\n"), F.col("_rows"), F.lit("</table></body></html>")).alias("html"))


# ---------------------------------------------------------------------------
# Climate grid points (embeddings): lat/lon from the first two components
# scaled around France, wind components, 2 m temperature (K) and radiation
# from the next ones, valid time = 2025-06-15 + label hours.
# ---------------------------------------------------------------------------

def grid_points(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    x = lambda i: F.col("embedding")[i].cast("double")
    return e.select(
        "vec_id",
        (F.lit("2025-06-15 00:00:00").cast("timestamp_ntz") +
         F.make_dt_interval(hours=F.col("label"))).alias("valid_time"),
        (x(0) * 24 + 46.2).alias("latitude"),
        (x(1) * 18 + 2.2).alias("longitude"),
        (x(2) * 30).alias("u100"),
        (x(3) * 30).alias("v100"),
        F.when(x(4) > -0.3, x(4) * 40 + 285).alias("t2m"),
        (F.abs(x(5)) * 1000000).alias("ssrd"),
    )


SQL_GRID = """grid AS (
  SELECT vec_id, TIMESTAMP '2025-06-15 00:00:00' + to_hours(label) AS valid_time,
         CAST(embedding[1] AS DOUBLE) * 24 + 46.2 AS latitude,
         CAST(embedding[2] AS DOUBLE) * 18 + 2.2 AS longitude,
         CAST(embedding[3] AS DOUBLE) * 30 AS u100,
         CAST(embedding[4] AS DOUBLE) * 30 AS v100,
         CASE WHEN CAST(embedding[5] AS DOUBLE) > -0.3 THEN CAST(embedding[5] AS DOUBLE) * 40 + 285 END AS t2m,
         abs(CAST(embedding[6] AS DOUBLE)) * 1000000 AS ssrd
  FROM embeddings)"""


# ---------------------------------------------------------------------------
# Alert log (events): user, region = event type, alert type by value, sent at ts.
# ---------------------------------------------------------------------------

def alert_log(spark: SparkSession, d: str) -> DataFrame:
    return alert_log_from(table(spark, d, "events"))


def alert_log_from(events: DataFrame) -> DataFrame:
    """Alert log from an ``events`` frame (batch or stream)."""
    ev = events.select("event_id", "ts", "user_id", "event_type", "value")
    return ev.select(
        F.col("user_id").alias("user_id"), F.col("event_type").alias("region_code"),
        F.when(F.col("value") > 250, "over_production").otherwise("under_production").alias("alert_type"),
        F.col("ts").alias("sent_at"), F.col("event_id").alias("alert_id"))


SQL_ALERTS = """alerts AS (
  SELECT user_id, event_type AS region_code,
         CASE WHEN value > 250 THEN 'over_production' ELSE 'under_production' END AS alert_type,
         ts AS sent_at, event_id AS alert_id
  FROM events)"""
