"""Query catalog: every registered query and its independent DuckDB SQL oracle.

Keys follow ``<operator id>_<name>``. Each Spark query reads the driver
tables through the bindings in ``standins`` and runs the library operators
over them in full (no sampling, no row caps except where the cap is the
feature: pages, newest-n lists). Maps are returned as sorted ``key:value``
text and every computed column is aliased identically on both sides.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from voltaic.constants import (
    ANNEE_CANDIDATES, FILIERE_CANDIDATES, PUISSANCE_CANDIDATES, REGION_CODE_CANDIDATES, REGION_NAME_CANDIDATES,
    SOURCE_COLUMN_MAP,
    CARBON_BANDS, CARBON_GAUGE_MAX, DEFAULT_GATES, EMISSION_FACTORS, EXPORT_COLUMN_LABELS,
    NATIONAL_BALANCE_TOLERANCE, REGION_BALANCE_TOLERANCE, REGION_CENTROIDS, SOURCES,
)
from voltaic.functions.calendar import calendar_parts
from voltaic.functions import columns as C
from voltaic.functions.columns import clean_text
from voltaic.functions.maps import map_as_text
from voltaic.operators import aggregates as A
from voltaic.operators import dedup as K
from voltaic.operators import joins as J
from voltaic.operators import lifecycle as Y
from voltaic.operators import nulls as N
from voltaic.operators import paging as L
from voltaic.operators import publish as PU
from voltaic.operators import quality as Q
from voltaic.operators import upsert as U
from voltaic.operators import windows as W
from voltaic.plans import gold, silver, standins as S
from voltaic.session import apply_core_conf, scratch_path
from voltaic.sources import files as F_
from voltaic.sources import html_events, profile, sinks
from voltaic.sources import weather as W_
from voltaic.streaming import accounting as TA
from voltaic.streaming import status as TS
from voltaic.streaming import streams as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; the session gets the core settings (UTC, AQE) first."""
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_core_conf(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


GOLD = S.SQL_GOLD
REC = ",\n".join([GOLD, S.SQL_RECORDS, S.SQL_REC_LONG])
NAT = ",\n".join([REC, S.SQL_NATIONAL])
FACTORS = "factors AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', CAST({float(v)} AS DOUBLE))" for k, v in EMISSION_FACTORS.items()) + ") t(source_name, factor))"
CENTROIDS = "centroids AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{code}', {v[-2]}, {v[-1]})" for i, (code, v) in enumerate(REGION_CENTROIDS.items())) + \
    ") t(ord, code, lat, lon))"
BAND_SQL = "CASE " + " ".join(f"WHEN {{x}} < {b} THEN '{lab}'" for b, lab in CARBON_BANDS) + " ELSE 'high' END"
SILVER_FLAG_COLS = ["consommation_mw", "nucleaire_mw", "eolien_mw", "solaire_mw", "hydraulique_mw", "gaz_mw"]
REF_NOW = "2024-01-31 00:00:00"
_LAND_JOB = "job-" + REF_NOW[:10].replace("-", "")


def _rec_out(recs: DataFrame) -> DataFrame:
    return recs.select("code_insee", "region", "timestamp", map_as_text("sources").alias("sources_text"),
                       F.size("sources").cast("long").alias("n_sources"), "facteur_charge",
                       "consommation_mw")


REC_COLS_SQL = "code_insee, region, timestamp, sources_text, n_sources, facteur_charge, consommation_mw"


# ---------------------------------------------------------------------------
# Serving: star join, pivot, filters, paging
# ---------------------------------------------------------------------------

@query("a01_production_regional", _with(GOLD, S.SQL_RECORDS) + f"SELECT {REC_COLS_SQL} FROM records")
def a01(spark, d):
    """K01 keep-last -> J01 star join -> A01 pivot to records (all-zero records dropped; L07 filters none)."""
    return _rec_out(gold.records(spark, d))


@query("j01_star_join", _with(GOLD) + "SELECT * FROM prod_long")
def j01(spark, d):
    """Fact ⋈ region ⋈ time ⋈ source, all three dimensions stored."""
    return gold.prod_long(spark, d, stored_time=True)


@query("k01_dedup_keep_last", _with(S.SQL_FACT_STAGED, S.SQL_FACT) + "SELECT * FROM fact")
def k01(spark, d):
    """Keep-last per (region, time, source) in load order."""
    return gold.fact(spark, d)


@query("a02_production_wide", _with(REC) + "SELECT code_insee, horodatage AS timestamp, " + ", ".join(
    f"MAX(CASE WHEN source_name = '{s}' THEN valeur_mw END) AS {s}" for s in SOURCES) +
    " FROM rec_long GROUP BY 1, 2")
def a02(spark, d):
    """One column per source (fixed source list)."""
    long = gold.prod_long(spark, d).withColumnRenamed("horodatage", "timestamp")
    return A.production_wide(long, keys=("code_insee", "timestamp"), drop_all_zero=True)


@query("l02_page", _with(GOLD, S.SQL_RECORDS) +
       f"SELECT {REC_COLS_SQL} FROM records ORDER BY timestamp DESC, code_insee LIMIT 100 OFFSET 50")
def l02(spark, d):
    """Newest-first total order, exact page after the pivot."""
    rows, _ = L.page(gold.records(spark, d), limit=100, offset=50)
    return _rec_out(rows)


@query("l02_page_total", _with(GOLD, S.SQL_RECORDS) + "SELECT COUNT(*) AS total_records FROM records")
def l02_total(spark, d):
    """Exact total of records behind the page."""
    _, total = L.page(gold.records(spark, d), limit=100, offset=50)
    return total


@query("l02_deep_page", _with(GOLD, S.SQL_RECORDS) + f""", ranked AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY timestamp DESC, code_insee) AS rn, COUNT(*) OVER () AS total_records FROM records)
SELECT {REC_COLS_SQL}, total_records FROM ranked WHERE rn > total_records // 10 AND rn <= total_records // 10 + 100""")
def l02_deep(spark, d):
    """A page behind a tenth of all records, from range counts: whole ranges are skipped, one is sorted."""
    pages = L.RankedPages(gold.records(spark, d))
    return _rec_out(pages.page(limit=100, offset=pages.total // 10)).withColumn("total_records", F.lit(pages.total).cast("long"))


@query("l07_apply_filters", _with(GOLD) + """, flt AS (
  SELECT * FROM prod_long WHERE code_insee = '7' AND horodatage >= TIMESTAMP '1996-01-01 00:00:00'
     AND horodatage < TIMESTAMP '1998-01-01 00:00:00' AND source_name = 'eolien'),
recs AS (
  SELECT code_insee, nom_region AS region, horodatage AS timestamp,
         string_agg(source_name || ':' || COALESCE(CAST(CAST(valeur_mw AS DECIMAL(18,4)) AS VARCHAR), 'null'),
                    ';' ORDER BY source_name) AS sources_text,
         COUNT(*) AS n_sources, arg_min(facteur_charge, source_name) AS facteur_charge,
         arg_min(consommation_mw, source_name) AS consommation_mw
  FROM flt GROUP BY 1, 2, 3 HAVING bool_or(valeur_mw IS NULL OR valeur_mw <> 0))
SELECT * FROM recs""")
def l07(spark, d):
    """Region / start / date-only end (whole day) / source filters before the pivot."""
    recs = gold.records(spark, d, region="7", start="1996-01-01", end="1997-12-31", source="eolien")
    return _rec_out(recs)


@query("s14_export_fr_rows", _with(GOLD) + """SELECT concat_ws(';', code_insee, nom_region,
    strftime(horodatage, '%Y-%m-%d %H:%M:%S'), source_name,
    COALESCE(CASE WHEN valeur_mw IS NULL THEN NULL ELSE replace(
      CASE WHEN right(rtrim(CAST(CAST(ROUND(valeur_mw, 4) AS DECIMAL(38,4)) AS VARCHAR), '0'), 1) = '.'
           THEN rtrim(CAST(CAST(ROUND(valeur_mw, 4) AS DECIMAL(38,4)) AS VARCHAR), '0') || '0'
           ELSE rtrim(CAST(CAST(ROUND(valeur_mw, 4) AS DECIMAL(38,4)) AS VARCHAR), '0') END, '.', ',') END, ''),
    COALESCE(CASE WHEN facteur_charge IS NULL THEN NULL ELSE replace(
      CASE WHEN right(rtrim(CAST(CAST(ROUND(facteur_charge, 4) AS DECIMAL(38,4)) AS VARCHAR), '0'), 1) = '.'
           THEN rtrim(CAST(CAST(ROUND(facteur_charge, 4) AS DECIMAL(38,4)) AS VARCHAR), '0') || '0'
           ELSE rtrim(CAST(CAST(ROUND(facteur_charge, 4) AS DECIMAL(38,4)) AS VARCHAR), '0') END, '.', ',') END, '')
  ) AS line FROM prod_long""")
def s14(spark, d):
    """French CSV lines (';', decimal comma, 4 dp, NULL empty) of the flat rows."""
    return sinks.fr_csv_lines(gold.prod_long(spark, d), list(EXPORT_COLUMN_LABELS))


@query("s14_export_fr_csv", _with(S.SQL_MAINTENANCE_RAW) + """SELECT event_id AS "Code", unit_name || ';"' || event_type || '"' AS "Unit",
  COALESCE(replace(CASE WHEN right(rtrim(t, '0'), 1) = '.' THEN rtrim(t, '0') || '0' ELSE rtrim(t, '0') END, '.', ','), '') AS "MW"
FROM (SELECT *, CAST(CAST(ROUND(unavailable_mw, 4) AS DECIMAL(38,4)) AS VARCHAR) AS t FROM maintenance)""")
def s14_export(spark, d):
    """The French export written as files and read back with a CSV reader: text with delimiters and quotes,
    decimal commas, one header per part file."""
    rows = gold.maintenance(spark, d).select("event_id", F.concat("unit_name", F.lit(';"'), "event_type", F.lit('"')).alias("unit_name"),
                                             "unavailable_mw")
    path = sinks.export_fr_csv(rows, scratch_path(spark, "s14"), ["event_id", "unit_name", "unavailable_mw"],
                               {"event_id": "Code", "unit_name": "Unit", "unavailable_mw": "MW"}, order=["event_id"])
    back = spark.read.schema("c0 string, c1 string, c2 string").option("sep", ";").option("escape", '"').option("lineSep", "\r\n").csv(path)
    header = F.regexp_replace("c0", "^\ufeff", "") == "Code"
    return back.where(~header).select(F.col("c0").alias("Code"), F.col("c1").alias("Unit"), F.coalesce("c2", F.lit("")).alias("MW"))


# ---------------------------------------------------------------------------
# Loader summaries, upserts, dimensions
# ---------------------------------------------------------------------------

@query("a04_fact_summary", _with(S.SQL_FACT_STAGED, S.SQL_FACT) + """SELECT COUNT(*) AS total_rows,
  COUNT(DISTINCT id_region) AS regions, COUNT(DISTINCT id_source) AS sources, COUNT(DISTINCT id_date) AS dates,
  ROUND(AVG(valeur_mw), 2) AS avg_mw, COUNT(facteur_charge) AS rows_with_load_factor FROM fact""")
def a04(spark, d):
    """Loader summary of the fact."""
    return A.fact_summary(gold.fact(spark, d))


@query("a05_fact_count", _with(S.SQL_FACT_STAGED, S.SQL_FACT) + "SELECT COUNT(*) AS n FROM fact")
def a05(spark, d):
    """Fact row count."""
    return A.fact_count(gold.fact(spark, d))


@query("p15_calendar_parts", _with(S.SQL_FACT_STAGED, S.SQL_FACT, S.SQL_DIM_TIME) + """SELECT id_date, horodatage,
  CAST(day(horodatage) AS INTEGER) AS jour, CAST(month(horodatage) AS INTEGER) AS mois,
  CAST(year(horodatage) AS INTEGER) AS annee, CAST(hour(horodatage) AS INTEGER) AS heure,
  CAST(minute(horodatage) AS INTEGER) AS minute, CAST(isodow(horodatage) AS INTEGER) AS jour_semaine,
  isodow(horodatage) >= 6 AS est_weekend FROM dim_time""")
def p15(spark, d):
    """Calendar parts of the time dimension."""
    f = gold.fact(spark, d)
    return calendar_parts(S.dim_time_from(f), "horodatage")


_UPSERT_SQL = _with(S.SQL_FACT_STAGED) + """, keep AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY region_code, ts, source_name ORDER BY load_batch DESC, load_pos DESC, valeur_mw DESC, facteur_charge DESC, consommation_mw DESC) AS rn
  FROM fact_staged WHERE ts < TIMESTAMP '1998-01-01 00:00:00'),
base AS (SELECT region_code AS id_region, CAST(strftime(ts, '%Y%m%d%H%M') AS BIGINT) AS id_date,
                source_name AS id_source, valeur_mw, facteur_charge, consommation_mw FROM keep WHERE rn = 1),
keepi AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY region_code, ts, source_name ORDER BY load_batch DESC, load_pos DESC, valeur_mw DESC, facteur_charge DESC, consommation_mw DESC) AS rn
  FROM fact_staged WHERE batch_tag = 'R'),
inc AS (SELECT region_code AS id_region, CAST(strftime(ts, '%Y%m%d%H%M') AS BIGINT) AS id_date,
               source_name AS id_source, valeur_mw, facteur_charge, consommation_mw FROM keepi WHERE rn = 1)
SELECT COALESCE(i.id_region, b.id_region) AS id_region, COALESCE(i.id_date, b.id_date) AS id_date,
       COALESCE(i.id_source, b.id_source) AS id_source,
       CASE WHEN i.id_region IS NOT NULL THEN i.valeur_mw ELSE b.valeur_mw END AS valeur_mw,
       CASE WHEN i.id_region IS NOT NULL THEN i.facteur_charge ELSE b.facteur_charge END AS facteur_charge,
       CASE WHEN i.id_region IS NOT NULL THEN i.consommation_mw ELSE b.consommation_mw END AS consommation_mw
FROM base b FULL OUTER JOIN inc i ON b.id_region = i.id_region AND b.id_date = i.id_date
                                 AND b.id_source = i.id_source"""


@query("u04_upsert_fact_energy", _UPSERT_SQL)
def u04(spark, d):
    """base = loads shipped before 1998, incoming = the 'R' batch (all dates); merge on the key."""
    staged = S.fact_staged(spark, d)
    base = gold.fact_from_staged(staged.where(F.col("ts") < F.lit("1998-01-01").cast("timestamp_ntz")))
    inc = S.to_fact_rows(staged.where(F.col("batch_tag") == "R"))
    return U.upsert_fact_energy(base, inc.select(*gold.FACT_COLS, "load_batch", "load_pos"),
                                order=gold.LOAD_ORDER)


@query("u04_published_fact", _UPSERT_SQL)
def u04_published(spark, d):
    """The same loads persisted: the base, then the 'R' batch published into the months it touches at one switch."""
    staged = S.fact_staged(spark, d)
    month = F.expr("id_date div 1000000").alias("month")
    path = scratch_path(spark, "u04-published")
    base = gold.fact_from_staged(staged.where(F.col("ts") < F.lit("1998-01-01").cast("timestamp_ntz"))).select(*gold.FACT_COLS, month)
    inc = S.to_fact_rows(staged.where(F.col("batch_tag") == "R")).select(*gold.FACT_COLS, month, "load_batch", "load_pos")
    keys = ["month", "id_date", "id_region", "id_source"]
    PU.publish_upsert(base, path, keys, ["month"])
    PU.publish_upsert(inc, path, keys, ["month"], order=gold.LOAD_ORDER, unstored=["load_batch", "load_pos"])
    return PU.read_published(spark, path, base.schema).select(*gold.FACT_COLS)


@query("u02_upsert_dim_time", _with(S.SQL_FACT_STAGED) + """, t AS (
  SELECT DISTINCT CAST(strftime(ts, '%Y%m%d%H%M') AS BIGINT) AS id_date FROM fact_staged
  WHERE ts < TIMESTAMP '1998-01-01 00:00:00' OR batch_tag = 'R')
SELECT id_date, strptime(CAST(id_date AS VARCHAR), '%Y%m%d%H%M') AS horodatage FROM t""")
def u02(spark, d):
    """Insert-only merge of the incoming batch's timestamps into the base time dimension."""
    staged = S.fact_staged(spark, d)
    base = S.dim_time_from(S.to_fact_rows(staged.where(F.col("ts") < F.lit("1998-01-01").cast("timestamp_ntz"))))
    inc = S.dim_time_from(S.to_fact_rows(staged.where(F.col("batch_tag") == "R")))
    return U.upsert_dim_time(base, inc)


# ---------------------------------------------------------------------------
# Dashboard analytics
# ---------------------------------------------------------------------------

@query("a08_national_by_timestamp", _with(NAT) + "SELECT timestamp, sources_text, consommation_mw FROM national")
def a08(spark, d):
    """National positive MW per source and timestamp, summed consumption."""
    n = gold.national(spark, d)
    return n.select("timestamp", map_as_text("sources").alias("sources_text"), "consommation_mw")


@query("a10_latest_by_region", _with(REC) + """, last AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY code_insee ORDER BY timestamp DESC) AS rn FROM records) x
  WHERE rn = 1)
SELECT l.code_insee, l.region, l.timestamp,
  CAST(COALESCE((SELECT SUM(CAST(valeur_mw AS DECIMAL(38,4))) FROM rec_long p WHERE p.code_insee = l.code_insee
     AND p.horodatage = l.timestamp AND p.valeur_mw > 0), 0) AS DOUBLE) AS total_mw, l.consommation_mw
FROM last l""")
def a10(spark, d):
    """A10: newest record per region with total positive MW."""
    return A.latest_by_region(gold.records(spark, d)).drop("sources")


@query("a11_region_balance", _with(REC) + f""", last AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY code_insee ORDER BY timestamp DESC) AS rn FROM records) x
  WHERE rn = 1),
tot AS (SELECT l.code_insee, l.region, l.timestamp, l.consommation_mw,
  CAST(COALESCE((SELECT SUM(CAST(valeur_mw AS DECIMAL(38,4))) FROM rec_long p WHERE p.code_insee = l.code_insee
     AND p.horodatage = l.timestamp AND p.valeur_mw > 0), 0) AS DOUBLE) AS total_mw FROM last l)
SELECT code_insee, region, timestamp, total_mw, consommation_mw,
  CASE WHEN consommation_mw IS NULL OR consommation_mw = 0 THEN NULL
       ELSE (total_mw - consommation_mw) / consommation_mw END AS ratio,
  CASE WHEN consommation_mw IS NULL OR consommation_mw = 0 THEN 'no_data'
       WHEN (total_mw - consommation_mw) / consommation_mw > {REGION_BALANCE_TOLERANCE} THEN 'surplus'
       WHEN (total_mw - consommation_mw) / consommation_mw < -{REGION_BALANCE_TOLERANCE} THEN 'deficit'
       ELSE 'balanced' END AS state
FROM tot""")
def a11(spark, d):
    """supply/demand state per region at its newest record (±15 %)."""
    return A.region_balance(A.latest_by_region(gold.records(spark, d)))


@query("a12_total_mw", _with(NAT) + """SELECT timestamp, floor(CAST(total_pos AS DOUBLE) + 0.5) AS total_mw
FROM national ORDER BY timestamp DESC LIMIT 1""")
def a12(spark, d):
    """Rounded national total at the newest timestamp."""
    return A.total_mw(gold.national(spark, d))


@query("a13_dominant_source", _with(NAT) + """SELECT timestamp, source_name AS source, mw FROM nat_src
WHERE timestamp = (SELECT MAX(timestamp) FROM national) ORDER BY mw DESC, source_name LIMIT 1""")
def a13(spark, d):
    """Dominant source at the newest national timestamp."""
    return A.dominant_source(gold.national(spark, d))


@query("a14_top_sources", _with(REC) + """, last AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY code_insee ORDER BY timestamp DESC) AS rn FROM records) x
  WHERE rn = 1),
pos AS (SELECT p.code_insee, p.horodatage AS timestamp, p.source_name AS source, p.valeur_mw AS mw,
        ROW_NUMBER() OVER (PARTITION BY p.code_insee ORDER BY p.valeur_mw DESC, p.source_name) AS rank
        FROM rec_long p JOIN last l ON p.code_insee = l.code_insee AND p.horodatage = l.timestamp
        WHERE p.valeur_mw > 0)
SELECT code_insee, timestamp, CAST(rank AS INTEGER) AS rank, source, mw FROM pos WHERE rank <= 7""")
def a14(spark, d):
    """Top 7 positive sources of each region's newest record."""
    return A.top_sources(gold.records(spark, d), n=7).withColumn("rank", F.col("rank").cast("int"))


_CI_SQL = _with(NAT, FACTORS) + f""", ci AS (
  SELECT n.timestamp,
         SUM(CAST(s.mw AS DECIMAL(20,4)) * CAST(COALESCE(f.factor, 0) AS DECIMAL(12,4))) AS w,
         SUM(CAST(s.mw AS DECIMAL(20,4))) AS t
  FROM national n LEFT JOIN nat_src s ON s.timestamp = n.timestamp
                  LEFT JOIN factors f ON f.source_name = s.source_name
  GROUP BY n.timestamp),
ci2 AS (SELECT timestamp, CASE WHEN t IS NULL OR t = 0 THEN 0.0 ELSE floor(w / t + 0.5) END AS intensity FROM ci)
"""


@query("a15_carbon_intensity", _CI_SQL + f"""SELECT timestamp, intensity,
  {BAND_SQL.format(x='intensity')} AS band, LEAST(intensity, {float(CARBON_GAUGE_MAX)}) AS gauge FROM ci2""")
def a15(spark, d):
    """Carbon intensity of every national point, its band and gauge value."""
    return A.carbon_intensity(gold.national(spark, d))


@query("a17_carbon_series", _CI_SQL + "SELECT timestamp, intensity FROM ci2 ORDER BY timestamp DESC LIMIT 96")
def a17(spark, d):
    """Carbon intensity of the newest 96 national points."""
    return A.carbon_series(gold.national(spark, d), n=96)


@query("a19_prod_vs_conso", _with(NAT) + """, pc AS (
  SELECT timestamp, floor(CAST(total_pos AS DOUBLE) + 0.5) AS prod, floor(consommation_mw + 0.5) AS conso
  FROM national)
SELECT timestamp, prod, conso, CASE WHEN conso IS NOT NULL AND prod > conso THEN prod END AS surplus_zone FROM pc""")
def a19(spark, d):
    """Rounded production vs consumption and the surplus zone."""
    return A.prod_vs_conso(gold.national(spark, d))


@query("a20_source_universe", _with(REC) +
       "SELECT string_agg(DISTINCT source_name, ',' ORDER BY source_name) AS sources FROM rec_long")
def a20(spark, d):
    """Union of source keys over all records."""
    return A.source_universe(gold.records(spark, d)).select(F.array_join("sources", ",").alias("sources"))


@query("a22_region_directory", _with(GOLD, S.SQL_RECORDS) +
       "SELECT code_insee, arg_min(region, timestamp) AS region FROM records GROUP BY code_insee")
def a22(spark, d):
    """Region directory, first name per code, French collation order."""
    return A.region_directory(gold.records(spark, d))


@query("a23_active_regions", _with(GOLD, S.SQL_RECORDS) +
       "SELECT COUNT(DISTINCT code_insee) AS active_regions, COUNT(*) AS data_points FROM records")
def a23(spark, d):
    """Regions with data and number of records."""
    return A.active_regions(gold.records(spark, d))


@query("w03_balance_runs", _with(NAT) + f""", pts AS (
  SELECT timestamp, floor(CAST(total_pos AS DOUBLE) + 0.5) AS prod, floor(consommation_mw + 0.5) AS conso
  FROM national),
st AS (SELECT *, CASE WHEN conso IS NULL OR conso = 0 THEN 'no_data'
                      WHEN (prod - conso) / conso > {NATIONAL_BALANCE_TOLERANCE} THEN 'surplus'
                      WHEN (prod - conso) / conso < -{NATIONAL_BALANCE_TOLERANCE} THEN 'deficit'
                      ELSE 'balanced' END AS state FROM pts),
fl AS (SELECT *, CASE WHEN state = 'no_data' OR LAG(state) OVER (ORDER BY timestamp) IS NULL
                           OR LAG(state) OVER (ORDER BY timestamp) <> state THEN timestamp END AS s FROM st)
SELECT timestamp, prod, conso, state,
       MAX(s) OVER (ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_start
FROM fl""")
def w03(spark, d):
    """supply/demand state of every national point and the start of its run (gaps and islands)."""
    return W.balance_runs(gold.national(spark, d))


_W03_LAST_SQL = _with(NAT) + f""", pts AS (
  SELECT timestamp, floor(CAST(total_pos AS DOUBLE) + 0.5) AS prod, floor(consommation_mw + 0.5) AS conso
  FROM national),
st AS (SELECT *, CASE WHEN conso IS NULL OR conso = 0 THEN 'no_data'
                      WHEN (prod - conso) / conso > {NATIONAL_BALANCE_TOLERANCE} THEN 'surplus'
                      WHEN (prod - conso) / conso < -{NATIONAL_BALANCE_TOLERANCE} THEN 'deficit'
                      ELSE 'balanced' END AS state FROM pts),
fl AS (SELECT *, CASE WHEN state = 'no_data' OR LAG(state) OVER (ORDER BY timestamp) IS NULL
                           OR LAG(state) OVER (ORDER BY timestamp) <> state THEN timestamp END AS s FROM st),
runs AS (SELECT timestamp, prod, conso, state,
         MAX(s) OVER (ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_start FROM fl)
SELECT timestamp, prod, conso, state,
       CASE WHEN state IN ('surplus', 'deficit') THEN run_start END AS run_start
FROM runs ORDER BY timestamp DESC LIMIT 1"""


@query("w03_balance_run_start", _W03_LAST_SQL)
def w03_last(spark, d):
    return W.balance_run_start(gold.national(spark, d))


@query("w03_carried_run_start", _W03_LAST_SQL)
def w03_carried(spark, d):
    """The same row from a persisted state: the history until 1998-06 once, then only what came behind it."""
    path = scratch_path(spark, "w03-state")
    W.advance_run_start(spark, path, lambda since: gold.national(spark, d, end="1998-06-30 23:59:59"))
    return W.advance_run_start(spark, path, lambda since: gold.national(spark, d, start=since))


@query("l08_last_period", _with(NAT) + """SELECT timestamp, sources_text, consommation_mw FROM national
WHERE timestamp >= TIMESTAMP '1998-08-02 00:00:00' - INTERVAL 30 DAY AND timestamp <= TIMESTAMP '1998-08-02 00:00:00'""")
def l08(spark, d):
    """The 30-day preset before an explicit reference time."""
    ref = "1998-08-02 00:00:00"  # the period bounds reach the fact's scan; the preset itself cuts the series
    start, end = L.period_bounds(ref, "30d")
    n = L.last_period(gold.national(spark, d, start=start, end=end), "timestamp", ref, "30d")
    return n.select("timestamp", map_as_text("sources").alias("sources_text"), "consommation_mw")


# ---------------------------------------------------------------------------
# Silver readings, null rules, quality gates
# ---------------------------------------------------------------------------

_SILVER_OUT_SQL = _with(S.SQL_SILVER) + "SELECT *, " + ", ".join(
    f"{c} IS NULL AS {c}_is_null" for c in SILVER_FLAG_COLS) + " FROM silver"


@query("p04_silver_readings", _SILVER_OUT_SQL)
def p04(spark, d):
    """P01, P02, P03, P04, K01, N01, N04, N06 over the raw readings (Silver step)."""
    out, _ = gold.silver_readings(spark, d)
    return out


@query("n05_quality_metrics", _with(S.SQL_RAW_DAMAGED) + """, nn AS (
  SELECT c, COUNT(*) FILTER (WHERE gone) AS n, COUNT(*) FILTER (WHERE gone AND kept) AS n_kept FROM (
    SELECT unnest(['code_insee_region', 'consommation_mw', 'date_heure', 'eolien_mw', 'gaz_mw', 'hydraulique_mw',
                   'nucleaire_mw', 'solaire_mw']) AS c,
           unnest([code_insee_region IS NULL, consommation_mw IS NULL, date_heure IS NULL, eolien_mw IS NULL, gaz_mw IS NULL,
                   hydraulique_mw IS NULL, nucleaire_mw IS NULL, solaire_mw IS NULL]) AS gone,
           code_insee_region IS NOT NULL AND date_heure IS NOT NULL AS kept FROM damaged) GROUP BY c),
t AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE code_insee_region IS NULL OR date_heure IS NULL) AS gone FROM damaged)
SELECT 'rte' AS source, t.n AS input_rows,
  COALESCE((SELECT string_agg(c || ':' || CAST(CAST(n AS DECIMAL(18,4)) AS VARCHAR), ';' ORDER BY c)
            FROM nn WHERE n > 0), '') AS nulls_found,
  t.gone AS rows_dropped, CAST(0 AS BIGINT) AS values_filled,
  (SELECT CAST(SUM(n_kept) AS BIGINT) FROM nn WHERE c NOT IN ('code_insee_region', 'date_heure')) AS values_flagged,
  t.n - t.gone AS output_rows FROM t""")
def n05(spark, d):
    """Metrics of the RTE rule set over readings as they came in, before any row is dropped."""
    _, m = silver.transform_readings(S.raw_readings_damaged(spark, d))
    return m.withColumn("nulls_found", map_as_text("nulls_found"))


@query("n01_null_drop", _with(S.SQL_RAW_DAMAGED) + """SELECT code_insee_region, libelle_region, date_heure, consommation_mw,
  nucleaire_mw, eolien_mw, solaire_mw, hydraulique_mw, gaz_mw, load_ordinal FROM damaged
WHERE code_insee_region IS NOT NULL AND date_heure IS NOT NULL""")
def n01(spark, d):
    """Readings without a key are dropped, artefact columns with them."""
    typed = silver.readings_columns(S.raw_readings_damaged(spark, d))
    return N.null_drop(typed, ["code_insee_region", "date_heure"])


@query("n06_capacity_silver", _with(S.SQL_CAPACITY_SILVER_RAW) + """SELECT code_insee_region, filiere,
  COALESCE(puissance_installee_mw, 0.0) AS puissance_installee_mw, load_ordinal FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY code_insee_region, filiere ORDER BY load_ordinal DESC) AS rn
    FROM capacity_silver_raw WHERE code_insee_region IS NOT NULL) WHERE rn = 1""")
def n06_capacity(spark, d):
    """Capacity Silver (drop without region, keep-last per region and branch, unreadable MW -> 0)."""
    out, _ = silver.transform_capacity(S.capacity_silver_raw(spark, d))
    return out


@query("n05_capacity_metrics", _with(S.SQL_CAPACITY_SILVER_RAW) + """SELECT 'capacity' AS source, COUNT(*) AS input_rows,
  COUNT(*) FILTER (WHERE code_insee_region IS NULL) AS rows_dropped,
  COUNT(*) FILTER (WHERE code_insee_region IS NOT NULL AND puissance_installee_mw IS NULL) AS values_filled,
  COUNT(*) FILTER (WHERE code_insee_region IS NOT NULL) AS output_rows FROM capacity_silver_raw""")
def n05_capacity(spark, d):
    """Metrics of the capacity rule set."""
    _, m = silver.transform_capacity(S.capacity_silver_raw(spark, d))
    return m.select("source", "input_rows", "rows_dropped", "values_filled", "output_rows")


@query("n03_forward_fill", _with(S.SQL_METEO_ROWS) + """SELECT code_insee, timestamp,
  LAST_VALUE(temperature_c IGNORE NULLS) OVER (PARTITION BY code_insee ORDER BY timestamp
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS temperature_c,
  wind_speed_10m, cloudcover_pct FROM meteo""")
def n03(spark, d):
    """Per-region forward fill of temperature in time order (two-level scan)."""
    m = gold.meteo(spark, d)
    return N.null_forward_fill(m, ["temperature_c"], ["code_insee"], "timestamp", bucket="day")


_GATES_SQL = _with(S.SQL_SILVER, GOLD) + f""", g AS (
  SELECT 'silver_rte_null_check' AS name, 'null_check' AS check_type,
         CASE WHEN COUNT(*) FILTER (WHERE code_insee_region IS NULL OR date_heure IS NULL) > 0
              THEN 'FAIL' ELSE 'PASS' END AS status, 'CRITICAL' AS severity FROM silver
  UNION ALL
  SELECT 'silver_rte_mw_range', 'range_check',
         CASE WHEN COUNT(*) FILTER (WHERE consommation_mw < 0 OR consommation_mw > 100000) > 0
              THEN 'FAIL' ELSE 'PASS' END, 'WARNING' FROM silver
  UNION ALL
  SELECT 'silver_rte_freshness', 'freshness',
         CASE WHEN MAX(date_heure) IS NULL THEN 'FAIL'
              WHEN epoch(TIMESTAMP '{REF_NOW}') - epoch(MAX(date_heure)) <= 24 * 3600 THEN 'PASS'
              WHEN epoch(TIMESTAMP '{REF_NOW}') - epoch(MAX(date_heure)) <= 48 * 3600 THEN 'WARN'
              ELSE 'FAIL' END, 'WARNING' FROM silver
  UNION ALL
  SELECT 'gold_fk_integrity', 'fk_exists',
         CASE WHEN (SELECT COUNT(*) FROM fact WHERE id_region IS NOT NULL
                      AND id_region NOT IN (SELECT id_region FROM dim_region))
                 + (SELECT COUNT(*) FROM fact WHERE id_date IS NOT NULL
                      AND id_date >= 199801010000)
                 + (SELECT COUNT(*) FROM fact WHERE id_source IS NOT NULL
                      AND id_source NOT IN (SELECT id_source FROM dim_source)) > 0
              THEN 'FAIL' ELSE 'PASS' END, 'CRITICAL'
  UNION ALL
  SELECT 'gold_facteur_charge_range', 'facteur_charge_range',
         CASE WHEN COUNT(*) FILTER (WHERE facteur_charge < 0 OR facteur_charge > 1.5) > 0
              THEN 'FAIL' ELSE 'PASS' END, 'WARNING' FROM fact)
"""


@query("q07_run_gates", _GATES_SQL + "SELECT * FROM g")
def q07(spark, d):
    """Q07 (with Q01, Q02, Q04, Q05, Q06): the default gate list, one aggregation pass per table.

    The time dimension is the one the loads before 1998 left, so later facts are orphans and a CRITICAL gate fails.
    """
    return _gates(spark, d).drop("details")


@query("q08_gate_summary", _GATES_SQL + """SELECT COUNT(*) AS total,
  COUNT(*) FILTER (WHERE status = 'PASS') AS passed, COUNT(*) FILTER (WHERE status = 'WARN') AS warned,
  COUNT(*) FILTER (WHERE status = 'FAIL') AS failed,
  COALESCE(bool_or(status = 'FAIL' AND severity = 'CRITICAL'), false) AS halt FROM g""")
def q08(spark, d):
    """Q08: gate summary and halt flag."""
    return Q.gate_summary(_gates(spark, d))


def _gates(spark, d):
    sil, _ = gold.silver_readings(spark, d)
    f = gold.fact(spark, d)
    time = S.dim_time(spark, d).where(F.col("id_date") < 199801010000)
    dims = {"DIM_REGION": (S.dim_region(spark, d), "id_region"), "DIM_TIME": (time, "id_date"),
            "DIM_SOURCE": (S.dim_source(spark), "id_source")}
    return Q.run_gates(DEFAULT_GATES, {"rte_production": sil, "FACT_ENERGY_FLOW": f}, ref=REF_NOW, dims=dims)


# ---------------------------------------------------------------------------
# Weather
# ---------------------------------------------------------------------------

@query("a09_national_meteo", _with(S.SQL_METEO_ROWS) + """SELECT timestamp,
  floor(CAST(SUM(CAST(temperature_c AS DECIMAL(18,4))) AS DOUBLE) / NULLIF(COUNT(temperature_c), 0) * 10 + 0.5) / 10
    AS temperature_c,
  floor(CAST(SUM(CAST(wind_speed_10m AS DECIMAL(18,4))) AS DOUBLE) / NULLIF(COUNT(wind_speed_10m), 0) * 10 + 0.5) / 10
    AS wind_speed_10m,
  floor(CAST(SUM(CAST(cloudcover_pct AS DECIMAL(18,4))) AS DOUBLE) / NULLIF(COUNT(cloudcover_pct), 0) + 0.5)
    AS cloudcover_pct
FROM meteo GROUP BY timestamp""")
def a09(spark, d):
    """National weather means per hour (NULL-skipping)."""
    return A.national_meteo(gold.meteo(spark, d))


@query("l03_meteo_regional", _with(S.SQL_METEO_ROWS) +
       "SELECT * FROM meteo ORDER BY timestamp DESC, code_insee LIMIT 500")
def l03(spark, d):
    """Newest 500 weather rows."""
    return L.meteo_regional(gold.meteo(spark, d), limit=500)


@query("j05_resolve_keys", _with(S.SQL_FACT_STAGED, S.SQL_DIM_REGION, S.SQL_DIM_SOURCE) + """, base AS (
  SELECT DISTINCT ts FROM fact_staged WHERE ts < TIMESTAMP '1998-01-01 00:00:00'),
hit AS (SELECT region_code IN (SELECT id_region FROM dim_region) AND ts IN (SELECT ts FROM base)
               AND source_name IN (SELECT id_source FROM dim_source) AS ok FROM fact_staged)
SELECT COUNT(*) FILTER (WHERE ok) AS resolved_rows, COUNT(*) FILTER (WHERE NOT ok) AS unmatched_rows FROM hit""")
def j05(spark, d):
    """Staged rows (repeats included) against the region, time and source dimensions; the time dimension is
    the one the loads before 1998 left."""
    rows = S.to_fact_rows(S.fact_staged(spark, d))
    time = S.dim_time_from(rows).where(F.col("id_date") < 199801010000).select("id_date")
    resolved, unmatched = J.resolve_keys(rows, [(S.dim_region(spark, d).select("id_region"), "id_region"),
                                                (time, "id_date"), (S.dim_source(spark).select("id_source"), "id_source")])
    return A.side_by_side(resolved.agg(F.count(F.lit(1)).alias("resolved_rows")), unmatched)


@query("j06_orphans", _with(S.SQL_METEO_ROWS, S.SQL_DIM_REGION) + """SELECT code_insee, COUNT(*) AS orphan_rows
FROM meteo WHERE code_insee IS NOT NULL AND code_insee NOT IN (SELECT id_region FROM dim_region) GROUP BY code_insee""")
def j06(spark, d):
    """Weather rows whose region is not in the region dimension (NOT IN semantics)."""
    o = J.orphans(gold.meteo(spark, d), "code_insee", S.dim_region(spark, d), "id_region")
    return o.groupBy("code_insee").agg(F.count(F.lit(1)).alias("orphan_rows"))


# ---------------------------------------------------------------------------
# Capacity
# ---------------------------------------------------------------------------

_PADS = ("\t", "\u00a0", " \r\n", "\u2003", "")


@query("p13_padded_cells", """SELECT p_partkey AS load_ordinal, p_retailprice AS safe, p_retailprice AS mw, CAST(p_size AS VARCHAR) AS code,
  p_retailprice / 1000.0 AS kw_mw FROM part""")
def p13_padded(spark, d):
    """Register cells padded with tabs, no-break and other white space read as their numbers."""
    raw = S.table(spark, d, "part")
    pad = F.get(F.array(*map(F.lit, _PADS)), (F.col("p_partkey") % len(_PADS)).cast("int"))
    padded = lambda c: F.concat(pad, c, F.reverse(pad))
    price, comma = F.col("p_retailprice").cast("string"), F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(","))
    return raw.select(F.col("p_partkey").alias("load_ordinal"), C.safe_double(padded(price)).alias("safe"),
                      C.parse_mw(padded(comma)).alias("mw"),
                      C.canonical_region_code(padded(F.concat(F.col("p_size").cast("string"), F.lit(".0")))).alias("code"),
                      C.kw_to_mw(padded(comma)).alias("kw_mw"))


@query("a07_capacity_by_region_source", _with(S.SQL_CAPACITY) + "SELECT * FROM capacity")
def a07(spark, d):
    """Canonical source, region code, kW -> MW, sum per (region, source, year)."""
    return gold.capacity(spark, d)


@query("a18_capacity_latest_year", _with(S.SQL_CAPACITY) + """SELECT source_name, annee,
  floor(puissance_installee_mw + 0.5) AS puissance FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY source_name ORDER BY annee DESC, code_insee_region) AS rn
    FROM capacity) x WHERE rn = 1""")
def a18(spark, d):
    """Per source, the newest year's capacity (rounded)."""
    return A.capacity_latest_year(gold.capacity(spark, d))


@query("l05_capacity_regional", _with(S.SQL_CAPACITY) + "SELECT * FROM capacity WHERE annee = 2024")
def l05(spark, d):
    """Capacity rows of one year in region / year / source order."""
    return L.capacity_regional(gold.capacity(spark, d), year=2024)


# ---------------------------------------------------------------------------
# Outages
# ---------------------------------------------------------------------------

_MAINT_COLS = "event_id, unit_name, affected_area, event_type, start_date, end_date, unavailable_mw, description"


@query("k01_maintenance_silver", _with(S.SQL_MAINTENANCE_RAW) + f"SELECT {_MAINT_COLS} FROM maintenance")
def k01m(spark, d):
    """P04, P07, P10, K01 over outage reports (repeated reports of one event collapse to the last)."""
    return gold.maintenance(spark, d)


@query("j04_maintenance_join", _with(S.SQL_MAINTENANCE_RAW, S.SQL_DIM_REGION) + f"""SELECT m.*, r.code_insee
FROM maintenance m LEFT JOIN dim_region r ON lower(trim(m.affected_area)) = lower(trim(r.nom_region))""")
def j04(spark, d):
    """J04 (D17): outage events ⟕ region on the normalised area name."""
    m = gold.maintenance(spark, d).withColumn("_area", F.lower(F.trim("affected_area")))
    r = S.dim_region(spark, d).select(F.lower(F.trim("nom_region")).alias("_area"), "code_insee")
    return J.maintenance_join(m, r, region_key="_area").drop("_area")


@query("l04_maintenance_events", _with(S.SQL_MAINTENANCE_RAW) +
       f"SELECT {_MAINT_COLS} FROM maintenance ORDER BY start_date DESC NULLS LAST, event_id LIMIT 100")
def l04(spark, d):
    """Newest 100 outage events."""
    return L.maintenance_events(gold.maintenance(spark, d), limit=100)


# ---------------------------------------------------------------------------
# Alerts, lifecycle
# ---------------------------------------------------------------------------

@query("k04_daily_alert_dedup", _with(S.SQL_ALERTS) + """SELECT user_id, region_code, alert_type, sent_at, alert_id
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, region_code, alert_type, CAST(sent_at AS DATE)
                                   ORDER BY sent_at, alert_id) AS rn FROM alerts) x WHERE rn = 1""")
def k04(spark, d):
    """One alert per (user, region, type, day), the earliest kept."""
    return K.daily_alert_dedup(S.alert_log(spark, d), tie=["alert_id"])


@query("k02_distinct_first_label", _with(S.SQL_ALERTS) +
       "SELECT user_id, arg_min(region_code, (sent_at, alert_id)) AS region_code FROM alerts GROUP BY user_id")
def k02(spark, d):
    """First region label per user in time order."""
    return K.distinct_first_label(S.alert_log(spark, d), "user_id", "region_code", ["sent_at", "alert_id"])


_LAST_SEEN_SQL = _with(S.SQL_SILVER) + """, seen AS (
  SELECT code_insee_region AS code_insee, arg_min(libelle_region, date_heure) AS nom_region,
         MIN(date_heure) AS first_seen_at, MAX(date_heure) AS last_seen_at
  FROM silver GROUP BY 1),
marked AS (SELECT code_insee, nom_region, first_seen_at, last_seen_at,
  CASE WHEN last_seen_at < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 168 HOUR THEN 'inactive'
       WHEN last_seen_at < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR THEN 'stale'
       ELSE 'active' END AS status, 'active' AS previous_status FROM seen)
"""


def _marked(spark, d):
    sil, _ = gold.silver_readings(spark, d)
    dim = Y.last_seen(sil)
    return Y.mark_status(dim, "2024-01-30 12:00:00")


@query("y02_mark_status", _LAST_SEEN_SQL + "SELECT * FROM marked")
def y02(spark, d):
    """Y02 (with T05 semantics in batch): last reading per region, then stale (>24 h) / inactive (>168 h)."""
    return _marked(spark, d)


@query("a06_status_summary", _LAST_SEEN_SQL + "SELECT status, COUNT(*) AS n FROM marked GROUP BY status")
def a06(spark, d):
    """Regions per lifecycle status."""
    return A.status_summary(_marked(spark, d))


@query("y03_lifecycle_summary", _LAST_SEEN_SQL +
       "SELECT status, COUNT(*) AS changed FROM marked WHERE status <> previous_status GROUP BY status")
def y03(spark, d):
    """Number of regions whose status changed, per new status."""
    return Y.lifecycle_summary(_marked(spark, d))


@query("y03_changed_regions", _LAST_SEEN_SQL +
       "SELECT status, code_insee AS code FROM marked WHERE status <> previous_status")
def y03_regions(spark, d):
    """The regions whose status changed."""
    return Y.changed_regions(_marked(spark, d))


@query("j07_diff_known", _with(S.SQL_SILVER, S.SQL_DIM_REGION) + """, seen AS (
  SELECT DISTINCT code_insee_region AS code_insee FROM silver)
SELECT code_insee, CASE WHEN code_insee IN (SELECT code_insee FROM dim_region) THEN 'updated' ELSE 'new' END AS kind
FROM seen""")
def j07(spark, d):
    """Regions seen in the readings split into new and known."""
    sil, _ = gold.silver_readings(spark, d)
    seen = sil.select(F.col("code_insee_region").alias("code_insee")).distinct()
    new, upd = J.diff_known(seen, S.dim_region(spark, d), "code_insee")
    return new.withColumn("kind", F.lit("new")).unionByName(upd.withColumn("kind", F.lit("updated")))


@query("y01_discover_regions", _with(S.SQL_SILVER, S.SQL_DIM_REGION) + f""", seen AS (
  SELECT code_insee_region AS code_insee, arg_min(libelle_region, date_heure) AS nom_region FROM silver GROUP BY 1),
base AS (SELECT code_insee, nom_region, 'stale' AS status, TIMESTAMP '2023-12-01 00:00:00' AS first_seen_at,
                TIMESTAMP '2023-12-15 00:00:00' AS last_seen_at FROM dim_region)
SELECT COALESCE(b.code_insee, s.code_insee) AS code_insee, COALESCE(s.nom_region, b.nom_region) AS nom_region,
  CASE WHEN s.code_insee IS NOT NULL THEN 'active' ELSE b.status END AS status,
  COALESCE(b.first_seen_at, TIMESTAMP '{REF_NOW}') AS first_seen_at,
  CASE WHEN s.code_insee IS NOT NULL AND b.code_insee IS NOT NULL
       THEN greatest(b.last_seen_at, TIMESTAMP '{REF_NOW}')
       WHEN s.code_insee IS NOT NULL THEN TIMESTAMP '{REF_NOW}' ELSE b.last_seen_at END AS last_seen_at
FROM base b FULL OUTER JOIN seen s ON b.code_insee = s.code_insee""")
def y01(spark, d):
    """Regions seen in the readings merged into a stale region dimension."""
    sil, _ = gold.silver_readings(spark, d)
    base = S.dim_region(spark, d).select(
        "code_insee", "nom_region", F.lit("stale").alias("status"),
        F.lit("2023-12-01 00:00:00").cast("timestamp_ntz").alias("first_seen_at"),
        F.lit("2023-12-15 00:00:00").cast("timestamp_ntz").alias("last_seen_at"))
    _, _, merged = Y.discover_regions(sil, base, REF_NOW)
    return merged


# ---------------------------------------------------------------------------
# Climate grid
# ---------------------------------------------------------------------------

_GRID_IN_BOX = "(latitude BETWEEN 41.3 AND 51.1 AND longitude BETWEEN -5.2 AND 9.6)"


@query("j08_nearest_centroid", _with(S.SQL_GRID, CENTROIDS) + f""", d AS (
  SELECT g.vec_id, g.latitude, g.longitude, c.code,
         ROW_NUMBER() OVER (PARTITION BY g.vec_id ORDER BY (g.latitude - c.lat) * (g.latitude - c.lat)
                            + (g.longitude - c.lon) * (g.longitude - c.lon), c.ord) AS rn
  FROM grid g, centroids c WHERE {_GRID_IN_BOX})
SELECT vec_id, latitude, longitude, code AS region_code FROM d WHERE rn = 1""")
def j08(spark, d):
    """P14 + J08: grid points inside the box mapped to the nearest region centroid."""
    g = silver.bbox_filter(S.grid_points(spark, d))
    return J.nearest_centroid(g, "latitude", "longitude").select("vec_id", "latitude", "longitude", "region_code")


@query("p09_climate_silver", _with(S.SQL_GRID, CENTROIDS) + f""", d AS (
  SELECT g.*, c.code AS region_code,
         ROW_NUMBER() OVER (PARTITION BY g.vec_id ORDER BY (g.latitude - c.lat) * (g.latitude - c.lat)
                            + (g.longitude - c.lon) * (g.longitude - c.lon), c.ord) AS rn
  FROM grid g, centroids c WHERE {_GRID_IN_BOX}),
pts AS (SELECT region_code, valid_time, sqrt(u100 * u100 + v100 * v100) AS w,
               round_even(t2m - 273.15, 2) AS t, ssrd FROM d WHERE rn = 1),
agg AS (SELECT region_code, valid_time, AVG(w) AS wind_speed_100m,
               CAST(AVG(CAST(t AS DECIMAL(18,4))) AS DOUBLE) AS temperature_c, AVG(ssrd) AS ssrd,
               COUNT(*) AS grid_points FROM pts GROUP BY 1, 2)
SELECT region_code, valid_time, ROUND(COALESCE(wind_speed_100m, 0), 4) AS wind_speed_100m,
  ROUND(LAST_VALUE(temperature_c IGNORE NULLS) OVER (PARTITION BY region_code ORDER BY valid_time
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS temperature_c,
  ROUND(COALESCE(ssrd, 0), 2) AS ssrd, grid_points FROM agg""")
def p09(spark, d):
    """Climate grid to Silver (mean per region-hour, ERA5 rules)."""
    out, _ = silver.transform_climate(S.grid_points(spark, d))
    return out.select("region_code", "valid_time", F.round("wind_speed_100m", 4).alias("wind_speed_100m"),
                      F.round("temperature_c", 4).alias("temperature_c"), F.round("ssrd", 2).alias("ssrd"),
                      "grid_points")


# ---------------------------------------------------------------------------
# Documents and pages
# ---------------------------------------------------------------------------

_WS_CLASS = ("[\\t\\n\\x0b\\f\\r \\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
             "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+")


@query("p07_clean_text", f"""SELECT doc_id, md5(trim(regexp_replace(text, '{_WS_CLASS}', ' ', 'g'))) AS text_md5,
  CAST(length(trim(regexp_replace(text, '{_WS_CLASS}', ' ', 'g'))) AS BIGINT) AS n_chars_clean FROM documents""")
def p07(spark, d):
    """P07 over whole document texts (hash and length of the cleaned text)."""
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    c = clean_text("text")
    return docs.select("doc_id", F.md5(c).alias("text_md5"), F.length(c).cast("long").alias("n_chars_clean"))


def _cell_sql(cls: str) -> str:
    inner = f"regexp_extract(tr, '<td[^>]*class=\"{cls}\"[^>]*>(.*?)</td>', 1, 's')"
    text = f"replace(replace(replace({inner}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


_HTML_ROWS_SQL = f"""rows AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<tr[^>]*class="[^"]*event-row[^"]*"[^>]*>.*?</tr>', 0, 's'))
    AS tr FROM pages),
cells AS (
  SELECT page_id, url, regexp_extract(tr, 'data-event-id="([^"]*)"', 1) AS data_id,
         {_cell_sql('event-id')} AS id_cell, {_cell_sql('unit-name')} AS unit_name, {_cell_sql('area')} AS affected_area,
         {_cell_sql('event-type')} AS event_type, {_cell_sql('start-date')} AS start_date,
         {_cell_sql('end-date')} AS end_date,
         CASE WHEN tr LIKE '%class="unavail-mw"%' THEN {_cell_sql('unavail-mw')} ELSE '0' END AS mw_text,
         {_cell_sql('description')} AS description
  FROM rows)"""


@query("s16_extract_events_html", _with(_HTML_ROWS_SQL) + f"""SELECT page_id,
  COALESCE(NULLIF(id_cell, ''), data_id) AS event_id, unit_name, affected_area, event_type, start_date, end_date,
  COALESCE(TRY_CAST(replace(replace(trim(mw_text), ',', '.'), ' ', '') AS DOUBLE), 0.0) AS unavailable_mw,
  description, url AS source_url, TIMESTAMP '{REF_NOW}' AS scraped_at
FROM cells WHERE COALESCE(NULLIF(id_cell, ''), data_id) <> ''""")
def s16(spark, d):
    """S16 over every page of the driver's ``pages`` table (they hold no outage rows; the extractor is
    checked with rows on rendered outage pages and on a fixture in tests)."""
    pages = S.table(spark, d, "pages").select("page_id", "url", "html")
    return html_events.extract_events_html(pages, "html", "url", scraped_at=REF_NOW)


@query("s16_extract_outage_pages", _with(S.SQL_MAINTENANCE_RAW) + f"""SELECT load_ordinal // 10 AS page_id,
  event_id, unit_name, affected_area, event_type, strftime(start_date, '%Y-%m-%dT%H:%M:%SZ') AS start_date,
  strftime(end_date, '%Y-%m-%dT%H:%M:%SZ') AS end_date,
  CASE WHEN event_type = '5-LOW' THEN CAST(0 AS DOUBLE) ELSE CAST(unavailable_mw AS DOUBLE) END AS unavailable_mw,
  trim(description) AS description, 'https://outages.example/page/' || CAST(load_ordinal // 10 AS VARCHAR) AS source_url,
  TIMESTAMP '{REF_NOW}' AS scraped_at FROM maint_raw""")
def s16b(spark, d):
    """Every event row of outage pages rendered from the outage reports (ten orders per page)."""
    return html_events.extract_events_html(S.outage_pages(spark, d), "html", "url", scraped_at=REF_NOW)


@query("s17_profile_schema", """SELECT 'doc_id' AS column_name, 'bigint' AS data_type,
  COUNT(*) FILTER (WHERE doc_id IS NULL) AS null_count, CAST(MIN(doc_id) AS VARCHAR) AS sample_value,
  COUNT(*) AS total_rows FROM documents
UNION ALL SELECT 'text', 'string', COUNT(*) FILTER (WHERE text IS NULL), md5(MIN(text)), COUNT(*) FROM documents
UNION ALL SELECT 'lang', 'string', COUNT(*) FILTER (WHERE lang IS NULL), MIN(lang), COUNT(*) FROM documents
UNION ALL SELECT 'source', 'string', COUNT(*) FILTER (WHERE source IS NULL), MIN(source), COUNT(*) FROM documents
UNION ALL SELECT 'n_chars', 'bigint', COUNT(*) FILTER (WHERE n_chars IS NULL), CAST(MIN(n_chars) AS VARCHAR),
  COUNT(*) FROM documents""")
def s17(spark, d):
    """Per column type, NULL count, a sample value (the minimum; text hashed) and total rows."""
    p = profile.profile_schema(S.table(spark, d, "documents"), hash_long_text=["text"])
    return p


# ---------------------------------------------------------------------------
# Streaming (availableNow over the events file; outputs read back as tables)
# ---------------------------------------------------------------------------

def _events_stream(spark, d):
    schema = S.table(spark, d, "events").schema
    return T.stream_bronze(spark, d, schema, glob="events.parquet")


def _append_and_read(sdf, name):
    spark = sdf.sparkSession
    root = scratch_path(spark, name)
    q = (sdf.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("t01_stream_bronze", _with(S.SQL_RAW_READINGS) + "SELECT * FROM raw_readings")
def t01(spark, d):
    """The events file as a stream, bound to raw readings, landed as Bronze Parquet."""
    return _append_and_read(S.raw_readings_from(_events_stream(spark, d)), "t01")


@query("t03_stream_upsert", _with(S.SQL_SILVER) + "SELECT * FROM silver")
def t03(spark, d):
    """Streamed readings upserted per micro-batch (keep-last per region and slot)."""
    sdf = silver.readings_columns(S.raw_readings_from(_events_stream(spark, d)))
    sdf = sdf.where(F.col("code_insee_region").isNotNull() & F.col("date_heure").isNotNull())
    root = scratch_path(spark, "t03")
    T.stream_upsert(sdf, f"{root}/table", ["code_insee_region", "date_heure"], ["load_ordinal"],
                    checkpoint=f"{root}/ckpt")
    return T.read_upserted(spark, f"{root}/table").drop("v")


@query("t04_stream_national", (_with(S.SQL_RAW_READINGS) + """, long AS (
  SELECT CAST(substr(date_heure, 1, 19) AS TIMESTAMP) - INTERVAL 1 HOUR AS date_heure, source_name, mw FROM (
    SELECT date_heure, 'nucleaire' AS source_name, TRY_CAST(trim(nucleaire) AS DOUBLE) AS mw FROM raw_readings
    UNION ALL SELECT date_heure, 'eolien', TRY_CAST(trim(eolien) AS DOUBLE) FROM raw_readings
    UNION ALL SELECT date_heure, 'solaire', TRY_CAST(trim(solaire) AS DOUBLE) FROM raw_readings
    UNION ALL SELECT date_heure, 'hydraulique', TRY_CAST(trim(hydraulique) AS DOUBLE) FROM raw_readings
    UNION ALL SELECT date_heure, 'gaz', TRY_CAST(trim(gaz) AS DOUBLE) FROM raw_readings) x
  WHERE mw > 0),
w AS (SELECT time_bucket(INTERVAL 15 MINUTE, date_heure) AS window_start,
             time_bucket(INTERVAL 15 MINUTE, date_heure) + INTERVAL 15 MINUTE AS window_end, source_name,
             CAST(SUM(CAST(mw AS DECIMAL(28,4))) AS DOUBLE) AS mw, COUNT(*) AS readings
      FROM long GROUP BY 1, 2, 3)
SELECT * FROM w WHERE window_end <= (SELECT MAX(date_heure) FROM long) - INTERVAL 4 HOUR"""))
def t04(spark, d):
    """National positive MW per 15-minute window and source on the stream (final windows)."""
    sdf = silver.readings_columns(S.raw_readings_from(_events_stream(spark, d)))
    long = A.unpivot_sources(sdf, ["date_heure"])
    return _append_and_read(T.stream_national(long), "t04")


@query("t05_stream_last_seen", _LAST_SEEN_SQL + "SELECT * FROM marked")
def t05(spark, d):
    """Last reading per region kept as streaming state, merged per batch, then marked."""
    sdf = silver.readings_columns(S.raw_readings_from(_events_stream(spark, d)))
    root = scratch_path(spark, "t05")
    q = (T.stream_last_seen(sdf).writeStream.outputMode("update")
         .foreachBatch(T.merge_last_seen(f"{root}/table")).option("checkpointLocation", f"{root}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    dim = T.read_upserted(spark, f"{root}/table").drop("v")
    return Y.mark_status(dim, "2024-01-30 12:00:00").select(
        "code_insee", "nom_region", "first_seen_at", "last_seen_at", "status", "previous_status")


@query("t05_status_changes", _with(S.SQL_SILVER) + """, seen AS (
  SELECT code_insee_region AS code_insee, arg_min(libelle_region, date_heure) AS nom_region,
         MIN(date_heure) AS first_seen_at, MAX(date_heure) AS last_seen_at FROM silver GROUP BY 1),
now AS (SELECT MAX(last_seen_at) - INTERVAL 4 HOUR AS t FROM seen)
SELECT code_insee, nom_region, NULL AS previous_status, 'active' AS status, first_seen_at, last_seen_at FROM seen
UNION ALL
SELECT code_insee, nom_region, 'active', CASE WHEN last_seen_at < t - INTERVAL 168 HOUR THEN 'inactive' ELSE 'stale' END,
       first_seen_at, last_seen_at
FROM seen, now WHERE last_seen_at < t - INTERVAL 24 HOUR""")
def t05_changes(spark, d):
    """Every status change of a region, out of event-time timers on the stream; the last ones are Y02's at the watermark."""
    sdf = silver.readings_columns(S.raw_readings_from(_events_stream(spark, d)))
    root = scratch_path(spark, "t05-changes")
    TS.run_status_changes(spark, TS.stream_status_changes(sdf), f"{root}/out", f"{root}/ckpt")
    out = spark.read.parquet(f"{root}/out")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen_at", "last_seen_at")})


def _two_deliveries(spark, d, run, again: bool):
    """Events landed in two deliveries, ``run`` after each: all but every tenth, then those and, with ``again``, the first once more."""
    root = scratch_path(spark, "two-deliveries")
    ev = S.table(spark, d, "events")
    second = F.col("event_id") % 10 == 0
    for rows in (ev.where(~second), ev if again else ev.where(second)):
        rows.write.mode("append").parquet(f"{root}/in")
        run(T.stream_bronze(spark, f"{root}/in", ev.schema), root)
    return root


_DELIVERIES = """WITH a AS (SELECT * FROM events WHERE event_id % 10 <> 0), b AS (SELECT * FROM events WHERE event_id % 10 = 0),
mark AS (SELECT date_trunc('millisecond', MAX(ts)) AS newest FROM a)"""


@query("t02_late_rows", _DELIVERIES + """, behind AS (SELECT newest - INTERVAL 4 HOUR AS w FROM mark)
SELECT 'readings' AS source, (SELECT COUNT(*) FROM a) + COUNT(*) AS read,
       (SELECT COUNT(*) FROM a) + COUNT(*) FILTER (WHERE ts > w AND event_id % 10 = 0) AS kept,
       COUNT(*) FILTER (WHERE ts > w AND event_id % 10 <> 0) AS repeats, COUNT(*) FILTER (WHERE ts <= w) AS late
FROM events, behind""")
def t02_late(spark, d):
    """Re-delivered and late readings on the stream: what was read is kept, a repeat or late, in the audit records."""
    def run(sdf, root):
        TA.run_audited(sdf.select("event_id", "ts"), lambda s: T.stream_dedup(s, ["event_id"], "ts"), f"{root}/out", f"{root}/ckpt",
                       f"{root}/audit", "t02", "readings", REF_NOW)
    root = _two_deliveries(spark, d, run, again=True)
    return TA.accounting_report(spark.read.parquet(f"{root}/audit"))


@query("t06_late_alerts", _DELIVERIES + """, behind AS (SELECT newest - INTERVAL 24 HOUR AS w FROM mark),
k AS (SELECT events.*, user_id || '/' || event_type || '/' || (value > 250) || '/' || CAST(ts AS DATE) AS key FROM events),
first AS (SELECT DISTINCT key FROM k WHERE event_id % 10 <> 0),
more AS (SELECT DISTINCT key FROM k, behind WHERE event_id % 10 = 0 AND ts > w AND key NOT IN (SELECT key FROM first))
SELECT 'alerts' AS source, COUNT(*) AS read, (SELECT COUNT(*) FROM first) + (SELECT COUNT(*) FROM more) AS kept,
       COUNT(*) FILTER (WHERE event_id % 10 <> 0 OR ts > w) - (SELECT COUNT(*) FROM first) - (SELECT COUNT(*) FROM more) AS repeats,
       COUNT(*) FILTER (WHERE event_id % 10 = 0 AND ts <= w) AS late
FROM k, behind""")
def t06_late(spark, d):
    """Late alerts on the stream are counted in the audit records beside the repeats."""
    def run(sdf, root):
        TA.run_audited(S.alert_log_from(sdf), T.stream_alert_dedup, f"{root}/out", f"{root}/ckpt", f"{root}/audit", "t06", "alerts", REF_NOW)
    root = _two_deliveries(spark, d, run, again=False)
    return TA.accounting_report(spark.read.parquet(f"{root}/audit"))


@query("t04_late_windows", """WITH long AS (
  SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts) AS slot, time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE AS window_end
  FROM events WHERE value > 0),
w AS (SELECT MAX(slot) FILTER (WHERE event_id % 10 <> 0) - INTERVAL 4 HOUR AS one, MAX(slot) - INTERVAL 4 HOUR AS two FROM long),
x AS (SELECT window_end, two, event_id % 10 = 0 AND window_end <= one AS late FROM long, w)
SELECT 'national' AS source, COUNT(*) AS read, COUNT(*) FILTER (WHERE NOT late AND window_end <= two) AS final,
       COUNT(*) FILTER (WHERE NOT late AND window_end > two) AS open, COUNT(*) FILTER (WHERE late) AS late FROM x""")
def t04_late(spark, d):
    """Readings of final windows, of open windows (in the state store) and late ones add up to what was read."""
    slot = F.window("ts", "15 minutes")["start"]

    def run(sdf, root):
        long = sdf.where("value > 0").select(slot.alias("date_heure"), F.lit("all").alias("source_name"), F.col("value").alias("valeur_mw"))
        TA.run_audited(long, T.stream_national, f"{root}/out", f"{root}/ckpt", f"{root}/audit", "t04", "national", REF_NOW)
    root = _two_deliveries(spark, d, run, again=False)
    return TA.window_accounting(spark, spark.read.parquet(f"{root}/audit"), spark.read.parquet(f"{root}/out"), f"{root}/ckpt")


@query("t06_stream_alert_dedup", _with(S.SQL_ALERTS) +
       "SELECT DISTINCT user_id, region_code, alert_type, CAST(sent_at AS DATE) AS day FROM alerts")
def t06(spark, d):
    """One alert per (user, region, type, day) on the stream."""
    s = T.stream_alert_dedup(S.alert_log_from(_events_stream(spark, d)))
    return _append_and_read(s.select("user_id", "region_code", "alert_type", "day"), "t06")


# ---------------------------------------------------------------------------
# File sources and sinks over files Spark writes from the tables
# ---------------------------------------------------------------------------

_RAW_SCHEMA = StructType(
    [StructField(c, StringType()) for c in ("code_insee_region", "libelle_region", "date_heure",
                                            "nucleaire", "eolien", "solaire", "hydraulique", "gaz")]
    + [StructField("consommation", DoubleType()), StructField("load_ordinal", LongType())])


@query("s01_read_bronze_json", _with(S.SQL_RAW_READINGS) + "SELECT * FROM raw_readings")
def s01(spark, d):
    """Raw readings landed as JSON files by Spark, read back file by file with record positions."""
    root = scratch_path(spark, "s01")
    S.raw_readings(spark, d).write.mode("overwrite").json(root)
    return F_.read_bronze_json(spark, root, _RAW_SCHEMA).drop("_file", "_pos")


def _mixed_bronze(spark, d, block: int = 100_000, lines: int = 10_000) -> str:
    """Readings landed in every shape the feed has: JSON Lines (click), arrays per region (view) that begin with a
    number, envelopes per region (purchase) that begin with a text and a null, JSON Lines with cut lines ('ND' signups),
    and arrays cut in half (error). A payload holds a region's readings out of ``block`` consecutive event ids, so none
    grows with a hot region; JSON Lines files, each read as a whole, hold ``lines`` lines at most."""
    root = scratch_path(spark, "s01-mixed")
    raw = S.raw_readings(spark, d)
    body = F.to_json(F.struct(*raw.columns))
    own = {e: F.col(c).isNotNull() for e, c in S.EVENT_COLUMN}
    raw.where(own["click"]).select(body.alias("value")).write.option("maxRecordsPerFile", lines).text(f"{root}/lines")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for kind, event in (("array", "view"), ("envelope", "purchase"), ("cut", "error")):
        keys = ["code_insee_region", "slot"]
        rows = raw.where(own[event]).withColumn("slot", F.floor(F.col("load_ordinal") / block)).repartition(tasks, *keys)
        per = rows.groupBy(*keys).agg(F.collect_list(F.struct(*raw.columns)).alias("r"))
        text = F.to_json("r")
        rest = F.substring(text, F.lit(2), F.char_length(text))
        if kind == "array":
            text = F.concat(F.lit("[7,"), rest)
        elif kind == "envelope":
            text = F.concat(F.lit('{"records":["x",null,'), rest, F.lit("}"))
        else:
            text = F.substring(text, F.lit(1), (F.char_length(text) / 2).cast("int"))
        # one value per file, as the feed lands one payload per file
        sinks.land_payloads(per.select(F.sha2(F.to_json(F.struct(*keys)), 256).alias("name"), F.concat(text, F.lit("\n")).alias("value")),
                            f"{root}/{kind}", ".txt")
    cut = F.when(F.col("hydraulique") == "ND", F.substring(body, F.lit(1), F.char_length(body) - 5)).otherwise(body)
    raw.where(own["signup"]).select(cut.alias("value")).write.option("maxRecordsPerFile", lines).text(f"{root}/damaged")
    return root


@query("s01_mixed_json", _with(S.SQL_RAW_READINGS) + """SELECT * FROM raw_readings
WHERE gaz IS NULL AND (hydraulique IS NULL OR hydraulique <> 'ND')""")
def s01_mixed(spark, d):
    """Good records of JSON Lines, arrays, envelopes and damaged files read together."""
    q = scratch_path(spark, "s01-quarantine")
    return F_.read_bronze_json(spark, _mixed_bronze(spark, d), _RAW_SCHEMA, on_damage="quarantine", quarantine=q,
                               glob="*.txt").drop("_file", "_pos")


_PAYLOADS = "COUNT(DISTINCT code_insee_region || '/' || (load_ordinal // 100000)) FROM raw_readings WHERE"


@query("s01_quarantine", _with(S.SQL_RAW_READINGS) + f"""SELECT 'cut line' AS kind, COUNT(*) AS texts FROM raw_readings
WHERE hydraulique = 'ND'
UNION ALL SELECT 'cut file', {_PAYLOADS} gaz IS NOT NULL
UNION ALL SELECT 'number', {_PAYLOADS} eolien IS NOT NULL
UNION ALL SELECT 'text', {_PAYLOADS} solaire IS NOT NULL
UNION ALL SELECT 'null', {_PAYLOADS} solaire IS NOT NULL""")
def s01_quarantine(spark, d):
    """Damaged texts kept in the quarantine: cut lines, cut files and the elements of good payloads that are no records."""
    q = scratch_path(spark, "s01-quarantine")
    F_.read_bronze_json(spark, _mixed_bronze(spark, d), _RAW_SCHEMA, on_damage="quarantine", quarantine=q, glob="*.txt")
    kind = (F.when(F.col("reason") == "no JSON", F.when(F.startswith("text", F.lit("[")), "cut file").otherwise("cut line"))
            .when(F.col("text") == "7", "number").when(F.col("text") == '"x"', "text").when(F.col("text") == "null", "null"))
    return spark.read.parquet(q).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("texts"))


def _capacity_csv(spark, d, sep, names=None):
    raw = S.capacity_raw(spark, d)
    if names:
        raw = raw.withColumnsRenamed(names)
    root = scratch_path(spark, "capcsv")
    # several files, as many as the session's shuffle partitions (sized for the cluster), written in parallel
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "8"))
    raw.repartition(n).write.mode("overwrite").option("header", True).option("sep", sep).csv(root)
    return root


@query("s02_read_capacity_csv", _with(S.SQL_CAPACITY) + "SELECT * FROM capacity")
def s02(spark, d):
    """S02, P05, P06: ';' register written by Spark, delimiter sniffed, names resolved, then A07."""
    root = _capacity_csv(spark, d, ";")
    df = F_.read_capacity_csv(spark, root)
    df = F_.resolve_aliases(df, {"code": REGION_CODE_CANDIDATES, "name": REGION_NAME_CANDIDATES,
                                 "fil": FILIERE_CANDIDATES, "kw": PUISSANCE_CANDIDATES,
                                 "year": ANNEE_CANDIDATES})
    df = df.withColumn("_ord", F.col("load_ordinal").cast("long"))
    return A.capacity_by_region_source(df, "code", "name", "fil", "kw", ["_ord"], year_col="year")


@query("s02_mixed_headers", _with(S.SQL_CAPACITY) + "SELECT * FROM capacity")
def s02_mixed(spark, d):
    """Register files with other column orders and delimiters, each read by its own header, then A07."""
    raw = S.capacity_raw(spark, d)
    root = scratch_path(spark, "s02-mixed")
    halves = ((F.col("puismaxinstallee") < "95", raw.columns, ";"), (F.col("puismaxinstallee") >= "95", raw.columns[::-1], ","))
    for part, cols, sep in halves:
        raw.where(part).select(*cols).write.mode("append").option("header", True).option("sep", sep).csv(root)
    df = F_.resolve_aliases(F_.read_capacity_csv(spark, root), {
        "code": REGION_CODE_CANDIDATES, "name": REGION_NAME_CANDIDATES, "fil": FILIERE_CANDIDATES,
        "kw": PUISSANCE_CANDIDATES, "year": ANNEE_CANDIDATES})
    return A.capacity_by_region_source(df.withColumn("_ord", F.col("load_ordinal").cast("long")), "code", "name", "fil", "kw",
                                       ["_ord"], year_col="year")


@query("s04_validate_csv", "SELECT 'PASS' AS status, COUNT(*) AS rows FROM part")
def s04(spark, d):
    """Per-file validation of CSV files written by Spark (required columns present)."""
    root = _capacity_csv(spark, d, ",", {"coderegion": "code_insee_region",
                                         "puismaxinstallee": "puissance_installee_mw"})
    st = F_.validate_and_route_csv(spark, root)
    return st.groupBy("status").agg(F.sum("rows").alias("rows"))


@query("s09_audit_report", f"""SELECT 'capacity_csv' AS source, 'success' AS status,
  COUNT(*) AS records, TIMESTAMP '{REF_NOW}' AS last_run FROM part""")
def s09(spark, d):
    """One audit record per validated register file appended to the audit table, read back and
    reported per source and status (records, last run; the run count is the number of files the write
    produced, a session setting, so it is left out of the result)."""
    root = _capacity_csv(spark, d, ",", {"coderegion": "code_insee_region",
                                         "puismaxinstallee": "puissance_installee_mw"})
    st = F_.validate_and_route_csv(spark, root)
    path = scratch_path(spark, "s09-audit")
    sinks.audit_append(sinks.audit_from_status(st, "capacity_csv", REF_NOW), path)
    return sinks.audit_report(spark.read.parquet(path)).drop("runs")


@query("s09_audited_write", f"""SELECT 'rte' AS source, 'success' AS status, CAST(1 AS BIGINT) AS runs,
  COUNT(*) AS records, TIMESTAMP '{REF_NOW}' AS last_run FROM events""")
def s09b(spark, d):
    """The raw regional batch written with its row count observed during the write, one audit
    record appended, the audit table reported per source and status."""
    root = scratch_path(spark, "s09-write")
    sinks.write_audited(S.raw_readings(spark, d), f"{root}/bronze", f"{root}/audit", _LAND_JOB, "rte", REF_NOW)
    return sinks.audit_report(spark.read.parquet(f"{root}/audit"))


_GOLD_SOURCE_COLS = [c for c in SOURCE_COLUMN_MAP if c in ("nucleaire_mw", "eolien_mw", "solaire_mw",
                                                           "hydraulique_mw", "gaz_mw")]


@query("s09_ingest_run_stages", _with(S.SQL_SILVER) + """SELECT 'bronze' AS stage, 'success' AS status,
  COUNT(*) AS rows, CAST(NULL AS VARCHAR) AS error FROM raw_readings
UNION ALL SELECT 'silver', 'success', COUNT(*), NULL FROM silver
UNION ALL SELECT 'gold', 'success', """ + " + ".join(f"COUNT({c})" for c in _GOLD_SOURCE_COLS) + """, NULL
FROM silver""")
def s09c(spark, d):
    """One ingest run of the raw regional batch (Bronze landing, Silver day layout,
    Gold fact merged into the touched days), each stage's rows observed during its write; the stage table."""
    from voltaic.plans.ingest import ingest_run
    stages, _ = ingest_run(spark, S.raw_readings(spark, d), scratch_path(spark, "run"), _LAND_JOB, REF_NOW)
    return stages


@query("s04_land_good_csv", _with(S.sql_capacity()) + """SELECT coderegion AS code_insee_region, region, filiere,
  puismaxinstallee AS puissance_installee_mw, CAST(annee AS VARCHAR) AS annee,
  CAST(load_ordinal AS VARCHAR) AS load_ordinal FROM capacity_raw""")
def s04b(spark, d):
    """Register files written by Spark validated, and the rows of the good ones landed as text
    columns named by each file's own header (quoted decimal-comma values parsed by ``from_csv``)."""
    root = _capacity_csv(spark, d, ",", {"coderegion": "code_insee_region",
                                         "puismaxinstallee": "puissance_installee_mw"})
    land = scratch_path(spark, "s04-land")
    F_.validate_and_route_csv(spark, root, landing=land)
    return spark.read.parquet(land).drop("_file")


@query("s11_skip_unchanged", "SELECT COUNT(*) AS first_records, CAST(0 AS BIGINT) AS second_files FROM part")
def s11(spark, d):
    """Checksum-based change detection: every file is new once, unchanged on the second pass."""
    root = _capacity_csv(spark, d, ";")
    todo, state = F_.skip_unchanged(spark, root, None)
    state_path = scratch_path(spark, "s11-state")
    state.write.mode("overwrite").parquet(state_path)
    todo2, _ = F_.skip_unchanged(spark, root, spark.read.parquet(state_path))
    return A.side_by_side(todo.agg(F.sum("records").alias("first_records")),
                          todo2.agg(F.count(F.lit(1)).alias("second_files")))


@query("s06_write_silver_daily", _with(S.SQL_SILVER) + "SELECT *, " + ", ".join(
    f"{c} IS NULL AS {c}_is_null" for c in SILVER_FLAG_COLS) + """,
  CAST(year(date_heure) AS INTEGER) AS year, CAST(month(date_heure) AS INTEGER) AS month,
  CAST(day(date_heure) AS INTEGER) AS day FROM silver WHERE date_heure >= TIMESTAMP '2024-01-15 00:00:00'""")
def s06(spark, d):
    """Silver written as year/month/day partitions, read back, pruned incrementally."""
    out, _ = gold.silver_readings(spark, d)
    root = scratch_path(spark, "s06")
    sinks.write_silver_daily(out, root)
    tree = F_.read_parquet_tree(spark, root)
    return F_.incremental_filter(tree, since="2024-01-15 00:00:00", partition_cols=True)


@query("s07_write_silver_monthly", _with(S.SQL_MAINTENANCE_RAW) + f"""SELECT {_MAINT_COLS},
  CAST(year(start_date) AS INTEGER) AS year, CAST(month(start_date) AS INTEGER) AS month FROM maintenance""")
def s07(spark, d):
    """Outage Silver written as year/month partitions (NULL-time rows to quarantine), read back."""
    m = gold.maintenance(spark, d)
    root = scratch_path(spark, "s07")
    sinks.write_silver_monthly(m, f"{root}/table", "start_date", quarantine=f"{root}/quarantine")
    return spark.read.parquet(f"{root}/table")


@query("s15_explode_hourly_payload", _with(S.SQL_METEO_ROWS) + """SELECT code_insee, timestamp, temperature_c,
  wind_speed_10m, cloudcover_pct FROM meteo WHERE temperature_c IS NOT NULL""")
def s15(spark, d):
    """Hourly payloads (parallel arrays per region and local day) exploded and moved to UTC."""
    m = gold.meteo(spark, d)
    local = F.from_utc_timestamp(F.col("timestamp").cast("timestamp"), "Europe/Paris")
    e = m.select("code_insee", F.to_date(local).alias("day"), F.struct(
        F.date_format(local, "yyyy-MM-dd'T'HH:mm").alias("t"), F.col("temperature_c").alias("a"),
        F.col("wind_speed_10m").alias("w"), F.col("cloudcover_pct").alias("c")).alias("h"))
    pay = e.groupBy("code_insee", "day").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    pay = pay.select("code_insee", F.struct(
        F.transform("hs", lambda x: x["t"]).alias("time"), F.transform("hs", lambda x: x["a"]).alias("temperature_2m"),
        F.transform("hs", lambda x: x["w"]).alias("wind_speed_10m"),
        F.transform("hs", lambda x: x["c"]).alias("cloudcover")).alias("hourly"))
    return W_.normalize_meteo(W_.explode_hourly_payload(pay)).select(
        "code_insee", "timestamp", "temperature_c", "wind_speed_10m", "cloudcover_pct")


# ---------------------------------------------------------------------------
# Remaining projections, joins and aggregates
# ---------------------------------------------------------------------------

@query("a03_unpivot_sources", _with(S.SQL_SILVER) + " UNION ALL ".join(
    f"SELECT code_insee_region, date_heure, '{src}' AS source_name, {col} AS valeur_mw FROM silver "
    f"WHERE {col} IS NOT NULL" for col, src in SOURCE_COLUMN_MAP.items()
    if col in ("nucleaire_mw", "eolien_mw", "solaire_mw", "hydraulique_mw", "gaz_mw")))
def a03(spark, d):
    """Wide Silver readings -> long (region, time, source, MW); NULL MW dropped."""
    out, _ = gold.silver_readings(spark, d)
    return A.unpivot_sources(out, ["code_insee_region", "date_heure"])


@query("a21_time_extent", _with(S.SQL_SILVER) + """SELECT MIN(date_heure) AS start, MAX(date_heure) AS "end",
  COUNT(*) AS rows, COUNT(DISTINCT code_insee_region) AS regions FROM silver""")
def a21(spark, d):
    """Time extent, rows and regions of the Silver readings."""
    out, _ = gold.silver_readings(spark, d)
    return A.time_extent(out, "date_heure", "code_insee_region")


@query("a21_regions", _with(S.SQL_SILVER) + "SELECT DISTINCT code_insee_region AS region FROM silver")
def a21_regions(spark, d):
    """The regions processed."""
    out, _ = gold.silver_readings(spark, d)
    return A.regions_processed(out, "code_insee_region")


@query("w04_top_n_per_group", _with(S.SQL_FACT_STAGED, S.SQL_FACT) + """SELECT id_region, id_date, id_source, valeur_mw,
  CAST(rank AS INTEGER) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id_region
    ORDER BY valeur_mw DESC NULLS LAST, id_date, id_source) AS rank FROM fact) WHERE rank <= 5""")
def w04(spark, d):
    """The five largest readings of every region."""
    f = gold.fact(spark, d).select("id_region", "id_date", "id_source", "valeur_mw")
    return W.top_n_per_group(f, ["id_region"], [F.col("valeur_mw").desc_nulls_last(), "id_date", "id_source"], 5)


@query("w05_last_n", _with(NAT) + "SELECT timestamp, consommation_mw FROM national ORDER BY timestamp DESC LIMIT 96")
def w05(spark, d):
    """The newest 96 national points."""
    return W.last_n(gold.national(spark, d).select("timestamp", "consommation_mw"), "timestamp", 96)


@query("a23_data_points", _with(GOLD, S.SQL_RECORDS) + "SELECT COUNT(*) AS data_points FROM records WHERE code_insee = '7'")
def a23_points(spark, d):
    """Records of one region."""
    return A.data_points(gold.records(spark, d), "7")


@query("k03_distinct_pairs", _with(S.SQL_FACT_STAGED, S.SQL_FACT) + "SELECT DISTINCT id_region, id_source FROM fact")
def k03(spark, d):
    """Distinct (region, source) pairs of the fact."""
    return K.distinct_pairs(gold.fact(spark, d), ["id_region", "id_source"])


_METEO_TIME_SQL = """meteo_time AS (
  SELECT DISTINCT CAST(strftime(date_trunc('hour', ts), '%Y%m%d%H%M') AS BIGINT) AS id_date,
         date_trunc('hour', ts) AS horodatage FROM events)"""


@query("j02_meteo_join", _with(S.SQL_METEO_ROWS, S.SQL_DIM_REGION, _METEO_TIME_SQL) + """SELECT r.code_insee,
  r.nom_region, t.horodatage, m.temperature_c, m.wind_speed_10m, m.cloudcover_pct
FROM meteo m JOIN meteo_time t ON CAST(strftime(m.timestamp, '%Y%m%d%H%M') AS BIGINT) = t.id_date
             JOIN dim_region r ON m.code_insee = r.id_region""")
def j02(spark, d):
    """Weather fact ⋈ time ⋈ region on natural keys."""
    from voltaic.functions.calendar import date_key
    m = gold.meteo(spark, d).select(date_key("timestamp").alias("id_date"), F.col("code_insee").alias("id_region"),
                                    "temperature_c", "wind_speed_10m", "cloudcover_pct")
    ev = S.table(spark, d, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("horodatage"))
    t = ev.distinct().select(date_key("horodatage").alias("id_date"), "horodatage")
    return J.meteo_join(m, t, S.dim_region(spark, d)).select(
        "code_insee", "nom_region", "horodatage", "temperature_c", "wind_speed_10m", "cloudcover_pct")


@query("j03_capacity_join", _with(S.SQL_CAPACITY, S.SQL_DIM_REGION, S.SQL_DIM_SOURCE) + """SELECT r.code_insee,
  r.nom_region, s.source_name, s.is_green, c.annee, c.puissance_installee_mw
FROM capacity c JOIN dim_region r ON c.code_insee_region = r.id_region
                JOIN dim_source s ON c.source_name = s.id_source""")
def j03(spark, d):
    """Capacity fact ⋈ region ⋈ source."""
    cap = gold.capacity(spark, d).select(F.col("code_insee_region").alias("id_region"),
                                         F.col("source_name").alias("id_source"), "annee", "puissance_installee_mw")
    return J.capacity_join(cap, S.dim_region(spark, d), S.dim_source(spark)).select(
        "code_insee", "nom_region", "source_name", "is_green", "annee", "puissance_installee_mw")


@query("a24_emission_factor_dim", _with(S.SQL_EMISSION_RAW) + """SELECT filiere, source_name,
  co2 AS co2_kg_mwh, ch4 AS ch4_kg_mwh, n2o AS n2o_kg_mwh, reference, annee, co2 AS factor FROM (
  SELECT lower(trim(filiere)) AS filiere, lower(trim(source_energie)) AS source_name, co2, ch4, n2o, reference, annee,
         ROW_NUMBER() OVER (PARTITION BY lower(trim(filiere)), lower(trim(source_energie))
                            ORDER BY annee DESC, co2 DESC, ch4 DESC, n2o DESC, reference DESC) AS rn
  FROM emission_raw) x WHERE rn = 1""")
def a24(spark, d):
    """Emission-factor register written as CSV by Spark, read back as text, typed, latest year per
    (sector, energy)."""
    root = scratch_path(spark, "efcsv")
    S.emission_raw(spark, d).write.option("header", True).csv(root)
    return A.emission_factor_dim(spark.read.option("header", True).csv(root))


@query("j10_factor_lookup", _with(NAT, FACTORS) + """SELECT s.timestamp, s.source_name, s.mw,
  COALESCE(f.factor, CAST(0 AS DOUBLE)) AS factor FROM nat_src s LEFT JOIN factors f ON s.source_name = f.source_name""")
def j10(spark, d):
    """Emission factor per national source value (unknown source -> 0)."""
    n = gold.national(spark, d).select("timestamp", F.explode("sources").alias("source_name", "mw"))
    return J.factor_lookup(n, "source_name")


@query("p17_load_factor", _with(S.SQL_FACT_STAGED, S.SQL_FACT, S.SQL_CAPACITY) + """SELECT f.id_region, f.id_date,
  f.id_source, f.valeur_mw, CASE WHEN c.puissance_installee_mw IS NULL OR c.puissance_installee_mw = 0 THEN NULL
  ELSE f.valeur_mw / c.puissance_installee_mw END AS facteur_charge
FROM fact f LEFT JOIN (SELECT * FROM capacity WHERE annee = 2024) c
  ON f.id_region = c.code_insee_region AND f.id_source = c.source_name""")
def p17(spark, d):
    """Load factor = MW / installed capacity of the region and source (2024 register)."""
    cap = gold.capacity(spark, d).where(F.col("annee") == 2024).select(
        F.col("code_insee_region").alias("id_region"), F.col("source_name").alias("id_source"),
        "puissance_installee_mw")
    f = gold.fact(spark, d).select("id_region", "id_date", "id_source", "valeur_mw")
    return A.load_factor(f, cap)


@query("p19_json_safe", _with(GOLD, S.SQL_RECORDS) + """SELECT code_insee, region,
  strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp, sources_text, facteur_charge, consommation_mw FROM records""")
def p19(spark, d):
    """API-ready records (timestamps as ISO text, decimals as doubles, NULLs kept)."""
    from voltaic.functions.columns import json_safe
    r = gold.records(spark, d)
    return json_safe(r.select("code_insee", "region", "timestamp", map_as_text("sources").alias("sources_text"),
                              "facteur_charge", "consommation_mw"))


@query("t02_stream_dedup", _with(S.SQL_RAW_READINGS) + """SELECT DISTINCT code_insee_region,
  CAST(substr(date_heure, 1, 19) AS TIMESTAMP) - INTERVAL 1 HOUR AS date_heure FROM raw_readings""")
def t02(spark, d):
    """Exact re-deliveries of a (region, slot) dropped on the stream within the 4-hour look-back."""
    sdf = silver.readings_columns(S.raw_readings_from(_events_stream(spark, d)))
    s = T.stream_dedup(sdf, ["code_insee_region", "date_heure"], "date_heure")
    return _append_and_read(s.select("code_insee_region", F.col("date_heure").cast("timestamp_ntz")), "t02")


# ---------------------------------------------------------------------------
# Individual quality checks (Q01-Q06), fill-zero (N02) and the weather upsert
# ---------------------------------------------------------------------------

_Q_COLS = "name, check_type, status, severity"


def _check_out(df: DataFrame, counted: str) -> DataFrame:
    """The check's row with the number it counted (a field of its details)."""
    return df.select("name", "check_type", "status", "severity",
                     F.get_json_object("details", f"$.{counted}").cast("double").alias("counted"))


@query("q01_null_check", _with(S.SQL_SILVER) + f"""SELECT 'q01' AS name, 'null_check' AS check_type,
  CASE WHEN COUNT(*) FILTER (WHERE code_insee_region IS NULL OR date_heure IS NULL OR nucleaire_mw IS NULL) > 0
       THEN 'FAIL' ELSE 'PASS' END AS status, 'CRITICAL' AS severity,
  CAST(COUNT(*) FILTER (WHERE nucleaire_mw IS NULL) AS DOUBLE) AS counted FROM silver""")
def q01(spark, d):
    sil, _ = gold.silver_readings(spark, d)
    return _check_out(Q.null_check(sil, ["code_insee_region", "date_heure", "nucleaire_mw"], "q01", "CRITICAL"),
                      "null_counts.nucleaire_mw")


@query("q02_range_check", _with(S.SQL_SILVER) + """SELECT 'q02' AS name, 'range_check' AS check_type,
  CASE WHEN COUNT(*) FILTER (WHERE consommation_mw < 0 OR consommation_mw > 500) > 0 THEN 'FAIL' ELSE 'PASS' END
    AS status, 'WARNING' AS severity,
  CAST(COUNT(*) FILTER (WHERE consommation_mw < 0 OR consommation_mw > 500) AS DOUBLE) AS counted FROM silver""")
def q02(spark, d):
    sil, _ = gold.silver_readings(spark, d)
    return _check_out(Q.range_check(sil, "consommation_mw", 0, 500, "q02", "WARNING"), "out_of_range")


@query("q03_row_count", _with(S.SQL_SILVER) + """, c AS (SELECT (SELECT COUNT(*) FROM silver) AS a,
  (SELECT COUNT(*) FROM raw_readings) AS e)
SELECT 'q03' AS name, 'row_count' AS check_type,
  CASE WHEN e = 0 THEN CASE WHEN a = 0 THEN 'PASS' ELSE 'WARN' END
       WHEN abs(a - e) * 100.0 / e <= 5 THEN 'PASS' WHEN abs(a - e) * 100.0 / e <= 10 THEN 'WARN'
       ELSE 'FAIL' END AS status, 'WARNING' AS severity, CAST(a AS DOUBLE) AS counted FROM c""")
def q03(spark, d):
    """Q03: Silver row count against the raw batch (5 % tolerance)."""
    sil, _ = gold.silver_readings(spark, d)
    return _check_out(Q.row_count_check(sil, S.raw_readings(spark, d), name="q03", severity="WARNING"), "actual")


@query("q04_freshness", _with(S.SQL_SILVER) + f"""SELECT 'q04' AS name, 'freshness' AS check_type,
  CASE WHEN MAX(date_heure) IS NULL THEN 'FAIL'
       WHEN epoch(TIMESTAMP '2024-02-01 06:00:00') - epoch(MAX(date_heure)) <= 24 * 3600 THEN 'PASS'
       WHEN epoch(TIMESTAMP '2024-02-01 06:00:00') - epoch(MAX(date_heure)) <= 48 * 3600 THEN 'WARN'
       ELSE 'FAIL' END AS status, 'WARNING' AS severity,
  ROUND((epoch(TIMESTAMP '2024-02-01 06:00:00') - epoch(MAX(date_heure))) / 3600.0, 2)::DOUBLE AS counted FROM silver""")
def q04(spark, d):
    sil, _ = gold.silver_readings(spark, d)
    return _check_out(Q.freshness_check(sil, "date_heure", 24, "2024-02-01 06:00:00", "q04", "WARNING"), "age_hours")


@query("q05_fk_integrity", _with(S.SQL_METEO_ROWS, S.SQL_DIM_REGION) + """SELECT 'q05' AS name,
  'fk_integrity' AS check_type,
  CASE WHEN COUNT(*) FILTER (WHERE code_insee IS NOT NULL AND code_insee NOT IN (SELECT id_region FROM dim_region)) > 0
       THEN 'FAIL' ELSE 'PASS' END AS status, 'CRITICAL' AS severity,
  CAST(COUNT(*) FILTER (WHERE code_insee IS NOT NULL AND code_insee NOT IN (SELECT id_region FROM dim_region)) AS DOUBLE)
    AS counted FROM meteo""")
def q05(spark, d):
    m = gold.meteo(spark, d)
    return _check_out(Q.fk_integrity(m, {"code_insee": (S.dim_region(spark, d), "id_region")}, "q05", "CRITICAL"), "orphans.code_insee")


@query("q06_load_factor_range", _with(S.SQL_FACT_STAGED, S.SQL_FACT) + """SELECT 'q06' AS name,
  'facteur_charge_range' AS check_type,
  CASE WHEN COUNT(*) FILTER (WHERE facteur_charge < 0 OR facteur_charge > 1.5) > 0 THEN 'FAIL' ELSE 'PASS' END
    AS status, 'WARNING' AS severity,
  CAST(COUNT(*) FILTER (WHERE facteur_charge < 0 OR facteur_charge > 1.5) AS DOUBLE) AS counted FROM fact""")
def q06(spark, d):
    return _check_out(Q.load_factor_range(gold.fact(spark, d), name="q06", severity="WARNING"), "out_of_range")


@query("n02_fill_zero", _with(S.SQL_SILVER) + """SELECT code_insee_region, date_heure,
  COALESCE(nucleaire_mw, 0.0) AS nucleaire_mw, COALESCE(eolien_mw, 0.0) AS eolien_mw,
  COALESCE(solaire_mw, 0.0) AS solaire_mw, COALESCE(hydraulique_mw, 0.0) AS hydraulique_mw,
  COALESCE(gaz_mw, 0.0) AS gaz_mw FROM silver""")
def n02(spark, d):
    """NULL MW -> 0.0 on the Silver readings."""
    sil, _ = gold.silver_readings(spark, d)
    cols = ["nucleaire_mw", "eolien_mw", "solaire_mw", "hydraulique_mw", "gaz_mw"]
    return N.null_fill_zero(sil.select("code_insee_region", "date_heure", *cols), cols)


@query("u05_upsert_fact_meteo", _with(S.SQL_METEO_ROWS) + """, b AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY code_insee, timestamp ORDER BY load_ordinal DESC) AS rn
                 FROM meteo_rows WHERE timestamp < TIMESTAMP '2024-01-15 00:00:00') x WHERE rn = 1),
i AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY code_insee, timestamp ORDER BY load_ordinal DESC) AS rn
                 FROM meteo_rows WHERE temperature_c IS NOT NULL) x WHERE rn = 1)
SELECT COALESCE(i.code_insee, b.code_insee) AS id_region, COALESCE(i.timestamp, b.timestamp) AS timestamp,
  CASE WHEN i.code_insee IS NOT NULL THEN i.temperature_c ELSE b.temperature_c END AS temperature_c,
  CASE WHEN i.code_insee IS NOT NULL THEN i.wind_speed_10m ELSE b.wind_speed_10m END AS wind_speed_10m,
  CASE WHEN i.code_insee IS NOT NULL THEN i.cloudcover_pct ELSE b.cloudcover_pct END AS cloudcover_pct
FROM b FULL OUTER JOIN i ON b.code_insee = i.code_insee AND b.timestamp = i.timestamp""")
def u05(spark, d):
    """Weather base (before 15 Jan) merged with the batch of temperature readings (all dates)."""
    rows = S.meteo_rows(spark, d).withColumnsRenamed({"code_insee": "id_region", "timestamp": "id_date"})
    keys = ["id_region", "id_date"]
    base = K.dedup_keep_last(rows.where(F.col("id_date") < F.lit("2024-01-15").cast("timestamp_ntz")),
                             keys, ["load_ordinal"]).drop("load_ordinal")
    inc = K.dedup_keep_last(rows.where(F.col("temperature_c").isNotNull()), keys, ["load_ordinal"])
    merged = U.upsert_fact_meteo(base, inc.select(*base.columns))
    return merged.select("id_region", F.col("id_date").alias("timestamp"), "temperature_c", "wind_speed_10m", "cloudcover_pct")


# ---------------------------------------------------------------------------
# Remaining upserts and landing sinks
# ---------------------------------------------------------------------------

_U06_BRAND = "Brand#1"


def _cap_fact(cap: DataFrame) -> DataFrame:
    return cap.select(F.col("code_insee_region").alias("id_region"), F.col("source_name").alias("id_source"),
                      "annee", "puissance_installee_mw")


@query("u06_upsert_fact_capacity", _with(S.sql_capacity(), S.sql_capacity("_i", _U06_BRAND)) + """
SELECT COALESCE(i.code_insee_region, b.code_insee_region) AS id_region,
  COALESCE(i.source_name, b.source_name) AS id_source, COALESCE(i.annee, b.annee) AS annee,
  CASE WHEN i.code_insee_region IS NOT NULL THEN i.puissance_installee_mw ELSE b.puissance_installee_mw END
    AS puissance_installee_mw
FROM capacity b FULL OUTER JOIN capacity_i i
  ON b.code_insee_region = i.code_insee_region AND b.source_name = i.source_name AND b.annee = i.annee""")
def u06(spark, d):
    """Capacity fact from the whole register merged with one operator's re-delivered register."""
    base = _cap_fact(gold.capacity(spark, d))
    inc = _cap_fact(gold.capacity(spark, d, brand=_U06_BRAND))
    return U.upsert_fact_capacity(base, inc)


def _fact_maintenance(spark, d, statuses):
    """Outage Silver of one scrape with its region resolved from the area name."""
    m = gold.maintenance(spark, d, statuses).withColumn("_area", F.lower(F.trim("affected_area")))
    r = S.dim_region(spark, d).select(F.lower(F.trim("nom_region")).alias("_area"),
                                      F.col("code_insee").alias("id_region"))
    return J.maintenance_join(m, r, region_key="_area").drop("_area")


_MAINT_FACT = _MAINT_COLS.split(", ") + ["id_region"]
_MAINT_FACT_SQL = ",\n".join(
    f"fm{sfx} AS (SELECT m.*, r.code_insee AS id_region FROM maintenance{sfx} m LEFT JOIN dim_region r"
    f" ON lower(trim(m.affected_area)) = lower(trim(r.nom_region)))" for sfx in ("_b", "_i"))


@query("u07_upsert_fact_maintenance", _with(S.sql_maintenance("_b", ("F", "O")), S.sql_maintenance("_i", ("O", "P")),
                                             S.SQL_DIM_REGION, _MAINT_FACT_SQL) +
       "SELECT COALESCE(i.event_id, b.event_id) AS event_id, " + ", ".join(
           f"CASE WHEN i.event_id IS NOT NULL THEN i.{c} ELSE b.{c} END AS {c}" for c in _MAINT_FACT[1:]) +
       "\nFROM fm_b b FULL OUTER JOIN fm_i i ON b.event_id = i.event_id")
def u07(spark, d):
    """Outage fact of an earlier scrape (status F, O) merged with a later one (O, P) on event id."""
    base = _fact_maintenance(spark, d, ("F", "O")).select(*_MAINT_FACT)
    inc = _fact_maintenance(spark, d, ("O", "P")).select(*_MAINT_FACT)
    return U.upsert_fact_maintenance(base, inc)


@query("u01_upsert_dim_region", _with(S.SQL_SILVER, S.SQL_DIM_REGION, S.SQL_REGION_ATTRS) + """, seen AS (
  SELECT code_insee_region AS code_insee, arg_min(libelle_region, date_heure) AS nom_region FROM silver
  WHERE trim(libelle_region) <> '' GROUP BY 1)
SELECT COALESCE(b.code_insee, s.code_insee) AS code_insee,
  CASE WHEN s.code_insee IS NOT NULL THEN s.nom_region ELSE b.nom_region END AS nom_region,
  b.population, b.superficie_km2
FROM region_attrs b FULL OUTER JOIN seen s ON b.code_insee = s.code_insee""")
def u01(spark, d):
    """U01, K02 (D16): region dimension merged with the regions seen in the readings; the batch carries
    no population or area, and those known values survive the NULLs."""
    sil, _ = gold.silver_readings(spark, d)
    seen = K.distinct_first_label(sil, "code_insee_region", "libelle_region", ["date_heure"],
                                  code_alias="code_insee", label_alias="nom_region")
    return U.upsert_dim_region(S.region_attrs(spark, d), seen)


@query("u03_upsert_dim_source", _with(S.SQL_FACT_STAGED, S.SQL_DIM_SOURCE) + """, seen AS (
  SELECT DISTINCT source_name FROM fact_staged),
inc AS (SELECT s.source_name, d.is_green FROM seen s LEFT JOIN dim_source d ON s.source_name = d.source_name)
SELECT COALESCE(i.source_name, b.source_name) AS source_name,
  CASE WHEN i.source_name IS NOT NULL THEN i.is_green ELSE b.is_green END AS is_green
FROM dim_source b FULL OUTER JOIN inc i ON b.source_name = i.source_name""")
def u03(spark, d):
    """Sources seen in the staged production rows merged into the source dimension; the green flag
    is overwritten from the fixed source list (NULL for a source outside it)."""
    base = S.dim_source(spark).select("source_name", "is_green")
    seen = S.fact_staged(spark, d).select("source_name").distinct()
    inc = seen.join(base, "source_name", "left")
    return U.upsert_dim_source(base, inc)


@query("s05_land_raw", _with(S.SQL_RAW_READINGS) + f"""SELECT *, '{_LAND_JOB}' AS job_id,
  TIMESTAMP '{REF_NOW}' AS ingested_at, DATE '{REF_NOW[:10]}' AS ingest_date FROM raw_readings""")
def s05(spark, d):
    """The raw regional batch appended under source/sub-path/ingest_date= with job id and time, read back."""
    root = scratch_path(spark, "s05")
    out = sinks.land_raw(S.raw_readings(spark, d), root, "rte", "regional", ts=REF_NOW, job_id=_LAND_JOB)
    return spark.read.parquet(out)


@query("s08_write_bronze_climate", _with(S.SQL_GRID, CENTROIDS) + f""", d AS (
  SELECT g.*, c.code AS region_code,
         ROW_NUMBER() OVER (PARTITION BY g.vec_id ORDER BY (g.latitude - c.lat) * (g.latitude - c.lat)
                            + (g.longitude - c.lon) * (g.longitude - c.lon), c.ord) AS rn
  FROM grid g, centroids c WHERE {_GRID_IN_BOX})
SELECT vec_id, valid_time, latitude, longitude, u100, v100, t2m, ssrd, region_code,
  lpad(CAST(year(valid_time) AS VARCHAR), 4, '0') AS year, lpad(CAST(month(valid_time) AS VARCHAR), 2, '0') AS month
FROM d WHERE rn = 1""")
def s08(spark, d):
    """Grid points tagged with their region, landed as year/month/region file groups, read back."""
    g = J.nearest_centroid(silver.bbox_filter(S.grid_points(spark, d)), "latitude", "longitude")
    root = scratch_path(spark, "s08")
    sinks.write_bronze_climate(g, root)
    schema = StructType([f for f in g.schema.fields if f.name != "region_code"] +
                        [StructField(c, StringType()) for c in ("year", "month", "region_code")])
    return spark.read.schema(schema).parquet(root)


@query("s10_snapshot_tables", _with(S.SQL_CAPACITY) + f"SELECT *, DATE '{REF_NOW[:10]}' AS snapshot_date FROM capacity")
def s10(spark, d):
    """Dated snapshot of the region dimension and the capacity fact; the capacity snapshot read back."""
    root = scratch_path(spark, "s10")
    paths = sinks.snapshot_tables({"dim_region": S.dim_region(spark, d), "fact_capacity": gold.capacity(spark, d)},
                                  root, REF_NOW[:10])
    return spark.read.parquet(paths["fact_capacity"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

