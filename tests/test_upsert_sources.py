import datetime as dt
import glob
import json
import os

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from voltaic.operators import upsert as U
from voltaic.sources import files, html_events, sinks, weather
from voltaic.sources.profile import profile_schema

FACT = "id_date long, id_region string, id_source string, valeur_mw double, facteur_charge double"


def test_upsert_idempotent_and_policies(spark):
    base = spark.createDataFrame([(1, "11", "eolien", 10.0, 0.1), (2, "11", "eolien", 20.0, 0.2)], FACT)
    inc = spark.createDataFrame([(2, "11", "eolien", 25.0, None), (3, "84", "gaz", 5.0, 0.5)], FACT)
    once = U.upsert_fact_energy(base, inc)
    twice = U.upsert_fact_energy(once, inc)
    rows = sorted(tuple(r) for r in once.collect())
    assert rows == sorted(tuple(r) for r in twice.collect())
    assert rows == [(1, "11", "eolien", 10.0, 0.1), (2, "11", "eolien", 25.0, None), (3, "84", "gaz", 5.0, 0.5)]
    keep = U.merge_frames(base, inc, ["id_date", "id_region", "id_source"], keep_non_null=["facteur_charge"])
    assert {r.id_date: r.facteur_charge for r in keep.collect()}[2] == 0.2
    t = spark.createDataFrame([(1, "a")], "id_date long, h string")
    t2 = U.upsert_dim_time(t, spark.createDataFrame([(1, "b"), (2, "c")], "id_date long, h string"))
    assert sorted(tuple(r) for r in t2.collect()) == [(1, "a"), (2, "c")]


def test_dim_region_keeps_known_population(spark):
    base = spark.createDataFrame([("11", "Ile", 12.0, 100.0)],
                                 "code_insee string, nom_region string, population double, superficie_km2 double")
    inc = spark.createDataFrame([("11", "Île-de-France", None, None)],
                                "code_insee string, nom_region string, population double, superficie_km2 double")
    r = U.upsert_dim_region(base, inc).first()
    assert (r.nom_region, r.population, r.superficie_km2) == ("Île-de-France", 12.0, 100.0)


def test_upsert_table_partitioned_twice(spark, tmp_dir):
    path = os.path.join(tmp_dir, "fact")
    a = spark.createDataFrame([("2025-01-01", "11", 1.0), ("2025-01-02", "11", 2.0)], "day string, k string, v double")
    U.upsert_table(spark, path, a, ["day", "k"], partition_by=["day"])
    b = spark.createDataFrame([("2025-01-02", "11", 5.0), ("2025-01-02", "84", 6.0)], "day string, k string, v double")
    for _ in range(2):  # a replayed batch gives the same table
        U.upsert_table(spark, path, b, ["day", "k"], partition_by=["day"])
    got = sorted((r.day, r.k, r.v) for r in spark.read.schema(a.schema).parquet(path).collect())
    assert got == [("2025-01-01", "11", 1.0), ("2025-01-02", "11", 5.0), ("2025-01-02", "84", 6.0)]
    d = os.path.join(tmp_dir, "dim")
    U.upsert_table(spark, d, a, ["day", "k"])
    assert U.upsert_table(spark, d, b, ["day", "k"]).endswith("v=1")
    assert U.read_latest(spark, d).count() == 3


SCHEMA = StructType([StructField("code_insee_region", StringType()), StructField("date_heure", StringType()),
                     StructField("pompage", StringType()), StructField("eolien", DoubleType())])


def test_read_bronze_json_shapes(spark, tmp_dir):
    os.makedirs(os.path.join(tmp_dir, "b", "2025"), exist_ok=True)
    with open(os.path.join(tmp_dir, "b", "a.json"), "w") as f:
        json.dump([{"code_insee_region": "11", "date_heure": "2025-02-20T10:30:00+01:00", "pompage": "0"},
                   {"code_insee_region": "11", "date_heure": "2025-02-20T10:30:00+01:00", "pompage": 0}], f)
    with open(os.path.join(tmp_dir, "b", "2025", "b.json"), "w") as f:
        json.dump({"records": [{"code_insee_region": "84", "eolien": 3.5}]}, f)
    with open(os.path.join(tmp_dir, "b", "c.json"), "w") as f:
        json.dump({"code_insee_region": "93", "eolien": 1}, f)
    df = files.read_bronze_json(spark, os.path.join(tmp_dir, "b"), SCHEMA)
    rows = sorted((r.code_insee_region, r._pos, r.pompage) for r in df.collect())
    assert rows == [("11", 0, "0"), ("11", 1, "0"), ("84", 0, None), ("93", 0, None)]


def test_capacity_csv_sniff_and_validation(spark, tmp_dir):
    d = os.path.join(tmp_dir, "csv")
    os.makedirs(d)
    with open(os.path.join(d, "ok.csv"), "w", encoding="utf-8") as f:
        f.write("﻿Code_INSEE_Region ,libelle,Puissance_Installee_MW\n11,Ile,12.5\n84,Auv,3\n")
    with open(os.path.join(d, "hdr.csv"), "w") as f:
        f.write("code_insee_region,puissance_installee_mw\n")
    with open(os.path.join(d, "miss.csv"), "w") as f:
        f.write("a,b\n1,2\n")
    with open(os.path.join(d, "empty.csv"), "w") as f:
        f.write("")
    with open(os.path.join(d, "blank.csv"), "w") as f:
        f.write("  \n\t\n\n")  # whitespace only: empty, as str.strip() sees it
    with open(os.path.join(d, "late header+1 %.csv"), "w", newline="") as f:
        f.write("\r\n   \r\nCODE_INSEE_REGION,puissance_installee_mw\r\n11,1\r\n\r\n24,2\r\n")
    st = {os.path.basename(r.file): (r.status, r.error, r.rows)
          for r in files.validate_and_route_csv(spark, d, landing=os.path.join(tmp_dir, "land"),
                                                quarantine=os.path.join(tmp_dir, "q"), ts=NOWTS).collect()}
    assert st["ok.csv"] == ("PASS", None, 2)
    assert st["hdr.csv"][1] == "header only" and st["miss.csv"][0] == "FAIL"
    assert st["empty.csv"] == ("FAIL", "empty file", 0) and st["blank.csv"] == ("FAIL", "empty file", 0)
    assert st["late header+1 %.csv"] == ("PASS", None, 2)  # header = first non-blank line; CRLF; odd name
    assert len(st) == 6
    land = spark.read.parquet(os.path.join(tmp_dir, "land"))
    assert sorted(land.columns) == ["_file", "code_insee_region", "libelle", "puissance_installee_mw"]
    # each file's rows are named by its own header, whatever the column order
    got = sorted((r.code_insee_region, r.libelle or "", r.puissance_installee_mw) for r in land.collect())
    assert got == [("11", "", "1"), ("11", "Ile", "12.5"), ("24", "", "2"), ("84", "Auv", "3")]
    kept = spark.read.parquet(os.path.join(tmp_dir, "q"))  # the bad files, with their own lines
    assert kept.select("file").distinct().count() == 4 and kept.where("line IS NOT NULL").count() == 6
    semi = os.path.join(tmp_dir, "semi.csv")
    with open(semi, "w") as f:
        f.write("code_insee_region;filiere;puissance\n11;Eolien;1,5\n")
    c = files.read_capacity_csv(spark, semi)
    assert c.select("code_insee_region", "filiere", "puissance").first() == ("11", "Eolien", "1,5")


NOWTS = "2025-06-20 12:00:00"


def test_skip_unchanged(spark, tmp_dir):
    d = os.path.join(tmp_dir, "ef")
    os.makedirs(d)
    with open(os.path.join(d, "f.csv"), "w") as f:
        f.write("h\n1\n2\n\n")
    todo, state = files.skip_unchanged(spark, d, None)
    r = todo.first()
    assert r.records == 2 and len(r.checksum) == 16
    todo2, _ = files.skip_unchanged(spark, d, state.cache())
    assert todo2.count() == 0


def test_hourly_payload_and_meteo(spark):
    df = spark.createDataFrame(
        [("11", (["2025-01-15T10:00", "2025-01-15T11:00", "2025-01-15T12:00"], [5.0, None, 7.0], [1.0, 2.0],
                 [10.0, 20.0, 30.0]))],
        "code_insee string, hourly struct<time:array<string>, temperature_2m:array<double>, "
        "wind_speed_10m:array<double>, cloudcover:array<double>>")
    rows = weather.explode_hourly_payload(df).collect()
    assert [(r.time, r.temperature_c) for r in rows] == [("2025-01-15T10:00", 5.0)]  # cut to shortest, NULL dropped
    m = weather.normalize_meteo(weather.explode_hourly_payload(df)).first()
    assert m.timestamp == dt.datetime(2025, 1, 15, 9, 0)  # Paris winter time -> UTC


PAGE = """<html><body><table>
<tr class="event-row" data-event-id="EVT-1"><td class="event-id">EVT-1</td><td class="unit-name">Unit A</td>
<td class="area">Grand Est</td><td class="event-type">planned</td><td class="start-date">2026-01-10T00:00:00Z</td>
<td class="end-date">2026-01-20T00:00:00Z</td><td class="unavail-mw"> 910,0 </td>
<td class="description">Annual   outage</td></tr>
<tr class="event-row" data-event-id="EVT-2"><td class="event-id"></td><td class="unit-name">Unit B</td>
<td class="unavail-mw">n/a</td></tr>
<tr class="event-row"><td class="unit-name">no id</td></tr>
<tr class="other"><td class="event-id">X</td></tr>
</table></body></html>"""


def test_extract_events_html(spark):
    pages = spark.createDataFrame([(1, "file://page.html", PAGE), (2, "u2", "<p>nothing")],
                                  "page_id long, url string, html string")
    ev = {r.event_id: r for r in html_events.extract_events_html(pages).collect()}
    assert set(ev) == {"EVT-1", "EVT-2"}
    assert ev["EVT-1"].unavailable_mw == 910.0 and ev["EVT-1"].affected_area == "Grand Est"
    assert ev["EVT-2"].unavailable_mw == 0.0 and ev["EVT-1"].source_url == "file://page.html"


def test_export_fr_csv_bytes(spark, tmp_dir):
    df = spark.createDataFrame([("11", "Île", dt.datetime(2025, 1, 1, 0, 15), "eolien", 12345678.5, None),
                                ("84", "A", dt.datetime(2025, 1, 1, 0, 30), "gaz", 0.12345, 0.05)],
                               "code_insee string, nom_region string, horodatage timestamp_ntz, "
                               "source_name string, valeur_mw double, facteur_charge double")
    out = sinks.export_fr_csv(df, os.path.join(tmp_dir, "x"), order=[("horodatage", False), "code_insee"],
                              max_rows=1000)
    part = glob.glob(os.path.join(out, "part-*"))[0]
    data = open(part, "rb").read()
    assert data.startswith(b"\xef\xbb\xbf") and b"\r\n" in data
    text = data.decode("utf-8-sig").split("\r\n")
    assert text[0] == "Code INSEE;Région;Horodatage;Source;Valeur (MW);Facteur de charge"
    assert text[1] == "84;A;2025-01-01 00:30:00;gaz;0,1235;0,05"  # newest first; 0.12345 -> 4 dp (half-up)
    assert text[2] == "11;Île;2025-01-01 00:15:00;eolien;12345678,5;"
    # without a cap the export is written in parallel: every part is a complete CSV
    many = sinks.export_fr_csv(df.repartition(2), os.path.join(tmp_dir, "y"))
    for f in glob.glob(os.path.join(many, "part-*")):
        assert open(f, "rb").read().startswith(b"\xef\xbb\xbfCode INSEE;")


def test_profile_schema(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "x int, y string")
    p = {r.column_name: r for r in profile_schema(df).collect()}
    assert p["x"].null_count == 1 and p["y"].sample_value == "a" and p["x"].total_rows == 2


def test_sinks_layouts(spark, tmp_dir):
    df = spark.createDataFrame([("11", dt.datetime(2025, 2, 3, 4, 0), 1.0), ("11", None, 2.0)],
                               "code string, date_heure timestamp_ntz, v double")
    root = os.path.join(tmp_dir, "silver")
    sinks.write_silver_daily(df.where("date_heure is not null"), root)
    assert os.path.isdir(os.path.join(root, "year=2025", "month=02", "day=03"))
    mroot = os.path.join(tmp_dir, "monthly")
    sinks.write_silver_monthly(df, mroot, "date_heure", quarantine=os.path.join(tmp_dir, "qq"))
    assert spark.read.parquet(os.path.join(tmp_dir, "qq")).count() == 1
    e = sinks.audit_entry(spark, "j1", "rte", "success", 10, NOWTS, details={"k": 1})
    assert sinks.audit_append(e, os.path.join(tmp_dir, "audit"))
    rep = sinks.audit_report(spark.read.parquet(os.path.join(tmp_dir, "audit"))).first()
    assert rep.runs == 1 and rep.records == 10
    st = spark.createDataFrame([("a.csv", "PASS", None, 4), ("b.csv", "FAIL", "empty file", 0)],
                               "file string, status string, error string, rows long")
    assert sinks.audit_append(sinks.audit_from_status(st, "cap", NOWTS), os.path.join(tmp_dir, "audit2"))
    rep2 = {r.status: r for r in sinks.audit_report(spark.read.parquet(os.path.join(tmp_dir, "audit2"))).collect()}
    assert rep2["success"].records == 4 and rep2["failure"].runs == 1 and rep2["failure"].records == 0
    aud = os.path.join(tmp_dir, "audit3")
    assert sinks.write_audited(df, os.path.join(tmp_dir, "w1"), aud, "j3", "rte", NOWTS)
    blocker = os.path.join(tmp_dir, "not_a_dir")
    open(blocker, "w").close()
    assert not sinks.write_audited(df, os.path.join(blocker, "x"), aud, "j4", "rte", NOWTS)
    rep3 = {r.job_id: r for r in spark.read.parquet(aud).collect()}
    assert rep3["j3"].status == "success" and rep3["j3"].record_count == 2
    assert rep3["j4"].status == "failure" and rep3["j4"].record_count is None and rep3["j4"].error_details
    _, run = sinks.stage_report(spark, [("bronze", "success", 5, None), ("gold", "failure", None, "x")])
    assert run.first().run_status == "partial"
    land = sinks.land_raw(df, os.path.join(tmp_dir, "bronze"), "rte", "regional", NOWTS, "job-1")
    assert spark.read.parquet(land).select("job_id").distinct().first()[0] == "job-1"
    clim = spark.createDataFrame([(dt.datetime(2025, 6, 15, 1), "11", 1.0), (dt.datetime(2025, 7, 1, 1), "84", 2.0)],
                                 "valid_time timestamp_ntz, region_code string, t double")
    croot = sinks.write_bronze_climate(clim, os.path.join(tmp_dir, "climate"))
    assert os.path.isdir(os.path.join(croot, "year=2025", "month=06", "region_code=11"))
    snap = sinks.snapshot_tables({"dim": df}, os.path.join(tmp_dir, "snap"), "2025-06-20")
    assert spark.read.parquet(snap["dim"]).where(F.col("snapshot_date") == "2025-06-20").count() == 2


def test_emission_factor_dim_and_lookup(spark, tmp_dir):
    from voltaic.operators.aggregates import emission_factor_dim
    from voltaic.operators.joins import factor_lookup
    p = os.path.join(tmp_dir, "ef.csv")
    with open(p, "w") as f:
        f.write("filiere,source_energie,facteur_emission_co2_kg_mwh,facteur_emission_ch4_kg_mwh,"
                "facteur_emission_n2o_kg_mwh,source,annee,date_mise_a_jour\n"
                "Thermique,Gaz,400,0.1,0.01,test,2022,2023-01-01\n"
                "Thermique,Gaz,420,0.1,0.01,test,2023,2024-01-01\n"
                "Renouvelable,Eolien,10,0,0,test,2023,2024-01-01\n")
    dim = emission_factor_dim(spark.read.option("header", True).csv(p))
    got = {r.source_name: (r.factor, r.annee) for r in dim.collect()}
    assert got == {"gaz": (420.0, 2023), "eolien": (10.0, 2023)}
    long = spark.createDataFrame([("gaz", 2.0), ("nucleaire", 1.0)], "source_name string, mw double")
    out = {r.source_name: r.factor for r in factor_lookup(long, "source_name", dim).collect()}
    assert out == {"gaz": 420.0, "nucleaire": 0.0}
    # a source listed under two sectors: one factor (the largest), no duplicated rows
    two = dim.unionByName(dim.where("source_name = 'gaz'").withColumn("filiere", F.lit("autre"))
                          .withColumn("factor", F.lit(500.0)))
    rows = factor_lookup(long, "source_name", two).collect()
    assert len(rows) == 2 and {r.source_name: r.factor for r in rows}["gaz"] == 500.0


def test_all_table_policies(spark):
    m = spark.createDataFrame([(1, "11", 1.0, 2.0, 3.0)], "id_date long, id_region string, t double, w double, c double")
    m2 = U.upsert_fact_meteo(m, spark.createDataFrame([(1, "11", 9.0, None, 3.0)], m.schema))
    assert tuple(m2.first()) == (1, "11", 9.0, None, 3.0)
    cap = spark.createDataFrame([("11", "eolien", 2024, 5.0)], "id_region string, id_source string, annee int, mw double")
    assert U.upsert_fact_capacity(cap, spark.createDataFrame([("11", "eolien", 2024, 7.0)], cap.schema)).first().mw == 7.0
    src = spark.createDataFrame([("eolien", False)], "source_name string, is_green boolean")
    assert U.upsert_dim_source(src, spark.createDataFrame([("eolien", True)], src.schema)).first().is_green is True
    mt = spark.createDataFrame([("E1", "u", 1.0)], "event_id string, unit_name string, unavailable_mw double")
    out = U.upsert_fact_maintenance(mt, spark.createDataFrame([("E1", "v", 2.0), ("E2", "w", 3.0)], mt.schema))
    assert sorted(tuple(r) for r in out.collect()) == [("E1", "v", 2.0), ("E2", "w", 3.0)]


def test_merge_with_batch_order_and_missing_columns(spark, tmp_dir):
    base = spark.createDataFrame([("11", 1.0, "a")], "k string, v double, note string")
    inc = spark.createDataFrame([("11", 2.0, 1), ("11", 3.0, 2), ("84", 4.0, 1)], "k string, v double, ord int")
    out = U.merge_frames(base, inc, ["k"], order=["ord"], keep_non_null=["note"])
    assert sorted(tuple(r) for r in out.collect()) == [("11", 3.0, "a"), ("84", 4.0, None)]
    path = os.path.join(tmp_dir, "p")
    first = spark.createDataFrame([("d1", "11", 1.0, 1)], "day string, k string, v double, ord int")
    U.upsert_table(spark, path, first, ["day", "k"], partition_by=["day"], order=["ord"])
    U.upsert_table(spark, path, inc.withColumn("day", F.lit("d1")), ["day", "k"], partition_by=["day"], order=["ord"])
    table = spark.read.parquet(path)
    assert "ord" not in table.columns
    assert sorted((r.k, r.v) for r in table.collect()) == [("11", 3.0), ("84", 4.0)]


def test_extractor_runs_where_workers_lack_the_package(tmp_dir):
    """The page parser runs in Python workers: it must work when only the driver can import the package
    (cluster workers, or a driver started outside the repository)."""
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = os.path.join(tmp_dir, "run.py")
    with open(script, "w") as f:
        f.write(f"""import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from voltaic.sources import html_events
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
pages = spark.createDataFrame([(1, "u", {PAGE!r})], "page_id long, url string, html string")
print("EVENTS", sorted(r.event_id for r in html_events.extract_events_html(pages).collect()))
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, script], cwd=tmp_dir, env=env, capture_output=True, text=True,
                         timeout=300)
    assert "EVENTS ['EVT-1', 'EVT-2']" in out.stdout, out.stderr[-2000:]
