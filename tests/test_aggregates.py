import datetime as dt

import pytest
from pyspark.sql import functions as F

from voltaic.operators import aggregates as A
from voltaic.operators.windows import balance_run_start, balance_runs, top_n_per_group

T0 = dt.datetime(2025, 2, 20, 10, 0)


def series(spark, rows):
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, sources map<string,double>, consommation_mw double")


# carbon intensity golden values of the dashboard gauge
@pytest.mark.parametrize("sources,expected", [
    ({}, 0.0), ({"nucleaire": 0.0, "eolien": -5.0}, 0.0), ({"nucleaire": 500.0}, 12.0),
    ({"charbon": 1000.0}, 820.0), ({"nucleaire": 500.0, "gaz": 500.0}, 251.0),
    ({"nucleaire": 100.0, "unknown": 100.0}, 6.0),
])
def test_carbon_intensity_golden(spark, sources, expected):
    df = series(spark, [(T0, sources, None)])
    assert A.carbon_intensity(df).first().intensity == expected


def long_rows(spark, rows):
    return spark.createDataFrame(rows, "code_insee string, nom_region string, horodatage timestamp_ntz, "
                                       "source_name string, valeur_mw double, facteur_charge double, "
                                       "consommation_mw double")


def test_records_pivot_zero_filter_and_consumption(spark):
    t1, t2, t3 = T0, T0 + dt.timedelta(minutes=15), T0 + dt.timedelta(minutes=30)
    rows = []
    for t in (t1, t2, t3):
        rows.append(("11", "Ile-de-France", t, "nucleaire", 450.0, 450 / 5000, round(450 * 1.1, 2)))
        rows.append(("84", "Auvergne", t, "nucleaire", 280.0, 280 / 5000, None))
    rows.append(("24", "Centre", t1, "eolien", 0.0, 0.0, 10.0))      # all zero -> dropped
    rows.append(("27", "Bourgogne", t1, "eolien", None, None, 10.0))  # NULL counts as non-zero -> kept
    rec = A.production_records(long_rows(spark, rows))
    by = {(r.code_insee, r.timestamp): r for r in rec.collect()}
    assert ("24", t1) not in by and ("27", t1) in by
    assert by[("11", t1)].consommation_mw == 495.0 and by[("84", t1)].consommation_mw is None
    assert by[("11", t2)].sources == {"nucleaire": 450.0}
    assert abs(by[("11", t1)].facteur_charge - 0.09) < 1e-12
    assert rec.count() == 7


def test_national_sums_positive_and_null_consumption(spark):
    rec = spark.createDataFrame([
        ("11", "a", T0, {"eolien": 10.0, "pompage": -3.0}, None, 5.0),
        ("84", "b", T0, {"eolien": 2.5}, None, None),
        ("24", "c", T0 + dt.timedelta(minutes=15), {"gaz": 1.0}, None, None)],
        "code_insee string, region string, timestamp timestamp_ntz, sources map<string,double>, "
        "facteur_charge double, consommation_mw double")
    nat = {r.timestamp: r for r in A.national_by_timestamp(rec).collect()}
    assert nat[T0].sources == {"eolien": 12.5} and nat[T0].consommation_mw == 5.0
    assert nat[T0 + dt.timedelta(minutes=15)].consommation_mw is None


def test_latest_balance_top_dominant(spark):
    rec = spark.createDataFrame([
        ("11", "a", T0, {"eolien": 10.0, "gaz": 30.0}, None, 20.0),
        ("11", "a", T0 + dt.timedelta(minutes=15), {"eolien": 50.0, "gaz": 30.0, "solaire": 50.0}, None, 100.0),
        ("84", "b", T0, {"eolien": 1.0}, None, None)],
        "code_insee string, region string, timestamp timestamp_ntz, sources map<string,double>, "
        "facteur_charge double, consommation_mw double")
    bal = {r.code_insee: r for r in A.region_balance(A.latest_by_region(rec)).collect()}
    assert bal["11"].total_mw == 130.0 and bal["11"].state == "surplus"
    assert bal["84"].state == "no_data"
    top = A.top_sources(rec, n=2).where("code_insee = '11'").orderBy("rank").collect()
    assert [(r.source, r.mw) for r in top] == [("eolien", 50.0), ("solaire", 50.0)]
    nat = A.national_by_timestamp(rec)
    dom = A.dominant_source(nat).first()
    assert dom.source == "eolien" and dom.mw == 50.0
    assert A.total_mw(nat).first().total_mw == 130.0


def test_capacity_register(spark):
    raw = spark.createDataFrame([
        ("11.0", "Ile", "Éolien terrestre", "1500,5", 1),
        ("11", "Île-de-France", "eolien en mer", "500", 2),
        ("11", "x", "Photovoltaïque", "abc", 3),       # bad kW: ignored by the sum
        ("0", "x", "Nucléaire", "100", 4),             # region 0 dropped
        ("84", "y", "Inconnue", "100", 5),             # unknown filière dropped
        ("84", "y", "Thermique gaz", "0", 6)],         # sum 0 dropped
        "code string, name string, filiere string, kw string, o int")
    out = A.capacity_by_region_source(raw, "code", "name", "filiere", "kw", ["o"], year=2024).collect()
    assert [(r.code_insee_region, r.source_name, r.puissance_installee_mw, r.libelle_region, r.annee)
            for r in out] == [("11", "eolien", 2.0, "Île-de-France", 2024)]


def test_load_factor(spark):
    long = spark.createDataFrame([("11", "eolien", 3200.0), ("84", "eolien", 100.0), ("11", "gaz", 5.0)],
                                 "id_region string, id_source string, valeur_mw double")
    cap = spark.createDataFrame([("11", "eolien", 10000.0), (None, "eolien", 1000.0), ("11", "gaz", 0.0)],
                                "id_region string, id_source string, puissance_installee_mw double")
    got = {(r.id_region, r.id_source): r.facteur_charge for r in A.load_factor(long, cap).collect()}
    assert got == {("11", "eolien"): 0.32, ("84", "eolien"): 0.1, ("11", "gaz"): None}
    # a register with several years: the latest year's capacity, one output row per fact row
    years = spark.createDataFrame([("11", "eolien", 2023, 8000.0), ("11", "eolien", 2024, 10000.0)],
                                  "id_region string, id_source string, annee int, puissance_installee_mw double")
    rows = A.load_factor(long, years).collect()
    assert len(rows) == 3 and {(r.id_region, r.id_source): r.facteur_charge for r in rows}[("11", "eolien")] == 0.32


def test_meteo_mean_null_policy(spark):
    m = spark.createDataFrame([(T0, 10.0, 1.0, 50.0), (T0, None, 2.0, 51.0)],
                              "timestamp timestamp_ntz, temperature_c double, wind_speed_10m double, "
                              "cloudcover_pct double")
    assert A.national_meteo(m).first().temperature_c == 10.0
    assert A.national_meteo(m, null_as_zero=True).first().temperature_c == 5.0
    assert A.national_meteo(m).first().cloudcover_pct == 51.0  # 50.5 rounds half up


def test_balance_runs_and_start(spark):
    rows = [(T0 + dt.timedelta(minutes=15 * i), {"x": p}, c) for i, (p, c) in enumerate(
        [(100.0, 100.0), (200.0, 100.0), (210.0, 100.0), (50.0, None), (300.0, 100.0), (320.0, 100.0)])]
    runs = {r.timestamp: r for r in balance_runs(series(spark, rows), bucket="hour").collect()}
    ts = sorted(runs)
    assert [runs[t].state for t in ts] == ["balanced", "surplus", "surplus", "no_data", "surplus", "surplus"]
    assert runs[ts[2]].run_start == ts[1]
    assert runs[ts[5]].run_start == ts[4]  # the missing consumption broke the run
    last = balance_run_start(series(spark, rows)).first()
    assert last.state == "surplus" and last.run_start == ts[4]


def test_top_n_per_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), ("b", 5)], "g string, v int")
    out = top_n_per_group(df, ["g"], [F.col("v").desc()], 2)
    assert sorted((r.g, r.v) for r in out.collect()) == [("a", 2), ("a", 3), ("b", 5)]


def test_source_universe_and_extent(spark):
    rec = spark.createDataFrame([("11", T0, {"b": 1.0, "a": 2.0}), ("84", T0, {"c": 1.0})],
                                "code_insee string, timestamp timestamp_ntz, sources map<string,double>")
    assert A.source_universe(rec).first().sources == ["a", "b", "c"]
    ext = A.time_extent(rec, "timestamp", "code_insee").first()
    assert ext.regions == 2 and ext.rows == 2
    assert sorted(r.region for r in A.regions_processed(rec, "code_insee").collect()) == ["11", "84"]


def test_thermal_source_kept(spark):
    from voltaic.plans.silver import transform_readings
    raw = spark.createDataFrame([("11", "2025-02-20T10:30:00+01:00", "120", "5", 1)],
                                "code_insee_region string, date_heure string, thermique string, eolien string, "
                                "load_ordinal int")
    sil, _ = transform_readings(raw)
    assert "thermique_mw_is_null" in sil.columns
    long = A.unpivot_sources(sil, ["code_insee_region", "date_heure"])
    assert sorted((r.source_name, r.valeur_mw) for r in long.collect()) == [("eolien", 5.0), ("thermique", 120.0)]
    assert A.unpivot_sources(sil, ["code_insee_region"], include_thermal=False).count() == 1
