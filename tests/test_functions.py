import datetime as dt

from pyspark.sql import functions as F

from voltaic.functions.calendar import calendar_parts
from voltaic.functions.columns import (
    canonical_region_code, clean_text, js_round, kelvin_to_celsius, kw_to_mw, parse_mw, parse_utc,
    safe_double, wind_speed,
)
from voltaic.functions.maps import any_nonzero, carbon_band, map_total_positive, positive_only


def one(spark, expr, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr).collect()]


def test_safe_double_mixed_text(spark):
    got = one(spark, safe_double("x"), [(" 12.5 ",), ("0",), ("abc",), (None,), ("NaN",)], "x string")
    assert got == [12.5, 0.0, None, None, None]


def test_parse_utc_offset(spark):
    got = one(spark, parse_utc("x").cast("timestamp_ntz"),
              [("2025-02-20T10:30:00+01:00",), ("garbage",)], "x string")
    assert got == [dt.datetime(2025, 2, 20, 9, 30), None]


def test_clean_text_unicode_whitespace(spark):
    got = one(spark, clean_text("x"), [("  a  b\t\nc  ",), ("x  y",)], "x string")
    assert got == ["a b c", "x y"]


def test_parse_mw(spark):
    got = one(spark, parse_mw("x"), [(" 910,5 ",), ("1 300",), ("n/a",), ("",)], "x string")
    assert got == [910.5, 1300.0, 0.0, 0.0]


def test_region_code_and_kw(spark):
    got = one(spark, canonical_region_code("x"), [("11.0",), ("84",), ("0",), ("",), ("xx",)], "x string")
    assert got == ["11", "84", None, None, None]
    assert one(spark, kw_to_mw("x"), [("1500,5",), ("bad",)], "x string") == [1.5005, None]


def test_rounding_rules(spark):
    # dashboard rounding is half toward +infinity, not half away from zero
    assert one(spark, js_round("x"), [(-2.5,), (2.5,), (0.49,)], "x double") == [-2.0, 3.0, 0.0]
    # Kelvin conversion is half-even on the decimal value
    assert one(spark, kelvin_to_celsius("x"), [(273.155,), (300.0,)], "x double") == [0.0, 26.85]
    assert one(spark, wind_speed("u", "v"), [(3.0, 4.0)], "u double, v double") == [5.0]


def test_calendar_weekend(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 6, 15, 10, 30),), (dt.datetime(2025, 6, 16, 0, 0),)],
                               "ts timestamp_ntz")
    rows = calendar_parts(df, "ts").orderBy("ts").collect()
    assert rows[0]["est_weekend"] is True and rows[0]["jour_semaine"] == 7 and rows[0]["minute"] == 30
    assert rows[1]["est_weekend"] is False and rows[1]["jour_semaine"] == 1


def test_map_helpers(spark):
    df = spark.createDataFrame([({"a": 1.0, "b": -2.0, "c": 0.0},), ({"a": 0.0},), ({"a": None},)],
                               "m map<string,double>")
    r = df.select(map_total_positive("m").alias("t"), any_nonzero("m").alias("k"),
                  F.size(positive_only("m")).alias("n")).collect()
    assert [x["t"] for x in r] == [1.0, 0.0, 0.0]
    assert [x["k"] for x in r] == [True, False, True]
    assert [x["n"] for x in r] == [1, 0, 0]
    assert one(spark, carbon_band("x"), [(99.0,), (100.0,), (399.0,), (400.0,)], "x double") == \
        ["very_low", "low", "medium", "high"]


def test_normalize_names_and_collation(spark):
    from voltaic.functions.columns import normalize_name
    assert normalize_name("Code Région") == "code_région"
    assert normalize_name(" Puissance installée (MW) ", fold_accents=True) == "puissance_installee_mw"
    assert normalize_name("Filière-Énergie", fold_accents=True) == "filiere_energie"
    from voltaic.operators.aggregates import region_directory
    rec = spark.createDataFrame([("76", "Occitanie", 1), ("11", "Île-de-France", 1), ("53", "Bretagne", 1)],
                                "code_insee string, region string, timestamp int")
    assert [r.region for r in region_directory(rec).collect()] == ["Bretagne", "Île-de-France", "Occitanie"]


def test_silver_column_steps(spark):
    from voltaic.plans.silver import drop_artifacts, readings_columns, rename_columns, safe_numeric
    raw = spark.createDataFrame([("11", "2025-02-20T10:30:00+01:00", "0", " 12 ", None, 495.0)],
                                "code_insee_region string, date_heure string, pompage string, eolien string, "
                                "column_68 string, consommation double")
    assert "column_68" not in drop_artifacts(raw).columns
    typed = safe_numeric(raw)
    assert dict(typed.dtypes)["pompage"] == "double" and typed.first().eolien == 12.0
    assert {"pompage_mw", "eolien_mw", "consommation_mw"} <= set(rename_columns(typed).columns)
    r = readings_columns(raw).first()
    assert r.date_heure == dt.datetime(2025, 2, 20, 9, 30) and r.pompage_mw == 0.0
