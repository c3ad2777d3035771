import datetime as dt

from voltaic.constants import ERA5_QUALITY_RULES, RTE_QUALITY_RULES
from voltaic.operators.dedup import daily_alert_dedup, dedup_keep_last, distinct_first_label
from voltaic.operators.nulls import apply_quality_rules, null_flag, null_forward_fill


def test_keep_last_three_to_two(spark):
    df = spark.createDataFrame([("11", "t1", 1.0, 1), ("11", "t1", 2.0, 2), ("84", "t1", 3.0, 3)],
                               "code string, ts string, mw double, ord int")
    out = {(r.code, r.mw) for r in dedup_keep_last(df, ["code", "ts"], ["ord"]).collect()}
    assert out == {("11", 2.0), ("84", 3.0)}


def test_keep_last_missing_key_is_noop(spark):
    df = spark.createDataFrame([("11", 1)], "code string, ord int")
    assert dedup_keep_last(df, ["code", "absent"], ["ord"]).count() == 1


def test_first_label_skips_blank(spark):
    df = spark.createDataFrame([("11", " ", 1), ("11", "Ile", 2), ("11", "Other", 3), ("84", None, 1)],
                               "c string, l string, o int")
    assert {(r.c, r.l) for r in distinct_first_label(df, "c", "l", ["o"]).collect()} == {("11", "Ile")}


def test_daily_alert_dedup(spark):
    rows = [(1, "11", "under_production", dt.datetime(2025, 1, 1, 8), 1),
            (1, "11", "under_production", dt.datetime(2025, 1, 1, 20), 2),
            (1, "11", "under_production", dt.datetime(2025, 1, 2, 8), 3),
            (1, "11", "over_production", dt.datetime(2025, 1, 1, 9), 4)]
    df = spark.createDataFrame(rows, "user_id int, region_code string, alert_type string, sent_at timestamp_ntz, id int")
    out = sorted(r.id for r in daily_alert_dedup(df, tie=["id"]).collect())
    assert out == [1, 3, 4]


def test_forward_fill_golden_and_leading_null(spark):
    base = dt.datetime(2025, 1, 31, 22)
    rows = [("r", base + dt.timedelta(hours=i), v) for i, v in enumerate([None, 10.0, None, None, 20.0])]
    rows += [("s", base, None), ("s", base + dt.timedelta(hours=5), 7.0)]
    df = spark.createDataFrame(rows, "e string, ts timestamp_ntz, t double")
    out = null_forward_fill(df, ["t"], ["e"], "ts", bucket="day")
    r = [x.t for x in out.where("e = 'r'").orderBy("ts").collect()]
    assert r == [None, 10.0, 10.0, 10.0, 20.0]  # crosses the day (and month) boundary
    s = [x.t for x in out.where("e = 's'").orderBy("ts").collect()]
    assert s == [None, 7.0]


def test_flags_always_present(spark):
    df = spark.createDataFrame([("11", 1.0)], "code_insee_region string, eolien_mw double")
    assert "eolien_mw_is_null" in null_flag(df, ["eolien_mw"]).columns


def test_rules_and_metrics(spark):
    rows = [("11", "2025-01-01", None, 5.0), (None, "2025-01-01", 1.0, 1.0), ("11", None, 2.0, None),
            ("84", "2025-01-02", 3.0, None)]
    df = spark.createDataFrame(rows, "code_insee_region string, date_heure string, eolien_mw double, "
                                     "consommation_mw double")
    out, m = apply_quality_rules(df, RTE_QUALITY_RULES, "rte")
    assert out.count() == 2
    mr = m.first()
    assert mr.input_rows == 4 and mr.rows_dropped == 2 and mr.output_rows == 2
    assert mr.values_flagged == 2  # eolien NULL in row 1, consommation NULL in row 4
    assert mr.nulls_found == {"code_insee_region": 1, "date_heure": 1, "eolien_mw": 1, "consommation_mw": 2}


def test_climate_rules_count_real_fills(spark):
    base = dt.datetime(2025, 6, 15)
    rows = [("r", base, None, None, 1.0), ("r", base + dt.timedelta(hours=1), 5.0, 2.0, None),
            ("r", base + dt.timedelta(hours=2), None, None, 3.0)]
    df = spark.createDataFrame(rows, "region_code string, valid_time timestamp_ntz, wind_speed_100m double, "
                                     "temperature_c double, ssrd double")
    out, m = apply_quality_rules(df, ERA5_QUALITY_RULES, "era5", entity=["region_code"], order="valid_time")
    temps = [r.temperature_c for r in out.orderBy("valid_time").collect()]
    assert temps == [None, 2.0, 2.0]
    # 2 wind + 1 ssrd zero-filled, 1 temperature really forward-filled (the leading NULL stays)
    assert m.first().values_filled == 4
