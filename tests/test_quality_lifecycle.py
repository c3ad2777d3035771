import datetime as dt

import pytest

from voltaic.constants import DEFAULT_GATES
from voltaic.operators import quality as Q
from voltaic.operators.lifecycle import changed_regions, lifecycle_summary, mark_status
from voltaic.operators.upsert import upsert_region_seen

NOW = "2025-06-20 12:00:00"


@pytest.mark.parametrize("actual,expected,status", [(98, 100, "PASS"), (90, 100, "WARN"), (50, 100, "FAIL"),
                                                    (0, 0, "PASS"), (3, 0, "WARN")])
def test_row_count(spark, actual, expected, status):
    df = spark.range(actual)
    assert Q.row_count_check(df, expected).first().status == status


def test_null_and_range(spark):
    df = spark.createDataFrame([(1, 5.0), (None, 200.0)], "a int, b double")
    assert Q.null_check(df, ["a"]).first().status == "FAIL"
    assert Q.null_check(df, ["b"]).first().status == "PASS"
    miss = Q.null_check(df, ["zz"]).first()
    assert miss.status == "FAIL" and '"zz":-1' in miss.details
    assert Q.range_check(df, "b", 0, 100).first().status == "FAIL"
    assert Q.range_check(df, "b", 0, 1000).first().status == "PASS"


def test_freshness(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 6, 20, 0, 0),)], "ts timestamp_ntz")
    assert Q.freshness_check(df, "ts", 24, NOW).first().status == "PASS"
    assert Q.freshness_check(df, "ts", 8, NOW).first().status == "WARN"
    assert Q.freshness_check(df, "ts", 4, NOW).first().status == "FAIL"
    assert Q.freshness_check(df.limit(0), "ts", 4, NOW).first().status == "FAIL"


def test_fk_integrity_null_is_not_orphan(spark):
    fact = spark.createDataFrame([(1,), (None,), (9,)], "fk int")
    dim = spark.createDataFrame([(1,)], "pk int")
    r = Q.fk_integrity(fact, {"fk": (dim, "pk")}).first()
    assert r.status == "FAIL" and '"fk":1' in r.details


def test_run_gates_and_summary(spark):
    silver = spark.createDataFrame([("11", dt.datetime(2025, 6, 20, 6), 500.0)],
                                   "code_insee_region string, date_heure timestamp_ntz, consommation_mw double")
    fact = spark.createDataFrame([("11", 1, "eolien", 2.0)],
                                 "id_region string, id_date int, id_source string, facteur_charge double")
    dims = {"DIM_REGION": (spark.createDataFrame([("11",)], "id_region string"), "id_region"),
            "DIM_TIME": (spark.createDataFrame([(1,)], "id_date int"), "id_date"),
            "DIM_SOURCE": (spark.createDataFrame([("gaz",)], "id_source string"), "id_source")}
    gates = DEFAULT_GATES + [{"name": "bad", "table": "rte_production", "check": "nope", "severity": "CRITICAL"},
                             {"name": "gone", "table": "missing", "check": "null_check", "columns": ["x"]}]
    res = {r.name: r.status for r in Q.run_gates(gates, {"rte_production": silver, "FACT_ENERGY_FLOW": fact},
                                                 NOW, dims).collect()}
    assert res == {"silver_rte_null_check": "PASS", "silver_rte_mw_range": "PASS", "silver_rte_freshness": "PASS",
                   "gold_fk_integrity": "FAIL", "gold_facteur_charge_range": "FAIL", "bad": "FAIL", "gone": "FAIL"}
    s = Q.gate_summary(Q.run_gates(gates, {"rte_production": silver, "FACT_ENERGY_FLOW": fact}, NOW, dims)).first()
    assert (s.total, s.passed, s.failed, s.halt) == (7, 3, 4, True)


def dim(spark, rows):
    return spark.createDataFrame(rows, "code_insee string, nom_region string, status string, "
                                       "first_seen_at timestamp_ntz, last_seen_at timestamp_ntz")


def test_staleness_and_inactivity(spark):
    now = dt.datetime(2025, 6, 20, 12)
    d = dim(spark, [("11", "a", "active", now, now - dt.timedelta(hours=48)),
                    ("84", "b", "stale", now, now - dt.timedelta(hours=240)),
                    ("24", "c", "active", now, now - dt.timedelta(hours=1)),
                    ("27", "d", "active", now, now - dt.timedelta(hours=24))])  # exactly 24 h: not stale (strict)
    got = {r.code_insee: r.status for r in mark_status(d, NOW).collect()}
    assert got == {"11": "stale", "84": "inactive", "24": "active", "27": "active"}
    summ = {r.status: r.changed for r in lifecycle_summary(mark_status(d, NOW)).collect()}
    assert summ == {"stale": 1, "inactive": 1}
    assert {(r.status, r.code) for r in changed_regions(mark_status(d, NOW)).collect()} == {("stale", "11"), ("inactive", "84")}


def test_lifecycle_thresholds_come_from_the_environment(spark, monkeypatch):
    now = dt.datetime(2025, 6, 20, 12)
    d = dim(spark, [("11", "a", "active", now, now - dt.timedelta(hours=5))])
    monkeypatch.setenv("STALENESS_THRESHOLD_HOURS", "4")
    assert mark_status(d, NOW).first().status == "stale"
    monkeypatch.setenv("STALENESS_THRESHOLD_HOURS", "x")
    assert mark_status(d, NOW).first().status == "active"


def test_reactivation_keeps_first_seen(spark):
    first = dt.datetime(2025, 1, 1)
    d = dim(spark, [("11", "a", "inactive", first, dt.datetime(2025, 2, 1)), ("84", "b", "active", first, first)])
    seen = spark.createDataFrame([("11", "A"), ("93", "P")], "code_insee string, nom_region string")
    out = {r.code_insee: r for r in upsert_region_seen(d, seen, NOW).collect()}
    assert out["11"].status == "active" and out["11"].first_seen_at == first
    assert out["11"].last_seen_at == dt.datetime(2025, 6, 20, 12) and out["11"].nom_region == "A"
    assert out["93"].status == "active" and out["84"].status == "active" and len(out) == 3
