"""Data-quality checks and gates (Q01-Q08).

Each check is a lazy one-row DataFrame with columns
(name, check_type, status, severity, details) where ``details`` is JSON text.
``run_gates`` folds all checks of one table into a single aggregation pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaic.constants import LOAD_FACTOR_MAX, ROW_COUNT_TOLERANCE_PCT

PASS, WARN, FAIL = "PASS", "WARN", "FAIL"
RESULT_COLS = ["name", "check_type", "status", "severity", "details"]


def _result(name: str, check_type: str, status: Column, severity: str | None, details: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(check_type).alias("check_type"),
                    status.alias("status"), F.lit(severity).cast("string").alias("severity"),
                    F.to_json(details).alias("details"))


# Every check returns (aggregate expressions, finisher(row columns) -> result struct).

def _null_check(df: DataFrame, name: str, columns: Sequence[str], severity=None):
    present = [c for c in columns if c in df.columns]
    aggs = [F.count_if(F.col(c).isNull()).alias(f"{name}__{c}") for c in present]

    def finish():
        counts = [F.col(f"{name}__{c}") if c in present else F.lit(-1).cast("long") for c in columns]
        nulls = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*counts))
        bad = F.lit(False)
        for c in counts:
            bad = bad | (c != 0)
        return _result(name, "null_check", F.when(bad, FAIL).otherwise(PASS), severity,
                       F.struct(nulls.alias("null_counts")))
    return aggs, finish


def _range_check(df: DataFrame, name: str, column: str, lo: float, hi: float, severity=None,
                 check_type: str = "range_check"):
    if column not in df.columns:
        return [], lambda: _result(name, check_type, F.lit(FAIL), severity,
                                   F.struct(F.lit(f"column {column} missing").alias("error")))
    c = F.col(column)
    aggs = [F.count_if(c.isNotNull() & ~F.isnan(c.cast("double")) & ((c < lo) | (c > hi)))
            .alias(f"{name}__out")]

    def finish():
        n = F.col(f"{name}__out")
        return _result(name, check_type, F.when(n > 0, FAIL).otherwise(PASS), severity,
                       F.struct(n.alias("out_of_range"), F.lit(lo).alias("min"), F.lit(hi).alias("max")))
    return aggs, finish


def row_count_status(actual: Column, expected: Column, tol_pct: float = ROW_COUNT_TOLERANCE_PCT) -> Column:
    """Q03 rule: |a-e|/e <= tol PASS, <= 2 tol WARN, else FAIL; e = 0 -> PASS iff a = 0 else WARN."""
    diff = F.abs(actual - expected) / expected * 100
    return (F.when(expected == 0, F.when(actual == 0, PASS).otherwise(WARN))
             .when(diff <= tol_pct, PASS).when(diff <= 2 * tol_pct, WARN).otherwise(FAIL))


def _freshness(df: DataFrame, name: str, ts: str, max_age_hours: float, ref: str, severity=None):
    if ts not in df.columns:
        return [], lambda: _result(name, "freshness", F.lit(FAIL), severity,
                                   F.struct(F.lit(f"column {ts} missing").alias("error")))
    aggs = [F.max(F.col(ts).cast("timestamp")).alias(f"{name}__max")]

    def finish():
        mx = F.col(f"{name}__max")
        ref_ts = F.lit(ref).cast("timestamp")
        age_h = (F.unix_micros(ref_ts) - F.unix_micros(mx)) / F.lit(3.6e9)
        status = (F.when(mx.isNull(), FAIL).when(age_h <= max_age_hours, PASS)
                   .when(age_h <= 2 * max_age_hours, WARN).otherwise(FAIL))
        return _result(name, "freshness", status, severity,
                       F.struct(F.round(age_h, 2).alias("age_hours"),
                                F.lit(max_age_hours).alias("max_age_hours")))
    return aggs, finish


def _load_factor(df: DataFrame, name: str, column: str = "facteur_charge",
                 lo: float = 0.0, hi: float = LOAD_FACTOR_MAX, severity=None):
    return _range_check(df, name, column, lo, hi, severity, "facteur_charge_range") if column in df.columns else \
        ([], lambda: _result(name, "facteur_charge_range", F.lit(FAIL), severity,
                             F.struct(F.lit(f"column {column} missing").alias("error"))))


def _single(df: DataFrame, spec) -> DataFrame:
    aggs, finish = spec
    base = df.agg(*aggs) if aggs else df.sparkSession.range(1)
    return base.select(finish().alias("r")).select("r.*")


def null_check(df: DataFrame, columns: Sequence[str], name: str = "null_check", severity=None) -> DataFrame:
    """Q01: FAIL if any listed column has a NULL; a missing column counts -1 and FAILs."""
    return _single(df, _null_check(df, name, columns, severity))


def range_check(df: DataFrame, column: str, lo: float, hi: float, name: str = "range_check",
                severity=None) -> DataFrame:
    """Q02: FAIL if any non-NULL value is outside [lo, hi]; missing column FAILs."""
    return _single(df, _range_check(df, name, column, lo, hi, severity))


def row_count_check(actual: DataFrame, expected: int | DataFrame, tol_pct: float = ROW_COUNT_TOLERANCE_PCT,
                    name: str = "row_count", severity=None) -> DataFrame:
    """Q03: relative row-count difference against an expected count (or frame)."""
    a = actual.agg(F.count(F.lit(1)).alias("a"))
    if isinstance(expected, DataFrame):
        e = expected.agg(F.count(F.lit(1)).alias("e"))
        both = a.unionByName(e, allowMissingColumns=True).agg(F.max("a").alias("a"), F.max("e").alias("e"))
    else:
        both = a.withColumn("e", F.lit(int(expected)).cast("long"))
    st = row_count_status(F.col("a"), F.col("e"), tol_pct)
    return both.select(_result(name, "row_count", st, severity,
                               F.struct(F.col("a").alias("actual"), F.col("e").alias("expected"))).alias("r")) \
        .select("r.*")


def freshness_check(df: DataFrame, ts: str, max_age_hours: float, ref: str,
                    name: str = "freshness", severity=None) -> DataFrame:
    """Q04: age of the newest timestamp against an explicit reference time."""
    return _single(df, _freshness(df, name, ts, max_age_hours, ref, severity))


def fk_integrity(fact: DataFrame, fk_map: Mapping[str, tuple[DataFrame, str]],
                 name: str = "fk_integrity", severity=None) -> DataFrame:
    """Q05: orphan count per foreign key; any orphan FAILs.

    One pass over the fact: each (distinct) dimension key set is left-joined
    on its foreign key (dimension-sized sides, broadcast by the planner) and
    all orphan counts come from a single aggregation. A NULL foreign key is
    not an orphan (``NOT IN`` semantics over a NULL-free key set).
    """
    j = fact.select(*fk_map)
    counts = []
    for i, (fk, (dim, pk)) in enumerate(fk_map.items()):
        keys = dim.select(F.col(pk).alias(f"_pk{i}")).where(F.col(f"_pk{i}").isNotNull()).distinct() \
                  .withColumn(f"_hit{i}", F.lit(True))
        j = j.join(keys, F.col(fk) == F.col(f"_pk{i}"), "left")
        counts.append(F.struct(F.lit(fk).alias("fk"),
                               F.count_if(F.col(fk).isNotNull() & F.col(f"_hit{i}").isNull()).alias("n")))
    agg = j.agg(F.array(*counts).alias("_c")).select(
        F.map_from_entries(F.array_sort("_c")).alias("orphans"),
        F.aggregate("_c", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("total"))
    return agg.select(_result(name, "fk_integrity", F.when(F.col("total") > 0, FAIL).otherwise(PASS),
                              severity, F.struct(F.col("orphans"))).alias("r")).select("r.*")


def load_factor_range(fact: DataFrame, column: str = "facteur_charge", name: str = "facteur_charge_range",
                      severity=None) -> DataFrame:
    """Q06: FAIL if a non-NULL load factor is outside 0..1.5."""
    return _single(fact, _load_factor(fact, name, column, severity=severity))


_CHECKS = {
    "null_check": lambda df, g, ref: _null_check(df, g["name"], g.get("columns", []), g.get("severity")),
    "range_check": lambda df, g, ref: _range_check(df, g["name"], g["column"], g["min"], g["max"],
                                                   g.get("severity")),
    "freshness": lambda df, g, ref: _freshness(df, g["name"], g["time_column"], g["max_age_hours"], ref,
                                               g.get("severity")),
    "facteur_charge_range": lambda df, g, ref: _load_factor(df, g["name"], g.get("column", "facteur_charge"),
                                                            severity=g.get("severity")),
}


def run_gates(config: Sequence[Mapping] | Mapping, tables: Mapping[str, DataFrame], ref: str,
              dims: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Q07: evaluate a gate list against named tables.

    Checks on one table share one aggregation pass. ``fk_exists`` gates use
    anti-joins against ``dims``. Unknown check or missing table -> FAIL.
    """
    gates = config["gates"] if isinstance(config, Mapping) else list(config)
    spark = next(iter(tables.values())).sparkSession
    by_table: dict[str, list] = {}
    outs: list[DataFrame] = []
    static: list = []
    for g in gates:
        t, chk = g.get("table"), g.get("check")
        if t not in tables:
            static.append((g["name"], chk, FAIL, g.get("severity"), f'{{"error":"table {t} missing"}}'))
        elif chk == "fk_exists":
            dims = dims or {}
            fk_map = {}
            missing = [d for d in g["fk_columns"].values() if d not in dims]
            if missing:
                static.append((g["name"], chk, FAIL, g.get("severity"), '{"error":"dimension missing"}'))
                continue
            for fk, d in g["fk_columns"].items():
                dim_df, pk = dims[d] if isinstance(dims[d], tuple) else (dims[d], fk)
                fk_map[fk] = (dim_df, pk)
            outs.append(fk_integrity(tables[t], fk_map, g["name"], g.get("severity"))
                        .withColumn("check_type", F.lit("fk_exists")))
        elif chk in _CHECKS:
            by_table.setdefault(t, []).append(_CHECKS[chk](tables[t], g, ref))
        else:
            static.append((g["name"], chk, FAIL, g.get("severity"), f'{{"error":"unknown check {chk}"}}'))
    for t, specs in by_table.items():
        aggs = [a for s in specs for a in s[0]]
        base = tables[t].agg(*aggs) if aggs else spark.range(1)
        outs.append(base.select(F.inline(F.array(*[s[1]() for s in specs]))))
    if static:
        outs.append(spark.createDataFrame(static, "name string, check_type string, status string, "
                                                  "severity string, details string"))
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res.select(*RESULT_COLS)


def gate_summary(results: DataFrame) -> DataFrame:
    """Q08: pass / warn / fail counts and the halt flag (a CRITICAL gate failed)."""
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == PASS).alias("passed"),
        F.count_if(F.col("status") == WARN).alias("warned"),
        F.count_if(F.col("status") == FAIL).alias("failed"),
        F.coalesce(F.bool_or((F.col("status") == FAIL) & (F.col("severity") == "CRITICAL")),
                   F.lit(False)).alias("halt"))
