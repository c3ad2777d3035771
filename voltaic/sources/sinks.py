"""Sinks: Bronze landing, Silver layouts, audit, snapshots, French CSV export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaic.constants import CSV_DECIMAL_SEP, CSV_DELIMITER, EXPORT_COLUMN_LABELS
from voltaic.session import small_batches

AUDIT_SCHEMA = ("job_id string, timestamp timestamp, source string, status string, record_count long, "
                "error_details string, details string")


def land_raw(df: DataFrame, root: str, source: str, sub_path: str, ts: str, job_id: str) -> str:
    """Append a raw batch under ``root/source/sub_path/ingest_date=YYYY-MM-DD`` with job id and time."""
    out = f"{root.rstrip('/')}/{source}/{sub_path}"
    (df.withColumn("job_id", F.lit(job_id))
       .withColumn("ingested_at", F.lit(ts).cast("timestamp"))
       .withColumn("ingest_date", F.to_date(F.lit(ts).cast("timestamp")))
       .write.mode("append").partitionBy("ingest_date").parquet(out))
    return out


def _write_payloads(folder: str, suffix: str):
    def run(batches):
        import re

        import pyarrow as pa
        from pyarrow import fs
        if folder.startswith("/") or folder.startswith("file:"):
            system, root = fs.LocalFileSystem(), re.sub(r"^file:/*", "/", folder)
        else:
            system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        n = 0
        for batch in batches:
            for name, text in zip(*batch.columns, strict=True):
                with system.open_output_stream(f"{root}/{name.as_py()}{suffix}") as f:
                    f.write((text.as_py() or "").encode())
            n += batch.num_rows
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])
    return run


def land_payloads(df: DataFrame, folder: str, suffix: str) -> int:
    """One file ``name + suffix`` per row (name, value) of ``df``, written by its tasks; returns the number of rows.

    Spark's own writer opens, checks, renames and commits every file apart, which for one small payload a file takes
    far longer than writing it. Names are the payloads' own, so a task that runs again writes the same files."""
    small_batches(df.sparkSession)
    landed = df.select("name", "value").mapInArrow(_write_payloads(folder, suffix), "n long")
    return landed.agg(F.sum("n")).first()[0] or 0


def _partition_cols(df: DataFrame, ts_col: str, parts: Sequence[str]) -> DataFrame:
    ts = F.col(ts_col)
    fmt = {"year": F.lpad(F.year(ts).cast("string"), 4, "0"),
           "month": F.lpad(F.month(ts).cast("string"), 2, "0"),
           "day": F.lpad(F.dayofmonth(ts).cast("string"), 2, "0")}
    return df.withColumns({p: fmt[p] for p in parts})


def write_silver_daily(df: DataFrame, root: str, ts_col: str = "date_heure") -> str:
    """Hive layout year=/month=/day= (zero-padded); only touched days are replaced.

    Rows are rebalanced on the partition columns: AQE keeps a day's rows in
    few files but splits a day that is too large for one task, so a hot day
    is written by several tasks.

    Without the time column the frame is written as a single unpartitioned table.
    """
    if ts_col not in df.columns:
        df.write.mode("overwrite").parquet(root)
        return root
    out = _partition_cols(df, ts_col, ["year", "month", "day"])
    (out.hint("rebalance", "year", "month", "day").sortWithinPartitions("year", "month", "day", ts_col)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "month", "day").parquet(root))
    return root


def write_silver_monthly(df: DataFrame, root: str, ts_col: str,
                         quarantine: str | None = None) -> str:
    """Hive layout year=/month=; rows without a time go to ``quarantine`` instead of vanishing."""
    good = df.where(F.col(ts_col).isNotNull())
    if quarantine is not None:
        df.where(F.col(ts_col).isNull()).write.mode("append").parquet(quarantine)
    out = _partition_cols(good, ts_col, ["year", "month"])
    (out.hint("rebalance", "year", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "month").parquet(root))
    return root


def write_bronze_climate(df: DataFrame, root: str, ts_col: str = "valid_time",
                         region_col: str = "region_code") -> str:
    """One file group per (year, month, region); rebalanced, so a large group is split over tasks."""
    out = _partition_cols(df, ts_col, ["year", "month"])
    (out.hint("rebalance", "year", "month", region_col).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("year", "month", region_col).parquet(root))
    return root


def audit_entry(spark: SparkSession, job_id: str, source: str, status: str, record_count: int | None,
                ts: str, error: str | None = None, details: Mapping | None = None) -> DataFrame:
    """One audit record as a DataFrame (``details`` kept as JSON text)."""
    import json
    return spark.createDataFrame(
        [(job_id, None, source, status, record_count, error, json.dumps(details) if details else None)],
        AUDIT_SCHEMA).withColumn("timestamp", F.lit(ts).cast("timestamp"))


def audit_from_status(status: DataFrame, source: str, ts: str) -> DataFrame:
    """One audit record per validated file (S04 status rows): success or failure, rows, reason."""
    return status.select(
        F.col("file").alias("job_id"), F.lit(ts).cast("timestamp").alias("timestamp"),
        F.lit(source).alias("source"),
        F.when(F.col("status") == "PASS", "success").otherwise("failure").alias("status"),
        F.col("rows").cast("long").alias("record_count"), F.col("error").alias("error_details"),
        F.lit(None).cast("string").alias("details"))


def audit_append(entry: DataFrame, path: str) -> bool:
    """Append to the audit table; a failure to persist never raises (returns False)."""
    try:
        entry.write.mode("append").parquet(path)
        return True
    except Exception:  # noqa: BLE001 - heartbeat must not break the job
        return False


def observed_write(df: DataFrame, write) -> int:
    """Run ``write(df')`` where ``df'`` counts its rows as it is written; returns that count.

    The count is an ``Observation`` collected by the write action itself (no
    second scan of the data).
    """
    from pyspark.sql import Observation
    obs = Observation()
    write(df.observe(obs, F.count(F.lit(1)).alias("rows")))
    return int(obs.get["rows"])


def write_audited(df: DataFrame, path: str, audit_path: str, job_id: str, source: str, ts: str,
                  partition_by: Sequence[str] = (), mode: str = "append") -> bool:
    """Write ``df`` and append one audit record for the write.

    The record count is an ``Observation`` collected by the write itself (no
    second scan). A failed write is audited as ``failure`` with its error text
    and reported by the return value; the audit append never raises.
    """
    def write(d: DataFrame) -> None:
        w = d.write.mode(mode)
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)

    try:
        rows = observed_write(df, write)
        entry = audit_entry(df.sparkSession, job_id, source, "success", rows, ts, details={"path": path})
        ok = True
    except Exception as e:  # noqa: BLE001 - the failure is what gets audited
        entry = audit_entry(df.sparkSession, job_id, source, "failure", None, ts, error=str(e),
                            details={"path": path})
        ok = False
    audit_append(entry, audit_path)
    return ok


def audit_report(audit: DataFrame) -> DataFrame:
    """Per source, runs by status and records ingested."""
    return audit.groupBy("source", "status").agg(F.count(F.lit(1)).alias("runs"),
                                                F.sum("record_count").alias("records"),
                                                F.max("timestamp").alias("last_run"))


def stage_report(spark: SparkSession, stages: Sequence[tuple[str, str, int | None, str | None]]
                 ) -> tuple[DataFrame, DataFrame]:
    """One row per pipeline stage (name, status, rows, error) and the run status.

    Bronze failure -> ``failure``; any later failure -> ``partial``; else ``success``.
    """
    df = spark.createDataFrame(list(stages), "stage string, status string, rows long, error string")
    failed = F.col("status") == "failure"
    run = df.agg(F.when(F.bool_or(failed & (F.col("stage") == "bronze")), "failure")
                  .when(F.bool_or(failed), "partial").otherwise("success").alias("run_status"))
    return df, run


def snapshot_tables(tables: Mapping[str, DataFrame], root: str, date: str) -> dict[str, str]:
    """Daily full snapshot of each table under ``root/<name>/snapshot_date=<date>``."""
    out = {}
    for name, df in tables.items():
        path = f"{root.rstrip('/')}/{name}"
        (df.withColumn("snapshot_date", F.lit(date).cast("date")).write.mode("overwrite")
           .option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path))
        out[name] = path
    return out


def fr_number(c) -> Column:
    """Python-style text of round(x, 4) with a decimal comma; NULL -> ''."""
    col = F.col(c) if isinstance(c, str) else c
    txt = F.round(col.cast("double"), 4).cast("decimal(38,4)").cast("string")
    txt = F.regexp_replace(txt, "0+$", "")
    txt = F.when(F.endswith(txt, F.lit(".")), F.concat(txt, F.lit("0"))).otherwise(txt)
    return F.coalesce(F.replace(txt, F.lit("."), F.lit(CSV_DECIMAL_SEP)), F.lit(""))


def _quoted(c: Column) -> Column:
    """A text cell as the CSV format has it: quoted if it holds the delimiter, a quote or a line end."""
    special = c.rlike(f'[{CSV_DELIMITER}"\\r\\n]')
    return F.when(special, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def _line_expr(df: DataFrame, cols: Sequence[str]) -> Column:
    cells = []
    types = dict(df.dtypes)
    for c in cols:
        t = types[c]
        if t in ("double", "float") or t.startswith("decimal"):
            cells.append(fr_number(c))
        elif t.startswith("timestamp"):
            cells.append(F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("")))
        else:
            cells.append(_quoted(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    return F.concat_ws(CSV_DELIMITER, *cells)


def fr_csv_lines(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """S14 row formatting: ';'-joined cells, floats as French decimals, timestamps as text."""
    return df.select(_line_expr(df, cols).alias("line"))


def export_fr_csv(df: DataFrame, path: str, cols: Sequence[str] | None = None,
                  labels: Mapping[str, str] = EXPORT_COLUMN_LABELS, max_rows: int | None = None,
                  order: Sequence = ()) -> str:
    """French-locale CSV (UTF-8 BOM, ';', decimal comma, CRLF, French header).

    Cells are formatted by Spark. ``order`` (names, or ``(name, ascending)``
    pairs) fixes the row order with a global, range-partitioned sort, so the
    part files are in order; each part file is a complete CSV with its own BOM
    and header (to join them, drop those of all but the first). With ``max_rows`` (an explicit, optional cap) the
    bounded result is written as one file, as the download endpoint does.
    """
    cols = list(cols or labels)
    spec = [(o, True) if isinstance(o, str) else (o[0], bool(o[1])) for o in order]
    sort_of = lambda c, asc: F.col(c).asc_nulls_first() if asc else F.col(c).desc_nulls_last()
    src = df.orderBy(*[sort_of(c, a) for c, a in spec]) if spec else df
    if max_rows is not None:
        src = src.limit(max_rows)
    types = dict(df.dtypes)
    out_names = [labels.get(c, c) for c in cols]
    out_names[0] = "\ufeff" + out_names[0]
    cells = []
    for c, name in zip(cols, out_names):
        t = types[c]
        if t in ("double", "float") or t.startswith("decimal"):
            v = fr_number(c)
        elif t.startswith("timestamp"):
            v = F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
        else:
            v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        cells.append(v.alias(name))
    out = src.select(*cells)
    if max_rows is not None:
        out = out.coalesce(1)
    (out.write.mode("overwrite").option("header", True).option("sep", CSV_DELIMITER)
        .option("lineSep", "\r\n").option("emptyValue", "").option("escape", '"').option("encoding", "UTF-8").csv(path))
    return path
