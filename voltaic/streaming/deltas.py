"""Tables that streams upsert: changed keys per batch, merged by tiers.

A batch writes only the keys it holds, as ``v=<batch>-<batch>``. When the last
``fanout`` versions are of one tier they are merged into one, ``v=<first>-<last>``,
so a row is rewritten once per tier and what a batch writes follows the batch,
not the table. Versions and their ranges are read from the directory listing
(finished ones only, by their ``_SUCCESS`` file); a version inside the range of
a wider one is out of date and is removed by the next batch. A replayed batch
rewrites its own version.

``read_deltas`` merges on the key: the newest version's row wins, but for
columns with a policy of their own (largest, smallest, newest that is not NULL),
which are commutative, so no batch has to read the table. Keys and policies lie
beside the versions, in ``_table``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT = 8


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm  # noqa: SLF001 - Hadoop FileSystem: listing and removal
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001


def versions(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(first, last batch) of every finished version, in order; wider ones first where they begin together."""
    jvm, fs = _filesystem(spark, path)
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/_SUCCESS")) or []
    names = [re.search(r"v=(\d+)-(\d+)$", st.getPath().getParent().toString()) for st in found]
    return sorted(((int(m[1]), int(m[2])) for m in names if m), key=lambda v: (v[0], -v[1]))


def _live(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The versions that no other one covers."""
    live: list[tuple[int, int]] = []
    for lo, hi in found:
        if not live or hi > live[-1][1]:
            live.append((lo, hi))
    return live


def _directory(path: str, version: tuple[int, int]) -> str:
    return f"{path}/v={version[0]}-{version[1]}"


def _merged(spark: SparkSession, path: str, some: list[tuple[int, int]], spec: dict) -> DataFrame:
    schema = spark.read.parquet(_directory(path, some[-1])).schema
    if len(some) == 1:
        return spark.read.schema(schema).parquet(_directory(path, some[0]))
    parts = [spark.read.schema(schema).parquet(_directory(path, v)).withColumn("_v", F.lit(v[1])) for v in some]
    rows = reduce(DataFrame.unionByName, parts)
    own = {c: how for how in ("greatest", "least", "keep_non_null") for c in spec[how]}
    plain = [c for c in schema.names if c not in spec["keys"] and c not in own]
    how = {"greatest": F.max, "least": F.min, "keep_non_null": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_v")))}
    newest = [F.max_by(F.struct(*plain), "_v").alias("_row")] if plain else []
    merged = rows.groupBy(*spec["keys"]).agg(F.max("_v").alias("_last"), *newest, *[how[k](c).alias(c) for c, k in own.items()])
    return merged.select(*[F.col(f"_row.{c}") if c in plain else F.col(c) for c in schema.names])


def read_deltas(spark: SparkSession, path: str) -> DataFrame:
    """The table as of the last finished batch, one row per key."""
    spec = json.loads(spark.read.text(f"{path}/_table").first()[0])
    return _merged(spark, path, _live(versions(spark, path)), spec)


def write_delta(batch: DataFrame, batch_id: int, path: str, keys: Sequence[str], greatest: Sequence[str] = (),
                least: Sequence[str] = (), keep_non_null: Sequence[str] = (), fanout: int = FANOUT) -> None:
    """Write one batch (unique by key) as a version of its own, then merge full tiers."""
    spark = batch.sparkSession
    jvm, fs = _filesystem(spark, path)
    spec = {"keys": list(keys), "greatest": list(greatest), "least": list(least), "keep_non_null": list(keep_non_null)}
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_table/_SUCCESS")):
        spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_table")
    found = versions(spark, path)
    for old in set(found) - set(_live(found)):  # merged by an earlier batch
        fs.delete(jvm.org.apache.hadoop.fs.Path(_directory(path, old)), True)
    batch.write.mode("overwrite").parquet(_directory(path, (batch_id, batch_id)))
    live = _live(versions(spark, path))
    tier = lambda v: next(k for k in range(64) if fanout ** (k + 1) > v[1] - v[0] + 1)
    while len(live) >= fanout and len({tier(v) for v in live[-fanout:]}) == 1:
        last = live[-fanout:]
        whole = (last[0][0], last[-1][1])
        _merged(spark, path, last, spec).write.mode("overwrite").parquet(_directory(path, whole))
        live = [*live[:-fanout], whole]
