"""Partitioned tables whose upserts appear at once (U04, U07 persisted).

An upsert writes the partitions it touches, whole, under a generation of its
own (``gen=<n>/<partition>``), then a manifest that says which generation holds
each partition. The manifest is finished when its ``_SUCCESS`` file is there:
that one file switches readers from the old table to the new one, so neither a
reader nor a crash between two partitions ever sees half an upsert. The next
upsert rewrites what an unfinished one left. No table format beyond that.

Readers read exactly the directories that the newest finished manifest names,
in one scan (partition columns stay prunable). ``vacuum`` removes generations
that neither the newest manifest nor the one before it names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voltaic.operators.dedup import dedup_keep_last
from voltaic.operators.upsert import merge_frames


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm  # noqa: SLF001 - Hadoop FileSystem: listing and removal
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.Path, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001


def _names(spark: SparkSession, pattern: str) -> list[str]:
    path, fs = _fs(spark, pattern)
    return sorted(st.getPath().toString() for st in fs.globStatus(path(pattern)) or [])


def generations(spark: SparkSession, path: str) -> list[int]:
    """Finished manifests, oldest first."""
    found = (re.search(r"n=(\d+)/_SUCCESS$", f) for f in _names(spark, f"{path}/_manifest/n=*/_SUCCESS"))
    return sorted(int(m[1]) for m in found if m)


def manifest(spark: SparkSession, path: str, generation: int | None = None) -> dict[str, int]:
    """Partition directory (``day=.../...``) -> generation that holds it; empty before the first upsert."""
    done = generations(spark, path)
    if not done:
        return {}
    rows = spark.read.schema("dir string, gen long").json(f"{path}/_manifest/n={done[-1] if generation is None else generation}")
    return {r["dir"]: r["gen"] for r in rows.collect()}  # one row per partition


def _scan(spark: SparkSession, path: str, dirs: dict[str, int], schema: StructType | None = None) -> DataFrame:
    reader = spark.read.option("basePath", path)
    if schema is not None:
        reader = reader.schema(StructType([*schema.fields]).add("gen", "long"))
    return reader.parquet(*[f"{path}/gen={g}/{d}" for d, g in sorted(dirs.items())]).drop("gen")


def read_published(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The table as of the newest finished upsert."""
    dirs = manifest(spark, path)
    if not dirs:
        if schema is None:
            raise FileNotFoundError(f"nothing was published at {path}")
        return spark.createDataFrame([], schema)
    return _scan(spark, path, dirs, schema)


def publish_upsert(incoming: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str],
                   order: Sequence[str] = (), unstored: Sequence[str] | None = None, **policy) -> int:
    """Merge a batch into the table at ``path`` (policies as ``merge_frames``); returns the generation that holds it.

    ``partition_by`` columns are part of the key: a key never moves between partitions. The batch's last row per
    key in ``order`` counts; columns ``unstored`` (default: all of ``order``) are not part of the table.
    """
    spark, parts, order = incoming.sparkSession, list(partition_by), list(order)
    unstored = order if unstored is None else unstored
    if not set(parts) <= set(keys):
        raise ValueError("partition columns must belong to the key")
    done = generations(spark, path)
    before = manifest(spark, path)
    schema = StructType([f for f in incoming.schema.fields if f.name not in unstored])
    if before:
        # the partitions a batch touches are few (its days or months): as literals they prune the listing
        touched = incoming.select(*parts).distinct().collect()
        if not touched:
            return done[-1]
        hit = reduce(or_, [reduce(and_, [F.col(c).eqNullSafe(F.lit(r[c])) for c in parts]) for r in touched])
        merged = merge_frames(_scan(spark, path, before, schema).where(hit).select(*schema.names), incoming, list(keys),
                              order=order or None, **policy)
    else:
        merged = (dedup_keep_last(incoming, list(keys), order) if order else incoming).select(*schema.names)
    generation = (done[-1] if done else 0) + 1
    own = f"{path}/gen={generation}"
    (merged.hint("rebalance", *parts).sortWithinPartitions(*parts, *keys)
     .write.mode("overwrite").partitionBy(*parts).parquet(own))
    written = [f[f.index(f"/gen={generation}/") + len(f"/gen={generation}/"):] for f in _names(spark, own + "/*=*" * len(parts))]
    after = before | dict.fromkeys(written, generation)
    switch = spark.createDataFrame(sorted(after.items()), "dir string, gen long").coalesce(1)
    switch.write.mode("overwrite").json(f"{path}/_manifest/n={generation}")
    return generation


def vacuum(spark: SparkSession, path: str) -> list[int]:
    """Remove generations and manifests that the two newest manifests do not need; the removed generations."""
    done = generations(spark, path)
    needed = {g for n in done[-2:] for g in manifest(spark, path, n).values()}
    make, fs = _fs(spark, path)
    gone = []
    for d in _names(spark, f"{path}/gen=*"):
        g = int(d.rsplit("=", 1)[1])
        if g not in needed and done and g <= done[-1]:
            fs.delete(make(d), True)
            gone.append(g)
    for n in done[:-2]:
        fs.delete(make(f"{path}/_manifest/n={n}"), True)
    return gone
