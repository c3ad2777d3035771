"""Helpers shared by the operators: intermediate tables, shared files, word patterns, worker caches."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaic.session import scratch_path, small_batches  # noqa: F401 - small_batches for the operators

# FIXED VALUES (stated by the operators' contracts)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_WORD_PATTERN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, every other character as it is (SQL ``lower`` would also change É, İ, ...).

    Texts whose non-ASCII part has no capitals take the fast ``lower``; both branches agree there.
    """
    rest = F.regexp_replace(col, r"[\x00-\x7F]+", "")
    return F.when(F.lower(rest) == rest, F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def words(col: Column) -> Column:
    """Words of a text by the contracts' pattern, A-Z lower-cased; NULL has none.

    Cut at runs of the other characters, which is several times faster than extracting the matches.
    """
    return F.array_remove(F.split(ascii_lower(F.coalesce(col, F.lit(""))), NO_WORD_PATTERN, -1), "")


def carried(carry: list[str] | None) -> list[Column]:
    """The named columns as one struct ``row``, so that no name can clash with an operator's own columns."""
    return [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Cuts the lineage in a place all executors and the driver share, so a lost
    executor costs no recomputation of what came before; the schema is passed
    on, so an empty table stays readable.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


HEAVY = 1000


def spread_join(rows: DataFrame, per_key: DataFrame, key: list[str], total: int) -> DataFrame:
    """Rows left-joined to a table with one row per key that counts the key's rows as ``n``; ``total``: all rows.

    At most ``HEAVY`` keys can have ``total / HEAVY`` rows or more: those are broadcast. The rows of all other keys,
    none with more than that, are joined by shuffle, so no hot key meets in one task."""
    values = [c for c in per_key.columns if c not in (*key, "n")]
    heavy = F.col("n") * HEAVY >= total
    large = per_key.where(heavy).select(*key, *values, F.lit(True).alias("_heavy"))
    small = per_key.where(~heavy).select(*key, *values)
    out = [*rows.columns, *values]
    marked = rows.join(F.broadcast(large), key, "left")
    rest = marked.where("_heavy IS NULL").select(*rows.columns).join(small, key, "left").select(*out)
    return marked.where("_heavy").select(*out).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker (functions shipped by value get fresh globals per task)."""
    module = sys.modules.setdefault("_voltaic_llm_worker", types.ModuleType("_voltaic_llm_worker"))
    return module.__dict__.setdefault("cache", {})


def release_memory() -> None:
    """Hand memory that libraries have freed back to the system; glibc and Arrow would keep it for this worker."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def open_fs(uri: str):
    """(pyarrow filesystem, path) of a folder shared by driver and executors; local paths may come as file: URIs."""
    import re

    from pyarrow import fs
    if uri.startswith("/") or uri.startswith("file:"):
        return fs.LocalFileSystem(use_mmap=True), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)
