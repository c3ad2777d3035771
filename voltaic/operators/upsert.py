"""Idempotent upserts into Gold tables.

``merge_frames`` is the set-based merge: incoming keep-last per key, one
full-outer join on the key, then a per-column policy. ``upsert_table``
persists it without a lakehouse format: partitioned facts are rewritten only
in the partitions the batch touches (dynamic partition overwrite, staged
first so the table is never read and overwritten in one job); unpartitioned
dimensions get a new snapshot version.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voltaic.operators.dedup import dedup_keep_last
from voltaic.session import scratch_path


def merge_frames(base: DataFrame, incoming: DataFrame, keys: Sequence[str],
                 update_cols: Sequence[str] | None = None, insert_only: bool = False,
                 keep_non_null: Sequence[str] = (), order: Sequence | None = None,
                 greatest_cols: Sequence[str] = (), keep_first_cols: Sequence[str] = (),
                 least_cols: Sequence[str] = ()) -> DataFrame:
    """Merge ``incoming`` into ``base`` on ``keys``; result has ``base``'s columns.

    ``base`` is unique per key (a table). ``incoming`` is reduced to its last
    row per key in ``order`` when ``order`` is given; without it, it must be
    unique per key already (the join would otherwise repeat base rows).

    * matched + ``insert_only``: base row kept (DO NOTHING)
    * matched, column in ``update_cols`` (default: all non-key): incoming value;
      for ``keep_non_null`` columns a NULL incoming value keeps the base value;
      ``greatest_cols`` / ``least_cols`` take the larger / smaller of both; ``keep_first_cols`` keep base
    * unmatched incoming rows are inserted; unmatched base rows stay.
    """
    cols = base.columns
    non_key = [c for c in cols if c not in keys]
    upd = set(non_key if update_cols is None else update_cols)
    inc = incoming
    for c in cols:  # columns the batch does not carry are NULL (and kept from base where policy says so)
        if c not in inc.columns:
            inc = inc.withColumn(c, F.lit(None).cast(base.schema[c].dataType))
    if order is not None:  # the batch's own keep-last, on its extra order columns
        inc = dedup_keep_last(inc, list(keys), order)
    inc = inc.select(*cols)
    b = base.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in non_key], F.lit(True).alias("_in_b"))
    i = inc.select(*keys, *[F.col(c).alias(f"_i_{c}") for c in non_key], F.lit(True).alias("_in_i"))
    j = b.join(i, on=list(keys), how="full_outer")
    in_b, in_i = F.col("_in_b").isNotNull(), F.col("_in_i").isNotNull()
    out = []
    for c in non_key:
        bc, ic = F.col(f"_b_{c}"), F.col(f"_i_{c}")
        if insert_only or c in keep_first_cols or c not in upd:
            v = F.when(in_b, bc).otherwise(ic)
        elif c in greatest_cols or c in least_cols:
            both = F.greatest(bc, ic) if c in greatest_cols else F.least(bc, ic)
            v = F.when(in_b & in_i, both).when(in_b, bc).otherwise(ic)
        elif c in keep_non_null:
            v = F.when(in_i, F.coalesce(ic, bc)).otherwise(bc)
        else:
            v = F.when(in_i, ic).otherwise(bc)
        out.append(v.alias(c))
    return j.select(*keys, *out).select(*cols)


def upsert_table(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str],
                 partition_by: Sequence[str] = (), **policy) -> str:
    """Persist a merge into the Parquet table at ``path``; returns the live path.

    Partitioned: read only partitions present in ``incoming`` (their values,
    bounded by the batch, become a partition filter), merge, stage under the
    shared checkpoint root, then dynamic-overwrite those partitions.
    Unpartitioned: write a new version directory ``path/v=<n>`` and return it.
    """
    partition_by = list(partition_by)
    exists = _exists(spark, path)
    if partition_by:
        if exists:
            # read with the batch's schema (minus its order columns) so partition values
            # keep their declared types
            order = set(policy.get("order") or [])
            schema = StructType([f for f in incoming.schema.fields if f.name not in order])
            base = spark.read.schema(schema).parquet(path)
            # the partitions a batch touches are few (its days or months): as literals they prune the listing
            touched = incoming.select(*partition_by).distinct().collect()
            base = base.where(reduce(or_, [reduce(and_, [F.col(c).eqNullSafe(F.lit(r[c])) for c in partition_by])
                                           for r in touched], F.lit(False)))
            merged = merge_frames(base, incoming, keys, **policy)
        else:
            order = policy.get("order")
            merged = (dedup_keep_last(incoming, list(keys), order) if order else incoming)
            merged = merged.select(*[c for c in incoming.columns if c not in (order or [])])
        stage = scratch_path(spark, "upsert-stage")
        # rebalanced on the partition columns (AQE splits a hot partition, merges small ones) and sorted by
        # key within files, so the Parquet statistics of a partition act as a key index
        (merged.hint("rebalance", *partition_by).sortWithinPartitions(*partition_by, *keys)
            .write.mode("overwrite").partitionBy(*partition_by).parquet(stage))
        staged = spark.read.parquet(stage)
        (staged.select(*merged.columns).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path))
        return path
    version = 0
    if exists:
        latest = latest_version(spark, path)
        version = latest + 1
        base = spark.read.parquet(f"{path}/v={latest}").drop("v")
        merged = merge_frames(base, incoming, keys, **policy)
    else:
        order = policy.get("order")
        merged = (dedup_keep_last(incoming, list(keys), order) if order else incoming)
        merged = merged.select(*[c for c in incoming.columns if c not in (order or [])])
    target = f"{path}/v={version}"
    merged.write.mode("overwrite").parquet(target)
    return target


def latest_version(spark: SparkSession, path: str) -> int:
    """Highest snapshot version under ``path`` (``v=`` is a discovered partition column)."""
    return spark.read.parquet(path).agg(F.max("v")).first()[0]


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v={latest_version(spark, path)}")


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException
    try:
        spark.read.parquet(path).schema  # noqa: B018 - resolves the file listing only
        return True
    except AnalysisException:
        return False


# ---------------------------------------------------------------------------
# Table policies
# ---------------------------------------------------------------------------


def upsert_dim_region(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Overwrite name; population/area overwritten only by non-NULL values."""
    return merge_frames(base, incoming, ["code_insee"],
                        keep_non_null=["population", "superficie_km2"],
                        keep_first_cols=[c for c in ("status", "first_seen_at", "last_seen_at")
                                         if c in base.columns])


def upsert_dim_time(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert-only (existing timestamps untouched)."""
    return merge_frames(base, incoming, ["id_date"], insert_only=True)


def upsert_dim_source(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Overwrite ``is_green`` (and category when present)."""
    return merge_frames(base, incoming, ["source_name"])


def upsert_fact_energy(base: DataFrame, incoming: DataFrame, order: Sequence | None = None) -> DataFrame:
    """Overwrite MW, temperature, consumption and the (recomputed) load factor."""
    return merge_frames(base, incoming, ["id_date", "id_region", "id_source"], order=order)


def upsert_fact_meteo(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Overwrite the three weather measures."""
    return merge_frames(base, incoming, ["id_date", "id_region"])


def upsert_fact_capacity(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Overwrite installed MW per (region, source, year)."""
    return merge_frames(base, incoming, ["id_region", "id_source", "annee"])


def upsert_fact_maintenance(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Overwrite everything but the event id."""
    return merge_frames(base, incoming, ["event_id"])


def upsert_region_seen(dim_region: DataFrame, seen: DataFrame, now: str) -> DataFrame:
    """Discovered regions -> insert as active, or touch last_seen and reactivate.

    ``seen`` has (code_insee, nom_region). ``first_seen_at`` is kept,
    ``last_seen_at`` = greatest(old, now).
    """
    now_ts = F.lit(now).cast("timestamp_ntz")
    inc = seen.select("code_insee", "nom_region", F.lit("active").alias("status"),
                      now_ts.alias("first_seen_at"), now_ts.alias("last_seen_at"))
    for c in dim_region.columns:
        if c not in inc.columns:
            inc = inc.withColumn(c, F.lit(None).cast(dim_region.schema[c].dataType))
    return merge_frames(dim_region, inc.select(*dim_region.columns), ["code_insee"],
                        update_cols=["nom_region", "status", "last_seen_at"],
                        keep_non_null=["nom_region"], greatest_cols=["last_seen_at"])
