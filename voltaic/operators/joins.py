"""Joins (J01-J10).

Physical strategy is left to Catalyst and AQE: dimension sides are small and
are broadcast by the planner when their measured size is under
``spark.sql.autoBroadcastJoinThreshold`` (static estimate) or
``spark.sql.adaptive.autoBroadcastJoinThreshold`` (runtime size); otherwise a
shuffle join runs. Only literal, fixed-size tables built here (emission
factors, centroids) are inlined as expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaic.constants import EMISSION_FACTORS, REGION_CENTROIDS
from voltaic.functions.calendar import from_date_key


def star_join(fact: DataFrame, region: DataFrame, time: DataFrame | None, source: DataFrame,
              region_key: str = "id_region", time_key: str = "id_date",
              source_key: str = "id_source", instant: str = "horodatage") -> DataFrame:
    """Fact ⋈ region ⋈ time ⋈ source (inner equi-joins on the natural keys).

    Without a stored ``time`` dimension its only attribute here, the instant, is computed from the key
    (yyyyMMddHHmm), which saves the join and the scan behind it.
    """
    timed = (fact.withColumn(instant, from_date_key(time_key)) if time is None
             else fact.join(time, on=time_key, how="inner"))
    return timed.join(region, on=region_key, how="inner").join(source, on=source_key, how="inner")


def meteo_join(fact: DataFrame, time: DataFrame, region: DataFrame,
               time_key: str = "id_date", region_key: str = "id_region") -> DataFrame:
    """Meteo fact ⋈ time ⋈ region."""
    return fact.join(time, on=time_key, how="inner").join(region, on=region_key, how="inner")


def capacity_join(fact: DataFrame, region: DataFrame, source: DataFrame,
                  region_key: str = "id_region", source_key: str = "id_source") -> DataFrame:
    """Capacity fact ⋈ region ⋈ source."""
    return fact.join(region, on=region_key, how="inner").join(source, on=source_key, how="inner")


def maintenance_join(events: DataFrame, region: DataFrame, region_key: str = "id_region",
                     code_col: str = "code_insee", code: str | None = None) -> DataFrame:
    """Outage events ⟕ region; a region filter applies after the join."""
    out = events.join(region, on=region_key, how="left")
    if code is not None:
        out = out.where(F.col(code_col) == code)
    return out


def resolve_keys(staged: DataFrame, dims: Sequence[tuple[DataFrame, str]]) -> tuple[DataFrame, DataFrame]:
    """Resolve staged rows against dimensions.

    ``dims`` is a list of (dimension, key) pairs. Returns (rows whose keys all
    resolve, one-row frame with the number of rows that did not).
    """
    resolved = flagged = staged
    missed = F.lit(False)
    for n, (dim, key) in enumerate(dims):
        resolved = resolved.join(dim, on=key, how="inner")
        # one left join per dimension with a hit flag: every staged row is counted once, repeated rows each
        flagged = flagged.join(dim.select(key).distinct().withColumn(f"_hit{n}", F.lit(True)), on=key, how="left")
        missed = missed | F.col(f"_hit{n}").isNull()
    return resolved, flagged.agg(F.count_if(missed).alias("unmatched_rows"))


def orphans(fact: DataFrame, fk: str, dim: DataFrame, pk: str) -> DataFrame:
    """Fact rows whose non-NULL foreign key is absent from the dimension.

    Matches ``fk NOT IN (SELECT pk ...)`` for a NULL-free dimension key: NULL
    foreign keys are not orphans.
    """
    keys = dim.select(F.col(pk).alias("_pk")).where(F.col("_pk").isNotNull())
    return fact.where(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("_pk"), "left_anti")


def diff_known(seen: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(new = seen ∖ known, updated = seen ∩ known) on ``key``."""
    k = known.select(key).where(F.col(key).isNotNull())
    return seen.join(k, on=key, how="left_anti"), seen.join(k, on=key, how="left_semi")


def centroid_array(centroids: Mapping[str, tuple] | None = None) -> Column:
    """Literal array<struct<ord,code,lat,lon>> of a fixed centroid table."""
    cents = centroids or REGION_CENTROIDS
    return F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(code).alias("code"),
                 F.lit(float(v[-2])).alias("lat"), F.lit(float(v[-1])).alias("lon"))
        for i, (code, v) in enumerate(cents.items())])


def nearest_centroid(df: DataFrame, lat: str, lon: str, out: str = "region_code",
                     centroids: Mapping[str, tuple] | None = None) -> DataFrame:
    """Nearest centroid by Euclidean distance in degrees; first centroid wins ties.

    A projection over a fixed literal table: no join, no shuffle.
    """
    la, lo = F.col(lat), F.col(lon)
    scored = F.transform(centroid_array(centroids), lambda c: F.struct(
        ((la - c["lat"]) * (la - c["lat"]) + (lo - c["lon"]) * (lo - c["lon"])).alias("d2"),
        c["ord"].alias("ord"), c["code"].alias("code")))
    best = F.array_min(scored)
    return df.withColumn(out, F.when(la.isNotNull() & lo.isNotNull(), best["code"]))


def factor_map(factors: Mapping[str, float] | None = None) -> Column:
    f = factors or EMISSION_FACTORS
    return F.create_map(*[x for k, v in f.items() for x in (F.lit(k), F.lit(float(v)))])


def factor_lookup(df: DataFrame, source_col: str, factors=None, out: str = "factor",
                  default: float = 0.0) -> DataFrame:
    """Emission factor per source, unknown -> ``default``.

    ``factors`` may be a dict (inlined map literal) or a factor DataFrame with
    columns (source_name, factor) — e.g. the emission dimension (A24) — joined
    on the source (left). The dimension is first reduced to one factor per
    source (the largest, when a source is listed under several sectors), so
    the join never multiplies rows.
    """
    if factors is None or isinstance(factors, Mapping):
        return df.withColumn(out, F.coalesce(F.element_at(factor_map(factors), F.col(source_col)),
                                             F.lit(default)))
    fdim = factors.groupBy(F.col("source_name").alias("_fsrc")).agg(F.max(F.col("factor").cast("double")).alias("_f"))
    return (df.join(fdim, F.col(source_col) == F.col("_fsrc"), "left")
              .withColumn(out, F.coalesce(F.col("_f").cast("double"), F.lit(default)))
              .drop("_fsrc", "_f"))
