"""Every Gold upsert policy, run over the bound driver tables: merging the same batch twice gives the
table that merging it once gives (SURVEY §5 (d))."""

import pytest
from pyspark.sql import functions as F

from voltaic.functions.calendar import date_key
from voltaic.operators import dedup as K
from voltaic.operators import upsert as U
from voltaic.plans import catalog as C
from voltaic.plans import gold
from voltaic.plans import standins as S

SF = "/root/testdata/sf0.001"


def _before_1998(df, col="ts"):
    return df.where(F.col(col) < F.lit("1998-01-01").cast("timestamp_ntz"))


def _fact(spark):
    staged = S.fact_staged(spark, SF)
    base = gold.fact_from_staged(_before_1998(staged))
    inc = S.to_fact_rows(staged.where(F.col("batch_tag") == "R")).select(*gold.FACT_COLS, "load_batch", "load_pos")
    return base, inc, lambda b, i: U.upsert_fact_energy(b, i, order=gold.LOAD_ORDER)


def _time(spark):
    staged = S.fact_staged(spark, SF)
    base = S.dim_time_from(S.to_fact_rows(_before_1998(staged)))
    inc = S.dim_time_from(S.to_fact_rows(staged.where(F.col("batch_tag") == "R")))
    return base, inc, U.upsert_dim_time


def _region(spark):
    sil, _ = gold.silver_readings(spark, SF)
    seen = K.distinct_first_label(sil, "code_insee_region", "libelle_region", ["date_heure"],
                                  code_alias="code_insee", label_alias="nom_region")
    return S.region_attrs(spark, SF), seen, U.upsert_dim_region


def _source(spark):
    base = S.dim_source(spark).select("source_name", "is_green")
    inc = S.fact_staged(spark, SF).select("source_name").distinct().join(base, "source_name", "left")
    return base, inc, U.upsert_dim_source


def _capacity(spark):
    return (C._cap_fact(gold.capacity(spark, SF)), C._cap_fact(gold.capacity(spark, SF, brand="Brand#1")),
            U.upsert_fact_capacity)


def _maintenance(spark):
    cols = C._MAINT_FACT
    return (C._fact_maintenance(spark, SF, ("F", "O")).select(*cols),
            C._fact_maintenance(spark, SF, ("O", "P")).select(*cols), U.upsert_fact_maintenance)


def _meteo(spark):
    rows = S.meteo_rows(spark, SF).withColumnRenamed("code_insee", "id_region") \
        .withColumn("id_date", date_key("timestamp"))
    keys = ["id_date", "id_region"]
    base = K.dedup_keep_last(rows.where(F.col("timestamp") < F.lit("2024-01-15").cast("timestamp_ntz")),
                             keys, ["load_ordinal"]).drop("load_ordinal", "timestamp")
    inc = K.dedup_keep_last(rows.where(F.col("temperature_c").isNotNull()), keys, ["load_ordinal"]) \
        .drop("load_ordinal", "timestamp")
    return base, inc.select(*base.columns), U.upsert_fact_meteo


@pytest.mark.parametrize("build", [_fact, _time, _region, _source, _capacity, _maintenance, _meteo],
                         ids=["U04", "U02", "U01", "U03", "U06", "U07", "U05"])
def test_upsert_twice_equals_once(spark, build):
    base, inc, merge = build(spark)
    once = merge(base, inc).cache()
    twice = merge(once, inc)
    assert once.count() > 0
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    # the batch's keys are all present after the merge
    keys = [c for c in once.columns if c in inc.columns][:1]
    assert inc.select(*keys).join(once.select(*keys), keys, "left_anti").count() == 0
    once.unpersist()
