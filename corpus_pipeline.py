"""Corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, byte-level BPE.

Every stage takes all documents its predecessor kept, decides with one of the
operators of ``voltaic.llm`` and returns the columns of ``documents`` (the last
one the encoded documents). ``run`` writes each stage's result as Parquet in
the shared checkpoint folder and reads it back for the next.

* ``toxicity`` drops documents that score 0.3 or more.
* ``line_dedup`` removes lines found in at least 10 documents (``n_chars`` follows
  the text); documents whose lines all go stay, with an empty text.
* ``near_dedup`` keeps, of each group linked at 4 or fewer bits, the document with
  the smallest id; of rows that repeat id and text one stays; a group without
  any id stays whole.
* ``decontaminate`` drops documents that hold a benchmark window of 10 words.
* ``encode`` encodes and decodes what is left.

NULL texts are empty texts; an empty table passes through; columns beyond those
of ``documents`` are left behind by the first stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaic.llm import line_runs, queries, simhash, toxicity, winnow
from voltaic.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = queries.toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, carry=COLUMNS).where("score < 0.3").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_runs.drop_common_lines(docs, min_docs=10, min_chars=1, carry=COLUMNS)
    changed = F.col("n_dropped") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("row.text"))
    chars = F.when(changed, F.char_length("kept").cast("long")).otherwise(F.col("row.n_chars").cast("long"))
    return out.select("doc_id", text.alias("text"), "row.lang", "row.source", chars.alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    grouped = simhash.near_duplicates(docs, words=4, radius=4)
    first = (grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
             .select(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash")).distinct())
    rows = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    kept = rows.join(first, F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("text_hash") == F.col("key_hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text_hash"]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = winnow.shared_spans(docs, table(spark, sf_dir, "benchmark"), span=10, carry=COLUMNS)
    return found.where(F.size("hits") == 0).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.bpe_digests(docs, queries.rank_model(), keep_ids=True)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_duplicates),
          ("decontaminate", drop_contaminated), ("encode", encode)]

# Toxicity and near-dedup can't be expressed in SQL: tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
