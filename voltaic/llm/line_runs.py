"""Operator 10: line dedup over levelled sorted runs of line hashes (DataFrame functions only).

A line's key is the line without ASCII white space at its ends, A-Z
lower-cased; runs hold (key hash of 128 bits, number of documents). A run is a
bucketed table: bucket and order are the hash, one sorted file per bucket. Batches
are dealt into the same buckets once, so runs meet each other and the batches
bucket by bucket in their order, without another shuffle or sort. ``LineRuns.add`` takes one batch of documents'
line counts: it merge-joins the runs, drops the keys they already decide (at
least ``min_docs`` documents over all runs; those need no more counting, so a very
common line leaves the later batches) and adds the rest as a new run of level 0.
When a level has ``fanout`` runs they are merged into one run of the next level.

``drop_common_lines`` deals the documents into ``batches``, adds them batch by
batch and then drops every line whose key is in at least ``min_docs``
documents, in every document, the early ones included. Line texts never move:
only hashes are exploded, aggregated map-side and shuffled (a line in a third
of all documents is one row per task); the documents meet the common keys
they hold in one join on (id, hash of the text).

Runs are external tables in the shared checkpoint folder, named in the
session's catalog while they are needed.

Edge cases: NULL and empty texts are one empty line; keys shorter than
``min_chars`` code points always stay; a line repeated within a document counts
that document once; repeated document rows count each; lines are joined by
``\\n`` again, so other white space (``\\r``, blanks at the ends) of kept lines
stays; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaic.llm.common import BLANKS, ascii_lower, carried, shuffle_partitions, stored
from voltaic.llm.winnow import let
from voltaic.session import scratch_path

RUN_SCHEMA = "hash binary, n long"


def line_keys(text: Column) -> Column:
    """Key of every line of a text, in order."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)))


def key_hashes(keys: Column, min_chars: int) -> Column:
    """Hash of every key; NULL for the ones too short to be dropped."""
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.md5(k.cast("binary"))))


@contextmanager
def ordered_scans(spark: SparkSession):
    """Within it, plans take bucketed tables of one file per bucket as sorted (Spark checks the number of files)."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class LineRuns:
    """Levelled runs; ``levels[i]`` lists the table names of the runs of level i."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = shuffle_partitions(spark)
        self.levels: list[list[str]] = [[]]

    def run(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def _runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def undecided(self, counts: DataFrame) -> DataFrame:
        """The rows (hash, n) of a batch whose keys the runs do not hold with ``min_docs`` documents yet."""
        known = F.lit(0).cast("long")
        for k, name in enumerate(self._runs()):
            run = self.run(name).select("hash", F.col("n").alias(f"n{k}")).hint("merge")
            counts = counts.join(run, "hash", "left")
            known = known + F.coalesce(F.col(f"n{k}"), F.lit(0))
        return counts.where(known < self.min_docs).select("hash", "n")

    def merged(self, left: str, right: str) -> DataFrame:
        """Two runs as one, in order."""
        a, b = self.run(left), self.run(right).select(F.col("hash").alias("h"), F.col("n").alias("m")).hint("merge")
        both = a.join(b, F.col("hash") == F.col("h"), "full_outer")
        return both.select(F.coalesce("hash", "h").alias("hash"), (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

    def write(self, rows: DataFrame, *partition_by: str) -> str:
        """Write rows that lie in their buckets' tasks as a sorted table; its name."""
        path = scratch_path(self.spark, "line-run")
        name = "line_run_" + path.rsplit("-", 1)[1]
        with ordered_scans(self.spark):
            writer = rows.write.option("path", path).bucketBy(self.buckets, "hash").sortBy("hash").format("parquet")
            (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)
        return name

    def dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, "hash")

    def add(self, counts: DataFrame) -> None:
        """Add one batch (hash, n), unique by hash: without the keys already decided, as a sorted run; then merge full levels."""
        left = self.undecided(counts)  # joins with runs leave the rows in their buckets' tasks
        self._put(0, self.write(left if self._runs() else self.dealt(left)))

    def _put(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merge_all(full))

    def _merge_all(self, names: list[str]) -> str:
        while len(names) > 1:
            left, right, *rest = names
            whole = self.write(self.merged(left, right))
            for old in (left, right):
                self.spark.sql(f"DROP TABLE {old}")
            names = [whole, *rest]
        return names[0]

    def common(self) -> DataFrame:
        """Keys that the runs hold with at least ``min_docs`` documents; merges what runs are left."""
        names = self._runs()
        if not names:
            return self.spark.createDataFrame([], "hash binary")
        self.levels = [[self._merge_all(names[::-1])]]  # small runs are merged first
        return self.run(self.levels[0][0]).where(F.col("n") >= self.min_docs).select("hash")

    def drop(self) -> None:
        """Forget the runs (their files stay where the session's scratch files are)."""
        for name in self._runs():
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = [[]]


def common_lines(docs: DataFrame, min_docs: int, min_chars: int, batches: int, fanout: int, text_col: str = "text") -> DataFrame:
    """Hashes of the line keys found in at least ``min_docs`` documents, by batches over levelled runs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashes = F.array_distinct(key_hashes(line_keys(text), min_chars))
    lines = docs.select(F.pmod(F.xxhash64(text), F.lit(batches)).cast("int").alias("batch"), F.explode(hashes).alias("key"))
    counts = (lines.where("key IS NOT NULL").groupBy("batch", F.unhex("key").alias("hash"))
              .agg(F.count("*").alias("n")))
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    arrived = runs.write(runs.dealt(counts), "batch")  # the batches lie in the runs' buckets and order, too
    for batch in range(batches):
        runs.add(runs.run(arrived).where(F.col("batch") == batch).select("hash", "n"))
    found = stored(runs.common(), "line-common")
    runs.drop()
    docs.sparkSession.sql(f"DROP TABLE {arrived}")
    return found


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2,
                      id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped, kept (the remaining lines joined by newlines); with ``carry``
    also those columns of the document's row, as a struct ``row``."""
    common = common_lines(docs, min_docs, min_chars, batches, fanout, text_col)
    rows = docs.select(*carried(carry), F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    hashes = F.array_distinct(key_hashes(line_keys(F.col("text")), min_chars))
    held = (rows.select("doc_id", "text_hash", F.explode(hashes).alias("key")).where("key IS NOT NULL")
            .select("doc_id", "text_hash", F.unhex("key").alias("hash")).join(common, "hash")
            .groupBy(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash"))
            .agg(F.collect_set(F.lower(F.hex("hash"))).alias("drop")))
    held = stored(held, "line-held")
    joined = rows.join(held, F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("text_hash") == F.col("key_hash")), "left")
    lines = F.split(F.col("text"), "\n", -1)

    def kept(both: Column) -> Column:
        stay = F.filter(both, lambda r: F.coalesce(~F.array_contains(F.col("drop"), r["key"]), F.lit(True)))
        return let(stay, lambda s: F.struct(F.size(both).cast("long").alias("n_lines"),
                                            (F.size(both) - F.size(s)).cast("long").alias("n_dropped"),
                                            F.array_join(F.transform(s, lambda r: r["line"]), "\n").alias("kept")))

    def whole(all_lines: Column) -> Column:
        return F.struct(F.size(all_lines).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"),
                        F.col("text").alias("kept"))

    zipped = F.zip_with(lines, key_hashes(line_keys(F.col("text")), min_chars),
                        lambda line, key: F.struct(line.alias("line"), key.alias("key")))
    result = F.when(F.col("drop").isNull(), let(lines, whole)).otherwise(let(zipped, kept))
    extra = ["row"] if carry else []
    return (joined.select(*extra, "doc_id", result.alias("r"))
            .select(*extra, "doc_id", "r.n_lines", "r.n_dropped", "r.kept"))
