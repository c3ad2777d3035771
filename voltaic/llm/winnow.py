"""Operator 8: benchmark decontamination by winnowed fingerprints (DataFrame functions only).

Words of documents and benchmark items are hashed as ``gram``-word k-grams;
every window of ``span`` consecutive words is stood for by the minimum hash of
its ``span - gram + 1`` k-grams (winnowing). Any window that a document shares
with an item has the same minimum on both sides, so joining the minima misses
no shared span. A hit is extended to the windows it stands for: a document's
window joins an item's window by minimum *and* words, so hash collisions add
nothing, and documents and items that share less than a window (boilerplate of
nine words in a third of all documents and in every item) meet in no row at
all: what the join yields follows the true hits. Items shorter than ``span``
words count only as a whole; their fingerprint is the hash of all their words,
looked up among the document's grams of that many words.

Plan, the same at every size: the benchmark's minima also fill a bitmap of
2^``bits`` bits, which travels with the tasks as the result of a scalar
subquery. Documents test the minima of their windows in it, in place; windows
that pass it (hits, and false alarms as the bitmap fills up) leave the document
as rows of key, place and words and are joined to the items' windows, the side
to broadcast being Catalyst's and AQE's choice. Texts never move: documents
without a candidate are results already, the others are joined to their hits.

Edge cases: NULL and empty texts have no words and no hits; items without
words are ignored; a NULL item id counts as the empty string; equal item ids
count once; repeated document rows each get their result; empty tables give
empty (documents) or hit-free (benchmark) results; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaic.llm.common import carried, stored, words

KEY = ["doc_id", "text_hash"]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row (bound as a lambda variable, so the optimizer cannot
    copy its expression into every use)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grams(tokens: Column, size: int) -> Column:
    """Hash of every ``size`` consecutive elements of an array of word hashes."""
    at = F.sequence(F.lit(0), F.size(tokens) - size)
    some = F.transform(at, lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(size)]))
    return F.when(F.size(tokens) >= size, some).otherwise(F.array().cast("array<bigint>"))


def word_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def minima(hashes: Column, window: int) -> Column:
    """Minimum of every ``window`` consecutive hashes (none if there are fewer)."""
    at = F.sequence(F.lit(0), F.size(hashes) - window)
    low = F.transform(at, lambda i: F.least(*[F.get(hashes, i + j) for j in range(window)])) if window > 1 else hashes
    return F.when(F.size(hashes) >= window, low).otherwise(F.array().cast("array<bigint>"))


def _sizes(items: DataFrame, span: int, gram: int) -> list[int]:
    """k-gram sizes in use: the regular one and the lengths of the short items (fewer than ``span`` values)."""
    short = items.where(F.col("n") < span).select("n").distinct().collect()
    return [gram, *sorted(r["n"] for r in short)]


def _windows(tokens: Column, sizes: list[int], span: int, gram: int, wanted=None) -> Column:
    """Array of (k, hash, at, words) of the windows of ``span`` words and of the short items' sizes whose hash is
    ``wanted`` (default: all).

    The short sizes are marked by a negative k, as one of them may equal the regular size."""
    def of_size(hashed: Column, size: int, k: int, window: int, length: int) -> Column:
        def chosen(low: Column) -> Column:
            every = F.when(F.size(low) > 0, F.sequence(F.lit(0), F.size(low) - 1)).otherwise(F.array().cast("array<int>"))
            at = every if wanted is None else F.filter(every, lambda i: wanted(F.get(low, i)))
            return F.transform(at, lambda i: F.struct(F.lit(k).alias("k"), F.get(low, i).alias("hash"), i.alias("at"),
                                                      F.array_join(F.slice(tokens, i + 1, length), " ").alias("words")))
        return let(let(grams(hashed, size), lambda g: minima(g, window)), chosen)

    def all_sizes(hashed: Column) -> Column:
        regular = of_size(hashed, gram, gram, span - gram + 1, span)
        return F.concat(regular, *[of_size(hashed, n, -n, 1, n) for n in sizes[1:]])
    return let(word_hashes(tokens), all_sizes)


def benchmark_items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (row number), item_id (text), words, n of every item that has words."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"),
                            words(F.col(text_col).cast("string")).alias("words"))
    rows = rows.where(F.size("words") > 0).withColumn("n", F.size("words"))
    return rows.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words", "n").distinct()


def item_windows(items: DataFrame, sizes: list[int], span: int, gram: int) -> DataFrame:
    """k, hash, words, item_id, length: the distinct windows of every item."""
    regular = F.col("n") >= span
    own = _windows(F.col("words"), sizes, span, gram)
    fits = F.filter(own, lambda w: F.when(regular, w["k"] == gram).otherwise(w["k"] == -F.col("n")))
    return (items.select("item_id", F.least(F.col("n"), F.lit(span)).alias("length"), F.explode(fits).alias("w"))
            .select("w.k", "w.hash", "w.words", "item_id", "length").distinct())


def hash_bitmap(hashes: DataFrame, bits: int) -> DataFrame:
    """One row: array of 2^(bits - 6) longs with the bit ``hash mod 2^bits`` of every hash set; of that size for any input."""
    place = F.col("hash").bitwiseAND((1 << bits) - 1)
    words = (hashes.groupBy(F.shiftright(place, 6).alias("id"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(hash & 63 as int)))").alias("mask")))
    every = hashes.sparkSession.range(1 << (bits - 6)).join(words, "id", "left")
    in_order = F.array_sort(F.collect_list(F.struct("id", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))))
    return every.agg(F.transform(in_order, lambda w: w["mask"]).alias("bitmap"))


def _tested(bitmap: Column, bits: int):
    """hash -> is its bit set."""
    def bit(h: Column) -> Column:
        word = F.get(bitmap, F.shiftright(h.bitwiseAND((1 << bits) - 1), 6).cast("int"))
        return F.getbit(word, h.bitwiseAND(63).cast("int")) == 1
    return bit


def _merged(starts: Column, length: Column) -> Column:
    """Distinct window starts -> array of (start, end) of the stretches they cover."""
    def stretches(s: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(s) - 1)
        first = F.filter(at, lambda i: (i == 0) | (F.get(s, i) - F.get(s, i - 1) > length))
        last = F.filter(at, lambda i: (i == F.size(s) - 1) | (F.get(s, i + 1) - F.get(s, i) > length))
        return F.zip_with(first, last, lambda a, b: F.struct(F.get(s, a).alias("start"), (F.get(s, b) + length).alias("end")))
    return let(F.array_sort(starts), stretches)


def covered(spans: Column) -> Column:
    """Number of places in the union of [start, end) spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["end"]))).alias("n"),
        F.greatest(acc["end"], s["end"]).alias("end"))
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def shared_spans(docs: DataFrame, benchmark: DataFrame, span: int = 10, gram: int = 5, bits: int = 20,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, hits: array of (item_id, spans: array of (start, end) in words) per document; with ``carry``
    also those columns of its row, as a struct ``row``."""
    items = stored(benchmark_items(benchmark, item_col, item_text_col), "winnow-items")
    sizes = _sizes(items, span, gram)
    windows = stored(item_windows(items, sizes, span, gram), "winnow-windows")
    bitmap = stored(hash_bitmap(windows.select("hash"), bits), "winnow-bitmap")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*carried(carry), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = rows.withColumn("bitmap", bitmap.scalar())  # functions over arrays take columns, but no subqueries
    known = _tested(F.col("bitmap"), bits)
    read = let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"),
                                                        _windows(w, sizes, span, gram, known).alias("own")))
    marked = stored(rows.select(*["row"] * bool(carry), *KEY, read.alias("r"))
                    .select(*["row"] * bool(carry), *KEY, "r.n_words", F.when(F.size("r.own") > 0, F.col("r.own")).alias("own")), "winnow-documents")

    found = marked.where("own IS NOT NULL").select(*KEY, F.explode("own").alias("w")).select(*KEY, "w.k", "w.hash", "w.at", "w.words")
    matched = found.distinct().join(windows, ["k", "hash", "words"])
    spans = _merged(F.collect_set("at"), F.col("length")).alias("spans")
    per_item = matched.groupBy(*KEY, "item_id", "length").agg(spans)
    named = per_item.groupBy(*KEY).agg(F.collect_list(F.struct("item_id", "spans")).alias("found"))
    named = stored(named, "winnow-named").select(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash"), "found")
    same = F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("text_hash") == F.col("key_hash"))
    none = F.array().cast("array<struct<item_id:string,spans:array<struct<start:int,end:int>>>>")
    out = ["row"] * bool(carry) + ["doc_id", "n_words"]
    joined = marked.where("own IS NOT NULL").join(named, same, "left")
    clean = marked.where("own IS NULL").select(*out, none.alias("hits"))
    return joined.select(*out, F.coalesce("found", none).alias("hits")).unionByName(clean)
