"""Operator 11: phrase collocation mining by stripes.

A *stripe* belongs to a prefix (one or more words) and counts the words that
follow it: ``{next word: occurrences}``; the empty next word stands for the end
of a piece, so a one-word stripe adds up to all occurrences of its word. Tasks
build the stripes of their documents with numpy, one row for each prefix and
*slice* of the next words; stripes of the same prefix and slice meet in one
shuffle and are merged elementwise. From the merged stripes come

* the extensions: every phrase of two or more words found often enough is an
  entry of its prefix' stripe;
* the prefix totals: occurrences of single words and, per language, of all words;
* the subsumption maxima: the most frequent longer phrase around a phrase.

Counts cover all documents; only entries below ``min_count`` are left out of
the merged stripes, after they were counted. A very common prefix is one row
per task chunk and slice before the shuffle and is spread over ``slices`` tasks
behind it; nothing is grouped by language before each task has cut its rows to
the first ``top``.

Score of a cut of a phrase (a occurrences) in two parts (l and r occurrences):
``floor(scale * a * a / (l * r))`` in exact decimals of 38 digits (right up to
10^16 occurrences of a phrase); a phrase gets its lowest score, ties go to the
shortest first part. A phrase that lies inside a longer one of at least
``min_count`` occurrences, with ``100 * f(longer) >= subsume_percent * a``, is
dropped.

Edge cases: NULL texts are empty; a NULL language is ``und``; repeated rows and
ids count each; texts without two words in a piece give no phrase; long texts
are cut between pieces, so memory follows the longest piece; ties in score and
count are put in order by the phrase's UTF-8 bytes; an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltaic.llm.common import stored
from voltaic.llm.spans import LOWER_TABLE, byte_set, coded, runs, utf8

# FIXED VALUES: what parts pieces and words, and the name of no language
PIECE_ENDS, WORD_GAPS, NO_LANG = ".,;:!?\n\x0b\x0c\r", " \t", "und"
STRIPE_SCHEMA = "lang string, prefix string, slice int, nexts array<string>, counts array<long>"


def _blocks(raw: np.ndarray, offsets: np.ndarray, most: int):
    """(bytes, document offsets, first document) of about ``most`` bytes, cut between pieces."""
    ends = byte_set(PIECE_ENDS)
    at, n = 0, len(raw)
    while at < n:
        to = min(n, at + most)
        if to < n:  # go on to the next border of a document or a piece
            border = int(offsets[np.searchsorted(offsets, to)])
            step = 1 << 16
            for k in range(to, border, step):
                hit = np.flatnonzero(ends[raw[k:min(k + step, border)]])
                if len(hit):
                    border = k + int(hit[0]) + 1
                    break
            to = border
        first = int(np.searchsorted(offsets, at, "right")) - 1
        last = max(first + 1, int(np.searchsorted(offsets, to)))
        yield raw[at:to], np.clip(offsets[first:last + 1], at, to) - at, first
        at = to


def _mixed(h: np.ndarray) -> np.ndarray:
    """Bits of unsigned 64-bit numbers spread over all places."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def string_hashes(strings) -> np.ndarray:
    """64-bit polynomial hash of every string of an Arrow large-string array."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset:strings.offset + len(strings) + 1]
    raw = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    begin = offsets[:-1] - offsets[0]
    lengths = np.diff(offsets)
    power = np.cumprod(np.full(int(lengths.max(initial=1)), 0x100000001B3, np.uint64))
    place = np.arange(len(raw)) - np.repeat(begin, lengths)
    sums = lengths.astype(np.uint64)
    some = lengths > 0
    if some.any():
        sums[some] += np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * power[place], begin[some])
    return _mixed(sums)


def phrase_places(word_hashes: list[np.ndarray], lang_hash: np.ndarray, bits: int) -> np.ndarray:
    """Place of a phrase (hashes of its words in order, of its language) in a bitmap of 2^bits bits."""
    h = lang_hash.copy()
    for w in word_hashes:
        h = _mixed(h * np.uint64(3) + w)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _emit(langs, raw, offsets, doc_lang, length: int, slices: int, known):
    """Arrow batch of the stripes of one block for prefixes of ``length`` words."""
    import pyarrow as pa
    import pyarrow.compute as pc

    raw = LOWER_TABLE[raw]
    breaks = byte_set(PIECE_ENDS)[raw]
    inside = ~(breaks | byte_set(WORD_GAPS)[raw])
    starts, ends = runs(inside, offsets)
    if not len(starts):
        return
    word, names = coded(raw, inside, starts, ends)
    lang = doc_lang[np.searchsorted(offsets, starts, "right") - 1]
    fresh = np.zeros(len(word), bool)  # the word begins a piece or a document
    piece = np.cumsum(breaks)[starts]
    fresh[1:] = np.diff(piece) != 0
    fresh[np.searchsorted(starts, offsets[:-1][offsets[:-1] <= starts[-1]])] = True
    room = np.append(np.flatnonzero(fresh), len(word))
    left = np.repeat(room[1:], np.diff(room)) - np.arange(len(word))  # words from here to the end of the piece

    if length == 1:
        at = np.arange(len(word))
    else:  # a longer phrase can be frequent only if the phrases of ``length`` words at both of its ends are
        bitmap, bits = known
        hashes = string_hashes(names)[word]
        whole = np.flatnonzero(left >= length)
        place = phrase_places([hashes[whole + k] for k in range(length)], string_hashes(langs.cast(pa.large_string()))[lang[whole]], bits)
        frequent = np.zeros(len(word) + 1, bool)
        frequent[whole] = (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1
        at = np.flatnonzero(frequent[:-1] & frequent[1:] & (left > length))
        if not len(at):
            return
    after = np.where(left[at] > length, word[np.minimum(at + length, len(word) - 1)] + 1, 0)
    size = len(names) + 1
    keys, state = np.unique(lang[at] * size + word[at], return_inverse=True)
    lang_of, prefix = keys // size, names.take(pa.array(keys % size))
    space = pa.scalar(" ", pa.large_string())
    for k in range(1, length):
        keys, state = np.unique(state * size + word[at + k], return_inverse=True)
        lang_of = lang_of[keys // size]
        prefix = pc.binary_join_element_wise(prefix.take(pa.array(keys // size)), names.take(pa.array(keys % size)), space)
    keys, counts = np.unique(state * size + after, return_counts=True)
    owner, then = keys // size, keys % size
    sums = np.add.reduceat(np.frombuffer(names.buffers()[2], np.uint8), np.frombuffer(names.buffers()[1], np.int64)[:len(names)], dtype=np.int64)
    slice_of = np.concatenate([[0], sums % slices])
    order = np.lexsort((slice_of[then], owner))
    owner, then, counts = owner[order], then[order], counts[order].astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(slice_of[then]) != 0)]))
    bounds = pa.array(np.append(cut, len(then)).astype(np.int32))
    spelled = pa.concat_arrays([pa.array([""], pa.large_string()), names])
    yield pa.record_batch([
        langs.take(pa.array(lang_of[owner[cut]])).cast(pa.string()), prefix.take(pa.array(owner[cut])).cast(pa.string()),
        pa.array(slice_of[then[cut]].astype(np.int32)), pa.ListArray.from_arrays(bounds, spelled.take(pa.array(then)).cast(pa.string())),
        pa.ListArray.from_arrays(bounds, pa.array(counts))], names=["lang", "prefix", "slice", "nexts", "counts"])


def _build(length: int, slices: int, block_bytes: int, known):
    def run(batches):
        import pyarrow as pa
        bitmap = (np.frombuffer(known.value[0], np.uint8), known.value[1]) if known else None
        held, size = [], 0

        def flush():
            table = pa.Table.from_batches(held)
            langs = table.column("lang").fill_null(NO_LANG).combine_chunks().dictionary_encode()
            langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
            doc_lang = langs.indices.to_numpy().astype(np.int64)
            raw, offsets = utf8(table.column("text"))
            for part, bounds, first in _blocks(raw, offsets, block_bytes):
                yield from _emit(langs.dictionary, part, bounds, doc_lang[first:first + len(bounds) - 1], length, slices, bitmap)

        for batch in batches:
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= block_bytes:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()
    return run


def _pages(bits: int, page_bits: int):
    """Places of the phrases of a batch in the bitmap, as (page, place in the page)."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        for batch in batches:
            if not batch.num_rows:
                continue
            words = pc.split_pattern(batch.column(1).cast(pa.large_string()), " ")
            flat, per = words.flatten(), words.value_lengths()[0].as_py()  # phrases of one table have equally many words
            hashes = string_hashes(flat).reshape(-1, per)
            place = phrase_places(list(hashes.T), string_hashes(batch.column(0).cast(pa.large_string())), bits)
            yield pa.record_batch([pa.array(place >> page_bits), pa.array(place & ((1 << page_bits) - 1))], names=["page", "place"])
    return run


def frequent_bitmap(phrases: DataFrame, bits: int = 26, page_bits: int = 15) -> tuple[bytes, int]:
    """Bitmap of 2^bits bits with the hashes of (lang, phrase): of that size for any number of phrases.

    Phrases that share a bit with a frequent one are counted in vain, none is missed."""
    places = phrases.select("lang", "phrase").mapInArrow(_pages(bits, page_bits), "page long, place long")
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    word = F.shiftright("place", 6).alias("word")
    mask = F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("mask")
    words = places.groupBy("page", word).agg(mask).groupBy("page").agg(F.collect_list(F.struct("word", "mask")).alias("words"))
    longs = bitmap.view("<i8")
    for r in words.toLocalIterator():  # at most 2^(bits - page_bits) rows of 2^(page_bits - 6) numbers
        at = [(r["page"] << (page_bits - 6)) + w["word"] for w in r["words"]]
        longs[at] = [w["mask"] for w in r["words"]]
    return bitmap.tobytes(), bits


def stripes(docs: DataFrame, length: int = 1, min_count: int = 10, known: tuple[bytes, int] | None = None, slices: int = 8,
            block_bytes: int = 8 << 20, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Merged stripes of all prefixes of ``length`` words: lang, prefix, slice, total (all counts of this slice of the
    next words) and extensions, array of (next, n) with n >= ``min_count``. Longer prefixes need ``known``, the
    bitmap of the frequent phrases of ``length`` words, and are kept only where they have extensions."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(known) if known else None  # of fixed size
    built = rows.mapInArrow(_build(length, slices, block_bytes, shared), STRIPE_SCHEMA)
    key = ["lang", "prefix", "slice"]
    met = built.repartition(*key)  # stripes move as they are; all that follows needs no other shuffle
    entries = met.select(*key, F.explode(F.arrays_zip("nexts", "counts")).alias("e"))
    merged = entries.groupBy(*key, F.col("e.nexts").alias("next")).agg(F.sum("e.counts").alias("n"))
    often = (F.col("n") >= min_count) & (F.col("next") != "")
    whole = merged.groupBy(*key).agg(F.sum("n").alias("total"), F.collect_list(F.when(often, F.struct("next", "n"))).alias("extensions"))
    return whole if length == 1 else whole.where(F.size("extensions") > 0)


def _extended(merged: DataFrame) -> DataFrame:
    """lang, phrase, a of the extensions."""
    return merged.select("lang", "prefix", F.explode("extensions").alias("e")).select(
        "lang", F.concat_ws(" ", "prefix", "e.next").alias("phrase"), F.col("e.n").alias("a"))


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, subsume_percent: int = 50, scale: int = 1_000_000,
                 top: int = 2000, bits: int = 26, text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score (and words, longest: the subsumption maximum) of each language's first
    ``top`` phrases of 2 to ``max_words`` words by score, count and phrase."""
    columns = {"text_col": text_col, "lang_col": lang_col}
    held = stored(stripes(docs, 1, min_count, **columns, **options), "stripes-1")
    singles = held.groupBy("lang", "prefix").agg(F.sum("total").alias("f"))
    sizes = singles.groupBy("lang").agg(F.sum("f").alias("n"))
    levels = [stored(_extended(held), "phrases-2")]
    for length in range(2, max_words):
        known = frequent_bitmap(levels[-1], bits)
        levels.append(stored(_extended(stripes(docs, length, min_count, known, **columns, **options)), f"phrases-{length + 1}"))
    found = reduce(DataFrame.unionByName, (p.withColumn("words", F.lit(m)) for m, p in enumerate(levels, 2)))
    # parts of phrases found often enough are found at least as often
    parts = stored(singles.where(F.col("f") >= min_count).select("lang", F.col("prefix").alias("part"), "f")
                   .unionByName(found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))), "phrase-parts")

    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"),
                             "rest": F.expr("substring_index(phrase, ' ', k - words)")})
    left = parts.select("lang", F.col("part").alias("first"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    exact = "decimal(38,0)"
    score = F.expr(f"(cast({scale} as {exact}) * cast(a as {exact}) * cast(a as {exact})) div (cast(l as {exact}) * cast(r as {exact}))")
    lowest = (scored.withColumn("score", score).groupBy("lang", "phrase", "words", "a")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))

    # every shorter phrase inside a phrase, with the most frequent phrase around it
    inner = F.expr("""flatten(transform(sequence(2, words - 1), m ->
                        transform(sequence(0, words - m), i -> concat_ws(' ', slice(split(phrase, ' ', -1), i + 1, m)))))""")
    longest = (found.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a")
               .groupBy("lang", "phrase").agg(F.max("a").alias("longest")))
    kept = (lowest.join(longest, ["lang", "phrase"], "left")
            .where(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("a") * subsume_percent)))

    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    first = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return (first.join(sizes, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n",
                    F.col("cut.score").cast("long").alias("score"), "words", "longest"))
