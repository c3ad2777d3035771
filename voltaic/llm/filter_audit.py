"""Operator 13: filter interaction audit by path counting over the subset lattice.

``n`` filters make a lattice of 2^n states: which filters were applied already.
What a filter removes depends on the state it meets, not on the order that led
there, so a corpus is audited from the counts of its failure masks alone:

* ``failure_masks`` reads every text once and returns its mask;
* ``mask_counts`` counts documents (and good, toxic ones) per part and mask, at
  most 2^n rows a part;
* ``lattice_edges`` lays those counts over the lattice: an edge (state, filter)
  removes the documents that pass the state's filters and fail this one.
  Forward path counts (orders that reach the state) times backward path counts
  (orders that leave the next state) weight the edges: their weighted removals,
  added up per filter, are its Shapley sum over all n! orders;
* ``order_steps`` reads the steps of every order from the same edges.

Repeats are found without a group of equal texts ever meeting in one task: the
smallest id per text digest is an aggregate with partial sums, and documents
find out whether they hold it by a join on digest *and* id.

Edge cases: NULL and empty texts are one and the same empty text (no words, no
distinct words); a NULL part is the empty string; a document with a NULL id
has no smaller one and is none's smaller one, so it is no repeat; rows that
repeat id and text are no repeats of each other; labels that repeat an id mark
it if any of them does, NULL labels and ids mark nothing; an empty table gives
an empty result; other columns are never read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaic.llm.spans import byte_set, coded, runs, slices, utf8

# FIXED VALUES: filters of the contract, in the order of their bits
FILTERS = "ABCDE"
REPEAT = FILTERS.index("E")
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, MARKS = 200, 50, 3, "#$%&*|"
BLANKS = " \t\n\x0b\x0c\r"
EDGE_SCHEMA = "part string, state int, filter int, paths long, kept long, removed long, redundant long, good_lost long, toxic_lost long"


def text_masks(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits A to D of every text of a batch (bytes, document offsets)."""
    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(flags), offsets))

    inside = ~byte_set(BLANKS)[raw]
    starts, ends = runs(inside, offsets)
    n = len(offsets) - 1
    words = np.diff(np.searchsorted(starts, offsets))
    doc = np.repeat(np.arange(n), words)
    distinct = np.zeros(n, np.int64)
    if len(starts):
        code, names = coded(raw, inside, starts, ends)
        distinct = np.bincount(np.unique(doc * len(names) + code) // len(names), minlength=n)
    upper = per_text((raw >= 0x41) & (raw <= 0x5A))
    points = np.diff(offsets) - per_text((raw & 0xC0) == 0x80)  # bytes that go on with a character count no more
    fails = [words < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * words, 100 * upper > MAX_UPPER_PERCENT * points,
             per_text(byte_set(MARKS)[raw]) > 0]
    return sum(f.astype(np.int64) << bit for bit, f in enumerate(fails))


def _read_texts(block_bytes: int):
    def run(batches):
        import hashlib

        import pyarrow as pa
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            for first, last in slices(np.diff(offsets), block_bytes):
                own = offsets[first:last + 1]
                bounds = own - own[0]
                part = raw[own[0]:own[-1]]
                view = memoryview(part)
                digests = [hashlib.sha256(view[a:b]).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.record_batch([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first),
                                       pa.array(digests, pa.binary()), pa.array(text_masks(part, bounds))],
                                      names=["doc_id", "part", "digest", "mask"])
    return run


def failure_masks(docs: DataFrame, block_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "lang") -> DataFrame:
    """doc_id, part, mask (bit i: fails filter i of ``FILTERS``) of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.col(text_col).cast("string").alias("text"))
    read = rows.mapInArrow(_read_texts(block_bytes), "doc_id long, part string, digest binary, mask long")
    first = read.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    joined = read.join(first, ["digest", "doc_id"], "left")
    again = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return joined.select("doc_id", "part", (F.col("mask") + F.when(again, 1 << REPEAT).otherwise(0)).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """part, docs, good, toxic: arrays of 2^filters document counts by mask."""
    marked = (labels.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    seen = masks.join(marked, "doc_id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))

    def by_mask(name: str) -> Column:
        return F.array(*[F.sum(F.when(F.col("mask") == m, F.col(name)).otherwise(0)) for m in range(1 << filters)]).alias(name)
    return seen.groupBy("part").agg(*map(by_mask, ("docs", "good", "toxic")))


def _passing(counts: np.ndarray) -> np.ndarray:
    """Per state: documents that pass all its filters (sum over the masks that share no bit with it)."""
    kept = counts.copy()  # becomes the sum over the subsets of a set, one bit at a time
    for bit in range(len(counts).bit_length() - 1):
        high = np.flatnonzero(np.arange(len(kept)) >> bit & 1)
        kept[high] += kept[high ^ (1 << bit)]
    return kept[::-1]  # the subsets of a state's complement


def path_counts(filters: int) -> tuple[list[int], list[int]]:
    """Per state: orders that reach it from the empty state, and orders that lead from it to the full one."""
    states = 1 << filters
    reach, leave = [0] * states, [0] * states
    reach[0] = leave[-1] = 1
    for s in range(states):
        for f in range(filters):
            if not s >> f & 1:
                reach[s | 1 << f] += reach[s]
    for s in reversed(range(states)):
        leave[s] += sum(leave[s | 1 << f] for f in range(filters) if not s >> f & 1)
    return reach, leave


def _edges(batches):
    import pyarrow as pa
    for batch in batches:
        for row in batch.to_pylist():
            docs, good, toxic = (_passing(np.array(row[k], np.int64)) for k in ("docs", "good", "toxic"))
            states = len(docs)
            filters = states.bit_length() - 1
            reach, leave = path_counts(filters)
            out = []
            for s in range(states):
                for f in range(filters):
                    if s >> f & 1:
                        continue
                    to, failing = s | 1 << f, int(docs[0] - docs[1 << f])
                    removed = int(docs[s] - docs[to])
                    out.append({"part": row["part"], "state": s, "filter": f, "paths": reach[s] * leave[to], "kept": int(docs[to]),
                                "removed": removed, "redundant": failing - removed, "good_lost": int(good[s] - good[to]),
                                "toxic_lost": int(toxic[s] - toxic[to])})
            ints = [pa.field(c, pa.int32()) for c in ("state", "filter")]
            longs = [pa.field(c, pa.int64()) for c in ("paths", "kept", "removed", "redundant", "good_lost", "toxic_lost")]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.string()), *ints, *longs]))


def lattice_edges(counts: DataFrame) -> DataFrame:
    """part, state, filter, paths (orders that take the edge), kept, removed, redundant, good_lost, toxic_lost of every
    edge of every part: ``filters * 2^(filters - 1)`` rows a part."""
    return counts.mapInArrow(_edges, EDGE_SCHEMA)


def shapley(edges: DataFrame) -> DataFrame:
    """part, filter, shapley (removals added up over all orders), unique_fails (fail this filter only)."""
    return edges.groupBy("part", "filter").agg(  # a filter's last edge leaves the state of all other filters
        F.sum(F.col("paths") * F.col("removed")).alias("shapley"), F.max_by("removed", "state").alias("unique_fails"))


def order_steps(edges: DataFrame, names: str = FILTERS) -> DataFrame:
    """part, filter_order, step (from 1), kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for
    every order of the filters: n! * n rows a part."""
    n = len(names)
    walks: dict[tuple[int, int], list] = {}
    for order in permutations(range(n)):
        state = 0
        for step, f in enumerate(order, 1):
            walks.setdefault((state, f), []).append(("".join(names[i] for i in order), step))
            state |= 1 << f
    assert sum(map(len, walks.values())) == n * factorial(n)
    literal = F.create_map(*[x for (s, f), own in walks.items() for x in (
        F.lit(s * n + f), F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step")) for o, k in own]))])
    whole = edges.join(shapley(edges), ["part", "filter"])
    steps = whole.select("*", F.explode(F.element_at(literal, F.col("state") * n + F.col("filter"))).alias("w"))
    return steps.select("part", "w.filter_order", "w.step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                        "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """Steps of all orders of the five filters, per part of the documents."""
    return order_steps(lattice_edges(mask_counts(failure_masks(docs, **columns), labels)))
