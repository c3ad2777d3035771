"""Operator 4: SimHash near-dedup by tiled exact comparison.

``fingerprints`` takes whole texts, lower-cases A-Z, cuts words at ASCII white
space and hashes every k-word shingle (repeats included) with XXH64; bit b of
the 64-bit fingerprint is set if bit b is set in more than half of the hashes.

``linked`` finds every pair of different fingerprints within ``radius`` bits
without a hash index that could miss one: the distinct fingerprints are laid
out in tiles by the population counts of their two halves. Two fingerprints
whose counts differ by more than ``radius`` in sum differ in more bits than
that, so only tiles of neighbouring counts are paired; inside a pair the same
bound on the four quarter counts picks the rows that are compared by numpy
exclusive-or and bit counts. A tile holds about ``tile_rows`` fingerprints, so
crowded counts are spread over many tiles and tasks.

A tile pair does not emit its pairs: it joins them in a local union-find and
emits one link from each member to the smallest of its set, at most one row
per fingerprint, whatever the size of a group of near copies; no connection is
lost. ``components`` then joins the links of all tile pairs (alternating large
and small star steps over written tables until nothing changes).

The comparison grows with the square of the number of *distinct* fingerprints
over the pruning factor (about 1/8 of all pairs pass the quarter bound on
random fingerprints); exact copies cost nothing. See the README for figures.

Edge cases: NULL, empty and blank texts have no words and the fingerprint
zero, linked like any other; fewer than k words hash the whole sequence;
repeated rows each get a row; a NULL id gets its component but cannot name it
(NULL if the whole component has no id); an empty table gives an empty result;
other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaic.llm.common import shuffle_partitions, small_batches, spread_join, stored

SEED = 42


def text_fingerprint(text: bytes, words: int = 4, seed: int = SEED, at_once: int = 1 << 16) -> int:
    """Fingerprint of one UTF-8 text as an unsigned 64-bit number."""
    import numpy as np
    import xxhash
    tokens = text.lower().split()  # bytes: A-Z alone change case, ASCII white space alone separates
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    starts, ends = starts[:n].tolist(), ends[min(words, len(tokens)) - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, at_once):
        hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[k:k + at_once], ends[k:k + at_once])),
                             "<u8", min(at_once, n - k))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprint(words: int, seed: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                prints = [text_fingerprint(t or b"", words, seed) for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), part.column("text_hash"), np.array(prints, np.uint64).view(np.int64)],
                                      names=["doc_id", "text_hash", "fingerprint"])
    return run


def fingerprints(docs: DataFrame, words: int = 4, seed: int = SEED, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and fingerprint (signed long with the fingerprint's 64 bits), one row per document."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                       text.cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprint(words, seed), "doc_id long, text_hash long, fingerprint long")


def _counts(fp: Column) -> tuple[Column, Column]:
    low = fp.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.bit_count(F.shiftrightunsigned(fp, 32)), F.bit_count(low)


def compare_tiles(a, b, same: bool, radius: int, block: int = 1 << 21):
    """(child, parent) arrays: every fingerprint of the two tiles that is linked to another, with the smallest
    (as a signed number) of its connected set."""
    import numpy as np
    nodes = np.unique(np.concatenate([a, b]))
    label = np.arange(len(nodes))  # always the root itself

    def join(u, v):
        """Unite u[i] with v[i] for all i: star by star, so that a crowd of links costs a few array passes."""
        while True:
            lu, lv = label[u], label[v]
            open_ = lu != lv
            if not open_.any():
                return
            u, v, lu, lv = u[open_], v[open_], lu[open_], lv[open_]
            high, low = np.maximum(lu, lv), np.minimum(lu, lv)
            np.minimum.at(label, high, low)  # each root under the smallest it is linked to
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up

    def quarters(x):
        return np.stack([np.bitwise_count((x >> np.uint64(s)) & np.uint64(0xFFFF)) for s in (48, 32, 16, 0)]).astype(np.int8)

    a, b = np.sort(a).view(np.uint64), np.sort(b).view(np.uint64)
    qa, qb = quarters(a), quarters(b)
    kinds, which = np.unique(qa, axis=1, return_inverse=True)
    which = which.reshape(-1)
    order, bounds = np.argsort(which, kind="stable"), np.cumsum(np.bincount(which, minlength=kinds.shape[1]))
    for k in range(kinds.shape[1]):
        rows = order[bounds[k - 1] if k else 0:bounds[k]]
        near = np.flatnonzero(np.abs(qb - kinds[:, k:k + 1]).sum(0) <= radius)
        if not len(near):
            continue
        right = b[near]
        step = max(1, block // len(near))
        for i in range(0, len(rows), step):
            left = a[rows[i:i + step]]
            x, y = np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= radius)
            left, right_hit = left[x], right[y]
            other = left != right_hit
            if same:  # each pair once
                other &= left < right_hit
            u = np.searchsorted(nodes, left[other].view(np.int64))
            v = np.searchsorted(nodes, right_hit[other].view(np.int64))
            join(u, v)
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _compare(radius: int):
    def run(batches):
        import pyarrow as pa
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        for batch in batches:
            a_col, b_col, same = batch.column("a"), batch.column("b"), batch.column("same").to_pylist()
            for i in range(batch.num_rows):
                a = a_col[i].values.to_numpy(zero_copy_only=False)
                b = b_col[i].values.to_numpy(zero_copy_only=False)
                child, to = compare_tiles(a, b, same[i], radius)
                if len(child):
                    yield pa.record_batch([child, to], schema=schema)
    return run


def linked(prints: DataFrame, radius: int = 4, tile_rows: int = 32768) -> DataFrame:
    """Links (u, v) between different fingerprints of column ``fingerprint``: connected through them are exactly
    the fingerprints connected by steps of at most ``radius`` bits."""
    spark = prints.sparkSession
    high, low = _counts(F.col("fingerprint"))
    distinct = stored(prints.select("fingerprint").where("fingerprint IS NOT NULL").distinct(), "simhash-distinct")
    cells = distinct.groupBy(high.alias("high"), low.alias("low")).agg(F.count("*").alias("n"))
    # at most 33 x 33 cells: small enough to send to every task at any input size
    cells = F.broadcast(stored(cells.select("high", "low", F.ceil(F.col("n") / tile_rows).alias("chunks")), "simhash-cells"))
    tiles = (distinct.select("fingerprint", high.alias("high"), low.alias("low")).join(cells, ["high", "low"])
             .withColumn("chunk", F.pmod(F.xxhash64("fingerprint"), F.col("chunks")))
             .groupBy("high", "low", "chunk").agg(F.collect_list("fingerprint").alias("rows")))
    tiles = stored(tiles, "simhash-tiles")
    steps = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius]
    key = ["ah", "al", "ac", "bh", "bl", "bc"]

    def side(own: str, other: str, sign: int) -> DataFrame:
        """Each tile once for every tile it is compared with, as the smaller (a) or the greater (b) one."""
        near = F.explode(F.array(*[F.struct(F.lit(sign * i).alias("dh"), F.lit(sign * j).alias("dl"))
                                   for i, j in steps if (i, j) >= (0, 0)])).alias("d")
        at = cells.select(F.col("high").alias(f"{other}h"), F.col("low").alias(f"{other}l"), F.col("chunks").alias("k"))
        out = (tiles.select(F.col("high").alias(f"{own}h"), F.col("low").alias(f"{own}l"), F.col("chunk").alias(f"{own}c"),
                            F.col("rows").alias(own), near)
               .withColumn(f"{other}h", F.col(f"{own}h") + F.col("d.dh")).withColumn(f"{other}l", F.col(f"{own}l") + F.col("d.dl"))
               .join(at, [f"{other}h", f"{other}l"])
               .withColumn(f"{other}c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))))
        same = (F.col("ah") == F.col("bh")) & (F.col("al") == F.col("bl"))
        return out.where(~same | (F.col("ac") <= F.col("bc"))).select(*key, own)

    n = shuffle_partitions(spark)
    pairs = (side("a", "b", 1).repartition(n, *key).join(side("b", "a", -1).repartition(n, *key), key)
             .select("a", "b", ((F.col("ah") == F.col("bh")) & (F.col("al") == F.col("bl"))
                                & (F.col("ac") == F.col("bc"))).alias("same")))
    return pairs.mapInArrow(_compare(radius), "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (u, v: long): root is the smallest node connected to it.

    Large-star then small-star steps, each a written table. Nodes are never collected.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(edges, "links")
    state, total = None, 2 * edges.count()
    while True:
        # the star of a hub is spread over the tasks: its smallest neighbour is brought to its edges
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both, low, ["u"], total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large, "links-large")  # the small-star step names it six times: as a plan it fills the driver
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = (spread_join(large, low, ["u"], total).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))))
        edges = stored(small.distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, total = now, 2 * now[0]


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = SEED, tile_rows: int = 32768,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fingerprint (16 hexadecimal digits) and component_id: the smallest doc_id reachable over links of
    at most ``radius`` differing bits, itself included."""
    prints = stored(fingerprints(docs, words, seed, id_col, text_col), "simhash")
    roots = components(linked(prints, radius, tile_rows)).withColumnRenamed("node", "fingerprint")
    first = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count("*").alias("docs"))
    grouped = first.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    named = stored(grouped.select("fingerprint", "root", "first", "docs"), "simhash-groups")
    # a component of many fingerprints, a fingerprint of many documents: neither meets in one task
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    sizes = named.agg(F.count("*"), F.coalesce(F.sum("docs"), F.lit(0))).first()
    by_print = spread_join(named, ids, ["root"], sizes[0]).select("fingerprint", "component_id", F.col("docs").alias("n"))
    by_print = stored(by_print, "simhash-components")
    return spread_join(prints, by_print, ["fingerprint"], sizes[1]).select(
        "doc_id", "text_hash", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
