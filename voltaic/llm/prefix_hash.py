"""Operator 9: document fingerprints from prefix polynomial hashes.

``PrefixHash`` holds, for two moduli below 2^31, the array
``S[i] = sum of (c_t + 1) * B^t over t < i``: from it the hash of any span
follows in constant time (difference, times an inverse power), so any two
spans of any two texts can be compared, the longest common extension of two
places is found by binary search, and the hash of a concatenation follows from
its parts. All spans of ``window`` code points are hashed in one array
expression; the ``keep`` smallest distinct window hashes are a fingerprint's
sketch, and the likeness of two fingerprints is the share of equal values
among the ``keep`` smallest of their union (an estimate of the Jaccard
similarity of the window sets). Equal whole-text hashes give likeness 1.

``with_next`` puts every document next to its successor in id order without
a single sorted partition: ids are cut into buckets at approximate quantiles
of all ids, every bucket is one partition (one shuffle of the texts), and the
first document of each bucket is copied to the end of the bucket before it
(one row per bucket). Tasks stream over their rows and hold two texts.

Edge cases: NULL text is empty; NULL ids come first and ties are ordered by
the text's hash; texts shorter than a window are one window; the empty text
has no windows and is like nothing but another empty text; a single document
is its own successor; an empty table gives an empty result; other columns
are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaic.llm.common import shuffle_partitions, worker_cache

MODULI = (2147483647, 2147483629)  # primes
BASES = (911382323, 972663749)
WINDOW, KEEP = 24, 32


def _powers(k: int, n: int):
    """B^t and B^-t modulo ``MODULI[k]`` for t < n (grown by doubling, kept by the worker)."""
    import numpy as np
    tables = worker_cache().setdefault("powers", {})
    p = MODULI[k]
    if k not in tables or len(tables[k][0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for base in (BASES[k], pow(BASES[k], -1, p)):
            t = np.ones(1, np.uint64)
            while len(t) < size:
                t = np.concatenate([t, t * np.uint64(pow(base, len(t), p)) % np.uint64(p)])
            out.append(t.astype(np.uint32))
        tables[k] = out
    return tables[k]


class PrefixHash:
    """Prefix arrays of one text; positions are code points."""

    def __init__(self, text: str):
        import numpy as np
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n, self.prefix = len(codes), []
        for k, p in enumerate(MODULI):
            power = _powers(k, self.n + 1)[0]
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(codes * power[:self.n] % np.uint64(p), out=s[1:])
            self.prefix.append((s % np.uint64(p)).astype(np.uint32))

    def span(self, i: int, j: int) -> tuple[int, int]:
        """Hash of the span [i, j), the same wherever it stands."""
        return tuple((int(self.prefix[k][j]) - int(self.prefix[k][i])) * int(_powers(k, self.n + 1)[1][i]) % p
                     for k, p in enumerate(MODULI))

    def equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        return self.span(i, i + length) == other.span(j, j + length)

    def common_extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common span that starts at i here and at j there, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(i, other, j, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def windows(self, width: int, end: int | None = None):
        """Hashes (first modulus) of all spans of ``width`` in [0, end); of the whole if it is shorter."""
        import numpy as np
        end = self.n if end is None else end
        if not end:
            return np.zeros(0, np.uint64)
        width = min(width, end)
        p, s = np.uint64(MODULI[0]), self.prefix[0]
        inverse = _powers(0, self.n + 1)[1]
        difference = s[width:end + 1].astype(np.uint64) + p - s[:end + 1 - width]
        return difference % p * inverse[:end + 1 - width] % p


def concatenated(parts: list[tuple[int, tuple[int, int]]]) -> tuple[int, int]:
    """Hash of a text from (length, hash) of its parts."""
    out, at = [0, 0], 0
    for length, value in parts:
        out = [(out[k] + value[k] * pow(BASES[k], at, p)) % p for k, p in enumerate(MODULI)]
        at += length
    return tuple(out)


def smallest(hashes, keep: int = KEEP):
    """The ``keep`` smallest distinct values, ascending."""
    import numpy as np
    if len(hashes) > 16 * keep:  # most texts: a cut that leaves a few times as many as are needed
        few = np.unique(hashes[hashes < np.uint64(MODULI[0] * 8 * keep // len(hashes))])
        if len(few) >= keep:
            return few[:keep]
    return np.unique(hashes)[:keep]


def fingerprint(whole: tuple[int, int], sketch) -> str:
    """16 hexadecimal digits of the whole text's hash, then 8 for every value of the sketch."""
    return f"{(whole[0] << 31) | whole[1]:016x}" + "".join(f"{v:08x}" for v in sketch.tolist())


def likeness(a: str, b: str, keep: int = KEEP) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    x, y = ({f[i:i + 8] for i in range(16, len(f), 8)} for f in (a, b))
    union = sorted(x | y)[:keep]
    return sum(v in x and v in y for v in union) / len(union) if union else 0.0


def _edited(text: str, own: PrefixHash, own_windows, following: str, other: PrefixHash, other_windows):
    """Text, whole hash and sketch of ``text`` with its second half replaced by the start of ``following``."""
    import numpy as np
    half = own.n // 2
    keep, take = own.n - half, min(half, other.n)
    if not half:
        return text, own.span(0, own.n), smallest(own_windows)
    new = text[:keep] + following[:take]
    whole = concatenated([(keep, own.span(0, keep)), (take, other.span(0, take))])
    if min(keep, take) < WINDOW:
        return new, whole, smallest(PrefixHash(new).windows(WINDOW))
    seam = PrefixHash(text[keep - WINDOW + 1:keep] + following[:WINDOW - 1]).windows(WINDOW)
    parts = [own_windows[:keep - WINDOW + 1], seam, other_windows[:take - WINDOW + 1]]
    return new, whole, np.unique(np.concatenate([smallest(p) for p in parts]))[:KEEP]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """bucket, doc_id, text, tail, order: one partition per bucket of ids, in order; the last row of a bucket
    (tail) is the document that follows it in the next one (after the last: the first)."""
    spark = docs.sparkSession
    n = buckets or shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shares = [i / n for i in range(1, n)]
    cuts = sorted({int(q) for q in rows.approxQuantile("doc_id", shares, 1 / (4 * n))}) if n > 1 else []
    passed = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(passed).cast("int"))
    rows = rows.withColumn("order", F.xxhash64("text"))
    first = rows.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "order")).alias("f"))
    firsts = sorted(first.collect(), key=lambda r: r["bucket"])  # one row per bucket
    tails = [(r["f"]["doc_id"], r["f"]["order"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)]
    tails = spark.createDataFrame(tails, "tail_id long, tail_order long, tail_bucket int")
    marked = rows.join(F.broadcast(tails), F.col("doc_id").eqNullSafe(F.col("tail_id")) & (F.col("order") == F.col("tail_order")), "left")
    own, tail = (F.struct(F.col(b).alias("bucket"), F.lit(t).alias("tail")) for b, t in (("bucket", False), ("tail_bucket", True)))
    places = F.when(F.col("tail_bucket").isNull(), F.array(own)).otherwise(F.array(own, tail))
    placed = marked.select("doc_id", "text", "order", F.explode(places).alias("p")).select("p.bucket", "doc_id", "text", "p.tail", "order")
    return (placed.repartitionById(max(n, 1), F.col("bucket"))
            .sortWithinPartitions("bucket", "tail", F.col("doc_id").asc_nulls_first(), "order"))


def _compare():
    def run(batches):
        import hashlib

        import pyarrow as pa
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                            ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                            ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix", pa.int64())])
        held, out = None, []
        for batch in batches:
            for piece in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                for row in piece.select(["bucket", "doc_id", "text", "tail"]).to_pylist():
                    if held and (held["done"] or held["bucket"] != row["bucket"]):
                        held = None
                    text = row["text"]
                    state = PrefixHash(text)
                    windows = state.windows(WINDOW)
                    new = {"doc_id": row["doc_id"], "bucket": row["bucket"], "text": text, "state": state, "windows": windows,
                           "print": fingerprint(state.span(0, state.n), smallest(windows)), "done": row["tail"]}
                    if held:
                        edited, whole, sketch = _edited(held["text"], held["state"], held["windows"], text, state, windows)
                        mark = fingerprint(whole, sketch)
                        keep = held["state"].n - held["state"].n // 2
                        same = keep + held["state"].common_extension(keep, state, 0)
                        out.append((held["doc_id"], held["state"].n, hashlib.sha256(edited.encode()).hexdigest(), held["print"],
                                    mark, likeness(held["print"], mark), likeness(held["print"], new["print"]), same))
                    held = new
                if len(out) >= 1000:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    return run


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: fingerprint, the fingerprint of its edited text (second half replaced by the start of the next
    document), both likenesses, and the common prefix of text and edited text by longest common extension."""
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, common_prefix long")
    return with_next(docs, id_col, text_col).mapInArrow(_compare(), schema)
