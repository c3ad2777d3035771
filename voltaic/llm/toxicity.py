"""Operator 7: toxic passages as maximum-scoring segments, calibrated by extreme-value statistics.

Training: the tokens are whole words and word stems (a word's first 3 to 8
characters, so that inflected and compounded insults count together). Tokens
get log-odds of toxic against clean labelled texts with an informative
Dirichlet prior, the prior being each token's share of the *whole* corpus; a
text counts a token once, so one repetitive text is no evidence. A token
scores the lower confidence bound of its log-odds if that is positive; a word
scores its best token, less a drift, so a random text scores below zero in the
long run. ``passage_share`` is the share of telling words that a toxic passage
is expected to have; it sets the drift.

Scoring: one scan per text (Ruzzo-Tompa, linear in the telling words) finds
every maximal scoring segment. With the word scores of the clean labelled
texts as background, lambda solves E[exp(lambda s)] = 1, a segment of score S in
a text of n words is expected K n exp(-lambda S) times by chance, and the best r
segments are aggregated by the sum statistic, corrected for the choice of r; r
takes in every segment expected less than once by chance, however many.
The text's p-value becomes a score through the prior share of toxic texts and
the largest evidence a p-value can stand for: odds against = -e p log p.

Labels are learnt from at most ``max_labelled`` rows (those of smallest id
hash): that bounds the join that brings labels to texts, the candidate tokens
sent to the tasks (each is in ``least`` or more toxic texts of the sample) and
the tokens that reach the driver. The corpus shares cover every document.

Edge cases: NULL and empty texts have no words, hence no passage, and score
the prior; label rows with NULL id or label are left out, repeated label rows
count once (toxic wins); without toxic or without clean labels no token is
significant; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from voltaic.llm.common import carried, small_batches, stored

_PASSAGE = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()),
                       StructField("score", DoubleType()), StructField("e_value", DoubleType())])
_OUT = [StructField("n_words", LongType()), StructField("score", DoubleType()), StructField("passages", ArrayType(_PASSAGE))]

STEMS = range(3, 9)


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    drift: float = 0.05
    rate: float = 1.0  # lambda
    k: float = 0.05
    prior: float = 0.05


def find_words(raw: bytes | None) -> list[str]:
    """Words of a UTF-8 text, A-Z lower-cased: the same cut as ``common.WORD_PATTERN``."""
    import re
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (raw or b"").lower().decode())


def tokens(word: str) -> list[str]:
    """The word and its stems (marked with an asterisk, which no word holds)."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def word_scores(model: Model, most: int = 150_000):
    """word -> score of its best token, with a cache that starts anew when it is full."""
    known, memo = model.scores, {}

    def of(word: str) -> float:
        value = memo.get(word)
        if value is None:
            if len(memo) >= most:
                memo.clear()
            value = memo[word] = max((known.get(t, 0.0) for t in tokens(word)), default=0.0) if known else 0.0
        return value
    return of


def sample_labels(labels: DataFrame, keep: Column, label_col: str, max_labelled: int) -> DataFrame:
    """doc_id, label of at most ``max_labelled`` labelled documents that satisfy ``keep``, by smallest id hash."""
    known = (labels.where(keep & F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label")))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)


def solve_rate(points: list[tuple[float, float]]) -> float:
    """The positive lambda with sum of p exp(lambda s) = 1 over (s, p); 1 if there is none."""
    if not any(s > 0 and p > 0 for s, p in points) or sum(s * p for s, p in points) >= 0:
        return 1.0
    total = lambda x: sum(p * math.exp(min(700.0, x * s)) for s, p in points)
    low, high = 0.0, 1.0
    while total(high) < 1 and high < 1e6:
        low, high = high, 2 * high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 1 else (low, mid)
    return high


def train(docs: DataFrame, labels: DataFrame, keep: Column, label_col: str = "toxic", max_labelled: int = 20_000,
          passage_share: float = 0.05, prior_share: float = 0.01, confidence: float = 2.0, least: int = 4) -> Model:
    """Fit the token scores on labelled rows that satisfy ``keep`` (a condition on the label rows)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    picked = stored(sample_labels(labels, keep, label_col, max_labelled), "toxicity-labels")
    # at most max_labelled rows are sent, and as many texts kept
    own = stored(rows.join(F.broadcast(picked), "doc_id").select("label", "text"), "toxicity-texts")
    counted = (own.mapInArrow(_document_tokens, "label int, token string, n long").groupBy("token")
               .agg(F.sum(F.col("n") * F.col("label")).alias("toxic"), F.sum(F.col("n") * (1 - F.col("label"))).alias("clean")))
    counted = stored(counted.where((F.col("toxic") >= least) | F.col("token").isNull()), "toxicity-tokens")
    words_of = counted.where("token IS NULL").first()  # all (text, word) pairs stand under NULL
    n_toxic, n_clean = (int(words_of[c] or 0) for c in ("toxic", "clean")) if words_of else (0, 0)
    share = picked.agg(F.avg("label")).first()[0]
    model = Model(drift=-math.log1p(-passage_share), k=passage_share, prior=min(0.2, max(0.01, share or 0.05)))
    if not n_toxic or not n_clean:
        return model
    maybe = counted.where(F.col("token").isNotNull() & (F.col("toxic") * n_clean > F.col("clean") * n_toxic))
    listed = docs.sparkSession.sparkContext.broadcast({r["token"] for r in maybe.select("token").collect()})
    corpus = stored(rows.select("text").mapInArrow(_corpus_tokens(listed), "token string, n long").groupBy("token")
                    .agg(F.sum("n").alias("n")), "toxicity-corpus")
    total = corpus.where("token IS NULL").first()["n"]
    prior = prior_share * (n_toxic + n_clean)
    joined = maybe.join(corpus, "token").withColumn("a", prior * F.col("n") / F.lit(total))
    up, down = F.col("toxic") + F.col("a"), F.col("clean") + F.col("a")
    odds = F.log(up / (n_toxic + prior - up)) - F.log(down / (n_clean + prior - down))
    bound = odds - confidence * F.sqrt(1 / up + 1 / down)
    model.scores = {r["token"]: r["score"] for r in joined.select("token", bound.alias("score")).where("score > 0").collect()}
    scale = own.where("label = 0").mapInArrow(_score_counts(model), "score double, n long").groupBy("score").agg(F.sum("n").alias("n"))
    counts = scale.collect()  # scores in steps of 0.01
    n = sum(r["n"] for r in counts)
    points = [(r["score"] - model.drift, r["n"] / n) for r in counts]
    model.rate = solve_rate(points)
    model.k = min(1.0, sum(p * math.exp(min(700.0, model.rate * s)) for s, p in points if s > 0) or passage_share)
    return model


def _document_tokens(batches, most: int = 200_000):
    """label, token, texts that hold it; under a NULL token the number of (text, word) pairs. Counts are handed on
    whenever there are more than ``most`` of them."""
    import pyarrow as pa

    def rows(counts):
        return pa.record_batch([pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.string()),
                                pa.array(list(counts.values()), pa.int64())], names=["label", "token", "n"])
    counts: dict = {}
    for batch in batches:
        for part in (batch.slice(i, 50) for i in range(0, batch.num_rows, 50)):
            for label, raw in zip(part.column("label").to_pylist(), part.column("text").to_pylist(), strict=True):
                own = set(find_words(raw))
                for t in {t for w in own for t in tokens(w)}:
                    counts[label, t] = counts.get((label, t), 0) + 1
                counts[label, None] = counts.get((label, None), 0) + len(own)
            if len(counts) > most:
                yield rows(counts)
                counts = {}
    if counts:
        yield rows(counts)


def _corpus_tokens(listed, most: int = 150_000):
    """token, texts of the corpus that hold it, for the listed tokens; under NULL all (text, word) pairs."""
    def run(batches):
        import pyarrow as pa
        wanted, memo, counts = listed.value, {}, {None: 0}
        texts = (raw for batch in batches for i in range(0, batch.num_rows, 200)
                 for raw in batch.slice(i, 200).column("text").to_pylist())
        for raw in texts:
            own = set(find_words(raw))
            counts[None] += len(own)
            held = set()
            for w in own:
                hit = memo.get(w)
                if hit is None:
                    if len(memo) >= most:
                        memo.clear()
                    hit = memo[w] = tuple(t for t in tokens(w) if t in wanted)
                held.update(hit)
            for t in held:
                counts[t] = counts.get(t, 0) + 1
        yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])
    return run


def _score_counts(model: Model):
    def run(batches):
        import pyarrow as pa
        of, counts = word_scores(model), {}
        for batch in batches:
            for raw in batch.column("text").to_pylist():
                for w in find_words(raw):
                    s = round(of(w), 2)
                    counts[s] = counts.get(s, 0) + 1
        yield pa.record_batch([pa.array(list(counts), pa.float64()), pa.array(list(counts.values()), pa.int64())], names=["score", "n"])
    return run


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) by one scan; ``hits`` are (position, score) of the words
    that score above the drift, in order; every other word costs ``drift``."""
    stack: list[list[float]] = []  # start, end, sum before the segment, sum after it, nearest one below with a smaller sum before
    total, last = 0.0, -1
    for at, score in hits:
        total -= drift * (at - last - 1)
        left, total, last = total, total + score - drift, at
        new = [at, at + 1, left, total, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3], -1]  # joins everything since segment j
            del stack[j:]
    return [(int(x[0]), int(x[1]), x[3] - x[2]) for x in stack]


def sum_tail(r: int, total: float) -> float:
    """Chance that the r best normalised segment scores of a random text sum to ``total`` or more.

    The scores x are the points of a Poisson process of rate exp(-x). Given g, the expected number of points above
    the r-th best (a gamma variable of shape r), the others exceed it by r - 1 exponential variables, so the chance
    is the mean over g of the gamma tail Q(r - 1, total + r log g). The usual exp(-t) t^(r-1) / (r! (r-1)!) is its
    limit for a large t and far too small for many moderate scores.
    """
    if r == 1:
        return -math.expm1(-math.exp(min(700.0, -total)))
    import numpy as np
    # the integrand is negligible outside: it rises to at most its value at log g = -total / r and is log-concave
    u = np.linspace(min(math.log(r), -total / r) - 40 / r - 4 / math.sqrt(r), math.log(r + 12 * math.sqrt(r) + 40), 600)
    z = np.maximum(0.0, total + r * u)
    log_z = np.log(np.maximum(z, 1e-300))
    term, tail = -z, np.where(z > 0, -z, 0.0)  # logs of exp(-z) z^j / j! and of their sum
    for j in range(1, r - 1):
        term = term + log_z - math.log(j)
        tail = np.logaddexp(tail, term)
    f = np.exp(r * u - np.exp(u) - math.lgamma(r) + np.where(z > 0, tail, 0.0))
    return min(1.0, float((f[1:] + f[:-1]).sum() * (u[1] - u[0]) / 2))


def p_value(scores: list[float], n: int, rate: float, k: float) -> float:
    """Chance of the best segment scores in a random text of n words: the smallest over r of the sum statistic of
    the r best, times 2^r for having chosen r. r runs over every segment expected less than once by chance; it ends
    early only where the chance is so small that the score is 1 already."""
    best, total = 1.0, 0.0
    chance = math.log(max(k * n, 1e-9))
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        if rate * s <= chance and r > 1:
            break
        total += rate * s - chance
        best = min(best, sum_tail(r, total) * 2.0 ** r)
        if best < 1e-30:
            break
    return best


def posterior(p: float, prior: float) -> float:
    """Chance of a toxic text from its p-value: the evidence against chance is at most 1 / (-e p log p)."""
    against = 1.0 if p >= 1 / math.e else -math.e * p * math.log(max(p, 1e-300))
    return prior / (prior + (1 - prior) * against)


def _score(model: Model, e_value: float):
    def run(batches):
        import pyarrow as pa
        of, drift = word_scores(model), model.drift
        schema = pa.schema([("n_words", pa.int64()), ("score", pa.float64()),
                            ("passages", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()),
                                                             ("score", pa.float64()), ("e_value", pa.float64())])))])
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                sizes, values, found = [], [], []
                for raw in part.column("text").to_pylist():
                    own = [of(w) for w in find_words(raw)]
                    n = len(own)
                    parts = segments([(i, s) for i, s in enumerate(own) if s > drift], drift)
                    p = p_value([s for _, _, s in parts], n, model.rate, model.k) if parts else 1.0
                    expected = [(a, b, s, model.k * n * math.exp(-min(700.0, model.rate * s))) for a, b, s in parts]
                    found.append([dict(zip(("start", "end", "score", "e_value"), x)) for x in expected if x[3] <= e_value])
                    sizes.append(n)
                    values.append(posterior(p, model.prior))
                yield pa.record_batch([part.column("row"), pa.array(sizes, pa.int64()), pa.array(values, pa.float64()),
                                       pa.array(found, schema.field("passages").type)],
                                      schema=pa.schema([batch.schema.field("row"), *schema]))
    return run


def score(docs: DataFrame, model: Model, e_value: float = 0.05, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """row (struct of the columns in ``carry``, doc_id if none are named), n_words, score, passages (start, end in
    words, score, e_value: the ones expected at most ``e_value`` times by chance)."""
    small_batches(docs.sparkSession)
    rows = docs.select(*carried(carry or ["doc_id"]), F.col(text_col).cast("string").cast("binary").alias("text"))
    out = StructType([rows.schema["row"], *_OUT])
    return rows.mapInArrow(_score(model, e_value), out)
