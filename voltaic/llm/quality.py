"""Operator 6: quality classifier by positive-unlabelled learning.

Only trusted positives (labelled good) and unlabelled web text are used; no
text is ever taken as a negative. Texts are described by a few shares and
counts, each cut at quantiles of the whole corpus, so that the scorer is a sum
of step functions of the features. With the squared loss the unbiased risk
``prior R_p(+) + R_u(-) - prior R_p(-)`` and its non-negative form (the
estimated negative risk may not fall below zero) depend on the data only
through the first and second moments of the steps over positives and over
unlabelled texts: one pass over all documents sums them, and the driver
minimises the risk over a few hundred numbers.

The class prior is estimated from the same scorer: positives can make up no
larger a share of the unlabelled texts than ``U(s >= t) / P(s >= t)`` for any
threshold t; the smallest such ratio over thresholds that keep at least
``prior_mass`` of the positives is the estimate.

All counts, quantiles, moments and histograms cover every document; only
arrays of that fixed size reach the driver. Texts are parsed once (the
features are a written table of 15 numbers a document).

Edge cases: NULL and empty texts have the features of an empty text; label
rows with NULL id or label are left out, repeated ones count once; without
positives the scorer is constant at the prior's default; an empty table gives
an empty result; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaic.llm.common import stored

FEATURES = ["log_words", "word_bytes", "symbol_share", "mark_share", "stop_share", "upper_share", "digit_share", "distinct_share",
            "repeat_share", "top_share", "no_letter_share", "odd_end_share", "log_line_words", "repeated_line_share",
            "log_sentence_words"]
BINS = 12


@dataclass
class Model:
    cuts: list[list[float]]
    weights: list[float]
    prior: float


def text_features(raw: bytes) -> list[float]:
    """The features of one UTF-8 text."""
    import math
    n = max(1, len(raw))
    tokens = raw.split()
    w = max(1, len(tokens))
    lower = raw.translate(None, b"abcdefghijklmnopqrstuvwxyz")
    n_lower = len(raw) - len(lower)
    rest = lower.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    n_upper = len(lower) - len(rest)
    n_symbol = len(rest) - len(rest.translate(None, b"#$%&*|~^<>={}[]\\/@_+`"))
    n_mark = len(rest) - len(rest.translate(None, b"!?"))
    n_stop = len(rest) - len(rest.translate(None, b".,;:"))
    n_digit = len(rest) - len(rest.translate(None, b"0123456789"))
    counts: dict[bytes, int] = {}
    for t in tokens:
        counts[t] = counts.get(t, 0) + 1
    repeats = sum(map(bytes.__eq__, tokens, tokens[1:]))
    plain = b"0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    no_letter = sum(c for t, c in counts.items() if not t.strip(plain))
    odd_end = sum(c for t, c in counts.items() if t[-1] in b"#$%&*|~^<>={}[]\\/@_+`!?")
    lines = raw.split(b"\n")
    ends = sum(c for t, c in counts.items() if t[-1] in b".!?")
    return [math.log1p(len(tokens)), len(raw) / w, n_symbol / n, n_mark / n, n_stop / n, n_upper / max(1, n_upper + n_lower),
            n_digit / n, len(counts) / w ** 0.9, repeats / w, max(counts.values(), default=0) / w, no_letter / w, odd_end / w,
            math.log1p(len(tokens) / len(lines)), 1 - len(set(lines)) / len(lines), math.log1p(len(tokens) / (ends + 1))]


def _features(batches):
    import pyarrow as pa
    names = ["doc_id", *FEATURES]
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            rows = [text_features(t or b"") for t in part.column("text").to_pylist()]
            yield pa.record_batch([part.column("doc_id"), *[pa.array(c, pa.float64()) for c in zip(*rows)]], names=names)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_features, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def steps(columns, cuts):
    """Design matrix: a constant and, per feature, one 0/1 column per cut that the value is above."""
    import numpy as np
    parts = [np.ones((len(columns[0]), 1))]
    parts += [(np.asarray(c)[:, None] > np.array(t)[None, :]).astype(float) for c, t in zip(columns, cuts, strict=True)]
    return np.concatenate(parts, axis=1)


def _moments(cuts, size):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        total = {u: (0, np.zeros(size), np.zeros((size, size))) for u in (False, True)}
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                x = steps([part.column(f).to_numpy() for f in FEATURES], cuts)
                positive = part.column("positive").to_numpy(zero_copy_only=False)
                for which in (False, True):
                    own = x[positive] if which else x
                    n, first, second = total[which]
                    total[which] = n + len(own), first + own.sum(0), second + own.T @ own
        for which, (n, first, second) in total.items():
            yield pa.record_batch([[which], [n], [first.tolist()], [second.ravel().tolist()]],
                                  names=["positive", "n", "first", "second"])
    return run


def minimise(a_u, b_u, a_p, b_p, prior: float, ridge: float = 1e-3, rounds: int = 500):
    """Weights of the smallest non-negative risk, squared loss, from the moments of unlabelled and positive texts.

    The unbiased risk has its minimum in closed form. Where the negative risk estimate is below zero there, the
    non-negative risk ``prior R_p(+) + max(0, R_u(-) - prior R_p(-))`` is lower elsewhere: subgradient steps from
    that point, the best point wins.
    """
    import numpy as np
    d = len(b_u)
    penalty = ridge * np.eye(d)
    penalty[0, 0] = 0

    def squares(a, b, w, sign):
        return (1 + 2 * sign * (w @ b) + w @ a @ w) / 4

    def risks(w):
        return prior * squares(a_p, b_p, w, -1), squares(a_u, b_u, w, 1) - prior * squares(a_p, b_p, w, 1)

    def total(w):
        positive, negative = risks(w)
        return positive + max(0.0, negative) + w @ penalty @ w / 4
    w = best = np.linalg.lstsq(a_u + penalty, 2 * prior * b_p - b_u, rcond=None)[0]
    if risks(w)[1] < 0:
        step = 1 / (np.linalg.norm(a_u, 2) + prior * np.linalg.norm(a_p, 2) + ridge)
        for _ in range(rounds):
            grad = prior * (a_p @ w - b_p) / 2 + penalty @ w / 2
            if risks(w)[1] >= 0:
                grad = grad + (b_u + a_u @ w - prior * (b_p + a_p @ w)) / 2
            w = w - step * grad
            best = w if total(w) < total(best) else best
    return best


def _raw(weights, cuts):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        w = np.array(weights)
        for batch in batches:
            g = steps([batch.column(f).to_numpy() for f in FEATURES], cuts) @ w if batch.num_rows else np.zeros(0)
            yield pa.record_batch([batch.column("doc_id"), batch.column("positive"), g], names=["doc_id", "positive", "g"])
    return run


def estimate_prior(histogram: list[tuple[float, int, int]], prior_mass: float) -> float:
    """Smallest U(s >= t) / P(s >= t) from (score bin, unlabelled, positives), over t with enough positives above."""
    n_u, n_p = sum(h[1] for h in histogram), sum(h[2] for h in histogram)
    best, u, p = 1.0, 0, 0
    for _, du, dp in sorted(histogram, reverse=True):
        u, p = u + du, p + dp
        if p >= prior_mass * n_p and p:
            best = min(best, (u / n_u) / (p / n_p))
    return best


def train(described: DataFrame, positives: DataFrame, unlabelled: Column, prior_mass: float = 0.3) -> Model:
    """``described``: the features of all documents; ``positives``: doc_id of trusted ones; ``unlabelled``: condition
    on doc_id of the documents to learn from."""
    import numpy as np
    relative = 1 / (8 * BINS)
    cuts = described.approxQuantile(FEATURES, [i / BINS for i in range(BINS + 1)], relative)
    cuts = [sorted(set(c[:-1])) for c in cuts]
    size = 1 + sum(map(len, cuts))
    marks = positives.select(F.col("doc_id").alias("key")).where("key IS NOT NULL").distinct().withColumn("hit", F.lit(True))
    rows = (described.where(unlabelled).join(marks, F.col("doc_id") == F.col("key"), "left")
            .withColumn("positive", F.coalesce("hit", F.lit(False))).select("doc_id", "positive", *FEATURES))
    rows = stored(rows, "quality-rows")
    moments = stored(rows.mapInArrow(_moments(cuts, size), "positive boolean, n long, first array<double>, second array<double>"),
                     "quality-moments")

    def summed(col: str):
        at = moments.select("positive", F.posexplode(col).alias("at", "v")).groupBy("positive", "at").agg(F.sum("v").alias("v"))
        out = {True: np.zeros(size if col == "first" else size * size), False: np.zeros(size if col == "first" else size * size)}
        for r in at.collect():  # a number for every moment
            out[r["positive"]][r["at"]] = r["v"]
        return out
    n = {r["positive"]: r["n"] for r in moments.groupBy("positive").agg(F.sum("n").alias("n")).collect()}
    if not n.get(True):
        return Model(cuts, [0.0] * size, 0.5)
    first, second = summed("first"), summed("second")
    b = {k: first[k] / n[k] for k in (True, False)}
    a = {k: second[k].reshape(size, size) / n[k] for k in (True, False)}
    trial = minimise(a[False], b[False], a[True], b[True], 1.0)
    scored = rows.mapInArrow(_raw(trial.tolist(), cuts), "doc_id long, positive boolean, g double")
    bins = (scored.groupBy(F.floor(F.col("g") * 50).alias("bin"))
            .agg(F.count("*").alias("u"), F.count_if("positive").alias("p")).collect())  # one row per score bin
    prior = min(0.99, max(0.05, estimate_prior([(r["bin"], r["u"], r["p"]) for r in bins], prior_mass)))
    return Model(cuts, minimise(a[False], b[False], a[True], b[True], prior).tolist(), prior)


def score(described: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: the estimated chance that a text is good, (g + 1) / 2 within 0 and 1."""
    flagged = described.withColumn("positive", F.lit(False)).select("doc_id", "positive", *FEATURES)
    raw = flagged.mapInArrow(_raw(model.weights, model.cuts), "doc_id long, positive boolean, g double")
    return raw.select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("g") + 1) / 2)).alias("score"))
