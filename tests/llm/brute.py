"""Plain-Python versions of the operators' contracts, for small inputs, and rows with every edge case."""

from __future__ import annotations

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def simhash(text, k=4):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not tokens:
        return 0
    grams = [" ".join(tokens[i:i + k]) for i in range(max(1, len(tokens) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=4):
    """Root position per fingerprint."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def contaminated(text, items, span=10):
    """(n_words, n_hit, item ids) against (item_id, text) items."""
    w = words(text)
    hit, ids = set(), set()
    for item, item_text in items:
        iw = words(item_text)
        n = min(span, len(iw))
        windows = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i:i + n]) in windows:
                hit.update(range(i, i + n))
                ids.add("" if item is None else str(item))
    return len(w), len(hit), sorted(ids)


def line_key(line):
    return lower(line.strip(BLANK))


def drop_lines(texts, min_docs=10, min_chars=1):
    """(n_lines, n_dropped, kept) per text."""
    seen = {}
    for t in texts:
        for k in {line_key(x) for x in (t or "").split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(line_key(x)) < min_chars or seen[line_key(x)] < min_docs]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


LONG = " ".join(f"w{i % 977}x" for i in range(30_000))

#: Texts with the cases every operator must stand: NULL, empty, blanks, repeats, other scripts, one very long text.
EDGE_TEXTS = [None, "", "   \n\t ", "One two three", "One two three", "Ünïcode ÉCLAIR straße 你好 世界 🙂🙂", "a", "\n\n\n",
              "tabs\tand\r\nreturns\x0b\x0c ends ", "It's we'll  they're   x y\xa0z\x1cq", LONG, LONG + " tail", None]


def edge_docs(spark, texts=EDGE_TEXTS):
    """documents with a NULL id, repeated ids and rows, and columns whose names operators use themselves."""
    rows = [(None if i == 3 else (7 if i in (6, 7) else 100 - i), t, "en", None, len(t) if t is not None else None,
             "x", 1, 2.0, "y") for i, t in enumerate(texts)]
    rows.append(rows[4])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, "
                                       "text_hash int, score double, bucket string")


def empty_docs(spark):
    return edge_docs(spark).where("false")
