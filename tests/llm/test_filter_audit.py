import random
import re
from itertools import permutations

import numpy as np
import pytest

import brute
from voltaic.llm import filter_audit, queries


def fails(text, doc_id, first):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": doc_id is not None and first is not None and doc_id > first}


def audited(docs, labels):
    """(doc_id, text, part) and (doc_id, quality, toxic) rows -> the audit, order by order."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    parts = {}
    for i, t, p in docs:
        parts.setdefault(p or "", []).append((fails(t, i, first.get(t or "")), i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        steps, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                total[f] += len(gone)
                steps.append((part, "".join(order), step, len(left), len(gone), sum(r[0][f] for r in rows) - len(gone),
                              sum(r[0][f] and sum(r[0].values()) == 1 for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*s, total[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def check(spark, docs, labels):
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in filter_audit.audit(docs, lab).collect())
    assert got == audited([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], labels)
    return got


def corpus():
    rng = random.Random(5)
    rows = []
    for i in range(150):
        n = rng.choice([0, 5, 199, 200, 201, 260])
        v = rng.choice([3, 100, 130, 10_000])
        t = " ".join(f"{rng.choice('xyzÀ')}{rng.randrange(v)}" for _ in range(n)) + rng.choice(["", " #", " A" * 40, "\x0b\x0c", " É"])
        rows.append((rng.randrange(140) if rng.random() < 0.9 else None, t, rng.choice(["en", "fr", None, ""])))
    rows += [(i, rows[k][1], "en") for i, k in ((200, 3), (1, 3), (201, 9), (None, 9))]
    return rows + [(7, "Aa" * 3, "de"), (7, "Aa" * 3, "de"), (500, None, "de"), (501, "", "es")]


def test_against_every_order(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, p, "k", 1) for i, t, p in rows], "doc_id long, text string, lang string, mask string, state int")
    rng = random.Random(6)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 220, 2), 4, 4, None]]
    got = check(spark, docs.repartition(3), labels)
    assert len(got) == 600 * 5


def test_thresholds_are_exact(spark):
    words = " ".join(f"w{i}" for i in range(100))
    upper = "A" * 3 + "b" * 97
    texts = [words + " " + words, words + " " + words + " w1", upper, upper + "A", "é" * 97 + "AAA", "é" * 97 + "AAAA", "a|b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS lang")
    masks = {r["doc_id"]: r["mask"] for r in filter_audit.failure_masks(docs).collect()}
    assert [masks[i] & 0b1111 for i in range(len(texts))] == [0, 0b10, 1, 0b101, 1, 0b101, 0b1001]


def test_edge_rows(spark):
    check(spark, brute.edge_docs(spark), [(7, 1, 0), (100, 1, 1), (None, 1, 1)])


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(brute.empty_docs(spark), labels).collect() == []
    assert filter_audit.audit(brute.edge_docs(spark), labels).count() == 600


@pytest.mark.parametrize("n", [1, 3, 6])
def test_paths_through_the_lattice(n):
    reach, leave = filter_audit.path_counts(n)
    assert reach[-1] == leave[0] == len(list(permutations(range(n))))
    counts = np.arange(1, (1 << n) + 1)
    kept = filter_audit._passing(counts)
    assert kept.tolist() == [sum(int(c) for m, c in enumerate(counts) if not m & s) for s in range(1 << n)]


def test_shapley_sums_share_out_all_removals(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in corpus()], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    edges = filter_audit.lattice_edges(filter_audit.mask_counts(filter_audit.failure_masks(docs), labels))
    shares = sum(r["shapley"] for r in filter_audit.shapley(edges).collect())
    last = filter_audit.order_steps(edges).where("step = 5").first()
    assert shares == 120 * (len(corpus()) - last["kept"])


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert sorted(tuple(r) for r in queries.op13_filter_audit(spark, sf).collect()) == audited(docs, labels)
