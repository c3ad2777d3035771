import random

import numpy as np
import pytest

import brute
from voltaic.llm import queries, simhash


def test_fingerprint_of_one_text():
    for text in brute.EDGE_TEXTS[:-3]:
        assert simhash.text_fingerprint((text or "").encode()) == brute.simhash(text)
    assert simhash.text_fingerprint(brute.LONG.encode(), at_once=1000) == brute.simhash(brute.LONG)


def crowd(seed, n):
    """Numbers in chains and stars of few differing bits, and strangers."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        x = rng.getrandbits(64)
        out.append(x)
        for _ in range(rng.choice([0, 0, 3, 12])):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            out.append(x)
            if rng.random() < 0.5:
                x = out[-2]
    return out[:n]


@pytest.mark.parametrize("tile_rows", [7, 32768])
def test_links_connect_exactly_what_is_within_the_radius(spark, tile_rows):
    prints = [*crowd(1, 400), 0, 1, (1 << 64) - 1]
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in signed + signed[:50]], "fingerprint long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.linked(df, 4, tile_rows)).collect()}
    want = brute.components(prints)
    groups = {}
    for p, r in zip(signed, want, strict=True):
        groups.setdefault(r, set()).add(p)
    for members in groups.values():
        assert {roots.get(p, p) for p in members} == {min(members)}


def test_one_tile_pair_emits_at_most_a_row_per_fingerprint():
    base = np.array([1 << b for b in range(40)] + [0], np.int64)
    child, root = simhash.compare_tiles(base, base, True, 4)
    assert len(child) == len(base) - 1 and set(root.tolist()) == {0}


def near_copies(n=40):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(500)]
    text = [rng.choice(vocabulary) for _ in range(400)]
    out = []
    for i in range(n):
        copy = list(text)
        copy[i * 9] = "changed"
        out.append(" ".join(copy))
    return out + [" ".join(rng.choice(vocabulary) for _ in range(50)) for _ in range(20)]


def test_documents(spark):
    docs = brute.edge_docs(spark, brute.EDGE_TEXTS + near_copies())
    rows = docs.select("doc_id", "text").collect()
    prints = [brute.simhash(r["text"]) for r in rows]
    roots = brute.components(prints)
    first = {}
    for r, root in zip(rows, roots, strict=True):
        if r["doc_id"] is not None:
            first[root] = min(first.get(root, r["doc_id"]), r["doc_id"])
    want = sorted(((r["doc_id"], f"{p:016x}", first.get(root)) for r, p, root in zip(rows, prints, roots, strict=True)), key=str)
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    assert len(set(first.values())) < len(rows) - 30


def test_empty_table(spark):
    assert simhash.near_duplicates(brute.empty_docs(spark)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    prints = [brute.simhash(r["text"]) for r in rows]
    roots = brute.components(prints)
    want = [(r["doc_id"], f"{p:016x}", rows[root]["doc_id"]) for r, p, root in zip(rows, prints, roots, strict=True)]
    assert [tuple(r) for r in queries.op4_simhash(spark, sf).orderBy("doc_id").collect()] == want


def test_groups_are_written_before_they_are_joined(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, "")], "doc_id long, text string")
    plan = simhash.near_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan  # the plans of the steps before are not part of it
