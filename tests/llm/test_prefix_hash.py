import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from voltaic.llm import queries
from voltaic.llm import prefix_hash as ph

TEXT = st.text(st.sampled_from(list("abAB \né你🙂")), max_size=80)


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT, st.integers(0, 80), st.integers(0, 80), st.integers(0, 20))
def test_spans_and_extensions(a, b, i, j, n):
    x, y = ph.PrefixHash(a), ph.PrefixHash(b)
    i, j = min(i, x.n), min(j, y.n)
    length = min(n, x.n - i, y.n - j)
    assert x.equal(i, y, j, length) == (a[i:i + length] == b[j:j + length])
    k = 0
    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
        k += 1
    assert x.common_extension(i, y, j) == k
    assert ph.concatenated([(x.n, x.span(0, x.n)), (y.n, y.span(0, y.n))]) == ph.PrefixHash(a + b).span(0, x.n + y.n)
    for w in (1, 3):
        spans = [x.span(s, s + min(w, x.n))[0] for s in range(max(0, x.n - w) + 1)] if x.n else []
        assert x.windows(w).tolist() == spans


def plain_print(text):
    h = ph.PrefixHash(text)
    return ph.fingerprint(h.span(0, h.n), ph.smallest(h.windows(ph.WINDOW)))


def expected(rows):
    """rows in order: (doc_id, text)"""
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = map(plain_print, (text, edited, after))
        common = next((i for i, (x, y) in enumerate(zip(text, edited)) if x != y), min(len(text), len(edited)))
        out.append((doc_id, len(text), brute.sha256(edited), a, b, ph.likeness(a, b), ph.likeness(a, c), common))
    return out


@pytest.mark.parametrize("buckets", [1, 4, 50])
def test_documents(spark, buckets):
    texts = [*brute.EDGE_TEXTS, "x" * 300, "ab" * 400, "short", "text " * 30]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "b", 1) for i, t in rows], "doc_id long, text string, bucket string, tail int").repartition(3)
    got = ph.with_next(docs, buckets=buckets).mapInArrow(ph._compare(), ph.compare_with_edits(docs).schema).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected(rows)


def test_likeness():
    a, b = " ".join(f"w{i}" for i in range(400)), " ".join(f"v{i}" for i in range(400))
    x, y, z = map(plain_print, (a, b, a[:len(a) // 2] + b[:len(b) // 2]))
    assert ph.likeness(x, x) == 1 and ph.likeness(x, y) < 0.1 < ph.likeness(x, z) < 0.7
    assert ph.likeness(plain_print(""), plain_print("")) == 1 and ph.likeness(plain_print(""), x) == 0


def test_null_ids_ties_and_repeats(spark):
    docs = brute.edge_docs(spark)
    got = ph.compare_with_edits(docs).collect()
    assert sorted(str((r["doc_id"], r["fingerprint"])) for r in got) == sorted(
        str((r["doc_id"], plain_print(r["text"] or ""))) for r in docs.collect())


def test_single_document_and_empty_table(spark):
    one = spark.createDataFrame([(5, "some text")], "doc_id long, text string")
    assert [tuple(r) for r in ph.compare_with_edits(one).collect()] == expected([(5, "some text")])
    assert ph.compare_with_edits(brute.empty_docs(spark)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = [tuple(r) for r in queries.op9_prefix_fingerprints(spark, sf).orderBy("doc_id").collect()]
    assert got == expected(rows)
    assert sum(r[5] for r in got) > 5 * sum(r[6] for r in got)
