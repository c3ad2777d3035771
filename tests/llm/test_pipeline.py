import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__
import brute
import corpus_pipeline
from voltaic.llm import bpe, queries, toxicity

RANKS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def plain(rows, toxic_ids, items):
    """The pipeline in plain Python over {doc_id: text}; toxicity's decision is tested on its own."""
    rows = {i: t for i, t in rows.items() if i not in toxic_ids}
    ids = sorted(rows)
    rows = {i: kept for i, (_, _, kept) in zip(ids, brute.drop_lines([rows[i] for i in ids]), strict=True)}
    roots = brute.components([brute.simhash(rows[i]) for i in ids])
    rows = {ids[k]: rows[ids[k]] for k, r in enumerate(roots) if r == k}
    return {i: t for i, t in rows.items() if not brute.contaminated(t, items)[1]}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_run_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = queries.toxicity_model(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).where("score >= 0.3").select("row.doc_id").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = plain({r["doc_id"]: r["text"] for r in docs.collect()}, toxic, items)
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(want) and len(got) == len(want)
    for r in got:
        ids = RANKS.encode_ordinary(want[r["doc_id"]])
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert r["decoded_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()


def tables(spark, monkeypatch, docs):
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "w5x w6x w7x w8x w9x w10x w11x w12x w13x w14x w15x")], "item_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, name: {"documents": docs, "labels": labels, "benchmark": bench}[name])


def test_stages_keep_the_columns_of_documents_and_stand_edge_rows(spark, monkeypatch):
    docs = brute.edge_docs(spark)
    tables(spark, monkeypatch, docs)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, "unused")
        assert docs.columns == corpus_pipeline.COLUMNS and [t for _, t in docs.dtypes] == ["bigint", "string", "string", "string", "bigint"]
        assert 0 < docs.count() <= before.count()
    kept = {r["text"] for r in docs.collect()}
    assert brute.LONG not in kept and "a" in kept and "One two three" in kept
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "unused").count() == docs.count()


def test_empty_table_passes_through(spark, monkeypatch):
    tables(spark, monkeypatch, brute.empty_docs(spark))
    assert corpus_pipeline.run(spark, "unused").collect() == []


def test_registered():
    names = list(__spark_entry__.queries())
    assert [n for n in names if n.startswith("op")] == list(queries.QUERIES) and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(names)
