import hashlib
import json
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from brute import EDGE_TEXTS, edge_docs, empty_docs
from voltaic.llm import bpe, queries
from voltaic.llm.encoder import Encoder

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
MODEL = queries.rank_model()
ENCODER = Encoder(MODEL, cache_pieces=50, group=3, splits_at_space=True)
TEXT = st.text(st.one_of(st.sampled_from(list(" \n\t\xa0'sStTaaaabé1.,!-----你🙂")), st.characters(codec="utf-8")), max_size=120)


def test_the_pattern_is_the_one_that_is_safe_to_cut_at_spaces():
    assert bpe.SPACE_SAFE_PATTERN == P.PATTERN and bpe._options(MODEL)["splits_at_space"]


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_same_ids_as_the_rank_encoder(texts):
    got = [np.frombuffer(c, ENCODER.dtype).tolist() for c in ENCODER.encode(texts)]
    assert got == [REFERENCE.encode_ordinary(t) for t in texts]


def test_runs_of_one_character():
    texts = [c * n for c in "a -=\n0é" for n in range(1, 60)]
    got = [np.frombuffer(c, ENCODER.dtype).tolist() for c in ENCODER.encode(texts)]
    assert got == [REFERENCE.encode_ordinary(t) for t in texts]


def test_workers_never_hold_the_model_as_python_objects(monkeypatch):
    read = []
    monkeypatch.setattr(json, "loads", lambda text, real=json.loads: read.append(len(text)) or real(text))
    encoder = Encoder(MODEL, splits_at_space=True)
    assert encoder.pieces and max(read, default=0) < 10_000
    joined, lengths = bpe.token_bytes(MODEL)  # on the driver
    assert lengths == [len(t) for t in sorted(RANKS, key=RANKS.get)] and len(joined) == sum(lengths)
    table = SimpleNamespace(value=(joined, np.array(lengths, np.int64).tobytes()))
    read.clear()
    ids = np.array(REFERENCE.encode_ordinary("a word, 你"), "<u4").tobytes()
    out = list(bpe._decode(table, True)(iter([pa.record_batch([pa.array([1]), pa.array([ids])], names=["doc_id", "ids"])])))
    assert out[0].to_pylist()[0]["text"] == "a word, 你" and not read


def test_round_trip_offsets_and_split_characters(spark):
    docs = edge_docs(spark)
    rows = bpe.decode(bpe.encode(docs, MODEL, offsets=True), MODEL).collect()
    assert sorted(r["text"] for r in rows) == sorted(t["text"] or "" for t in docs.collect())
    for r in rows:
        ids, text = np.frombuffer(r["ids"], "<u4").tolist(), r["text"]
        if len(text) > 1000:
            continue
        assert ids == REFERENCE.encode_ordinary(text) and r["n_tokens"] == len(ids)
        at, split = 0, 0
        raw = text.encode()
        for i, start, end in zip(ids, r["starts"], r["ends"], strict=True):
            token = REFERENCE.decode_single_token_bytes(i)
            cut = (raw[at] & 0xC0) == 0x80
            split += cut
            assert start == len(raw[:at].decode(errors="ignore")) - 0 * cut
            assert token in text[start:end].encode()
            at += len(token)
        assert r["split_chars"] == split
    assert any(r["split_chars"] for r in rows)


def test_round_trip_in_one_worker_gives_the_rows_of_both_steps(spark):
    docs = edge_docs(spark)
    docs = docs.unionByName(docs)  # repeated rows stay
    both = bpe.decode(bpe.encode(docs, MODEL, offsets=True), MODEL)
    once = bpe.round_trip(docs, MODEL, offsets=True)
    assert once.dtypes == both.dtypes
    assert sorted(map(repr, once.collect())) == sorted(map(repr, both.collect()))
    assert bpe.round_trip(empty_docs(spark), MODEL).collect() == []


def test_digests_take_one_python_worker_per_task(spark):
    plan = queries.bpe_digests(edge_docs(spark), MODEL, keep_ids=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_cut_sequences_decode_to_replacement_characters(spark):
    ids = REFERENCE.encode_ordinary("🙂")
    assert len(ids) > 1
    df = spark.createDataFrame([(1, bytearray(np.array(ids[:1], "<u4").tobytes()))], "doc_id long, ids binary")
    assert "�" in bpe.decode(df, MODEL).first()["text"]


def test_empty_table(spark):
    assert bpe.decode(bpe.encode(empty_docs(spark), MODEL), MODEL).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op3_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = REFERENCE.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert EDGE_TEXTS
