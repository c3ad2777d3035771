import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brute import edge_docs, empty_docs
from voltaic.llm import queries, token_files
from voltaic.llm.encoder import Encoder
from voltaic.session import scratch_path

JSON = queries.vocabulary_json()


TOKENIZER, ENCODER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Encoder(JSON, cache_pieces=50, slice_chars=40, group=3)
TEXT = st.text(st.one_of(st.sampled_from(list(" \n\t\xa0 \x1c'sStTaé1.,!<|>endoftx你🙂")), st.characters(codec="utf-8")), max_size=200)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_pieces_and_slices_give_the_ids_of_the_whole_text(texts):
    got = [np.frombuffer(c, ENCODER.dtype).tolist() for c in ENCODER.encode(texts)]
    assert got == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


SPECIAL = ["a<|endoftext|>b", "<|endoftext|>", "x  <|endoftext|>  y\n<|endoftext|><|endoftext|> \u3000 z", "<|endoftext", "a <|endoftext|>" * 50]


def test_added_tokens_are_found_as_the_library_finds_them():
    got = [np.frombuffer(c, ENCODER.dtype).tolist() for c in ENCODER.encode(SPECIAL)]
    assert got == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in SPECIAL] and len(got[0]) == 3
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    got = [np.frombuffer(c, ENCODER.dtype).tolist() for c in Encoder(JSON, special_as_text=True).encode(SPECIAL)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in SPECIAL]


@pytest.mark.parametrize("flags", [{"lstrip": True}, {"rstrip": True}, {"single_word": True}, {"content": "of the"}])
def test_added_tokens_that_reach_beyond_a_piece(flags):
    spec = json.loads(JSON)
    spec["added_tokens"].append({"id": 50257, "content": "the", "single_word": False, "lstrip": False, "rstrip": False,
                                 "normalized": False, "special": False, **flags})
    own, encoder = Tokenizer.from_str(json.dumps(spec)), Encoder(json.dumps(spec))
    texts = ["one of the  many the\nothers breathe", "the", " the "]
    assert [np.frombuffer(c, encoder.dtype).tolist() for c in encoder.encode(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_of_all_white_space():
    spaces = [chr(c) for c in (*range(9, 14), 0x20, 0x1C, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x180E)]
    texts = [f"a{x}{y}b{y}" for x in spaces for y in spaces] + [f"é{x} {y}中 " for x in spaces for y in spaces]
    for encoder in (ENCODER, Encoder(JSON)):
        got = [np.frombuffer(c, encoder.dtype).tolist() for c in encoder.encode(texts)]
        assert got == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


def expected(rows):
    at, out = 0, []
    for doc_id, text in rows:
        ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_matches_plain_encoding(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = queries.op1_token_files(spark, sf).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected(rows)


@pytest.mark.parametrize("shards", [1, 5])
def test_edge_rows(spark, shards):
    out = scratch_path(spark, "t")
    docs = edge_docs(spark)
    index = token_files.write_token_files(docs, out, JSON, 2, shards=shards)
    got = token_files.read_token_files(spark, out).orderBy("start").collect()
    assert len(got) == docs.count()
    ids = [r["doc_id"] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(len(got))]
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(e[2:] for e in expected([(0, r["text"]) for r in docs.collect()]))
    bases = index.orderBy("shard").collect()
    assert [b["base"] for b in bases] == [sum(x["n_tokens"] for x in bases[:i]) for i in range(len(bases))]


def test_empty_table(spark):
    out = scratch_path(spark, "t")
    assert token_files.write_token_files(empty_docs(spark), out, JSON, 2).count() == 0
    assert token_files.read_token_files(spark, out).collect() == []


def test_two_vocabularies_in_one_session(spark):
    docs = spark.createDataFrame([(i, f"the example number {i} of <|endoftext|> them") for i in range(40)], "doc_id long, text string")
    spec = json.loads(JSON)
    spec["model"]["merges"] = spec["model"]["merges"][:200]
    for model in (JSON, json.dumps(spec), JSON):
        own = Tokenizer.from_str(model)
        out = scratch_path(spark, "t")
        token_files.write_token_files(docs, out, model, 2)
        got = {r["doc_id"]: r["n_tokens"] for r in token_files.read_token_files(spark, out).collect()}
        assert got == {r["doc_id"]: len(own.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect()}


def test_wide_ids_for_a_large_end_id(spark):
    out = scratch_path(spark, "t")
    index = token_files.write_token_files(edge_docs(spark), out, JSON, 70_000)
    assert {r["width"] for r in index.collect()} == {4}
    row = token_files.read_token_files(spark, out).where("n_tokens = 1").first()
    assert row["ids_crc32"] == zlib.crc32(np.array([70_000], "<u4").tobytes())
