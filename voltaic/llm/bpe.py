"""Operator 3: byte-level BPE encoding and decoding by a rank file.

``tokenizer_json`` turns ranks (bytes -> id) and a split pattern into a
``tokenizers`` BPE model over the byte-to-character alphabet: every way to
join two ranked tokens into a ranked token is a merge, in rank order, and a
match that is itself a token is taken whole, as rank-based encoders do.
``encode`` runs it over Arrow batches and maps bytes back to characters:
a token's start and end are offsets in characters of the text, and a token
border inside a character counts as a split character. ``decode`` reverses
the byte table and joins the bytes before it reads them as UTF-8, so split
characters come back whole. ``round_trip`` does both in one pass over the rows.

All are narrow map stages: no shuffle, memory bounded by one batch and the
longest text. Edge cases: NULL text is the empty text (no ids); texts of any
length are encoded in slices with the same ids; repeated rows stay; an empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import base64
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaic.llm.common import release_memory, small_batches
from voltaic.llm.encoder import byte_table, worker_encoder
from voltaic.llm.spans import gather, utf8

# FIXED VALUE: the split pattern of the rank files that ship with the public tokenizers
SPACE_SAFE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file: one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """The ranks as a ``tokenizers`` model (JSON text)."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers
    chars = byte_table()
    name = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        pairs = [(token[:i], token[i:]) for i in range(1, len(token))]
        pairs = [p for p in pairs if p[0] in ranks and p[1] in ranks]
        merges += [(name[a], name[b]) for a, b in sorted(pairs, key=lambda p: (ranks[p[0]], ranks[p[1]]))]
    tokenizer = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer.to_str()


def _options(model: str) -> dict:
    split = json.loads(model)["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex")
    return {"splits_at_space": split == SPACE_SAFE_PATTERN, "cache_pieces": 100_000, "slice_chars": 1 << 20, "special_as_text": True}


def _encode(model, options: dict, offsets: bool, part_rows: int = 256):
    def run(batches):
        import pyarrow as pa
        encoder = worker_encoder(model.value, **options)
        for batch in batches:
            for part in (batch.slice(i, part_rows) for i in range(0, batch.num_rows, part_rows)):
                ids, bounds = encoder.encode_column(part.column(1))
                raw, at = utf8(part.column(1))
                counts = np.diff(bounds)
                first = (raw & 0xC0) != 0x80  # bytes that begin a character
                size = encoder.lengths[ids]
                ends = np.cumsum(size)
                begins = ends - size
                split = np.concatenate([[0], np.cumsum(~first[begins])])
                wide = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [
                    None, pa.py_buffer(bounds * 4), pa.py_buffer(ids.astype("<u4"))])
                cols = [part.column(0).cast(pa.int64()), wide.cast(pa.binary()), counts, np.diff(split[bounds])]
                names = ["doc_id", "ids", "n_tokens", "split_chars"]
                if offsets:
                    char = np.cumsum(first) - 1  # byte -> character
                    base = np.repeat(np.concatenate([[0], np.cumsum(first)])[at[:-1]], counts)
                    cols += [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v, pa.int32()))
                             for v in (char[begins] - base, char[ends - 1] + 1 - base)]
                    names += ["starts", "ends"]
                yield pa.record_batch(cols, names=names)
    return run


def _encoding(docs: DataFrame, model: str, offsets: bool, id_col: str, text_col: str):
    """(rows, what a worker does with their batches, schema) of ``encode``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # one vocabulary
    schema = "doc_id long, ids binary, n_tokens long, split_chars long" + ", starts array<int>, ends array<int>" * offsets
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows, _encode(shared, _options(model), offsets), schema


def encode(docs: DataFrame, model: str, offsets: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens, split_chars (tokens that begin inside a
    character); with ``offsets`` also starts and ends of every token in characters."""
    rows, run, schema = _encoding(docs, model, offsets, id_col, text_col)
    return rows.mapInArrow(run, schema)


def token_bytes(model: str) -> tuple[bytes, list[int]]:
    """The bytes of all tokens one after the other, in id order, and their lengths."""
    back = {c: b for b, c in byte_table().items()}
    vocab = json.loads(model)["model"]["vocab"]
    table = [b""] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        table[i] = bytes(back[c] for c in token)
    return b"".join(table), [*map(len, table)]


def _decode(table, with_text: bool, at_once: int = 1 << 20):
    """``table`` holds ``token_bytes``: the model itself, far larger as Python objects, stays out of these workers."""
    def run(batches):
        import pyarrow as pa
        joined, lengths = table.value
        flat, sizes = np.frombuffer(joined, np.uint8), np.frombuffer(lengths, np.int64)
        for batch in batches:
            schema = batch.schema.append(pa.field("decoded", pa.binary()))
            if with_text:
                schema = schema.append(pa.field("text", pa.string()))
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                raw, at = utf8(part.column("ids").cast(pa.large_binary()))
                ids = np.frombuffer(np.ascontiguousarray(raw), "<u4")
                decoded = np.concatenate([np.zeros(0, np.uint8), *(gather(flat, sizes, ids[k:k + at_once])
                                                                   for k in range(0, len(ids), at_once))])
                ends = np.concatenate([[0], np.cumsum(sizes[ids])])[at // 4]
                whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [
                    None, pa.py_buffer(ends), pa.py_buffer(decoded)]).cast(pa.binary())
                texts = [pa.array([d.decode(errors="replace") for d in whole.to_pylist()], pa.string())] if with_text else []
                yield pa.record_batch([*part.columns, whole, *texts], schema=schema)
    return run


def _decoding(spark: SparkSession, model: str, schema: str, text: bool):
    """(what a worker does with batches of ``schema``, schema) of ``decode``."""
    joined, lengths = token_bytes(model)
    shared = spark.sparkContext.broadcast((joined, np.array(lengths, np.int64).tobytes()))
    return _decode(shared, text), schema + ", decoded binary" + ", text string" * text


def decode(encoded: DataFrame, model: str, text: bool = True) -> DataFrame:
    """``encode``'s rows with ``decoded`` (bytes) and, with ``text``, ``text`` (bytes that are no UTF-8, as from
    cut id sequences, become U+FFFD)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    run, schema = _decoding(encoded.sparkSession, model, schema, text)
    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str, text: bool = True, offsets: bool = False, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The rows of ``decode(encode(docs))``, each batch encoded and then decoded by one worker: chained, every task
    holds two Python workers at a time, and as workers are used again, all of them come to hold a tokenizer."""
    rows, write, schema = _encoding(docs, model, offsets, id_col, text_col)
    read, schema = _decoding(docs.sparkSession, model, schema, text)

    def run(batches):
        yield from read(write(batches))
        release_memory()  # an idle worker keeps its tokenizer and known pieces only
    return rows.mapInArrow(run, schema)
