"""Exact, memory-bounded batch encoding with the ``tokenizers`` library (used by token files and byte-level BPE).

The byte-level pre-tokenizer never joins a character that is not white space
with white space that follows it, nor a letter or digit with a mark that follows
it, so a text may be cut there and the pieces encoded on their own give the same
ids. The cuts are found on the UTF-8 bytes with numpy, before ASCII white space
and between ASCII letters or digits and marks only (all other characters stay
inside their piece); the pieces become an Arrow string array, are
dictionary-encoded, and only distinct pieces that the worker has not met lately
are encoded, many per call and told apart by their byte lengths, since a
byte-level token stands for a fixed number of bytes. Ids are then gathered per
piece. Tokenizers of another build take the plain path.

Added tokens (``<|endoftext|>``) are cut out of the text first by the library, as
it does by default; with ``special_as_text`` those marked special are ordinary
text. They hold no white space and take none from their neighbours, or the
tokenizer takes the plain path, so they always lie within a piece.
"""

from __future__ import annotations

import hashlib
import json
import os
from itertools import repeat

import numpy as np

from voltaic.llm.common import release_memory, worker_cache
from voltaic.llm.spans import byte_set, gather, utf8

ASCII_SPACE = byte_set(" \t\n\x0b\x0c\r")
ASCII_WORD = byte_set("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
ASCII_MARK = byte_set("".join(map(chr, range(0x21, 0x7F)))) & ~ASCII_WORD
# FIXED VALUES: last two bytes of the Unicode White_Space characters beyond ASCII (some other characters share them)
SPACE_ENDS = [(0xC2, 0x85), (0xC2, 0xA0), (0x9A, 0x80), *((0x80, b) for b in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0x81, 0x9F)]
SPACE_END = np.zeros((256, 256), bool)
SPACE_END[tuple(np.array(SPACE_ENDS).T)] = True


def byte_table() -> dict[int, str]:
    """Byte -> printable character of byte-level vocabularies: visible Latin-1 bytes stand for
    themselves, the others for the code points from 256 on, in byte order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def piece_starts(raw: np.ndarray, offsets: np.ndarray, whole: list[bytes] = ()) -> np.ndarray:
    """Bytes at which a text or a piece (white space and what follows it, or marks behind a word) begins; the strings
    ``whole`` are not cut."""
    start = np.zeros(len(raw) + 1, bool)
    if len(raw) > 1:
        space = ASCII_SPACE[raw]
        at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        high = at[raw[at - 1] >= 0x80]  # the character before may be other white space
        start[at] = True
        start[high[SPACE_END[raw[high - 2], raw[high - 1]]]] = False
        start[1:-1] |= ASCII_WORD[raw[:-1]] & ASCII_MARK[raw[1:]]
    text = raw.tobytes() if whole else b""
    for content in whole:
        at = text.find(content)
        while at >= 0:
            start[at + 1:at + len(content)] = False
            at = text.find(content, at + 1)
    start[offsets] = True
    return np.flatnonzero(start[:-1])


class _Pieces:
    """Ids of known pieces: piece -> entry, and per entry its place in one flat array."""

    def __init__(self, dtype):
        self.entry: dict[str, int] = {}
        self.flat = np.zeros(0, dtype)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, pieces: list[str]) -> np.ndarray:
        """Entry of every piece, -1 where it has none."""
        return np.fromiter(map(self.entry.get, pieces, repeat(-1)), np.int64, len(pieces))

    def add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.entry.update(zip(pieces, range(len(self.size), len(self.size) + len(pieces)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, ids])

    def ids(self, entries: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.size, entries, self.begin)


class Encoder:
    """``encode(texts)`` -> one bytes object of little-endian ids per text; ``encode_column`` -> all ids and bounds."""

    def __init__(self, tokenizer_json: str, cache_pieces: int = 400_000, slice_chars: int = 1 << 23,
                 group: int = 64, splits_at_space: bool | None = None, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core already
        from tokenizers import Tokenizer
        # asked of the tokenizer: the whole JSON as Python objects would double the worker's memory
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = special_as_text
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        added = {i: t for i, t in self.tokenizer.get_added_tokens_decoder().items() if not (special_as_text and t.special)}
        self.lengths = np.zeros(max([*vocab.values(), *added], default=0) + 1, np.int64)
        for token, i in vocab.items():
            self.lengths[i] = len(token)
        for i, t in added.items():
            self.lengths[i] = len(t.content.encode())
        self.whole = [t.content.encode() for t in added.values() if t.content]
        pre = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        if splits_at_space is None:
            splits_at_space = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                               and bool(pre.get("use_regex")))
        apart = all(not (t.single_word or t.lstrip or t.rstrip) and not any(c.isspace() for c in t.content)
                    for t in added.values())
        self.pieces = splits_at_space and apart and not self.tokenizer.normalizer
        self.dtype = np.dtype("<u2") if len(self.lengths) <= 1 << 16 else np.dtype("<u4")
        self.cache_pieces, self.slice_bytes, self.group = cache_pieces, slice_chars, group
        # two generations: a full one becomes the old one, pieces in use move on from there
        self.memo, self.old = _Pieces(self.dtype), _Pieces(self.dtype)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype)
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str], sizes: np.ndarray, joins: np.ndarray) -> None:
        """Encode new pieces (with their byte lengths); those that ``joins`` marks may follow one another in one text."""
        alone = [pieces[i] for i in np.flatnonzero(~joins)]
        coded = self._plain(alone)
        self.memo.add(alone, np.concatenate([self.memo.flat[:0], *coded]), np.fromiter(map(len, coded), np.int64, len(coded)))
        joined = [pieces[i] for i in np.flatnonzero(joins)]
        coded = self._plain(["".join(joined[i:i + self.group]) for i in range(0, len(joined), self.group)])
        ids = np.concatenate([self.memo.flat[:0], *coded])
        # a byte-level token stands for a fixed number of bytes: that tells the pieces apart
        cuts = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes[joins])) + 1
        self.memo.add(joined, ids, np.diff(cuts, prepend=0))

    def _look_up(self, strings) -> np.ndarray:
        """Entry in ``memo`` of every string of an Arrow large-string array of distinct pieces."""
        if len(self.memo.size) > self.cache_pieces // 2:
            self.memo, self.old = _Pieces(self.dtype), self.memo
        pieces = strings.to_numpy(zero_copy_only=False).tolist()
        found = self.memo.find(pieces)
        new = np.flatnonzero(found < 0)
        if len(new):
            names = [pieces[i] for i in new]
            before = self.old.find(names)
            kept = np.flatnonzero(before >= 0)
            self.memo.add([names[i] for i in kept], self.old.ids(before[kept]), self.old.size[before[kept]])
            raw, offsets = utf8(strings)
            fresh = new[before < 0]
            start, end = offsets[fresh], offsets[fresh + 1]
            last, last_but_one = raw[end - 1], raw[np.maximum(end - 2, 0)]
            # a piece may follow another only if it begins, and that one does not end, with white space
            joins = ASCII_SPACE[raw[start]] & ~ASCII_SPACE[last] & ~SPACE_END[last_but_one, last]
            self._learn([pieces[i] for i in fresh], end - start, joins)
            found[new] = self.memo.find(names)
        return found

    def encode_column(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, bounds of the texts in them); NULL is the empty text."""
        import pyarrow as pa
        if not self.pieces:
            coded = [ids for t in column.to_pylist() for ids in self._plain([t or ""])]
            return np.concatenate([np.zeros(0, self.dtype), *coded]), np.cumsum([0, *map(len, coded)])
        raw, offsets = utf8(column)
        starts = piece_starts(raw, offsets, self.whole)
        sizes = np.zeros(len(starts) + 1, np.int64)  # ids per piece, from 1
        found = [np.zeros(0, self.dtype)]
        cuts = np.searchsorted(starts, np.arange(0, len(raw) + self.slice_bytes, self.slice_bytes))
        bounds = np.append(starts, len(raw))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            strings = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(bounds[a:b + 1] - bounds[a]),
                                                       pa.py_buffer(np.ascontiguousarray(raw[bounds[a]:bounds[b]])))
            named = strings.dictionary_encode()
            entries = self._look_up(named.dictionary)[named.indices.to_numpy()]
            found.append(self.memo.ids(entries))
            sizes[a + 1:b + 1] = self.memo.size[entries]
        return np.concatenate(found), np.cumsum(sizes)[np.searchsorted(starts, offsets)]

    def encode(self, texts: list[str]) -> list[bytes]:
        import pyarrow as pa
        ids, bounds = self.encode_column(pa.array(texts, pa.string()))
        raw, at = ids.tobytes(), (bounds * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def worker_encoder(tokenizer_json: str, **options) -> Encoder:
    """One encoder per worker, vocabulary and options, with its cache (workers live on between jobs)."""
    key = hashlib.md5(json.dumps([tokenizer_json, sorted(options.items())]).encode()).hexdigest()
    cache = worker_cache()
    if ("encoder", key) not in cache:
        cache["encoder", key] = Encoder(tokenizer_json, **options)
        release_memory()  # building a tokenizer takes twice the memory it keeps
    return cache["encoder", key]
