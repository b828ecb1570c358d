r"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A text is cut at special strings, then into pieces by the byte-level pattern.  Within a piece, a segment tree
over the positions holds each adjacent pair's merge rank together with its position; the root is the leftmost
lowest rank.  A merge changes at most three leaves, each a logarithmic update, until the root says that
nothing can be merged.  A piece of any length costs n log n.  Pieces repeat, so each Python worker keeps the
last few hundred thousand of them, in two generations of bounded size.

The vocabulary is one file of fixed size, read on the driver by a path that is a parameter and sent along
with the function.  Encoding needs no shuffle: each task reads its rows and forgets them.

Defined cases: a null text counts as empty and has no ids; a string like ``<|endoftext|>`` in a text is that
special token; ids decode to the bytes of their tokens, what isn't UTF-8 becoming U+FFFD; repeated rows and
null ids are encoded each on their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import read

#: Fixed pattern of the byte-level pre-tokeniser.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ids that a task holds before it hands rows on.
OUT_TOKENS = 1 << 18
_NONE = 1 << 62
_POS = (1 << 32) - 1


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next free code point."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    out = {chr(b): b for b in keep}
    for n, b in enumerate(x for x in range(256) if x not in keep):
        out[chr(256 + n)] = b
    return out


class Encoder:
    """``spec``: the tokeniser file's text."""

    def __init__(self, spec: str, cache: int = 400_000):
        d = json.loads(spec)
        odd = [t["content"] for t in d["added_tokens"] if any(t.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized"))]
        if odd:
            raise ValueError(f"added tokens that strip, want whole words or are normalised are not supported: {odd}")
        byte = _byte_chars()
        vocab = d["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for s, i in vocab.items():
            self.token[i] = bytes(byte[c] for c in s)
        for s, i in self.special.items():
            self.token[i] = s.encode()
        ids = {t: i for i, t in enumerate(self.token)}
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        #: (left, right) packed -> rank, in the upper half; the merged id of each rank
        self.pair: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, m in enumerate(d["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pair[vocab[a] << 32 | vocab[b]] = rank << 32
            self.merged.append(vocab[a + b])
        self.piece = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.cache = cache
        self.text_of_id = [str(i) for i in range(size)]

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The ids of one piece."""
        sym = [self.byte_id[b] for b in data]
        n = len(sym)
        if n < 2:
            return tuple(sym)
        rank, merged = self.pair.get, self.merged
        width = 1
        while width < n - 1:
            width *= 2
        # a leaf: the rank of the pair that starts here, then the position; no pair beats any rank
        leaves = [rank(sym[i] << 32 | sym[i + 1], _NONE) | i for i in range(n - 1)]
        tree = [_NONE] * width + leaves + [_NONE] * (width - n + 1)
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while (root := tree[1]) < _NONE:
            i = root & _POS
            j = after[i]
            sym[i] = left = merged[root >> 32]
            sym[j] = -1
            nxt = after[i] = after[j]
            if nxt < n:
                before[nxt] = i
                changed = [(i, rank(left << 32 | sym[nxt], _NONE) | i), (j, _NONE)]
            elif j < n - 1:
                changed = [(i, _NONE), (j, _NONE)]
            else:
                changed = [(i, _NONE)]
            p = before[i]
            if p >= 0:
                changed.append((p, rank(sym[p] << 32 | left, _NONE) | p))
            for at, value in changed:
                k = width + at
                tree[k] = value
                k >>= 1
                while k:
                    a, b = tree[2 * k], tree[2 * k + 1]
                    if b < a:
                        a = b
                    if tree[k] == a:
                        break
                    tree[k] = a
                    k >>= 1
        return tuple(s for s in sym if s >= 0)

    def __missing(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.merge(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= 64:
            if len(self.young) >= self.cache:
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def _plain(self, text: str) -> Iterator[int]:
        pieces = self.piece(text)
        out = list(map(self.young.get, pieces))
        if None in out:
            known, miss = self.young, self.__missing
            for k, ids in enumerate(out):
                if ids is None:
                    out[k] = known.get(pieces[k]) or miss(pieces[k])
        return chain.from_iterable(out)

    def encode(self, text: str | None) -> list[int]:
        text = text or ""
        if self.cut is None or not any(s in text for s in self.special):
            return list(self._plain(text))
        out, at = [], 0
        for m in self.cut.finditer(text):
            out.extend(self._plain(text[at : m.start()]))
            out.append(self.special[m.group()])
            at = m.end()
        out.extend(self._plain(text[at:]))
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_HELD: dict[str, Encoder] = {}


#: Pieces that an encoder remembers, in each of two generations; about 200 bytes a piece.
CACHE = 400_000


def encoder(spec: str, cache: int = CACHE) -> Encoder:
    """One encoder for each worker process and vocabulary, so that its pieces stay known between tasks."""
    key = f"{hashlib.sha256(spec.encode()).hexdigest()}:{cache}"
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Encoder(spec, cache)
    return _HELD[key]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int)."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))  # a vocabulary: a few MB, whatever the input
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""
    spec = coded.sparkSession.sparkContext.broadcast(read_spec(path))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], schema=schema)

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """Encodes and decodes in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, and if asked for ``ids``."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value, cache)
        names = enc.text_of_id.__getitem__

        def out(b: pa.RecordBatch) -> pa.RecordBatch:
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), *([pa.array(kept, pa.list_(pa.int32()))] * with_ids)]
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for b in batches:
            n, a, d, kept, first, held = [], [], [], [], 0, 0
            for k, text in enumerate(b.column(1)):
                ids = enc.encode(text.as_py())
                if with_ids:
                    kept.append(np.array(ids, np.int32))
                n.append(len(ids))
                held += len(ids)
                a.append(hashlib.sha256(",".join(map(names, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
                if with_ids and held >= OUT_TOKENS:
                    yield out(b.slice(first, k + 1 - first))
                    n, a, d, kept, first, held = [], [], [], [], k + 1, 0
            yield out(b.slice(first))

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), default_path())
