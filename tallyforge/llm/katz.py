"""Language-model scoring with a Katz backoff model.

Counts are discounted by Good-Turing for counts up to `K`; the mass taken from a history goes to its unseen
words in proportion to the next shorter model, with the backoff weight that makes each history's
probabilities add up to one exactly.  A history that loses nothing to discounting sets one count aside for
unseen words.  Words never seen in training share what discounting takes from the single words.

How it runs.  Tasks cut the corpus into blocks of tokens.  A block is never gathered anywhere else: it sends
*messages*, its distinct n-grams with their training counts, to buckets of n-grams with the same history, and gets
answers back in the order in which it sent them.

* Level 1: words by hash.  A bucket adds up counts, numbers the words, and answers with count and number.
* Level k: n-grams by history, with the probability of the shorter model beside each.  A bucket holds all
  that follows a history, so it has the history's count, its count of counts and the shorter model's mass of
  the words seen there, which is what the discount and the exact backoff weight need.
* A history with more than a bucket's share of all tokens is spread over several buckets by word.  The partial sums
  are added by an aggregation and joined to the blocks that ask for them.
* Then each block evaluates its tokens recursively from its answers and adds them up by document.

The model is a table partitioned by level, a row for each bucket: for level 1 words with counts, numbers and
probabilities; for level k histories with counts and backoff weights, and words with counts, discounted counts and
the shorter model's probabilities (`model_rows` reads them).  `score_with` scores other texts from it: its rows are
one more sender to the buckets.

Messages, counts and answers are tables in the shared folder, partitioned by kind and grouped by bucket.  A
message is one row for each block and bucket, packed and compressed: shuffled volume follows the number of
distinct n-grams, and common n-grams cost a block one entry.  The number of buckets follows the input; where a block
has fewer n-grams than there are buckets, a message holds one, and rows follow the distinct n-grams too.  All
tables but the model and the result are deleted in the end.

Defined cases: a null or wordless text is one token, its end; a null id counts as the empty text for the
training split; repeated rows are documents of their own; without training text every word is unknown and
has probability one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import discard, materialise, read

K = 5
BLOCK_TOKENS = 1_200_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_END = b"\n"  # no word is white space
#: ``sums``: numbers that are added up over buckets.
_ROW = "kind string, block long, bucket long, payload binary, sums array<double>"
_COLS = ["kind", "block", "bucket", "payload", "sums"]
#: The block number under which a stored model sends its counts.
_MODEL = -2


def _narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers without a sign in the narrowest type that holds them."""
    if a.dtype.kind not in "iub" or not len(a) or int(a.min()) < 0:
        return a
    hi = int(a.max())
    return a.astype(np.uint8 if hi < 1 << 8 else np.uint16 if hi < 1 << 16 else np.uint32 if hi < 1 << 32 else np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays, each in the narrowest whole-number type that holds it, compressed; whole numbers by byte planes,
    and those that never fall as differences.  Floats with many repeats are coded by their place in a table of
    distinct values, which follows them."""
    z = zstandard.ZstdCompressor(level=3)
    todo = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        if a.dtype.kind == "f" and len(a) > 64:
            table, codes = np.unique(a, return_inverse=True)
            if 4 * len(table) < len(a):
                todo += [(codes, b"t"), (table, b"f")]
                continue
        todo.append((a, b"a"))
    out = [struct.pack("<H", len(todo))]
    for a, role in todo:
        a = _narrow(a)
        kind = a.dtype.str[-2:].encode()
        if role == b"a" and a.dtype.kind == "u" and len(a) > 1 and (a[1:] >= a[:-1]).all():
            a, role = _narrow(np.concatenate([a[:1], np.diff(a)])), b"d"
        planes = a.view(np.uint8).reshape(len(a), -1).T if len(a) and a.dtype.kind == "u" and a.itemsize > 1 else a
        body = z.compress(planes.tobytes())
        out += [struct.pack("<2s2s1sQQ", kind, a.dtype.str[-2:].encode(), role, len(a), len(body)), body]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    (n,), at, z, out = struct.unpack_from("<H", data), 2, zstandard.ZstdDecompressor(), []
    for _ in range(n):
        kind, stored, role, length, size = struct.unpack_from("<2s2s1sQQ", data, at)
        at += 21
        dtype, own = np.dtype(stored.decode()), np.dtype(kind.decode())
        raw = z.decompress(data[at : at + size], max_output_size=max(1, length * dtype.itemsize)) if length else b""
        a = np.frombuffer(raw, np.uint8)
        a = (np.ascontiguousarray(a.reshape(dtype.itemsize, -1).T) if length and dtype.kind == "u" and dtype.itemsize > 1 else a).view(dtype).reshape(-1)
        if role == b"d":
            a = np.cumsum(a, dtype=own)
        at += size
        if role == b"f":
            out[-1] = a[out[-1]]
        else:
            out.append(a.astype(np.int64) if own.kind in "iub" and own.str[1:] != "u8" else a)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public-domain splitmix64 constants)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def is_training(doc_id, modulus: int = 7, held: int = 2) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus != held


def good_turing(nr: np.ndarray) -> np.ndarray:
    """Discounts for counts 0..K (entry 0 unused) from counts of counts 1..K+1; 1.0 where the formula gives
    none between 0 and 1."""
    d = np.ones(K + 1)
    n = np.concatenate([[0.0], np.asarray(nr, float)])
    if n[1] > 0:
        a = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            if n[r] > 0 and a < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a)
                if 0 < x < 1:
                    d[r] = x
    return d


@dataclass
class Level:
    """What every block has to know of a level: small, whatever the corpus."""

    discount: np.ndarray
    total: int = 0  # training tokens
    types: int = 0  # distinct training words
    reserve: float = 0.0  # probability of any word not seen in training


@dataclass
class Model:
    """A stored model: its table (``level, bucket, payload``) and what reading it takes."""

    table: DataFrame
    order: int
    buckets: int
    levels: list[Level]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(*r, None) if len(r) == 4 else r for r in rows], columns=_COLS)


def _by_bucket(bucket: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    return np.lexsort((*reversed(keys), bucket))


def _runs(sorted_bucket: np.ndarray) -> list[tuple[int, int, int]]:
    if not len(sorted_bucket):
        return []
    cut = np.flatnonzero(np.diff(sorted_bucket)) + 1
    edge = np.concatenate([[0], cut, [len(sorted_bucket)]])
    return [(int(sorted_bucket[a]), int(a), int(b)) for a, b in zip(edge, edge[1:])]


# Level 1 ------------------------------------------------------------------------------------------------


def _tokenise(buckets: int, modulus: int | None, held: int, block_tokens: int):
    schema = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("bucket", pa.int64()), ("payload", pa.binary()), ("sums", pa.list_(pa.float64()))])

    def flush(block: int, words: dict[bytes, int], docs: list, tokens: list) -> pa.RecordBatch:
        tok = np.concatenate(tokens)
        lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
        train = np.fromiter((modulus is not None and is_training(d, modulus, held) for d in docs), bool, len(docs))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        counts = np.bincount(tok[np.repeat(train, lens)], minlength=len(words))
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = _by_bucket(bucket, hashes)
        null = np.fromiter((d is None for d in docs), bool, len(docs))
        ids = np.fromiter((0 if d is None else d for d in docs), np.int64, len(docs))
        rows = [("block", block, -1, pack(ids, null, lens, train, tok, order, np.array([words[_END], len(words)])))]
        for b, lo, hi in _runs(bucket[order]):
            at = order[lo:hi]
            rows.append(("message", block, b, pack(hashes[at], counts[at])))
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in zip(*rows)), pa.nulls(len(rows), schema.types[4])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        words: dict[bytes, int] = {}
        docs, tokens, n = [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = _WORD.findall((text.as_py() or "").encode("utf-8", "surrogatepass").translate(_LOWER))
                found.append(_END)
                tokens.append(np.fromiter((words.setdefault(w, len(words)) for w in found), np.int64, len(found)))
                docs.append(doc)
                n += len(found)
                if n >= block_tokens:
                    yield flush(block, words, docs, tokens)
                    block, words, docs, tokens, n = block + 1, {}, [], [], 0
        if docs:
            yield flush(block, words, docs, tokens)

    return run


def _count_of_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1 : K + 2]


def _add_words(buckets: int, keep: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(p) for p in pdf["payload"]]
        bucket = int(pdf["bucket"].iloc[0])
        keys, back = np.unique(np.concatenate([p[0].astype(np.uint64) for p in parts]), return_inverse=True)
        c = np.bincount(back, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
        rank = np.empty(len(keys), np.int64)
        rank[np.lexsort((keys, -c))] = np.arange(len(keys))
        rows, at = [], 0
        for block, p in zip(pdf["block"], parts):
            mine = back[at : at + len(p[0])]
            at += len(p[0])
            if block != _MODEL:
                rows.append(("answer", block, bucket, pack(c[mine], rank[mine] * buckets + bucket)))
        rows.append(("sum", -1, bucket, None, [float(x) for x in (c.sum(), (c > 0).sum(), *_count_of_counts(c))]))
        if keep:
            rows.append(("model", _MODEL, bucket, pack(keys[c > 0], c[c > 0], rank[c > 0] * buckets + bucket)))
        return _frame(rows)

    return run


# Level k ------------------------------------------------------------------------------------------------


class Block:
    """A block's tokens and what has been answered about them so far."""

    def __init__(self, payload: bytes):
        self.ids, self.null, self.lens, self.train, self.tok, self.order, (end, n_words) = unpack(payload)
        self.end, self.n_words = int(end), int(n_words)
        self.tok = self.tok.astype(np.int32)
        self.first = np.zeros(len(self.tok), bool)
        self.first[np.cumsum(self.lens) - self.lens] = True
        self.in_train = np.repeat(self.train.astype(bool), self.lens)

    def words(self, answers: list[bytes], level: Level) -> None:
        """Level 1: counts, numbers and probabilities of words."""
        got = [unpack(a) for a in answers]
        count, number = np.empty(self.n_words, np.int64), np.empty(self.n_words, np.int64)
        count[self.order] = np.concatenate([g[0] for g in got])
        number[self.order] = np.concatenate([g[1] for g in got])
        self.c1 = count[self.tok]
        self.number = number[self.tok] + 1
        self.end_count = int(count[self.end])
        self.p = unigram(level, count)[self.tok]
        self.seen = self.c1  # training count of the k-gram that ends at each token

    def history(self, k: int) -> np.ndarray:
        """A number for the k - 1 tokens before each one; before a text's start stands 0."""
        out = np.zeros(len(self.tok), np.uint64)
        prev, gone = self.number, np.zeros(len(self.tok), bool)
        for step in range(1, k):
            gone = np.concatenate([[True], gone[:-1]]) | self.first if step > 1 else self.first.copy()
            prev = np.concatenate([[0], prev[:-1]])
            prev = np.where(gone, 0, prev)
            out = prev.astype(np.uint64) if k == 2 else mix64(out * np.uint64(3) + prev.astype(np.uint64))
        return out

    def grams(self, k: int, buckets: int, share: float):
        """The block's distinct k-grams in sending order: history, word, count, shorter probability, whether
        the history is spread; and for each token its k-gram."""
        h = self.history(k)
        keys, hid = np.unique(h, return_inverse=True)
        code, at, back = np.unique(hid * (self.n_words + 1) + self.tok, return_index=True, return_inverse=True)
        n = np.bincount(back[self.in_train], minlength=len(code))
        before = np.concatenate([[0], self.seen[:-1]])
        before = np.where(self.first, self.end_count, before)[at]
        salts = (before / share).astype(np.int64) + 1
        salt = np.where(salts > 1, mix64(self.number[at]).astype(np.uint64) % salts.astype(np.uint64), 0)
        bucket = (mix64(h[at] + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
        order = _by_bucket(bucket, h[at], self.number[at])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = at[order]
        return bucket[order], h[at], self.number[at], n[order], self.p[at], salts[order] > 1, place[back]

    def absorb(self, k: int, answers: list[bytes], level: Level, buckets: int, share: float, hot: pd.DataFrame) -> None:
        """Level k's probabilities, in place of the shorter model's.  ``hot`` has the sums of the spread histories."""
        bucket, h, _, _, lower, spread, of = self.grams(k, buckets, share)
        got = [unpack(a) for a in answers]
        c = np.concatenate([g[0] for g in got])
        sums = np.concatenate([np.column_stack(g[1:]) for g in got])
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])])
        sums = sums[np.cumsum(new) - 1]
        if spread.any():
            keys = hot["bucket"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(keys)
            sums[spread] = np.stack(list(hot["sums"]))[order][np.searchsorted(keys[order], h[spread])]
        self.p = katz(level.discount, c, lower, sums)[of]
        self.seen = c[of]


def unigram(level: Level, count: np.ndarray) -> np.ndarray:
    """Probability of words with these training counts; a word without any gets the whole reserve."""
    n = level.total
    if n == 0:
        return np.ones(len(count))
    d, kept = level.discount, level.reserve
    if kept <= 0:
        return np.where(count > 0, count / (n + 1), 1 / (n + 1))
    return np.where(count > 0, d[np.where(count <= K, count, 0)] * count / n, kept)


def freed_mass(d: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each history's unseen words get, and whether that is one count set aside as no discount frees any.
    ``sums`` has a row for each: the history's count, how many of its continuations occur 1..K times, and the shorter
    model's mass of all its continuations."""
    safe = np.maximum(sums[:, 0], 1)
    freed = (sums[:, 1 : K + 1] * (1 - d[1:]) * np.arange(1, K + 1)).sum(axis=1) / safe
    none = freed <= 0
    return np.where(none, 1 / (safe + 1), freed), none


def backoff(d: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Backoff weights: they make each history's probabilities add up to one."""
    return freed_mass(d, sums)[0] / np.maximum(1 - sums[:, K + 1], 1e-300)


def katz(d: np.ndarray, c: np.ndarray, lower: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Probabilities of k-grams with counts ``c`` and shorter probabilities ``lower``; ``sums`` as in `freed_mass`."""
    total = sums[:, 0]
    safe = np.maximum(total, 1)
    _, none = freed_mass(d, sums)
    p_seen = np.where(none, c / (safe + 1), d[np.where(c <= K, c, 0)] * c / safe)
    return np.where(total == 0, lower, np.where(c > 0, p_seen, backoff(d, sums) * lower))


def _add_grams(keep: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(p) for p in pdf["payload"]]
        bucket = int(pdf["bucket"].iloc[0])
        reps = [np.repeat(p[0].astype(np.uint64), p[1]) for p in parts]
        hist, hid = np.unique(np.concatenate(reps), return_inverse=True)
        word = np.concatenate([p[3] for p in parts])
        code, at, back = np.unique(hid * (int(word.max()) + 1) + word if len(hist) * (int(word.max()) + 1) < 1 << 62 else hid * (1 << 32) + np.unique(word, return_inverse=True)[1], return_index=True, return_inverse=True)
        c = np.bincount(back, np.concatenate([p[4] for p in parts]), len(code)).astype(np.int64)
        lower = np.concatenate([p[5] for p in parts])[at]
        of = hid[at]
        sums = np.zeros((len(hist), K + 2))
        sums[:, 0] = np.bincount(of, c, len(hist))
        for r in range(1, K + 1):
            sums[:, r] = np.bincount(of[c == r], minlength=len(hist))
        sums[:, K + 1] = np.bincount(of[c > 0], lower[c > 0], len(hist))
        rows, i, spread = [], 0, np.zeros(len(hist), bool)
        for block, p in zip(pdf["block"], parts):
            n = len(p[3])
            mine = back[i : i + n]
            starts = np.concatenate([[0], np.cumsum(p[1])[:-1]]) + i
            hs = hid[starts]
            i += n
            spread[hs[p[2] > 0]] = True
            if block == _MODEL:
                continue
            s = sums[hs]
            rows.append(("answer", block, bucket, pack(c[mine], *(s[:, r].astype(np.int64) for r in range(K + 1)), s[:, K + 1])))
            rows += [("want", block, h, None) for h in hist[hs[p[2] > 0]].view(np.int64).tolist()]
        rows.append(("sum", -1, bucket, None, _count_of_counts(c).astype(float).tolist()))
        rows += [("hot", -1, int(h), None, x.tolist()) for h, x in zip(hist[spread].view(np.int64), sums[spread])]
        if keep:
            live = c > 0
            has, n = np.unique(of[live], return_counts=True)
            rows.append(("model", _MODEL, bucket, pack(hist[has], n, spread[has].astype(np.int64), word[at][live], c[live], lower[live], *sums[has].T)))
        return _frame(rows)

    return run


def _stored(k: int, level: Level):
    """A bucket's counts as a row of the model: with probabilities, or discounted counts and backoff weights.
    Histories that are spread over buckets have their whole sums and weights in rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for payload in b.column(1):
                got = unpack(payload.as_py())
                if k == 1:
                    out.append(pack(*got, unigram(level, got[1])))
                else:
                    sums, c = np.column_stack(got[6:]) if len(got[0]) else np.zeros((0, K + 2)), got[4]
                    out.append(pack(*got[:6], level.discount[np.where(c <= K, c, 0)] * c, sums[:, 0], backoff(level.discount, sums)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["bucket", "payload"])

    return run


def model_rows(model: Model, k: int) -> DataFrame:
    """The model's level ``k``: ``word, number, count, p`` for 1 (``word`` is a hash), else ``history, word, count,
    discounted, lower, total, weight``, where ``total`` and ``weight`` are null if the history is spread."""
    long, double = pa.int64(), pa.float64()
    schema = pa.schema([("word", long), ("number", long), ("count", long), ("p", double)] if k == 1 else [("history", long), ("word", long), ("count", long), ("discounted", double), ("lower", double), ("total", double), ("weight", double)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload in b.column(0):
                got = unpack(payload.as_py())
                if k == 1:
                    cols = [got[0].astype(np.uint64).view(np.int64), got[2], got[1], got[3].astype(float)]
                else:
                    each = lambda x: np.repeat(x, got[1])  # noqa: B023, E731
                    whole = each(got[2]) == 0
                    sums = [pa.array(each(got[i]).astype(float), mask=~whole) for i in (7, 8)]
                    cols = [each(got[0].astype(np.uint64).view(np.int64)), got[3], got[4], got[6].astype(float), got[5].astype(float), *sums]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], schema=schema)

    kinds = ", ".join(f"`{f.name}` {'long' if f.type == long else 'double'}" for f in schema)
    return model.table.filter(F.col("level") == k).select("payload").mapInArrow(run, kinds)


def _replay(pdf: pd.DataFrame, levels: list[Level], buckets: int, share: float) -> Block:
    """A block with every level that has been answered."""
    b = Block(pdf.loc[pdf["kind"] == "block", "payload"].iloc[0])
    for k, level in enumerate(levels, 1):
        mine = pdf[pdf["kind"] == f"answer{k}"].sort_values("bucket")
        if k == 1:
            b.words(list(mine["payload"]), level)
        else:
            b.absorb(k, list(mine["payload"]), level, buckets, share, pdf[pdf["kind"] == f"hot{k}"])
    return b


def _ask(k: int, levels: list[Level], buckets: int, share: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = _replay(pdf, levels, buckets, share)
        bucket, h, word, n, lower, spread, _ = b.grams(k, buckets, share)
        rows = []
        for to, lo, hi in _runs(bucket):
            new = np.concatenate([[0], np.flatnonzero(h[lo + 1 : hi] != h[lo : hi - 1]) + 1])
            rows.append(("message", int(pdf["block"].iloc[0]), to, pack(h[lo:hi][new], np.diff(np.concatenate([new, [hi - lo]])), spread[lo:hi][new], word[lo:hi], n[lo:hi], lower[lo:hi])))
        return _frame(rows)

    return run


def _score(levels: list[Level], buckets: int, share: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = _replay(pdf, levels, buckets, share)
        n, v = levels[0].total, levels[0].types
        at = np.cumsum(b.lens) - b.lens
        add = lambda x: np.add.reduceat(x, at)
        return pd.DataFrame(
            {
                "doc_id": pd.Series(b.ids, dtype="Int64").mask(pd.Series(b.null > 0)),
                "held_out": b.train == 0,
                "n_tokens": b.lens,
                "n_known": add((b.c1 > 0).astype(np.int64)),
                "train_tokens": np.full(len(b.lens), n, np.int64),
                "base_score": add(np.log10((b.c1 + 1) / (n + v + 1))),
                "score": add(np.log10(b.p)),
            }
        )

    return run


def _run(docs: DataFrame, id_col: str, text_col: str, order: int, modulus: int | None, held: int, block_tokens: int, buckets: int, keep: bool, model: Model | None) -> tuple[DataFrame, Model]:
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = materialise(src.mapInArrow(_tokenise(buckets, modulus, held, block_tokens), _ROW), "katz-blocks", ["kind"])
    blocks = first.filter("kind = 'block'")
    answers, heat, levels, share, used, tables = [], [], [], 1.0, [first], []

    def group(order_done: int) -> DataFrame:
        rows = blocks.select(*_COLS)
        for n, (a, h) in enumerate(zip(answers, heat), 1):
            rows = rows.unionByName(a.filter("kind = 'answer'").select(F.lit(f"answer{n}").alias("kind"), "block", "bucket", "payload", "sums"))
            if h is not None:
                rows = rows.unionByName(h.select(F.lit(f"hot{n}").alias("kind"), "block", F.col("history").alias("bucket"), F.lit(None).cast("binary").alias("payload"), "sums"))
        return rows.groupBy("block")

    def stored(k: int) -> DataFrame:
        return model.table.filter(F.col("level") == k).select(F.lit("message").alias("kind"), F.lit(_MODEL).cast("long").alias("block"), "bucket", "payload", F.lit(None).cast("array<double>").alias("sums"))

    for k in range(1, order + 1):
        if k == 1:
            asked, add = first.filter("kind = 'message'").select(*_COLS), _add_words(buckets, keep)
        else:
            asked, add = group(k - 1).applyInPandas(_ask(k, list(levels), buckets, share), _ROW), _add_grams(keep)
        asked = asked.unionByName(stored(k)) if model else asked
        got = materialise(asked.groupBy("bucket").applyInPandas(add, _ROW), f"katz-level{k}", ["kind"])
        used.append(got)
        sums = got.filter("kind = 'sum'").select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()  # a few numbers
        total = np.zeros(K + 3 if k == 1 else K + 1)
        for r in sums:
            total[r["i"]] = r["x"]
        if k == 1:
            level = Level(good_turing(total[2:]), int(total[0]), int(total[1]))
            r = np.arange(1, K + 1)
            level.reserve = float(((1 - level.discount[1:]) * r * total[2 : K + 2]).sum() / max(1, level.total))
            share = max(1.0, level.total / buckets)
            discard(first, partition="kind=message")  # answered, and read no more
            heat.append(None)
        else:
            level = Level(good_turing(total))
            parts = [F.sum(F.get("sums", F.lit(i))) for i in range(K + 2)]
            hot = got.filter("kind = 'hot'").groupBy(F.col("bucket").alias("history")).agg(F.array(*parts).alias("sums"))
            want = got.filter("kind = 'want'").select("block", F.col("bucket").alias("history")).distinct()
            heat.append(materialise(want.join(hot, "history").select("block", "history", "sums"), f"katz-hot{k}"))
            used.append(heat[-1])
        if keep:
            rows = got.filter("kind = 'model'").select("bucket", "payload").mapInArrow(_stored(k, level), "bucket long, payload binary")
            tables.append(materialise(rows, f"katz-model{k}").select(F.lit(k).alias("level"), "bucket", "payload"))
            discard(got, partition="kind=model")
        answers.append(got)
        levels.append(level)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = materialise(group(order).applyInPandas(_score(levels, buckets, share), out), "katz-scored")
    discard(*used)
    table = functools.reduce(DataFrame.unionByName, tables) if tables else None
    return scored, Model(table, order, buckets, levels)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, modulus: int = 7, held: int = 2, block_tokens: int = BLOCK_TOKENS, buckets: int | None = None) -> tuple[DataFrame, Model]:
    """(scores, model): ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every text, and
    the model that was learned from the texts whose crc32(id as text) mod ``modulus`` is not ``held``."""
    buckets = buckets or max(8, 2 * docs.rdd.getNumPartitions())  # as many as there are input splits: read off the plan
    return _run(docs, id_col, text_col, order, modulus, held, block_tokens, buckets, True, None)


def score_with(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Scores of other texts, none of which is learned from, by a stored model."""
    return _run(docs, id_col, text_col, model.order, None, 0, block_tokens, model.buckets, False, model)[0]


def op1_katz(spark, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"))[0]
