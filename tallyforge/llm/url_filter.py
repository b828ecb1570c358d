r"""URL filter: a bit-parallel wildcard automaton over canonical URLs.

Each rule becomes glob patterns over the canonical form of host and path (a byte between that no text
holds).  All patterns are laid side by side in one Shift-And automaton whose state is a row of 64-bit
words: one bit for each literal character, ``*`` as a self-loop on the bit before it.  Every URL of a batch is
stepped at once, character by character, with the same few masks; which rules fitted is read off the
accepting bits, and of those the longest rule wins.

Defined cases: a null URL, or one without ``://``, has empty host and path and fits no rule; what no rule
fits gets ``default``; of rules of one length the first wins; repeated rows are judged each on their own; a URL may be
of any length; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import read

#: (verdict, rule); a rule is a host suffix, a slash and a path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Stands for the byte 0xFF, which no UTF-8 text holds, so that no host or path can pass for both.
_SEP = "\udcff"
_UPPER = "".join(map(chr, range(65, 91)))


#: Words of automaton state that a batch is stepped in at once (8 bytes each, in a few arrays): more rules, fewer rows.
STATE_WORDS = 1 << 20


def globs(rule: str) -> list[str]:
    """The rule's host and all its subdomains; any path that starts with the rule's."""
    host, _, path = rule.partition("/")
    return [f"{host}{_SEP}/{path}*", f"*.{host}{_SEP}/{path}*"]


class ShiftAnd:
    """All patterns in one automaton.  ``step`` masks: byte value -> words; ``stay``: bits with a self-loop."""

    def __init__(self, patterns: list[str]):
        self.patterns = patterns
        units: list[tuple[bytes | None, bool]] = []  # (literal, self-loop); None is a pattern's start
        starts, ends = [], []
        for p in patterns:
            starts.append(len(units))
            units.append((None, False))
            for ch in p.encode("utf-8", "surrogateescape"):
                if ch == ord("*"):
                    units[-1] = (units[-1][0], True)
                else:
                    units.append((bytes([ch]), False))
            ends.append(len(units) - 1)
        words = max(1, (len(units) + 63) // 64)
        self.masks, self.stay, self.start, self.starts_bits = np.zeros((256, words), np.uint64), np.zeros(words, np.uint64), np.zeros(words, np.uint64), starts
        for k, (literal, loop) in enumerate(units):
            w, bit = k // 64, np.uint64(1) << np.uint64(k % 64)
            if literal is not None:
                self.masks[literal[0], w] |= bit
            if loop:
                self.stay[w] |= bit
        for s in starts:
            self.start[s // 64] |= np.uint64(1) << np.uint64(s % 64)
        self.ends = [(e // 64, np.uint64(1) << np.uint64(e % 64)) for e in ends]

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Rows: texts, columns: patterns; whether the whole text fits."""
        step = max(1, STATE_WORDS // len(self.start))
        parts = [self._match(texts[k : k + step]) for k in range(0, len(texts), step)]
        return np.concatenate(parts) if parts else self._match([])

    def _match(self, texts: list[bytes]) -> np.ndarray:
        n = len(texts)
        out = np.zeros((n, len(self.patterns)), bool)
        if not n:
            return out
        length = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-length, kind="stable")  # long ones first: those still running are a prefix
        flat = np.frombuffer(b"".join(texts), np.uint8)
        offset = np.concatenate([[0], np.cumsum(length)[:-1]])[order]
        length = length[order]
        state = np.tile(self.start, (n, 1))
        running = n
        carry = np.zeros_like(state)
        for k in range(int(length[0]) if n else 0):
            while running and length[running - 1] <= k:
                running -= 1
            s = state[:running]
            c = carry[:running]
            c[:, 0] = 0
            c[:, 1:] = s[:, :-1] >> np.uint64(63)
            moved = ((s << np.uint64(1)) | c) & self.masks[flat[offset[:running] + k]]
            state[:running] = moved | (s & self.stay)
        for p, (w, bit) in enumerate(self.ends):
            out[order, p] = (state[:, w] & bit) != 0
        return out


def canonical(url: str | None) -> tuple[str, str]:
    """(host, path)."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((k for k in (rest.find("?"), rest.find("#")) if k >= 0), default=len(rest))
    head = rest[:cut]
    slash = head.find("/")
    host, path = (head, "") if slash < 0 else (head[:slash], head[slash:])
    return "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in host), path


def filter_urls(pages: DataFrame, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict``."""
    rules = list(rules)
    patterns = [(g, k) for k, (_, r) in enumerate(rules) for g in globs(r)]
    machine = ShiftAnd([g for g, _ in patterns])
    owner = [k for _, k in patterns]
    by_length = sorted(range(len(rules)), key=lambda k: -len(rules[k][1]))
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [canonical(u) for u in b.column(1).to_pylist()]
            texts = [h.encode() + b"\xff" + p.encode() if h or p else b"" for h, p in parts]
            hits = machine.match(texts)
            best = np.full(len(parts), -1)
            for k in reversed(by_length):
                best[hits[:, [i for i, o in enumerate(owner) if o == k]].any(axis=1)] = k
            cols = [b.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string())]
            cols += [pa.array([rules[k][1] if k >= 0 else None for k in best], pa.string()), pa.array([rules[k][0] if k >= 0 else default for k in best], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return src.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))


OP4_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path FROM u),
r AS (SELECT *, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
