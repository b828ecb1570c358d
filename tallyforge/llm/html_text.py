r"""Main text of web pages, by differencing each page with its nearest neighbour by URL.

1. A pass turns each page into lines: one line for each block of text, with its position (the block elements that
   are open, with their classes) and a mark for where it stands (inside an article, outside one, or inside an element
   that is boilerplate by its tag, role or class).
2. Pages are sorted by host and path over all machines; a page's neighbour is the page before or after it on
   the same host whose path shares the longer prefix with its own.  Only keys are sorted, and only hashes of
   lines travel to a neighbour.  Lines are made again in the last pass rather than stored.
3. Each page's lines are aligned with its neighbour's by longest common subsequence (bit-parallel rows).  What both
   share is deleted if it stands where the host repeats itself: at a position where more than half of all lines of the
   host's pages are shared.  So a passage that two articles quote stays, and a notice inside all articles goes.
   A page that shares most lines of its article (or, without an article, all its lines) is a copy of its
   neighbour: it has no say in which positions repeat, but loses its lines there like others.
4. Structure decides on the rest: lines in elements that are boilerplate go, and where an article is marked so does
   what stands outside it.

Defined cases: a null or empty page has empty text; a page alone on its host is judged by its structure; a
null URL, or one without a host, has no neighbour; repeated rows and null ids are extracted each on their own
(a copy of a page under the same URL is not taken for its neighbour); an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import discard, join_groups, materialise, read, row_keys
from tallyforge.llm.url_filter import canonical

#: Elements that are never main text.
DROPPED = frozenset("nav footer aside form script style noscript template iframe svg button select textarea dialog head title object canvas video audio".split())
#: Elements whose content is not markup, and those of them that may hold character references.
RAW = frozenset("script style noscript template iframe svg textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that mark boilerplate, whether other pages repeat it or not.
_MARKS = frozenset(
    "menu menubar navbar nav navigation breadcrumb breadcrumbs footer sidebar complementary contentinfo notice notices cookie cookies consent gdpr "
    "ad ads advert adverts advertisement advertising sponsored comment comments disqus".split()
)
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
_MARKED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_SPLIT = re.compile(r"[^A-Za-z0-9]+")
_CLASS = re.compile(r"""(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
INSIDE, OUTSIDE, BOILERPLATE = 0, 1, 2


def _boilerplate(name: str, attrs: str, in_article: bool) -> bool:
    if name in DROPPED or name == "header" and not in_article:
        return True
    if not attrs or name in ("html", "body"):
        return False
    if _HIDDEN.search(attrs):
        return True
    words = {w.lower() for m in _MARKED.finditer(attrs) for w in _SPLIT.split(m[1] or m[2] or m[3] or "")}
    return bool(words & _MARKS)


def _label(name: str, attrs: str) -> str:
    found = _CLASS.search(attrs) if attrs else None
    return ".".join([name, *sorted((found[1] or found[2] or found[3] or "").split())]) if found else name


def page_lines(page: str | None) -> list[tuple[int, str, int]]:
    """(where, text, position) for each block of text, in page order."""
    out: list[tuple[int, str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, str]] = []  # open elements; whether the element begins boilerplate; its label if a block
    bad = article = seen = 0
    at_path: dict[str, int] = {}

    def close_line() -> None:
        if held:
            line = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if line:
                path = "/".join(label for _, _, label in stack if label)
                if path not in at_path:
                    at_path[path] = line_hash(path)
                out.append((BOILERPLATE if bad else INSIDE if article else OUTSIDE, line, at_path[path]))

    def pop() -> None:
        nonlocal bad, article
        name, was_bad, _ = stack.pop()
        bad -= was_bad
        article -= name in ("article", "main")

    page = page or ""
    at = 0
    while True:
        m = _TAG.search(page, at)
        if not m:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, closing, attrs = m[2].lower(), m[1], m[3]
        if name in BLOCKS:
            close_line()
        elif name == "br":
            held.append(" ")
            continue
        if closing:
            if any(x[0] == name for x in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in VOID or attrs.endswith("/"):
            continue
        if name in BLOCKS and stack and any(x[0] == "p" for x in stack[-4:]):  # a block ends an open paragraph
            while any(x[0] == "p" for x in stack[-4:]):
                pop()
        own = _boilerplate(name, attrs, bool(article))
        if name in ("article", "main") and not own:
            if bad and not seen:  # what should have been closed before the article
                while bad:
                    pop()
            seen += not bad
        stack.append((name, own, _label(name, attrs) if name in BLOCKS else ""))
        bad += own
        article += name in ("article", "main")
        if name in RAW:
            end = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = end.start() if end else len(page)
    close_line()
    return out


def line_hash(line: str) -> int:
    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def shared_lines(a: list[int], b: list[int]) -> set[int]:
    """Positions of ``a`` in a longest common subsequence with ``b``."""
    lo, hi_a, hi_b = 0, len(a), len(b)
    while lo < hi_a and lo < hi_b and a[lo] == b[lo]:
        lo += 1
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
    out = set(range(lo)) | set(range(hi_a, len(a)))
    x, y = a[lo:hi_a], b[lo:hi_b]
    known = set(y)
    keep = [i for i, v in enumerate(x) if v in known]
    if not keep:
        return out
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row, rows = full, []
    for i in keep:  # zero bits of a row: columns where the length grows
        u = row & where[x[i]]
        row = (row + u | row - u) & full
        rows.append(row)
    j = len(y)
    for k in range(len(keep) - 1, -1, -1):
        # the length at (k, j) against (k - 1, j): only a row that adds one has to take its line
        here = (~rows[k] & (1 << j) - 1 & full).bit_count()
        above = (~rows[k - 1] & (1 << j) - 1 & full).bit_count() if k else 0
        if here == above:
            continue
        hits = where[x[keep[k]]] & (1 << j) - 1
        while hits:  # the last column at which this line ends a common subsequence of that length
            c = hits.bit_length() - 1
            before = (~rows[k - 1] & (1 << c) - 1 & full).bit_count() if k else 0
            if before == here - 1:
                out.add(lo + keep[k])
                j = c
                break
            hits ^= 1 << c
    return out


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a page's neighbours have to know: its place and the hashes of its lines; and the lines' places."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("hashes", pa.list_(pa.int64())), ("spots", pa.list_(pa.int64())), ("places", pa.list_(pa.int8()))])
    for b in batches:
        parts = [canonical(u) for u in b.column(3).to_pylist()]
        got = [page_lines(x.as_py()) for x in b.column(4)]
        cols = [pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array([[line_hash(t) for _, t, _ in g] for g in got], pa.list_(pa.int64()))]
        cols += [pa.array([[s for _, _, s in g] for g in got], pa.list_(pa.int64())), pa.array([[w for w, _, _ in g] for g in got], pa.list_(pa.int8()))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], schema=schema)


def is_copy(places: list[int], shared: set[int]) -> bool:
    """Whether a page that shares these lines is a copy of its neighbour."""
    inside = [i for i, w in enumerate(places) if w == INSIDE]
    return 2 * sum(i in shared for i in inside) > len(inside) if inside else len(shared) == len(places)


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which lines of a page its neighbour shares, and whether the page votes."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("host", pa.string()), ("spots", pa.list_(pa.int64())), ("shared", pa.list_(pa.bool_())), ("votes", pa.bool_())])
    for b in batches:
        flags, votes = [], []
        for own, places, theirs in zip(*(b.column(k).to_pylist() for k in (4, 5, 6))):
            shared = shared_lines(own, theirs)
            flags.append([i in shared for i in range(len(own))])
            votes.append(not is_copy(places, shared))
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(flags, pa.list_(pa.bool_())), pa.array(votes, pa.bool_())], schema=schema)


def _texts(structure: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for places, lines, gone in zip(*(b.column(k).to_pylist() for k in range(2, 5))):
                gone, marked = set(gone or []), INSIDE in places
                fits = lambda w: not structure or w == INSIDE or w == OUTSIDE and not marked  # noqa: B023, E731
                texts.append("\n".join(t for i, (w, t) in enumerate(zip(places, lines)) if i not in gone and fits(w)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return run


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("places", pa.list_(pa.int8())), ("lines", pa.list_(pa.string()))])
    for b in batches:
        got = [page_lines(x.as_py()) for x in b.column(4)]
        cols = [pa.array([[w for w, _, _ in g] for g in got], pa.list_(pa.int8())), pa.array([[t for _, t, _ in g] for g in got], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], *cols], schema=schema)


def neighbours(pages: DataFrame) -> DataFrame:
    """``k1, k2, o1, o2``: each page's nearest neighbour by URL, from ``k1, k2, host, path``."""
    named = pages.filter("host <> ''").select("k1", "k2", "host", "path")
    keys = named.groupBy("host", "path").agg(F.min(F.struct("k1", "k2")).alias("k"))  # one row for each URL
    ordered = keys.repartitionByRange("host", "path").sortWithinPartitions("host", "path").withColumn("pos", F.monotonically_increasing_id())
    ordered = materialise(ordered, "html-order")
    part = F.shiftrightunsigned("pos", 33)
    counts = sorted((r["p"], r["n"]) for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row a task
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    table = pages.sparkSession.createDataFrame(offsets or [(-1, 0)], "p long, offset long")
    at = ordered.withColumn("p", part).join(table, "p").select("k", "host", "path", (F.col("offset") + F.col("pos") % F.lit(1 << 33)).alias("idx"))
    at = materialise(at, "html-index")
    steps = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])
    fits = lambda n: (n <= F.length("path")) & (n <= F.length("o_path")) & (F.col("path").substr(F.lit(1), n) == F.col("o_path").substr(F.lit(1), n))
    prefix = F.aggregate(steps, F.lit(0), lambda n, step: F.when(fits(n + step), n + step).otherwise(n))  # a binary search
    near = []
    for step in (1, -1):
        other = at.select((F.col("idx") + step).alias("idx"), F.col("host").alias("o_host"), F.col("path").alias("o_path"), F.col("k").alias("other"))
        pair = at.join(other, "idx").filter("host = o_host")
        near.append(pair.select("host", "path", F.struct(prefix.alias("common"), F.lit(-step).alias("side"), "other").alias("best")))
    best = near[0].unionByName(near[1]).groupBy("host", "path").agg(F.max("best").alias("best"))
    return named.join(best, ["host", "path"]).select("k1", "k2", F.col("best.other.k1").alias("o1"), F.col("best.other.k2").alias("o2"))


def repeated_lines(outline: DataFrame) -> DataFrame:
    """``k1, k2, gone``: the numbers of the lines that differencing deletes."""
    theirs = neighbours(outline).join(outline.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("hashes").alias("theirs")), ["o1", "o2"]).select("k1", "k2", "theirs")
    both = outline.join(theirs, ["k1", "k2"]).select("k1", "k2", "host", "spots", "hashes", "places", "theirs")
    aligned = materialise(both.mapInArrow(_align, "k1 long, k2 long, host string, spots array<long>, shared array<boolean>, votes boolean"), "html-aligned")
    votes = aligned.filter("votes").select("host", F.explode(F.arrays_zip("spots", "shared")).alias("x")).groupBy("host", F.col("x.spots").alias("spot"))
    votes = votes.agg(F.count("*").alias("n"), F.sum(F.col("x.shared").cast("long")).alias("s")).filter("2 * s > n")
    sizes = aligned.groupBy("host").agg(F.count("*").alias("pages"))
    templates = materialise(votes.groupBy("host").agg(F.collect_set("spot").alias("repeat")).join(sizes, "host"), "html-repeats")
    rows = join_groups(aligned, templates, "host", "pages")
    numbers = F.filter(F.sequence(F.lit(0), F.size("spots") - 1), lambda i: F.get("shared", i) & F.array_contains("repeat", F.get("spots", i)))
    return rows.filter("size(spots) > 0 AND repeat IS NOT NULL").select("k1", "k2", numbers.alias("gone")).filter("size(gone) > 0")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", structure: bool = True) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page.  Without ``structure`` differencing alone decides."""
    src = pages.select(*row_keys(id_col, url_col, html_col), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    outline = src.mapInArrow(_outline, "k1 long, k2 long, host string, path string, hashes array<long>, spots array<long>, places array<byte>").dropDuplicates(["k1", "k2"])
    outline = materialise(outline, "html-outline")
    gone = materialise(repeated_lines(outline), "html-gone")
    discard(outline)
    lines = src.mapInArrow(_lines, "k1 long, k2 long, page_id long, url string, places array<byte>, lines array<string>")
    both = lines.join(gone, ["k1", "k2"], "left").select("page_id", "url", "places", "lines", "gone")
    return both.mapInArrow(_texts(structure), "page_id long, url string, text string, n_chars long")


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))
