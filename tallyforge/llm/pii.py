r"""Personal data: pattern spans that always stay, and further candidates that boosted trees judge.

Base kinds (leftmost, non-overlapping per kind): ``email``, ``ip`` (each part at most 255), ``card`` (12 to
19 digits that pass the Luhn test) and ``phone`` (a plus sign and 9 to 15 digits).  A match that fails its
test is dropped and the search goes on behind it.

High-recall generators propose more spans: written-out addresses (``name (at) host dot tld``), phone numbers without a
plus sign, card numbers with other separators, bare runs of digits (as a phone number and as a card), veiled and IPv6
addresses, and long strings that may be keys (a fifth kind, ``secret``).  They propose freely and overlap.
Gradient-boosted trees over the candidate's format and the words around it score each one; a threshold for each kind,
calibrated for precision on examples of shapes that the trees haven't seen, selects.  Of candidates that overlap,
the one that passes its threshold by most is kept; a base span wins against any.  The examples are a bounded table
(`FILLS` for each shape of `FIT` and `CALIBRATE`), spelled out from templates, so fitting costs one tiny job whatever
the input.

Everything that touches documents is a built-in expression.  The patterns start only where a run of their
characters starts (``\G`` or a look-behind) and use possessive or bounded repeats, which gives the same matches in time
linear in the text and without recursion.  Offsets come from the texts between matches, summed in blocks.

Defined cases: a null text counts as empty; a text without spans has zero counts, the hash of the empty
string and an empty span list; repeated rows and null ids are judged each on their own; other columns of
the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.boosting import Booster, calibrated_threshold
from tallyforge.llm.common import read, text_of

#: Kinds of base spans, and the one that only generators propose.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Fixed patterns, in a form that Java's matcher runs without recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # runs of under 12 digits fail anyway, and no match can start inside one
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further candidates: (kinds that a match may be, pattern).
GENERATORS = (
    (("email",), r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[(\[{](?i:at)[)\]}]\x20?|\x20(?i:at)\x20)[A-Za-z0-9-]{2,64}+(?:(?:\x20?[(\[{](?i:dot)[)\]}]\x20?|\x20(?i:dot)\x20|\.)[A-Za-z0-9-]{2,24}+){1,4}"),
    (("phone",), r"(?<![A-Za-z0-9.+(/-])(?:00[1-9][0-9]{0,2}[\x20.-])?(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?:[\x20.-][0-9]{3,4})?(?![0-9A-Za-z-])"),
    (("card",), r"(?<![A-Za-z0-9./-])[0-9]{4}([./_])(?:[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{6}\1[0-9]{5})(?![0-9A-Za-z/-])"),
    (("phone", "card"), r"(?<![0-9A-Za-z.+/_-])[0-9]{9,19}+(?![0-9A-Za-z/_-])"),
    (("ip",), r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20\.\x20)[0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])"),
    (("secret",), r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{20,128}+={0,2}(?![A-Za-z0-9+/_=-])"),
)
CONTEXT_CHARS = 24
CUES = (
    r"(?i)\b(?:tel|telephone|phone|call|dial|fax|mobile|cell|whatsapp|ring)\b",
    r"(?i)\b(?:card|visa|mastercard|amex|pay|paid|credit|debit)\b",
    r"(?i)\b(?:mail|e-?mail|contact|reach|write|address)\b",
    r"(?i)(?:token|secret|password|passwd|pwd|api.?key|\bkey|credential|bearer|auth)[a-z]*[\"']?\s*[:=]?\s*[\"']?$",
    r"(?i)\b(?:ip|host|server|address|from|login)\b",
)
AGAINST = r"(?i)\b(?:version|isbn|serial|model|order|ref|part|item|ticket|build|sku|page|sum|total|commit|checksum|sha|md5|id|no|number|path|file|at|time)\W*$"
PRECISION = 0.98
#: Examples of each shape.
FILLS = 12
_RUN = 128


def _ok(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(m, r"\."), lambda p: F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 3).cast("int") <= 255)
    if kind == "card":
        return n.between(12, 19) & F.when(n.between(12, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _tested(kind: str):
    return lambda x: _ok(kind, x["m"])


def _proposed(found: Column, k: int) -> Column:
    """(s, e, m) to (s, k, e, m), without those whose number of digits the kind can't have."""
    low, high = {"phone": (9, 15), "card": (12, 19)}.get(KINDS[k], (0, 1 << 30))
    fits = F.filter(found, lambda x: F.length(F.regexp_replace(x["m"], "[^0-9]", "")).between(low, high))
    return F.transform(fits, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["m"].alias("m")))


def _named(found: Column, k: int) -> Column:
    """(s, e, m) to (s, k, e, kind)."""
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(KINDS[k]).alias("kind")))


def _spans(df: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """Adds ``out``: array of (s, e, m) for the matches of ``pattern``, in code points."""
    hits, gaps, lens = f"{out}_hits", f"{out}_gaps", f"{out}_lens"
    df = df.withColumn(hits, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    some = F.size(hits) > 0
    df = df.withColumn(gaps, F.when(some, F.split(F.col(text), pattern, -1)))
    # i-th step: the gap before match i and the match itself
    df = df.withColumn(lens, F.when(some, F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), F.col(hits), lambda g, m: (F.length(g) + F.length(m)).cast("long"))))
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / _RUN).cast("int")), lambda r: add(F.slice(lens, r * _RUN + 1, F.lit(_RUN))))
    df = df.withColumn(f"{out}_runs", F.when(some, runs))
    heads = F.transform(F.sequence(F.lit(1), F.size(f"{out}_runs")), lambda r: add(F.slice(f"{out}_runs", F.lit(1), r - 1)))
    df = df.withColumn(f"{out}_heads", F.when(some, heads))

    def span(m, i):
        r = F.floor(i / _RUN).cast("int")
        end = F.get(f"{out}_heads", r) + add(F.slice(lens, r * _RUN + 1, i - r * _RUN + 1))
        return F.struct((end - F.length(m)).alias("s"), end.alias("e"), m.alias("m"))

    df = df.withColumn(out, F.when(some, F.transform(hits, span)).otherwise(F.array().cast("array<struct<s:bigint,e:bigint,m:string>>")))
    return df.drop(hits, gaps, lens, f"{out}_runs", f"{out}_heads")


def _features(k: Column, m: Column, before: Column, after: Column) -> list[Column]:
    """Numbers about a candidate: its kind, its format, and what stands around it."""
    digits, letters = F.regexp_replace(m, "[^0-9]", ""), F.regexp_replace(m, "[^A-Za-z]", "")
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0)).cast("double")
    return [
        *[flag(k == i) for i in range(len(KINDS))],
        F.length(m).cast("double"),
        F.length(digits).cast("double"),
        F.length(letters).cast("double"),
        (F.length(m) - F.length(digits) - F.length(letters)).cast("double"),
        F.size(F.array_distinct(F.split(m, ""))).cast("double"),
        flag(F.call_function("luhn_check", F.when(digits == "", "1").otherwise(digits))),
        flag(m.rlike(r"^(?:\(|0)")),
        flag(m.rlike(r"(?i)[(\[{](?:at|dot|\.)[)\]}]")),
        flag(m.rlike(r"(?i)\sdot\s")),
        flag(m.rlike(r"[A-Fa-f]") & ~m.rlike(r"[G-Zg-z]")),
        F.size(F.split(m, ":")).cast("double"),
        F.size(F.split(m, "/")).cast("double"),
        F.size(F.split(m, "-")).cast("double"),
        flag(digits.rlike("^(?:[0-5][0-9])+$")),
        *[flag(before.rlike(cue)) for cue in CUES],
        flag(before.rlike(AGAINST)),
        flag(before.rlike(r"[$€£#]\s*$")),
        flag(before.rlike(r"[:=][\"'\s]*$")),
        flag(after.rlike(r"^\s*[%=*]")),
    ]


#: Shapes of the labelled examples: (kind, text before, template, text after, label).  # stands for a digit, L for one
#: that makes the number pass the Luhn test, ~ for a hexadecimal digit, ^ for a letter or digit, @ for a small letter.
FIT = (
    ("phone", "please call ", "(###) ###-####", " today", 1),
    ("phone", "tel: ", "###-###-####", ".", 1),
    ("phone", "mobile ", "###.###.####", " or", 1),
    ("phone", "the office phone is ", "0## #### ####", ",", 1),
    ("phone", "dial ", "00## ## #### ####", " now", 1),
    ("phone", "words in a line ", "(###) ###-####", " and", 1),
    ("phone", "fax ", "##########", "", 1),
    ("phone", "order ", "###-###-####", " shipped", 0),
    ("phone", "serial ", "### ### ####", "", 0),
    ("phone", "words in a line ", "### ### ####", " and more", 0),
    ("phone", "sum total = ", "###.###.####", " =", 0),
    ("phone", "words $", "### ### ####", "", 0),
    ("phone", "words in a line ", "##########", " and more", 0),
    ("phone", "words in a line ", "############", " and more", 0),
    ("phone", "ref ", "###########", "", 0),
    ("email", "write to ", "@@@@(at)@@@@(dot)org", "", 1),
    ("email", "my mail: ", "@@.@@ [at] @@@@@ [dot] net", " ok", 1),
    ("email", "words ", "@.@ (at) @@@@.com", "", 1),
    ("email", "in a line ", "@@@@@(at)@@@@@@.net", " and", 1),
    ("email", "words ", "@@@[at]@@@@.org", " words", 1),
    ("email", "words ", "@@@@@@[at]@@@@@@.de", "", 1),
    ("email", "contact ", "@@@@ at @@@@@ dot com", ", please", 1),
    ("email", "words ", "@@@@@ at @@@@@@ dot org", "", 1),
    ("email", "she ", "@@@@@@ at @@@@@.com", " again", 0),
    ("email", "we ", "@@@@@ at @@@@.Then", " came", 0),
    ("card", "card ", "####.####.####.###L", " exp", 1),
    ("card", "paid with visa ", "####_####_####_###L", "", 1),
    ("card", "words ", "####.######.####L", " words", 1),
    ("card", "part ", "####.####.####.####", "", 0),
    ("card", "words ", "####/####/####/####", " words", 0),
    ("card", "words ", "################", " words", 0),
    ("card", "order ", "#############", "", 0),
    ("card", "words ", "####.######.#####", " words", 0),
    ("card", "model ", "####_####_####_####", "", 0),
    ("ip", "server ", "##[.]##[.]#[.]1##", " is down", 1),
    ("ip", "words ", "1##(.)##(.)##(.)#", "", 1),
    ("ip", "host ", "2001:db8:~~~~::~~~~:~~~~", "", 1),
    ("ip", "words ", "fe80::~~~~:~~~~:~~~~:~~~~", " words", 1),
    ("ip", "words ", "~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~", "", 1),
    ("ip", "at ", "1#:2#:3#", " sharp", 0),
    ("ip", "words ", "0#:1#:2#", "", 0),
    ("ip", "words ", "#:##:##:##", "", 0),
    ("secret", 'token = "', "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~", '" words', 1),
    ("secret", "api_key: ", "^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^", "", 1),
    ("secret", "password=", "^^^^^^^^^^^^^^^^^^^^^^", " words", 1),
    ("secret", "Authorization: Bearer ", "^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^", "", 1),
    ("secret", "commit ", "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~", " words", 0),
    ("secret", "words ", "@@@@@@@@@@@@@@@@@@@@@@@@", " words", 0),
    ("secret", "words ", "@@@@@@-@@@@@-@@@@-@@@@@@@", "", 0),
    ("secret", "file ", "/@@@/@@@@@/@@@/@@@@@@@@", "", 0),
    ("secret", "words ", "~~~~~~~~-~~~~-~~~~-~~~~-~~~~~~~~~~~~", "", 0),
    ("secret", "words ", "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~", " words", 0),
    ("secret", "words ", "#####################", " words", 0),
)
#: Other shapes, for the thresholds.
CALIBRATE = (
    ("phone", "ring us: ", "(0##) ### ####", " soon", 1),
    ("phone", "whatsapp ", "###-###-####", "", 1),
    ("phone", "words ", "(0##) ####-####", "", 1),
    ("phone", "cell ", "###########", " please", 1),
    ("phone", "sku ", "###-###-####", "", 0),
    ("phone", "build ", "###.###.####", "", 0),
    ("phone", "of the ", "### ### #### ####", " in", 0),
    ("phone", "of the ", "#########", " in", 0),
    ("phone", "of the ", "#############", " in", 0),
    ("email", "e-mail ", "@@@@{at}@@@@{dot}de", "", 1),
    ("email", "reach ", "@@@ at @@@@@@@ dot net", "", 1),
    ("email", "of ", "@@@@[at]@@@@@.org", "", 1),
    ("email", "he ", "@@@@ at @@@@@@@.net", " twice", 0),
    ("card", "mastercard ", "####/####/####/###L", "", 1),
    ("card", "of ", "####_####_####_###L", " in", 1),
    ("card", "of ", "####_####_####_####", " in", 0),
    ("card", "ticket ", "###############", "", 0),
    ("card", "of ", "##################", " in", 0),
    ("ip", "login from ", "##(.)#(.)1##(.)##", "", 1),
    ("ip", "of ", "2a00:~~~~:~~~~::~~", " in", 1),
    ("ip", "time ", "1#:5#:0#", "", 0),
    ("ip", "of ", "1#:0#:4#", " in", 0),
    ("secret", "secret: '", "^^^^^^^^^^^^^^^^^^^^^^^^^^", "'", 1),
    ("secret", "auth_token=", "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~", "", 1),
    ("secret", "sha ", "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~", "", 0),
    ("secret", "of ", "@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@", " in", 0),
    ("secret", "path ", "@@@@/@@@@@@@/@@@@@/@@@@@@", "", 0),
    ("secret", "of ", "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~", " in", 0),
)
_ALPHABETS = {"#": "0123456789", "~": "0123456789abcdef", "^": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "@": "abcdefghijklmnopqrstuvwxyz"}


def spelled(shapes, fills: int = FILLS, state: int = 12345) -> list[tuple[int, str, str, str, int]]:
    """(kind, text, before, after, label) of ``fills`` spellings of each shape, the same each time.  A number that
    passes the Luhn test by chance where the shape doesn't ask for it is spelled again."""
    out = []
    for kind, before, shape, after, label in shapes:
        done = 0
        while done < fills:
            text = ""
            for ch in shape:
                state = (state * 1103515245 + 12345) % (1 << 31)
                if ch == "L":
                    ch = str(-_luhn_sum(text + "0") % 10)
                text += _ALPHABETS[ch][(state >> 16) % len(_ALPHABETS[ch])] if ch in _ALPHABETS else ch
            if kind == "card" and "L" not in shape and _luhn_sum(text) % 10 == 0:
                continue
            out.append((KINDS.index(kind), text, before, after, label))
            done += 1
    return out


def _luhn_sum(text: str) -> int:
    digits = [int(c) for c in reversed(text) if c.isdigit()]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits))


_FITTED: dict[float, tuple[Booster, tuple[float, ...]]] = {}


def fit_judge(spark: SparkSession, precision: float = PRECISION) -> tuple[Booster, tuple[float, ...]]:
    """Trees fitted on `FIT`, and a threshold for each kind from `CALIBRATE`."""
    if precision not in _FITTED:
        quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
        fit, other = spelled(FIT), spelled(CALIBRATE, state=54321)
        values = ", ".join(f"({i}, {k}, {quote(m)}, {quote(b)}, {quote(a)}, {y})" for i, (k, m, b, a, y) in enumerate([*fit, *other]))
        table = spark.sql(f"SELECT * FROM VALUES {values} AS t(i, k, m, b, a, y)")
        got = table.select("i", "k", "y", F.array(*_features(F.col("k"), F.col("m"), F.col("b"), F.col("a"))).alias("x")).orderBy("i").collect()
        judge = Booster(trees=24).fit([list(r["x"]) for r in got[: len(fit)]], [r["y"] for r in got[: len(fit)]])
        held = [(r["k"], judge.margin(r["x"]), r["y"]) for r in got[len(fit) :]]
        cuts = [calibrated_threshold([m for k, m, _ in held if k == kind], [y for k, _, y in held if k == kind], precision) for kind in range(len(KINDS))]
        _FITTED[precision] = judge, tuple(max(c, 0.0) for c in cuts)  # at least even odds
    return _FITTED[precision]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """``doc_id, text, base, added``: two arrays of (s, k, e, kind), sorted, in code points."""
    judge, cuts = fit_judge(docs.sparkSession, precision)
    df = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    span = "array<struct<s:bigint,k:int,e:bigint,kind:string>>"
    for k, kind in enumerate(BASE_KINDS):
        df = _spans(df, "text", BASE[kind], f"b_{kind}")
        df = df.withColumn(f"b_{kind}", _named(F.filter(f"b_{kind}", _tested(kind)), k))
    df = df.withColumn("base", F.array_sort(F.concat(*[f"b_{k}" for k in BASE_KINDS])).cast(span)).drop(*[f"b_{k}" for k in BASE_KINDS])
    for n, (kinds, pattern) in enumerate(GENERATORS):
        df = _spans(df, "text", pattern, f"c_{n}")
        df = df.withColumn(f"c_{n}", F.concat(*[_proposed(F.col(f"c_{n}"), KINDS.index(kind)) for kind in kinds]))
    df = df.withColumn("found", F.concat(*[f"c_{n}" for n in range(len(GENERATORS))])).drop(*[f"c_{n}" for n in range(len(GENERATORS))])

    def seen(x):
        from_ = F.greatest(x["s"] - CONTEXT_CHARS, F.lit(0))
        before = F.col("text").substr((from_ + 1).cast("int"), (x["s"] - from_).cast("int"))
        after = F.col("text").substr((x["e"] + 1).cast("int"), F.lit(CONTEXT_CHARS))
        return F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.array(*_features(x["k"], x["m"], before, after)).alias("x"))

    def scored(x):
        over = judge.column([F.get(x["x"], F.lit(i)) for i in range(judge.width)]) - F.get(F.array(*[F.lit(float(c)) for c in cuts]), x["k"])
        return F.struct(over.alias("over"), (-x["s"]).alias("first"), x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))

    # the rest is done for texts with candidates only
    some = F.size("found") > 0
    df = df.withColumn("found", F.when(some, F.transform("found", seen)))
    df = df.withColumn("found", F.when(some, F.filter(F.transform("found", scored), lambda x: x["over"] >= 0)))
    meets = lambda x, y: (y["s"] < x["e"]) & (x["s"] < y["e"])
    beaten = lambda x: F.exists("base", lambda b: meets(x, b)) | F.exists("found", lambda y: meets(x, y) & (y > x))
    best = F.transform(F.filter("found", lambda x: ~beaten(x)), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.get(F.array(*[F.lit(k) for k in KINDS]), x["k"]).alias("kind")))
    added = F.coalesce(F.array_sort(best).cast(span), F.array().cast(span))
    return df.withColumn("added", added).select("doc_id", "text", "base", "added")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(df: DataFrame) -> DataFrame:
    """``doc_id, text`` with every span of ``personal_data``'s result replaced by its kind in brackets.
    Spans that overlap are replaced once, by the kind that starts first."""
    spans = F.array_sort(F.concat("base", "added"))
    kept = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, x: F.when(
            x["s"] >= acc["at"],
            F.struct(x["e"].alias("at"), F.concat(acc["out"], F.array(F.col("text").substr((acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int")), F.concat(F.lit("["), x["kind"], F.lit("]")))).alias("out")),
        ).otherwise(F.struct(acc["at"].alias("at"), acc["out"].alias("out"))),
    )
    df = df.withColumn("_k", kept)
    return df.select("doc_id", F.concat(F.array_join("_k.out", ""), F.col("text").substr((F.col("_k.at") + 1).cast("int"), F.length("text"))).alias("text"))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    found = personal_data(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_sort(F.concat("base", "added"))
    return found.select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        F.size(spans).cast("long").alias("n_spans"),
    )
