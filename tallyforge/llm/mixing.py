"""Mixing sources to target weights by a low-discrepancy schedule.

Each source is a line of words: its documents in an order that a hash of id and text fixes, cut into blocks of
``block_tokens`` words.  A source's target is an integral number of words, so it needs so many slots; a
golden-ratio sequence over the cumulative slot counts says which source each slot of the mix belongs to,
slots are ranked within their source, and rank r takes block ``r mod blocks`` of pass ``r div blocks``.
Slots past a source's target are not used, and a source that the finite sequence left short gets its last
slots at the end, so what a source gives is its target to the word.

No step gathers a source in one task: positions and ranks are prefix sums over (source, chunk), and only
per-source and per-chunk totals meet in a window.  The table of sources has one row a source; its targets depend on
all others' and are made in one task.

The schedule decides when each document comes: ``first_slot`` is where the mix takes its first word for the first
time, and `mixed` gives whole documents in the order of their slots.

Defined cases: a null text has size 0 and is never taken; null is a source of its own, last in order; null
ids and repeated ids are documents like others; rows alike in id, text and source are interchangeable, and
`mixed` gives as many of them as are due to all of them; a source without words has target 0; an empty table gives an
empty result; other columns pass through `mixed`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import finished, keyed, materialise, read, row_keys, with_keys, word_count

#: Weights dealt to sources in order.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CEILING = 2.0
BLOCK_TOKENS = 4096
CHUNK_DOCS = 2048
CHUNK_SLOTS = 4096
#: The golden ratio's fraction in 2^40ths, odd so that the sequence visits every point.
_M = 1 << 40
_GOLDEN = 679_531_297_215 | 1
_BINS = 1024


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """``source, source_size, src, weight, target`` from ``source, source_size``.

    The share of all words is split by weight; no target passes ``ceiling`` times its source's size, and
    what is cut off goes to the others by weight.  With sources sorted by ceiling over weight, the level at
    which the first uncapped source stands is the level of all uncapped ones.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    t = sizes.withColumn("src", F.row_number().over(order) - 1).withColumn("weight", w).withColumn("cap", F.col("source_size") * ceiling)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("total", F.sum("source_size").over(everything) * share)
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    t = t.withColumn("level", F.max(free).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return t.select("source", "source_size", "src", "weight", target.cast("double").alias("target"))


def _prefix(df: DataFrame, keys: list[str], chunk: str, value, out: str) -> DataFrame:
    """Per (keys, chunk): the sum of ``value`` over earlier chunks."""
    sums = df.groupBy(*keys, chunk).agg(value.alias("_v"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, chunk, F.coalesce(F.sum("_v").over(before), F.lit(0)).cast("long").alias(out))


def placed(docs: DataFrame, seed: int) -> DataFrame:
    """``doc_id, k1, k2, source, size, start``: where each document stands on its source's line of words."""
    d = materialise(docs.withColumn("ord", F.xxhash64(F.lit(seed), "k1", "k2")), "mix-docs")
    n = d.count()
    bits = max(0, (max(1, n) // CHUNK_DOCS).bit_length())
    d = d.withColumn("chunk", F.shiftright("ord", 63 - bits) if bits else F.lit(0).cast("long"))
    d = d.withColumn("s", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))))
    offsets = _prefix(d, ["s"], "chunk", F.sum("size"), "offset")
    run = Window.partitionBy("s", "chunk").orderBy("ord", "k1", "k2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("upto", F.sum("size").over(run))
    d = d.join(offsets, ["s", "chunk"])
    return d.select("doc_id", "k1", "k2", "source", "size", (F.col("offset") + F.col("upto") - F.col("size")).alias("start"))


def schedule(targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``slot, src, rank, epoch, block, tokens``: the mix, slot by slot."""
    spark = targets.sparkSession
    b = F.lit(block_tokens)
    t = (
        targets.withColumn("words", F.least(F.round("target"), F.floor(F.col("source_size") * CEILING)).cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / b))
        .filter("source_size > 0 AND words > 0")
        .withColumn("full", F.floor(F.col("words") / F.col("source_size")))
        .withColumn("rest", F.col("words") - F.col("full") * F.col("source_size"))
        .withColumn("slots", F.col("full") * F.col("blocks") + F.ceil(F.col("rest") / b))
        .withColumn("hi", F.sum("slots").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)))
    )
    t = materialise(t.select("src", "source_size", "blocks", "full", "rest", "slots", "hi"), "mix-targets")
    total = t.agg(F.max("hi")).first()[0] or 0
    point = lambda c: F.floor(c / F.lit(float(max(1, total))) * F.lit(float(_M)))
    ranges = t.select("src", "slots", point(F.col("hi") - F.col("slots")).alias("lo"), point(F.col("hi")).alias("up"))
    width = _M // _BINS
    # each source under every bin that its range touches: at most one row a bin and one a source
    ranges = ranges.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("up") - 1) / width))))
    high = _GOLDEN * (1 << 20) % _M
    i = F.col("id") + 1
    x = (F.shiftright(i, 20) * F.lit(high) + (i % (1 << 20)) * F.lit(_GOLDEN)) % F.lit(_M)
    slots = spark.range(total).select(F.col("id").alias("slot"), x.alias("x")).withColumn("bin", F.floor(F.col("x") / width))
    hit = slots.join(ranges, "bin").filter("x >= lo AND x < up").select("slot", "src", "slots", F.floor(F.col("slot") / CHUNK_SLOTS).alias("chunk"))
    offsets = _prefix(hit, ["src"], "chunk", F.count("*"), "offset")
    inside = Window.partitionBy("src", "chunk").orderBy("slot")
    ranked = hit.withColumn("r", F.row_number().over(inside) - 1).join(offsets, ["src", "chunk"])
    ranked = materialise(ranked.select("slot", "src", "slots", (F.col("offset") + F.col("r")).alias("rank")), "mix-ranked")
    used = ranked.filter("rank < slots").select("slot", "src", "rank")
    got = ranked.groupBy("src").agg(F.count("*").alias("got"))
    short = t.join(got, "src", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < slots")
    late = short.select("src", F.explode(F.sequence("got", F.col("slots") - 1)).alias("rank")).select((F.lit(total) + F.col("rank")).alias("slot"), "src", "rank")
    out = used.unionByName(late).join(t, "src")
    out = out.withColumn("epoch", F.floor(F.col("rank") / F.col("blocks"))).withColumn("block", F.col("rank") % F.col("blocks"))
    whole = F.least(b, F.col("source_size") - F.col("block") * b)
    last = (F.col("rank") == F.col("slots") - 1) & (F.col("rest") > 0)
    tokens = F.when(last, F.col("rest") - F.col("block") * b).otherwise(whole)
    return out.select("slot", "src", "rank", "epoch", "block", tokens.cast("long").alias("tokens"))


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, block_tokens: int, seed: int) -> tuple[DataFrame, DataFrame]:
    sized = docs.select(F.col(id_col).alias("doc_id"), *row_keys(id_col, text_col, source_col), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    at = materialise(placed(sized, seed), "mix-placed")
    targets = materialise(source_targets(at.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-sources")
    plan = materialise(schedule(targets, block_tokens), "mix-schedule")
    d = at.join(targets, at["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    # a block is taken once in a pass, so this gathers a few slots
    takes = plan.groupBy("src", "block", "tokens").agg(F.count("*").alias("times"), F.collect_list("slot").alias("at"))
    end = F.col("start") + F.col("size")
    pieces = d.filter("size > 0").select("src", "start", end.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / block_tokens), F.floor((end - 1) / block_tokens))).alias("block"))
    from_ = F.greatest(F.col("start"), F.col("block") * block_tokens)
    to = F.least(F.col("end"), F.col("block") * block_tokens + F.col("tokens"))
    first = (F.col("start") >= F.col("block") * block_tokens) & (F.col("start") < to)
    taken = (
        pieces.join(takes, ["src", "block"])
        .groupBy("src", "start")
        .agg(F.sum(F.greatest(to - from_, F.lit(0)) * F.col("times")).alias("t"), F.array_sort(F.flatten(F.collect_list(F.when(first, F.col("at"))))).alias("slots"))
    )
    # a document without words shares its start with the next one: it has no row to meet
    key = F.when(F.col("size") > 0, F.col("start")).otherwise(F.lit(-1))
    out = d.withColumn("start", key).join(taken, ["src", "start"], "left")
    return out.withColumn("taken", F.coalesce("t", F.lit(0)).cast("long")), plan


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_tokens: int = BLOCK_TOKENS, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(documents, schedule).  Documents: ``doc_id, size, source, source_size, target, taken, copies, first_slot``;
    ``copies`` counts the passes that take the document's first word, ``first_slot`` is where the first does."""
    out, plan = _mix(docs, id_col, text_col, source_col, block_tokens, seed)
    copies = F.coalesce(F.size("slots"), F.lit(0)).cast("long")
    return out.select("doc_id", "size", "source", "source_size", "target", "taken", F.when(copies > 0, copies).otherwise(0).alias("copies"), F.array_min("slots").alias("first_slot")), plan


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_tokens: int = BLOCK_TOKENS, seed: int = 17) -> DataFrame:
    """The mix as whole documents, with all their columns, in the order of their slots: partitions follow one
    another, and rows in them.  A document comes once for every pass that takes its first word."""
    found, plan = _mix(docs, id_col, text_col, source_col, block_tokens, seed)
    places = F.transform("slots", lambda x: F.struct(x.alias("slot"), F.col("start")))
    due = found.filter(F.size("slots") > 0).groupBy("k1", "k2").agg(F.flatten(F.collect_list(places)).alias("places"))
    copies = found.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1").select("k1", "k2")
    due = materialise(due.join(copies.withColumn("many", F.lit(True)), ["k1", "k2"], "left"), "mix-due")
    rows = keyed(docs, id_col, text_col, source_col)
    got = rows.join(due.filter("many IS NULL"), ["k1", "k2"])
    got = got.unionByName(with_keys(rows, due.filter("many")).dropDuplicates(["k1", "k2"]).select(*got.columns))
    got = got.select("row", F.explode("places").alias("place"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = (plan.agg(F.max("slot")).first()[0] or 0) + 1
    part = F.least(F.floor(F.col("place.slot") * n / total), F.lit(n - 1)).cast("int")
    return got.repartitionById(n, part).sortWithinPartitions("place").select("row.*")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return finished(lambda: mix(read(spark, sf_dir, "documents"))[0].drop("copies"), "mix-result")
