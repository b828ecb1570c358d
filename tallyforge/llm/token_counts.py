"""Token counts by a separator scan over flat, unindexed token files.

A flat token file is a stream of unsigned ids of 16 or 32 bits (``width`` bytes) in which an end-of-document id closes
each document.  Files are cut into blocks of a fixed number of tokens wherever that falls; a task opens a file at its
offset and reads a range of blocks, so that a file may be of any size.  Each block is scanned by itself:
one vectorised comparison finds its separators and yields the lengths of the documents that end in it and the
tail that it leaves open.  A prefix scan over the blocks of a file then stitches: the number of separators
before a block numbers its documents, and the open tails since the last separator lengthen its first one.

`flatten` writes such files in the shared folder, one for each task, and keeps which document is which.  Its separator
is the first id that the vocabulary does not have, so that nothing in a text can be taken for one: ``<|endoftext|>``
in a text is a token like others.

Defined cases: a null or empty text has 0 tokens; null ids and repeated rows are documents of their own; tokens after
the last separator of a file are a document only if there are any; an empty file has no documents, and an empty table
gives an empty result; a file whose length isn't a whole number of tokens is an error; in a file that was written
elsewhere every ``eod`` id is a separator; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm import common
from tallyforge.llm.bpe import default_path, encoder, read_spec
from tallyforge.llm.common import finished, materialise, read, scratch_dir

BLOCK_TOKENS = 1 << 16
#: Blocks that one task reads from a file.
RANGE = 64
#: Tasks that ranges are spread over, at most.
MOST_TASKS = 50_000
#: Blocks of a file that one window takes; totals of such runs meet in a second, much smaller window.
RUN = 1024


def id_width(eod: int) -> int:
    """Bytes of an id."""
    return 2 if eod < 1 << 16 else 4


def opens(path: str) -> bool:
    """Whether executors can open files of this store by themselves."""
    try:
        pafs.FileSystem.from_uri(path)
    except Exception:  # a scheme that Arrow doesn't know, or lacks a library for
        return False
    return True


def read_flat(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, width: int = 2) -> DataFrame:
    """``file, block, data`` from files of ids.  Where only Spark's readers can open the files, each is read as a
    whole by one task, and may hold 2 GB at most."""
    files = spark.read.format("binaryFile").load(path)
    size = width * block_tokens
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("data", pa.binary())])

    def rows(name: str, first: int, data: bytes) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(data), size):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first + k // size], pa.int64()), pa.array([bytes(data[k : k + size])], pa.binary())], schema=schema)

    def whole(name: str, length: int) -> None:
        if length % width:
            raise ValueError(f"{name}: {length} bytes are no whole number of tokens")

    def of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                view = memoryview(data.as_buffer())
                whole(name, len(view))
                yield from rows(name, 0, view)

    def of_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, length, at in zip(*(c.to_pylist() for c in b.columns)):
                whole(name, length)
                store, own = pafs.FileSystem.from_uri(name)
                with store.open_input_file(own) as f:
                    yield from rows(name, at // size, f.read_at(min(length - at, size * RANGE), at))

    out = "file string, block long, data binary"
    if not opens(path):
        return files.select("path", "content").mapInArrow(of_files, out)
    ranges = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size * RANGE))).alias("at"))
    tasks = max(1, min(ranges.count(), MOST_TASKS))
    return ranges.repartition(tasks, "path", "at").mapInArrow(of_ranges, out)


def scan_block(data: bytes, eod: int, width: int = 2) -> tuple[int, int, int, list[int]]:
    """(separators, tokens before the first, tokens after the last, lengths of the documents between)."""
    ids = np.frombuffer(data, f"<u{width}")
    at = np.flatnonzero(ids == eod)
    if not len(at):
        return 0, len(ids), len(ids), []
    return len(at), int(at[0]), len(ids) - int(at[-1]) - 1, (np.diff(at) - 1).tolist()


def count_tokens(blocks: DataFrame, eod: int, width: int = 2) -> DataFrame:
    """``file, ordinal, n_tokens`` for each document of ``file, block, data``."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seps", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("inner", pa.list_(pa.int64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan_block(x.as_py() or b"", eod, width) for x in b.column(2)]
            cols = [pa.array([r[k] for r in rows], schema.types[k + 2]) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], schema=schema)

    src = blocks.select(F.col("file").cast("string").alias("file"), F.col("block").cast("long").alias("block"), "data")
    scanned = src.mapInArrow(scan, "file string, block long, seps long, head long, tail long, inner array<long>")
    scanned = materialise(scanned.withColumn("run", F.floor(F.col("block") / RUN)), "tokens-scanned")
    # before a block: separators so far, and tokens since the last of them
    inside = Window.partitionBy("file", "run").orderBy("block")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    t = scanned.withColumn("seps_in", F.coalesce(F.sum("seps").over(earlier), F.lit(0)))
    # tokens of blocks without a separator add up; a block with one starts again from its tail
    t = t.withColumn("part", F.sum(F.when(F.col("seps") > 0, 1).otherwise(0)).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    since = Window.partitionBy("file", "run", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("open_after", F.sum("tail").over(since))
    t = t.withColumn("open_in", F.coalesce(F.lag("open_after").over(inside), F.lit(0))).withColumn("fresh", F.col("seps_in") == 0)
    last = F.max_by("open_after", "block")
    runs = t.groupBy("file", "run").agg(F.sum("seps").alias("run_seps"), last.alias("run_open"))
    over = Window.partitionBy("file").orderBy("run")
    runs = runs.withColumn("seps_before", F.coalesce(F.sum("run_seps").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = runs.withColumn("run_part", F.sum(F.when(F.col("run_seps") > 0, 1).otherwise(0)).over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.withColumn("carry_after", F.sum("run_open").over(Window.partitionBy("file", "run_part").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.withColumn("carry", F.coalesce(F.lag("carry_after").over(over), F.lit(0))).select("file", "run", "seps_before", "carry")
    t = t.join(runs, ["file", "run"])
    first = F.col("head") + F.col("open_in") + F.when(F.col("fresh"), F.col("carry")).otherwise(0)
    lens = F.when(F.col("seps") > 0, F.concat(F.array(first), F.col("inner"))).otherwise(F.array().cast("array<bigint>"))
    closed = t.select("file", (F.col("seps_before") + F.col("seps_in")).alias("base"), F.posexplode(lens).alias("k", "n_tokens"))
    closed = closed.select("file", (F.col("base") + F.col("k")).alias("ordinal"), "n_tokens")
    # what a file leaves open at its end
    ends = t.groupBy("file").agg(F.sum("seps").alias("ordinal"), F.max_by(F.col("open_after") + F.when((F.col("seps") == 0) & F.col("fresh"), F.col("carry")).otherwise(0), "block").alias("n_tokens"))
    return closed.unionByName(ends.filter("n_tokens > 0").select("file", "ordinal", "n_tokens"))


def flatten(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame, int]:
    """Encodes ``docs`` into one flat file for each task: (blocks, order, separator).  ``order`` says which document
    is which: ``file, ordinal, doc_id``.  Where executors can't open files of the shared folder by themselves, the
    streams are a table of blocks in it."""
    spark = docs.sparkSession
    text = read_spec(path)
    eod = len(encoder(text).token)
    width, spec = id_width(eod), spark.sparkContext.broadcast(text)
    folder = f"{scratch_dir(spark)}/tallyforge/tokens-{uuid.uuid4().hex}"
    files = opens(folder)
    if files:
        common.made(folder)
        store, own = pafs.FileSystem.from_uri(folder)
        store.create_dir(own, recursive=True)
    schema = pa.schema([("kind", pa.string()), ("file", pa.string()), ("number", pa.int64()), ("doc_id", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        enc, file = encoder(spec.value), f"stream-{task.partitionId():06d}"
        row = lambda kind, k, d, x: pa.RecordBatch.from_arrays([pa.array([kind] * len(k)), pa.array([file] * len(k)), pa.array(k, pa.int64()), pa.array(d, pa.int64()), pa.array(x, pa.binary())], schema=schema)
        out, block, held, n_held, ordinal = None, 0, [], 0, 0
        for b in batches:
            for t in b.column(1):
                held.append(np.array([*enc.encode(t.as_py()), eod], f"<u{width}"))
                n_held += len(held[-1])
                if n_held < block_tokens:
                    continue
                flat = np.concatenate(held)
                cut = len(flat) // block_tokens * block_tokens
                if files:
                    out = out or _Output(folder, file, task.taskAttemptId())
                    out.write(flat[:cut])
                else:
                    yield row("data", range(block, block + cut // block_tokens), [None] * (cut // block_tokens), [x.tobytes() for x in flat[:cut].reshape(-1, block_tokens)])
                block += cut // block_tokens
                held, n_held = [flat[cut:]], len(flat) - cut
            yield row("order", range(ordinal, ordinal + b.num_rows), b.column(0).to_pylist(), [None] * b.num_rows)
            ordinal += b.num_rows
        if n_held and not files:
            yield row("data", [block], [None], [np.concatenate(held).tobytes()])
        elif n_held or out:
            out = out or _Output(folder, file, task.taskAttemptId())
            out.write(np.concatenate(held))
            out.done()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    got = materialise(src.mapInArrow(run, "kind string, file string, number long, doc_id long, data binary"), "tokens-order", ["kind"])
    order = got.filter("kind = 'order'").select("file", F.col("number").alias("ordinal"), "doc_id")
    if not files:
        return got.filter("kind = 'data'").select("file", F.col("number").alias("block"), "data"), order, eod
    blocks = read_flat(spark, folder, block_tokens, width)
    return blocks.withColumn("file", F.element_at(F.split("file", "/"), -1)), order, eod


class _Output:
    """A file that appears under its name when it is whole: a task that is run again replaces it."""

    def __init__(self, folder: str, name: str, attempt: int):
        self.store, own = pafs.FileSystem.from_uri(folder)
        self.name, self.draft = f"{own}/{name}", f"{own}/_{name}.{attempt}"  # readers pass over names with a line in front
        self.stream = self.store.open_output_stream(self.draft)

    def write(self, ids: np.ndarray) -> None:
        self.stream.write(ids.tobytes())

    def done(self) -> None:
        self.stream.close()
        self.store.move(self.draft, self.name)


def token_counts(docs: DataFrame, path: str, block_tokens: int = BLOCK_TOKENS, **cols) -> DataFrame:
    """``doc_id, n_tokens`` for every row, counted in the files that `flatten` writes."""
    blocks, order, eod = flatten(docs, path, block_tokens=block_tokens, **cols)
    return order.join(count_tokens(blocks, eod, id_width(eod)), ["file", "ordinal"]).select("doc_id", "n_tokens")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return finished(lambda: token_counts(read(spark, sf_dir, "documents"), default_path()), "tokens-result")
