"""Answers counted in event-time windows.  Each function is a plan that a streaming and a batch DataFrame
both take; a watermark only matters to the first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S


def _marked(df: DataFrame, ts: str, late: str) -> DataFrame:
    """A stream with its watermark, which needs a time stamp with a zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if df.isStreaming else df


def windowed_counts(df: DataFrame, answer: str, ts: str = "ts", width: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """``start, end, answer, n`` in tumbling or sliding windows."""
    d = _marked(df, ts, late)
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    d = d.withColumn(answer, S.na_blank(answer)).filter(F.col(answer).isNotNull())
    return d.groupBy(w.alias("w"), answer).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), answer, "n")


def windowed_summary(df: DataFrame, value: str, ts: str = "ts", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """``start, end, n, mean, sd`` of a number."""
    d = _marked(df, ts, late)
    v = F.col(value).cast("double")
    return d.groupBy(F.window(ts, width).alias("w")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "sd")


def windowed_nps(df: DataFrame, value: str, ts: str = "ts", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """``start, end, n, nps``."""
    d = _marked(df, ts, late)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    d = d.withColumn("__g", S.nps_group(value, dtype=kinds[value])).filter("__g IS NOT NULL")
    return d.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), S.r_round(F.avg("__g") * 100, 0).alias("nps")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "nps")


def sessions(df: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """``key, start, end, n`` of runs of events with no longer pause than ``gap``."""
    d = _marked(df, ts, late)
    return d.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def percentages_by_batch(sink):
    """A ``foreachBatch`` function: shares within each window of a micro-batch of ``windowed_counts`` in
    complete mode go to ``sink(df, batch_id)``."""
    from pyspark.sql import Window

    def run(batch: DataFrame, batch_id: int) -> None:
        whole = Window.partitionBy("start", "end")
        sink(batch.withColumn("pct", S.r_round(F.col("n") / F.sum("n").over(whole) * 100, 0)), batch_id)

    return run
