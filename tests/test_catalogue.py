"""Every query with SQL against DuckDB on the smallest tables; streams against the same plan on a table."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge import queries
from tallyforge.streaming import windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return c


def plain(rows):
    def one(v):
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
        return None if v is None else str(v)

    return sorted((tuple(one(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = df.select(*[f"`{c}`" for c in cols]).collect()
    if name not in queries.SQL:
        assert got
        return
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert plain(got) == plain(con.execute(f"SELECT {quoted} FROM ({queries.SQL[name]})").fetchall())


def test_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windows.windowed_counts(stream, "event_type").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert plain(spark.table("counts").collect()) == plain(windows.windowed_counts(events, "event_type").collect())


def test_percentages_in_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    seen = []
    sink = windows.percentages_by_batch(lambda df, _: seen.append(df.agg(F.sum("pct").alias("s"), F.count_distinct("start").alias("n")).first()))
    q = windows.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "event_type").writeStream.outputMode("complete").foreachBatch(sink).start()
    q.processAllAvailable()
    q.stop()
    assert seen and abs(seen[-1]["s"] - 100 * seen[-1]["n"]) <= 3 * seen[-1]["n"]


def test_plans_push_down(spark):
    plan = queries.pct_event_type(spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<event_type:string>" in plan
    banner = queries.banner_flags(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_comment" not in banner and "l_extendedprice" not in banner.split("Relation")[0]
