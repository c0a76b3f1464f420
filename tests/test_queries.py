"""Every query with SQL against DuckDB on the smallest tables, and the driver's contract."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.plans import card_queries, history_queries, more_queries, record_queries  # noqa: F401
from tidemark.plans import queries as Q


def canonical(rows):
    def one(x):
        if x is None:
            return "null"
        if isinstance(x, float | int):
            return f"{round(float(x), 9):.9f}"
        return str(x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query_against_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    df = Q.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = canonical([tuple(r[c] for c in cols) for r in df.collect()])
    r = con.execute(Q.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == canonical([tuple(x[names.index(c)] for c in cols) for x in r.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_component_events_takes_tied_lines_alike(spark, tmp_path):
    """Rows of a line that have one part are a tie that the SQL leaves open: what it says of both sides is the same whichever it takes."""
    rows = [(1, 1, 7, "R", 5.0), *((1, 3, 7, "R", q) for q in (9.0, 10.0)), (2, 5, 7, "R", 5.0), *((2, 2, 7, "R", q) for q in (10.0, 9.0))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_quantity double").repartition(4, "l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, Q.QUERIES["component_events"](spark, str(tmp_path)).collect()))
    assert got == [(1, "1", "removed"), (2, "2", "changed"), (2, "5", "added")]


def test_recent_rules_rounds_halves_as_sql(spark, tmp_path):
    """Values that end in a half go to the even number, as SQL casts them."""
    import duckdb

    rows = [(i, f"2024-01-{d:02d} 10:00:00", 1, "click", v, "{}") for i, (d, v) in enumerate([(2, 2.0), (2, 1.0), (29, 2.5), (29, 1.0)])]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    df = Q.QUERIES["recent_rules"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"set TimeZone = 'UTC'; create view events as select * replace (ts::TIMESTAMP AS ts) from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(df.columns)} from ({Q.ORACLES['recent_rules']})").fetchall()
    assert canonical([tuple(r) for r in df.collect()]) == canonical(want) and "unchanged" in {r.status for r in df.collect()}
