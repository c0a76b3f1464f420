"""Rows bound by a stream, in every order of arrival, against the batch operator."""

import random
from datetime import datetime as D
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.streaming import binding

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@pytest.fixture
def stateful(spark):
    old = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    yield spark
    spark.conf.set(STORE[0], old)


def told(spark, batches, folder, lateness="3650 days"):
    """Run a stream over batches of (observations, rows), a file each, and give its rows."""
    for i, (obs, rows) in enumerate(batches):
        o = spark.createDataFrame(obs, "kind string, value string, owner string, observed_at timestamp")
        r = spark.createDataFrame(rows, "row_id string, kind string, value string, at timestamp")
        binding.flow(o, r, 2).coalesce(1).write.mode("append").parquet(f"{folder}/in/{i:03d}")
    out = []
    for i in range(len(batches)):  # one folder more each time, under one checkpoint: what came before is not read again
        q = spark.readStream.schema(binding.EVENT).option("recursiveFileLookup", "true").parquet(f"{folder}/in/{{{','.join(f'{k:03d}' for k in range(i + 1))},none}}")
        binding.bind_stream(q, lateness).writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    return out


def test_any_order_gives_the_batch_result(stateful, tmp_path):
    rng = random.Random(2)
    obs = [("upn", rng.choice(["x", "Y ", "z"]), rng.choice(["u1", "u2", None]), D(2026, 1, 1) + timedelta(days=rng.randrange(12))) for _ in range(25)]
    rows = [(f"r{i}", "upn", rng.choice(["x", "y", "z", "q", ""]), D(2025, 12, 30) + timedelta(days=rng.randrange(16), hours=5)) for i in range(30)]
    df = stateful.createDataFrame(obs, "kind string, value string, owner string, observed_at timestamp").withColumn("value", F.lower(F.trim("value")))
    ask = stateful.createDataFrame(rows, "row_id string, kind string, value string, captured_at timestamp").filter("value <> ''")
    want = {r.row_id: (r.status, r.bound) for r in asof.alias_asof(df, ask, asof="captured_at").collect()}
    rng.shuffle(obs)
    out = told(stateful, [([], rows[:20]), (obs[:12], rows[20:]), (obs[12:], [])], tmp_path)
    last = {}
    for r in sorted(out, key=lambda r: r.revision):
        last[r.row_id] = (r.status, r.bound)
    assert last == want
    assert len({(r.row_id, r.revision) for r in out}) == len(out) and max(r.revision for r in out) > 1


def test_times_decide():
    times = [(1, ["a"]), (5, ["a", "b"]), (9, ["c"])]
    assert [binding.outcome(times, t) for t in (0, 1, 4, 5, 10)] == [("unbound", None), ("bound", "a"), ("bound", "a"), ("ambiguous", None), ("bound", "c")]
