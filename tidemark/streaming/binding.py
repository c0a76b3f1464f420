"""Rows bound to their owners by alias as a stream: identity files may come before, with or after the rows that need them.

Each alias is a key with state: its observation times, each with the owners seen then (two at most, which is enough to tell
one from several), and the rows that wait, each with the outcome last told. A row is told an outcome when it comes, and told
another whenever an observation that comes later changes it, with a higher revision; the last revision of each row is what
`asof.bind_rows` gives over everything read, whatever the order of arrival. A timer drops rows whose time lies further back
than the allowed lateness, and observation times that no later row can ask for.

An alias that a third of all rows have is spread over SALTS keys: rows by their id, observations to all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SALTS = 4
#: What flows: observations have an owner and no row_id, rows the other way round.
EVENT = "kind string, value string, salt int, at timestamp, row_id string, owner string"
BOUND = "row_id string, kind string, value string, at timestamp, status string, bound string, revision int"


def flow(observations: DataFrame, rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """Observations (kind, value, owner, observed_at) and rows (row_id, kind, value, at) as one flow of events; blank aliases and null owners or times are left out, as they bind nothing."""
    alias = [F.col("kind").cast("string").alias("kind"), F.lower(F.trim("value")).alias("value")]
    none = F.lit(None).cast("string")
    seen = observations.filter("owner is not null").select(*alias, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col("observed_at").cast("timestamp").alias("at"), none.alias("row_id"), F.col("owner").cast("string").alias("owner"))
    own = rows.filter("row_id is not null").select(*alias, F.pmod(F.xxhash64(F.col("row_id").cast("string")), F.lit(salts)).cast("int").alias("salt"), F.col("at").cast("timestamp").alias("at"), F.col("row_id").cast("string").alias("row_id"), none.alias("owner"))
    return seen.unionByName(own).filter("value <> '' and at is not null")


class Binder(StatefulProcessor):
    """State of one alias. lateness: milliseconds behind the watermark until rows and times are dropped."""

    def __init__(self, lateness: int) -> None:
        self.lateness = lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "at long", "owners array<string>")
        self.waiting = handle.getMapState("waiting", "row_id string", "at long, status string, bound string, revision int")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        changed, new = None, {}
        for part in rows:
            for at, row_id, owner in zip(part["at"].astype("datetime64[us]").astype("int64").tolist(), part["row_id"].tolist(), part["owner"].tolist(), strict=True):
                if isinstance(row_id, str):
                    new[row_id] = at
                    continue
                have = list(self.seen.getValue((at,))[0]) if self.seen.containsKey((at,)) else []
                if owner not in have and len(have) < 2:
                    self.seen.updateValue((at,), ([*have, owner],))
                    changed = at if changed is None else min(changed, at)
        times = sorted((k[0], list(v[0])) for k, v in self.seen.iterator())
        asked = {r: (at, None, None, 0) for r, at in new.items() if not self.waiting.containsKey((r,))}
        if changed is not None:  # rows from before the earliest news stay as they are
            asked |= {k[0]: tuple(v) for k, v in self.waiting.iterator() if v[0] >= changed}
        out = []
        for row_id, (at, status, bound, revision) in sorted(asked.items()):
            now = outcome(times, at)
            if now != (status, bound):
                self.waiting.updateValue((row_id,), (at, *now, revision + 1))
                out.append((row_id, *key[:2], pd.Timestamp(at, unit="us"), *now, revision + 1))
        if new:
            self._wake(min(new.values()))
        names = [f.split()[0] for f in BOUND.split(", ")]
        yield pd.DataFrame(out, columns=names)

    def _wake(self, at: int) -> None:
        """One timer a key, for its oldest row."""
        due = at // 1000 + self.lateness
        if not any(t <= due for t in self.handle.listTimers()):
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        limit = (timerValues.getCurrentWatermarkInMs() - self.lateness) * 1000
        left = []
        for k, v in list(self.waiting.iterator()):
            if v[0] <= limit:
                self.waiting.removeKey(k)
            else:
                left.append(v[0])
        old = sorted(k[0] for k, _ in self.seen.iterator() if k[0] <= limit)
        for at in old[:-1]:  # the newest of the old times still answers
            self.seen.removeKey((at,))
        if left:
            self._wake(min(left))
        yield pd.DataFrame({f.split()[0]: [] for f in BOUND.split(", ")})

    def close(self) -> None:
        pass


def outcome(times: list[tuple[int, list[str]]], at: int) -> tuple[str, str | None]:
    """(status, owner) at a time, given observation times in order with their owners."""
    last = None
    for t, owners in times:
        if t > at:
            break
        last = owners
    if not last:
        return "unbound", None
    return ("bound", last[0]) if len(last) == 1 else ("ambiguous", None)


def bind_stream(events: DataFrame, lateness: str = "30 days") -> DataFrame:
    """BOUND rows of a stream of EVENT rows (see `flow`): an append for each outcome, and for each that changes it.

    lateness: how far behind the newest event time an event may come and still count. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass).
    """
    spark = events.sparkSession
    milliseconds = int(spark.sql(f"SELECT CAST(unix_millis(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {lateness}) AS BIGINT)").first()[0])
    keyed = events.withWatermark("at", lateness).groupBy("kind", "value", "salt")
    return keyed.transformWithStateInPandas(Binder(milliseconds), BOUND, "Append", "EventTime")


def latest(told: DataFrame) -> DataFrame:
    """The last outcome of each row: row_id, status, bound."""
    best = told.groupBy("row_id").agg(F.max_by(F.struct("status", "bound"), "revision").alias("_o"))
    return best.select("row_id", "_o.status", "_o.bound")


def reason(status: Column | str, kind: str = "upn") -> Column:
    """Why a row is not bound, as `asof.bind_rows` says it; null where it is."""
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s != "bound", F.concat(s, F.lit(f"_{kind}")))
