"""Validity intervals of states, links and aliases, and as-of questions answered from them.

Equal states of consecutive snapshots are one row with `valid_from` and `valid_until` (exclusive; null while it lasts), found
by gaps and islands: a state begins a new island where the snapshot before lacks its key or has another state. So a history
of daily dumps that hardly change shrinks to its changes, and no as-of question reads whole snapshots again.

Questions meet intervals by an equi-join on dyadic buckets: a time line of 2 ** LEVELS units is a binary tree, an interval
falls into at most two nodes a level, a moment lies in one node of each level, and an interval that covers a moment shares
exactly one node with it. No pair is made twice and none by comparing everything with everything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket, and levels of buckets: 2 ** 16 days are 179 years from 1970 on, beyond which times share the last bucket.
UNIT, LEVELS = 86_400, 16


def _unit(t: Column | str, unit: int) -> Column:
    """The bucket of a time; times off the line fall into its first or last one."""
    return F.greatest(F.lit(0), F.least(F.floor(F.unix_seconds(F.col(t) if isinstance(t, str) else t) / unit), F.lit((1 << LEVELS) - 1))).cast("long")


def _shift(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x, level)


def covering(first: Column, last: Column) -> Column:
    """Array of (level, node): the nodes whose buckets are exactly first to last, of which no two overlap."""
    levels = F.sequence(F.lit(0), F.lit(LEVELS))

    def at(level: Column) -> Column:
        a = _shift(first + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
        b = _shift(last + 1, level)
        node = lambda n: F.struct(level.cast("int").alias("level"), n.alias("node"))
        return F.array(F.when((a < b) & (a % 2 == 1), node(a)), F.when((a < b) & (b % 2 == 1), node(b - 1)))

    return F.array_compact(F.flatten(F.transform(levels, at)))


def holding(bucket: Column) -> Column:
    """Array of (level, node): the node of each level in which a bucket lies."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda level: F.struct(level.cast("int").alias("level"), _shift(bucket, level).alias("node")))


def interval_join(intervals: DataFrame, probes: DataFrame, by: Sequence[str], at: str = "target", unit: int = UNIT) -> DataFrame:
    """probes with the columns of each interval that holds at their time: valid_from <= at < valid_until, equal in `by`.

    A probe that no interval covers, or with a null time, gives no row. Intervals that begin where they end hold nothing.
    """
    far = F.lit((1 << LEVELS) - 1).cast("long")
    last = F.when(F.col("valid_until").isNull(), far).otherwise(_unit("valid_until", unit))
    spread = intervals.withColumn("_n", F.explode(covering(_unit("valid_from", unit), last)))
    asked = probes.filter(F.col(at).isNotNull()).withColumn("_n", F.explode(holding(_unit(at, unit))))
    met = asked.join(spread, [*by, "_n"])
    return met.filter((F.col("valid_from") <= F.col(at)) & (F.col("valid_until").isNull() | (F.col(at) < F.col("valid_until")))).drop("_n")


def numbered(snapshots: DataFrame, family: str = "family", at: str = "captured_at") -> DataFrame:
    """family, at, seq and next_at of each snapshot: one row for each, in a window of one family's snapshots."""
    w = Window.partitionBy(family).orderBy(at)
    return snapshots.select(family, at).distinct().withColumn("_seq", F.row_number().over(w)).withColumn("_next", F.lead(at).over(w))


def state_intervals(history: DataFrame, state: Column, entity: str | Sequence[str] = "entity", family: str = "family", at: str = "captured_at", snapshots: DataFrame | None = None) -> DataFrame:
    """family, entity, state, valid_from, valid_until, n_snapshots: what each entity's rows said, and from when to when.

    history has a row for each entity in each of its family's snapshots. snapshots: (family, at) of all of them, where some
    may hold no row; by default those of the history. An entity that a snapshot lacks has no state until it comes back. Rows
    without an entity or a time are left out; of repeated rows of one snapshot the greatest state counts; a null state is a
    state as others are. A window holds one entity's snapshots of one family.
    """
    key = [entity] if isinstance(entity, str) else list(entity)
    rows = history.withColumn("state", state).dropna(subset=[*key, at]).groupBy(family, *key, at).agg(F.max(F.struct("state")).alias("_s"))
    rows = rows.join(numbered(history if snapshots is None else snapshots, family, at), [family, at])
    w = Window.partitionBy(family, *key).orderBy("_seq")
    begins = (F.lag("_seq").over(w).isNull()) | (F.lag("_seq").over(w) != F.col("_seq") - 1) | ~F.lag("_s").over(w).eqNullSafe(F.col("_s"))
    rows = rows.withColumn("_begins", begins.cast("int")).withColumn("_island", F.sum("_begins").over(w))
    out = rows.groupBy(family, *key, "_island").agg(F.first("_s").alias("_s"), F.min(at).alias("valid_from"), F.max(F.struct(at, "_next")).alias("_last"), F.count(F.lit(1)).alias("n_snapshots"))
    return out.select(family, *key, F.col("_s.state").alias("state"), "valid_from", F.col("_last._next").alias("valid_until"), "n_snapshots")


def states_at(intervals: DataFrame, targets: DataFrame, family: str = "family", target: str = "target", unit: int = UNIT) -> DataFrame:
    """Every entity's state at each (family, target): what `asof.rows_asof` reads from whole snapshots."""
    return interval_join(intervals, targets.select(family, target).distinct(), [family], target, unit)


def link_intervals(merged: DataFrame, snapshots: DataFrame | None = None, at: str = "captured_at") -> DataFrame:
    """device, status, user_id, valid_from, valid_until, n_snapshots of merged links (`links.merge_links`) over all captures.

    snapshots: the capture times there are, by default those of the links; a device that one of them lacks has no link then.
    """
    one = lambda df: df.withColumn("family", F.lit(""))
    out = state_intervals(one(merged), F.struct("status", "user_id"), "device", at=at, snapshots=None if snapshots is None else one(snapshots))
    return out.select("device", "state.status", "state.user_id", "valid_from", "valid_until", "n_snapshots")


def devices_at(intervals: DataFrame, users: DataFrame, at: str = "captured_at", unit: int = UNIT) -> DataFrame:
    """user_id, time, device: the devices that resolved links give each (user_id, time) asked for."""
    own = intervals.filter("status = 'resolved'").select("user_id", "device", "valid_from", "valid_until")
    return interval_join(own, users.select("user_id", at).distinct(), ["user_id"], at, unit).select("user_id", at, "device")


def alias_intervals(observations: DataFrame, alias: Sequence[str] = ("kind", "value"), owner: str = "owner", at: str = "observed_at") -> DataFrame:
    """alias, owners (count), owner (where there is one), valid_from, valid_until: who an alias named from when to when.

    What was observed holds until the alias is observed again; equal owners of consecutive observations are one interval.
    Owners are counted, and told apart by their sums of hashes, with partial aggregates, so no list of them is built.
    """
    seen = observations.filter(F.col(owner).isNotNull()).select(*alias, F.col(at).alias("_t"), F.col(owner).cast("string").alias("_o")).distinct()
    seen = seen.groupBy(*alias, "_t").agg(F.count(F.lit(1)).alias("owners"), F.min("_o").alias("_least"), F.sum(F.xxhash64("_o").cast("decimal(38,0)")).alias("_sum"))
    w = Window.partitionBy(*alias).orderBy("_t")
    who = F.struct("owners", "_least", "_sum")
    seen = seen.withColumn("_begins", F.coalesce((F.lag(who).over(w) != who).cast("int"), F.lit(1)))
    starts = seen.filter("_begins = 1")
    return starts.select(*alias, "owners", F.when(F.col("owners") == 1, F.col("_least")).alias("owner"), F.col("_t").alias("valid_from"), F.lead("_t").over(w).alias("valid_until"))


def bind_asof(intervals: DataFrame, probes: DataFrame, alias: Sequence[str] = ("kind", "value"), at: str = "asof", unit: int = UNIT) -> DataFrame:
    """probes with status (bound, ambiguous, unbound) and bound (the owner where there is one), from alias intervals."""
    asked = probes.select(*alias, at).distinct()
    met = interval_join(intervals, asked, alias, at, unit).select(*alias, at, "owners", "owner")
    rows = probes.join(met, [*alias, at], "left")
    status = F.when(F.col("owners").isNull(), "unbound").when(F.col("owners") == 1, "bound").otherwise("ambiguous")
    return rows.select(*(F.col(f"`{c}`") for c in probes.columns), status.alias("status"), F.col("owner").alias("bound"))
