"""Snapshot pairs by period, calendars and run health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import diff

# Look-back periods in hours.
PERIODS = {"24 hours": 24, "48 hours": 48, "3 days": 72, "7 days": 168, "15 days": 360, "30 days": 720}


def adjacent_pairs(snapshots: DataFrame, family: str = "family", at: str = "captured_at") -> DataFrame:
    """Each snapshot with the one before it."""
    return snapshots.withColumn("before", F.lag(at).over(Window.partitionBy(family).orderBy(at))).filter("before is not null")


def latest_previous(snapshots: DataFrame, family: str = "family", at: str = "captured_at") -> DataFrame:
    """latest and previous snapshot of each family."""
    top = snapshots.groupBy(family).agg(F.max(at).alias("latest"))
    rest = snapshots.join(top, family).filter(F.col(at) < F.col("latest")).groupBy(family).agg(F.max(at).alias("previous"))
    return top.join(rest, family, "left")


def period_pairs(snapshots: DataFrame, reference: Column, periods: dict[str, int] | None = None, family: str = "family", at: str = "captured_at") -> DataFrame:
    """family, period, latest, baseline, reason: the newest snapshot, and the newest not later than reference minus period.

    The newest counts even where it is later than the reference. Reasons, in order: `single` (one snapshot), `stale` (the
    latest is not later than the cutoff), `no_baseline`, `ok`. One aggregate over snapshots times periods.
    """
    own = F.array(*(F.struct(F.lit(k).alias("period"), F.lit(h).alias("hours")) for k, h in (periods or PERIODS).items()))
    rows = snapshots.select(family, at).distinct().withColumn("_p", F.explode(own)).withColumn("_cut", reference - F.make_interval(hours=F.col("_p.hours")))
    out = rows.groupBy(family, F.col("_p.period").alias("period")).agg(F.max(at).alias("latest"), F.max(F.when(F.col(at) <= F.col("_cut"), F.col(at))).alias("baseline"), F.count(F.lit(1)).alias("_n"), F.first("_cut").alias("_cut"))
    reason = F.when(F.col("_n") < 2, "single").when(F.col("latest") <= F.col("_cut"), "stale").when(F.col("baseline").isNull(), "no_baseline").otherwise("ok")
    return out.withColumn("reason", reason).select(family, "period", "latest", F.when(F.col("reason") == "ok", F.col("baseline")).alias("baseline"), "reason")


def period_changes(history: DataFrame, pairs: DataFrame, columns: Sequence[str] = (), family: str = "family", at: str = "captured_at", key: str = "key", says: Column | None = None, partial: DataFrame | None = None) -> DataFrame:
    """family, period, status (changed, partial, unchanged, no_data), added, removed, changed: all families and periods in one job.

    Rows of the two snapshots of each pair are picked by a join with the small pair table and meet in one aggregate by key.
    says: a row's evidence, by default of all `columns`. partial: (family, captured_at) of snapshots that were not wholly
    retrieved; a pair with one of them is partial, whatever its counts.
    """
    h = diff.evidence(columns) if says is None else says
    ok = pairs.filter("reason = 'ok'").select(family, "period", F.explode(F.array(F.struct(F.col("latest").alias("t"), F.lit(1).alias("side")), F.struct(F.col("baseline").alias("t"), F.lit(0).alias("side")))).alias("s"))
    rows = history.select(family, at, key, h.alias("_h")).join(ok.select(family, "period", F.col("s.t").alias(at), "s.side"), [family, at])
    keys = rows.groupBy(family, "period", key).agg(F.max(F.when(F.col("side") == 1, F.col("_h"))).alias("_a"), F.max(F.when(F.col("side") == 0, F.col("_h"))).alias("_b"))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counted = keys.groupBy(family, "period").agg(n(F.col("_b").isNull()).alias("added"), n(F.col("_a").isNull()).alias("removed"), n(diff.differs("_a", "_b")).alias("changed"))
    own = pairs
    if partial is not None:
        flags = partial.select(family, at).distinct()
        latest, base = (flags.select(family, F.col(at).alias(c), F.lit(True).alias(f"_{c}")) for c in ("latest", "baseline"))
        own = pairs.join(latest, [family, "latest"], "left").join(base, [family, "baseline"], "left").withColumn("_partial", F.coalesce("_latest", "_baseline", F.lit(False)))
    out = own.select(family, "period", "reason", *(["_partial"] if partial is not None else [])).join(counted, [family, "period"], "left").fillna(0, ["added", "removed", "changed"])
    status = F.when(F.col("reason") != "ok", "no_data").when(F.col("_partial") if partial is not None else F.lit(False), "partial").when(F.col("added") + F.col("removed") + F.col("changed") > 0, "changed").otherwise("unchanged")
    return out.withColumn("status", status).select(family, "period", "status", "reason", "added", "removed", "changed")


def rollup(changes: DataFrame) -> DataFrame:
    """Per period: families by status and totals."""
    n = lambda s: F.count_if(F.col("status") == s)
    return changes.groupBy("period").agg(n("changed").alias("families_changed"), n("unchanged").alias("families_unchanged"), n("no_data").alias("families_no_data"), *(F.sum(c).alias(c) for c in ("added", "removed", "changed")))


def report_order(changes: DataFrame, family: str = "family") -> DataFrame:
    """Rows with their place in the report: changed, partial, unchanged, no_data, then by family."""
    rank = F.when(F.col("status") == "changed", 0).when(F.col("status") == "partial", 1).when(F.col("status") == "unchanged", 2).otherwise(3)
    return changes.withColumn("place", F.row_number().over(Window.partitionBy("period").orderBy(rank, F.lower(family), family)))


def business_days(reference: Column, days: int, scheduled_hour: int = 1) -> Column:
    """Array of the last `days` weekdays up to the reference; its own day counts once the scheduled hour has come."""
    day = F.to_date(reference)
    last = F.when(F.hour(reference) >= scheduled_hour, day).otherwise(F.date_sub(day, 1))
    weekdays = F.filter(F.sequence(F.date_sub(last, 2 * days + 6), last), lambda d: F.weekday(d) < 5)
    return F.slice(weekdays, F.greatest(F.lit(1), F.size(weekdays) - days + 1), days)


def latest_of_day(snapshots: DataFrame, family: str = "family", at: str = "captured_at") -> DataFrame:
    return snapshots.groupBy(family, F.to_date(at).alias("day")).agg(F.max(at).alias(at))


def run_health(snapshots: DataFrame, reference: Column, days: int, scheduled_hour: int = 1, grace_hours: int = 6, attention: Column | None = None, family: str = "family", at: str = "captured_at") -> DataFrame:
    """Per family over the last business days: expected, observed, missing, late, attention, coverage, status, place.

    A run after the scheduled hour plus grace is late, not missing. attention: flag of a snapshot that needs a look.
    """
    marked = snapshots.withColumn("_flag", attention if attention is not None else F.lit(False))
    own = marked.groupBy(family, F.to_date(at).alias("day")).agg(F.max(at).alias("_t"), F.max_by("_flag", at).alias("_flag"))
    want = snapshots.select(family).distinct().withColumn("day", F.explode(business_days(reference, days, scheduled_hour)))
    late = (F.col("_t").cast("double") - F.col("day").cast("timestamp").cast("double")) > (scheduled_hour + grace_hours) * 3600
    rows = want.join(own, [family, "day"], "left")
    out = rows.groupBy(family).agg(F.count(F.lit(1)).alias("expected"), F.count("_t").alias("observed"), F.count_if(F.col("_t").isNull()).alias("missing"), F.count_if(late).alias("late"), F.count_if("_flag").alias("attention"))
    coverage = F.col("observed") / F.col("expected")
    status = (
        F.when(F.col("expected") == 0, "No schedule window").when(F.col("attention") > 0, "Attention").when((F.col("missing") == 0) & (F.col("late") == 0), "Healthy")
        .when(F.col("missing") == 0, "Completed late").when(coverage >= 0.8, "Attention").otherwise("Missing runs")
    )
    out = out.withColumn("coverage", coverage).withColumn("status", status)
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.col("status") == "Healthy", F.lower(family), family)))  # one row a family


def run_totals(health: DataFrame) -> DataFrame:
    return health.agg(F.sum("observed").alias("observed"), F.sum("expected").alias("expected"), F.sum("missing").alias("missing"), F.round(F.sum("observed") / F.sum("expected"), 6).alias("coverage"))


def policy_period_pairs(anchors: DataFrame, bundles: DataFrame, reference: Column, periods: dict[str, int] | None = None, key: str = "snapshot_id", at: str = "captured_at") -> DataFrame:
    """period_pairs of one policy family over its bundles: only those that an anchor names, by the bundle's own time.

    Reasons differ: no bundle is `not_enough_snapshots`, one is `no_baseline`; a baseline needs a known time.
    """
    own = bundles.join(anchors.select(key).distinct(), key, "left_semi").select(key, at)
    spans = anchors.sparkSession.createDataFrame(list((periods or PERIODS).items()), "period string, hours int").withColumn("_cut", reference - F.make_interval(hours=F.col("hours")))
    newest = own.agg(F.max(at).alias("latest"), F.count(F.lit(1)).alias("_n"))  # one row
    rows = spans.join(newest).join(own.select(F.col(at).alias("_t")), F.col("_t") <= F.col("_cut"), "left")
    out = rows.groupBy("period").agg(F.first("latest").alias("latest"), F.first("_n").alias("_n"), F.first("_cut").alias("_cut"), F.max("_t").alias("_base"))
    reason = F.when(F.col("_n") == 0, "not_enough_snapshots").when(F.col("_n") < 2, "no_baseline").when(F.col("latest") <= F.col("_cut"), "stale").when(F.col("_base").isNull(), "no_baseline").otherwise("ok")
    return out.withColumn("reason", reason).select("period", "latest", F.when(F.col("reason") == "ok", F.col("_base")).alias("baseline"), "reason")
