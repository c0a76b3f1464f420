"""Entities at a moment and over a period, put together from the as-of, diff and link operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import asof, diff, periods
from .identity import Adapter


def reconstruct(history: DataFrame, targets: DataFrame, asked: DataFrame, columns: Sequence[str], authoritative: Sequence[str], entity: str = "entity", family: str = "family", at: str = "captured_at", target: str = "target") -> DataFrame:
    """One row for each (entity, target): presence, coverage (array of family, status, used, gap_seconds), properties.

    targets: (family, target). asked: (entity, family) pairs of interest. Properties keep their family and time; blanks are
    left out, so a family without the entity adds coverage and no property.
    """
    used = asof.snapshot_asof(history.select(family, at).distinct(), targets, family, at, target)
    status = asof.entity_status(history, used, asked, entity, family, at, target)
    gaps = used.select(target, family, "gap_seconds")
    coverage = status.join(gaps, [target, family]).groupBy(entity, target).agg(F.array_sort(F.collect_list(F.struct(F.col(family).alias("family"), "status", "used", "gap_seconds"))).alias("coverage"))
    who = asof.presence(status, authoritative, entity, family, target)
    state = asof.state_asof(history, used, columns, entity, family, at, target)
    return who.join(coverage, [entity, target]).join(state, [entity, target], "left")


def with_devices(states: DataFrame, devices: DataFrame, entity: str = "entity", target: str = "target") -> DataFrame:
    """States with the devices and device coverage of each (user, target); a state without devices information stays."""
    return states.join(devices.select(F.col("user_id").alias(entity), F.col("captured_at").alias(target), "devices", F.col("coverage").alias("device_coverage")), [entity, target], "left").fillna("no_coverage", ["device_coverage"])


def period_events(history: DataFrame, pairs: DataFrame, columns: Sequence[str], scope: Sequence[str] = (), entity: str = "entity", family: str = "family", at: str = "captured_at") -> tuple[DataFrame, DataFrame]:
    """(events, notes): changes of every entity between the two snapshots of each family and period, and the families without a pair.

    Events: entity, family, period, scope..., change, changes. All entities, families and periods meet in one full outer join.
    """
    props = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(c), F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("v")) for c in columns)), lambda x: x.v != ""))
    by = [entity, family, "period", *scope]

    def side(which: str) -> DataFrame:
        picked = pairs.filter("reason = 'ok'").select(family, "period", F.col(which).alias(at))
        return history.join(picked, [family, at]).select(*by, props.alias("properties"))

    events = diff.map_diff(side("baseline"), side("latest"), by).filter("change <> 'unchanged'")
    return events, pairs.filter("reason <> 'ok'").select(family, "period", F.col("reason").alias("note"))


def changes_between(before: DataFrame, after: DataFrame, entity: str = "entity") -> DataFrame:
    """Two states of entities (arrays of properties as reconstruct() gives them): scalar changes by (family, name)."""
    long = lambda df, name: df.select(entity, F.explode("properties").alias("p")).select(entity, "p.family", "p.name", F.col("p.value").alias(name))
    both = long(before, "before").join(long(after, "after"), [entity, "family", "name"], "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "modified")
    return both.withColumn("change", change).filter("change is not null")


def relationships(rows: DataFrame, adapter: Adapter, entity: str = "entity", *keep: str) -> DataFrame:
    """entity, family, scope, properties and the kept columns of a family's rows: what each row says of its entity, for `diff.relationship_diff`."""
    return rows.select(entity, F.lit(adapter.family).alias("family"), adapter.row_scope(rows.columns).alias("scope"), adapter.card(rows.columns).alias("properties"), *keep)


def state_changes(before: DataFrame, after: DataFrame, before_rows: DataFrame, after_rows: DataFrame, entity: str = "entity") -> tuple[DataFrame, DataFrame]:
    """Two states of entities: (changes of their scalar properties, changes of their relationships)."""
    return changes_between(before, after, entity), diff.relationship_diff(before_rows, after_rows, entity)


def recent(history: DataFrame, reference, columns: Sequence[str] = (), family: str = "family", at: str = "captured_at", key: str = "key", says: Column | None = None, partial: DataFrame | None = None, spans: dict[str, int] | None = None) -> DataFrame:
    """The recent-changes report over all families and periods, in its order.

    says: a row's evidence under its family's rules (see `plans.families.says`), by default of all `columns`. partial:
    (family, captured_at) of snapshots that were not wholly retrieved. spans: the periods, in hours.
    """
    pairs = periods.period_pairs(history.select(family, at), reference, spans, family=family, at=at)
    return periods.report_order(periods.period_changes(history, pairs, columns, family, at, key, says, partial), family)
