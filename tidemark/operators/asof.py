"""As-of joins at the level of snapshots and of aliases, and states of entities at a time.

No snapshot later than the target is ever used, and a row that its family's chosen snapshot lacks is absent: earlier rows
are not carried forward.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_asof(snapshots: DataFrame, targets: DataFrame, family: str = "family", at: str = "captured_at", target: str = "target") -> DataFrame:
    """For targets (family, target): target, family, used (the newest capture time not later than the target, null if none), gap_seconds.

    Snapshots and targets meet on the time line of each family: a union ordered by time and the last capture seen so far,
    so the cost is a sort of both, never their product.
    """
    lines = snapshots.select(family, F.col(at).alias("_t"), F.col(at).alias("_s"), F.lit(None).cast("timestamp").alias(target)).distinct()
    asks = targets.select(family, target).distinct()
    asks = asks.select(family, F.col(target).alias("_t"), F.lit(None).cast("timestamp").alias("_s"), F.col(target).cast("timestamp").alias(target))
    w = Window.partitionBy(family).orderBy("_t", F.col(target).isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_t", F.col("_t").cast("timestamp")).withColumn("_s", F.col("_s").cast("timestamp")).unionByName(asks.withColumn("_t", F.col("_t").cast("timestamp"))).withColumn("used", F.last("_s", ignorenulls=True).over(w))
    return rows.filter(F.col(target).isNotNull()).select(target, family, "used", F.timestamp_diff("SECOND", "used", target).alias("gap_seconds"))


def for_every_family(snapshots: DataFrame, times: Sequence, family: str = "family", target: str = "target") -> DataFrame:
    """(family, target) for each family and each of some given times."""
    return snapshots.select(family).distinct().withColumn(target, F.explode(F.array(*(F.lit(t).cast("timestamp") for t in times))))


def rows_asof(history: DataFrame, used: DataFrame, family: str = "family", at: str = "captured_at") -> DataFrame:
    """Rows of the snapshots in use, with their target."""
    return history.join(used.filter("used is not null").withColumnRenamed("used", at), [family, at])


def entity_status(history: DataFrame, used: DataFrame, entities: DataFrame, entity: str = "entity", family: str = "family", at: str = "captured_at", target: str = "target") -> DataFrame:
    """entity, target, family, used, status: snapshot_used, entity_absent or no_snapshot for every entity and family asked for.

    entities: (entity, family) pairs that are of interest.
    """
    here = rows_asof(history.select(family, at, entity).distinct(), used, family, at).select(target, family, entity, F.lit(1).alias("_here"))
    asked = entities.select(entity, family).join(used, family)
    status = F.when(F.col("used").isNull(), "no_snapshot").when(F.col("_here") == 1, "snapshot_used").otherwise("entity_absent")
    return asked.join(here, [target, family, entity], "left").select(entity, target, family, "used", status.alias("status"))


def presence(status: DataFrame, authoritative: Sequence[str], entity: str = "entity", family: str = "family", target: str = "target") -> DataFrame:
    """Per entity and target: present if any family has it; unknown without any snapshot; absent if an authoritative family
    lacks it; else partial."""
    out = status.groupBy(entity, target).agg(F.bool_or(F.col("status") == "snapshot_used").alias("_any"), F.bool_and(F.col("status") == "no_snapshot").alias("_none"), F.bool_or((F.col("status") == "entity_absent") & F.col(family).isin(*authoritative)).alias("_gone"))
    return out.select(entity, target, F.when(F.col("_any"), "present").when(F.col("_none"), "unknown").when(F.col("_gone"), "absent").otherwise("partial").alias("presence"))


def state_asof(history: DataFrame, used: DataFrame, columns: Sequence[str], entity: str = "entity", family: str = "family", at: str = "captured_at", target: str = "target") -> DataFrame:
    """One row for each (entity, target): properties as sorted structs (family, name, value, observed_at), blanks left out."""
    rows = rows_asof(history, used, family, at)
    facts = F.filter(F.array(*(F.struct(F.col(family).alias("family"), F.lit(c).alias("name"), F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("value"), F.col(at).alias("observed_at")) for c in columns)), lambda x: x.value != "")
    return rows.select(entity, target, F.explode(facts).alias("fact")).groupBy(entity, target).agg(F.array_sort(F.collect_set("fact")).alias("properties"))


def alias_asof(observations: DataFrame, probes: DataFrame, alias: Sequence[str] = ("kind", "value"), owner: str = "owner", at: str = "observed_at", asof: str = "asof") -> DataFrame:
    """probes with owners (sorted array), status (bound, ambiguous, unbound), bound (the owner where there is one).

    The newest observation time not later than the probe decides; several owners at that time are ambiguous, not a choice.
    Only distinct times of an alias, asked and observed ones, meet in its ordered pass; probes and owners are joined to
    what it finds by alias and time, so an alias with many owners or probes is no large group anywhere. The status is told
    from the least and greatest owner: where `owners` is not read, no array of them is built or moved to the probes.
    """
    seen = observations.filter(F.col(owner).isNotNull()).groupBy(*alias, F.col(at).alias("_t")).agg(F.array_sort(F.collect_set(owner)).alias("owners"), F.min(owner).alias("_least"), F.max(owner).alias("_most"))
    times = seen.select(*alias, "_t", F.col("_t").alias("_seen")).unionByName(probes.select(*alias, F.col(asof).alias("_t"), F.lit(None).cast(seen.schema["_t"].dataType).alias("_seen")))
    times = times.groupBy(*alias, "_t").agg(F.max("_seen").alias("_seen"))
    w = Window.partitionBy(*alias).orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    found = times.withColumn("_seen", F.last("_seen", ignorenulls=True).over(w)).filter("_seen is not null")
    found = found.join(seen.withColumnRenamed("_t", "_seen"), [*alias, "_seen"]).select(*alias, F.col("_t").alias(asof), "owners", "_least", "_most")
    rows = probes.join(found, [*alias, asof], "left")
    status = F.when(F.col("_least").isNull(), "unbound").when(F.col("_least") == F.col("_most"), "bound").otherwise("ambiguous")
    none = F.array().cast(seen.schema["owners"].dataType)
    return rows.withColumn("status", status).select(*(F.col(f"`{c}`") for c in probes.columns), F.coalesce("owners", none).alias("owners"), "status", F.when(F.col("status") == "bound", F.col("_least")).alias("bound"))


def bind_rows(rows: DataFrame, observations: DataFrame, identity: Column, alias_value: Column, kind: str = "upn", at: str = "captured_at") -> DataFrame:
    """Rows with `entity` and `reason`: their own immutable id, else the owner of their alias at their snapshot's time.

    reason is null where the row is bound; else missing_upn, unbound_upn or ambiguous_upn, and entity is null.
    """
    own = rows.withColumn("_id", identity).withColumn("kind", F.lit(kind)).withColumn("value", F.lower(F.trim(F.coalesce(alias_value, F.lit("")))))
    with_id = own.filter("_id is not null").withColumn("entity", F.col("_id")).withColumn("reason", F.lit(None).cast("string"))
    no_alias = own.filter("_id is null and value = ''").withColumn("entity", F.lit(None).cast("string")).withColumn("reason", F.lit(f"missing_{kind}"))
    ask = alias_asof(observations, own.filter("_id is null and value <> ''"), asof=at)
    bound = ask.withColumn("entity", F.col("bound").cast("string")).withColumn("reason", F.when(F.col("status") != "bound", F.concat(F.col("status"), F.lit(f"_{kind}")))).drop("owners", "status", "bound")
    return with_id.withColumn("entity", F.col("entity").cast("string")).unionByName(no_alias).unionByName(bound).drop("_id", "kind", "value")


def aliases_at(observations: DataFrame, targets: DataFrame, owner: str = "owner", at: str = "observed_at", target: str = "target") -> DataFrame:
    """owner, target, values: distinct alias values seen up to each target. targets has owner and target."""
    rows = targets.select(owner, target).distinct().join(observations, owner).filter(F.col(at) <= F.col(target))
    return rows.groupBy(owner, target).agg(F.array_sort(F.collect_set("value")).alias("values"))
