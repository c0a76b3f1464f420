"""Links from users to devices and matches between records, resolved by ladders of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from . import asof


def device_key(aad: Column, managed: Column, serial: Column, family: Column, *more: Column) -> Column:
    """aad: id, else md: id, else serial: family: number, else hardware fields joined, else `empty`."""
    rest = F.nullif(F.concat_ws("|", *(cells.filled(c) for c in more)), F.lit("")) if more else F.lit(None).cast("string")
    tag = lambda name, c: F.concat(F.lit(name), F.nullif(c, F.lit("")))
    return F.coalesce(tag("aad:", cells.guid(aad)), tag("md:", cells.guid(managed)), F.concat(F.lit("serial:"), cells.text(family), F.lit(":"), F.nullif(cells.serial(serial), F.lit(""))), rest, F.lit("empty"))


def attempts(devices: DataFrame, observations: DataFrame, users: DataFrame, at: str = "captured_at") -> DataFrame:
    """One row for each signal of a device row: UserId (exact), UPN and mail (by alias at the row's time).

    devices: device, captured_at, user_id, upn, mail. users: user_id. Columns: device, captured_at, signal, status
    (resolved, ambiguous, unbound), owner (of a resolved one), owners.
    """
    base = devices.select("device", F.col(at).alias(at), cells.text("user_id").alias("user_id"), cells.lower("upn").alias("upn"), cells.lower("mail").alias("mail"))
    known = users.select(cells.text("user_id").alias("user_id")).distinct().withColumn("_known", F.lit(1))
    exact = base.filter("user_id <> ''").join(known, "user_id", "left")
    exact = exact.select("device", at, F.lit("user_id").alias("signal"), F.when(F.col("_known") == 1, "resolved").otherwise("unbound").alias("status"), F.when(F.col("_known") == 1, F.col("user_id")).alias("owner"), F.when(F.col("_known") == 1, F.array("user_id")).otherwise(F.array().cast("array<string>")).alias("owners"))
    mail_counts = cells.is_email("mail") & (F.col("mail") != F.col("upn"))
    named = base.select("device", at, F.explode(F.filter(F.array(F.struct(F.lit("upn").alias("kind"), F.col("upn").alias("value")), F.when(mail_counts, F.struct(F.lit("mail").alias("kind"), F.col("mail").alias("value")))), lambda x: x.isNotNull() & (x.value != ""))).alias("s"))
    probed = asof.alias_asof(observations, named.select("device", at, "s.kind", "s.value"), asof=at)
    probed = probed.select("device", at, F.col("kind").alias("signal"), F.when(F.col("status") == "bound", "resolved").otherwise(F.col("status")).alias("status"), F.col("bound").cast("string").alias("owner"), F.col("owners").cast("array<string>").alias("owners"))
    return exact.unionByName(probed)


def merge_links(tries: DataFrame, at: str = "captured_at") -> DataFrame:
    """Per device and snapshot: status, user_id, candidates, by this ladder.

    Two UserIds: conflicting. UserId against another resolved signal: conflicting. A UserId: resolved. Any ambiguous:
    ambiguous. Two resolved users: conflicting. One: resolved. A signal without owner: unbound. Else none. Where tries have
    `owner`, it is what resolved signals tell, and `owners` serves the candidates alone: who does not read those moves none.
    """
    own = lambda cond: F.array_distinct(F.flatten(F.collect_set(F.when(cond, F.col("owners")))))
    told = (lambda cond: F.collect_set(F.when(cond, F.col("owner")))) if "owner" in tries.columns else own
    ok = F.col("status") == "resolved"
    g = tries.groupBy("device", at).agg(told(ok & (F.col("signal") == "user_id")).alias("ids"), told(ok & (F.col("signal") != "user_id")).alias("others"), F.bool_or(F.col("status") == "ambiguous").alias("amb"), F.count(F.lit(1)).alias("n"), own(F.lit(True)).alias("candidates"))
    more = F.size(F.array_except("others", "ids"))
    status = (
        F.when(F.size("ids") > 1, "conflicting").when((F.size("ids") == 1) & (more > 0), "conflicting").when(F.size("ids") == 1, "resolved").when(F.col("amb"), "ambiguous")
        .when(F.size("others") > 1, "conflicting").when(F.size("others") == 1, "resolved").when(F.col("n") > 0, "unbound").otherwise("none")
    )
    out = g.withColumn("status", status)
    return out.select("device", at, "status", F.when(F.col("status") == "resolved", F.coalesce(F.try_element_at("ids", F.lit(1)), F.try_element_at("others", F.lit(1)))).alias("user_id"), F.array_sort("candidates").alias("candidates"))


def relevant_unresolved(merged: DataFrame, tries_values: DataFrame, aliases: DataFrame, at: str = "captured_at") -> DataFrame:
    """(user_id, device, time) of unresolved observations that matter to a user: the user is a candidate, or the link value is
    one of the user's aliases. Two equi-joins and a distinct union instead of one join by a disjunction.

    tries_values: device, time, value. aliases: user_id, value.
    """
    open_ = merged.filter(~F.col("status").isin("resolved", "none"))
    by_candidate = open_.select(F.explode("candidates").alias("user_id"), "device", at)
    by_alias = open_.select("device", at).join(tries_values, ["device", at]).join(aliases.select("user_id", cells.lower("value").alias("value")), "value").select("user_id", "device", at)
    return by_candidate.unionByName(by_alias).distinct()


def user_devices(users: DataFrame, merged: DataFrame, unresolved: DataFrame, covered: DataFrame, at: str = "captured_at") -> DataFrame:
    """Per user and time: devices, and coverage populated, ambiguous_association, known_zero, unknown or no_coverage.

    users: user_id, captured_at. covered: captured_at of device snapshots there are, `complete` if authoritative.
    """
    own = merged.filter("status = 'resolved'").groupBy("user_id", at).agg(F.array_sort(F.collect_set("device")).alias("devices"))
    open_ = unresolved.groupBy("user_id", at).agg(F.count(F.lit(1)).alias("_open"))
    rows = users.select("user_id", at).join(own, ["user_id", at], "left").join(open_, ["user_id", at], "left").join(covered.select(at, F.lit(1).alias("_c"), "complete"), at, "left")
    state = F.when(F.col("_c").isNull(), "no_coverage").when(F.size("devices") > 0, "populated").when(F.col("_open") > 0, "ambiguous_association").when(F.col("complete"), "known_zero").otherwise("unknown")
    return rows.select("user_id", at, F.coalesce("devices", F.array().cast("array<string>")).alias("devices"), state.alias("coverage"))


def applicability(operating_system: Column | str, model: Column | str, has_snapshot: Column) -> Column:
    """not_applicable unless the system is Windows (a blank one is not known to be), and for cloud PCs and virtual machines by
    their model; then no_coverage without a snapshot; else null."""
    os_, m = cells.lower(operating_system), cells.lower(model)
    virtual = m.contains("cloud pc") | (m == "virtual machine")  # fixed values
    return F.when(~os_.startswith("windows") | virtual, "not_applicable").when(~has_snapshot, "no_coverage")


def match_records(left: DataFrame, right: DataFrame, keys: dict[str, tuple[Column, Column]], left_id: str, right_id: str, containing: str | None = None) -> DataFrame:
    """Match left rows to right rows on several normalised keys, then settle disagreements between keys.

    keys: kind -> (left, right) normalised columns, blank meaning invalid. Per kind a left row is unique, ambiguous, absent
    or invalid. Then: unique keys that disagree, ambiguous; unique, and an ambiguous `containing` kind that has it, matched
    (without it, ambiguous); unique and another ambiguous, ambiguous; only ambiguous, ambiguous; a unique one, matched;
    none, no_match_with_coverage. Returns left_id, status, matched, diagnostic, and `by_kind`, an array of kind, state and
    number of records. Values are counted before they meet, so one that many records share moves one row, and whether it
    has the unique record is an equi-join.
    """
    def long(df: DataFrame, name: str, side: int) -> DataFrame:
        cols = F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(c[side], F.lit("")).alias("value")) for k, c in keys.items()))
        return df.select(F.col(name).cast("string").alias(name), F.explode(cols).alias("k")).select(name, "k.kind", "k.value")

    ids = long(right, right_id, 1).filter("value <> ''").distinct()
    index = ids.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"), F.min(right_id).alias("least"))
    probe = long(left, left_id, 0).join(index, ["kind", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    state = F.when(F.col("value") == "", "invalid").when(F.col("n") == 0, "absent").when(F.col("n") == 1, "unique").otherwise("ambiguous")
    probe = probe.withColumn("state", state)
    amb, only = F.col("state") == "ambiguous", F.when(F.col("state") == "unique", F.col("least"))
    own = amb & (F.col("kind") == F.lit(containing))
    g = probe.groupBy(left_id).agg(F.min(only).alias("u"), F.max(only).alias("_u"), F.count_if(amb & ~own).alias("other"), F.count_if(own).alias("own"), F.max(F.when(own, F.col("value"))).alias("_pool"), F.array_sort(F.collect_list(F.struct("kind", "state", "n"))).alias("by_kind"))
    held = ids.filter(F.col("kind") == F.lit(containing)).select(F.col("value").alias("_pool"), F.col(right_id).alias("u"), F.lit(True).alias("_inside"))
    g = g.join(held, ["_pool", "u"], "left")
    one, inside = F.col("u") == F.col("_u"), F.coalesce("_inside", F.lit(False))
    status = (
        F.when(F.col("u") != F.col("_u"), "ambiguous").when(one & (F.col("other") > 0), "ambiguous").when(one & (F.col("own") > 0) & inside, "matched").when(one & (F.col("own") > 0), "ambiguous")
        .when(one, "matched").when(F.col("other") + F.col("own") > 0, "ambiguous").otherwise("no_match_with_coverage")
    )
    out = g.withColumn("status", status)
    return out.select(left_id, "status", F.when(F.col("status") == "matched", F.col("u")).alias("matched"), F.when((F.col("status") == "matched") & (F.col("own") > 0), "duplicate value resolved by another key").alias("diagnostic"), "by_kind")


def match_candidates(left: DataFrame, right: DataFrame, keys: dict[str, tuple[Column, Column]], left_id: str, right_id: str) -> DataFrame:
    """left_id, kind, right_id: a row for each record that a key names, for those who want to see them; a plain join, split where a value is hot."""
    side = lambda df, name, i: df.select(F.col(name).cast("string").alias(name), F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(c[i], F.lit("")).alias("value")) for k, c in keys.items()))).alias("k")).select(name, "k.kind", "k.value").filter("value <> ''").distinct()
    return side(left, left_id, 0).join(side(right, right_id, 1), ["kind", "value"]).select(left_id, "kind", right_id)
