"""Fields of an entity from several families: authority, conflicts, collections."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells


def pick(facts: DataFrame, by: Sequence[str] = ("entity", "key"), value: str = "value", rank: str = "rank") -> DataFrame:
    """Per (entity, key): the value of the family with the lowest rank, and the other values as sorted `conflicts`.

    Equal values merge first; ties of rank go to the smaller value. Two partial aggregates, no collected group but its distinct values.
    """
    groups = facts.filter(cells.filled(value).isNotNull()).groupBy(*by, cells.text(value).alias("v")).agg(F.min(rank).alias("r"))
    out = groups.groupBy(*by).agg(F.min(F.struct("r", "v")).alias("best"), F.array_sort(F.collect_set("v")).alias("all"))
    return out.select(*by, F.col("best.v").alias("value"), F.col("best.r").alias("rank"), F.array_except("all", F.array("best.v")).alias("conflicts"))


def bind_fields(facts: DataFrame, bindings: DataFrame, exclusions: DataFrame) -> DataFrame:
    """facts (entity, family, name, value) with key, label and rank of their binding; unbound ones that no exclusion names
    become additional:<family>:<name>, ranked last."""
    bound = facts.join(bindings, ["family", "name"])
    free = facts.join(bindings, ["family", "name"], "left_anti").join(exclusions, ["family", "name"], "left_anti")
    return bound.select("entity", "key", "value", "rank").unionByName(free.select("entity", F.concat_ws(":", F.lit("additional"), "family", "name").alias("key"), "value", F.lit(1_000).alias("rank")))


def dedupe_relationships(rows: DataFrame, by: Sequence[str], dedup: Column, order: str) -> DataFrame:
    """First row, by order, of each dedup key without case."""
    best = rows.groupBy(*by, F.lower(dedup).alias("_key")).agg(F.min_by(F.struct(*rows.columns), order).alias("_row"))
    return best.select("_row.*")


def collection_coverage(n_rows: Column, status: Column, authoritative: Column, applies: Column) -> Column:
    """populated, known_empty, no_coverage, unknown or not_applicable."""
    return F.when(~applies, "not_applicable").when(n_rows > 0, "populated").when(status == "no_snapshot", "no_coverage").when(authoritative, "known_empty").otherwise("unknown")


def merge_methods(first: Column | str, second: Column | str) -> Column:
    """Two method lists: equal sets merge, unlike sets are a conflict that the first, authoritative one wins."""
    a, b = cells.tokens_ordered(first), cells.tokens_ordered(second)
    fold = lambda x: F.array_sort(F.transform(x, F.lower))
    state = F.when((F.size(a) == 0) & (F.size(b) == 0), "known_empty").when((F.size(a) > 0) & (F.size(b) > 0) & (fold(a) != fold(b)), "conflict").otherwise("populated")
    return F.struct(F.when(F.size(a) > 0, a).otherwise(b).alias("methods"), state.alias("state"), F.when(state == "conflict", b).alias("alternate"))


def provenance(observations: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct observations (family, observed_at) of each group, sorted."""
    return observations.groupBy(*by).agg(F.array_sort(F.collect_set(F.struct("family", "observed_at"))).alias("sources"))


def source_audit(merged: DataFrame, matches: DataFrame) -> DataFrame:
    """Per device: link status, number of candidates, and the state and candidates of each match key."""
    return merged.join(matches, "device", "left").select("device", F.col("status").alias("link_status"), F.size("candidates").alias("n_candidates"), F.transform(F.coalesce("by_kind", F.array().cast("array<struct<kind:string,state:string,n:bigint>>")), lambda k: k).alias("keys"))


@dataclass(frozen=True)
class Collection:
    """Rows of a family that are one collection of an entity: what they show, and the column that tells two of them apart."""

    name: str
    family: str
    primary: str
    secondary: str
    dedup: str
    detail: str = ""


# The collections of users.
COLLECTIONS = (
    Collection("roles", "Entra_Role_Assignments", "RoleName", "RoleState", "RoleName"),
    Collection("groups", "Entra_Group_User_Memberships", "GroupName", "MembershipType", "GroupId", "GroupId"),
    Collection("access_packages", "Entra_AccessPackage_User_Assignments", "AccessPackageName", "AssignmentState", "AccessPackageId", "AccessPackageId"),
)


def collect_relationships(rows: DataFrame, collection: Collection, entity: str = "entity", order: str = "row_ix") -> DataFrame:
    """entity, collection, primary, secondary, detail: a row for each dedup key of an entity, without case; the first in file order counts.

    Rows without dedup key are told apart by their primary text.
    """
    get = lambda c: cells.resolve(rows.columns, c) if c else F.lit("")
    key = F.coalesce(F.nullif(get(collection.dedup), F.lit("")), get(collection.primary))
    own = rows.select(entity, order, key.alias("_dedup"), get(collection.primary).alias("primary"), get(collection.secondary).alias("secondary"), get(collection.detail).alias("detail")).filter("_dedup <> ''")
    return dedupe_relationships(own, [entity], F.col("_dedup"), order).select(entity, F.lit(collection.name).alias("collection"), "primary", "secondary", "detail")
