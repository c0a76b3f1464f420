"""Nested policy documents: trees to rows, normal forms, hashes, and differences that trust only what was retrieved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..plans.storage import stored

# Versions, statuses and type names of the documents.
SNAPSHOT_VERSION, EXPORT_VERSION = 1, 4
TRUSTED = ("success", "not_applicable")
KINDS = {"ChoiceSetting": "choice", "SimpleSetting": "simple", "GroupSetting": "group", "ChoiceSettingCollection": "choice_collection", "SimpleSettingCollection": "simple_collection", "GroupSettingCollection": "group_collection"}
TARGETS = {"allDevicesAssignmentTarget": "all_devices", "allLicensedUsersAssignmentTarget": "all_users", "groupAssignmentTarget": "group", "exclusionGroupAssignmentTarget": "exclusion_group"}
INVENTORY_COLUMNS = ("SnapshotId", "CapturedAtUtc", "PolicyId", "Source", "Platform", "PolicyType", "JsonRelativePath", "RetrievalStatus")
FILTER_FIELDS = ("platform", "rule", "assignmentFilterManagementType")
CLASSIC_METADATA = ("id", "displayName", "description", "createdDateTime", "lastModifiedDateTime", "version", "roleScopeTagIds", "assignments", "@odata.type", "@odata.context", "supportsScopeTags", "deviceManagementApplicabilityRuleOsEdition", "deviceManagementApplicabilityRuleOsVersion", "deviceManagementApplicabilityRuleDeviceMode")

#: Settings whose values are lists, which keep their value as a whole beside their leaves.
LISTS = ("simpleSettingCollectionValue", "choiceSettingCollectionValue")


def get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(cells.col(v), path, kind)


def json_depth(text: Column) -> Column:
    """How deep the objects and lists of a JSON text lie in each other: 0 for a scalar."""
    for pattern in (r"(?s)\\.", '"[^"]*"', r"[^\[\]{}]+"):  # escapes, strings, whatever is no bracket
        text = F.regexp_replace(text, pattern, "")
    step = lambda a, c: F.struct((a.now + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)).alias("now"), F.greatest(a.most, a.now).alias("most"))
    return F.aggregate(F.split(text, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a.most)


def tree_nodes(docs: DataFrame, by: Sequence[str], variant: str, keep: Sequence[str] = LISTS, whole_lists: bool = False) -> DataFrame:
    """Every node below a VARIANT: by, path, depth, name, type, value, one row each, told from a document in its own task.

    value is a leaf's; an object or list has none, unless its name is in `keep`, so the rows are linear in the document
    however deep it is. whole_lists: lists are leaves, with their value. Nulls have a row; a null document has none. Depth
    and rows have no limit. Level by level, open nodes are done and give way to their children, as often as the document is
    deep; nothing is shuffled or stored, and rows stay where their document was. A task holds the nodes of one document.
    """
    cast = lambda v, kind: F.try_variant_get(v, "$", kind)

    def node(path: Column, depth: Column, name: Column, v: Column) -> Column:
        items = F.lit(None).cast("array<variant>") if whole_lists else cast(v, "array<variant>")
        return F.struct(path.alias("path"), depth.alias("depth"), name.alias("name"), cast(v, "map<string,variant>").alias("fields"), items.alias("items"), v.alias("value"))

    def below(x: Column) -> Column:
        place = lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))
        named = F.transform(F.map_entries(x.fields), lambda e: node(F.concat(x.path, F.lit("."), e.key), x.depth + 1, e.key, e.value))
        return F.coalesce(named, F.transform(x["items"], lambda v, i: node(F.concat(x.path, place(i)), x.depth + 1, place(i), v)), F.filter(F.array(x), lambda _: F.lit(False)))

    def done(x: Column) -> Column:
        inner = F.when(x.fields.isNotNull(), "object").when(x["items"].isNotNull(), "array").otherwise("leaf")
        return F.struct(x.path.alias("path"), x.depth.alias("depth"), x["name"].alias("name"), inner.alias("type"), F.when((inner == "leaf") | x["name"].isin(*keep), x.value).alias("value"))

    quoted = [F.col(f"`{c}`") for c in by]
    own = F.when(F.col(variant).isNotNull(), F.col(variant))
    roots = docs.filter(F.col(variant).isNotNull()).select(*quoted, F.array(node(F.lit("$"), F.lit(0), F.lit("$"), own)).alias("_open"), F.sequence(F.lit(0), json_depth(F.to_json(variant))).alias("_levels"))
    none = F.filter(F.transform("_open", done), lambda _: F.lit(False))
    step = lambda a, _: F.struct(F.concat(a.done, F.transform(a.open, done)).alias("done"), F.flatten(F.transform(a.open, below)).alias("open"))
    # explode_outer, as a filter on the size of what explode takes would tell the nodes once more; there is always a root
    every = roots.select(*quoted, F.explode_outer(F.aggregate("_levels", F.struct(none.alias("done"), F.col("_open").alias("open")), step, lambda a: a.done)).alias("_n")).select(*quoted, "_n.*")
    return every.withColumn("type", F.when(F.col("type") == "leaf", cells.json_type(F.col("value"))).otherwise(F.col("type")))


def setting_nodes(nodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Setting instances among tree nodes: by, path, depth (of settings), definition_id, kind, raw_value, hash (of these three).

    A setting is an object with a settingDefinitionId. Its properties are leaves below it, which meet by the object's path.
    """
    up = lambda tail: F.expr(f"substring(path, 1, length(path) - {tail})")
    ends = lambda tail: F.col("path").endswith(tail)
    roles = [("id", F.col("name") == "settingDefinitionId", "length(name) - 1"), ("type", F.col("name") == "@odata.type", "length(name) - 1")]
    roles += [(f"raw{i}", ends(t), str(len(t))) for i, t in enumerate((".simpleSettingValue.value", ".choiceSettingValue.value"))]
    roles += [(f"raw{i}", F.col("name") == t, "length(name) - 1") for i, t in enumerate(LISTS, 2)]
    role = F.coalesce(*(F.when(c, F.struct(F.lit(n).alias("role"), up(t).alias("owner"))) for n, c, t in roles))
    own = nodes.withColumn("_r", role).filter("_r is not null").select(*by, F.col("_r.owner").alias("path"), "_r.role", get("value", "$").alias("_v"))
    one = lambda n: F.max(F.when(F.col("role") == n, F.col("_v"))).alias(f"_{n}")
    found = own.groupBy(*by, "path").agg(*(one(n) for n, _, _ in roles)).filter("_id is not null")
    short = F.regexp_replace(F.element_at(F.split(F.coalesce("_type", F.lit("")), r"\."), -1), "^deviceManagementConfiguration|Instance$", "")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), short), F.lit("unknown"))
    raw = F.coalesce("_raw0", "_raw1", "_raw2", "_raw3")
    depth = F.size(F.split("path", r"\.children\["))
    out = found.select(*by, "path", (depth - 1).alias("depth"), F.col("_id").alias("definition_id"), kind.alias("kind"), raw.alias("raw_value"))
    return out.withColumn("hash", F.sha2(F.to_json(F.struct("definition_id", "kind", "raw_value")), 256))


def choice_labels(settings: DataFrame, options: DataFrame) -> DataFrame:
    """label of a raw value: the definition's option that has it as item id, option value, name or id, in that order."""
    long = options.select("definition_id", "label", F.explode(F.array(*(F.struct(F.lit(i).alias("prio"), F.col(c).alias("raw_value")) for i, c in enumerate(("item_id", "option_value", "name", "id"))))).alias("o")).select("definition_id", "o.raw_value", "o.prio", "label")
    best = long.filter("raw_value is not null").groupBy("definition_id", "raw_value").agg(F.min_by("label", "prio").alias("label"))
    return settings.join(best, ["definition_id", "raw_value"], "left")


def classic_properties(nodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Dotted property paths of flat documents: leaves and whole lists; metadata and empty values are left out."""
    top = F.split(F.col("path"), r"\.").getItem(1)
    leaf = ~F.col("type").isin("object", "null") & ~F.col("path").contains("[") & (F.col("depth") > 0)
    value = F.to_json("value")
    return nodes.filter(leaf & ~top.isin(*CLASSIC_METADATA) & ~value.isin('""', "[]", "{}")).select(*by, F.substring("path", 3, 1 << 20).alias("property"), "type", value.alias("value"))


def admx_values(docs: DataFrame, by: Sequence[str], variant: str) -> DataFrame:
    """Definition values of a template policy: definition_id, enabled, values (canonical JSON), opaque if there is no definition."""
    each = docs.lateralJoin(docs.sparkSession.tvf.variant_explode(get(variant, "$.definitionValues", "variant").outer()).select(F.col("value").alias("_v")))
    return each.select(*by, F.coalesce(get("_v", "$.definition.id"), F.lit("opaque")).alias("definition_id"), get("_v", "$.enabled", "boolean").alias("enabled"), F.to_json(get("_v", "$.presentationValues", "variant")).alias("values"))


def assignments(docs: DataFrame, by: Sequence[str], variant: str) -> DataFrame:
    """Assignments with the key kind|group|filter|mode; unknown target types keep their name."""
    each = docs.lateralJoin(docs.sparkSession.tvf.variant_explode(get(variant, "$.assignments", "variant").outer()).select(F.col("value").alias("_v")))
    short = F.element_at(F.split(F.coalesce(get("_v", "$.target['@odata.type']"), F.lit("unknown")), r"\."), -1)
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TARGETS.items() for x in kv]), short), short)
    group, rule, mode = (F.coalesce(get("_v", f"$.target.{p}"), F.lit("")) for p in ("groupId", "deviceAndAppManagementAssignmentFilterId", "deviceAndAppManagementAssignmentFilterType"))
    return each.select(*by, kind.alias("kind"), group.alias("group_id"), rule.alias("filter_id"), mode.alias("mode"), F.concat_ws("|", kind, group, rule, mode).alias("assignment_key"))


def filter_hash(df: DataFrame, fields: Sequence[str]) -> Column:
    """Hash of an assignment filter's semantic fields, nulls left out."""
    return cells.struct_hash(*fields)


def manifest_issues(snapshot_version: Column, export_version: Column, snapshot_id: Column, captured_at: Column, inventory: Column) -> Column:
    """Array of issues of a manifest; empty where it is valid. Null versions are allowed."""
    return F.filter(
        F.array(
            F.when(cells.filled(snapshot_id).isNull(), "missing snapshotId"), F.when(cells.filled(captured_at).isNull(), "missing capturedAtUtc"), F.when(cells.filled(captured_at).isNotNull() & cells.timestamp(captured_at).isNull(), "bad capturedAtUtc"),
            F.when(cells.filled(inventory).isNull(), "missing inventory"), F.when(snapshot_version.isNotNull() & (snapshot_version != SNAPSHOT_VERSION), "unsupported snapshot version"), F.when(export_version.isNotNull() & (export_version != EXPORT_VERSION), "unsupported export version"),
        ),
        lambda x: x.isNotNull(),
    )


def source_accounting(listed: Column, exported: Column, errors: Column) -> Column:
    """integrity_error unless exported and errors make up what was listed; incomplete with errors; else complete."""
    return F.when(exported + errors != listed, "integrity_error").when(errors > 0, "incomplete").otherwise("complete")


def export_status(statuses: Column) -> Column:
    return F.when(F.array_contains(statuses, "integrity_error"), "integrity_error").when(F.array_contains(statuses, "incomplete"), "incomplete").otherwise("complete")


def contract_issues(inventory: DataFrame, documents: DataFrame, key: str = "policy_key", path: str = "path") -> DataFrame:
    """(key, issue): paths that are absolute, leave the bundle or have no document, and keys that repeat."""
    bad = F.when(F.col(path).rlike(r"^([A-Za-z]:|/|\\)"), "absolute path").when(F.col(path).rlike(r"(^|[/\\])\.\.([/\\]|$)"), "path outside the bundle")
    shaped = inventory.withColumn("issue", bad)
    lost = shaped.filter("issue is null").join(documents.select(path), path, "left_anti").select(key, F.lit("missing document").alias("issue"))
    twice = inventory.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key, F.lit("duplicate key").alias("issue"))
    return shaped.filter("issue is not null").select(key, "issue").unionByName(lost).unionByName(twice)


def blockers(retrieval: Column, components: Sequence[str]) -> Column:
    """Components whose retrieval failed, of a map component -> status: what keeps a policy from having a hash."""
    return F.filter(F.array(*(F.when(F.coalesce(F.try_element_at(retrieval, F.lit(c)), F.lit("missing")).isin("error", "partial", "missing"), F.lit(c)) for c in components)), lambda x: x.isNotNull())


def policy_hash(blocked: Column, *parts: Column) -> Column:
    """Hash over canonical parts, blank where anything blocks it."""
    return F.when(F.size(blocked) > 0, "").otherwise(cells.struct_hash(*(p.alias(f"p{i}") for i, p in enumerate(parts))))


def policy_diff(before: DataFrame, after: DataFrame, before_status: DataFrame, after_status: DataFrame, key: str = "policy_key") -> DataFrame:
    """key, source, state, suppression. Tables: key, source, hash ('' if not eligible). Statuses: source, status.

    A policy that one side lacks was added or removed only if that side's source was fully retrieved; else the difference is
    indeterminate and its reason is kept. Two equal hashes are unchanged, two unlike ones modified. A null hash is none, as '':
    the policy is there. A key that repeats with unlike hashes is there without one.
    """
    def side(df: DataFrame, s: str) -> DataFrame:
        one = F.struct(F.col("source"), F.coalesce("hash", F.lit("")).alias("hash"))
        return df.groupBy(key).agg(F.min(one).alias(s), F.count_distinct("hash").alias(f"{s}_n")).select(key, F.col(f"{s}.source").alias(f"{s}s"), F.when(F.col(f"{s}_n") > 1, "").otherwise(F.col(f"{s}.hash")).alias(s))

    both = side(before, "_b").join(side(after, "_a"), key, "full_outer").withColumn("source", F.coalesce("_as", "_bs"))
    both = both.join(before_status.select("source", F.col("status").alias("_bok")), "source", "left").join(after_status.select("source", F.col("status").alias("_aok")), "source", "left")
    ok = lambda c: F.coalesce(F.col(c) == "success", F.lit(False))
    state = (
        F.when(F.col("_b").isNull() & ok("_bok"), "added").when(F.col("_a").isNull() & ok("_aok"), "removed").when(F.col("_b").isNull() | F.col("_a").isNull(), "indeterminate")
        .when((F.col("_a") == "") | (F.col("_b") == ""), "indeterminate").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("modified")
    )
    why = F.when(F.col("_b").isNull() & ~ok("_bok"), "baseline source not retrieved").when(F.col("_a").isNull() & ~ok("_aok"), "target source not retrieved").when((F.col("_a") == "") | (F.col("_b") == ""), "policy not eligible for a hash")
    return both.select(key, "source", state.alias("state"), F.when(state == "indeterminate", why).alias("suppression"))


def component_events(before: DataFrame, after: DataFrame, modified: DataFrame, key: str = "policy_key") -> DataFrame:
    """Events of all component kinds in one full outer join by (key, component_type, component_key); tables have value and
    trusted. Kinds are compared only where both sides are trusted; of repeated components the last (by position, then value) wins."""
    by = [key, "component_type", "component_key"]
    last = lambda df, s: df.join(modified.select(key), key, "left_semi").groupBy(*by).agg(F.max_by("value", F.struct("position", "value")).alias(s))
    untrusted = before.unionByName(after).filter(~F.col("trusted")).select(key, "component_type").distinct()
    both = last(before, "before").join(last(after, "after"), by, "full_outer").join(untrusted, [key, "component_type"], "left_anti")
    event = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return both.withColumn("event", event).filter("event is not null").select(*by, "event", "before", "after")


def explained(events: DataFrame, modified: DataFrame, before: DataFrame, after: DataFrame, key: str = "policy_key") -> DataFrame:
    """component_events of modified policies, and an event `unexplained_policy_semantic_change` with both hashes for each of them that has none.

    before and after: key and hash of the policies.
    """
    rest = modified.select(key).distinct().join(events.select(key).distinct(), key, "left_anti")
    side = lambda df, s: df.groupBy(key).agg(F.min("hash").alias(s))
    none = rest.join(side(before, "before"), key).join(side(after, "after"), key)
    return events.unionByName(none.select(key, F.lit("policy").alias("component_type"), F.lit("").alias("component_key"), F.lit("unexplained_policy_semantic_change").alias("event"), "before", "after"))


def metadata_events(before: DataFrame, after: DataFrame, key: str = "policy_key") -> DataFrame:
    """renamed, description_changed, scope_tags_changed (as sets) and applicability_changed (by canonical JSON)."""
    j = before.alias("b").join(after.alias("a"), key)
    differ = {
        "renamed": cells.text("b.name") != cells.text("a.name"), "description_changed": cells.text("b.description") != cells.text("a.description"),
        "scope_tags_changed": F.array_sort(F.array_distinct("b.scope_tags")) != F.array_sort(F.array_distinct("a.scope_tags")), "applicability_changed": ~cells.canonical_json(F.col("b.applicability")).eqNullSafe(cells.canonical_json(F.col("a.applicability"))),
    }
    return j.select(key, F.explode(F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in differ.items())), lambda x: x.isNotNull())).alias("event"))


def comparison_summary(diff: DataFrame) -> DataFrame:
    """Policies by state, suppressions, and status: partial with any suppression, else changed or unchanged."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    out = diff.agg(*(n(s) for s in ("added", "removed", "modified", "unchanged", "indeterminate")), F.count("suppression").alias("suppressions"))
    return out.withColumn("status", F.when(F.col("suppressions") > 0, "partial").when(F.col("added") + F.col("removed") + F.col("modified") > 0, "changed").otherwise("unchanged"))


def ordered(before: Column, after: Column, allow_reverse: bool = False) -> Column:
    """Null, or an error where the baseline is later than the target."""
    return F.when(F.lit(not allow_reverse) & (before > after), F.raise_error(F.lit("the baseline is later than the target")))


def trust_level(export: Column, warnings: Column, ineligible: Column) -> Column:
    return F.when(export == "integrity_error", "error").when((export == "incomplete") | (ineligible > 0), "warning").when(warnings > 0, "informational").otherwise("success")


def run_observation(export: Column) -> Column:
    """How run health counts a bundle: observed, attention or missing."""
    return F.when(export == "complete", "observed").when(export == "incomplete", "attention").otherwise("missing")


def normalization_status(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per snapshot: error with any error, partial with any warning, else success."""
    return rows.groupBy(*by).agg(F.when(F.bool_or(F.col("level") == "error"), "error").when(F.bool_or(F.col("level") == "warning"), "partial").otherwise("success").alias("status"))


def facet_counts(rows: DataFrame, facets: Sequence[str]) -> DataFrame:
    """facet, value, n for all facets in one aggregate over an exploded facet array."""
    return rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in facets))).alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


def names_asof(assigned: DataFrame, groups: DataFrame, at: str = "captured_at") -> DataFrame:
    """Group names from the newest group snapshot not later than the policy's; an unknown id stays as it is.

    assigned: group_id, captured_at. groups: group_id, display, captured_at.
    """
    asks = assigned.select(at).distinct().withColumn("_ask", F.lit(True))
    lines = groups.select(at).distinct().withColumn("_ask", F.lit(False))
    w = Window.orderBy(at, "_ask").rowsBetween(Window.unboundedPreceding, 0)  # one row a snapshot
    used = asks.unionByName(lines).withColumn("used", F.last(F.when(~F.col("_ask"), F.col(at)), ignorenulls=True).over(w)).filter("_ask").select(at, "used")
    names = groups.select("group_id", F.col(at).alias("used"), "display")
    return assigned.join(used, at, "left").join(names, ["used", "group_id"], "left").withColumn("name", F.coalesce(cells.filled("display"), F.col("group_id"))).drop("display", "used")


# How the sources of policies are named.
SOURCE_LABELS = {"configurationPolicies": "Modern", "deviceConfigurations": "Classic", "groupPolicyConfigurations": "ADMX"}


def compact_inventory(policies: DataFrame) -> DataFrame:
    """policy_key, name, platform, policy_type, source, by platform, name without case, and key; nameless ones are `Unnamed policy`, unknown sources stay as they are."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    label = F.coalesce(*(F.when(F.col("source") == k, v) for k, v in SOURCE_LABELS.items()), "source")
    rows = policies.select("policy_key", F.coalesce(F.nullif("name", F.lit("")), F.lit("Unnamed policy")).alias("name"), blank("platform").alias("platform"), blank("policy_type").alias("policy_type"), label.alias("source"))
    return rows.orderBy("platform", F.lower("name"), "policy_key")


def snapshot_metrics(policies: DataFrame, settings: DataFrame, assigned: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per snapshot: policies, hash-eligible ones, settings, assignments; three aggregates joined on the snapshot."""
    p = policies.groupBy(*by).agg(F.count(F.lit(1)).alias("policies"), F.count_if(F.col("hash") != "").alias("eligible"))
    n = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    return p.join(n(settings, "settings"), list(by), "left").join(n(assigned, "assignments"), list(by), "left").fillna(0, ["settings", "assignments"])


def inspection(settings: DataFrame, definitions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per bundle: nodes, greatest depth, kinds, and the share of settings whose definition is there, with the number missing."""
    known = settings.join(definitions.select("definition_id").distinct().withColumn("_d", F.lit(1)), "definition_id", "left")
    out = known.groupBy(*by).agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("max_depth"), F.count_distinct("kind").alias("kinds"), F.count("_d").alias("_known"), F.count_distinct(F.when(F.col("_d").isNull(), F.col("definition_id"))).alias("missing_definitions"))
    return out.withColumn("definition_coverage", F.round(100.0 * F.col("_known") / F.col("nodes"), 1)).drop("_known")


def metrics_by_grain(policies: DataFrame, settings: DataFrame, assigned: DataFrame, by: Sequence[str], key: str = "policy_key", source: str = "source", kind: str = "type") -> DataFrame:
    """by, level (total, source, type, source_type), source, type, policies, eligible, settings, assignments, eligible_share.

    Settings and assignments (by, key) are counted for each policy first; one pass over policies then fills all levels by
    grouping sets. A policy that has none counts 0; those of unknown policies count nowhere; null sources and types are
    groups of their own, told from totals by the level.
    """
    n = lambda df, name: df.groupBy(*by, key).agg(F.count(F.lit(1)).alias(name))
    own = policies.join(n(settings, "_settings"), [*by, key], "left").join(n(assigned, "_assignments"), [*by, key], "left")
    own = own.select(*by, F.col(source).alias("source"), F.col(kind).alias("type"), (F.coalesce("hash", F.lit("")) != "").alias("_eligible"), "_settings", "_assignments")
    groups = own.groupingSets([list(by), [*by, "source"], [*by, "type"], [*by, "source", "type"]], *by, "source", "type")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    out = groups.agg(F.grouping("source").alias("_s"), F.grouping("type").alias("_t"), F.count(F.lit(1)).alias("policies"), F.count_if("_eligible").alias("eligible"), total("_settings", "settings"), total("_assignments", "assignments"))
    level = F.when((F.col("_s") == 1) & (F.col("_t") == 1), "total").when(F.col("_t") == 1, "source").when(F.col("_s") == 1, "type").otherwise("source_type")
    return out.select(*by, level.alias("level"), "source", "type", "policies", "eligible", "settings", "assignments", F.round(F.col("eligible") / F.col("policies"), 6).alias("eligible_share"))


def inspection_by_grain(settings: DataFrame, definitions: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, level (total, kind), kind, nodes, max_depth, definitions, missing_definitions, definition_coverage (percent of nodes) of a bundle's settings, in one pass by grouping sets."""
    known = settings.join(definitions.select("definition_id").distinct().withColumn("_d", F.lit(1)), "definition_id", "left")
    groups = known.groupingSets([list(by), [*by, "kind"]], *by, "kind")
    out = groups.agg(F.grouping("kind").alias("_k"), F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("max_depth"), F.count_distinct("definition_id").alias("definitions"), F.count_distinct(F.when(F.col("_d").isNull(), F.col("definition_id"))).alias("missing_definitions"), F.count("_d").alias("_known"))
    return out.select(*by, F.when(F.col("_k") == 1, "total").otherwise("kind").alias("level"), "kind", "nodes", "max_depth", "definitions", "missing_definitions", F.round(100.0 * F.col("_known") / F.col("nodes"), 1).alias("definition_coverage"))


def inventory(policies: DataFrame, diffs: DataFrame | None, assigned: DataFrame, key: str = "policy_key") -> DataFrame:
    """Policies with change state (no_baseline without a comparison, unchanged where none was found), assignments, search text."""
    n = assigned.groupBy(key).agg(F.count(F.lit(1)).alias("assignments"))
    rows = policies.join(n, key, "left").fillna(0, ["assignments"])
    rows = rows.join(diffs.select(key, "state"), key, "left").withColumn("state", F.coalesce("state", F.lit("unchanged"))) if diffs is not None else rows.withColumn("state", F.lit("no_baseline"))
    return rows.withColumn("search", F.lower(F.concat_ws(" ", "name", "platform", "source", key)))


def filter_inventory(rows: DataFrame, platform: str = "", source: str = "", state: str = "", needle: str = "") -> DataFrame:
    for c, v in (("platform", platform), ("source", source), ("state", state)):
        rows = rows.filter(F.col(c) == v) if v else rows
    return rows.filter(F.col("search").contains(needle.lower())) if needle else rows


def filter_details(details: DataFrame, change: str = "All", needle: str = "") -> DataFrame:
    """Change details of one type with the needle in their joined text."""
    rows = details if change == "All" else details.filter(F.col("change") == change)
    return rows.filter(F.lower(F.concat_ws(" | ", *details.columns)).contains(needle.lower())) if needle else rows


def event_rows(events: DataFrame, before: DataFrame, after: DataFrame, key: str = "policy_key") -> DataFrame:
    """Events with the policy's display name: from before for removals, else from after."""
    names = before.select(key, F.col("name").alias("_b")).join(after.select(key, F.col("name").alias("_a")), key, "full_outer")
    return events.join(names, key, "left").withColumn("policy", F.when(F.col("event") == "removed", F.coalesce("_b", "_a")).otherwise(F.coalesce("_a", "_b"))).drop("_a", "_b")


def inventory_issues(headers: Sequence[str]) -> list[str]:
    """What an inventory's header lacks; told from the schema, before a row is read."""
    return [f"missing column {c}" for c in INVENTORY_COLUMNS if c not in headers] if headers else ["missing header"]


def document_issues(inventory: DataFrame, documents: DataFrame, manifest: DataFrame, bundle: str = "bundle", path: str = "path") -> DataFrame:
    """(bundle, path, issue): documents of another snapshot id or capture time than their manifest's, and bundles with more or fewer documents than inventory rows.

    inventory: bundle, path. documents: bundle, path, snapshot_id, captured_at. manifest: bundle, snapshot_id, captured_at.
    """
    told = documents.join(manifest.select(bundle, F.col("snapshot_id").alias("_id"), F.col("captured_at").alias("_at")), bundle)
    odd = lambda a, b, name: F.when(~F.coalesce(cells.text(a), F.lit("")).eqNullSafe(cells.text(b)), name)
    each = told.select(bundle, path, F.explode(F.array_compact(F.array(odd("snapshot_id", "_id", "snapshot id mismatch"), odd("captured_at", "_at", "captured at mismatch")))).alias("issue"))
    n = lambda df, name: df.groupBy(bundle).agg(F.count(F.lit(1)).alias(name))
    counts = n(inventory, "_rows").join(n(documents, "_docs"), bundle, "full_outer").filter(~F.coalesce("_rows", F.lit(0)).eqNullSafe(F.coalesce("_docs", F.lit(0))))
    return each.unionByName(counts.select(bundle, F.lit(None).cast("string").alias(path), F.lit("count mismatch").alias("issue")))


def normal_filters(docs: DataFrame, by: Sequence[str], variant: str) -> DataFrame:
    """Assignment filters of documents: by, filter_id, display, semantic (canonical JSON of the fields that are there), hash, warning.

    A filter without an id has no hash and a warning; display name and description are no semantics.
    """
    each = docs.lateralJoin(docs.sparkSession.tvf.variant_explode(get(variant, "$.assignmentFilters", "variant").outer()).select(F.col("value").alias("_v"))).filter("_v is not null")
    fid = F.coalesce(get("_v", "$.id"), F.lit(""))
    semantic = cells.canonical_json(F.to_json(F.struct(fid.alias("filterId"), *(get("_v", f"$.{f}").alias(f) for f in FILTER_FIELDS))))
    out = each.select(*by, fid.alias("filter_id"), get("_v", "$.displayName").alias("display"), get("_v", "$.rule").alias("rule"), semantic.alias("semantic"))
    named = F.col("filter_id") != ""
    return out.select(*by, "filter_id", "display", "rule", F.when(named, F.col("semantic")).alias("semantic"), F.when(named, F.sha2("semantic", 256)).alias("hash"), F.when(~named, "assignment filter without an id").alias("warning"))


def filter_presentation(assigned: DataFrame, filters: DataFrame, key: str = "filter_id") -> DataFrame:
    """assigned with shown and detail of its filter: the display name and the id, else the id and the rule; a dash without a filter."""
    known = filters.groupBy(key).agg(F.min(F.struct(cells.filled("display").alias("d"), cells.filled("rule").alias("r"))).alias("_f"))
    rows = assigned.join(known, key, "left")
    none, d = cells.filled(key).isNull(), F.col("_f.d")
    return rows.withColumn("shown", F.when(none, "—").otherwise(F.coalesce(d, F.col(key)))).withColumn("detail", F.when(none, "").when(d.isNotNull(), F.col(key)).otherwise(F.coalesce("_f.r", F.lit("")))).drop("_f")


def filter_diff(before: DataFrame, after: DataFrame, before_trusted: bool, after_trusted: bool) -> DataFrame:
    """filter_id, state, event, category, reason of assignment filters: as policies, existence counts only where that side's filters were retrieved."""
    side = lambda df, s: df.filter("filter_id <> ''").groupBy("filter_id").agg(F.min("hash").alias(s))
    both = side(before, "_b").join(side(after, "_a"), "filter_id", "full_outer")
    new, gone = F.col("_b").isNull(), F.col("_a").isNull()
    state = F.when(new, "added" if before_trusted else "indeterminate").when(gone, "removed" if after_trusted else "indeterminate").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("changed")
    out = both.withColumn("state", state)
    event = F.when(F.col("state").isin("added", "removed", "changed"), F.concat(F.lit("assignment_filter_"), F.col("state")))
    unsure = F.col("state") == "indeterminate"
    return out.select("filter_id", "state", event.alias("event"), F.when(unsure, "assignment_filter_existence_unavailable").alias("category"), F.when(unsure, F.when(new, "baseline_filter_coverage_unavailable").otherwise("target_filter_coverage_unavailable")).alias("reason"))


def summary_counts(policies: DataFrame, filters: DataFrame, events: DataFrame, suppressions: DataFrame) -> DataFrame:
    """section, name, n of a comparison: policies and filters by state, events by type, suppressions by category."""
    parts = [(policies, "policies", "state"), (filters, "assignmentFilters", "state"), (events, "eventsByType", "event"), (suppressions, "suppressionCategories", "category")]
    rows = [df.select(F.lit(s).alias("section"), F.col(c).alias("name")).filter("name is not null") for df, s, c in parts]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r)
    return whole.groupBy("section", "name").agg(F.count(F.lit(1)).alias("n"))


def setting_hashes(settings: DataFrame, by: Sequence[str]) -> DataFrame:
    """settings (as setting_nodes gives them) with `subtree`: a hash of definition, kind, raw value and the children's hashes in sorted order.

    The order of children, their paths and display labels are no part of it. Built bottom up, a stored pass for each depth;
    children's hashes are sorted within their parent, which has as many as the document says.
    """
    own = stored(settings.select(*by, "path", "depth", "definition_id", "kind", "raw_value", F.regexp_replace("path", r"\.[A-Za-z]+Value(\[\d+\])?\.children\[\d+\]$", "").alias("_parent")), "settings")
    deepest = own.agg(F.max("depth")).first()[0]
    done, below = None, None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = own.filter(F.col("depth") == depth)
        if below is not None:
            inner = below.groupBy(*by, F.col("_parent").alias("path")).agg(F.array_sort(F.collect_list("subtree")).alias("_inner"))
            level = level.join(inner, [*by, "path"], "left")
        else:
            level = level.withColumn("_inner", F.lit(None).cast("array<string>"))
        kids = F.concat_ws(",", F.coalesce("_inner", F.array().cast("array<string>")))
        below = stored(level.withColumn("subtree", F.sha2(F.to_json(F.struct("definition_id", "kind", "raw_value", kids.alias("children"))), 256)).drop("_inner"), "setting-hashes")
        done = below if done is None else done.unionByName(below)
    return (own.withColumn("subtree", F.lit(None).cast("string")) if done is None else done).drop("_parent")


def admx_blocked(docs: DataFrame, by: Sequence[str], variant: str) -> DataFrame:
    """by, blocked: whether a template policy's values can't be trusted, as its retrieval failed or was partial and gave none."""
    n = F.coalesce(F.size(get(variant, "$.definitionValues", "array<variant>")), F.lit(0))
    status = F.lower(F.coalesce(get(variant, "$.retrieval.definitionValues.status"), get(variant, "$.retrieval.status"), F.lit("")))
    return docs.select(*by, (status.isin("error", "partial") & (n <= 0)).alias("blocked"))
