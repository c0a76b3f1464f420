"""Queries of single-purpose operators: cells, cards, filters, documents, files. They register where the others do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, predicates
from ..operators import diff, identity, links, metrics, periods, policy, resolve
from ..operators import point_in_time as pit
from ..streaming import incremental
from . import cards, families
from .queries import _FD, _families, _two_days, events, query, ref, table


def pick(key: Column, every: int, *values: str | None) -> Column:
    """One of the values by key // every, in turn."""
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.floor(key / every) % len(values) + 1).cast("int"))


def sql_pick(key: str, every: int, *values: str | None) -> str:
    return f"[{', '.join('NULL' if v is None else repr(v) for v in values)}][(({key}) // {every}) % {len(values)} + 1]"


# --- cells


@query("""SELECT o_orderkey, 'Fam_' || o_orderstatus AS family, strftime(o_orderdate, '%Y-%m-%d') || ' 01:02:03' AS stamp, CASE o_orderkey % 3 WHEN 0 THEN 'Active · via ' || o_orderpriority WHEN 1 THEN 'Active · Direct' ELSE 'Direct' END AS path,
o_orderkey % 4 IN (0, 1) AS known, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 9)::INT END AS whole, substr(sha256(o_orderkey::VARCHAR), 1, 12) AS id, ['Windows', 'macOS', 'iOS/iPadOS', 'Android', 'Other'][o_orderkey % 5 + 1] AS platform,
['Microsoft 365', 'Security', 'Distribution'][o_orderkey % 3 + 1] AS kind, ['success', 'partial', 'error', 'partial', 'success'][o_orderkey % 5 + 1] AS rollup, (o_orderkey % 3)::INT AS delegates, o_orderkey % 4 <> 0 AS meaningful, 'Status: ' || o_orderstatus || ' / Year: ' || year(o_orderdate) AS scope FROM orders""")
def cell_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    stem = F.concat(F.lit("Fam_"), "o_orderstatus", F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-010203"))
    path = cells.role_path(F.when(k % 3 != 2, "Active"), F.lit(" Direct "), F.when(k % 3 == 0, F.col("o_orderpriority")))
    statuses = F.element_at(F.array(*(F.split(F.lit(x), ",") for x in ("success", "success,error", "error", "partial,success", "success,success"))), (k % 5 + 1).cast("int"))
    lists = F.element_at(F.array(*map(F.lit, ("ERROR: x", "a;ERROR: y;a", "a; b"))), (k % 3 + 1).cast("int"))
    return o.select(
        "o_orderkey", cells.family_of(stem).alias("family"), F.date_format(cells.stamp_of(stem), "yyyy-MM-dd HH:mm:ss").alias("stamp"), path.alias("path"), cells.status_known(pick(k, 1, "200", "404", "500", ""), True).alias("known"),
        cells.whole(F.when(k % 2 == 0, F.concat(F.lit(" "), (k % 9).cast("string")))).alias("whole"), cells.short_id(k.cast("string")).alias("id"), cells.platform_of(pick(k, 1, "win10X", "macOSX", "iosY", "androidZ", "tv")).alias("platform"),
        cells.group_type(k % 3 == 0, k % 3 == 1).alias("kind"), cells.retrieval_status(statuses).alias("rollup"), cells.delegate_count(lists).cast("int").alias("delegates"), cells.meaningful(pick(k, 1, "N/A", "x", "0", "y")).alias("meaningful"),
        cells.row_scope(["Status", "Empty", "Year"], [F.col("o_orderstatus"), F.lit(" "), F.year("o_orderdate").cast("string")]).alias("scope"),
    )


@query("""WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'p' || c_custkey END AS pkg, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'q' || c_custkey % 7 END AS pol FROM customer)
SELECT c_custkey, CASE WHEN pkg IS NULL THEN NULL WHEN pol = '' THEN pkg ELSE pkg || chr(31) || pol END AS package, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey || chr(31) || c_nationkey END AS member, CASE WHEN c_custkey % 5 = 0 THEN 's' || c_custkey ELSE c_custkey::VARCHAR END AS device,
 CASE WHEN c_custkey % 5 <> 0 THEN c_custkey || chr(31) || 'r' || c_custkey % 3 ELSE NULL END AS stable, CASE WHEN c_custkey % 2 = 0 THEN 'u' || c_custkey || chr(31) || 'Admin' || chr(31) || 'Active' || chr(31) || 'Direct' || chr(31) ELSE 'u' || c_custkey || chr(31) || 'Admin' || chr(31) || 'Active' || chr(31) || 'Direct' || chr(31) || c_mktsegment END AS legacy FROM r JOIN customer USING (c_custkey)""")
def family_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    s = k.cast("string")
    own = F.when(k % 5 != 0, s)
    rows = c.select("c_custkey", F.when(k % 4 != 0, F.concat(F.lit("p"), s)).alias("AccessPackageId"), F.when(k % 3 != 0, F.concat(F.lit("q"), (k % 7).cast("string"))).otherwise("").alias("PolicyId"), own.alias("ManagedDeviceId"), F.concat(F.lit("s"), s).alias("SerialNumber"))
    roles = c.select("c_custkey", own.alias("UserId"), F.concat(F.lit("r"), (k % 3).cast("string")).alias("AssignmentScheduleId"), F.col("c_nationkey").cast("string").alias("GroupId"), F.concat(F.lit("u"), s).alias("UserPrincipalName"), F.lit("Admin").alias("RoleName"), F.lit("Active").alias("RoleState"), F.lit("Direct").alias("AssignmentSource"), F.when(k % 2 != 0, F.col("c_mktsegment")).alias("SourceGroup"))
    key = families.row_key
    a = rows.select("c_custkey", key("Entra_Access_Packages", rows.columns).alias("package"), key("Intune_ManagedDevices_Compliance", rows.columns).alias("device"))
    stable = F.split(key("Entra_Role_Assignments", roles.columns), cells.SEPARATOR)
    b = roles.select("c_custkey", key("Entra_Group_User_Memberships", roles.columns).alias("member"), F.concat_ws(cells.SEPARATOR, stable[1], stable[0]).alias("_s"), stable.alias("_x"), key("Entra_Role_Assignments", roles.columns, False).alias("legacy"))
    return a.join(b, "c_custkey").select("c_custkey", "package", "member", "device", F.when(F.col("_x").isNotNull(), F.col("_s")).alias("stable"), "legacy")


@query("""WITH c AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, CASE WHEN c_custkey % 3 = 0 THEN 'aad:' || c_custkey END AS aad, CASE WHEN c_custkey % 3 = 1 THEN 'm' || c_custkey END AS other FROM customer)
SELECT k AS c_custkey, coalesce(aad, 'intune:Intune_ManagedDevices_Compliance:' || other) AS managed, coalesce(aad, 'autopilot:' || other) AS autopilot, coalesce(aad, 'ios_intune:' || other) AS ios, coalesce(aad, 'android_intune:' || other) AS android,
CASE WHEN k % 2 = 0 THEN 'x' || k ELSE 'smtp:' || lower(name) END AS mailbox, CASE WHEN k % 2 = 0 THEN k::VARCHAR END AS properties, CASE WHEN k % 5 <> 0 THEN 'upn_only:Entra_Users_AuthenticationMethods:' || lower(name) END AS methods,
CASE WHEN k % 5 <> 0 THEN 'upn_only:Entra_Role_Assignments:' || lower(name) END AS roles, 'RoleName: ' || seg AS scope, CASE WHEN k % 2 = 0 THEN 'ExternalDirectoryObjectId=x' || k || ';' ELSE '' END || 'PrimarySmtpAddress=' || name || ';Alias=' || seg AS card, CASE WHEN k % 2 = 0 THEN 'x' || k ELSE 'Unknown' END AS shown FROM c""")
def entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a customer's row under the shipped families: ids, what stands in for them, and rows without either."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    s = k.cast("string")
    name, aad, other = F.col("c_name"), F.when(k % 3 == 0, s).otherwise(" "), F.when(k % 3 == 1, F.concat(F.lit("m"), s))
    upn = F.when(k % 5 != 0, name).otherwise("")
    rows = c.select("c_custkey", aad.alias("azureaddeviceid"), aad.alias("EntraDeviceId"), *(other.alias(x) for x in ("ManagedDeviceId", "AutopilotObjectId", "IntuneDeviceId")), F.col("c_mktsegment").alias("SerialNumber"), F.when(k % 2 == 0, F.concat(F.lit("x"), s)).alias("ExternalDirectoryObjectId"), name.alias("PrimarySmtpAddress"), F.col("c_mktsegment").alias("ALIAS"), F.when(k % 2 == 0, s).alias("Id"), upn.alias("UPN"), upn.alias("UserPrincipalName"), F.col("c_mktsegment").alias("RoleName"), F.lit(" ").alias("displayName"))
    of = {a.family: a for a in identity.ADAPTERS}
    key = lambda f, n: of[f].key(rows.columns).alias(n)
    box = of["Exchange_SharedMailboxes"]
    card = F.array_join(F.transform(box.card(rows.columns), lambda p: F.concat(p["name"], F.lit("="), p["value"])), ";")
    return rows.select(
        "c_custkey", key("Intune_ManagedDevices_Compliance", "managed"), key("Intune_Devices_Autopilot", "autopilot"), key("Intune_iOS_Devices", "ios"), key("Intune_Android_Devices", "android"), key("Exchange_SharedMailboxes", "mailbox"),
        key("Entra_Users_Properties", "properties"), key("Entra_Users_AuthenticationMethods", "methods"), key("Entra_Role_Assignments", "roles"), of["Entra_Role_Assignments"].row_scope(rows.columns).alias("scope"), card.alias("card"), box.shown(rows.columns).alias("shown"),
    )


# --- filters


@query("""SELECT c_custkey FROM customer WHERE contains(lower(concat_ws(' | ', c_name, c_mktsegment)), '9 | build')""")
def library_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.anywhere(table(spark, sf_dir, "customer"), " 9 | BUILD ", ["c_name", "c_mktsegment"]).select("c_custkey")


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def fixed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return predicates.fixed_rows(table(spark, sf_dir, "customer"), named, "c_custkey").select("c_custkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 1 THEN 'not_applicable' WHEN o_orderkey % 5 IN (0, 1) THEN 'not_applicable' WHEN o_orderkey % 2 = 0 THEN 'no_coverage' END AS gate FROM orders""")
def applicability_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    model = F.when(k % 5 == 0, "Windows 365 Cloud PC Enterprise").when(k % 5 == 1, "Virtual Machine").when(k % 5 == 2, "VMware 7").otherwise("Laptop")
    gate = links.applicability(F.when(k % 3 == 0, "Android").when(k % 3 == 1, "Windows 11").otherwise(""), model, k % 2 == 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", gate.alias("gate"))


# --- differences


@query("""WITH b AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS s FROM customer WHERE c_custkey % 7 <> 0), a AS (SELECT c_custkey AS k, c_name AS n, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END AS s FROM customer WHERE c_custkey % 11 <> 0),
d AS (SELECT 'Added' AS change, a.k::VARCHAR AS key, NULL AS property, 0 AS r FROM a ANTI JOIN b USING (k) UNION ALL SELECT 'Removed', b.k::VARCHAR, NULL, 1 FROM b ANTI JOIN a USING (k) UNION ALL SELECT 'Changed', a.k::VARCHAR, 's', 2 FROM a JOIN b USING (k) WHERE a.s <> b.s)
SELECT change, key, property, (SELECT count(*) FROM d) > 40 AS more FROM d ORDER BY r, lower(key), key, property LIMIT 40""")
def detail_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of 40 lines, which is what the cap is for, and whether there are more."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"), F.col("c_mktsegment").alias("s"), F.lit(0).alias("row_ix"))
    after = c.filter("k % 11 <> 0").withColumn("s", F.when(F.col("k") % 5 == 0, "NEW").otherwise(F.col("s")))
    return diff.details(diff.pair_diff(c.filter("k % 7 <> 0"), after, F.col("k").cast("string"), "row_ix"), 40).select("change", "key", "property", "more")


@query(f"""WITH {_FD}, p AS (SELECT * FROM (VALUES ('24 hours', 24), ('7 days', 168)) v(period, h)), sn AS (SELECT DISTINCT family, captured_at FROM fd),
pr AS (SELECT family, period, max(captured_at) AS latest, max(captured_at) FILTER (captured_at <= TIMESTAMP '2024-01-29 12:00:00' - h * INTERVAL 1 HOUR) AS base, any_value(TIMESTAMP '2024-01-29 12:00:00' - h * INTERVAL 1 HOUR) AS cut FROM sn, p GROUP BY 1, 2),
ok AS (SELECT * FROM pr WHERE base IS NOT NULL AND latest > cut), a AS (SELECT period, fd.* FROM ok JOIN fd ON fd.family = ok.family AND fd.captured_at = latest), b AS (SELECT period, fd.* FROM ok JOIN fd ON fd.family = ok.family AND fd.captured_at = base),
j AS (SELECT coalesce(a.key, b.key) AS entity, coalesce(a.family, b.family) AS family, coalesce(a.period, b.period) AS period, CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN 'removed' WHEN a.n_events <> b.n_events THEN 'modified' END AS change FROM a FULL JOIN b ON a.key = b.key AND a.family = b.family AND a.period = b.period)
SELECT * FROM j WHERE change IS NOT NULL""")
def entity_period_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _families(spark, sf_dir).withColumnRenamed("key", "entity")
    pairs = periods.period_pairs(h.select("family", "captured_at"), ref(), {"24 hours": 24, "7 days": 168})
    return pit.period_events(h, pairs, ["n_events"])[0].select("entity", "family", "period", "change")


@query("""WITH b AS (SELECT c_custkey AS k, c_mktsegment AS r FROM customer WHERE c_custkey % 6 <> 0), a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS r FROM customer WHERE c_custkey % 9 <> 0)
SELECT coalesce(a.k, b.k)::VARCHAR AS filter_id, CASE WHEN b.k IS NULL THEN 'indeterminate' WHEN a.k IS NULL THEN 'removed' WHEN a.r = b.r THEN 'unchanged' ELSE 'changed' END AS state, CASE WHEN b.k IS NULL THEN NULL WHEN a.k IS NULL THEN 'assignment_filter_removed' WHEN a.r <> b.r THEN 'assignment_filter_changed' END AS event,
 CASE WHEN b.k IS NULL THEN 'baseline_filter_coverage_unavailable' END AS reason FROM a FULL JOIN b ON a.k = b.k""")
def filter_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filter_diff(spark, sf_dir).select("filter_id", "state", "event", "reason")


def _filter_docs(rows: DataFrame, by: str, rule: Column) -> DataFrame:
    """A document of filters for each nation; display names differ between calls and are no semantics."""
    one = F.struct(F.when(F.col("c_custkey") >= 0, F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit(by), "c_name").alias("displayName"), rule.alias("rule"))
    return rows.groupBy("c_nationkey").agg(F.parse_json(F.to_json(F.struct(F.collect_list(one).alias("assignmentFilters")))).alias("doc"))


def _filter_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    before = policy.normal_filters(_filter_docs(c.filter("c_custkey % 6 <> 0"), "old ", F.col("c_mktsegment")), ["c_nationkey"], "doc")
    after = policy.normal_filters(_filter_docs(c.filter("c_custkey % 9 <> 0"), "new ", F.when(F.col("c_custkey") % 4 == 0, "new").otherwise(F.col("c_mktsegment"))), ["c_nationkey"], "doc")
    return policy.filter_diff(before, after, False, True)


@query("""WITH b AS (SELECT c_custkey AS k, c_mktsegment AS r FROM customer WHERE c_custkey % 6 <> 0), a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS r FROM customer WHERE c_custkey % 9 <> 0),
f AS (SELECT CASE WHEN b.k IS NULL THEN 'indeterminate' WHEN a.k IS NULL THEN 'removed' WHEN a.r = b.r THEN 'unchanged' ELSE 'changed' END AS s FROM a FULL JOIN b ON a.k = b.k)
SELECT 'assignmentFilters' AS section, s AS name, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'eventsByType', 'assignment_filter_' || s, count(*) FROM f WHERE s IN ('removed', 'changed') GROUP BY 2
UNION ALL SELECT 'suppressionCategories', 'assignment_filter_existence_unavailable', count(*) FROM f WHERE s = 'indeterminate' HAVING count(*) > 0 UNION ALL SELECT 'policies', CASE WHEN o_orderstatus = 'O' THEN 'modified' ELSE 'unchanged' END, count(*) FROM orders GROUP BY 2""")
def comparison_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _filter_diff(spark, sf_dir)
    policies = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "O", "modified").otherwise("unchanged").alias("state"))
    return policy.summary_counts(policies, f, f, f)


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN '—' WHEN c_custkey IS NOT NULL AND o_custkey % 3 = 1 THEN 'f ' || c_name ELSE o_custkey::VARCHAR END AS shown,
CASE WHEN o_custkey % 3 = 0 THEN '' WHEN c_custkey IS NOT NULL AND o_custkey % 3 = 1 THEN o_custkey::VARCHAR WHEN c_custkey IS NOT NULL THEN c_mktsegment ELSE '' END AS detail FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) c ON c_custkey = o_custkey""")
def filter_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, o = F.col("c_custkey"), F.col("o_custkey")
    f = table(spark, sf_dir, "customer").filter("c_custkey % 10 <> 0").select(k.cast("string").alias("filter_id"), F.when(k % 3 == 1, F.concat(F.lit("f "), "c_name")).alias("display"), F.col("c_mktsegment").alias("rule"))
    asks = table(spark, sf_dir, "orders").select("o_orderkey", F.when(o % 3 != 0, o.cast("string")).alias("filter_id"))
    return policy.filter_presentation(asks, f).select("o_orderkey", "shown", "detail")


# --- documents


@query("""WITH c AS (SELECT conv_id, turn FROM conversations), d AS (SELECT * FROM c WHERE turn % 3 <> 2)
SELECT conv_id AS bundle, conv_id || '/' || turn AS path, CASE WHEN turn % 3 = 1 THEN 'snapshot id mismatch' END AS issue FROM d WHERE turn % 3 = 1 UNION ALL SELECT conv_id, conv_id || '/' || turn, 'captured at mismatch' FROM d WHERE turn % 2 = 1
UNION ALL SELECT conv_id, NULL, 'count mismatch' FROM c GROUP BY 1 HAVING count(*) FILTER (turn % 3 = 2) > 0""")
def document_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("bundle"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), "turn")
    docs = c.filter("turn % 3 <> 2").select("bundle", "path", F.when(F.col("turn") % 3 == 1, "other").otherwise("id").alias("snapshot_id"), F.when(F.col("turn") % 2 == 1, "then").otherwise(" now ").alias("captured_at"))
    told = c.select("bundle").distinct().select("bundle", F.lit("id").alias("snapshot_id"), F.lit("now").alias("captured_at"))
    return policy.document_issues(c, docs, told)


def _lines(rows: DataFrame, step: int) -> DataFrame:
    """Settings of each order: a group of lines, in line order or, with step -1, the other way round; each line has a child."""
    t = "#x.deviceManagementConfiguration"
    child = F.struct(F.lit(t + "SimpleSettingInstance").alias("@odata.type"), F.lit("quantity").alias("settingDefinitionId"), F.struct(F.col("q").alias("value")).alias("simpleSettingValue"))
    line = F.struct(F.lit(t + "ChoiceSettingInstance").alias("@odata.type"), F.concat(F.lit("line_"), F.col("l_linenumber").cast("string")).alias("settingDefinitionId"), F.struct(F.col("l_returnflag").alias("value"), F.array(child).alias("children")).alias("choiceSettingValue"))
    ordered = F.array_sort(F.collect_list(F.struct((F.col("l_linenumber") * step).alias("n"), F.col("q").alias("m"), line.alias("line"))), lambda a, b: F.when(a.n < b.n, -1).when(a.n > b.n, 1).when(a.m < b.m, -1).otherwise(1))
    group = F.struct(F.lit(t + "GroupSettingCollectionInstance").alias("@odata.type"), F.lit("lines").alias("settingDefinitionId"), F.array(F.struct(F.transform(ordered, lambda x: x.line).alias("children"))).alias("groupSettingCollectionValue"))
    docs = rows.groupBy(F.col("l_orderkey").alias("policy_key")).agg(F.parse_json(F.to_json(F.struct(F.array(F.struct(group.alias("settingInstance"))).alias("settings")))).alias("doc"))
    return policy.setting_hashes(policy.setting_nodes(policy.tree_nodes(docs, ["policy_key"], "doc"), ["policy_key"]), ["policy_key"])


@query("""SELECT l_orderkey AS policy_key, l_orderkey % 10 <> 0 AS same FROM lineitem GROUP BY 1""")
def setting_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a policy's settings hash the same with their children in another order, and other quantities in every tenth."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("int").alias("q"))
    top = lambda rows, name: rows.filter("depth = 0").select("policy_key", F.col("subtree").alias(name))
    other = li.withColumn("q", F.col("q") + F.when(F.col("l_orderkey") % 10 == 0, 1).otherwise(0))
    return top(_lines(li, 1), "a").join(top(_lines(other, -1), "b"), "policy_key").select("policy_key", (F.col("a") == F.col("b")).alias("same"))


@query("""SELECT o_orderkey AS policy_key, CASE WHEN o_orderkey % 3 = 0 THEN 'opaque' ELSE 'd' || o_custkey END AS definition_id, o_orderkey % 2 = 0 AS enabled FROM orders WHERE o_orderkey % 5 <> 0""")
def template_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.admx_values(_templates(spark, sf_dir), ["policy_key"], "doc").select("policy_key", "definition_id", "enabled").filter("enabled is not null")


@query("""SELECT o_orderkey AS policy_key, o_orderkey % 5 = 0 AND o_orderkey % 4 < 2 AS blocked FROM orders""")
def template_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.admx_blocked(_templates(spark, sf_dir), ["policy_key"], "doc")


def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    value = F.struct((k % 2 == 0).alias("enabled"), F.when(k % 3 != 0, F.struct(F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("id"))).alias("definition"))
    doc = F.struct(F.when(k % 5 != 0, F.array(value)).otherwise(F.array().cast("array<struct<enabled: boolean, definition: struct<id: string>>>")).alias("definitionValues"), F.struct(pick(k, 1, "error", "Partial", "success", "").alias("status")).alias("retrieval"))
    return table(spark, sf_dir, "orders").select(k.alias("policy_key"), F.parse_json(F.to_json(doc)).alias("doc"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'missing snapshotId' WHEN 1 THEN 'bad capturedAtUtc' WHEN 2 THEN 'unsupported snapshot version' ELSE '' END AS issues, CASE WHEN o_orderkey % 6 = 0 THEN 'error' WHEN o_orderkey % 6 = 1 OR o_orderkey % 5 = 0 THEN 'warning' WHEN o_orderkey % 2 = 0 THEN 'informational' ELSE 'success' END AS trust,
CASE o_orderkey % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'attention' ELSE 'observed' END AS observed FROM orders""")
def manifest_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    issues = policy.manifest_issues(F.when(k % 4 == 2, 9), F.lit(4), F.when(k % 4 != 0, "id"), F.when(k % 4 == 1, "soon").otherwise("2026-01-01T00:00:00Z"), F.lit("inventory.csv"))
    export = F.when(k % 6 == 0, "integrity_error").when(k % 6 == 1, "incomplete").otherwise("complete")
    trust = policy.trust_level(export, F.when(k % 2 == 0, 1).otherwise(0), F.when(k % 5 == 0, 2).otherwise(0))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(issues, ",").alias("issues"), trust.alias("trust"), policy.run_observation(export).alias("observed"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'settings' WHEN o_orderkey % 3 = 1 THEN 'assignments' ELSE '' END AS blocked, o_orderkey % 3 = 2 AS eligible FROM orders""")
def hash_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    got = F.create_map(F.lit("settings"), F.when(k % 3 == 0, "error").otherwise("success"), F.lit("assignments"), F.when(k % 3 == 1, "partial").otherwise("not_applicable"))
    blocked = policy.blockers(got, ["settings", "assignments"])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(blocked, ",").alias("blocked"), (policy.policy_hash(blocked, F.col("o_orderstatus"), k) != "").alias("eligible"))


@query("""WITH p AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN 'Windows' ELSE 'iOS' END AS platform, o_orderpriority AS source, CASE WHEN o_orderkey % 4 = 0 THEN 'added' WHEN o_orderkey % 4 = 1 THEN 'modified' ELSE 'unchanged' END AS state FROM orders)
SELECT p.k AS policy_key, state, count(l_orderkey) AS assignments FROM p LEFT JOIN lineitem ON l_orderkey = p.k WHERE platform = 'Windows' AND state <> 'unchanged' GROUP BY ALL""")
def inventory_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    p = table(spark, sf_dir, "orders").select(k.alias("policy_key"), F.lit("n").alias("name"), F.when(F.col("o_orderstatus") == "O", "Windows").otherwise("iOS").alias("platform"), F.col("o_orderpriority").alias("source"))
    d = p.filter("policy_key % 4 < 2").select("policy_key", F.when(F.col("policy_key") % 4 == 0, "added").otherwise("modified").alias("state"))
    rows = policy.inventory(p, d, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("policy_key")))
    return policy.filter_inventory(rows, platform="Windows", needle="N WINDOWS").filter("state <> 'unchanged'").select("policy_key", "state", "assignments")


@query("""WITH g AS (SELECT DISTINCT c_nationkey % 7 AS seen FROM customer), a AS (SELECT DISTINCT o_custkey AS group_id, year(o_orderdate) - 1990 AS t FROM orders), u AS (SELECT t, max(seen) AS used FROM a JOIN g ON seen <= t GROUP BY 1)
SELECT a.group_id, a.t, coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_name END, a.group_id::VARCHAR) AS name FROM a LEFT JOIN u USING (t) LEFT JOIN customer ON c_custkey = a.group_id AND c_nationkey % 7 = used""")
def group_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda n: F.timestamp_seconds(n * 86400).alias("captured_at")
    g = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("group_id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).otherwise("").alias("display"), at(F.col("c_nationkey") % 7))
    t = (F.year("o_orderdate") - 1990).cast("long")
    asks = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("group_id"), t.alias("t"), at(t)).distinct()
    return policy.names_asof(asks, g).select(F.col("group_id").cast("long").alias("group_id"), "t", "name")


@query("""WITH e AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'removed' ELSE 'added' END AS event FROM customer)
SELECT k AS policy_key, event, CASE WHEN event = 'removed' THEN coalesce(CASE WHEN k % 2 = 0 THEN 'old' END, CASE WHEN k % 5 <> 0 THEN 'new' END) ELSE coalesce(CASE WHEN k % 5 <> 0 THEN 'new' END, CASE WHEN k % 2 = 0 THEN 'old' END) END AS policy FROM e""")
def named_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("policy_key"), F.when(k % 3 == 0, "removed").otherwise("added").alias("event"))
    side = lambda cond, n: c.filter(cond).select("policy_key", F.lit(n).alias("name"))
    return policy.event_rows(c, side("policy_key % 2 = 0", "old"), side("policy_key % 5 <> 0", "new")).select("policy_key", "event", "policy")


# --- entities and files


@query("""SELECT user_id AS entity, 'roles' AS collection, first(event_type ORDER BY event_id) AS "primary" FROM events GROUP BY user_id, event_type""")
def relationship_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = resolve.COLLECTIONS[0]
    rows = events(spark, sf_dir).select(F.col("user_id").alias("entity"), F.col("event_id").alias("row_ix"), F.col("event_type").alias("ROLENAME"), F.lit("Active").alias("RoleState"))
    again = rows.withColumns({"ROLENAME": F.upper("ROLENAME"), "row_ix": F.col("row_ix") + (1 << 40)})
    return resolve.collect_relationships(rows.unionByName(again), roles).select("entity", "collection", "primary")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'not_applicable' WHEN o_orderkey % 2 = 0 THEN 'populated' WHEN o_orderkey % 5 = 0 THEN 'no_coverage' WHEN o_orderkey % 3 = 1 THEN 'known_empty' ELSE 'unknown' END AS coverage FROM orders""")
def collection_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", resolve.collection_coverage(F.when(k % 2 == 0, 3).otherwise(0), F.when(k % 5 == 0, "no_snapshot").otherwise("snapshot_used"), k % 3 == 1, k % 6 != 0).alias("coverage"))


@query("""SELECT event_type AS family, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS at, arg_max(event_id, (ts, event_id)) AS file FROM events GROUP BY 1""")
def latest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.col("event_type").alias("family"), F.col("ts").alias("captured_at"), F.col("event_id").alias("file"))
    return identity.latest_files(e).select("family", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss").alias("at"), "file")


@query("""WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'deleted' WHEN o_orderkey % 5 = 0 THEN 'changed' ELSE 'reused' END AS action FROM orders), b AS (SELECT k FROM o WHERE k % 10 = 5 AND action = 'changed')
SELECT k::VARCHAR AS path, CASE WHEN action = 'changed' AND k NOT IN (SELECT k FROM b) THEN 'new' ELSE 'old' END AS v FROM o WHERE action <> 'deleted'""")
def rows_after_a_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted files' rows go, parsed files' rows are replaced, failed files keep theirs."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    action = F.when(k % 11 == 0, "deleted").when(k % 5 == 0, "changed").otherwise("reused")
    files = o.select(k.cast("string").alias("path"), action.alias("action"), "o_orderkey")
    failed = files.filter("action = 'changed' and o_orderkey % 10 = 5").select("path")
    row = lambda df, v: df.select("path", F.lit(v).alias("v"))
    return incremental.next_rows(row(files, "old"), row(files.filter("action = 'changed'"), "new"), files, failed)


@query("""SELECT o_orderkey::VARCHAR AS path, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS stage FROM orders WHERE o_orderkey % 3 <> 0""")
def parse_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderstatus").alias("family"), F.when(F.col("o_orderkey") % 3 == 0, "reused").otherwise("changed").alias("action"))
    first, rest = incremental.parse_order(o.select("path", "action"), o.select("path", "family"), ["F"])
    return first.select("path", F.lit(1).alias("stage")).unionByName(rest.select("path", F.lit(2).alias("stage")))


@query("""WITH b AS (SELECT DISTINCT date_trunc('day', ts) + INTERVAL 1 DAY AS t FROM events WHERE day(ts) % 2 = 0), p AS (SELECT * FROM (VALUES ('24 hours', 24), ('7 days', 168), ('30 days', 720)) v(period, h)),
r AS (SELECT period, (SELECT max(t) FROM b) AS latest, (SELECT count(*) FROM b) AS n, TIMESTAMP '2024-01-29 12:00:00' - h * INTERVAL 1 HOUR AS cut, (SELECT max(t) FROM b WHERE t <= TIMESTAMP '2024-01-29 12:00:00' - h * INTERVAL 1 HOUR) AS base FROM p)
SELECT period, CASE WHEN n = 0 THEN 'not_enough_snapshots' WHEN n < 2 THEN 'no_baseline' WHEN latest <= cut THEN 'stale' WHEN base IS NULL THEN 'no_baseline' ELSE 'ok' END AS reason, CASE WHEN n >= 2 AND latest > cut THEN strftime(base, '%Y-%m-%d') END AS baseline FROM r""")
def policy_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = events(spark, sf_dir).select(F.date_format("captured_at", "yyyyMMdd").alias("snapshot_id"), "captured_at", F.dayofmonth("ts").alias("d")).distinct()
    found = periods.policy_period_pairs(b.filter("d % 2 = 0"), b, ref(), {"24 hours": 24, "7 days": 168, "30 days": 720})
    return found.select("period", "reason", F.date_format("baseline", "yyyy-MM-dd").alias("baseline"))


# --- dashboards

_K = "o_orderkey"
_MAIL = f"""WITH m AS (SELECT year(o_orderdate)::INT AS year, {sql_pick(_K, 1, "True", "no", "")} AS a, {sql_pick(_K, 2, "true", "false")} AS f, {sql_pick(_K, 3, "1", "0", None)} AS w, {sql_pick(_K, 1, "Error: x", "Keep", "")} AS r FROM orders)"""


def _by_year(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), *(v.alias(k) for k, v in columns.items()))


def _cards(rows: DataFrame, name: str) -> DataFrame:
    found = cards.detect(rows.columns)
    if found is None or found.name != name:
        raise ValueError(f"{name} was not detected")
    return metrics.dashboard(rows, found, by=["year"])


@query(_MAIL + """ SELECT year, count(*) AS "Total", count(*) FILTER (a = 'True') AS "Any Delegation", count(*) FILTER (f = 'true') AS "Full Access", count(*) FILTER (w = '1') AS "Send As", count(*) FILTER (f = 'true') AS "Send on Behalf", count(*) FILTER (a <> 'True') AS "No Delegates",
count(*) FILTER (w = '1') AS "Forwarding", count(*) FILTER (f <> 'true') AS "Without Full Access", count(*) FILTER (f = 'false') AS "Visible", count(*) FILTER (f = 'true') AS "Hidden", 0::BIGINT AS "Litigation Hold", count(*) FILTER (r = 'Keep') AS "With Retention Policy" FROM m GROUP BY 1""")
def cards_mailboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(_K)
    f, w = pick(k, 2, "true", "false"), pick(k, 3, "1", "0", None)
    return _cards(_by_year(spark, sf_dir, PrimarySmtpAddress=F.lit("x"), HasFullAccessDelegates=f, HasSendAsDelegates=w, HasSendOnBehalfDelegates=f, HasAnyDelegation=pick(k, 1, "True", "no", ""), HasForwarding=w, HiddenFromAddressListsEnabled=f, RetentionPolicy=pick(k, 1, "Error: x", "Keep", "")), "Shared mailboxes")


@query(f"""WITH m AS (SELECT year(o_orderdate)::INT AS year, {sql_pick(_K, 1, "mdm", "easMdm", "exchange")} AS g, {sql_pick(_K, 2, "Compliant", "noncompliant", "")} AS c, {sql_pick(_K, 1, "company", "personal", "Companion")} AS o, {sql_pick(_K, 3, "Windows 11", "macOS", "iPadOS", "Android", "")} AS s, {sql_pick(_K, 1, "Active", "stale31-90d", "Stale>90d", "Never")} AS a FROM orders)
SELECT year, count(*) AS "Total", count(*) FILTER (g <> 'exchange') AS "MDM managed", count(*) FILTER (c = 'Compliant') AS "Compliant", count(*) FILTER (c = 'noncompliant') AS "NonCompliant", count(*) FILTER (a = 'Active') AS "Active", count(*) FILTER (a = 'stale31-90d') AS "Stale 31 90", count(*) FILTER (a = 'Stale>90d') AS "Stale over 90",
count(*) FILTER (o <> 'personal') AS "Company", count(*) FILTER (o = 'personal') AS "Personal", count(*) FILTER (s = 'Windows 11') AS "Windows", count(*) FILTER (s = 'macOS') AS "macOS", count(*) FILTER (s = 'iPadOS') AS "iOS iPadOS", count(*) FILTER (s = 'Android') AS "Android" FROM m GROUP BY 1""")
def cards_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(_K)
    return _cards(_by_year(spark, sf_dir, ManagedDeviceId=k.cast("string"), ManagementAgent=pick(k, 1, "mdm", "easMdm", "exchange"), ComplianceState=pick(k, 2, "Compliant", "noncompliant", ""), OwnerType=pick(k, 1, "company", "personal", "Companion"), OperatingSystem=pick(k, 3, "Windows 11", "macOS", "iPadOS", "Android", ""), DeviceActivityStatus=pick(k, 1, "Active", "stale31-90d", "Stale>90d", "Never")), "Managed devices")


@query(f"""WITH m AS (SELECT year(o_orderdate)::INT AS year, {sql_pick(_K, 1, "true", "False")} AS t, {sql_pick(_K, 2, "0", "3", "x", "")} AS n, {sql_pick(_K, 1, "Assigned", "Dynamic", "")} AS m, o_orderpriority AS r FROM orders)
SELECT year, count(*) AS "Groups Total", count(*) FILTER (t = 'true') AS "Security", count(*) FILTER (t = 'true') AS "Unified", count(*) FILTER (t = 'true') AS "Teams", count(*) FILTER (t = 'true') AS "Mail enabled", 0::BIGINT AS "Synced", count(*) FILTER (t = 'true') AS "Dynamic", count(*) FILTER (m = 'Assigned') AS "Assigned", count(*) FILTER (n = '3') AS "Groups with Members", count(*) FILTER (n = '0') AS "Empty",
count(*) FILTER (n = '3') AS "With Owners", count(*) FILTER (n = '0') AS "Without Owners", 0::BIGINT AS "Used in CA", count(r) AS "Assigned Roles", 0::BIGINT AS "Enterprise Apps", 0::BIGINT AS "Access Packages" FROM m GROUP BY 1""")
def cards_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(_K)
    t, n = pick(k, 1, "true", "False"), pick(k, 2, "0", "3", "x", "")
    return _cards(_by_year(spark, sf_dir, FriendlyGroupType=F.lit("g"), SecurityEnabled=t, IsUnified=t, IsTeamsTeam=t, MailEnabled=t, IsDynamic=t, MembershipType=pick(k, 1, "Assigned", "Dynamic", ""), MembersCount=n, OwnersCount=n, AssignedRoles=F.col("o_orderpriority")), "Groups")


@query(f"""WITH m AS (SELECT year(o_orderdate)::INT AS year, o_custkey % 40 AS p, o_custkey % 3 AS c, {sql_pick(_K, 1, "Enabled", "disabled", "")} AS s, {sql_pick(_K, 2, "pol", "")} AS q FROM orders)
SELECT year, count(DISTINCT p) AS "Packages", count(DISTINCT nullif(q, '')) AS "Policies", count(DISTINCT c) AS "Catalogs", count(*) AS "Rows", count(*) FILTER (s = 'Enabled') AS "Enabled Policies", count(*) FILTER (s = 'disabled') AS "Disabled Policies", count(DISTINCT p) FILTER (s = 'Enabled') AS "Packages with Enabled",
count(DISTINCT p) FILTER (s = 'disabled') AS "Packages with Disabled", count(*) FILTER (q = '') AS "No Policy Rows", count(DISTINCT p) FILTER (q = '') AS "Packages without Policy" FROM m GROUP BY 1""")
def cards_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col(_K), F.col("o_custkey")
    return _cards(_by_year(spark, sf_dir, AccessPackageId=(c % 40).cast("string"), AccessPackageName=(c % 20).cast("string"), CatalogId=(c % 3).cast("string"), PolicyId=pick(k, 2, "pol", ""), PolicyStatus=pick(k, 1, "Enabled", "disabled", "")), "Access packages")


@query(f"""WITH m AS (SELECT year(o_orderdate)::INT AS year, {sql_pick(_K, 1, "Member", "guest")} AS u, {sql_pick(_K, 2, "true", "no")} AS e, {sql_pick(_K, 1, "TRUE", "false", "")} AS s, {sql_pick(_K, 3, "boss", " ")} AS b FROM orders)
SELECT year, count(*) AS "Identity Total", count(*) FILTER (e = 'true') AS "Enabled", count(*) FILTER (e = 'no') AS "Disabled", count(*) FILTER (u = 'Member') AS "Members", count(*) FILTER (u = 'guest') AS "Guests", count(*) FILTER (s = 'TRUE') AS "Synced", count(*) FILTER (s <> 'TRUE') AS "Cloud only",
count(*) FILTER (b = 'boss') AS "With ManagerUPN", count(*) FILTER (b = ' ') AS "Without ManagerUPN", {', '.join(f'0::BIGINT AS "With {c}", count(*) AS "Without {c}"' for c in ("Department", "JobTitle", "UsageLocation", "CompanyName", "Sponsors"))} FROM m GROUP BY 1""")
def cards_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(_K)
    return _cards(_by_year(spark, sf_dir, UserType=pick(k, 1, "Member", "guest"), AccountEnabled=pick(k, 2, "true", "no"), OnPremisesSyncEnabled=pick(k, 1, "TRUE", "false", ""), ManagerUPN=pick(k, 3, "boss", " ")), "Identity")


@query(f"""WITH m AS (SELECT year(o_orderdate)::INT AS year, {sql_pick(_K, 1, "enrolled", "notContacted")} AS e, {sql_pick(_K, 2, "Assigned", "NotAssigned", "assigned")} AS a, {sql_pick(_K, 1, "Review", "ReadyToAssign", "ReadyToUnassign")} AS r FROM orders)
SELECT year, count(*) AS "Total", count(*) FILTER (e = 'enrolled') AS "Enrolled", count(*) FILTER (a = 'Assigned') AS "Assigned", count(*) FILTER (a = 'NotAssigned') AS "Not Assigned", count(*) FILTER (r = 'ReadyToAssign') AS "Ready To Assign", count(*) FILTER (r = 'ReadyToUnassign') AS "Ready To Unassign", count(*) FILTER (r = 'Review') AS "Review" FROM m GROUP BY 1""")
def cards_autopilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(_K)
    return _cards(_by_year(spark, sf_dir, AutopilotObjectId=k.cast("string"), SerialNumber=F.lit("s"), EnrollmentState=pick(k, 1, "enrolled", "notContacted"), AssignmentStatus=pick(k, 2, "Assigned", "NotAssigned", "assigned"), RecommendedAction=pick(k, 1, "Review", "ReadyToAssign", "ReadyToUnassign"), GroupTag=F.lit("")), "Autopilot")


@query("""SELECT count(*) FILTER (change = 'Added') AS added, count(*) FILTER (change = 'Changed') AS changed FROM (WITH b AS (SELECT user_id AS k, arg_max(event_type, (ts, event_id)) AS v FROM events WHERE ts::DATE = DATE '2024-01-10' GROUP BY 1), a AS (SELECT user_id AS k, arg_max(event_type, (ts, event_id)) AS v FROM events WHERE ts::DATE = DATE '2024-01-20' GROUP BY 1)
SELECT CASE WHEN b.k IS NULL THEN 'Added' WHEN a.v <> b.v THEN 'Changed' END AS change, coalesce(a.v, '') || '|' || coalesce(b.v, '') AS t FROM a LEFT JOIN b USING (k)) WHERE change = 'Added' OR contains(t, 'click')""")
def detail_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added users, and last types that changed from or to a click."""
    before, after = (d.select("key", "last_type", "row_ix") for d in _two_days(spark, sf_dir))
    d = diff.details(diff.pair_diff(before, after, F.col("key"), "row_ix", exclude=["key"]))
    one = lambda rows, n: rows.agg(F.count(F.lit(1)).alias(n))
    return one(policy.filter_details(d, "Added"), "added").join(one(policy.filter_details(d, "Changed", "CLICK"), "changed"))
