"""Further queries: bindings, collections, documents and bookkeeping. They register where the first ones do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, predicates
from ..operators import asof, diff, identity, links, metrics, periods, policy, resolve
from ..streaming import incremental
from . import families
from .queries import _FD, _RECENT, _UD, REFERENCE, _alias_obs, _families, _recent, _used, events, query, ref, table, user_day


@query("""WITH o AS (SELECT json_extract_string(props, '$.k') AS value, date_trunc('day', ts) AS t, list_distinct(list(user_id::VARCHAR)) AS owners FROM events GROUP BY 1, 2),
r AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR END AS uid, CASE WHEN event_id % 7 = 1 THEN '' ELSE json_extract_string(props, '$.k') END AS v, date_trunc('day', ts) AS at FROM events),
m AS (SELECT event_id, uid, v, max(t) AS t FROM r LEFT JOIN o ON o.value = r.v AND o.t <= r.at GROUP BY ALL),
x AS (SELECT uid, v, owners FROM m LEFT JOIN o ON o.value = m.v AND o.t = m.t),
y AS (SELECT CASE WHEN uid IS NOT NULL THEN NULL WHEN v = '' THEN 'missing_k' WHEN owners IS NULL THEN 'unbound_k' WHEN len(owners) > 1 THEN 'ambiguous_k' END AS reason, CASE WHEN uid IS NOT NULL THEN uid WHEN v <> '' AND len(owners) = 1 THEN owners[1] END AS entity FROM x)
SELECT reason, count(*) AS n, count(DISTINCT entity) AS entities FROM y GROUP BY 1""")
def row_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).alias("uid"), F.when(F.col("event_id") % 7 != 1, F.get_json_object("props", "$.k")).alias("v"), F.date_trunc("day", "ts").alias("captured_at"))
    bound = asof.bind_rows(rows, _alias_obs(spark, sf_dir), F.col("uid"), F.col("v"), kind="k")
    return bound.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("entities"))


@query("""WITH t AS (SELECT user_id AS owner, max(ts) - INTERVAL 20 DAY AS target FROM events GROUP BY 1)
SELECT t.owner::VARCHAR AS owner, count(DISTINCT json_extract_string(props, '$.k'))::INT AS n, min(json_extract_string(props, '$.k')) AS first FROM t JOIN events e ON e.user_id = t.owner AND date_trunc('day', ts) <= target GROUP BY 1""")
def aliases_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = events(spark, sf_dir).groupBy(F.col("user_id").cast("string").alias("owner")).agg((F.max("ts") - F.expr("interval 20 days")).alias("target"))
    return asof.aliases_at(_alias_obs(spark, sf_dir), targets).select("owner", F.size("values").alias("n"), F.col("values")[0].alias("first"))


@query("""WITH s AS (SELECT max(ts) AS t, ts::DATE AS day, event_type AS family FROM events GROUP BY 2, 3)
SELECT family, strftime(day, '%Y-%m-%d') AS day, strftime(t, '%H:%M:%S') AS at, strftime(lag(t) OVER (PARTITION BY family ORDER BY t), '%H:%M:%S') AS before FROM s QUALIFY before IS NOT NULL""")
def adjacent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).select(F.col("event_type").alias("family"), F.col("ts").alias("captured_at"))
    return periods.adjacent_pairs(periods.latest_of_day(s)).select("family", F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format("captured_at", "HH:mm:ss").alias("at"), F.date_format("before", "HH:mm:ss").alias("before"))


@query(f"""WITH {_FD}, d AS (SELECT DISTINCT family, captured_at FROM fd), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY captured_at DESC) AS n FROM d)
SELECT family, strftime(max(captured_at) FILTER (n = 1), '%Y-%m-%d') AS latest, strftime(max(captured_at) FILTER (n = 2), '%Y-%m-%d') AS previous FROM r GROUP BY 1""")
def latest_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = periods.latest_previous(_families(spark, sf_dir).select("family", "captured_at"))
    return p.select("family", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("latest", "previous")))


@query(f"""WITH s AS (SELECT event_type AS family, max(ts) AS t, ts::DATE AS day FROM events GROUP BY 1, 3),
d AS (SELECT d::DATE AS day FROM generate_series(DATE '2024-01-01', DATE '{REFERENCE[:10]}', INTERVAL 1 DAY) g(d) WHERE isodow(d) < 6 ORDER BY 1 DESC LIMIT 10),
w AS (SELECT family, day FROM (SELECT DISTINCT family FROM s), d)
SELECT count(t) AS observed, count(*) AS expected, count(*) - count(t) AS missing, round(count(t) / count(*), 6) AS coverage FROM w LEFT JOIN s USING (family, day)""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).select(F.col("event_type").alias("family"), F.col("ts").alias("captured_at"))
    return periods.run_totals(periods.run_health(periods.latest_of_day(s).select("family", "captured_at"), ref(), 10))


@query("""SELECT c_custkey::VARCHAR AS entity, c_name AS display FROM customer WHERE contains(lower(c_custkey::VARCHAR || chr(10) || c_mktsegment || chr(10) || c_name), 'build')""")
def contains_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("entity"), F.col("c_mktsegment").alias("alias"), F.col("c_name").alias("display"))
    return identity.contains(c, "BUILD")


@query(f"""WITH {_FD} SELECT key AS entity, count(DISTINCT (family, captured_at))::INT AS n FROM fd GROUP BY 1""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _families(spark, sf_dir).select(F.col("key").alias("entity"), "family", F.col("captured_at").alias("observed_at"))
    return resolve.provenance(h.unionByName(h), ["entity"]).select("entity", F.size("sources").alias("n"))


@query("""SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2""")
def relationship_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("k", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")))
    return resolve.dedupe_relationships(e, ["user_id"], F.col("k"), "event_id").select("user_id", "event_type", "event_id")


@query("""WITH t AS (SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (ts < TIMESTAMP '2024-01-04'))) AS a, list_sort(list_distinct(list(event_type) FILTER (ts > TIMESTAMP '2024-01-27'))) AS b FROM events GROUP BY 1),
c AS (SELECT user_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM t)
SELECT user_id, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 'known_empty' WHEN len(a) > 0 AND len(b) > 0 AND a <> b THEN 'conflict' ELSE 'populated' END AS state, len(CASE WHEN len(a) > 0 THEN a ELSE b END)::INT AS n FROM c""")
def method_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda c: F.array_join(F.collect_list(F.when(c, F.col("event_type"))), ";")
    t = events(spark, sf_dir).groupBy("user_id").agg(pick(F.col("ts") < F.lit("2024-01-04").cast("timestamp")).alias("a"), pick(F.col("ts") > F.lit("2024-01-27").cast("timestamp")).alias("b"))
    m = resolve.merge_methods("a", F.upper("b"))
    return t.select("user_id", m.state.alias("state"), F.size(m.methods).alias("n"))


@query("""SELECT CASE WHEN event_type = 'click' THEN 'clicks' ELSE 'additional:events:' || event_type END AS key, count(*) AS n, max(CASE event_type WHEN 'click' THEN 1 ELSE 1000 END)::INT AS rank FROM events WHERE event_type <> 'error' GROUP BY 1""")
def field_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = events(spark, sf_dir).select(F.col("user_id").alias("entity"), F.lit("events").alias("family"), F.col("event_type").alias("name"), F.col("value").cast("string").alias("value"))
    names = facts.select("family", "name").distinct()
    bound = resolve.bind_fields(facts, names.filter("name = 'click'").withColumns({"key": F.lit("clicks"), "rank": F.lit(1)}), names.filter("name = 'error'"))
    return bound.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("rank"))


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy for each order: a group setting with a choice for each line, which holds a simple setting."""
    t = "#x.deviceManagementConfiguration"
    simple = F.struct(F.lit(t + "SimpleSettingInstance").alias("@odata.type"), F.lit("quantity").alias("settingDefinitionId"), F.struct(F.col("l_quantity").cast("int").alias("value")).alias("simpleSettingValue"))
    choice = F.struct(F.lit(t + "ChoiceSettingInstance").alias("@odata.type"), F.concat(F.lit("line_"), F.col("l_linenumber").cast("string")).alias("settingDefinitionId"), F.struct(F.col("l_returnflag").alias("value"), F.array(simple).alias("children")).alias("choiceSettingValue"))
    group = F.struct(F.lit(t + "GroupSettingCollectionInstance").alias("@odata.type"), F.lit("lines").alias("settingDefinitionId"), F.array(F.struct(F.array_sort(F.collect_list(choice), lambda a, b: F.when(a.settingDefinitionId < b.settingDefinitionId, -1).otherwise(1)).alias("children"))).alias("groupSettingCollectionValue"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("policy_key")).agg(F.parse_json(F.to_json(F.struct(F.array(F.struct(group.alias("settingInstance"))).alias("settings")))).alias("doc"))


@query("""SELECT l_orderkey AS policy_key, 'lines' AS definition_id, 'group_collection' AS kind, 0::INT AS depth, 1::BIGINT AS n, NULL::VARCHAR AS least FROM lineitem GROUP BY 1
UNION ALL SELECT l_orderkey, 'line_' || l_linenumber, 'choice', 1, count(*), min(l_returnflag) FROM lineitem GROUP BY 1, 2 UNION ALL SELECT l_orderkey, 'quantity', 'simple', 2, count(*), min(l_quantity::INT::VARCHAR) FROM lineitem GROUP BY 1""")
def setting_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = policy.setting_nodes(policy.tree_nodes(_settings(spark, sf_dir), ["policy_key"], "doc"), ["policy_key"])
    return nodes.groupBy("policy_key", "definition_id", "kind", "depth").agg(F.count(F.lit(1)).alias("n"), F.min("raw_value").alias("least"))


@query("""SELECT c_custkey AS policy_key, 'name' AS property, '"' || c_name || '"' AS value FROM customer UNION ALL SELECT c_custkey, 'place.nation', c_nationkey::VARCHAR FROM customer
UNION ALL SELECT c_custkey, 'tags', '["' || c_mktsegment || '",1]' FROM customer""")
def classic_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    doc = F.concat(F.lit('{"id":'), F.col("c_custkey").cast("string"), F.lit(',"name":"'), F.col("c_name"), F.lit('","place":{"nation":'), F.col("c_nationkey").cast("string"), F.lit(',"note":""},"tags":["'), F.col("c_mktsegment"), F.lit('",1],"none":[]}'))
    docs = c.select(F.col("c_custkey").alias("policy_key"), F.parse_json(doc).alias("doc"))
    return policy.classic_properties(policy.tree_nodes(docs, ["policy_key"], "doc", whole_lists=True), ["policy_key"]).select("policy_key", "property", "value")


@query("""SELECT o_orderkey AS policy_key, CASE WHEN o_orderstatus = 'O' THEN 'group|' || o_custkey || '|' || '|include' WHEN o_orderstatus = 'F' THEN 'all_devices|||' ELSE 'oddTarget|||' END AS assignment_key FROM orders""")
def policy_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "O", "groupAssignmentTarget").when(F.col("o_orderstatus") == "F", "allDevicesAssignmentTarget").otherwise("oddTarget")
    mine = F.col("o_orderstatus") == "O"
    target = F.struct(F.concat(F.lit("#microsoft.graph."), kind).alias("@odata.type"), F.when(mine, F.col("o_custkey").cast("string")).alias("groupId"), F.when(mine, "include").alias("deviceAndAppManagementAssignmentFilterType"))
    docs = o.select(F.col("o_orderkey").alias("policy_key"), F.parse_json(F.to_json(F.struct(F.array(F.struct(target.alias("target"))).alias("assignments")))).alias("doc"))
    return policy.assignments(docs, ["policy_key"], "doc").select("policy_key", "assignment_key")


@query("""WITH b AS (SELECT l_orderkey AS policy_key, l_linenumber AS k, arg_max(l_quantity, l_partkey) AS v FROM lineitem WHERE l_linenumber < 5 GROUP BY 1, 2), a AS (SELECT l_orderkey AS policy_key, l_linenumber AS k, arg_max(CASE WHEN l_linenumber = 2 THEN l_quantity + 1 ELSE l_quantity END, l_partkey) AS v FROM lineitem WHERE l_linenumber > 1 GROUP BY 1, 2),
hb AS (SELECT policy_key, list_sort(list((k, v))) AS h FROM b GROUP BY 1), ha AS (SELECT policy_key, list_sort(list((k, v))) AS h FROM a GROUP BY 1), m AS (SELECT policy_key FROM hb JOIN ha USING (policy_key) WHERE hb.h <> ha.h),
j AS (SELECT coalesce(a.policy_key, b.policy_key) AS policy_key, coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' END AS event FROM a FULL JOIN b ON a.policy_key = b.policy_key AND a.k = b.k)
SELECT policy_key, k::VARCHAR AS component_key, event FROM j SEMI JOIN m USING (policy_key) WHERE event IS NOT NULL AND k <> 6""")
def component_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a line's rows that have one part, both sides take that of the greater quantity: the SQL leaves it open which."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") == 6, "assignment").otherwise("setting")

    def side(rows: DataFrame, v) -> DataFrame:
        return rows.select(F.col("l_orderkey").alias("policy_key"), kind.alias("component_type"), F.col("l_linenumber").cast("string").alias("component_key"), v.cast("string").alias("value"), F.struct("l_partkey", "l_quantity").alias("position"), (F.col("l_linenumber") != 6).alias("trusted"))

    def hashed(rows: DataFrame) -> DataFrame:
        one = rows.groupBy("policy_key", "component_key").agg(F.max_by("value", "position").alias("value"))
        return one.groupBy("policy_key").agg(cells.semantic_hash(F.to_json(F.array_sort(F.collect_list(F.struct("component_key", "value"))))).alias("hash")).withColumn("source", F.lit("orders"))

    before, after = side(li.filter("l_linenumber < 5"), F.col("l_quantity")), side(li.filter("l_linenumber > 1"), F.col("l_quantity") + F.when(F.col("l_linenumber") == 2, 1).otherwise(0))
    ok = spark.range(1).select(F.lit("orders").alias("source"), F.lit("success").alias("status"))
    modified = policy.policy_diff(hashed(before), hashed(after), ok, ok).filter("state = 'modified'")
    return policy.component_events(before, after, modified).select("policy_key", "component_key", "event")


@query("""SELECT c_custkey AS policy_key, unnest(list_filter([CASE WHEN c_custkey % 5 = 0 THEN 'renamed' END, CASE WHEN c_custkey % 7 = 0 THEN 'description_changed' END, CASE WHEN c_custkey % 11 = 0 THEN 'applicability_changed' END], lambda x: x IS NOT NULL)) AS event FROM customer""")
def metadata_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    def side(new: bool) -> DataFrame:
        k = F.col("c_custkey")
        bump = lambda n, a, b: F.when(F.lit(new) & (k % n == 0), b).otherwise(a)
        tags = F.array(F.lit("1"), F.lit("0")) if new else F.array(F.lit("0"), F.lit("1"), F.lit("0"))
        return table(spark, sf_dir, "customer").select(k.alias("policy_key"), bump(5, F.col("c_name"), F.lit("new")).alias("name"), bump(7, F.lit("d"), F.lit("e")).alias("description"), tags.alias("scope_tags"), bump(11, F.lit('{"b":1,"a":2}' if new else '{"a":2,"b":1}'), F.lit('{"a":3}')).alias("applicability"))

    return policy.metadata_events(side(False), side(True))


@query("""SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.facet_counts(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("""SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'error' WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'partial' ELSE 'success' END AS status FROM orders GROUP BY 1""")
def normalization_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("o_orderstatus") == "P", "error").when(F.col("o_orderpriority") == "1-URGENT", "warning").otherwise("info")
    return policy.normalization_status(table(spark, sf_dir, "orders").withColumn("level", level), ["o_custkey"])


@query("""SELECT l_orderkey, CASE WHEN count(*) FILTER (l_returnflag = 'N') + count(*) FILTER (l_returnflag = 'R') <> count(*) THEN 'integrity_error' WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'incomplete' ELSE 'complete' END AS accounting FROM lineitem GROUP BY 1""")
def source_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda f: F.count_if(F.col("l_returnflag") == f)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("listed"), n("N").alias("ok"), n("R").alias("bad")).select("l_orderkey", policy.source_accounting(F.col("listed"), F.col("ok"), F.col("bad")).alias("accounting"))


@query("""SELECT conv_id AS policy_key, 'duplicate key' AS issue FROM conversations GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT conv_id, 'missing document' FROM conversations WHERE turn % 4 = 3
UNION ALL SELECT conv_id, 'absolute path' FROM conversations WHERE turn % 4 = 1 UNION ALL SELECT conv_id, 'path outside the bundle' FROM conversations WHERE turn % 4 = 2""")
def contract_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    path = F.concat(F.when(F.col("turn") % 4 == 1, "/").when(F.col("turn") % 4 == 2, "../").otherwise(""), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    inv = c.select(F.col("conv_id").alias("policy_key"), path.alias("path"))
    return policy.contract_issues(inv, c.filter("turn % 4 = 0").select(path.alias("path")))


@query("""SELECT count(DISTINCT user_id) AS entities, count(DISTINCT ts::DATE) AS files FROM events""")
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.statistics(events(spark, sf_dir).select(F.col("user_id").alias("entity"), F.to_date("ts").alias("file")))


@query("""SELECT DISTINCT user_id AS entity FROM events WHERE ts::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-01-04'""")
def affected_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.col("user_id").alias("entity"), F.to_date("ts").cast("string").alias("path"))
    d = F.to_date("path")
    action = F.when(d == F.lit("2024-01-03").cast("date"), "changed").when(d == F.lit("2024-01-04").cast("date"), "deleted").otherwise("reused")
    return incremental.affected(e, e.select("path").distinct().withColumn("action", action))


@query("""SELECT count(*) AS discovered, count(*) FILTER (k % 3 = 0 AND k % 2 = 0) AS parsed, count(*) FILTER (k % 3 <> 0) AS reused, count(*) FILTER (k % 3 = 0 AND k % 2 <> 0) AS failed, 0::BIGINT AS deleted, 'completed_with_errors' AS status FROM (SELECT o_orderkey AS k FROM orders)""")
def sync_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("path"))
    return incremental.accounting(o.select("path", F.when(F.col("k") % 3 == 0, "new").otherwise("reused").alias("action")), o.filter("k % 3 = 0").select("path", (F.col("k") % 2 == 0).alias("ok")))


@query("""SELECT source, min(doc_id) AS doc_id FROM documents WHERE source IS NOT NULL GROUP BY 1""")
def distinct_nonblank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.first_of_each(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id").select("source", "doc_id")


@query("""SELECT count(*) FILTER (c_acctbal > 0) AS positive, count(*) FILTER (c_nationkey = 0) AS zero, count(*) FILTER (starts_with(c_mktsegment, 'BUILD')) AS prefix, count(*) FILTER (contains(lower(c_name), '11')) AS inside, count(*) FILTER (contains(lower(c_name), '77') OR contains(lower(c_name), '88')) AS either, 0::BIGINT AS blank FROM customer""")
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c, k, v="": F.count_if(predicates.rule(c, k, v))
    return table(spark, sf_dir, "customer").agg(n("c_acctbal", "gt0").alias("positive"), n("c_nationkey", "eq0").alias("zero"), n("c_mktsegment", "startswith", "build").alias("prefix"), n("c_name", "contains", "11").alias("inside"), n("c_name", "contains_any", ["77", "88"]).alias("either"), n("c_name", "blank").alias("blank"))


@query(f"""WITH {_FD}, t AS (SELECT unnest([TIMESTAMP '2023-12-31 00:00:00', TIMESTAMP '2024-01-11 00:00:00', TIMESTAMP '2024-02-15 00:00:00']) AS target), u AS (SELECT target, family, max(captured_at) AS used FROM t JOIN (SELECT DISTINCT family, captured_at FROM fd) ON captured_at <= target GROUP BY 1, 2)
SELECT key AS entity, strftime(target, '%Y-%m-%d') AS target, count(*)::INT AS n, sum(n_events)::BIGINT AS total FROM u JOIN fd ON fd.family = u.family AND fd.captured_at = u.used GROUP BY 1, 2""")
def asof_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, used = _used(spark, sf_dir)
    used = used.filter(F.date_format("target", "yyyy-MM-dd").isin("2023-12-31", "2024-01-11", "2024-02-15"))
    s = asof.state_asof(h, used, ["n_events"])
    return s.select("entity", F.date_format("target", "yyyy-MM-dd").alias("target"), F.size("properties").alias("n"), F.aggregate("properties", F.lit(0).cast("long"), lambda a, p: a + p.value.cast("long")).alias("total"))


@query(f"""WITH {_UD}, p AS (SELECT seq, key, last_type AS hash FROM h), j AS (SELECT coalesce(a.seq, b.seq + 1) AS seq, a.key AS ak, b.key AS bk, a.hash AS ah, b.hash AS bh FROM p a FULL JOIN p b ON a.key = b.key AND a.seq = b.seq + 1)
SELECT seq::INT AS seq, count(*) FILTER (bk IS NULL) AS added, count(*) FILTER (ak IS NULL) AS removed, count(*) FILTER (ah <> bh) AS changed, count(*) FILTER (ah = bh) AS stable FROM j WHERE seq BETWEEN 2 AND (SELECT max(seq) FROM sn) AND seq % 4 <> 0 GROUP BY 1""")
def policy_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = diff.number_snapshots(user_day(spark, sf_dir).withColumn("family", F.lit("policies")))
    own = h.select("family", "seq", "key", F.col("last_type").alias("hash"))
    partial = h.select("seq").distinct().filter("seq % 4 = 0")
    return diff.movement(own, ["hash"]).join(partial, "seq", "left_anti").drop("family")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'aad:aaaaaaaa-0000-1111-2222-' || lpad(o_custkey::VARCHAR, 12, '0') WHEN o_orderkey % 3 = 0 THEN 'serial:f:s ' || o_custkey ELSE 'empty' END AS device,
CASE WHEN o_orderkey % 5 = 0 THEN 'Never' WHEN date_diff('day', o_orderdate, TIMESTAMP '2001-08-01') <= 30 THEN 'Active' WHEN date_diff('day', o_orderdate, TIMESTAMP '2001-08-01') <= 90 THEN 'Stale31-90d' ELSE 'Stale>90d' END AS activity,
CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'Review' WHEN o_orderstatus = 'O' THEN 'ReadyToUnassign' ELSE 'ReadyToAssign' END AS action FROM orders""")
def derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k, cust = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey").cast("string")
    aad = F.when(k % 2 == 0, F.concat(F.lit(" AAAAAAAA-0000-1111-2222-"), F.lpad(cust, 12, "0"))).otherwise("unknown")
    serial = F.when(k % 3 == 0, F.concat(F.lit("S   "), cust)).otherwise("N/A")
    days = F.when(k % 5 != 0, cells.age_days(F.lit("2001-08-01"), "o_orderdate"))
    return o.select("o_orderkey", links.device_key(aad, F.lit("none"), serial, F.lit("f")).alias("device"), cells.activity_bucket(days).alias("activity"), cells.recommended_action(F.col("o_orderstatus") == "O", k % 2 == 0).alias("action"))


@query(_RECENT + """ SELECT family, period, status FROM r WHERE status <> 'no_data'""")
def changed_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recent(spark, sf_dir).filter("status <> 'no_data'").select("family", "period", "status")


@query("""SELECT c_mktsegment AS family, strftime(DATE '2024-01-01' + (c_custkey % 9)::INT, '%Y-%m-%d') AS day, count(*)::DOUBLE AS value FROM customer GROUP BY 1, 2""")
def snapshot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("family"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 9).cast("int")).alias("captured_at"), F.col("c_name").alias("AppName"), F.col("c_nationkey").cast("string").alias("other"))
    long = metrics.as_series(metrics.dashboard(rows, by=["family", "captured_at"]))
    return long.filter("metric = 'rows'").select("family", F.date_format("captured_at", "yyyy-MM-dd").alias("day"), "value")


_FLAGS = f"""WITH {_UD}, f AS (SELECT h.*, sn.captured_at >= TIMESTAMP '2024-01-12' AS e, day(sn.captured_at) % 5 <> 0 AS l FROM h JOIN sn USING (seq))"""


@query(_FLAGS + """, j AS (SELECT coalesce(a.seq, b.seq + 1) AS seq, a.key AS ak, b.key AS bk, a.n_events <> b.n_events OR (a.e AND b.e AND a.has_error <> b.has_error) OR (a.l AND b.l AND a.last_type <> b.last_type) AS differs FROM f a FULL JOIN f b ON a.key = b.key AND a.seq = b.seq + 1)
SELECT seq::INT AS seq, count(*) FILTER (bk IS NULL) AS added, count(*) FILTER (ak IS NULL) AS removed, count(*) FILTER (differs) AS changed, count(*) FILTER (NOT differs) AS stable FROM j WHERE seq BETWEEN 2 AND (SELECT max(seq) FROM sn) GROUP BY 1""")
def movement_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns come and go between snapshots: only those that both of a pair have are compared."""
    keep = lambda c, when: F.when(when, F.lit(c))
    headers = F.array_compact(F.array(F.lit("Key"), F.lit("N_Events"), keep("has_error", F.col("captured_at") >= F.lit("2024-01-12").cast("timestamp")), keep("Last_Type", F.dayofmonth("captured_at") % 5 != 0)))
    h = user_day(spark, sf_dir).withColumns({"headers": headers, "row_ix": F.lit(0)})
    return families.history_movement(h, "Drifting", ["key", "last_type", "n_events", "has_error"])


@query(f"""WITH {_UD}, t AS (SELECT date_trunc('day', ts) + INTERVAL 1 DAY AS captured_at, user_id::VARCHAR AS key, list_sort(list_distinct(list(event_type))) AS s, count(*) AS n FROM events GROUP BY 1, 2), f AS (SELECT seq, key, s, n % 7 = 0 AS bad FROM t JOIN sn USING (captured_at)),
j AS (SELECT coalesce(a.seq, b.seq + 1) AS seq, a.key AS ak, b.key AS bk, NOT a.bad AND NOT b.bad AND a.s <> b.s AS differs FROM f a FULL JOIN f b ON a.key = b.key AND a.seq = b.seq + 1)
SELECT seq::INT AS seq, count(*) FILTER (bk IS NULL) AS added, count(*) FILTER (ak IS NULL) AS removed, count(*) FILTER (ak = bk AND differs) AS changed, count(*) FILTER (ak = bk AND NOT differs) AS stable FROM j WHERE seq BETWEEN 2 AND (SELECT max(seq) FROM sn) GROUP BY 1""")
def movement_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history under its family's rules: delegates are a set without case, errors are no evidence, counts do not matter, the last row of a key wins."""
    e = events(spark, sf_dir)
    spelled = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    t = e.groupBy("captured_at", F.col("user_id").cast("string").alias("ExternalDirectoryObjectId")).agg(F.array_join(F.collect_list(spelled), "; ").alias("list"), F.count(F.lit(1)).alias("FullAccessDelegatesCount"))
    rows = t.select("captured_at", "ExternalDirectoryObjectId", F.when(F.col("FullAccessDelegatesCount") % 7 == 0, "Error: timeout").otherwise(F.col("list")).alias("FullAccessDelegates"), "FullAccessDelegatesCount", F.lit(1).alias("row_ix"))
    earlier = rows.withColumns({"FullAccessDelegates": F.date_format("captured_at", "dd"), "row_ix": F.lit(0)})
    columns = ["ExternalDirectoryObjectId", "FullAccessDelegates", "FullAccessDelegatesCount"]
    return families.history_movement(rows.unionByName(earlier).withColumn("headers", F.array(*map(F.lit, columns))), "Exchange_SharedMailboxes", columns)


@query(_RECENT.replace("count(*) AS n_events FROM events", "CASE event_type WHEN 'click' THEN array_to_string(list_sort(list_distinct(list(value::INT % 3))), ';') WHEN 'view' THEN (count(*) % 3)::VARCHAR ELSE count(*)::VARCHAR END AS n_events FROM events") + """,
g AS (SELECT family, period, reason = 'ok' AND family = 'signup' AND (day(latest) % 4 = 0 OR day(base) % 4 = 0) AS partial FROM pr)
SELECT family, period, CASE WHEN partial THEN 'partial' ELSE status END AS status, added, removed, changed FROM r JOIN g USING (family, period)""")
def recent_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period changes of several families, each under its own rules; pairs with a partly retrieved snapshot are partial."""
    n = F.count(F.lit(1))
    h = events(spark, sf_dir).groupBy(F.col("event_type").alias("family"), "captured_at", F.col("user_id").cast("string").alias("key")).agg(
        F.array_join(F.shuffle(F.collect_list((F.rint("value").cast("int") % 3).cast("string")), F.lit(7)), ";").alias("SendOnBehalfDelegates"), (n % 3).alias("Model"), n.alias("FreeStorageGB"))
    says = F.when(F.col("family") == "click", families.says("Exchange_SharedMailboxes", ["SendOnBehalfDelegates"])).when(F.col("family") == "view", families.says("Intune_iOS_Devices", ["Model", "FreeStorageGB"])).otherwise(families.says("", ["FreeStorageGB"]))
    snaps = h.select("family", "captured_at").distinct()
    found = periods.period_changes(h, periods.period_pairs(snaps, ref()), says=says, partial=snaps.filter("family = 'signup' and dayofmonth(captured_at) % 4 = 0"))
    return found.select("family", "period", "status", "added", "removed", "changed")
