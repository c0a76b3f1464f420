"""Queries over whole histories: validity intervals, stores that runs change, relationships. They register where the others do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, diff, intervals, links, policy
from ..operators import point_in_time as pit
from ..streaming.search_index import SearchIndex
from ..streaming.store import Store
from . import families
from .queries import _FD, REFERENCE, _families, events, query, ref, table
from .storage import shared_dir


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family, target): three times a day in the whole span of the events, for each family."""
    days = events(spark, sf_dir).select(F.date_trunc("day", "ts").alias("d")).distinct()
    own = days.select(F.explode(F.array(*(F.col("d") + F.make_interval(hours=F.lit(h)) for h in (0, 7, 19)))).alias("target"))
    return _families(spark, sf_dir).select("family").distinct().join(own, F.lit(True)).select("family", "target")


# --- intervals


@query(f"""WITH {_FD}, sn AS (SELECT family, captured_at, row_number() OVER (PARTITION BY family ORDER BY captured_at) AS seq, lead(captured_at) OVER (PARTITION BY family ORDER BY captured_at) AS nxt FROM (SELECT DISTINCT family, captured_at FROM fd)),
r AS (SELECT fd.*, seq, nxt FROM fd JOIN sn USING (family, captured_at)), b AS (SELECT *, CASE WHEN lag(seq) OVER w = seq - 1 AND lag(n_events) OVER w = n_events THEN 0 ELSE 1 END AS begins FROM r WINDOW w AS (PARTITION BY family, key ORDER BY seq)),
i AS (SELECT *, sum(begins) OVER (PARTITION BY family, key ORDER BY seq) AS island FROM b)
SELECT family, key AS entity, any_value(n_events) AS state, strftime(min(captured_at), '%Y-%m-%d') AS valid_from, strftime(arg_max(struct_pack(n := nxt), seq).n, '%Y-%m-%d') AS valid_until, count(*) AS n_snapshots FROM i GROUP BY family, key, island""")
def state_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every family's history of states as validity intervals."""
    found = intervals.state_intervals(_families(spark, sf_dir).withColumnRenamed("key", "entity"), F.col("n_events"))
    return found.select("family", "entity", "state", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("valid_from", "valid_until")), "n_snapshots")


@query(f"""WITH {_FD}, t AS (SELECT DISTINCT date_trunc('day', ts) + h * INTERVAL 1 HOUR AS target FROM events, (VALUES (0), (7), (19)) v(h)), u AS (SELECT target, family, max(captured_at) AS used FROM t JOIN (SELECT DISTINCT family, captured_at FROM fd) ON captured_at <= target GROUP BY 1, 2)
SELECT u.family, strftime(target, '%Y-%m-%d %H') AS target, count(*) AS entities, sum(n_events)::BIGINT AS total, max(key) AS last FROM u JOIN fd ON fd.family = u.family AND fd.captured_at = u.used GROUP BY 1, 2""")
def state_intervals_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities' states at three times a day, from intervals; the SQL reads the snapshot in use."""
    own = intervals.state_intervals(_families(spark, sf_dir).withColumnRenamed("key", "entity"), F.col("n_events"))
    met = intervals.states_at(own, _targets(spark, sf_dir))
    return met.groupBy("family", F.date_format("target", "yyyy-MM-dd HH").alias("target")).agg(F.count(F.lit(1)).alias("entities"), F.sum("state").alias("total"), F.max("entity").alias("last"))


_LINKS = """l AS (SELECT json_extract_string(props, '$.k') AS device, date_trunc('day', ts) + INTERVAL 1 DAY AS t, count(DISTINCT user_id % 3) AS n, min((user_id % 3)::VARCHAR) AS u FROM events GROUP BY 1, 2),
m AS (SELECT device, t, CASE WHEN n > 1 THEN 'conflicting' ELSE 'resolved' END AS status, CASE WHEN n = 1 THEN u END AS user_id FROM l)"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = events(spark, sf_dir).select(F.get_json_object("props", "$.k").alias("device"), "captured_at", F.lit("user_id").alias("signal"), F.lit("resolved").alias("status"), F.array((F.col("user_id") % 3).cast("string")).alias("owners"))
    return links.merge_links(tries)


@query(f"""WITH {_LINKS}, sn AS (SELECT t, row_number() OVER (ORDER BY t) AS seq, lead(t) OVER (ORDER BY t) AS nxt FROM (SELECT DISTINCT t FROM m)), r AS (SELECT m.*, seq, nxt FROM m JOIN sn USING (t)),
b AS (SELECT *, CASE WHEN lag(seq) OVER w = seq - 1 AND lag(status) OVER w = status AND lag(user_id) OVER w IS NOT DISTINCT FROM user_id THEN 0 ELSE 1 END AS begins FROM r WINDOW w AS (PARTITION BY device ORDER BY seq)), i AS (SELECT *, sum(begins) OVER (PARTITION BY device ORDER BY seq) AS island FROM b)
SELECT device, any_value(status) AS status, any_value(user_id) AS user_id, strftime(min(t), '%Y-%m-%d') AS valid_from, strftime(arg_max(struct_pack(n := nxt), seq).n, '%Y-%m-%d') AS valid_until, count(*) AS n_snapshots FROM i GROUP BY device, island""")
def link_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged links of every device over all captures."""
    found = intervals.link_intervals(_links(spark, sf_dir))
    return found.select("device", "status", "user_id", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("valid_from", "valid_until")), "n_snapshots")


@query(f"""WITH {_LINKS}, a AS (SELECT DISTINCT (user_id % 3)::VARCHAR AS user_id, date_trunc('day', ts) + INTERVAL 31 HOUR AS ask FROM events), u AS (SELECT ask, max(t) AS used FROM (SELECT DISTINCT ask FROM a) JOIN (SELECT DISTINCT t FROM m) ON t <= ask GROUP BY 1)
SELECT a.user_id, strftime(a.ask, '%Y-%m-%d') AS day, count(*) AS devices, min(device) AS least FROM a JOIN u USING (ask) JOIN m ON m.t = u.used AND m.user_id = a.user_id WHERE status = 'resolved' GROUP BY 1, 2""")
def devices_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The devices of each user at many times, from link intervals; the SQL reads the capture in use."""
    asks = events(spark, sf_dir).select((F.col("user_id") % 3).cast("string").alias("user_id"), (F.col("captured_at") + F.expr("interval 7 hours")).alias("captured_at")).distinct()
    met = intervals.devices_at(intervals.link_intervals(_links(spark, sf_dir)), asks)
    return met.groupBy("user_id", F.date_format("captured_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("devices"), F.min("device").alias("least"))


@query("""WITH o AS (SELECT json_extract_string(props, '$.k') AS value, date_trunc('day', ts) AS t, count(DISTINCT user_id % 4) AS n, min((user_id % 4)::VARCHAR) AS who FROM events GROUP BY 1, 2),
p AS (SELECT DISTINCT json_extract_string(props, '$.k') AS value, date_trunc('hour', ts) AS asof FROM events), m AS (SELECT p.value, p.asof, max(t) AS t FROM p LEFT JOIN o ON o.value = p.value AND o.t <= p.asof GROUP BY 1, 2)
SELECT CASE WHEN n IS NULL THEN 'unbound' WHEN n = 1 THEN 'bound' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN who END AS bound, count(*) AS n FROM m LEFT JOIN o USING (value, t) GROUP BY 1, 2""")
def alias_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of aliases at every hour with an event, from alias intervals."""
    k = F.get_json_object("props", "$.k")
    seen = events(spark, sf_dir).select(F.lit("k").alias("kind"), k.alias("value"), (F.col("user_id") % 4).cast("string").alias("owner"), F.date_trunc("day", "ts").alias("observed_at"))
    asks = events(spark, sf_dir).select(F.lit("k").alias("kind"), k.alias("value"), F.date_trunc("hour", "ts").alias("asof")).distinct()
    return intervals.bind_asof(intervals.alias_intervals(seen), asks).groupBy("status", "bound").agg(F.count(F.lit(1)).alias("n"))


# --- the store of runs


@query("""WITH f AS (SELECT strftime(ts, '%Y-%m-%d') AS path, day(ts)::INT AS d, event_id FROM events), s AS (SELECT path, event_id,
CASE WHEN d % 6 = 5 THEN NULL WHEN d % 5 = 0 AND d > 10 THEN NULL WHEN d % 3 = 0 AND d % 4 <> 0 THEN 3 WHEN d > 20 THEN 3 WHEN d % 4 = 0 AND d <= 20 AND d > 10 THEN 2 WHEN d > 10 THEN 2 WHEN d % 2 = 0 AND d % 8 <> 0 THEN 2 ELSE 1 END AS v FROM f)
SELECT path, v, count(*) AS n, sum(event_id)::BIGINT AS ids FROM s WHERE v IS NOT NULL GROUP BY 1, 2""")
def store_after_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after three runs over days as files. First run: days to 10. Second: days to 20 come, even ones of before change,
    every eighth of these fails and keeps its rows. Third: the rest comes, but for every fifth day, which never does when over
    10; every third day changes, every fourth of which fails; days 5, 11, 17, ... are deleted. The second run is applied twice."""
    d = F.dayofmonth("ts")
    rows = events(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd").alias("path"), d.alias("d"), F.col("event_id"))
    files = rows.select("path", "d").distinct()
    store = Store(spark, f"{shared_dir(spark)}/{_fresh('store')}", "path string, event_id long, v int")
    never = (F.col("d") > 10) & (F.col("d") % 5 == 0)

    def run(batch: str, v: int, new: Column, changed: Column, deleted: Column, fails: Column) -> None:
        said = files.withColumn("action", F.when(deleted, "deleted").when(new, "new").when(changed, "changed")).filter("action is not null")
        read = said.filter("action <> 'deleted'")
        failed = read.filter(fails & (F.col("action") == "changed")).select("path", F.lit("unreadable").alias("message"))
        store.commit(batch, said.select("path", "action"), rows.join(read.select("path"), "path", "left_semi").select("path", "event_id", F.lit(v).alias("v")), failed)

    no = F.lit(False)
    run("one", 1, F.col("d") <= 10, no, no, no)
    second = ("two", 2, (F.col("d") > 10) & (F.col("d") <= 20) & ~never, (F.col("d") <= 10) & (F.col("d") % 2 == 0), no, F.col("d") % 8 == 0)
    run(*second)
    run(*second)
    run("three", 3, (F.col("d") > 20) & ~never, (F.col("d") % 3 == 0) & ~never & (F.col("d") <= 20), F.col("d") % 6 == 5, F.col("d") % 4 == 0)
    return store.rows().groupBy("path", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def _fresh(name: str) -> str:
    import uuid

    return f"{name}-{uuid.uuid4().hex}"


_NAMED = """c AS (SELECT c_custkey, c_nationkey AS n, c_custkey::VARCHAR AS entity, c_mktsegment || '.' || c_nationkey || '@' || c_custkey || '.example' AS alias, c_name || ' ref' || c_custkey AS display FROM customer),
e AS (SELECT entity, alias, CASE WHEN n % 5 = 1 AND n % 10 <> 6 AND n < 20 THEN 'Now ' || display ELSE display END AS display FROM c WHERE n % 5 <> 0 OR n >= 20)"""


@query(rf"""WITH {_NAMED}, q AS (SELECT c_custkey AS q, lower(CASE (c_custkey // 50) % 9 WHEN 0 THEN entity WHEN 1 THEN alias WHEN 2 THEN display WHEN 3 THEN left(display, 17) WHEN 4 THEN split_part(alias, '@', 1) || '@' || left(entity, 1) WHEN 5 THEN '@' || entity || '.ex' WHEN 6 THEN 'ref' || entity WHEN 7 THEN 'NOW CUSTOMER#0000' || left(entity, 2) ELSE left(entity, 2) END) AS needle FROM c WHERE c_custkey % 50 = 0),
r AS (SELECT q, entity, display, CASE WHEN entity = needle THEN 0 WHEN lower(alias) = needle THEN 1 WHEN lower(display) = needle THEN 2 WHEN starts_with(entity, needle) THEN 3 WHEN starts_with(lower(alias), needle) THEN 4 WHEN starts_with(lower(display), needle) THEN 5
 WHEN len(list_filter(regexp_split_to_array(lower(alias) || ' ' || lower(display), '[@._\-\s]+'), lambda t: t <> '' AND starts_with(t, needle))) > 0 THEN 6 WHEN contains(entity || ' ' || lower(alias) || ' ' || lower(display), needle) THEN 7 END AS rank FROM q, e),
p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank, lower(display), entity) AS place FROM r WHERE rank IS NOT NULL) SELECT q, entity, display, rank::INT AS rank, place::INT AS place FROM p WHERE place <= 50""")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in an index that two runs kept up; a nation's customers are a file. First run: files to 19. Second: the rest comes,
    every fifth of the first goes, every fifth beside it changes, one of which fails and keeps its names. The second is applied twice."""
    entity, n = F.col("c_custkey").cast("string"), F.col("c_nationkey")
    alias = F.concat("c_mktsegment", F.lit("."), n.cast("string"), F.lit("@"), entity, F.lit(".example"))
    c = table(spark, sf_dir, "customer").select("c_custkey", n.alias("n"), n.cast("string").alias("path"), entity.alias("entity"), alias.alias("alias"), F.concat("c_name", F.lit(" ref"), entity).alias("display"))
    files, index = c.select("path", "n").distinct(), SearchIndex(spark, f"{shared_dir(spark)}/{_fresh('search')}")
    n = F.col("n")
    index.update("one", files.filter(n < 20).select("path", F.lit("new").alias("action")), c.filter(n < 20), files.limit(0).select("path", F.lit("").alias("message")))
    action = F.when(n >= 20, "new").when(n % 5 == 0, "deleted").when(n % 5 == 1, "changed")
    said, failed = files.select("path", action.alias("action")).filter("action is not null"), files.filter((n < 20) & (n % 10 == 6)).select("path", F.lit("unreadable").alias("message"))
    now = c.filter((n >= 20) | (n % 5 == 1)).withColumn("display", F.when(n < 20, F.concat(F.lit("Now "), "display")).otherwise(F.col("display")))
    for _ in range(2):
        index.update("two", said, now, failed)
    kind = F.floor(F.col("c_custkey") / 50) % 9
    head = lambda size: F.substring("entity", 1, size)
    needles = [F.col("entity"), F.col("alias"), F.col("display"), F.substring("display", 1, 17), F.concat(F.split_part("alias", F.lit("@"), F.lit(1)), F.lit("@"), head(1)), F.concat(F.lit("@"), "entity", F.lit(".ex")), F.concat(F.lit("ref"), "entity"), F.concat(F.lit("NOW CUSTOMER#0000"), head(2)), head(2)]
    asks = c.filter("c_custkey % 50 = 0").select(F.col("c_custkey").alias("q"), F.element_at(F.array(*needles), (kind + 1).cast("int")).alias("needle"))
    return index.search(asks, "q", "needle").select("q", "entity", "display", "rank", "place")


# --- recent changes under rules


@query(f"""WITH w AS (SELECT date_trunc('day', ts) + INTERVAL 1 DAY AS t, * FROM events), n AS (SELECT t, user_id AS u, event_type AS r, count(*) > 1 AS active FROM w GROUP BY 1, 2, 3), m AS (SELECT t, user_id AS u, count(*) % 3 AS v FROM w GROUP BY 1, 2),
p AS (SELECT * FROM (VALUES ('24 hours', 24), ('48 hours', 48), ('3 days', 72), ('7 days', 168), ('15 days', 360), ('30 days', 720)) x(period, hours)), sn AS (SELECT DISTINCT t FROM w),
pp AS (SELECT period, max(t) AS latest, max(t) FILTER (t <= TIMESTAMP '{REFERENCE}' - hours * INTERVAL 1 HOUR) AS base, count(*) AS n, any_value(TIMESTAMP '{REFERENCE}' - hours * INTERVAL 1 HOUR) AS cut FROM sn, p GROUP BY 1),
pr AS (SELECT *, CASE WHEN n < 2 THEN 'single' WHEN latest <= cut THEN 'stale' WHEN base IS NULL THEN 'no_baseline' ELSE 'ok' END AS reason, base >= TIMESTAMP '2024-01-22' AND latest >= TIMESTAMP '2024-01-22' AS stable FROM pp),
rk AS (SELECT 'Entra_Role_Assignments' AS family, period, u || r || CASE WHEN stable THEN '' ELSE active::VARCHAR END AS k, active::INT AS v, t = latest AS a FROM n JOIN pr ON reason = 'ok' AND t IN (latest, base)
UNION ALL SELECT 'Exchange_SharedMailboxes', period, u::VARCHAR, v, t = latest FROM m JOIN pr ON reason = 'ok' AND t IN (latest, base)),
k AS (SELECT family, period, k, max(v) FILTER (a) AS a, max(v) FILTER (NOT a) AS b FROM rk GROUP BY 1, 2, 3), c AS (SELECT family, period, count(*) FILTER (b IS NULL) AS added, count(*) FILTER (a IS NULL) AS removed, count(*) FILTER (a <> b) AS changed FROM k GROUP BY 1, 2),
o AS (SELECT f.family, pr.*, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(changed, 0) AS changed, f.family = 'Exchange_SharedMailboxes' AND (day(latest) % 4 = 0 OR day(base) % 4 = 0) AS part FROM pr CROSS JOIN (VALUES ('Entra_Role_Assignments'), ('Exchange_SharedMailboxes')) f(family) LEFT JOIN c ON c.family = f.family AND c.period = pr.period),
z AS (SELECT *, CASE WHEN reason <> 'ok' THEN 'no_data' WHEN part THEN 'partial' WHEN added + removed + changed > 0 THEN 'changed' ELSE 'unchanged' END AS status FROM o)
SELECT family, period, status, reason, added, removed, changed, row_number() OVER (PARTITION BY period ORDER BY CASE status WHEN 'changed' THEN 0 WHEN 'partial' THEN 1 WHEN 'unchanged' THEN 2 ELSE 3 END, family)::INT AS place FROM z""")
def recent_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles, whose snapshots have their stable key from the 22nd on, and mailboxes, some of whose snapshots are partial."""
    e, user = events(spark, sf_dir), F.col("user_id").cast("string")
    since = F.col("captured_at") >= F.lit("2024-01-22").cast("timestamp")
    roles = e.groupBy("captured_at", user.alias("UserId"), F.col("event_type").alias("RoleName")).agg(F.when(F.count(F.lit(1)) > 1, "Active").otherwise("Eligible").alias("RoleState"))
    old = ["UserId", "UserPrincipalName", "RoleName", "RoleState", "AssignmentSource", "SourceGroup", "DisplayName"]
    names = {"UserPrincipalName": F.concat(F.lit("u"), "UserId"), "AssignmentSource": F.lit("Direct"), "SourceGroup": F.lit(""), "DisplayName": F.date_format("captured_at", "dd"), "AssignmentScheduleId": F.when(since, F.concat(F.lit("a"), "RoleName")), "row_ix": F.lit(0)}
    roles = roles.withColumns(names).withColumn("headers", F.when(since, F.array(*map(F.lit, [*old, "AssignmentScheduleId"]))).otherwise(F.array(*map(F.lit, old))))
    boxes = e.groupBy("captured_at", user.alias("ExternalDirectoryObjectId")).agg((F.count(F.lit(1)) % 3).cast("string").alias("SendOnBehalfDelegates"), F.count(F.lit(1)).cast("string").alias("SendOnBehalfDelegatesCount"))
    boxes = boxes.withColumns({"headers": F.array(*(F.lit(c) for c in boxes.columns[1:])), "row_ix": F.lit(0)})
    partial = boxes.filter("dayofmonth(captured_at) % 4 = 0").select(F.lit("Exchange_SharedMailboxes").alias("family"), "captured_at")
    return families.recent_report({"Entra_Role_Assignments": roles, "Exchange_SharedMailboxes": boxes}, ref(), partial)


# --- relationships


@query("""WITH r AS (SELECT user_id AS entity, event_type AS scope, 'kind=' || (hour(ts) % 3) || '|zone=' || (user_id % 2) AS text, day(ts) <= 15 AS b FROM events),
t AS (SELECT entity, scope, text, count(*) FILTER (b) AS nb, count(*) FILTER (NOT b) AS na FROM r GROUP BY ALL)
SELECT entity, scope, CASE WHEN sum(nb) = 0 THEN 'added' WHEN sum(na) = 0 THEN 'removed' ELSE 'modified' END AS change, sum(greatest(nb - na, 0))::BIGINT AS fewer, sum(greatest(na - nb, 0))::BIGINT AS more FROM t GROUP BY 1, 2 HAVING bool_or(nb <> na)""")
def relationship_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships of users before and after mid-month as bags; on one side the properties stand in another order."""
    e = events(spark, sf_dir)
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    kind, zone = pair("kind", F.hour("ts") % 3), pair("zone", F.col("user_id") % 2)
    side = lambda rows, *p: rows.select(F.col("user_id").alias("entity"), F.lit("roles").alias("family"), F.col("event_type").alias("scope"), F.array(*p).alias("properties"))
    found = diff.relationship_diff(side(e.filter(F.dayofmonth("ts") <= 15), kind, zone), side(e.filter(F.dayofmonth("ts") > 15), zone, kind))
    n = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x.n)
    return found.select("entity", "scope", "change", n("before").alias("fewer"), n("after").alias("more"))


# --- policies at several grains


@query("""WITH s AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (l_linenumber = 1) AS a FROM lineitem GROUP BY 1), p AS (SELECT year(o_orderdate)::INT AS year, o_orderpriority AS source, o_orderstatus AS type, o_orderkey % 3 <> 0 AS ok, coalesce(n, 0) AS n, coalesce(a, 0) AS a FROM orders LEFT JOIN s ON k = o_orderkey)
SELECT year, CASE WHEN grouping(source) = 1 AND grouping(type) = 1 THEN 'total' WHEN grouping(type) = 1 THEN 'source' WHEN grouping(source) = 1 THEN 'type' ELSE 'source_type' END AS level, source, type, count(*) AS policies, count(*) FILTER (ok) AS eligible, sum(n)::BIGINT AS settings, sum(a)::BIGINT AS assignments, round(count(*) FILTER (ok) / count(*), 6) AS eligible_share
FROM p GROUP BY GROUPING SETS ((year), (year, source), (year, type), (year, source, type))""")
def policy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    year, k = F.year("o_orderdate").alias("year"), F.col("o_orderkey")
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    p = o.select(year, k.alias("policy_key"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("type"), F.when(k % 3 != 0, "h").otherwise("").alias("hash"))
    rows = li.join(o.select(k.alias("l_orderkey"), year), "l_orderkey").select("year", F.col("l_orderkey").alias("policy_key"), "l_linenumber")
    return policy.metrics_by_grain(p, rows, rows.filter("l_linenumber = 1"), ["year"])


@query("""SELECT o_orderkey::VARCHAR AS policy_key, CASE WHEN o_orderkey % 4 = 0 THEN 'Unnamed policy' ELSE o_orderstatus || o_orderpriority END AS name, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS platform, o_orderpriority AS policy_type,
CASE o_orderkey % 3 WHEN 0 THEN 'Modern' WHEN 1 THEN 'Classic' ELSE o_orderpriority END AS source FROM orders""")
def compact_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    source = F.when(k % 3 == 0, "configurationPolicies").when(k % 3 == 1, "deviceConfigurations").otherwise(F.col("o_orderpriority"))
    name, platform = F.when(k % 4 != 0, F.concat("o_orderstatus", "o_orderpriority")).otherwise(F.when(k % 8 == 0, "")), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return policy.compact_inventory(table(spark, sf_dir, "orders").select(k.cast("string").alias("policy_key"), name.alias("name"), platform.alias("platform"), F.col("o_orderpriority").alias("policy_type"), source.alias("source")))


@query("""WITH s AS (SELECT l_returnflag AS bundle, l_linestatus AS kind, 'd' || l_suppkey % 50 AS d, l_linenumber AS depth, l_suppkey % 50 < 40 AS known FROM lineitem)
SELECT bundle, CASE WHEN grouping(kind) = 1 THEN 'total' ELSE 'kind' END AS level, kind, count(*) AS nodes, max(depth)::INT AS max_depth, count(DISTINCT d) AS definitions, count(DISTINCT d) FILTER (NOT known) AS missing_definitions, round(100.0 * count(*) FILTER (known) / count(*), 1) AS definition_coverage FROM s GROUP BY GROUPING SETS ((bundle), (bundle, kind))""")
def bundle_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_suppkey") % 50
    name = F.concat(F.lit("d"), n.cast("string"))
    s = table(spark, sf_dir, "lineitem")
    rows = s.select(F.col("l_returnflag").alias("bundle"), F.col("l_linestatus").alias("kind"), name.alias("definition_id"), F.col("l_linenumber").cast("int").alias("depth"))
    return policy.inspection_by_grain(rows, s.filter(n < 40).select(name.alias("definition_id")), ["bundle"])


@query("""WITH l AS (SELECT l_orderkey AS k, bool_or(l_linenumber = 6) AS six, bool_or(l_linenumber = 2) AS two FROM lineitem GROUP BY 1)
SELECT k AS policy_key, CASE WHEN two AND k % 3 = 0 THEN 'changed' ELSE 'unexplained_policy_semantic_change' END AS event FROM l WHERE six OR (two AND k % 3 = 0)""")
def unexplained_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies whose hash changes: by a trusted component in every third, and by one that can't be compared where they have a sixth."""
    li, k, n = table(spark, sf_dir, "lineitem"), F.col("l_orderkey"), F.col("l_linenumber")
    bump = F.when((n == 6) | ((n == 2) & (k % 3 == 0)), 1).otherwise(0)
    side = lambda by: li.select(k.alias("policy_key"), F.when(n == 6, "assignment").otherwise("setting").alias("component_type"), n.cast("string").alias("component_key"), (n * 10 + by).cast("string").alias("value"), n.alias("position"), (n != 6).alias("trusted"))
    before, after = side(F.lit(0)), side(bump)
    hashed = lambda df: df.groupBy("policy_key").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("value")), ","), 256).alias("hash")).withColumn("source", F.lit("s"))
    ok = spark.range(1).select(F.lit("s").alias("source"), F.lit("success").alias("status"))
    hb, ha = hashed(before), hashed(after)
    modified = policy.policy_diff(hb, ha, ok, ok).filter("state = 'modified'")
    return policy.explained(policy.component_events(before, after, modified), modified, hb, ha).select("policy_key", "event")
