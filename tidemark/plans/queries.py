"""Queries of the library's operators over the given tables, and the SQL that states their results.

Events stand in for daily snapshots: one row for each user and day, captured at the day's end, whose columns are the last
event type, the number of events and whether an error was among them. Event types stand in for report families.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cells, predicates
from ..operators import asof, diff, identity, links, metrics, periods, policy, resolve
from ..streaming import incremental
from . import cards

REFERENCE = "2024-01-29 12:00:00"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; times as instants, whatever zone flag the file has."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def ref() -> Column:
    return F.lit(REFERENCE).cast("timestamp")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("captured_at", (F.date_trunc("day", "ts") + F.expr("interval 1 day")))


def user_day(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """One row for each key and day; by: further grouping columns before the user."""
    e = events(spark, sf_dir)
    return e.groupBy(*by, "captured_at", F.col("user_id").cast("string").alias("key")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count(F.lit(1)).alias("n_events"), F.max(F.col("event_type") == "error").cast("string").alias("has_error"))


COLUMNS = ["last_type", "n_events", "has_error"]
_UD = """
ud AS (SELECT date_trunc('day', ts) + INTERVAL 1 DAY AS captured_at, user_id::VARCHAR AS key, arg_max(event_type, (ts, event_id)) AS last_type,
         count(*) AS n_events, max((event_type = 'error')::INT) AS has_error FROM events GROUP BY 1, 2),
sn AS (SELECT captured_at, row_number() OVER (ORDER BY captured_at) AS seq FROM (SELECT DISTINCT captured_at FROM ud)),
h AS (SELECT seq, key, last_type, n_events, has_error FROM ud JOIN sn USING (captured_at))"""
_FD = """
fd AS (SELECT event_type AS family, date_trunc('day', ts) + INTERVAL 1 DAY AS captured_at, user_id::VARCHAR AS key, count(*) AS n_events FROM events GROUP BY 1, 2, 3)"""


@query(f"""WITH {_UD}, b AS (SELECT * FROM h), a AS (SELECT * FROM h),
j AS (SELECT coalesce(a.seq, b.seq + 1) AS seq, a.key AS ak, b.key AS bk,
        (a.last_type, a.n_events, a.has_error) IS DISTINCT FROM (b.last_type, b.n_events, b.has_error) AS differs
      FROM a FULL JOIN b ON a.key = b.key AND a.seq = b.seq + 1)
SELECT seq::INT AS seq, count(*) FILTER (bk IS NULL) AS added, count(*) FILTER (ak IS NULL) AS removed,
       count(*) FILTER (ak IS NOT NULL AND bk IS NOT NULL AND differs) AS changed, count(*) FILTER (ak IS NOT NULL AND bk IS NOT NULL AND NOT differs) AS stable
FROM j WHERE seq BETWEEN 2 AND (SELECT max(seq) FROM sn) GROUP BY 1""")
def movement_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = diff.number_snapshots(user_day(spark, sf_dir).withColumn("family", F.lit("users")))
    return diff.movement(h, COLUMNS).drop("family")


def _two_days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = user_day(spark, sf_dir).withColumn("row_ix", F.lit(0))
    day = lambda d: own.filter(F.col("captured_at") == F.lit(d).cast("timestamp")).drop("captured_at")
    return day("2024-01-11"), day("2024-01-21")


_PAIR = f"""WITH {_UD}, b AS (SELECT * FROM ud WHERE captured_at = TIMESTAMP '2024-01-11'), a AS (SELECT * FROM ud WHERE captured_at = TIMESTAMP '2024-01-21'),
j AS (SELECT coalesce(a.key, b.key) AS key, a.key AS ak, b.key AS bk, b.last_type AS b1, a.last_type AS a1, b.n_events::VARCHAR AS b2, a.n_events::VARCHAR AS a2,
        CASE b.has_error WHEN 1 THEN 'true' ELSE 'false' END AS b3, CASE a.has_error WHEN 1 THEN 'true' ELSE 'false' END AS a3 FROM a FULL JOIN b ON a.key = b.key),
d AS (SELECT 'Added' AS change, key, NULL::VARCHAR AS property, NULL::VARCHAR AS before, NULL::VARCHAR AS after FROM j WHERE bk IS NULL
      UNION ALL SELECT 'Removed', key, NULL, NULL, NULL FROM j WHERE ak IS NULL
      UNION ALL SELECT 'Changed', key, 'last_type', b1, a1 FROM j WHERE ak = bk AND b1 <> a1
      UNION ALL SELECT 'Changed', key, 'n_events', b2, a2 FROM j WHERE ak = bk AND b2 <> a2
      UNION ALL SELECT 'Changed', key, 'has_error', b3, a3 FROM j WHERE ak = bk AND b3 <> a3)"""


@query(_PAIR + " SELECT change, key, property, before, after FROM d")
def diff_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _two_days(spark, sf_dir)
    return diff.details(diff.pair_diff(before, after, F.col("key"), "row_ix", exclude=["key"]))


@query(_PAIR + """ SELECT count(*) FILTER (bk IS NULL) AS added, count(*) FILTER (ak IS NULL) AS removed, count(*) FILTER (ak = bk AND (b1, b2, b3) <> (a1, a2, a3)) AS changed,
count(*) FILTER (ak = bk AND (b1, b2, b3) = (a1, a2, a3)) AS stable, count(*) FILTER (bk IS NULL OR ak IS NULL OR (b1, b2, b3) <> (a1, a2, a3)) AS total FROM j""")
def diff_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _two_days(spark, sf_dir)
    return diff.counts(diff.pair_diff(before, after, F.col("key"), "row_ix", exclude=["key"]))


@query("""WITH g AS (SELECT date_trunc('day', ts) AS d, user_id::VARCHAR || chr(31) || event_type AS key, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1, 2),
j AS (SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'Added' WHEN a.key IS NULL THEN 'Removed' WHEN a.n <> b.n THEN 'Changed' ELSE 'Stable' END AS change
 FROM (SELECT * FROM g WHERE d = DATE '2024-01-20') a FULL JOIN (SELECT * FROM g WHERE d = DATE '2024-01-10') b ON a.key = b.key) SELECT key, change FROM j""")
def diff_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("kind", F.when(F.col("event_type") != "error", F.col("event_type")))  # a blank part drops the row on both sides
    g = e.groupBy(F.to_date("ts").alias("d"), F.col("user_id").cast("string").alias("user_id"), "kind").agg(F.count(F.lit(1)).alias("n")).withColumn("row_ix", F.lit(0))
    day = lambda d: g.filter(F.col("d") == F.lit(d).cast("date")).drop("d")
    return diff.pair_diff(day("2024-01-10"), day("2024-01-20"), cells.key_all("user_id", "kind"), "row_ix").select("key", "change")


@query("""WITH t AS (SELECT user_id, date_trunc('day', ts) AS d, list_sort(list_distinct(list(event_type))) AS s FROM events GROUP BY 1, 2)
SELECT a.user_id, array_to_string(list_filter(a.s, lambda x: NOT list_contains(b.s, x)), ';') AS added, array_to_string(list_filter(b.s, lambda x: NOT list_contains(a.s, x)), ';') AS removed, a.s = b.s AS same
FROM t a JOIN t b ON a.user_id = b.user_id AND a.d = DATE '2024-01-20' AND b.d = DATE '2024-01-10'""")
def token_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("d")).agg(F.array_join(F.collect_list("event_type"), " ; ").alias("s"))
    day = lambda d, n: t.filter(F.col("d") == F.lit(d).cast("date")).select("user_id", F.col("s").alias(n))
    delta = diff.token_delta("b", "a")
    return day("2024-01-10", "b").join(day("2024-01-20", "a"), "user_id").select("user_id", F.array_join(delta.added, ";").alias("added"), F.array_join(delta.removed, ";").alias("removed"), cells.same_tokens("a", "b").alias("same"))


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("family"), "captured_at", F.col("user_id").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n_events"))


_RECENT = f"""WITH {_FD}, p AS (SELECT * FROM (VALUES ('24 hours', 24), ('48 hours', 48), ('3 days', 72), ('7 days', 168), ('15 days', 360), ('30 days', 720)) v(period, hours)),
sn AS (SELECT DISTINCT family, captured_at FROM fd),
pp AS (SELECT family, period, max(captured_at) AS latest, max(captured_at) FILTER (captured_at <= TIMESTAMP '{REFERENCE}' - hours * INTERVAL 1 HOUR) AS base, count(*) AS n,
         any_value(TIMESTAMP '{REFERENCE}' - hours * INTERVAL 1 HOUR) AS cut FROM sn, p GROUP BY 1, 2),
pr AS (SELECT *, CASE WHEN n < 2 THEN 'single' WHEN latest <= cut THEN 'stale' WHEN base IS NULL THEN 'no_baseline' ELSE 'ok' END AS reason FROM pp),
k AS (SELECT family, period, key, max(n_events) FILTER (captured_at = latest) AS a, max(n_events) FILTER (captured_at = base) AS b
      FROM fd JOIN pr USING (family) WHERE reason = 'ok' AND captured_at IN (latest, base) GROUP BY 1, 2, 3),
c AS (SELECT family, period, count(*) FILTER (b IS NULL) AS added, count(*) FILTER (a IS NULL) AS removed, count(*) FILTER (a <> b) AS changed FROM k GROUP BY 1, 2),
r AS (SELECT family, period, reason, coalesce(added, 0)::BIGINT AS added, coalesce(removed, 0)::BIGINT AS removed, coalesce(changed, 0)::BIGINT AS changed,
        CASE WHEN reason <> 'ok' THEN 'no_data' WHEN coalesce(added + removed + changed, 0) > 0 THEN 'changed' ELSE 'unchanged' END AS status FROM pr LEFT JOIN c USING (family, period))"""


def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _families(spark, sf_dir)
    return periods.period_changes(h, periods.period_pairs(h.select("family", "captured_at"), ref()), ["n_events"])


@query(_RECENT + """ SELECT family, period, status, reason, added, removed, changed,
row_number() OVER (PARTITION BY period ORDER BY CASE status WHEN 'changed' THEN 0 WHEN 'partial' THEN 1 WHEN 'unchanged' THEN 2 ELSE 3 END, family)::INT AS place FROM r""")
def recent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.report_order(_recent(spark, sf_dir))


@query(_RECENT + """ SELECT period, count(*) FILTER (status = 'changed') AS families_changed, count(*) FILTER (status = 'unchanged') AS families_unchanged, count(*) FILTER (status = 'no_data') AS families_no_data,
sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed, sum(changed)::BIGINT AS changed FROM r GROUP BY 1""")
def recent_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.rollup(_recent(spark, sf_dir))


@query(f"""WITH s AS (SELECT event_type AS family, max(ts) AS t, ts::DATE AS day FROM events WHERE NOT (event_type = 'view' AND ts::DATE = DATE '2024-01-24') GROUP BY 1, 3),
d AS (SELECT d::DATE AS day FROM generate_series(DATE '2024-01-01', DATE '{REFERENCE[:10]}', INTERVAL 1 DAY) g(d) WHERE isodow(d) < 6 ORDER BY 1 DESC LIMIT 10),
w AS (SELECT family, day FROM (SELECT DISTINCT family FROM s), d),
g AS (SELECT family, count(*) AS expected, count(t) AS observed, count(*) FILTER (t IS NULL) AS missing, count(*) FILTER (epoch(t) - epoch(day::TIMESTAMP) > 25200) AS late FROM w LEFT JOIN s USING (family, day) GROUP BY 1)
SELECT family, expected, observed, missing, late, 0::BIGINT AS attention, round(observed / expected, 6) AS coverage,
CASE WHEN missing = 0 AND late = 0 THEN 'Healthy' WHEN missing = 0 THEN 'Completed late' WHEN observed / expected >= 0.8 THEN 'Attention' ELSE 'Missing runs' END AS status FROM g""")
def run_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).filter(~((F.col("event_type") == "view") & (F.to_date("ts") == F.lit("2024-01-24").cast("date")))).select(F.col("event_type").alias("family"), F.col("ts").alias("captured_at"))
    return periods.run_health(periods.latest_of_day(s).select("family", "captured_at"), ref(), 10).withColumn("coverage", F.round("coverage", 6)).drop("place")


@query(f"""WITH {_UD} SELECT strftime(captured_at, '%Y-%m-%d') AS day, count(*) AS users, sum(n_events)::BIGINT AS events, sum(has_error)::BIGINT AS users_with_error FROM ud GROUP BY 1""")
def metric_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day(spark, sf_dir).groupBy(F.date_format("captured_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("users"), F.sum("n_events").alias("events"), F.count_if(F.col("has_error") == "true").alias("users_with_error"))


def _daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    wide = o.groupBy(F.col("o_orderstatus").alias("family"), F.col("o_orderdate").alias("captured_at")).agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("customers"))
    return metrics.as_series(wide)


_DAILY = """WITH w AS (SELECT o_orderstatus AS family, o_orderdate AS t, count(*)::DOUBLE AS orders, count(DISTINCT o_custkey)::DOUBLE AS customers FROM orders GROUP BY 1, 2),
s AS (SELECT family, t, 'orders' AS metric, orders AS value FROM w UNION ALL SELECT family, t, 'customers', customers FROM w)"""


@query(_DAILY + """ SELECT family, metric, strftime(max(t), '%Y-%m-%d') AS day, arg_max(value, t) AS value, any_value(n) AS source_points
FROM (SELECT *, count(*) OVER (PARTITION BY family, metric) AS n FROM s) GROUP BY family, metric, isoyear(t), weekofyear(t)""")
def metric_series_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.series(_daily_orders(spark, sf_dir), "weekly").select("family", "metric", F.date_format("captured_at", "yyyy-MM-dd").alias("day"), "value", "source_points")


@query(_DAILY + """, n AS (SELECT *, count(*) OVER (PARTITION BY family, metric) AS n, date_diff('day', min(t) OVER (PARTITION BY family, metric), max(t) OVER (PARTITION BY family, metric)) AS span FROM s),
l AS (SELECT *, CASE WHEN n <= 140 THEN 'daily' WHEN span <= 730 THEN 'weekly' ELSE 'monthly' END AS level FROM n),
b AS (SELECT *, CASE level WHEN 'daily' THEN t::VARCHAR WHEN 'weekly' THEN isoyear(t) || '-' || weekofyear(t) ELSE strftime(t, '%Y-%m') END AS bucket FROM l)
SELECT family, metric, level, strftime(max(t), '%Y-%m-%d') AS day, arg_max(value, t) AS value, any_value(n) AS source_points FROM b GROUP BY family, metric, level, bucket""")
def metric_series_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.series(_daily_orders(spark, sf_dir)).select("family", "metric", "level", F.date_format("captured_at", "yyyy-MM-dd").alias("day"), "value", "source_points")


@query(_DAILY + """ SELECT family, metric, strftime(t, '%Y-%m-%d') AS day, value FROM (SELECT *, max(t) OVER (PARTITION BY family, metric) AS newest FROM s) WHERE t >= newest - INTERVAL 30 DAY""")
def metric_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.trailing(_daily_orders(spark, sf_dir), 30, ("family", "metric")).select("family", "metric", F.date_format("captured_at", "yyyy-MM-dd").alias("day"), "value")


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "Active").when(F.col("o_orderstatus") == "F", "eligible").otherwise("")
    return o.select(F.year("o_orderdate").alias("year"), F.col("o_custkey").cast("string").alias("UserPrincipalName"), F.col("o_orderpriority").alias("RoleName"), state.alias("RoleState"), F.when(F.col("o_totalprice") > 200000, "Group").otherwise(" direct ").alias("AssignmentSource"), F.when(F.col("o_totalprice") > 200000, F.col("o_orderpriority")).alias("SourceGroup"), (F.col("o_orderkey") % 2 == 0).cast("string").alias("AccountEnabled"))


@query("""SELECT year(o_orderdate)::INT AS year, count(*) AS "Role Rows", count(DISTINCT o_custkey) AS "Distinct Users", count(DISTINCT o_orderpriority) AS "Distinct Roles", count(DISTINCT CASE WHEN o_totalprice > 200000 THEN o_orderpriority END) AS "Source Groups",
count(*) FILTER (o_orderstatus = 'O') AS "Active", count(*) FILTER (o_orderstatus = 'F') AS "Eligible", count(*) FILTER (o_totalprice <= 200000) AS "Direct", count(*) FILTER (o_totalprice > 200000) AS "Group",
count(*) FILTER (o_totalprice <= 200000 AND o_orderstatus = 'O') AS "Direct Active", count(*) FILTER (o_totalprice <= 200000 AND o_orderstatus = 'F') AS "Direct Eligible",
count(*) FILTER (o_totalprice > 200000 AND o_orderstatus = 'O') AS "Group Active", count(*) FILTER (o_totalprice > 200000 AND o_orderstatus = 'F') AS "Group Eligible",
count(*) FILTER (o_orderkey % 2 = 0) AS "Enabled rows", count(*) FILTER (o_orderkey % 2 <> 0) AS "Disabled rows" FROM orders GROUP BY 1""")
def dashboard_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _roles(spark, sf_dir)
    return metrics.dashboard(rows, cards.detect(rows.columns), by=["year"])


@query("""WITH c AS (SELECT c_mktsegment, CASE WHEN c_acctbal < 0 THEN ' ' ELSE c_name END AS n, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_nationkey END AS k FROM customer),
b AS (SELECT c_mktsegment, (trim(n) = '')::INT + (k IS NULL)::INT AS b FROM c)
SELECT c_mktsegment, count(*) AS rows, 2::INT AS columns, count(*) FILTER (b = 0) AS complete_rows, count(*) FILTER (b > 0) AS rows_with_blanks, sum(b)::BIGINT AS blank_cells, round(100.0 * (count(*) * 2 - sum(b)) / (count(*) * 2), 1) AS completeness FROM b GROUP BY 1""")
def quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_mktsegment", F.when(F.col("c_acctbal") < 0, " ").otherwise(F.col("c_name")).alias("n"), F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey")).alias("k"))
    return metrics.profile(c, ["c_mktsegment"]).withColumn("completeness", F.col("completeness").cast("double"))


@query("""SELECT coalesce(nullif(trim(CASE WHEN p_size = 1 THEN '' ELSE p_brand END), ''), 'Unknown') AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY lower(value), value LIMIT 6""")
def manufacturer_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.first_groups(table(spark, sf_dir, "part").withColumn("m", F.when(F.col("p_size") != 1, F.col("p_brand"))), "m")


_TARGETS = ("2023-12-31 00:00:00", "2024-01-05 09:00:00", "2024-01-11 00:00:00", "2024-01-19 23:59:59", "2024-02-15 00:00:00")
_ASOF = f"""WITH {_FD}, t AS (SELECT unnest([{", ".join(f"TIMESTAMP '{x}'" for x in _TARGETS)}]) AS target), sn AS (SELECT DISTINCT family, captured_at FROM fd),
u AS (SELECT target, family, max(captured_at) FILTER (captured_at <= target) AS used FROM t, sn GROUP BY 1, 2),
e AS (SELECT DISTINCT family, key FROM fd)"""


def _used(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    h = _families(spark, sf_dir).withColumnRenamed("key", "entity")
    snaps = h.select("family", "captured_at").distinct()
    return h, asof.snapshot_asof(snaps, asof.for_every_family(snaps, _TARGETS))


@query(_ASOF + """ SELECT strftime(target, '%Y-%m-%d %H:%M:%S') AS target, family, strftime(used, '%Y-%m-%d') AS used, date_diff('second', used, target) AS gap_seconds FROM u""")
def snapshot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, used = _used(spark, sf_dir)
    return used.select(F.date_format("target", "yyyy-MM-dd HH:mm:ss").alias("target"), "family", F.date_format("used", "yyyy-MM-dd").alias("used"), "gap_seconds")


@query(_ASOF + """ SELECT e.key AS entity, strftime(target, '%Y-%m-%d %H:%M:%S') AS target, e.family, CASE WHEN used IS NULL THEN 'no_snapshot' WHEN fd.key IS NULL THEN 'entity_absent' ELSE 'snapshot_used' END AS status
FROM e JOIN u USING (family) LEFT JOIN fd ON fd.family = e.family AND fd.captured_at = used AND fd.key = e.key""")
def asof_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, used = _used(spark, sf_dir)
    return asof.entity_status(h, used, h.select("entity", "family").distinct()).select("entity", F.date_format("target", "yyyy-MM-dd HH:mm:ss").alias("target"), "family", "status")


@query(_ASOF + """, s AS (SELECT e.key AS entity, target, e.family, CASE WHEN used IS NULL THEN 'no_snapshot' WHEN fd.key IS NULL THEN 'entity_absent' ELSE 'snapshot_used' END AS status
FROM e JOIN u USING (family) LEFT JOIN fd ON fd.family = e.family AND fd.captured_at = used AND fd.key = e.key)
SELECT entity, strftime(target, '%Y-%m-%d %H:%M:%S') AS target, CASE WHEN bool_or(status = 'snapshot_used') THEN 'present' WHEN bool_and(status = 'no_snapshot') THEN 'unknown' WHEN bool_or(status = 'entity_absent' AND family = 'signup') THEN 'absent' ELSE 'partial' END AS presence
FROM s GROUP BY entity, s.target""")
def presence_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, used = _used(spark, sf_dir)
    status = asof.entity_status(h, used, h.select("entity", "family").distinct())
    return asof.presence(status, ["signup"]).withColumn("target", F.date_format("target", "yyyy-MM-dd HH:mm:ss"))


def _alias_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(F.lit("k").alias("kind"), F.get_json_object("props", "$.k").alias("value"), F.col("user_id").cast("string").alias("owner"), F.date_trunc("day", "ts").alias("observed_at"))


_ALIAS = """WITH o AS (SELECT json_extract_string(props, '$.k') AS value, date_trunc('day', ts) AS t, list_sort(list_distinct(list(user_id::VARCHAR))) AS owners FROM events GROUP BY 1, 2),
p AS (SELECT DISTINCT json_extract_string(props, '$.k') AS value, date_trunc('day', ts) - INTERVAL 1 DAY + INTERVAL 6 HOUR AS asof FROM events),
m AS (SELECT p.value, p.asof, max(o.t) AS t FROM p LEFT JOIN o ON o.value = p.value AND o.t <= p.asof GROUP BY 1, 2)"""


@query(_ALIAS + """ SELECT m.value, strftime(m.asof, '%Y-%m-%d %H') AS asof, CASE WHEN owners IS NULL THEN 'unbound' WHEN len(owners) = 1 THEN 'bound' ELSE 'ambiguous' END AS status, CASE WHEN len(owners) = 1 THEN owners[1] END AS bound, coalesce(len(owners), 0)::INT AS n
FROM m LEFT JOIN o ON o.value = m.value AND o.t = m.t""")
def alias_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _alias_obs(spark, sf_dir)
    probes = obs.select("kind", "value", (F.col("observed_at") - F.expr("interval 18 hours")).alias("asof")).distinct()
    return asof.alias_asof(obs, probes).select("value", F.date_format("asof", "yyyy-MM-dd HH").alias("asof"), "status", "bound", F.size("owners").alias("n"))


@query(f"""WITH {_FD}, n AS (SELECT family, max(captured_at) AS newest FROM fd GROUP BY 1)
SELECT key AS entity, strftime(min(captured_at), '%Y-%m-%d') AS first_seen, strftime(max(captured_at), '%Y-%m-%d') AS last_seen, bool_or(captured_at = newest) AS present_in_latest FROM fd JOIN n USING (family) GROUP BY 1""")
def first_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _families(spark, sf_dir).select(F.col("key").alias("entity"), "family", "captured_at", F.col("key").alias("display"))
    return identity.seen(h).select("entity", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_seen", "last_seen")), "present_in_latest")


@query("""SELECT user_id::VARCHAR AS entity, json_extract_string(props, '$.k') AS alias, strftime(min(ts), '%Y-%m-%d') AS first_seen, strftime(max(ts), '%Y-%m-%d') AS last_seen FROM events GROUP BY 1, 2""")
def alias_first_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _alias_obs(spark, sf_dir).withColumnRenamed("owner", "entity").withColumn("family", F.lit("events"))
    return identity.alias_seen(obs).select("entity", "alias", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_seen", "last_seen")))


@query("""WITH d AS (SELECT o_orderkey::VARCHAR AS device, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey::VARCHAR END AS uid, (o_custkey + o_orderkey % 2)::VARCHAR AS upn, o_custkey % 50 AS mail FROM orders),
known AS (SELECT c_custkey::VARCHAR AS c FROM customer),
a AS (SELECT device, uid AS owner, 'id' AS s, c IS NOT NULL AS ok, FALSE AS amb FROM d LEFT JOIN known ON c = uid WHERE uid IS NOT NULL
 UNION ALL SELECT device, c, 'upn', c IS NOT NULL, FALSE FROM d LEFT JOIN known ON c = upn
 UNION ALL SELECT device, (SELECT min(c_custkey) FROM customer WHERE c_custkey % 50 = mail)::VARCHAR, 'mail', n = 1, n > 1 FROM d LEFT JOIN (SELECT c_custkey % 50 AS m, count(*) AS n FROM customer GROUP BY 1) ON m = mail WHERE device::BIGINT % 7 = 0),
g AS (SELECT device, count(DISTINCT owner) FILTER (ok AND s = 'id') AS ids, any_value(owner) FILTER (ok AND s = 'id') AS id, count(DISTINCT owner) FILTER (ok AND s <> 'id') AS others, any_value(owner) FILTER (ok AND s <> 'id') AS other, bool_or(amb) AS amb FROM a GROUP BY 1),
r AS (SELECT *, CASE WHEN ids > 1 THEN 'conflicting' WHEN ids = 1 AND (others > 1 OR (others = 1 AND other <> id)) THEN 'conflicting' WHEN ids = 1 THEN 'resolved' WHEN amb THEN 'ambiguous' WHEN others > 1 THEN 'conflicting' WHEN others = 1 THEN 'resolved' ELSE 'unbound' END AS status FROM g)
SELECT device, status, CASE WHEN status = 'resolved' THEN coalesce(id, other) END AS user_id FROM r""")
def link_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("2020-01-02").cast("timestamp")
    o = table(spark, sf_dir, "orders")
    mail = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("m"), (F.col("o_custkey") % 50).cast("string"), F.lit("@example.com")))
    devices = o.select(F.col("o_orderkey").cast("string").alias("device"), at.alias("captured_at"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey").cast("string")).alias("user_id"), (F.col("o_custkey") + F.col("o_orderkey") % 2).cast("string").alias("upn"), mail.alias("mail"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("owner"), F.concat(F.lit("m"), (F.col("c_custkey") % 50).cast("string"), F.lit("@example.com")).alias("mail"))
    seen = F.lit("2020-01-01").cast("timestamp").alias("observed_at")
    obs = c.select(F.lit("upn").alias("kind"), F.col("owner").alias("value"), "owner", seen).unionByName(c.select(F.lit("mail").alias("kind"), F.col("mail").alias("value"), "owner", seen))
    return links.merge_links(links.attempts(devices, obs, c.select(F.col("owner").alias("user_id")))).select("device", "status", "user_id")


@query("""WITH l AS (SELECT p_partkey AS id, p_partkey % 700 AS k1, p_partkey % 211 AS k2, p_size AS k3 FROM part), r AS (SELECT s_suppkey AS id, s_suppkey % 700 AS k1, s_suppkey % 97 AS k2, s_nationkey AS k3 FROM supplier),
n1 AS (SELECT k1, count(*) AS n, min(id) AS id FROM r GROUP BY 1), n2 AS (SELECT k2, count(*) AS n, min(id) AS id FROM r GROUP BY 1), n3 AS (SELECT k3, count(*) AS n, min(id) AS id, list(id) AS ids FROM r GROUP BY 1),
j AS (SELECT l.id, n1.n AS a, n1.id AS ai, n2.n AS b, n2.id AS bi, n3.n AS c, n3.id AS ci, n3.ids AS ids FROM l LEFT JOIN n1 USING (k1) LEFT JOIN n2 USING (k2) LEFT JOIN n3 USING (k3)),
u AS (SELECT *, list_distinct(list_filter([CASE WHEN a = 1 THEN ai END, CASE WHEN b = 1 THEN bi END, CASE WHEN c = 1 THEN ci END], lambda x: x IS NOT NULL)) AS u FROM j),
s AS (SELECT *, CASE WHEN len(u) > 1 THEN 'ambiguous' WHEN len(u) = 1 AND (a > 1 OR b > 1) THEN 'ambiguous' WHEN len(u) = 1 AND c > 1 AND list_contains(ids, u[1]) THEN 'matched' WHEN len(u) = 1 AND c > 1 THEN 'ambiguous'
 WHEN len(u) = 1 THEN 'matched' WHEN a > 1 OR b > 1 OR c > 1 THEN 'ambiguous' ELSE 'no_match_with_coverage' END AS status FROM u)
SELECT id::VARCHAR AS part, status, CASE WHEN status = 'matched' THEN u[1]::VARCHAR END AS matched FROM s""")
def multikey_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "part"), table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "supplier")
    t = lambda c: c.cast("string")
    keys = {"aad": (t(F.col("part") % 700), t(F.col("supplier") % 700)), "managed": (t(F.col("part") % 211), t(F.col("supplier") % 97)), "serial": (cells.serial("p_size"), cells.serial("s_nationkey"))}
    return links.match_records(p, s, keys, "part", "supplier", containing="serial").select("part", "status", "matched")


@query("""WITH f AS (SELECT o_custkey AS entity, o_orderstatus AS v, CASE o_orderstatus WHEN 'O' THEN 2 WHEN 'F' THEN 1 ELSE 3 END AS r FROM orders), g AS (SELECT entity, v, min(r) AS r FROM f GROUP BY 1, 2)
SELECT entity, arg_min(v, (r, v)) AS value, min(r)::INT AS rank, (count(*) - 1)::INT AS n_conflicts FROM g GROUP BY 1""")
def authority_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "O", 2).when(F.col("o_orderstatus") == "F", 1).otherwise(3)
    facts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.lit("status").alias("key"), F.col("o_orderstatus").alias("value"), rank.alias("rank"))
    return resolve.pick(facts).select("entity", "value", "rank", F.size("conflicts").alias("n_conflicts"))


@query(r"""WITH e AS (SELECT c_custkey, c_custkey::VARCHAR AS entity, c_mktsegment || '.' || c_nationkey || '@' || c_custkey || '.example' AS alias, c_name || ' ref' || c_custkey AS display FROM customer),
q AS (SELECT c_custkey AS q, lower(CASE (c_custkey // 50) % 7 WHEN 0 THEN entity WHEN 1 THEN alias WHEN 2 THEN display WHEN 3 THEN left(display, 17) WHEN 4 THEN split_part(alias, '@', 1) || '@' || left(entity, 1) WHEN 5 THEN '@' || entity || '.ex' ELSE 'ref' || entity END) AS n FROM e WHERE c_custkey % 50 = 0),
r AS (SELECT q, entity, display, CASE WHEN entity = n THEN 0 WHEN lower(alias) = n THEN 1 WHEN lower(display) = n THEN 2 WHEN starts_with(entity, n) THEN 3 WHEN starts_with(lower(alias), n) THEN 4 WHEN starts_with(lower(display), n) THEN 5
 WHEN len(list_filter(regexp_split_to_array(lower(alias) || ' ' || lower(display), '[@._\-\s]+'), lambda t: t <> '' AND starts_with(t, n))) > 0 THEN 6 WHEN contains(entity || ' ' || lower(alias) || ' ' || lower(display), n) THEN 7 END AS rank FROM q, e),
p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank, lower(display), entity) AS place FROM r WHERE rank IS NOT NULL) SELECT q, entity, rank::INT AS rank, place::INT AS place FROM p WHERE place <= 50""")
def search_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity = F.col("c_custkey").cast("string")
    alias = F.concat("c_mktsegment", F.lit("."), F.col("c_nationkey").cast("string"), F.lit("@"), entity, F.lit(".example"))
    c = table(spark, sf_dir, "customer").select("c_custkey", entity.alias("entity"), alias.alias("alias"), F.concat("c_name", F.lit(" ref"), entity).alias("display"))
    kind = F.floor(F.col("c_custkey") / 50) % 7
    needles = [F.col("entity"), F.col("alias"), F.col("display"), F.substring("display", 1, 17), F.concat(F.split_part("alias", F.lit("@"), F.lit(1)), F.lit("@"), F.substring("entity", 1, 1)), F.concat(F.lit("@"), "entity", F.lit(".ex"))]
    n = F.concat(F.lit("ref"), "entity")
    for i, x in enumerate(needles):
        n = F.when(kind == i, x).otherwise(n)
    asks = c.filter("c_custkey % 50 = 0").select(F.col("c_custkey").alias("q"), n.alias("needle"))
    return identity.search_many(c.drop("c_custkey"), asks, "q", "needle").select("q", "entity", "rank", "place")


@query("""SELECT DISTINCT source AS value FROM documents WHERE starts_with(lower(source), 'src1')""")
def autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.autocomplete(table(spark, sf_dir, "documents"), "SRC1", 50, "source")


@query("""SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' | ', p_name, p_brand)), 'red') AND contains(lower(concat_ws(' | ', p_name, p_brand)), 'brand#1')""")
def smart_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.filter(predicates.smart_search(p.columns, "RED brand#1", ["P_NAME", "p_brand"])).select("p_partkey")


@query("""SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey % 5 IN (0, 2)""")
def value_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("m", F.when(F.col("c_nationkey") % 5 != 0, (F.col("c_nationkey") % 5).cast("string")))
    return c.filter(predicates.equalities({"c_mktsegment": ["BUILDING", "MACHINERY"], "m": ["2", ""]})).select("c_custkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN TRUE ELSE epoch(TIMESTAMP '2001-08-01') - epoch(o_orderdate) >= 366 * 86400 END AS old_or_blank, o_orderkey % 11 <> 0 AND epoch(TIMESTAMP '2001-08-01') - epoch(o_orderdate) < 31 * 86400 AS fresh FROM orders""")
def date_age_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("d", F.when(F.col("o_orderkey") % 11 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    now = F.lit("2001-08-01").cast("timestamp")
    return o.select("o_orderkey", predicates.age_rule("d", "days_gt_or_blank", 365, now).alias("old_or_blank"), predicates.age_rule("d", "days_lte", 30, now).alias("fresh"))


@query("""WITH m AS (SELECT DISTINCT CASE WHEN event_id % 4 = 0 THEN upper(event_type) || (event_id % 9)::VARCHAR ELSE json_extract_string(props, '$.k') || CASE WHEN event_id % 3 = 0 THEN ',000' ELSE '' END END AS v FROM events)
SELECT v, row_number() OVER (ORDER BY CASE WHEN regexp_matches(v, '^[0-9,]+$') THEN 0 ELSE 1 END, try_cast(replace(v, ',', '') AS DOUBLE), lower(v), v)::INT AS place FROM m""")
def mixed_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    v = F.when(F.col("event_id") % 4 == 0, F.concat(F.upper("event_type"), (F.col("event_id") % 9).cast("string"))).otherwise(F.concat(k, F.when(F.col("event_id") % 3 == 0, ",000").otherwise("")))
    own = events(spark, sf_dir).select(v.alias("v")).distinct()
    return predicates.ranked(own, *predicates.mixed_order("v"), "v").select("v", F.col("place").cast("int").alias("place"))


@query("""WITH s AS (SELECT date_trunc('day', ts) AS t, list_sort(list_distinct(list(event_type) FILTER ((length(event_type) * 7 + day(ts)) % 3 <> 0))) AS h FROM events GROUP BY 1),
l AS (SELECT t, h, lag(h) OVER (ORDER BY t) AS o FROM s)
SELECT strftime(t, '%Y-%m-%d') AS day, array_to_string(list_filter(h, lambda x: NOT list_contains(o, x)), ',') AS added, array_to_string(list_filter(o, lambda x: NOT list_contains(h, x)), ',') AS removed FROM l WHERE o IS NOT NULL AND h <> o""")
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when((F.length("event_type") * 7 + F.dayofmonth("ts")) % 3 != 0, F.col("event_type"))
    s = events(spark, sf_dir).groupBy(F.date_trunc("day", "ts").alias("captured_at")).agg(F.array_sort(F.collect_set(shown)).alias("headers")).withColumn("family", F.lit("events"))
    return diff.schema_changes(s).select(F.date_format("captured_at", "yyyy-MM-dd").alias("day"), F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query("""WITH l AS (SELECT l_orderkey AS k, list_sort(list((l_linenumber, l_quantity, l_returnflag))) AS a, list_sort(list((l_linenumber, CASE WHEN l_orderkey % 10 = 0 THEN l_quantity + 1 ELSE l_quantity END, l_returnflag))) AS b FROM lineitem GROUP BY 1)
SELECT k AS policy_key, CASE WHEN k % 13 = 0 THEN 'removed' WHEN k % 17 = 0 THEN 'added' WHEN a = b THEN 'unchanged' ELSE 'modified' END AS state FROM l WHERE NOT (k % 13 = 0 AND k % 17 = 0)""")
def canonical_hash_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")

    def side(bump: bool, drop: int) -> DataFrame:
        q = F.col("l_quantity") + F.when(F.lit(bump) & (F.col("l_orderkey") % 10 == 0), 1).otherwise(0)
        doc = F.to_json(F.array_sort(F.collect_list(F.struct("l_linenumber", q.alias("q"), "l_returnflag"))))
        return li.filter(F.col("l_orderkey") % drop != 0).groupBy(F.col("l_orderkey").alias("policy_key")).agg(cells.semantic_hash(doc).alias("hash")).withColumn("source", F.lit("orders"))

    ok = spark.range(1).select(F.lit("orders").alias("source"), F.lit("success").alias("status"))
    return policy.policy_diff(side(False, 17), side(True, 13), ok, ok).select("policy_key", "state")


@query("""WITH c AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, '$' AS path, 0::INT AS depth, 'object' AS type FROM c GROUP BY 1 UNION ALL SELECT conv_id, '$.turns', 1, 'array' FROM c GROUP BY 1
UNION ALL SELECT conv_id, '$.turns[' || (row_number() OVER w - 1) || ']', 2, 'object' FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, n)
UNION ALL SELECT conv_id, '$.turns[' || (row_number() OVER w - 1) || '].' || unnest(['n', 'role', 'turn']), 3, unnest(['integer', 'string', 'integer']) FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, n)""")
def json_tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("text is not null")
    doc = F.parse_json(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("turns"))))
    return policy.tree_nodes(c.groupBy("conv_id").agg(doc.alias("doc")), ["conv_id"], "doc").select("conv_id", "path", "depth", "type")


@query(f"""WITH {_UD}, b AS (SELECT key, (key::BIGINT % 3) AS s, last_type AS v FROM ud WHERE captured_at = TIMESTAMP '2024-01-11'), a AS (SELECT key, (key::BIGINT % 3) AS s, last_type AS v FROM ud WHERE captured_at = TIMESTAMP '2024-01-21')
SELECT coalesce(a.key, b.key) AS policy_key, CASE WHEN b.key IS NULL THEN CASE WHEN a.s <> 1 THEN 'added' ELSE 'indeterminate' END WHEN a.key IS NULL THEN CASE WHEN b.s <> 2 THEN 'removed' ELSE 'indeterminate' END
WHEN a.v = 'view' OR b.v = 'view' THEN 'indeterminate' WHEN a.v = b.v THEN 'unchanged' ELSE 'modified' END AS state FROM a FULL JOIN b ON a.key = b.key""")
def trust_gated_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = (d.select(F.col("key").alias("policy_key"), (F.col("key").cast("long") % 3).cast("string").alias("source"), F.when(F.col("last_type") == "view", "").otherwise(F.col("last_type")).alias("hash")) for d in _two_days(spark, sf_dir))
    ok = lambda bad: spark.range(3).select(F.col("id").cast("string").alias("source"), F.when(F.col("id") == bad, "error").otherwise("success").alias("status"))
    return policy.policy_diff(before, after, ok(1), ok(2)).select("policy_key", "state")


@query("""SELECT coalesce(n.o_orderkey, o.o_orderkey)::VARCHAR AS path, CASE WHEN n.o_orderkey IS NULL THEN 'deleted' WHEN o.o_orderkey IS NULL THEN 'new' WHEN o.o_orderkey % 29 = 0 THEN 'failed_before' WHEN n.o_orderkey % 5 = 0 AND n.o_orderkey % 4 = 0 THEN 'changed' ELSE 'reused' END AS action
FROM (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) n FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 11 <> 0) o ON n.o_orderkey = o.o_orderkey""")
def incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, size = F.col("o_orderkey").cast("string").alias("path"), F.col("o_totalprice").alias("size")
    touched = (F.col("o_orderkey") % 5 == 0) & (F.col("o_orderkey") % 4 == 0)
    old = o.filter("o_orderkey % 11 <> 0").select(key, size, F.col("o_orderdate").alias("modified"), F.lit("f").alias("fingerprint"), F.when(F.col("o_orderkey") % 29 == 0, "error").otherwise("ok").alias("status"))
    now = o.filter("o_orderkey % 7 <> 0").select(key, size, F.when(touched, F.col("o_orderdate") + F.expr("interval 1 hour")).otherwise(F.col("o_orderdate")).alias("modified"), F.lit("f").alias("fingerprint"))
    return incremental.classify(now, old)


@query("""SELECT DISTINCT trim(p_type) AS value FROM part""")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.distinct_values(table(spark, sf_dir, "part"), "p_type")


@query("""WITH s AS (SELECT c_custkey AS entity, c_name AS name, c_mktsegment AS seg FROM customer),
b AS (SELECT entity, CASE WHEN entity % 4 = 0 THEN '' ELSE name END AS n, seg AS s FROM s WHERE entity % 9 <> 0), a AS (SELECT entity, name AS n, CASE WHEN entity % 6 = 0 THEN 'X' ELSE seg END AS s FROM s WHERE entity % 8 <> 1)
SELECT coalesce(a.entity, b.entity) AS entity, CASE WHEN b.entity IS NULL THEN 'added' WHEN a.entity IS NULL THEN 'removed' WHEN a.n <> b.n OR a.s <> b.s THEN 'modified' ELSE 'unchanged' END AS change,
CASE WHEN a.entity = b.entity THEN (a.n <> b.n)::INT + (a.s <> b.s)::INT ELSE 0 END AS n_changes FROM a FULL JOIN b ON a.entity = b.entity""")
def entity_state_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "entity")
    props = lambda n, s: F.map_filter(F.create_map(F.lit("name"), n, F.lit("segment"), s), lambda k, v: v != "")
    before = c.filter("entity % 9 <> 0").select("entity", props(F.when(F.col("entity") % 4 == 0, "").otherwise(F.col("c_name")), F.col("c_mktsegment")).alias("properties"))
    after = c.filter("entity % 8 <> 1").select("entity", props(F.col("c_name"), F.when(F.col("entity") % 6 == 0, "X").otherwise(F.col("c_mktsegment"))).alias("properties"))
    return diff.map_diff(before, after, ["entity"]).select("entity", "change", F.coalesce(F.size("changes"), F.lit(0)).alias("n_changes"))
