"""Queries of entity cards, devices of users at a time, and report files in one scan. They register where the others do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrichment, identity
from . import fields
from .queries import query, table

ADAPTERS = {a.family: a for a in identity.ADAPTERS}


def _reports(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three report families about customers: the customers, what their orders say, what the events of the same numbers say."""
    c = table(spark, sf_dir, "customer").withColumn("Id", F.col("c_custkey").cast("string"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("UserId"))
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("Id"))
    nation = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))
    return {
        "Entra_Users_Properties": c.select("Id", F.col("c_name").alias("UPN"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("Department"), nation.alias("Country"), (F.col("c_acctbal") > 5000).cast("string").alias("OnPremisesSyncEnabled")),
        "Entra_Users_Activity": o.agg(F.max("o_orderpriority").alias("Department"), F.concat(F.lit("N"), (F.max("o_custkey") % 25).cast("string")).alias("Country"), F.min("o_orderstatus").alias("City"), (F.count(F.lit(1)) > 10).cast("string").alias("OnPremisesSyncEnabled")),
        "Entra_Users_AuthenticationMethods": e.agg(F.min("event_type").alias("Department"), F.max("event_type").alias("City"), F.max("event_type").alias("AuthenticationMethods"), F.min("event_type").alias("SystemPreferredAuthenticationMethods"), F.max("event_type").alias("SystemPreferredAuthenticationMethod")),
    }


@query("""WITH p AS (SELECT c_custkey AS entity, c_name AS upn, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS department, 'N' || c_nationkey AS country, (c_acctbal > 5000)::VARCHAR AS sync FROM customer),
a AS (SELECT o_custkey AS entity, max(o_orderpriority) AS department, 'N' || (max(o_custkey) % 25) AS country, min(o_orderstatus) AS city, (count(*) > 10)::VARCHAR AS sync FROM orders GROUP BY 1),
m AS (SELECT user_id AS entity, min(event_type) AS department, max(event_type) AS city, min(event_type) AS other, max(event_type) AS method FROM events GROUP BY 1),
v AS (SELECT entity, 0 AS rank, 'user_immutable_id' AS key, 'identity' AS section, entity::VARCHAR AS value FROM p UNION ALL SELECT entity, 1, 'user_immutable_id', 'identity', entity::VARCHAR FROM a
UNION ALL SELECT entity, 0, 'upn', 'identity', upn FROM p UNION ALL SELECT entity, 0, 'department', 'organization', department FROM p UNION ALL SELECT entity, 1, 'department', 'organization', department FROM a UNION ALL SELECT entity, 2, 'department', 'organization', department FROM m
UNION ALL SELECT entity, 0, 'country', 'organization', country FROM p UNION ALL SELECT entity, 1, 'country', 'organization', country FROM a UNION ALL SELECT entity, 1, 'city', 'organization', city FROM a UNION ALL SELECT entity, 2, 'city', 'organization', city FROM m
UNION ALL SELECT entity, 0, 'on_premises_sync_enabled', 'organization', sync FROM p UNION ALL SELECT entity, 1, 'on_premises_sync_enabled', 'authentication', sync FROM a
UNION ALL SELECT entity, 0, 'system_preferred_auth_method', 'authentication', method FROM m UNION ALL SELECT entity, 1, 'system_preferred_auth_method', 'authentication', other FROM m),
f AS (SELECT entity, key, value, min(rank) AS r, max(rank) AS w, arg_max(section, rank) AS section, count(*) AS n FROM v WHERE trim(coalesce(value, '')) <> '' GROUP BY 1, 2, 3)
SELECT entity::VARCHAR AS entity, arg_max(section, w) AS section, key, arg_min(value, r) AS value, CASE WHEN key = 'system_preferred_auth_method' THEN 1 ELSE arg_min(n, r) END::INT AS n_sources, array_to_string(list(value ORDER BY r)[2:], '|') AS conflicts FROM f GROUP BY 1, key""")
def entity_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = None
    for family, rows in _reports(spark, sf_dir).items():
        adapter = ADAPTERS[family]
        # authentication rows name their user by sign-in name; here they are bound by their number
        own = fields.facts(rows, adapter) if adapter.canonical else rows.select(F.lit("user").alias("entity_type"), F.col("Id").alias("entity"), F.lit(family).alias("family"), F.inline(adapter.card(rows.columns)))
        said = own if said is None else said.unionByName(own)
    cards = fields.entity_card(said, fields.registry(spark), fields.exclusions(spark))
    return cards.select("entity", "section", "key", "value", F.size("sources").alias("n_sources"), F.array_join(F.transform("conflicts", lambda c: c.value), "|").alias("conflicts"))


# --- devices of users


def _stamp(day: str) -> Column:
    return F.lit(day).cast("timestamp")


def _managed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as managed devices in three snapshots; the last one has rows that can't be read."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    cells_ = F.struct(
        F.format_string("00000000-0000-0000-0000-%012d", k).alias("AzureADDeviceId"), F.concat(F.lit("S"), k.cast("string")).alias("SerialNumber"), F.when(k % 3 == 0, c.cast("string")).alias("UserId"),
        F.concat(F.lit("U"), (c + k % 2).cast("string")).alias("UserPrincipalName"), F.when(F.col("o_orderstatus") == "P", "iOS").otherwise("Windows 11").alias("OperatingSystem"),
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(cells_).alias("payload")).withColumn("captured_at", F.explode(F.array(*(_stamp(d) for d in ("2020-01-01", "2020-02-01", "2020-03-01")))))
    day = F.month("captured_at")
    o = o.filter((day == 2) | ((day == 1) & (k % 4 != 1)) | ((day == 3) & (k % 50 < 2)))
    return o.select("captured_at", k.alias("row_ix"), F.when((day == 3) & (k % 50 == 1), "{oops").otherwise(F.col("payload")).alias("payload"))


def _enrolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as enrolment records of one snapshot; every fifth number tells a wrong serial number."""
    k = F.col("o_orderkey")
    own = F.struct(F.format_string("00000000-0000-0000-0000-%012d", k).alias("AzureADDeviceId"), F.concat(F.lit("s"), (k + (k % 5 == 0).cast("int")).cast("string")).alias("SerialNumber"))
    return table(spark, sf_dir, "orders").filter(k % 4 != 3).select(_stamp("2020-01-20").alias("captured_at"), k.alias("row_ix"), F.to_json(own).alias("payload"))


@query("""WITH t(target, snap, matched) AS (VALUES ('2019-12-15', NULL, FALSE), ('2020-01-10', 1, FALSE), ('2020-02-10', 2, TRUE), ('2020-03-10', 3, TRUE)),
ob AS (SELECT c_custkey AS alias, c_custkey AS owner, 0 AS late FROM customer UNION ALL SELECT c_custkey, c_custkey, 1 FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey - 1, c_custkey, 1 FROM customer WHERE c_custkey % 10 = 1),
ow AS (SELECT snap, alias, list(owner) AS owners FROM (SELECT s.snap, ob.*, max(late) OVER (PARTITION BY s.snap, alias) AS newest FROM ob, (VALUES (1), (2)) s(snap) WHERE s.snap = 2 OR late = 0) WHERE late = newest GROUP BY 1, 2),
d AS (SELECT snap, o_orderkey AS k, o_custkey AS c, o_orderstatus = 'P' AS phone, o_custkey + o_orderkey % 2 AS alias FROM orders, (VALUES (1), (2)) s(snap) WHERE snap = 2 OR o_orderkey % 4 <> 1),
l AS (SELECT d.*, coalesce(owners, []) AS owners FROM d LEFT JOIN ow USING (snap, alias)),
m AS (SELECT *, CASE WHEN k % 3 = 0 AND len(owners) = 1 AND owners[1] <> c THEN 'conflicting' WHEN k % 3 = 0 THEN 'resolved' WHEN len(owners) > 1 THEN 'ambiguous' WHEN len(owners) = 1 THEN 'resolved' ELSE 'unbound' END AS status,
 CASE WHEN k % 3 = 0 THEN list_distinct(list_append(owners, c)) ELSE owners END AS candidates FROM l),
r AS (SELECT o_orderkey AS k, o_orderkey + (o_orderkey % 5 = 0)::INT AS sn FROM orders WHERE o_orderkey % 4 <> 3), sn AS (SELECT sn AS k, list(k) AS ks FROM r GROUP BY 1),
e AS (SELECT d.k, r.k AS own, coalesce(ks, []) AS ks FROM (SELECT DISTINCT k FROM d) d LEFT JOIN r USING (k) LEFT JOIN sn USING (k)),
q AS (SELECT k, CASE WHEN own IS NOT NULL AND (len(ks) = 0 OR list_contains(ks, own)) THEN 'matched' WHEN own IS NOT NULL THEN 'ambiguous' WHEN len(ks) > 1 THEN 'ambiguous' WHEN len(ks) = 1 THEN 'matched' ELSE 'no_match_with_coverage' END AS status, coalesce(own, ks[1]) AS rec FROM e),
v AS (SELECT target, CASE WHEN k % 3 = 0 THEN c ELSE owners[1] END AS u, k, phone, CASE WHEN phone THEN 'not_applicable' WHEN NOT matched THEN 'no_coverage' ELSE q.status END AS st, rec FROM m JOIN t USING (snap) JOIN q USING (k) WHERE m.status = 'resolved'),
n AS (SELECT target, u, count(*) AS n_devices, string_agg(k || ':' || CASE WHEN phone THEN 'iOS' ELSE 'Windows 11' END || ':' || st || CASE WHEN st = 'matched' THEN ':' || rec ELSE '' END, ',' ORDER BY k) AS devices FROM v GROUP BY 1, 2),
x AS (SELECT target, u, count(*) AS n_open FROM (SELECT DISTINCT target, k, unnest(candidates) AS u FROM m JOIN t USING (snap) WHERE status <> 'resolved') GROUP BY 1, 2),
bad AS (SELECT count(*) AS n FROM orders WHERE o_orderkey % 50 = 1)
SELECT c_custkey::VARCHAR AS user_id, t.target, CASE WHEN snap IS NULL THEN 'no_coverage' WHEN snap = 3 AND bad.n > 0 THEN 'error' WHEN n_devices > 0 THEN 'populated' WHEN n_open > 0 THEN 'ambiguous_association' ELSE 'known_zero' END AS coverage,
 CASE WHEN snap = 3 THEN NULL ELSE coalesce(n.devices, '') END AS devices, CASE WHEN snap = 3 THEN NULL ELSE coalesce(n_open, 0) END::INT AS n_unresolved, CASE WHEN snap = 3 THEN bad.n || ' rows can''t be read' END AS error
FROM customer CROSS JOIN t CROSS JOIN bad LEFT JOIN n ON n.u = c_custkey AND n.target = t.target LEFT JOIN x ON x.u = c_custkey AND x.target = t.target""")
def user_devices_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("owner"))
    seen = lambda rows, alias, day: rows.select(F.lit("upn").alias("kind"), F.concat(F.lit("u"), alias.cast("string")).alias("value"), "owner", _stamp(day).alias("observed_at"))
    k = F.col("c_custkey")
    names = seen(c, k, "2019-12-01").unionByName(seen(c.filter(k % 10 == 0), k, "2020-01-15")).unionByName(seen(c.filter(k % 10 == 1), k - 1, "2020-01-15"))
    users = c.select(F.col("owner").alias("user_id"), F.explode(F.array(*(_stamp(d) for d in ("2019-12-15", "2020-01-10", "2020-02-10", "2020-03-10")))).alias("target"))
    out = enrichment.user_devices_at(users, _managed(spark, sf_dir), names, users.select("user_id"), _enrolled(spark, sf_dir))
    cell = lambda entries, name: F.try_element_at(F.map_from_entries(entries), F.lit(name))
    number = lambda text: F.substring(text, -12, 12).cast("long").cast("string")
    one = lambda d: F.concat_ws(":", number(d.device), cell(d.properties, "OperatingSystem"), d.match.status, number(cell(d.match.properties, "AzureADDeviceId")))
    return out.select("user_id", F.date_format("target", "yyyy-MM-dd").alias("target"), "coverage", F.array_join(F.transform("devices", one), ",").alias("devices"), F.size("unresolved").alias("n_unresolved"), "error")
