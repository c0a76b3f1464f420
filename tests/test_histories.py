"""Histories under family rules, policies that are there without a hash, global ranks, search of many needles, storage."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import predicates
from tidemark.operators import diff, identity, periods, policy
from tidemark.plans import families, storage

D = datetime


def moved(spark, family, snapshots, **options):
    """history_movement of snapshots, each a list of rows (dicts): {seq: (added, removed, changed)}."""
    columns = sorted({c for rows in snapshots for r in rows for c in r})
    data = [(D(2026, 1, 1 + t), [c for c in columns if any(c in r for r in rows)], i, *(r.get(c) for c in columns)) for t, rows in enumerate(snapshots) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "captured_at timestamp, headers array<string>, row_ix int, " + ", ".join(f"`{c}` string" for c in columns))
    return {r.seq: (r.added, r.removed, r.changed) for r in families.history_movement(df, family, columns, **options).collect()}


def test_a_new_or_dropped_column_is_no_change(spark):
    got = moved(spark, "Other", [[{"Id": "1", "a": "x"}], [{"Id": "1", "a": "x", "b": "y"}], [{"Id": "1", "b": "z"}], [{"Id": "1", "b": "z"}, {"Id": " ", "b": "q"}]])
    assert got == {2: (0, 0, 0), 3: (0, 0, 1), 4: (0, 0, 0)}


def test_errors_orders_and_excluded_columns_are_no_changes(spark):
    row = lambda full, n="1": {"ExternalDirectoryObjectId": "m", "FullAccessDelegates": full, "FullAccessDelegatesCount": n, "DisplayName": "M"}
    got = moved(spark, "Exchange_SharedMailboxes", [[row("a@x; B@x")], [row("ERROR: transient", "9")], [row("b@x;a@x")], [row("A@x; b@x", "3")], [row("")], [row("a@x")]])
    assert got == {2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0), 5: (0, 0, 1), 6: (0, 0, 1)}


def test_unknown_manager_and_names_beside_a_user_id(spark):
    user = lambda boss, status: {"Id": "u", "ManagerUPN": boss, "ManagerStatus": status}
    assert moved(spark, "Entra_Users_Properties", [[user("b", "200")], [user("", "500")], [user("", "404")], [user("c", "200")]]) == {2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 1)}
    device = lambda name, uid="7": {"ManagedDeviceId": "d", "UserId": uid, "UserDisplayName": name}
    assert moved(spark, "Intune_ManagedDevices_Compliance", [[device("A")], [device("B")], [device("B", "8")]]) == {2: (0, 0, 0), 3: (0, 0, 1)}


def test_role_keys_follow_the_headers_of_a_pair(spark):
    old = {"UserPrincipalName": "p", "RoleName": "r", "RoleState": "Active", "AssignmentSource": "Direct", "SourceGroup": ""}
    new = old | {"AssignmentScheduleId": "s1", "UserId": "u1"}
    got = moved(spark, "Entra_Role_Assignments", [[old], [new], [new | {"UserPrincipalName": "renamed"}], [new | {"AssignmentScheduleId": "s2"}]])
    assert got == {2: (0, 0, 0), 3: (0, 0, 0), 4: (1, 1, 0)}


def test_period_changes_compare_common_headers_and_tell_partial_pairs(spark):
    rows = [("f", D(2026, 1, 1), ["k", "a"], "1", "x", None), ("f", D(2026, 1, 9), ["k", "a", "b"], "1", "x", "y"), ("g", D(2026, 1, 1), ["k", "a"], "1", "x", None), ("g", D(2026, 1, 9), ["k", "a"], "1", "z", None)]
    h = spark.createDataFrame(rows, "family string, captured_at timestamp, headers array<string>, key string, a string, b string")
    pairs = periods.period_pairs(h, F.lit("2026-01-09").cast("timestamp"), {"3 days": 72})
    says = families.says("", ["a", "b"], F.col("headers"))
    assert {r.family: (r.status, r.changed) for r in periods.period_changes(h, pairs, says=says).collect()} == {"f": ("unchanged", 0), "g": ("changed", 1)}
    partial = h.filter("family = 'g' and day(captured_at) = 1")
    assert {r.family: r.status for r in periods.period_changes(h, pairs, says=says, partial=partial).collect()} == {"f": "unchanged", "g": "partial"}


def test_a_policy_without_a_hash_is_there(spark):
    side = lambda rows: spark.createDataFrame(rows, "policy_key string, source string, hash string")
    ok = spark.createDataFrame([("s", "success")], "source string, status string")
    before, after = side([("p", "s", "h"), ("q", "s", "h"), ("r", "s", None), ("t", "s", "1"), ("t", "s", "2"), ("u", "s", "1"), ("u", "s", "1")]), side([("p", "s", None), ("r", "s", "h"), ("t", "s", "1"), ("u", "s", "1")])
    got = sorted((r.policy_key, r.state) for r in policy.policy_diff(before, after, ok, ok).collect())
    assert got == [("p", "indeterminate"), ("q", "removed"), ("r", "indeterminate"), ("t", "indeterminate"), ("u", "unchanged")]


def test_a_null_map_is_a_state_without_properties(spark):
    side = lambda rows: spark.createDataFrame(rows, "entity int, properties map<string, string>")
    got = {r.entity: (r.change, len(r.changes or [])) for r in diff.map_diff(side([(1, None), (2, {"a": "x"}), (3, None)]), side([(1, {"a": "x"}), (2, None), (4, None)]), ["entity"]).collect()}
    assert got == {1: ("modified", 1), 2: ("modified", 1), 3: ("removed", 0), 4: ("added", 0)}


def test_global_rank_equals_a_sort(spark):
    values = [str((i * 37) % 101) if i % 3 else f"w{i % 50}" for i in range(400)]
    df = spark.createDataFrame(sorted({(v,) for v in values}), "v string").repartition(7)
    got = {r.place: r.v for r in predicates.ranked(df, *predicates.mixed_order("v"), "v").collect()}
    want = [r.v for r in df.orderBy(*predicates.mixed_order("v"), "v").collect()]
    assert [got[i + 1] for i in range(len(want))] == want and len(got) == len(want)
    assert predicates.ranked(df.limit(0), "v").count() == 0


def test_many_needles_find_what_one_does(spark):
    names = ["Ann Lee", "Annabel", "Bo", "joanna", "Zed-Ann", "an", "7", None]
    e = spark.createDataFrame([(str(i), n, f"{n}@x.y" if i % 2 else None) for i, n in enumerate(names)], "entity string, display string, alias string")
    needles = ["ann", "a", "an", "ann lee", "7", "x.y", "nowhere", "", "zed-ann@x.y", "@x"]
    asks = spark.createDataFrame(list(enumerate(needles)), "q int, n string")
    got = {}
    for r in identity.search_many(e, asks, "q", "n").collect():
        got.setdefault(needles[r.q], []).append((r.place, r.entity, r["rank"]))
    for n in needles:
        want = [(i, r.entity, r["rank"]) for i, r in enumerate(identity.search(e, F.lit(n)).collect(), 1)] if n else []
        assert sorted(got.get(n, [])) == want, n


def test_stored_tables_go(spark):
    t = storage.stored(spark.range(3), "gone")
    path = storage.WRITTEN[-1]
    assert t.count() == 3 and storage.drop_stored(spark) >= 1 and not storage.WRITTEN
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


def test_recent_report_takes_each_pairs_key(spark):
    """Roles between snapshots of which one lacks the stable key are told by the legacy one; documents are refused."""
    role = "UserId string, UserPrincipalName string, RoleName string, RoleState string, AssignmentSource string, SourceGroup string, AssignmentScheduleId string, captured_at timestamp, headers array<string>, row_ix int"
    old = ["UserId", "UserPrincipalName", "RoleName", "RoleState", "AssignmentSource", "SourceGroup"]
    row = lambda day, state, sid: ("u", "u@x", "R", state, "Direct", "", sid, datetime(2026, 7, day), [*old, "AssignmentScheduleId"] if sid else old, 0)
    h = spark.createDataFrame([row(1, "Active", None), row(8, "Eligible", "s"), row(9, "Active", "s")], role)
    ask = lambda **kw: {r.period: (r.family, r.status, r.added, r.removed, r.changed) for r in families.recent_report({"Entra_Role_Assignments": h}, F.lit("2026-07-09 00:00:00").cast("timestamp"), spans={"day": 24, "week": 168}, **kw).collect()}
    name = "Entra_Role_Assignments"
    assert ask() == {"day": (name, "changed", 0, 0, 1), "week": (name, "unchanged", 0, 0, 0)}  # by the legacy key it is one assignment
    part = spark.createDataFrame([(name, datetime(2026, 7, 1))], "family string, captured_at timestamp")
    assert ask(partial=part) == {"day": (name, "changed", 0, 0, 1), "week": (name, "partial", 0, 0, 0)}
    with pytest.raises(ValueError):
        families.recent_report({"Intune_ConfigurationPolicies": h}, F.lit(None))
