"""Validity intervals against direct readings, the store through runs and losses, adapters and relationships as bags."""

import random
from datetime import datetime as D
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, diff, identity, intervals
from tidemark.operators import point_in_time as pit
from tidemark.streaming.store import Store

HISTORY = "family string, captured_at timestamp, entity string, v string"


def test_intervals_answer_as_snapshots_do(spark):
    """Random histories with gaps, returns and empty snapshots: every as-of question has one answer both ways."""
    rng, rows = random.Random(4), []
    times = {f: sorted(D(2026, 1, 1) + timedelta(hours=rng.randrange(2000)) for _ in range(12)) for f in ("f", "g")}
    for f, ts in times.items():
        for t in ts:
            rows += [(f, t, e, str(rng.randrange(2))) for e in "abcd" if rng.random() < 0.7]
    rows += [("f", times["f"][0], None, "x"), ("f", None, "a", "x")]
    h = spark.createDataFrame(rows, HISTORY)
    snaps = spark.createDataFrame([(f, t) for f, ts in times.items() for t in ts], "family string, captured_at timestamp")
    own = intervals.state_intervals(h, F.col("v"), snapshots=snaps)
    targets = spark.createDataFrame([(f, D(2025, 12, 25) + timedelta(hours=17 * k)) for f in ("f", "g") for k in range(180)] + [(f, t) for f, ts in times.items() for t in ts] + [("f", None), ("h", D(2026, 2, 1))], "family string, target timestamp")
    got = sorted((r.family, r.target, r.entity, r.state) for r in intervals.states_at(own, targets).collect())
    used = asof.snapshot_asof(snaps, targets.filter("target is not null"))
    want = sorted((r.family, r.target, r.entity, r.v) for r in asof.rows_asof(h.filter("entity is not null"), used).collect())
    assert got == want and len(got) > 500
    assert own.groupBy("family", "entity", "valid_from").count().filter("count > 1").isEmpty()
    assert intervals.state_intervals(h.limit(0), F.col("v")).count() == 0


def test_repeated_rows_and_null_states(spark):
    h = spark.createDataFrame([("f", D(2026, 1, d), "a", v) for d, v in ((1, None), (1, None), (2, None), (3, "x"), (3, "y"), (4, "y"))], HISTORY)
    got = [(r.state, r.valid_from.day, r.valid_until and r.valid_until.day, r.n_snapshots) for r in intervals.state_intervals(h, F.col("v")).orderBy("valid_from").collect()]
    assert got == [(None, 1, 3, 2), ("y", 3, None, 2)]


def test_dyadic_nodes_cover_once(spark):
    """Each bucket of a range lies in one of its nodes, and no other bucket does."""
    df = spark.createDataFrame([(a, b) for a in range(12) for b in range(a, 12)], "a long, b long").withColumn("n", intervals.covering(F.col("a"), F.col("b")))
    for r in df.collect():
        held = sorted(x for n in r.n for x in range(n.node << n.level, (n.node + 1) << n.level))
        assert held == list(range(r.a, r.b + 1)) and len(r.n) <= 2 * 4
    far = spark.createDataFrame([(0, (1 << intervals.LEVELS) - 1)], "a long, b long").select(intervals.covering(F.col("a"), F.col("b")).alias("n")).first().n
    assert [(x.level, x.node) for x in far] == [(intervals.LEVELS, 0)]


def test_times_off_the_line_and_points(spark):
    i = spark.createDataFrame([("a", D(1960, 1, 1), D(1965, 1, 1)), ("b", D(1960, 1, 1), None), ("c", D(2026, 1, 1), D(2026, 1, 1)), ("d", D(2200, 1, 1), None)], "k string, valid_from timestamp, valid_until timestamp")
    p = spark.createDataFrame([(k, t) for k in "abcd" for t in (D(1962, 1, 1), D(2026, 1, 1), D(2300, 1, 1))], "k string, target timestamp")
    got = sorted((r.k, r.target.year) for r in intervals.interval_join(i, p, ["k"]).collect())
    assert got == [("a", 1962), ("b", 1962), ("b", 2026), ("b", 2300), ("d", 2300)]


def test_alias_intervals_bind_as_observations_do(spark):
    rng = random.Random(8)
    obs = spark.createDataFrame([("upn", rng.choice("xyz"), rng.choice(["u1", "u2", None]), D(2026, 1, 1) + timedelta(days=rng.randrange(20))) for _ in range(60)], "kind string, value string, owner string, observed_at timestamp")
    ask = spark.createDataFrame([("upn", v, D(2025, 12, 30) + timedelta(hours=9 * k)) for v in "xyzw" for k in range(70)], "kind string, value string, asof timestamp")
    want = sorted((r.value, r.asof, r.status, r.bound or "") for r in asof.alias_asof(obs, ask).collect())
    assert sorted((r.value, r.asof, r.status, r.bound or "") for r in intervals.bind_asof(intervals.alias_intervals(obs), ask).collect()) == want


def test_link_intervals_give_a_users_devices(spark):
    merged = spark.createDataFrame([("d1", D(2026, 1, 1), "resolved", "a"), ("d1", D(2026, 1, 2), "resolved", "a"), ("d1", D(2026, 1, 3), "ambiguous", None), ("d2", D(2026, 1, 3), "resolved", "a")], "device string, captured_at timestamp, status string, user_id string")
    own = intervals.link_intervals(merged)
    assert own.count() == 3
    asks = spark.createDataFrame([("a", D(2026, 1, d, 5)) for d in (1, 2, 3)] + [("z", D(2026, 1, 1, 5))], "user_id string, captured_at timestamp")
    assert sorted((r.captured_at.day, r.device) for r in intervals.devices_at(own, asks).collect()) == [(1, "d1"), (2, "d1"), (3, "d2")]


# --- the store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", "path string, v long")


def frames(spark, actions, rows=(), failed=()):
    return spark.createDataFrame(list(actions), "path string, action string"), spark.createDataFrame(list(rows), "path string, v long"), spark.createDataFrame(list(failed), "path string, message string")


def held(store, version=None):
    return sorted(map(tuple, store.rows(version).collect()))


def test_store_through_runs(spark, store):
    assert held(store) == [] and store.versions() == [] and store.vacuum() == 0
    assert store.commit("one", *frames(spark, [("a", "new"), ("b", "new"), ("c", "new"), ("d", "new")], [("a", 1), ("a", 1), ("b", 2), ("c", 3)], [("c", "bad")])) == 1
    assert held(store) == [("a", 1), ("a", 1), ("b", 2)]
    assert {r.path: (r.status, r.rows) for r in store.manifest().collect()} == {"a": ("ok", 2), "b": ("ok", 1), "c": ("error", 0), "d": ("ok", 0)}
    store.commit("two", *frames(spark, [("a", "changed"), ("b", "changed"), ("c", "failed_before"), ("d", "deleted")], [("b", 22), ("c", 33)], [("a", "unreadable")]))
    assert held(store) == [("a", 1), ("a", 1), ("b", 22), ("c", 33)] and held(store, 1) == [("a", 1), ("a", 1), ("b", 2)]
    assert {r.path: (r.status, r.message) for r in store.manifest().collect()} == {"a": ("error", "unreadable"), "b": ("ok", None), "c": ("ok", None)}
    assert store.commit("two", *frames(spark, [("a", "deleted")])) == 2 and store.commits() == ["one", "two"]  # a repeated batch changes nothing
    store.commit("three", *frames(spark, [("a", "deleted"), ("b", "reused")]))
    assert held(store) == [("b", 22), ("c", 33)]
    assert store.vacuum() >= 1 and store.versions() == [3] and held(store) == [("b", 22), ("c", 33)]


def test_a_lost_run_leaves_the_old_store(spark, store, monkeypatch):
    """A driver lost between the phases, or while the manifest is written, changes nothing; the run is done again whole."""
    store.commit("one", *frames(spark, [("a", "new")], [("a", 1)]))
    args = frames(spark, [("a", "changed"), ("b", "new")], [("a", 11), ("b", 2)])

    def lost(self, *_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", lost)
        with pytest.raises(KeyboardInterrupt):
            store.commit("two", *args)
    assert held(store) == [("a", 1)] and store.versions() == [1]
    spark.createDataFrame([("half", "two", "ok", None, 1, None)], "path string, batch string, status string, message string, rows long, commits array<string>").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{store.folder}/manifests/v2")
    assert held(store) == [("a", 1)] and store.versions() == [1]
    assert store.commit("two", *args) == 2 and held(store) == [("a", 11), ("b", 2)]


def test_of_two_runs_at_once_one_fails(spark, store):
    store.commit("one", *frames(spark, [("a", "new")], [("a", 1)]))
    with pytest.raises(RuntimeError):
        store._publish(1, store.manifest(), ["other"])
    assert held(store) == [("a", 1)]


def test_vacuum_rewrites_thin_batches(spark, store):
    store.commit("one", *frames(spark, [(str(i), "new") for i in range(10)], [(str(i), i) for i in range(10)]))
    store.commit("two", *frames(spark, [(str(i), "deleted") for i in range(8)]))
    assert store.vacuum() == 2 and held(store) == [("8", 8), ("9", 9)]
    assert {r.batch for r in store.manifest().collect()} == {"compact-3"} and store.commits()[:2] == ["one", "two"]


def test_store_as_a_stream_sink(spark, tmp_path):
    """A stream over a folder; its last batch is repeated with the checkpoint gone and applied once."""
    from tidemark.streaming.store import sink

    own = Store(spark, f"file://{tmp_path}/s", "path string, v long")
    folder = tmp_path / "in"
    spark.createDataFrame([(1,), (2,)], "v long").coalesce(1).write.parquet(str(folder))
    none = spark.createDataFrame([], "path string, message string")
    run = sink(own, "stream", lambda df: (df, none))
    for check in ("c1", "c2"):
        rows = spark.readStream.schema("v long").parquet(str(folder)).select(F.col("_metadata.file_path").alias("path"), "v")
        rows.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / check)).trigger(availableNow=True).start().awaitTermination()
    assert [r.v for r in own.rows().orderBy("v").collect()] == [1, 2] and own.commits() == ["stream-0"]


# --- adapters and relationships


def test_keys_of_shipped_families(spark):
    of = {a.family: a for a in identity.ADAPTERS}
    key = lambda f, **c: spark.createDataFrame([tuple(c.values())], ", ".join(f"`{n}` string" for n in c)).select(of[f].key(list(c))).first()[0]
    assert key("Entra_Users_AuthenticationMethods", MicrosoftReportId="r1", UPN="Ann@X.org") == "upn_only:Entra_Users_AuthenticationMethods:ann@x.org"
    assert key("Entra_Role_Assignments", UserId="u1", UserPrincipalName=" B@x ") == "upn_only:Entra_Role_Assignments:b@x"
    assert key("Entra_Users_Properties", UPN="Ann@X.org") is None and key("Entra_Users_Properties", id="u1", UPN="a") == "u1"
    assert key("Intune_Devices_Autopilot", AutopilotObjectId="P", SerialNumber="s") == "autopilot:P" and key("Intune_Devices_Autopilot", AzureADDeviceId="A") == "aad:A"
    assert key("Intune_ManagedDevices_Compliance", ManagedDeviceId="M") == "intune:Intune_ManagedDevices_Compliance:M" and key("Intune_ManagedDevices_Compliance", SerialNumber="s") is None
    assert key("Intune_Android_Devices", IntuneDeviceId="i") == "android_intune:i" and key("Intune_iOS_Devices", IntuneDeviceId="i") == "ios_intune:i"
    assert key("Exchange_SharedMailboxes", PrimarySmtpAddress="Box@X") == "smtp:box@x"
    assert not of["Entra_Users_Properties"].supports(["UPN"]) and of["Entra_Users_Properties"].supports(["ID"]) and of["Entra_Role_Assignments"].supports(["userprincipalname"])
    assert {a.family for a in identity.ADAPTERS if a.upn_dependent} == {"Entra_Users_AuthenticationMethods", "Entra_Role_Assignments"}
    assert len(identity.ADAPTERS) == 11 and identity.Adapter("f", "user", (), fallback=identity.Fallback("p:", "x")).supports([])


def test_scopes_and_cards(spark):
    of = {a.family: a for a in identity.ADAPTERS}
    rows = spark.createDataFrame([("u", "g1", "Group", "direct", "x"), ("u", "", "Other", " ", "x")], "UserId string, groupid string, GroupName string, MembershipType string, more string")
    a = of["Entra_Group_User_Memberships"]
    got = [(r.s, [(p.name, p.value) for p in r.c]) for r in rows.select(a.row_scope(rows.columns).alias("s"), a.card(rows.columns).alias("c")).collect()]
    assert got == [("GroupId: g1 / GroupName: Group", [("UserId", "u"), ("GroupName", "Group"), ("MembershipType", "direct")]), ("GroupName: Other", [("UserId", "u"), ("GroupName", "Other")])]
    rel = pit.relationships(rows.withColumn("entity", F.lit("e")), a)
    assert rel.columns == ["entity", "family", "scope", "properties"] and rel.count() == 2


def test_relationships_as_bags(spark):
    kind = "entity string, family string, scope string, properties array<struct<name: string, value: string>>"
    p = lambda *x: [tuple(i.split("=")) for i in x]
    before = spark.createDataFrame([("e", "f", "s1", p("a=1", "b=2")), ("e", "f", "s2", p("a=1")), ("e", "f", "s2", p("a=1")), ("e", "f", "s3", p("a=1")), ("e", "f", None, None), ("e", "f", "s5", p("a=1"))], kind)
    after = spark.createDataFrame([("e", "f", "s1", p("b=2", "a=1")), ("e", "f", "s2", p("a=1")), ("e", "f", "s4", p("a=1")), ("e", "f", None, None), ("e", "f", "s5", p("a=2"))], kind)
    got = {r.scope: (r.change, [tuple(x) for x in r.before], [tuple(x) for x in r.after]) for r in diff.relationship_diff(before, after).collect()}
    assert got == {"s2": ("modified", [("a=1", 1)], []), "s3": ("removed", [("a=1", 1)], []), "s4": ("added", [], [("a=1", 1)]), "s5": ("modified", [("a=1", 1)], [("a=2", 1)])}
    assert diff.relationship_diff(before.limit(0), after.limit(0)).count() == 0
