from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, diff, identity, links, metrics, policy, resolve
from tidemark.operators import point_in_time as pit
from tidemark.plans import cards, families
from tidemark.streaming import incremental

D = datetime


def test_token_reorder_and_failed_retrieval_are_no_change(spark):
    before = spark.createDataFrame([(0, "m1", "a;b", "x"), (1, "m2", "a", "y"), (2, "m3", "a", "y")], "row_ix int, id string, delegates string, other string")
    after = spark.createDataFrame([(0, "m1", "b; a", "x"), (1, "m2", "ERROR: timeout", "y"), (2, "m3", "a;c", "y")], "row_ix int, id string, delegates string, extra string")
    d = diff.pair_diff(before, after, F.col("id"), "row_ix", guards={"delegates": diff.failed_retrieval("delegates")}, token_columns=["delegates"])
    assert {r.key: r.change for r in d.collect()} == {"m1": "Stable", "m2": "Stable", "m3": "Changed"}
    (row,) = diff.details(d, most=5).collect()
    assert (row.property, row.before, row.after, row.more) == ("delegates", "a", "a;c", False)
    assert diff.counts(d).first().total == 1


def test_last_row_wins_and_blank_keys_drop(spark):
    rows = spark.createDataFrame([(0, "k", "old"), (1, "k", "new"), (2, " ", "x"), (3, None, "y")], "row_ix int, id string, v string")
    assert [(r.id, r.v) for r in diff.last_row_wins(rows, ["id"], "row_ix").collect()] == [("k", "new")]


def test_unknown_manager_status_is_no_removal(spark):
    schema = "row_ix int, id string, manager string, status string"
    before, after = spark.createDataFrame([(0, "u", "boss", "200")], schema), spark.createDataFrame([(0, "u", "", "500")], schema)
    assert diff.pair_diff(before, after, F.col("id"), "row_ix", exclude=["status"]).first().change == "Changed"
    assert diff.pair_diff(before, after, F.col("id"), "row_ix", exclude=["status"], guards={"manager": diff.unknown_status("status")}).first().change == "Stable"


def test_alias_ties_and_owner_changes(spark):
    obs = spark.createDataFrame([("upn", "x", "u1", D(2026, 1, 1)), ("upn", "x", "u2", D(2026, 1, 5)), ("upn", "t", "u1", D(2026, 1, 1)), ("upn", "t", "u2", D(2026, 1, 1))], "kind string, value string, owner string, observed_at timestamp")
    ask = spark.createDataFrame([("upn", "x", D(2026, 1, 4)), ("upn", "x", D(2026, 1, 5)), ("upn", "t", D(2026, 2, 1)), ("upn", "x", D(2025, 1, 1)), ("upn", "z", D(2026, 1, 1))], "kind string, value string, asof timestamp")
    got = {(r.value, r.asof): (r.status, r.bound) for r in asof.alias_asof(obs, ask).collect()}
    assert got == {("x", D(2026, 1, 4)): ("bound", "u1"), ("x", D(2026, 1, 5)): ("bound", "u2"), ("t", D(2026, 2, 1)): ("ambiguous", None), ("x", D(2025, 1, 1)): ("unbound", None), ("z", D(2026, 1, 1)): ("unbound", None)}
    rows = spark.createDataFrame([("i", "x"), (None, "X "), (None, "t"), (None, ""), (None, "q")], "uid string, upn string").withColumn("captured_at", F.lit("2026-01-04").cast("timestamp"))
    bound = {(r.uid, r.upn): (r.entity, r.reason) for r in asof.bind_rows(rows, obs, F.col("uid"), F.col("upn")).collect()}
    assert bound == {("i", "x"): ("i", None), (None, "X "): ("u1", None), (None, "t"): (None, "ambiguous_upn"), (None, ""): (None, "missing_upn"), (None, "q"): (None, "unbound_upn")}


def test_presence(spark):
    h = spark.createDataFrame([("users", D(2026, 1, 1), "a"), ("users", D(2026, 1, 3), "b"), ("act", D(2026, 1, 2), "a")], "family string, captured_at timestamp, entity string").withColumn("p", F.col("entity"))
    used = asof.snapshot_asof(h, asof.for_every_family(h, ["2025-12-31 00:00:00", "2026-01-01 12:00:00", "2026-01-04 00:00:00"]))
    ask = spark.createDataFrame([(e, f) for e in "ab" for f in ("users", "act")], "entity string, family string")
    status = asof.entity_status(h, used, ask)
    got = {(r.entity, r.target.day): r.presence for r in asof.presence(status, ["users"]).collect()}
    assert got == {("a", 31): "unknown", ("b", 31): "unknown", ("a", 1): "present", ("b", 1): "absent", ("a", 4): "present", ("b", 4): "present"}
    state = {(r.entity, r.target.day): [p.value for p in r.properties] for r in asof.state_asof(h, used, ["p"]).collect()}
    assert state[("a", 4)] == ["a"] and ("b", 1) not in state


@pytest.mark.parametrize(
    ("tries", "want"),
    [
        ([("user_id", "resolved", ["a"])], ("resolved", "a")), ([("user_id", "resolved", ["a"]), ("upn", "resolved", ["b"])], ("conflicting", None)), ([("user_id", "resolved", ["a"]), ("upn", "ambiguous", ["a", "b"])], ("resolved", "a")),
        ([("user_id", "resolved", ["a"]), ("user_id", "resolved", ["b"])], ("conflicting", None)), ([("upn", "ambiguous", ["a", "b"]), ("mail", "resolved", ["a"])], ("ambiguous", None)), ([("upn", "resolved", ["a"]), ("mail", "resolved", ["b"])], ("conflicting", None)),
        ([("upn", "resolved", ["a"]), ("mail", "unbound", [])], ("resolved", "a")), ([("upn", "unbound", [])], ("unbound", None)),
    ],
)
def test_link_ladder(spark, tries, want):
    df = spark.createDataFrame([("d", D(2026, 1, 1), *t) for t in tries], "device string, captured_at timestamp, signal string, status string, owners array<string>")
    r = links.merge_links(df).first()
    assert (r.status, r.user_id) == want


def test_user_devices_coverage(spark):
    at = D(2026, 1, 1)
    users = spark.createDataFrame([(u, at) for u in "abc"] + [("a", D(2026, 1, 2))], "user_id string, captured_at timestamp")
    merged = spark.createDataFrame([("d1", at, "resolved", "a", ["a"]), ("d2", at, "ambiguous", None, ["b", "z"])], "device string, captured_at timestamp, status string, user_id string, candidates array<string>")
    values = spark.createDataFrame([("d2", at, "b@x")], "device string, captured_at timestamp, value string")
    open_ = links.relevant_unresolved(merged, values, spark.createDataFrame([("b", "B@x")], "user_id string, value string"))
    assert {r.user_id for r in open_.collect()} == {"b", "z"}
    got = links.user_devices(users, merged, open_, spark.createDataFrame([(at, True)], "captured_at timestamp, complete boolean"))
    assert {(r.user_id, r.captured_at.day): (r.coverage, r.devices) for r in got.collect()} == {("a", 1): ("populated", ["d1"]), ("b", 1): ("ambiguous_association", []), ("c", 1): ("known_zero", []), ("a", 2): ("no_coverage", [])}


def test_matches(spark):
    left = spark.createDataFrame([("1", "A", "s1"), ("2", "A", "s2"), ("3", "", "s2"), ("4", "q", "q"), ("5", "B", "s2"), ("6", "B", "s9")], "l string, id string, sn string")
    right = spark.createDataFrame([("r1", "A", "s2"), ("r2", "C", "s2"), ("r3", "B", "s9"), ("r4", "D", "s1")], "r string, rid string, rsn string")
    got = {r.l: (r.status, r.matched, bool(r.diagnostic)) for r in links.match_records(left, right, {"id": (F.col("id"), F.col("rid")), "serial": (F.col("sn"), F.col("rsn"))}, "l", "r", "serial").collect()}
    assert got == {"1": ("ambiguous", None, False), "2": ("matched", "r1", True), "3": ("ambiguous", None, False), "4": ("no_match_with_coverage", None, False), "5": ("ambiguous", None, False), "6": ("matched", "r3", False)}
    gate = spark.createDataFrame([("macOS", "x"), ("Windows 11", "Cloud PC Enterprise"), ("Windows", "Surface"), ("", "Surface"), (None, None), ("windows", "VMware 7"), ("Windows", "Virtual Machine")], "os string, model string")
    n, c = "not_applicable", "no_coverage"
    assert [r[0] for r in gate.select(links.applicability("os", "model", F.lit(False))).collect()] == [n, n, c, n, n, c, n]


def test_resolution(spark):
    facts = spark.createDataFrame([("e", "dept", "A", 2), ("e", "dept", "B", 1), ("e", "dept", "B", 3), ("e", "dept", " ", 0)], "entity string, key string, value string, rank int")
    r = resolve.pick(facts).first()
    assert (r.value, r.rank, r.conflicts) == ("B", 1, ["A"])
    m = spark.createDataFrame([("SMS;App", "app; sms"), ("SMS", "FIDO"), ("", "")], "a string, b string").select(resolve.merge_methods("a", "b").alias("m")).collect()
    assert [(x.m.state, x.m.methods) for x in m] == [("populated", ["SMS", "App"]), ("conflict", ["SMS"]), ("known_empty", [])]
    f = spark.createDataFrame([("e", "F", "Mail", "m"), ("e", "F", "Odd", "o"), ("e", "F", "Id", "i")], "entity string, family string, name string, value string")
    b = spark.createDataFrame([("F", "Mail", "mail", 1)], "family string, name string, key string, rank int")
    assert {r.key for r in resolve.bind_fields(f, b, spark.createDataFrame([("F", "Id")], "family string, name string")).collect()} == {"mail", "additional:F:Odd"}
    rel = spark.createDataFrame([("e", "G", 1), ("e", "g", 0), ("e", "h", 2)], "entity string, k string, row_ix int")
    assert sorted(r.row_ix for r in resolve.dedupe_relationships(rel, ["entity"], F.col("k"), "row_ix").collect()) == [0, 2]


def test_cards_detect_and_count(spark):
    assert cards.detect(["Column"]) is None
    assert cards.detect("UserPrincipalName GroupId GroupName MembershipType UserType".split()).name == "Memberships"
    apps = spark.createDataFrame([("a", "1", "x", "published", "True", "3", "Windows"), ("b", "2", "x", "Processing", "no", "", "iOS/iPadOS")], "AppName string, AppId string, AppGraphType string, PublishingState string, IsAssigned string, AssignmentCount string, PlatformGuess string")
    r = metrics.dashboard(apps).first().asDict()
    assert (r["Apps"], r["App Types"], r["Assignment Rows"], r["Published"], r["Assigned"], r["Unassigned"], r["iOS iPadOS"]) == (2, 1, 3, 1, 1, 1, 1)
    act = spark.createDataFrame([("u", "2026-01-01", ""), ("v", "2024-01-01", "2026-01-20T00:00:00Z")], "UserId string, CreatedDateTime string, LastSuccessfulSignInDateTime string").withColumns({c: F.lit("") for c in "UPN LastPasswordChangeDateTime LastInteractiveSignInDateTime LastNonInteractiveSignInDateTime AccountEnabled".split()})
    r = metrics.dashboard(act.withColumn("captured_at", F.lit("2026-01-31").cast("timestamp")), by=["captured_at"]).first().asDict()
    assert (r["Created 30"], r["Created over 730"], r["Successful 30"], r["Inactive 30"], r["Never Successful"]) == (1, 1, 1, 1, 1)
    assert metrics.profile(spark.createDataFrame([("", "x")], "a string, b string")).first().completeness == 50.0


def test_search(spark):
    e = spark.createDataFrame([("u1", "Ann Lee", "ann@x.com"), ("u2", "Bob Ann", "bob@x.com"), ("ann", "Zed", ""), ("u3", "Joanne", "jo@x.com")], "entity string, display string, alias string")
    got = identity.search(e, F.lit("ANN")).collect()
    assert [(r.entity, r["rank"]) for r in got] == [("ann", 0), ("u1", 4), ("u2", 6), ("u3", 7)]
    assert identity.contains(e.withColumn("entity_type", F.lit("user")), "jo", "user").first().entity == "u3"
    assert [a.key(["AzureADDeviceId", "SerialNumber"]) is not None for a in identity.ADAPTERS if a.entity_type == "device"] == [True] * 4


DOC = """{"settings":[{"settingInstance":{"@odata.type":"#x.deviceManagementConfigurationGroupSettingCollectionInstance","settingDefinitionId":"g","groupSettingCollectionValue":[{"children":[
{"@odata.type":"#x.deviceManagementConfigurationChoiceSettingInstance","settingDefinitionId":"c","choiceSettingValue":{"value":"c_1","children":[{"@odata.type":"#x.deviceManagementConfigurationSimpleSettingInstance","settingDefinitionId":"s","simpleSettingValue":{"value":5}}]}}]}]}}],
"assignments":[{"target":{"@odata.type":"#microsoft.graph.groupAssignmentTarget","groupId":"G1","deviceAndAppManagementAssignmentFilterType":"include"}}],"definitionValues":[{"definition":{"id":"adm"},"enabled":true}]}"""


def test_policy_trees(spark):
    docs = spark.createDataFrame([("p", DOC)], "policy_key string, t string").select("policy_key", F.parse_json("t").alias("doc"))
    nodes = policy.tree_nodes(docs, ["policy_key"], "doc")
    s = {r.definition_id: (r.depth, r.kind, r.raw_value) for r in policy.setting_nodes(nodes, ["policy_key"]).collect()}
    assert s == {"g": (0, "group_collection", None), "c": (1, "choice", "c_1"), "s": (2, "simple", "5")}
    options = spark.createDataFrame([("c", "On", "c_1", None, None, None)], "definition_id string, label string, item_id string, option_value string, name string, id string")
    assert {r.label for r in policy.choice_labels(policy.setting_nodes(nodes, ["policy_key"]), options).collect()} == {None, "On"}
    assert policy.assignments(docs, ["policy_key"], "doc").first().assignment_key == "group|G1||include"
    a = policy.admx_values(docs, ["policy_key"], "doc").first()
    assert (a.definition_id, a.enabled) == ("adm", True)
    flat = spark.createDataFrame([("p", '{"id":"1","a":{"b":2,"c":""},"l":[1,2],"e":[]}')], "policy_key string, t string").select("policy_key", F.parse_json("t").alias("doc"))
    props = {r.property: r.value for r in policy.classic_properties(policy.tree_nodes(flat, ["policy_key"], "doc", whole_lists=True), ["policy_key"]).collect()}
    assert props == {"a.b": "2", "l": "[1,2]"}


def test_deep_trees_and_nulls(spark):
    """Depth 200 in rows that hold leaves' values only; nulls have rows, null documents none; kept and whole lists have their value."""
    import json

    deep = 7
    for i in range(200):
        deep = {"a": deep} if i % 2 else [deep]
    docs = spark.createDataFrame([("p", json.dumps(deep)), ("q", '{"n":null,"l":[1,{"x":2}],"e":{},"simpleSettingCollectionValue":[1]}'), ("z", None)], "k string, t string").select("k", F.try_parse_json("t").alias("doc"))
    rows = policy.tree_nodes(docs, ["k"], "doc").withColumn("value", F.to_json("value")).collect()
    p = [r for r in rows if r.k == "p"]
    assert len(p) == 201 and [(r.depth, r.value) for r in p if r.value] == [(200, "7")]
    q = {r.path: (r.type, r.value) for r in rows if r.k == "q"}
    assert q == {"$": ("object", None), "$.n": ("null", "null"), "$.l": ("array", None), "$.l[0]": ("integer", "1"), "$.l[1]": ("object", None), "$.l[1].x": ("integer", "2"), "$.e": ("object", None), "$.simpleSettingCollectionValue": ("array", "[1]"), "$.simpleSettingCollectionValue[0]": ("integer", "1")}
    whole = {r.path: r.value for r in policy.tree_nodes(docs, ["k"], "doc", whole_lists=True).filter("k = 'q'").withColumn("value", F.to_json("value")).collect()}
    assert whole["$.l"] == '[1,{"x":2}]' and "$.l[0]" not in whole


def test_trees_are_told_in_one_task_a_document(spark):
    """Brackets in texts and keys are no depth, and neither trees nor settings of documents that lie by key are shuffled again."""
    text = '{"a\\"{[":"]}\\\\","b":[[{"c":"[{"}],[]],"d":{}}'
    docs = spark.createDataFrame([("p", text), ("s", "5")], "k string, t string").select("k", F.parse_json("t").alias("doc"))
    got = {(r.k, r.path): (r.depth, r.type, r.v) for r in policy.tree_nodes(docs, ["k"], "doc").withColumn("v", F.to_json("value")).collect()}
    assert got == {
        ("p", "$"): (0, "object", None), ("p", '$.a"{['): (1, "string", '"]}\\\\"'), ("p", "$.b"): (1, "array", None), ("p", "$.b[0]"): (2, "array", None), ("p", "$.b[0][0]"): (3, "object", None),
        ("p", "$.b[0][0].c"): (4, "string", '"[{"'), ("p", "$.b[1]"): (2, "array", None), ("p", "$.d"): (1, "object", None), ("s", "$"): (0, "integer", "5"),
    }
    own = spark.createDataFrame([("p", DOC)], "policy_key string, t string").groupBy("policy_key").agg(F.parse_json(F.max("t")).alias("doc"))
    settings = policy.setting_nodes(policy.tree_nodes(own, ["policy_key"], "doc"), ["policy_key"])
    plan = settings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "UnionLoop" not in plan and settings.count() == 3


def test_links_move_owners_of_shared_aliases_only_where_they_are_read(spark):
    """An alias that many own is told by its least and greatest owner; candidates have all of them."""
    at, seen = D(2026, 1, 2), D(2026, 1, 1)
    devices = spark.createDataFrame([("d1", at, None, "u1", "all@x.org"), ("d2", at, "2", None, "all@x.org"), ("d3", at, None, "u3", None), ("d4", at, None, "none", None), ("d5", at, "5", "u3", None)], "device string, captured_at timestamp, user_id string, upn string, mail string")
    obs = spark.createDataFrame([*(("mail", "all@x.org", str(i), seen) for i in range(50)), ("upn", "u1", "1", seen), ("upn", "u3", "3", seen)], "kind string, value string, owner string, observed_at timestamp")
    merged = links.merge_links(links.attempts(devices, obs, spark.range(50).select(F.col("id").cast("string").alias("user_id"))))
    got = {r.device: (r.status, r.user_id, len(r.candidates)) for r in merged.collect()}
    assert got == {"d1": ("ambiguous", None, 50), "d2": ("resolved", "2", 50), "d3": ("resolved", "3", 1), "d4": ("unbound", None, 0), "d5": ("conflicting", None, 2)}
    read = merged.select("device", "status", "user_id")
    assert "owners" not in read._jdf.queryExecution().optimizedPlan().toString()
    assert {r.device: (r.status, r.user_id) for r in read.collect()} == {k: v[:2] for k, v in got.items()}


def test_tied_components_are_taken_alike_on_both_sides(spark):
    """Of rows with one position, both sides take the same, in whatever order they come."""
    side = lambda values: spark.createDataFrame([("p", "setting", "c", v, 1, True) for v in values], "policy_key string, component_type string, component_key string, value string, position int, trusted boolean").coalesce(1)
    modified = spark.createDataFrame([("p",)], "policy_key string")
    assert policy.component_events(side(["x", "y"]), side(["y", "x"]), modified).count() == 0
    assert policy.component_events(side(["x", "y"]), side(["x", "z"]), modified).first().after == "z"


def test_metrics_at_several_grains(spark):
    p = spark.createDataFrame([("y", "a", "s1", "t1", "h"), ("y", "b", "s1", None, ""), ("y", "c", "s2", "t1", None)], "snap string, policy_key string, source string, type string, hash string")
    n = spark.createDataFrame([("y", "a"), ("y", "a"), ("y", "c"), ("y", "unknown")], "snap string, policy_key string")
    got = {(r.level, r.source, r.type): (r.policies, r.eligible, r.settings, r.assignments) for r in policy.metrics_by_grain(p, n, n.limit(0), ["snap"]).collect()}
    assert got[("total", None, None)] == (3, 1, 3, 0) and got[("source", "s1", None)] == (2, 1, 2, 0) and got[("type", None, None)] == (1, 0, 0, 0) and got[("source_type", "s2", "t1")] == (1, 0, 1, 0) and len(got) == 8
    s = spark.createDataFrame([("b", "d1", "choice", 0), ("b", "d2", "simple", 3), ("b", "d2", "simple", 1)], "bundle string, definition_id string, kind string, depth int")
    got = {(r.level, r.kind): (r.nodes, r.max_depth, r.definitions, r.missing_definitions, r.definition_coverage) for r in policy.inspection_by_grain(s, s.limit(1).select("definition_id"), ["bundle"]).collect()}
    assert got == {("total", None): (3, 3, 2, 1, 33.3), ("kind", "choice"): (1, 0, 1, 0, 100.0), ("kind", "simple"): (2, 3, 1, 1, 0.0)}


def test_unexplained_changes(spark):
    none = spark.createDataFrame([("a", "setting", "k", "changed", "1", "2")], "policy_key string, component_type string, component_key string, event string, before string, after string")
    side = lambda h: spark.createDataFrame([("a", h), ("b", h)], "policy_key string, hash string")
    got = {(r.policy_key, r.event, r.before, r.after) for r in policy.explained(none, side("x"), side("x"), side("y")).collect()}
    assert got == {("a", "changed", "1", "2"), ("b", "unexplained_policy_semantic_change", "x", "y")}


def test_policy_comparison(spark):
    schema = "policy_key string, source string, hash string"
    before = spark.createDataFrame([("same", "s", "1"), ("mod", "s", "1"), ("gone", "s", "1"), ("lost", "f", "1"), ("inel", "s", "")], schema)
    after = spark.createDataFrame([("same", "s", "1"), ("mod", "s", "2"), ("new", "s", "1"), ("inel", "s", "1")], schema)
    ok = spark.createDataFrame([("s", "success"), ("f", "error")], "source string, status string")
    d = policy.policy_diff(before, after, ok, ok)
    assert {r.policy_key: r.state for r in d.collect()} == {"same": "unchanged", "mod": "modified", "gone": "removed", "lost": "indeterminate", "new": "added", "inel": "indeterminate"}
    s = policy.comparison_summary(d).first()
    assert (s.status, s.suppressions) == ("partial", 2)
    comp = "policy_key string, component_type string, component_key string, value string, position int, trusted boolean"
    b = spark.createDataFrame([("mod", "setting", "a", "1", 0, True), ("mod", "setting", "a", "2", 1, True), ("mod", "assignment", "x", "1", 0, False)], comp)
    a = spark.createDataFrame([("mod", "setting", "a", "3", 0, True), ("mod", "setting", "n", "1", 1, True), ("mod", "assignment", "y", "1", 0, True)], comp)
    ev = policy.component_events(b, a, d.filter("state = 'modified'")).collect()
    assert {(r.component_key, r.event, r.before, r.after) for r in ev} == {("a", "changed", "2", "3"), ("n", "added", None, "1")}
    meta = "policy_key string, name string, description string, scope_tags array<string>, applicability string"
    m = policy.metadata_events(spark.createDataFrame([("p", "A", "d", ["1", "0"], '{"a":1,"b":2}')], meta), spark.createDataFrame([("p", "B", "d", ["0", "1"], '{"b":2,"a":1}')], meta))
    assert [r.event for r in m.collect()] == ["renamed"]
    issues = policy.contract_issues(spark.createDataFrame([("a", "/x.json"), ("b", "../x.json"), ("c", "p/c.json"), ("c", "p/d.json")], "policy_key string, path string"), spark.createDataFrame([("p/c.json",)], "path string"))
    assert sorted((r.policy_key, r.issue) for r in issues.collect()) == [("a", "absolute path"), ("b", "path outside the bundle"), ("c", "duplicate key"), ("c", "missing document")]
    names = policy.names_asof(spark.createDataFrame([("g1", D(2026, 1, 5)), ("g2", D(2026, 1, 5))], "group_id string, captured_at timestamp"), spark.createDataFrame([("g1", "Old", D(2026, 1, 1)), ("g1", "Now", D(2026, 1, 4)), ("g1", "Later", D(2026, 1, 9))], "group_id string, display string, captured_at timestamp"))
    assert {r.group_id: r.name for r in names.collect()} == {"g1": "Now", "g2": "g2"}


def test_incremental(spark):
    c = spark.createDataFrame([("a", "new"), ("b", "reused"), ("c", "deleted"), ("d", "changed")], "path string, action string")
    r = incremental.accounting(c, spark.createDataFrame([("a", True), ("d", False)], "path string, ok boolean")).first()
    assert (r.discovered, r.parsed, r.reused, r.failed, r.deleted, r.status) == (3, 1, 1, 1, 1, "completed_with_errors")
    occ = spark.createDataFrame([("c", "e1"), ("b", "e2"), ("d", "e3")], "path string, entity string")
    assert {r.entity for r in incremental.affected(occ, c).collect()} == {"e1", "e3"}
    assert incremental.fingerprint(identity.ADAPTERS[0]) != incremental.fingerprint(identity.ADAPTERS[1])


def rows(spark, *dicts):
    names = sorted({k for d in dicts for k in d})
    return spark.createDataFrame([(i, *(d.get(n, "") for n in names)) for i, d in enumerate(dicts)], ", ".join(["row_ix int", *(f"`{n}` string" for n in names)]))


def test_family_rules(spark):
    legacy = {"UserPrincipalName": "u", "RoleName": "r", "RoleState": "Active", "AssignmentSource": "Direct", "SourceGroup": ""}
    stable = legacy | {"AssignmentScheduleId": "s", "UserId": "i"}
    change = lambda f, b, a: sorted(r.change for r in families.compare(rows(spark, *b), rows(spark, *a), f).collect())
    assert change("Entra_Role_Assignments", [legacy], [stable]) == ["Stable"]
    assert change("Entra_Role_Assignments", [legacy], [legacy | {"RoleState": "Eligible"}]) == ["Added", "Removed"]
    assert change("Entra_Role_Assignments", [stable], [stable | {"RoleState": "Eligible"}]) == ["Changed"]
    box = {"ExternalDirectoryObjectId": "m", "FullAccessDelegates": "A;b", "SendAsDelegates": "x", "HasForwarding": "no"}
    assert change("Exchange_SharedMailboxes", [box], [box | {"FullAccessDelegates": "B; a", "SendAsDelegates": "ERROR: no", "HasForwarding": "yes"}]) == ["Stable"]
    device = {"ManagedDeviceId": "d", "UserId": "u", "UserDisplayName": "Old", "LastSyncDateTime": "1"}
    assert change("Intune_ManagedDevices_Compliance", [device], [device | {"UserDisplayName": "New", "LastSyncDateTime": "2"}]) == ["Stable"]
    assert change("Intune_ManagedDevices_Compliance", [device | {"UserId": ""}], [device | {"UserId": "", "UserDisplayName": "New"}]) == ["Changed"]
    pack = {"AccessPackageId": "p", "PolicyId": ""}
    assert change("Entra_Access_Packages", [pack], [pack, pack | {"PolicyId": "q"}]) == ["Added", "Stable"]
    ios = {"EntraDeviceId": "", "UDID": "z", "FreeStorageGB": "1"}
    assert change("Intune_iOS_Devices_Report", [ios], [ios | {"FreeStorageGB": "2"}]) == ["Stable"]
    assert families.key_name("Unknown", ["X", "upn"]) == "upn" and families.key_name("Unknown", ["X"]) == "X"
    d = families.labelled(families.compare(rows(spark, {"GroupId": "g", "UserId": "u", "UserDisplayName": "Ann", "GroupName": "Ops"}), rows(spark, {"GroupId": "h", "UserId": "u", "UserDisplayName": "Ann", "GroupName": ""}), "Entra_Group_User_Memberships"), "Entra_Group_User_Memberships")
    assert {r.change: r.identity for r in d.collect()} == {"Removed": "Ann → Ops", "Added": "Ann → h"}


def test_point_in_time(spark):
    h = spark.createDataFrame([("users", D(2026, 1, 1), "a", "x"), ("users", D(2026, 1, 3), "a", "y"), ("users", D(2026, 1, 3), "b", ""), ("act", D(2026, 1, 2), "a", "z")], "family string, captured_at timestamp, entity string, p string")
    asked = spark.createDataFrame([(e, f) for e in "ab" for f in ("users", "act")], "entity string, family string")
    states = pit.reconstruct(h, asof.for_every_family(h, ["2026-01-02 12:00:00", "2026-01-04 00:00:00"]), asked, ["p"], ["users"])
    got = {(r.entity, r.target.day): r for r in states.collect()}
    assert got["b", 2].presence == "absent" and got["b", 2].properties is None and [c.status for c in got["b", 2].coverage] == ["entity_absent", "entity_absent"]
    assert got["a", 4].coverage[1].gap_seconds == 86400 and [p.value for p in got["a", 4].properties] == ["z", "y"]
    day = lambda d: states.filter(F.dayofmonth("target") == d)
    assert [(r.entity, r.name, r.change) for r in pit.changes_between(day(2), day(4)).collect()] == [("a", "p", "modified")]
    pairs = spark.createDataFrame([("users", "p", D(2026, 1, 3), D(2026, 1, 1), "ok"), ("act", "p", D(2026, 1, 2), None, "single")], "family string, period string, latest timestamp, baseline timestamp, reason string")
    events, notes = pit.period_events(h, pairs, ["p"])
    assert {(r.entity, r.change) for r in events.collect()} == {("a", "modified"), ("b", "added")} and notes.first().note == "single"
    dev = spark.createDataFrame([("a", D(2026, 1, 4), ["d"], "populated")], "user_id string, captured_at timestamp, devices array<string>, coverage string")
    assert {(r.entity, r.target.day): r.device_coverage for r in pit.with_devices(states, dev).collect()}[("a", 4)] == "populated"


def test_policy_reports(spark):
    pol = spark.createDataFrame([("p", "P", "win", "s", "h"), ("q", "Q", "mac", "s", "")], "policy_key string, name string, platform string, source string, hash string").withColumn("snapshot", F.lit(1))
    assigned = spark.createDataFrame([("p", 1), ("p", 1)], "policy_key string, snapshot int")
    settings = spark.createDataFrame([(1, "d1", "choice", 0), (1, "d2", "simple", 2)], "snapshot int, definition_id string, kind string, depth int")
    m = policy.snapshot_metrics(pol, settings, assigned, ["snapshot"]).first()
    assert (m.policies, m.eligible, m.settings, m.assignments) == (2, 1, 2, 2)
    i = policy.inspection(settings, spark.createDataFrame([("d1",)], "definition_id string"), ["snapshot"]).first()
    assert (i.nodes, i.max_depth, i.definition_coverage, i.missing_definitions) == (2, 2, 50.0, 1)
    inv = policy.inventory(pol, spark.createDataFrame([("p", "modified")], "policy_key string, state string"), assigned)
    assert {r.policy_key: (r.state, r.assignments) for r in inv.collect()} == {"p": ("modified", 2), "q": ("unchanged", 0)}
    assert policy.filter_inventory(inv, platform="win", needle="P").count() == 1 and policy.inventory(pol, None, assigned).first().state == "no_baseline"
    ev = spark.createDataFrame([("p", "removed"), ("p", "changed")], "policy_key string, event string")
    named = policy.event_rows(ev, spark.createDataFrame([("p", "Old")], "policy_key string, name string"), spark.createDataFrame([("p", "New")], "policy_key string, name string"))
    assert {r.event: r.policy for r in named.collect()} == {"removed": "Old", "changed": "New"}
    d = spark.createDataFrame([("Added", "k1"), ("Removed", "k2")], "change string, key string")
    assert policy.filter_details(d, "Added", "K1").count() == 1 and policy.filter_details(d, "All", "k").count() == 2


def test_unresolved_rows_of_a_run(spark):
    said = spark.createDataFrame([("a", "new"), ("b", "reused"), ("c", "changed")], "path string, action string")
    done = spark.createDataFrame([("a", True, 3), ("c", False, None)], "path string, ok boolean, unresolved long")
    assert incremental.accounting(said, done).first().asDict() == {"discovered": 3, "parsed": 1, "reused": 1, "failed": 1, "deleted": 0, "unresolved": 3, "status": "completed_with_errors"}
    assert incremental.accounting(said, done.filter("false")).first().unresolved == 0
