from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import cells, predicates
from tidemark.operators import periods


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("value", "want"),
    [("2026-07-24T01:30:00Z", datetime(2026, 7, 24, 1, 30)), ("2026-07-24 01:30:00", datetime(2026, 7, 24, 1, 30)), ("24/07/2026", datetime(2026, 7, 24)), ("24/07/2026 01:30", datetime(2026, 7, 24, 1, 30)), ("soon", None), ("", None), (None, None)],
)
def test_timestamp(spark, value, want):
    assert one(spark, cells.timestamp("c"), c=value) == want


def test_names(spark):
    assert one(spark, cells.family_of("c"), c="Entra_Users_Properties_20260724-013000") == "Entra_Users_Properties"
    assert one(spark, cells.stamp_of("c"), c="A-20260724_013000") == datetime(2026, 7, 24, 1, 30)
    assert one(spark, cells.stamp_of("c"), c="A") is None


def test_tokens(spark):
    assert one(spark, cells.tokens("c"), c=" b; a ;;b") == ["a", "b"]
    assert one(spark, cells.tokens_ordered("c"), c="B; a; b ;A;c") == ["B", "a", "c"]
    assert one(spark, cells.same_tokens("c", "d", fold=True), c="A;b", d="B; a") is True
    assert one(spark, cells.delegate_count("c"), c="a;ERROR: x;b") == 2
    assert one(spark, cells.search_tokens("c"), c="Ann.B_c-d@x  Y") == ["ann", "b", "c", "d", "x", "y"]


def test_keys(spark):
    assert one(spark, cells.key_all("c", "d"), c="a", d=" ") is None
    assert one(spark, cells.key_all("c", "d"), c="a", d="b") == "a\u001fb"
    assert one(spark, cells.key_first("c", "d"), c=" ", d="b") == "b"
    assert one(spark, cells.key_optional("c", "d"), c="a", d="") == "a"
    assert one(spark, cells.key_last_optional("c", "d"), c="a", d="") == "a\u001f"
    assert one(spark, cells.key_last_optional("c", "d"), c="", d="a") is None


def test_normal_forms(spark):
    g = "AAAAAAAA-0000-1111-2222-BBBBBBBBBBBB"
    assert one(spark, cells.guid("c"), c=f" {g} ") == g.lower() and one(spark, cells.guid("c"), c="N/A") == ""
    assert one(spark, cells.serial("c"), c=" AB  1\t2 ") == "ab 1 2" and one(spark, cells.serial("c"), c="Unknown") == ""
    assert one(spark, cells.whole("c"), c="3.9") == 3 and one(spark, cells.whole("c", strict=True), c="3.9") is None
    assert one(spark, cells.canonical_json(F.col("c")), c='{"b": 1, "a": [1.50, {"d": null}]}') == '{"a":[1.5,{"d":null}],"b":1}'
    assert one(spark, cells.scope_map("c")["B"], c="A: 1 / B: 2") == "2"
    assert one(spark, cells.row_scope(["A", "B"], [F.col("c"), F.col("d")]), c="1", d="") == "A: 1"
    assert one(spark, cells.status_known("c"), c="404") is False and one(spark, cells.status_known("c", missing_is_known=True), c="404") is True
    assert one(spark, cells.role_path("c", "d", F.lit("G")), c="Active", d="Direct") == "Active · via G"
    assert one(spark, cells.retrieval_status(F.split("c", ";")), c="error;success") == "partial"


def test_rules(spark):
    for kind, value, cell, want in [("blank", "", " ", True), ("nonblank", "", "x", True), ("contains", "EL", "hello", True), ("contains_any", ["q", "lo"], "hello", True), ("startswith", "he", "Hello", True), ("eq0", "", "0.0", True), ("eq0", "", "x", False), ("gt0", "", "3", True)]:
        assert one(spark, predicates.rule("c", kind, value), c=cell) is want
    df = spark.createDataFrame([("10",), ("9",), ("1,000",), ("b",), ("A",), ("-2.5",)], "c string")
    assert [r.c for r in df.orderBy(*predicates.mixed_order("c")).collect()] == ["-2.5", "9", "10", "1,000", "A", "b"]
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, "b")], "i int, c string")
    assert sorted(r.i for r in predicates.first_of_each(rows, "c", "i").collect()) == [1, 4]


def test_calendar(spark):
    at = lambda t, n: [str(d) for d in one(spark, periods.business_days(F.lit(t).cast("timestamp"), n))]
    assert at("2026-07-28 12:00:00", 3) == ["2026-07-24", "2026-07-27", "2026-07-28"]
    assert at("2026-07-28 00:30:00", 2) == ["2026-07-24", "2026-07-27"]


def test_run_health_of_late_runs(spark):
    stamps = ["2026-07-24 01:30:00", "2026-07-27 08:15:00", "2026-07-28 01:15:00"]
    df = spark.createDataFrame([("f", datetime.fromisoformat(s)) for s in stamps], "family string, captured_at timestamp")
    r = periods.run_health(df, F.lit("2026-07-28 12:00:00").cast("timestamp"), 3).first()
    assert (r.expected, r.observed, r.missing, r.late, r.status) == (3, 3, 0, 1, "Completed late")


def test_baseline_at_cutoff(spark):
    df = spark.createDataFrame([("f", datetime(2026, 7, 1)), ("f", datetime(2026, 7, 8))], "family string, captured_at timestamp")
    r = {x.period: x for x in periods.period_pairs(df, F.lit("2026-07-08 00:00:00").cast("timestamp")).collect()}
    assert r["7 days"].baseline == datetime(2026, 7, 1) and r["7 days"].reason == "ok" and r["15 days"].reason == "no_baseline"


def test_membership_and_delegation(spark):
    df = spark.createDataFrame([("Unified; DynamicMembership", "Error: x", " a ;b"), ("Unified", "ERROR: x", ""), (None, None, None)], "t string, f string, s string")
    got = df.select(cells.membership_type("t"), cells.has_delegates("f", "s")).collect()
    assert [tuple(r) for r in got] == [("Dynamic", True), ("Assigned", False), ("Assigned", False)]
