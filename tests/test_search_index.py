"""The search index against direct reading of all names, through runs, losses and a vacuum."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import grams, identity
from tidemark.streaming.search_index import NAMES, SearchIndex

RUN = "path string, action string"
BAD = "path string, message string"


@pytest.fixture
def index(spark, tmp_path):
    return SearchIndex(spark, f"file://{tmp_path}/index")


def update(spark, index, batch, said, names, failed=()):
    return index.update(batch, spark.createDataFrame(said, RUN), spark.createDataFrame(names, NAMES), spark.createDataFrame(list(failed), BAD))


def asked(spark, index, needles, k=50):
    asks = spark.createDataFrame(needles, "q int, needle string")
    return sorted((r.q, r.place, r.entity, r["rank"], r.display) for r in index.search(asks, "q", "needle", k).collect())


def plainly(names, needles, k=50):
    """Ranks by reading every name for every needle."""
    import re

    out = []
    for q, needle in needles:
        n, best = (needle or "").lower(), {}
        for _, entity, alias, display in names if n and q is not None else ():
            e, a, d = ((x or "").strip(" ").lower() for x in (entity, alias, display))
            tokens = [t for t in re.split(r"[@._\-\s]+", f"{a} {d}") if t]
            tests = [e == n, a == n, d == n, e.startswith(n), a.startswith(n), d.startswith(n), any(t.startswith(n) for t in tokens), n in f"{e} {a} {d}"]
            if any(tests):
                rank, shown = best.get(entity, (9, None))
                best[entity] = min(rank, tests.index(True)), min(x for x in (shown, display) if x is not None)
        order = sorted(best.items(), key=lambda x: (x[1][0], x[1][1].lower(), x[0]))
        out += [(q, i, e, r, d) for i, (e, (r, d)) in enumerate(order[:k], 1)]
    return sorted(out)


def test_empty_index_and_needles(spark, index):
    assert asked(spark, index, [(1, "a"), (2, "abcd"), (3, ""), (4, None)]) == []
    update(spark, index, "one", [("f", "new")], [("f", "E1", None, "Ann"), ("f", "", "", "")])
    assert asked(spark, index, [(1, ""), (2, None), (None, "ann"), (3, "ANN"), (4, "n"), (5, "zzz"), (6, "annx")]) == [(3, 1, "E1", 2, "Ann"), (4, 1, "E1", 7, "Ann")]


def test_random_names_through_runs(spark, index):
    r = random.Random(5)
    word = lambda: "".join(r.choice("aAbB.@ é") for _ in range(r.randint(0, 7)))
    rows = lambda path, n: [(path, f"e{r.randint(0, 30)}", word(), word() + "d") for _ in range(n)]
    live = {p: rows(p, 40) for p in "abc"}
    needles = [(i, word()) for i in range(60)] + [(60, "e1"), (61, "e"), (62, "éé"), (63, "d")]
    update(spark, index, "one", [(p, "new") for p in "abc"], sum(live.values(), []))
    assert asked(spark, index, needles, 5) == plainly(sum(live.values(), []), needles, 5)

    live = {"b": rows("b", 30), "c": live["c"], "d": live["a"][:20]}  # d repeats names of a file that goes
    live["d"] = [("d", *x[1:]) for x in live["d"]]
    run = "two", [("a", "deleted"), ("b", "changed"), ("c", "changed"), ("d", "new")], live["b"] + rows("c", 9) + live["d"], [("c", "unreadable")]
    assert update(spark, index, *run) == 2 and update(spark, index, *run) == 2
    whole = plainly(sum(live.values(), []), needles)
    assert asked(spark, index, needles) == whole
    fresh = SearchIndex(spark, index.folder + "-anew")
    update(spark, fresh, "all", [(p, "new") for p in live], sum(live.values(), []))
    assert asked(spark, fresh, needles) == whole
    assert index.vacuum() == 2 and len(index.parts()) == 1 and asked(spark, index, needles) == whole
    same = lambda i: sorted(map(tuple, i.counts().collect()))
    assert same(index) == same(fresh)


def test_repeated_names_are_posted_once(spark, index):
    update(spark, index, "one", [("f", "new")], [("f", "E1", "a@x", "Ann")])
    update(spark, index, "two", [("g", "new")], [("g", "E1", "a@x", "Ann"), ("g", "E2", "b@x", "Bob")])
    assert sorted(r.text for r in index.postings().filter("gram is null").collect()) == ["e1 a@x ann", "e2 b@x bob"]
    update(spark, index, "three", [("f", "deleted")], [])
    assert [x[2] for x in asked(spark, index, [(1, "a@x")])] == ["E1"]


def test_a_lost_run_leaves_names_searchable(spark, index, monkeypatch):
    update(spark, index, "one", [("f", "new")], [("f", "E1", "a@x", "Ann")])
    with monkeypatch.context() as m:
        m.setattr(index.names, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            update(spark, index, "two", [("g", "new")], [("g", "E2", "b@x", "Bob")])
    assert asked(spark, index, [(1, "bob")]) == []
    update(spark, index, "three", [("h", "new")], [("h", "E2", "b@x", "Bob")])  # relies on what the lost run posted
    update(spark, index, "two", [("g", "new")], [("g", "E3", "c@x", "Bobby")])
    assert [x[2] for x in asked(spark, index, [(1, "bob")])] == ["E2", "E3"]


def test_many_names_with_common_runs(spark):
    names = [(f"e{i}", "common", f"common {i}") for i in range(300)]
    e = spark.createDataFrame(names, "entity string, alias string, display string")
    asks = spark.createDataFrame([(1, "common 29"), (2, "co"), (3, "comma")], "q int, needle string")
    got = sorted((r.q, r.place, r.entity) for r in identity.search_many(e, asks, "q", "needle", 12).collect())
    assert got == [x[:3] for x in plainly([("", *n) for n in names], [(1, "common 29"), (2, "co"), (3, "comma")], 12)]
    assert len(spark.range(1).select(grams.runs(grams.F.lit("ab"))).first()[0]) == 2


def test_many_needles_meet_what_holds_them_alone(spark, tmp_path):
    """Needles whose runs are all common meet no more names than hold them, in a search of many and in an index."""
    e = spark.createDataFrame([(str(i), f"a{i}@x", f"Name {i:04d}") for i in range(200)], "entity string, alias string, display string")
    needles = [("q1", "name 0012"), ("q2", "NAME 0012"), ("q3", "e 01"), ("q4", "7@"), ("q5", "x"), ("q6", "absent"), ("q7", None), ("q8", ""), *((f"n{i}", f"a{i}@x name") for i in range(100))]
    common = "@x name 0"
    needles += [(f"c{i}-{j}", common[i:j]) for i in range(len(common)) for j in range(i + 3, len(common) + 1)]
    asks = spark.createDataFrame(needles, "q string, n string")
    texts = e.withColumn("t", identity.searched())
    own = asks.select(F.lower("n").alias("n")).filter("n <> ''").distinct()
    met = grams.pieces(texts, "t", own, "n").select("entity", "n").distinct().collect()
    assert sorted(map(tuple, met)) == sorted((r.entity, n.n) for r in texts.collect() for n in own.collect() if n.n in r.t)
    want = sorted(map(tuple, identity.search_many(e, asks, "q", "n", 12).select("q", "entity", "rank", "place").collect()))
    assert {q for q, *_ in want} == {q for q, _ in needles} - {"q6", "q7", "q8"} and all(p <= 12 for *_, p in want)
    index = SearchIndex(spark, f"file://{tmp_path}/index")
    files = spark.createDataFrame([("f", "new")], "path string, action string")
    index.update("one", files, e.withColumn("path", F.lit("f")), files.limit(0).select("path", F.lit("").alias("message")))
    found = index.search(asks, "q", "n", 12)
    assert sorted(map(tuple, found.select("q", "entity", "rank", "place").collect())) == want
    assert not any("/postings/" in f for f in found.inputFiles())
    few = index.search(asks.filter("q = 'n7'"), "q", "n", 12)
    assert any("/postings/" in f for f in few.inputFiles()) and few.count() == 1
