"""The pipeline's stages, each against what it should keep, and on awkward rows."""

import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tidemark.llm import mixing, pii, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(1, "you are an idiot and a moron", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "call +1 (212) 555-0100 now or later please", "en", "b", 4), (5, "call +1 (212) 555-0100 now or later please", "en", "b", 4), (5, "call +1 (212) 555-0100 now or later please", "en", "b", 4), (None, "no id", "en", "b", 4), (6, "w " * 50_000, "en", "c", 1)]
    return spark.createDataFrame(rows, DOCS).select("*", *(F.lit(0).alias(c) for c in ("score", "size", "copies", "fingerprint", "kept_id", "copy")))


def test_stage_names():
    assert [n for n, _ in C.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "mixing", "sentencepiece"] and C.ORACLE_SQL is None


def test_toxic_rows_go_and_clean_ones_stay(spark, sf, documents):
    kept = {r.doc_id for r in C.reject_toxic(spark, documents, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r.doc_id: r.predicted for r in toxicity.score(documents, toxicity.fit(documents, labels)).collect()}
    assert kept == {i for i, p in scores.items() if not p}
    assert all(r.doc_id in kept for r in labels.filter("toxic = 0").collect())


def test_one_of_each_group_stays(spark, sf, documents):
    """Groups are those of five words and a similarity of 0.8, not op5's of three words; test_near_copies holds them against all pairs."""
    kept = sorted(r.doc_id for r in C.near_dedup(spark, documents, sf).collect())
    assert kept == sorted({r.component_id for r in simhash.near_copies(documents).collect()})


def test_the_right_text_of_a_repeated_id_stays(spark, sf):
    """A copy of another document goes and a unique text stays, though both have one id; a nameless copy goes, a nameless original stays."""
    a, b = "one two three four five six seven", "quite another text of seven words here"
    rows = [(1, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (5, b, "fr", "s", 1), (None, a, "en", "s", 1), (None, "nobody else has this", "en", "s", 1), (None, "nobody else has this", "en", "s", 1)]
    for order in (rows, rows[::-1]):
        got = C.near_dedup(spark, spark.createDataFrame(order, DOCS), sf).collect()
        assert sorted((r.doc_id or 0, r.text, r.lang) for r in got) == [(0, "nobody else has this", "en"), (1, a, "en"), (5, b, "en")]


def test_spans_are_replaced(spark, sf, documents):
    before = {r.doc_id: r.text for r in documents.collect()}
    after = {r.doc_id: r for r in C.redact_pii(spark, documents, sf).collect()}
    assert set(before) == set(after)
    for i, t in before.items():
        assert not list(pii.base_spans(after[i].text)) or not list(pii.base_spans(t)), i
        assert after[i].n_chars == len(after[i].text) and (list(pii.base_spans(t)) or list(pii.loose_spans(t)) or after[i].text == t)


def test_mix_takes_copies(spark, sf, documents):
    got = collections.Counter(r.doc_id for r in C.mix_sources(spark, documents, sf).select("doc_id").collect())
    want = {r.doc_id: r.copies for r in mixing.mix(documents, F.array("source"), mixing.n_words(F.col("text"))).collect() if r.copies}
    assert got == want


def test_run_ends_with_round_trips(spark, sf):
    got = C.run(spark, sf)
    assert got.count() > 0 and got.filter("not round_trip").count() == 0 and got.groupBy("doc_id", "sample").agg(F.count_distinct("ids").alias("n")).filter("n > 1").count() == 0


def test_stages_on_awkward_rows(spark, sf, awkward):
    kept = C.reject_toxic(spark, awkward, sf)
    assert 1 not in {r.doc_id for r in kept.collect()} and kept.count() == 7
    deduped = C.near_dedup(spark, awkward, sf)
    assert sorted((r.doc_id for r in deduped.collect()), key=str) == [1, 2, 4, 6, None]
    clean = {r.doc_id: r.text for r in C.redact_pii(spark, awkward, sf).collect()}
    assert clean[4] == "call <phone> now or later please" and clean[2] is None
    mixed = C.mix_sources(spark, awkward, sf).collect()
    assert {r.doc_id for r in mixed} >= {2, 3} and max(collections.Counter(r.doc_id for r in mixed).values()) <= 4
    assert len({r.doc_id for r in C.encode_pieces(spark, awkward, sf).collect()}) == 7
    assert all(re.fullmatch("[a-z_]+", n) for n, _ in C.STAGES)
    for _, stage in C.STAGES:
        assert stage(spark, awkward.limit(0), sf).count() == 0
    for _, stage in C.STAGES[:4]:
        assert stage(spark, awkward, sf).columns == C.DOCUMENTS


def test_a_run_leaves_only_its_last_table(spark, sf):
    from tidemark.llm import common

    before = list(common.WRITTEN)
    kept = common.stored(spark.range(2), "kept")
    got = C.run(spark, sf)
    assert common.WRITTEN[: len(before)] == before and len(common.WRITTEN) == len(before) + 1 and kept.count() == 2
    assert got.select("doc_id").distinct().count() > 0
