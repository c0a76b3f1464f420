"""Each operator against a brute-force version, a round trip or held-out labels, and on awkward rows."""

import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import merkle, mixing, pieces, pii, quality, queries, simhash, tokens, topk, toxicity, warc

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000 + "x" * 50_000
AWKWARD = [
    (1, "You are an idiot. Mail me: a.b@example.com", "en", "s1", 1), (2, None, None, None, None), (3, "", "en", "s1", 0), (4, LONG, "en", "s2", 5), (5, "same words here again", "en", "s1", 3), (6, "same words here again", "en", "s2", 3),
    (6, "same words here again", "en", "s2", 3), (7, " \n\t ", "fr", None, 1), (None, "no id at all", "fr", "s3", 1), (8, "naïve ☃ text 中文 ▁ end", "fr", "s3", 1), (9, "one", None, "s1", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward rows with further columns whose names clash with those that operators make."""
    df = spark.createDataFrame(AWKWARD, DOCS)
    clash = ["score", "predicted", "fingerprint", "component_id", "hash", "part", "size", "copies", "ids", "sample", "spans", "bucket", "key", "mark", "x", "start", "behind", "value", "kept", "pattern"]
    return df.select("*", *(F.lit("clash").alias(c) for c in clash))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (3, 0, 0), (5, 1, 0), (5, 1, 0), (9, 0, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda x: (x[0] is None, x[0] or 0))


# --- toxicity


def test_grammar_weighs_clauses_not_words():
    s = toxicity.Scorer({"blorg": 1.0})
    value = lambda t: sum(m[2] for m in s.matches(t))
    assert value("you are an idiot") > value("an idiot came") > value("he said you are an idiot") > 0
    assert value("you are not an idiot") < value("an idiot came") / 2
    assert value("nothing here") == 0 and value("idiotically") == 0
    for alone in ("idiot", "kill", "blorgish", "Idiot!", "fine idiot yesterday", "kill yesterday", "idiot.\nmoron."):
        assert value(alone) == 0, alone
    assert value("kill the bug") == 0 < value("kill you") == value("I will kill you") and value("do not kill them") < value("kill them") / 2
    assert value("idiot, you") == value("you idiot") > value("the idiot") > value("idiot of mine") > 0
    assert value("moron idiot") > 0 and value("the blorgish") == value("the idiot")
    assert value("not at all of this is near the idiot") == pytest.approx(value("the idiot"))
    assert len(list(s.matches("the idiot. fine. a moron, loser\nyou clown"))) == 3
    assert value("IDIOT!! OF!! ALL!!") > 0


def test_composed_machine_equals_its_parts():
    """Reading a clause with the composed machine is reading it with one transducer after the other."""
    scope, forwards, _ = toxicity.grammar()
    both, rng = toxicity.compose(scope, forwards, toxicity.SYMBOLS), np.random.default_rng(0)
    for _ in range(300):
        p, q, r = both.start, scope.start, forwards.start
        for symbol in rng.choice(list(toxicity.SYMBOLS), 12):
            out, f, p = both.step(p, symbol)
            mid, g, q = scope.step(q, symbol)
            last, h, r = forwards.step(r, mid)
            assert out == last and f == pytest.approx(g * h)


def test_toxicity_finds_held_out_labels(spark, sf):
    got = {r.doc_id: r for r in queries.op1_toxicity(spark, sf).collect()}
    docs, own = table(spark, sf, "documents"), table(spark, sf, "labels").collect()
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(got[r.doc_id].predicted, r.toxic) for r in own if r.doc_id in got and got[r.doc_id].held_out and r.toxic is not None]
    assert sum(p == t for p, t in held) / len(held) > 0.9
    assert not any(p and not t for p, t in held)


def test_toxicity_awkward(spark, docs, empty, labels):
    m = toxicity.fit(docs, labels)
    got = toxicity.score(docs, m).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in AWKWARD)
    assert len({r.score for r in got if r.doc_id in (2, 3, 7)}) == 1
    assert toxicity.score(empty, m).count() == 0
    assert 0 <= toxicity.score(docs, toxicity.fit(empty, labels.limit(0))).first().score <= 1
    assert toxicity.clauses(docs, m).filter("doc_id = 1").count() == 1


# --- WARC


def test_warc_against_sql(spark, sf):
    import duckdb

    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op2_warc(spark, sf).collect()}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    assert got == {r[0]: tuple(r[1:]) for r in con.execute(queries.OP2).fetchall()}


def test_warc_awkward(spark, tmp_path):
    rows = [(3, "http://a", "<p>x</p>"), (1, "http://b c", "<p>x</p>"), (2, None, None), (5, "", ""), (5, "", ""), (None, "http://d", "WARC/1.0\r\n\r\n\r\nWARC/1.0 filedesc://\n"), (9, "http://l", "é" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    warc.write_arc(pages, f"{tmp_path}/arc")
    arcs = warc.read_arc(spark, f"{tmp_path}/arc").collect()
    assert sorted((r.page_id is None, r.page_id or 0, bytes(r.payload)) for r in arcs) == sorted((i is None, i or 0, (h or "").encode()) for i, _, h in rows)
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    got = warc.page_records(spark, f"{tmp_path}/warc").collect()
    assert len(got) == len(rows) and all(r.digests_ok for r in got)
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == {(1, "response", None): 1, (3, "revisit", 1): 1, (2, "response", None): 1, (5, "revisit", 2): 2, (None, "response", None): 1, (9, "response", None): 1}
    again = warc.read_warc(spark, f"{tmp_path}/warc").filter("record_type = 'response'")
    assert {bytes(r.payload) for r in again.collect()} == {(h or "").encode() for _, _, h in rows}
    warc.write_arc(pages.limit(0), f"{tmp_path}/none")
    assert warc.read_arc(spark, f"{tmp_path}/none").count() == 0


def test_arc_versions_and_lengths():
    for v in (1, 2):
        data = (warc.arc_head(v, "20080430204825") + "\n" + warc.arc_text(v, 7, "http://x/ y", "a\n\nb", "20080430204825") + "\n").encode()
        (r,) = warc.parse_arc(data, "f")
        assert (r["version"], r["page_id"], r["payload"], r["status"], r["url"]) == (v, 7, b"a\n\nb", 200, "http://x/y")
        with pytest.raises(ValueError):
            list(warc.parse_arc(data[:-4], "f"))
    assert warc.iso_date("20080430204825") == "2008-04-30T20:48:25Z" and warc.iso_date("2008") == "2008-01-01T00:00:00Z"


# --- token ids


@given(st.lists(st.integers(0, 1 << 20), max_size=200), st.integers(21, 32))
@settings(max_examples=50, deadline=None)
def test_pack_round_trip(ids, bits):
    x = np.array(ids, np.uint32)
    data = tokens.pack(x, bits)
    assert len(data) == (len(x) * bits + 7) // 8 and tokens.unpack(data, bits, 0, len(x)).tolist() == ids
    assert tokens.unpack(data, bits, len(x) // 3, len(x) // 2).tolist() == ids[len(x) // 3 :][: len(x) // 2]


def test_pack_narrow():
    assert [tokens.bits_for(n) for n in (2, 3, 256, 257, 50257)] == [1, 2, 8, 9, 16]
    with pytest.raises(ValueError):
        tokens.pack(np.array([8]), 3)


def brute_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids


def test_tokens_brute_force(spark, sf):
    got = {r.doc_id: r for r in queries.op3_tokens(spark, sf).collect()}
    at = 0
    for i, t in pairs(table(spark, sf, "documents")):
        ids = [*brute_ids(t), 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_tokens_awkward(spark, docs, empty, tmp_path):
    for n, df in enumerate((docs, empty)):
        tokens.write(df, f"{tmp_path}/{n}", P.path("byte_bpe_50k.json"), block_ids=50)
    got = tokens.read_documents(spark, f"{tmp_path}/0").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    text = {r[0]: r[1] for r in AWKWARD}
    assert all(r.ids == [*brute_ids(text[r.doc_id]), 0] for r in got)
    assert tokens.read_documents(spark, f"{tmp_path}/1").count() == 0


@given(st.lists(st.sampled_from(["a", "é", "α", "²", "5", "'s", " ", "  ", "\n", "\t", "!", "_", "क", "़", "<|endoftext|>", "\x1c", "\xa0", "中", ".", "×", "ÿ", "ɏ", "ʼ", "\u0301", "“", "\u2003", "\u3000", "\x85", "'", "٣", "Ⅳ", "I'll", "abcdefghijklmnopqrstuvwxyz", "\0", "7z"]), max_size=30))
@settings(max_examples=600, deadline=None)
def test_units_encode_as_whole(parts):
    e = tokens.encoder(P.path("byte_bpe_50k.json"))
    text = "".join(parts)
    assert e([text])[0].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


# --- PII


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@given(st.text(alphabet="ab1.2@3+ -()9%4\n", max_size=80))
@settings(max_examples=500, deadline=None)
def test_base_spans(text):
    assert sorted(pii.base_spans(text), key=lambda s: (s[1], pii.KINDS.index(s[0]))) == plain_spans(text)


def test_pii_query_brute_force(spark, sf):
    got = {r.doc_id: r for r in queries.op4_pii(spark, sf).collect()}
    for i, t in pairs(table(spark, sf, "documents")):
        base, r = plain_spans(t or ""), got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        said = [f"{k}:{b}:{e}" for k, b, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert collections.Counter(said) <= collections.Counter(r.spans.split(","))


def planted_pii(n=900, seed=11):
    """(texts, spans that no base pattern finds, decoys): numbers beside numbers, invalid first parts, numbers that fail the check."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))

    def card(valid):
        while True:
            d = "4" + "".join(map(str, rng.integers(0, 10, 15)))
            if pii.luhn(d) == valid:
                return d

    phone = lambda: f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"
    quad = lambda: ".".join(map(str, rng.integers(1, 256, 4)))
    texts, hidden, decoys = [], [], []
    for i in range(n):
        made, own, bad = [(word(), None)], [], []
        kind = i % 6
        if kind == 0:
            made += [(phone(), "phone"), (str(rng.integers(10**6, 10**7)), None)]
        elif kind == 1:
            made += [(card(True), "card"), (card(True), "card")]
        elif kind == 2:
            made += [(card(False), "bad")]
        elif kind == 3:
            made += [("version", None), (f"{rng.integers(300, 999)}.{quad()}", "ip")]
        else:
            made += [(phone(), None), (word(), None), (card(True), None), (word(), None), (quad(), None), (word(), None), (f"{word()}@{word()}.com", None)]
        made.append((word(), None))
        text = ""
        for x, k in made:
            begin = len(text) + (x.index(".") + 1 if k == "ip" else 0)
            if k:
                (bad if k == "bad" else own).append((i, "card" if k == "bad" else k, begin, len(text) + len(x)))
            text += x + " "
        texts.append(text)
        hidden += own
        decoys += bad
    return texts, set(hidden), set(decoys)


def test_added_spans_on_planted_documents(spark):
    texts, hidden, decoys = planted_pii()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, s.kind, s.begin, s.end): s.base for r in pii.find(docs).collect() for s in r.spans}
    added = {k for k, base in got.items() if not base}
    assert {k for k, base in got.items() if base} == {(i, *s) for i, t in enumerate(texts) for s in plain_spans(t)}
    assert len(added & hidden) / len(added) > 0.95 and len(added & hidden) / len(hidden) > 0.9 and not added & decoys
    model = pii.train(pii.pattern_counts(pii.candidates(docs)))
    right = {name: yes[2] - no[2] for name, no, yes in zip(pii.LABELERS, *model.reliability["card"], strict=True)}
    assert right["check"] > 0.9 > right["layout"] and right["check"] > right["cue"] + 0.5


@given(st.text(alphabet="ab1.2@3+ -()9%4_/\n", max_size=120))
@settings(max_examples=400, deadline=None)
def test_candidates_overlap_nowhere(text):
    by = collections.defaultdict(list)
    for k, b, e, base, v in pii.candidates_of(text):
        by[k].append((b, e))
        assert 0 <= b < e <= len(text) and len(v) == len(pii.LABELERS)
    assert all(x[1] <= y[0] for own in by.values() for x, y in zip(own, own[1:], strict=False))


def test_em_learns_reliabilities():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.4
    acc, counts = [0.9, 0.8, 0.7, 0.95], collections.Counter()
    for t in truth:
        counts["".join("+" if (rng.random() < a) == t else "-" for a in acc)] += 1
    prior, share, post = pii.expectation_maximisation(counts)
    assert abs(prior - 0.4) < 0.03 and np.allclose(share[1, :, 2], acc, atol=0.04) and post["++++"] > 0.99 > 0.1 > post["----"]


def test_pii_awkward(spark, docs, empty):
    found = pii.digests(pii.find(docs)).collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter(r[0] for r in AWKWARD)
    assert next(r for r in found if r.doc_id == 1).spans == "email:27:42"
    assert pii.find(empty).count() == 0
    clean = {r.doc_id: r.text for r in pii.redact(docs, ["doc_id", "text"]).collect()}
    assert clean[1].endswith("Mail me: <email>") and clean[2] is None and clean[3] == "" and clean[4] == LONG
    assert pii.redact(empty, ["doc_id", "text"]).count() == 0
    assert [k for k, *_ in pii.candidates_of("write to jane (at) example (dot) com")] == ["email"]


# --- SimHash


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    best = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        best[find(i)].append(d)
    return [min((x for x in best[find(i)] if x is not None), default=None) for i in range(len(rows))]


def test_simhash_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(i, brute_fingerprint(t)) for i, t in pairs(docs)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash(spark, sf).collect()}
    assert got == {i: (f"{f:016x}", c) for (i, f), c in zip(rows, brute_components(rows), strict=True)}


def test_simhash_awkward(spark, docs, empty):
    rows = [(r[0], brute_fingerprint(r[1])) for r in AWKWARD]
    got = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == collections.Counter((i, f"{f:016x}", c) for (i, f), c in zip(rows, brute_components(rows), strict=True))
    assert simhash.near_duplicates(empty).count() == 0


def cluster(n=400, seed=5):
    rng = np.random.default_rng(seed)
    centre = int(rng.integers(0, 2**63))
    out = {int(x) for x in rng.integers(0, 2**63, n)}
    for f in [centre] * n + list(out)[: n // 2]:
        for _ in range(int(rng.integers(1, 5))):
            f ^= 1 << int(rng.integers(0, 64))
        out.add(f)
    return sorted(out)


def test_links_in_dense_clusters(spark):
    fps = cluster()
    want = brute_components(list(enumerate(fps)))
    rows = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fingerprint long")
    at = {int(np.uint64(f).astype(np.int64)): i for i, f in enumerate(fps)}
    for bits, hot in ((12, 1 << 16), (4, 100)):  # the second deals full buckets out anew
        pairs_ = simhash.near_links(rows, bucket_bits=bits, hot_bucket=hot).collect()
        assert all((fps[at[r.a]] ^ fps[at[r.b]]).bit_count() <= 3 for r in pairs_)
        root = list(range(len(fps)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for r in pairs_:
            a, b = find(at[r.a]), find(at[r.b])
            root[max(a, b)] = min(a, b)
        assert [find(i) for i in range(len(fps))] == want


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


# --- top-k


def brute_topk(rows, k=10, every=100):
    own = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(1024 * float(np.float32(x))) for x in v]
        own[i] = min(own.get(i, q), q)
    out = []
    for i in own:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(own[i], v, strict=False)), j) for j, v in own.items() if j != i)[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_topk_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in queries.op6_topk(spark, sf).collect()) == brute_topk(rows)


def test_topk_awkward(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(1, 230)]
    rows += [(0, [1.0] * 6), (300, [0.5] * 6), (300, [0.5] * 6), (400, None), (500, [1.0, None]), (600, [float("nan")]), (700, [float("inf")]), (800, []), (900, [2.0]), (None, [1.0])] + [(i, [9.0] * 6) for i in range(1001, 1040)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).repartition(5)
    got = topk.search(df, F.col("vec_id") % 100 == 0)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute_topk(rows)
    assert topk.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.search(df.filter("vec_id in (0, 1)"), F.col("vec_id") % 100 == 0).count() == 1


def test_topk_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 7)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) if x > 0 else 0.0 for x in rng.normal(size=8).astype(np.float32)]) for i in range(60)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 5 == 0, k=4)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute_topk(rows, 4, 5)


# --- quality


def test_quality_finds_held_out_labels(spark, sf):
    got = {r.doc_id: r for r in queries.op7_quality(spark, sf).collect()}
    own = table(spark, sf, "labels").collect()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.quality, got[r.doc_id].score) for r in own if got[r.doc_id].held_out]
    assert sum((s >= 0.5) == (y == 1) for y, s in held) / len(held) > 0.9


def test_discriminant_matches_densities():
    rng = np.random.default_rng(0)
    p = len(quality.NAMES)
    x = {y: rng.normal(size=(4000, p)) @ (np.eye(p) + rng.normal(size=(p, p)) * 0.5) * (1 + y) + y for y in (0, 1)}
    m = quality.discriminant({y: (len(z), z.sum(0), z.T @ z) for y, z in x.items()})
    z, want = rng.normal(size=(20, p)), []
    for r in z:
        d = []
        for y in (0, 1):
            c = np.cov(x[y].T, bias=True)
            d.append(-0.5 * (r - x[y].mean(0)) @ np.linalg.solve(c, r - x[y].mean(0)) - 0.5 * np.linalg.slogdet(c)[1])
        want.append(d[1] - d[0])
    assert np.corrcoef(m.log_odds(z), want)[0, 1] > 0.99 and all(0 < s < 0.2 for s in m.shrinkage)


def test_quality_awkward(spark, docs, empty, labels):
    got = quality.classify(docs, labels).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1 and len({r.score for r in got if r.doc_id in (5, 6)}) == 1
    assert quality.classify(empty, labels).count() == 0
    assert len(quality.classify(docs, labels.limit(0)).collect()) == len(AWKWARD)


# --- SentencePiece


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary(P.path("piece_bpe_32k.model"))


def all_segmentations(text, v):
    own = {t: i for i, (t, k) in enumerate(zip(v.text, v.kind, strict=True)) if k == "piece"}

    def rec(i):
        if i == len(text):
            yield (), 0.0
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in own:
                for r, s in rec(j):
                    yield (own[text[i:j]], *r), s + v.logp[own[text[i:j]]]
            elif j == i + 1:
                for r, s in rec(j):
                    yield (-1 - ord(text[i]), *r), s + v.byte_logp * len(text[i].encode())

    out = dict(rec(0))
    z = np.logaddexp.reduce(list(out.values()))
    return {k: math.exp(s - z) for k, s in out.items()}


def test_sampling_law_without_replacement(vocab):
    text, n, k = "▁the▁in☃er", 12_000, 3
    law = all_segmentations(text, vocab)
    la, found = pieces.sample_batch([text] * n, [pieces._row_key(i, 1) for i in range(n)], vocab, k)
    names = [[tuple(la.piece[s.edges].tolist()) for s in own] for own in found]
    assert all(len(set(x)) == k for x in names) and all(a.value >= b.value for own in found for a, b in zip(own, own[1:], strict=False))
    assert all(math.log(law[x]) == pytest.approx(s.log_prob) for own, nm in zip(found[:50], names[:50], strict=True) for s, x in zip(own, nm, strict=True))
    first, second = collections.Counter(x[0] for x in names), collections.Counter(x[1] for x in names)
    want = {s: sum(p * law[s] / (1 - p) for t, p in law.items() if t != s) for s in law}
    assert max(abs(first[s] / n - p) for s, p in law.items()) < 0.02 and max(abs(second[s] / n - p) for s, p in want.items()) < 0.02
    assert np.mean([sum(math.exp(s.log_prob) / s.inclusion for s in own) for own in found]) == pytest.approx(1, abs=0.02)


def test_small_lattices_are_exhausted(vocab):
    for text in ("▁a", "▁zz", "☃"):
        la, (own,) = pieces.sample_batch([text], [5], vocab, 50)
        assert len(own) == len(all_segmentations(text, vocab)) == len({tuple(s.edges.tolist()) for s in own}) and all(s.inclusion == 1 for s in own)


def test_pieces_query_against_enumeration(spark, vocab, tmp_path):
    """The query on short texts: every sample is one of all segmentations, by its ids' checksum, with that one's probability."""
    texts = ["the", "in er", "☃a", "ab\ncd", "", None, "1.5 x", "don't", "naïve", "  a"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.defaultdict(list)
    for r in queries.op8_sentencepiece(spark, str(tmp_path)).collect():
        got[r.doc_id].append(r)
    for i, t in enumerate(texts):
        law = {}
        for seg, p in all_segmentations(vocab.normalised(t or ""), vocab).items():
            ids = [x for s in seg for x in ([s] if s >= 0 else [vocab.byte_ids[b] for b in chr(-1 - s).encode()])]
            law[zlib.crc32(np.array(ids, "<u4").tobytes())] = (p, len(ids))
        own = sorted(got[i], key=lambda r: r.sample)
        assert len(own) == min(2, len(law)) and len({r.ids_crc32 for r in own}) == len(own) and all(r.round_trip for r in own)
        assert all(math.exp(r.log_prob) == pytest.approx(law[r.ids_crc32][0]) and r.n_pieces == law[r.ids_crc32][1] for r in own)
        assert all(a.value >= b.value for a, b in zip(own, own[1:], strict=False)) and (len(law) > 2 or all(r.inclusion == 1 for r in own))


def test_pieces_query_gives_ids_and_decodes_them(spark, docs, tmp_path, monkeypatch):
    """Every sample has its ids, which the library decodes to the text; the round trip is that of the text decoded from them."""
    import sentencepiece

    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    sp, plain = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), collections.defaultdict(set)
    for r in docs.collect():
        plain[r.doc_id].add((r.text or "").replace("▁", " "))
    got = queries.op8_sentencepiece(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(plain)
    for r in got:
        text = sp.decode(r.ids)
        assert text in plain[r.doc_id] and r.round_trip and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert len(r.ids) == r.n_pieces and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    decode = pieces.decode
    monkeypatch.setattr(pieces, "decode", lambda *a, **k: decode(*a, **k).withColumn("_text", F.concat("_text", F.lit("x"))))
    assert not any(r.round_trip for r in queries.op8_sentencepiece(spark, str(tmp_path)).collect())


def test_decoding_puts_unknown_ids_where_they_stand(spark, vocab):
    the, a = (vocab.text.index(t) for t in ("▁the", "▁a"))
    rows = spark.createDataFrame([(1, [the, len(vocab.text), a]), (2, None), (3, [-1, None, the]), (4, []), (5, [a])], "doc_id long, ids array<int>")
    got = {r.doc_id: r for r in pieces.decode(rows, P.path("piece_bpe_32k.model"), keep=("doc_id", "ids")).collect()}
    assert {i: r.text for i, r in got.items()} == {1: "the� a", 2: None, 3: "�� the", 4: "", 5: "a"}
    assert {i: r.ids for i, r in got.items()} == {r.doc_id: r.ids for r in rows.collect()}


def test_units_never_cut_a_piece(vocab):
    for t, k in zip(vocab.text, vocab.kind, strict=True):
        if k == "piece":
            x = vocab.letter[[ord(c) for c in t]]
            assert vocab.joined[x[:-1], x[1:]].all()


def test_lattices_kept_between_texts_change_nothing(vocab, monkeypatch):
    """Samples do not depend on what the worker has seen, nor on when it forgets."""
    texts = [vocab.normalised(" ".join(f"wo{i * j % 17}rd, x{j}" for j in range(12))) for i in range(40)]
    keys = [pieces._row_key(i, 9) for i in range(40)]

    def told(batches, held):
        out = []
        for a, b in batches:
            la, found = pieces.sample_batch(texts[a:b], keys[a:b], vocab, 3, held)
            out += [[(la.piece[s.edges].tolist(), s.log_prob, s.value, s.inclusion) for s in own] for own in found]
        return out

    want = told([(0, 40)], None)
    monkeypatch.setattr(pieces, "HELD_EDGES", 500)
    assert told([(i, i + 5) for i in range(0, 40, 5)], pieces.Held(vocab)) == want


def test_pieces_awkward(spark, docs, empty, vocab):
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    got = pieces.encode(docs, model, k=3).collect()
    assert all(r.round_trip for r in got) and all(0 <= r.inclusion <= 1 for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert {i: len(v) for i, v in by.items()} == {1: 3, 2: 1, 3: 1, 4: 3, 5: 3, 6: 6, 7: 2, None: 3, 8: 3, 9: 3}
    assert len({tuple(r.ids) for r in by[6]}) == 3 and len({tuple(r.ids) for r in by[4]}) == 3
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    assert sp.decode(by[8][0].ids) == AWKWARD[9][1].replace("▁", " ")
    other = pieces.encode(docs.repartition(7), model, k=3).collect()
    key = lambda r: (r.doc_id or -1, r.sample, r.ids)
    assert sorted(map(key, other)) == sorted(map(key, got))
    text = {r[0]: (r[1] or "").replace("▁", " ") for r in AWKWARD}
    back = pieces.decode(pieces.encode(docs, model, k=1), model).collect()
    assert all(r.text == text[r.doc_id] for r in back)
    assert pieces.encode(empty, model).count() == 0


# --- mixing


def test_targets_reshare():
    assert mixing.targets({"a": 10, "b": 100, "c": 100}, {"a": 5.0, "b": 2.0, "c": 1.0}) == pytest.approx({"a": 20.0, "b": 295 * 2 / 3, "c": 295 / 3})
    assert sum(mixing.targets({"a": 1, "b": 1}, {"a": 1, "b": 1}).values()) == pytest.approx(3)


def test_flow_repeats_only_where_it_must():
    a, b, ab = frozenset("a"), frozenset("b"), frozenset("ab")
    flow = mixing.min_cost_flow({a: 10, b: 10, ab: 10}, {"a": 20, "b": 5})
    assert flow[a, "a"] == 10 and flow[ab, "a"] == 10 and flow[b, "b"] == 5
    assert sum(mixing.min_cost_flow({a: 10}, {"a": 18}).values()) == 18 and sum(mixing.min_cost_flow({a: 10}, {"a": 99}).values()) == 20


def test_flow_against_linear_program():
    """Most words first, then least cost, against all fillings of tiny mixes."""
    import itertools

    rng = np.random.default_rng(4)
    for _ in range(25):
        pats = list({frozenset(rng.choice(["a", "b", "c"], rng.integers(1, 3), replace=False).tolist()) for _ in range(3)})
        cap, quota = {p: int(rng.integers(1, 3)) for p in pats}, {s: int(rng.integers(0, 4)) for s in "abc"}
        ways = [(p, s) for p in pats for s in sorted(p)]
        best = (0, 0)
        for xs in itertools.product(range(4), repeat=len(ways)):
            of = {p: sum(x for x, (q, _) in zip(xs, ways, strict=True) if q == p) for p in pats}
            to = {s: sum(x for x, (_, t) in zip(xs, ways, strict=True) if t == s) for s in "abc"}
            if all(of[p] <= 2 * cap[p] for p in pats) and all(to[s] <= quota[s] for s in "abc"):
                best = max(best, (sum(xs), -sum(max(0, of[p] - cap[p]) for p in pats)))
        flow = mixing.min_cost_flow(cap, quota)
        of = {p: sum(x for (q, _), x in flow.items() if q == p) for p in pats}
        assert (sum(flow.values()), -sum(max(0, of[p] - cap[p]) for p in pats)) == best


def test_mixing_contract(spark, sf):
    got = queries.op9_mixing(spark, sf).collect()
    docs = table(spark, sf, "documents").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    per = collections.Counter()
    for i, s in source.items():
        per[s] += size[i]
    ordered = sorted(s for s in per if s is not None) + [None] * (None in per)
    goal = mixing.targets(dict(per), {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(ordered)})
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == per[source[r.doc_id]] and r.target == pytest.approx(goal[source[r.doc_id]]) and r.taken in (0, r.size, 2 * r.size)
        taken[source[r.doc_id]] += r.taken
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r.size)
    assert len(got) == len(docs) and all(abs(taken[s] - goal[s]) <= largest[s] / 2 + 1 for s in per)
    assert sorted((r.doc_id, r.taken) for r in queries.op9_mixing(spark, sf).collect()) == sorted((r.doc_id, r.taken) for r in got)


def test_mixing_overlap_and_awkward(spark, docs, empty):
    size = mixing.n_words(F.col("text"))
    got = mixing.mix(docs, F.array("source"), size, keep=["text", "size"]).collect()
    assert len(got) == len(AWKWARD) and {r.doc_id: r.text for r in got} == {r[0]: r[1] for r in AWKWARD}
    assert all(r.copies == 0 for r in got if r.doc_id in (2, 3, 7))
    assert mixing.mix(empty, F.array("source"), size).count() == 0 and mixing.source_targets(empty, F.col("source"), size).count() == 0
    rows = [(i, ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else ["b", "b"], 10) for i in range(300)] + [(400, [], 5), (401, None, 5)]
    over = mixing.mix(spark.createDataFrame(rows, "doc_id long, s array<string>, n long"), F.col("s"), F.col("n"), weights={"a": 3.0, "b": 1.0}, share=1.0).collect()
    per = collections.Counter()
    for r in over:
        assert sum(p.copies for p in r.parts) == r.copies <= 2 and r.taken == r.copies * r["size"]
        for p in r.parts:
            per[p.source] += p.copies * r["size"]
    goal = mixing.targets({"a": 2000, "b": 2000}, {"a": 3.0, "b": 1.0}, 1.0)
    assert all(abs(per[s] - goal[s]) <= 20 for s in "ab") and not any(r.copies for r in over if r.doc_id >= 400)


# --- Merkle


@given(st.text(alphabet="ab c\n#.é\r ", max_size=200))
@settings(max_examples=200, deadline=None)
def test_phrases_lose_nothing(text):
    assert "".join(merkle.phrases(text)) == text
    assert merkle.encode(text) == plain_merkle(text)[0]
    assert merkle.likeness(merkle.encode(text), merkle.encode(text)) == 1.0


def test_edits_are_located():
    paras = [f"paragraph number {i} with some words in it\n" for i in range(40)]
    a = merkle.encode("".join(paras))
    paras[17] = "something else entirely\n"
    b = merkle.encode("".join(paras))
    assert len(merkle.edits(a, b)) == 1 and a.partition("/")[0] != b.partition("/")[0] and 0.9 < merkle.likeness(a, b) < 1
    assert merkle.likeness(a, merkle.encode("nothing in common")) == 0.0


def plain_merkle(text):
    """(fingerprint, phrases' marks with repeats), word by word and without the operator's code."""
    hashed = lambda data, size=8: hashlib.blake2b(data, digest_size=size).digest()
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+_"
    sections, marks, fresh = [], [], True
    for line in text.splitlines(keepends=True):
        bits = re.split(r"(\s+)", line)  # words at even places
        own, words, found = "", 0, []
        for i, bit in enumerate(bits):
            if i % 2 == 0 and bit:
                if words and (bits[i - 2][-1] in "dhlptxDHLPTX048,;" or words == 8):
                    found.append(own)
                    own, words = "", 0
                words += 1
            own += bit
        found += [own] if own else []
        full = [xxhash.xxh3_64(x.encode()).intdigest() for x in found]
        shown = ["".join(alphabet[h >> s & 63] for s in (0, 6, 12, 18)) for h in full]
        mark = hashed(b"p" + b"".join(h.to_bytes(8, "little") for h in full))
        if fresh or line[0] == "#":
            sections.append([])
        sections[-1].append((mark, shown))
        marks += shown
        fresh = line.isspace() or mark[0] % 8 == 0
    tops = [hashed(b"s" + b"".join(m for m, _ in sec)) for sec in sections]
    root = hashed(b"r" + b"".join(tops) + hashed(text.encode(), 16), 16).hex()
    return "/".join([root] + [t.hex() + ":" + ",".join("".join(x) for _, x in sec) for t, sec in zip(tops, sections, strict=True)]), collections.Counter(marks)


def plain_likeness(a, b):
    if a[0][:32] == b[0][:32]:
        return 1.0
    total = sum(a[1].values()) + sum(b[1].values())
    return 2 * sum((a[1] & b[1]).values()) / total if total else 0.0


def brute_merkle(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        f, g = plain_merkle(t), plain_merkle(edited)
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), f[0], g[0], plain_likeness(f, g), plain_likeness(f, plain_merkle(nxt)))
    return out


def test_merkle_long_white_space():
    began = time.process_time()
    for text in (" " * 1_000_000, "\t \n" * 300_000, "a" * 1_000_000, "a " * 400_000 + " " * 200_000):
        assert merkle.likeness(merkle.encode(text), merkle.encode(text + "x")) <= 1
    assert time.process_time() - began < 20


def test_merkle_parts_split_repeated_and_null_ids(spark):
    """Whatever the parts, neighbours are those of the documented order."""
    rows = [(7 if i % 3 else None, f"text {i * 37 % 200} of many " * 3) for i in range(300)] + [(i, f"own {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    by = df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(by, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), -r.h))
    want = collections.Counter()
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        cut = len(a.text) // 3
        want[a.doc_id, hashlib.sha256((a.text[: len(a.text) - cut] + b.text[:cut]).encode()).hexdigest()] += 1
    for n in (1, 5):
        assert collections.Counter((r.doc_id, r.edited_sha256) for r in merkle.against_edits(df, partitions=n).collect()) == want


def test_merkle_brute_force(spark, sf):
    want = brute_merkle(pairs(table(spark, sf, "documents")))
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in queries.op10_merkle(spark, sf).collect()}
    assert got == want
    assert np.mean([w[4] for w in want.values()]) > 0.6 > 0.1 > np.median([w[5] for w in want.values()])


def test_merkle_awkward(spark, docs, empty):
    got = merkle.against_edits(docs).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in AWKWARD)
    assert len({r.fingerprint for r in got if r.doc_id in (5, 6)}) == 1 and len({r.fingerprint for r in got if r.doc_id in (2, 3)}) == 1
    assert merkle.against_edits(empty).count() == 0
    (one,) = merkle.against_edits(docs.filter("doc_id = 9")).collect()
    assert one.near_next == 1.0 and one.n_chars == 3
    assert merkle.fingerprints(docs).count() == len(AWKWARD)
