"""Secret ledger, token alignment and Merkle manifest against brute force, on awkward rows and over several runs."""

import collections
import hashlib
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import alignment, common, manifest, queries, secret_ledger

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, 'token = "abcdef0123456789abcdef0123456789" and password: hunter22', "en", "s1", 1), (2, None, None, None, None), (3, "", "en", "s1", 0), (4, "word " * 30_000 + "x" * 20_000, "en", "s2", 5),
    (5, "same words here again", "en", "s1", 3), (6, "same words here again", "en", "s2", 3), (6, "same words here again", "en", "s2", 3), (7, " \n\t  ", "fr", None, 1), (None, "no id at all AKIA" + "Q" * 16, "fr", "s3", 1),
    (8, "naïve ☃ text 中文 ▁ end", "fr", "s3", 1), (9, "one", None, "s1", 1), (10, "  two  spaces <s> <|endoftext|> \x1c end", "de", "s1", None), (14, "日本語のテキスト😀é", "ja", "s1", 7), (35, "=" * 5000, "de", "s1", 7),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(AWKWARD, DOCS)
    clash = ["tree", "pos", "n", "digest", "segment", "level", "blob", "place", "path", "version", "row", "part", "piece", "times", "a", "b", "spans", "copies", "root", "leaf", "_at", "_spread", "kind"]
    return df.select("*", *(F.lit("clash").alias(c) for c in clash))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:])))


# --- secrets


def brute_secrets(text):
    """Plain patterns as the contract states them, position by position."""
    names = "(?:password|passwd|secret|token|api_?key)"
    assign = re.compile(f"(?ia:{names})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    spans = [("assign", *m.span()) for m in assign.finditer(text) if len(m.group(1)) >= 6]
    spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    kinds = ["assign", "access", "hex"]
    spans.sort(key=lambda s: (s[1], kinds.index(s[0])))
    return spans


def said(spans):
    return ",".join(f"{k}:{b}:{e}" for k, b, e in spans)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "PassWord", "api_key", "apikey", "\u017fecret", "secret", " ", "  ", "=", ":", '"', "'", "abc", "abcdef", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "0123456789abcdef01234567", "é", "-", "\n", "eyJ", "."]), max_size=25).map("".join))
def test_base_rules(text):
    found = [(r.name, b, e) for r in secret_ledger.RULES if r.base for b, e in r.find(text)]
    assert sorted(found) == sorted(brute_secrets(text))


def test_secret_query_brute_force(spark, sf):
    rows = {r.doc_id: r for r in queries.op11_secrets(spark, sf).collect()}
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    assert rows.keys() == texts.keys()
    for k, r in rows.items():
        want = brute_secrets(texts[k])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == n for s in want) for n in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(said(want).encode()).hexdigest()
        assert set(said(want).split(",")) <= set(r.spans.split(","))


def test_added_rules():
    by = {r.name: r for r in secret_ledger.RULES}
    jwt = "eyJhbGciOi.eyJzdWIiOi.c2lnbmF0dXJl"
    pem = "-----BEGIN RSA PRIVATE KEY-----\nMIIE\n-----END RSA PRIVATE KEY-----"
    assert list(by["jwt"].find(f"x {jwt} y")) == [(2, 2 + len(jwt))]
    assert list(by["pem"].find(f"a {pem} b {pem}")) == [(2, 2 + len(pem)), (5 + len(pem), 5 + 2 * len(pem))]
    assert list(by["url"].find("at postgres://ann:pa55@host/db")) == [(3, len("at postgres://ann:pa55@"))]
    assert not list(by["url"].find("http://host:80/a@b"))
    began = time.time()
    for text in ("-----BEGIN PRIVATE KEY-----" * 20_000, "eyJ" * 200_000, "a://" * 200_000, "password" * 100_000, "password" + " " * 300_000, "AKIA" * 200_000, "0123456789abcdef0123456" * 20_000 + "g"):
        for r in secret_ledger.RULES:
            list(r.find(text))
    assert time.time() - began < 20


def test_secrets_awkward(spark, docs, empty, tmp_path):
    rows = secret_ledger.digests(secret_ledger.findings(docs, f"file://{tmp_path}/ledger", path_col="doc_id", version_col=None)).collect()
    assert in_order((r.doc_id, r.base_sha256, r.n_hex) for r in rows) == in_order((r[0], hashlib.sha256(said(brute_secrets(r[1] or "")).encode()).hexdigest(), sum(s[0] == "hex" for s in brute_secrets(r[1] or ""))) for r in AWKWARD)
    assert secret_ledger.findings(empty, f"file://{tmp_path}/none", path_col="doc_id", version_col=None).count() == 0


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    """Copied, reverted and repeated texts cost no scan; a changed rule costs one scan of that rule."""
    path = f"file://{tmp_path}/ledger"
    history = [("a.py", 1, "token = abcdef1"), ("a.py", 2, "clean"), ("a.py", 3, "token = abcdef1"), ("b.py", 1, "token = abcdef1"), ("c.py", None, None), (None, 1, "clean"), ("c.py", 1, "clean"), ("c.py", 1, "clean")]
    kind = "path string, version long, text string"
    found = lambda h, rules=secret_ledger.RULES: in_order((r.path, r.version, said([(s.rule, s.begin, s.end) for s in r.spans])) for r in secret_ledger.findings(spark.createDataFrame(h, kind), path, rules).collect())
    pairs = lambda: collections.Counter((bytes(r.blob), m) for r in secret_ledger.ledger(spark, path).collect() for m in r.scanned)
    want = lambda h: in_order((p, v, said(brute_secrets(t or ""))) for p, v, t in h)
    assert found(history) == want(history)
    first = pairs()
    assert len(first) == 3 * len(secret_ledger.RULES) and set(first.values()) == {1}
    history += [("d.py", 1, "token = abcdef1"), ("d.py", 2, "secret: 0123456789")]
    assert found(history) == want(history)
    second = pairs()
    assert len(second - first) == len(secret_ledger.RULES) and set(second.values()) == {1}
    assert found(history) == want(history) and pairs() == second
    newer = (secret_ledger.Rule("assign", 2, lambda t: iter([(0, 5)] if t.startswith("clean") else [])), *secret_ledger.RULES[1:])
    rows = found(history, newer)
    assert ("c.py", 1, "assign:0:5") in rows and ("d.py", 2, "") in rows
    third = pairs()
    assert set(m for _, m in third - second) == {"assign@2"} and set(third.values()) == {1}
    assert found(history) == want(history) and pairs() == third  # the old version's findings are still there


def test_uncommitted_batch_is_not_read(spark, tmp_path):
    (tmp_path / "ledger" / "x" / "_temporary" / "0").mkdir(parents=True)
    path = f"file://{tmp_path}/ledger"
    h = spark.createDataFrame([("a", 1, "token = abcdef1")], "path string, version long, text string")
    assert [len(r.spans) for r in secret_ledger.findings(h, path).collect()] == [1]


def test_join_by_weight_equals_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 3)
    rows = common.stored(spark.range(1000).select((F.when(F.col("id") < 500, 0).otherwise(F.col("id") % 7)).alias("k"), "id"), "rows")
    one = common.stored(rows.groupBy("k").agg(F.count(F.lit(1)).alias("w")), "weights")
    assert sorted(map(tuple, common.join_by_weight(rows, one, "k", "w").collect())) == sorted(map(tuple, rows.join(one, "k").collect()))


# --- alignment


@pytest.fixture(scope="module")
def files():
    return P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute_alignment(texts, files):
    """Groups by sets of ends, counts by dictionaries."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel  # noqa: F401

    ta, tb = Tokenizer.from_file(files[0]), SentencePieceProcessor(model_file=files[1])
    ta.encode_special_tokens = True
    byte_of = alignment._byte_of()
    made, per_pair = [], collections.Counter()
    for t in texts:
        if not t:
            made.append(None)
            continue
        a, b = ta.encode(" " + t, add_special_tokens=False).ids, tb.encode(t)
        raw_a = [bytes(byte_of[c] for c in ta.id_to_token(i)) for i in a]
        raw_b = [bytes([int(x[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", x := tb.id_to_piece(i)) else x.replace("▁", " ").encode() for i in b]
        if not (b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode()):
            made.append(None)
            continue
        ea, eb = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        both = sorted(set(ea) & set(eb))
        groups, i, j = [], 0, 0
        for e in both:
            x, y = ea.index(e, i) + 1, eb.index(e, j) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        links = collections.Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        per_pair.update(links.keys())
        made.append((a, b, groups, links))
    best = collections.defaultdict(int)
    for (x, _), n in per_pair.items():
        best[x] = max(best[x], n)
    out = []
    for m in made:
        if m is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = m
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), sum(links.values()), sum(n for k, n in links.items() if per_pair[k] == best[k[0]]), sum(n * per_pair[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_query_brute_force(spark, sf, files):
    docs = table(spark, sf, "documents").collect()
    want = in_order((r.doc_id, *m) for r, m in zip(docs, brute_alignment([r.text for r in docs], files), strict=True))
    assert in_order(map(tuple, queries.op12_alignment(spark, sf).select(*COLUMNS).collect())) == want


@pytest.mark.parametrize(("piece", "large", "held", "hot"), [(1 << 15, 256, 1 << 22, 65_536), (7, 2, 40, 3), (100, 256, 1000, 65_536)])
def test_alignment_awkward_and_in_pieces(spark, docs, empty, files, monkeypatch, piece, large, held, hot):
    """The same rows whatever the size of pieces, of what is held, and wherever the hot pairs end."""
    rows = [r if len(r[1] or "") < 6000 else (r[0], r[1][:400], *r[2:]) for r in AWKWARD]
    df = docs.withColumn("text", F.when(F.length("text") < 6000, F.col("text")).otherwise(F.substring("text", 1, 400)))
    want = in_order((r[0], *m) for r, m in zip(rows, brute_alignment([r[1] for r in rows], files), strict=True))
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    assert in_order(map(tuple, alignment.align(df, *files, piece=piece).select(*COLUMNS).collect())) == want
    assert alignment.align(empty, *files).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.lists(st.integers(1, 4), min_size=1, max_size=40), st.integers(1, 9))
def test_merge_path(a, b, piece):
    """Pieces hold about `piece` ends each, part no equal ends, and all lower ends come first."""
    a, b = np.cumsum(a), np.cumsum(b)
    cuts = alignment.merge_path(a, b, piece).T.tolist()
    assert cuts[0] == [0, 0] and cuts[-1] == [len(a), len(b)]
    for (i0, j0), (i1, j1) in zip(cuts, cuts[1:]):
        assert 0 <= i1 - i0 and 0 <= j1 - j0 and i1 - i0 + j1 - j0 <= piece + 1
        before, behind = np.concatenate([a[:i1], b[:j1]]), np.concatenate([a[i1:], b[j1:]])
        assert not len(behind) or not len(before) or before.max() < behind.min()


@settings(max_examples=100, deadline=None)
@given(st.data())
def test_links_of_large_groups(data):
    """Distinct ids and counts give what all pairs give; parts have no common pair."""
    n = data.draw(st.integers(1, 4))
    ga = np.array(sorted(data.draw(st.lists(st.integers(0, n - 1), max_size=30)) + list(range(n))))
    gb = np.array(sorted(data.draw(st.lists(st.integers(0, n - 1), max_size=30)) + list(range(n))))
    a, b = np.array(data.draw(st.lists(st.integers(0, 4), min_size=len(ga), max_size=len(ga)))), np.array(data.draw(st.lists(st.integers(0, 3), min_size=len(gb), max_size=len(gb))))
    scope = np.arange(n) // 2
    want = collections.Counter((int(scope[g]) * 5 + int(x)) * 4 + int(y) for x, g in zip(a, ga) for y, h in zip(b, gb) if g == h)
    old = alignment.LARGE_GROUP, alignment.HELD_PAIRS
    try:
        for large, held in ((256, 1 << 22), (3, 1 << 22), (3, 10)):
            alignment.LARGE_GROUP, alignment.HELD_PAIRS = large, held
            got = collections.Counter()
            for key, times in alignment.parts_of_pairs(a, b, ga, gb, scope, 4, 5):
                assert not set(key.tolist()) & set(got)
                got.update(dict(zip(key.tolist(), times.tolist())))
            assert got == want
    finally:
        alignment.LARGE_GROUP, alignment.HELD_PAIRS = old


# --- manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(level):
    """(root, siblings from the leaf on with their side) of every leaf."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, i in enumerate(at):
            if i ^ 1 < len(level):
                paths[k].append((i & 1, level[i ^ 1]))
            else:
                paths[k].append((0, ""))
            at[k] = i >> 1
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def brute_manifest(rows):
    trees = collections.defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        trees[lang].append((doc_id is not None, doc_id or 0, leaf_of(doc_id, source, lang, n, text), leaf_of(doc_id, source, lang, n if n is None else n + 1, text), doc_id))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    below = [climb([t[2] for t in sorted(trees[x], key=lambda t: t[:3])]) for x in langs]
    root, above = climb([b[0] for b in below])
    out = []
    for x, (subroot, paths), up in zip(langs, below, above, strict=True):
        for t, own in zip(sorted(trees[x], key=lambda t: t[:3]), paths, strict=True):
            path = own + up
            at = t[3] if t[4] is not None and zlib.crc32(str(t[4]).encode()) % 7 == 0 else t[2]
            for side, s in path:
                at = h(s, at) if side else h(at, s)
            out.append((t[4], t[2], subroot, root, h(*(s for _, s in path)), at, at == root))
    return in_order(out)


TOLD = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_query_brute_force(spark, sf):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in table(spark, sf, "documents").collect()]
    got = in_order(map(tuple, queries.op13_manifest(spark, sf).select(*TOLD).collect()))
    assert got == brute_manifest(rows) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize(("step", "few", "share"), [(10, 8192, 4096), (2, 0, 1), (3, 4, 2)])
def test_manifest_awkward(spark, docs, empty, monkeypatch, step, few, share):
    """Equal results whatever a task builds at once and wherever joins stop being broadcast."""
    monkeypatch.setattr(manifest, "FEW", few)
    monkeypatch.setattr(common, "HOT_SHARE", share)
    off = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    assert in_order(map(tuple, manifest.manifest(docs, off, step=step).select(*TOLD).collect())) == brute_manifest(AWKWARD)
    assert manifest.manifest(empty).count() == 0


def test_proofs_lead_to_the_root(spark, sf):
    for r in manifest.manifest(table(spark, sf, "documents")).limit(50).collect():
        assert manifest.folded(bytes.fromhex(r.leaf), bytes(r.proof))[0].hex() == r.root and r.verified


def test_manifest_of_one_row(spark):
    (r,) = manifest.manifest(spark.createDataFrame(AWKWARD[:1], DOCS)).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == hashlib.sha256(b"").hexdigest() and r.verified


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=12) | st.sampled_from([" ", "  ", "\n", "\t", "word", "hello world", "<s>", "</s>", "中文", "😀", "é", "   x", "a" * 20, "1234", "\x00", "é"]), min_size=1, max_size=12).map("".join).filter(bool))
def test_units_of_pieces_encode_as_whole(text):
    from sentencepiece import SentencePieceProcessor

    units = alignment.pair(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).encode_b
    whole = SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")).encode(text)
    (ids,) = units([text])
    spelled = units.spelled.of(np.array(whole, np.int64)).tobytes() == (" " + text).encode()
    assert ids.tolist() == (whole if spelled else [])


# --- faults mended


def test_toxicity_is_linear_in_spaced_punctuation():
    from tidemark.llm import toxicity

    s = toxicity.Scorer({})
    began = time.time()
    for text in ("Trash " + ". " * 500_000 + "12", "idiot" + "! " * 500_000, "idiot . " * 100_000):
        s.features(text)
    assert time.time() - began < 30


def test_topk_keeps_rows_of_one_id(spark):
    from tidemark.llm import topk

    df = spark.createDataFrame([(100, [1.0, 0.0]), (1, [5.0, 0.0]), (1, [9.0, 0.0]), (1, [9.0, 0.0]), (2, [7.0, 0.0]), (3, [40000.0, -1.0])], "vec_id long, embedding array<float>")
    found = sorted((r["rank"], r.vec_id, r.score >> 20) for r in topk.search(df, F.col("vec_id") % 100 == 0).collect())
    assert found == [(1, 3, 40000), (2, 1, 9), (3, 2, 7), (4, 1, 5)]
