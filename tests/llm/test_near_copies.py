"""The pipeline's near copies against all pairs by brute force."""

import random

import numpy as np

import corpus_pipeline as C
from tidemark.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_groups(rows):
    def shingles(text):
        w = (text or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and (sets[a] == sets[b] or 10 * shared >= 8 * len(sets[a] | sets[b])):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}


def corpus():
    rng, out = random.Random(7), []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        for k in range(12):
            words = list(base)
            for _ in range(k):
                words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
            out.append(" ".join(words))
    rng.shuffle(out)
    return [*enumerate(out), (1000, None), (1001, ""), (1002, "two words"), (1003, "two  words"), (1004, "two other words")]


def test_groups_equal_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    want = brute_groups(rows)
    assert {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()} == want
    assert sorted(r.doc_id for r in C.near_dedup(spark, df, "").collect()) == sorted(set(want.values()))
    assert simhash.near_copies(df.limit(0)).count() == 0


def test_no_near_copy_stays_in_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_groups([(r.doc_id, (r.text or "").encode().lower().decode()) for r in docs.select("doc_id", "text").collect()])
    assert sorted(r.doc_id for r in C.near_dedup(spark, docs, sf).collect()) == sorted(set(want.values()))


def test_fingerprints_meet_on_variants(spark):
    """Pairs within 2 bits and with near check bits are joined, whatever the buckets; no others are paired."""
    rng = np.random.default_rng(3)
    k, made = simhash.PRINT_BITS, {}
    for number in (0, 7, 15):
        for centre in rng.integers(0, 1 << k, 12).tolist():
            for _ in range(40):
                flips = rng.choice(k, int(rng.integers(0, 4)), replace=False).tolist()
                made[(number << k) | (centre ^ sum(1 << f for f in flips))] = int(rng.integers(0, 2)) * 0xFFFFFFFF
    prints = list(made)
    near = lambda a, b: a >> k == b >> k and (a ^ b).bit_count() <= 2 and (made[a] ^ made[b]).bit_count() <= simhash.FIRST_RADIUS

    def closure(pairs):
        root = {x: x for x in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
        return {x: find(x) for x in prints}

    want = closure((a, b) for i, a in enumerate(prints) for b in prints[:i] if near(a, b))
    df = spark.createDataFrame([(a, c if c < 1 << 31 else c - (1 << 32)) for a, c in made.items()], "print long, check long")
    for lead in (4, 12, None):
        got = [(r.a, r.b) for r in simhash.near_prints(df, lead).collect()]
        assert all(near(a, b) for a, b in got) and closure(got) == want


def test_similarity_decides_and_recall_is_high(spark):
    """Of planted pairs at 0.8 to 0.85 most are found, of pairs just below none, and groups never join unlike texts."""
    rng, rows, above, below = random.Random(5), [], [], []
    for i in range(0, 600, 2):
        base = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        cut = 20 if i % 4 else 30  # shares 180 of 220 or 170 of 230 five-word shingles
        rows += [(i, " ".join(base)), (i + 1, " ".join(base[: 204 - cut] + [f"v{rng.randrange(10**6)}" for _ in range(cut)]))]
        (above if i % 4 else below).append(i)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i + 1] == i for i in above) / len(above) > 0.9
    assert all(got[i + 1] == i + 1 for i in below) and set(got.values()) >= set(range(0, 600, 2))


def test_law_of_fingerprints():
    assert simhash.copy_law(0) == simhash.copy_law(1 << 20) == (simhash.PRINTS, simhash.PRINT_BITS)
    for n in (1 << 22, 10**9, 10**11):
        prints, bits = simhash.copy_law(n)
        assert n / 2**bits <= 2**-simhash.LOAD_BITS and prints.bit_length() + bits < 63
        assert prints * bits + 64 <= 64 * (len(simhash._DRAWN) - simhash.COPY_SHINGLE)


def test_groups_by_the_law_of_many_texts(spark):
    """What a thousand million texts would ask for finds the same groups and as many planted pairs."""
    law = simhash.copy_law(10**9)
    rows = corpus()
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_copies(df, law=law).collect()} == brute_groups(rows)
    rng, planted = random.Random(6), []
    for i in range(0, 200, 2):
        base = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        planted += [(i, " ".join(base)), (i + 1, " ".join(base[:184] + [f"v{rng.randrange(10**6)}" for _ in range(20)]))]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(planted, "doc_id long, text string"), law=law).collect()}
    assert sum(got[i + 1] == i for i in range(0, 200, 2)) > 90
