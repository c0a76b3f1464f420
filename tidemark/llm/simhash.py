"""SimHash near-duplicates, found by meet-in-the-middle ball hashing.

Every distinct fingerprint emits the variants within half the radius around it, variants are shuffled, fingerprints
that meet on a variant are linked and verified, and links are closed to components.

Radius 3 is odd, so one of two fingerprints at distance 3 has to go two flips. Two rules keep the second ring small and
lose nothing. (1) Distance 3 means different parity of the set bits, so only fingerprints of odd parity emit two-flip
variants. (2) Of any three bit positions two lie in the same half of the word, so two-flip variants flip two bits of one
half: 992 instead of 2,016. Hence every pair within 3 bits meets on a variant that is one flip at most away from one of
them and, from the other, one flip or two flips of the second ring.

Variants that share their leading ``bucket_bits`` bits travel together: a fingerprint is sent once to each bucket that
one of its variants falls in and is expanded there, which moves 79 rows a fingerprint instead of about 560 and keeps a
bucket of bounded size, as the number of buckets follows the number of fingerprints. Within a bucket, fingerprints that
meet on a variant are joined to its first one-flip owner (linear in the group, never all pairs) after a check of the
real distance, and only a spanning forest of the bucket leaves the task.

Near copies by similarity (`near_copies`) are found the same way and then verified. One 64-bit fingerprint within 3 bits
reaches few texts of similarity 0.8, which differ in a seventh of their bits; so a text has PRINTS fingerprints of
PRINT_BITS bits each, pairs within 2 bits of one of them are candidates, and of each candidate pair the whole sets of
shingles are compared. Texts of similarity s differ in a bit with probability p = acos(2s / (1 + s)) / pi; a pair of 0.8 is a
candidate with probability 1 - (1 - P(at most 2 of 28 bits differ)) ** 16 = 0.96, one of 0.85 with 0.99. A fingerprint is
met through one text, so it must hardly ever hold unlike ones: `copy_law` gives longer and more fingerprints to more texts
(over a million), such that they hold 2 ** -8 unlike texts on average and a pair of 0.8 is found as often as before.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bound_batches, map_rows, stored, texts

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Fingerprints a bucket of variants is meant for; more fingerprints make more buckets.
PER_BUCKET = 1 << 12
MIN_BUCKET_BITS = 12
#: A bucket sent more fingerprints than this, by a dense cluster of them, is dealt out anew by more leading bits.
HOT_BUCKET, MORE_BITS, MAX_BUCKET_BITS = 1 << 16, 6, 30
#: Variants that a task holds at once; a fuller bucket is expanded part by part.
HELD = 1 << 22
_ONE = np.uint64(1)

#: Near copies: words of a shingle, similarity as shared / all in whole numbers, fingerprints of a text, their bits.
COPY_SHINGLE, SIMILARITY, PRINTS, PRINT_BITS = 5, (4, 5), 16, 28
#: Texts by which two fingerprints of unlike texts are equal, as a power of 2; the least probability that a pair of similarity 0.8 is a candidate.
LOAD_BITS, FOUND = 8, 0.959
#: Candidates whose 64 check bits differ in more places are no near copies (at similarity 0.8 9.7 on average, with a deviation
#: of 2.9; of unlike texts 32): for the forest of a bucket and for what is compared.
FIRST_RADIUS = CHECK_RADIUS = 22
_DRAWN = np.random.default_rng(SEED).integers(0, 2**63, 96 + COPY_SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint_of(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the text's word shingles, repeats included, hashed by XXH64 of their UTF-8 bytes.

    ASCII letters are lower-cased. Fewer words than a shingle: the whole sequence is one. No word: 0.
    """
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()  # both for ASCII alone
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line, one = b" ".join(words), xxhash.xxh64_intdigest
    if n == 1:
        return one(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends, counts = ends[shingle - 1 :].tolist(), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):  # a very long text takes no more memory than this many shingles
        h = np.fromiter((one(line[a:b], SEED) for a, b in zip(begins[at : at + (1 << 14)], ends[at : at + (1 << 14)], strict=True)), np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint as a signed long with the same bits. A null text counts as empty."""
    bound_batches(docs.sparkSession)

    def make(c: dict) -> dict:
        h = np.array([fingerprint_of(t, shingle) for t in c["text"]], np.uint64)
        return {"doc_id": c["doc_id"], "fingerprint": h.view(np.int64)}

    return map_rows(texts(docs, id_col, text_col), make, "doc_id long, fingerprint long")


def _parity(x: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(x) & np.uint8(1)).astype(bool)


def _buckets_of(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of fp, bucket) for each bucket that holds one of its variants: no, one or, for odd parity, two leading bits flipped."""
    lead = (fp >> np.uint64(64 - bits)).astype(np.int64)
    odd = np.flatnonzero(_parity(fp))
    singles = [0] + [1 << i for i in range(bits)]
    # bit i of the lead is bit 64 - bits + i of the word; two flips stay in one half
    halves = [(64 - bits + i) // 32 for i in range(bits)]
    pairs = [(1 << i) | (1 << j) for i in range(bits) for j in range(i) if halves[i] == halves[j]]
    rows = [np.tile(np.arange(len(fp)), len(singles)), np.tile(odd, len(pairs))]
    made = [(lead[None, :] ^ np.array(singles)[:, None]).ravel(), (lead[odd][None, :] ^ np.array(pairs, np.int64)[:, None]).ravel()]
    return np.concatenate(rows), np.concatenate(made)


def _expand(fp: np.ndarray, bucket: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All variants of fp in the bucket: (variant, row of fp, second ring or not)."""
    shift = np.uint64(64 - bits)
    diff = (fp >> shift) ^ np.uint64(bucket)
    away, odd = np.bitwise_count(diff), _parity(fp)
    home = fp ^ (diff << shift)
    low = 64 - bits
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(rows: np.ndarray, masks: np.ndarray, second: bool) -> None:
        v = (home[rows][:, None] ^ masks[None, :]).ravel()
        out.append((v, np.repeat(rows, len(masks)), np.full(len(v), second)))

    none, one = np.zeros(1, np.uint64), _ONE << np.arange(low, dtype=np.uint64)
    same, near, two = np.flatnonzero(away == 0), np.flatnonzero(away == 1), np.flatnonzero((away == 2) & odd)
    add(same, none, False)
    add(same, one, False)
    add(near, none, False)
    add(two, none, True)
    i, j = np.triu_indices(low, 1)
    keep = (i // 32) == (j // 32)
    add(same[odd[same]], (_ONE << i[keep].astype(np.uint64)) | (_ONE << j[keep].astype(np.uint64)), True)
    flipped = near[odd[near]]
    if len(flipped):  # one flip among the leading bits, one below in the same half
        half = (np.log2(diff[flipped].astype(np.float64)).round().astype(np.int64) + low) // 32
        for h in (0, 1):
            m = one[(np.arange(low) // 32) == h]
            if len(m):
                add(flipped[half == h], m, True)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    root, kept = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _pairs_in_bucket(fp: np.ndarray, bucket: int, bits: int, radius: int) -> np.ndarray:
    """Verified pairs of rows of fp, coded as a * len(fp) + b, that join whatever meets on a variant in this bucket."""
    if len(fp) < 2:
        return np.zeros(0, np.int64)
    away = np.bitwise_count((fp >> np.uint64(64 - bits)) ^ np.uint64(bucket))
    if int((away == 0).sum()) * 561 + int((away == 1).sum()) * 30 > HELD and bits < MAX_BUCKET_BITS:
        parts = []
        for sub in range(1 << 4):
            own = np.flatnonzero(np.bitwise_count((fp >> np.uint64(60 - bits)) ^ np.uint64(bucket << 4 | sub)) <= 2)
            p = _pairs_in_bucket(fp[own], bucket << 4 | sub, bits + 4, radius)
            parts.append(own[p // max(1, len(own))] * len(fp) + own[p % max(1, len(own))])
        return np.unique(np.concatenate(parts))
    variant, row, second = _expand(fp, bucket, bits)
    if not len(variant):
        return np.zeros(0, np.int64)
    order = np.argsort(variant, kind="stable")
    variant, row, second = variant[order], row[order], second[order]
    start = np.flatnonzero(np.concatenate(([True], variant[1:] != variant[:-1])))
    size = np.diff(np.append(start, len(variant)))
    # all other members are joined to the first that is one flip away at most; a group without one proves no link
    first = np.repeat(np.minimum.reduceat(np.where(second, len(row), np.arange(len(row))), start), size)
    ok = (first < len(row)) & np.repeat(size > 1, size)
    a, b = row[first[ok]], row[ok]
    good = (a != b) & (np.bitwise_count(fp[a] ^ fp[b]) <= radius)
    return np.unique(np.minimum(a, b)[good].astype(np.int64) * len(fp) + np.maximum(a, b)[good])


def links_in_bucket(fp: np.ndarray, bucket: int, bits: int, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest, as rows of fp, of the links that meet in this bucket."""
    pairs = _pairs_in_bucket(fp, bucket, bits, radius)
    return _forest(len(fp), pairs // max(1, len(fp)), pairs % max(1, len(fp)))


def near_links(distinct: DataFrame, fp_col: str = "fingerprint", bucket_bits: int | None = None, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose closure joins exactly those that are joined within 3 bits.

    bucket_bits: leading bits that deal variants out; by default at least 12, and enough for PER_BUCKET fingerprints a bucket.
    """
    spark = distinct.sparkSession
    bound_batches(spark)
    one = distinct.select(F.col(fp_col).alias("fp"))
    bits = bucket_bits or max(MIN_BUCKET_BITS, int(one.count() / PER_BUCKET).bit_length())

    def emitted(df: DataFrame, bits: int, within: int = 0) -> DataFrame:
        def emit(c: dict) -> dict:
            fp = np.array(c["fp"], np.int64)
            row, bucket = _buckets_of(fp.view(np.uint64), bits)
            if within:  # only those below the bucket that was too full
                own = bucket >> (bits - within) == np.array(c["bucket"], np.int64)[row]
                row, bucket = row[own], bucket[own]
            return {"bucket": bucket, "fp": fp[row]}

        return map_rows(df, emit, "bucket long, fp long")

    def meet(bits: int):
        def run(batches):
            import pyarrow as pa

            schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
            for batch in batches:
                for bucket, held in zip(batch.column("bucket").to_pylist(), batch.column("fp"), strict=True):
                    fp = np.sort(held.values.to_numpy(zero_copy_only=False).view(np.uint64))
                    if made := links_in_bucket(fp, bucket, bits):
                        x = fp.view(np.int64)[np.array(made)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, k])) for k in (0, 1)], schema=schema)

        return run

    found, dealt = None, emitted(one, bits)
    while True:
        sizes = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        hot = sizes.filter(F.col("n") > hot_bucket).select("bucket") if bits < MAX_BUCKET_BITS else None
        again = hot is not None and not (hot := stored(hot, "hot-buckets")).isEmpty()
        cool = dealt.join(hot, "bucket", "left_anti") if again else dealt
        links = cool.groupBy("bucket").agg(F.collect_list("fp").alias("fp")).filter(F.size("fp") > 1).mapInArrow(meet(bits), "a long, b long")
        found = links if found is None else found.unionAll(links)
        if not again:
            return found.distinct()
        dealt = emitted(stored(dealt.join(hot, "bucket", "left_semi"), "hot-rows"), min(MAX_BUCKET_BITS, bits + MORE_BITS), bits)
        bits = min(MAX_BUCKET_BITS, bits + MORE_BITS)


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches. Alternates large-star and small-star until links stay.

    Each star is a partial minimum and an equi-join that Spark may split where a node is hot; every round is checkpointed.
    """
    spark = links.sparkSession
    e = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    members = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return members.unionAll(members.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint 0 and form one group with whatever lies within 3 bits of it. Repeated rows
    share their id and hence their component. A row with a null id gets a fingerprint and its group's smallest id (null
    if no member has one). Empty input gives no rows. Other columns are ignored.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    owners = fps.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    of = components(near_links(owners.select("fingerprint")))
    owned = owners.join(of, owners.fingerprint == of.node, "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    owned = stored(owned, "owned")
    best = owned.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = owned.join(best, "root").select("fingerprint", "component_id")
    return fps.join(of_fp, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies by verified similarity


def copy_law(texts_: int) -> tuple[int, int]:
    """(fingerprints of a text, their bits) for so many texts: bits so that 2 ** -LOAD_BITS unlike texts share a fingerprint, fingerprints so that a pair of 0.8 is found with probability FOUND."""
    bits = max(PRINT_BITS, int(max(1, texts_) - 1).bit_length() + LOAD_BITS)
    n, d = SIMILARITY
    differs = math.acos(2 * n / (d + n)) / math.pi
    meets = sum(math.comb(bits, k) * differs**k * (1 - differs) ** (bits - k) for k in range(3))
    return max(PRINTS, math.ceil(math.log(1 - FOUND) / math.log(1 - meets) - 1e-9)), bits


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles. ASCII letters are lower-cased; fewer words than a shingle are one; no word: none."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()  # both for ASCII alone
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    one = xxhash.xxh3_64_intdigest
    w = np.fromiter(map(one, words), np.uint64, len(words))
    n = len(words) - shingle + 1
    return np.unique(_mixed(sum(_mixed(w[k : k + n] * _DRAWN[k]) * _DRAWN[k] for k in range(shingle))))


def _node(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0


def _bits_of(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    """n_bits or a few more bits of SimHash over the set, each set if it is in over half the hashes."""
    drawn = _DRAWN[COPY_SHINGLE : COPY_SHINGLE - (-n_bits // 64)]
    counts = np.zeros(64 * len(drawn), np.int64)
    for at in range(0, len(hashes), 255):  # so that counts of a part fit a byte
        wide = _mixed(hashes[at : at + 255, None] * drawn)
        counts += np.unpackbits(wide.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return counts * 2 > len(hashes)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", law: tuple[int, int] = (PRINTS, PRINT_BITS)) -> DataFrame:
    """doc_id, mark (XXH64 of the text), node (hash of the whole set, 0 if empty), prints (fingerprints with their number in front; none if empty), check."""
    bound_batches(docs.sparkSession)
    n_prints, n_bits = law

    def make(c: dict) -> dict:
        nodes, prints, checks = [], [], []
        places, numbers = np.int64(1) << np.arange(n_bits, dtype=np.int64), np.arange(n_prints, dtype=np.int64) << n_bits
        k = n_prints * n_bits
        for t in c["text"]:
            own = shingle_set(t)
            nodes.append(_node(own))
            bits = _bits_of(own, k + 64)
            checks.append(int(np.packbits(bits[k : k + 64], bitorder="little").view("<u8")[0]))
            prints.append((bits[:k].reshape(n_prints, n_bits) @ places) + numbers if len(own) else np.zeros(0, np.int64))
        whole = lambda x: np.array(x, np.uint64).view(np.int64)
        return {"doc_id": c["doc_id"], "mark": c["mark"], "node": whole(nodes), "prints": prints, "check": whole(checks)}

    return map_rows(texts(docs, id_col, text_col).withColumn("mark", F.xxhash64("text")), make, "doc_id long, mark long, node long, prints array<long>, check long")


def pairs_in_bucket(prints: np.ndarray, bucket: int, lead: int, bits: int = PRINT_BITS) -> np.ndarray:
    """Codes (i << 32 | j, i < j, places in prints) of all pairs of distinct fingerprints that meet on a variant one flip away at most in this bucket.

    A bucket is given by the leading bits: those in front of a fingerprint (its number) and `lead` bits of it. A variant
    has one fingerprint for each flip at most, and their pairs lie within 2 bits.
    """
    low = bits - lead
    diff = (prints >> low) ^ bucket
    home, near = np.flatnonzero(diff == 0), np.flatnonzero(diff != 0)
    flips = np.concatenate(([0], np.int64(1) << np.arange(low)))
    variant = np.concatenate([(prints[home][:, None] ^ flips).ravel(), (prints[near] & ((1 << low) - 1)) | (bucket << low)])
    owner = np.concatenate([np.repeat(home, len(flips)), near])
    order = np.argsort(variant, kind="stable")
    variant, owner = variant[order], owner[order]
    out, k = [np.zeros(0, np.int64)], 1
    while k < len(variant):
        same = np.flatnonzero(variant[k:] == variant[:-k])
        if not len(same):
            break
        a, b = owner[same], owner[same + k]
        out.append(np.minimum(a, b) << 32 | np.maximum(a, b))
        k += 1
    return np.unique(np.concatenate(out))


def links_of_bucket(prints: np.ndarray, check: np.ndarray, bucket: int, lead: int, bits: int = PRINT_BITS) -> np.ndarray:
    """A spanning forest (rows of two fingerprints), nearest check bits first, of the pairs that meet in this bucket and whose check bits are near.

    Like texts are nearer than unlike ones that pass by chance (one in 100), so these do not take a like pair's place.
    """
    order = np.argsort(prints, kind="stable")
    prints, check = prints[order], check[order]
    code = pairs_in_bucket(prints, bucket, lead, bits)
    a, b = code >> 32, code & 0xFFFFFFFF
    away = np.bitwise_count((check[a] ^ check[b]).view(np.uint64))
    order = np.argsort(away, kind="stable")
    order = order[away[order] <= FIRST_RADIUS]
    kept = np.array(_forest(len(prints), a[order], b[order]), np.int64).reshape(-1, 2)
    return prints[kept]


def near_prints(distinct: DataFrame, lead_bits: int | None = None, law: tuple[int, int] = (PRINTS, PRINT_BITS)) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints `print` of one number, within 2 bits and with near `check` bits, that join what meets on a variant.

    Only a spanning forest of each bucket leaves its task, so the pairs of a large group of near copies are linear in it.
    lead_bits: leading bits that deal variants out; by default enough for PER_BUCKET variants a bucket, which holds
    4,096 * (1 + lead_bits) fingerprints at most where 12 bits are left, whatever the number of texts, as they are distinct.
    """
    bound_batches(distinct.sparkSession)
    n_prints, n_bits = law
    lead = lead_bits or min(n_bits - 12, max(4, int(distinct.count() * 10 / n_prints / PER_BUCKET).bit_length()))
    low, flips = n_bits - lead, np.concatenate(([0], np.int64(1) << np.arange(lead)))

    def emit(c: dict) -> dict:
        own = np.array(c["print"], np.int64)
        return {"bucket": ((own >> low)[:, None] ^ flips).ravel(), "print": np.repeat(own, len(flips)), "check": np.repeat(np.array(c["check"], np.int64), len(flips))}

    def meet(batches):
        import pyarrow as pa

        for batch in batches:
            flat = lambda x: x.values.to_numpy(zero_copy_only=False)
            for bucket, prints, checks in zip(batch.column("bucket").to_pylist(), batch.column("prints"), batch.column("checks"), strict=True):
                if len(found := links_of_bucket(flat(prints), flat(checks), bucket, lead, n_bits)):
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=arrow)

    arrow = arrow_schema("a long, b long")
    spread = distinct.select("print", "check").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "print")
    dealt = map_rows(spread, emit, "bucket long, print long, check long")
    met = dealt.groupBy("bucket").agg(F.collect_list(F.struct("print", "check")).alias("own")).filter("size(own) > 1")
    return met.select("bucket", F.col("own.print").alias("prints"), F.col("own.check").alias("checks")).mapInArrow(meet, "a long, b long").distinct()


def candidate_pairs(made: DataFrame, law: tuple[int, int] = (PRINTS, PRINT_BITS)) -> DataFrame:
    """Distinct candidates (a, b, away) of the sketches' nodes, `away` of their check bits apart.

    Nodes with one fingerprint are candidates of its least node; fingerprints within 2 bits make candidates of their least nodes.
    """
    nodes = made.filter("node <> 0").select("node", "check", "prints").dropDuplicates(["node"])
    own = stored(nodes.select("node", "check", F.explode("prints").alias("print")), "prints")
    led = stored(own.groupBy("print").agg(F.min(F.struct("node", "check")).alias("lead"), F.count(F.lit(1)).alias("members")), "leads")
    end = lambda x, s: [F.col(f"{x}.node").alias(s), F.col(f"{x}.check").alias(f"{s}_check")]
    same = own.join(led.filter("members > 1").select("print", "lead"), "print").filter("node <> lead.node").select(F.col("node").alias("a"), F.col("check").alias("a_check"), *end("lead", "b"))
    near = near_prints(led.select("print", "lead.check"), law=law)
    side = lambda s: led.select(F.col("print").alias(s), F.col("lead").alias(f"{s}_lead"))
    near = near.join(side("a"), "a").join(side("b"), "b").select(*end("a_lead", "a"), *end("b_lead", "b"))
    away = F.bit_count(F.col("a_check").bitwiseXOR(F.col("b_check")))
    found = same.unionAll(near).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), away.alias("away"))
    return stored(found.filter(F.col("away") <= CHECK_RADIUS).distinct(), "candidates")


def _sets(docs: DataFrame, pairs: DataFrame, made: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node and hashes of the pairs' nodes, made anew from one text of each (repeated rows repeat it): few texts have candidates, so sets of all are not moved."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    keys = made.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("key")).select("key.doc_id", "key.mark")

    def make(c: dict) -> dict:
        sets = [shingle_set(t) for t in c["text"]]
        return {"node": np.array([_node(s) for s in sets], np.uint64).view(np.int64), "hashes": [s.view(np.int64) for s in sets]}

    all_ = texts(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    own = all_.join(keys, all_.doc_id.eqNullSafe(keys.doc_id) & (all_.mark == keys.mark), "left_semi")
    return map_rows(own.select("text"), make, "node long, hashes array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("hashes").alias(f"of_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    n, d = SIMILARITY  # shared / (a + b - shared) >= n / d
    return both.filter(f"{n + d}L * size(array_intersect(of_a, of_b)) >= {n}L * (size(of_a) + size(of_b))").select("a", "b").distinct()


def similar_links(docs: DataFrame, made: DataFrame, id_col: str = "doc_id", text_col: str = "text", law: tuple[int, int] = (PRINTS, PRINT_BITS)) -> DataFrame:
    """Verified links (a, b) between nodes whose closure joins all candidates that are similar enough.

    First each node is compared with its nearest candidate, which joins most of a large group; then all candidates that are
    still apart are. Pairs inside a component need no comparison, as they can't change the closure.
    """
    pairs = candidate_pairs(made, law)
    sets = stored(_sets(docs, pairs, made, id_col, text_col), "sets")
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "away"))
    nearest = both.groupBy("a").agg(F.min(F.struct("away", "b")).alias("to")).select(F.least("a", "to.b").alias("x"), F.greatest("a", "to.b").alias("b")).distinct()
    first = stored(_verified(nearest.withColumnRenamed("x", "a"), sets), "similar")
    of = components(first)
    root = lambda x: of.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    apart = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
    return first.unionAll(_verified(apart, sets))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", law: tuple[int, int] | None = None) -> DataFrame:
    """One row per input row: doc_id, mark (XXH64 of the text), component_id (smallest doc_id of its group of near
    copies), stays (whether this id and text stand for the group).

    Near copies share 0.8 or more of their distinct five-word shingles (Jaccard similarity). Links are closed, so a group may
    hold texts that are similar over others only. Null and empty texts form one group. Repeated rows have equal results;
    of texts with the group's smallest id, that with the smallest mark stays. Rows with a null id take part; their group's
    id is null if no member has one. Empty input gives no rows. Other columns are ignored. law: fingerprints of a text and
    their bits, by default as the number of rows asks for.
    """
    law = law or copy_law(docs.count())
    made = stored(sketches(docs, id_col, text_col, law), "sketches")
    of = components(similar_links(docs, made, id_col, text_col, law))
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    owned = made.groupBy("node").agg(F.min(key).alias("least")).join(of, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    owned = stored(owned, "owned")
    best = owned.groupBy("root").agg(F.min("least").alias("least"))
    out = made.select("doc_id", "mark", "node").join(owned.select("node", "root").join(best, "root").select("node", "least"), "node")
    return out.select("doc_id", "mark", F.col("least.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("mark") == F.col("least.mark"))).alias("stays"))
