"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Token capacity flows from patterns
to the quotas of their sources; the first copy of a document is free, each further one dearer than the one before, so
the flow repeats only what quotas leave no other way to fill. The flow works on sums per pattern and source, whose number
is that of the mix's configuration and never grows with the documents. Then documents are selected in a seeded order.
"""

from __future__ import annotations

from collections import defaultdict, deque
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

WEIGHTS, SHARE, MOST_COPIES = (5.0, 2.0, 1.0), 1.5, 2
#: Hash buckets that the seeded order is cut into; only the bucket that a cut falls in has to be sorted.
ORDER_BUCKETS = 4096
#: Patterns and sources that a mix may have at most: their sums are what the driver holds.
MOST_PATTERNS = 100_000
SEED = 17


def n_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weights_by_code_point(sources: list[str | None], weights: tuple[float, ...] = WEIGHTS) -> dict[str | None, float]:
    """Weights dealt in turn to the sources by code point, null last."""
    ordered = sorted((s for s in sources if s is not None)) + ([None] if None in sources else [])
    return {s: weights[i % len(weights)] for i, s in enumerate(ordered)}


def targets(sizes: dict, weights: dict, share: float = SHARE, most: float = MOST_COPIES) -> dict:
    """share of all sizes, split by weight; a target stops at `most` times its source's size and the excess is reshared."""
    goal, full, open_ = share * sum(sizes.values()), {}, set(sizes)
    while open_:
        rest, w = goal - sum(full.values()), sum(weights[s] for s in open_)
        over = {s for s in open_ if rest * weights[s] / w > most * sizes[s]}
        if not over:
            return full | {s: rest * weights[s] / w for s in open_}
        full |= {s: float(most * sizes[s]) for s in over}
        open_ -= over
    return full


def min_cost_flow(capacity: dict[frozenset, int], quota: dict, copies: int = MOST_COPIES) -> dict[tuple[frozenset, object], int]:
    """Words that each pattern gives each of its sources: most words first, then least cost.

    Copy k of a pattern's documents costs k^2, so marginal costs rise. A source that overlaps no other is filled straight
    from its own pattern; the others go through the network. Shortest paths are found under potentials, which keep costs
    positive, and all paths of one length are filled together by blocking flows.
    """
    given: dict[tuple[frozenset, object], int] = {}
    shared = {s for p in capacity if len(p) > 1 for s in p}
    for s in quota:
        if s not in shared and (p := frozenset([s])) in capacity and (x := min(quota[s], copies * capacity[p])) > 0:
            given[p, s] = x
    capacity = {p: n for p, n in capacity.items() if p & shared}
    quota = {s: n for s, n in quota.items() if s in shared}
    to, left, cost = [], [], []
    out: dict[object, list[int]] = defaultdict(list)

    def arc(a, b, cap: int, price: int) -> None:
        for x, y, n, c in ((a, b, cap, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            left.append(n)
            cost.append(c)

    begin, end, ways = ("begin",), ("end",), {}
    for p in sorted(capacity, key=lambda x: sorted((y is None, y or "") for y in x)):
        for k in range(copies):
            arc(begin, ("pattern", p), capacity[p], k * k)
        for s in sorted(p, key=lambda y: (y is None, y or "")):
            if s in quota:
                ways[p, s] = len(to)
                arc(("pattern", p), ("source", s), copies * capacity[p], 0)
    for s in quota:
        arc(("source", s), end, quota[s], 0)
    height: dict[object, int] = defaultdict(int)

    def distances() -> dict:
        far, heap, n = {begin: 0}, [(0, 0, begin)], 0
        while heap:
            d, _, a = heappop(heap)
            if d > far[a]:
                continue
            for i in out[a]:
                b = to[i]
                if left[i] > 0 and (e := d + cost[i] + height[a] - height[b]) < far.get(b, 1 << 62):
                    far[b], n = e, n + 1
                    heappush(heap, (e, n, b))
        return far

    def fill() -> bool:
        """One blocking flow along arcs without reduced cost, by levels; whether there was any."""
        level, waiting = {begin: 0}, deque([begin])
        free = lambda i, a: left[i] > 0 and cost[i] + height[a] - height[to[i]] == 0
        while waiting:
            a = waiting.popleft()
            for i in out[a]:
                if to[i] not in level and free(i, a):
                    level[to[i]] = level[a] + 1
                    waiting.append(to[i])
        if end not in level:
            return False
        at, path, a = dict.fromkeys(level, 0), [], begin
        while True:
            if a == end:
                x = min(left[i] for i in path)
                for i in path:
                    left[i] -= x
                    left[i ^ 1] += x
                first = next(n for n, i in enumerate(path) if not left[i])
                a, path = to[path[first] ^ 1], path[:first]
            elif at[a] < len(out[a]):
                i = out[a][at[a]]
                if level.get(to[i]) == level[a] + 1 and free(i, a):
                    path.append(i)
                    a = to[i]
                else:
                    at[a] += 1
            elif a == begin:
                return True
            else:
                a = to[path.pop() ^ 1]
                at[a] += 1

    while end in (far := distances()):
        for a in out:
            height[a] += min(far.get(a, far[end]), far[end])
        while fill():
            pass
    return given | {k: left[i ^ 1] for k, i in ways.items() if left[i ^ 1]}


def bounded(rows: dict, what: str) -> None:
    """A mix beyond the bound is refused as a whole; no pattern or source is ever left out of one."""
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"a mix has {MOST_PATTERNS} {what} at most")


def mix(docs: DataFrame, sources: Column, size: Column, id_col: str = "doc_id", weights: dict | None = None, share: float = SHARE, copies: int = MOST_COPIES, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """Every document with the copies that the mix takes of it.

    sources: array of strings, the document's sources (duplicates count once; a null member is the source null; a null
    or empty array belongs to no source and is never taken). size: words, null read as 0. weights: by source, by default
    5, 2, 1 in turn by code point. keep: further columns of docs to carry along.

    Returns doc_id, pattern (sorted array), size, copies (0 to `copies`), taken (copies * size), parts (array of struct
    source, copies: which source's quota each copy fills), then keep. The order in which documents of a pattern are
    taken is by md5 of seed, id and text's size, so reruns agree whatever the partitions; rows that tie in all of it are
    alike but for `keep` columns. Documents of size 0 are never taken. Empty input gives no rows.
    """
    spark, keep = docs.sparkSession, keep or []
    raw = F.coalesce(sources, F.array().cast("array<string>"))
    pattern = F.array_sort(F.array_distinct(raw), lambda a, b: F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), 1).when(b.isNull(), -1).when(a < b, -1).when(a > b, 1).otherwise(0))
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(F.col(id_col).alias("doc_id"), pattern.alias("pattern"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), mark.alias("mark"), F.conv(F.substring(mark, 1, 3), 16, 10).cast("int").alias("bucket"), F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keep)), F.lit(0).alias("none")).alias("kept"))
    sums = stored(rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("words")), "mix-sums")

    of = {tuple(r.pattern): int(r.words) for r in sums.groupBy("pattern").agg(F.sum("words").alias("words")).limit(MOST_PATTERNS + 1).collect()}
    bounded(of, "membership patterns")
    per_source: dict = defaultdict(int)
    for p, words in of.items():
        for s in p:
            per_source[s] += words
    weights = weights if weights is not None else weights_by_code_point(list(per_source))
    goal = targets({s: n for s, n in per_source.items() if s in weights}, weights, share, copies) if per_source else {}
    flow = min_cost_flow({frozenset(p): n for p, n in of.items() if n and p}, {s: round(t) for s, t in goal.items()}, copies)

    # what a pattern gives, laid end to end: source i takes words begin to end of the line of copies
    plan = []
    for p, words in of.items():
        at, cuts = 0, []
        for s in p:
            if x := flow.get((frozenset(p), s), 0):
                cuts.append((s, at, at + x))
                at += x
        plan.append((list(p), words, at, cuts))
    lines = spark.createDataFrame(plan, "pattern array<string>, capacity long, give long, cuts array<struct<source: string, begin: long, end: long>>").withColumn("key", F.to_json("pattern")).drop("pattern")
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("key", F.to_json("pattern")).select("key", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start")).join(lines, "key")
    # copy k of the document at `at` lies at k * capacity + at; it is taken if its middle lies before `give`
    placed = rows.withColumn("key", F.to_json("pattern")).join(starts, ["key", "bucket"])
    order = Window.partitionBy("key", "bucket").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    middle = lambda k: k * F.col("capacity") + F.col("at") + F.col("size") / 2
    takes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), middle), lambda m: (m < F.col("give")) & (F.col("size") > 0))
    owner = F.transform(takes, lambda m: F.filter("cuts", lambda c: (m >= c.begin) & (m < c.end))[0].source)
    placed = placed.withColumn("owners", owner).withColumn("copies", F.size("owners"))
    parts = F.transform(F.array_distinct("owners"), lambda s: F.struct(s.alias("source"), F.size(F.filter("owners", lambda o: o.eqNullSafe(s))).alias("copies")))
    return placed.select("doc_id", "pattern", "size", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), parts.alias("parts"), *(F.col(f"kept.k{i}").alias(k) for i, k in enumerate(keep)))


def source_targets(docs: DataFrame, source: Column, size: Column, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target of each source: as many rows as the mix has sources."""
    spark = docs.sparkSession
    sizes = {r[0]: int(r[1] or 0) for r in docs.groupBy(source.alias("source")).agg(F.sum(size)).limit(MOST_PATTERNS + 1).collect()}
    bounded(sizes, "sources")
    goal = targets(sizes, weights_by_code_point(list(sizes), weights), share, most) if sizes else {}
    return spark.createDataFrame([(s, sizes[s], float(goal[s])) for s in sizes], "source string, source_size long, target double")
