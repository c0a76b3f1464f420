"""What changed: snapshot pairs, whole histories in one pass, entity states.

Tables are long histories: a family, a snapshot number `seq` (dense, by capture time), a key and columns. Three states of
evidence stay apart: a column that a snapshot does not have, a blank cell, and a row that is missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells


def number_snapshots(df: DataFrame, family: str = "family", at: str = "captured_at") -> DataFrame:
    """seq of each (family, capture time): a small table of snapshots, ranked, joined back by Spark's choice of strategy."""
    snaps = df.select(family, at).distinct()
    ranked = snaps.withColumn("seq", F.row_number().over(Window.partitionBy(family).orderBy(at)))
    return df.join(ranked, [family, at])


def last_row_wins(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Of rows with one key the last in file order; rows with a blank key are dropped. A partial aggregate, no sort."""
    rest = [c for c in df.columns if c not in by]
    own = df.filter(cells.filled(by[-1]).isNotNull()).groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return own.select(*by, "_row.*")


def changed_columns(columns: Sequence[str], before: str, after: str, guards: dict[str, Column] | None = None, token_columns: Sequence[str] = (), folded: Sequence[str] = ()) -> Column:
    """Array of (column, before, after) for columns that differ; token columns compare as sets, folded ones without case; a guard that holds suppresses its column."""
    out = []
    for c in columns:
        a, b = F.col(f"{before}.`{c}`"), F.col(f"{after}.`{c}`")
        differs = ~cells.same_tokens(a, b, fold=c in folded) if c in (*token_columns, *folded) else cells.text(a) != cells.text(b)
        if guards and c in guards:
            differs = differs & ~F.coalesce(guards[c], F.lit(False))
        out.append(F.when(differs, F.struct(F.lit(c).alias("column"), cells.text(a).alias("before"), cells.text(b).alias("after"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull()) if out else F.array().cast("array<struct<column:string,before:string,after:string>>")


def failed_retrieval(c: str, before: str = "b", after: str = "a") -> Column:
    """Guard: either side reports an error instead of a list."""
    bad = lambda side: F.upper(cells.text(F.col(f"{side}.`{c}`"))).startswith("ERROR:")
    return bad(before) | bad(after)


def unknown_status(status: str, missing_is_known: bool = False, before: str = "b", after: str = "a") -> Column:
    """Guard: the retrieval did not answer on both sides, so a difference is no evidence."""
    return ~(cells.status_known(F.col(f"{before}.`{status}`"), missing_is_known) & cells.status_known(F.col(f"{after}.`{status}`"), missing_is_known))


def pair_diff(before: DataFrame, after: DataFrame, key: Column, order: str, exclude: Sequence[str] = (), guards: dict[str, Column] | None = None, token_columns: Sequence[str] = (), folded: Sequence[str] = ()) -> DataFrame:
    """key, change (Added, Removed, Changed, Stable), changes: one full outer join of two snapshots by key.

    Only columns in both tables are compared, and of these none that `exclude` names; guards may read any column in both.
    Blank keys drop out on both sides; of equal keys the last row wins.
    """
    held = [c for c in after.columns if c in before.columns and c.lower() != order.lower()]
    common = [c for c in held if c.lower() not in {x.lower() for x in exclude}]
    sides = [last_row_wins(d.withColumn("_key", key), ["_key"], order).select("_key", F.struct(*held, F.lit(1).alias("_here")).alias(s)) for d, s in ((before, "b"), (after, "a"))]
    both = sides[0].join(sides[1], "_key", "full_outer")
    changes = F.when(F.col("a._here").isNotNull() & F.col("b._here").isNotNull(), changed_columns(common, "b", "a", guards, token_columns, folded))
    change = F.when(F.col("b._here").isNull(), "Added").when(F.col("a._here").isNull(), "Removed").when(F.size("changes") > 0, "Changed").otherwise("Stable")
    return both.withColumn("changes", changes).withColumn("change", change).select(F.col("_key").alias("key"), "change", "changes", "b", "a")


def counts(diff: DataFrame) -> DataFrame:
    """added, removed, changed, stable, total (of the first three)."""
    n = lambda *names: F.count_if(F.col("change").isin(*names))
    return diff.agg(n("Added").alias("added"), n("Removed").alias("removed"), n("Changed").alias("changed"), n("Stable").alias("stable"), n("Added", "Removed", "Changed").alias("total"))


def details(diff: DataFrame, most: int | None = None) -> DataFrame:
    """A row for each added or removed key and each changed column; with `most`, that many in canonical order and whether more exist."""
    rows = diff.filter("change <> 'Stable'").select("change", "key", F.explode_outer("changes").alias("c")).select("change", "key", F.col("c.column").alias("property"), "c.before", "c.after")
    if most is None:
        return rows
    rank = F.when(F.col("change") == "Added", 0).when(F.col("change") == "Removed", 1).otherwise(2)
    capped = rows.orderBy(rank, F.lower("key"), "key", "property").limit(most + 1)
    return capped.withColumn("more", F.count(F.lit(1)).over(Window.partitionBy()) > most).limit(most)  # most + 1 rows


def evidence(columns: Sequence[str], headers: Column | None = None, sets: Sequence[str] = (), folded: Sequence[str] = (), unknown: dict[str, Column] | None = None) -> Column:
    """What a row says of each column, as an array of hashes; null where it says nothing.

    It says nothing of a column that its snapshot does not have (headers: array of names, without case) and where `unknown`
    holds. Token columns count as sets, folded ones without case.
    """
    out, has = [], lambda c: F.exists(headers, lambda x: F.lower(x) == c.lower())
    for c in columns:
        value = F.array_join(cells.tokens(f"`{c}`", c in folded), ";") if c in (*sets, *folded) else cells.text(f"`{c}`")
        h = F.xxhash64(value)
        if headers is not None:
            h = F.when(has(c), h)
        if unknown and c in unknown:
            h = F.when(~F.coalesce(unknown[c], F.lit(False)), h)
        out.append(h)
    return F.array(*out).cast("array<bigint>")


def differs(a: Column | str, b: Column | str) -> Column:
    """Whether two rows' evidence differs in a column that both speak of."""
    return F.exists(F.zip_with(cells.col(a), cells.col(b), lambda x, y: F.coalesce(x != y, F.lit(False))), lambda d: d)


def movement(history: DataFrame, columns: Sequence[str] = (), family: str = "family", key: str = "key", last: int | None = None, says: Column | None = None) -> DataFrame:
    """family, seq, added, removed, changed, stable of every adjacent snapshot pair, in one pass over all rows.

    history has one row for each (family, seq, key); says: its evidence, by default of all `columns`. A row was added if its
    key was not in the snapshot before, and its key is removed in the next snapshot if it is not there. One shuffle by
    (family, key); counts are partial aggregates.
    """
    w = Window.partitionBy(family, key).orderBy("seq")
    h = evidence(columns) if says is None else says
    newest = history.groupBy(family).agg(F.max("seq").alias("_newest"))
    rows = history.select(family, key, "seq", h.alias("_h")).withColumn("_p", F.lag("seq").over(w)).withColumn("_ph", F.lag("_h").over(w)).withColumn("_n", F.lead("seq").over(w))
    here = F.col("_p") == F.col("seq") - 1
    event = F.array(
        F.struct(F.col("seq"), F.when(~F.coalesce(here, F.lit(False)), "added").when(differs("_h", "_ph"), "changed").otherwise("stable").alias("what")),
        F.when(F.coalesce(F.col("_n") != F.col("seq") + 1, F.lit(True)), F.struct((F.col("seq") + 1).alias("seq"), F.lit("removed").alias("what"))),
    )
    events = rows.select(family, F.explode(F.filter(event, lambda e: e.isNotNull())).alias("e")).groupBy(family, F.col("e.seq").alias("seq"))
    out = events.agg(*(F.count_if(F.col("e.what") == k).alias(k) for k in ("added", "removed", "changed", "stable")))
    out = out.join(newest, family).filter((F.col("seq") > 1) & (F.col("seq") <= F.col("_newest")))
    return (out.filter(F.col("seq") > F.col("_newest") - last) if last else out).drop("_newest")


def schema_changes(snapshots: DataFrame, family: str = "family", at: str = "captured_at", headers: str = "headers") -> DataFrame:
    """Headers added (new order) and removed (old order) at each snapshot whose headers differ from those before."""
    old = F.lag(headers).over(Window.partitionBy(family).orderBy(at))
    rows = snapshots.withColumn("_old", old).filter(F.col("_old").isNotNull())
    rows = rows.withColumn("added", F.array_except(headers, "_old")).withColumn("removed", F.array_except("_old", headers))
    return rows.filter((F.size("added") > 0) | (F.size("removed") > 0)).select(family, at, "added", "removed")


def map_diff(before: DataFrame, after: DataFrame, by: Sequence[str], value: str = "properties") -> DataFrame:
    """Entity states or scoped rows, each with a map of properties: added, removed, modified and the changed names.

    Compares the union of both sides' properties; a property that one side lacks counts as blank.
    """
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    side = lambda df, s: df.select(*by, F.coalesce(F.col(value), none).alias(s))  # noqa: E731  a null map has no property, but its row is there
    both = side(before, "_b").join(side(after, "_a"), list(by), "full_outer")
    names = F.array_sort(F.array_union(F.map_keys("_b"), F.map_keys("_a")))
    get = lambda m, k: F.trim(F.coalesce(F.try_element_at(F.col(m), k), F.lit("")))
    diff = F.filter(F.transform(names, lambda k: F.struct(k.alias("name"), get("_b", k).alias("before"), get("_a", k).alias("after"))), lambda x: x.before != x.after)
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.size("changes") > 0, "modified").otherwise("unchanged")
    return both.withColumn("changes", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), diff)).withColumn("change", change).select(*by, "change", "changes")


def relationship_diff(before: DataFrame, after: DataFrame, entity: str = "entity", family: str = "family", scope: str = "scope", properties: str = "properties") -> DataFrame:
    """entity, family, scope, change (added, removed, modified), before, after: relationships of two states as bags.

    Each table has a row for each relationship: its scope and its properties, an array of (name, value). A relationship is
    told by its properties' canonical text, `name=value` in order of names, so their order is no difference, and repeats
    count: before and after are the texts of which that side has more, each with how many more. Scopes without a
    difference give no row. Null scopes are one scope; null properties are none. Both sides meet in partial sums.
    """
    text = F.array_join(F.array_sort(F.transform(F.coalesce(F.col(properties), F.array().cast("array<struct<name: string, value: string>>")), lambda p: F.concat(p["name"], F.lit("="), F.coalesce(p["value"], F.lit(""))))), "|")
    side = lambda df, b, a: df.select(entity, family, scope, text.alias("_text"), F.lit(b).alias("_b"), F.lit(a).alias("_a"))
    bags = side(before, 1, 0).unionByName(side(after, 0, 1)).groupBy(entity, family, scope, "_text").agg(F.sum("_b").alias("_b"), F.sum("_a").alias("_a"))
    more = lambda x, y: F.array_sort(F.collect_list(F.when(F.col(x) > F.col(y), F.struct(F.col("_text").alias("text"), (F.col(x) - F.col(y)).alias("n")))))
    out = bags.groupBy(entity, family, scope).agg(F.sum("_b").alias("_nb"), F.sum("_a").alias("_na"), more("_b", "_a").alias("before"), more("_a", "_b").alias("after"))
    change = F.when(F.col("_nb") == 0, "added").when(F.col("_na") == 0, "removed").when((F.size("before") > 0) | (F.size("after") > 0), "modified")
    return out.withColumn("change", change).filter("change is not null").select(entity, family, scope, "change", "before", "after")


def token_delta(before: Column | str, after: Column | str, fold: bool = True) -> Column:
    """Tokens added and removed, as sorted sets."""
    a, b = cells.tokens(before, fold), cells.tokens(after, fold)
    return F.struct(F.array_except(b, a).alias("added"), F.array_except(a, b).alias("removed"))
