"""Runs of three characters: how needles meet texts that have them anywhere, without comparing each with each.

A text is followed by two marks, so that a run begins at each of its characters. A needle of three characters or more has
its own runs in every text that holds it; a shorter one begins a run there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
#: Needles that are sent to all tasks at most.
MOST_SENT = 1 << 18
#: Parts of each run's postings, so that those of a common run are dealt to several tasks.
SALTS = 16
_END = "\0" * (GRAM - 1)


def runs(text: Column) -> Column:
    """Distinct runs that begin at the characters of a text; none of an empty or null one."""
    at, padded = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), F.concat(text, F.lit(_END))
    return F.when(text != "", F.array_distinct(F.transform(at, lambda i: F.substring(padded, i, GRAM)))).otherwise(F.array().cast("array<string>"))


def own_runs(needle: Column) -> Column:
    """Distinct whole runs of a needle of GRAM characters or more."""
    at = F.sequence(F.lit(1), F.greatest(F.length(needle) - GRAM + 1, F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substring(needle, i, GRAM)))


def picks(asks: DataFrame, counts: DataFrame, query: str, needle: str) -> DataFrame:
    """query, gram, bit, need: the runs by which each needle looks for texts.

    counts: gram, n; it need not be exact, but a run that it lacks is in no text. Long needles take their two rarest runs,
    each with a bit of its own, and those with a run that no text has take none. Short needles take all runs that they
    begin, with one bit. A text may hold the needle only if its runs have all bits of `need`. Empty needles take none.
    """
    long = asks.filter(F.length(needle) >= GRAM).select(query, F.explode(own_runs(F.col(needle))).alias("gram")).join(counts.select("gram", "n"), "gram", "left")
    two = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))), 1, 2)  # as many as a needle has runs
    rare = long.groupBy(query).agg(two.alias("_two")).filter(F.col("_two")[0]["n"] > 0)
    rare = rare.select(query, (2 * F.size("_two") - 1).alias("need"), F.posexplode("_two").alias("_i", "_g")).select(query, "_g.gram", (F.col("_i") + 1).alias("bit"), "need")
    short = asks.filter(F.length(needle).between(1, GRAM - 1)).select(query, F.col(needle).alias("_begin"))
    begun = counts.select("gram", F.explode(F.array(*(F.substring("gram", 1, n) for n in range(1, GRAM)))).alias("_begin"))
    return rare.unionByName(short.join(begun, "_begin").select(query, "gram", F.lit(1).alias("bit"), F.lit(1).alias("need")).distinct())


def meet(postings: DataFrame, picked: DataFrame, query: str, *of: str) -> DataFrame:
    """query and `of` of the texts that have all bits of a needle. postings: gram and `of`, one row a run of a text; rows may repeat.

    The two runs of a needle are intersected by a partial bit_or. Picks are few beside postings, so Spark mostly broadcasts
    them; where it does not, each run's postings meet them in SALTS parts.
    """
    salt = F.pmod(F.xxhash64(*of), F.lit(SALTS)).cast("int")
    dealt = picked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = postings.withColumn("_salt", salt).join(dealt, ["gram", "_salt"])
    return met.groupBy(query, *of).agg(F.bit_or("bit").alias("_bits"), F.max("need").alias("_need")).filter("_bits = _need").select(query, *of)


def pieces(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """texts with each needle that they hold, told where they lie; a needle that a text holds twice is told twice.

    needles: distinct, not empty. Their beginnings of at most GRAM characters, as many as the alphabet allows, tell which
    lengths are worth a piece at a place; up to MOST_SENT needles are sent to all tasks, more meet the pieces in a shuffle.
    """
    begun = needles.select(F.substring(needle, 1, GRAM).alias("_run"), F.length(needle).alias("_size"))
    told = needles.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.least(F.length(needle), F.lit(GRAM))).alias("sizes")).first()
    begins = F.broadcast(begun.groupBy("_run").agg(F.collect_set("_size").alias("_sizes")))
    # explode_outer, as filters on the size of what explode takes would tell it more than once
    places = texts.withColumn("_at", F.explode_outer(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))))
    runs_ = places.withColumn("_run", F.explode_outer(F.array(*(F.substring(F.col(text), F.col("_at"), F.lit(n)) for n in sorted(told["sizes"]) or [GRAM]))))
    cut = runs_.join(begins, "_run").select(*texts.columns, "_at", F.explode("_sizes").alias("_size"))
    return cut.select(*texts.columns, F.substring(F.col(text), F.col("_at"), F.col("_size")).alias(needle)).join(F.broadcast(needles) if told["n"] <= MOST_SENT else needles, needle)
