"""Row filters as Column predicates over text cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored
from . import cells


def all_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def any_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def smart_search(columns: Sequence[str], needle: str, wanted: Sequence[str] | None = None) -> Column:
    """Every word of the needle occurs in the joined text of the wanted columns (all, if the table has none of them)."""
    own = [c for c in columns if wanted and c.lower() in {w.lower() for w in wanted}] or list(columns)
    joined = F.concat_ws(" | ", *(cells.lower(F.col(f"`{c}`")) for c in own))
    return all_of([joined.contains(w) for w in needle.lower().split()])


def one_of(c: Column | str, values: Sequence[str], allow_empty: bool = False) -> Column:
    """Trimmed value among `values`; '' among them, or allow_empty, admits blanks."""
    t, own = cells.text(c), [v for v in values if v != ""]
    return any_of(([t.isin(*own)] if own else []) + ([t == ""] if allow_empty or "" in values else []))


def equalities(wanted: Mapping[str, Sequence[str]]) -> Column:
    return all_of([one_of(c, v) for c, v in wanted.items()])


def rule(c: Column | str, kind: str, value: str | Sequence[str] = "") -> Column:
    """blank, nonblank, not_empty, contains, contains_any, startswith, eq0, gt0."""
    low, n = cells.lower(c), cells.number(c)
    if kind == "contains_any":
        return any_of([low.contains(v.lower()) for v in value])
    return {
        "blank": low == "", "nonblank": low != "", "not_empty": low != "", "contains": low.contains(str(value).lower()), "startswith": low.startswith(str(value).lower()),
        "eq0": F.coalesce(n == 0, F.lit(False)), "gt0": F.coalesce(n > 0, F.lit(False)),
    }[kind]


def age_rule(c: Column | str, kind: str, days: int, now: Column) -> Column:
    """days_lte, days_gt, days_gt_or_blank, blank; now is always a parameter."""
    age = cells.age_days(now, c)
    gone = age.isNull()
    return {"days_lte": F.coalesce(age <= days, F.lit(False)), "days_gt": F.coalesce(age > days, F.lit(False)), "days_gt_or_blank": gone | (age > days), "blank": gone}[kind]


def first_of_each(df: DataFrame, c: str, order: str) -> DataFrame:
    """First row, by `order`, of each distinct filled value."""
    return df.filter(cells.text(c) != "").groupBy(cells.text(c).alias("_value")).agg(F.min_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")


def ranked(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """df with the place of each row in a global order, from 1: ranges are sorted apart, and their sizes are added up.

    The sorted ranges are stored once, as their sizes must be those of the rows that are numbered; ties should be broken
    by `order`. No task has more than its range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    own = stored(own.withColumns({"_range": F.shiftright("_id", 33), "_nth": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id"), "ranked")
    sizes = own.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.join(sizes.select("_range", before.alias("_before")), "_range").withColumn(name, F.col("_before") + F.col("_nth") + 1).drop("_range", "_nth", "_before")


def mixed_order(c: Column | str) -> list[Column]:
    """Sort keys: numbers (commas dropped) before text, text without case."""
    t = F.regexp_replace(cells.text(c), ",", "")
    is_number = t.rlike(r"^-?(\d+\.?\d*|\.\d+)$")
    return [F.when(is_number, 0).otherwise(1), F.when(is_number, t.try_cast("double")), F.when(~is_number, cells.lower(c))]


def fixed_rows(df: DataFrame, rows: DataFrame, by: str = "row_ix") -> DataFrame:
    """The rows that a list of row numbers names."""
    return df.join(rows.select(by).distinct(), by, "left_semi")


def anywhere(df: DataFrame, needle: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with the needle, without case, in the joined text of the columns; a blank needle keeps all."""
    if not needle.strip():
        return df
    return df.filter(F.lower(F.concat_ws(" | ", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns or df.columns))).contains(needle.strip().lower()))
