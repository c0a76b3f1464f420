"""Snapshot metrics, generic quality profile, metric series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..plans import cards


def dashboard(rows: DataFrame, report: cards.Report | None = None, by: Sequence[str] = ()) -> DataFrame:
    """All cards of a report, a column each, for every group of `by` (family, capture time): one aggregate with partial sums.

    Without a report the headers decide; where none matches, the generic profile is made.
    """
    own = report or cards.detect(rows.columns)
    if own is None:
        return profile(rows, by)
    get = lambda c: F.col(c) if c in by else cells.resolve(rows.columns, c)
    return rows.groupBy(*by).agg(*(rule(get).alias(title) for title, rule in own.cards.items()))


def profile(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """rows, columns, completeness (percent, one decimal, 100.0 for an empty table), complete_rows, rows_with_blanks, blank_cells."""
    own = [c for c in rows.columns if c not in by]
    blanks = sum((F.when(cells.text(F.col(f"`{c}`")) == "", 1).otherwise(0) for c in own), F.lit(0))
    out = rows.withColumn("_b", blanks).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.lit(len(own)).alias("columns"), F.count_if(F.col("_b") == 0).alias("complete_rows"), F.count_if(F.col("_b") > 0).alias("rows_with_blanks"), F.coalesce(F.sum("_b"), F.lit(0)).alias("blank_cells"))
    all_cells = F.col("rows") * F.col("columns")
    return out.withColumn("completeness", F.when(all_cells == 0, F.lit(100.0)).otherwise(F.round(100.0 * (all_cells - F.col("blank_cells")) / all_cells, 1)))


def as_series(wide: DataFrame, by: Sequence[str] = ("family", "captured_at")) -> DataFrame:
    """Long metrics: by, metric, value."""
    names = [c for c in wide.columns if c not in by]
    return wide.select(*by, *(F.col(f"`{c}`").cast("double").alias(c) for c in names)).unpivot(list(by), names, "metric", "value")


def first_groups(rows: DataFrame, c: str, most: int = 6, blank: str = "Unknown") -> DataFrame:
    """Counts by value, blank under its name; the alphabetically first `most`."""
    name = F.coalesce(cells.filled(c), F.lit(blank)).alias("value")
    return rows.groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.lower("value"), "value").limit(most)


def trailing(series: DataFrame, days: int, by: Sequence[str] = ("family",), at: str = "captured_at") -> DataFrame:
    """Points not older than `days` before the newest of their series."""
    newest = series.groupBy(*by).agg(F.max(at).alias("_newest"))
    return series.join(newest, list(by)).filter(F.col(at) >= F.col("_newest") - F.make_interval(days=F.lit(days))).drop("_newest")


def level_of(points: Column, span_days: Column) -> Column:
    """daily up to 140 points, else weekly up to two years, else monthly."""
    return F.when(points <= 140, "daily").when(span_days <= 730, "weekly").otherwise("monthly")


def series(points: DataFrame, level: str = "auto", by: Sequence[str] = ("family", "metric"), at: str = "captured_at", value: str = "value") -> DataFrame:
    """The last value of each bucket: by, at, value, label, level, source_points.

    Buckets are capture times (daily), ISO weeks or months. `auto` picks a level for each series from one small aggregate.
    """
    size = points.groupBy(*by).agg(F.count(F.lit(1)).alias("source_points"), F.datediff(F.max(at), F.min(at)).alias("_span"))
    own = points.join(size, list(by)).withColumn("level", level_of(F.col("source_points"), F.col("_span")) if level == "auto" else F.lit(level))
    week = F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), F.col(at)).cast("string"), F.weekofyear(at).cast("string"))
    bucket = F.when(F.col("level") == "daily", F.col(at).cast("string")).when(F.col("level") == "weekly", week).otherwise(F.date_format(at, "yyyy-MM"))
    out = own.groupBy(*by, "level", "source_points", bucket.alias("bucket")).agg(F.max_by(value, at).alias("value"), F.max(at).alias(at))
    return out.withColumn("label", F.when(F.col("level") == "monthly", F.date_format(at, "MMM yy")).otherwise(F.date_format(at, "dd MMM"))).drop("bucket")
