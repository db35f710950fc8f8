"""Calibration: exact percentiles of corpus metrics, and the category rules that follow from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .triage import Rule

PERCENTS = (0, 10, 25, 50, 75, 90, 95, 100)


def thresholds(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """(metric, p0 ... p100, mean, std) of the named columns; exact percentiles, population deviation."""
    long = metrics.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("m.*")
    rows = long.filter("value IS NOT NULL").groupBy("metric").agg(F.percentile("value", F.array(*[F.lit(p / 100) for p in PERCENTS])).alias("p"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return rows.select("metric", *[F.col("p")[k].alias(f"p{p}") for k, p in enumerate(PERCENTS)], "mean", "std")


def char_variance(chars: str = "chars") -> Column:
    """Variance over the squared mean of a document's page lengths; 0 for fewer than two pages or none but blank ones."""
    mean = F.avg(chars)
    return F.when((F.count(chars) < 2) | (mean == 0), 0.0).otherwise(F.var_pop(chars) / (mean * mean))


def column_estimate(points: DataFrame, key: str, x: str) -> DataFrame:
    """(key, column_count): columns of a layout, from the x of its spans: places of 20 units that hold a twentieth of them or more."""
    places = points.filter(F.col(x).isNotNull()).groupBy(key, (F.bround(F.col(x) / 20) * 20).alias("place")).agg(F.count("*").alias("n"))
    sums = places.groupBy(key).agg(F.sum("n").alias("total"), F.collect_list("n").alias("each"))
    return sums.select(key, F.when(F.col("total") < 10, 1).otherwise(F.size(F.filter("each", lambda n: n >= 0.05 * F.col("total")))).cast("int").alias("column_count"))


def table_blocks(lines: Column) -> Column:
    """Whether a block of lines (arrays of x) is a table: over two lines, and three places of 10 units or more."""
    return (F.size(lines) > 2) & (F.size(F.array_distinct(F.transform(F.flatten(lines), lambda x: F.bround(x / 10)))) >= 3)


def rules(found: Mapping[str, Mapping[str, float]]) -> tuple[Rule, ...]:
    """Rules from thresholds {metric: {p25: value, ...}}; a missing percentile leaves the built-in number."""
    at = lambda metric, p, otherwise: found.get(metric, {}).get(p, otherwise)
    chars, images, tables = "avg_chars_per_page", "image_area_ratio", "table_count"
    return (
        Rule("simple_text", 0.8, "fast_text", {}, {chars: at(chars, "p50", 1000), images: at(images, "p25", 0.1), tables: at(tables, "p25", 1), "column_count": 2}),
        Rule("moderate_complexity", 0.7, "layout", {chars: at(chars, "p50", 1000)}, {chars: at(chars, "p75", 2000), images: at(images, "p50", 0.3), tables: at(tables, "p50", 3), "column_count": 3}),
        Rule("high_complexity", 0.6, "vision", {chars: at(chars, "p75", 2000), images: at(images, "p50", 0.3), tables: at(tables, "p50", 3), "column_count": 3}, {}),
    )


def collected(table: DataFrame) -> dict[str, dict[str, float]]:
    """thresholds() as a dictionary: one row for each metric."""
    return {r.metric: {k: r[k] for k in table.columns if k != "metric"} for r in table.collect()}
