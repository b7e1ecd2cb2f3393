"""The audit tables behind charts. Every function gives a small DataFrame; nothing is drawn from other data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.dataset import ROW_KEY, Dataset
from tablewright.functions.exprs import OTHER, aggregate, bin_index, bucket, col, dates_of, finite, label, missing, null_label, to_number
from tablewright.operators.roles import ChartSuggestion

TOP_CATEGORIES, TOP_BOXES, TOP_SLICES, SCATTER_POINTS = 15, 8, 7, 5_000


class ChartError(ValueError):
    """The chart's data can't be built."""


def _number(df: DataFrame, name: str) -> Column:
    return to_number(col(name), df.schema[name].dataType)


def missingness(df: DataFrame) -> DataFrame:
    """column, missing_percent of the columns with NULL or blank values, the most missing first."""
    fields = [f for f in df.schema if f.name != ROW_KEY]
    shares = [F.struct(F.lit(f.name).alias("column"), F.round(100 * F.avg(missing(col(f.name), f.dataType).cast("int")), 2).alias("missing_percent")) for f in fields]
    long = df.agg(F.array(*shares).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    return long.filter("missing_percent > 0").orderBy(F.desc("missing_percent"), "column")


def category_count(df: DataFrame, x: str, top: int = TOP_CATEGORIES) -> DataFrame:
    """x, count of the most frequent labels; ties by label."""
    return df.groupBy(label(col(x)).alias(x)).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), col(x)).limit(top)


def pie(df: DataFrame, x: str, top: int = TOP_SLICES) -> DataFrame:
    """x, count, share_percent: the most frequent labels and, if anything is left, the rest together; shares of all rows."""
    counts = df.groupBy(label(col(x)).alias("x")).agg(F.count(F.lit(1)).alias("count"))
    first = counts.orderBy(F.desc("count"), "x").limit(top)
    # The rest is the total less the first: two small aggregates instead of a window over all labels in one task.
    sums = counts.agg(F.sum("count").alias("total"))
    shown = first.agg(F.collect_list(F.struct("x", "count")).alias("rows"), F.coalesce(F.sum("count"), F.lit(0)).alias("shown"))
    both = shown.withColumn("total", sums.scalar())
    rest = F.array(F.struct(F.lit(OTHER).alias("x"), (F.col("total") - F.col("shown")).alias("count")))
    out = both.select("total", F.explode(F.when(F.col("total") > F.col("shown"), F.concat("rows", rest)).otherwise(F.col("rows"))).alias("r"))
    return out.select(F.col("r.x").alias(x), F.col("r.count").alias("count"), F.round(100 * F.col("r.count") / F.col("total"), 2).alias("share_percent")).orderBy(
        (F.col("r.x") == OTHER).cast("int"), F.desc("count"), F.col("r.x")
    )


def box(df: DataFrame, y: str, group: str | None = None, top: int = TOP_BOXES) -> DataFrame:
    """group, count, min, q1, median, q3, max of the largest groups by values present."""
    name = group or y
    key = label(col(group)) if group else F.lit("all rows")
    value = F.coalesce(_number(df, y))
    plain = df.select(key.alias("key"), value.alias("v")).filter(F.col("v").isNotNull())
    kept = plain.groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(top).select("key")
    quarters = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = plain.join(F.broadcast(kept), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.min("v").alias("min"), quarters.alias("q"), F.max("v").alias("max"))
    r = lambda c: F.round(c, 4)
    return out.select(
        F.col("key").alias(name), "count", r(F.col("min")).alias("min"), r(F.get("q", F.lit(0))).alias("q1"), r(F.get("q", F.lit(1))).alias("median"),
        r(F.get("q", F.lit(2))).alias("q3"), r(F.col("max")).alias("max"),
    ).orderBy(F.desc("count"), F.col(name))


def bin_count(count: int, distinct: int, low: float, high: float, q1: float, q3: float) -> int:
    """Freedman-Diaconis, from 3 to 20 bins."""
    if distinct <= 1:
        return 1
    spread = q3 - q1
    if spread <= 0:
        return min(12, max(3, math.ceil(math.sqrt(distinct))))
    return min(20, max(3, math.ceil((high - low) / (2 * spread * count ** (-1 / 3)))))


def binned(df: DataFrame, value: Column, bins: int | None) -> DataFrame:
    """bin_start, bin_end, bin, count of equal-width bins over the finite values; empty bins are kept.

    Two passes: the extremes (and quartiles, where the number of bins is not given), then the counts.
    """
    spark = df.sparkSession
    plain = df.select(finite(value).alias("v")).filter(F.col("v").isNotNull())
    aggs = [F.count(F.lit(1)), F.min("v"), F.max("v")]
    if bins is None:
        aggs += [F.count_distinct("v"), F.percentile("v", F.array(F.lit(0.25), F.lit(0.75)))]
    row = plain.agg(*aggs).first()
    if not row[0]:
        raise ChartError("there are no numbers to bin")
    n, low, high = row[0], row[1], row[2]
    bins = bins if bins is not None else bin_count(n, row[3], low, high, *row[4])
    bins = 1 if low == high else bins
    width = (high - low) / bins
    edges = spark.range(bins).select(F.col("id").alias("i"), (F.lit(low) + F.col("id") * width).alias("bin_start"), (F.lit(low) + (F.col("id") + 1) * width).alias("bin_end"))
    counts = plain.groupBy(bin_index(F.col("v"), low, high, bins).alias("i")).agg(F.count(F.lit(1)).alias("count"))
    out = edges.join(F.broadcast(counts), "i", "left").orderBy("i")
    shown = F.concat(F.when(F.col("i") == 0, F.lit("[")).otherwise(F.lit("(")), F.round("bin_start", 4).cast("string"), F.lit(", "), F.round("bin_end", 4).cast("string"), F.lit("]"))
    return out.select("bin_start", "bin_end", shown.alias("bin"), F.coalesce("count", F.lit(0)).alias("count"))


def histogram(df: DataFrame, x: str, bins: int | None = None) -> DataFrame:
    """x, count over automatic bins."""
    return binned(df, _number(df, x), bins).select(F.col("bin").alias(x), "count")


def time_series(df: DataFrame, x: str, y: str | None = None, function: str = "mean", grain: str = "month") -> DataFrame:
    """x, y (or count) per period, ascending. Rows without a date (or value) don't count."""
    period = bucket(dates_of(df, x), grain)
    if y is None:
        plain = df.select(period.alias("x")).filter(F.col("x").isNotNull())
        return plain.groupBy(F.col("x").alias(x)).agg(F.count(F.lit(1)).alias("count")).orderBy(x)
    plain = df.select(period.alias("x"), _number(df, y).alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    return plain.groupBy(F.col("x").alias(x)).agg(aggregate(function, F.col("y")).alias(y)).orderBy(x)


def time_area(df: DataFrame, x: str, y: str | None = None, grain: str = "month") -> DataFrame:
    """x, y (or count), cumulative: sums per period and their running total. One row per period reaches the window."""
    per = time_series(df, x, y, "sum", grain)
    return per.withColumn("cumulative", F.sum(y or "count").over(Window.orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow))).orderBy(x)


def category_aggregate(df: DataFrame, x: str, y: str, function: str = "mean", top: int = TOP_CATEGORIES) -> DataFrame:
    """x, y of the categories with the largest values. Labels are not trimmed here, and blank text is a label."""
    plain = df.select(null_label(col(x)).alias("x"), _number(df, y).alias("y")).filter(F.col("y").isNotNull())
    return plain.groupBy(F.col("x").alias(x)).agg(aggregate(function, F.col("y")).alias(y)).orderBy(F.desc(y), x).limit(top)


def scatter(df: DataFrame, x: str, y: str, most: int = SCATTER_POINTS, seed: int = 42) -> DataFrame:
    """x, y of complete rows, in row order; of more than ``most`` a repeatable sample of exactly so many."""
    plain = df.select(F.col(ROW_KEY), _number(df, x).alias("x"), _number(df, y).alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    drawn = plain.orderBy(F.xxhash64(ROW_KEY, F.lit(seed)), ROW_KEY).limit(most)  # a top-k per partition, not a sort of all
    return drawn.orderBy(ROW_KEY).select(F.col("x").alias(x), F.col("y").alias("y" if x == y else y))


def chart_data(data: Dataset, s: ChartSuggestion) -> DataFrame:
    """The audit table of a suggested chart."""
    df = data.frame
    if s.kind == "missingness":
        return missingness(df)
    if s.kind == "category_count":
        return category_count(df, s.x)
    if s.kind == "pie":
        return pie(df, s.x)
    if s.kind == "box":
        return box(df, s.x, s.y)
    if s.kind == "histogram":
        return histogram(df, s.x)
    if s.kind == "time_series":
        return time_series(df, s.x, s.y, s.aggregation or "mean", s.date_grain or "month")
    if s.kind == "time_area":
        return time_area(df, s.x, s.y, s.date_grain or "month")
    if s.kind == "category_aggregate":
        return category_aggregate(df, s.x, s.y, s.aggregation or "mean")
    if s.kind == "scatter":
        return scatter(df, s.x, s.y)
    raise ChartError(f"unknown chart {s.kind!r}")


MARKS = {
    "missingness": "bar", "category_count": "bar", "pie": "arc", "box": "box", "histogram": "bar", "time_series": "line", "time_area": "area",
    "category_aggregate": "bar", "scatter": "point", "bar": "bar", "line": "line", "distribution": "bar",
}


def chart_spec(kind: str, title: str, table: DataFrame) -> dict:
    """A drawing specification of exactly the audit rows: mark, encodings and values."""
    if kind not in MARKS:
        raise ChartError(f"unknown chart {kind!r}")
    names = table.columns
    rows = [r.asDict() for r in table.limit(SCATTER_POINTS).collect()]
    return {"title": title, "mark": MARKS[kind], "x": names[0], "y": "cumulative" if "cumulative" in names else names[-1] if kind in ("histogram", "distribution") else names[min(1, len(names) - 1)], "values": rows}
