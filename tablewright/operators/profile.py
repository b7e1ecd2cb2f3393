"""Dataset profiles: counts, a table of columns, a numeric summary, quality issues and a health score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.dataset import ROW_KEY, Dataset
from tablewright.functions.exprs import col, is_numeric, missing
from tablewright.operators.stats import TableStats


@dataclass(frozen=True)
class QualityIssue:
    severity: str
    title: str
    detail: str
    column: str | None = None


@dataclass(frozen=True)
class DatasetProfile:
    rows: int
    columns: int
    size_estimate: int
    duplicate_rows: int
    score: int
    column_profile: list[dict]
    numeric_summary: list[dict]
    issues: tuple[QualityIssue, ...]

    @property
    def missing_cells(self) -> int:
        return sum(c["missing_count"] for c in self.column_profile)


def column_profile(df: DataFrame) -> DataFrame:
    """column, missing_count, missing_percent, unique_count of every column, as one DataFrame."""
    fields = [f for f in df.schema if f.name != ROW_KEY]
    cells = F.array(*(
        F.struct(F.lit(f.name).alias("column"), missing(col(f.name), f.dataType).cast("int").alias("gone"), col(f.name).cast("string").alias("value")) for f in fields
    ))
    long = df.select(F.explode(cells).alias("c")).select("c.*")
    by_value = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("gone").alias("gone"))
    return by_value.groupBy("column").agg(
        F.sum("gone").alias("missing_count"), F.round(100 * F.sum("gone") / F.sum("n"), 2).alias("missing_percent"), F.count("value").alias("unique_count")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """duplicate_rows: rows equal to an earlier one, NULL equal to NULL; one row."""
    names = [c for c in df.columns if c != ROW_KEY]
    groups = df.groupBy(*map(col, names)).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def numeric_summary(df: DataFrame) -> DataFrame:
    """column, count, mean, std, min, q1, median, q3, max of every number column, from one aggregate."""
    names = [f.name for f in df.schema if is_numeric(f.dataType) and f.name != ROW_KEY]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, count long, mean double, std double, min double, q1 double, median double, q3 double, max double")
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    rows = []
    for name in names:
        c = col(name).cast("double")
        rows.append(F.struct(
            F.lit(name).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"),
            F.percentile(c, quarters).alias("q"), F.max(c).alias("max"),
        ))
    out = df.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    return out.select("column", "count", "mean", "std", "min", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"), "max")


def quality_issues(rows: int, columns: list[dict], duplicates: int) -> tuple[QualityIssue, ...]:
    """Duplicates first, then each column's issues in the order missing, constant, identifier."""
    if not rows or not columns:
        return (QualityIssue("critical", "Empty dataset", "There are no rows or no columns to analyse."),)
    out = []
    if duplicates:
        share = duplicates / rows
        out.append(QualityIssue("warning" if share < 0.1 else "critical", "Duplicate rows", f"{duplicates:,} rows ({share:.1%}) repeat an earlier row."))
    for c in columns:
        if c["missing_count"]:
            high = c["missing_percent"] >= 30
            out.append(QualityIssue("critical" if high else "warning", "High missingness" if high else "Missing values", f"{c['missing_percent']:.1f}% of the values are missing.", c["column"]))
        if c["unique_count"] <= 1:
            out.append(QualityIssue("warning", "Constant column", "The column has at most one distinct value.", c["column"]))
        if rows >= 20 and c["unique_count"] == rows:
            out.append(QualityIssue("info", "Possible identifier", "Every row has its own value.", c["column"]))
    return tuple(out)


def health_score(rows: int, columns: list[dict], duplicates: int) -> int:
    """100 less shares of missing cells (55 at most), of duplicate rows (30) and of constant columns (15)."""
    if not rows or not columns:
        return 0
    gone = 100 * sum(c["missing_count"] for c in columns) / (rows * len(columns))
    constant = sum(c["unique_count"] <= 1 for c in columns)
    return max(0, round(100 - min(55, gone) - min(30, 100 * duplicates / rows) - min(15, constant / len(columns) * 20)))


def size_estimate(df: DataFrame) -> int:
    """Bytes by the optimizer's statistics: an estimate, as a distributed table has no one size in memory."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def profile(data: Dataset, stats: TableStats | None = None) -> DatasetProfile:
    """The whole profile. ``stats`` may be shared with roles and cleaning."""
    stats = stats or TableStats(data)
    table = []
    for c in stats.columns.values():
        table.append({
            "column": c.name, "dtype": c.kind.simpleString(), "missing_count": c.missing, "missing_percent": round(100 * c.missing / c.rows, 2) if c.rows else 0.0,
            "unique_count": c.distinct, "examples": ", ".join(c.examples) or "—",
        })
    numbers = [{"column": n, **{k: v[k] for k in ("count", "mean", "std", "min", "q1", "median", "q3", "max")}} for n, v in stats.numbers.items()]
    duplicates = stats.duplicates if stats.rows else 0
    return DatasetProfile(
        stats.rows, len(table), size_estimate(data.visible), duplicates, health_score(stats.rows, table, duplicates), table, numbers,
        quality_issues(stats.rows, table, duplicates),
    )


def metadata_brief(stats: TableStats, semantics) -> dict:
    """Row count and, per column, name, role, format, distinct count and NULL share; never a value."""
    columns = []
    for s in semantics:
        c = stats.columns[s.column]
        columns.append({"name": s.column, "role": s.role, "format": s.display_format, "unique": c.distinct, "missing_percent": round(100 * c.nulls / c.rows, 2) if c.rows else 0.0})
    return {"rows": stats.rows, "columns": columns}
