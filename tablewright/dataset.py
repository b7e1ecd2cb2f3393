"""A table under work: a DataFrame, checked names, NaN as NULL, and a hidden row order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.exprs import col, without_nan

ROW_KEY = "__row_key"


class LoadError(ValueError):
    """The input can't be loaded."""


@dataclass(frozen=True)
class Limits:
    """Bounds for uploads; ``None`` turns one off. Parquet is read without limits unless given."""

    max_upload_bytes: int | None = 25 * 1024 * 1024
    max_rows: int | None = 250_000
    max_columns: int | None = 500
    max_expanded_bytes: int | None = 250 * 1024 * 1024
    max_archive_members: int | None = 10_000

    def __post_init__(self) -> None:
        for name, value in vars(self).items():
            if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value <= 0):
                raise ValueError(f"{name} must be a positive whole number")


NO_LIMITS = Limits(None, None, None, None, None)


@dataclass(frozen=True)
class Dataset:
    """``frame`` has the user's columns and ROW_KEY, by which rows are ordered; ``name`` is for display."""

    frame: DataFrame
    name: str = "data"

    @property
    def columns(self) -> list[str]:
        return [c for c in self.frame.columns if c != ROW_KEY]

    @property
    def visible(self) -> DataFrame:
        """Without the hidden order."""
        return self.frame.drop(ROW_KEY)

    def with_frame(self, frame: DataFrame) -> Dataset:
        return Dataset(frame, self.name)


def check_names(names: list[str]) -> list[str]:
    """Names trimmed; blank or equal ones are errors."""
    clean = [str(n).strip() for n in names]
    if any(not n for n in clean):
        raise LoadError("every column needs a non-empty header")
    if len(set(clean)) != len(clean):
        raise LoadError("column headers must be unique")
    return clean


def from_frame(df: DataFrame, name: str = "data", limits: Limits = NO_LIMITS, key=None) -> Dataset:
    """Wraps a DataFrame: names checked, NaN made NULL, an order key added, shape limits applied."""
    names = check_names(df.columns)
    if not names:
        raise LoadError("the table has no columns")
    if limits.max_columns is not None and len(names) > limits.max_columns:
        raise LoadError(f"the table has more than {limits.max_columns} columns")
    order = F.monotonically_increasing_id() if key is None else key
    fields = [without_nan(col(old), df.schema[old].dataType).alias(new) for old, new in zip(df.columns, names, strict=True)]
    frame = df.select(*fields, order.alias(ROW_KEY))
    if limits.max_rows is not None:
        seen = frame.limit(limits.max_rows + 1).count()
        if not seen:
            raise LoadError("the table has no data rows")
        if seen > limits.max_rows:
            raise LoadError(f"the table has more than {limits.max_rows} rows")
    return Dataset(frame, name)


def read_parquet(spark: SparkSession, path: str, name: str | None = None, limits: Limits = NO_LIMITS) -> Dataset:
    """A Parquet table; file and row index make its order."""
    df = spark.read.parquet(path)
    key = F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    return from_frame(df, name or path.rsplit("/", 1)[-1], limits, key)
