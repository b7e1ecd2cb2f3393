"""Column expressions that the operators share. All are built-in Spark expressions.

The workbench's meaning of "strip", "blank", "missing", "number" and "date" lives here and nowhere else.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "(missing)"
OTHER = "(other)"

# The shapes of plain numbers, of numbers that are rather codes, and of dates.
PLAIN_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
LEADING_ZERO = r"^[+-]?0\d+$"
DATE_SHAPE = r"\d{4}[-/]\d{1,2}([-/]\d{1,2})?|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|[A-Za-z]{3,9}\s+\d{1,2}(,?\s+\d{2,4})?"
DATE_START = r"(?i)^\d{4}[-/]\d{1,2}[-/]\d{1,2}|^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
GRAINS = ("day", "week", "month", "quarter", "year")

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, NUMERIC)


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


def is_temporal(kind: T.DataType) -> bool:
    return isinstance(kind, TEMPORAL)


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def fold(c: Column) -> Column:
    """For comparing without case; the upper-case step joins letters such as sharp s and ss.

    The concatenation keeps the optimizer from dropping that step.
    """
    return F.lower(F.concat(F.upper(c), F.lit("")))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def missing(c: Column, kind: T.DataType) -> Column:
    """NULL, or text of white space only. Never null itself."""
    return (c.isNull() | F.coalesce(is_blank(c), F.lit(False))) if is_text(kind) else c.isNull()


def label(c: Column) -> Column:
    """A category's name: trimmed text, with one name for all missing values."""
    text = strip(c.cast("string"))
    return F.when(text.isNull() | (text == ""), F.lit(MISSING)).otherwise(text)


def null_label(c: Column) -> Column:
    """As ``label``, but only NULL is missing and nothing is trimmed."""
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def finite(c: Column) -> Column:
    """The value where it is a finite number, else NULL."""
    number = c.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def without_nan(c: Column, kind: T.DataType) -> Column:
    return F.when(~F.isnan(c), c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c


def to_number(c: Column, kind: T.DataType) -> Column:
    """A double, or NULL where the value is not a plain number."""
    if is_numeric(kind) or isinstance(kind, T.BooleanType):
        return without_nan(c, kind).cast("double")
    if is_text(kind):
        text = strip(c)
        return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))
    return F.lit(None).cast("double")


#: Formats tried in order; the first that fits gives the date.
DATE_FORMATS = (
    "yyyy-M-d'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-M-d HH:mm:ss[.SSSSSS][.SSS]", "yyyy-M-d HH:mm", "yyyy-M-d'T'HH:mm", "yyyy-M-d", "yyyy/M/d", "yyyy-M", "yyyyMMdd",
    "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "M/d/yy", "M/d/yyyy HH:mm:ss", "M/d/yyyy HH:mm", "MMM d yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy",
)


def to_timestamp(c: Column, kind: T.DataType) -> Column:
    """TIMESTAMP_NTZ in UTC from any accepted spelling, else NULL. A bare time of day is not a date."""
    if isinstance(kind, T.TimestampNTZType):
        return c
    if is_temporal(kind):
        return c.cast("timestamp_ntz")
    if not is_text(kind):
        return F.lit(None).cast("timestamp_ntz")
    text = strip(c)
    zoned = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[T ].*(Z|[+-]\d{2}:?\d{2})$"), F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz"))
    tries = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS]
    found = F.when(text.rlike(r"\d"), F.coalesce(zoned, *tries))
    return F.when(text.rlike(r"^\d{1,2}:\d{2}"), F.lit(None).cast("timestamp_ntz")).otherwise(found)


def year_start(c: Column) -> Column:
    """1 January of a year given as a number."""
    one = F.lit(1)
    return F.make_timestamp_ntz(c.cast("int"), one, one, F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))


def are_years(df: DataFrame, name: str) -> bool:
    """Whether the column holds values and all of them are whole years from 1900 to 2100."""
    kind = df.schema[name].dataType
    if not (is_numeric(kind) or is_text(kind)):
        return False
    number = to_number(col(name), kind)
    held = (col(name).isNotNull() & ~missing(col(name), kind)) if is_text(kind) else col(name).isNotNull()
    fits = F.coalesce(number.between(1900, 2100) & (number % 1 == 0), F.lit(False))
    row = df.filter(held).agg(F.count(F.lit(1)), F.bool_and(fits)).first()
    return bool(row[0] and row[1])


def dates_of(df: DataFrame, name: str) -> Column:
    """The column as dates: as calendar years where all values are such, else parsed."""
    kind = df.schema[name].dataType
    if is_temporal(kind):
        return to_timestamp(col(name), kind)
    if are_years(df, name):
        return year_start(to_number(col(name), kind))
    return to_timestamp(col(name), kind)


def bucket(ts: Column, grain: str) -> Column:
    """Start of the day, week (from Monday), month, quarter or year."""
    if grain not in GRAINS:
        raise ValueError(f"date grain must be one of {', '.join(GRAINS)}")
    return F.date_trunc(grain, ts).cast("timestamp_ntz")


def bin_index(value: Column, low: float, high: float, bins: int) -> Column:
    """0-based number of the equal-width bin, closed on the right, the lowest edge included."""
    if bins == 1 or high <= low:
        return F.lit(0).cast("long")
    width = (high - low) / bins
    return (F.greatest(F.least(F.ceil((value - F.lit(low)) / F.lit(width)), F.lit(bins)), F.lit(1)) - 1).cast("long")


def aggregate(function: str, c: Column) -> Column:
    """One of the seven aggregate functions; the values must be numbers for mean, median and sum."""
    functions = {"count": F.count, "mean": F.avg, "median": F.median, "sum": F.sum, "min": F.min, "max": F.max, "distinct_count": F.count_distinct}
    if function not in functions:
        raise ValueError(f"unknown aggregate {function!r}")
    return functions[function](c)


def total(columns: Iterable[Column]) -> Column:
    out = F.lit(0)
    for c in columns:
        out = out + c
    return out
