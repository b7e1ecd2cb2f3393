"""Visual queries: one shape of projection, filters, groups, aggregates, sort and limit, compiled to DataFrame operations."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.exprs import col, is_numeric, is_temporal

RELATION = "uploaded_data"
MOST_ROWS = 5_000
COMPARISONS = {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
TEXT_TESTS = ("contains", "starts_with")
NULL_TESTS = ("is_null", "is_not_null")
FUNCTIONS = {"count_rows": "COUNT", "count_values": "COUNT", "mean": "AVG", "median": "MEDIAN", "sum": "SUM", "min": "MIN", "max": "MAX"}


class QueryError(ValueError):
    """The query can't be built or run."""


@dataclass(frozen=True)
class FilterRule:
    column: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class AggregateRule:
    function: str
    column: str | None = None
    alias: str | None = None

    @property
    def name(self) -> str:
        if self.alias is None:
            return "row_count" if self.function == "count_rows" else f"{self.function}_{self.column}"
        if not self.alias.strip():
            raise QueryError("an aggregate's name must not be blank")
        return self.alias.strip()


@dataclass(frozen=True)
class QuerySpec:
    selected_columns: tuple[str, ...] = ()
    filters: tuple[FilterRule, ...] = ()
    group_by: tuple[str, ...] = ()
    aggregates: tuple[AggregateRule, ...] = ()
    sort_by: str | None = None
    sort_descending: bool = False
    limit: int = 100


@dataclass(frozen=True)
class BuiltQuery:
    """SQL with named parameters, their values, and the same with the values in place, for display."""

    sql: str
    parameters: dict[str, Any]
    display: str


def operators_for(kind: T.DataType) -> tuple[str, ...]:
    """The filter operators that make sense for a type."""
    if isinstance(kind, T.BooleanType):
        return ("eq", "ne", *NULL_TESTS)
    if is_numeric(kind) or is_temporal(kind):
        return (*COMPARISONS, *NULL_TESTS)
    return ("eq", "ne", *TEXT_TESTS, *NULL_TESTS)


def coerce(value: Any, kind: T.DataType) -> Any:
    """A filter's value in the column's type."""
    if value is None:
        raise QueryError("this filter needs a value")
    text = str(value).strip()
    try:
        if isinstance(kind, T.BooleanType):
            word = text.lower()
            if word in ("true", "1", "yes"):
                return True
            if word in ("false", "0", "no"):
                return False
            raise ValueError
        if is_numeric(kind):
            number = float(text.replace(",", ""))
            if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
                return number
            if number != int(number):
                raise ValueError
            return int(text.replace(",", "")) if re.fullmatch(r"[+-]?[\d,]+", text) else int(number)
        if is_temporal(kind):
            return value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None)
    except (ValueError, OverflowError):
        raise QueryError(f"{value!r} is not a value of type {kind.simpleString()}") from None
    return str(value)


def _predicate(rule: FilterRule, kind: T.DataType) -> Column:
    c = col(rule.column)
    if rule.operator == "is_null":
        return c.isNull()
    if rule.operator == "is_not_null":
        return c.isNotNull()
    if rule.operator in TEXT_TESTS:
        text, part = F.lower(c.cast("string")), F.lower(F.lit("" if rule.value is None else str(rule.value)))
        return F.contains(text, part) if rule.operator == "contains" else F.startswith(text, part)
    value = F.lit(coerce(rule.value, kind))
    return {"eq": c == value, "ne": c != value, "gt": c > value, "gte": c >= value, "lt": c < value, "lte": c <= value}[rule.operator]


def _aggregate(rule: AggregateRule) -> Column:
    if rule.function == "count_rows":
        return F.count(F.lit(1))
    made = {"count_values": F.count, "mean": F.avg, "median": F.median, "sum": F.sum, "min": F.min, "max": F.max}
    return made[rule.function](col(rule.column))


def outputs(df: DataFrame, spec: QuerySpec) -> list[str]:
    """Names of the result's columns; everything about the specification is checked here."""
    known = set(df.columns)

    def check(names: tuple[str, ...], what: str) -> None:
        if len(set(names)) != len(names):
            raise QueryError(f"{what} names a column twice")
        if unknown := [n for n in names if n not in known]:
            raise QueryError(f"unknown columns: {', '.join(unknown)}")

    if isinstance(spec.limit, bool) or not isinstance(spec.limit, int) or not 1 <= spec.limit <= MOST_ROWS:
        raise QueryError(f"the limit must be a whole number from 1 to {MOST_ROWS}")
    check(spec.selected_columns, "the selection")
    check(spec.group_by, "the grouping")
    for rule in spec.filters:
        check((rule.column,), "a filter")
        if rule.operator not in (*COMPARISONS, *TEXT_TESTS, *NULL_TESTS):
            raise QueryError(f"unknown operator {rule.operator!r}")
    for rule in spec.aggregates:
        if rule.function not in FUNCTIONS:
            raise QueryError(f"unknown aggregate {rule.function!r}")
        if (rule.column is None) != (rule.function == "count_rows"):
            raise QueryError(f"{rule.function} {'takes no' if rule.column else 'needs a'} column")
        if rule.column is not None:
            check((rule.column,), "an aggregate")
            kind = df.schema[rule.column].dataType
            if rule.function in ("mean", "median", "sum") and not is_numeric(kind):
                raise QueryError(f"{rule.function} needs numbers, and {rule.column} has none")
    if spec.group_by and not spec.aggregates:
        raise QueryError("a grouping needs an aggregate")
    if spec.aggregates and spec.selected_columns:
        raise QueryError("aggregates and detail columns can't be combined")
    names = [*spec.group_by, *(r.name for r in spec.aggregates)] if spec.aggregates else list(spec.selected_columns or df.columns)
    if len(set(names)) != len(names):
        raise QueryError("two output columns have the same name")
    if spec.sort_by is not None and spec.sort_by not in names:
        raise QueryError(f"{spec.sort_by!r} is not an output column")
    return names


def run_query(df: DataFrame, spec: QuerySpec) -> DataFrame:
    """The result as a lazy DataFrame: filters reach the scan, aggregates are partial, sort and limit become a top-k."""
    names = outputs(df, spec)
    out = df
    if spec.filters:
        out = out.filter(reduce(and_, (_predicate(r, df.schema[r.column].dataType) for r in spec.filters)))
    if spec.aggregates:
        out = out.groupBy(*map(col, spec.group_by)).agg(*(_aggregate(r).alias(r.name) for r in spec.aggregates))
    out = out.select(*map(col, names))
    if spec.sort_by is not None:
        c = col(spec.sort_by)
        out = out.orderBy(c.desc_nulls_last() if spec.sort_descending else c.asc_nulls_last())
    return out.limit(spec.limit)


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value: Any) -> str:
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def build_query(df: DataFrame, spec: QuerySpec, table: str = RELATION) -> BuiltQuery:
    """The same query as SQL text for ``spark.sql(sql, args=parameters)``."""
    names = outputs(df, spec)
    parameters: dict[str, Any] = {}
    tests, shown = [], []
    for i, rule in enumerate(spec.filters):
        c = quote(rule.column)
        if rule.operator in NULL_TESTS:
            test = f"{c} IS {'NOT ' * (rule.operator == 'is_not_null')}NULL"
            tests.append(test)
            shown.append(test)
            continue
        key = f"p{i}"
        text = rule.operator in TEXT_TESTS
        parameters[key] = ("" if rule.value is None else str(rule.value)) if text else coerce(rule.value, df.schema[rule.column].dataType)
        form = f"{'contains' if rule.operator == 'contains' else 'startswith'}(lower(CAST({c} AS STRING)), lower({{}}))" if text else f"{c} {COMPARISONS[rule.operator]} {{}}"
        tests.append(form.format(f":{key}"))
        shown.append(form.format(literal(parameters[key])))
    made = [f"{FUNCTIONS[r.function]}({quote(r.column) if r.column else '*'}) AS {quote(r.name)}" for r in spec.aggregates]
    head = [*map(quote, spec.group_by), *made] if spec.aggregates else list(map(quote, names))

    def text(where: list[str]) -> str:
        lines = ["SELECT", "  " + ",\n  ".join(head), f"FROM {quote(table)}"]
        lines += ["WHERE " + "\n  AND ".join(where)] if where else []
        lines += ["GROUP BY " + ", ".join(map(quote, spec.group_by))] if spec.group_by else []
        lines += [f"ORDER BY {quote(spec.sort_by)} {'DESC' if spec.sort_descending else 'ASC'} NULLS LAST"] if spec.sort_by else []
        return "\n".join([*lines, f"LIMIT {spec.limit}"])

    return BuiltQuery(text(tests), parameters, text(shown))


def execute(df: DataFrame, spec: QuerySpec):
    """The result as pandas (at most MOST_ROWS rows), with Spark's errors as ours."""
    try:
        return run_query(df, spec).toPandas()
    except PySparkException as error:
        raise QueryError(str(error).splitlines()[0]) from error


def suggested_group(categorical: tuple[str, ...], datetime: tuple[str, ...]) -> str | None:
    """The column to group by at first."""
    return next(iter((*categorical, *datetime)), None)
