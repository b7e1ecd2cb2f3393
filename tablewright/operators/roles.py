"""Roles of columns, and charts recommended for them. Driver-side rules over shared statistics."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T

from tablewright.dataset import Dataset
from tablewright.functions.exprs import is_numeric, is_temporal, is_text
from tablewright.operators.stats import ColumnStats, TableStats

ROLES = ("identifier", "numeric", "categorical", "datetime", "text", "ignore")
GOALS = ("Overview", "Trends", "Compare", "Distributions", "Relationships", "Data quality")
PIE_SLICES = 7

# Words in column names that tell what a column is.
ID_WORDS = {"uuid", "guid"}
KEY_WORDS = {"key", "code", "number"}
DATE_WORDS = {"date", "datetime", "timestamp", "time", "day", "month", "year"}
CLASS_WORDS = {"category", "class", "group", "segment", "status", "tier", "type"}
MONEY_PARTS = ("price", "cost", "revenue", "sales", "spend", "amount", "income")
SHARE_PARTS = ("percent", "percentage", "pct", "rate", "ratio")


@dataclass(frozen=True)
class ColumnSemantic:
    column: str
    role: str
    confidence: float
    display_format: str
    reason: str


@dataclass(frozen=True)
class ColumnRoles:
    identifier: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    datetime: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()


@dataclass(frozen=True)
class ChartSuggestion:
    kind: str
    title: str
    explanation: str = ""
    x: str | None = None
    y: str | None = None
    aggregation: str | None = None
    date_grain: str | None = None
    confidence: float = field(default=0.9)


def name_words(name: str) -> set[str]:
    return set(filter(None, re.split(r"[^a-z0-9]+", name.lower())))


def classify(c: ColumnStats) -> ColumnSemantic:
    """The first rule that fits decides."""
    lowered, words = c.name.lower(), name_words(c.name)
    ratio = c.distinct / c.present if c.present else 0.0

    def of(role: str, confidence: float, shown: str, reason: str) -> ColumnSemantic:
        return ColumnSemantic(c.name, role, confidence, shown, reason)

    if lowered == "id" or lowered.endswith("_id") or lowered.startswith("id_") or words & ID_WORDS or (words & KEY_WORDS and ratio >= 0.8):
        return of("identifier", 0.99, "ID", "The name marks an identifier.")
    if not c.present:
        return of("ignore", 0.99, "Empty", "There are no values.")
    if c.distinct == 1:
        return of("ignore", 0.97, "Constant", "All values are the same.")
    if is_temporal(c.kind):
        return of("datetime", 0.99, "Date/time", "The type is a date or time.")
    if is_numeric(c.kind) and "year" in words and c.years:
        return of("datetime", 0.96, "Year", "All values are calendar years.")
    if is_text(c.kind):
        hint = bool(words & DATE_WORDS)
        if c.parse_rate >= 0.8 and hint or c.shape_rate >= 0.8 and c.parse_rate >= 0.95:
            return of("datetime", min(0.98, 0.72 + 0.24 * c.parse_rate + 0.04 * hint), "Date/time", "The first values parse as dates.")
    if is_numeric(c.kind):
        if words & CLASS_WORDS and c.distinct <= 50:
            return of("categorical", 0.86, "Category", "The name marks a class and there are few values.")
        return of("numeric", 0.94, number_format(c), "The type is a number.")
    if isinstance(c.kind, T.BooleanType):
        return of("categorical", 0.99, "Category", "The type is Boolean.")
    if is_text(c.kind):
        if 2 <= c.distinct <= 50 and ratio <= 0.6:
            return of("categorical", 0.88, "Category", "Few values repeat often.")
        return of("text", 0.82, "Text", "Many different texts.")
    return of("ignore", 0.55, "Unknown", "The type has no analytical meaning here.")


def number_format(c: ColumnStats) -> str:
    lowered = c.name.lower()
    if any(p in lowered for p in MONEY_PARTS):
        return "Currency"
    if any(p in lowered for p in SHARE_PARTS) or (c.unit and c.distinct > 2):
        return "Percentage"
    return "Number"


def infer_semantics(data: Dataset, stats: TableStats | None = None) -> tuple[ColumnSemantic, ...]:
    return tuple(classify(c) for c in (stats or TableStats(data)).columns.values())


def roles_from(mapping: Mapping[str, str]) -> ColumnRoles:
    """Roles by column as tuples by role; an unknown role counts as ignore."""
    out: dict[str, list[str]] = {r: [] for r in ROLES}
    for column, role in mapping.items():
        out[role if role in out else "ignore"].append(column)
    return ColumnRoles(**{r: tuple(v) for r, v in out.items()})


def infer_roles(data: Dataset, stats: TableStats | None = None) -> ColumnRoles:
    return roles_from({s.column: s.role for s in infer_semantics(data, stats)})


@dataclass(frozen=True)
class ChartRule:
    """A kind of chart for everything that ``over`` binds; texts and columns are filled in from the binding.

    ``short`` names the rule that makes up for what is missing, ``none`` the one for when nothing is bound.
    """

    over: str
    kind: str
    confidence: float
    title: str
    explanation: str
    x: str | None
    y: str | None
    function: str | None = None
    dated: bool = False
    short: str | None = None
    none: str | None = None


# Kinds, columns and confidences of the charts, and how many of which serve a goal.
CHART_RULES = {
    "gaps": ChartRule("table", "missingness", 1.0, "Missing values by column", "Share of rows without a value, by column.", "column", "missing_percent"),
    "counts": ChartRule("category", "category_count", 0.95, "Rows by {category}", "Exact counts; missing values have a group of their own.", "{category}", "count"),
    "shares": ChartRule("slices", "pie", 0.93, "Share of rows by {category}", "Shares of all rows.", "{category}", "count", short="counts"),
    "spread": ChartRule("measure", "box", 0.88, "Spread of {measure}{split}", "Quartiles and extremes.", "{measure}", "{group}"),
    "running": ChartRule("dated", "time_area", 0.86, "Running total of {measure}", "Sum so far at each period.", "{date}", "{measure}", "sum", True, none="running_rows"),
    "running_rows": ChartRule("date", "time_area", 0.86, "Running total of rows", "Sum so far at each period.", "{date}", None, "count", True),
    "histogram": ChartRule("measure", "histogram", 0.92, "Distribution of {measure}", "Rows by range of values.", "{measure}", "count"),
    "trend": ChartRule("dated", "time_series", 0.88, "{function} of {measure} over time", "One value per period.", "{date}", "{measure}", "chosen", True, none="trend_rows"),
    "trend_rows": ChartRule("date", "time_series", 0.92, "Rows over time", "Rows per period.", "{date}", None, "count", True),
    "compare": ChartRule("grouped", "category_aggregate", 0.9, "{function} of {measure} by {group}", "One value per category.", "{group}", "{measure}", "chosen"),
    "pairs": ChartRule("pair", "scatter", 0.85, "{measure} against {other}", "One point per complete row.", "{measure}", "{other}"),
}
GOAL_RULES = {
    "Overview": {"gaps": 1, "shares": 1, "trend": 1, "spread": 1},
    "Trends": {"trend": 2, "running": 1},
    "Compare": {"compare": 2, "shares": 1, "counts": 1},
    "Distributions": {"histogram": 2, "spread": 2},
    "Relationships": {"pairs": 2, "spread": 1, "compare": 1},
    "Data quality": {"gaps": 1, "counts": 2},
}
#: What fills an overview of fewer than four charts.
SPARE_RULES = ("compare", "histogram", "pairs")


def _bindings(stats: TableStats, roles: ColumnRoles) -> dict[str, list[dict[str, str]]]:
    """The columns that each kind of rule can be filled in with."""
    group = {"group": roles.categorical[0], "split": f" by {roles.categorical[0]}"} if roles.categorical else {"split": ""}
    measures = [{"measure": c, **group} for c in roles.numeric]
    dates = [{"date": c} for c in roles.datetime[:1]]
    return {
        "table": [{}] if any(c.missing for c in stats.columns.values()) else [],
        "category": [{"category": c} for c in roles.categorical],
        "slices": [{"category": c} for c in roles.categorical if 2 <= stats.columns[c].distinct_or_null <= PIE_SLICES + 1],
        "measure": measures, "grouped": measures if roles.categorical else [], "date": dates, "dated": [d | m for d in dates for m in measures],
        "pair": [{"measure": a, "other": b} for a, b in zip(roles.numeric, roles.numeric[1:], strict=False)],
    }


def suggest_charts(
    stats: TableStats, roles: ColumnRoles, goal: str = "Overview", *, most: int = 4, aggregation: str = "mean", grain: str = "month"
) -> tuple[ChartSuggestion, ...]:
    """At most ``most`` charts for a goal, by its rules in their order; an unknown goal is an overview."""
    if not stats.rows or most <= 0:
        return ()
    bound = _bindings(stats, roles)

    def made(name: str, n: int) -> list[ChartSuggestion]:
        rule = CHART_RULES[name]
        out = []
        for own in bound[rule.over][:n]:
            function = aggregation if rule.function == "chosen" else rule.function
            fill = lambda text: text and (text.format(function=function, **own) if not (text == "{group}" and "group" not in own) else None)  # noqa: B023, E731
            out.append(ChartSuggestion(rule.kind, fill(rule.title), rule.explanation, fill(rule.x), fill(rule.y), function, grain if rule.dated else None, rule.confidence))
        if rule.short and len(out) < n:
            out += made(rule.short, n - len(out))
        if rule.none and not out:
            out += made(rule.none, n)
        return out

    wanted = GOAL_RULES.get(goal, GOAL_RULES["Overview"])
    out = [chart for name, n in wanted.items() for chart in made(name, n)]
    for name in SPARE_RULES if wanted is GOAL_RULES["Overview"] else ():
        if len(out) < 4:
            out += [chart for chart in made(name, 1) if chart not in out]
    return tuple(out[:most])
