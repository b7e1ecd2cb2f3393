"""Cleaning: suggestions from shared statistics, lazy actions, replay, and portable recipes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.dataset import ROW_KEY, Dataset
from tablewright.functions.exprs import col, fold, is_blank, is_numeric, is_text, strip, to_number, to_timestamp
from tablewright.operators.roles import infer_semantics, name_words
from tablewright.operators.stats import TableStats

# The kinds, in the order in which a batch applies them.
ORDER = (
    "drop_duplicates", "trim_whitespace", "blank_to_missing", "normalize_categories", "convert_numeric", "convert_datetime", "fill_numeric_median",
    "fill_category_missing", "drop_column", "flag_outliers",
)
# Words of names whose digits are no numbers.
IDENTIFIER_WORDS = {"id", "uuid", "guid", "key", "code", "zip", "postal", "phone"}
RECIPE_FORMAT, RECIPE_VERSION = "tablewright-cleaning-recipe", 1


class CleaningError(ValueError):
    """An action or a recipe can't be applied."""


@dataclass(frozen=True)
class CleaningAction:
    kind: str
    column: str | None = None
    parameters: tuple[tuple[str, str], ...] = ()
    affected_rows: int = 0
    affected_percent: float = 0.0
    confidence: str = "high"
    evidence: str = ""
    action_id: str = field(default="")

    def __post_init__(self) -> None:
        if not self.action_id:
            object.__setattr__(self, "action_id", f"{self.kind}:{self.column or '*'}")

    def parameter(self, name: str) -> str:
        for key, value in self.parameters:
            if key == name:
                return value
        raise CleaningError(f"{self.kind} lacks its parameter {name!r}")


def _replaced(df: DataFrame, name: str, expression) -> DataFrame:
    return df.select(*(expression.alias(c) if c == name else col(c) for c in df.columns))


def _apply(df: DataFrame, action: CleaningAction) -> DataFrame:
    kind, name = action.kind, action.column
    visible = [c for c in df.columns if c != ROW_KEY]
    if kind == "drop_duplicates":
        return df.groupBy(*map(col, visible)).agg(F.min(ROW_KEY).alias(ROW_KEY)).select(*map(col, df.columns))
    if name not in visible:
        raise CleaningError(f"there is no column {name!r}")
    c, kind_of = col(name), df.schema[name].dataType
    text = is_text(kind_of)
    if kind == "drop_column":
        return df.select(*(col(x) for x in df.columns if x != name))
    if kind == "trim_whitespace":
        return _replaced(df, name, strip(c)) if text else df
    if kind == "blank_to_missing":
        return _replaced(df, name, F.when(~is_blank(c), c)) if text else df
    if kind == "normalize_categories":
        if not text:
            return df
        names = json.loads(action.parameter("canonical_map"))
        pairs = [F.lit(x) for item in names.items() for x in item]
        return _replaced(df, name, F.coalesce(F.try_element_at(F.create_map(*pairs), fold(strip(c))), c)) if pairs else df
    if kind == "convert_numeric":
        number = to_number(c, kind_of)
        whole = dict(action.parameters).get("whole")
        if whole is None:  # the result's type depends on all values
            whole = str(bool(df.agg(F.coalesce(F.bool_and(number % 1 == 0), F.lit(False))).first()[0])).lower()
        return _replaced(df, name, number.try_cast("long") if whole == "true" else number)
    if kind == "convert_datetime":
        return _replaced(df, name, to_timestamp(c, kind_of))
    if kind == "fill_numeric_median":
        return _replaced(df, name, F.coalesce(c.cast("double"), F.lit(float(action.parameter("value")))))
    if kind == "fill_category_missing":
        return _replaced(df, name, F.coalesce(c.cast("string"), F.lit(action.parameter("value"))))
    if kind == "flag_outliers":
        low, high = float(action.parameter("lower")), float(action.parameter("upper"))
        value = to_number(c, kind_of)
        flag = F.coalesce((value < low) | (value > high), F.lit(False))
        return df.withColumn(action.parameter("flag_column"), flag)
    raise CleaningError(f"unknown action {kind!r}")


def apply_actions(data: Dataset, actions: Iterable[CleaningAction]) -> Dataset:
    """One batch, in the fixed order of kinds. The result is lazy; nothing of the source changes."""
    actions = tuple(actions)
    ids = [a.action_id for a in actions]
    if len(set(ids)) != len(ids):
        raise CleaningError("an action is listed twice")
    dropped = {a.column for a in actions if a.kind == "drop_column"}
    if any(a.column in dropped for a in actions if a.kind != "drop_column" and a.column):
        raise CleaningError("a batch can't clean and drop the same column")
    if unknown := [a.kind for a in actions if a.kind not in ORDER]:
        raise CleaningError(f"unknown action {unknown[0]!r}")
    frame = data.frame
    for action in sorted(actions, key=lambda a: (ORDER.index(a.kind), a.column or "", a.action_id)):
        frame = _apply(frame, action)
    return data.with_frame(frame)


def replay(data: Dataset, batches: Iterable[Sequence[CleaningAction]]) -> Dataset:
    """All batches from the source; leaving the last one out undoes it."""
    for batch in batches:
        data = apply_actions(data, batch)
    return data


# ---- Suggestions -----------------------------------------------------------------------------------------------------


def category_spellings(df: DataFrame, name: str) -> DataFrame:
    """key, canonical, variants, spelling, n: spellings that are equal without case, with the one to use for all."""
    from pyspark.sql import Window

    text = strip(col(name))
    counts = df.select(text.alias("spelling")).filter((F.col("spelling") != "")).groupBy("spelling").agg(F.count(F.lit(1)).alias("n"))
    keyed = counts.withColumn("key", fold(F.col("spelling")))
    own = Window.partitionBy("key")
    best = F.first("spelling").over(own.orderBy(F.desc("n"), "spelling"))
    return keyed.withColumn("variants", F.count(F.lit(1)).over(own)).withColumn("canonical", best).filter("variants > 1")


def _spellings(stats: TableStats, names: list[str]) -> dict[str, list[dict]]:
    """key, canonical, spelling, changed of the spellings that differ in case alone, by column; one job for all columns of few values."""
    if not names:
        return {}
    s = strip(F.col("value"))
    rows = stats.values(names).select("column", F.col("value"), F.col("n"), s.alias("spelling"), fold(s).alias("key")).filter("spelling != ''").collect()
    out: dict[str, list[dict]] = {n: [] for n in names}
    for name in names:
        groups: dict[str, dict[str, int]] = {}
        for r in rows:
            if r["column"] == name:
                counts = groups.setdefault(r["key"], {})
                counts[r["spelling"]] = counts.get(r["spelling"], 0) + r["n"]
        canonical = {key: min(counts, key=lambda x: (-counts[x], x)) for key, counts in groups.items() if len(counts) > 1}  # noqa: B023
        for key, spelling in sorted((key, x) for key in canonical for x in groups[key]):
            changed = sum(r["n"] for r in rows if r["column"] == name and r["spelling"] == spelling and r["value"] != canonical[key])
            out[name].append({"key": key, "canonical": canonical[key], "spelling": spelling, "changed": changed})
    return out


def missing_label(existing: set[str]) -> str:
    """A label for missing categories that no category has yet."""
    folded = {x.casefold() for x in existing}
    return next(x for n in count(1) if (x := "Missing" if n == 1 else f"Missing ({n})").casefold() not in folded)


def suggest_actions(data: Dataset, stats: TableStats | None = None) -> tuple[CleaningAction, ...]:
    """Suggestions with their evidence, in the order of kinds. Statistics of all columns come from a handful of jobs."""
    stats = stats or TableStats(data)
    rows, frame = stats.rows, data.frame
    if not rows or not stats.fields:
        return ()
    out: list[CleaningAction] = []

    def add(kind: str, column: str | None, affected: int, confidence: str, evidence: str, **parameters: str) -> None:
        out.append(CleaningAction(kind, column, tuple(parameters.items()), affected, round(100 * affected / rows, 2), confidence, evidence))

    if stats.duplicates:
        add("drop_duplicates", None, stats.duplicates, "high", "Rows that repeat an earlier row in every column.")
    roles = {s.column: s.role for s in infer_semantics(data, stats)}
    facts = stats.texts
    limit = min(50, max(10, round(0.4 * rows)))
    spellings = _spellings(stats, [n for n, t in facts.items() if t["folds"] < t["values"] <= limit])
    outlier_bounds = {}
    for c in stats.columns.values():
        name, role = c.name, roles[c.name]
        if t := facts.get(name):
            if t["padded"]:
                add("trim_whitespace", name, t["padded"], "high", "Texts with white space at an end.")
            if t["blank"]:
                add("blank_to_missing", name, t["blank"], "high", "Texts of white space only.")
            if name in spellings:
                found = spellings[name]
                names = {r["key"]: r["canonical"] for r in found}
                changed = sum(r["changed"] for r in found)
                add("normalize_categories", name, changed, "medium", f"{len(found)} spellings make {len(names)} categories.", canonical_map=json.dumps(names, ensure_ascii=False, sort_keys=True))
            numeric = (
                t["full"] >= 3 and role != "identifier" and not name_words(name) & IDENTIFIER_WORDS
                and not (role == "categorical" and t["values"] <= 10) and t["plain"] and not t["zero"]
            )
            if numeric:
                add("convert_numeric", name, t["full"], "high", "All texts are plain numbers.")
            elif role == "datetime" and t["full"] >= 3 and (t["shape"] or 0) >= 0.9 and t["dates"]:
                add("convert_datetime", name, t["full"], "high", "All texts are dates.")
        if not c.present:
            add("drop_column", name, rows, "high", "The column has no values.", reason="empty")
            continue
        if c.distinct == 1:
            add("drop_column", name, rows, "low", "The column has one distinct value.", reason="constant")
            continue
        rate = c.nulls / rows
        numbers = c.numeric
        if rate >= 0.6:
            add("drop_column", name, rows, "low", f"{rate:.1%} of the rows have no value.", reason="mostly_missing")
        elif 0 < rate <= 0.3:
            if numbers and role != "identifier" and numbers["finite"] >= 3:
                add("fill_numeric_median", name, c.nulls, "medium", "Few values are missing.", value=repr(numbers["fmedian"]))
            elif role == "categorical" and not numbers:
                existing = set(stats.labels(name))
                add("fill_category_missing", name, c.nulls, "medium", "Few categories are missing.", value=missing_label(existing))
        flag = f"{name}_is_outlier"
        if numbers and is_numeric(c.kind) and role != "identifier" and flag not in stats.fields and numbers["finite"] >= 8 and c.distinct >= 4:
            spread = numbers["fq3"] - numbers["fq1"]
            if spread > 0:
                outlier_bounds[name] = (numbers["fq1"] - 1.5 * spread, numbers["fq3"] + 1.5 * spread)
    if outlier_bounds:
        hits = [F.count_if((col(n).cast("double") < lo) | (col(n).cast("double") > hi)).alias(f"h{i}") for i, (n, (lo, hi)) in enumerate(outlier_bounds.items())]
        found = frame.agg(*hits).first()
        for i, (name, (low, high)) in enumerate(outlier_bounds.items()):
            if found[i]:
                add("flag_outliers", name, found[i], "medium", f"Values outside {low:g} to {high:g}.", lower=repr(low), upper=repr(high), flag_column=f"{name}_is_outlier")
    return tuple(sorted(out, key=lambda a: (ORDER.index(a.kind), a.column or "", a.action_id)))


# ---- Recipes ---------------------------------------------------------------------------------------------------------


def fingerprint(batches: Iterable[Sequence[CleaningAction]]) -> str:
    """A short digest of a history; equal histories give equal results."""
    plain = [[[a.action_id, a.kind, a.column, sorted(a.parameters)] for a in batch] for batch in batches]
    return hashlib.sha256(json.dumps(plain, sort_keys=True).encode()).hexdigest()[:16]


def write_recipe(name: str, source_sha256: str, source: Dataset, cleaned: Dataset, batches: Iterable[Sequence[CleaningAction]], notes: str = "") -> str:
    """The history as JSON, with shapes, scores and types before and after."""
    from tablewright.operators.profile import profile

    before, after = profile(source), profile(cleaned)
    steps = [
        {"kind": a.kind, "column": a.column, "parameters": dict(a.parameters), "affected_rows": a.affected_rows, "confidence": a.confidence, "evidence": a.evidence}
        for batch in batches for a in sorted(batch, key=lambda a: (ORDER.index(a.kind), a.column or ""))
    ]
    return json.dumps({
        "format": RECIPE_FORMAT, "version": RECIPE_VERSION,
        "source": {"name": name, "sha256": source_sha256, "rows": before.rows, "columns": before.columns, "score": before.score},
        "result": {"rows": after.rows, "columns": after.columns, "score": after.score, "types": dict(cleaned.visible.dtypes)},
        "operations": steps, "notes": notes,
    }, indent=2, ensure_ascii=False)


def read_recipe(text: str) -> tuple[tuple[CleaningAction, ...], ...]:
    """One batch per operation, in order."""
    try:
        recipe = json.loads(text)
    except ValueError as error:
        raise CleaningError("the recipe is not JSON") from error
    if not isinstance(recipe, dict) or recipe.get("format") != RECIPE_FORMAT or recipe.get("version") != RECIPE_VERSION:
        raise CleaningError("this is not a cleaning recipe of a known version")
    steps = recipe.get("operations")
    if not isinstance(steps, list):
        raise CleaningError("the recipe has no list of operations")
    out = []
    for i, step in enumerate(steps):
        if not isinstance(step, dict) or step.get("kind") not in ORDER:
            raise CleaningError(f"operation {i + 1} is unknown")
        parameters, column = step.get("parameters", {}), step.get("column")
        if not isinstance(parameters, dict) or not all(isinstance(v, str) for v in parameters.values()):
            raise CleaningError(f"operation {i + 1} has parameters that are not text")
        if (column is None) != (step["kind"] == "drop_duplicates") or not isinstance(column, str | None):
            raise CleaningError(f"operation {i + 1} names no valid column")
        out.append((CleaningAction(step["kind"], column, tuple(parameters.items()), action_id=f"recipe-{i + 1}"),))
    return tuple(out)


def compare(before: Dataset, after: Dataset) -> dict:
    """Differences of score, rows, columns and types."""
    from tablewright.operators.profile import profile

    a, b = profile(before), profile(after)
    old, new = dict(before.visible.dtypes), dict(after.visible.dtypes)
    return {"score": b.score - a.score, "rows": b.rows - a.rows, "columns": b.columns - a.columns, "changed_types": sum(old[c] != new[c] for c in old.keys() & new.keys())}
