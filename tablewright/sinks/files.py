"""Files: delimited text, the Markdown quality report, and a dashboard as one HTML page."""

from __future__ import annotations

import html
import json
import math

from pyspark.sql import DataFrame, SparkSession

from tablewright.dataset import ROW_KEY, Dataset
from tablewright.operators import cards
from tablewright.operators.charts import chart_spec
from tablewright.operators.profile import DatasetProfile

AUDIT_ROWS = 1_000


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """All rows with a header, in parallel parts; ``single`` only for results known to be small."""
    out = df.drop(ROW_KEY)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def markdown_report(name: str, p: DatasetProfile) -> str:
    def cell(value: object) -> str:
        return str(value).replace("|", "\\|").replace("\n", " ")

    lines = [
        f"# Data quality report: {name}", "", "## Overview", "", f"- Rows: {p.rows:,}", f"- Columns: {p.columns:,}", f"- Missing cells: {p.missing_cells:,}",
        f"- Duplicate rows: {p.duplicate_rows:,}", f"- Health score: {p.score}/100", "", "## Findings", "",
    ]
    lines += [f"- **{i.severity}** {i.title}{f' ({i.column})' if i.column else ''}: {i.detail}" for i in p.issues] or ["- No findings."]
    lines += ["", "## Columns", "", "| Column | Type | Missing | Missing % | Distinct | Examples |", "|---|---|---|---|---|---|"]
    lines += [f"| {cell(c['column'])} | {c['dtype']} | {c['missing_count']:,} | {c['missing_percent']:.2f} | {c['unique_count']:,} | {cell(c['examples'])} |" for c in p.column_profile]
    return "\n".join(lines) + "\n"


def _table(df: DataFrame) -> str:
    rows = df.limit(AUDIT_ROWS + 1).collect()
    more = df.count() - AUDIT_ROWS if len(rows) > AUDIT_ROWS else 0
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{'' if v is None else html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows[:AUDIT_ROWS])
    note = f"<p>{more:,} additional rows</p>" if more > 0 else ""
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>{note}"


WIDE, HIGH, LEFT = 640, 240, 60


def _svg(body: str, high: float = HIGH) -> str:
    return f'<svg width="{WIDE}" height="{high:.0f}" font-size="12">{body}</svg>'


def _scale(values: list[float], low: float, high: float):
    """From the values' range to a range of pixels; a single value stands in the middle."""
    least, most = min(values), max(values)
    return lambda v: (low + high) / 2 if most == least else low + (high - low) * (v - least) / (most - least)


def _bars(points: list[tuple[str, float]]) -> str:
    most = max(abs(v) for _, v in points) or 1
    rows = "".join(
        f'<text x="0" y="{18 * i + 13}">{html.escape(k[:30])}</text><rect x="220" y="{18 * i + 2}" width="{400 * abs(v) / most:.1f}" height="14" fill="#3b6ea5"/>' for i, (k, v) in enumerate(points)
    )
    return _svg(rows, 18 * len(points) + 4)


def _curve(points: list[tuple[str, float]], filled: bool) -> str:
    """One place per row, in order, with the ends labelled."""
    y = _scale([0.0, *(v for _, v in points)], HIGH - 30, 10)
    step = (WIDE - LEFT - 20) / max(1, len(points) - 1)
    line = " ".join(f"{LEFT + step * i:.1f},{y(v):.1f}" for i, (_, v) in enumerate(points))
    area = f'<polygon points="{LEFT},{y(0):.1f} {line} {LEFT + step * (len(points) - 1):.1f},{y(0):.1f}" fill="#3b6ea5" opacity="0.3"/>' if filled else ""
    ends = f'<text x="{LEFT}" y="{HIGH - 8}">{html.escape(points[0][0][:20])}</text><text x="{WIDE - 20}" y="{HIGH - 8}" text-anchor="end">{html.escape(points[-1][0][:20])}</text>'
    return _svg(f'{area}<polyline points="{line}" fill="none" stroke="#3b6ea5" stroke-width="2"/>{ends}')


def _slices(points: list[tuple[str, float]]) -> str:
    whole, turned, out = sum(max(v, 0) for _, v in points) or 1, 0.0, ""
    place = lambda share: (120 + 100 * math.sin(2 * math.pi * share), 120 - 100 * math.cos(2 * math.pi * share))
    for i, (name, v) in enumerate(points):
        share = min(max(v, 0) / whole, 0.9999)  # a whole circle has no beginning
        (x0, y0), (x1, y1) = place(turned), place(turned + share)
        shade = f"hsl({(i * 47) % 360} 45% 50%)"
        out += f'<path d="M120,120 L{x0:.1f},{y0:.1f} A100,100 0 {int(share > 0.5)} 1 {x1:.1f},{y1:.1f} Z" fill="{shade}"/><rect x="260" y="{18 * i + 6}" width="12" height="12" fill="{shade}"/>'
        out += f'<text x="280" y="{18 * i + 16}">{html.escape(name[:40])} {100 * max(v, 0) / whole:.1f}%</text>'
        turned += share
    return _svg(out, max(HIGH, 18 * len(points) + 10))


def _dots(points: list[tuple[float, float]]) -> str:
    x, y = _scale([p[0] for p in points], LEFT, WIDE - 20), _scale([p[1] for p in points], HIGH - 20, 10)
    return _svg("".join(f'<circle cx="{x(a):.1f}" cy="{y(b):.1f}" r="2" fill="#3b6ea5" opacity="0.5"/>' for a, b in points))


def _boxes(rows: list[dict], name: str) -> str:
    """Whiskers from the least to the largest value, a box between the quartiles, a line at the median."""
    x, out = _scale([r[k] for r in rows for k in ("min", "max")], 200, WIDE - 20), ""
    for i, r in enumerate(rows):
        top, at = 26 * i + 4, {k: x(r[k]) for k in ("min", "q1", "median", "q3", "max")}
        out += f'<text x="0" y="{top + 14}">{html.escape(str(r[name])[:28])}</text><line x1="{at["min"]:.1f}" x2="{at["max"]:.1f}" y1="{top + 9}" y2="{top + 9}" stroke="#333"/>'
        out += f'<rect x="{at["q1"]:.1f}" y="{top}" width="{max(1, at["q3"] - at["q1"]):.1f}" height="18" fill="#9db8d6"/><line x1="{at["median"]:.1f}" x2="{at["median"]:.1f}" y1="{top}" y2="{top + 18}" stroke="#1d3d63" stroke-width="2"/>'
    return _svg(out, 26 * len(rows) + 8)


def figure(spec: dict) -> str:
    """The drawing of a specification by its mark; nothing where no row has a number."""
    rows, x, y, mark = spec["values"], spec["x"], spec["y"], spec["mark"]
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)
    if mark == "box":
        known = [r for r in rows if all(number(r.get(k)) for k in ("min", "q1", "median", "q3", "max"))]
        return _boxes(known, x) if known else ""
    if mark == "point":
        known = [(r[x], r[y]) for r in rows if number(r.get(x)) and number(r.get(y))]
        return _dots(known) if known else ""
    known = [(str(r[x]), float(r[y])) for r in rows if number(r.get(y))]
    if not known:
        return ""
    if mark in ("line", "area"):
        return _curve(known, mark == "area")
    return _slices(known) if mark == "arc" else _bars(known[:50])


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A text, such as SQL or a report, as one file in a folder of any file system that Spark can write."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def html_dashboard(data: Dataset, config: cards.Config) -> str:
    """One page: every card with its value or picture and its audit table. All text is escaped."""
    cards.check_config(data.frame, config)
    df = cards.apply_filters(data.frame, config.filters).persist()
    try:
        parts = []
        for card in config.cards:
            result = cards.build_card(df, card)
            if card.kind == "kpi":
                shown = f"<p class='value'>{html.escape(cards.format_value(result.value))}</p>"
            else:
                spec = chart_spec(card.kind, card.title, result.audit)
                shown = figure(spec) + f"<script type='application/json'>{json.dumps(spec, default=str).replace('<', chr(92) + 'u003c')}</script>"
            parts.append(f"<article><h2>{html.escape(card.title)}</h2>{shown}<p>{html.escape(result.calculation)}</p>{_table(result.audit)}</article>")
    finally:
        df.unpersist()
    title = html.escape(config.name)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{title}</title></head><body><h1>{title}</h1>{''.join(parts)}</body></html>"
