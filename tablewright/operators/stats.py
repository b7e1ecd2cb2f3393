"""Statistics of all columns in few passes, for profiles, roles and cleaning.

One job counts distinct values of all columns together (a long form of column and value, aggregated twice), one takes
plain and numeric aggregates, one looks at the first texts for dates. None of them loops over columns with an action each.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from tablewright.dataset import ROW_KEY, Dataset
from tablewright.functions.exprs import DATE_SHAPE, DATE_START, LEADING_ZERO, PLAIN_NUMBER, col, finite, fold, is_blank, is_numeric, is_text, missing, strip, to_timestamp

#: Texts per column that are looked at for dates.
SAMPLE = 100
#: Rows that are looked at first for these and for examples.
HEAD = 1_000
QUARTERS = [0.25, 0.5, 0.75]


@dataclass
class ColumnStats:
    """What is known of one column. ``nulls`` counts NULL, ``missing`` NULL and blank text."""

    name: str
    kind: T.DataType
    rows: int
    nulls: int = 0
    missing: int = 0
    distinct: int = 0
    examples: list[str] = field(default_factory=list)
    numeric: dict[str, float] = field(default_factory=dict)
    years: bool = False
    unit: bool = False
    parse_rate: float = 0.0
    shape_rate: float = 0.0

    @property
    def present(self) -> int:
        return self.rows - self.nulls

    @property
    def distinct_or_null(self) -> int:
        return self.distinct + bool(self.nulls)


class TableStats:
    """Statistics of a dataset, each kind taken when first asked for."""

    def __init__(self, data: Dataset):
        self.data = data
        self.fields = {f.name: f.dataType for f in data.frame.schema if f.name != ROW_KEY}

    @cached_property
    def plain(self) -> dict:
        """Row count, NULL and missing counts, and all number statistics, in one aggregate over the table."""
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, (name, kind) in enumerate(self.fields.items()):
            aggs.append(F.count_if(col(name).isNull()).alias(f"n{i}"))
            if is_text(kind):
                aggs.append(F.count_if(missing(col(name), kind)).alias(f"m{i}"))
            if is_numeric(kind):
                c, ok = col(name).cast("double"), finite(col(name))
                aggs += [
                    F.count(c).alias(f"count{i}"), F.avg(c).alias(f"mean{i}"), F.stddev_samp(c).alias(f"std{i}"), F.min(c).alias(f"min{i}"), F.max(c).alias(f"max{i}"),
                    F.bool_and(c.between(1900, 2100) & (c % 1 == 0)).alias(f"years{i}"), F.bool_and(c.between(0, 1)).alias(f"unit{i}"),
                    F.count(ok).alias(f"finite{i}"), F.percentile(ok, QUARTERS).alias(f"fq{i}"),
                ]
        out = self.data.frame.agg(*aggs).first().asDict()
        return out | {f"m{i}": out[f"n{i}"] for i, kind in enumerate(self.fields.values()) if not is_text(kind)}

    @property
    def rows(self) -> int:
        return self.plain["rows"]

    def long(self, names: list[str]) -> DataFrame:
        """ROW_KEY, column, value: the non-null values of some columns as text."""
        pairs = F.array(*(F.struct(F.lit(n).alias("column"), col(n).cast("string").alias("value")) for n in names))
        made = self.data.frame.select(ROW_KEY, F.explode(pairs).alias("p"))
        return made.select(ROW_KEY, "p.column", "p.value").filter(F.col("value").isNotNull())

    def values(self, names: list[str] | None = None) -> DataFrame:
        """column, value, n, first: every distinct non-null value with its count and the place where it is first seen."""
        return self.long(names or list(self.fields)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.min(ROW_KEY).alias("first"))

    @cached_property
    def head(self) -> dict[str, list[str]]:
        """The non-null values of the first HEAD rows as text, by column: a top-k, whatever the size of the table."""
        first = self.data.frame.orderBy(ROW_KEY).limit(HEAD).select(*(col(n).cast("string").alias(f"c{i}") for i, n in enumerate(self.fields)))
        rows = first.collect()
        return {n: [r[i] for r in rows if r[i] is not None] for i, n in enumerate(self.fields)}

    @cached_property
    def distinct(self) -> dict[str, tuple[int, list[str]]]:
        """Distinct non-null values (blank ones too), and the first three that are not blank, by column."""
        pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), col(n).cast("string").alias("value")) for i, n in enumerate(self.fields)))).alias("p")
        plain = self.data.frame.select(pairs).select("p.i", "p.value").filter(F.col("value").isNotNull()).distinct()
        names = list(self.fields)
        counts = {names[r["i"]]: r["d"] for r in plain.groupBy("i").agg(F.count(F.lit(1)).alias("d")).collect()}
        examples = {n: [x for x in dict.fromkeys(values) if x.strip()][:3] for n, values in self.head.items()}
        if late := [n for n in self.fields if len(examples[n]) < min(3, counts.get(n, 0))]:  # seen first behind the head
            order = Window.partitionBy("column").orderBy("first")
            shown = self.values(late).filter(~is_blank(F.col("value"))).withColumn("rank", F.row_number().over(order)).filter("rank <= 3").select("column", "rank", "value")
            examples |= {n: [] for n in late}
            for r in sorted(shown.collect(), key=lambda r: r["rank"]):
                examples[r["column"]].append(r["value"])
        return {n: (counts.get(n, 0), [x[:60] for x in examples[n]]) for n in self.fields}

    def labels(self, name: str, most: int = 51) -> list[str]:
        """Distinct non-null values of one column as text, at most so many."""
        return [r[0] for r in self.data.frame.select(col(name).cast("string")).filter(col(name).isNotNull()).distinct().limit(most).collect()]

    def gather(self, *more: str) -> TableStats:
        """Takes the statistics of all columns, and ``more`` by name, with the jobs that don't need one another side by side."""
        kinds = [n for n in ("plain", "head", "distinct", "duplicates", *more) if n not in self.__dict__]
        if not kinds:
            return self
        with ThreadPoolExecutor(len(kinds)) as pool:
            work = inheritable_thread_target(self.data.frame.sparkSession)
            for done in [pool.submit(work(lambda n=n: getattr(self, n))) for n in kinds]:
                done.result()
        return self

    @cached_property
    def numbers(self) -> dict[str, dict]:
        """count, mean, std, min, q1, median, q3, max, years, unit, finite statistics by number column."""
        places = {n: i for i, (n, k) in enumerate(self.fields.items()) if is_numeric(k)}
        plain = self.plain
        quartiles = {n: plain[f"fq{i}"] for n, i in places.items()}
        if odd := [n for n, i in places.items() if plain[f"finite{i}"] < plain[f"count{i}"]]:  # only infinities make a difference
            row = self.data.frame.agg(*(F.percentile(col(n).cast("double"), QUARTERS) for n in odd)).first()
            quartiles |= dict(zip(odd, row, strict=True))
        out = {}
        for n, i in places.items():
            q, fq = quartiles[n] or [None] * 3, plain[f"fq{i}"] or [None] * 3
            out[n] = {k: plain[f"{k}{i}"] for k in ("count", "mean", "std", "min", "max", "years", "unit", "finite")}
            out[n] |= {"q1": q[0], "median": q[1], "q3": q[2], "fq1": fq[0], "fmedian": fq[1], "fq3": fq[2]}
        return out

    @cached_property
    def dates(self) -> dict[str, tuple[float, float]]:
        """Share of the first SAMPLE texts that parse as dates, and that look like dates, by text column."""
        names = [n for n, k in self.fields.items() if is_text(k)]
        spark = self.data.frame.sparkSession
        sparse = [n for n in names if len(self.head[n]) < min(SAMPLE, self.rows - self.plain[f"n{list(self.fields).index(n)}"])]
        dated = [n for n in names if n not in sparse and any(x.isdigit() for v in self.head[n][:SAMPLE] for x in v)]  # no date is without a digit
        rows = [(n, v) for n in dated for v in self.head[n][:SAMPLE]]
        if not rows and not sparse:
            return {}
        first = spark.createDataFrame(rows, "column string, value string").coalesce(1)
        if sparse:  # their first values stand behind the head
            ranked = self.long(sparse).withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(ROW_KEY))).filter(F.col("rank") <= SAMPLE)
            first = first.unionByName(ranked.select("column", "value"))
        parsed = to_timestamp(F.col("value"), T.StringType()).isNotNull().cast("double")
        shaped = strip(F.col("value")).rlike(DATE_START).cast("double")
        return {r["column"]: (r["parsed"], r["shaped"]) for r in first.groupBy("column").agg(F.avg(parsed).alias("parsed"), F.avg(shaped).alias("shaped")).collect()}

    @cached_property
    def texts(self) -> dict[str, dict]:
        """Counts and tests of all text columns in one job; patterns are tried once per distinct value, counts weigh them."""
        names = [n for n, kind in self.fields.items() if is_text(kind)]
        if not names:
            return {}
        c, n = F.col("value"), F.col("n")
        known = self.values(names).withColumn("s", strip(c)).withColumn("full", F.col("s") != "")
        s, full = F.col("s"), F.col("full")
        times = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0))
        every = lambda test: F.coalesce(F.bool_and(F.when(full, test)), F.lit(False))
        facts = known.groupBy("column").agg(
            times(c != s).alias("padded"), times(~full).alias("blank"), times(full).alias("full"), F.count_distinct(F.when(full, s)).alias("values"),
            F.count_distinct(F.when(full, fold(s))).alias("folds"), every(s.rlike(PLAIN_NUMBER)).alias("plain"), F.coalesce(F.bool_or(full & s.rlike(LEADING_ZERO)), F.lit(False)).alias("zero"),
            (times(full & s.rlike(DATE_SHAPE)) / F.nullif(times(full), F.lit(0))).alias("shape"), every(to_timestamp(c, T.StringType()).isNotNull()).alias("dates"),
        )
        return {r["column"]: r.asDict() for r in facts.collect()}

    @cached_property
    def duplicates(self) -> int:
        """Rows equal to an earlier one in all columns."""
        return self.rows - self.data.visible.distinct().count()

    @cached_property
    def columns(self) -> dict[str, ColumnStats]:
        self.gather()
        out = {}
        for i, (name, kind) in enumerate(self.fields.items()):
            distinct, examples = self.distinct[name]
            numbers = self.numbers.get(name, {})
            parsed, shaped = self.dates.get(name, (0.0, 0.0))
            out[name] = ColumnStats(
                name, kind, self.rows, self.plain[f"n{i}"], self.plain[f"m{i}"], distinct, examples, numbers,
                bool(numbers.get("years")), bool(numbers.get("unit")), parsed, shaped,
            )
        return out
