"""The registered queries of the table workbench and the SQL that must give the same rows.

The tables have no missing values, blanks or repeated rows, so the queries make such cases from a rule on both
sides. Aggregates of doubles are rounded on both sides, as sums depend on the order of addition.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.dataset import from_frame
from tablewright.functions.exprs import GRAINS
from tablewright.operators import cards, charts, cleaning, profile, roles
from tablewright.operators.cleaning import CleaningAction
from tablewright.operators.query import AggregateRule, FilterRule, QuerySpec, run_query
from tablewright.operators.stats import TableStats
from tablewright.plans import sqlguard
from tablewright.session import read_table
from tablewright.sinks.records import json_records

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    _queries[name] = query
    if sql is not None:
        _oracles[name] = sql if name == "cht_box" else nudged(sql)


def table(name: str) -> Query:
    return lambda spark, sf_dir: read_table(spark, sf_dir, name)


#: Added before rounding on both sides: the two engines round exact halves of doubles differently.
NUDGE = 1e-7


def rounded(df: DataFrame, *names: str, places: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + F.lit(NUDGE), places) for n in names})


def nudged(sql: str) -> str:
    """The same in SQL, for rounded aggregates (shares are rounded by the operators themselves)."""
    return re.sub(r"ROUND\((.*?), ([24])\)( AS (?!share_|missing_))", rf"ROUND(\1 + {NUDGE}, \2)\3", sql)


# ---- Made cases ------------------------------------------------------------------------------------------------------


def items_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem, with l_tax missing on first lines."""
    return read_table(spark, sf_dir, "lineitem").withColumn("l_tax", F.when(F.col("l_linenumber") != 1, F.col("l_tax")))


ITEMS = "(SELECT * REPLACE (CASE WHEN l_linenumber <> 1 THEN l_tax END AS l_tax) FROM lineitem)"


def orders_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders, with priority missing or blank, status padded, and price as text."""
    o, n = read_table(spark, sf_dir, "orders"), F.col("o_orderkey") % 7
    return o.select(
        "o_orderkey", "o_custkey", F.when(n == 1, F.concat(F.lit("  "), F.col("o_orderstatus"), F.lit(" "))).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(n == 2, F.lit(None)).when(n == 3, F.lit("   ")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"), "o_totalprice", "o_orderdate",
    )


ORDERS = """(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 1 THEN '  ' || o_orderstatus || ' ' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 7 = 2 THEN NULL WHEN o_orderkey % 7 = 3 THEN '   ' ELSE o_orderpriority END AS o_orderpriority, o_totalprice, o_orderdate FROM orders)"""


def doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders, every fifth one twice."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return o.unionByName(o.filter(F.col("o_orderkey") % 5 == 0))


DOUBLED = """(SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
  UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 5 = 0)"""


def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer, with segments in three spellings."""
    c, n = read_table(spark, sf_dir, "customer"), F.col("c_custkey") % 5
    seg = F.col("c_mktsegment")
    return c.select("c_custkey", F.when(n == 0, F.lower(seg)).when(n == 1, F.concat(F.lit(" "), seg)).otherwise(seg).alias("segment"), "c_acctbal")


SPELLINGS = """(SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 5 = 1 THEN ' ' || c_mktsegment ELSE c_mktsegment END AS segment,
  c_acctbal FROM customer)"""


# ---- Visual queries --------------------------------------------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounted line items by flag and status."""
    spec = QuerySpec(
        filters=(FilterRule("l_discount", "gte", 0.05), FilterRule("l_returnflag", "is_not_null")), group_by=("l_returnflag", "l_linestatus"),
        aggregates=(AggregateRule("count_rows"), AggregateRule("sum", "l_quantity"), AggregateRule("mean", "l_extendedprice"), AggregateRule("median", "l_extendedprice")),
        sort_by="mean_l_extendedprice", sort_descending=True,
    )
    return rounded(run_query(read_table(spark, sf_dir, "lineitem"), spec), "sum_l_quantity", "mean_l_extendedprice", "median_l_extendedprice")


register("flagship", flagship, """
    SELECT l_returnflag, l_linestatus, COUNT(*) AS row_count, ROUND(SUM(l_quantity), 4) AS sum_l_quantity, ROUND(AVG(l_extendedprice), 4) AS mean_l_extendedprice,
           ROUND(MEDIAN(l_extendedprice), 4) AS median_l_extendedprice
    FROM lineitem WHERE l_discount >= 0.05 AND l_returnflag IS NOT NULL GROUP BY ALL""")


def _filter_query(source: Query, columns: tuple[str, ...], *rules: FilterRule) -> Query:
    """The predicate alone over the whole table: a query's limit is a feature of results, not of filters."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = source(spark, sf_dir)
        spec = QuerySpec(filters=rules, group_by=columns, aggregates=(AggregateRule("count_rows"),), limit=5_000)
        return run_query(df, spec)

    return build


for name, sign in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    register(
        f"flt_{name}", _filter_query(items_with_gaps, ("l_returnflag", "l_linenumber"), FilterRule("l_tax", name, 0.04)),
        f"SELECT l_returnflag, l_linenumber, COUNT(*) AS row_count FROM {ITEMS} WHERE l_tax {sign} 0.04 GROUP BY ALL",
    )
register("flt_contains", _filter_query(table("part"), ("p_brand", "p_type"), FilterRule("p_type", "contains", "STEEL")),
         "SELECT p_brand, p_type, COUNT(*) AS row_count FROM part WHERE contains(lower(p_type), lower('STEEL')) GROUP BY ALL")
register("flt_starts_with", _filter_query(table("part"), ("p_brand", "p_type"), FilterRule("p_brand", "starts_with", "BRAND#1")),
         "SELECT p_brand, p_type, COUNT(*) AS row_count FROM part WHERE starts_with(lower(p_brand), lower('BRAND#1')) GROUP BY ALL")
register("flt_is_null", _filter_query(items_with_gaps, ("l_linenumber", "l_returnflag"), FilterRule("l_tax", "is_null")),
         f"SELECT l_linenumber, l_returnflag, COUNT(*) AS row_count FROM {ITEMS} WHERE l_tax IS NULL GROUP BY ALL")
register("flt_is_not_null", _filter_query(items_with_gaps, ("l_linenumber", "l_returnflag"), FilterRule("l_tax", "is_not_null")),
         f"SELECT l_linenumber, l_returnflag, COUNT(*) AS row_count FROM {ITEMS} WHERE l_tax IS NOT NULL GROUP BY ALL")
register("flt_and3", _filter_query(table("orders"), ("o_orderstatus", "o_orderpriority"), FilterRule("o_totalprice", "gt", "100,000"), FilterRule("o_orderdate", "gte", "1995-01-01"), FilterRule("o_orderstatus", "ne", "P")),
         "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS row_count FROM orders WHERE o_totalprice > 100000 AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderstatus <> 'P' GROUP BY ALL")


def _aggregate_query(rule: AggregateRule) -> Query:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run_query(items_with_gaps(spark, sf_dir), QuerySpec(group_by=("l_returnflag",), aggregates=(rule,)))
        return rounded(out, rule.name) if rule.function in ("mean", "median", "sum") else out

    return build


for name, sql in (("count_rows", "COUNT(*)"), ("count_values", "COUNT(l_tax)"), ("mean", "ROUND(AVG(l_tax), 4)"), ("median", "ROUND(MEDIAN(l_tax), 4)"), ("sum", "ROUND(SUM(l_tax), 4)"), ("min", "MIN(l_tax)"), ("max", "MAX(l_tax)")):
    register(f"agg_{name}", _aggregate_query(AggregateRule(name, None if name == "count_rows" else "l_tax", "result")), f"SELECT l_returnflag, {sql} AS result FROM {ITEMS} GROUP BY ALL")


def agg_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = "o_totalprice"
    rules = (AggregateRule("count_rows"), *(AggregateRule(f, price) for f in ("count_values", "mean", "median", "sum", "min", "max")), AggregateRule("sum", "o_custkey"))
    return rounded(run_query(read_table(spark, sf_dir, "orders"), QuerySpec(aggregates=rules)), *(f"{f}_{price}" for f in ("mean", "median", "sum")), places=2)


register("agg_global", agg_global, """
    SELECT COUNT(*) AS row_count, COUNT(o_totalprice) AS count_values_o_totalprice, ROUND(AVG(o_totalprice), 2) AS mean_o_totalprice, ROUND(MEDIAN(o_totalprice), 2) AS median_o_totalprice,
           ROUND(SUM(o_totalprice), 2) AS sum_o_totalprice, MIN(o_totalprice) AS min_o_totalprice, MAX(o_totalprice) AS max_o_totalprice, CAST(SUM(o_custkey) AS BIGINT) AS sum_o_custkey FROM orders""")
register("agg_null_group", lambda s, d: run_query(orders_with_gaps(s, d), QuerySpec(group_by=("o_orderpriority",), aggregates=(AggregateRule("count_rows"),))),
         f"SELECT o_orderpriority, COUNT(*) AS row_count FROM {ORDERS} GROUP BY ALL")
register("sort_nulls_last", lambda s, d: run_query(orders_with_gaps(s, d), QuerySpec(group_by=("o_orderpriority",), aggregates=(AggregateRule("count_rows"),), sort_by="o_orderpriority", limit=6)),
         f"SELECT o_orderpriority, COUNT(*) AS row_count FROM {ORDERS} GROUP BY 1 ORDER BY o_orderpriority NULLS LAST LIMIT 6")
register("topk_mean", lambda s, d: rounded(run_query(read_table(s, d, "part"), QuerySpec(group_by=("p_brand",), aggregates=(AggregateRule("mean", "p_retailprice"),), sort_by="mean_p_retailprice", sort_descending=True, limit=5)), "mean_p_retailprice"),
         "SELECT p_brand, ROUND(AVG(p_retailprice), 4) AS mean_p_retailprice FROM part GROUP BY 1 ORDER BY AVG(p_retailprice) DESC NULLS LAST LIMIT 5")
register("prj_columns", lambda s, d: run_query(read_table(s, d, "nation"), QuerySpec(selected_columns=("n_name", "n_regionkey"))), "SELECT n_name, n_regionkey FROM nation")


# ---- Profiles and roles ----------------------------------------------------------------------------------------------

register("prf_columns", lambda s, d: profile.column_profile(orders_with_gaps(s, d)), "\n UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(COUNT(*) FILTER ({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') AS BIGINT) AS missing_count,
    ROUND(100 * COUNT(*) FILTER ({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') / COUNT(*), 2) AS missing_percent, COUNT(DISTINCT {c}) AS unique_count FROM {ORDERS}"""
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate")
))
register("prf_duplicates", lambda s, d: profile.duplicate_rows(doubled(s, d)), f"SELECT COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {DOUBLED})) AS duplicate_rows FROM {DOUBLED}")


def prf_numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = items_with_gaps(spark, sf_dir).select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return rounded(profile.numeric_summary(kept), "mean", "std", "min", "q1", "median", "q3", "max")


register("prf_numeric_summary", prf_numeric_summary, "\n UNION ALL ".join(
    f"""SELECT '{c}' AS "column", COUNT({c}) AS count, ROUND(AVG({c}), 4) AS mean, ROUND(stddev_samp({c}), 4) AS std, ROUND(MIN({c}), 4) AS min, ROUND(quantile_cont({c}, 0.25), 4) AS q1,
    ROUND(MEDIAN({c}), 4) AS median, ROUND(quantile_cont({c}, 0.75), 4) AS q3, ROUND(MAX({c}), 4) AS max FROM {ITEMS}""" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
))


def prf_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.profile(from_frame(orders_with_gaps(spark, sf_dir)))
    return spark.createDataFrame([(p.rows, p.columns, p.missing_cells, p.duplicate_rows, p.score)], "rows long, columns int, missing_cells long, duplicate_rows long, score int")


register("prf_score", prf_score, f"""
    WITH t AS (SELECT COUNT(*) AS rows, COUNT(*) FILTER (o_orderpriority IS NULL OR trim(o_orderpriority) = '') AS gone FROM {ORDERS})
    SELECT rows, 6 AS columns, gone AS missing_cells, CAST(0 AS BIGINT) AS duplicate_rows, CAST(round_even(100 - LEAST(55, 100.0 * gone / (rows * 6)), 0) AS INTEGER) AS score FROM t""")


def prf_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.profile(from_frame(orders_with_gaps(spark, sf_dir).withColumn("fixed", F.lit("x"))))
    return spark.createDataFrame([(i.severity, i.title, i.column) for i in p.issues], "severity string, title string, name string")


register("prf_issues", prf_issues, """SELECT * FROM (VALUES ('info', 'Possible identifier', 'o_orderkey'), ('warning', 'Missing values', 'o_orderpriority'), ('warning', 'Constant column', 'fixed')) AS t(severity, title, name)
    UNION ALL SELECT 'info', 'Possible identifier', 'o_totalprice' FROM orders HAVING COUNT(DISTINCT o_totalprice) = COUNT(*)
    UNION ALL SELECT 'info', 'Possible identifier', 'o_orderdate' FROM orders HAVING COUNT(DISTINCT o_orderdate) = COUNT(*)""")


def sem_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name in ("customer", "orders", "part", "lineitem", "events", "supplier", "nation"):
        rows += [(name, s.column, s.role, s.display_format) for s in roles.infer_semantics(from_frame(read_table(spark, sf_dir, name)))]
    return spark.createDataFrame(rows, "source string, name string, role string, display_format string")


def rows_sql(names: str, *rows: str) -> str:
    """SQL for rows that are known beforehand; each is written as its fields between commas."""
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) AS t({names})"


def role_rows() -> list[str]:
    """What the rules give each column: those with "_id" are identifiers, dates are dates, few texts categories, prices money, shares of one percentages."""
    known = {
        "customer": "c_custkey numeric Number, c_name text Text, c_nationkey numeric Number, c_acctbal numeric Number, c_mktsegment categorical Category",
        "orders": "o_orderkey numeric Number, o_custkey numeric Number, o_orderstatus categorical Category, o_totalprice numeric Currency, o_orderdate datetime Date/time, o_orderpriority categorical Category",
        "part": "p_partkey numeric Number, p_name text Text, p_brand categorical Category, p_type categorical Category, p_size numeric Number, p_retailprice numeric Currency",
        "lineitem": "l_orderkey numeric Number, l_partkey numeric Number, l_suppkey numeric Number, l_linenumber numeric Number, l_quantity numeric Number, l_extendedprice numeric Currency,"
                    " l_discount numeric Percentage, l_tax numeric Percentage, l_returnflag categorical Category, l_linestatus categorical Category, l_shipdate datetime Date/time",
        "events": "event_id identifier ID, ts datetime Date/time, user_id identifier ID, event_type categorical Category, value numeric Number, props text Text",
        "supplier": "s_suppkey numeric Number, s_name text Text, s_nationkey numeric Number, s_acctbal numeric Number",
        "nation": "n_nationkey numeric Number, n_name text Text, n_regionkey numeric Number",
    }
    return [", ".join(f"'{x}'" for x in (source, *field.split())) for source, fields in known.items() for field in fields.split(",")]


register("sem_roles", sem_roles, rows_sql("source, name, role, display_format", *role_rows()))


def rec_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = from_frame(orders_with_gaps(spark, sf_dir))
    stats = TableStats(data)
    found = roles.infer_roles(data, stats)
    rows = [(goal, i, c.kind, c.x, c.y) for goal in roles.GOALS for i, c in enumerate(roles.suggest_charts(stats, found, goal))]
    return spark.createDataFrame(rows, "goal string, place int, kind string, x string, y string")


REC_CHARTS = {
    "Overview": "missingness column missing_percent, pie o_orderstatus count, time_series o_orderdate o_orderkey, box o_orderkey o_orderstatus",
    "Trends": "time_series o_orderdate o_orderkey, time_series o_orderdate o_custkey, time_area o_orderdate o_orderkey",
    "Compare": "category_aggregate o_orderstatus o_orderkey, category_aggregate o_orderstatus o_custkey, pie o_orderstatus count, category_count o_orderstatus count",
    "Distributions": "histogram o_orderkey count, histogram o_custkey count, box o_orderkey o_orderstatus, box o_custkey o_orderstatus",
    "Relationships": "scatter o_orderkey o_custkey, scatter o_custkey o_totalprice, box o_orderkey o_orderstatus, category_aggregate o_orderstatus o_orderkey",
    "Data quality": "missingness column missing_percent, category_count o_orderstatus count, category_count o_orderpriority count",
}
register("rec_charts", rec_charts, rows_sql("goal, place, kind, x, y", *(
    f"'{goal}', {i}, " + ", ".join(f"'{x}'" for x in chart.split()) for goal, charts_ in REC_CHARTS.items() for i, chart in enumerate(charts_.split(","))
)))


# ---- Cleaning --------------------------------------------------------------------------------------------------------


def cleaned(source: Query, *batches: tuple[CleaningAction, ...], pick: tuple[str, ...] = ()) -> Query:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = cleaning.replay(from_frame(source(spark, sf_dir)), batches).visible
        return out.select(*pick) if pick else out

    return build


def act(kind: str, column: str | None = None, **parameters: str) -> CleaningAction:
    return CleaningAction(kind, column, tuple(parameters.items()))


register("cln_dedup", cleaned(doubled, (act("drop_duplicates"),)), f"SELECT DISTINCT * FROM {DOUBLED}")
register("cln_trim", cleaned(orders_with_gaps, (act("trim_whitespace", "o_orderstatus"),), pick=("o_orderkey", "o_orderstatus")),
         f"SELECT o_orderkey, regexp_replace(o_orderstatus, '^\\s+|\\s+$', '', 'g') AS o_orderstatus FROM {ORDERS}")
register("cln_blank_null", cleaned(orders_with_gaps, (act("blank_to_missing", "o_orderpriority"),), pick=("o_orderkey", "o_orderpriority")),
         f"SELECT o_orderkey, CASE WHEN trim(o_orderpriority) <> '' THEN o_orderpriority END AS o_orderpriority FROM {ORDERS}")


def cln_merge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = from_frame(spellings(spark, sf_dir))
    found = [a for a in cleaning.suggest_actions(data) if a.kind == "normalize_categories"]
    return cleaning.apply_actions(data, found).visible


register("cln_merge_labels", cln_merge_labels, f"""
    WITH counts AS (SELECT trim(segment) AS s, COUNT(*) AS n FROM {SPELLINGS} GROUP BY 1),
         best AS (SELECT lower(s) AS k, s, ROW_NUMBER() OVER (PARTITION BY lower(s) ORDER BY n DESC, s) AS r FROM counts)
    SELECT c_custkey, best.s AS segment, c_acctbal FROM {SPELLINGS} t JOIN best ON best.k = lower(trim(t.segment)) AND r = 1""")


def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n = read_table(spark, sf_dir, "orders"), F.col("o_orderkey") % 10
    price = F.format_string("%.2f", "o_totalprice")
    return o.select("o_orderkey", F.when(n == 1, F.lit(" ")).when(n == 2, F.lit("12d")).when(n == 3, F.concat(F.lit(" "), price)).otherwise(price).alias("price"), F.col("o_custkey").cast("string").alias("whole"))


NUMBER_TEXTS = """(SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN ' ' WHEN o_orderkey % 10 = 2 THEN '12d' WHEN o_orderkey % 10 = 3 THEN ' ' || printf('%.2f', o_totalprice)
  ELSE printf('%.2f', o_totalprice) END AS price, CAST(o_custkey AS VARCHAR) AS whole FROM orders)"""
register("cln_to_number", cleaned(number_texts, (act("convert_numeric", "price"), act("convert_numeric", "whole"))),
         f"SELECT o_orderkey, TRY_CAST(trim(price) AS DOUBLE) AS price, CAST(whole AS BIGINT) AS whole FROM {NUMBER_TEXTS}")


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n, d = read_table(spark, sf_dir, "orders"), F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(n == 0, F.date_format(d, "yyyy-MM-dd")).when(n == 1, F.date_format(d, "MM/dd/yyyy")).when(n == 2, F.date_format(d, "MMM d, yyyy")).otherwise(F.lit("no date"))
    return o.select("o_orderkey", text.alias("day"))


register("cln_to_datetime", cleaned(date_texts, (act("convert_datetime", "day"),)), "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN date_trunc('day', o_orderdate)::TIMESTAMP END AS day FROM orders")
register("cln_fill_median", cleaned(items_with_gaps, (act("fill_numeric_median", "l_tax", value="0.04"),), pick=("l_orderkey", "l_linenumber", "l_tax")),
         f"SELECT l_orderkey, l_linenumber, COALESCE(l_tax, 0.04) AS l_tax FROM {ITEMS}")
register("cln_fill_label", cleaned(orders_with_gaps, (act("fill_category_missing", "o_orderpriority", value="Missing"),), pick=("o_orderkey", "o_orderpriority")),
         f"SELECT o_orderkey, COALESCE(o_orderpriority, 'Missing') AS o_orderpriority FROM {ORDERS}")
register("cln_drop_column", cleaned(table("supplier"), (act("drop_column", "s_acctbal"),)), "SELECT s_suppkey, s_name, s_nationkey FROM supplier")


def cln_flag_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds from the data's own quartiles, as the suggestion has them; prices cubed so that there are outliers."""
    made = read_table(spark, sf_dir, "orders").select("o_orderkey", F.pow(F.col("o_totalprice") / 1000, F.lit(3.0)).alias("measure"))
    data = from_frame(made)
    q = TableStats(data).numbers["measure"]
    spread = q["fq3"] - q["fq1"]
    bounds = {"lower": repr(q["fq1"] - 1.5 * spread), "upper": repr(q["fq3"] + 1.5 * spread), "flag_column": "flagged"}
    return cleaning.apply_actions(data, [act("flag_outliers", "measure", **bounds)]).visible.select("o_orderkey", "flagged")


register("cln_flag_outliers", cln_flag_outliers, """
    WITH t AS (SELECT o_orderkey, pow(o_totalprice / 1000, 3.0) AS v FROM orders), q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM t)
    SELECT o_orderkey, v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a) AS flagged FROM t, q""")
register("cln_replay", cleaned(
    orders_with_gaps, (act("trim_whitespace", "o_orderstatus"), act("blank_to_missing", "o_orderpriority")), (act("fill_category_missing", "o_orderpriority", value="Missing"), act("drop_column", "o_custkey")),
), f"""SELECT o_orderkey, trim(o_orderstatus) AS o_orderstatus, COALESCE(CASE WHEN trim(o_orderpriority) <> '' THEN o_orderpriority END, 'Missing') AS o_orderpriority,
       o_totalprice, o_orderdate FROM {ORDERS}""")


def det_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name, source in (("orders", orders_with_gaps), ("spellings", spellings), ("numbers", number_texts), ("doubled", doubled)):
        rows += [(name, a.kind, a.column, a.affected_rows) for a in cleaning.suggest_actions(from_frame(source(spark, sf_dir)))]
    return spark.createDataFrame(rows, "source string, kind string, name string, affected_rows long")


register("det_actions", det_actions, f"""
    SELECT 'orders' AS source, 'trim_whitespace' AS kind, 'o_orderstatus' AS name, COUNT(*) FILTER (o_orderstatus <> trim(o_orderstatus)) AS affected_rows FROM {ORDERS}
    UNION ALL SELECT 'orders', 'trim_whitespace', 'o_orderpriority', COUNT(*) FILTER (o_orderpriority <> trim(o_orderpriority)) FROM {ORDERS}
    UNION ALL SELECT 'orders', 'blank_to_missing', 'o_orderpriority', COUNT(*) FILTER (trim(o_orderpriority) = '') FROM {ORDERS}
    UNION ALL SELECT 'orders', 'fill_category_missing', 'o_orderpriority', COUNT(*) FILTER (o_orderpriority IS NULL) FROM {ORDERS}
    UNION ALL SELECT 'spellings', 'trim_whitespace', 'segment', COUNT(*) FILTER (segment <> trim(segment)) FROM {SPELLINGS}
    UNION ALL SELECT 'spellings', 'normalize_categories', 'segment', COUNT(*) FILTER (segment <> upper(trim(segment))) FROM {SPELLINGS}
    UNION ALL SELECT 'numbers', 'trim_whitespace', 'price', COUNT(*) FILTER (price <> trim(price)) FROM {NUMBER_TEXTS}
    UNION ALL SELECT 'numbers', 'blank_to_missing', 'price', COUNT(*) FILTER (trim(price) = '') FROM {NUMBER_TEXTS}
    UNION ALL SELECT 'numbers', 'convert_numeric', 'whole', COUNT(*) FILTER (trim(whole) <> '') FROM {NUMBER_TEXTS}
    UNION ALL SELECT 'doubled', 'drop_duplicates', NULL, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {DOUBLED})) FROM {DOUBLED}""")


# ---- Guided charts ---------------------------------------------------------------------------------------------------

LABEL = "CASE WHEN {0} IS NULL OR trim({0}) = '' THEN '(missing)' ELSE trim({0}) END"
PRIORITY = LABEL.format("o_orderpriority")
register("cht_missingness", lambda s, d: charts.missingness(orders_with_gaps(s, d)), f"""
    SELECT 'o_orderpriority' AS "column", ROUND(100 * COUNT(*) FILTER (o_orderpriority IS NULL OR trim(o_orderpriority) = '') / COUNT(*), 2) AS missing_percent FROM {ORDERS}""")
register("cht_category_count", lambda s, d: charts.category_count(read_table(s, d, "documents"), "source"), 'SELECT source, COUNT(*) AS "count" FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15')
register("cht_category_missing", lambda s, d: charts.category_count(orders_with_gaps(s, d), "o_orderpriority"),
         f'SELECT {PRIORITY} AS o_orderpriority, COUNT(*) AS "count" FROM {ORDERS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15')
register("cht_pie_other", lambda s, d: charts.pie(read_table(s, d, "documents"), "source"), """
    WITH c AS (SELECT source, COUNT(*) AS n, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, source) AS r FROM documents GROUP BY 1)
    SELECT CASE WHEN r <= 7 THEN source ELSE '(other)' END AS source, CAST(SUM(n) AS BIGINT) AS "count", ROUND(100 * SUM(n) / (SELECT SUM(n) FROM c), 2) AS share_percent FROM c GROUP BY 1""")
register("cht_box", lambda s, d: charts.box(read_table(s, d, "lineitem"), "l_extendedprice", "l_returnflag"), """
    SELECT l_returnflag, COUNT(*) AS "count", ROUND(MIN(l_extendedprice), 4) AS min, ROUND(quantile_cont(l_extendedprice, 0.25), 4) AS q1, ROUND(MEDIAN(l_extendedprice), 4) AS median,
           ROUND(quantile_cont(l_extendedprice, 0.75), 4) AS q3, ROUND(MAX(l_extendedprice), 4) AS max FROM lineitem GROUP BY 1""")
BINS = """edges AS (SELECT i, low + i * (high - low) / bins AS bin_start, low + (i + 1) * (high - low) / bins AS bin_end FROM stats, range(CAST(bins AS BIGINT)) AS g(i)),
    hits AS (SELECT greatest(least(ceil((v - low) / ((high - low) / bins)), bins), 1) - 1 AS i, COUNT(*) AS n FROM vals, stats GROUP BY 1)
    SELECT ROUND(bin_start, 4) AS bin_start, ROUND(bin_end, 4) AS bin_end, COALESCE(n, 0) AS "count" FROM edges LEFT JOIN hits ON hits.i = edges.i"""
register("cht_histogram", lambda s, d: rounded(charts.binned(read_table(s, d, "orders"), F.col("o_totalprice"), None).drop("bin"), "bin_start", "bin_end"), f"""
    WITH vals AS (SELECT o_totalprice AS v FROM orders),
    stats AS (SELECT MIN(v) AS low, MAX(v) AS high, least(20, greatest(3, ceil((MAX(v) - MIN(v)) / (2 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) * pow(COUNT(v), -1.0 / 3))))) AS bins FROM vals), {BINS}""")
for grain in GRAINS:
    register(f"cht_time_mean_{grain}", lambda s, d, g=grain: rounded(charts.time_series(read_table(s, d, "orders"), "o_orderdate", "o_totalprice", "mean", g), "o_totalprice"),
             f"SELECT date_trunc('{grain}', o_orderdate)::TIMESTAMP AS o_orderdate, ROUND(AVG(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1")
register("cht_time_count", lambda s, d: charts.time_series(read_table(s, d, "events"), "ts", grain="day"), """SELECT date_trunc('day', ts)::TIMESTAMP AS ts, COUNT(*) AS "count" FROM events GROUP BY 1""")
register("cht_cumulative", lambda s, d: rounded(charts.time_area(read_table(s, d, "orders"), "o_orderdate", "o_totalprice"), "o_totalprice", "cumulative", places=2), """
    WITH p AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS o_orderdate, SUM(o_totalprice) AS v FROM orders GROUP BY 1)
    SELECT o_orderdate, ROUND(v, 2) AS o_totalprice, ROUND(SUM(v) OVER (ORDER BY o_orderdate), 2) AS cumulative FROM p""")
for name, sql in (("mean", "AVG"), ("median", "MEDIAN"), ("sum", "SUM"), ("min", "MIN"), ("max", "MAX"), ("count", "COUNT")):
    exact = name == "count"
    register(
        f"cht_category_{name}" if not exact else "cht_category_values",
        lambda s, d, f=name: (lambda df: df if f == "count" else rounded(df, "p_retailprice"))(charts.category_aggregate(read_table(s, d, "part"), "p_brand", "p_retailprice", f)),
        f"SELECT p_brand, {f'{sql}(p_retailprice)' if exact else f'ROUND({sql}(p_retailprice), 4)'} AS p_retailprice FROM part GROUP BY 1 ORDER BY {sql}(p_retailprice) DESC, p_brand LIMIT 15",
    )


def cht_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.scatter(from_frame(read_table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")).frame, "l_quantity", "l_extendedprice")


register("cht_scatter", cht_scatter)
# Of up to 5,000 complete rows all are points; the sample of more can't be said in SQL.
register("cht_scatter_all", lambda s, d: charts.scatter(from_frame(read_table(s, d, "customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal"))).filter("c_custkey <= 4000")).frame, "c_custkey", "c_acctbal"),
         "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_acctbal FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey <= 4000")


# ---- Cards and filters -----------------------------------------------------------------------------------------------

for name, sql in (("row_count", "COUNT(*)"), ("distinct_count", "COUNT(DISTINCT o_custkey)"), ("sum", "SUM(o_totalprice)"), ("mean", "AVG(o_totalprice)"), ("median", "MEDIAN(o_totalprice)")):
    column = {"row_count": None, "distinct_count": "o_custkey"}.get(name, "o_totalprice")
    register(f"crd_kpi_{name}", lambda s, d, m=name, c=column: rounded(cards.kpi(read_table(s, d, "orders"), m, c), "value", places=2),
             f"SELECT '{name}' AS metric, '{column or '(all rows)'}' AS source_column, COUNT(*) AS valid_rows, ROUND(CAST({sql} AS DOUBLE), 2) AS value FROM orders")
register("crd_bar_sum", lambda s, d: rounded(cards.bar(read_table(s, d, "customer"), "c_mktsegment", "sum", "c_acctbal"), "value", places=2),
         "SELECT c_mktsegment AS category, ROUND(SUM(c_acctbal), 2) AS value FROM customer GROUP BY 1 ORDER BY SUM(c_acctbal) DESC, 1 LIMIT 12")
register("crd_bar_distinct", lambda s, d: cards.bar(read_table(s, d, "customer"), "c_mktsegment", "distinct_count", "c_nationkey"),
         "SELECT c_mktsegment AS category, COUNT(DISTINCT c_nationkey) AS value FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
register("crd_pie_other", lambda s, d: cards.pie(read_table(s, d, "documents"), "source", top=5), """
    WITH c AS (SELECT source, COUNT(*) AS n, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, source) AS r FROM documents GROUP BY 1)
    SELECT CASE WHEN r <= 5 THEN source ELSE '(other)' END AS category, CAST(SUM(n) AS BIGINT) AS value, ROUND(100 * SUM(n) / (SELECT SUM(n) FROM c), 2) AS share_percent FROM c GROUP BY 1""")
register("crd_pie_distinct", lambda s, d: cards.pie(read_table(s, d, "documents"), "source", "distinct_count", "lang", top=5), """
    WITH c AS (SELECT source, COUNT(DISTINCT lang) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
    SELECT source AS category, n AS value, ROUND(100 * n / (SELECT SUM(n) FROM c), 2) AS share_percent FROM c""")
register("crd_line_distinct", lambda s, d: cards.line(read_table(s, d, "events"), "ts", "distinct_count", "user_id", "week"),
         "SELECT date_trunc('week', ts)::TIMESTAMP AS period, COUNT(DISTINCT user_id) AS value FROM events GROUP BY 1")
register("crd_distribution", lambda s, d: rounded(cards.distribution(read_table(s, d, "lineitem"), "l_extendedprice").drop("bin"), "bin_start", "bin_end"), f"""
    WITH vals AS (SELECT l_extendedprice AS v FROM lineitem), stats AS (SELECT MIN(v) AS low, MAX(v) AS high, 12 AS bins FROM vals), {BINS}""")


def crd_filters_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = (
        cards.Filter("a", "o_orderpriority", "values", ("(missing)", "1-URGENT")), cards.Filter("b", "o_totalprice", "range", minimum=50_000.0, maximum=200_000.0),
        cards.Filter("c", "o_orderdate", "date_range", start="1994-01-01", end="1996-12-31"),
    )
    return cards.apply_filters(orders_with_gaps(spark, sf_dir), filters).select("o_orderkey", "o_totalprice")


register("crd_filters_all", crd_filters_all, f"""
    SELECT o_orderkey, o_totalprice FROM {ORDERS} WHERE {PRIORITY} IN ('(missing)', '1-URGENT') AND o_totalprice BETWEEN 50000 AND 200000
      AND o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'""")
register("crd_filter_options", lambda s, d: cards.filter_options(read_table(s, d, "documents"), "source"), 'SELECT source AS label, COUNT(*) AS "count" FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200')


def crd_default_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = cards.default_config(from_frame(orders_with_gaps(spark, sf_dir)))
    return spark.createDataFrame([(c.card_id, c.kind, c.metric, c.column, c.x, c.y) for c in config.cards], "card_id string, kind string, metric string, source string, x string, y string")


register("crd_default_dashboard", crd_default_dashboard, rows_sql(
    "card_id, kind, metric, source, x, y", "'rows', 'kpi', 'row_count', NULL, NULL, NULL", "'mean', 'kpi', 'mean', 'o_orderkey', NULL, NULL",
    "'share', 'pie', 'row_count', NULL, 'o_orderstatus', NULL", "'trend', 'line', 'mean', 'o_orderkey', 'o_orderdate', NULL",
))


# ---- Export, review and guarded SQL ----------------------------------------------------------------------------------

register("export_records", lambda s, d: json_records(read_table(s, d, "events")), r"""
    SELECT '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 <> 0 THEN '.' || strftime(ts, '%f') ELSE '' END || '","user_id":' || user_id ||
      ',"event_type":"' || event_type || '","value":' || CAST(value AS VARCHAR) || ',"props":"' || replace(replace(props, '\', '\\'), '"', '\"') || '"}' AS record FROM events""")

LINTED = (
    ("plain", "SELECT o_orderstatus, COUNT(*) AS n FROM uploaded_data GROUP BY o_orderstatus ORDER BY n DESC LIMIT 10"), ("star", "SELECT * FROM uploaded_data"),
    ("null", "SELECT o_orderkey FROM uploaded_data WHERE o_orderstatus = NULL LIMIT 5"), ("like", "SELECT o_orderkey FROM uploaded_data WHERE o_orderpriority LIKE '%HIGH' LIMIT 5"),
    ("cross", "SELECT a.o_orderkey FROM uploaded_data a CROSS JOIN uploaded_data b LIMIT 5"), ("distinct", "SELECT DISTINCT o_orderstatus FROM uploaded_data ORDER BY 1"),
    ("group", "SELECT o_orderkey, COUNT(*) AS n FROM uploaded_data GROUP BY o_orderkey LIMIT 5"), ("not_in", "SELECT o_orderkey FROM uploaded_data WHERE o_custkey NOT IN (SELECT o_custkey FROM uploaded_data) LIMIT 5"),
    ("function", "SELECT o_orderkey FROM uploaded_data WHERE upper(o_orderstatus) = 'F' LIMIT 5"), ("union", "SELECT o_orderkey FROM uploaded_data UNION SELECT o_custkey FROM uploaded_data"),
)


def lint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "orders")
    rows = [(name, f.rule, f.severity) for name, sql in LINTED for f in sqlguard.lint(df, sqlguard.parse(spark, sql))]
    return spark.createDataFrame(rows, "sql_id string, rule string, severity string")


BY_SIZE = "CASE WHEN (SELECT COUNT(*) FROM orders) > 10000 THEN 'medium' ELSE 'low' END"
register("lint_findings", lint_findings, rows_sql(
    "sql_id, rule, severity", f"'star', 'unbounded-detail', {BY_SIZE}", "'star', 'explicit-columns', 'low'", "'null', 'null-comparison', 'high'", "'like', 'leading-wildcard', 'medium'",
    "'cross', 'cross-join', 'high'", "'cross', 'repeated-upload-scan', 'medium'", f"'distinct', 'distinct-cost', {BY_SIZE}", "'distinct', 'unbounded-sort', 'medium'", "'distinct', 'ordinal-order', 'low'",
    "'group', 'high-cardinality-group-o_orderkey', 'medium'", "'not_in', 'not-in-subquery', 'high'", "'function', 'function-on-filter-column', 'medium'", "'union', 'union-deduplication', 'low'",
))


def coach_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "orders")
    made = [(name, sqlguard.analyze(df, sql)) for name, sql in LINTED]
    return spark.createDataFrame([(n, a.score, a.formatted, ", ".join(c for c, _ in a.clauses)) for n, a in made], "sql_id string, score int, formatted string, clauses string")


def coach_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planned operators of each query, which depend on the engine's settings."""
    df = read_table(spark, sf_dir, "orders")
    made = [(name, sqlguard.analyze(df, sql)) for name, sql in LINTED]
    return spark.createDataFrame([(n, i, s.node, s.meaning) for n, a in made for i, s in enumerate(a.steps)], "sql_id string, place int, node string, meaning string")


def _penalty(least: int, by_size: bool) -> str:
    """A score: 100 less 25, 12 or 5 for each finding; one of them depends on the size of the table."""
    return f"100 - {least}" + (" - CASE WHEN (SELECT COUNT(*) FROM orders) > 10000 THEN 12 ELSE 5 END" if by_size else "")


#: By query: what is taken off, whether the size matters, the clauses, and where lines break.
REVIEWED = {
    "plain": (0, False, "SELECT, FROM, GROUP BY, ORDER BY, LIMIT", " FROM| GROUP BY| ORDER BY| LIMIT"), "star": (5, True, "SELECT, FROM", " FROM"), "null": (25, False, "SELECT, FROM, WHERE, LIMIT", " FROM| WHERE| LIMIT"),
    "like": (12, False, "SELECT, FROM, WHERE, LIMIT", " FROM| WHERE| LIMIT"), "cross": (37, False, "SELECT, FROM, JOIN, LIMIT", " FROM| CROSS JOIN| LIMIT"), "distinct": (17, True, "SELECT, FROM, ORDER BY", " FROM| ORDER BY"),
    "group": (12, False, "SELECT, FROM, GROUP BY, LIMIT", " FROM| GROUP BY| LIMIT"), "function": (12, False, "SELECT, FROM, WHERE, LIMIT", " FROM| WHERE| LIMIT"),
}


def review_sql() -> str:
    texts = dict(LINTED)
    texts |= {name: re.sub(f"({breaks})", lambda m: "\n" + m[0][1:], texts[name]) for name, (_, _, _, breaks) in REVIEWED.items()}
    texts["not_in"] = "SELECT o_orderkey\nFROM uploaded_data\nWHERE o_custkey NOT IN (\n  SELECT o_custkey\n  FROM uploaded_data\n)\nLIMIT 5"
    texts["union"] = "SELECT o_orderkey\nFROM uploaded_data\nUNION\nSELECT o_custkey\nFROM uploaded_data"
    rest = {name: (least, size, clauses) for name, (least, size, clauses, _) in REVIEWED.items()} | {"not_in": (25, False, "SELECT, FROM, WHERE, LIMIT"), "union": (5, False, "FROM, UNION")}
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    return rows_sql("sql_id, score, formatted, clauses", *(f"'{n}', {_penalty(least, size)}, {quoted(texts[n] + ';')}, '{clauses}'" for n, (least, size, clauses) in rest.items()))


register("coach_review", coach_review, review_sql())
register("coach_steps", coach_steps)

GUARDED = {
    "sql_self_join": ("orders", "SELECT a.o_orderstatus, COUNT(*) AS n FROM {t} a JOIN {t} b ON a.o_orderkey = b.o_custkey GROUP BY a.o_orderstatus"),
    "sql_anti": ("orders", "SELECT o_orderkey, o_custkey FROM {t} a WHERE NOT EXISTS (SELECT 1 FROM {t} b WHERE b.o_orderkey = a.o_custkey)"),
    "sql_union": ("customer", "SELECT c_mktsegment AS v FROM {t} UNION SELECT CAST(c_nationkey AS VARCHAR(20)) FROM {t}"),
    "sql_window": ("part", "SELECT p_partkey, p_brand, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM {t}"),
    "sql_cte": ("orders", "WITH t AS (SELECT o_custkey, COUNT(*) AS n FROM {t} GROUP BY o_custkey HAVING COUNT(*) > 1) SELECT n, COUNT(*) AS customers FROM t WHERE n >= (SELECT MIN(n) FROM t) GROUP BY n"),
}
for name, (source, text) in GUARDED.items():
    register(name, lambda s, d, t=source, q=text: sqlguard.run_guarded(read_table(s, d, t), q.format(t="uploaded_data")), text.format(t=source))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
