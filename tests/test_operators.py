"""Hand-made tables with hand-computed results, for the workbench's operators."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tablewright.dataset import LoadError, Limits, from_frame
from tablewright.functions import exprs
from tablewright.operators import advisor, cards, charts, cleaning, profile, query, roles
from tablewright.operators.cleaning import CleaningAction, CleaningError
from tablewright.operators.query import AggregateRule, FilterRule, QueryError, QuerySpec
from tablewright.operators.stats import TableStats


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows, schema: from_frame(spark.createDataFrame(rows, schema).coalesce(1))


@pytest.fixture(scope="module")
def customers(make):
    rows = [
        (101, "Enterprise", 4200.0, 9.1, "2025-06-01"), (102, "Small Business", 850.0, 8.2, "2025-06-04"), (103, "Enterprise", 5100.0, None, "2025-06-06"),
        (104, "Consumer", None, 7.4, "2025-05-02"), (105, "Small Business", 920.0, 8.8, "2025-06-08"), (106, "Small Business", 920.0, None, "2025-05-09"),
    ]
    return make(rows, "customer_id long, segment string, monthly_spend double, satisfaction_score double, last_contact string")


@pytest.fixture(scope="module")
def orders(make):
    rows = [
        (101, "2025-01-01", "A", 100.0, 1), (102, "2025-01-15", "A", 500.0, 2), (103, "2025-02-01", "B", 300.0, 3), (104, "bad", "A", 400.0, 1),
        (105, "2025-02-20", None, 600.0, 2), (106, "2025-02-21", "B", 600.0, 4), (107, "2025-02-27", "A", 700.0, 5), (108, "2025-03-01", "B", None, 6),
    ]
    return make(rows, "order_id long, date string, segment string, revenue double, units long")


def values(df):
    return [tuple(r) for r in df.collect()]


# ---- Expressions -----------------------------------------------------------------------------------------------------


def test_strip_fold_and_labels(spark):
    df = spark.createDataFrame([("  x\x1c\t",), ("  ",), (None,), ("Straße",)], "c string")
    assert values(df.select(exprs.strip(F.col("c")), exprs.label(F.col("c")))) == [("x", "x"), ("", "(missing)"), (None, "(missing)"), ("Straße", "Straße")]
    assert df.select(exprs.fold(F.col("c"))).collect()[3][0] == "strasse"


@pytest.mark.parametrize(("text", "number"), [("12", 12.0), (" -3.5e2 ", -350.0), (".5", 0.5), ("1,000", None), ("12d", None), ("", None), ("NaN", None), (None, None)])
def test_numbers(spark, text, number):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(exprs.to_number(F.col("c"), df.schema["c"].dataType)).first()[0] == number


@pytest.mark.parametrize(("text", "day"), [
    ("2025-01-02", dt.datetime(2025, 1, 2)), ("2025-01-02T03:04:05Z", dt.datetime(2025, 1, 2, 3, 4, 5)), ("2025-01-02T03:04:05+02:00", dt.datetime(2025, 1, 2, 1, 4, 5)),
    ("1/2/2025", dt.datetime(2025, 1, 2)), ("25/1/2025", dt.datetime(2025, 1, 25)), ("Jan 2 2025", dt.datetime(2025, 1, 2)), ("2025-03", dt.datetime(2025, 3, 1)),
    ("20250102", dt.datetime(2025, 1, 2)), ("10:30", None), ("words", None), ("2025-13-45", None),
])
def test_dates(spark, text, day):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(exprs.to_timestamp(F.col("c"), df.schema["c"].dataType)).first()[0] == day


def test_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 2.5, 3, 10)], "v double")
    assert [r[0] for r in df.select(exprs.bin_index(F.col("v"), 0.0, 10.0, 10)).collect()] == [0, 0, 1, 2, 2, 9]


# ---- Dataset ---------------------------------------------------------------------------------------------------------


def test_limits_and_names(spark):
    df = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")
    with pytest.raises(LoadError, match="1 rows"):
        from_frame(df, limits=Limits(max_rows=1))
    with pytest.raises(LoadError, match="1 columns"):
        from_frame(df, limits=Limits(max_columns=1))
    with pytest.raises(LoadError, match="non-empty"):
        from_frame(df.toDF("a", " "))
    with pytest.raises(ValueError, match="positive"):
        Limits(max_rows=0)
    assert values(from_frame(spark.createDataFrame([(float("nan"),)], "x double")).visible) == [(None,)]


# ---- Queries ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([("Enterprise", 1200.0, True), ("Enterprise", 800.0, False), ("Consumer", 300.0, True), (None, 100.0, False)], "`customer segment` string, revenue double, active boolean")


def test_filter_sort_and_coercion(sales):
    spec = QuerySpec(("customer segment", "revenue"), (FilterRule("revenue", "gte", "500"),), sort_by="revenue", sort_descending=True)
    assert values(query.run_query(sales, spec)) == [("Enterprise", 1200.0), ("Enterprise", 800.0)]
    assert values(query.run_query(sales, QuerySpec(("revenue",), (FilterRule("revenue", "gt", "1,000"),)))) == [(1200.0,)]
    assert values(query.run_query(sales, QuerySpec(("revenue",), (FilterRule("customer segment", "is_null"),)))) == [(100.0,)]
    assert query.run_query(sales, QuerySpec(("revenue",), (FilterRule("active", "eq", "yes"),))).count() == 2
    assert query.run_query(sales, QuerySpec((), (FilterRule("customer segment", "contains", None),))).count() == 3
    assert query.run_query(sales, QuerySpec((), (FilterRule("customer segment", "eq", "x' OR 1=1 --"),))).count() == 0


def test_groups(sales):
    spec = QuerySpec(group_by=("customer segment",), aggregates=(AggregateRule("mean", "revenue", "average"), AggregateRule("count_rows")), sort_by="average", sort_descending=True, limit=1)
    assert values(query.run_query(sales, spec)) == [("Enterprise", 1000.0, 2)]
    built = query.build_query(sales, spec)
    assert values(sales.sparkSession.sql(built.sql.replace("`uploaded_data`", "{t}"), args=built.parameters, t=sales)) == [("Enterprise", 1000.0, 2)]
    plan = query.run_query(sales, spec)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


@pytest.mark.parametrize("spec", [
    QuerySpec(("nope",)), QuerySpec(("revenue", "revenue")), QuerySpec(limit=0), QuerySpec(limit=5_001), QuerySpec(limit=True), QuerySpec(group_by=("active",)),
    QuerySpec(("revenue",), aggregates=(AggregateRule("count_rows"),)), QuerySpec(aggregates=(AggregateRule("mean"),)), QuerySpec(aggregates=(AggregateRule("count_rows", "revenue"),)),
    QuerySpec(aggregates=(AggregateRule("mean", "active"),)), QuerySpec(aggregates=(AggregateRule("sum", "revenue", " "),)), QuerySpec(("revenue",), sort_by="active"),
    QuerySpec(filters=(FilterRule("revenue", "like", 1),)), QuerySpec(filters=(FilterRule("revenue", "eq", "x"),)), QuerySpec(filters=(FilterRule("revenue", "eq", None),)),
    QuerySpec(aggregates=(AggregateRule("min", "revenue", "a"), AggregateRule("max", "revenue", "a"))),
])
def test_bad_specifications(sales, spec):
    with pytest.raises(QueryError):
        query.run_query(sales, spec)


# ---- Profiles and roles ----------------------------------------------------------------------------------------------


def test_profile(make):
    data = make([(1, "x", 1.0), (2, "x", None), (3, "x", None), (4, "x", 2.0)], "id long, segment string, score double")
    p = profile.profile(data)
    assert (p.rows, p.columns, p.missing_cells, p.duplicate_rows) == (4, 3, 2, 0) and p.score < 100
    assert {(i.title, i.column) for i in p.issues} == {("High missingness", "score"), ("Constant column", "segment")}
    assert p.column_profile[2]["missing_percent"] == 50.0 and p.column_profile[0]["examples"] == "1, 2, 3"


def test_blanks_are_missing(make):
    p = profile.profile(make([("a",), ("",), ("  ",), (None,)], "value string"))
    assert (p.column_profile[0]["missing_count"], p.column_profile[0]["missing_percent"], p.column_profile[0]["unique_count"]) == (3, 75.0, 3)


def test_empty_table(make):
    p = profile.profile(make([], "a string, b double"))
    assert (p.rows, p.score, p.issues[0].severity) == (0, 0, "critical")
    assert cleaning.suggest_actions(make([], "a string")) == ()


def test_statistics_take_few_jobs(spark, customers):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("stats", "stats")
    stats = TableStats(customers)
    profile.profile(customers, stats)
    roles.infer_semantics(customers, stats)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("stats")) <= 22


def test_roles(customers, make):
    assert {s.column: s.role for s in roles.infer_semantics(customers)} == {
        "customer_id": "identifier", "segment": "categorical", "monthly_spend": "numeric", "satisfaction_score": "numeric", "last_contact": "datetime"
    }
    years = make([(2020, 10), (2021, 30), (2021, 20)], "report_year long, sales long")
    assert roles.infer_roles(years) == roles.ColumnRoles(numeric=("sales",), datetime=("report_year",))
    assert values(charts.time_series(years.frame, "report_year", "sales", "sum", "year")) == [(dt.datetime(2020, 1, 1), 10.0), (dt.datetime(2021, 1, 1), 50.0)]
    codes = make([("001",), ("002",), ("003",), ("004",)], "account_code string")
    assert roles.infer_roles(codes).datetime == () and cleaning.suggest_actions(codes) == ()


def test_overview(customers):
    stats = TableStats(customers)
    assert [s.kind for s in roles.suggest_charts(stats, roles.infer_roles(customers, stats))] == ["missingness", "pie", "time_series", "box"]


# ---- Charts ----------------------------------------------------------------------------------------------------------


def test_guided_charts(customers):
    df = customers.frame
    assert [r["share_percent"] for r in charts.pie(df, "segment").collect()] == [50.0, 33.33, 16.67]
    boxes = {r["segment"]: r for r in charts.box(df, "monthly_spend", "segment").collect()}
    assert (boxes["Enterprise"]["q1"], boxes["Enterprise"]["q3"]) == (4425.0, 4875.0) and "Consumer" not in boxes
    assert (boxes["Small Business"]["count"], boxes["Small Business"]["min"], boxes["Small Business"]["median"]) == (3, 850.0, 920.0)
    assert charts.time_area(df, "last_contact", "monthly_spend").collect()[-1]["cumulative"] == 11_990.0
    assert charts.missingness(df).collect()[0]["column"] == "satisfaction_score"


def test_pie_tail(make):
    rows = [(c,) for c in "aabcdefghi"]
    out = charts.pie(make(rows, "city string").frame, "city").collect()
    assert len(out) == 8 and out[-1]["city"] == "(other)" and sum(r["count"] for r in out) == 10


def test_histogram_keeps_all_rows(make):
    data = make([(float(v),) for v in [1, 1, 2, 3, 50]] + [(None,), (float("inf"),)], "x double")
    assert sum(r["count"] for r in charts.histogram(data.frame, "x").collect()) == 5
    out = cards.distribution(data.frame, "x", 10).collect()
    assert len(out) == 10 and [r["count"] for r in out][:2] == [4, 0]
    assert len(charts.histogram(make([(2.0,), (2.0,)], "x double").frame, "x").collect()) == 1


def test_scatter_sample(spark):
    data = from_frame(spark.range(6000).select(F.col("id").alias("x"), (F.col("id") * 2).alias("y")))
    one, two = values(charts.scatter(data.frame, "x", "y")), values(charts.scatter(data.frame, "x", "y"))
    assert len(one) == 5000 and one == two and one == sorted(one)


def test_category_aggregate_keeps_blanks_apart(make):
    data = make([(" a", 1.0), ("a", 2.0), (None, 5.0), ("", 4.0), ("b", None)], "k string, v double")
    assert values(charts.category_aggregate(data.frame, "k", "v", "sum")) == [("(missing)", 5.0), ("", 4.0), ("a", 2.0), (" a", 1.0)]


# ---- Cards -----------------------------------------------------------------------------------------------------------


def test_cards(orders):
    df = orders.frame
    assert cards.kpi(df, "sum", "revenue").first()["value"] == 3200.0
    assert cards.kpi(df, "mean", "revenue").first()["value"] == pytest.approx(3200 / 7)
    assert cards.kpi(df, "median", "revenue").first()["value"] == 500.0
    assert cards.kpi(df, "distinct_count", "segment").first()["value"] == 2
    assert values(cards.pie(df, "segment")) == [("A", 4, 50.0), ("B", 3, 37.5), ("(missing)", 1, 12.5)]
    assert values(cards.bar(df, "segment", "sum", "revenue")) == [("A", 1700.0), ("B", 900.0), ("(missing)", 600.0)]
    assert [(r[0].month, r[1]) for r in cards.line(df, "date", "sum", "revenue").collect()] == [(1, 600.0), (2, 2200.0)]
    assert sum(r["count"] for r in cards.distribution(df, "revenue", 5).collect()) == 7


def test_pie_rules(make):
    data = make([(c,) for c in "aaaaabbbbcccdde"], "city string")
    assert [(r["category"], r["value"]) for r in cards.pie(data.frame, "city", top=3).collect()] == [("a", 5), ("b", 4), ("c", 3), ("(other)", 3)]
    with pytest.raises(cards.CardError):
        cards.pie(data.frame, "city", "mean", "city")


def test_filters(orders):
    df = orders.frame
    filters = (cards.Filter("a", "segment", "values", ("B", "(missing)")), cards.Filter("b", "revenue", "range", minimum=300.0, maximum=600.0), cards.Filter("c", "date", "date_range", start="2025-02-01", end="2025-02-20"))
    assert [r["order_id"] for r in cards.apply_filters(df, filters).orderBy("order_id").collect()] == [103, 105]
    found = roles.infer_roles(orders)
    kept = cards.apply_filters(df, tuple(cards.default_filter(df, c, c, found) for c in ("revenue",)))
    assert [r["order_id"] for r in kept.orderBy("order_id").collect()] == [101, 102, 103, 104, 105, 106, 107]
    with pytest.raises(cards.CardError):
        cards.apply_filters(df, filters[:1] * 2)


def test_configuration(orders):
    df = orders.frame
    config = cards.default_config(orders)
    assert cards.config_from_json(cards.config_to_json(config), df) == config
    for spoil in ({"version": 9}, {"extra": 1}, {"cards": []}, {"name": ""}, {"cards": [{"card_id": "a b", "kind": "kpi", "title": "x"}]}, {"cards": [{"card_id": "a", "kind": "kpi", "title": "x", "odd": 1}]}):
        with pytest.raises(cards.CardError):
            cards.config_from_json(json.dumps({**json.loads(cards.config_to_json(config)), **spoil}), df)
    with pytest.raises(cards.CardError):
        cards.config_from_json(" " * 100_001, df)
    assert cards.move_card(config, config.cards[0].card_id, -1) == config
    assert cards.move_card(config, config.cards[0].card_id, 1).cards[1] == config.cards[0]
    assert len(cards.remove_card(config, config.cards[0].card_id).cards) == len(config.cards) - 1
    assert cards.next_id(config) == "card-1"


@pytest.mark.parametrize(("value", "text"), [(None, "No data"), (1200.0, "1,200"), (1234567.89, "1,234,567.9"), (123.456, "123.46"), (1.5, "1.5")])
def test_value_format(value, text):
    assert cards.format_value(value) == text


# ---- Cleaning --------------------------------------------------------------------------------------------------------


def kinds(data):
    return {(a.kind, a.column) for a in cleaning.suggest_actions(data)}


def test_trim_blank_and_merge(make):
    data = make([(" A ", 1), ("a", 2), ("A", 3), ("", 4), (None, 5), ("A", 6)], "segment string, value long")
    assert {("trim_whitespace", "segment"), ("blank_to_missing", "segment"), ("normalize_categories", "segment")} <= kinds(data)
    chosen = [a for a in cleaning.suggest_actions(data) if a.column == "segment" and a.kind != "fill_category_missing"]
    assert [r["segment"] for r in cleaning.apply_actions(data, chosen).visible.orderBy("value").collect()] == ["A", "A", "A", None, None, "A"]
    assert [r["segment"] for r in data.visible.orderBy("value").collect()][:2] == [" A ", "a"]


def test_duplicates_keep_the_first(make):
    data = make([("a", 1), ("b", 2), ("a", 1)], "name string, value long")
    assert ("drop_duplicates", None) in kinds(data)
    out = cleaning.apply_actions(data, [CleaningAction("drop_duplicates")])
    assert [tuple(r)[:2] for r in out.frame.orderBy("__row_key").collect()] == [("a", 1), ("b", 2)]


def test_conversions(make):
    data = make([("1", "2025-01-01", "x1"), ("2", "2025-01-02", "007"), ("3", "2025-02-03", "008"), (" ", None, "9")], "amount string, event_date string, other string")
    found = {a.kind: a for a in cleaning.suggest_actions(data) if a.kind.startswith("convert")}
    assert {(k, a.column) for k, a in found.items()} == {("convert_numeric", "amount"), ("convert_datetime", "event_date")}
    out = cleaning.apply_actions(data, found.values())
    assert dict(out.visible.dtypes) == {"amount": "bigint", "event_date": "timestamp_ntz", "other": "string"}
    assert [r["amount"] for r in out.visible.collect()] == [1, 2, 3, None]


def test_fills(make):
    data = make([(10.0, "missing"), (30.0, "b"), (30.0, "b"), (None, None), (50.0, "b"), (20.0, "missing")], "score double, segment string")
    found = {a.kind: a for a in cleaning.suggest_actions(data)}
    assert found["fill_numeric_median"].parameter("value") == "30.0" and found["fill_category_missing"].parameter("value") == "Missing (2)"
    out = cleaning.apply_actions(data, [found["fill_numeric_median"], found["fill_category_missing"]]).visible.collect()
    assert out[3] == (30.0, "Missing (2)")


def test_outliers(make):
    data = make([(float(v),) for v in [10, 11, 12, 13, 14, 15, 16, 1000]], "revenue double")
    (action,) = [a for a in cleaning.suggest_actions(data) if a.kind == "flag_outliers"]
    out = cleaning.apply_actions(data, [action])
    assert [r["revenue_is_outlier"] for r in out.visible.orderBy("revenue").collect()] == [False] * 7 + [True]
    assert ("flag_outliers", "revenue") not in kinds(out)
    infinite = make([(float(v),) for v in range(10, 18)] + [(float("inf"),)], "revenue double")
    (action,) = [a for a in cleaning.suggest_actions(infinite) if a.kind == "flag_outliers"]
    assert action.affected_rows == 1 and float(action.parameter("upper")) < 100


def test_drop_rules(make):
    data = make([(None, "c", "x"), (None, "c", None), (None, "c", None), (None, "c", None)], "empty string, constant string, sparse string")
    found = {a.column: dict(a.parameters)["reason"] for a in cleaning.suggest_actions(data) if a.kind == "drop_column"}
    assert found == {"empty": "empty", "constant": "constant", "sparse": "constant"}
    mostly = make([("a", 1), ("b", 2), (None, 3), (None, 4), (None, 5), (None, 6)], "sparse string, n long")
    assert [dict(a.parameters)["reason"] for a in cleaning.suggest_actions(mostly) if a.kind == "drop_column"] == ["mostly_missing"]
    padded = make([(" x",), (" x",)], "constant string")
    assert [a.kind for a in cleaning.suggest_actions(padded)] == ["drop_duplicates", "trim_whitespace", "drop_column"]
    assert profile.profile(make([(" ",), ("b",), ("",), ("c",)], "t string")).column_profile[0]["examples"] == "b, c"


def test_conflicts_and_replay(make):
    data = make([("a",), (" a",), ("a",)], "label string")
    with pytest.raises(CleaningError):
        cleaning.apply_actions(data, [CleaningAction("drop_column", "label"), CleaningAction("trim_whitespace", "label")])
    with pytest.raises(CleaningError):
        cleaning.apply_actions(data, [CleaningAction("drop_duplicates")] * 2)
    with pytest.raises(CleaningError):
        cleaning.apply_actions(data, [CleaningAction("trim_whitespace", "nope")])
    history = ((CleaningAction("trim_whitespace", "label"),), (CleaningAction("drop_duplicates"),))
    assert cleaning.replay(data, history).visible.count() == 1 and cleaning.replay(data, history[:-1]).visible.count() == 3
    assert cleaning.fingerprint(history) != cleaning.fingerprint(history[:1])


def test_recipes(make):
    data = make([(" a", "1"), ("a", "2"), ("b", "3"), ("b", "3"), (None, "x")], "name string, amount string")
    batch = [CleaningAction("drop_duplicates"), CleaningAction("trim_whitespace", "name"), CleaningAction("convert_numeric", "amount"), CleaningAction("flag_outliers", "amount", (("lower", "0"), ("upper", "2"), ("flag_column", "high")))]
    direct = cleaning.apply_actions(data, batch)
    text = cleaning.write_recipe("t.csv", "0" * 64, data, direct, [batch])
    again = cleaning.replay(data, cleaning.read_recipe(text))
    assert sorted(map(str, values(again.visible))) == sorted(map(str, values(direct.visible))) and again.visible.schema == direct.visible.schema
    assert cleaning.compare(data, direct)["rows"] == -1
    for bad in ("[", "{}", text.replace("drop_duplicates", "nonsense"), text.replace('"column": "name"', '"column": 3')):
        with pytest.raises(CleaningError):
            cleaning.read_recipe(bad)


# ---- Advisor ---------------------------------------------------------------------------------------------------------


def test_advisor(customers):
    stats = TableStats(customers)
    found = roles.infer_roles(customers, stats)
    brief = profile.metadata_brief(stats, roles.infer_semantics(customers, stats))
    assert "Enterprise" not in json.dumps(advisor.messages(brief, "Overview")) and brief["columns"][2]["missing_percent"] == 16.67
    answer = "```json\n" + json.dumps({"charts": [{"kind": "pie", "x": "segment"}, {"kind": "pie", "x": "nope"}, {"kind": "scatter", "x": "monthly_spend", "y": "monthly_spend"}, 3]}) + "\n```"
    sent = []
    send = lambda method, url, body, headers: (sent.append((url, headers)), (200, json.dumps({"choices": [{"message": {"content": answer}}]})))[1]
    out = advisor.ask(brief, "Overview", found, base_url="https://x.test/v1", model="m", api_key="k", send=send)
    assert [(s.kind, s.x, s.date_grain) for s in out] == [("pie", "segment", "month")] and sent[0][0] == "https://x.test/v1/chat/completions"
    for bad in ("no json", '{"charts": []}', '{"charts": 3}'):
        with pytest.raises(advisor.AdvisorError):
            advisor.validated(bad, found)
    with pytest.raises(advisor.AdvisorError):
        advisor.check_endpoint("http://x.test", "m")
    advisor.check_endpoint("http://localhost:1", "m")


def test_examples_and_dates_behind_the_head(spark):
    n = F.col("id")
    df = spark.range(3000).select(
        F.when(n >= 2000, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 300).cast("int")), "yyyy-MM-dd")).alias("day"), F.when(n < 1500, F.lit("a")).otherwise(F.concat(F.lit("b"), n % 4)).alias("k")
    )
    stats = TableStats(from_frame(df.coalesce(1)))
    assert stats.columns["day"].examples == ["2024-07-19", "2024-07-20", "2024-07-21"] and stats.columns["day"].parse_rate == 1.0
    assert stats.columns["k"].examples == ["a", "b0", "b1"] and stats.columns["k"].distinct == 5
