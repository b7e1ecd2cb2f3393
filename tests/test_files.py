"""Files in and out: accepted and refused inputs, SQL review, exports."""

from __future__ import annotations

import datetime as dt
import http.server
import json
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from tablewright.dataset import LoadError, Limits, from_frame
from tablewright.operators import cards, charts, cleaning, profile, roles
from tablewright.operators.charts import chart_spec
from tablewright.operators.query import QuerySpec, run_query
from tablewright.operators.stats import TableStats
from tablewright.plans import sqlguard
from tablewright.sinks import files, records
from tablewright.sources import csv as csv_source
from tablewright.sources.load import load
from tablewright.sources.sample import sample
from tablewright.streaming import follow


def workbook(path, rows, extra_parts=0, types=True):
    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, dt.datetime):
            return f'<c r="{ref}" s="1"><v>{(v - dt.datetime(1899, 12, 30)).total_seconds() / 86400}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'

    space = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    body = "".join(f'<row r="{i}">' + "".join(cell(f"{chr(65 + j)}{i}", v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        if types:
            z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{space}" xmlns:r="{link}"><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="worksheets/b.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{space}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/a.xml", f'<worksheet xmlns="{space}"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/worksheets/b.xml", f'<worksheet xmlns="{space}"><sheetData/></worksheet>')
        for i in range(extra_parts):
            z.writestr(f"x{i}", "x" * 50)


CASES = {
    "standard": (b"customer_id,segment,region,revenue,order_date,status\nC1,A,North,10.5,2025-01-01,Active\nC2,A,South,,2025-01-02, Paused \nC3,B,North,3,2025-02-01,Active\nC4,B,East,7,2025-02-03,Active\n", 4, {"revenue": "double", "order_date": "string", "customer_id": "string"}),
    "international": ("﻿record_id;category;amount;event_date\nä1;Café;1.5;2025-01-01\nä2;Thé;2.5;2025-01-02\nä3;Thé;3.5;2025-01-03\n".encode(), 3, {"amount": "double", "category": "string", "record_id": "string"}),
    "multiline": (b'case_id,category,amount,notes\nA,"x, y",1.5,"two\nlines"\nB,z,2.5,"say ""hi"""\n', 2, {"amount": "double", "notes": "string"}),
    "single": (b'status\n"a, b"\nc\nd\n', 3, {"status": "string"}),
    "pipe": (b"row_id|segment|score|comment\n1|a|1.5|x\n2|b||\n3|a|2|y\n4|c|3|z\n", 4, {"row_id": "bigint", "score": "double", "comment": "string"}),
    "latin": ("name,n\nCafé,1\n".encode("latin-1"), 1, {"name": "string", "n": "bigint"}),
    "typed": (b"code,flag,na,gaps,text\n001,True,NA,1,1\n002,FALSE,NA,,null\n\n003,true,NA,3,\"1,000\"\n", 3, {"code": "bigint", "flag": "boolean", "na": "double", "gaps": "double", "text": "string"}),
    "inch": (b'size,n\n5" wide,1\n"6"" tall",2\n', 2, {"size": "string", "n": "bigint"}),
    "short": (b"a,b,c\n1,2\n3,4,5\n", 2, {"a": "bigint", "c": "double"}),
}


@pytest.mark.parametrize("case", CASES)
def test_accepted_files(spark, tmp_path, case):
    content, rows, types = CASES[case]
    path = tmp_path / "t.CSV"
    path.write_bytes(content)
    data = load(spark, str(path))
    assert data.visible.count() == rows and types.items() <= dict(data.visible.dtypes).items()
    stats = TableStats(data)
    profile.profile(data, stats)
    actions = cleaning.suggest_actions(data, stats)
    dropped = {a.column for a in actions if a.kind == "drop_column"}
    cleaning.apply_actions(data, [a for a in actions if a.kind == "drop_column" or a.column not in dropped]).visible.collect()
    config = cards.default_config(data, roles.infer_roles(data, stats))
    assert "<article>" in files.html_dashboard(data, config)
    assert run_query(data.visible, QuerySpec()).count() == rows
    assert sqlguard.analyze(data.visible, "SELECT COUNT(*) AS n FROM uploaded_data").score == 100
    if case == "multiline":
        assert [r["notes"] for r in data.visible.collect()] == ["two\nlines", 'say "hi"']
    if case == "latin":
        assert data.visible.first()["name"] == "Café"


def test_bytes_behind_the_head_decide_too(spark, tmp_path):
    """Latin-1 letters behind two megabytes, and a large file without quoted line breaks in several tasks."""
    path = tmp_path / "late.csv"
    path.write_bytes(b"name,n\n" + b"".join(b"plain text %07d,%d\n" % (i, i) for i in range(120_000)) + "Café,7\n".encode("latin-1"))
    data = load(spark, str(path))
    assert data.visible.filter("n = 7 AND name LIKE 'Caf%'").collect()[0]["name"] == "Café" and data.visible.count() == 120_001
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        data = load(spark, str(path))
        assert data.frame.rdd.getNumPartitions() > 2 and [r["n"] for r in data.frame.orderBy("__row_key").limit(3).collect()] == [0, 1, 2]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize(("text", "kind"), [
    ('a,b\n1,2\n', "line"), ('a,b\n"x, y",5" wide\n', "line"), ('a,b\n"x\ny",2\n', "lines"), ('a,b\n1,"2\n', "open"), ('a\n"he said ""hi"""\n"', "open"),
    ('a,b\n"x\n"",y",2\n"z",3\n', "lines"), ('a,b\n"x\ny","z\n', "open"), ('a;b\nx "q;2\n', "line"),
])
def test_quoting(spark, tmp_path, text, kind):
    path = tmp_path / "q.csv"
    path.write_text(text)
    assert csv_source.quoting(spark, str(path), ";" if ";" in text else ",", "utf-8") == kind


REFUSED = {
    "type.txt": (b"a,b\n1,2\n", "unsupported", Limits()), "empty.csv": (b"", "empty", Limits()), "header.csv": (b"a,b\n", "no data rows", Limits()), "binary.csv": (b"a,\0b\n1,2\n", "binary", Limits()),
    "quote.csv": (b'a,b\n1,"2\n', "parsed", Limits()), "blank.csv": (b"name,,age\n1,2,3\n", "non-empty", Limits()), "twice.csv": (b"name,name\n1,2\n", "unique", Limits()), "long.csv": (b"a,b\n1,2,3\n4,5,6\n", "more fields", Limits()),
    "damaged.xlsx": (b"not a zip", "damaged", Limits()), "big.csv": (b"a,b\n1,2\n", "per-file limit", Limits(max_upload_bytes=4)), "rows.csv": (b"a\n1\n2\n", "1 rows", Limits(max_rows=1)), "wide.csv": (b"a,b\n1,2\n", "1 columns", Limits(max_columns=1)), "old.xls": (b"x", "xls", Limits()),
}


@pytest.mark.parametrize("name", REFUSED)
def test_refused_files(spark, tmp_path, name):
    content, message, limits = REFUSED[name]
    path = tmp_path / name
    path.write_bytes(content)
    with pytest.raises(LoadError, match=message):
        load(spark, str(path), limits)


def test_workbooks(spark, tmp_path):
    rows = [["order_id", "region", "quantity", "revenue", "order_date", "fulfilled"], ["O1", "N", 1, 1.5, dt.datetime(2025, 1, 1), True], ["O2", "S", 2, None, dt.datetime(2025, 1, 2, 12), False], ["O3", None, 3, 2.5, dt.datetime(2025, 1, 3), True]]
    path = str(tmp_path / "t.xlsx")
    workbook(path, rows)
    data = load(spark, path)
    assert dict(data.visible.dtypes) == {"order_id": "string", "region": "string", "quantity": "bigint", "revenue": "double", "order_date": "timestamp_ntz", "fulfilled": "boolean"}
    assert [tuple(r) for r in data.visible.collect()] == [tuple(r) for r in rows[1:]]
    workbook(path, rows, types=False)
    with pytest.raises(LoadError, match="damaged"):
        load(spark, path)
    workbook(path, rows, extra_parts=10)
    for limits in (Limits(max_archive_members=3), Limits(max_expanded_bytes=100)):
        with pytest.raises(LoadError):
            load(spark, path, limits)


# ---- Review ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (3, "b", 3.0), (4, "a", 4.0)], "customer_id long, segment string, revenue double")


RULES = {
    "explicit-columns": "SELECT * FROM uploaded_data LIMIT 1", "unbounded-detail": "SELECT segment FROM uploaded_data", "distinct-cost": "SELECT DISTINCT segment FROM uploaded_data",
    "unbounded-sort": "SELECT segment, COUNT(*) AS n FROM uploaded_data GROUP BY segment ORDER BY n", "ordinal-order": "SELECT segment FROM uploaded_data ORDER BY 1 LIMIT 3",
    "wide-projection": "SELECT " + ", ".join(f"revenue + {i} AS c{i}" for i in range(16)) + " FROM uploaded_data LIMIT 1", "leading-wildcard": "SELECT segment FROM uploaded_data WHERE segment LIKE '%a' LIMIT 1",
    "null-comparison": "SELECT segment FROM uploaded_data WHERE segment = NULL LIMIT 1", "not-in-subquery": "SELECT segment FROM uploaded_data WHERE customer_id NOT IN (SELECT customer_id FROM uploaded_data) LIMIT 1",
    "function-on-filter-column": "SELECT segment FROM uploaded_data WHERE lower(segment) = 'a' LIMIT 1", "many-or-branches": "SELECT segment FROM uploaded_data WHERE revenue = 1 OR revenue = 2 OR revenue = 3 OR revenue = 4 LIMIT 1",
    "cross-join": "SELECT a.segment FROM uploaded_data a CROSS JOIN uploaded_data b LIMIT 1", "join-without-condition": "SELECT a.segment FROM uploaded_data a JOIN uploaded_data b LIMIT 1",
    "repeated-upload-scan": "SELECT a.segment FROM uploaded_data a JOIN uploaded_data b ON a.customer_id = b.customer_id LIMIT 1", "union-deduplication": "SELECT segment FROM uploaded_data UNION SELECT segment FROM uploaded_data",
}


@pytest.mark.parametrize("rule", RULES)
def test_rules(spark, table, rule):
    assert rule in {f.rule for f in sqlguard.lint(table, sqlguard.parse(spark, RULES[rule]))}


def test_grouping_by_near_unique_keys(spark):
    df = spark.range(30).select(F.col("id").alias("unique_key"), F.lit(1).alias("value"))
    found = sqlguard.lint(df, sqlguard.parse(spark, "SELECT unique_key, SUM(value) AS v FROM uploaded_data GROUP BY unique_key LIMIT 5"))
    assert [f.rule for f in found] == ["high-cardinality-group-unique_key"]


def test_clean_query(table):
    out = sqlguard.analyze(table, "select segment, avg(revenue) as mean_revenue from uploaded_data where revenue >= 1 and segment is not null group by segment order by mean_revenue desc limit 10")
    assert out.score == 100 and out.findings == () and out.tables == ("uploaded_data",)
    assert [c for c, _ in out.clauses] == ["SELECT", "FROM", "WHERE", "GROUP BY", "ORDER BY", "LIMIT"]
    assert out.formatted.count("\n") == 5 and sqlguard.format_sql(out.formatted) == out.formatted
    assert "TakeOrderedAndProject" in {s.node for s in out.steps}


def test_review_texts(spark, table):
    sql = "WITH t AS (SELECT segment, revenue FROM uploaded_data WHERE segment IN (SELECT segment FROM uploaded_data)) SELECT segment, SUM(revenue) AS total FROM t WHERE revenue > 1 GROUP BY segment HAVING SUM(revenue) > 2 ORDER BY total DESC LIMIT 7"
    said = dict(sqlguard.explain_clauses(sqlguard.parse(spark, sql)))
    assert list(said) == ["WITH", "SELECT", "FROM", "WHERE", "GROUP BY", "HAVING", "ORDER BY", "LIMIT"]
    for clause, part in {"WITH": "t", "SELECT": "segment, total", "FROM": "uploaded_data", "WHERE": "revenue", "GROUP BY": "segment", "HAVING": "2", "ORDER BY": "total descending", "LIMIT": "7"}.items():
        assert part in said[clause], (clause, said[clause])
    pretty = sqlguard.format_sql(sql)
    assert "\n  FROM uploaded_data" in pretty and "\n    SELECT segment" in pretty and sqlguard.format_sql(pretty) == pretty
    assert sqlguard.format_sql("select 'a\n   b' as x from uploaded_data") == "SELECT 'a\n   b' as x\nFROM uploaded_data;"
    for name, text in RULES.items():
        for f in sqlguard.lint(table, sqlguard.parse(spark, text)):
            assert f.category in ("Readability", "Performance", "Correctness", "Maintainability") and f.detail and f.recommendation and "{" not in f.detail, name


@pytest.mark.parametrize(("sql", "suggested"), [
    ("SELECT * FROM uploaded_data", "SELECT `customer_id`, `segment`, `revenue`\nFROM uploaded_data;"),
    ("SELECT u.*, revenue * 2 AS d FROM uploaded_data u", "SELECT u.`customer_id`, u.`segment`, u.`revenue`, revenue * 2 AS d\nFROM uploaded_data u;"),
    ("SELECT 1 AS one, * FROM uploaded_data LIMIT 2", "SELECT 1 AS one, `customer_id`, `segment`, `revenue`\nFROM uploaded_data\nLIMIT 2;"),
    ("SELECT a.* FROM uploaded_data a JOIN uploaded_data b ON a.customer_id = b.customer_id", "SELECT a.*\nFROM uploaded_data a\nJOIN uploaded_data b ON a.customer_id = b.customer_id;"),
    ("SELECT count(*) AS n FROM uploaded_data", "SELECT count(*) AS n\nFROM uploaded_data;"),
])
def test_stars_are_written_out(table, sql, suggested):
    assert sqlguard.analyze(table, sql).suggested == suggested


def test_syntax_errors_have_a_place(table):
    with pytest.raises(sqlguard.SqlError, match=r"line 2, column \d+"):
        sqlguard.analyze(table, "SELECT segment,\n ( FROM uploaded_data")


def test_empty_result_is_seen(table):
    assert "LocalTableScan" in {s.node for s in sqlguard.analyze(table, "SELECT segment FROM uploaded_data WHERE segment = NULL").steps}


@pytest.mark.parametrize("sql", [
    "", "SELECT 1; SELECT 2", "DROP TABLE uploaded_data", "INSERT INTO uploaded_data SELECT 1", "CREATE TABLE x AS SELECT 1", "SELECT * FROM other", "SELECT * FROM a.b", "SELECT * FROM csv.`/etc/passwd`",
    "SELECT * FROM range(5)", "SELECT ? FROM uploaded_data", "SELECT :x FROM uploaded_data", "SET x = 1", "EXPLAIN SELECT 1", "SELECT FROM WHERE", "SELECT '" + "x" * 20_000 + "'", "WITH t AS (SELECT * FROM secret) SELECT * FROM t",
    "SELECT (SELECT MAX(a) FROM secret) FROM uploaded_data", "SHOW TABLES",
])
def test_guard(table, sql):
    with pytest.raises(sqlguard.SqlError):
        sqlguard.analyze(table, sql)


def test_semicolons_in_text_are_text(table):
    assert sqlguard.run_guarded(table, "SELECT ';' AS s, segment FROM uploaded_data; ").count() == 4


# ---- Exports ---------------------------------------------------------------------------------------------------------


@pytest.fixture()
def server():
    seen, answers = [], []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, dict(self.headers), body))
            self.send_response(answers.pop(0) if answers else 200)
            self.end_headers()

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen, answers
    s.shutdown()


def test_records(spark):
    df = spark.createDataFrame([(1, float("nan"), True, dt.datetime(2025, 1, 2, 3, 4, 5), None), (2, 1.5, False, dt.datetime(2025, 1, 2, 3, 4, 5, 250000), "x")], "count long, price double, active boolean, seen timestamp_ntz, note string")
    assert list(records.records(from_frame(df))) == [{"count": 1, "active": True, "seen": "2025-01-02T03:04:05"}, {"count": 2, "price": 1.5, "active": False, "seen": "2025-01-02T03:04:05.250000", "note": "x"}]
    with pytest.raises(records.ExportError):
        list(records.records(from_frame(df), 0))


def test_table_service(server):
    url, seen, answers = server
    items, naps = [{"n": i} for i in range(25)], []
    to = records.TableService("appABC123", "My table")
    report = records.push_service(items, to, "tok", api_url=url, sleep=naps.append)
    assert report.ok and [len(b["records"]) for _, _, b in seen] == [10, 10, 5] and seen[0][0] == "/appABC123/My%20table" and seen[0][1]["Authorization"] == "Bearer tok" and naps == [0.25, 0.25]
    answers += [200, 429, 200, 422]
    report = records.push_service(items, to, "tok", api_url=url, sleep=naps.append)
    assert (report.sent, len(report.failures), report.ok) == (20, 1, False) and 2.0 in naps
    answers += [401]
    with pytest.raises(records.ExportError):
        records.push_service(items, to, "tok", api_url=url, sleep=naps.append)
    with pytest.raises(records.ExportError):
        records.push_service(items, records.TableService("x", "t"), "tok", api_url=url)


def test_webhook(server):
    url, seen, answers = server
    items = [{"n": i} for i in range(12)]
    answers += [200, 500]
    report = records.push_webhook(items, records.Webhook(url, 5, "X-Key"), secret="s", name="p", sleep=lambda _: None)
    assert (report.sent, report.batches, len(report.failures)) == (7, 3, 1)
    assert seen[0][1]["X-Key"] == "s" and seen[2][2] | {"records": 0} == {"source": "tablewright", "pipeline": "p", "batch_index": 3, "batch_count": 3, "records": 0}
    for bad in (records.Webhook("http://far.test"), records.Webhook(url, 0), records.Webhook(url, 1001), records.Webhook(url, 5, "X-Key")):
        with pytest.raises(records.ExportError):
            records.push_webhook(items, bad)
    with pytest.raises(records.ExportError, match="reached"):
        records.push_webhook(items, records.Webhook("http://127.0.0.1:9"))


def test_export_configuration(spark, tmp_path, capsys):
    config = records.ExportConfig("p", records.Webhook("https://x.test", 5), 10)
    text = records.config_to_json(config)
    assert records.config_from_json(text) == config
    for spoil in ({"extra": 1}, {"version": 2}, {"name": ""}, {"row_limit": 0}, {"kind": "x"}, {"destination": {"odd": 1}}):
        with pytest.raises(records.ExportError):
            records.config_from_json(json.dumps({**json.loads(text), **spoil}))
    (tmp_path / "d.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "c.json").write_text(text)
    assert records.main([str(tmp_path / "d.csv"), str(tmp_path / "c.json"), "--dry-run"]) == 0
    assert json.loads(capsys.readouterr().out)["records"] == [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    assert records.main([str(tmp_path / "no.csv"), str(tmp_path / "c.json"), "--dry-run"]) == 1


def test_report_and_pages_escape(spark, tmp_path):
    data = from_frame(spark.createDataFrame([("<b>|", 1.0), ("x", 2.0), ("x", 3.0)], "name string, v double"))
    report = files.markdown_report("t", profile.profile(data))
    assert "Health score" in report and "\\|" in report
    page = files.html_dashboard(data, cards.Config("<i>", (cards.Card("a", "bar", "<script>", x="name"),)))
    assert "<script>alert" not in page and "<b>" not in page and "&lt;b&gt;" in page and "&lt;i&gt;" in page
    files.write_csv(data.visible, str(tmp_path / "out"), single=True)
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).count() == 3


def test_figures_per_kind(spark, tmp_path):
    data = sample(spark)
    df = data.frame
    made = {
        "rect": chart_spec("category_count", "t", charts.category_count(df, "segment")), "path": chart_spec("pie", "t", charts.pie(df, "segment")),
        "polyline": chart_spec("time_series", "t", charts.time_series(df, "last_contact", "monthly_spend")), "polygon": chart_spec("time_area", "t", charts.time_area(df, "last_contact", "monthly_spend")),
        "circle": chart_spec("scatter", "t", charts.scatter(df, "monthly_spend", "satisfaction_score")), "line": chart_spec("box", "t", charts.box(df, "monthly_spend", "segment")),
    }
    for mark, spec in made.items():
        assert f"<{mark} " in files.figure(spec) and "nan" not in files.figure(spec), mark
    assert files.figure(made["circle"]).count("<circle") == 6 and files.figure({**made["rect"], "values": []}) == ""
    files.write_text(spark, "SELECT 1;\n-- é", str(tmp_path / "q"))
    assert [r.value for r in spark.read.text(str(tmp_path / "q")).collect()] == ["SELECT 1;", "-- é"]
    assert profile.profile(data).duplicate_rows == 1


def test_streams(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.range(60).select(F.concat(F.lit(" a"), F.col("id") % 3).alias("k"), (F.lit("2025-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("id") * 5).cast("int"))).alias("t"))
    df.filter("k <> ' a2'").write.parquet(source)
    steps = [[cleaning.CleaningAction("trim_whitespace", "k")]]
    stream = lambda: follow.cleaned(follow.arriving(spark, source, "k string, t timestamp"), steps)
    follow.append(stream(), out, str(tmp_path / "c1")).awaitTermination()
    df.filter("k = ' a2'").write.mode("append").parquet(source)
    follow.append(stream(), out, str(tmp_path / "c1")).awaitTermination()
    assert sorted((r.k, r["count"]) for r in spark.read.parquet(out).groupBy("k").count().collect()) == [("a0", 20), ("a1", 20), ("a2", 20)]
    follow.append(follow.counts(stream(), "t", "k"), str(tmp_path / "n"), str(tmp_path / "c2")).awaitTermination()
    assert {r["count"] for r in spark.read.parquet(str(tmp_path / "n")).collect()} == {4}
    with pytest.raises(cleaning.CleaningError):
        follow.cleaned(stream(), [[cleaning.CleaningAction("drop_duplicates")]])


def test_same_result_with_other_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 7).cast("string").alias("k"), F.when(F.col("id") % 11 != 0, F.col("id").cast("double")).alias("v"))
    one, many = from_frame(df.coalesce(1)), from_frame(df.repartition(8))
    close = lambda data: [{k: round(v, 9) if isinstance(v, float) else v for k, v in c.items()} for c in profile.profile(data).numeric_summary]
    assert close(one) == close(many)
    assert [r.asDict() for r in cards.bar(one.frame, "k", "sum", "v").collect()] == [r.asDict() for r in cards.bar(many.frame, "k", "sum", "v").collect()]
