"""Headline queries, timed once each after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tablewright.dataset import from_frame
from tablewright.operators import cards, cleaning, profile, roles
from tablewright.operators.stats import TableStats
from tablewright.plans import catalog
from tablewright.session import get_session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "flagship", "flt_contains", "agg_median", "topk_mean", "prf_numeric_summary", "prf_columns", "prf_duplicates", "cln_dedup", "cln_merge_labels", "cln_replay", "cht_box",
    "cht_histogram", "cht_time_mean_month", "cht_cumulative", "cht_category_median", "crd_pie_other", "crd_distribution", "crd_filters_all", "sql_self_join", "sql_window",
)


def synthetic(spark, rows: int = 100_000):
    """The reference workload's table: seven columns by rule, some values missing."""
    from pyspark.sql import functions as F

    i = F.col("id")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (i % n + 1).cast("int"))
    return spark.range(rows).select(
        (i + 1).alias("customer_id"), pick(["Consumer", "Enterprise", "Small Business"], 3).alias("segment"), pick(["North", "South", "East", "West"], 4).alias("region"),
        F.when(i % 101 != 0, (500 + i % 2500).cast("double")).alias("monthly_revenue"), (i % 10 + 1).cast("double").alias("satisfaction"),
        (F.lit("2022-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=i.cast("int"))).alias("signup_date"), F.when(i % 5 == 0, F.lit("Paused")).otherwise(F.lit(" Active ")).alias("status"),
    )


def end_to_end(spark) -> int:
    """Profile, cleaning suggestions, starter dashboard and its cards, as the reference times them."""
    data = from_frame(synthetic(spark).persist())
    stats = TableStats(data).gather("texts")
    profile.profile(data, stats)
    found = cleaning.suggest_actions(data, stats)
    config = cards.default_config(data, roles.infer_roles(data, stats))
    cards.build_all(data.frame, config.cards, lambda result: result.audit.collect())
    data.frame.unpersist()
    return len(found)


def main() -> None:
    spark = get_session(f"local[{CPUS}]", **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["flagship"](spark, SF).collect()  # starts the engine
    times = {}
    for name in HEADLINE:
        begun = time.perf_counter()
        queries[name](spark, SF).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begun, 3)
    end_to_end(spark)
    begun = time.perf_counter()
    end_to_end(spark)
    times["end_to_end_100k"] = round(time.perf_counter() - begun, 3)
    print(json.dumps({"metric": "headline_queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF.rsplit("sf", 1)[-1], "rows_per_s_100k": round(100_000 / times["end_to_end_100k"])}))


if __name__ == "__main__":
    main()
