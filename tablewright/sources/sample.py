"""A small table to try the workbench with, made by rule: a missing number, a padded label, a repeated row."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tablewright.dataset import Dataset, from_frame


def sample(spark: SparkSession) -> Dataset:
    """Seven customers' rows, the last one like the first."""
    segments = ("Retail", "Wholesale", " Retail")
    rows = [(1 + i, segments[i % 3], None if i == 4 else 120.0 + 35.5 * i, 6.0 + i / 2, f"2025-0{1 + i % 4}-1{i}") for i in range(6)]
    schema = "customer_id long, segment string, monthly_spend double, satisfaction_score double, last_contact string"
    return from_frame(spark.createDataFrame([*rows, rows[0]], schema).coalesce(1), "sample")
