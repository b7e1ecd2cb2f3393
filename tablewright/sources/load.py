"""Loading by file type."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tablewright.dataset import Dataset, Limits, LoadError, read_parquet
from tablewright.sources.csv import read_csv
from tablewright.sources.xlsx import read_xlsx


def load(spark: SparkSession, path: str, limits: Limits | None = None) -> Dataset:
    """A file as a dataset; every failure is a LoadError."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if kind == "csv":
        return read_csv(spark, path, limits)
    if kind == "xlsx":
        return read_xlsx(spark, path, limits)
    if kind == "parquet":
        return read_parquet(spark, path)
    if kind == "xls":
        return read_xls(spark, path, limits)
    raise LoadError(f"unsupported file type {kind!r}; use csv, xlsx, xls or parquet")


def read_xls(spark: SparkSession, path: str, limits: Limits | None = None) -> Dataset:
    """Old binary workbooks, where the optional reader is installed."""
    try:
        import xlrd
    except ImportError as error:
        raise LoadError("the reader for .xls files is not installed; save the file as .xlsx") from error
    content = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    sheet = xlrd.open_workbook(file_contents=content).sheet_by_index(0)
    rows = [[v if v != "" else None for v in sheet.row_values(i)] for i in range(sheet.nrows)]
    return _from_rows(spark, rows, path, limits)


def _from_rows(spark: SparkSession, rows: list[list], path: str, limits: Limits | None) -> Dataset:
    from pyspark.sql import types as T

    from tablewright.dataset import check_names, from_frame
    from tablewright.sources.xlsx import _kind, _value

    if len(rows) < 2:
        raise LoadError("the table has no data rows")
    header = check_names(rows[0])
    kinds = [_kind([r[i] for r in rows[1:]]) for i in range(len(header))]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(header, kinds, strict=True)])
    return from_frame(spark.createDataFrame([tuple(_value(v, k) for v, k in zip(r, kinds, strict=True)) for r in rows[1:]], schema), path.rsplit("/", 1)[-1], limits or Limits())
