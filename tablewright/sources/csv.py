"""Delimited text: delimiter and header are settled on the driver from a head of the file, encoding and quoted line breaks by Spark
over all of it; rows are read by Spark as text and typed by one aggregate over all columns.

A quote opens a text only where a field begins, as in ``5" wide`` it doesn't. Where no line ends inside such a text, the file is read
in as many tasks as it has splits; else lines belong together and one task reads them.
"""

from __future__ import annotations

import csv as stdcsv
import io
import re
from functools import reduce
from operator import or_

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.dataset import Dataset, Limits, LoadError, check_names, from_frame
from tablewright.functions.exprs import col

HEAD_BYTES, SNIFF_CHARS, NUL_BYTES = 1 << 20, 65_536, 8_192
DELIMITERS = ",;\t|"
# Texts that mean a missing value in delimited files.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
INTEGER = r"^\s*[+-]?\d{1,18}\s*$"
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"
BOOLEAN = r"^(True|TRUE|true|False|FALSE|false)$"
BROKEN = "__broken"


def head_of(spark: SparkSession, path: str, size: int = HEAD_BYTES) -> tuple[bytes, int]:
    """The first bytes of a file and its length, through Spark's file systems."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    length = fs.getFileStatus(where).getLen()
    stream = fs.open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, min(size, length)))), length
    finally:
        stream.close()


def decode(head: bytes, whole: bool) -> tuple[str, str]:
    """Text and encoding: UTF-8 with or without a mark, else Latin-1."""
    if b"\0" in head[:NUL_BYTES]:
        raise LoadError("the file looks binary or is UTF-16; save it as UTF-8 text")
    for encoding in ("utf-8-sig", "utf-8", "latin-1"):
        try:
            return head.decode(encoding), encoding
        except UnicodeDecodeError as error:
            if not whole and error.start > len(head) - 4 and "end of data" in error.reason:  # cut inside a character
                return head[: error.start].decode(encoding), encoding
    raise LoadError("the text's encoding is unknown")


def all_utf8(spark: SparkSession, path: str) -> bool:
    """Whether every line of the file is valid UTF-8."""
    return spark.read.text(path).filter(~F.is_valid_utf8("value")).isEmpty()


def quoting(spark: SparkSession, path: str, delimiter: str, encoding: str) -> str:
    """"line" where quotes are closed in the line that opens them, "lines" where some go on, "open" where the last one is never closed.

    A line leads from outside a quoted text to inside or outside, and likewise from inside. Lines without quotes change
    nothing; of the others both ways are found by patterns, and composed in order only if some line leads inside.
    """
    mark = re.escape(delimiter)
    text = F.decode(F.col("value").cast("binary"), "ISO-8859-1") if encoding == "latin-1" else F.col("value")
    rest = rf'(?:[^"{mark}][^{mark}]*)?'  # of a field without quotes, or behind a closing one
    fields = rf'^(?:(?:"(?:[^"]|"")*"(?!"){rest}|{rest}){mark})*+'
    opened = r'^"(?:[^"]|"")*+$'  # a last field whose quote is not closed
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), text.alias("value")).filter(F.contains("value", F.lit('"')))
    ends = lambda line: F.regexp_replace(line, fields, "").rlike(opened)
    closed = F.regexp_replace("value", r'^(?:[^"]|"")*+"(?!")', "")
    ways = lines.select("at", ends(F.col("value")).alias("out"), (~F.col("value").rlike(r'^(?:[^"]|"")*+"(?!")') | ends(F.concat(F.lit("x"), closed))).alias("in"))
    if ways.filter("out").isEmpty():
        return "line"
    inside = False
    for way in ways.orderBy("at").toLocalIterator():  # such a file is read by one task anyway
        inside = way["in"] if inside else way["out"]
    return "open" if inside else "lines"


def decode_latin(head: bytes) -> str:
    """The head as Latin-1, without a byte order mark."""
    return head.removeprefix(b"\xef\xbb\xbf").decode("latin-1")


def find_delimiter(text: str) -> str:
    """The delimiter of the first lines; a comma where none occurs."""
    first = next((line for line in text.splitlines() if line.strip()), "")
    candidates = [d for d in DELIMITERS if d in first]
    if not candidates:
        return ","
    try:
        return stdcsv.Sniffer().sniff(text[:SNIFF_CHARS], "".join(candidates)).delimiter
    except stdcsv.Error:
        return candidates[0]


def find_header(text: str, delimiter: str) -> list[str]:
    """The names in the first row that isn't empty."""
    try:
        for row in stdcsv.reader(io.StringIO(text), delimiter=delimiter):
            if row and any(x.strip() for x in row) or len(row) > 1:
                return check_names(row)
    except stdcsv.Error as error:
        raise LoadError("the file could not be parsed") from error
    raise LoadError("the file has no header")


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns as long, double or Boolean where every value fits; one aggregate decides for all columns."""
    names = df.columns
    plain = df.select(*(F.when(~col(n).isin(*NA_TOKENS), col(n)).alias(n) for n in names))
    aggs = []
    for i, n in enumerate(names):
        c = col(n)
        aggs += [F.count(c).alias(f"n{i}"), F.bool_and(c.rlike(INTEGER)).alias(f"i{i}"), F.bool_and(c.rlike(NUMBER)).alias(f"d{i}"), F.bool_and(c.rlike(BOOLEAN)).alias(f"b{i}"), F.count(F.lit(1)).alias(f"r{i}")]
    row = plain.agg(*aggs).first().asDict()
    out = []
    for i, n in enumerate(names):
        c = col(n)
        if not row[f"n{i}"]:
            out.append(c.cast("double").alias(n) if row[f"r{i}"] else c)
        elif row[f"b{i}"]:
            out.append((F.lower(c) == "true").alias(n))
        elif row[f"i{i}"]:
            kind = "long" if row[f"n{i}"] == row[f"r{i}"] else "double"  # whole numbers with gaps are doubles
            out.append(F.trim(c).try_cast(kind).alias(n))
        elif row[f"d{i}"]:
            out.append(F.trim(c).try_cast("double").alias(n))
        else:
            out.append(c)
    return plain.select(*out)


def read_csv(spark: SparkSession, path: str, limits: Limits | None = None, name: str | None = None) -> Dataset:
    """A delimited file as a dataset. Short rows are padded; a row that is too long or a quote left open is an error."""
    limits = limits or Limits()
    try:
        head, length = head_of(spark, path)
    except Exception as error:  # noqa: BLE001  Hadoop's errors come as Py4J errors of many kinds
        raise LoadError(f"the file can't be read: {path}") from error
    if not length:
        raise LoadError("the file is empty")
    if limits.max_upload_bytes is not None and length > limits.max_upload_bytes:
        raise LoadError(f"the file has more than the per-file limit of {limits.max_upload_bytes} bytes")
    text, encoding = decode(head, length == len(head))
    delimiter = find_delimiter(text)
    header = find_header(text, delimiter)
    if limits.max_columns is not None and len(header) > limits.max_columns:
        raise LoadError(f"the file has more than {limits.max_columns} columns")
    if encoding != "latin-1" and length > len(head) and not all_utf8(spark, path):
        encoding = "latin-1"
        header = find_header(decode_latin(head), delimiter)
    quotes = quoting(spark, path, delimiter, encoding)
    if quotes == "open":
        raise LoadError("the file could not be parsed: a quote is left open")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))] + [T.StructField(BROKEN, T.StringType())])
    options = {"header": True, "multiLine": quotes == "lines", "escape": '"', "sep": delimiter, "encoding": "ISO-8859-1" if encoding == "latin-1" else "UTF-8", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN, "enforceSchema": True}
    raw = spark.read.schema(schema).options(**options).csv(path)
    fields = [F.col(f"c{i}") for i in range(len(header))]
    held = raw.filter(reduce(or_, (f.isNotNull() for f in fields)) | F.col(BROKEN).isNotNull())
    # Spark marks short and long rows alike; only a long one has as many delimiters as the header has names.
    unquoted = F.regexp_replace(BROKEN, r'"(?:[^"]|"")*"', "")
    longer = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(delimiter), F.lit(""))) >= len(header)
    try:
        if held.filter(F.col(BROKEN).isNotNull() & longer).limit(1).count():
            raise LoadError("the file could not be parsed: a row has more fields than the header")
        named = held.select(*(f.alias(n) for f, n in zip(fields, header, strict=True)))
        return from_frame(infer_types(named), name or path.rsplit("/", 1)[-1], limits)
    except PySparkException as error:
        raise LoadError("the file could not be parsed") from error
