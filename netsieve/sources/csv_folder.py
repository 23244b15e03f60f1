"""Flow CSV folders: header discovery, per-header-group reads, union by name, typed columns, per-file outcomes.

Spark's CSV reader maps columns by position over all files of one read, but
flow files differ in their headers. So the header line of every ``*.csv``
file (not recursive) is read on its own, straight from the file system (a few kilobytes a
file, many files at a time, no Spark job), files are grouped by identical header, each group is read with an all-string schema,
and the groups are combined with ``unionByName(allowMissingColumns=True)``.
Only file-level metadata (one header per file) reaches the driver.
A file whose header cannot be read, or with rows of more fields than its header, is skipped with its
reason, as the original does; ``ingest_report`` tells every file's outcome.
Values are then cast with ``try_cast`` — bad numbers and ``inf``/``Infinity``
spellings never raise; day-first times are parsed with ``try_to_timestamp``.
"""

from __future__ import annotations

import csv

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsieve import schemas
from netsieve.functions import domains as D

# Columns kept as text; every other flow column is numeric (double).
TEXT_COLUMNS = {"label", "timestamp", "flow_id", "src_ip", "dst_ip", "source_file"}


def _first_line(spark: SparkSession, path: str) -> tuple[str | None, str | None]:
    """(first line, error) of one file: at most its first buffers are read, decompressed by its suffix."""
    from netsieve.sources.sinks import hadoop_fs

    jvm = spark._jvm
    try:
        fs, Path = hadoop_fs(spark, path)
        stream = fs.open(Path(path))
        try:
            codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(Path(path))
            if codec is not None:
                stream = codec.createInputStream(stream)
            line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
        finally:
            stream.close()
    except Py4JJavaError as e:
        reason = e.java_exception
        return None, f"{reason.getClass().getSimpleName()}: {reason.getMessage()}"
    return (None if line is None else line.removeprefix("\ufeff")), None


def csv_headers(spark: SparkSession, folder: str, parallel: int = 32) -> DataFrame:
    """(path, file_name, header, error) for each ``*.csv`` file directly in ``folder`` that is not empty; the header is null
    where it could not be read.

    Only the start of each file is read, ``parallel`` files at a time, so finding the headers costs
    a few kilobytes per file and no Spark job, however many and large the files are.
    """
    from concurrent.futures import ThreadPoolExecutor

    files = [(p, n) for p, n, size in _listing(spark, folder) if n.endswith(".csv") and size > 0]
    with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(files)))) as pool:
        heads = list(pool.map(lambda f: _first_line(spark, f[0]), files))
    rows = [(p, n, h, e) for (p, n), (h, e) in zip(files, heads)]
    return spark.createDataFrame(rows, "path string, file_name string, header string, error string")


def header_columns(header: str) -> list[str]:
    """Column names of a header line; quoted names may hold commas."""
    return [h.strip().strip('"') for h in next(csv.reader([header]), [])]


def _frames(spark: SparkSession, heads: list) -> list[DataFrame]:
    """One all-string frame per header among (path, header) rows, with ``source_file`` and ``_extra``: whether a row has more
    fields than the header."""
    groups: dict[str, list[str]] = {}
    for r in heads:
        groups.setdefault(r["header"], []).append(r["path"])
    frames = []
    for header, paths in sorted(groups.items()):
        names = header_columns(header)
        schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names) + 1)])
        df = spark.read.option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").schema(schema).csv(paths)
        frames.append(df.select(*[F.col(f"_c{i}").alias(schemas.column_name(n)) for i, n in enumerate(names)],
                                F.col("_metadata.file_name").alias("source_file"),
                                F.col(f"_c{len(names)}").isNotNull().alias("_extra")))
    return frames


def read_groups(spark: SparkSession, folder: str, required: list[str] | None = None, heads: DataFrame | None = None) -> DataFrame:
    """All rows of all CSV files (optionally only files carrying the ``required`` headers), all strings,
    snake-case column names, ``source_file`` from the file name; header groups unioned by name.

    Rows of more fields than their header lose the fields beyond it; ``ingest`` leaves out the files that have such rows.
    """
    heads = csv_headers(spark, folder) if heads is None else heads
    heads = heads.where("header is not null")
    if required is not None:
        heads = schema_report(heads, required).where("ok")
    frames = [f.drop("_extra") for f in _frames(spark, heads.select("path", "header").collect())]
    if not frames:
        return spark.createDataFrame([], "source_file string, label string")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def typed(df: DataFrame) -> DataFrame:
    """try_cast every metric column to double (unparsable -> null; inf spellings -> +-inf)."""
    return df.select(*[F.col(c) if c in TEXT_COLUMNS else F.col(c).try_cast("double").alias(c) for c in df.columns])


def scan_flows(spark: SparkSession, folder: str, required: list[str] | None = None) -> DataFrame:
    return typed(read_groups(spark, folder, required))


def schema_report(heads: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Per file: the required columns it lacks and whether it is usable."""
    want = required or D.REQUIRED_COLUMNS
    rows = [(r.path, r.file_name, r.header, [c for c in want if c not in header_columns(r.header or "")]) for r in heads.collect()]
    out = heads.sparkSession.createDataFrame(rows, "path string, file_name string, header string, missing_columns array<string>")
    return out.withColumn("ok", F.col("header").isNotNull() & (F.size("missing_columns") == 0))


def _listing(spark: SparkSession, folder: str) -> list[tuple[str, str, int]]:
    """(path, name, length) of every plain file directly in ``folder`` — file-system metadata, as the
    driver lists it for any file scan."""
    from netsieve.sources.sinks import hadoop_fs

    fs, Path = hadoop_fs(spark, folder)
    return [(st.getPath().toString(), st.getPath().getName(), int(st.getLen())) for st in fs.listStatus(Path(folder))
            if st.isFile() and not st.getPath().getName().startswith((".", "_"))]


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, length) of every plain file directly in ``folder``; zero-length files included
    (scans skip them)."""
    return spark.createDataFrame([(n, size) for _, n, size in _listing(spark, folder)],
                                 "file_name string, length long")


def ingest_report(spark: SparkSession, folder: str, required: list[str] | None = None) -> DataFrame:
    """Every file of the folder with its status — processed, or skipped: not a CSV file, empty, its header could not be read,
    columns missing, rows of more fields than the header — and the number of data rows in it.

    One Spark job reads the data of all usable files, whatever their number.
    """
    heads = csv_headers(spark, folder).persist()
    checked = schema_report(heads, required)
    usable = _frames(spark, checked.where("ok").select("path", "header").collect())
    counts = [f.select(F.col("source_file").alias("file_name"), "_extra") for f in usable]
    rows = spark.createDataFrame([], "file_name string, _extra boolean")
    for c in counts:
        rows = rows.unionByName(c)
    rows = rows.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("_extra").alias("n_extra"))
    j = (list_files(spark, folder).join(checked.drop("path", "header"), "file_name", "left")
         .join(heads.select("file_name", "error", F.col("header").isNotNull().alias("has_header")), "file_name", "left")
         .join(rows, "file_name", "left"))
    status = (F.when(~F.col("file_name").endswith(".csv"), F.lit("skipped: not a CSV file"))
               .when(F.col("error").isNotNull(), F.concat(F.lit("skipped: "), F.col("error")))
               .when(~F.coalesce("has_header", F.lit(False)), F.lit("skipped: empty file"))
               .when(~F.col("ok"), F.concat(F.lit("skipped: missing columns "),
                                            F.array_join("missing_columns", ", ")))
               .when(F.col("n_extra") > 0, F.concat(F.lit("skipped: "), F.col("n_extra").cast("string"),
                                                    F.lit(" rows with more fields than the header")))
               .otherwise(F.lit("processed")))
    return j.select("file_name", "length", status.alias("status"),
                    F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))


def ingest(spark: SparkSession, folder: str, required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(typed rows of the files that the report calls processed, the report): one pass over the data for the report (computed here,
    one row per file) and one for the rows."""
    report = ingest_report(spark, folder, required or D.REQUIRED_COLUMNS)
    outcome = report.collect()
    report = spark.createDataFrame(outcome, report.schema)
    good = [r.file_name for r in outcome if r.status == "processed"]
    heads = csv_headers(spark, folder)
    heads = heads.join(spark.createDataFrame([(n,) for n in good], "file_name string"), "file_name", "left_semi")
    return typed(read_groups(spark, folder, None, heads)), report
