"""Sinks: cleaned flow tables, logs, summaries, training examples, label maps, and flow CSV fixtures.

All writers are DataFrame writers (distributed, one file set per task);
nothing is gathered on the driver except the ≤ 15-row label maps.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsieve import schemas


def write_clean(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Cleaned flow rows, one folder per source file (partition pruning on ``source_file``)."""
    w = df.write.mode("overwrite").partitionBy("source_file")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def three_decimals(df: DataFrame) -> DataFrame:
    """Floating columns as text of 3 decimals, as the results CSVs show them."""
    return df.select(*[F.format_string("%.3f", F.col(f.name)).alias(f.name) if f.dataType.simpleString() in ("double", "float")
                       else F.col(f.name) for f in df.schema.fields])


def append_log(df: DataFrame, path: str, run_id: str, fmt: str = "csv") -> None:
    """Add the rows of a run (or micro-batch) to a log; replaying a run replaces its rows.

    The rows go to a folder of this attempt alone; when all parts are there, the manifest entry of the run is renamed into
    place and names the attempt. Readers see the rows of the attempts that the manifest names, so a run that
    dies half way adds nothing, and one that is repeated adds its rows once.
    """
    spark = df.sparkSession
    attempt = uuid.uuid4().hex
    w = df.write.mode("errorifexists")
    out = f"{path.rstrip('/')}/run_id={run_id}/attempt={attempt}"
    w.option("header", True).option("quoteAll", True).csv(out) if fmt == "csv" else w.parquet(out)
    manifest = f"{path.rstrip('/')}/_manifest"
    write_text_file(spark, f"{manifest}/.{run_id}.{attempt}", attempt)
    fs, Path = hadoop_fs(spark, manifest)
    entry = Path(f"{manifest}/{run_id}")
    if fs.exists(entry):
        fs.delete(entry, False)
    fs.rename(Path(f"{manifest}/.{run_id}.{attempt}"), entry)


def read_log(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """The committed rows of a log with their ``run_id``; a log without runs has none."""
    manifest = f"{path.rstrip('/')}/_manifest"
    fs, Path = hadoop_fs(spark, manifest)
    entries = [] if not fs.exists(Path(manifest)) else [
        s.getPath() for s in fs.listStatus(Path(manifest)) if not s.getPath().getName().startswith(".")]
    runs = spark.read.text([e.toString() for e in entries]).select(
        F.col("_metadata.file_name").alias("run_id"), "value").collect() if entries else []
    if not runs:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("run_id", T.StringType())]))
    reader = spark.read.schema(schema).option("basePath", path)
    paths = [f"{path.rstrip('/')}/run_id={r.run_id}/attempt={r.value}" for r in runs]
    df = reader.option("header", True).option("multiLine", True).csv(paths) if fmt == "csv" else reader.parquet(*paths)
    return df.select(*schema.names, F.col("run_id").cast("string").alias("run_id"))


def write_csv_3dp(df: DataFrame, path: str) -> None:
    """Results CSV with floating columns printed to 3 decimals."""
    three_decimals(df).write.mode("overwrite").option("header", True).csv(path)


def write_examples(df: DataFrame, path: str) -> None:
    """Training examples as JSON Lines with the nested ``input`` / ``output`` layout."""
    df.write.mode("overwrite").json(path)


def read_examples(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Training examples from JSON Lines, or from one JSON array per file with ``multiline=True``."""
    return spark.read.schema(schemas.EXAMPLE).option("multiLine", multiline).json(path)


def write_label_maps(dim: DataFrame, path: str) -> None:
    """Label maps as JSON text: ``{"classes": [...]}`` (sorted names) and ``{name: id}`` per mapping.

    ``dim`` has (mapping, id, name); each map has at most a few dozen rows.
    """
    maps = dim.groupBy("mapping").agg(
        F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("id", "name"))),
                                       lambda s: s["name"]).alias("classes"))).alias("classes_json"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "id"))))).alias("mapping_json"))
    maps.select(F.concat_ws("\t", "mapping", "classes_json", "mapping_json").alias("value")) \
        .write.mode("overwrite").text(path)


def hadoop_fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def write_named_text(df: DataFrame, folder: str, name: str) -> None:
    """Write the one column of ``df``, in its order, as the lines of the file ``folder/name`` (fixture helper)."""
    tmp = f"{folder.rstrip('/')}_parts/{name}"
    df.write.mode("overwrite").text(tmp)
    _rename_part(df.sparkSession, tmp, folder, name)


def _rename_part(spark: SparkSession, tmp: str, folder: str, name: str) -> None:
    fs, Path = hadoop_fs(spark, folder)
    fs.mkdirs(Path(folder))
    parts = [s.getPath() for s in fs.listStatus(Path(tmp)) if s.getPath().getName().startswith("part-")]
    fs.rename(parts[0], Path(f"{folder}/{name}"))


def write_named_csv(df: DataFrame, folder: str, name: str) -> None:
    """Write ``df`` as a single CSV file ``folder/name`` (fixture helper for small per-file tables)."""
    tmp = f"{folder.rstrip('/')}_parts/{name}"
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(tmp)
    _rename_part(df.sparkSession, tmp, folder, name)


def write_text_file(spark: SparkSession, path: str, text: str) -> None:
    fs, Path = hadoop_fs(spark, path)
    out = fs.create(Path(path), True)
    out.write(bytearray(text.encode()))
    out.close()
