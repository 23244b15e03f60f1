"""Label cleaning, standardization and lookups (dimension joins).

Every dimension here is a fixed table of at most a few dozen rows, so the
broadcast is bounded by construction; the fact side never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsieve.functions import domains as D


_DIMS: dict = {}


def _dim(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small fixed table as a broadcast DataFrame (built once per session)."""
    key = (id(spark), spark.sparkContext.applicationId, schema, tuple(rows))
    if key not in _DIMS:
        _DIMS[key] = F.broadcast(spark.createDataFrame(rows, schema))
    return _DIMS[key]


def mapping_dim(spark: SparkSession) -> DataFrame:
    return _dim(spark, D.ATTACK_MAPPING, "_m_raw string, _m_std string")


def known_dim(spark: SparkSession) -> DataFrame:
    return _dim(spark, [(n,) for n in D.KNOWN_LABELS], "_known string")


def label_dim(spark: SparkSession) -> DataFrame:
    """All four label maps as one dimension: (mapping, id, name)."""
    rows = [(m, i, n) for m, pairs in D.LABEL_MAPS.items() for i, n in pairs]
    return _dim(spark, rows, "mapping string, id int, name string")


def clean_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Drop repeated header rows (label equals the word ``Label``) and null labels."""
    return df.where(~F.col(label).eqNullSafe("Label") & F.col(label).isNotNull())


def standardize_label(df: DataFrame, label: str = "label", out: str | None = None) -> DataFrame:
    """Raw spelling -> standardized name; an unmatched value keeps its own spelling."""
    out = out or label
    dim = mapping_dim(df.sparkSession)
    joined = df.join(dim, F.col(label) == dim["_m_raw"], "left")
    return joined.withColumn(out, F.coalesce(F.col("_m_std"), F.col(label))).drop("_m_raw", "_m_std")


def known_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Keep rows whose label is one of the 15 standardized names."""
    dim = known_dim(df.sparkSession)
    return df.join(dim, F.col(label) == dim["_known"], "left_semi")


def unknown_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Observed labels outside the known set, with the number of rows each removes."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_removed"))
    dim = known_dim(df.sparkSession)
    return counts.join(dim, F.col("label") == dim["_known"], "left_anti")


def missing_types(df: DataFrame, label: str = "label") -> DataFrame:
    """Known names never observed in the data."""
    dim = known_dim(df.sparkSession)
    seen = known_labels(df.select(F.col(label).alias("_seen")), "_seen").distinct()  # at most the known names
    return dim.join(F.broadcast(seen), dim["_known"] == seen["_seen"], "left_anti").select(
        F.col("_known").alias("label"))


def class_name(df: DataFrame, class_id: str, out: str = "class_name", mapping: str = "encoder") -> DataFrame:
    """Class id -> name with the chosen map (default: the saved encoder); miss -> ``Unknown``."""
    dim = label_dim(df.sparkSession).where(F.col("mapping") == mapping).select(
        F.col("id").alias("_cid"), F.col("name").alias("_cname"))
    joined = df.join(F.broadcast(dim), F.col(class_id) == F.col("_cid"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_cname"), F.lit("Unknown"))).drop("_cid", "_cname")


def alert_label_id(df: DataFrame, label: str, out: str = "alert_label_id") -> DataFrame:
    """Alert-model label -> id, miss -> 13."""
    dim = _dim(df.sparkSession, D.ALERT_MODEL_CLASSES, "_aname string, _aid int")
    joined = df.join(dim, F.col(label) == F.col("_aname"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_aid"), F.lit(D.ALERT_MODEL_UNKNOWN))).drop("_aname", "_aid")


def text_label_id(df: DataFrame, label: str, out: str = "text_label_id") -> DataFrame:
    """Text-model label -> evaluation id, case-insensitive, first match; miss (or null) -> 15."""
    rows = {}
    for i, n in D.TEXT_EVAL_CLASSES:
        rows.setdefault(n.lower(), i)
    dim = _dim(df.sparkSession, sorted(rows.items(), key=lambda r: r[1]), "_lname string, _tid int")
    joined = df.join(dim, F.lower(F.col(label)) == F.col("_lname"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_tid"), F.lit(D.TEXT_EVAL_UNKNOWN))).drop("_lname", "_tid")


def label_to_id(df: DataFrame, label: str = "label", out: str = "label_id") -> DataFrame:
    """Name -> evaluation id; rows whose name has no id are dropped (inner join)."""
    dim = _dim(df.sparkSession, [(n, i) for i, n in D.TEXT_EVAL_CLASSES], "_ename string, _eid int")
    return df.join(dim, F.col(label) == F.col("_ename"), "inner").withColumn(out, F.col("_eid")).drop("_ename", "_eid")


def binary_label(label: Column | str) -> Column:
    """0 for ``Benign``, else 1 — a null label counts as malicious."""
    c = F.col(label) if isinstance(label, str) else label
    return F.when(c.eqNullSafe("Benign"), F.lit(0)).otherwise(F.lit(1))


def encode_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Sorted distinct labels with id = position (alphabetical, as the encoder).

    The window runs over the distinct labels only — a domain of at most the
    known names — never over the fact rows.
    """
    from pyspark.sql import Window

    distinct = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return distinct.select(
        "label", "n", (F.row_number().over(Window.orderBy("label")) - 1).alias("label_id"))


def port_service(port: Column) -> Column:
    """Port -> service name (9 well-known ports), miss -> ``Unknown``."""
    m = F.create_map(*[x for p, s in D.COMMON_PORTS for x in (F.lit(p), F.lit(s))])
    return F.coalesce(F.try_element_at(m, port.cast("int")), F.lit("Unknown"))


def protocol_name(protocol: Column) -> Column:
    """1/6/17 -> ICMP/TCP/UDP, other numbers -> ``Protocol n``, unparsable -> ``Unknown Protocol``."""
    d = protocol.cast("string").try_cast("double")
    finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))
    n = F.when(finite, d.cast("long"))
    m = F.create_map(*[x for p, s in D.PROTOCOLS for x in (F.lit(p).cast("long"), F.lit(s))])
    return (F.when(n.isNull(), F.lit("Unknown Protocol"))
            .otherwise(F.coalesce(F.try_element_at(m, n), F.concat(F.lit("Protocol "), n.cast("string")))))
