"""Row cleaning, projections and the packet feature row.

All of these are narrow (per-row) transformations: no shuffle, and the
column lists are resolved at plan time from the DataFrame schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsieve import schemas
from netsieve.functions import detect as X
from netsieve.functions import domains as D
from netsieve.session import checkpoint_root, sized_join

NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def fractional_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def drop_identity(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Drop identity columns when present (absent names are ignored)."""
    wanted = {schemas.column_name(n) for n in (names or D.IDENTITY_COLUMNS)} | set(names or D.IDENTITY_COLUMNS)
    return df.drop(*[c for c in df.columns if c in wanted])


def inf_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """+inf / -inf -> null in every floating column."""
    cols = cols if cols is not None else fractional_columns(df)
    inf = F.lit(float("inf"))
    return df.select(*[F.when(F.abs(F.col(c)) == inf, F.lit(None)).otherwise(F.col(c)).alias(c) if c in cols
                       else F.col(c) for c in df.columns])


def finite_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Infinities become missing, then rows with any missing value (null or NaN) are dropped."""
    return inf_to_null(df).na.drop("any", subset=subset)


def valid_time(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.na.drop(subset=[ts])


def align_features(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """Model feature order: missing features as 0.0, extras dropped (resolved at plan time)."""
    present = set(df.columns)
    cols = [F.col(c).cast("double").alias(c) if c in present else F.lit(0.0).alias(c) for c in features]
    return df.select(*(keep or []), *cols)


REQUIRED_ALERT_FIELDS = ["flow_byts_s", "flow_pkts_s", "flow_iat_mean", "fwd_header_len", "bwd_header_len",
                         "rst_flag_cnt", "syn_flag_cnt"]


def alert_defaults(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """NaN numeric values -> 0 (null stays null); absent required fields -> 0."""
    required = required or REQUIRED_ALERT_FIELDS
    frac = set(fractional_columns(df))
    cols = [F.nanvl(F.col(c), F.lit(0.0)).alias(c) if c in frac else F.col(c) for c in df.columns]
    cols += [F.lit(0).cast("long").alias(c) for c in required if c not in df.columns]
    return df.select(*cols)


def alert_record(df: DataFrame) -> DataFrame:
    """The alert record (16 keys) as a struct; absent keys get 'Unknown' (ports, protocol) or 0."""
    present = set(df.columns)

    def get(c: str, default):
        return F.col(c) if c in present else F.lit(default)

    rec = F.struct(
        F.coalesce(get("protocol", None).cast("string"), F.lit("Unknown")).alias("protocol"),
        F.coalesce(get("src_port", None).cast("string"), F.lit("Unknown")).alias("src_port"),
        F.coalesce(get("dst_port", None).cast("string"), F.lit("Unknown")).alias("dst_port"),
        *[get(c, 0.0).cast("double").alias(c) for c in
          ["flow_byts_s", "flow_pkts_s", "flow_iat_mean", "fwd_header_len", "bwd_header_len"]],
        *[get(c, 0).cast("long").alias(c) for c in ["rst_flag_cnt", "syn_flag_cnt"]],
        *[get(c, 0.0).cast("double").alias(c) for c in ["pkt_len_min", "pkt_len_max"]],
        get("slm_label", None).cast("string").alias("slm_label"),
        get("slm_score", None).cast("double").alias("slm_score"),
        get("binary_pred", None).cast("boolean").alias("binary_prediction"),
        get("attack_label", None).cast("string").alias("multiclass_label"),
    )
    return df.withColumn("alert", rec)


def category_dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code): dense codes of the distinct non-null values in their order, without a list on the driver.

    Values are range-partitioned and sorted; a partition's codes begin after the counts of the partitions before it
    (a table with one row per partition). The checkpoint fixes the sampled range bounds.
    """
    checkpoint_root(df.sparkSession)
    values = (df.select(F.col(column).alias("value")).where("value is not null").distinct()
              .repartitionByRange("value").sortWithinPartitions("value")
              .withColumn("_id", F.monotonically_increasing_id()).checkpoint())
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = values.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select(F.col("_part").alias("_of"), before.alias("_start")))
    return values.join(starts, part == F.col("_of")).select("value", (F.col("_start") + place).cast("double").alias("code"))


def category_codes(df: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """The rows with ``<c>_code`` for each string column ``c`` other than ``exclude``: the place of its value among the
    distinct values of the column; a missing value gets the number of values."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in (exclude or [])]
    out = df
    for c in cols:
        codes = category_dictionary(df, c).withColumnsRenamed({"value": c, "code": f"{c}_code"})
        out = sized_join(out, codes, [c], "left").withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(float(codes.count()))))
    return out.select(*df.columns, *[f"{c}_code" for c in cols])


def packet_features(df: DataFrame, form: str = "wide", keep: list[str] | None = None) -> DataFrame:
    """Feature row of one packet: ports, protocol, length, TCP flags, time parts; flow metrics 0.

    ``form`` is ``wide`` (57 fields), ``early`` (with forward counts, header and window) or ``narrow``.
    Non-IP packets have protocol 0; ports are 0 when neither TCP nor UDP.
    """
    pl = F.col("pkt_len").cast("double")
    is_ip = F.col("protocol").isNotNull() & (F.col("protocol") != 0)
    has_tcp = F.col("tcp_flags").isNotNull()
    base = {
        "src_port": F.coalesce(F.col("src_port"), F.lit(0)),
        "dst_port": F.coalesce(F.col("dst_port"), F.lit(0)),
        "protocol": F.coalesce(F.col("protocol"), F.lit(0)),
        "pkt_len_min": pl, "pkt_len_max": pl, "pkt_len_mean": pl,
        "pkt_len_std": F.lit(0.0), "pkt_len_var": F.lit(0.0),
    }
    base.update(zip([n for n, _ in D.TCP_FLAG_MASKS], X.tcp_flag_columns("tcp_flags")))
    base.update(zip(["hour", "minute", "second", "day_of_week"], X.time_parts("ts")))
    if form == "early":
        base.update({
            "tot_fwd_pkts": F.lit(1.0), "tot_bwd_pkts": F.lit(0.0), "totlen_fwd_pkts": pl, "totlen_bwd_pkts": F.lit(0.0),
            "fwd_header_len": F.when(is_ip, F.lit(20.0)).otherwise(F.lit(0.0)), "pkt_size_avg": pl,
            "init_fwd_win_byts": F.when(has_tcp, F.coalesce(F.col("tcp_window"), F.lit(0))).otherwise(F.lit(0)),
        })
        names = schemas.EARLY_FEATURES
    elif form == "narrow":
        names = schemas.NARROW_FEATURES
    else:
        names = schemas.PACKET_FEATURES
    cols = [(base[n] if n in base else F.lit(0.0)).alias(n) for n in names]
    return df.select("packet_id", *(keep or []), *cols)
