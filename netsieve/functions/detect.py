"""Scalar detection rules as Column expressions (stay inside whole-stage codegen).

Spark orders NaN above every number (``NaN > 1000`` is true), while the
original Python comparisons are false for NaN; every threshold goes through
``_gt``/``_lt`` which make NaN compare false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netsieve.functions import domains as D


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _gt(c: Column, v: float) -> Column:
    return ~F.isnan(c) & (c > F.lit(v))


def _lt(c: Column, v: float) -> Column:
    return ~F.isnan(c) & (c < F.lit(v))


def dbl(c: Column | str) -> Column:
    return col(c).cast("double")


def binary_decision(score: Column | str, threshold: float = 0.5) -> Column:
    """Score strictly above the threshold; NaN is not malicious; null stays null."""
    s = dbl(score)
    return F.when(s.isNull(), F.lit(None).cast("boolean")).otherwise(_gt(s, threshold))


def text_trigger(label: Column | str, score: Column | str, threshold: float = 0.7) -> Column:
    """Text model fires: label not ``normal`` (any case) and score above t; nulls never fire."""
    s = dbl(score)
    return F.coalesce((F.lower(col(label)) != F.lit("normal")) & _gt(s, threshold), F.lit(False))


def hybrid_trigger(binary: Column | str, label: Column | str, score: Column | str, threshold: float = 0.7) -> Column:
    """``binary OR text`` — a null binary result counts as not fired."""
    return F.coalesce(col(binary), F.lit(False)) | text_trigger(label, score, threshold)


def gated_label(binary: Column | str, label: Column | str) -> Column:
    """The multi-class label only when the binary model fired, else null."""
    return F.when(F.coalesce(col(binary), F.lit(False)), col(label))


def traffic_pattern(pkt_rate: Column | str, iat_mean: Column | str) -> Column:
    r, i = dbl(pkt_rate), dbl(iat_mean)
    return (F.when(r.isNull() | i.isNull(), F.lit("Unknown pattern"))
            .when(_gt(r, 1000), F.lit("High-frequency"))
            .when(_lt(i, 50), F.lit("Burst"))
            .when(_gt(i, 1000), F.lit("Slow and methodical"))
            .otherwise(F.lit("Moderate")))


def impact_level(flow_rate: Column | str, pkt_rate: Column | str) -> Column:
    f, p = dbl(flow_rate), dbl(pkt_rate)
    return (F.when(f.isNull() | p.isNull(), F.lit(None).cast("string"))
            .when(_gt(f, 1000) | _gt(p, 500), F.lit("High"))
            .when(_gt(f, 500) | _gt(p, 100), F.lit("Medium"))
            .otherwise(F.lit("Low")))


def severity(flow_rate: Column | str, pkt_rate: Column | str, rst: Column | str) -> Column:
    f, p, r = dbl(flow_rate), dbl(pkt_rate), dbl(rst)
    return (F.when(f.isNull() | p.isNull() | r.isNull(), F.lit(None).cast("string"))
            .when(_gt(f, 1000) | _gt(p, 500) | _gt(r, 100), F.lit("CRITICAL"))
            .when(_gt(f, 500) | _gt(p, 100) | _gt(r, 50), F.lit("WARNING"))
            .otherwise(F.lit("NOTICE")))


def rule_port(protocol: Column | str, dst_port: Column | str) -> Column:
    """TCP to a port other than 80/443."""
    return F.coalesce((col(protocol) == 6) & ~col(dst_port).isin(80, 443), F.lit(False))


def rule_external(protocol: Column | str, src_ip: Column | str, dst_ip: Column | str) -> Column:
    """TCP where ``192.168.`` occurs in neither address (substring test)."""
    return F.coalesce(
        (col(protocol) == 6) & ~F.contains(col(src_ip), F.lit("192.168.")) & ~F.contains(col(dst_ip), F.lit("192.168.")),
        F.lit(False))


def tcp_flag_columns(tcp_flags: Column | str) -> list[Column]:
    """Eight 0/1 indicators by mask; a packet without TCP flags gives 0."""
    f = col(tcp_flags)
    return [F.coalesce(((f.bitwiseAND(F.lit(m))) != 0).cast("int"), F.lit(0)).alias(name)
            for name, m in D.TCP_FLAG_MASKS]


def time_parts(ts: Column | str, weekday_name: str = "day_of_week") -> list[Column]:
    """Hour, minute, second and weekday (Monday = 0) of a timestamp."""
    t = col(ts)
    return [F.hour(t).alias("hour"), F.minute(t).alias("minute"), F.second(t).alias("second"),
            F.weekday(t).alias(weekday_name)]


#: Spellings of a time, the first that fits counts; numbers with or without leading zeros.
DAY_FIRST = ("d/M/yyyy H:mm:ss", "d/M/yyyy h:mm:ss a", "d/M/yyyy H:mm", "d-M-yyyy H:mm:ss", "d.M.yyyy H:mm:ss",
             "yyyy-M-d H:mm:ss", "d/M/yyyy")


def parse_day_first(text: Column | str, patterns: tuple[str, ...] = DAY_FIRST) -> Column:
    """Day-first text time -> timestamp; one that fits none of the patterns, or names no real day, -> null (never raises)."""
    return F.coalesce(*[F.try_to_timestamp(col(text), F.lit(p)) for p in patterns])


def round_half_up(c: Column | str, digits: int) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d`` — the same IEEE steps as the SQL form, so equal inputs round equally
    in any engine (``round`` differs between engines at and near decimal ties)."""
    scale = F.lit(float(10 ** digits))
    return F.floor(col(c).cast("double") * scale + F.lit(0.5)) / scale


def argmax(arr: Column | str) -> Column:
    """0-based index of the first maximum."""
    a = col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def softmax(arr: Column | str) -> Column:
    a = col(arr)
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    total = F.aggregate(e, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)


def array_mean(arr: Column | str) -> Column:
    a = col(arr)
    return F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x) / F.size(a)
