"""Text operators over whole texts with higher-order array functions (no UDF).

Whitespace is the ASCII set ``[ \\t\\n\\x0B\\f\\r]`` in both the engine and the
oracle, so splitting and trimming agree byte for byte.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from netsieve.functions import domains as D

WS = r"[ \t\n\x0B\f\r]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def word_count(c: Column | str) -> Column:
    """Number of whitespace-separated words (as ``len(s.split())``)."""
    return F.size(F.filter(F.split(_c(c), f"{WS}+"), lambda w: w != F.lit("")))


def clean_text(text: Column | str, keywords: list[str] | None = None, max_words: int = 20) -> Column:
    """Keep lines that contain a keyword (case-insensitive) and have fewer than ``max_words`` words; trim them."""
    kws = keywords or D.NOTIFICATION_KEYWORDS
    lines = F.split(_c(text), "\n", -1)

    def keep(line: Column) -> Column:
        low = F.lower(line)
        hit = F.lit(False)
        for k in kws:
            hit = hit | F.contains(low, F.lit(k))
        return hit & (word_count(line) < max_words)

    return F.array_join(F.transform(F.filter(lines, keep), strip), "\n")


def validate_text(text: Column | str, fallback: Column, max_steps: int = 3) -> Column:
    """Keep the THREAT / MITIGATION / IMPACT sections (blank-line separated).

    The mitigation keeps its header and at most ``max_steps`` non-blank lines
    that do not start with ``4``. Not exactly three sections -> ``fallback``.
    """
    sections = F.transform(F.split(_c(text), "\n\n", -1), strip)
    kept = F.filter(sections, lambda s: s.startswith("THREAT:") | s.startswith("MITIGATION:") | s.startswith("IMPACT:"))

    def fix(s: Column) -> Column:
        lines = F.split(s, "\n", -1)
        steps = F.filter(lines, lambda ln, i: (i > 0) & (strip(ln) != F.lit("")) & ~strip(ln).startswith("4"))
        head = F.array(F.element_at(lines, 1))
        return F.when(s.startswith("MITIGATION:"),
                      F.array_join(F.concat(head, F.slice(steps, 1, max_steps)), "\n")).otherwise(s)

    fixed = F.transform(kept, fix)
    return F.when(F.size(fixed) == 3, F.array_join(fixed, "\n\n")).otherwise(fallback)


def spelled(x: Column) -> Column:
    """A number as the original prints it: integers plainly, doubles by ``plain_number``."""
    return F.when(F.typeof(x).isin("double", "float"), plain_number(x.cast("double"))).otherwise(x.cast("string"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def plain_number(x: Column) -> Column:
    """Shortest digits that read back as the double ``x``: plain from 1e-4 to below 1e16 (at least one decimal), else with an
    exponent of two digits (``1e-05``, ``1.5e+16``); ``nan``, ``inf``, ``-inf``, ``-0.0``. (Below
    1e-300 and from 1e17 on, where the JVM prints some numbers with a digit too many, the last digit may differ by one.)"""
    a = F.abs(x)
    # The first of 15, 16 and 17 digits that reads back as the number: d.ddde±xx
    chosen = None
    for n in (14, 15):
        text = F.format_string(f"%.{n}e", a)
        chosen = (F if chosen is None else chosen).when(text.cast("double") == a, text)
    chosen = chosen.otherwise(F.format_string("%.16e", a))
    # From 1e17 a cast may print 18 digits, and %.16e rounds those: the integer itself is rounded instead.
    whole = F.when((a >= 1e17) & (a < 9.2e18), a.cast("bigint"))
    exact = F.when(whole < 10 ** 18, F.bround(whole, -1)).otherwise(F.bround(whole, -2)).cast("string")

    def spell(digits: Column, e: Column) -> Column:
        size = F.length(digits)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        large = F.concat(F.rpad(F.substring(digits, F.lit(1), e + 1), e + 1, "0"), F.lit("."),
                         F.when(size > e + 1, F.substring(digits, e + 2, size)).otherwise(F.lit("0")))
        rest = F.when(size > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), size))).otherwise(F.lit(""))
        power = F.concat(F.substring(digits, 1, 1), rest, F.format_string("e%+03d", e))
        return F.when((e < -4) | (e >= 16), power).when(e < 0, small).otherwise(large)

    def split(text: Column) -> Column:
        digits = F.regexp_replace(F.replace(F.split_part(text, F.lit("e"), F.lit(1)), F.lit(".")), "(?<=.)0+$", "")
        digits = F.when((F.length(digits) == 17) & whole.isNotNull(), F.regexp_replace(exact, "0+$", "")).otherwise(digits)
        return F.struct(digits.alias("d"), F.split_part(text, F.lit("e"), F.lit(2)).cast("int").alias("e"))

    body = _let(chosen, lambda c: _let(split(c), lambda s: spell(s["d"], s["e"])))
    sign = F.when(x.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    # A plain cast of at most 15 digits that reads back is the shortest: no two such decimals are one double.
    text = a.cast("string")
    plain = (a >= 1e-3) & (a < 1e7) & (F.length(text) <= 16)
    shown = F.when(a == 0, F.lit("0.0")).when(a == float("inf"), F.lit("inf")).when(plain, text).otherwise(body)
    return F.when(x.isNull(), F.lit(None)).when(F.isnan(x), F.lit("nan")).otherwise(F.concat(sign, shown))


def payload_text(flow_byts_s: Column | str, flow_pkts_s: Column | str) -> Column:
    """Text given to the text scorer for a flow row."""
    return F.concat(F.lit("Flow Bytes/s: "), F.coalesce(spelled(_c(flow_byts_s)), F.lit("Unknown")),
                    F.lit(", Flow Packets/s: "), F.coalesce(spelled(_c(flow_pkts_s)), F.lit("Unknown")))


def packet_payload_text(src_ip: Column | str, dst_ip: Column | str, payload: Column | str) -> Column:
    """Text given to the text scorer for a packet."""
    return F.concat(F.lit("Source: "), F.coalesce(_c(src_ip), F.lit("Unknown")), F.lit(", Destination: "),
                    F.coalesce(_c(dst_ip), F.lit("Unknown")), F.lit(", Payload: "),
                    F.coalesce(_c(payload), F.lit("Unknown")))


# ---------------------------------------------------------------- SQL side (oracle)

SQL_WS = "[ \\t\\n\\x0B\\f\\r]"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SQL_WS}+|{SQL_WS}+$', '', 'g')"


def sql_word_count(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array({c}, '{SQL_WS}+'), lambda w: w <> ''))"


def sql_clean_text(text: str, keywords: list[str] | None = None, max_words: int = 20) -> str:
    kws = keywords or D.NOTIFICATION_KEYWORDS
    hit = " OR ".join(f"contains(lower(l), '{k}')" for k in kws)
    return (f"array_to_string(list_transform(list_filter(string_split({text}, chr(10)), "
            f"lambda l: ({hit}) AND {sql_word_count('l')} < {max_words}), lambda l: {sql_strip('l')}), chr(10))")


def sql_validate_text(text: str, fallback: str, max_steps: int = 3) -> str:
    nl2 = "chr(10) || chr(10)"
    sections = f"list_transform(string_split({text}, {nl2}), lambda s: {sql_strip('s')})"
    kept = (f"list_filter({sections}, lambda s: starts_with(s, 'THREAT:') OR starts_with(s, 'MITIGATION:') "
            f"OR starts_with(s, 'IMPACT:'))")
    steps = (f"list_filter(string_split(s, chr(10)), lambda ln, i: i > 1 AND {sql_strip('ln')} <> '' "
             f"AND NOT starts_with({sql_strip('ln')}, '4'))")
    fix = (f"lambda s: CASE WHEN starts_with(s, 'MITIGATION:') THEN array_to_string(list_concat("
           f"[string_split(s, chr(10))[1]], list_slice({steps}, 1, {max_steps})), chr(10)) ELSE s END")
    fixed = f"list_transform({kept}, {fix})"
    return f"(CASE WHEN len({fixed}) = 3 THEN array_to_string({fixed}, {nl2}) ELSE {fallback} END)"
