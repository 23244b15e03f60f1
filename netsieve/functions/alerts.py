"""Alert texts as Column expressions: templates as data, each cut once into its literal and value pieces.

A text is one ``concat`` of the pieces of its template; where the attack type chooses among
templates, one ``CASE`` holds their concats, so a row pays for the text it gets alone, and a
value that looks like a placeholder stays as it is. Each placeholder value is described once
(``VALUES``) and compiled either to a Spark Column (the engine) or to a SQL expression (the DuckDB oracle), so the
two can only differ where the engines differ. A missing value makes the whole text null: the alert text then
falls back to the fallback alert, as the original does when a metric is missing; a detail block of its own
shows ``{NULL}`` in its place.

Input columns of an alert record: protocol, src_port, dst_port, flow_byts_s,
flow_pkts_s, flow_iat_mean, fwd_header_len, bwd_header_len, rst_flag_cnt,
syn_flag_cnt, tot_fwd_pkts, tot_bwd_pkts, fwd_pkt_len_mean, bwd_pkt_len_mean,
slm_label, slm_score, binary_pred, attack_label (null when not classified).
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsieve.functions import domains as D
from netsieve.functions import templates as TPL
from netsieve.functions.textops import spelled, sql_word_count, word_count

NULL = "{NULL}"

# Value specs: (kind, args...). Kinds: f2 (two decimals), raw (plain string),
# pick (threshold label), and a few named rules.
VALUES = {
    "attack_type": ("attack_type",),
    "flow_rate": ("f2", "flow_byts_s"),
    "packet_rate": ("f2", "flow_pkts_s"),
    "pkt_rate": ("f2", "flow_pkts_s"),
    "iat_mean": ("f2", "flow_iat_mean"),
    "slm_score": ("f2", "slm_score"),
    "protocol": ("raw", "protocol"),
    "src_port": ("raw", "src_port"),
    "dst_port": ("raw", "dst_port"),
    "syn_flags": ("raw", "syn_flag_cnt"),
    "rst_flags": ("raw", "rst_flag_cnt"),
    "tot_fwd_pkts": ("raw", "tot_fwd_pkts"),
    "tot_bwd_pkts": ("raw", "tot_bwd_pkts"),
    "fwd_header_len": ("raw", "fwd_header_len"),
    "bwd_header_len": ("raw", "bwd_header_len"),
    "fwd_pkt_len_mean": ("raw", "fwd_pkt_len_mean"),
    "bwd_pkt_len_mean": ("raw", "bwd_pkt_len_mean"),
    "active_connections": ("diff", "syn_flag_cnt", "rst_flag_cnt"),
    "header_sum": ("sum", "fwd_header_len", "bwd_header_len"),
    "protocol_name": ("protocol_name",),
    "port_analysis": ("port_analysis",),
    "traffic_pattern": ("traffic_pattern",),
    "impact_level": ("impact_level",),
    "severity": ("severity",),
    # derived labels of the first detail set
    "volume_pattern": ("pick", "flow_pkts_s", ">", 1000, "High-volume", "Slow and Low"),
    "dos_vector": ("pick", "flow_pkts_s", ">", 10000, "High-Rate DoS", "Slow and Low DoS"),
    "syn_vector": ("pick", "syn_flag_cnt", ">", 100, "SYN Flood", "Volume-based DDoS"),
    "rate_pattern": ("pick", "flow_pkts_s", ">", 100, "Aggressive", "Stealthy"),
    "payload_pattern": ("pick", "fwd_pkt_len_mean", ">", 1000, "Large Payload", "Standard Request"),
    "query_pattern": ("pick", "fwd_pkt_len_mean", ">", 500, "Complex Query", "Simple Query"),
    # derived labels of the second detail set
    "hulk_pattern": ("pick", "flow_iat_mean", "<", 100, "Sustained", "Burst"),
    "bot_pattern": ("pick", "flow_pkts_s", ">", 100, "Yes", "Possible"),
    "ftp_pattern": ("pick", "flow_iat_mean", "<", 50, "Aggressive", "Stealthy"),
    "ssh_pattern": ("pick", "flow_iat_mean", "<", 100, "Rapid", "Distributed"),
    "goldeneye_pattern": ("pick", "flow_pkts_s", ">", 500, "Aggressive", "Moderate"),
    "exhaustion_level": ("pick", "flow_byts_s", ">", 1000, "High", "Moderate"),
    "xss_pattern": ("pick", "fwd_header_len", ">", 1000, "Large payload", "Standard"),
    "sql_pattern": ("pick", "fwd_header_len", ">", 500, "Complex", "Simple"),
}

METRIC_LABELS = ["volume_pattern", "dos_vector", "syn_vector", "rate_pattern", "payload_pattern", "query_pattern",
                 "active_connections", "hulk_pattern", "bot_pattern", "ftp_pattern", "ssh_pattern", "header_sum",
                 "goldeneye_pattern", "exhaustion_level", "xss_pattern", "sql_pattern"]


def placeholders(*texts: str) -> list[str]:
    seen: dict[str, None] = {}
    for t in texts:
        for name in re.findall(r"\{([a-z_0-9]+)\}", t):
            seen.setdefault(name, None)
    return list(seen)


# ---------------------------------------------------------------- Spark side

def _c(name: str) -> Column:
    return F.col(name)


def _ok(x: Column) -> Column:
    return ~F.isnan(x.cast("double"))


def _cmp(x: Column, op: str, v: float) -> Column:
    x = x.cast("double")
    return _ok(x) & (x > F.lit(v) if op == ">" else x < F.lit(v))


def _port_desc(p: Column, unknown: str) -> Column:
    d = p.cast("double")
    svc = F.coalesce(F.try_element_at(
        F.create_map(*[x for k, s in D.COMMON_PORTS for x in (F.lit(k), F.lit(s))]), d.cast("int")), F.lit("Unknown"))
    return F.when(d.isNull() | F.isnan(d) | (d == 0), F.lit(unknown)).otherwise(
        F.concat(F.lit("Port "), d.cast("string"), F.lit(" ("), svc, F.lit(")")))


@functools.cache
def _protocol_name() -> Column:
    from netsieve.operators.labels import protocol_name
    return protocol_name(_c("protocol"))


@functools.cache
def _traffic_pattern() -> Column:
    from netsieve.functions.detect import traffic_pattern
    return traffic_pattern("flow_pkts_s", "flow_iat_mean")


@functools.cache
def spark_value(name: str) -> Column:
    spec = VALUES[name]
    kind = spec[0]
    if kind == "attack_type":
        return F.coalesce(_c("attack_label"), F.lit("Unknown"))
    if kind == "f2":
        return F.when(_c(spec[1]).isNotNull(), F.format_string("%.2f", _c(spec[1]).cast("double")))
    if kind == "raw":
        return spelled(_c(spec[1]))
    if kind == "diff":
        return spelled(_c(spec[1]) - _c(spec[2]))
    if kind == "sum":
        return spelled(_c(spec[1]) + _c(spec[2]))
    if kind == "pick":
        x = _c(spec[1])
        return F.when(x.isNull(), F.lit(None)).when(_cmp(x, spec[2], spec[3]), F.lit(spec[4])).otherwise(F.lit(spec[5]))
    if kind == "protocol_name":
        return _protocol_name()
    if kind == "traffic_pattern":
        return _traffic_pattern()
    if kind == "impact_level":
        from netsieve.functions.detect import impact_level
        return impact_level("flow_byts_s", "flow_pkts_s")
    if kind == "severity":
        from netsieve.functions.detect import severity
        return severity("flow_byts_s", "flow_pkts_s", "rst_flag_cnt")
    if kind == "port_analysis":
        return port_analysis()
    raise ValueError(name)


@functools.cache
def port_analysis() -> Column:
    """Port and protocol sentence; ports print as floats (``Port 443.0 (HTTPS)``)."""
    proto = _protocol_name()
    src_desc = _port_desc(_c("src_port"), "Unknown Source")
    dst_desc = _port_desc(_c("dst_port"), "Unknown Destination")
    d = _c("dst_port").cast("double")
    dst = F.when(d.isNull() | F.isnan(d) | (d == 0), F.lit(0.0)).otherwise(d)
    slow = F.coalesce(_c("attack_label"), F.lit("Unknown")) == F.lit("DoS Slowhttptest")
    return (F.when(slow & (dst == 21), F.concat(F.lit("WARNING: HTTP DoS Attack targeting FTP port ("),
                                                dst.cast("string"), F.lit(") over "), proto))
            .when(slow & (dst == 0), F.concat(F.lit("WARNING: HTTP DoS Attack targeting unknown port over "), proto))
            .when(slow & ~dst.isin(80, 443, 8080), F.concat(F.lit("WARNING: HTTP DoS Attack on non-HTTP port "),
                                                             dst.cast("string"), F.lit(" over "), proto))
            .when(slow, F.concat(F.lit("Target: "), dst_desc, F.lit(" over "), proto))
            .otherwise(F.concat(F.lit("Connection: "), src_desc, F.lit(" → "), dst_desc, F.lit(" over "), proto)))


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def _pieces(template: str, names) -> list[tuple[bool, str]]:
    """(is a value, literal text or placeholder name) pieces of a template; only ``names`` are placeholders."""
    parts = re.split(r"\{([a-z_0-9]+)\}", template)
    out = [(k % 2 == 1, x) for k, x in enumerate(parts)]
    return [(v and x in names, x if not v or x in names else "{" + x + "}") for v, x in out if v or x]


def _compile(template: str, values: dict[str, Column]) -> Column:
    """The template filled in: one concat; null if a value is."""
    return F.concat(*[values[x] if is_value else F.lit(x) for is_value, x in _pieces(template, values)])


def _choose(key: Column, table: dict[str, str], default: str, values: dict[str, Column]) -> Column:
    """The template that ``key`` names, filled in: one CASE of concats."""
    out = None
    for k, template in table.items():
        out = (F if out is None else out).when(key == F.lit(k), _compile(template, values))
    return _compile(default, values) if out is None else out.otherwise(_compile(default, values))


def _shown(values: dict[str, Column]) -> dict[str, Column]:
    return {n: F.coalesce(v, F.lit(NULL)) for n, v in values.items()}


def _values(names) -> dict[str, Column]:
    return {n: spark_value(n) for n in names}


@functools.cache
def threat_text() -> Column:
    at = F.coalesce(_c("attack_label"), F.lit("Unknown"))
    dst = F.coalesce(_c("dst_port").cast("string"), F.lit("Unknown"))
    http = F.when(_c("dst_port").isin(80, 443, 8080), F.concat(F.lit("HTTP port "), dst)).otherwise(
        F.concat(F.lit("port "), dst, F.lit(" (unusual for HTTP)")))
    return F.when(at == "DoS Slowhttptest", F.concat(
        F.lit("DoS Slowhttptest attack detected targeting "), http, F.lit(" with slow HTTP request pattern"))).otherwise(
        F.concat(F.lit("Suspicious "), at, F.lit(" activity detected on port "), dst))


@functools.cache
def alert_detail() -> Column:
    at = F.coalesce(_c("attack_label"), F.lit("Unknown"))
    names = placeholders(TPL.DETAIL_DEFAULT, *TPL.DETAIL.values())
    return _choose(at, TPL.DETAIL, TPL.DETAIL_DEFAULT, _shown(_values(names)))


@functools.cache
def alert_detail2() -> Column:
    at = F.coalesce(_c("attack_label"), F.lit("Unknown"))
    names = placeholders(TPL.DETAIL2_DEFAULT, *TPL.DETAIL2.values())
    return _choose(at, TPL.DETAIL2, TPL.DETAIL2_DEFAULT, _shown(_values(names)))


@functools.cache
def alert_fallback() -> Column:
    """The fallback alert (the one that runs); a null score prints 0.00."""
    at = F.coalesce(_c("attack_label"), F.lit("Unknown"))
    src = F.coalesce(_c("src_port").cast("string"), F.lit("Unknown"))
    dst = F.coalesce(_c("dst_port").cast("string"), F.lit("Unknown"))
    port_info = F.when(F.coalesce(_c("dst_port") == 80, F.lit(False)), F.concat(F.lit("port "), dst)).otherwise(
        F.concat(F.lit("ports "), src, F.lit(" → "), dst))
    vals = {"port_info": port_info, "attack_type": at,
            "score": F.format_string("%.2f", F.coalesce(_c("slm_score").cast("double"), F.lit(0.0)))}
    whole = {k: _inserted(TPL.FALLBACK_TEXT, v) for k, v in TPL.FALLBACK.items()}
    return _choose(at, whole, _inserted(TPL.FALLBACK_TEXT, TPL.FALLBACK_DEFAULT), vals)


def _inserted(frame: str, parts: tuple[str, str, str]) -> str:
    """A text template with the threat, mitigation and impact templates in their places."""
    for name, part in zip(("threat", "mitigation", "impact"), parts):
        frame = frame.replace("{" + name + "}", part)
    return frame


@functools.cache
def alert_text() -> Column:
    """The intended alert: THREAT / details / MITIGATION / IMPACT; fallback when a metric is missing."""
    at = F.coalesce(_c("attack_label"), F.lit("Unknown"))
    names = placeholders(TPL.DETAIL_DEFAULT, *TPL.DETAIL.values())
    return F.coalesce(_alert_frame(at, _choose(at, TPL.DETAIL, TPL.DETAIL_DEFAULT, _values(names))), alert_fallback())


def _alert_frame(at: Column, details: Column) -> Column:
    return _compile(TPL.ALERT_TEXT, {
        "threat": threat_text(), "details": details,
        "mitigation": _lookup(at, TPL.MITIGATION, TPL.MITIGATION_DEFAULT),
        "impact": _lookup(at, TPL.IMPACT, TPL.IMPACT_DEFAULT)})


def _example_parts(at: Column, values: dict[str, Column] | None = None) -> dict[str, Column]:
    vals = values or _values(placeholders(*[v[0] for v in TPL.EXAMPLE.values()]))
    desc = {k: v[0] for k, v in TPL.EXAMPLE.items() if k != "Unknown"}
    mit = {k: "\n".join("• " + s for s in v[1]) for k, v in TPL.EXAMPLE.items() if k != "Unknown"}
    imp = {k: v[2] for k, v in TPL.EXAMPLE.items() if k != "Unknown"}
    unk = TPL.EXAMPLE["Unknown"]
    return {
        "threat": _choose(at, desc, unk[0], _shown(vals)),
        "mitigation": _lookup(at, mit, "\n".join("• " + s for s in unk[1])),
        "impact": _lookup(at, imp, unk[2]),
    }


def alert_confidence(confidence: Column, values: dict[str, Column] | None = None) -> Column:
    """Severity-headed alert with a confidence value and the second detail block."""
    at = F.coalesce(_c("attack_label"), F.lit("Unknown"))
    parts = _example_parts(at, values)
    parts["severity"] = F.coalesce(spark_value("severity"), F.lit(NULL))
    parts["confidence"] = F.format_string("%.2f", F.coalesce(confidence.cast("double"), F.lit(0.0)))
    values = values or _values(placeholders(TPL.DETAIL2_DEFAULT, *TPL.DETAIL2.values()))
    parts["details"] = _choose(at, TPL.DETAIL2, TPL.DETAIL2_DEFAULT, _shown(values))
    return _compile(TPL.CONFIDENCE_TEXT, parts)


@functools.cache
def alert_generic() -> Column:
    vals = {"dst_port": F.coalesce(_c("dst_port").cast("string"), F.lit("Unknown")),
            "src_port": F.coalesce(_c("src_port").cast("string"), F.lit("Unknown")),
            "protocol": F.coalesce(_c("protocol").cast("string"), F.lit("Unknown")),
            "attack_type": F.coalesce(_c("attack_label"), F.lit("Unknown"))}
    return _compile(TPL.GENERIC_TEXT, vals)


def prompt_classifier(attack_type: Column) -> Column:
    vals = {"protocol": _c("protocol").cast("string"), "src_port": _c("src_port").cast("string"),
            "dst_port": _c("dst_port").cast("string"), "attack_type": attack_type}
    return _compile(TPL.PROMPT_CLASSIFIER, _shown(vals))


def prompt_summary() -> Column:
    """The whole prompt, whatever its length; ``prompt_words`` tells what a model with a limit has to cut."""
    vals = {"protocol": _c("protocol").cast("string"), "src_port": _c("src_port").cast("string"),
            "dst_port": _c("dst_port").cast("string"),
            "slm_label": F.coalesce(_c("slm_label"), F.lit("None")),
            "slm_score": F.format_string("%.2f", F.coalesce(_c("slm_score").cast("double"), F.lit(0.0))),
            "binary": F.when(F.coalesce(_c("binary_pred"), F.lit(False)), F.lit("Malicious")).otherwise(F.lit("Benign")),
            "attack_type": F.coalesce(_c("attack_label"), F.lit("Not Triggered"))}
    return _compile(TPL.PROMPT_SUMMARY, _shown(vals))


def prompt_words() -> Column:
    return word_count(prompt_summary()).cast("long")


def alert_metrics(df: DataFrame) -> DataFrame:
    """The derived labels used inside the detail texts, as columns."""
    return df.select("row_id", *[spark_value(n).alias(n) for n in METRIC_LABELS])


# ---------------------------------------------------------------- DataFrame forms

#: Values that most templates show: columns of their own, so that their long expressions are not in every branch.
_SHARED = ("protocol_name", "port_analysis", "impact_level", "traffic_pattern")


def _staged(df: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with the shared values, and those of doubles spelled out, as columns; and all values."""
    doubles = {c for c, t in df.dtypes if t in ("double", "float")}
    staged = [n for n in names if n in _SHARED or VALUES[n][0] in ("raw", "sum", "diff") and doubles.intersection(VALUES[n][1:])]
    values = {n: F.col(f"_v_{n}") if n in staged else spark_value(n) for n in names}
    return df.withColumns({f"_v_{n}": spark_value(n) for n in staged}), values


def add_alert_detail(df: DataFrame, out: str = "alert_detail", second: bool = False) -> DataFrame:
    table, default = (TPL.DETAIL2, TPL.DETAIL2_DEFAULT) if second else (TPL.DETAIL, TPL.DETAIL_DEFAULT)
    d, values = _staged(df, placeholders(default, *table.values()))
    at = F.coalesce(_c("attack_label"), F.lit("Unknown"))
    return d.select(*df.columns, _choose(at, table, default, _shown(values)).alias(out))


def add_alert_text(df: DataFrame, out: str = "alert_text") -> DataFrame:
    """``alert_text`` as a column."""
    d, values = _staged(df, placeholders(TPL.DETAIL_DEFAULT, *TPL.DETAIL.values()))
    at = F.coalesce(_c("attack_label"), F.lit("Unknown"))
    text = _alert_frame(at, _choose(at, TPL.DETAIL, TPL.DETAIL_DEFAULT, values))
    return d.select(*df.columns, F.coalesce(text, alert_fallback()).alias(out))


def add_alert_confidence(df: DataFrame, confidence: Column, out: str = "alert_confidence") -> DataFrame:
    """``alert_confidence`` as a column."""
    descriptions = [v[0] for v in TPL.EXAMPLE.values()]
    d, values = _staged(df, placeholders(TPL.DETAIL2_DEFAULT, *TPL.DETAIL2.values(), *descriptions))
    return d.select(*df.columns, alert_confidence(confidence, values).alias(out))


# ---------------------------------------------------------------- SQL side (oracle)

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_cmp(x: str, op: str, v: float) -> str:
    return f"(NOT isnan(CAST({x} AS DOUBLE)) AND CAST({x} AS DOUBLE) {op} {v})"


def _sql_protocol_name() -> str:
    d = "TRY_CAST(CAST(protocol AS VARCHAR) AS DOUBLE)"
    n = f"CAST(trunc({d}) AS BIGINT)"
    cases = " ".join(f"WHEN {n} = {k} THEN {_q(v)}" for k, v in D.PROTOCOLS)
    return (f"(CASE WHEN {d} IS NULL OR isnan({d}) OR isinf({d}) THEN 'Unknown Protocol' {cases} "
            f"ELSE 'Protocol ' || CAST({n} AS VARCHAR) END)")


def _sql_service(d: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {_q(v)}" for k, v in D.COMMON_PORTS)
    return f"(CASE CAST(trunc({d}) AS INTEGER) {cases} ELSE 'Unknown' END)"


def _sql_port_desc(p: str, unknown: str) -> str:
    d = f"CAST({p} AS DOUBLE)"
    return (f"(CASE WHEN {d} IS NULL OR isnan({d}) OR {d} = 0 THEN {_q(unknown)} "
            f"ELSE 'Port ' || CAST({d} AS VARCHAR) || ' (' || {_sql_service(d)} || ')' END)")


def sql_port_analysis() -> str:
    proto = _sql_protocol_name()
    d = "CAST(dst_port AS DOUBLE)"
    dst = f"(CASE WHEN {d} IS NULL OR isnan({d}) OR {d} = 0 THEN 0.0 ELSE {d} END)"
    slow = "coalesce(attack_label, 'Unknown') = 'DoS Slowhttptest'"
    return (f"(CASE WHEN {slow} AND {dst} = 21 THEN 'WARNING: HTTP DoS Attack targeting FTP port (' || "
            f"CAST({dst} AS VARCHAR) || ') over ' || {proto} "
            f"WHEN {slow} AND {dst} = 0 THEN 'WARNING: HTTP DoS Attack targeting unknown port over ' || {proto} "
            f"WHEN {slow} AND {dst} NOT IN (80, 443, 8080) THEN 'WARNING: HTTP DoS Attack on non-HTTP port ' || "
            f"CAST({dst} AS VARCHAR) || ' over ' || {proto} "
            f"WHEN {slow} THEN 'Target: ' || {_sql_port_desc('dst_port', 'Unknown Destination')} || ' over ' || {proto} "
            f"ELSE 'Connection: ' || {_sql_port_desc('src_port', 'Unknown Source')} || ' → ' || "
            f"{_sql_port_desc('dst_port', 'Unknown Destination')} || ' over ' || {proto} END)")


def sql_traffic_pattern() -> str:
    return ("(CASE WHEN flow_pkts_s IS NULL OR flow_iat_mean IS NULL THEN 'Unknown pattern' "
            f"WHEN {_sql_cmp('flow_pkts_s', '>', 1000)} THEN 'High-frequency' "
            f"WHEN {_sql_cmp('flow_iat_mean', '<', 50)} THEN 'Burst' "
            f"WHEN {_sql_cmp('flow_iat_mean', '>', 1000)} THEN 'Slow and methodical' ELSE 'Moderate' END)")


def sql_impact_level() -> str:
    return ("(CASE WHEN flow_byts_s IS NULL OR flow_pkts_s IS NULL THEN NULL "
            f"WHEN {_sql_cmp('flow_byts_s', '>', 1000)} OR {_sql_cmp('flow_pkts_s', '>', 500)} THEN 'High' "
            f"WHEN {_sql_cmp('flow_byts_s', '>', 500)} OR {_sql_cmp('flow_pkts_s', '>', 100)} THEN 'Medium' "
            "ELSE 'Low' END)")


def sql_severity() -> str:
    return ("(CASE WHEN flow_byts_s IS NULL OR flow_pkts_s IS NULL OR rst_flag_cnt IS NULL THEN NULL "
            f"WHEN {_sql_cmp('flow_byts_s', '>', 1000)} OR {_sql_cmp('flow_pkts_s', '>', 500)} "
            f"OR {_sql_cmp('rst_flag_cnt', '>', 100)} THEN 'CRITICAL' "
            f"WHEN {_sql_cmp('flow_byts_s', '>', 500)} OR {_sql_cmp('flow_pkts_s', '>', 100)} "
            f"OR {_sql_cmp('rst_flag_cnt', '>', 50)} THEN 'WARNING' ELSE 'NOTICE' END)")


def sql_value(name: str) -> str:
    spec = VALUES[name]
    kind = spec[0]
    if kind == "attack_type":
        return "coalesce(attack_label, 'Unknown')"
    if kind == "f2":
        return f"(CASE WHEN {spec[1]} IS NOT NULL THEN printf('%.2f', CAST({spec[1]} AS DOUBLE)) END)"
    if kind == "raw":
        return f"CAST({spec[1]} AS VARCHAR)"  # the shortest digits, as the original prints them
    if kind == "diff":
        return f"CAST({spec[1]} - {spec[2]} AS VARCHAR)"
    if kind == "sum":
        return f"CAST({spec[1]} + {spec[2]} AS VARCHAR)"
    if kind == "pick":
        return (f"(CASE WHEN {spec[1]} IS NULL THEN NULL WHEN {_sql_cmp(spec[1], spec[2], spec[3])} "
                f"THEN {_q(spec[4])} ELSE {_q(spec[5])} END)")
    return {"protocol_name": _sql_protocol_name, "traffic_pattern": sql_traffic_pattern,
            "impact_level": sql_impact_level, "severity": sql_severity,
            "port_analysis": sql_port_analysis}[kind]()


def _sql_lookup(key: str, table: dict[str, str], default: str) -> str:
    cases = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in table.items())
    return f"(CASE {key} {cases} ELSE {_q(default)} END)"


def _sql_compile(template: str, values: dict[str, str]) -> str:
    return "(" + " || ".join(values[x] if v else _q(x) for v, x in _pieces(template, values)) + ")"


def _sql_choose(key: str, table: dict[str, str], default: str, values: dict[str, str]) -> str:
    cases = " ".join(f"WHEN {_q(k)} THEN {_sql_compile(v, values)}" for k, v in table.items())
    return f"(CASE {key} {cases} ELSE {_sql_compile(default, values)} END)"


def _sql_shown(values: dict[str, str]) -> dict[str, str]:
    return {n: f"coalesce({v}, {_q(NULL)})" for n, v in values.items()}


def _sql_values(names) -> dict[str, str]:
    return {n: sql_value(n) for n in names}


AT = "coalesce(attack_label, 'Unknown')"


def sql_threat_text() -> str:
    dst = "coalesce(CAST(dst_port AS VARCHAR), 'Unknown')"
    return (f"(CASE WHEN {AT} = 'DoS Slowhttptest' THEN 'DoS Slowhttptest attack detected targeting ' || "
            f"(CASE WHEN dst_port IN (80, 443, 8080) THEN 'HTTP port ' || {dst} "
            f"ELSE 'port ' || {dst} || ' (unusual for HTTP)' END) || ' with slow HTTP request pattern' "
            f"ELSE 'Suspicious ' || {AT} || ' activity detected on port ' || {dst} END)")


def sql_alert_detail() -> str:
    names = placeholders(TPL.DETAIL_DEFAULT, *TPL.DETAIL.values())
    return _sql_choose(AT, TPL.DETAIL, TPL.DETAIL_DEFAULT, _sql_shown(_sql_values(names)))


def sql_alert_detail2() -> str:
    names = placeholders(TPL.DETAIL2_DEFAULT, *TPL.DETAIL2.values())
    return _sql_choose(AT, TPL.DETAIL2, TPL.DETAIL2_DEFAULT, _sql_shown(_sql_values(names)))


def sql_alert_fallback() -> str:
    src = "coalesce(CAST(src_port AS VARCHAR), 'Unknown')"
    dst = "coalesce(CAST(dst_port AS VARCHAR), 'Unknown')"
    vals = {"port_info": f"(CASE WHEN coalesce(dst_port = 80, false) THEN 'port ' || {dst} "
                         f"ELSE 'ports ' || {src} || ' → ' || {dst} END)",
            "attack_type": AT,
            "score": "printf('%.2f', coalesce(CAST(slm_score AS DOUBLE), 0.0))"}
    whole = {k: _inserted(TPL.FALLBACK_TEXT, v) for k, v in TPL.FALLBACK.items()}
    return _sql_choose(AT, whole, _inserted(TPL.FALLBACK_TEXT, TPL.FALLBACK_DEFAULT), vals)


def sql_alert_text() -> str:
    names = placeholders(TPL.DETAIL_DEFAULT, *TPL.DETAIL.values())
    parts = {"threat": sql_threat_text(), "details": _sql_choose(AT, TPL.DETAIL, TPL.DETAIL_DEFAULT, _sql_values(names)),
             "mitigation": _sql_lookup(AT, TPL.MITIGATION, TPL.MITIGATION_DEFAULT),
             "impact": _sql_lookup(AT, TPL.IMPACT, TPL.IMPACT_DEFAULT)}
    return f"coalesce({_sql_compile(TPL.ALERT_TEXT, parts)}, {sql_alert_fallback()})"


def sql_example_parts() -> dict[str, str]:
    names = placeholders(*[v[0] for v in TPL.EXAMPLE.values()])
    vals = _sql_values(names)
    desc = {k: v[0] for k, v in TPL.EXAMPLE.items() if k != "Unknown"}
    mit = {k: "\n".join("• " + s for s in v[1]) for k, v in TPL.EXAMPLE.items() if k != "Unknown"}
    imp = {k: v[2] for k, v in TPL.EXAMPLE.items() if k != "Unknown"}
    unk = TPL.EXAMPLE["Unknown"]
    return {"threat": _sql_choose(AT, desc, unk[0], _sql_shown(vals)),
            "mitigation": _sql_lookup(AT, mit, "\n".join("• " + s for s in unk[1])),
            "impact": _sql_lookup(AT, imp, unk[2])}


def sql_alert_confidence(confidence: str) -> str:
    parts = sql_example_parts()
    parts["severity"] = f"coalesce({sql_severity()}, {_q(NULL)})"
    parts["confidence"] = f"printf('%.2f', coalesce(CAST({confidence} AS DOUBLE), 0.0))"
    parts["details"] = sql_alert_detail2()
    return _sql_compile(TPL.CONFIDENCE_TEXT, parts)


def sql_alert_generic() -> str:
    vals = {"dst_port": "coalesce(CAST(dst_port AS VARCHAR), 'Unknown')",
            "src_port": "coalesce(CAST(src_port AS VARCHAR), 'Unknown')",
            "protocol": "coalesce(CAST(protocol AS VARCHAR), 'Unknown')",
            "attack_type": AT}
    return _sql_compile(TPL.GENERIC_TEXT, vals)


def sql_prompt_classifier(attack_type: str) -> str:
    vals = {"protocol": "CAST(protocol AS VARCHAR)", "src_port": "CAST(src_port AS VARCHAR)",
            "dst_port": "CAST(dst_port AS VARCHAR)", "attack_type": attack_type}
    return _sql_compile(TPL.PROMPT_CLASSIFIER, _sql_shown(vals))


def sql_prompt_summary() -> str:
    vals = {"protocol": "CAST(protocol AS VARCHAR)", "src_port": "CAST(src_port AS VARCHAR)",
            "dst_port": "CAST(dst_port AS VARCHAR)", "slm_label": "coalesce(slm_label, 'None')",
            "slm_score": "printf('%.2f', coalesce(CAST(slm_score AS DOUBLE), 0.0))",
            "binary": "(CASE WHEN coalesce(binary_pred, false) THEN 'Malicious' ELSE 'Benign' END)",
            "attack_type": "coalesce(attack_label, 'Not Triggered')"}
    return _sql_compile(TPL.PROMPT_SUMMARY, _sql_shown(vals))


def sql_prompt_words() -> str:
    return f"CAST({sql_word_count(sql_prompt_summary())} AS BIGINT)"
