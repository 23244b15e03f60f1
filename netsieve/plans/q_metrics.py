"""Queries: evaluation metrics, sampling and splits, cleaning of numeric flow rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsieve.functions import detect as X
from netsieve.functions import domains as D
from netsieve.operators import clean as C
from netsieve.operators import labels as L
from netsieve.operators import metrics as M
from netsieve.operators import sampling as SM
from netsieve.operators import stats as S
from netsieve.plans import evaluation as E
from netsieve.plans.registry import query
from netsieve.plans.sqlbase import ENCODER, LABELLED, values, with_alerts
from netsieve.session import table
from netsieve.sources import adapters

N_CLASSES = len(D.ENCODER_CLASSES)
H = "((row_id % 2147483648) * 2654435761 + 42) % 4294967296"

# ---------------------------------------------------------------- binary metrics

_BIN_SQL = """
SELECT count(*) AS n, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y <> 1 AND p = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND p <> 1) AS fn, count(*) FILTER (WHERE y <> 1 AND p <> 1) AS tn,
  round(coalesce((count(*) FILTER (WHERE y = p)) / nullif(count(*), 0), 0), 6) AS accuracy,
  round(coalesce((count(*) FILTER (WHERE y = 1 AND p = 1)) / nullif(count(*) FILTER (WHERE p = 1), 0), 0), 6)
    AS precision,
  round(coalesce((count(*) FILTER (WHERE y = 1 AND p = 1)) / nullif(count(*) FILTER (WHERE y = 1), 0), 0), 6)
    AS recall,
  round(coalesce(2.0 * (count(*) FILTER (WHERE y = 1 AND p = 1)) / nullif(2 * (count(*) FILTER (WHERE y = 1 AND p = 1))
    + count(*) FILTER (WHERE y <> 1 AND p = 1) + count(*) FILTER (WHERE y = 1 AND p <> 1), 0), 0), 6) AS f1
FROM x"""


@query("metrics_binary", sql=lambda: with_alerts(LABELLED) + """,
x AS (SELECT CASE WHEN label = 'Benign' THEN 0 ELSE 1 END AS y,
             CASE WHEN NOT isnan(binary_score) AND binary_score > 0.5 THEN 1 ELSE 0 END AS p FROM labelled)""" + _BIN_SQL)
def q_metrics_binary(spark, sf):
    df = E.labelled_alerts(spark, sf).select(
        L.binary_label("label").alias("y"), X.binary_decision("binary_score").cast("int").alias("p"))
    return M.binary_metrics(df, "y", "p")


@query("metrics_binary_labels", sql="WITH x AS (SELECT quality AS y, toxic AS p FROM labels)" + _BIN_SQL)
def q_metrics_binary_labels(spark, sf):
    """The same metrics over the given labels table (true = quality, predicted = toxic)."""
    return M.binary_metrics(table(spark, sf, "labels"), "quality", "toxic")


# ---------------------------------------------------------------- multi-class metrics

_PER_CLASS = """,
ev AS (SELECT y AS cls, 1 AS is_true, 0 AS is_pred, CASE WHEN y = p THEN 1 ELSE 0 END AS is_tp FROM x
       UNION ALL SELECT p AS cls, 0, 1, 0 FROM x),
c AS (SELECT cls, sum(is_tp) AS tp, sum(is_true) AS support, sum(is_pred) AS predicted FROM ev GROUP BY cls),
s AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
             coalesce(2.0 * tp / nullif(support + predicted, 0), 0) AS f1 FROM c)"""

_MULTI_SELECT = """
SELECT round(sum(tp) / sum(support), 6) AS accuracy,
  round(avg(precision), 6) AS precision_macro, round(sum(precision * support) / sum(support), 6) AS precision_weighted,
  round(avg(recall), 6) AS recall_macro, round(sum(recall * support) / sum(support), 6) AS recall_weighted,
  round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM s"""

_ALERTS_XY = adapters.cte("alerts") + ",\nx AS (SELECT row_id, class_id AS y, pred_class_id AS p FROM alerts)"


@query("metrics_multi", sql=lambda: _ALERTS_XY + _PER_CLASS + _MULTI_SELECT)
def q_metrics_multi(spark, sf):
    return M.multi_metrics(adapters.alerts(spark, sf), "class_id", "pred_class_id")


def _encoder_names(spark):
    return spark.createDataFrame(list(enumerate(D.ENCODER_CLASSES)), "cls int, name string")


_REPORT_SELECT = """,
named AS (SELECT s.*, coalesce(nm.nm_name, CAST(s.cls AS VARCHAR)) AS name FROM s LEFT JOIN {names} nm ON s.cls = nm.nm_id)
SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  CAST(support AS BIGINT) AS support FROM named
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM s
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
  CAST(sum(support) AS BIGINT) FROM s
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM s"""


@query("class_report", sql=lambda: _ALERTS_XY + _PER_CLASS + _REPORT_SELECT.format(
    names=values(list(enumerate(D.ENCODER_CLASSES)), "nm_id, nm_name")))
def q_class_report(spark, sf):
    return M.class_report(adapters.alerts(spark, sf), "class_id", "pred_class_id", _encoder_names(spark))


@query("confusion_matrix", sql=lambda: adapters.cte("alerts") + """,
seen AS (SELECT class_id AS true_id FROM alerts UNION SELECT pred_class_id FROM alerts)
SELECT s.true_id, """ + ", ".join(
    f"count(a.row_id) FILTER (WHERE a.pred_class_id = {k}) AS p_{k}" for k in range(N_CLASSES - 2)) + f""",
  count(a.row_id) FILTER (WHERE a.pred_class_id NOT IN ({", ".join(map(str, range(N_CLASSES - 2)))})) AS p_other
FROM seen s LEFT JOIN alerts a ON a.class_id = s.true_id GROUP BY s.true_id""")
def q_confusion_matrix(spark, sf):
    """Counts of true against predicted class; the last two classes stand for ids that a report does not list."""
    return M.confusion_matrix(adapters.alerts(spark, sf), "class_id", "pred_class_id", list(range(N_CLASSES - 2)))


# ---------------------------------------------------------------- text-model evaluation (given scores)

_TEXT_IDS = values([(n.lower(), i) for i, n in D.TEXT_EVAL_CLASSES], "t_lname, t_id")
_EVAL_IDS = values([(n, i) for i, n in D.TEXT_EVAL_CLASSES], "g_name, g_id")


def _text_eval(spark, sf):
    df = L.label_to_id(E.labelled_alerts(spark, sf), "label", out="ground_truth")
    df = L.text_label_id(df, "slm_label", out="slm_prediction")
    return df


_TEXT_EVAL_SQL = f""",
te AS (SELECT l.row_id, g.g_id AS ground_truth, coalesce(t.t_id, 15) AS slm_prediction, l.slm_label, l.slm_score
       FROM labelled l JOIN {_EVAL_IDS} g ON l.label = g.g_name LEFT JOIN {_TEXT_IDS} t ON lower(l.slm_label) = t.t_lname)"""


@query("text_eval_rows", sql=lambda: with_alerts(LABELLED) + _TEXT_EVAL_SQL + """
SELECT row_id AS index, ground_truth, slm_prediction, slm_label, slm_score FROM te""")
def q_text_eval_rows(spark, sf):
    """Ground truth id, text-model id (case-insensitive; unknown = 15), label and score per row."""
    return _text_eval(spark, sf).select(F.col("row_id").alias("index"), "ground_truth", "slm_prediction",
                                        "slm_label", "slm_score")


@query("class_report_text", sql=lambda: with_alerts(LABELLED) + _TEXT_EVAL_SQL +
       ",\nx AS (SELECT ground_truth AS y, slm_prediction AS p FROM te)" + _PER_CLASS + _REPORT_SELECT.format(
           names=values(list(D.TEXT_EVAL_CLASSES) + [(D.TEXT_EVAL_UNKNOWN, "Unknown")], "nm_id, nm_name")))
def q_class_report_text(spark, sf):
    """Report over the union of true and predicted ids; the unknown id is named ``Unknown``."""
    names = spark.createDataFrame(list(D.TEXT_EVAL_CLASSES) + [(D.TEXT_EVAL_UNKNOWN, "Unknown")], "cls int, name string")
    return M.class_report(_text_eval(spark, sf), "ground_truth", "slm_prediction", names)


@query("confusion_matrix_text", sql=lambda: with_alerts(LABELLED) + _TEXT_EVAL_SQL + """,
seen AS (SELECT ground_truth AS true_id FROM te UNION SELECT slm_prediction FROM te)
SELECT s.true_id, """ + ", ".join(f"count(t.row_id) FILTER (WHERE t.slm_prediction = {k}) AS p_{k}" for k in range(16)) + """,
  CAST(0 AS BIGINT) AS p_other
FROM seen s LEFT JOIN te t ON t.ground_truth = s.true_id GROUP BY s.true_id""")
def q_confusion_matrix_text(spark, sf):
    """True class against the text model's, the unknown id (15) included."""
    return M.confusion_matrix(_text_eval(spark, sf), "ground_truth", "slm_prediction", list(range(16)))


# ---------------------------------------------------------------- ROC AUC


@query("roc_auc", sql=lambda: with_alerts(LABELLED) + """,
s AS (SELECT binary_score AS sc, sum(CASE WHEN label <> 'Benign' THEN 1 ELSE 0 END) AS p,
             sum(CASE WHEN label = 'Benign' THEN 1 ELSE 0 END) AS n FROM labelled GROUP BY binary_score),
c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY sc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM s)
SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives,
  round(sum(p * nb + 0.5 * p * n) / (sum(p) * sum(n)), 6) AS auc FROM c""")
def q_roc_auc(spark, sf):
    df = E.labelled_alerts(spark, sf).select(L.binary_label("label").alias("y"), "binary_score")
    return M.roc_auc(df, "y", "binary_score")


def class_probs(spark, sf, n_classes: int = 10):
    """Per score vector: 10 class scores (vector entries folded by index mod 10), softmax, 9 decimals."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    scores = F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: F.aggregate(
        F.filter("v", lambda x, i: i % n_classes == k), F.lit(0.0).cast("double"), lambda a, x: a + x))
    p = e.select("vec_id", "label", X.softmax(scores).alias("p"))
    return p.select("vec_id", "label", F.transform("p", lambda x: F.round(x, 9)).alias("probs"))


_PROBS_SQL = """
WITH u AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
sc AS (SELECT vec_id, label, CAST(i % 10 AS INTEGER) AS k, sum(CAST(x AS DOUBLE)) AS s FROM u GROUP BY vec_id, label, i % 10),
ex AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM sc),
pr AS (SELECT vec_id, label, k, round(e / sum(e) OVER (PARTITION BY vec_id), 9) AS p FROM ex)"""


@query("roc_auc_ovr", sql=_PROBS_SQL + """,
s AS (SELECT k, p AS sc, sum(CASE WHEN label = k THEN 1 ELSE 0 END) AS pos,
             sum(CASE WHEN label <> k THEN 1 ELSE 0 END) AS n FROM pr GROUP BY k, p),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY k ORDER BY sc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             AS nb FROM s),
per AS (SELECT k AS class_id, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives,
               round(sum(pos * nb + 0.5 * pos * n) / (sum(pos) * sum(n)), 6) AS auc FROM c GROUP BY k)
SELECT * FROM per
UNION ALL SELECT -1, CAST(sum(positives) AS BIGINT), CAST(sum(negatives) AS BIGINT), round(avg(auc), 6) FROM per""")
def q_roc_auc_ovr(spark, sf):
    """One-vs-rest AUC per class (class_id -1 holds the macro mean)."""
    p = class_probs(spark, sf).select("vec_id", "label", F.posexplode("probs").alias("k", "p"))
    p = p.select((F.col("label") == F.col("k")).cast("int").alias("y"), "k", "p")
    per = M.roc_auc(p, "y", "p", by=["k"]).withColumnRenamed("k", "class_id")
    macro = per.agg(F.lit(-1).alias("class_id"), F.sum("positives").alias("positives"),
                    F.sum("negatives").alias("negatives"), F.round(F.avg("auc"), 6).alias("auc"))
    return per.unionByName(macro)


@query("logloss_merror", sql=_PROBS_SQL + """,
row AS (SELECT vec_id, label, max(p) FILTER (WHERE k = label) AS py,
               min(k) FILTER (WHERE p = mx) AS pred
        FROM (SELECT *, max(p) OVER (PARTITION BY vec_id) AS mx FROM pr) GROUP BY vec_id, label),
cw AS (SELECT label, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS w FROM row GROUP BY label),
j AS (SELECT r.*, cw.w, -ln(greatest(r.py, 1e-15)) AS ll, CASE WHEN r.pred <> r.label THEN 1.0 ELSE 0.0 END AS err
      FROM row r JOIN cw ON r.label = cw.label)
SELECT round(avg(ll), 6) AS logloss, round(avg(err), 6) AS merror,
  round(sum(w * ll) / sum(w), 6) AS weighted_logloss, round(sum(w * err) / sum(w), 6) AS weighted_merror FROM j""")
def q_logloss_merror(spark, sf):
    """Multi-class log loss and error, plain and class-weighted."""
    j = S.with_class_weights(class_probs(spark, sf), "label")  # per-class table broadcast by label
    return M.log_loss(j, "probs", "label", weight="weight")


# ---------------------------------------------------------------- sampling and splits


@query("sample_n", sql=lambda: with_alerts(LABELLED) + f"""
SELECT row_id, label FROM labelled ORDER BY {H}, row_id LIMIT 10000""")
def q_sample_n(spark, sf):
    """Seeded sample of 10,000 rows (the sample size of the evaluation run)."""
    return SM.sample_n(E.labelled_alerts(spark, sf), 10000, "row_id").select("row_id", "label")


@query("sample_per_class", sql=lambda: with_alerts(LABELLED) + f"""
SELECT row_id, label FROM (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {H}, row_id) AS rn
FROM labelled) WHERE rn <= 100""")
def q_sample_per_class(spark, sf):
    return SM.sample_per_class(E.labelled_alerts(spark, sf), "label", 100, "row_id").select("row_id", "label")


@query("split_random", sql=lambda: with_alerts(LABELLED) + f"""
SELECT row_id, label, CASE WHEN {H} < 858993459 THEN 'test' ELSE 'train' END AS split FROM labelled""")
def q_split_random(spark, sf):
    return SM.split_random(E.labelled_alerts(spark, sf).select("row_id", "label"), "row_id")


@query("split_stratified", sql=lambda: with_alerts(LABELLED) + f"""
SELECT row_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {H}, row_id)
  <= round(0.2 * count(*) OVER (PARTITION BY label)) THEN 'test' ELSE 'train' END AS split FROM labelled""")
def q_split_stratified(spark, sf):
    return SM.split_stratified(E.labelled_alerts(spark, sf).select("row_id", "label"), "label", "row_id")


# ---------------------------------------------------------------- numeric cleaning of flow rows

_FLOW_COLS = ["flow_byts_s", "flow_pkts_s", "flow_iat_mean"]


@query("finite_rows", sql=lambda: adapters.cte("flows") + """
SELECT * FROM flows WHERE flow_byts_s IS NOT NULL AND NOT isnan(flow_byts_s) AND NOT isinf(flow_byts_s)
  AND flow_pkts_s IS NOT NULL AND NOT isnan(flow_pkts_s) AND NOT isinf(flow_pkts_s)
  AND flow_iat_mean IS NOT NULL AND NOT isnan(flow_iat_mean) AND NOT isinf(flow_iat_mean)
  AND ts IS NOT NULL AND source_file IS NOT NULL AND label IS NOT NULL""")
def q_finite_rows(spark, sf):
    return C.finite_rows(adapters.flows(spark, sf))


@query("zscore_file", sql=lambda: adapters.cte("flows") + """,
f AS (SELECT * FROM flows WHERE flow_byts_s IS NOT NULL AND flow_pkts_s IS NOT NULL AND flow_iat_mean IS NOT NULL
        AND label IS NOT NULL AND ts IS NOT NULL),
st AS (SELECT source_file, """ + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _FLOW_COLS) + """ FROM f GROUP BY source_file)
SELECT f.source_file, f.ts, f.label, """ + ", ".join(
    f"round((f.{c} - st.m_{c}) / coalesce(nullif(st.s_{c}, 0), 1), 6) AS z_{c}" for c in _FLOW_COLS) + """
FROM f JOIN st ON f.source_file = st.source_file""")
def q_zscore_file(spark, sf):
    """Per-file z-score (population std) of the numeric flow metrics, after the missing-value drop."""
    return S.zscore_by_file(C.finite_rows(adapters.flows(spark, sf)), _FLOW_COLS, "source_file")


@query("drop_identity", sql=lambda: adapters.cte("packets") + """
SELECT packet_id, ts, flow_key, protocol, src_port, dst_port, tcp_flags, pkt_len, tcp_window, payload FROM packets""")
def q_drop_identity(spark, sf):
    """Address columns (``Src IP``/``Dst IP`` -> src_ip/dst_ip) dropped; absent identity names ignored."""
    return C.drop_identity(adapters.packets(spark, sf))


@query("feature_label_split", sql=lambda: with_alerts(LABELLED) + """
SELECT row_id, CASE WHEN label = 'Benign' THEN 0 ELSE 1 END AS label,
  [CAST(flow_byts_s AS DOUBLE), CAST(flow_pkts_s AS DOUBLE), CAST(flow_iat_mean AS DOUBLE),
   CAST(rst_flag_cnt AS DOUBLE), CAST(syn_flag_cnt AS DOUBLE)] AS features FROM labelled""")
def q_feature_label_split(spark, sf):
    """Features assembled into one vector (shown as an array) next to the binary target."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    cols = ["flow_byts_s", "flow_pkts_s", "flow_iat_mean", "rst_flag_cnt", "syn_flag_cnt"]
    df = E.labelled_alerts(spark, sf).select("row_id", L.binary_label("label").alias("label"), *cols)
    v = VectorAssembler(inputCols=cols, outputCol="v", handleInvalid="keep").transform(df)
    return v.select("row_id", "label", vector_to_array("v").alias("features"))


@query("flow_union", sql=lambda: adapters.cte("flows") + """
SELECT ts, source_file, flow_byts_s, label FROM flows WHERE source_file < 4
UNION ALL BY NAME
SELECT ts, source_file, flow_pkts_s, flow_iat_mean, label FROM flows WHERE source_file >= 4""")
def q_flow_union(spark, sf):
    """Files with different columns, aligned by name; columns a file lacks are null."""
    f = adapters.flows(spark, sf)
    a = f.where("source_file < 4").select("ts", "source_file", "flow_byts_s", "label")
    b = f.where("source_file >= 4").select("ts", "source_file", "flow_pkts_s", "flow_iat_mean", "label")
    return a.unionByName(b, allowMissingColumns=True)


@query("category_codes", sql=lambda: adapters.cte("alerts") + """,
d AS (SELECT slm_label, CAST(row_number() OVER (ORDER BY slm_label) - 1 AS DOUBLE) AS code
      FROM (SELECT DISTINCT slm_label FROM alerts WHERE slm_label IS NOT NULL)),
n AS (SELECT CAST(count(*) AS DOUBLE) AS k FROM d)
SELECT a.row_id, a.slm_label, coalesce(d.code, n.k) AS slm_label_code
FROM alerts a LEFT JOIN d ON a.slm_label = d.slm_label, n""")
def q_category_codes(spark, sf):
    """String column -> category code (alphabetical); missing values get the extra code."""
    a = adapters.alerts(spark, sf).select("row_id", "slm_label")
    out = C.category_codes(a)
    return out.select("row_id", "slm_label", "slm_label_code")


@query("category_codes_text", sql="""
WITH t AS (SELECT doc_id, text, source FROM documents),
d AS (SELECT text, CAST(row_number() OVER (ORDER BY encode(text)) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT text FROM t WHERE text IS NOT NULL)),
s AS (SELECT source, CAST(row_number() OVER (ORDER BY encode(source)) - 1 AS DOUBLE) AS code
      FROM (SELECT DISTINCT source FROM t WHERE source IS NOT NULL))
SELECT t.doc_id, coalesce(d.code, (SELECT CAST(count(*) AS DOUBLE) FROM d)) AS text_code,
  coalesce(s.code, (SELECT CAST(count(*) AS DOUBLE) FROM s)) AS source_code
FROM t LEFT JOIN d ON t.text = d.text LEFT JOIN s ON t.source = s.source""")
def q_category_codes_text(spark, sf):
    """Codes of a column with as many categories as the table has texts, and of one with few."""
    t = table(spark, sf, "documents").select("doc_id", "text", "source")
    return C.category_codes(t).select("doc_id", "text_code", "source_code")


_ = ENCODER
