"""Queries: train and apply the binary, multi-class, baseline and text classifiers (rows-only checks).

Model weights cannot be compared with the original (different learners), so
these keys have no oracle SQL; pytest checks invariants instead (AUC above
chance on separable data, probabilities summing to 1, save / load equality, the multi-class trainer against a
booster written out on one small table). Every fit runs the trainers' own number of rounds, with early stop on the held-out rows.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from netsieve.functions import alerts as A
from netsieve.functions import domains as D
from netsieve.operators import clean as C
from netsieve.operators import labels as L
from netsieve.operators import models as MD
from netsieve.operators import sampling as SM
from netsieve.operators import stats as S
from netsieve.plans import evaluation as E
from netsieve.plans import q_examples
from netsieve.plans.registry import query
from netsieve.session import scratch_dir
from netsieve.sources import adapters


def _binary_frame(spark, sf):
    df = E.labelled_alerts(spark, sf).withColumn("y", L.binary_label("label").cast("double"))
    return SM.split_random(df, "row_id").withColumn("is_val", F.col("split") == "test")


@query("train_binary")
def q_train_binary(spark, sf):
    """Boosted trees on the binary target with early stopping on the held-out split; scored hold-out rows."""
    df = _binary_frame(spark, sf)
    model = MD.train_binary(df, "y", validation_col="is_val")
    test = df.where("is_val")
    return MD.positive_probability(model, test).select("row_id", "y", "score", "binary_pred")


def _multi_frame(spark, sf):
    df = S.with_class_weights(E.labelled_alerts(spark, sf), "label")
    return SM.split_stratified(df, "label", "row_id").withColumn("held", F.col("split") == "test")


@query("train_curve")
def q_train_curve(spark, sf):
    """Log loss and error of the multi-class trainer per round, on the training and the held-out rows."""
    return MD.train_multi(_multi_frame(spark, sf), "label", weight_col="weight", validation_col="held").curve_table(spark)


@query("train_multi")
def q_train_multi(spark, sf):
    """Softmax boosted trees with class weights on the stratified train split, early stop on the other; hold-out predictions."""
    df = _multi_frame(spark, sf)
    model = MD.train_multi(df, "label", weight_col="weight", validation_col="held")
    return MD.multi_predict(model, df.where("split = 'test'")).select("row_id", "label", "pred_label", "probs")


@query("train_baseline")
def q_train_baseline(spark, sf):
    """Random forest (100 trees) on per-file z-scores of the numeric features."""
    df = E.labelled_alerts(spark, sf).withColumn("y", L.binary_label("label").cast("double"))
    num = ["flow_byts_s", "flow_pkts_s", "flow_iat_mean", "fwd_header_len", "bwd_header_len", "rst_flag_cnt",
           "syn_flag_cnt"]
    z = S.zscore_by_file(C.finite_rows(df.select("row_id", "source_file", "y", *num)), num, "source_file")
    z = SM.split_random(z, "row_id")
    feats = [f"z_{c}" for c in num]
    model = MD.train_baseline(z.where("split = 'train'"), "y", features=feats, num_trees=100)
    out = model.transform(MD.spread(z.where("split = 'test'")))
    return out.select("row_id", "y", F.col("prediction").alias("pred"))


def _text_frame(spark, sf):
    ex = q_examples.examples(q_examples.sampled(spark, sf))
    ex = ex.withColumn("attack_label", F.col("attack_type"))
    ex = ex.select("row_id", "is_twin", "attack_type", A.prompt_classifier(F.col("attack_type")).alias("text"))
    ex = L.alert_label_id(ex, "attack_type", out="label_id")
    return ex.withColumn("label_id", F.col("label_id").cast("double"))


_ALERT_NAMES = [n for n, _ in sorted(D.ALERT_MODEL_CLASSES, key=lambda r: r[1])]


@query("train_text")
def q_train_text(spark, sf):
    """Prompt text -> alert-model class with hashed TF-IDF + multinomial logistic regression."""
    ex = _text_frame(spark, sf)
    model = MD.train_text(ex, "text", "label_id")
    return model.transform(ex).select("row_id", "is_twin", "attack_type", "label_id",
                                      F.col("prediction").alias("pred_id"))


@query("score_binary")
def q_score_binary(spark, sf):
    """Packet rows aligned to the model's features (missing -> 0) and scored; strict 0.5 threshold."""
    model = MD.train_binary(_binary_frame(spark, sf), "y", validation_col="is_val")
    pkts = C.packet_features(adapters.packets(spark, sf), "wide")
    aligned = C.align_features(pkts, MD.FEATURES, keep=["packet_id"])
    return MD.positive_probability(model, aligned).select("packet_id", "score", "binary_pred")


@query("score_multi")
def q_score_multi(spark, sf):
    """The multi-class model runs only on rows where the binary decision fired (filter before scoring)."""
    model = MD.train_multi(_multi_frame(spark, sf), "label", weight_col="weight", validation_col="held")
    fired = E.alert_rows(spark, sf).where(F.coalesce(F.col("binary_pred"), F.lit(False)))
    return MD.multi_predict(model, fired).select("row_id", "pred_label")


@query("score_text")
def q_score_text(spark, sf):
    """Text scoring of every alert record's prompt -> (label, score); empty text -> nulls."""
    model = MD.train_text(_text_frame(spark, sf), "text", "label_id")
    recs = E.alert_rows(spark, sf).select(
        "row_id", "protocol", "src_port", "dst_port",
        A.prompt_classifier(F.coalesce("attack_label", F.lit("Unknown"))).alias("text"))
    return MD.text_scores(model, recs, _ALERT_NAMES).select("row_id", "text_result.label", "text_result.score")


@query("alert_classify")
def q_alert_classify(spark, sf):
    """Prompt -> class probabilities -> arg-max class and confidence -> severity-headed alert text."""
    model = MD.train_text(_text_frame(spark, sf), "text", "label_id")
    recs = E.alert_rows(spark, sf).where("is_malicious")
    recs = recs.withColumn("text", A.prompt_classifier(F.coalesce("attack_label", F.lit("Unknown"))))
    scored = MD.text_scores(model, recs, _ALERT_NAMES)
    scored = scored.withColumn("attack_label", F.col("text_result.label"))
    out = A.add_alert_confidence(scored, F.col("text_result.score"))
    return out.select("row_id", F.col("text_result.label").alias("predicted_type"),
                      F.round("text_result.score", 6).alias("confidence"), "alert_confidence")


@query("model_roundtrip")
def q_model_roundtrip(spark, sf):
    """Fit, save to the shared checkpoint folder, load, and score with the loaded model."""
    df = _binary_frame(spark, sf)
    model = MD.train_binary(df, "y", validation_col="is_val")
    path = scratch_dir(spark, "model")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    return MD.positive_probability(loaded, df.where("is_val")).select("row_id", "y", "score", "binary_pred")
