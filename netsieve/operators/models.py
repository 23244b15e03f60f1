"""Classifiers with MLlib: training, scoring, text scoring, save / load.

Training inputs are persisted (memory and disk) around the iterative fit and
released after it; tree learners aggregate binned histograms on the executors,
so the work scales with the data. Scoring is ``transform`` — narrow, per
partition, no shuffle. A user text scorer plugs in as an Arrow-batched
``pandas_udf`` (one model load per Python worker), never a per-row UDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import HashingTF, IDF, Tokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsieve.functions import detect as X
from netsieve.operators import boosting as B
from netsieve.session import checkpoint_root

FEATURES = ["protocol", "src_port", "dst_port", "flow_byts_s", "flow_pkts_s", "flow_iat_mean", "fwd_header_len",
            "bwd_header_len", "rst_flag_cnt", "syn_flag_cnt", "tot_fwd_pkts", "tot_bwd_pkts"]


#: The deepest trees that MLlib grows; the original does not limit depth.
MAX_DEPTH = 30
#: Rows that are worth a task of their own in a fit.
TASK_ROWS = 10_000


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def _fit(pipeline: Pipeline, df: DataFrame) -> PipelineModel:
    """Fit with the input persisted (memory and disk; a lost executor recomputes its part)."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return pipeline.fit(df)
    finally:
        df.unpersist()


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over the session's cores where a small file left them in fewer partitions, ``TASK_ROWS`` a task at least."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    here = df.rdd.getNumPartitions()
    wanted = min(cores, df.count() // TASK_ROWS) if here < cores else here
    return df.repartition(wanted) if wanted > here else df


def train_binary(df: DataFrame, label: str = "y", features: list[str] | None = None, max_iter: int = 100,
                 validation_col: str | None = None) -> PipelineModel:
    """Boosted trees: step 0.1, depth 6, 256 bins, at most ``max_iter`` rounds; early stop on a validation flag."""
    gbt = GBTClassifier(labelCol=label, featuresCol="features", stepSize=0.1, maxDepth=6, maxBins=256,
                        maxIter=max_iter, seed=42)
    if validation_col:
        gbt.setValidationIndicatorCol(validation_col)
    return _fit(Pipeline(stages=[_assembler(features or FEATURES), gbt]), df)


def train_multi(df: DataFrame, label: str = "label", features: list[str] | None = None, max_iter: int = 100,
                weight_col: str | None = None, validation_col: str | None = None, key: str = "row_id") -> B.SoftmaxModel:
    """Softmax boosted trees (``boosting``): step 0.1, depth 6, row and feature sampling 0.8, optional class weights; early
    stop after 10 rounds without a lower error on the rows flagged by ``validation_col``, best round kept."""
    return B.train(df, label, features or FEATURES, key, validation_col, weight_col, max_iter)


def train_baseline(df: DataFrame, label: str = "y", features: list[str] | None = None,
                   num_trees: int = 100) -> PipelineModel:
    """Random forest of ``num_trees`` trees (seed 42).

    Trees this deep take many passes; the node that a row has reached in each tree is kept between them (checkpointed where a
    checkpoint folder is set), so no pass walks the trees from their roots.
    """
    rf = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=num_trees, maxDepth=MAX_DEPTH, seed=42, cacheNodeIds=True)
    checkpoint_root(df.sparkSession)
    return _fit(Pipeline(stages=[_assembler(features or FEATURES), rf]), spread(df))


def train_text(df: DataFrame, text: str = "text", label: str = "label_id", num_features: int = 1 << 16,
               max_iter: int = 50) -> PipelineModel:
    """Prompt text -> attack type: tokens, hashed term frequencies, IDF, multinomial logistic regression."""
    stages = [Tokenizer(inputCol=text, outputCol="_tokens"),
              HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
              IDF(inputCol="_tf", outputCol="_tfidf"),
              LogisticRegression(featuresCol="_tfidf", labelCol=label, family="multinomial", maxIter=max_iter)]
    return _fit(Pipeline(stages=stages), df)


def positive_probability(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Binary scoring: probability of class 1 and the strict-threshold decision."""
    out = model.transform(df)
    p1 = vector_to_array("probability")[1]
    return out.withColumn("score", p1).withColumn("binary_pred", X.binary_decision("score", threshold)).drop(
        "features", "rawPrediction", "probability", "prediction")


def multi_predict(model: B.SoftmaxModel, df: DataFrame) -> DataFrame:
    """Multi-class scoring: class probabilities, first arg-max, and its name."""
    return B.predict(model, df)


def text_scores(model: PipelineModel, df: DataFrame, label_names: list[str] | None = None) -> DataFrame:
    """Text model scoring -> struct(label, score); empty text -> nulls (as the original returns nothing)."""
    out = model.transform(df)
    prob = vector_to_array("probability")
    idx = X.argmax(prob)
    name = (F.element_at(F.array(*[F.lit(n) for n in label_names]), idx + 1) if label_names
            else idx.cast("string"))
    empty = F.col("text").isNull() | (F.length("text") == 0)
    res = F.when(empty, F.lit(None)).otherwise(F.struct(name.alias("label"), F.array_max(prob).alias("score")))
    return out.withColumn("text_result", res).drop("_tokens", "_tf", "_tfidf", "rawPrediction", "probability",
                                                   "prediction")


def pandas_text_scorer(score_batch: Callable, returns: str = "label string, score double"):
    """Wrap a user scorer ``pandas.Series[str] -> pandas.DataFrame(label, score)`` as an Arrow pandas UDF.

    Spark evaluates it per Arrow batch; the scorer should load its model once
    per worker (module-level cache), not per call.
    """
    from pyspark.sql.functions import pandas_udf

    return pandas_udf(score_batch, returnType=T._parse_datatype_string(returns))
