"""Connected components of an edge table: smallest reachable node, by label spreading and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netsieve.session import checkpoint_root, scratch_dir


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; the shuffle files behind it go when it is written.

    Smaller than a checkpoint (columns are compressed), for intermediate tables that grow with the text.
    """
    spark, setting = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, path = spark.conf.get(setting, "false"), scratch_dir(spark, tag)
    spark.conf.set(setting, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once all that was computed from them is written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected graph ``edges(a, b)`` of longs; component is its smallest node.

    Each round gives every node the smallest label among itself and its
    neighbours and then the label of that label, so chains shorten by more than
    half; rounds end when no label changes. Labels and edges stay distributed:
    a hub's neighbours meet in a combinable minimum, never in a list. Rows with a
    null end and loops only name their node. Empty input gives no rows.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = durable(both.where("a is not null and b is not null").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label"))
    labels = durable(labels)
    while True:
        near = (both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near")))
        spread = (labels.join(near, F.col("node") == F.col("a"))
                  .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        spread = durable(spread)
        up = spread.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        jumped = durable(spread.join(up, F.col("label") == F.col("up"))
                         .select("node", "old", F.least("label", "up_label").alias("label")))
        changed = jumped.where("label != old").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
