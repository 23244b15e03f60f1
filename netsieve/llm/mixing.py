"""Op 6: mixing sources to target weights by iterative proportional fitting.

Only DataFrame operations. Documents are summed into cells (source, language,
topic); raking scales the cells' token weights to each marginal in turn; every
document is then kept with its cell's calibrated probability, decided by a hash
of its id. The cell table grows with the distinct combinations, not with the
rows, and stays distributed; the driver sees only single sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from netsieve.llm.components import durable

WORD = r"[^\x20\x09-\x0D]+"
#: Target share of a value: its tokens to this power, scaled to sum 1 (1 keeps the corpus, 0 is uniform).
TEMPERING = {"source": 0.7, "lang": 0.8, "topic": 0.9}
ROUNDS = 12
#: Expected tokens of the sample against all tokens.
SAMPLE_SHARE = 0.8
#: Cell tables up to this many rows are broadcast.
BROADCAST_CELLS = 50_000


def n_tokens(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def length_topic(tokens: Column) -> Column:
    """Stand-in topic of tables without one: the text's form by length."""
    return F.when(tokens < 100, "note").when(tokens < 1000, "article").otherwise("book")


def fit_cells(cells: DataFrame, tempering: dict[str, float], rounds: int) -> DataFrame:
    """``cells`` with a column ``weight``: tokens * weight has the target share of each value of each dimension."""
    total = cells.agg(F.sum("tokens").alias("t")).collect()[0]["t"] or 0
    for dim, power in tempering.items():
        of_value = F.sum("tokens").over(Window.partitionBy(dim))
        cells = cells.withColumn(f"_raw_{dim}", F.when(of_value > 0, F.pow(of_value, F.lit(float(power)))).otherwise(0.0))
        cells = cells.withColumn(f"_part_{dim}", F.when(of_value > 0, F.col(f"_raw_{dim}") * F.col("tokens") / of_value)
                                 .otherwise(0.0))
    cells = durable(cells)
    # Each value's raw share is spread over its cells, so that a plain sum counts it once.
    scale = cells.agg(*[F.sum(f"_part_{d}").alias(d) for d in tempering]).collect()[0]
    for dim in tempering:
        cells = cells.withColumn(f"_target_{dim}", F.col(f"_raw_{dim}") * F.lit(total / scale[dim] if scale[dim] else 0.0))
    cells = cells.withColumn("weight", F.lit(1.0))
    for r in range(rounds):
        for dim in tempering:
            mass = F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(dim))
            cells = cells.withColumn(f"_mass_{dim}", mass).withColumn(
                "weight", F.when(F.col(f"_mass_{dim}") > 0,
                                 F.col("weight") * F.col(f"_target_{dim}") / F.col(f"_mass_{dim}")).otherwise(F.col("weight")))
        if r % 4 == 3:
            cells = durable(cells)
    return durable(cells.select(*tempering, "tokens", "weight"))


def calibrate(cells: DataFrame, share: float) -> DataFrame:
    """``cells`` with ``prob`` = min(1, c * weight), c such that the expected tokens are ``share`` of all.

    Each step sets c from the cells not yet at 1; the set at 1 only grows, so the steps end.
    """
    c, full = 0.0, -1
    while True:
        at_one = F.lit(c) * F.col("weight") >= 1
        got = cells.agg(F.sum("tokens").alias("all"), F.sum(F.when(at_one, F.col("tokens")).otherwise(0)).alias("one"),
                        F.sum(F.when(at_one, 0.0).otherwise(F.col("tokens") * F.col("weight"))).alias("mass"),
                        F.sum(at_one.cast("int")).alias("n")).collect()[0]
        if not got["mass"] or got["n"] == full:
            return cells.withColumn("prob", F.least(F.lit(1.0), F.lit(c if got["mass"] else max(c, 1.0)) * F.col("weight")))
        c, full = (share * got["all"] - got["one"]) / got["mass"], got["n"]


def mix(docs: DataFrame, dims: dict[str, str | Column], id_col: str = "doc_id", text_col: str = "text",
        tempering: dict[str, float] | None = None, rounds: int = ROUNDS, share: float = SAMPLE_SHARE,
        carry: list[str] | None = None) -> DataFrame:
    """One row per input row: id, the ``carry`` columns, n_tokens, weight, prob and sampled.

    ``dims`` gives the column or expression of each marginal; an expression may use
    ``n_tokens``, which stands for the count of tokens here. A null value of a dimension is a value of its own. Null
    and empty texts have no tokens; they keep their cell's probability, and a cell without
    tokens keeps weight 1. A null id hashes like an empty one; repeated rows get one decision. Extra
    columns are not read; an empty table gives no rows.
    """
    tempering = tempering or TEMPERING
    carry = carry or []
    rows = docs.withColumn("n_tokens", n_tokens(text_col)).select(
        F.struct(id_col, *carry).alias("_row"), "n_tokens",
        *[(F.col(c) if isinstance(c, str) else c).cast("string").alias(f"_{d}") for d, c in dims.items()])
    cells = rows.groupBy(*[F.col(f"_{d}").alias(d) for d in tempering]).agg(F.sum("n_tokens").alias("tokens"))
    cells = durable(calibrate(fit_cells(durable(cells), tempering, rounds), share))
    few = cells.count() <= BROADCAST_CELLS
    cells = cells.select(
        *[F.col(d).alias(f"c_{d}") for d in tempering], "weight", "prob")
    on = F.lit(True)
    for d in tempering:
        on = on & F.col(f"_{d}").eqNullSafe(F.col(f"c_{d}"))
    drawn = F.conv(F.substring(F.md5(F.coalesce(F.col(f"_row.{id_col}").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double")
    return rows.join(F.broadcast(cells) if few else cells, on, "left").select("_row.*", "n_tokens", "weight", "prob",
                                               (drawn / float(1 << 32) < F.col("prob")).alias("sampled"))
