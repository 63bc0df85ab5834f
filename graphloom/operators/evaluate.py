"""Evaluation: percentiles, samples, accuracy against known callers, answer size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import cut


def _ranked(df: DataFrame, order: list) -> DataFrame:
    """nth from 0 in the given order and the number of rows n.

    Rows are ranked within ranges of the order and shifted by the sizes of the
    ranges before, so no task sorts all rows.
    """
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    within = cut(parts.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1), "ranked")
    sizes = within.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")
    sizes = sizes.select("_part", before.alias("_before"), F.sum("_size").over(Window.partitionBy()).alias("n"))
    return within.join(sizes, "_part").withColumn("nth", F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def percentile_floor(df: DataFrame, value: str, percents: tuple[int, ...]) -> DataFrame:
    """(p, value): the element at place floor(p * n / 100) from 0, the last one at most; no rows give no rows."""
    ranked = _ranked(df.select(value), [value])
    out = ranked.select("nth", "n", F.col(value), F.explode(F.array(*[F.lit(p) for p in percents])).alias("p"))
    return out.where(F.col("nth") == F.least(F.col("n") - 1, F.floor(F.col("p") * F.col("n") / 100))).select("p", value)


def mean_or_zero(value: Column | str) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def systematic_sample(df: DataFrame, order: list, k: int) -> DataFrame:
    """Elements floor(i * n / k) for i below k; all rows if there are no more than k."""
    ranked = _ranked(df, order)
    i = F.ceil(F.col("nth") * k / F.col("n"))
    hit = (F.col("n") <= k) | ((i < k) & (F.floor(i * F.col("n") / k) == F.col("nth")))
    return ranked.where(hit).drop("nth", "n")


def stride_sample(df: DataFrame, order: list, step: int, k: int) -> DataFrame:
    """Every step-th row, the first k of them."""
    return _ranked(df, order).where((F.col("nth") % step == 0) & (F.col("nth") < step * k)).drop("nth", "n")


def accuracy(truth: DataFrame, answer: DataFrame) -> DataFrame:
    """(def, file) pairs -> precision, recall and f1 for each definition that has a true caller.

    A definition without an answer has precision 0.
    """
    t, a = truth.select("def", "file").distinct().withColumn("t", F.lit(1)), answer.select("def", "file").distinct().withColumn("a", F.lit(1))
    sums = t.join(a, ["def", "file"], "full").groupBy("def").agg(F.count("t").alias("n_true"), F.count("a").alias("n_answer"), F.count(F.when(F.col("t").isNotNull() & F.col("a").isNotNull(), 1)).alias("n_both"))
    p = F.when(F.col("n_answer") == 0, 0.0).otherwise(F.col("n_both") / F.col("n_answer"))
    r = F.col("n_both") / F.col("n_true")
    out = sums.where("n_true > 0").select("def", p.alias("precision"), r.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return out.withColumn("f1", f1)


def macro_average(per_definition: DataFrame) -> DataFrame:
    return per_definition.agg(F.count("*").alias("definitions"), *[mean_or_zero(c).alias(c) for c in ("precision", "recall", "f1")])


def token_efficiency(answers: DataFrame) -> DataFrame:
    """(answer_tokens, file_tokens) per query -> totals, how much smaller answers are than whole files (percent), and the median factor."""
    ratio = F.when(F.col("answer_tokens") > 0, F.col("file_tokens") / F.col("answer_tokens"))
    middle = percentile_floor(answers.select(ratio.alias("factor")).where("factor is not null"), "factor", (50,))
    part = answers.select(F.lit(1).alias("q"), "answer_tokens", "file_tokens", F.lit(None).cast("double").alias("factor"))
    part = part.union(middle.select(F.lit(0), F.lit(0), F.lit(0), "factor"))
    totals = part.agg(
        F.coalesce(F.sum("q"), F.lit(0)).alias("queries"), F.coalesce(F.sum("answer_tokens"), F.lit(0)).alias("answer_tokens"), F.coalesce(F.sum("file_tokens"), F.lit(0)).alias("file_tokens"), F.coalesce(F.max("factor"), F.lit(0.0)).alias("median_factor")
    )
    saved = F.when(F.col("file_tokens") == 0, 0.0).otherwise(100.0 * (1 - F.col("answer_tokens") / F.col("file_tokens")))
    return totals.withColumn("reduction_percent", saved)


def read_truth(spark, path: str) -> DataFrame:
    """A JSON list of {name, callerFiles} -> (def, file); definitions without callers have none."""
    rows = spark.read.schema("name string, callerFiles array<string>").option("multiLine", True).json(path)
    return rows.select(F.col("name").alias("def"), F.explode("callerFiles").alias("file"))


def format_bytes(n: int) -> str:
    """B up to 1000, then whole KB, then MB with one digit."""
    return f"{n / 1e6:.1f} MB" if n > 1e6 else f"{int(n / 1e3 + 0.5)} KB" if n > 1e3 else f"{n} B"
