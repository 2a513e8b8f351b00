"""Rank statistics over (paper_id, combo, recall)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType

from linkweir.sources.scratch import written

from .ranking import average_ranks


def average_rank(partition: list[str], order: str) -> Column:
    """Rank with ties sharing the mean of their places, for groups of bounded size; ``ranking.average_ranks`` is for others."""
    return F.rank().over(W.partitionBy(*partition).orderBy(order)) + (F.count("*").over(W.partitionBy(*partition, order)) - 1) / 2


def mean_ranks(scores: DataFrame) -> DataFrame:
    return scores.withColumn("r", average_rank(["paper_id"], "recall")).groupBy("combo").agg(F.round(F.avg("r"), 6).alias("mean_rank"))


def friedman(scores: DataFrame, k: int) -> DataFrame:
    """n, k, chi2 (corrected for ties) and df; only papers with all k scores count."""
    full = scores.withColumn("c", F.count("recall").over(W.partitionBy("paper_id"))).where(F.col("c") == k)
    r = full.withColumn("r", average_rank(["paper_id"], "recall"))
    ties = r.groupBy("paper_id", "recall").agg(F.count("*").alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    sums = r.groupBy("combo").agg(F.sum("r").alias("s"), F.count("*").alias("n")).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"))
    one = sums.crossJoin(ties)
    n = F.col("n")
    raw = 12 / (k * n * (k + 1)) * F.col("ss") - 3 * n * (k + 1)
    return one.select(n, F.lit(k).alias("k"), F.try_divide(raw, 1 - F.col("ties") / (k * (k * k - 1) * n)).alias("chi2"), F.lit(k - 1).alias("df"))


@F.pandas_udf(DoubleType())
def chi2_sf5(x: pd.Series) -> pd.Series:
    """Upper tail of the chi-squared distribution with five degrees of freedom."""
    return x.map(lambda v: None if v is None or math.isnan(v) else math.erfc(math.sqrt(v / 2)) + math.sqrt(2 * v / math.pi) * math.exp(-v / 2) * (1 + v / 3))


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2)))


def signed_ranks(scores: DataFrame, baseline: int) -> DataFrame:
    """Differences of every combination to the baseline on the same paper, zeros dropped, with average ranks."""
    base = scores.where(F.col("combo") == baseline).select("paper_id", F.col("recall").alias("base"))
    d = scores.where(F.col("combo") != baseline).join(base, "paper_id").select("combo", "paper_id", (F.col("recall") - F.col("base")).alias("diff"))
    d = d.withColumn("a", F.round(F.abs("diff"), 12)).where("a > 0")
    return average_ranks(written(d, "differences"), ["combo"], "a")


def wilcoxon(scores: DataFrame, baseline: int) -> DataFrame:
    """combo, n, z (normal approximation, corrected for ties, without continuity correction) and the rank-biserial effect."""
    r = signed_ranks(scores, baseline)
    up, down = (F.sum(F.when(sign, F.col("r")).otherwise(0)) for sign in (F.col("diff") > 0, F.col("diff") < 0))
    n, t = F.col("n"), F.col("ties").cast("double")
    # each of the t rows of a tie carries its share of t ** 3 - t
    s = r.groupBy("combo").agg(F.count("*").alias("n"), up.alias("up"), down.alias("down"), F.sum(t * t - 1).alias("ties"))
    sd = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    out = s.select("combo", n, ((F.least("up", "down") - n * (n + 1) / 4) / sd).alias("z"), ((F.col("up") - F.col("down")) / (F.col("up") + F.col("down"))).alias("effect"))
    rest = scores.where(F.col("combo") != baseline).select("combo").distinct().join(out.select("combo"), "combo", "left_anti")
    return out.unionByName(rest.select("combo", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("z"), F.lit(0.0).alias("effect")))


def holm(tests: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Adjusted p and the verdict of the step-down procedure; null p stays null and is no test.

    One window over all tests: their number is that of the combinations."""
    some = tests.where(F.col(p).isNotNull())
    w = W.orderBy(p, "combo")
    scaled = some.select(F.struct("*").alias("test"), F.col(p).alias("p"), F.col("combo").alias("combo"), (F.col(p) * (F.count("*").over(W.partitionBy()) - F.row_number().over(w) + 1)).alias("scaled"))
    some = scaled.select("test.*", F.least(F.lit(1.0), F.max("scaled").over(W.orderBy("p", "combo").rowsBetween(W.unboundedPreceding, 0))).alias("holm_p"))
    none = tests.where(F.col(p).isNull()).withColumn("holm_p", F.lit(None).cast("double"))
    return some.unionByName(none).withColumn("significant", F.coalesce(F.col("holm_p") <= alpha, F.lit(False)))
