"""Corpora by year: merged pools, reports, yearly bootstrap. Long tables (year, paper_id, format, num_urls)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import places
from .resample import hashed_place


def common_pool(stages: DataFrame, formats: int = 5) -> DataFrame:
    """Rows of the papers that every format has, of one year each: one aggregate instead of a chain of joins."""
    full = stages.groupBy("year", "paper_id").agg(F.count_distinct("format").alias("k")).where(F.col("k") == formats).select("year", "paper_id")
    return stages.join(full, ["year", "paper_id"], "left_semi")


def common_ids(stages: DataFrame, formats: int = 5) -> DataFrame:
    return common_pool(stages, formats).select("year", "paper_id").distinct()


def year_report(stages: DataFrame) -> DataFrame:
    """Papers and URLs by year and format, with totals (nulls) on either side."""
    return stages.cube("year", "format").agg(F.count_distinct("paper_id").alias("papers"), F.sum("num_urls").alias("urls"))


#: Fixed order of the statuses of a conversion; others come last.
STATUSES = ("success", "failed", "pending", "corrupted_json")


def in_status_order(runs: DataFrame, key: str, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """The runs with ``status_place``, sorted by it and by the key."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, statuses)), F.col("status")), F.lit(0))
    return runs.withColumn("status_place", F.when(place > 0, place - 1).otherwise(len(statuses)).cast("int")).orderBy("status_place", key)


def conversions_by_year(done: DataFrame, started: str, now: str) -> DataFrame:
    """Papers done by year and in all (null), with papers a minute since the start; null before it."""
    minutes = (F.unix_timestamp(F.lit(now)) - F.unix_timestamp(F.lit(started))) / 60
    rate = F.when(minutes > 0, F.round(F.count("*") / minutes, 1)).when(minutes == 0, F.lit(0.0))
    return done.rollup("year").agg(F.count("*").alias("papers"), rate.alias("papers_a_minute"))


def status_report(runs: DataFrame, pool: int) -> DataFrame:
    """Runs by status with their share of the pool."""
    return runs.groupBy("status").agg(F.count("*").alias("n"), F.round(100 * F.count("*") / pool, 4).alias("pct"))


def wide_totals(stages: DataFrame, formats: int = 5) -> DataFrame:
    return stages.groupBy("year", "paper_id").pivot("format", list(range(1, formats + 1))).agg(F.sum("num_urls")).na.fill(0)


def yearly_bootstrap(pool: DataFrame, reps: int, size: int) -> DataFrame:
    """(year, rep, format, urls): sums over ``size`` papers of a year drawn with replacement."""
    ids = places(pool.select("year", "paper_id").distinct(), ["year"], [F.col("paper_id")]).withColumnRenamed("place_of", "n")
    years = ids.select("year", "n").distinct()
    slots = years.select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("slot"))
    place = hashed_place(F.col("n"), "year", "rep", "slot")
    draws = slots.select("year", "rep", place.alias("place")).groupBy("year", "rep", "place").agg(F.count("*").alias("m"))
    sums = pool.groupBy("year", "paper_id", "format").agg(F.sum("num_urls").alias("u")).join(ids.select("year", "paper_id", "place"), ["year", "paper_id"])
    return sums.join(draws, ["year", "place"]).groupBy("year", "rep", "format").agg(F.sum(F.col("u") * F.col("m")).alias("urls"))


def trend(reps: DataFrame) -> DataFrame:
    """Mean and quartiles of the replicates by year and format."""
    q = [F.round(F.percentile("urls", x), 6).alias(n) for x, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return reps.groupBy("year", "format").agg(F.round(F.avg("urls"), 6).alias("mean"), *q)


def box_plot(reps: DataFrame, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers and outliers of the replicates by year and format.

    Whiskers are the extreme values within ``reach`` times the interquartile range of the quartiles; what lies beyond is an
    outlier, counted, with the least and the greatest. Two aggregates and a join of one row a group between them."""
    by = ["year", "format"]
    q = reps.groupBy(*by).agg(*(F.percentile("urls", x).alias(n) for x, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))))
    u, spread = F.col("urls"), reach * (F.col("q3") - F.col("q1"))
    inside = u.between(F.col("q1") - spread, F.col("q3") + spread)
    out = reps.join(q, by).groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, u)).alias("whisker_low"), F.max(F.when(inside, u)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"), F.min(F.when(~inside, u)).alias("least_outlier"), F.max(F.when(~inside, u)).alias("greatest_outlier"),
    )
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


def of_years(rows: DataFrame, folder: str, first: int = 1992, last: int = 2024) -> DataFrame:
    """Rows whose folder is a year of four digits in the range, with it as ``year``."""
    ok = F.col(folder).rlike(r"^\d{4}$")
    return rows.where(ok).withColumn("year", F.col(folder).try_cast("int")).where(F.col("year").between(first, last))


def reindex(rows: DataFrame, key: str, order: list, value: str) -> DataFrame:
    """The values of the keys in ``order``, 0 where there is none; other keys go."""
    dim = rows.sparkSession.createDataFrame([(i, k) for i, k in enumerate(order)], f"ord int, {key} {rows.schema[key].dataType.simpleString()}")
    return dim.join(rows.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(0))).select("ord", key, value)


def sampled_and_done(sample: DataFrame, done: DataFrame) -> DataFrame:
    """Sampled papers that a tracker names for the same year."""
    return sample.join(done.select("year", "paper_id"), ["year", "paper_id"], "left_semi")


def sampler_totals(log: DataFrame) -> DataFrame:
    """Rows read, selected and without a class, by year and category, with totals (nulls)."""
    return log.cube("year", "category").agg(F.count("*").alias("processed"), F.count_if("selected").alias("selected"), F.count_if(F.col("category").isNull()).alias("unmatched"), F.grouping_id().alias("level"))
