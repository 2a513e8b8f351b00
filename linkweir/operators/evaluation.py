"""Evaluation of extracted URLs against ground truth.

Long tables: ``ext`` (paper_id, format, url) with formats numbered from 1, ``gt`` (paper_id, url and further columns).
``masks`` reduces both to one row a (paper, url) with a bit for each format; every score is an aggregate of it.
"""

from __future__ import annotations

from itertools import combinations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkweir.functions.scalars import trimmed

LABELS = ("TEXTWAL", "LaTeX", "HTML", "XML", "Qwen2-VL", "Markdown")


def combos(spark: SparkSession, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """All non-empty subsets, by size and order: ord, combo (bits), label, n_formats, short."""
    rows = []
    for n in range(1, len(labels) + 1):
        for c in combinations(range(len(labels)), n):
            names = [labels[i] for i in c]
            rows.append((len(rows) + 1, sum(1 << i for i in c), " + ".join(names), n, "+".join("I" if x.startswith("Qwen") else x[0] for x in names)))
    return spark.createDataFrame(rows, "ord int, combo int, label string, n_formats int, short string")


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct("*"), F.struct(order)).alias("first_row")).select("first_row.*")


def masks(ext: DataFrame, gt: DataFrame) -> DataFrame:
    """paper_id, url, mask of formats that found it, is_gt (0 or 1). One shuffle; partial aggregation before it."""
    found = ext.select("paper_id", "url", F.expr("shiftleft(1, format - 1)").alias("bit"), F.lit(0).alias("g"))
    truth = gt.select("paper_id", "url", F.lit(0).alias("bit"), F.lit(1).alias("g"))
    return found.unionByName(truth).groupBy("paper_id", "url").agg(F.bit_or("bit").alias("mask"), F.max("g").alias("is_gt"))


def per_paper_masks(m: DataFrame) -> DataFrame:
    """Number of URLs of a paper by mask and truth: at most 2 ** (formats + 1) rows a paper, whatever its URLs."""
    return m.groupBy("paper_id", "mask", "is_gt").agg(F.count("*").alias("n"))


def per_paper_combos(m: DataFrame, combo_dim: DataFrame) -> DataFrame:
    """paper_id, combo, gt, tp, ext of papers with ground truth.

    A paper's masks, a bounded number, lie in one partition before they meet the combinations; else each partition that
    has one of them would send a row a combination."""
    hit = (F.col("mask").bitwiseAND(F.col("combo")) != 0).cast("int")
    out = per_paper_masks(m).repartition("paper_id").crossJoin(F.broadcast(combo_dim.select("combo"))).groupBy("paper_id", "combo").agg(
        F.sum(F.col("is_gt") * F.col("n")).alias("gt"), F.sum(F.col("is_gt") * hit * F.col("n")).alias("tp"), F.sum(hit * F.col("n")).alias("ext")
    )
    return out.where("gt > 0")


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def prf(vectors: DataFrame, combo_dim: DataFrame, rounding: Callable[[Column], Column] = lambda x: F.round(x, 6)) -> DataFrame:
    """Precision, recall and F1 of each combination over all papers."""
    s = vectors.groupBy("combo").agg(*(F.sum(c).alias(c) for c in ("gt", "tp", "ext")))
    p, r = ratio(F.col("tp"), F.col("ext")), ratio(F.col("tp"), F.col("gt"))
    return s.join(F.broadcast(combo_dim), "combo").select("ord", "combo", "label", "n_formats", "gt", "tp", "ext", rounding(p).alias("precision"), rounding(r).alias("recall"), rounding(f1(p, r)).alias("f1"))


def labelled(gt: DataFrame) -> DataFrame:
    """Ground truth that counts: every label but GenURL; a null label counts."""
    return gt.where(~F.col("label").eqNullSafe("GenURL"))


def oads_recall(ext: DataFrame, gt: DataFrame, combo_dim: DataFrame) -> DataFrame:
    s = per_paper_combos(masks(ext, labelled(gt)), combo_dim).groupBy("combo").agg(F.sum("gt").alias("total"), F.sum("tp").alias("found"))
    r = ratio(F.col("found"), F.col("total"))
    return s.join(F.broadcast(combo_dim), "combo").select("ord", "label", "n_formats", "found", "total", F.round(r, 6).alias("recall"), F.round(100 * (1 - r), 1).alias("missing_pct"))


def availability(ext: DataFrame, gt: DataFrame, formats: int = 6) -> DataFrame:
    """A 0/1 column for each format and ground-truth URL."""
    m = masks(ext, gt).where("is_gt = 1")
    return m.select("paper_id", "url", *(F.expr(f"cast(shiftright(mask, {i}) & 1 as int)").alias(f"f{i + 1}") for i in range(formats)))


def coverage(flags: DataFrame, key: str, formats: int = 6, top: int | None = None) -> DataFrame:
    """Mean flag of each format by key, the most frequent keys first (ties by key)."""
    out = flags.groupBy(key).agg(F.count("*").alias("n"), *(F.round(F.avg(f"f{i}"), 6).alias(f"f{i}") for i in range(1, formats + 1)))
    return out.orderBy(F.desc("n"), key).limit(top) if top else out


def missed(ext: DataFrame, gt: DataFrame, formats: int = 6) -> DataFrame:
    """(format, paper_id, url) of ground truth that a format has not found."""
    m = masks(ext, gt).where("is_gt = 1")
    return m.select("paper_id", "url", F.explode(F.sequence(F.lit(1), F.lit(formats))).alias("format"), "mask").where("(shiftright(mask, format - 1) & 1) = 0").select("format", "paper_id", "url")


def characteristics(gt: DataFrame) -> DataFrame:
    """One row for each characteristic of a URL: location whole, the other dimensions split at commas."""
    one = lambda name, arr: gt.select("paper_id", "url", F.lit(name).alias("dimension"), F.explode(arr).alias("value"))
    out = gt.where(F.col("location").isNotNull()).select("paper_id", "url", F.lit("location").alias("dimension"), F.col("location").alias("value"))
    for name in ("spatial", "lexical", "representational"):
        out = out.unionByName(one(name, F.transform(F.split(name, ","), lambda x: F.trim(x))))
    return out


def failure_modes(ext: DataFrame, gt: DataFrame, formats: int = 6, top: int = 8) -> DataFrame:
    """For each format and dimension the most frequent values among missed URLs, with their share of all such URLs."""
    m = masks(ext, gt).where("is_gt = 1").select("paper_id", "url", "mask")
    c = characteristics(gt).join(m, ["paper_id", "url"])
    agg = c.groupBy("dimension", "value").agg(F.count("*").alias("n"), *(F.count(F.when(F.expr(f"(shiftright(mask, {i}) & 1) = 0"), 1)).alias(f"m{i + 1}") for i in range(formats)))
    long = agg.unpivot(["dimension", "value", "n"], [f"m{i + 1}" for i in range(formats)], "format", "missed").where("missed > 0")
    rank = F.row_number().over(W.partitionBy("format", "dimension").orderBy(F.desc("missed"), "value"))
    return long.withColumn("rank", rank).where(F.col("rank") <= top).select(F.expr("cast(substring(format, 2) as int)").alias("format"), "dimension", "value", "rank", "missed", "n", F.round(F.col("missed") / F.col("n"), 6).alias("share"))


def complexity_hits(ext: DataFrame, gt: DataFrame, formats: int = 6) -> DataFrame:
    """Totals and hits of each format of URLs split across lines and of those only in annotations."""
    m = gt.join(masks(ext, gt).where("is_gt = 1").select("paper_id", "url", "mask"), ["paper_id", "url"])
    kinds = {"split_line": F.lower("spatial").contains("split across lines"), "annotation_only": F.lower("representational").contains("hidden in annotation layers")}
    out = None
    for name, cond in kinds.items():
        one = m.where(cond).agg(F.lit(name).alias("target"), F.count("*").alias("total"), *(F.count(F.when(F.expr(f"(shiftright(mask, {i}) & 1) = 1"), 1)).alias(f"f{i + 1}") for i in range(formats)))
        out = one if out is None else out.unionByName(one)
    return out


def merge_formats(papers: DataFrame, ext: DataFrame, formats: int = 6) -> DataFrame:
    """Every paper with every format: its URLs, none where the format has none."""
    fmt = papers.sparkSession.range(1, formats + 1).select(F.col("id").cast("int").alias("format"))
    urls = ext.groupBy("paper_id", "format").agg(F.array_sort(F.collect_set("url")).alias("urls"))
    out = papers.select("paper_id").distinct().crossJoin(F.broadcast(fmt)).join(urls, ["paper_id", "format"], "left")
    empty = F.array().cast(ext.select(F.array("url").alias("u")).schema["u"].dataType)
    out = out.withColumn("urls", F.coalesce("urls", empty))
    return out.withColumn("url_count", F.size("urls"))


def superset(ext: DataFrame) -> DataFrame:
    return ext.groupBy("paper_id").agg(F.array_sort(F.collect_set("url")).alias("urls"), F.count_distinct("url").alias("url_count"))


def stage_summary(ext: DataFrame, papers: DataFrame) -> DataFrame:
    """By format: papers, papers with a URL, URLs."""
    n = papers.select(F.count_distinct("paper_id").alias("papers"))
    return ext.groupBy("format").agg(F.count_distinct("paper_id").alias("with_urls"), F.count("*").alias("urls")).crossJoin(F.broadcast(n))


def value_counts(rows: DataFrame, value: Column) -> DataFrame:
    """Counts and percentages of an array column's values; null arrays and values count for nothing."""
    out = rows.select(F.explode(value).alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("n"))
    total = out.agg(F.sum("n").alias("total"))
    return out.crossJoin(F.broadcast(total)).select("value", "n", F.round(100 * F.col("n") / F.col("total"), 4).alias("pct"))


def labelled_papers(gt: DataFrame) -> DataFrame:
    """Papers with a labelled row, and those that keep one without GenURL."""
    n = F.count_if(~F.col("label").eqNullSafe("GenURL"))
    per = gt.groupBy("paper_id").agg(n.alias("kept"))
    return per.agg(F.count("*").alias("papers"), F.count_if(F.col("kept") > 0).alias("papers_kept"))


def ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    """The rows of a report, some hundred at most, with their place in an order."""
    return rows.withColumn("place", F.row_number().over(W.orderBy(*order)))


def by_f1(scores: DataFrame) -> DataFrame:
    """Combinations, the best F1 first."""
    return ranked(scores, F.desc("f1"), "ord")


def by_size_and_recall(scores: DataFrame) -> DataFrame:
    """Combinations by number of formats, the best recall of each first."""
    return ranked(scores, "n_formats", F.desc("recall"), "ord")


def lookup(rows: DataFrame, meta: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the other columns of ``meta`` (one row a key), where the keys agree as text without white space at the ends."""
    text = lambda k: trimmed(F.col(k).cast("string"))
    own = rows.select(F.struct("*").alias("row"), *(text(k).alias(k) for k in keys))
    other = meta.select(*(text(k).alias(k) for k in keys), *(c for c in meta.columns if c not in keys))
    return own.join(other, keys).drop(*keys).select("row.*", *(c for c in meta.columns if c not in keys))


def valid_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have a value, and no blank one, in each of the columns."""
    for c in columns:
        rows = rows.where(F.col(c).isNotNull() & (trimmed(F.col(c).cast("string")) != ""))
    return rows


def recall_order(scores: DataFrame) -> DataFrame:
    """Recall of the combinations in ascending order, with the row of what the source itself has."""
    whole = scores.sparkSession.createDataFrame([("Available in PDF", 1.0)], "label string, recall double")
    return scores.select("label", "recall").unionByName(whole).orderBy("recall", "label")
