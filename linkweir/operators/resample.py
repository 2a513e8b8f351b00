"""Sampling and resampling."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkweir.sources.scratch import written

from . import ranking
from .bottom import least
from .ranking import places


def allocate(counts: DataFrame, target: int, strata: str = "year", part: str = "month") -> DataFrame:
    """Seats of each part of a stratum: proportional, rounded down, the rest by largest remainder (ties by part).

    A stratum not above the target keeps everything."""
    total = F.sum("n").over(W.partitionBy(strata))
    exact = F.col("n") * target  # in units of 1 / total, so that all is integer
    base = counts.withColumn("total", total).withColumn("floor", F.floor(exact / F.col("total"))).withColumn("rest", exact - F.col("floor") * F.col("total"))
    base = base.withColumn("deficit", F.lit(target) - F.sum("floor").over(W.partitionBy(strata))).withColumn("place", F.row_number().over(W.partitionBy(strata).orderBy(F.desc("rest"), part)))
    seats = F.when(F.col("total") <= target, F.col("n")).otherwise(F.col("floor") + (F.col("place") <= F.col("deficit")).cast("int"))
    return base.select(strata, part, "n", seats.cast("long").alias("seats"))


def stratified(rows: DataFrame, target: int, order: Column, key: str = "paper_id", strata: str = "year", part: str = "month") -> DataFrame:
    """``target`` rows of each stratum, drawn in the given order inside each part."""
    counts = rows.groupBy(strata, part).agg(F.count("*").alias("n"))
    seats = allocate(counts, target, strata, part).select(F.col(strata).alias("_strata"), F.col(part).alias("_part_of"), F.col("seats").alias("_seats"))
    # one row a part of a stratum: Spark broadcasts it where it is small
    same = F.col(strata).eqNullSafe(F.col("_strata")) & F.col(part).eqNullSafe(F.col("_part_of"))
    drawn = rows.withColumn("_order", order).join(seats, same).drop("_strata", "_part_of")
    return least(drawn, [strata, part], ["_order", key], "_seats").drop("_order", "_seats", "nth")


COLUMN_GAP, SINGLE_MAX, DOUBLE_MAX, ETD_MIN, SCANNED_CHARS, MIN_SIDE = 50, 20, 15, 30, 50, 5


def column_layout(blocks: Column) -> Column:
    """"double" if rounded left edges of blocks that are not tiny leave a gap, else "single"."""
    wide = F.filter(blocks, lambda b: (b["x1"] - b["x0"] > MIN_SIDE) & (b["y1"] - b["y0"] > MIN_SIDE))
    x = F.array_sort(F.array_distinct(F.transform(wide, lambda b: F.bround(b["x0"]).cast("int"))))
    gaps = F.exists(F.arrays_zip(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))).alias("a"), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))).alias("b")), lambda p: p["b"] - p["a"] > COLUMN_GAP)
    return F.when(gaps, "double").otherwise("single")


def layout_class(n_chars: Column, n_images: Column, layout: Column, n_pages: Column) -> Column:
    """scanned, etd, single_column, double_column or null."""
    return (
        F.when((n_chars < SCANNED_CHARS) & (n_images > 0), "scanned")
        .when((layout == "single") & (n_pages >= ETD_MIN), "etd")
        .when((layout == "single") & (n_pages <= SINGLE_MAX), "single_column")
        .when((layout == "double") & (n_pages <= DOUBLE_MAX), "double_column")
    )


def quota_sample(rows: DataFrame, quotas: dict[str, int], order: Column, key: str = "paper_id") -> DataFrame:
    """Rows of each year up to each category's quota in the given order, and whether the year's log would reach them.

    Reading stops where the last quota is filled; a year in which one is not filled is read whole."""
    table = rows.sparkSession.createDataFrame(list(quotas.items()), "category string, quota long")
    ordered = written(rows.select("year", key, "category", order.alias("_order")), "quota-rows")
    nth = least(ordered.join(F.broadcast(table), "category"), ["year", "category"], ["_order", key], "quota")
    at = F.struct("_order", key)
    # one row a year and category: whether its quota is filled, and by which row
    filled = nth.groupBy("year", "category").agg(F.max(at).alias("_last"), (F.max("nth") == F.max("quota")).alias("_filled"))
    filled = written(filled, "quota-filled")
    stops = filled.where("_filled").groupBy("year").agg(F.count("*").alias("_n"), F.max("_last").alias("_stop")).where(F.col("_n") == len(quotas)).select("year", "_stop")
    read = ordered.join(stops, "year", "left").where(F.col("_stop").isNull() | (at <= F.col("_stop")))
    marked = read.join(filled, ["year", "category"], "left")
    selected = F.coalesce(F.col("_last").isNotNull() & (~F.col("_filled") | (at <= F.col("_last"))), F.lit(False))
    placed = places(marked.select("year", key, "category", "_order", selected.alias("selected")), ["year"], [F.col("_order"), F.col(key)])
    return placed.select("year", key, "category", (F.col("place") + 1).alias("place"), "selected")


def hashed_place(papers: Column, *key: Column | str) -> Column:
    """A place below ``papers`` that any engine with md5 repeats: the first 60 bits of the key's md5, modulo ``papers``."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", *key).cast("binary")), 1, 15), 16, 10).cast("long"), papers)


def hashed_draws(spark: SparkSession, reps: int, slots: int, papers: int) -> DataFrame:
    """(rep, slot, place): a draw with replacement, each slot of each replicate on its own."""
    d = spark.range(slots).select(F.col("id").alias("slot")).crossJoin(spark.range(reps).select(F.col("id").alias("rep")))
    return d.select("rep", "slot", hashed_place(F.lit(papers), "rep", "slot").alias("place"))


def bootstrap_by_join(vectors: DataFrame, reps: int, draws: Callable[[SparkSession, int, int, int], DataFrame] = hashed_draws, population: DataFrame | None = None) -> DataFrame:
    """rep, combo, tp, ext, gt of resampled papers, by a join with multiplicities; papers are numbered in id order.

    Papers are drawn from the ``population`` (default: those of the vectors); one without a vector adds nothing. The
    vectors are written once, as their table is far smaller than the shuffles that make it."""
    vectors = written(vectors.select("paper_id", "combo", "gt", "tp", "ext"), "vectors")
    ids = (vectors if population is None else population).select("paper_id").distinct()
    numbers = ranking.numbered(ids, [F.col("paper_id")], "number").select("paper_id", (F.col("number") - 1).alias("place"))
    n = numbers.count()
    mult = draws(vectors.sparkSession, reps, n, max(n, 1)).repartition("place").groupBy("rep", "place").agg(F.count("*").alias("m"))
    drawn = numbers.join(mult, "place").select("paper_id", "rep", "m")
    return vectors.join(drawn, "paper_id").groupBy("rep", "combo").agg(*(F.sum(F.col(c) * F.col("m")).alias(c) for c in ("gt", "tp", "ext")))


def bootstrap_by_blocks(vectors: DataFrame, reps: int, seed: int = 42, papers: int = 4096, population: DataFrame | None = None, chunk: int = 250, together: int = 4) -> DataFrame:
    """The same with numpy's generator, in blocks of about ``papers`` papers that each meet all replicates in one task.

    How many of a replicate's draws fall into a block is found by halving the range of blocks with binomial draws whose
    seeds belong to the halves, so that all tasks agree and each replicate draws as many papers as the population has.
    The driver holds one number a block; papers and their metrics stay where they are. The vectors are written once, and
    ``together`` blocks are one task's, which holds one of them and the sums of all, so that it sends a row a replicate
    and combination, not one for each block."""
    vectors = written(vectors.select("paper_id", "combo", "gt", "tp", "ext"), "vectors")
    ids = (vectors if population is None else population).select("paper_id").distinct()
    ids = ids if population is None else written(ids, "population")
    blocks = max(1, -(-ids.count() // papers))
    block = F.pmod(F.xxhash64("paper_id"), F.lit(blocks)).cast("int").alias("block")
    sizes = np.zeros(blocks, np.int64)
    for r in ids.groupBy(block).agg(F.count("*").alias("n")).collect():
        sizes[r["block"]] = r["n"]

    def drawn(of: int) -> np.ndarray:
        lo, hi, n = 0, blocks, np.full(reps, sizes.sum())
        while hi - lo > 1:
            mid = (lo + hi) // 2
            total = sizes[lo:hi].sum()
            left = np.random.default_rng([seed, 0, lo, hi]).binomial(n, sizes[lo:mid].sum() / total if total else 0)
            lo, hi, n = (lo, mid, left) if of < mid else (mid, hi, n - left)
        return n

    def resampled(of: int, rows: pd.DataFrame) -> tuple[list[int], np.ndarray]:
        """Combinations of a block, and gt, tp and ext of each in each replicate."""
        wide = rows.pivot(index="paper_id", columns="combo", values=["gt", "tp", "ext"]).fillna(0).sort_index()
        matrix, names = wide.to_numpy(float), sorted(set(rows["combo"]))
        at = [[wide.columns.get_loc((k, c)) for c in names] for k in ("gt", "tp", "ext")]
        size, draws, rng = int(sizes[of]), drawn(of), np.random.default_rng([seed, 1, of])
        sums = np.zeros((3, reps, len(names)), np.int64)
        for first in range(0, reps, chunk):
            n = draws[first : first + chunk]
            cells = np.repeat(np.arange(len(n)), n) * size + rng.integers(0, size, n.sum())
            mult = np.bincount(cells, minlength=len(n) * size).reshape(len(n), size)[:, : len(matrix)]
            got = mult.astype(float) @ matrix
            for k in range(3):
                sums[k, first : first + len(n)] = got[:, at[k]]
        return names, sums

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for of, rows in _runs(batches, "block"):
            names, got = resampled(of, rows)
            for i, c in enumerate(names):
                sums[c] = sums[c] + got[:, :, i] if c in sums else got[:, :, i].copy()
        for c, (gt, tp, ext) in sums.items():
            yield pa.RecordBatch.from_pydict({"rep": np.arange(reps), "combo": np.full(reps, c, np.int32), "gt": gt, "tp": tp, "ext": ext})

    near = vectors.select("paper_id", "combo", "gt", "tp", "ext", block).withColumn("of", F.floor(F.col("block") / together).cast("int"))
    dealt = near.repartitionByRange(max(1, -(-blocks // together)), "of").sortWithinPartitions("block")
    found = dealt.drop("of").mapInArrow(run, "rep long, combo int, gt long, tp long, ext long")
    return found.groupBy("rep", "combo").agg(*(F.sum(c).alias(c) for c in ("gt", "tp", "ext")))


def _runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[int, pd.DataFrame]]:
    """Each value of an integer column and its rows, which lie together; one value's rows are held."""
    held, of = [], None
    for b in batches:
        values = b.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1), len(values)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                if held and values[lo] != of:
                    yield of, pa.Table.from_batches(held).to_pandas()
                    held = []
                of = int(values[lo])
                held.append(b.slice(lo, hi - lo))
    if held:
        yield of, pa.Table.from_batches(held).to_pandas()


def intervals(reps: DataFrame) -> DataFrame:
    """2.5 and 97.5 percent points of precision, recall and F1 by combination."""
    from .evaluation import f1, ratio

    p, r = ratio(F.col("tp"), F.col("ext")), ratio(F.col("tp"), F.col("gt"))
    out = reps.select("combo", p.alias("p"), r.alias("r"), f1(p, r).alias("f"))
    bounds = lambda c: [F.round(F.percentile(c, q), 6).alias(f"{c}_{n}") for q, n in ((0.025, "low"), (0.975, "high"))]
    return out.groupBy("combo").agg(*(x for c in "prf" for x in bounds(c)))
