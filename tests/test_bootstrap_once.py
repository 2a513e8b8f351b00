"""What the bootstrap reads and shuffles: its vectors are made once, and no table of masks by combinations is sent."""

import pytest
from pyspark.sql import functions as F

from linkweir.operators import evaluation as E
from linkweir.operators import resample as R


def counted(spark, papers, combos):
    """Vectors of a number of papers, and an accumulator of how many rows were made so far."""
    made = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(papers).crossJoin(spark.range(1, combos + 1).select(F.col("id").cast("int").alias("combo")))
    rows = rows.select(F.col("id").alias("paper_id"), "combo", F.lit(1).alias("gt"), (F.col("id") % 2).alias("tp"), F.col("id").alias("ext"))
    return rows.mapInArrow(tell, "paper_id long, combo int, gt int, tp long, ext long"), made


@pytest.mark.parametrize("form", ["join", "blocks"])
def test_vectors_are_made_once(spark, form):
    v, made = counted(spark, 90, 2)
    got = R.bootstrap_by_join(v, 5) if form == "join" else R.bootstrap_by_blocks(v, 5, papers=9)
    assert {(r["rep"], r["combo"]): r["gt"] for r in got.collect()} == {(r, c): 90 for r in range(5) for c in (1, 2)}
    assert made.value == 180


def test_masks_meet_combinations_where_their_paper_lies(spark):
    masks = spark.range(400).select((F.col("id") % 3).alias("paper_id"), F.col("id").alias("url"), (F.col("id") % 64).cast("int").alias("mask"), (F.col("id") % 2).cast("int").alias("is_gt"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = E.per_paper_combos(masks, E.combos(spark))
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "hashpartitioning(paper_id" in plan and not any("hashpartitioning" in x and "combo" in x for x in plan.splitlines())
    want = {}
    for i in range(400):
        for c in range(1, 64):
            gt, tp, ext = want.get((i % 3, c), (0, 0, 0))
            hit = int(i % 64 & c > 0)
            want[i % 3, c] = gt + i % 2, tp + (i % 2) * hit, ext + hit
    assert {(r["paper_id"], r["combo"]): (r["gt"], r["tp"], r["ext"]) for r in got.collect()} == want


def test_blocks_are_the_same_however_many_a_task_has(spark):
    v, _ = counted(spark, 300, 3)
    rows = lambda n: sorted(map(tuple, R.bootstrap_by_blocks(v, 40, papers=9, chunk=7, together=n).collect()))
    assert rows(1) == rows(5) == rows(100) and len(rows(2)) == 120


def test_masks_of_papers_need_no_first_row_and_no_distinct_rows(spark, sf):
    from linkweir.plans import catalog
    from linkweir.plans.fixtures import load

    c, v = catalog._combo_vectors(spark, sf)
    assert "first_row" not in v._jdf.queryExecution().optimizedPlan().toString()
    want = E.per_paper_combos(E.masks(load(spark, sf, "ext"), catalog._gt(spark, sf)), c)
    assert v.exceptAll(want).count() == want.exceptAll(v).count() == 0 < want.count()
