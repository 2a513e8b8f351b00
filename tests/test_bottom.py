"""First rows of strata, kept by each task and merged, against plain Python."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from linkweir.operators import bottom
from linkweir.operators import resample as R


def data(n):
    rng = random.Random(8)
    return [(rng.choice([None, "a", "b", "c"]), rng.choice([None, 1, 2]), rng.choice([None, rng.random()]), i) for i in range(n)]


def test_least_against_sorting_for_any_number_of_rows_held(spark, monkeypatch):
    monkeypatch.setattr(bottom, "HELD", 50)
    rows = data(4000)
    k = lambda s, p: {None: 0, "a": 3, "b": 40, "c": 10_000}[s] + (p or 0)
    table = spark.createDataFrame([(*r, k(r[0], r[1])) for r in rows], "s string, p int, v double, i int, k long").repartition(7)
    groups = defaultdict(list)
    for r in rows:
        groups[r[:2]].append(r)
    want = set()
    for (s, p), g in groups.items():
        g.sort(key=lambda r: (r[2] is not None, r[2] or 0, r[3]))
        want |= {(*r, n) for n, r in enumerate(g[: k(s, p)], 1)}
    assert {(r["s"], r["p"], r["v"], r["i"], r["nth"]) for r in bottom.least(table, ["s", "p"], ["v", "i"], "k").collect()} == want
    assert bottom.least(table.limit(0), ["s"], ["i"], "k").count() == 0


def test_a_task_gives_no_more_than_k_rows_a_stratum(spark):
    table = spark.range(100_000, numPartitions=5).selectExpr("id % 3 AS s", "hash(id) AS v", "id AS i", "4L AS k")
    kept = bottom._keep(table, ["s"], ["v", "i"], "k")
    assert kept.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 12
    assert kept.count() <= 5 * 3 * 4


def test_quota_sample_stops_where_the_last_quota_is_filled(spark):
    rng = random.Random(9)
    rows = [(y, i, rng.choice(["x", "y", None, "z"])) for y in (1, 2, 3) for i in range(y * 1000, y * 1000 + (300 if y < 3 else 9))]
    quotas = {"x": 5, "y": 20}
    got = R.quota_sample(spark.createDataFrame(rows, "year int, paper_id int, category string"), quotas, F.hash("paper_id"))
    order = {r["paper_id"]: (r["h"], r["paper_id"]) for r in spark.createDataFrame(rows, "year int, paper_id int, category string").select("paper_id", F.hash("paper_id").alias("h")).collect()}
    want = set()
    for y in (1, 2, 3):
        log, left = [], dict(quotas)
        for _, i, c in sorted((r for r in rows if r[0] == y), key=lambda r: order[r[1]]):
            chosen = left.get(c, 0) > 0
            if chosen:
                left[c] -= 1
            log.append((y, i, c, len(log) + 1, chosen))
            if not any(left.values()):
                break
        want |= set(log)
    assert {tuple(r) for r in got.collect()} == want


def test_stratified_takes_parts_without_a_name_too(spark):
    rows = spark.createDataFrame([(1, None if i % 2 else 5, i) for i in range(100)], "year int, month int, paper_id int")
    got = R.stratified(rows, 10, F.col("paper_id"))
    assert sorted(r["paper_id"] for r in got.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert got.columns == ["year", "month", "paper_id"]
