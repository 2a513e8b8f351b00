"""Numbers, places and ranks that no task makes for a whole group, against plain Python."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from linkweir.operators import ranking, stats


def test_numbers_follow_the_order_over_all_ranges(spark):
    values = random.Random(1).sample(range(10_000), 3000)
    rows = spark.createDataFrame([(v, v % 7) for v in values], "v int, g int").repartition(9)
    got = {r["v"]: r["place"] for r in ranking.numbered(rows, [F.col("g").desc(), F.col("v")], parts=13).collect()}
    want = {v: i + 1 for i, v in enumerate(sorted(values, key=lambda v: (-(v % 7), v)))}
    assert got == want
    assert ranking.numbered(rows.limit(0), [F.col("v")]).count() == 0


def test_places_start_anew_for_each_key_and_null_is_a_key(spark):
    rng = random.Random(2)
    data = [(rng.choice([None, "a", "b", "c"]), i) for i in range(2000)]
    rows = spark.createDataFrame(data, "k string, i int")
    groups = defaultdict(list)
    for k, i in data:
        groups[k].append(i)
    want = {(k, i, n, len(ids)) for k, ids in groups.items() for n, i in enumerate(sorted(ids))}
    assert {(r["k"], r["i"], r["place"], r["place_of"]) for r in ranking.places(rows, ["k"], [F.col("i")], parts=11).collect()} == want


def test_average_ranks_share_places_whatever_the_ranges(spark):
    rng = random.Random(3)
    data = [(rng.choice("xy"), 0.5 if rng.random() < 0.4 else round(rng.random(), 2), i) for i in range(3000)]
    rows = spark.createDataFrame(data, "k string, v double, i int")
    groups = defaultdict(list)
    for k, v, _ in data:
        groups[k].append(v)
    got = ranking.average_ranks(rows, ["k"], "v", parts=17).collect()
    assert len(got) == len(data)
    for r in got:
        g = groups[r["k"]]
        assert r["ties"] == g.count(r["v"])
        assert r["r"] == sum(x < r["v"] for x in g) + (r["ties"] + 1) / 2
    whole = {r["i"]: r["r"] for r in ranking.average_ranks(rows, [], "v").collect()}
    every = sorted(v for _, v, _ in data)
    assert all(whole[i] == every.index(v) + (every.count(v) + 1) / 2 for _, v, i in data[:200])
    assert ranking.average_ranks(rows.limit(0), ["k"], "v").count() == 0


def test_signed_ranks_have_no_window_over_a_combination(spark):
    rng = random.Random(4)
    scores = spark.createDataFrame([(p, c, rng.choice([0.0, 0.25, 0.5, 1.0])) for p in range(200) for c in (1, 2, 63)], "paper_id int, combo int, recall double")
    ranks = stats.signed_ranks(scores, 63)
    plan = ranks._jdf.queryExecution().executedPlan().toString()
    assert not any("Window" in line and "_range" not in line for line in plan.splitlines())
    assert ranks.count() == sum(1 for r in scores.groupBy("paper_id").pivot("combo").max("recall").collect() for c in ("1", "2") if r[c] != r["63"])
