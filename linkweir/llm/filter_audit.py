"""Audit of how filters interact: every order of five filters is replayed over every document.

Each document's failures are five bits. The documents meet a broadcast table of the 120 orders, every pair opens into five
steps, the first filter of the order that the document fails decides where it goes, and the counts of a part, order and step
are conditional sums. Those are combined in the tasks before the shuffle, which then carries at most 600 rows a part and
task, however large a part is. The texts are read once: bits, a SHA-256 of the text and the part go to a narrow table.

Copies are told by that digest: one aggregate finds the least id of each text that several ids share, and the join back
splits hot texts (adaptive skew join). Null and empty texts are the same empty text. Rows that repeat an id are each
counted; a null id is no copy, makes nobody else one, and has no label. A null source is the part ''. Of several labels of an
id, any 1 counts. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, words_column

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5
#: Fixed value: characters that no document may hold.
MARKS = "[#$%&*|]"
STEPS = range(1, len(FILTERS) + 1)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(docs: DataFrame) -> DataFrame:
    """id, part, digest of the text and ``bits``: bit i is set where the document fails filter i, of those that see one text alone."""
    t, n = F.col("t"), F.size("words").cast("long")
    step = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    step = step.withColumn("words", words_column(t))
    fails = (
        n < MIN_WORDS,
        100 * F.size(F.array_distinct("words")).cast("long") < DISTINCT_PERCENT * n,
        100 * F.regexp_count(t, F.lit("[A-Z]")).cast("long") > UPPER_PERCENT * F.char_length(t).cast("long"),
        t.rlike(MARKS),
    )
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return step.select("id", "part", F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"), bits.alias("bits"))


def mark_copies(rows: DataFrame) -> DataFrame:
    """Adds the last filter's bit: the text is also that of a smaller id."""
    shared = rows.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("digest", "least")
    copy = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    return rows.join(shared, "digest", "left").withColumn("bits", F.col("bits") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).drop("least")


def attach_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``good`` and ``toxic``. Rows without an id match nothing and are spread by their text's digest."""
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast(rows.schema["id"].dataType).alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    marks = marks.where("good or toxic").withColumn("spread", F.lit(0))
    spread = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(4096)).cast("int")).otherwise(0)
    out = rows.withColumn("spread", spread).join(marks, ["id", "spread"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}).drop("spread")


def replay(rows: DataFrame, orders: list[str] | None = None) -> DataFrame:
    """part, filter_order, step and the counts, from rows (part, bits, good, toxic), a row a document."""
    orders = orders or ["".join(p) for p in permutations(FILTERS)]
    table = rows.sparkSession.createDataFrame([(i, o, [FILTERS.index(c) for c in o]) for i, o in enumerate(orders)], "order_id int, filter_order string, filters array<int>")
    met = rows.select("part", "bits", "good", "toxic").crossJoin(F.broadcast(table.select("order_id", "filters")))
    fails = lambda place: F.getbit("bits", F.element_at("filters", place)) == 1
    first: Column = F.lit(len(FILTERS) + 1)
    for s in reversed(STEPS):
        first = F.when(fails(F.lit(s)), s).otherwise(first)
    steps = met.withColumn("first", first).select("*", F.explode(F.array(*map(F.lit, STEPS))).alias("step"))
    here = F.col("first") == F.col("step")
    conditions = (
        F.col("first") > F.col("step"),
        here,
        fails(F.col("step")) & (F.col("first") < F.col("step")),
        F.col("bits") == F.expr("shiftleft(1, element_at(filters, step))"),
        here & F.col("good"),
        here & F.col("toxic"),
    )
    counts = steps.groupBy("part", "order_id", "step").agg(*(F.count_if(c).alias(n) for n, c in zip(COUNTS, conditions)))
    named = counts.join(F.broadcast(table.select("order_id", "filter_order")), "order_id")
    return named.select("part", "filter_order", "step", *COUNTS)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, the counts and ``shapley``: what the step's filter removes in all orders together."""
    rows = attach_labels(mark_copies(materialize(failures(docs), "filter-failures")), labels)
    its_filter = W.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))  # one row an order
    return replay(rows).withColumn("shapley", F.sum("removed").over(its_filter))


def sql() -> str:
    """The same audit as DuckDB SQL."""
    word = "[^\\x20\\x09-\\x0D]+"
    orders = " || ".join(f"o{i}.x" for i in STEPS)
    unlike = " AND ".join(f"o{i}.x <> o{j}.x" for i in STEPS for j in range(1, i))
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '{word}') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(words) < {MIN_WORDS},
  100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {UPPER_PERCENT} * length(t),
  regexp_matches(t, '{MARKS}'), coalesce(w.doc_id > least, false)] AS fails FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT {orders} AS filter_order FROM {', '.join(f'x AS o{i}' for i in STEPS)} WHERE {unlike}),
m AS (SELECT part, good, toxic, fails, filter_order, coalesce(nullif(list_position(list_transform(string_split(filter_order, ''), lambda c: fails[ascii(c) - 64]), true), 0), 6) AS hit FROM f, o),
s AS (SELECT *, ascii(filter_order[step]) - 64 AS k FROM m, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
c AS (SELECT part, filter_order, step, count(*) FILTER (hit > step) AS kept, count(*) FILTER (hit = step) AS removed,
  count(*) FILTER (fails[k] AND hit < step) AS redundant, count(*) FILTER (fails[k] AND len(list_filter(fails, lambda b: b)) = 1) AS unique_fails,
  count(*) FILTER (hit = step AND good) AS good_lost, count(*) FILTER (hit = step AND toxic) AS toxic_lost FROM s GROUP BY ALL)
SELECT *, sum(removed) OVER (PARTITION BY part, filter_order[step])::BIGINT AS shapley FROM c"""
