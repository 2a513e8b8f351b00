"""Filter audit, importance resampling and byte-level BPE against plain Python and the tokenizer's library."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from linkweir.llm import byte_bpe, filter_audit, importance_resampling, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string, t string, ids string, rank string, bits string, part string"
MULTI, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def docs_of(spark, rows):
    """(id, text, source) with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, None, s, None, "x", "y", "z", "i", "r", "b", "p") for i, t, s in rows], DOCS)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Übung", "漢字", "THE", "a#b", "x.y-z", "don't"]
    out = [(1, None, "s"), (2, "", "s"), (3, " \n\t ", None), (4, "One", ""), (None, "same text here", "t"), (None, None, None), (9, "z" * 30_000, "long"), (10, " ".join(rng.choices(words, k=20_000)), "long")]
    for i in range(20, 20 + n):
        text = " ".join(rng.choices(words[: rng.randint(3, len(words))], k=rng.randint(1, 120)))
        out.append((i, text, rng.choice(["s", "t", None, "hot", "hot"])))
    out += [(i + 1000, t, "hot") for i, t, _ in out[20:40]] + [(21, out[-1][1], "t"), (22, out[-2][1], "s"), (22, out[-2][1], "s")]
    return out


LABELS = "doc_id long, quality int, toxic int, lang string"


# 11


def brute_audit(docs, labels):
    good, toxic = ({i for i, q, t, _ in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    counts = defaultdict(lambda: dict.fromkeys(filter_audit.COUNTS, 0))
    for i, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i,
        }
        for order in itertools.permutations("ABCDE"):
            hit = next((n for n, f in enumerate(order, 1) if fails[f]), 6)
            for n, f in enumerate(order, 1):
                c = counts[s or "", "".join(order), n]
                c["kept"] += hit > n
                c["removed"] += hit == n
                c["redundant"] += fails[f] and hit < n
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                c["good_lost"] += hit == n and i in good
                c["toxic_lost"] += hit == n and i in toxic
    shapley = Counter()
    for (s, order, n), c in counts.items():
        shapley[s, order[n - 1]] += c["removed"]
    return {(*k, *c.values(), shapley[k[0], k[1][k[2] - 1]]) for k, c in counts.items()}


def test_audit_against_brute_force_and_sql(spark):
    docs = corpus(1, 150)
    labels = [(i, i % 2, int(i % 5 == 0), "x") for i in range(0, 1100, 3)] + [(30, None, None, None), (None, 1, 1, "x"), (33, 1, 1, "x"), (33, 0, None, "x")]
    table = docs_of(spark, docs)
    marks = spark.createDataFrame(labels, LABELS)
    got = filter_audit.audit(table, marks)
    columns = ["part", "filter_order", "step", *filter_audit.COUNTS, "shapley"]
    rows = {tuple(r[c] for c in columns) for r in got.collect()}
    assert rows == brute_audit(docs, labels)
    con = duckdb.connect()
    con.register("documents", table.toPandas())
    con.register("labels", marks.toPandas())
    con.execute("create view documents2 as select * replace (doc_id::bigint as doc_id) from documents")
    want = con.execute(filter_audit.sql().replace("FROM documents)", "FROM documents2)")).df()
    assert {tuple(r) for r in want[columns].itertuples(index=False, name=None)} == rows


def test_audit_of_nothing_and_without_labels(spark):
    nothing = docs_of(spark, [])
    assert filter_audit.audit(nothing, spark.createDataFrame([], LABELS)).count() == 0
    got = filter_audit.audit(docs_of(spark, [(1, "a", "s"), (2, "a", "s")]), spark.createDataFrame([], LABELS))
    assert got.count() == 600 and got.agg(F.max("good_lost")).first()[0] == 0
    first = {r["filter_order"]: (r["removed"], r["kept"]) for r in got.where("step = 1").collect()}
    assert first["EABCD"] == (1, 1) and first["ABCDE"] == (2, 0)


def test_audit_replays_given_orders_and_its_shuffle_is_small(spark):
    rows = spark.range(5000).select(F.lit("p").alias("part"), (F.col("id") % 32).cast("int").alias("bits"), F.lit(True).alias("good"), F.lit(False).alias("toxic"))
    got = {r["step"]: r for r in filter_audit.replay(rows, ["EDCBA"]).collect()}
    assert len(got) == 5 and got[1]["removed"] == sum((i % 32) >> 4 for i in range(5000))
    plan = filter_audit.replay(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning") < plan.index("partial_count_if" if "partial_count_if" in plan else "partial_count")
    assert "Python" not in plan and "Arrow" not in plan


# 12


def brute_resample(docs, target, percent, min_words, buckets, longest=2):
    def words(t):
        lower = (t or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)

    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x, _ in docs for b in features(x)), Counter(b for x in target for b in features(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets))))
    out = []
    for i, x, _ in docs:
        f = features(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, len(words(x))])
    can = sorted((r for r in out if r[3] is not None and r[5] >= min_words), key=lambda r: (-r[3], r[0]))
    for n, r in enumerate(can[: percent * len(can) // 100], 1):
        r[4] = n
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: [-1 if x is None else x for x in r])


@pytest.mark.parametrize("longest,block", [(2, 2_000_000), (2, 500), (1, 300), (3, 1000)])
def test_resampling_against_brute_force_for_any_block(spark, monkeypatch, longest, block):
    monkeypatch.setattr(importance_resampling, "BLOCK", block)
    monkeypatch.setattr(importance_resampling, "DICTIONARY", block)
    docs, target = corpus(2, 120), ["w1 w2 w3 W1 w2", None, "漢字 don't", "", "w5 " * 50]
    items = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, score string")
    got = importance_resampling.resample(docs_of(spark, docs), items, longest=longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = brute_resample(docs, target, 25, 20, 10_000, longest)
    assert in_order(tuple(r) for r in got.collect()) == in_order(tuple(r[:5]) for r in want)


def test_resampling_of_nothing_and_towards_nothing(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert importance_resampling.resample(docs_of(spark, []), items).count() == 0
    docs = [(i, "word " * i, "s") for i in range(40)]
    got = importance_resampling.resample(docs_of(spark, docs), items, columns=["doc_id", "text", "score"])
    assert got.columns == ["doc_id", "text", "n_features", "weight", "score", "rank"]
    want = {r[0]: tuple(r[1:5]) for r in brute_resample(docs, [], 25, 20, 10_000)}
    assert {r["doc_id"]: tuple(r)[2:] for r in got.collect()} == want
    assert sorted(r["rank"] for r in got.where("rank is not null").collect()) == [1, 2, 3, 4, 5]


def test_tuples_are_hashed_once_a_block(monkeypatch):
    calls = Counter()
    crc = zlib.crc32
    monkeypatch.setattr(importance_resampling.zlib, "crc32", lambda data, start=0: (calls.update([(bytes(data), start)]), crc(data, start))[1])
    words = [b"a", b"b", b"c"]
    ids = np.array([0, 1] * 500 + [2], np.int64)
    found = list(importance_resampling.feature_buckets(ids, np.array([1001]), words, 2, 1 << 32))
    assert [len(bucket) for bucket, _, _ in found] == [3, 3]  # a, b, c; a b, b a, b c
    assert set(found[1][0].tolist()) == {crc(x) for x in (b"a b", b"b a", b"b c")}
    assert max(calls.values()) == 1


# 13


BITS = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "漢", "字", "1", "23", "'s", "'", "'ll", "!", "?", "\xa0", "\x1f", "՘", "౜", "\U00011de0", "aaaa", "    ", "<|endoftext|>", "ing", "tion", "ß", "שלום", "नमस्ते", "🙂", "\x85", "　"]


def odd_texts(seed, n):
    rng = random.Random(seed)
    out = ["".join(rng.choices(BITS, k=rng.randint(0, 40))) for _ in range(n)]
    return out + ["a" * 3000, " " * 2000 + "x", "ab" * 2000 + " ", "the quick  brown \n\n fox\t ", " ", ""]


def test_encoding_is_the_librarys():
    enc = byte_bpe.Encoder(MULTI, PATTERN)
    texts = odd_texts(3, 3000)
    for t, got in zip(texts, enc.encode(texts)):
        ids = np.frombuffer(got, np.int32).tolist()
        assert ids == LIBRARY.encode_ordinary(t), t
        assert enc.vocabulary.decode(ids) == t.encode()


def test_memories_that_start_anew_change_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 20)
    enc = byte_bpe.Encoder(MULTI, PATTERN)
    for t in odd_texts(4, 300):
        assert np.frombuffer(enc.encode([t])[0], np.int32).tolist() == LIBRARY.encode_ordinary(t)


def test_each_prefix_has_one_last_token_that_holds():
    v, rng = byte_bpe.vocabulary(MULTI), random.Random(5)
    for _ in range(300):
        piece = "".join(rng.choices(BITS, k=rng.randint(1, 6))).encode()
        last = v.prefix_table(piece)
        for i in range(1, len(piece) + 1):
            fit = [RANKS[piece[j:i]] for j in range(i) if piece[j:i] in RANKS and (j == 0 or v.seam_holds(last[j], RANKS[piece[j:i]]))]
            assert fit == [last[i]]


def test_appends_and_edits_equal_encoding_anew():
    rng = random.Random(6)
    for _ in range(250):
        e = byte_bpe.Encoded(MULTI, PATTERN, "".join(rng.choices(BITS, k=rng.randint(0, 25))))
        for _ in range(6):
            i = rng.randint(0, len(e.text))
            j = rng.choice([i, rng.randint(i, min(len(e.text), i + 6))])
            e.replace(i, j, "".join(rng.choices(BITS, k=rng.randint(0, 4))))
            e.append(rng.choice(["", "x", " "]))
            assert e.ids() == LIBRARY.encode_ordinary(e.text)


def test_an_edit_touches_few_pieces_and_few_entries(monkeypatch):
    e = byte_bpe.Encoded(MULTI, PATTERN, "some words in a row " * 2000)
    assert e.replace(20_000, 20_001, "q") <= 8
    long = byte_bpe.Encoded(MULTI, PATTERN, "ab" * 5000)
    asked, real = Counter(), byte_bpe.Vocabulary.last_token
    monkeypatch.setattr(byte_bpe.Vocabulary, "last_token", lambda self, piece, i, last: (asked.update(n=1), real(self, piece, i, last))[1])
    long.replace(4000, 4001, "q")
    assert asked["n"] < 200
    assert long.ids() == LIBRARY.encode_ordinary(long.text)


def test_vocabularies_that_merges_do_not_reach_are_refused():
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256}
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary(ranks).halves(256)


def test_encode_and_decode_rows(spark):
    rows = [(i, t, "s") for i, t in enumerate(odd_texts(7, 60))] + [(None, "a text", None), (5, "again", "s"), (5, "again", "s"), (900, None, None), (901, "x y  z " * 20_000, "s")]
    docs = docs_of(spark, rows).repartition(5)
    got = sorted((tuple(r) for r in byte_bpe.encode_and_decode(docs, MULTI, PATTERN).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    both = byte_bpe.decode(byte_bpe.encode(docs, MULTI, PATTERN, ["doc_id", "text", "ids"]), MULTI)
    assert both.columns == ["doc_id", "text", "ids", "decoded"]
    assert both.where(F.decode("decoded", "UTF-8") != F.coalesce("text", F.lit(""))).count() == 0
    assert sorted((tuple(r) for r in byte_bpe.round_trip(docs, MULTI, PATTERN, ["doc_id", "text", "ids"]).collect()), key=repr) == sorted((tuple(r) for r in both.collect()), key=repr)
    assert byte_bpe.encode_and_decode(docs.limit(0), MULTI, PATTERN).count() == 0
    assert byte_bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), MULTI).where("decoded <> x''").count() == 0


def test_queries_take_their_whole_tables(spark, sf):
    for name in ("op12_importance_resampling", "op13_byte_bpe"):
        assert queries.queries()[name](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
