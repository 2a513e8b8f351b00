"""Corpus operators against brute force, round trips and held-out labels, with nulls, blanks, ties and odd columns."""

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
from pyspark.sql import functions as F

import corpus_pipeline
from linkweir.llm import common, decontamination, graph, jaccard_join, lm_scoring, packing, quality_classifier, quality_rules, queries, token_counts, token_file, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string, t string"
BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def docs_of(spark, texts):
    """Rows with nulls and columns whose names clash with results."""
    return spark.createDataFrame([(i, t, None, "s", None, "x", "y", "z") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(2)
    words = [rng.choice("the of and to in x y #% Ünder naïve 漢字 <s>".split()) for _ in range(4000)]
    long = " ".join(words)
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d e f g h i j k l"), (6, "a b c d e f g h i j k l"), (6, "a b c d e f g h i j k l"), (7, long), (8, long + " tail"), (None, "a b c d e f g h i j k l"), (9, "A\x0bb\x0cC\r\nd  e   f\x1fg\xa0h\n\n"), (10, "x" * 50_000)]
    return docs_of(spark, texts), texts


def empty(spark):
    return docs_of(spark, [])


def words(text):
    return (text or "").encode().lower().split()


# 1


def brute_distance(p, t):
    row = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        new = [i]
        for j in range(1, len(t) + 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p[i - 1] != t[j - 1])))
        row = new
    return min(row)


def test_myers_and_pigeonhole_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        p, t = ("".join(rng.choices("ab ", k=rng.randint(1, 30))) for _ in range(2))
        bits = defaultdict(int)
        for i, c in enumerate(p):
            bits[c] |= 1 << i
        assert decontamination.myers(bits, len(p), t, 0, len(t))[0] == brute_distance(p, t)
    items = [(k, "".join(rng.choices("abcde ", k=rng.randint(1, 60)))) for k in range(30)]
    m = decontamination.Matcher(tuple(items), 6)
    for _ in range(60):
        text = "".join(rng.choices("abcde ", k=80))
        k, item = rng.choice(items)
        edited = list(decontamination.normal(item))
        for _ in range(rng.randint(0, 6)):
            if edited:
                edited[rng.randrange(len(edited))] = rng.choice(["", "a", "bc"])
        text = text + "".join(edited) + text[::-1]
        want = {}
        for i, x in items:
            x = decontamination.normal(x)
            if x and (d := brute_distance(x, decontamination.normal(text))) <= len(x) // 6:
                want[i] = d
        assert {i: d for i, d, _, _ in m.find(text)} == want


def test_leaks_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "A  B c d e f g h i j k l"), (None, "one")], "item_id long, text string")
    for chars in (5, 10**6):
        got = Counter((r["doc_id"], r["item_id"], r["distance"]) for r in decontamination.find_leaks(odd[0], bench, block_chars=chars).collect())
        assert got == Counter({(5, 3, 0): 1, (6, 3, 0): 2, (None, 3, 0): 1, (4, None, 0): 1})
    kept = decontamination.remove_leaking(odd[0], bench)
    assert kept.columns == odd[0].columns and kept.count() == len(odd[1]) - 5
    assert decontamination.find_leaks(empty(spark), bench).count() == 0


# 2 and 9


def test_word_vectors_do_not_depend_on_the_number_of_tasks(spark):
    docs = docs_of(spark, [(i, f"one two{i % 7} three {i % 5}") for i in range(300)])
    one, many = (quality_classifier.word_vectors(docs.repartition(n)) for n in (1, 130))
    assert np.abs(one).sum() > 0 and np.array_equal(one, many)


@pytest.mark.parametrize(("module", "label", "mod", "rest", "least"), [(toxicity, "toxic", 3, 1, 0.95), (quality_classifier, "quality", 5, 0, 0.95)])
def test_classifiers(spark, module, label, mod, rest, least):
    d = "/root/testdata/sf0.1"
    docs, labels = (common.read_table(spark, d, t) for t in ("documents", "labels"))
    got = module.classify(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert set(held.doc_id) == {i for i in got.doc_id if zlib.crc32(str(i).encode()) % mod == rest}
    assert (held.predicted == held[label]).mean() > least
    assert got.score.between(0, 1).all()


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality_classifier, "quality")])
def test_classifiers_on_odd_rows(spark, odd, module, label):
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    got = module.classify(odd[0], none).collect()
    assert len(got) == len(odd[1]) and all(r["score"] == 0.5 and r["held_out"] is not None for r in got)
    some = spark.createDataFrame([(i, i % 2) for i in (4, 5, 6, 7, 8, 9, 10)] + [(None, 1), (5, None)], f"doc_id long, {label} int")
    assert len(module.classify(odd[0], some).collect()) == len(odd[1])
    assert module.classify(empty(spark), some).count() == 0


def test_long_texts_are_read_in_overlapping_pieces(monkeypatch):
    text = "some toxic words in a long text " * 20 + "w" * 300
    vectors = np.random.default_rng(1).normal(size=(1 << 14, 32)).astype(np.float32)
    want = [set(np.concatenate(list(toxicity.bucket_runs(text))).tolist()), quality_classifier.pool(text, vectors)]
    monkeypatch.setattr(toxicity, "PIECE", 50)
    monkeypatch.setattr(quality_classifier, "PIECE", 50)
    assert set(np.concatenate(list(toxicity.bucket_runs(text))).tolist()) == want[0]
    assert np.allclose(quality_classifier.pool(text, vectors), want[1])


def test_toxicity_against_brute_force(spark, monkeypatch):
    """Counts of documents with each n-gram, ratios, choice of features and scores of a plain version with sets of n-grams."""
    rng = random.Random(13)
    texts = [(i, " ".join(rng.choices("lorem ipsum dolor sit amet Élan".split(), k=12)) + " vile rubbish" * (i % 4 == 0)) for i in range(480)]
    labels = [(i, int(i % 4 == 0)) for i, _ in texts]
    docs, table = docs_of(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")

    def grams(text):
        flat = " " + " ".join(text.lower().split()) + " "
        return {flat[i : i + n] for n in toxicity.SIZES for i in range(len(flat) - n + 1)}

    train = [(grams(t), y) for (i, t), (_, y) in zip(texts, labels) if zlib.crc32(str(i).encode()) % 3 != 1]
    count = {y: Counter(g for s, v in train if v == y for g in s) for y in (0, 1)}
    n = Counter(y for _, y in train)
    ratio = {}
    for g in count[0].keys() | count[1].keys():
        p, q = count[1][g] + 1, count[0][g] + 1
        r = math.log(p / (n[1] + 2)) - math.log(q / (n[0] + 2))
        if abs(r) / math.sqrt(1 / p + 1 / q) >= toxicity.MIN_Z:
            ratio[g] = r
    keys, beta, bias = toxicity.fit(docs, table, "toxic", 3, 1)
    assert ratio and len(keys) == len(ratio)
    by_key = {int(toxicity._hashes(np.array(list(map(ord, g)), np.uint32))[-1][0]): g for g in ratio}
    weight = {by_key[k]: b for k, b in zip(keys.tolist(), beta)}
    assert all((weight[g] > 0) == (ratio[g] > 0) for g in ratio)
    got = {r["doc_id"]: r for r in toxicity.classify(docs, table).collect()}
    for i, t in texts:
        z = bias + sum(weight[g] for g in grams(t) & weight.keys())
        assert math.isclose(got[i]["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-9) and got[i]["predicted"] == int(got[i]["score"] >= 0.7) == int(i % 4 == 0)


def test_word_vectors_and_pooling_against_brute_force(spark):
    texts = [(i, t) for i, t in enumerate(["one two, three!", "two  two 12 \n one", None, "", "naïve words"])]
    places, signs = quality_classifier._index_vectors()
    bucket = lambda w: int(quality_classifier.word_buckets(np.frombuffer(w, np.uint8))[0])
    lists = [[bucket(w) for w in re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[,]+|[!]+", (t or "").encode())] for _, t in texts]
    v = np.zeros((1 << 14, quality_classifier.DIM))
    for ws in lists:
        for i, j in itertools.permutations(range(len(ws)), 2):
            if abs(i - j) <= quality_classifier.REACH:
                np.add.at(v[ws[i]], places[ws[j]], signs[ws[j]])
    v = np.sign(v) * np.log1p(np.abs(v))
    used = np.abs(v).sum(1) > 0
    v[used] -= v[used].mean(0)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    got = quality_classifier.word_vectors(docs_of(spark, texts))
    assert np.allclose(got, v, atol=1e-5)
    for (_, t), ws in zip(texts, lists):
        want = np.concatenate([sum((v[w] for w in ws), np.zeros(32)), sum((v[a] * v[b] for a, b in zip(ws, ws[1:])), np.zeros(32))]) / max(1, len(ws))
        assert np.allclose(quality_classifier.pool(t, got), want, atol=1e-5)


def test_ids_that_are_text_and_clashing_columns(spark):
    docs = spark.createDataFrame([("a", "some words here", "x"), ("b", "other words there", "y"), (None, None, "z")], "doc_id string, text string, n_tokens string")
    labels = spark.createDataFrame([("a", 1, 1), ("b", 0, 0)], "doc_id string, toxic int, quality int")
    bench = spark.createDataFrame([("q", "some words here"), (None, None)], "item_id string, text string")
    assert [tuple(r)[:2] for r in decontamination.find_leaks(docs, bench).collect()] == [("a", "q")]
    for module in (toxicity, quality_classifier):
        assert {r["doc_id"] for r in module.classify(docs, labels).collect()} == {"a", "b", None}
    assert token_counts.count_tokens(docs, PIECE_BPE, columns=["doc_id", "n_tokens"]).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(docs, 3, 90, 100).collect()} == {("a", "a"), ("b", "b"), (None, None)}


def test_clean_texts_of_millions_of_characters_stay_clean(spark):
    docs, labels = (common.read_table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, "toxic", 3, 1)
    held = docs.join(labels, "doc_id").where(common.is_held_out("doc_id", 3, 1) & F.col("text").isNotNull())
    scored = toxicity.score(held, model, ["doc_id", "toxic"]).join(docs.select("doc_id", "text"), "doc_id").toPandas().sort_values("doc_id")
    clean, toxic = (scored[(scored.toxic == y) & ((scored.score >= 0.7) == y)].text.tolist() for y in (0, 1))
    half = " ".join(clean * 3)[:1_000_000]
    long = [half + " " + " ".join(clean[k:] + clean[:k])[:1_000_000] for k in (0, 200)] + [f"{half} {' '.join(toxic)} {half}"]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string"), model).collect()}
    assert got[0] < 0.7 and got[1] < 0.7 and got[2] >= 0.7


# 3 and 7


def test_token_file_round_trip(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTE_BPE)
    rows = token_file.encode_and_read(odd[0], BYTE_BPE).collect()
    want, start = [], 0
    for i, t in sorted(odd[1], key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(rows, key=lambda r: r["start"]) == want
    assert token_file.encode_and_read(empty(spark), BYTE_BPE).count() == 0


def test_elias_fano_select():
    rng = np.random.default_rng(3)
    for high in (1, 2, 300, 9000):
        sizes = rng.integers(0, high, 1500)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        parts = token_file.elias_fano(starts, int(sizes.sum()))
        b = token_file.EliasFano(*parts)
        assert (b.select_run(0, 1500) == starts).all()
        assert all(b.select(i) == starts[i] for i in range(1500))
        for i, j in ((0, 1), (255, 257), (256, 512), (1499, 1500), (300, 1400)):
            assert (b.select_run(i, j) == starts[i:j]).all()
        assert sum(p.nbytes for p in parts[1:]) * 8 / 1500 < 2 + math.log2(max(2, sizes.sum() / 1500)) + 1.5


def test_token_files_of_far_and_repeated_ids(tmp_path):
    ids = [-(2**63), -(2**63), -5, 0, 0, 7, 2**63 - 1]
    tokens = [np.arange(n, dtype=np.uint16).tobytes() for n in (3, 0, 2, 4, 1, 0, 9, 5, 6)]
    with open(tmp_path / "f", "wb") as out:
        token_file.dump(out, np.array(ids), 2, np.array([len(t) // 2 for t in tokens]), tokens, 2)
    t = token_file.TokenFile((tmp_path / "f").read_bytes())
    assert t.doc_ids(0, 9).to_pylist() == [None, None, *ids] and t.doc_ids(1, 4).to_pylist() == [None, *ids[:2]]
    assert [t.tokens(i).tobytes() for i in range(9)] == tokens


def test_token_files_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(None if i % 3 else i // 2, f"some words {i}") for i in range(200)], "doc_id long, text string")
    monkeypatch.setattr(token_file, "FILE_BYTES", 100)
    manifest = token_file.write(docs, BYTE_BPE, common.fresh_path(spark, "bounded"))
    assert manifest.count() > 5
    rows = token_file.read(spark, manifest).orderBy("start").collect()
    assert len(rows) == 200 and [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda x: (x is not None, x or 0))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))


def test_counts_and_ids_equal_the_libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    sp, tok = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE), Tokenizer.from_file(BYTE_BPE)
    rng = random.Random(4)
    texts = ["".join(rng.choices(" \t\n  aeThe'st12é漢😀▁<s>|\xa0.,!\x0b", k=rng.randint(0, 40))) for _ in range(4000)]
    texts += ["<|endoftext|> a <|endoftext|>", "   ", "a" * 3000, " ".join(["naïve.", "straße,", "ÉTÉ", "ªb", "x1,"] * 9)]
    assert token_counts.MergeCounter(PIECE_BPE).count_all(texts) == [len(x) for x in sp.encode(texts)]
    assert token_file.Encoder(BYTE_BPE).encode(texts) == [np.array(e.ids, np.uint16).tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_of_odd_rows(spark, odd):
    got = token_counts.count_tokens(odd[0], PIECE_BPE, limit=100).collect()
    assert len(got) == len(odd[1])
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == 0 and by[7]["over_limit"] and by[10]["n_bytes"] == 50_000


# 4


def test_quality_rules_equal_sql(spark, odd):
    con = duckdb.connect()
    rows = [r for r in odd[1] if r[0] != 6 and r[0] is not None]
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = con.execute(quality_rules.sql()).df().sort_values("doc_id").reset_index(drop=True)
    got = quality_rules.score_rules(docs_of(spark, rows)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert list(got.columns) == list(want.columns) and (got.astype(str) == want.astype(str)).all().all()
    assert quality_rules.score_rules(odd[0]).count() == len(odd[1]) and quality_rules.score_rules(empty(spark)).count() == 0


def test_one_stop_word_does_not_save_a_long_text(spark):
    junk = " ".join(f"zq{i}x" for i in range(2000))
    prose = " ".join(f"The zq{i}x of" for i in range(200))
    got = {r["doc_id"]: r for r in quality_rules.score_rules(docs_of(spark, [(1, junk + " the"), (2, prose)])).collect()}
    assert (got[1]["kept"], got[1]["permille_stop_words"]) == (False, 0) and (got[2]["kept"], got[2]["permille_stop_words"]) == (True, 666)


def test_repeated_windows_against_brute_force(spark):
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choices("ab", k=rng.randint(0, 40)))) for i in range(80)]
    for r in quality_rules.score_rules(docs_of(spark, texts)).collect():
        w = texts[r["doc_id"]][1].split()
        count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        assert r["n_repeat_words"] == len({i + j for i in range(len(w) - 4) for j in range(5) if count[tuple(w[i : i + 5])] > 1})


# 5


def test_loser_tree():
    rng = random.Random(7)
    for k in (0, 1, 2, 5, 33):
        runs = [sorted(rng.choices(range(50), k=rng.randint(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: (x,))) == sorted(itertools.chain(*runs))


def test_warc(spark, monkeypatch):
    pages = [(1, "http://b.org/x", "same"), (2, "http://a.org/é y", "same"), (3, None, None), (4, "http://a.org", ""), (5, "http://b.org/x", "other\r\n\r\nü"), (None, "http://c.org", "same"), (6, "http://b.org/x", "same"), (6, "http://b.org/x", "same")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    got = warc.archive_and_read(frame).collect()
    keeper = {"same": 6, "": 4, "other\r\n\r\nü": 5}
    want = Counter()
    for i, _, h in pages:
        raw, k = (h or "").encode(), keeper[h or ""]
        want[(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == k else "revisit", None if i == k else k)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    monkeypatch.setattr(warc, "FAN_IN", 2)
    path = common.fresh_path(spark, "warc-test")
    index = warc.merge(spark, path, warc.write(frame, path)).orderBy("shard", "seq").collect()
    order = [(r["url_key"], r["ts"], -1 if r["page_id"] is None else r["page_id"]) for r in index]
    assert len(order) == len(pages) and order == sorted(order)
    assert warc.archive_and_read(frame.limit(0)).count() == 0


# 6


def brute_components(texts, k, num, den):
    sets = defaultdict(list)
    for i, t in texts:
        w = words(t)
        sets[i].append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(sorted(sets), 2):
        if any(a and b and den * len(a & b) >= num * len(a | b) for a in sets[i] for b in sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def near_texts(rng, vocabulary, groups, sizes=(8, 30, 90)):
    passage, texts = rng.choices(vocabulary, k=20), []
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.choice(sizes)) + passage * (g % 3 == 0)
        for _ in range(rng.choice([1, 2, 12, 25])):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    return texts


def components_of(spark, texts, k, num):
    return {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(docs_of(spark, texts), k, num, 100).collect()}


def test_jaccard_join_against_brute_force(spark):
    rng = random.Random(8)
    texts = list(enumerate([None, "", "a b", "A  b", "b a", "w", *near_texts(rng, [f"w{i}" for i in range(60)], 12)]))
    for k, num in ((3, 90), (5, 80), (1, 50)):
        assert components_of(spark, texts, k, num) == brute_components(texts, k, num, 100), (k, num)


@pytest.mark.parametrize("num", [34, 50, 67, 80, 100])
def test_jaccard_join_of_sets_of_one_to_three(spark, num):
    texts = list(enumerate(f"x{i} y{i}"[: None if j else -len(f" y{i}")] + " z" * (i % 3 == 0 and j > 1) for i in range(30) for j in range(3)))
    assert components_of(spark, texts, 1, num) == brute_components(texts, 1, num, 100)


@pytest.mark.parametrize(("growth", "num"), [(3, 90), (3, 60), (100, 80), (0, 80)])
def test_regions_parted_by_spark_join_exactly(spark, monkeypatch, growth, num):
    """Blocks of a few members: neighbourhoods are parted level by level, or joined in pairs of blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 6)
    monkeypatch.setattr(jaccard_join, "GROWTH", growth)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 4)
    rng = random.Random(11)
    texts = list(enumerate(near_texts(rng, [f"w{i}" for i in range(200)], 9, (20, 40, 60))))
    assert components_of(spark, texts, 2, num) == brute_components(texts, 2, num, 100)


def test_odd_sketches_bound_the_difference_and_fold():
    rng = np.random.default_rng(5)
    for n in (1, 40, 250, 260, 3000):
        x = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        y = np.concatenate([x[: n - n // 20], rng.integers(-(2**63), 2**63 - 1, n // 15)])
        a, b = (jaccard_join.odd_sketch(v)[None] for v in (x, y))
        width = min(a.shape[1], b.shape[1])
        a, b = jaccard_join.fold(a, width), jaccard_join.fold(b, width)
        assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))
    sets = [np.unique(np.concatenate([np.arange(g * 1000, g * 1000 + 95), rng.integers(10**6, 10**7, rng.integers(0, 30))])) * 0x9E3779B97F4A7C1 for g in range(30) for _ in range(4)]
    keep = jaccard_join.possible(np.array([len(s) for s in sets]), [jaccard_join.odd_sketch(s).tobytes() for s in sets], 80, 100)
    near = [any(100 * (n := len(np.intersect1d(a, b))) >= 80 * (len(a) + len(b) - n) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    assert not (np.array(near) & ~keep).any()


def test_join_region_recurses_exactly():
    rng = np.random.default_rng(9)
    sets = []
    for _ in range(40):
        base = rng.choice(100_000, 60, replace=False)
        for _ in range(rng.integers(1, 30)):
            x = base.copy()
            x[rng.choice(60, rng.integers(0, 6), replace=False)] = rng.integers(100_000, 200_000)
            sets.append(np.unique(x))
    pairs = jaccard_join.join_region(sets, np.zeros(len(sets), bool), 90, 100)
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 100 * (n := len(np.intersect1d(a, b))) >= 90 * (len(a) + len(b) - n)]

    def parts(edges):
        root = list(range(len(sets)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i, j in edges:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
        return [find(i) for i in range(len(sets))]

    assert parts(pairs) == parts(near)


def test_jaccard_join_odd_rows(spark, odd):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(odd[0], 3, 90, 100).collect())
    assert got[(6, 10, 5)] == 2 and got[(5, 10, 5)] == 1 and got[(None, 10, None)] == 1 and got[(1, 0, 1)] == got[(2, 0, 2)] == 1
    assert next(c for i, _, c in got if i == 8) == 7
    assert jaccard_join.near_duplicates(empty(spark), 3, 90, 100).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 60), (60, 70), (80, 80)], "a long, b long")
    got = {(r["node"], r["root"]) for r in graph.components(edges).collect()}
    assert got == {(i, 0) for i in range(31)} | {(i, 50) for i in (50, 60, 70)}


# 8


def test_packing(spark, odd):
    rng = np.random.default_rng(10)
    for _ in range(30):
        e, c = np.sort(rng.choice(40, 9, replace=False)) + 1, rng.integers(1, 9, 9)
        cost = lambda b: sum(n * min(x for x in b if x >= v) for v, n in zip(e, c))  # noqa: E731, B023
        assert cost(packing.best_boundaries(e, c, 3)) == min(cost((*x, e[-1])) for x in itertools.combinations(e[:-1], 2))
    got = packing.pack(odd[0], token_budget=64, chunk_rows=4).toPandas()
    assert len(got) == len(odd[1]) and not got.duplicated(["batch_id", "slot"]).any() and (got.padding >= 0).all()
    full = got.groupby("batch_id").bucket_len.agg(["sum", "size"])
    assert ((full["sum"] <= 64) | (full["size"] == 1)).all()
    assert packing.pack(empty(spark)).count() == 0


def test_packing_boundaries_are_the_first_optimum_at_any_length():
    rng = np.random.default_rng(11)
    for _ in range(150):
        n, buckets = int(rng.integers(1, 40)), int(rng.integers(1, 8))
        lengths, counts = np.sort(rng.choice(100_001, n, replace=False)).tolist(), rng.integers(1, 50, n).tolist()
        sums = [0, *itertools.accumulate(counts)]
        cost, back = [0] + [1 << 62] * n, []
        for _ in range(min(buckets, n)):
            ways = [[cost[i] + lengths[j - 1] * (sums[j] - sums[i]) for i in range(j)] for j in range(1, n + 1)]
            back.append([0] + [w.index(min(w)) for w in ways])
            cost = [0] + [min(w) for w in ways]
        want, j = [], n
        for choice in reversed(back):
            if j:
                want.append(lengths[j - 1])
                j = choice[j]
        assert packing.best_boundaries(np.array(lengths), np.array(counts), buckets) == sorted(want)
    assert packing.best_boundaries(np.array([]), np.array([])) == []
    many = packing.best_boundaries(np.arange(1, 100_001), np.ones(100_000, np.int64))
    assert len(many) == packing.BUCKETS and many[-1] == 100_000


# 10


def test_packing_boundaries_are_lengths_that_occur(spark):
    lengths = [10, 2049, 4099, 4099, 70_001]
    docs = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long")
    assert [(r["bucket_len"], r["padding"]) for r in packing.pack(docs, F.col("n")).orderBy("doc_id").collect()] == [(n, 0) for n in lengths]


def test_lm_base_and_model(spark):
    texts = [(i, random.Random(i % 40).choice(["", "the cat sat on the mat ", "A dog "]) * (i % 7) + f"w{i % 9}") for i in range(120)] + [(500, None), (None, "the")]
    got = lm_scoring.score_texts(docs_of(spark, texts)).collect()
    train = Counter()
    for i, t in texts:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            train.update([*words(t), b""])
    n, v = sum(train.values()), len(train)
    by = {r["doc_id"]: r for r in got}
    for i, t in texts:
        w, r = [*words(t), b""], by[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in train for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r["score"] < 0
    assert len(got) == len(texts) and lm_scoring.score_texts(empty(spark)).count() == 0


def textbook_tree(train, texts):
    """log10 of each text by context-tree weighting, node by node: dictionaries of counts, block probabilities by recursion."""
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)

    def steps(text):
        run = b" " * 9 + b"".join(w + b" " for w in [*words(text), b""])
        place = 0
        for i in range(9, len(run)):
            depth = 4 if place < 3 else 6
            context = run[i - depth : i][::-1] if place < 3 else (run[i - place - 1 : i][::-1] + b" " * 6)[:6]
            for k in range(8):
                yield context, (run[i] >> (8 - k)) | (1 << k), (run[i] >> (7 - k)) & 1
            place = 0 if run[i] == 32 else place + 1

    def path(context, heap):
        return [(context[:d], heap) for d in range(len(context) + 1)]

    for text in train:
        for context, heap, bit in steps(text):
            nodes = path(context, heap)
            for node in nodes:
                counts[node][bit] += 1
            for up, down in zip(nodes, nodes[1:]):
                children[up].add(down)

    def kt(zeros, ones):
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)

    memory = {}

    def block(node):
        if node not in memory:
            own = kt(*counts.get(node, (0, 0)))
            kids = children.get(node)
            memory[node] = (own, own, 0.0) if not kids else (float(np.logaddexp(own, k := sum(block(c)[0] for c in kids))) - math.log(2), own, k)
        return memory[node]

    def predict(nodes):
        zeros, ones = counts.get(nodes[0], (0, 0))
        p = (ones + 0.5) / (zeros + ones + 1)
        if len(nodes) == 1:
            return p
        _, own, kids = block(nodes[0])
        w = 1 / (1 + math.exp(kids - own))
        return w * p + (1 - w) * predict(nodes[1:])

    out = []
    for text in texts:
        total = 0.0
        for context, heap, bit in steps(text):
            p = predict(path(context, heap))
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def test_scores_equal_a_textbook_context_tree(spark, monkeypatch):
    """Contexts across words, unseen contexts and bytes, NUL bytes, held-out texts; heads of a few entries change nothing."""
    rng = random.Random(12)
    vocabulary = ["the", "a", "cat", "catalogue", "dog", "do", "naïve", "x", "\0\0\0\0\0\0\0\0q", "sat", "mat"]
    texts = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 9)))) for i in range(60)] + [(500, None), (None, "the"), (501, "unseen words zzz"), (502, "sat cat the"), (503, "the cat sat")]
    want = textbook_tree([t for i, t in texts if i is None or zlib.crc32(str(i).encode()) % 10], [t for _, t in texts])
    for small in (False, True):
        if small:
            monkeypatch.setattr(lm_scoring, "HEAD_EVENTS", 3)
            monkeypatch.setattr(lm_scoring, "HEAD_WORDS", 2)
        got = {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(docs_of(spark, texts)).collect()}
        assert all(math.isclose(got[i], w, rel_tol=1e-7) for (i, _), w in zip(texts, want))
    assert got[502] != got[503]


def test_lgamma():
    x = np.array([0.5, 1, 1.5, 3, 10.5, 1e6])
    assert np.allclose(lm_scoring.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-10)


# Registry and pipeline


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, d)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want.fetchall())


def test_pipeline_stages(spark, odd):
    d = "/root/testdata/sf0.001"
    docs = common.materialize(common.read_table(spark, d, "documents"), "t")
    bench = [decontamination.normal(r["text"]) for r in common.read_table(spark, d, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, docs, d), name)
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = {r["doc_id"] for r in out.collect()}
        assert after <= set(before) and after
        if name == "jaccard_join":
            root = brute_components(list(before.items()), 5, 80, 100)
            assert after == {i for i in root if root[i] == i}
        if name == "decontamination":
            assert after == {i for i, t in before.items() if not any(b in decontamination.normal(t) for b in bench)}
        if name == "packing":
            assert after == set(before)
        else:
            assert out.columns == docs.columns
        docs = out
    assert corpus_pipeline.run(spark, d).count() == len(after)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_odd_and_empty_rows(spark, odd, name, stage):
    for rows in (odd[0], empty(spark)):
        out = stage(spark, rows, "/root/testdata/sf0.001")
        assert out.count() <= len(odd[1])


def test_near_duplicate_stage_keeps_unlike_texts_of_one_id_and_odd_columns(spark):
    text = "a b c d e f g h i j k l"
    rows = [(1, text, "r1"), (1, text, "r1"), (1, "quite another text of more than five words", "r2"), (2, text + " m", "r3"), (None, text, "r4"), (None, None, "r5"), (3, "", "r6")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns and sorted(r["_n"] for r in out.collect()) == ["r2", "r4", "r5", "r6"]
