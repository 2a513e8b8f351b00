"""Merge passes of archives by key ranges, bounded token files, benchmark items read from files."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkweir.llm import common, decontamination, token_file, warc


@pytest.mark.parametrize(("fan_in", "ranges"), [(4, 16), (2, 3), (8, 64)])
def test_merge_passes_keep_all_tasks_busy(spark, monkeypatch, fan_in, ranges):
    monkeypatch.setattr(warc, "FAN_IN", fan_in)
    rng = random.Random(fan_in)
    pages = spark.createDataFrame([(i, f"http://h{rng.randrange(40)}.org/{rng.randrange(300)}", f"<p>{i % 50}</p>") for i in range(900)], "page_id long, url string, html string").repartition(60)
    path = common.fresh_path(spark, "warc")
    manifest = warc.write(pages, path)
    made, real = [], warc.materialize
    monkeypatch.setattr(warc, "materialize", lambda df, tag, parts=None: (made.append((tag, df.rdd.getNumPartitions() if tag == "merged-runs" else 0)), real(df, tag, parts))[1])
    index = warc.merge(spark, path, manifest, ranges).orderBy("shard", "seq").collect()
    order = [(r["url_key"], r["ts"], r["page_id"]) for r in index]
    assert order == sorted(order) and sorted(r["page_id"] for r in index) == list(range(900))
    passes = [n for tag, n in made if tag == "merged-runs"]
    assert passes and min(passes) >= min(ranges, 60 // fan_in)


def test_ranges_of_many_captures_lose_none(spark):
    n = 20_003
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/"), "id").alias("url"), (F.col("id") % 7).cast("string").alias("html"))
    path = common.fresh_path(spark, "warc")
    index = warc.merge(spark, path, warc.write(pages, path), 1)
    rows = index.orderBy("shard", "seq").collect()
    assert [(r["shard"], r["seq"]) for r in rows] == [(0, i) for i in range(n)]
    assert [r["url_key"] for r in rows] == sorted(f"org,h)/{i}" for i in range(n))
    got = warc.read(spark, path, index)
    assert sorted(r["page_id"] for r in got.select("page_id").collect()) == list(range(n))


def test_bounds_part_the_marks_evenly():
    runs = [([f"r{i}"], 10, [f"k{j:03d}\t2020\t{i}\t0" for j in range(10)]) for i in range(20)]
    bounds = warc._bounds(runs, 8)
    assert len(bounds) == 8 and bounds[0][0] is None and bounds[-1][1] is None
    assert all(a[1] == b[0] for a, b in zip(bounds, bounds[1:]))
    assert warc._bounds([], 8) == [(None, None)] and warc._bounds([(["x"], 1, ["k\t1\t\t0"])], 8) == [(None, None)]


def test_token_files_close_after_so_many_documents(spark, monkeypatch):
    import public_tokenizers

    docs = spark.createDataFrame([(i * 10**12, "a" if i % 3 else None) for i in range(500)], "doc_id long, text string")
    monkeypatch.setattr(token_file, "FILE_DOCS", 40)
    path = common.fresh_path(spark, "tokens")
    manifest = token_file.write(docs.coalesce(1), public_tokenizers.path("byte_bpe_50k.json"), path, parts=1)
    got = token_file.read(spark, manifest).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == [i * 10**12 for i in range(500)]
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    assert manifest.agg(F.max("n_docs")).first()[0] <= token_file.FILE_DOCS or manifest.count() == 1


def library_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    return [np.array(e.ids, np.uint16).tobytes() for e in Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)]


def test_letters_and_tails_of_chunks_meet_the_library_once():
    import public_tokenizers

    enc = token_file.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    given = []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return real.encode_batch_fast(texts, **options)

    real, enc.tok = enc.tok, Counting()
    rng = random.Random(5)
    stems = ["".join(rng.choices("abcdefghij", k=12)) for _ in range(300)]
    tails = ["", ".", ",", ".\nThe", "'s", "$$$", "7"]
    texts = ["Text " + " ".join(s + t for s in stems) for t in tails]
    assert enc.encode(texts) == library_ids(texts)
    assert sum(map(len, given)) < 2 * sum(map(len, stems))
    assert enc.encode(texts[:2]) == library_ids(texts[:2]) and sum(map(len, given)) < 2 * sum(map(len, stems))


@pytest.mark.parametrize("remembered", [800_000, 60])
def test_ids_of_odd_chunks_in_batches(monkeypatch, remembered):
    import public_tokenizers

    monkeypatch.setattr(token_file, "REMEMBERED", remembered)
    monkeypatch.setattr(token_file, "JOINED", 7)
    enc = token_file.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    bits = ["a", "The", "don't", "I'll", "x's.", "it'S", "'re", "ab1", "1ab", "e\u0301x", "a\u0301", "é", "aé", "漢a", "a漢.", ".", ",b", "\n", "\n\n", "\r\n", "\t", "\x1f", "\x85", "\u2003", "\u3000", "\xa0", "\x00", "<|endoftext|>", "endoftext|>", "a<|endoftext|>b", "\u0120", "😀", ""]
    for n in (0, 1, 900, 900, 300):
        texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", " ", "  "]) for _ in range(rng.randint(0, 30))) for _ in range(n)]
        assert enc.encode(texts) == library_ids(texts)
    assert enc.encode([""]) == [b""] and enc.encode(["", "  ", " ", "b c"]) == library_ids(["", "  ", " ", "b c"])


def test_items_come_from_files_in_blocks(spark):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(words, k=12)), "x") for i in range(60)] + [(None, "null id item of several words here", "x"), (7, None, "x"), (8, "", "x"), (3, "a repeated id", "x")]
    texts = [(i, " ".join(rng.choices(words, k=40)) + " " + (rng.choice(items)[1 if i % 3 else 2] or "")) for i in range(80)] + [(100, None), (None, items[0][1])]
    texts = [(i, t if isinstance(t, str) else None) for i, t in texts]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    whole = decontamination.Matcher(tuple((i, t) for i, t, _ in items if t is not None), decontamination.BUDGET_STEP)
    want = {(d, *hit) for d, t in texts for hit in whole.find(t)}
    for chars in (10**6, 1500):
        assert {tuple(r) for r in decontamination.find_leaks(docs, table, block_chars=chars).collect()} == want
    assert len(decontamination.blocks(table, 200)) > 10
    kept = decontamination.remove_leaking(docs, table, block_chars=500)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, t in texts if not whole.find(t)}
    assert decontamination.find_leaks(docs, table.limit(0)).count() == 0
