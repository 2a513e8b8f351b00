"""Files as rows, ranges of large files, nested JSON by ranges, committed sinks and keyed state."""

import json
import os
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkweir.operators import extract as X
from linkweir.sources import blobs, committed, files, nested_json


def uri(path):
    return f"file://{path}"


# Files


def test_files_are_written_and_copied_whole_or_not_at_all(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", "one"), ("c.txt", None), ("é ü.txt", "x" * 200_000)], "path string, content string")
    blobs.write_files(rows, uri(tmp_path / "in"))
    assert (tmp_path / "in/a/b.txt").read_text() == "one" and (tmp_path / "in/c.txt").read_bytes() == b""
    todo = [(str(tmp_path / "in/a/b.txt"), str(tmp_path / "out/1")), (uri(tmp_path / "in/é ü.txt"), str(tmp_path / "out/x/2")), (str(tmp_path / "in/none"), str(tmp_path / "out/3")), (None, "x"), (str(tmp_path / "in"), str(tmp_path / "out/4"))]
    got = {r["path"]: r["copied"] for r in blobs.copy_files(spark.createDataFrame(todo, "path string, target string")).collect()}
    assert [got[p] for p, _ in todo] == [3, 200_000, None, None, None]
    assert (tmp_path / "out/x/2").read_text() == "x" * 200_000
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["1", "x"]


def test_a_large_manifest_is_asked_for_without_a_listing(spark, tmp_path, monkeypatch):
    (tmp_path / "d").mkdir()
    for i in range(0, 1000, 7):
        (tmp_path / f"d/{i}").write_text("x" * (i % 5))
    manifest = spark.range(100_000).select(F.concat(F.lit(f"{tmp_path}/d/"), "id").alias("path"), "id").unionByName(spark.createDataFrame([(None, -1), (str(tmp_path / "d"), -2)], "path string, id long"))
    got = {r["id"]: r["size"] for r in files.existing(manifest).collect()}
    assert got == {i: i % 5 for i in range(0, 1000, 7)}
    assert "binaryFile" not in files.existing(manifest)._jdf.queryExecution().toString()


def test_selected_files_are_listed_and_copied_by_category(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.pdf").write_text(n)
    rows = spark.createDataFrame([("etd", str(tmp_path / "a.pdf")), ("double", str(tmp_path / "b.pdf")), ("double", str(tmp_path / "gone.pdf"))], "category string, path string")
    files.copy_selected(rows, str(tmp_path / "chosen"))
    assert (tmp_path / "chosen/etd/a.pdf").read_text() == "a" and os.listdir(tmp_path / "chosen/double") == ["b.pdf"]
    lists = spark.read.text(str(tmp_path / "chosen/lists")).groupBy("category").count().collect()
    assert {r["category"]: r["count"] for r in lists} == {"etd": 1, "double": 2}


# Bytes in ranges

WHOLE = re.compile(rb"""(https?://[^\s<>()"']+)""", re.I)


def of_ranges(data, step, block):
    found = []
    for first in range(0, len(data), step):
        found += blobs.links_of_range(pa.BufferReader(data), first, min(first + step, len(data)), block)
    return found


def test_every_cut_of_a_file_gives_what_the_whole_gives():
    data = b"x http://a.org/1 (HTTPS://b.org/\xc3\xa9)http:// <http://>https://c.de/http://d.de/ 'http://e' \x00\xffhttp://f\xff\x00\nhhttp://g"
    want = WHOLE.findall(data)
    assert len(want) == 6
    for step in range(1, len(data) + 2):
        for block in (1, 7, 64):
            assert of_ranges(data, step, block) == want, (step, block)


def test_random_bytes_in_ranges():
    rng, bits = random.Random(11), [b"http://", b"https://", b"HTTP", b":", b"//", b"/", b"h", b" ", b"(", b">", b'"', b"\n", b"a", b"\xc3", b"\x85", b"\x0b", b"p://x"]
    for _ in range(1500):
        data = b"".join(rng.choices(bits, k=rng.randint(0, 30)))
        assert of_ranges(data, rng.randint(1, 20), rng.randint(1, 9)) == WHOLE.findall(data), data


def test_large_files_are_the_work_of_many_tasks(spark, tmp_path):
    rng = random.Random(12)
    text = b"".join(rng.choice([b"word ", b"http://a%d.org/x " % rng.randrange(500), b"\xff\x00" * 30, b"(https://b.org/" + b"y" * 500 + b")"]) for _ in range(20_000))
    (tmp_path / "big.pdf").write_bytes(text)
    (tmp_path / "empty.pdf").write_bytes(b"")
    listed = files.list_files(spark, uri(tmp_path), "pdf").select("path", F.col("length").alias("size"))
    assert blobs.ranges(listed, "size", 10_000).count() == -(-len(text) // 10_000)
    got = {r["url"] for r in blobs.scan_links(listed, step=10_000, block=512).collect()}
    assert got == {u.decode("utf-8", "ignore") for u in WHOLE.findall(text)}


# Nested JSON


def flat(value):
    return {(o, i, json.dumps(r, sort_keys=True)) for o, m in value.items() for i, r in m.items()}


def by_ranges(data, step):
    state, depth, name, out = nested_json.OUTSIDE, 0, None, []
    for first in range(0, len(data), step):
        last = min(first + step, len(data))
        out += nested_json.records(pa.BufferReader(data), first, last, state, depth, name)
        s = nested_json.structure(data[first:last], state, depth)
        longer = data[first : last + 100]
        found = [k for k in nested_json.keys(longer, nested_json.structure(longer, state, depth), state, depth, 1) if k[2] >= 0 and k[0] < last - first]
        name = json.loads(longer[found[-1][0] : found[-1][1] + 1]) if found else name
        state, depth = s.state, int(s.depths[-1]) if len(s.depths) else depth
    return out


@pytest.mark.parametrize("style", [{}, {"indent": 4}, {"separators": (",", ":")}, {"ensure_ascii": False, "indent": 1}])
def test_records_at_every_cut(style):
    value = {
        "1993": {"hep/1": {"urls": ["a{b}", 'q"\\"}', "\\"], "n": 1}, "2": None, "3": "te,x}t", "4": 5, "5": [1, {"a": {}}], 'k"e\\y': {}},
        "20\\": {},
        "2001é": {"x": {"deep": {"er": [[{}]]}}, "y": True, "last": {"urls": []}},
    }
    data = json.dumps(value, **style).encode()
    for step in range(1, len(data) + 1):
        got = by_ranges(data, step)
        assert {(o, i, json.dumps(json.loads(r), sort_keys=True)) for o, i, r in got} == flat(value), step
        assert len(got) == 9


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    rng = random.Random(13)
    value = {str(y): {f"{y}.{i}": {"urls": ["http://a/{" + "x" * rng.randint(0, 80)] * rng.randint(0, 3), "num_urls": i, "note": '"}\\' * (i % 3)} for i in range(400)} for y in range(1992, 2000)}
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.json").write_text(json.dumps(value, indent=2))
    (tmp_path / "m/b.json").write_text('{"1990": {"only": {"num_urls": 7}}}')
    (tmp_path / "m/c.json").write_text("{}")
    got = nested_json.read_map_of_maps(spark, uri(tmp_path / "m"), "urls array<string>, num_urls int, note string", step=5000)
    rows = {(r["outer"], r["inner"]): (r["urls"], r["num_urls"], r["note"]) for r in got.collect()}
    want = {(y, i): (r["urls"], r["num_urls"], r["note"]) for y, m in value.items() for i, r in m.items()} | {("1990", "only"): (None, 7, None)}
    assert rows == want
    assert nested_json._ranges(spark, uri(tmp_path / "m"), 5000).count() > 50


# Committed sinks


def rows_of(spark, path):
    return sorted(((r["a"], r["b"]) for r in committed.read_committed(spark, path, "a long, b string").collect()), key=str)


def test_overwrite_append_and_clean(spark, tmp_path):
    path = uri(tmp_path / "t")
    assert rows_of(spark, path) == [] and committed.clean(path) == 0
    one = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string").repartition(2)
    committed.write_committed(one, path)
    committed.write_committed(spark.createDataFrame([(3, "é\n")], "a long, b string"), path, mode="append")
    assert sorted(rows_of(spark, path), key=str) == [(1, "x"), (2, None), (3, "é\n")]
    committed.write_committed(spark.createDataFrame([(4, "z")], "a long, b string"), path)
    assert rows_of(spark, path) == [(4, "z")] and committed.current(path)["number"] == 2
    assert committed.clean(path) >= 4 and rows_of(spark, path) == [(4, "z")]


def test_a_task_that_dies_leaves_the_old_result(spark, tmp_path):
    path = uri(tmp_path / "t")
    committed.write_committed(spark.createDataFrame([(1, "x")], "a long, b string"), path)

    @F.udf("string")
    def dies(i):
        if i == 900:
            raise RuntimeError("killed")
        return "new"

    with pytest.raises(Exception, match="killed"):
        committed.write_committed(spark.range(1000).repartition(4).select(F.col("id").alias("a"), dies("id").alias("b")), path)
    assert rows_of(spark, path) == [(1, "x")]
    time.sleep(2)  # for tasks that had not yet heard of it
    committed.clean(path)
    assert rows_of(spark, path) == [(1, "x")] and len(os.listdir(tmp_path / "t/data")) == 1


def test_a_driver_that_stops_before_the_commit_leaves_the_old_result(spark, tmp_path):
    path = uri(tmp_path / "t")
    committed.write_committed(spark.createDataFrame([(1, "x")], "a long, b string"), path)
    writer = committed.Writer({"path": path}, overwrite=True)
    message = writer.write(iter([pa.RecordBatch.from_pylist([{"a": 2, "b": "y"}])]))  # the tasks end, and no commit follows
    assert rows_of(spark, path) == [(1, "x")]
    writer.commit([message])
    assert rows_of(spark, path) == [(2, "y")]
    late = writer.write(iter([pa.RecordBatch.from_pylist([{"a": 3, "b": "z"}])]))
    writer.abort([late, None])
    assert rows_of(spark, path) == [(2, "y")] and committed.clean(path) == 2


def test_manifest_lines(spark, tmp_path):
    path = uri(tmp_path / "m")
    rows = spark.createDataFrame([(1993, "hep/1", "a b.pdf"), (None, "x", None)], "year int, paper_id string, path string")
    committed.write_committed(rows, path, "text")
    got = committed.read_committed(spark, path, "year int, paper_id string, path string", sep="|")
    assert sorted(map(tuple, got.collect()), key=str) == [(1993, "hep/1", "a b.pdf"), (None, "x", "")]


# Keyed state


def test_a_batch_reads_nothing_of_the_target_and_a_restart_forgets_no_id(spark, tmp_path):
    from linkweir.streaming import incremental as I

    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    run = lambda: I.extract_incrementally(spark, source, "paper_id long, text string", X.markdown_links(F.col("text")), target, state, files_per_batch=2)
    put = lambda lo, hi: spark.range(lo, hi, 1, 3).select(F.col("id").alias("paper_id"), F.lit("[x](http://a)").alias("text")).write.mode("append").parquet(source)
    put(0, 300)
    assert run().count() == 300
    (tmp_path / "out").rename(tmp_path / "gone")  # what the ids need is not there
    put(200, 400)
    assert {r["paper_id"] for r in run().collect()} == set(range(300, 400))
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")
