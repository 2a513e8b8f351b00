"""Folders of papers are listed and read by tasks; the driver knows neither the files nor one task for every few of them."""

import pytest
from pyspark.sql import functions as F

from linkweir.operators import extract as X
from linkweir.sources import blobs, files


@pytest.fixture()
def root(tmp_path):
    content = {
        "p1/main.tex": b"\\begin{document}\\url{http://a.org/1}",
        "p1/deep/er/_part.tex": b"http://a.org/2 \xe9\xff",
        "p1/.old.bbl": b"http://a.org/3",
        "p1/note.txt": b"http://a.org/no",
        "p2/empty.tex": b"",
        "p3/only.bbl": b"http://c.org/1",
        "p 4%20/ü.tex": "http://d.org/ü1".encode(),
        "single.tex": b"http://e.org/1",
        "none/readme": b"",
    }
    for name, data in content.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_bytes(data)
    return f"file://{tmp_path}/src"


def test_all_sources_are_read_at_any_depth(spark, root):
    got = files.latex_sources(spark, root)
    want = {"p1": ["_part.tex", ".old.bbl", "main.tex"], "p2": ["empty.tex"], "p3": ["only.bbl"], "p 4%20": ["ü.tex"], "single.tex": ["single.tex"]}
    rows = got.collect()
    assert sorted((r["paper_id"], r["path"].rsplit("/", 1)[-1]) for r in rows) == sorted((k, x) for k, v in want.items() for x in v)
    by_name = {r["path"].rsplit("/", 1)[-1]: r for r in rows}
    assert by_name["_part.tex"]["content"] == "http://a.org/2 " and by_name["_part.tex"]["size"] == 17
    assert by_name["empty.tex"]["content"] == "" and by_name["empty.tex"]["size"] == 0
    assert by_name["_part.tex"]["path"] == f"{root}/p1/deep/er/_part.tex"
    assert {r["paper_id"]: (r["urls"], r["failed_files"]) for r in X.latex_papers(got).collect()}["p1"] == (["http://a.org/1", "http://a.org/2", "http://a.org/3"], 0)
    assert {r["paper_id"] for r in files.main_file(got).collect()} == {"p1", "p2", "p 4%20", "single.tex"}
    assert files.latex_sources(spark, root + "/missing").count() == 0


def test_papers_that_are_named_are_read_once(spark, root):
    papers = spark.createDataFrame([("p1",), ("p1",), ("p3",), ("gone",), (None,), ("",)], "paper_id string")
    got = files.latex_sources(spark, root, papers)
    assert sorted(r["paper_id"] for r in got.collect()) == ["p1", "p1", "p1", "p3"]


def test_the_driver_lists_no_files_and_tasks_have_many(spark, tmp_path):
    src = f"file://{tmp_path}/src"
    rows = spark.range(300).select(F.explode(F.array(*(F.concat("id", F.lit(f"/{n}")) for n in ("a.tex", "b.tex", "c.bbl")))).alias("path"), F.lit("x").alias("content"))
    blobs.write_files(rows, src)
    for got in (files.latex_sources(spark, src), files.latex_sources(spark, src, spark.range(300).withColumnRenamed("id", "paper_id"))):
        assert not [f for f in got.inputFiles() if f.endswith((".tex", ".bbl"))]
        assert got.rdd.getNumPartitions() == 4 and got.count() == 900
    assert blobs.read_folders(blobs.names_in(spark, src, at_once=7), src, (".bbl",), per_task=30).rdd.getNumPartitions() == 10
    assert blobs.names_in(spark, src, at_once=7).distinct().count() == 300


def test_main_files_are_chosen_by_columns_without_contents(spark):
    rows = [("p", "x/a.tex", 9, "note long"), ("p", "x/b.tex", 5, "\\documentclass"), ("p", "x/c.tex", 3, "\\begin{document} longer"), ("p", "x/d.tex", 99, None), ("q", "y/b.tex", 7, "é"), ("q", "y/a.tex", 7, "éé"), ("q", "y/z.bbl", 70, "\\documentclass")]
    main = files.main_file(spark.createDataFrame(rows, "paper_id string, path string, size long, content string").repartition(3))
    assert main.columns == ["paper_id", "path", "size", "content"]
    assert {r["paper_id"]: (r["path"], r["size"], r["content"]) for r in main.collect()} == {"p": ("x/c.tex", 3, "\\begin{document} longer"), "q": ("y/a.tex", 7, "éé")}
    plan = main.select("paper_id", "path")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1 and not any("content" in x for x in plan.splitlines() if "Window" in x)
