"""Queries over files: each writes its input from a given table below the scratch folder and reads it back."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from linkweir.functions.scalars import is_missing
from linkweir.plans.fixtures import duck, load
from linkweir.plans.registry import query
from linkweir.sources import blobs, committed, files, nested_json
from linkweir.sources.scratch import new_path

_PAGES = duck("urls")
_ID = "paper_id::VARCHAR"


def _written(spark: SparkSession, d: str, tag: str, path: Column, content: Column, where: str = "true", fixture: str = "urls") -> str:
    """Root of a folder with a file for each row of a fixture."""
    root = new_path(spark, tag)
    blobs.write_files(load(spark, d, fixture).where(where).select(path.alias("path"), content.alias("content")), root)
    return root


def _key() -> Column:
    return F.col("paper_id").cast("string")


@query(f"SELECT {_ID} AS paper_id, length(url)::BIGINT AS length FROM {_PAGES}")
def list_files(spark, d):
    root = _written(spark, d, "pdfs", F.concat(F.lit("set "), (F.col("paper_id") % 7).cast("string"), F.lit("/"), _key(), F.lit(".pdf")), F.col("url"))
    return files.list_files(spark, root, "pdf").select("paper_id", "length")


@query(f"SELECT {_ID} AS paper_id, CASE WHEN paper_id % 3 = 0 THEN '' ELSE url || chr(10) || '{{\"two\": \"lines\"}}' END AS content FROM {_PAGES}")
def whole_text_files(spark, d):
    text = F.concat("url", F.lit('\n{"two": "lines"}'))
    root = _written(spark, d, "texts", F.concat(_key(), F.lit(".txt")), text, "paper_id % 3 > 0")
    return files.with_content(load(spark, d, "urls").select(_key().alias("paper_id")), files.whole_texts(spark, root, "txt")).select("paper_id", "content")


@query(f"SELECT {_ID} AS paper_id, CASE WHEN paper_id % 2 = 0 THEN 'b.tex' ELSE 'c.tex' END AS name, (CASE WHEN paper_id % 2 = 0 THEN 30 ELSE 24 END + length(url))::BIGINT AS size FROM {_PAGES}")
def main_tex_file(spark, d):
    """The main source of each paper, of a note, a chapter that starts a document every second time, and a long text."""
    root = new_path(spark, "sources")
    pages = load(spark, d, "urls")
    chapter = F.when(F.col("paper_id") % 2 == 0, F.concat(F.lit("\\documentclass{x} % a comment\n"), "url")).otherwise(F.concat(F.lit("no class: "), "url"))
    three = {"a.tex": F.lit("note"), "b.tex": chapter, "c.tex": F.concat("url", F.lit("a long text, no class   ")), "d.bbl": F.lit("\\documentclass")}
    rows = pages.select("paper_id", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c.alias("content")) for n, c in three.items()))).alias("f"))
    blobs.write_files(rows.select(F.concat_ws("/", "paper_id", "f.name").alias("path"), "f.content"), root)
    main = files.main_file(files.latex_sources(spark, root, pages))
    return main.select("paper_id", F.substring_index("path", "/", -1).alias("name"), "size")


@query(f"SELECT {_ID} AS paper_id, 'a.html' AS name FROM {_PAGES}")
def first_html_file(spark, d):
    root = new_path(spark, "html")
    rows = load(spark, d, "urls").select("paper_id", "url", F.explode(F.array(*map(F.lit, ("b.html", "a.html", "c/a.html")))).alias("name"))
    blobs.write_files(rows.select(F.concat_ws("/", "paper_id", "name").alias("path"), F.col("url").alias("content")), root)
    texts = files.whole_texts(spark, root, "html").withColumn("name", F.substring_index("path", "/html-", -1))
    texts = texts.select(F.element_at(F.split("name", "/"), 2).alias("paper_id"), "path", F.substring_index("path", "/", -1).alias("name"))
    return files.first_file(texts).select("paper_id", "name")


_NESTED = f"(SELECT year, paper_id, sum(num_urls)::BIGINT AS num_urls, list(DISTINCT format ORDER BY format) AS formats FROM {duck('corpus')} GROUP BY ALL)"


@query(f"SELECT year::VARCHAR AS year, paper_id::VARCHAR AS paper_id, num_urls, len(formats) AS n, 'a \"{{brace}}\" \\ ' || paper_id::VARCHAR AS title FROM {_NESTED}")
def nested_year_json(spark, d):
    """{year: {id: record}} files, each read by several tasks, with braces, quotes and backslashes in strings."""
    papers = load(spark, d, "corpus").groupBy("year", "paper_id").agg(F.sum("num_urls").cast("long").alias("num_urls"), F.array_sort(F.collect_set("format")).alias("formats"))
    title = F.concat(F.lit('a "{brace}" \\ '), _key())
    record = F.to_json(F.struct("num_urls", F.transform("formats", lambda f: F.struct(f.alias("f"), F.lit("}{").alias("x"))).alias("urls"), title.alias("title")))
    line = F.concat(F.lit('  "'), _key(), F.lit('" : '), record)
    # a file holds the papers of a year of one thousand keys, so a group is bounded
    made = papers.groupBy("year", F.floor(F.col("paper_id") / 1000).alias("part")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    text = F.concat(F.lit('{\n "'), F.col("year").cast("string"), F.lit('": {\n'), F.array_join("lines", ",\n"), F.lit("\n }\n}\n"))
    root = new_path(spark, "nested")
    blobs.write_files(made.select(F.concat_ws("-", "year", "part").alias("path"), text.alias("content")), root)
    got = nested_json.read_map_of_maps(spark, root, "num_urls long, urls array<struct<f: int, x: string>>, title string", step=1 << 12)
    return got.select(F.col("outer").alias("year"), F.col("inner").alias("paper_id"), "num_urls", F.size("urls").alias("n"), "title")


@query(f"SELECT (1992 + paper_id % 5)::INT AS year, {_ID} AS paper_id, length(url)::BIGINT AS size FROM {_PAGES} WHERE paper_id % 3 > 0")
def existing_of_manifest(spark, d):
    """The lines year|id|path of a committed manifest whose files exist."""
    root = _written(spark, d, "present", F.concat(_key(), F.lit(".pdf")), F.col("url"), "paper_id % 3 > 0")
    listed = load(spark, d, "urls").select((1992 + F.col("paper_id") % 5).cast("int").alias("year"), _key().alias("paper_id"), F.concat(F.lit(f"{root}/"), _key(), F.lit(".pdf")).alias("path"))
    path = new_path(spark, "manifest")
    committed.write_committed(listed, path, "text")
    rows = committed.read_committed(spark, path, "year int, paper_id string, path string", sep="|")
    return files.existing(rows).select("year", "paper_id", "size")


@query(f"SELECT CASE WHEN paper_id % 5 = 0 THEN paper_id::VARCHAR || '_meta.json' ELSE {_ID} END AS paper_id, CASE WHEN paper_id % 5 = 0 THEN 'corrupted_json' WHEN paper_id % 2 = 0 THEN 'success' ELSE 'failed' END AS status, CASE WHEN paper_id % 5 > 0 AND paper_id % 2 = 1 THEN url END AS error FROM {_PAGES}")
def conversion_records(spark, d):
    good = F.to_json(F.struct(_key().alias("arxiv_id"), F.when(F.col("paper_id") % 2 == 0, "success").otherwise("failed").alias("status"), F.when(F.col("paper_id") % 2 == 1, F.col("url")).alias("error")))
    content = F.when(F.col("paper_id") % 5 == 0, '{"arxiv_id": "cut').otherwise(F.replace(good, F.lit(","), F.lit(",\n ")))
    root = _written(spark, d, "meta", F.concat(_key(), F.lit("_meta.json")), content)
    return files.read_status_files(spark, root).select("paper_id", "status", "error")


@query(f"SELECT {_ID} AS arxiv_id, url AS html_path FROM {_PAGES} WHERE paper_id % 4 > 0")
def success_markers(spark, d):
    content = F.when(F.col("paper_id") % 4 == 0, "{broken").otherwise(F.to_json(F.struct(_key().alias("arxiv_id"), F.col("url").alias("html_path"))))
    return files.read_success_markers(spark, _written(spark, d, "success", F.concat(_key(), F.lit(".json")), content))


@query(f"SELECT DISTINCT (1990 + paper_id % 9)::INT AS year, {_ID} AS paper_id FROM {_PAGES} WHERE paper_id % 10 > 0")
def tracker_logs(spark, d):
    name = F.when(F.col("paper_id") % 10 == 0, F.concat(F.lit("other_"), _key(), F.lit(".txt"))).otherwise(F.concat((1990 + F.col("paper_id") % 9).cast("string"), F.lit("_task_"), _key(), F.lit(".log")))
    return files.read_tracker_logs(spark, _written(spark, d, "logs", name, F.concat(_key(), F.lit("\n\n "), _key(), F.lit(" \n"))))


@query(f"SELECT CASE paper_id % 3 WHEN 0 THEN 'A100' ELSE 'V100' END AS kind, count(*) AS logs FROM {_PAGES} WHERE paper_id % 3 < 2 GROUP BY ALL")
def hardware_tally(spark, d):
    third = F.col("paper_id") % 3
    content = F.concat(F.lit("started\n"), F.when(third == 0, "on A100, V100\n").when(third == 1, "on V100\n").otherwise("on a CPU\n"), "url")
    return files.hardware_tally(spark, _written(spark, d, "hardware", F.concat(_key(), F.lit(".log")), content))


@query(f"SELECT DISTINCT (paper_id // 40)::VARCHAR AS paper_id, unnest([url || '/é', url]) AS url FROM {_PAGES}")
def scan_large_binary(spark, d):
    """URLs in the bytes of files that are scanned in ranges far shorter than they are."""
    noise = F.unhex(F.lit("0001FFE9C3"))
    one = F.concat(F.encode(F.lit("/URI("), "UTF-8"), F.encode(F.concat("url", F.lit("/é) <"), "url", F.lit(">")), "UTF-8"), noise)
    pages = load(spark, d, "urls").select((F.floor(F.col("paper_id") / 40)).alias("part"), F.struct("paper_id", F.hex(one).alias("x")).alias("one"))
    made = pages.groupBy("part").agg(F.array_join(F.sort_array(F.collect_list("one"))["x"], "").alias("x"))  # forty pages a file
    root = new_path(spark, "binary")
    blobs.write_files(made.select(F.concat(F.col("part").cast("string"), F.lit(".pdf")).alias("path"), F.unhex("x").alias("content")), root)
    found = blobs.scan_links(files.list_files(spark, root, "pdf").select("path", F.col("length").alias("size")), step=64, block=16)
    return found.select(files.stem(F.col("path"), "pdf").alias("paper_id"), "url")


@query(f"SELECT 'c' || (paper_id % 3)::VARCHAR AS category, {_ID} AS paper_id, CASE WHEN paper_id % 4 > 0 THEN length(url)::BIGINT END AS copied FROM {_PAGES}")
def copy_selected(spark, d):
    """Files copied to a folder a category, with what is missing told."""
    root = _written(spark, d, "chosen", F.concat(_key(), F.lit(".pdf")), F.col("url"), "paper_id % 4 > 0")
    target = new_path(spark, "copies")
    category = F.concat(F.lit("c"), (F.col("paper_id") % 3).cast("string"))
    rows = load(spark, d, "urls").select(category.alias("category"), _key().alias("paper_id"), F.concat(F.lit(f"{root}/"), _key(), F.lit(".pdf")).alias("path"))
    files.copy_selected(rows, target)
    copies = files.list_files(spark, target, "pdf").select("paper_id", F.col("length").alias("copied"))
    lists = spark.read.text(f"{target}/lists").select("category", files.stem(F.col("value"), "pdf").alias("paper_id"))
    return lists.join(copies, "paper_id", "left").select("category", "paper_id", "copied")


@query("SELECT paper_id, url, label FROM (SELECT DISTINCT l_suppkey AS paper_id, l_partkey % 200 AS url, l_returnflag AS label FROM lineitem WHERE l_linenumber > 5)")
def committed_json(spark, d):
    """Rows that stand in a committed sink after a first result was replaced and a second part added."""
    path = new_path(spark, "committed")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber > 5").select(F.col("l_suppkey").alias("paper_id"), (F.col("l_partkey") % 200).alias("url"), F.col("l_returnflag").alias("label")).distinct()
    committed.write_committed(rows.limit(10), path)
    committed.write_committed(rows.where("url % 2 = 0"), path)
    committed.write_committed(rows.where("url % 2 = 1"), path, mode="append")
    return committed.read_committed(spark, path, "paper_id long, url long, label string")


_MARKS = ("NaN", "nan", "-nan", "NULL", "#N/A", "1.#IND", "<NA>", "None", "x NaN", "nil", "NAN")


@query(f"SELECT {_ID} AS paper_id, CASE WHEN m NOT IN ('x NaN', 'nil', 'NAN') THEN NULL ELSE m END AS value, m NOT IN ('x NaN', 'nil') AS missing FROM (SELECT paper_id, ({list(_MARKS)})[1 + paper_id % {len(_MARKS)}] AS m FROM {_PAGES})")
def missing_values(spark, d):
    """Marks of missing values that a CSV file holds, and the guard for those it keeps."""
    path = new_path(spark, "marks")
    mark = F.element_at(F.array(*map(F.lit, _MARKS)), (1 + F.col("paper_id") % len(_MARKS)).cast("int"))
    files.write_csv(load(spark, d, "urls").select(_key().alias("paper_id"), mark.alias("value")), path)
    return files.read_csv(spark, path, "paper_id string, value string").withColumn("missing", is_missing(F.col("value")))


@query(f"SELECT {_ID} AS paper_id, length(url)::BIGINT AS size FROM {_PAGES} WHERE paper_id % 5 = 1")
def converted_files(spark, d):
    """Papers of a sample whose derived path is a file, with its size."""
    root = _written(spark, d, "converted", F.concat(_key(), F.lit(".md")), F.col("url"), "paper_id % 5 = 1")
    sample = load(spark, d, "urls").select(_key().alias("paper_id"), F.concat(F.lit(f"{root}/"), _key(), F.lit(".pdf")).alias("pdf_path"))
    return files.existing(sample.withColumn("path", files.converted_path(F.col("pdf_path")))).select("paper_id", "size")
