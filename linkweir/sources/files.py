"""File sources and sinks. Each reads with a fixed schema, so that there is no pass to infer one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .blobs import ask, copy_files, names_in, read_folders

STAGE = "filename string, url_count int, urls array<string>"
GROUND_TRUTH = "arxiv_id string, URL string, OADS string, location string, `Spatial Complexity` string, `Lexicographical Complexity` string, `Representational Complexity` string"
CONVERSION = "arxiv_id string, source_pdf_path string, target_xml_path string, status string, timestamp string, error string"
#: What a reader of CSV takes for a missing value.
NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def stem(path: Column, ext: str) -> Column:
    return F.regexp_extract(path, rf"([^/]+)\.{ext}$", 1)


def list_files(spark: SparkSession, root: str, ext: str) -> DataFrame:
    """paper_id and path of all files with an extension; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}").option("recursiveFileLookup", True).load(root)
    return files.select(stem(F.col("path"), ext).alias("paper_id"), "path", "length")


def whole_texts(spark: SparkSession, root: str, ext: str) -> DataFrame:
    """paper_id and content, one row a file."""
    t = spark.read.option("pathGlobFilter", f"*.{ext}").option("recursiveFileLookup", True).text(root, wholetext=True)
    return t.select(stem(F.col("_metadata.file_path"), ext).alias("paper_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def with_content(papers: DataFrame, texts: DataFrame) -> DataFrame:
    """Every paper, with an empty text where there is no file."""
    return papers.join(texts.select("paper_id", "content"), "paper_id", "left").withColumn("content", F.coalesce("content", F.lit("")))


def latex_sources(spark: SparkSession, root: str, papers: DataFrame | None = None) -> DataFrame:
    """.tex and .bbl files with the paper that their first folder below ``root`` names, listed and read by tasks.

    ``papers`` has the paper_id of each folder that is wanted; without it all that ``root`` holds are read."""
    names = names_in(spark, root) if papers is None else papers.select(F.col("paper_id").cast("string").alias("name"))
    return read_folders(names, root, (".tex", ".bbl")).withColumnRenamed("name", "paper_id")


def main_file(sources: DataFrame) -> DataFrame:
    """The main .tex of each paper: the longest that starts a document, else the largest file."""
    has = F.col("content").rlike(r"\\documentclass|\\begin\{document\}")
    tex = sources.where(F.col("path").endswith(".tex")).withColumn("_has", has)
    # as columns, so that a content is searched once and goes no further than its task unless it is asked for
    tex = tex.withColumn("_long", F.when(F.col("_has"), F.length("content")).otherwise(F.col("size")))
    rank = F.row_number().over(W.partitionBy("paper_id").orderBy(F.desc("_has"), F.desc("_long"), "path"))
    return tex.withColumn("_n", rank).where("_n = 1").drop("_n", "_has", "_long")


def first_file(files: DataFrame) -> DataFrame:
    """The first file of each paper in path order."""
    return files.withColumn("_n", F.row_number().over(W.partitionBy("paper_id").orderBy("path"))).where("_n = 1").drop("_n")


def read_json(spark: SparkSession, path: str, schema: str, multiline: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed CSV with quoted line breaks; the usual marks of missing values become null."""
    t = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return t.select(*(F.when(F.col(f"`{c}`").isin(*NA), None).otherwise(F.col(f"`{c}`")).alias(c) if k == "string" else F.col(f"`{c}`") for c, k in t.dtypes))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Lines year|id|path."""
    return spark.read.schema("year int, paper_id string, path string").option("sep", "|").csv(path)


def write_manifest(df: DataFrame, path: str) -> None:
    df.select("year", "paper_id", "path").write.mode("overwrite").option("sep", "|").csv(path)


def strided(rows: DataFrame, place: str, part: int, parts: int) -> DataFrame:
    """Every ``parts``-th row from the ``part``-th on, by the rows' numbers."""
    return rows.where(F.pmod(F.col(place), F.lit(parts)) == part)


def existing(manifest: DataFrame) -> DataFrame:
    """The rows whose ``path`` is a file, with its ``size``; tasks ask for their own paths and nothing is listed."""
    return ask(manifest).where(F.col("size").isNotNull())


def read_status_files(spark: SparkSession, path: str) -> DataFrame:
    """Conversion records; a file that does not parse has the status corrupted_json and its name as id."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", CONVERSION).alias("r"))
    bad = F.col("r.arxiv_id").isNull()
    return t.select(F.when(bad, F.col("file")).otherwise(F.col("r.arxiv_id")).alias("paper_id"), F.when(bad, F.lit("corrupted_json")).otherwise(F.col("r.status")).alias("status"), F.try_to_timestamp("r.timestamp").alias("at"), F.col("r.error").alias("error"))


def read_success_markers(spark: SparkSession, path: str, schema: str = "arxiv_id string, html_path string") -> DataFrame:
    """One JSON object a line or file; what does not parse is skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_selected(rows: DataFrame, path: str) -> None:
    """A list of paths for each category."""
    rows.select("category", F.col("path").alias("value")).write.mode("overwrite").partitionBy("category").text(path)


def copy_selected(rows: DataFrame, root: str) -> None:
    """A list of paths for each category below ``root``/lists, and copies of those files below ``root``/<category>.

    A selected file that is missing stands in its list and is not copied; files of one name in a category overwrite each other."""
    write_selected(rows, f"{root}/lists")
    target = F.concat_ws("/", F.lit(root.rstrip("/")), "category", F.substring_index("path", "/", -1))
    copy_files(rows.where("category is not null").select("path", target.alias("target"))).write.format("noop").mode("overwrite").save()


def converted_path(pdf_path: Column, ext: str = ".md") -> Column:
    """Where a conversion of a PDF lies: every ".pdf" of the path is replaced."""
    return F.replace(pdf_path, F.lit(".pdf"), F.lit(ext))


def read_tracker_logs(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (year, paper_id) of logs named <year>_task_<n>.log with an id a line."""
    t = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d{4})_task_\d+\.log$", 1).try_cast("int").alias("year"), F.trim("value").alias("paper_id"))
    return t.where((F.col("paper_id") != "") & F.col("year").isNotNull()).distinct()


def hardware_tally(spark: SparkSession, path: str) -> DataFrame:
    """Logs by the accelerator that they name."""
    t = spark.read.text(path, wholetext=True)
    kind = F.when(F.col("value").contains("A100"), "A100").when(F.col("value").contains("V100"), "V100")
    return t.select(kind.alias("kind")).where(F.col("kind").isNotNull()).groupBy("kind").agg(F.count("*").alias("logs"))


def combined_json(merged: DataFrame) -> DataFrame:
    """{paper: {format: record}} as one JSON text a paper."""
    rec = F.struct(F.col("url_count"), F.col("urls"))
    m = merged.groupBy("paper_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("format").cast("string").alias("format"), rec.alias("record"))))).alias("formats"))
    return m.select("paper_id", F.to_json("formats").alias("json"))
