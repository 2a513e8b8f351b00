"""Helpers that the corpus operators share: the shared folder, written tables, words and hashes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D, nothing else.
WORD_SPACE = " \t\n\x0b\x0c\r"
#: The same as a character class that Java, RE2 and Python read alike.
WORD_SPACE_CLASS = "[\\x20\\x09-\\x0D]+"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of a folder that driver and executors share: ``spark.checkpoint.dir`` where it is set.

    A session on one machine without that setting (tests) gets a temporary folder; on a cluster it is an error.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_dirs.setdefault(app, "file://" + tempfile.mkdtemp(prefix="linkweir-"))
    return f"{base.rstrip('/')}/linkweir-{app}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, parts: int | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder: the table read back, and its path. Cuts the lineage, survives lost executors.

    ``parts`` is the most tasks and files of tables whose size the caller knows to be small for each task."""
    path = fresh_path(df.sparkSession, tag)
    (df.coalesce(parts) if parts else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str, parts: int | None = None) -> DataFrame:
    return written(df, tag, parts)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Put an empty table in the place of a written one that nothing reads any more; Spark deletes its files."""
    spark.createDataFrame([], "gone int").write.mode("overwrite").parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound the rows of an Arrow batch where the session has Spark's default (which bounds its bytes to 64 MB already)."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(doc_id: Column | str) -> Column:
    """crc32 of the id as text; null for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string").cast("binary"))


def is_held_out(doc_id: Column | str, mod: int, remainder: int) -> Column:
    """True if crc32(id) mod ``mod`` is ``remainder``; a null id is never held out."""
    return F.coalesce(id_crc(doc_id) % mod == remainder, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, as UTF-8: ``bytes.lower`` and ``bytes.split`` touch ASCII only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def words_column(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_SPACE_CLASS))


def labelled_sample(labels: DataFrame, label: str, mod: int, remainder: int, per_class: int) -> tuple[dict[str, int], dict[int, float]]:
    """Ids (as text) and labels of a bounded sample of the training rows, and the weight of either class.

    At most about ``per_class`` ids of each class, taken by a hash of the id (at random, the same each time). Ids in the
    held-out part, null ids and null labels are left out; an id with several labels has the largest. The weights restore
    the classes' shares among all training rows.
    """
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~is_held_out("doc_id", mod, remainder))
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    sizes = {int(r["y"]): r["count"] for r in rows.groupBy((F.col("y") > 0).alias("y")).count().collect()}
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    limit = F.lit(None)
    for y, n in sizes.items():
        limit = F.when((F.col("y") > 0) == bool(y), F.lit(min(1.0, per_class / max(n, 1)))).otherwise(limit)
    taken = {r["doc_id"]: int(r["y"] > 0) for r in rows.where(share < limit).select(F.col("doc_id").cast("string"), "y").collect()}
    got = {y: sum(v == y for v in taken.values()) for y in (0, 1)}
    total = max(1, sum(sizes.values()))
    weights = {y: (sizes.get(y, 0) / total) / (got[y] / max(1, len(taken))) if got[y] else 0.0 for y in (0, 1)}
    return taken, weights


def join_sample(docs: DataFrame, taken: dict[str, int]) -> DataFrame:
    """Rows of ``docs`` whose id is in the sample, with its label ``y``; the sample is bounded, so it is broadcast."""
    ids = docs.sparkSession.createDataFrame(list(taken.items()), "sample_id string, y int")
    return docs.select(F.col("doc_id").cast("string").alias("sample_id"), "text").join(F.broadcast(ids), "sample_id")


def kept_columns(docs: DataFrame, columns: list[str] | None, made: tuple[str, ...]) -> list[str]:
    """The columns (default: doc_id) that stay beside those an operator makes; of equal names the operator's stays."""
    return [c for c in columns or ["doc_id"] if c not in made]
