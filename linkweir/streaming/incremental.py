"""Incremental extraction: new files only, exactly once per document id, with Structured Streaming's own bookkeeping."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

#: State by key that lies on the executors' disks; a batch writes what it changed to the checkpoint, not the whole state.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings that a query takes over when it starts, put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def extract_incrementally(spark: SparkSession, source: str, schema: str, urls: Column, target: str, checkpoint: str, files_per_batch: int = 100) -> DataFrame:
    """Read Parquet files that ``source`` gained since the last call, add (paper_id, urls) to ``target``, return all of it.

    ``schema`` has paper_id, of any type. An id that was seen before, in this call or an earlier one, is skipped; a paper
    without URLs leaves a row with an empty array, so ``not_done`` does not bring it back. The ids are keyed state of the
    query, kept with its ``checkpoint``: a batch looks up its own ids and reads nothing of the target, whose size does not
    matter to it. A batch that is cut off is written over when it is run again. Rows with a null id are taken once."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    kept = StructType().add("paper_id", stream.schema["paper_id"].dataType).add("urls", ArrayType(StringType()))
    table = StructType([*kept, *StructType().add("batch", LongType())])
    spark.createDataFrame([], kept).write.mode("ignore").parquet(f"{target}/batch=-1")
    first = stream.select("paper_id", F.coalesce(urls, F.array().cast("array<string>")).alias("urls")).dropDuplicates(["paper_id"])

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    with _settings(spark, STATE):
        query = first.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(table).parquet(target).select("paper_id", "urls")


def not_done(todo: DataFrame, done: DataFrame, key: str = "paper_id") -> DataFrame:
    """The batch form of resuming: rows whose id the target does not have."""
    return todo.join(done.select(key), key, "left_anti")
