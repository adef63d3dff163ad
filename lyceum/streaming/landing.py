"""Incremental processing of a landing folder: each micro-batch goes through the same anti-join as a batch run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def follow(
    spark: SparkSession, folder: str, schema: str, checkpoint: str, each: Callable[[DataFrame, int], None], files: int = 100
) -> StreamingQuery:
    """Runs `each` on the rows of new Parquet files under the folder until all present ones are done."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def land_once(rows: DataFrame, batch: int, path: str) -> bool:
    """Writes a batch to its own folder of the table at path, once: False if it is there already.

    A folder counts as written when Spark's success marker is in it, so the markers are the ledger of batches. What a broken attempt
    has left is replaced by the next one.
    """
    spark, target = rows.sparkSession, f"{path.rstrip('/')}/batch={batch}"
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        return False
    rows.write.mode("overwrite").parquet(target)
    return True


def follow_into(
    spark: SparkSession, folder: str, schema: str, checkpoint: str, path: str, of: Callable[[DataFrame], DataFrame], files: int = 100
) -> StreamingQuery:
    """of(rows) of all new files under the folder, in the table at path exactly once: a stream that ends between writing a batch and
    noting it in the checkpoint gets the same files again under the same number."""

    def each(rows: DataFrame, batch: int) -> None:
        land_once(of(rows), batch, path)

    return follow(spark, folder, schema, checkpoint, each, files)
