"""What several corpus operators need: shared storage, global row numbers, joins that bear hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key counts as heavy from one part in so many of all rows on: at most so many keys can.
HEAVY_PARTS = 400
#: Rows and bytes that a Python worker turns to objects at once. Spark bounds the batches it sends by bytes itself.
SLICE_ROWS, SLICE_BYTES = 500, 8 << 20

_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under the one that the cluster names in spark.checkpoint.dir.

    Where none is named, a temporary folder will do for a local master only; elsewhere that is an error, as executors and
    driver would not see each other's files. The setting is static in Spark, so it is read and never written here.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", None) or ""
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share: intermediate tables are stored there")
        base = f"file://{tempfile.gettempdir()}/lyceum-checkpoints"
    path = f"{base.rstrip('/')}/lyceum-{uuid.uuid4().hex}"
    _made.setdefault(base, []).append(path)
    return path


#: Lets Spark drop the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, *partition_by: str, path: str | None = None, tidy: bool = False) -> DataFrame:
    """df written once to shared storage and read again: cuts the lineage, and survives lost executors.

    tidy: the shuffle files of the write go as soon as it is done, not when the driver next collects its garbage. For chains of large
    tables; a later use of df itself, not of what is returned, shuffles anew.
    """
    spark, path = df.sparkSession, path or shared_dir(df.sparkSession)
    before = spark.conf.get(_CLEANUP, "false")
    try:
        spark.conf.set(_CLEANUP, "true" if tidy else before)
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_in = path
    return table


def drop_stored(*tables: DataFrame) -> None:
    """Deletes what `stored` wrote for these tables, as returned by it, when later ones have taken their place."""
    for table in tables:
        discard(table.sparkSession, table._stored_in)


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes stored tables that no result reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


def discard_all(spark: SparkSession) -> None:
    """Deletes all tables that this process has stored; for a job's end, when its results are written elsewhere."""
    for paths in _made.values():
        discard(spark, *paths)
    _made.clear()


def arrow_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most SLICE_ROWS rows and about SLICE_BYTES bytes, so that few texts are Python objects at once."""
    for batch in batches:
        each = max(1, batch.nbytes // max(1, batch.num_rows))
        n = max(1, min(SLICE_ROWS, SLICE_BYTES // each))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further columns of the input can't clash with made ones."""
    return docs.select(*(F.col(f"`{c}`") for c in columns))


def numbered(df: DataFrame, order: Sequence[str], number: str = "row_no") -> DataFrame:
    """Dense global row numbers from 0 in the given order, without bringing all rows to one task.

    Range partitions are sorted and stored; each row's number is its place in its partition plus the sizes of
    the partitions before it. The table of sizes has one row per partition, so the broadcast is bounded by their
    count. Equal rows are interchangeable; nulls come first.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranges = stored(ranged.withColumn("_at", F.monotonically_increasing_id()))
    cut = ranges.withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(
        F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    starts = sizes.select("_part", before.alias("_start"))
    table = cut.join(F.broadcast(starts), "_part").withColumn(number, F.col("_start") + F.col("_in")).drop("_part", "_start", "_in", "_at")
    table._stored_in = ranges._stored_in
    return table


def heavy_join(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, how: str = "left") -> DataFrame:
    """Joins left with right (one row per key) where a few keys may hold most rows of left.

    `weight` is a column of right: how many rows of left its key has at most. Keys with at least 1/HEAVY_PARTS of
    the summed weights number HEAVY_PARTS at most, which bounds their broadcast; all other keys are joined by a
    shuffle, in which none stands out. `how` is left or inner. right is read twice and should be stored.
    """
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    bound = max(1, total // HEAVY_PARTS)
    made = [c for c in right.columns if c not in keys and c != weight]
    heavy = right.where(F.col(weight) >= bound).select(
        *keys, F.struct(*made).alias("_heavy") if made else F.lit(True).alias("_heavy")
    )
    marked = left.join(F.broadcast(heavy), list(keys), "left")
    light = right.where(F.col(weight) < bound).drop(weight)
    kept = [c for c in left.columns if c not in keys]
    few = marked.where(F.col("_heavy").isNotNull()).select(
        *keys, *kept, *((F.col(f"_heavy.{c}").alias(c)) for c in made)
    )
    many = marked.where(F.col("_heavy").isNull()).drop("_heavy").join(light, list(keys), how)
    return few.unionByName(many.select(*few.columns))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def place_among(value: Column, bounds: Sequence[int]) -> Column:
    """How many of the ascending bounds are below value: a binary search over a literal array."""
    if not bounds:
        return F.lit(0)
    array = F.lit(list(bounds)).cast("array<long>")

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        below = F.get(array, mid) < value
        lo = F.when(s["lo"] >= s["hi"], s["lo"]).when(below, mid + 1).otherwise(s["lo"])
        hi = F.when((s["lo"] >= s["hi"]) | below, s["hi"]).otherwise(mid)
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    steps = F.array(*(F.lit(k) for k in range(len(bounds).bit_length() + 1)))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(steps, start, halve, lambda s: s["lo"])
