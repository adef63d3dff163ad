"""Stored documents: scans, appends, updates, and the joins between raw and processed ones. Parquet is the store."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, schema: str | None = None, **equal: object) -> DataFrame:
    """Rows of a table whose columns equal the given values; the filters reach the scan."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    for name, value in equal.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def append(df: DataFrame, path: str, *partition_by: str, sort_by: Sequence[str] = ()) -> None:
    """Adds rows; equal rows are added again.

    Folders by partition_by and the order of rows inside each file stand in for indexes: a scan for equal values reads the
    folders that have them, and of their files the row groups whose range of sort_by can hold them.
    """
    ordered = df.sortWithinPartitions(*partition_by, *sort_by) if sort_by else df
    ordered.write.mode("append").partitionBy(*partition_by).parquet(path)


def updated_first(df: DataFrame, match: Column, order: list[str], **values: object) -> DataFrame:
    """df with the values set in the first matching row in the given order, and in no other; nothing is inserted.

    The order must tell rows apart: the first one is found by a top-1 sort of keys, not by moving the table.
    """
    first = df.where(match).orderBy(*order).select(*order).limit(1)
    marked = df.join(F.broadcast(first.withColumn("_hit", F.lit(True))), order, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    for name, value in values.items():
        marked = marked.withColumn(name, F.when(hit, F.lit(value)).otherwise(F.col(name)))
    return marked.select(*df.columns)


def _bucketed_table(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> str:
    """The name of a table over the files at path. Dropping it leaves the files, which are outside the warehouse."""
    name = f"lyceum_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def append_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Adds rows to a store that is dealt into buckets by a hash of the key, for joins that move no row of it (`bucketed`). All appends
    to one path take the same key and number of buckets. df is dealt out by the key first, so a batch adds one file to each bucket."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    name = _bucketed_table(df.sparkSession, path, schema, key, buckets)
    try:
        df.repartition(buckets, key).write.insertInto(name)
    finally:
        df.sparkSession.sql(f"DROP TABLE {name}")


def bucketed(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """The rows of such a store. Spark knows how they are dealt, so joins and groups by the key need no shuffle on this side."""
    name = _bucketed_table(spark, path, schema, key, buckets)
    try:
        return spark.table(name).select("*")  # resolved by its columns now: files and layout are known, the name may go
    finally:
        spark.sql(f"DROP TABLE {name}")


def update_in_place(spark: SparkSession, path: str, match: str, order: Sequence[str], **values: object) -> bool:
    """Sets values in the first row of a Parquet table that matches, in the given order, which must tell rows apart; False without one.

    Only the file that holds the row is written anew, beside the table, and takes the old one's name by one rename: readers see the old
    file or the new one. (The file system must replace files by rename, as HDFS and local ones do; object stores do not.) Columns of
    the table's folders can't be set.
    """
    table = spark.read.parquet(path)
    first = table.where(match).select(*order, F.col("_metadata.file_path").alias("_file")).orderBy(*order).limit(1).collect()
    if not first:
        return False
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    old = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(first[0]["_file"]))
    folders = {part.split("=")[0] for part in first[0]["_file"].split("/")[:-1] if "=" in part} & set(table.columns)
    if folders & set(values):
        raise ValueError("columns of the table's folders can't be set in place")
    row = F.expr(match)
    for name in order:
        row = row & F.col(name).eqNullSafe(F.lit(first[0][name]))
    changed = spark.read.option("basePath", path).schema(table.schema).parquet(str(old))
    for name, value in values.items():
        changed = changed.withColumn(name, F.when(F.coalesce(row, F.lit(False)), F.lit(value).cast(table.schema[name].dataType)).otherwise(F.col(name)))
    staged = f"{path.rstrip('/')}/_update-{uuid.uuid4().hex}"
    changed.drop(*folders).coalesce(1).write.parquet(staged)
    system = old.getFileSystem(conf)
    (new,) = (f.getPath() for f in system.globStatus(jvm.org.apache.hadoop.fs.Path(f"{staged}/part-*.parquet")))
    overwrite = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    overwrite[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), conf).rename(new, old, overwrite)
    system.delete(jvm.org.apache.hadoop.fs.Path(staged), True)
    return True


def unprocessed(raw: DataFrame, processed: DataFrame, raw_id: str = "raw_id", by: str = "raw_data_id") -> DataFrame:
    """Raw rows that no processed row names."""
    done = processed.select(F.col(by).alias("_done"))
    return raw.join(done, raw[raw_id] == F.col("_done"), "left_anti")


def processed_only(raw: DataFrame, processed: DataFrame, raw_id: str = "raw_id", by: str = "raw_data_id") -> DataFrame:
    done = processed.select(F.col(by).alias("_done"))
    return raw.join(done, raw[raw_id] == F.col("_done"), "left_semi")


def exists_among(urls: DataFrame, stored: DataFrame, url: str = "url") -> DataFrame:
    """urls that are stored already."""
    return urls.join(stored.select(url).distinct(), url, "left_semi")


def with_parent(children: DataFrame, parents: DataFrame, parent_id: Column, raw_id: str = "raw_id") -> DataFrame:
    """Children (tables, images, files) beside the page they were found on, its columns prefixed parent_."""
    renamed = parents.select(*(F.col(c).alias(f"parent_{c}") for c in parents.columns))
    return children.join(renamed, parent_id == F.col(f"parent_{raw_id}"))


def latest(df: DataFrame, key: str, order: str, *ties: str) -> DataFrame:
    """The newest row of each key; ties go to the smallest tie-breakers."""
    w = Window.partitionBy(key).orderBy(F.desc(order), *ties)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def type_counts(raw: DataFrame, page_type: str = "page_type") -> DataFrame:
    """(page_type, n): rows of each type, unknown for none."""
    return raw.groupBy(F.coalesce(page_type, F.lit("unknown")).alias("page_type")).agg(F.count("*").alias("n"))


def progress(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """One row: total raw rows and how many are processed."""
    ids = processed.select(F.col("raw_data_id").alias("raw_id"), F.lit(1).alias("_p")).distinct()
    return raw.join(ids, "raw_id", "left").agg(F.count("*").alias("total"), F.count("_p").alias("processed"))


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)
