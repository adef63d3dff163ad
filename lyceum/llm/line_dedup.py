"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

A run is a table of (h1, h2, n_docs, last_doc), one row per line key, bucketed by hash and sorted inside each bucket, so that
runs meet by merging, without a shuffle. A new batch of documents is reduced to its keys and merge-anti-joined with the runs:
keys that no run holds become the batch's own run at level 0, so each key stands in one run; keys seen before are noted
beside the runs with their counts. As soon as a level holds `fanout` runs they are merged to one of the next level. A line
that stands in several documents is then either noted, or frequent inside its first batch already: the others, most of all
lines, never move again. A key is two seeded 64-bit hashes, 128 bits together.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lyceum.llm.shared import discard, heavy_join, narrow, shared_dir, stored, text_or_empty

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def hashed(line: Column, min_chars: int) -> Column:
    """struct(h1, h2) of a line's key; null if the key has fewer than min_chars code points."""

    def of(key: Column) -> Column:
        pair = F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))
        return F.when(F.length(key) >= min_chars, pair)

    return F.transform(F.array(line_key(line)), of)[0]


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row (doc_id, h1, h2) for each document and each of its distinct long enough keys."""
    pairs = F.transform(lines_of(text_or_empty()), lambda x: hashed(x, min_chars))
    found = F.array_distinct(F.filter(pairs, lambda x: x.isNotNull()))
    return docs.select("doc_id", F.explode(found).alias("k")).select("doc_id", "k.h1", "k.h2")


@contextmanager
def _sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Inside, a bucket of one file counts as sorted, so that runs are merged without sorting them again."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class LineRuns:
    """The levelled runs. `levels[i]` holds the names of the runs of level i, fewer than `fanout` of them; `noted` those of the
    tables of keys that a later batch holds again. Batches may arrive at any time, for instance from a stream's foreachBatch.

    The tables are external ones in the cluster's shared folder; close() drops and deletes them.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.noted: list[str] = []
        self.paths: dict[str, str] = {}

    def _write(self, run: DataFrame) -> str:
        name = f"lyceum_run_{uuid.uuid4().hex}"
        self.paths[name] = shared_dir(self.spark)
        out = run.select(*KEY, "n_docs", "last_doc").write.format("parquet").option("path", self.paths[name])
        with _sorted_buckets(self.spark):
            out.bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        return name

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, self.paths.pop(name))

    def _runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose key no run holds."""
        return reduce(lambda df, run: df.join(run.hint("merge"), KEY, "left_anti"), self._runs(), batch)

    def add(self, hashes: DataFrame) -> None:
        """Adds a batch: (doc_id, h1, h2), each document and key once; no document may come in two batches."""
        tally = hashes.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        batch = self._write(tally)
        if not any(self.levels):
            self._put(0, batch)
            return
        whole = self.spark.table(batch)
        fresh = self._write(self.unseen(whole))
        self.noted.append(self._write(whole.join(self.spark.table(fresh).hint("merge"), KEY, "left_anti")))
        self._drop(batch)
        self._put(0, fresh)

    def _put(self, level: int, run: str) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self._write(_merged([self.spark.table(name) for name in full]))
            self._drop(*full)
            self._put(level + 1, merged)

    def common(self, min_docs: int) -> DataFrame:
        """(h1, h2, n_docs, last_doc) of the keys that stand in at least min_docs documents, stored."""
        runs, noted = self._runs(), [self.spark.table(name) for name in self.noted]
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, n_docs long, last_doc long")
        again = _merged(noted).select(*KEY, F.col("n_docs").alias("more"), F.col("last_doc").alias("later")) if noted else None
        parts = []
        for run in runs:
            both = run.join(again.hint("merge"), KEY, "left") if noted else run.withColumn("more", F.lit(0)).withColumn("later", F.lit(None))
            n_docs = F.col("n_docs") + F.coalesce("more", F.lit(0))
            last = F.greatest("last_doc", "later")
            parts.append(both.select(*KEY, n_docs.alias("n_docs"), last.cast("long").alias("last_doc")).where(F.col("n_docs") >= min_docs))
        with _sorted_buckets(self.spark):
            return stored(reduce(DataFrame.unionByName, parts))

    def close(self) -> None:
        self._drop(*self.paths)
        self.levels, self.noted = [[]], []


def _merged(runs: list[DataFrame]) -> DataFrame:
    both = reduce(DataFrame.unionByName, runs)
    return both.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4) -> DataFrame:
    """(doc_id, gone: sorted array of struct(h1, h2)): the keys that a document has to give up, documents without any left out.

    Rows with one doc_id are one document. The documents are dealt to batches by doc_id; each batch goes through the runs.
    """
    hashes = line_hashes(docs, min_chars)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    kept = stored(hashes.withColumn("batch", batch), "batch")
    runs = LineRuns(docs.sparkSession)
    try:
        for k in range(batches):
            runs.add(kept.where(F.col("batch") == k).select("doc_id", *KEY).distinct())
        common = runs.common(min_docs)
    finally:
        runs.close()
    hit = heavy_join(kept.select("doc_id", *KEY), common, KEY, "n_docs", "inner")
    lost = hit.where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    return lost.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct(*KEY))).alias("gone"))


def among(value: Column, found: Column) -> Column:
    """Whether a sorted array of structs holds value, by halving; so a long text with many repeated lines is no square of them."""

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        below = F.get(found, mid) < value
        lo = F.when(s["lo"] >= s["hi"], s["lo"]).when(below, mid + 1).otherwise(s["lo"])
        hi = F.when((s["lo"] >= s["hi"]) | below, s["hi"]).otherwise(mid)
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(found) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("lo"), F.size(found).alias("hi"))
    return F.aggregate(steps, start, halve, lambda s: F.coalesce(F.get(found, s["lo"]) == value, F.lit(False)))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text.

    Keys of at least min_chars code points found in at least min_docs documents lose all their lines except in the
    largest doc_id holding it. A null or empty text is one empty line. Documents are told apart by doc_id; rows that
    share one (null among them) count as one document and keep their own rows. All columns of docs are kept, save that
    n_lines, n_dropped and kept_text are replaced.
    """
    slim = narrow(docs, "doc_id", "text")
    gone = repeated_lines(slim, min_chars, min_docs, batches).withColumnRenamed("doc_id", "_gone_of")
    base = docs.drop("n_lines", "n_dropped", "kept_text")
    joined = base.join(gone, base["doc_id"].eqNullSafe(gone["_gone_of"]), "left")
    lines = lines_of(text_or_empty())

    def stays(line: Column) -> Column:
        key = hashed(line, min_chars)
        few = F.coalesce(F.array_contains("gone", key), F.lit(False))
        many = F.get(F.transform(F.array(key), lambda k: F.when(k.isNull(), F.lit(False)).otherwise(among(k, F.col("gone")))), 0)
        return ~F.when(F.size("gone") <= 16, few).otherwise(many)

    kept = F.when(F.col("gone").isNull(), lines).otherwise(F.filter(lines, stays))
    whole = joined.withColumn("_kept", kept)
    return whole.select(
        *base.columns,
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size("_kept")).cast("long").alias("n_dropped"),
        F.array_join("_kept", "\n").alias("kept_text"),
    )


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    out = drop_repeated_lines(narrow(docs, "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
