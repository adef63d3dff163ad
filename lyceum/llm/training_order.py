"""Training-order materialisation: token sequences in a keyed random order, in fixed-stride shards.

Documents are tokenised and joined, an end mark after each, and cut into sequences of a fixed length, which are stored once
and numbered. A keyed Feistel permutation with cycle-walking gives each number its global slot, and slot s stands in shard
s div per_shard at place s mod per_shard. Tasks are dealt ranges of whole shards and write them in slot order, every row of
one fixed width, in small pages: a reader finds any slot by the file's page index, without the rest of its shard, reads on
sequentially, and resumes from a slot number alone. Shards are written by Spark's own committed writer, so tasks lost or
repeated leave neither gaps nor doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lyceum.llm.bpe import RANKS, read_ranks
from lyceum.llm.shared import arrow_batches, discard, narrow, shared_dir, text_or_empty
from lyceum.llm.sharding import permuted

LENGTH, PER_SHARD, KEY = 2048, 4096, 7
#: Bytes of a page: what a reader has to decompress for one slot.
PAGE = 64 << 10
#: Bytes of ids that one task writes.
TASK_BYTES = 512 << 20
SCHEMA = "slot long, shard int, place int, first_doc long, n_tokens int, ids binary"
#: Fills up the last sequence of a partition; no token has it.
PAD = 65535

_tokenizers: dict[tuple[str, str], object] = {}


def tokenizer(path: str, pattern: str):
    """The library's encoding of the ranks at path, without special tokens."""
    import tiktoken

    key = (path, pattern)
    if key not in _tokenizers:
        _tokenizers[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return _tokenizers[key]


def sequences(docs: DataFrame, path: str, pattern: str, length: int = LENGTH) -> DataFrame:
    """(first_doc, n_tokens, ids): ids are `length` little-endian unsigned 16-bit ids; the id after the last rank ends a
    document. Only the last sequence of a partition is filled up. A partition is read as a stream."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path, pattern)
        end = coder.n_vocab
        left, owners = np.zeros(0, np.uint16), np.zeros(0, np.int64)
        known = np.zeros(0, bool)

        def rows(ids: np.ndarray, docs_: np.ndarray, has: np.ndarray, full: int) -> pa.RecordBatch:
            block = ids.reshape(-1, length)
            first = np.arange(0, len(ids), length)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(docs_[first], mask=~has[first]), pa.array(np.full(len(block), full), pa.int32()),
                    pa.array([row.tobytes() for row in block], pa.binary()),
                ],
                ["first_doc", "n_tokens", "ids"],
            )

        for batch in arrow_batches(batches):
            coded = [[*coder.encode_ordinary(t), end] for t in batch.column("text").to_pylist()]
            sizes = [len(c) for c in coded]
            ids = batch.column("doc_id")
            present = np.array(ids.is_valid().to_pylist(), bool)
            number = np.array([x or 0 for x in ids.to_pylist()], np.int64)
            left = np.concatenate([left, *(np.array(c, np.uint16) for c in coded)])
            owners = np.concatenate([owners, np.repeat(number, sizes)])
            known = np.concatenate([known, np.repeat(present, sizes)])
            whole = len(left) // length * length
            if whole:
                yield rows(left[:whole], owners[:whole], known[:whole], length)
                left, owners, known = left[whole:], owners[whole:], known[whole:]
        if len(left):
            fill = length - len(left)
            ids = np.concatenate([left, np.full(fill, PAD, np.uint16)])
            yield rows(ids, np.resize(owners, length), np.resize(known, length), len(left))

    slim = narrow(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    return slim.mapInArrow(cut, "first_doc long, n_tokens int, ids binary")


def write_shards(rows: DataFrame, path: str, key: int = KEY, per_shard: int = PER_SHARD, length: int = LENGTH) -> None:
    """Writes rows (first_doc, n_tokens, ids of `length` tokens) to path in the order of their slots, as (slot, shard, place, first_doc, n_tokens, ids).

    rows are stored and numbered first; the table of partition sizes is bounded by their count. A task writes one file of
    consecutive whole shards. There are as many tasks as shuffle partitions, whatever the number of shards, but more where
    one would get over TASK_BYTES.
    """
    spark = rows.sparkSession
    kept = shared_dir(spark)
    rows.withColumn("_at", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(kept)
    cut = spark.read.parquet(kept)
    cut = cut.withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    n = cut.count()
    shards = max(1, -(-n // per_shard))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * 2 * length // TASK_BYTES)
    each = -(-shards // tasks)
    slots = cut.join(F.broadcast(starts), "_part").withColumn("slot", permuted(F.col("_start") + F.col("_in"), n, key))
    shard = F.floor(F.col("slot") / F.lit(per_shard)).cast("int")
    placed = slots.select("slot", shard.alias("shard"), F.pmod("slot", F.lit(per_shard)).cast("int").alias("place"), "first_doc", "n_tokens", "ids")
    ranged = placed.repartitionById(-(-shards // each), F.floor(F.col("shard") / F.lit(each)).cast("int")).sortWithinPartitions("slot")
    options = {"compression": "zstd", "parquet.page.size": PAGE, "parquet.enable.dictionary": "false"}
    ranged.write.options(**options).parquet(path)
    discard(spark, kept)


def read_slots(shards: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    """The rows of the slots from start up to stop; the condition reaches the scan, which skips other files and pages."""
    inside = F.col("slot") >= start
    return shards.where(inside if stop is None else inside & (F.col("slot") < stop))


def materialise(docs: DataFrame, path: str | None = None, key: int = KEY, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Writes docs (doc_id, text) as shards in training order to the shared folder; returns the shards.

    A null text is empty: it leaves its end mark only. Rows with a null or repeated doc_id are written like any other; an
    empty table gives no shard; other columns are not looked at. The order depends on the key and on the stored sequences,
    which follow the layout of docs.
    """
    import public_tokenizers

    ranks = path or public_tokenizers.path(RANKS)
    out = shared_dir(docs.sparkSession)
    write_shards(sequences(docs, ranks, public_tokenizers.PATTERN, length), out, key, per_shard, length)
    return docs.sparkSession.read.schema(SCHEMA).parquet(out)


def order_digest(docs: DataFrame) -> DataFrame:
    rows = read_slots(materialise(docs))
    return rows.select("slot", "shard", "place", "first_doc", "n_tokens", F.crc32("ids").alias("ids_crc32"))
