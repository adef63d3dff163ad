"""Blocks of dictionary-encoded words: what operators on n-grams of words share.

A block is a run of documents of some 6 MB (a longer document is a block of its own), with its own dictionary. Only the entries of
the dictionaries, a row for each block and word, are shuffled to count words over the corpus and to bring their global ids back, so
neither a text nor the corpus' dictionary is ever broadcast or held by one task. Global ids are ranks by descending count: the count
of an id, and how many occurrences stand before it, follow from a table with one row per different count (`Ranks`). Words that occur
N times in all have at most sqrt(2N) different counts, which bounds that table; it is all that tasks get.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyceum.llm.shared import arrow_batches, numbered, stored

#: Bytes of text from which on a block is closed.
BLOCK_BYTES = 6 << 20

#: Ids whose counts are looked up in a table.
OFTEN = 1 << 16

#: The id of a word that the corpus' dictionary does not hold.
NO_WORD = -1

_BLOCK = pa.schema([
    ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())),
    ("tokens", pa.binary()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())),
])
BLOCK = "block long, doc_ids array<long>, flags array<boolean>, lengths array<long>, tokens binary, words array<binary>, counts array<long>"


def packed(ids: np.ndarray) -> bytes:
    """Integers of 32 bits, compressed: all first bytes, then all second ones and so on, as upper bytes differ little; see unpacked."""
    raw = np.ascontiguousarray(ids, dtype="<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(-1)


def packed_long(numbers: np.ndarray) -> bytes:
    """Integers of 64 bits: their lower halves, then their upper ones, which are mostly zero and take no room."""
    wide = np.ascontiguousarray(numbers, dtype=np.int64)
    return packed(np.concatenate([(wide & 0xFFFFFFFF).astype(np.uint32).view(np.int32), (wide >> 32).astype(np.int32)]))


def unpacked_long(data: bytes) -> np.ndarray:
    low, high = unpacked(data).reshape(2, -1)
    return high.astype(np.int64) << 32 | low.view(np.uint32).astype(np.int64)


def packed_columns(narrow: list[np.ndarray], wide: list[np.ndarray]) -> bytes:
    """Columns of one length, of 32 and of 64 bits, in one piece; see unpacked_columns."""
    wide = [np.asarray(c, dtype=np.int64) for c in wide]
    halves = [h for c in wide for h in ((c & 0xFFFFFFFF).astype(np.uint32).view(np.int32), (c >> 32).astype(np.int32))]
    return packed(np.concatenate([*(c.astype(np.int32) for c in narrow), *halves]))


def unpacked_columns(data: bytes, narrow: int, wide: int) -> list[np.ndarray]:
    """The columns, as numbers of 64 bits."""
    table = unpacked(data).reshape(narrow + 2 * wide, -1)
    low, high = table[narrow::2], table[narrow + 1 :: 2]
    return [*table[:narrow].astype(np.int64), *(high.astype(np.int64) << 32 | low.view(np.uint32).astype(np.int64))]


def radix_order(*digits: np.ndarray) -> np.ndarray:
    """The stable order of rows by arrays of unsigned 32-bit numbers, the first array first: least significant 16 bits first, each
    pass a counting sort (numpy's stable sort of 16-bit numbers)."""
    order = np.arange(len(digits[0]))
    for column in reversed(digits):
        top = int(column.max(initial=0))
        for shift in (0, 16):
            if top >> shift:
                digit = (column >> shift).astype(np.uint16)
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def equal_runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by the columns (32 bits, unsigned), and where in it the runs of equal rows start. No rows: no runs."""
    order = radix_order(*columns)
    changes = [c[order][1:] != c[order][:-1] for c in columns]
    return order, np.flatnonzero(np.concatenate([[True] * (len(order) > 0), np.any(changes, axis=0)]))


def run_numbers(order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each row the number of its run."""
    numbers = np.empty(len(order), dtype=np.int64)
    numbers[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    return numbers


def word_blocks(docs: DataFrame, words_of: Callable[..., tuple[bytes, list[bytes], bool]], size_from: int = BLOCK_BYTES) -> DataFrame:
    """The blocks of docs (doc_id and further columns), each closed from size_from bytes of words on; stored.

    words_of(*values of a row) gives the name of the dictionary, the words, and whether they count. Words are kept as the name, a line
    feed and the word (which has none itself). tokens are local ids, document by document (lengths); counts are those of the words
    in documents that count.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = count(TaskContext.get().partitionId() << 28)
        number: Iterator[int] = count()
        ids: dict[bytes, dict] = defaultdict(lambda: defaultdict(number.__next__))
        doc_ids, flags, tokens, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            n_words = sum(map(len, ids.values()))
            words, counts = [b""] * n_words, np.zeros(n_words, dtype=np.int64)
            for name, held in ids.items():
                for word, at in held.items():
                    words[at] = name + b"\n" + word
            for some, flag in zip(tokens, flags, strict=True):
                if flag:
                    np.add.at(counts, some, 1) if len(some) < n_words else np.add(counts, np.bincount(some, minlength=n_words), out=counts)
            values = [next(made), doc_ids, flags, [len(t) for t in tokens], packed(np.concatenate(tokens)), words, counts]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCK, strict=True)], schema=_BLOCK)

        for batch in arrow_batches(batches):
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                name, words, counts = words_of(*row)
                doc_ids.append(row[0])
                flags.append(counts)
                tokens.append(np.fromiter(map(ids[name].__getitem__, words), dtype=np.int32, count=len(words)))
                size += sum(map(len, words))
                if size >= size_from:
                    yield block()
                    number, size = count(), 0
                    ids.clear()
                    for kept in (doc_ids, flags, tokens):
                        kept.clear()
        if doc_ids:
            yield block()

    return stored(docs.mapInArrow(build, BLOCK))


@dataclass(frozen=True)
class Ranks:
    """Counts by id: ids from first[k] on occur n[k] times, after before[k] occurrences of smaller ids."""

    first: np.ndarray
    n: np.ndarray
    before: np.ndarray
    total: int
    size: int

    @cached_property
    def _often(self) -> np.ndarray:
        """The counts of the smallest OFTEN ids, which most words have."""
        ids = np.arange(min(OFTEN, self.size))
        return self.n[np.searchsorted(self.first, ids, side="right") - 1]

    def count_of(self, ids: np.ndarray) -> np.ndarray:
        """How often each id occurs; 0 for NO_WORD."""
        if not self.size:
            return np.zeros(len(ids), dtype=np.int64)
        out = self._often[np.clip(ids, 0, len(self._often) - 1)]
        rare = np.flatnonzero(ids >= len(self._often))
        out[rare] = self.n[np.searchsorted(self.first, ids[rare], side="right") - 1]
        out[ids < 0] = 0
        return out

    def mass_before(self, ids: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.first, ids, side="right") - 1
        return self.before[at] + (ids - self.first[at]) * self.n[at]


def word_counts(blocks: DataFrame) -> DataFrame:
    """(word, n) of all blocks, stored; a word's rows are combined within a block already."""
    each = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("w"))
    return stored(each.groupBy(F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n")), tidy=True)


def ranked(counts: DataFrame) -> tuple[DataFrame, Ranks]:
    """(word, n, id) with dense ids by descending n, stored, and their ranks."""
    table = numbered(counts.select("word", "n", (-F.col("n")).alias("_less")), ["_less", "word"], "id")
    words = table.drop("_less")
    words._stored_in = table._stored_in
    steps = words.groupBy("n").agg(F.min("id").alias("first"), F.count("*").alias("words")).orderBy(F.desc("n")).toPandas()
    n, size = steps["n"].to_numpy(np.int64), steps["words"].to_numpy(np.int64)
    if size.sum() >= 1 << 31:
        raise ValueError("ids of words are numbers of 31 bits")
    mass = np.concatenate([[0], np.cumsum(n * size)])
    return words, Ranks(steps["first"].to_numpy(np.int64), n, mass[:-1], int(mass[-1]), int(size.sum()))


CODED = "block long, doc_ids array<long>, flags array<boolean>, lengths array<long>, tokens binary"


def encoded(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """(block, doc_ids, flags, lengths, tokens) with global ids for local ones, stored.

    Only a block's own words come back to it. A word stands in as many rows as blocks hold it.
    """
    each = blocks.select("block", F.posexplode(F.col("words")).alias("at", "word"))
    both = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("id"))
    found = each.join(words.select("word", "id"), "word").groupBy("block").agg(F.collect_list(both).alias("found"))

    def translate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                pairs = row.column("found").flatten().to_numpy(zero_copy_only=False)
                local = unpacked(row.column("tokens")[0].as_py())
                to = np.full(int(local.max(initial=-1)) + 1, NO_WORD, dtype=np.int32)
                to[pairs >> 32] = pairs & 0xFFFFFFFF
                columns = [row.column(c) for c in ("block", "doc_ids", "flags", "lengths")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([packed(to[local])], pa.binary())], ["block", "doc_ids", "flags", "lengths", "tokens"])

    slim = blocks.select("block", "doc_ids", "flags", "lengths", "tokens").join(found, "block", "left")
    return stored(slim.mapInArrow(translate, CODED), tidy=True)
