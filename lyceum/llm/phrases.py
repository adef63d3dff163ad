"""Phrases of two and three words, scored by how much more often they occur than their parts would suggest.

Words that occur often enough get ids (lyceum.llm.blocks); every other word breaks a piece, as no phrase with it can be frequent.
N-grams of ids are keys of twelve bytes, three big-endian numbers of 32 bits (id + 1, 0 for none), so that a phrase sorts before the
longer ones it begins. Each block sorts its keys by radix and counts the runs; the runs are dealt to ranges of keys whose bounds
follow from the dictionary's own counts, the range of a very frequent first word being divided by the second. Each range merges
its runs by another radix sort and count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyceum.llm.blocks import Ranks, encoded, equal_runs, packed, ranked, unpacked, word_blocks, word_counts
from lyceum.llm.shared import drop_stored, narrow, stored

#: Occurrences of a phrase, at least.
LEAST = 10
#: A phrase goes if a longer one that holds it has this many percent of its occurrences.
COVERED_PERCENT = 50
#: Phrases of each lang.
TOP = 2000
#: Parts of a lang whose first phrases are found by tasks of their own; the last task of a lang gets SALTS * top rows at most.
SALTS = 32
#: Tokens of the corpus in a range of keys.
RANGE_TOKENS = 4 << 20

#: Ends a piece; no byte of UTF-8 text.
_BREAK = b"\xff"
_SEPARATORS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\n" * 10)

RUNS = "range long, keys binary, n binary"


def pieces(doc_id: int | None, lang: str | None, text: bytes | None) -> tuple[bytes, list[bytes], bool]:
    """The words of a text in lower case (A-Z only), with a break after each piece."""
    data = (text or b"").lower().translate(_SEPARATORS).replace(b"\n", b" " + _BREAK + b" ")
    return (lang if lang is not None else "und").encode(), [*data.split(), _BREAK], True


def counted_runs(columns: tuple[np.ndarray, ...], n: np.ndarray | None = None) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The different keys in order, each with the number of its rows, or the sum of their n."""
    order, starts = equal_runs(*columns)
    if not len(starts):
        return columns, np.empty(0, dtype=np.int64)
    sums = np.diff(np.append(starts, len(order))) if n is None else np.add.reduceat(n[order], starts)
    return tuple(c[order[starts]] for c in columns), sums


def ngrams(ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys of all runs of two and three words; -1 in ids is a break."""
    up = (ids + 1).astype(np.uint32)
    first, second = up[:-1], up[1:]
    third = np.append(up[2:], np.uint32(0)) if len(up) > 1 else up[:0]
    two = (first > 0) & (second > 0)
    three = two & (third > 0)
    zeros = np.zeros(int(two.sum()), dtype=np.uint32)
    return np.concatenate([first[two], first[three]]), np.concatenate([second[two], second[three]]), np.concatenate([zeros, third[three]])


def ranges_of(first: np.ndarray, second: np.ndarray, ranks: Ranks, ranges: int) -> np.ndarray:
    """The range of each key: where its first two words fall, by how many occurrences stand before them. Ascends with the key."""
    a, b = first.astype(np.int64) - 1, second.astype(np.int64) - 1
    place = ranks.mass_before(a) + ranks.count_of(a) * (ranks.mass_before(b) / ranks.total)
    return np.minimum(place * (ranges / ranks.total), ranges - 1).astype(np.int64)


def block_runs(coded: DataFrame, ranks: Ranks, ranges: int) -> DataFrame:
    """A row for each block and range that it has keys of: sorted keys and their counts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens in batch.column("tokens"):
                columns, n = counted_runs(ngrams(unpacked(tokens.as_py())))
                if not len(n):
                    continue
                place = ranges_of(columns[0], columns[1], ranks, ranges)
                starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                ends = np.append(starts[1:], len(n))
                blobs = [[packed(np.concatenate([np.diff(columns[0][s:e].astype(np.int64), prepend=0), columns[1][s:e], columns[2][s:e]])), packed(n[s:e])] for s, e in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(place[starts]), *(pa.array(x, pa.binary()) for x in zip(*blobs, strict=True))], ["range", "keys", "n"])

    return coded.select("tokens").mapInArrow(cut, RUNS)


def merged_runs(runs: DataFrame, ranks: Ranks, least: int) -> DataFrame:
    """(g1, g2, g3, f, n1, n2, n3, f12, longer): the n-grams of ids with f of at least `least` and the counts of their words.

    g3 is null for pairs. f12 is the count of a triple's first two words; longer that of a pair's most frequent continuation. Both
    lie in the same range as the key itself.
    """

    def merge(group: pa.Table) -> pa.Table:
        parts = [unpacked(k).reshape(3, -1) for k in group.column("keys").to_pylist()]
        firsts = [np.cumsum(p[0], dtype=np.int64) for p in parts]
        columns = tuple(np.concatenate(x).astype(np.uint32) for x in (firsts, [p[1] for p in parts], [p[2] for p in parts]))
        columns, f = counted_runs(columns, np.concatenate([unpacked(n) for n in group.column("n").to_pylist()]).astype(np.int64))
        often = f >= least
        (a, b, c), f = (x[often].astype(np.int64) for x in columns), f[often]
        pair = c == 0
        of_pair = np.maximum.accumulate(np.where(pair, np.arange(len(f)), 0))
        longer = np.maximum.reduceat(np.where(pair, 0, f), np.flatnonzero(pair)) if len(f) else f
        best = np.zeros(len(f), dtype=np.int64)
        best[pair] = longer
        values = [a - 1, b - 1, c - 1, f, *(ranks.count_of(x - 1) for x in (a, b, c)), f[of_pair], best]
        missing = [np.zeros(len(f), dtype=bool)] * 2 + [pair] + [np.zeros(len(f), dtype=bool)] * 6
        return pa.table([pa.array(v, pa.int64(), mask=m) for v, m in zip(values, missing, strict=True)], names=GRAMS)

    return runs.groupBy("range").applyInArrow(merge, ", ".join(f"{c} long" for c in GRAMS))


GRAMS = ["g1", "g2", "g3", "f", "n1", "n2", "n3", "f12", "longer"]


def weakest_cut(rows: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """rows with a, l, r and score of the cut that scores lowest, the first one among equals. Decimals keep the products exact."""
    wide = "decimal(14, 0)"
    cut = F.array(*(
        F.struct(
            F.expr(f"(cast(f AS {wide}) * cast(f AS {wide}) * 1000000BD) div (cast({l} AS {wide}) * cast({r} AS {wide}))").alias("score"),
            F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"),
        )
        for k, (l, r) in enumerate(cuts)
    ))
    return rows.withColumn("cut", F.array_min(cut)).select("g1", "g2", "g3", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")


def scored(grams: DataFrame, covered_percent: int = COVERED_PERCENT) -> DataFrame:
    """(g1, g2, g3, a, l, r, score) of all phrases but pairs that a triple covers. grams are read several times."""
    pairs, triples = grams.where(F.col("g3").isNull()), grams.where(F.col("g3").isNotNull())
    ends = pairs.select(F.col("g1").alias("g2"), F.col("g2").alias("g3"), F.col("f").alias("f23"))
    before = triples.groupBy(F.col("g2").alias("g1"), F.col("g3").alias("g2")).agg(F.max("f").alias("before"))
    longest = F.greatest("longer", F.coalesce("before", F.lit(0)))
    free = pairs.join(before, ["g1", "g2"], "left").where(100 * longest < covered_percent * F.col("f"))
    three = weakest_cut(triples.join(ends, ["g2", "g3"]), [("n1", "f23"), ("f12", "n3")])
    return weakest_cut(free, [("n1", "n2")]).unionByName(three)


def text_of(word: Column) -> tuple[Column, Column]:
    """The lang and the word of an entry of the dictionary; only the lang can hold a line feed."""
    entry = word.cast("string")
    own = F.substring_index(entry, "\n", -1)
    return F.substring(entry, F.lit(1), F.length(entry) - F.length(own) - 1), own


def phrases(docs: DataFrame, least: int = LEAST, covered_percent: int = COVERED_PERCENT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each lang.

    A null text is empty, a null lang counts as `und`; rows that share a doc_id or have none count each. No documents, or no frequent
    words, give no rows. Equal scores are ordered by a, then by the bytes of the phrase.
    """
    docs = narrow(docs, "doc_id", "lang", "text").withColumn("text", F.col("text").cast("binary"))
    blocks = word_blocks(docs, pieces)
    counts = word_counts(blocks).where(~F.endswith("word", F.lit(b"\n" + _BREAK)))
    words, ranks = ranked(counts.where(F.col("n") >= least))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(2 * partitions, ranks.total // RANGE_TOKENS)
    coded = encoded(blocks, words)
    drop_stored(blocks)
    grams = stored(merged_runs(block_runs(coded, ranks, ranges), ranks, least), tidy=True)
    drop_stored(coded)
    found = scored(grams, covered_percent)
    for k in (1, 2, 3):
        named = words.select(F.col("id").alias(f"g{k}"), *(c.alias(x) for c, x in zip(text_of(F.col("word")), ("lang" if k == 1 else f"_{k}", f"w{k}"), strict=True)))
        found = found.join(named, f"g{k}", "left")
    found = found.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    few = found.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top).drop("rank")
    first = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.groupBy(text_of(F.col("word"))[0].alias("lang")).agg(F.sum("n").alias("n"))
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
