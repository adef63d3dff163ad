"""Shards by a keyed Feistel permutation of global row numbers (DataFrame functions only).

Law `rows`: row r of N goes to place p(r) of a permutation of 0..N-1, to shard p mod S and slot p div S. Shard sizes
differ by one row at most, slots have no gaps, and any row's shard and slot follow from (r, N, key) alone, so a
reader can resume anywhere. Row numbers follow doc_id, which makes the shuffle independent of the file layout.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyceum.llm.shared import narrow, numbered, text_or_empty

ROUNDS = 6
#: Steps of cycle-walking. The domain exceeds N by less than its root, so a walk of this length can't be met in practice; one that is longer fails loudly.
WALK = 32
ROW_BYTES = 16


def feistel(place: Column, a: int, b: int, key: int) -> Column:
    """A keyed bijection on 0..a*b-1: the two digits of a place (base a, base b) are moved round by round."""
    left, right = F.floor(place / F.lit(b)).cast("long"), F.pmod(place, F.lit(b))
    state = F.struct(left.alias("l"), right.alias("r"))

    def turn(s: Column, k: Column) -> Column:
        moved = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], k, F.lit(key)), F.lit(a)), F.lit(a))
        other = F.pmod(s["r"] + F.pmod(F.xxhash64(moved, k, F.lit(-key - 1)), F.lit(b)), F.lit(b))
        return F.struct(moved.alias("l"), other.alias("r"))

    rounds = F.array(*(F.lit(k) for k in range(ROUNDS // 2)))
    return F.aggregate(rounds, state, turn, lambda s: s["l"] * F.lit(b) + s["r"])


def permuted(row: Column, n: int, key: int) -> Column:
    """The place of `row` in the keyed permutation of 0..n-1 (cycle-walking: outside places are permuted again)."""
    if n <= 1:
        return F.lit(0).cast("long")
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    steps = F.array(*(F.lit(k) for k in range(WALK)))
    place = F.aggregate(
        steps, feistel(row, a, b, key), lambda p, _: F.when(p < n, p).otherwise(feistel(p, a, b, key))
    )
    return F.when(place < n, place).otherwise(F.raise_error(F.lit("cycle walk too long: choose another key")).cast("long"))


def permute_rows(rows: DataFrame, order: list[str], key: int = 1, place: str = "place") -> DataFrame:
    """rows with `row_no` (dense, in `order`) and `place` (its keyed permutation)."""
    cut = numbered(rows, order)
    n = cut.count()
    return cut.withColumn(place, permuted(F.col("row_no"), n, key))


def shard_documents(docs: DataFrame, shards: int = 40, key: int = 1) -> DataFrame:
    """Shard and slot of every row of docs (doc_id, text).

    A null text counts as empty. Rows with a null or repeated doc_id are rows like any other; equal rows are
    interchangeable. An empty table gives an empty result. Further columns of docs are not looked at. Equal texts are not
    kept together: law `rows` holds counts at most one apart, which a large group of copies would break.
    """
    slim = narrow(docs, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text_or_empty()).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text_or_empty()).alias("text_crc32"),
    )
    placed = permute_rows(slim, ["doc_id", "text_crc32", "size"], key)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("place") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_no",
    )
