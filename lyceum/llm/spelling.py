"""Spelling variants: words that differ by one letter from a far more frequent one.

The words are cut into shards of a sorted range, each a compact trie of bounded size. A few shards at a time are broadcast; every word
runs its Levenshtein automaton of distance one through each of them depth-first. What a word finds is reduced to its number of near
words and the best of them at once, so pairs never meet in one place.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyceum.llm.shared import arrow_batches, narrow, stored

#: Code points and occurrences of a word, at least.
LETTERS, LEAST = 6, 5
#: A form occurs at least so many times as often as the word.
TIMES = 5
#: One in so many occurrences (by checksum) loses a letter.
SLIP = 199
#: Words and letters of a shard (one longer word is a shard of its own); bytes of shards that are broadcast at once.
SHARD_WORDS, SHARD_LETTERS, ROUND_BYTES = 200_000, 4_000_000, 24 << 20
#: Different words that a task counts before it hands them on.
HELD_WORDS = 400_000

_RUN = re.compile(r"[a-zÀ-ÿ]+")


def slipped(doc_id: int | None, run: str) -> str:
    """The run as this document has it: one in SLIP has lost the letter that the checksum of `doc_id:run` names."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % SLIP else run[: h % len(run)] + run[h % len(run) + 1 :]


def words_of(docs: DataFrame, letters: int = LETTERS, least: int = LEAST) -> DataFrame:
    """(word, n): runs of letters, lower-cased A-Z, as `slipped` leaves them, of enough letters and occurrences.

    A null text has no words; a missing doc_id counts as an empty one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def batch_of() -> pa.RecordBatch:
            rows = [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(rows, ["word", "n"])

        for batch in arrow_batches(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                low = text.lower().decode("utf-8", "replace")
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(_RUN.findall(low)).items():
                    if len(run) >= letters:
                        held[run if zlib.crc32(run.encode(), prefix) % SLIP else slipped(doc_id, run)] += n
                if len(held) >= HELD_WORDS:
                    yield batch_of()
        yield batch_of()

    texts = narrow(docs, "doc_id", "text").where(F.col("text").isNotNull()).withColumn("text", F.col("text").cast("binary"))
    counted = texts.mapInArrow(count, "word string, n long").where(F.length("word") >= letters)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Trie:
    """A trie of sorted words in arrays, nodes level by level: the children of node k are first[k] to first[k + 1], one letter each in
    labels. A node under which one word is left is a leaf and keeps the rest of it in tails. n is a word's count at its last node."""

    def __init__(self, labels: str, first: bytes, n: bytes, tails: list[str | None]):
        self.labels, self.first, self.n, self.tails = labels, array("i", first), array("q", n), tails

    @staticmethod
    def row(words: list[str], counts: list[int]) -> dict:
        """The arrays of sorted, different words; the root's label is a blank."""
        labels, first, n, tails = [" "], [], [], []
        level = [(0, len(words))]
        depth, made = 0, 1
        while level:
            below = []
            for low, high in level:
                first.append(made)
                if high - low == 1:
                    n.append(counts[low])
                    tails.append(words[low][depth:])
                    continue
                tails.append(None)
                ends = low < high and len(words[low]) == depth
                n.append(counts[low] if ends else 0)
                at = low + ends
                while at < high:
                    letter = words[at][depth]
                    to = bisect_left(words, words[at][:depth] + chr(ord(letter) + 1), at, high)
                    labels.append(letter)
                    below.append((at, to))
                    made += 1
                    at = to
            level, depth = below, depth + 1
        first.append(made)
        return {"labels": "".join(labels), "first": array("i", first).tobytes(), "n": array("q", n).tobytes(), "tails": tails}

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """The words at distance one, each once, with their counts: the automaton of the word and the trie walked together.

        Along the word itself no error is spent. Leaving it for a letter that is not the next one spends it; the places of the
        word that can follow are then those after an insertion, a replacement, and a deletion if the letter is the one after next.
        (An inserted or deleted letter that equals the next one is found where the run of that letter ends.)
        """
        labels, first, n, tails, size = self.labels, self.first, self.n, self.tails, len(word)
        stack: list[tuple[int, str, int, tuple[int, ...]]] = [(0, "", 0, ())]
        while stack:
            node, path, depth, places = stack.pop()
            tail = tails[node]
            if tail is not None:
                rest = {word[p:] for p in places} if places else _one_off(word[depth:], tail)
                if (tail in rest) if places else rest:
                    yield path + tail, n[node]
                continue
            if places:
                if n[node] and size in places:
                    yield path, n[node]
                for letter in {word[p] for p in places if p < size}:
                    child = labels.find(letter, first[node], first[node + 1])
                    if child >= 0:
                        stack.append((child, path + letter, depth + 1, tuple(p + 1 for p in places if p < size and word[p] == letter)))
                continue
            if n[node] and depth == size - 1:
                yield path, n[node]
            following = word[depth] if depth < size else ""
            after = word[depth + 1] if depth + 1 < size else ""
            for child in range(first[node], first[node + 1]):
                letter = labels[child]
                if letter == following:
                    stack.append((child, path + letter, depth + 1, ()))
                    continue
                left = (depth, depth + 1, depth + 2) if letter == after else (depth, depth + 1) if following else (depth,)
                stack.append((child, path + letter, depth + 1, left))


def _one_off(rest: str, tail: str) -> bool:
    """Whether two strings differ by exactly one inserted, deleted or replaced code point."""
    if rest == tail or abs(len(rest) - len(tail)) > 1:
        return False
    at = next((k for k, (a, b) in enumerate(zip(rest, tail, strict=False)) if a != b), min(len(rest), len(tail)))
    a, b = (at + (len(x) >= len(y)) for x, y in ((rest, tail), (tail, rest)))
    return rest[a:] == tail[b:]


def shards(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(labels, first, n, tails, bytes): tries of bounded size over ranges of the sorted words."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard() -> pa.RecordBatch:
            row = Trie.row(names, counts)
            size = len(row["labels"]) + len(row["first"]) + len(row["n"]) + sum(len(t or "") + 1 for t in row["tails"])
            names.clear()
            counts.clear()
            return pa.RecordBatch.from_pylist([row | {"bytes": size}], schema=pa.schema([("labels", pa.string()), ("first", pa.binary()), ("n", pa.binary()), ("tails", pa.list_(pa.string())), ("bytes", pa.int64())]))

        names, counts, letters = [], [], 0
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if names and (len(names) >= shard_words or letters + len(word) > SHARD_LETTERS):
                    yield shard()
                    letters = 0
                names.append(word)
                counts.append(n)
                letters += len(word)
        if names:
            yield shard()

    ordered = words.repartitionByRange("word").sortWithinPartitions("word")
    return ordered.mapInArrow(build, "labels string, first binary, n binary, tails array<string>, bytes long")


def near_words(words: DataFrame, tries: list[dict]) -> DataFrame:
    """(word, n, n_near, best): each word with what it finds in the tries; best is the near word of the largest n, as (less, word)
    with less = -n, so that the smallest one wins."""
    held = words.sparkSession.sparkContext.broadcast(tries)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [Trie(row["labels"], row["first"], row["n"], row["tails"]) for row in held.value]
        for batch in arrow_batches(batches):
            found = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                near = [(-times, other) for trie in every for other, times in trie.near(word)]
                less, best = min(near, default=(None, None))
                found.append((word, n, len(near), {"less": less, "word": best} if near else None))
            best = pa.struct([("less", pa.int64()), ("word", pa.string())])
            kinds = [pa.string(), pa.int64(), pa.int64(), best]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n", "n_near", "best"])

    return words.mapInArrow(find, "word string, n long, n_near long, best struct<less: long, word: string>")


def with_near(words: DataFrame, shard_words: int = SHARD_WORDS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, n, n_near, best) over all shards. words are read once a round: the bytes of all tries over round_bytes, rounded up."""
    tries = stored(shards(words, shard_words).withColumn("shard", F.monotonically_increasing_id()))
    sizes = tries.select("shard", "bytes").orderBy("shard").toLocalIterator()
    rounds: list[list[int]] = []
    held = round_bytes
    for shard, size in sizes:
        if held + size > round_bytes:
            rounds.append([])
            held = 0
        rounds[-1].append(shard)
        held += size
    parts = []
    for some in rounds:
        rows = [r.asDict() for r in tries.where(F.col("shard").between(some[0], some[-1])).collect()]
        parts.append(near_words(words, rows))
    if not parts:
        return words.withColumns({"n_near": F.lit(0).cast("long"), "best": F.lit(None).cast("struct<less: long, word: string>")})
    if len(parts) == 1:
        return parts[0]
    every = stored(parts[0])
    for part in parts[1:]:
        every = every.unionByName(stored(part))
    return every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def with_roots(words: DataFrame) -> DataFrame:
    """words (word, form, ...) with root, the last word that forms lead to. Each join doubles the length of the paths followed; as
    a form is TIMES as frequent as its word, a path of k forms takes a count of TIMES to the k, so few joins do."""
    paths = stored(words.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        further = paths.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        longer = stored(paths.join(further, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_went")))
        paths = longer.select("word", "root")
        if longer.where("_went").isEmpty():
            break
    return words.join(paths, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, letters: int = LETTERS, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of the documents.

    Null and empty texts have no words, an empty table gives no rows; rows that share a doc_id count each. Equal counts of near words
    are decided by code-point order.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = stored(words_of(docs, letters, least).repartition(partitions))
    near = stored(with_near(words))
    is_form = -F.col("best.less") >= times * F.col("n")
    formed = near.select("word", F.when(is_form, F.col("best.word")).alias("form"), "n", "n_near", F.when(is_form, -F.col("best.less")).alias("form_n"))
    return with_roots(formed).select("word", "form", "root", "n", "n_near", "form_n")
