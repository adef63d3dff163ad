"""Best-fit packing of tokenised documents into fixed-length sequences by bin completion.

Lengths are whole numbers up to the capacity, so what has to be packed is known by its histogram: at most `capacity`
counts, whatever the number of documents. Bin completion runs on that histogram: it fills the largest length left with the
best undominated completion, as often as stock lasts, and searches further completions depth-first while a bound on the
waste leaves room below the incumbent. The plan it gives (at most one pattern per exhausted length) is joined back to
the pieces by their rank among pieces of equal length, in Spark.
"""

from __future__ import annotations

import random
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyceum.llm.shared import arrow_batches, narrow, numbered, stored, text_or_empty

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Words remembered by one worker; all are forgotten when there are more (bounds memory only).
REMEMBERED = 500_000
#: Steps of one enumeration of completions, and completions tried in the whole search.
STEPS, TRIES = 1_500, 3_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
    return [other.get(b, chr(b)) for b in range(256)]


class WordIds(dict):
    """White-space-delimited word (UTF-8) -> its ids as little-endian unsigned 32-bit integers.

    The vocabulary's pattern drops white space and never crosses it, so a text's ids are those of its words in turn. Words
    of plain letters are one match of the pattern and go to the merges directly; others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merges = self.whole.model
        self.letters = byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = ids = self._encode(word)
        return ids

    def _encode(self, word: bytes) -> bytes:
        if b"<|" not in word:
            core = word.rstrip(b"!#$%&*+,./:;=?@^_`|~-()")
            text = core.decode("utf-8", "surrogatepass")
            lower = text.lower()
            # A letter's lower-case form may end in a mark (that of a dotted capital I does), which joins the punctuation.
            if 0 < len(core) < len(word) and text[-1].isalnum() and lower[-1].isalnum():
                return self[core] + self[word[len(core) :]]
            if core == word and text and max(text) < "ɐ":
                if text.isalpha() and lower.isalpha():
                    chars = lower if lower.isascii() else "".join(self.letters[b] for b in lower.encode())
                    return array("I", [t.id for t in self.merges.tokenize(chars)]).tobytes()
        text = word.decode("utf-8", "replace")
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        data = text.encode("utf-8", "replace")
        if b"<|" not in data:
            data = data.lower()
        return b"".join(map(self.__getitem__, data.split()))


_workers: dict[str, WordIds] = {}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids, then id 0, cut only beyond the capacity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _workers.get(path) or _workers.setdefault(path, WordIds(path))
        for batch in arrow_batches(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = words.ids(text) + bytes(4)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    slim = narrow(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    return slim.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def completions(room: int, stock: np.ndarray, steps: int = STEPS) -> list[tuple[int, dict[int, int]]]:
    """(waste, {length: copies}) of fillings of `room` from stock, least waste first.

    Depth-first from the largest length that fits, most copies first, so the first filling is the best-fit-decreasing
    one. A filling without waste dominates all later ones and ends the enumeration; of equal wastes the one with the
    larger items is kept, which dominates the others.
    """
    lengths = np.flatnonzero(stock[: room + 1])[::-1]
    found: dict[int, dict[int, int]] = {}
    least = int(lengths[-1]) if len(lengths) else room + 1
    todo: list[tuple[int, int, dict[int, int]]] = [(0, room, {})]
    while todo and steps:
        steps -= 1
        at, left, taken = todo.pop()
        if left < least:
            found.setdefault(left, taken)
            if not left:
                break
            continue
        at += int(np.searchsorted(-lengths[at:], -left))
        if at == len(lengths):
            found.setdefault(left, taken)
            continue
        length = int(lengths[at])
        most = min(int(stock[length]), left // length)
        todo.append((at + 1, left, taken))
        for copies in range(1, most + 1):
            todo.append((at + 1, left - copies * length, taken | {length: copies}))
    return sorted(found.items())


def bound(stock: np.ndarray, capacity: int) -> int:
    """No packing has fewer sequences: the volume bound, raised by items over half that can't share (Martello and Toth)."""
    sizes = np.arange(len(stock))
    best = -(-int((stock * sizes).sum()) // capacity)
    for k in range(capacity // 2 + 1):
        large = int(stock[capacity - k + 1 :].sum())
        middle = stock[capacity // 2 + 1 : capacity - k + 1]
        room = int(middle.sum()) * capacity - int((middle * sizes[capacity // 2 + 1 : capacity - k + 1]).sum())
        small = int((stock[k : capacity // 2 + 1] * sizes[k : capacity // 2 + 1]).sum())
        best = max(best, large + int(middle.sum()) + max(0, -(-(small - room) // capacity)))
    return best


def filled_up(state: tuple, capacity: int, gap: int, filling: dict[int, int]) -> tuple:
    """The state (stock left, patterns so far as (earlier, pattern), sequences, waste) after the largest length left was filled up
    with this completion, as often as stock lasts."""
    stock, made, n, waste = state
    largest = int(np.flatnonzero(stock)[-1])
    whole = filling | {largest: filling.get(largest, 0) + 1}
    times = min(int(stock[x]) // c for x, c in whole.items())
    after = stock.copy()
    for x, c in whole.items():
        after[x] -= times * c
    return after, (made, (times, whole)), n + times, waste + times * gap


def pack_histogram(
    counts: dict[int, int], capacity: int = CAPACITY, tries: int = TRIES, width: int = 3
) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: copies}): patterns that together use up the counts, in as few sequences as were found.

    Depth-first branch and bound: the first descent takes the best completion each time and is the first incumbent;
    then up to `width` completions are tried at each step, last steps first, until the lower bound is met, every branch
    is pruned or `tries` completions were looked at. A branch ends when its waste leaves no room below the incumbent. What is
    decided early is changed last that way, so as many completions again are tried in fresh descents, each of which mostly
    takes the best completion and sometimes (by a seeded generator) a later one.
    """
    stock = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        stock[length] += n
    goal = bound(stock, capacity)
    volume = int((stock * np.arange(capacity + 1)).sum())
    best, best_n = None, 1 << 62

    def fillings(stock: np.ndarray, most: int) -> list[tuple[int, dict[int, int]]]:
        largest = int(np.flatnonzero(stock)[-1])
        rest = stock.copy()
        rest[largest] -= 1
        return completions(capacity - largest, rest)[:most] or [(capacity - largest, {})]

    root = (stock, None, 0, 0)
    stack, left = [root], tries
    while stack and best_n > goal and (left > 0 or best is None):
        state = stack.pop()
        if state[3] > (best_n - 1) * capacity - volume:
            continue
        if not state[0].any():
            best, best_n = state[1], state[2]
            continue
        left -= 1
        stack += [filled_up(state, capacity, *f) for f in reversed(fillings(state[0], width))]
    chance, left = random.Random(0), tries
    while best_n > goal and left > 0:
        state = root
        while state[0].any() and state[3] <= (best_n - 1) * capacity - volume:
            found = fillings(state[0], 4 * width)
            state = filled_up(state, capacity, *found[min(int(chance.expovariate(1.2)), len(found) - 1)])
            left -= 1
        if not state[0].any() and state[2] < best_n:
            best, best_n = state[1], state[2]
    patterns = []
    while best:
        best, pattern = best
        patterns.append(pattern)
    return patterns[::-1]


def place_pieces(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = cut.sparkSession
    ranked = numbered(cut, ["length", "doc_id", "piece", "ids_crc32", "start"], "_row")
    counts = {r["length"]: r["count"] for r in ranked.groupBy("length").count().collect()}
    before, total = {}, 0
    for length in sorted(counts):
        before[length], total = total, total + counts[length]
    used = dict.fromkeys(counts, 0)
    plan, sequence = [], 0
    for times, pattern in pack_histogram(counts, capacity):
        offset = 0
        for length in sorted(pattern, reverse=True):
            copies = pattern[length]
            first = before[length] + used[length]
            plan.append((length, first, first + times * copies, sequence, copies, offset))
            used[length] += times * copies
            offset += copies * length
        sequence += times
    table = spark.createDataFrame(
        plan, "length long, _first long, _end long, _sequence long, _copies long, _offset long"
    )  # at most one pattern for each of `capacity` lengths, of under 64 lengths each
    inside = (F.col("_row") >= F.col("_first")) & (F.col("_row") < F.col("_end"))
    k = F.col("_row") - F.col("_first")
    fit = ranked.join(F.broadcast(table.withColumnRenamed("length", "_length")), (F.col("length") == F.col("_length")) & inside)
    return fit.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_sequence") + (k - F.pmod(k, F.col("_copies"))) / F.col("_copies")).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(k, F.col("_copies")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Packs every row of docs (doc_id, text) into sequences of at most `capacity` tokens; one row per piece.

    A null text is empty: its only token is the closing id 0. Only documents longer than the capacity are cut. Rows with a
    null or repeated doc_id are packed like any other; an empty table gives an empty result; other columns are not looked
    at.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return place_pieces(stored(pieces(docs, path, capacity)), capacity)
