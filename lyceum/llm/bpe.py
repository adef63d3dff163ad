"""Byte-level BPE: ranked merges folded over the bytes of distinct words; decoding joins the pieces of the ids.

Two forms of one fold. `merged_words` is a column expression: higher-order functions fold the merges of a word over a literal
table of ranked pairs. `encode_documents` does whole texts in Arrow batches, where each worker folds a word once and
remembers it. Whole corpora go through the second form: a joined dictionary of all distinct words would move more bytes than
the texts have, and the interpreted fold takes several times as long (figures in the README).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyceum.llm.shared import arrow_batches, narrow, text_or_empty

RANKS = "byte_bpe_50k.tiktoken"
#: Entries that a worker remembers at most, and bytes from which a word is merged by a heap.
REMEMBERED, LONG = 400_000, 64
SLOTS = 1 << 18
#: Multipliers of the two hash functions of the pair table.
PROBES = ((40503, 30011), (27689, 50021))
EMPTY = -(1 << 40)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: of all neighbouring pieces, those of the lowest rank together are merged, leftmost first, until none is
    ranked."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    none = len(ranks)
    scores = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while scores:
        best = min(scores)
        if best == none:
            break
        at = scores.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del scores[at]
        if at:
            scores[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
        if at < len(scores):
            scores[at] = ranks.get(parts[at] + parts[at + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges over a linked list with a heap of (rank, place): n log n for words of any length."""
    n = len(word)
    end = list(range(1, n + 1))  # of the piece that starts here; 0 once it is merged into another
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def push(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or not end[j] or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    """Ids of whole texts. Distinct words are merged once, distinct chunks between plain spaces are split once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces = {rank: piece for piece, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        # A space with white space or an end beside it: then chunks between spaces would not be whole matches.
        self.uneven = regex.compile(r"(?<!\S) | (?!\S)").search
        self.words, self.chunks = _Words(self), _Chunks(self)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids. A plain space always begins a match, so text is cut before each of them."""
        if self.uneven(text):
            return b"".join(map(self.words.__getitem__, self.find(text)))
        head, *rest = text.split(" ")
        return self.chunks[head] + b"".join([self.chunks[" " + chunk] for chunk in rest])

    def text_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, array("I", ids)))


class _Words(dict):
    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = ids = array("I", merge(word.encode("utf-8", "replace"), self.encoder.ranks)).tobytes()
        return ids


class _Chunks(dict):
    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[chunk] = ids = b"".join(map(self.encoder.words.__getitem__, self.encoder.find(chunk)))
        return ids


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    key = (path, pattern)
    return _encoders.get(key) or _encoders.setdefault(key, Encoder(read_ranks(path), pattern))


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): token ids of every whole text of docs (doc_id, text), and the bytes they decode to.

    A null text is empty and has no ids. Rows are independent, so ties, repeated rows and null doc_ids need no care; an
    empty table gives an empty result; other columns are not looked at.
    """
    return _mapped(docs, path, pattern, False)


def encode_digest(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): as encode_documents, with digests taken in the same task."""
    return _mapped(docs, path, pattern, True)


def _mapped(docs: DataFrame, path: str | None, pattern: str | None, digest: bool) -> DataFrame:
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in arrow_batches(batches):
            coded = [own.ids(t) for t in batch.column("text").to_pylist()]
            decoded = [own.text_bytes(c) for c in coded]
            if digest:
                columns = [
                    pa.array([len(c) // 4 for c in coded], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
                ]
            else:
                columns = [pa.array([list(array("I", c)) for c in coded], pa.list_(pa.int32())), pa.array(decoded, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    schema = "doc_id long, " + (
        "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    slim = narrow(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    return slim.mapInArrow(run, schema)


def pair_table(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """Slots (key, merged id) of a cuckoo hash of all mergeable pairs: key = left id * 65536 + right id."""
    keys, values = [EMPTY] * SLOTS, [0] * SLOTS
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is None or right is None:
                continue
            key, value = left * 65536 + right, rank
            at = (left * PROBES[0][0] + right * PROBES[0][1]) % SLOTS
            for _ in range(1000):
                key, keys[at], value, values[at] = keys[at], key, values[at], value
                if key == EMPTY:
                    break
                first, second = (((key >> 16) * a + (key & 65535) * b) % SLOTS for a, b in PROBES)
                at = second if at == first else first
            else:
                raise ValueError("the pair table is too small for these ranks")
    return keys, values


def merged_words(word: Column, ranks: dict[bytes, int]) -> Column:
    """array<int>: the ids of a word (binary) by a fold of higher-order functions; for tables of distinct words.

    The state is the ids so far and the merged id of each neighbouring pair, between two sentinels; each step merges the
    leftmost pair of the lowest rank and looks up its two new neighbours.
    """
    keys, values = pair_table(ranks)

    def literal(items: list[int], kind: str) -> Column:
        return F.split(F.lit(",".join(map(str, items))), ",").cast(f"array<{kind}>")

    singles = literal([ranks[bytes([b])] for b in range(256)], "int")

    def pair(t: Column, left: Column, right: Column) -> Column:
        key = left.cast("long") * 65536 + right
        at = [F.pmod(left.cast("long") * a + right.cast("long") * b, F.lit(SLOTS)).cast("int") for a, b in PROBES]
        first, second = (F.get(t["keys"], x) == key for x in at)
        return F.when(first, F.get(t["values"], at[0])).when(second, F.get(t["values"], at[1]))

    def fold(t: Column) -> Column:
        codes = F.transform(
            F.sequence(F.lit(1), F.length(word)),
            lambda i: F.get(t["singles"], F.conv(F.hex(F.substring(word, i, F.lit(1))), 16, 10).cast("int")),
        )
        edge = F.array(F.lit(-1))
        ids = F.concat(edge, codes, edge)
        pairs = F.zip_with(ids, F.slice(ids, F.lit(2), F.size(ids)), lambda a, b: F.when(b.isNotNull(), pair(t, a, b)))
        start = F.struct(ids.alias("ids"), pairs.alias("pairs"))

        def step(s: Column, _: Column) -> Column:
            def joined(best: Column) -> Column:
                ids, pairs, new, at = s["ids"], s["pairs"], best["new"], best["at"]
                beside = F.array(pair(t, F.get(ids, at - 2), new), pair(t, new, F.get(ids, at + 1)))
                return F.struct(
                    F.concat(F.slice(ids, F.lit(1), at - 1), F.array(new), F.slice(ids, at + 2, F.size(ids))).alias("ids"),
                    F.concat(F.slice(pairs, F.lit(1), at - 2), beside, F.slice(pairs, at + 2, F.size(pairs))).alias("pairs"),
                )

            best = F.transform(
                F.array(F.array_min(s["pairs"])),
                lambda low: F.struct(low.alias("new"), F.array_position(s["pairs"], low).cast("int").alias("at")),
            )
            return F.get(F.transform(best, lambda b: F.when(b["new"].isNull(), s).otherwise(joined(b))), F.lit(0))

        turns = F.sequence(F.lit(1), F.length(word))
        return F.aggregate(turns, start, step, lambda s: F.slice(s["ids"], F.lit(2), F.size(s["ids"]) - 2))

    tables = F.struct(
        literal(keys, "long").alias("keys"), literal(values, "int").alias("values"), singles.alias("singles")
    )
    empty = F.array().cast("array<int>")
    return F.when(F.length(word) > 0, F.get(F.transform(F.array(tables), fold), F.lit(0))).otherwise(empty)


def decoded_words(ids: Column, ranks: dict[bytes, int]) -> Column:
    """binary: the pieces of ids (array<int>) concatenated, from a literal array of the pieces."""
    pieces = sorted(ranks, key=ranks.get)
    table = F.split(F.lit(",".join(p.hex() for p in pieces)), ",")

    def join(t: Column) -> Column:
        return F.aggregate(ids, F.lit(""), lambda s, i: F.concat(s, F.get(t, i)))

    return F.unhex(F.get(F.transform(F.array(table), join), F.lit(0)))
