"""Language-model scores from a probabilistic suffix tree of words.

A state of the tree is a context, the last words before a word, of up to DEPTH words. It is kept if the words after it differ enough
from what its longest kept suffix foretells; a word is scored by the longest kept context before it. Each state's distribution is
smoothed by that of its suffix, down to single words with one added to each count, so probabilities sum to one over the known words
and one unknown word.

Contexts are counted length by length over blocks of encoded words (lyceum.llm.blocks). A block sends its different n-grams, sorted
and compressed, to parts by their context; a part adds the counts up, tests its contexts, and answers each block in the block's own
order. The tree is never gathered: every block gets what its own documents need. A context with more than a part's share of all
words is divided by the word that follows; its test is summed up afterwards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyceum.llm.blocks import CODED, Ranks, encoded, equal_runs, packed_columns, radix_order, ranked, run_numbers, unpacked, unpacked_columns, word_blocks, word_counts
from lyceum.llm.shared import drop_stored, narrow, stored

#: Words of a context at most, its occurrences at least, the weight of its suffix' distribution, and the gain (in nats, over all its
#: occurrences, each foretold without itself) from which on it is kept.
DEPTH, LEAST, WEIGHT, GAIN = 2, 4, 2.0, 3.0
#: Documents with this remainder of the checksum of their id by FOLDS are not learned from.
FOLDS, HELD_OUT = 7, 2
#: Words of the corpus in a part; bytes of words in a block.
PART_WORDS, BLOCK = 1 << 20, 2 << 20

_END = b""

STATE = CODED + ", known array<binary>"
ANSWERS = "part long, block long, told binary, context array<long>, gain double"


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def document_words(doc_id: int | None, text: bytes | None) -> tuple[bytes, list[bytes], bool]:
    """The words of a text in lower case (A-Z only) and an end."""
    return b"", [*(text or b"").lower().split(), _END], not is_held_out(doc_id)


@dataclass(frozen=True)
class Model:
    """What all tasks know: the words' counts and the parameters."""

    ranks: Ranks
    parts: int
    least: int
    weight: float
    gain: float

    def single(self, counts: np.ndarray) -> np.ndarray:
        """Chances of words with these counts, without a context."""
        return (counts + 1) / (self.ranks.total + self.ranks.size + 1)

    def prior(self, ids: np.ndarray) -> np.ndarray:
        return self.single(self.ranks.count_of(ids))

    def smoothed(self, chance: np.ndarray, kept: np.ndarray, seen: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Chances by contexts one word longer where these are kept."""
        return np.where(kept, (seen + self.weight * chance) / (before + self.weight), chance)

    def divided(self, occurrences: np.ndarray) -> np.ndarray:
        """Into how many parts a context goes: at most `parts` contexts of a length into more than one."""
        return 1 + occurrences * self.parts // max(1, self.ranks.total)

    def part_of(self, columns: list[np.ndarray], occurrences: np.ndarray) -> np.ndarray:
        *context, word = columns
        mixed = np.zeros(len(word), dtype=np.uint64)
        for ids in context:
            mixed = (mixed ^ ids.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        own = word.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)
        return ((mixed % np.uint64(self.parts) + own % self.divided(occurrences).astype(np.uint64)) % np.uint64(self.parts)).astype(np.int64)


class Block:
    """A block's words with what is known of the n-grams that end at each of them."""

    def __init__(self, row: pa.RecordBatch, model: Model):
        self.model = model
        self.block = row.column("block")[0].as_py()
        self.doc_ids, self.flags = row.column("doc_ids")[0].as_py(), row.column("flags")[0].as_py()
        self.lengths = np.array(row.column("lengths")[0].as_py(), dtype=np.int64)
        self.tokens = unpacked(row.column("tokens")[0].as_py()).astype(np.int64)
        self.place = np.arange(len(self.tokens)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.train = np.repeat(np.array(self.flags, dtype=bool), self.lengths)
        self.seen, self.kept = [model.ranks.count_of(self.tokens)], [np.ones(len(self.tokens), dtype=bool)]
        self.chance = model.single(self.seen[0])
        for told in row.column("known")[0].as_py():
            kept, seen = unpacked_columns(told, 1, 1)
            self.learn(seen, kept > 0)

    def before(self) -> np.ndarray:
        """Occurrences of the next longer context before each word; 0 where there is none."""
        counts = np.concatenate([[0], self.seen[-1][:-1]])
        return np.where(self.place >= len(self.seen), counts, 0)

    def learn(self, seen: np.ndarray, kept: np.ndarray) -> None:
        """Takes up the counts of n-grams one word longer, and whether their contexts are kept."""
        self.chance = self.model.smoothed(self.chance, kept, seen, self.before())
        self.seen.append(seen)
        self.kept.append(kept)

    def shorter(self, places: np.ndarray) -> list[np.ndarray]:
        """What is known of the n-grams at these places with shorter contexts, length by length: whether the context is kept, its
        occurrences (from two words on), and those of the n-gram."""
        out = []
        for k in range(1, len(self.seen)):
            out += [self.kept[k][places], *([self.seen[k - 1][places - 1]] if k > 1 else []), self.seen[k][places]]
        return out

    def asked(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The different n-grams of the next length, in the order in which they are sent: the places that ask, the number of the n-gram
        of each, the columns, the occurrences of the contexts, a place of each, and their parts."""
        size, before = len(self.seen), self.before()
        places = np.flatnonzero((before >= self.model.least) & (self.tokens >= 0))
        columns = [self.tokens[places - back] for back in range(size, -1, -1)]
        order, starts = equal_runs(*(c.astype(np.uint32) for c in columns))
        numbers, one = run_numbers(order, starts), order[starts]
        columns, occurrences = [c[one] for c in columns], before[places[one]]
        part = self.model.part_of(columns, occurrences)
        by_part = radix_order(part.astype(np.uint32))
        rank = np.empty(len(part), dtype=np.int64)
        rank[by_part] = np.arange(len(part))
        return places, rank[numbers], [c[by_part] for c in columns], occurrences[by_part], places[one[by_part]], part[by_part]


def questions(state: DataFrame, model: Model, size: int) -> DataFrame:
    """A row for each block and part: n-grams, their counts in the block's training documents, the occurrences of contexts that are
    divided (else 0: their part adds them up itself), and what is known by shorter contexts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block(batch.slice(k, 1), model)
                places, numbers, columns, occurrences, one, part = block.asked()
                if not len(part):
                    continue
                n = np.bincount(numbers, weights=block.train[places], minlength=len(part)).astype(np.int64)
                starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                wide = [n, np.where(model.divided(occurrences) > 1, occurrences, 0), *block.shorter(one)]
                blobs = [
                    packed_columns([np.diff(columns[0][s:e], prepend=0), *(c[s:e] for c in columns[1:])], [c[s:e] for c in wide])
                    for s, e in zip(starts, np.append(starts[1:], len(part)), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array([block.block] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], ["part", "block", "asked"])

    return state.mapInArrow(ask, "part long, block long, asked binary")


def answers(asked: DataFrame, model: Model, size: int) -> DataFrame:
    """For each question the counts over all blocks and whether the contexts are kept; and for each divided context a row of its own
    (without a block) with the part's share of its gain."""

    def answer(group: pa.Table) -> pa.Table:
        extra = 2 + len([k for k in range(1, size) for _ in range(2 + (k > 1))])
        blobs = [unpacked_columns(b, size + 1, extra) for b in group.column("asked").to_pylist()]
        ends = np.cumsum([len(b[0]) for b in blobs])
        first, *rest = (list(c) for c in zip(*blobs, strict=True))
        first, *rest = np.concatenate([np.cumsum(c) for c in first]), *map(np.concatenate, rest)
        columns, (n, occurrences, *known) = [first, *rest[:size]], rest[size:]
        order, starts = equal_runs(*(c.astype(np.uint32) for c in columns))
        numbers, one = run_numbers(order, starts), order[starts]
        n = np.add.reduceat(n[order], starts)
        columns, occurrences = [c[one] for c in columns], occurrences[one]
        chance = model.prior(columns[-1])
        each = iter([c[one] for c in known])
        for length in range(1, size):
            kept = next(each) > 0
            before = next(each) if length > 1 else model.ranks.count_of(columns[-2])
            chance = model.smoothed(chance, kept, next(each), before)
        heads = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns[:-1]], axis=0)]))
        own = np.add.reduceat(n, heads)
        occurrences = np.repeat(np.where(occurrences[heads] > 0, occurrences[heads], own), np.diff(np.append(heads, len(n))))
        without = (np.maximum(n - 1, 0) + model.weight * chance) / (occurrences - 1 + model.weight)
        gain = np.add.reduceat(np.where(n > 0, n * np.log(without / chance), 0.0), heads)
        divided = model.divided(occurrences[heads]) > 1
        kept = np.repeat((gain > model.gain) & ~divided, np.diff(np.append(heads, len(n))))
        part = group.column("part")[0].as_py()
        blocks, counts, flags = group.column("block").to_pylist(), np.split(n[numbers], ends[:-1]), np.split(kept[numbers], ends[:-1])
        rows = [(part, b, packed_columns([f], [c]), None, None) for b, c, f in zip(blocks, counts, flags, strict=True)]
        rows += [(part, None, None, [int(c[h]) for c in columns[:-1]], float(g)) for h, g in zip(heads[divided], gain[divided], strict=True)]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "block", "told", "context", "gain"])

    return asked.groupBy("part").applyInArrow(answer, ANSWERS)


def learned(state: DataFrame, told: DataFrame, model: Model, divided: dict[tuple, bool]) -> DataFrame:
    """state with what the blocks were told, word by word, stored. divided has the verdicts on the contexts that no one part could test."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                block = Block(row, model)
                places, numbers, columns, occurrences, _, part = block.asked()
                seen, kept = np.zeros(len(block.tokens), dtype=np.int64), np.zeros(len(block.tokens), dtype=bool)
                if len(part):
                    pairs = [unpacked_columns(t["told"], 1, 1) for t in sorted(row.column("told")[0].as_py(), key=lambda t: t["part"])]
                    flags, counts = (np.concatenate(c) for c in zip(*pairs, strict=True))
                    flags = flags > 0
                    own = np.flatnonzero(model.divided(occurrences) > 1)
                    contexts = np.stack([c[own] for c in columns[:-1]])
                    heads = np.flatnonzero(np.concatenate([[True] * (len(own) > 0), np.any(contexts[:, 1:] != contexts[:, :-1], axis=0)]))
                    verdicts = [divided[tuple(contexts[:, h].tolist())] for h in heads]
                    flags[own] = np.repeat(np.array(verdicts, dtype=bool), np.diff(np.append(heads, len(own))))
                    seen[places], kept[places] = counts[numbers], flags[numbers]
                arrays = [row.column(c) for c in ("block", "doc_ids", "flags", "lengths", "tokens")]
                known = [*row.column("known")[0].as_py(), packed_columns([kept], [seen])]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([known], pa.list_(pa.binary()))], ["block", "doc_ids", "flags", "lengths", "tokens", "known"])

    back = told.groupBy("block").agg(F.collect_list(F.struct("part", "told")).alias("told"))
    return stored(state.join(back, "block", "left").mapInArrow(take, STATE), tidy=True)


def scored(state: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block(batch.slice(k, 1), model)
                starts = np.cumsum(block.lengths) - block.lengths
                known, base, own = (np.add.reduceat(x, starts) for x in ((block.tokens >= 0).astype(np.int64), np.log10(model.prior(block.tokens)), np.log10(block.chance)))
                held = [not f for f in block.flags]
                total = np.full(len(starts), model.ranks.total)
                yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, pa.int64()), pa.array(held, pa.bool_()), *map(pa.array, (block.lengths, known, total, base, own))], names)

    return state.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def suffix_tree_scores(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, weight: float = WEIGHT, gain: float = GAIN) -> DataFrame:
    """A row for each row of docs: whether it was held out, its words (an end included), those known from training, the training words
    of the corpus, and the base ten logarithm of its probability by single words and by the tree.

    A null text is empty: its end alone is scored. A missing doc_id counts as an empty one; rows that share a doc_id are scored each.
    Without any training words every word is unknown, with probability one. An empty table gives no rows.
    """
    docs = narrow(docs, "doc_id", "text").withColumn("text", F.col("text").cast("binary"))
    blocks = word_blocks(docs, document_words, BLOCK)
    counts = word_counts(blocks)
    words, ranks = ranked(counts.where(F.col("n") > 0))
    drop_stored(counts)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    model = Model(ranks, max(2 * partitions, ranks.total // PART_WORDS), least, weight, gain)
    none = F.array().cast("array<binary>")
    coded = encoded(blocks, words)
    drop_stored(blocks, words)
    state, old = coded.withColumn("known", none), coded
    for size in range(1, depth + 1):
        told = stored(answers(questions(state, model, size), model, size), tidy=True)
        sums = told.where(F.col("block").isNull()).groupBy("context").agg(F.sum("gain").alias("gain"))
        divided = {tuple(r["context"]): r["gain"] > gain for r in sums.collect()}
        state = learned(state, told.where(F.col("block").isNotNull()), model, divided)
        drop_stored(told, old)
        old = state
    return scored(state, model)
