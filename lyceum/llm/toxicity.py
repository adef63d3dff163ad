"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Examples are a bounded sample of the labelled rows, SAMPLE of each class (all of them where there are fewer), taken in the
order of a hash of doc_id; of examples with one sketch (their SKETCH least hashes of five-word shingles: copies, mostly) one
is kept, as copies would make their chance words look telling. Terms are lower-cased words and their beginnings; all terms of
the examples are candidates. A term weighs (1 + ln tf) * idf * phi squared: idf counts all documents, and phi is the
correlation of term and class over the examples, corrected for chance, so that a word counts as far as it tells about the
label: words that tell no more than chance does, and those that no example holds, weigh nothing.

Every document is scored. The vote of its NEAREST neighbours is turned to a probability by a logistic curve fitted on the
leave-one-out votes of the examples, each class weighted by its share of all labelled rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyceum.llm.shared import arrow_batches, narrow, stored, text_or_empty

#: Labelled rows of each class, neighbours that vote, examples in a block of the index, blocks opened at once.
SAMPLE, NEAREST, BLOCK, OPENED = 600, 15, 64, 8
#: What a sum of weights may be off by.
ROUNDING = 1e-6
SKETCH, SKETCH_WORDS = 8, 5
PREFIXES = (4, 5, 6, 7)
FOLDS, HELD_OUT = 5, 0
REMEMBERED = 200_000

_letters = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words; ASCII characters that are neither letters nor digits divide them."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_letters).split()


def terms_of(word: bytes) -> list[str]:
    """A word and its beginnings (marked by a star)."""
    text = word.decode("utf-8", "replace")
    return [text, *(text[:n] + "*" for n in PREFIXES if len(text) >= n)]


def sketch(words: list[bytes]) -> int:
    """One hash of the SKETCH least hashes of the shingles of SKETCH_WORDS words."""
    last = max(1, len(words) - SKETCH_WORDS + 1)
    hashes = {xxhash.xxh64_intdigest(b" ".join(words[i : i + SKETCH_WORDS])) for i in range(last)}
    return xxhash.xxh64_intdigest(repr(heapq.nsmallest(SKETCH, hashes))) - (1 << 63)


class WordTerms(dict):
    """word -> numbers of its terms in the vocabulary; forgets everything beyond REMEMBERED words."""

    def __init__(self, vocabulary: dict[str, int]):
        self.whole = {t: k for t, k in vocabulary.items() if t[-1] != "*"}
        self.starts = [(n, {t[:-1]: k for t, k in vocabulary.items() if t[-1] == "*" and len(t) == n + 1}) for n in PREFIXES]

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        text = word.decode("utf-8", "replace")
        found = [self.whole[text]] if text in self.whole else []
        for n, starts in self.starts:
            if len(text) < n:
                break
            start = text[:n]
            if start in starts:
                found.append(starts[start])
        self[word] = out = tuple(found)
        return out

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a text, ascending, and how often they occur."""
        found = list(chain.from_iterable(map(self.__getitem__, words_of(text))))
        return np.unique(np.array(found, np.int64), return_counts=True)


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from each start up to its end, and which of the ranges each belongs to."""
    sizes = ends - starts
    which = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which], which


@dataclass
class Index:
    """Postings sorted by (term, example). Examples lie in blocks; an entry is the part of a term's postings in one block, with
    its largest weight. A term has entries only for blocks that hold it."""

    vocabulary: dict[str, int]
    importance: np.ndarray  # of each term: idf * phi squared
    labels: np.ndarray
    doc_ids: np.ndarray
    examples: np.ndarray  # of each posting
    weights: np.ndarray
    cuts: np.ndarray  # [entry]: where its postings begin
    blocks: np.ndarray  # [entry]: its block
    most: np.ndarray  # [entry]: its largest weight
    entries: np.ndarray  # [term]: where its entries begin
    curve: tuple[float, float] = (0.0, 0.0)
    without: float = 0.0  # score of texts without a term that weighs anything
    cache: WordTerms | None = field(default=None, repr=False)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights (length 1) of a text."""
        if self.cache is None:
            self.cache = WordTerms(self.vocabulary)
        terms, counts = self.cache.counts(text)
        return unit(terms, counts, self.importance)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEAREST, but: int = -1) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest with a cosine over 0. Blocks are opened in the order of their bounds, as long as
        these can reach the k-th cosine so far."""
        at, which = ranges(self.entries[terms], self.entries[terms + 1])
        if not len(at):
            return []
        n_blocks = -(-len(self.labels) // BLOCK)
        own = self.blocks[at]
        bounds = np.bincount(own, weights[which] * self.most[at], n_blocks)
        order = np.argsort(-bounds, kind="stable")
        scores, least = np.zeros(len(self.labels)), 0.0
        for begin in range(0, n_blocks, OPENED):
            if bounds[order[begin]] <= 0 or bounds[order[begin]] < least - ROUNDING:
                break
            now = np.zeros(n_blocks, bool)
            now[order[begin : begin + OPENED]] = True
            chosen = np.flatnonzero(now[own])
            place, entry = ranges(self.cuts[at[chosen]], self.cuts[at[chosen] + 1])
            scores += np.bincount(self.examples[place], weights[which[chosen]][entry] * self.weights[place], len(scores))
            if but >= 0:
                scores[but] = 0.0
            if len(scores) > k:
                least = np.partition(scores, -k)[-k]
        near = np.flatnonzero((scores > 0) & (scores >= least))
        near = near[np.lexsort((near, -scores[near]))][:k]
        return list(zip(scores[near].tolist(), near.tolist(), strict=True))

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of the toxic ones among the neighbours, nearer ones counting more."""
        weights = [1 / (1.05 - min(cosine, 1.0)) for cosine, _ in near]
        return sum(w * self.labels[i] for w, (_, i) in zip(weights, near, strict=True)) / sum(weights)

    def score(self, near: list[tuple[float, int]]) -> float:
        if not near:
            return self.without
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a * self.vote(near) + b))))


def unit(terms: np.ndarray, counts: np.ndarray, importance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms that weigh anything and their weights, scaled to length 1."""
    weights = (1 + np.log(counts)) * importance[terms]
    some = weights > 0
    return terms[some], weights[some] / max(1e-300, float(np.sqrt((weights**2).sum())))


def telling(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Phi squared of term and class over the examples, less what chance alone gives (1 / (n - 1), the usual correction for bias);
    toxic and clean count the examples that hold each term."""
    n, held = n_toxic + n_clean, toxic + clean
    apart = (toxic * float(n_clean) - clean * float(n_toxic)) ** 2
    phi2 = apart / np.maximum(1.0, float(n_toxic) * n_clean * held * (n - held))
    return np.maximum(0.0, phi2 - 1 / max(1, n - 1))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one variable with a small ridge, by Newton steps."""
    design, beta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    ridge = 1e-3 * w.sum() * np.eye(2) / max(1, len(x)) + 1e-9 * np.eye(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, design.T @ (w * (y - p)) - ridge @ beta)
        beta = np.clip(beta + step, -60, 60)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def build_index(docs: DataFrame, labels: DataFrame) -> Index | None:
    """The index over the sample of labelled rows that are not held out; None without labelled rows."""
    known = (
        narrow(labels, "doc_id", "toxic")
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    known = stored(known)
    shares = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [known.where(F.col("toxic") == c).orderBy(*order).limit(SAMPLE) for c in (0, 1)]
    sample = parts[0].unionByName(parts[1])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            for doc_id, toxic, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = words_of(text)
                counts = Counter(t for word, times in Counter(words).items() for t in terms_of(word) for _ in range(times))
                n = len(counts) + 1  # a row without a term stands for the document itself
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc_id] * n, pa.int64()), pa.array([toxic] * n, pa.int32()),
                        pa.array([sketch(words)] * n, pa.int64()), pa.array([None, *counts], pa.string()),
                        pa.array([0, *counts.values()], pa.int64()),
                    ],
                    ["doc_id", "toxic", "sketch", "term", "tf"],
                )

    texts = narrow(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most 2 * SAMPLE rows
    texts = texts.select("doc_id", "toxic", text_or_empty().alias("text"))
    found = texts.mapInArrow(spread, "doc_id long, toxic int, sketch long, term string, tf long")
    found = stored(found.groupBy("doc_id", "toxic", "sketch", "term").agg(F.sum("tf").alias("tf")))
    alone = found.where(F.col("term").isNull()).groupBy("toxic", "sketch").agg(F.min("doc_id").alias("doc_id"))
    chosen = {r["doc_id"]: r["toxic"] for r in alone.collect()}  # at most 2 * SAMPLE
    if not chosen:
        return None
    found = found.where(F.col("term").isNotNull()).join(F.broadcast(alone.select("doc_id")), "doc_id")
    stats = found.groupBy("term").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).toArrow()  # the terms of the sample
    toxic, held = (stats[c].to_numpy().astype(np.float64) for c in ("a", "n"))
    totals = Counter(chosen.values())
    phi2 = telling(toxic, held - toxic, totals[1], totals[0])
    names = stats["term"].filter(pa.array(phi2 > 0))  # all others would add nothing to a cosine
    vocabulary = {t: k for k, t in enumerate(names.to_pylist())}
    numbers = docs.sparkSession.createDataFrame(pa.table({"term": names, "_no": pa.array(np.arange(len(names), dtype=np.int32))}))
    postings = found.join(F.broadcast(numbers), "term").select("doc_id", "_no", F.col("tf").cast("int")).toArrow()
    df, n_docs = document_frequencies(docs, vocabulary)
    importance = (np.log((1 + n_docs) / (1 + df)) + 1) * phi2[phi2 > 0]
    return indexed(chosen, shares, vocabulary, importance, *(c.to_numpy() for c in postings.columns))


def document_frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term of the vocabulary stands, and the number of documents. Each partition gives its
    sums; what comes to the driver has one row per term of the vocabulary at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, sums = WordTerms(vocabulary), np.zeros(len(vocabulary), np.int64)
        n = 0
        for batch in arrow_batches(batches):
            found: list[int] = []
            for text in batch.column("text").to_pylist():
                n += 1
                found += set(chain.from_iterable(map(lookup.__getitem__, set(words_of(text)))))
            sums += np.bincount(np.array(found, np.int64), minlength=len(sums))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some], pa.int32()), pa.array([n, *sums[some]], pa.int64())], ["term", "n"])

    slim = narrow(docs, "text").select(text_or_empty().alias("text"))
    sums = slim.mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = sums["term"].to_numpy(), sums["n"].to_numpy()
    df = np.zeros(len(vocabulary))
    df[term[term >= 0]] = n[term >= 0]
    return df, int(n[term < 0].sum())


def indexed(
    chosen: dict[int, int], shares: dict[int, int], vocabulary: dict[str, int], importance: np.ndarray,
    doc_ids: np.ndarray, terms: np.ndarray, tfs: np.ndarray,
) -> Index:
    """The index of the examples chosen (doc_id -> label) from the postings (doc_ids, terms, tfs), with its curve fitted."""
    cut = np.lexsort((terms, doc_ids))
    doc_ids, terms, tfs = doc_ids[cut], terms[cut].astype(np.int64), tfs[cut]
    owners, starts = np.unique(doc_ids, return_index=True)
    vectors = {}
    for owner, at, end in zip(owners.tolist(), starts.tolist(), [*starts[1:].tolist(), len(doc_ids)], strict=True):
        vector = unit(terms[at:end], tfs[at:end], importance)
        if len(vector[0]):
            vectors[owner] = vector
    # Neighbours share blocks: by class, then by the strongest term.
    order = sorted(vectors, key=lambda d: (chosen[d], int(vectors[d][0][np.argmax(vectors[d][1])]), d))
    term = np.concatenate([np.zeros(0, np.int64), *(vectors[d][0] for d in order)])
    weight = np.concatenate([np.zeros(0), *(vectors[d][1] for d in order)])
    example = np.repeat(np.arange(len(order)), [len(vectors[d][0]) for d in order])
    cut = np.argsort(term, kind="stable")
    term, weight, example = term[cut], weight[cut], example[cut]
    block = example // BLOCK
    fresh = np.ones(len(term), bool)
    fresh[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
    cuts = np.flatnonzero(fresh)
    most = np.maximum.reduceat(weight, cuts) if len(cuts) else weight
    entries = np.searchsorted(term[cuts], np.arange(len(vocabulary) + 1))
    labels = np.array([chosen[d] for d in order], np.int64)
    index = Index(
        vocabulary, importance, labels, np.array(order, np.int64), example.astype(np.int32), weight.astype(np.float32),
        np.append(cuts, len(term)), block[cuts].astype(np.int32), most, entries,
    )
    share = {c: shares.get(c, 0) / max(1, sum(v == c for v in chosen.values())) for c in (0, 1)}
    votes = []
    for e, d in enumerate(order):
        near = index.nearest(*vectors[d], but=e)
        if near:
            votes.append((index.vote(near), chosen[d], share[chosen[d]]))
    if votes:
        index.curve = logistic(*(np.array(c, float) for c in zip(*votes, strict=True)))
    bare = Counter(chosen[d] for d in chosen if d not in vectors)
    toxic, clean = bare[1] * share[1], bare[0] * share[0]
    index.without = toxic / (toxic + clean) if toxic + clean else 0.0
    return index


def score_documents(docs: DataFrame, index: Index | None) -> DataFrame:
    """(doc_id, score, predicted, evidence) for every row of docs (doc_id, text).

    evidence: the neighbours as (doc_id, toxic, cosine), nearest first, ties by place in the index. Null and empty texts,
    and texts without a term of the index, get the share of toxic ones among such examples and no evidence; without
    labelled rows every score is 0. Repeated rows and null doc_ids are scored like any other; an empty table gives an
    empty result.
    """
    item = pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            scores, evidence = [], []
            for text in batch.column("text").to_pylist():
                near = index.nearest(*index.vector(text)) if index else []
                scores.append(index.score(near) if index else 0.0)
                evidence.append(
                    [{"doc_id": int(index.doc_ids[i]), "toxic": int(index.labels[i]), "cosine": c} for c, i in near]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, pa.list_(item)),
                ],
                ["doc_id", "score", "predicted", "evidence"],
            )

    slim = narrow(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    schema = "doc_id long, score double, predicted int, evidence array<struct<doc_id:long,toxic:int,cosine:double>>"
    return slim.mapInArrow(run, schema)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs, build_index(docs, labels))
    nearest = F.get("evidence", F.lit(0))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", "predicted",
        nearest["doc_id"].alias("nearest_doc"), nearest["cosine"].alias("nearest_cosine"),
    )
