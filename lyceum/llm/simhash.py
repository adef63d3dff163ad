"""SimHash near-dedup by self-joins of binary tries of fingerprints.

A pair of trie nodes is followed downwards together with the number of bits in which their prefixes differ, and dropped as
soon as that exceeds the error budget. A fingerprint is put into several tries, each with other bits first, and at the top
of each trie a smaller budget holds, so that most pairs are dropped early. The top is dealt out by Spark: every fingerprint
is sent to the pairs of prefixes within that budget, and each pair of subtries is traversed in one task with numpy, level by
level, in bounded memory. Crowded prefixes are cut by further bits first. A task returns a spanning forest of the links it
found, never all pairs, and passes over node pairs that are in one tree already; components come from alternating star
contractions over stored edges.

Two plans of tries: `halves` finds all pairs within a small budget B (they differ in at most B div 2 bits in one half of the
fingerprint, so two tries do). `heads` is for wide budgets, where such a guarantee would prune too late: 256 bits, tries
whose first bits must agree and whose next ones may differ in a few, as many tries as a given recall takes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyceum.llm.shared import arrow_batches, discard, heavy_join, narrow, shared_dir, stored, text_or_empty

BITS = 64
#: Fingerprints that a subtrie should hold at most.
NODE = 1 << 14
#: A prefix is crowded from one part in so many of all fingerprints on: at most so many can be.
CROWDED_PARTS = 400
#: Prefix bits that a trie is dealt by at least, for enough tasks however few fingerprints there are.
LEAST_TOP = 5
#: Node pairs handled at once, and pairs of leaves compared without going further down; their product, some ten long
#: integers each, is what a task holds beside its fingerprints.
CHUNK, SMALL = 1 << 13, 64
VOTES = 1 << 16
#: Words of a wide fingerprint, and differing bits up to which two of them are candidates. Sets of shingles with a Jaccard
#: similarity of 0.8 differ in 38.8 of the 256 bits on average, with a deviation of 5.7.
WORDS, WIDE = ["w0", "w1", "w2", "w3"], 56
#: Bytes of shingle hashes of one component that are compared in one task with themselves, or with as many others.
BLOCK_BYTES = 16 << 20


@dataclass(frozen=True)
class Tries:
    """Where each trie's first bit lies, and the differing bits allowed: in the `top` bits that Spark deals by, in the first
    `head` bits, in the 64 bits of the trie, and in all bits of the fingerprint."""

    starts: tuple[int, ...]
    top: int
    top_errors: int
    head: int
    head_errors: int
    budget: int
    wide: int


def halves(n: int, budget: int = 2, node: int = NODE) -> Tries:
    """All pairs of 64-bit fingerprints within the budget, of n fingerprints."""
    half = BITS // 2
    top = min(half, max(LEAST_TOP, (n // node).bit_length()))
    return Tries((0, half), top, budget // 2, half, budget // 2, budget, budget)


def heads(n: int, node: int = NODE) -> Tries:
    """Pairs of 256-bit fingerprints of Jaccard similarity 0.8 and more, of n fingerprints.

    The top bits agree, the next twelve or more differ in three at most. More top bits, which keep a subtrie at `node`
    fingerprints whatever n is, are paid by more tries: their number grows about with the fourth root of n. By simulation
    (independent bits) a pair of similarity 0.8 meets in one of them with a chance of 0.99 at 5 bits, 0.97 at 8 and at 12, 0.91
    at 16; of 0.85 with 0.97 and more in all cases.
    """
    top = min(16, max(LEAST_TOP, (n // node).bit_length()))
    stride = 16 if top <= 8 else 8 if top <= 12 else 4
    return Tries(tuple(range(0, BITS * len(WORDS), stride)), top, 0, max(24, top + 12), 3, 20, WIDE)


def simhash(text: str, width: int = 3, seed: int = 42) -> int:
    """Majority bits over the XXH64 of all word shingles; 0 without words. A-Z are lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= width:
        return hash64(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), VOTES):
        part = [hash64(joined[a:b], seed) for a, b in zip(starts[at : at + VOTES], ends[at : at + VOTES], strict=True)]
        rows = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as a signed long. A null text is empty."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            marks = np.array([simhash(t, width) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks.view(np.int64))], ["doc_id", "fp"])

    slim = narrow(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    return slim.mapInArrow(score, "doc_id long, fp long")


def masks(bits: int, budget: int) -> list[int]:
    """All patterns of at most `budget` set bits among `bits`."""
    return [sum(1 << b for b in c) for n in range(budget + 1) for c in combinations(range(bits), n)]


class Forest:
    """Union-find over 0..n-1 whose roots are kept flat, so that links inside a tree are dropped by array."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            fresh = self.root[a] != self.root[b]
            a, b = a[fresh], b[fresh]
            head, a, b = (a[:4096], b[:4096]), a[4096:], b[4096:]
            up: dict[int, int] = {}

            def find(x: int) -> int:
                while x in up:
                    up[x] = up.get(up[x], up[x])
                    x = up[x]
                return x

            for x, y in zip(head[0].tolist(), head[1].tolist(), strict=True):
                rx, ry = find(int(self.root[x])), find(int(self.root[y]))
                if rx != ry:
                    up[max(rx, ry)] = min(rx, ry)
                    self.edges.append((x, y))
            if up:
                flat = np.arange(len(self.root))
                flat[list(up)] = [find(x) for x in up]
                self.root = flat[self.root]


def window(words: list[np.ndarray], start: int) -> np.ndarray:
    """The 64 bits from bit `start` on of fingerprints given by their words, the first bit following the last."""
    k, by = divmod(start, BITS)
    if not by:
        return words[k]
    return (words[k] << np.uint64(by)) | (words[(k + 1) % len(words)] >> np.uint64(BITS - by))


def window_column(words: list[str], start: int) -> Column:
    """The same as a column."""
    k, by = divmod(start, BITS)
    if not by:
        return F.col(words[k])
    return F.shiftleft(words[k], by).bitwiseOR(F.shiftrightunsigned(words[(k + 1) % len(words)], BITS - by))


def differing(words: list[np.ndarray], i, j) -> np.ndarray:
    return sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in words)


def linked(left: np.ndarray, right: np.ndarray | None, depth: int, apart: int, tries: Tries, forest: Forest | None = None) -> Iterator[tuple]:
    """Index pairs (i, j) of left and right within the budgets of tries, in chunks; of left alone with i < j if right is None.

    The arrays are sorted, each of one prefix of `depth` bits; these prefixes differ in `apart` bits. Pairs beyond the budget
    of the head may be found too, if a leaf compares them. Node pairs inside one tree of the forest (over left, then right)
    are passed over.
    """
    alone = right is None
    right = left if alone else right
    behind = 0 if alone else len(left)
    zeros: dict[tuple[int, int], np.ndarray] = {}

    def middle(side: int, bit: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if (side, bit) not in zeros:
            values = (left, right)[side]
            clear = ((values >> np.uint64(BITS - 1 - bit)) & np.uint64(1)) == 0
            zeros[side, bit] = np.concatenate([[0], np.cumsum(clear)])
        count = zeros[side, bit]
        return lo + count[hi] - count[lo]

    def joined(a0, a1, b0, b1) -> np.ndarray:
        """Where both nodes lie in one tree."""
        run = np.concatenate([[0], np.cumsum(forest.root[1:] != forest.root[:-1])])
        b0, b1 = b0 + behind, b1 + behind
        return (run[a0] == run[a1 - 1]) & (run[b0] == run[b1 - 1]) & (forest.root[a0] == forest.root[b0])

    one = lambda x: np.array([x], np.int64)
    stack = [(depth, one(0), one(len(left)), one(0), one(len(right)), one(apart))]
    if not len(left) or not len(right):
        return
    while stack:
        bit, *node = stack.pop()
        if len(node[0]) > CHUNK:
            half = len(node[0]) // 2
            stack += [(bit, *(x[s] for x in node)) for s in (slice(half, None), slice(half))]
            continue
        if forest is not None and forest.edges:
            open_ = ~joined(*node[:4])
            node = [x[open_] for x in node]
        a0, a1, b0, b1, d = node
        leaf = ((a1 - a0) * (b1 - b0) <= SMALL) | (bit >= BITS)
        if leaf.any():
            na, nb = (a1 - a0)[leaf], (b1 - b0)[leaf]
            size = na * nb
            at = np.repeat(np.arange(len(size)), size)
            within = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            i, j = a0[leaf][at] + within // nb[at], b0[leaf][at] + within % nb[at]
            near = np.bitwise_count(left[i] ^ right[j]) <= tries.budget
            if alone:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        a0, a1, b0, b1, d = (x[~leaf] for x in (a0, a1, b0, b1, d))
        if not len(a0):
            continue
        am, bm = middle(0, bit, a0, a1), middle(1, bit, b0, b1)
        spent = d + 1
        kinds = [(a0, am, bm, b1, spent), (am, a1, b0, bm, spent), (a0, am, b0, bm, d), (am, a1, bm, b1, d)]
        if alone:  # a node with itself: its higher half with its lower one is met already
            other = a0 != b0
            kinds[1] = tuple(x[other] for x in kinds[1])
        kids = [np.concatenate(x) for x in zip(*kinds, strict=True)]
        alive = (kids[1] > kids[0]) & (kids[3] > kids[2]) & (kids[4] <= (tries.head_errors if bit < tries.head else tries.budget))
        if alive.any():
            stack.append((bit + 1, *(x[alive] for x in kids)))


def links(fps: DataFrame, words: list[str], tries: Tries, node: int = NODE) -> DataFrame:
    """(a, b): a spanning forest, task by task, of the links between the rows (vertex, *words) of fps: what meets in one of the
    tries and differs in at most tries.wide bits in all."""
    n = fps.count()
    top = tries.top
    crowded: dict[tuple[int, int], int] = {}
    if n > node:
        bound = max(node, n // CROWDED_PARTS)
        turns = F.array(*(window_column(words, start) for start in tries.starts))
        sides = fps.select(F.posexplode(turns).alias("side", "v"))
        counts = sides.groupBy("side", F.shiftrightunsigned("v", BITS - top).alias("p")).count()
        for r in counts.where(F.col("count") > bound).collect():  # at most CROWDED_PARTS for each trie
            crowded[r["side"], r["p"]] = min(tries.head - top, (r["count"] // bound).bit_length())
    base = np.array(masks(top, tries.top_errors), np.uint64)
    names = ["level", "lo", "hi", "vertex", *words]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [batch.column(w).to_numpy(zero_copy_only=False).view(np.uint64) for w in words]
            for side, start in enumerate(tries.starts):
                yield from deal_side(side, window(whole, start), batch)

    def deal_side(side: int, values: np.ndarray, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        home = values >> np.uint64(BITS - top) if top else np.zeros_like(values)
        hot = [(np.uint64(p), extra) for (s, p), extra in crowded.items() if s == side]
        for mask in base:
            more = np.zeros(len(values), np.int64)
            for p, extra in hot:
                at = (home == p) | (home == p ^ mask)
                more[at] = np.maximum(more[at], extra)
            left = tries.head_errors - int(np.bitwise_count(mask))
            for extra in np.unique(more).tolist():
                chosen = np.flatnonzero(more == extra)
                depth = top + extra
                rows = values[chosen]
                own = rows >> np.uint64(BITS - depth) if depth else np.zeros_like(rows)
                taken = batch.take(pa.array(chosen))
                for low in masks(extra, left):
                    near = own ^ ((mask << np.uint64(extra)) | np.uint64(low))
                    columns = [
                        pa.array(np.full(len(rows), side * BITS + depth, np.int32)),
                        pa.array(np.minimum(own, near).view(np.int64)),
                        pa.array(np.maximum(own, near).view(np.int64)),
                    ]
                    yield pa.RecordBatch.from_arrays([*columns, *(taken.column(c) for c in names[3:])], names)

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        side, depth, lo, hi = int(key[0]) // BITS, int(key[0]) % BITS, int(key[1]), int(key[2])
        whole = [rows[w].to_numpy().view(np.uint64) for w in words]
        values = window(whole, tries.starts[side])
        order = np.argsort(values, kind="stable")
        if lo != hi:
            low = (values[order] >> np.uint64(BITS - depth)) == np.uint64(lo)
            left, right = values[order[low]], values[order[~low]]
            order = np.concatenate([order[low], order[~low]])
        else:
            left, right = values[order], None
        whole, vertex = [w[order] for w in whole], rows["vertex"].to_numpy()[order]
        behind = 0 if right is None else len(left)
        forest = Forest(len(values))
        for i, j in linked(left, right, depth, (lo ^ hi).bit_count(), tries, forest):
            j = j + behind
            if len(words) > 1:
                near = differing(whole, i, j) <= tries.wide
                i, j = i[near], j[near]
            forest.add(i, j)
        at = np.array(forest.edges, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": vertex[at[:, 0]], "b": vertex[at[:, 1]]})

    schema = "level int, lo long, hi long, vertex long, " + ", ".join(f"{w} long" for w in words)
    dealt = fps.select("vertex", *words).mapInArrow(deal, schema)
    return dealt.groupBy("level", "lo", "hi").applyInPandas(join, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the edges (a, b) of longs: root is the smallest vertex reachable.

    Alternating large-star and small-star contractions until nothing changes; every round is stored, and earlier ones are
    deleted. Minima are combined before the shuffle, and a star's centre is a skewed join key that adaptive execution splits.
    """
    spark = edges.sparkSession
    a, b = F.col("a"), F.col("b")
    old = [shared_dir(spark)]
    edges = stored(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), path=old[0])
    state = None
    while True:
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b"))
        old.append(shared_dir(spark))
        large = stored(large.where(a != b).distinct(), path=old[-1])
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(least, "a")
        small = pairs.select(b.alias("a"), F.col("m").alias("b")).unionByName(pairs.select("a", F.col("m").alias("b")))
        last = shared_dir(spark)
        edges = stored(small.where(a != b).distinct(), path=last)
        discard(spark, *old)
        old = [last]
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("v"), "root")
    return roots.unionByName(edges.select(b.alias("v"), b.alias("root")).distinct())


def named_components(fps: DataFrame, roots: DataFrame, key: list[str]) -> DataFrame:
    """(*key, component_id, n_docs) for every row of fps (*key, vertex, first_doc, n_docs), from the (v, root) of its vertices."""
    linked_fps = stored(fps.join(roots.withColumnRenamed("v", "vertex"), "vertex"))
    least = linked_fps.groupBy("root").agg(F.min("first_doc").alias("least_doc"))
    named = linked_fps.join(least, "root").select("vertex", "least_doc")
    table = fps.join(named, "vertex", "left")
    return stored(table.select(*key, F.coalesce("least_doc", "first_doc").alias("component_id"), "n_docs"))


def near_groups(docs: DataFrame, width: int = 3, budget: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text).

    Documents are linked if their fingerprints differ in at most `budget` bits; component_id is the smallest doc_id reachable
    over links, itself included. Null and empty texts, and texts without words, have fingerprint 0 and are linked like any
    other. A null doc_id names a component only if all its documents have none. An empty table gives an empty result;
    further columns are not looked at.
    """
    marked = stored(fingerprints(docs, width))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs"))
    fps = stored(distinct.withColumn("vertex", F.monotonically_increasing_id()))
    roots = components(links(fps, ["fp"], halves(fps.count(), budget)))
    return heavy_join(marked, named_components(fps, roots, ["fp"]), ["fp"], "n_docs", "inner").select("doc_id", "fp", "component_id")


def near_group_digest(docs: DataFrame) -> DataFrame:
    grouped = near_groups(docs, width=3, budget=2)
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """The distinct word shingles as 128-bit hashes, two words each, A-Z lower-cased; without words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined, hash128 = b" ".join(words), xxhash.xxh3_128_digest
    if len(words) <= width:
        return np.frombuffer(hash128(joined), "<u8").reshape(-1, 2) if words else np.zeros((0, 2), np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    found = {hash128(joined[a:b]) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)}
    return np.frombuffer(b"".join(sorted(found)), "<u8").reshape(-1, 2)


def mixed(values: np.ndarray) -> np.ndarray:
    """A second hash of hashes (the finalizer of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def wide_simhash(hashes: np.ndarray) -> np.ndarray:
    """Four words of majority bits over a set of 128-bit hashes; 0 for none."""
    if not len(hashes):
        return np.zeros(len(WORDS), np.uint64)
    votes = np.zeros(BITS * len(WORDS), np.int64)
    for at in range(0, len(hashes), VOTES):
        part = hashes[at : at + VOTES]
        rows = np.ascontiguousarray(np.concatenate([part, mixed(part)], axis=1)).view(np.uint8)
        votes += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes[:, 0].astype(np.uint32))


def shingled(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, w0 to w3, shingles): the 256-bit fingerprint of the distinct word shingles, and these as sorted 32-bit hashes. A
    null text is empty; a text without words has no shingles."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            hashes = [shingle_hashes(t, width) for t in batch.column("text").to_pylist()]
            marks = np.array([wide_simhash(h) for h in hashes], np.uint64).reshape(-1, len(WORDS)).view(np.int64)
            sets = pa.array([shingle_set(h).tobytes() for h in hashes], pa.binary())
            columns = [pa.array(np.ascontiguousarray(marks[:, k])) for k in range(len(WORDS))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, sets], ["doc_id", *WORDS, "shingles"])

    slim = narrow(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    return slim.mapInArrow(score, "doc_id long, w0 long, w1 long, w2 long, w3 long, shingles binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have at least so many percent of their union in common."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    if not len(b):
        return True
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def verified_links(members: DataFrame, wide: int, percent: int, block: int = BLOCK_BYTES) -> DataFrame:
    """(a, b): a spanning forest, task by task, of the links between members (vertex, root, w0 to w3, shingles) of one root.

    Linked are members whose fingerprints differ in at most `wide` bits and whose shingle sets have `percent` percent of their
    union in common. Roots whose shingles have up to `block` bytes are compared by the bucketful; larger ones are cut into
    blocks, and each two blocks meet in one task. Two members are compared only while nothing else has joined them.
    """
    size = F.octet_length("shingles").cast("long") + 64
    sizes = stored(members.groupBy("root").agg(F.sum(size).alias("n_bytes"), F.count("*").alias("n")))
    total = sizes.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // block)
    sizes = sizes.select("root", "n", F.ceil(F.col("n_bytes") / block).cast("long").alias("blocks"))
    slim = heavy_join(members, sizes, ["root"], "n", "inner")
    own = F.pmod(F.xxhash64("vertex"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = slim.withColumn("own", own).withColumn("other", other).select(
        F.pmod(F.xxhash64("root"), F.lit(buckets)).alias("bucket"),
        F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        "own", "vertex", "root", *WORDS, "shingles",
    )

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["root", "own", "vertex"], kind="stable")
        root, own = rows["root"].to_numpy(), rows["own"].to_numpy()
        vertex, data = rows["vertex"].to_numpy(), rows["shingles"].to_numpy()
        words = [rows[w].to_numpy().view(np.uint64) for w in WORDS]
        found: list[tuple[int, int]] = []
        cuts = [0, *(np.flatnonzero(root[1:] != root[:-1]) + 1).tolist(), len(root)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            sets = [np.frombuffer(x, np.uint32) for x in data[lo:hi]]
            marks, side = [w[lo:hi] for w in words], own[lo:hi]
            tree = np.arange(hi - lo)
            for i in range(hi - lo - 1):
                apart = tree[i + 1 :] != tree[i]
                if key[1] != key[2]:
                    apart &= side[i + 1 :] != side[i]
                later = np.flatnonzero(apart) + i + 1
                if len(later):
                    later = later[differing(marks, i, later) <= wide]
                for j in later.tolist():
                    if tree[i] != tree[j] and similar(sets[i], sets[j], percent):
                        tree[tree == tree[j]] = tree[i]
                        found.append((vertex[lo + i], vertex[lo + j]))
        at = np.array(found, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": at[:, 0], "b": at[:, 1]})

    return dealt.groupBy("bucket", "lo", "hi").applyInPandas(join, "a long, b long")


def similar_groups(docs: DataFrame, width: int = 5, percent: int = 80, node: int = 1 << 15) -> DataFrame:
    """(doc_id, component_id) for every row of docs (doc_id, text), component_id as in near_groups.

    The tries only search candidates: these are joined to components, and inside each of them every two documents whose
    fingerprints differ in at most WIDE bits are linked if their shingle sets have a Jaccard similarity of `percent` percent at
    least (exact but for collisions of 32-bit hashes). Documents without words are one component.
    """
    marked = shingled(docs, width).withColumn("vertex", F.monotonically_increasing_id())
    marked = stored(marked.withColumn("set_id", F.xxhash64("shingles")))
    key = ["w0", "w1", "set_id"]
    first = [F.first(w).alias(w) for w in WORDS[2:]]
    distinct = marked.groupBy(*key).agg(
        F.min("vertex").alias("vertex"), F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs"), *first
    )
    fps = stored(distinct)
    # vertices of one fingerprint and several shingle sets meet in the trie like any others
    roots = components(links(fps, WORDS, heads(fps.count(), node), node)).withColumnRenamed("v", "vertex")
    members = fps.select("vertex", *WORDS).join(roots, "vertex").join(marked.select("vertex", "shingles"), "vertex")
    roots = components(verified_links(stored(members), WIDE, percent))
    table = named_components(fps, roots, key)
    return heavy_join(marked.select("doc_id", *key), table, key, "n_docs", "inner").select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is its component's smallest in similar_groups; a repeated doc_id keeps all its rows."""
    grouped = similar_groups(docs, width, percent=percent)
    first = grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(F.col("_id")), "left_semi")
