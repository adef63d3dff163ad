"""The suffix tree against a version that counts everything in dictionaries."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from lyceum.llm import blocks, suffix_tree
from lyceum.llm.suffix_tree import suffix_tree_scores

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text):
    low = (text or "").translate(LOWER)
    for c in SPACE:
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + [None]


def plain_model(docs, depth, least, weight, gain):
    """chance(context words, word), by definition; and the counts of single words."""
    counts = [Counter() for _ in range(depth + 1)]
    for doc_id, text in docs:
        if zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 7 != 2:
            w = words(text)
            for k in range(depth + 1):
                counts[k].update(tuple(w[i - k : i + 1]) for i in range(k, len(w)))
    single = counts[0]
    total, size = sum(single.values()), len(single)
    followers = defaultdict(Counter)
    for k in range(1, depth + 1):
        for g, n in counts[k].items():
            followers[g[:-1]][g[-1]] = n
    occurrences = {c: sum(f.values()) for c, f in followers.items()}
    kept = {}

    def chance(context, word):
        if not context:
            return (single[(word,)] + 1) / (total + size + 1)
        shorter = chance(context[1:], word)
        if not kept.get(context):
            return shorter
        return (followers[context][word] + weight * shorter) / (occurrences[context] + weight)

    for c in sorted(followers, key=len):
        if occurrences[c] >= least:
            won = sum(n * math.log((n - 1 + weight * chance(c[1:], w)) / (occurrences[c] - 1 + weight) / chance(c[1:], w)) for w, n in followers[c].items())
            kept[c] = won > gain
    return chance, single, total, size


def plain_scores(docs, depth, least, weight, gain):
    chance, single, total, size = plain_model(docs, depth, least, weight, gain)
    out = []
    for doc_id, text in docs:
        w = words(text)
        held = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 7 == 2
        own = sum(math.log10(chance(tuple(w[max(0, i - depth) : i]), w[i])) for i in range(len(w)))
        base = sum(math.log10((single[(x,)] + 1) / (total + size + 1)) for x in w)
        out.append((doc_id, held, len(w), sum((x,) in single for x in w), total, base, own))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    follow = {w: rng.sample("abcdefghij", 2) for w in "abcdefghij"}

    def text():
        out, w = [], "a"
        for _ in range(rng.randrange(60)):
            w = rng.choice(follow.get(w, "a")) if rng.random() < 0.8 else rng.choice("abcdefghijKLé")
            out.append(w + rng.choice(["", "", "", "x"]))
        return rng.choice(["\n", " ", "\x0b", "\t "]).join(out)

    return [(k, text()) for k in range(150)] + [(2, None), (None, ""), (None, "a b c"), (7, "A B only once"), (7, "word " * 3000)]


@pytest.mark.parametrize("depth, least, weight, gain", [(1, 1, 2.0, 0.0), (2, 4, 2.0, 3.0), (3, 2, 0.5, 1.0), (2, 10, 5.0, 50.0)])
def test_scores_against_brute_force(spark, corpus, monkeypatch, depth, least, weight, gain):
    monkeypatch.setattr(suffix_tree, "PART_WORDS", 300)  # frequent contexts are divided
    docs = spark.createDataFrame([(*d, 0) for d in corpus], "doc_id long, text string, score int").repartition(3)
    found = sorted(map(tuple, suffix_tree_scores(docs, depth, least, weight, gain).collect()), key=repr)
    wanted = sorted(plain_scores(corpus, depth, least, weight, gain), key=repr)
    assert [f[:5] for f in found] == [w[:5] for w in wanted]
    for f, w in zip(found, wanted, strict=True):
        assert f[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_probabilities_sum_to_one(corpus):
    chance, single, _, _ = plain_model(corpus, 2, 4, 2.0, 3.0)
    for context in [(), ("a",), ("a", "b"), ("never", "seen")]:
        assert sum(chance(context, w[0]) for w in [*single, ("unknown",)]) == pytest.approx(1)


def test_contexts_help_held_out_documents(spark, corpus):
    rows = suffix_tree_scores(spark.createDataFrame(corpus, "doc_id long, text string")).where("held_out and n_tokens > 20").collect()
    assert len(rows) > 5 and sum(r.score for r in rows) > 0.8 * sum(r.base_score for r in rows)


def test_nothing_and_nothing_to_learn_from(spark):
    assert suffix_tree_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    held = next(k for k in range(99) if suffix_tree.is_held_out(k))
    row = suffix_tree_scores(spark.createDataFrame([(held, "a b a b a b")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row] == [(held, True, 7, 0, 0, 0.0, 0.0)]


def test_long_counts_survive_packing():
    import numpy as np

    numbers = np.array([0, 1, (1 << 31) - 1, 1 << 31, (1 << 32) + 5, 1 << 55], dtype=np.int64)
    assert (blocks.unpacked_long(blocks.packed_long(numbers)) == numbers).all()
