"""Near-dedup keeps documents apart that only their fingerprints bring together."""

import random

import pytest

from lyceum.llm import simhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def family(r, n, changed, words=300):
    """n texts that have all but their last `changed` words in common."""
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    return [" ".join(base[: words - changed] + [f"v{r.randrange(10**6)}" for _ in range(changed)]) for _ in range(n)]


def test_a_family_below_the_similarity_is_kept(spark):
    r = random.Random(3)
    form, close = family(r, 60, 75), family(r, 40, 15)
    assert jaccard(*form[:2]) < 0.7 and jaccard(*close[:2]) > 0.85
    df = spark.createDataFrame(list(enumerate(form + close)), "doc_id long, text string")
    kept = sorted(x["doc_id"] for x in simhash.keep_one_of_each(df).collect())
    assert kept == [*range(60), 60]


def test_most_pairs_just_above_the_similarity_are_found(spark):
    r = random.Random(4)
    pairs = [family(r, 2, 31) for _ in range(150)]
    assert all(0.8 < jaccard(*p) < 0.82 for p in pairs)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(x for p in pairs for x in p)], "doc_id long, text string")
    assert simhash.keep_one_of_each(df).count() <= 300 - 0.9 * 150


@pytest.mark.parametrize("block", [4000, 1 << 24])
def test_blocks_of_a_component_meet(spark, block):
    r = random.Random(5)
    texts = family(r, 30, 15) + family(r, 1, 15)
    sets = [simhash.shingle_set(simhash.shingle_hashes(t, 5)).tobytes() for t in texts]
    df = spark.createDataFrame([(k, 0, 0, 0, 0, 0, bytearray(x)) for k, x in enumerate(sets)], "vertex long, root long, w0 long, w1 long, w2 long, w3 long, shingles binary")
    found = simhash.components(simhash.verified_links(df, simhash.WIDE, 80, block))
    assert {x["v"]: x["root"] for x in found.collect()} == dict.fromkeys(range(30), 0)


def test_many_small_subtries_find_the_same(spark):
    r = random.Random(6)
    texts = [t for _ in range(40) for t in family(r, 3, 12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for node in (1 << 15, 16):
        grouped = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(df, node=node).collect()}
        assert grouped == {k: k // 3 * 3 for k in range(120)}
