"""Phrases and spelling variants against brute-force versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lyceum.llm import phrases as P
from lyceum.llm import spelling as S

from .conftest import rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_phrases(docs, least=10, percent=50, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        longer = defaultdict(int)
        for g, a in counts.items():
            if len(g) == 3 and a >= least:
                for part in (g[:2], g[1:]):
                    longer[part] = max(longer[part], a)
        for g, a in counts.items():
            if len(g) > 1 and a >= least and not (len(g) == 2 and 100 * longer[g] >= percent * a and longer[g]):
                cuts = [(1000000 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out, key=repr)


def test_phrases_by_hand(spark):
    texts = [("en", "Red Fox runs. red fox sleeps, red fox runs")] * 5 + [(None, "a b c")] * 10 + [("und", "a b d\na b")] * 2
    docs = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "doc_id long, lang string, text string")
    found = rows(P.phrases(docs))
    assert ("en", 1, "red fox", 15, 15, 15, 40, 1000000) in found or ("en", 2, "red fox", 15, 15, 15, 40, 1000000) not in found
    assert found == plain_phrases(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["a", "b", "C", "é", "dd", "x y", "E"]
    texts = [
        (rng.choice(["en", "de", None, "und", "x\ny"]), "".join(rng.choice(words) + rng.choice(" \t  .\n\x0b,;") for _ in range(rng.randrange(80))))
        for _ in range(120)
    ] + [("en", None), (None, None), ("en", "")]
    docs = spark.createDataFrame([(None if k % 7 == 0 else k % 50, *t, 1) for k, t in enumerate(texts)], "doc_id long, lang string, text string, n int")
    assert rows(P.phrases(docs, least=5, top=40)) == plain_phrases(texts, 5, 50, 40)
    assert rows(P.phrases(docs, least=3, covered_percent=80)) == plain_phrases(texts, 3, 80)


def test_blocks_do_not_change_phrases(spark, monkeypatch):
    texts = [("en", "one two three four. " * k) for k in range(9)]
    docs = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "doc_id long, lang string, text string").repartition(3)
    assert rows(P.phrases(docs)) == plain_phrases(texts)


def test_radix_order():
    import numpy as np

    from lyceum.llm.blocks import packed, radix_order, unpacked

    rng = np.random.default_rng(5)
    columns = [rng.integers(0, top, 5000, dtype=np.uint32) for top in (70000, 3, 1 << 31)]
    assert (radix_order(*columns) == np.lexsort(columns[::-1])).all()
    assert (unpacked(packed(columns[0])) == columns[0]).all() and len(unpacked(packed(columns[0][:0]))) == 0


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert rows(P.phrases(docs)) == []
    docs = spark.createDataFrame([(1, "en", "rare words only"), (2, None, None)], "doc_id long, lang string, text string")
    assert rows(P.phrases(docs)) == []


def plain_spelling(docs, letters=6, least=5, times=5):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= least}
    near, deleted = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            short = w[:k] + w[k + 1 :]
            if short in n:
                near[w].add(short)
                near[short].add(w)
            deleted[(k, short)].add(w)
    for same in deleted.values():
        for w in same:
            near[w] |= same - {w}
    out, form = [], {}
    for w, c in n.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * c else None
    for w, c in n.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, c, len(near[w]), None if form[w] is None else n[form[w]]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_words, round_bytes", [(S.SHARD_WORDS, S.ROUND_BYTES), (7, 1)])
def test_spelling_against_brute_force(spark, monkeypatch, shard_words, round_bytes):
    rng = random.Random(3)
    base = ["".join(rng.choice("abÀÿc") for _ in range(rng.randrange(5, 9))) for _ in range(60)]

    def typo(w):
        k, c = rng.randrange(len(w)), rng.choice("abcÿ")
        return rng.choice([w, w, w, w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w.upper()])

    docs = [(k, " ".join(typo(rng.choice(base[: rng.choice([3, 10, 60])])) + rng.choice(["", ".", "1", "_"]) for _ in range(120))) for k in range(150)]
    docs += [(77, "mnopqrs " * 200 + "mnopqrt " * 30 + "mnouqrt " * 5), (None, "x" * 5000 + " " + "y" * 4000), (4, None), (5, "")] + [(9, "banana " * 30 + "bananna bananas banana " * 6)] * 2
    table = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, form int").repartition(5)
    monkeypatch.setattr(S.with_near, "__defaults__", (shard_words, round_bytes))
    found = rows(S.spelling_variants(table))
    assert found == plain_spelling(docs)
    assert any(r[1] for r in found) and any(r[2] not in (r[0], r[1]) for r in found)


def test_spelling_of_nothing(spark):
    assert rows(S.spelling_variants(spark.createDataFrame([], "doc_id long, text string"))) == []
    assert rows(S.spelling_variants(spark.createDataFrame([(1, "few words"), (2, None)], "doc_id long, text string"))) == []


def test_slips_delete_a_letter():
    runs = [f"{a}{b}bcdef" for a in "abcdefgh" for b in "klmnopqrst"]
    found = {S.slipped(k, r) for k in range(40) for r in runs}
    assert any(len(w) == 6 for w in found) and all(len(w) in (6, 7) for w in found)


def test_trie_finds_what_distance_one_says():
    rng = random.Random(11)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(200)})
    row = S.Trie.row(words, [k + 1 for k in range(len(words))])
    trie = S.Trie(row["labels"], row["first"], row["n"], row["tails"])
    for w in [*words, "", "c", "abcab", "aaaaaaaaaa"]:
        found = list(trie.near(w))
        assert sorted(f[0] for f in found) == [x for x in words if S._one_off(w, x)]
        assert all(words[n - 1] == x for x, n in found)


def test_roman_numerals_and_circled_letters_are_no_capitals():
    from lyceum.llm.quality import _cases

    assert _cases("ⅧⒶÀé9a") == (1, 3, 1)
