import math
import random
from collections import Counter

import numpy as np
import pytest

from lyceum.llm import toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(1)
    words = [f"plain{k}" for k in range(600)]
    table, labels = [], []
    for k in range(400):
        text = r.choices(words, k=80)
        toxic = k % 4 == 0
        if toxic:
            text[r.randrange(80)] = r.choice(["nasty", "Vilely", "vilest"])
        table.append((k, " ".join(text)))
        labels.append((k, int(k % 7 > 0), int(toxic)))
    table += [(900, None), (901, ""), (None, "nasty"), (5, table[5][1]), (902, "vileness " * 3000)]
    labels += [(None, 1, 1), (950, 1, None), (0, 1, 1)]
    return (
        spark.createDataFrame(table, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_held_out_rows_are_told_apart(corpus):
    docs, labels = corpus
    out = toxicity.toxicity_digest(docs, labels).join(labels.dropna(), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert held and all(r["predicted"] == r["toxic"] for r in held)
    assert toxicity.toxicity_digest(docs, labels).count() == docs.count()


def test_cosines_are_those_of_a_brute_force_version(corpus):
    """Term weights and cosines built by hand from the texts: idf over all documents, phi over the examples, no term left out."""
    docs, labels = corpus
    index = toxicity.build_index(docs, labels)
    all_texts = [r["text"] or "" for r in docs.collect()]
    of = {}
    for r in docs.where("doc_id is not null").collect():
        of.setdefault(r["doc_id"], []).append(r["text"] or "")
    bags = {d: Counter(t for text in of[d] for w in toxicity.words_of(text) for t in toxicity.terms_of(w)) for d in index.doc_ids.tolist()}
    label = dict(zip(index.doc_ids.tolist(), index.labels.tolist(), strict=True))
    n, n1 = len(bags), sum(label.values())
    df = Counter(t for text in all_texts for t in {t for w in toxicity.words_of(text) for t in toxicity.terms_of(w)})
    held, toxic = Counter(), Counter()
    for d, bag in bags.items():
        held.update(bag.keys())
        toxic.update(bag.keys() if label[d] else ())

    def weight(t):
        a, h = toxic[t], held[t]
        phi2 = (a * (n - n1) - (h - a) * n1) ** 2 / max(1, n1 * (n - n1) * h * (n - h))
        return (math.log((1 + len(all_texts)) / (1 + df[t])) + 1) * max(0.0, phi2 - 1 / (n - 1))

    weights = {t: w for t in held if (w := weight(t)) > 0}
    assert index.vocabulary.keys() == weights.keys()

    def vector(bag):
        raw = {t: (1 + math.log(c)) * weights[t] for t, c in bag.items() if t in weights}
        length = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / length for t, x in raw.items()}

    vectors = [vector(bags[d]) for d in index.doc_ids.tolist()]
    for text in all_texts[::7] + all_texts[-5:]:
        query = vector(Counter(t for w in toxicity.words_of(text) for t in toxicity.terms_of(w)))
        cosines = [sum(x * v.get(t, 0.0) for t, x in query.items()) for v in vectors]
        best = sorted((c for c in cosines if c > 0), reverse=True)[: toxicity.NEAREST]
        assert np.allclose([c for c, _ in index.nearest(*index.vector(text))], best, atol=1e-6)


def test_copies_among_the_examples_count_once_and_boilerplate_is_no_copy():
    line = "all rights reserved by the owners of this page and its parts"
    words = [toxicity.words_of(f"{line} {' '.join(f'own{k}x{i}' for i in range(40))}") for k in range(2)]
    assert toxicity.sketch(words[0]) != toxicity.sketch(words[1])
    assert toxicity.sketch(words[0]) == toxicity.sketch(list(words[0]))


def test_without_labels_or_documents(spark, corpus):
    docs, labels = corpus
    none = toxicity.toxicity_digest(docs, labels.where("doc_id < 0")).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.toxicity_digest(docs.where("doc_id < 0"), labels).count() == 0
    clash = docs.selectExpr("*", "1 as score", "2 as toxic", "3 as term")
    assert toxicity.toxicity_digest(clash, labels).count() == docs.count()


def test_terms_are_counted_as_word_by_word():
    lookup = toxicity.WordTerms({"storm": 0, "stor*": 1, "sea": 2, "storm*": 3})
    terms, counts = lookup.counts("Storm, storms; SEA sea storm")
    assert (terms.tolist(), counts.tolist()) == ([0, 1, 2, 3], [2, 3, 2, 3])
    assert [len(c) for c in lookup.counts("")] == [0, 0]
