"""The pipeline against a plain version of its stages on the smallest tables."""

import re
import struct
import unicodedata
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lyceum.llm import packing
from lyceum.llm.shared import stored
from tests.llm.test_contracts import dedup_of, groups_of, measures_of, sha
from tests.llm.test_similar import shingles

DATA = "/root/testdata/sf0.001"
PRIVATE = r"\+1 \(\d{3}\) \d{3}-\d{4}|[\w.]+@[\w.]+\w|\bAKIA[A-Z0-9]{16}\b|password=\w+|\b(?:\d{1,3}\.){3}\d{1,3}\b"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before the first stage and after each."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], DATA)))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def good(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars, symbols, dup_lines, repeats = measures_of(text)
    lines = sum(1 for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
    letters, upper = sum(c.isalpha() for c in text), sum(unicodedata.category(c) == "Lu" for c in text)
    return not (
        n < 20 or 100 * repeats > 30 * n or 100 * dup_lines > 50 * lines or 100 * symbols > 10 * n or 100 * upper > 60 * letters
        or 100 * text.count("!") > 30 * n or chars < 2 * n or chars > 15 * n or 100 * letters < 50 * chars
        or 100 * sum("0" <= c <= "9" for c in text) > 50 * chars
        or 100 * sum(a == b for a, b in zip(words, words[1:])) > 30 * n
    )


def test_quality(stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert after == {d: t for d, t in before.items() if good(t or "")}
    assert len(after) < len(before)


def test_line_dedup(stages):
    before, after = texts(stages[1]), texts(stages[2])
    assert sorted(((d, sha(t)) for d, t in after.items()), key=repr) == [(d, s) for d, _, _, s in dedup_of(list(before.items()))]


def test_near_dedup(stages):
    """Against exact similarities of all pairs: nothing is removed without a link, and few links are missed."""
    before, after = texts(stages[2]), texts(stages[3])
    ids = list(before)
    sets = [frozenset(shingles(before[d])) for d in ids]

    def near(a, b):
        return 10 * len(a & b) >= 8 * len(a | b)

    kept = {d for d, _, group in groups_of(ids, sets, near) if d == group}
    assert kept <= after.keys() and all(after[d] == before[d] for d in after)
    assert len(after) < len(before) and len(after.keys() - kept) <= 0.1 * (len(before) - len(kept))


def test_pseudonyms(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert before.keys() == after.keys()
    changed = 0
    for d, text in before.items():
        private = re.findall(PRIVATE, text)
        assert not any(p in after[d] for p in private)
        changed += bool(private)
        if not re.search(r"\d|@|AKIA|=|:", text):
            assert after[d] == text
    assert changed


def test_packing(stages):
    coder = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    expected = []
    for d, text in texts(stages[4]).items():
        ids = [*coder.encode(text, add_special_tokens=False).ids, 0]
        parts = [ids[at : at + 2048] for at in range(0, len(ids), 2048)]
        expected += [(d, k, k * 2048, len(p), zlib.crc32(struct.pack(f"<{len(p)}I", *p))) for k, p in enumerate(parts)]
    out = stages[5].collect()
    assert sorted(tuple(r)[:5] for r in out) == sorted(expected)
    assert len({r["sequence_id"] for r in out}) == -(-sum(e[3] for e in expected) // 2048)


def test_stages_keep_the_columns_of_documents(stages):
    for df in stages[1:5]:
        assert df.dtypes == stages[0].dtypes
        assert df.where("n_chars <> length(text)").count() == 0


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, DATA).count() == stages[5].count()


def test_pipeline_survives_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (None, "x " * 40, None, None, 1), (3, "y z " * 9000, "en", "s", 9)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, DATA))
        assert docs.count() >= 0
