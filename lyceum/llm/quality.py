"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: the ledger keeps the measurements and one bit per failed rule. Policies are
versioned sets of rules applied to the stored bits, and ablations (what a policy would keep without one of its rules) are
bitwise aggregations over the ledger, without looking at a text again.
"""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lyceum.llm.shared import narrow, stored

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_exclaim",
    "n_stutter",
]


def _rules() -> dict[str, Column]:
    """Rule name -> failure condition over the measurements. The order gives the bits and only grows."""
    c = F.col
    return {
        "few_words": c("n_words") < 20,
        "repeated_windows": 100 * c("n_repeat_words") > 30 * c("n_words"),
        "duplicate_lines": 100 * c("n_dup_lines") > 50 * c("n_lines"),
        "symbols": 100 * c("n_symbols") > 10 * c("n_words"),
        "shouting": 100 * c("n_upper") > 60 * c("n_letters"),
        "exclamations": 100 * c("n_exclaim") > 30 * c("n_words"),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")),
        "few_letters": 100 * c("n_letters") < 50 * c("word_chars"),
        "digits": 100 * c("n_digits") > 50 * c("word_chars"),
        "stutter": 100 * c("n_stutter") > 30 * c("n_words"),
    }


BASE = ("few_words", "repeated_windows")
#: Version -> rules that it holds a document to.
POLICIES = {
    "base": BASE,
    "2025-1": (
        *BASE, "duplicate_lines", "symbols", "shouting", "exclamations", "word_length", "few_letters", "digits",
        "stutter",
    ),
}
CURRENT = "2025-1"


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that stand in the text twice or more. Exact: windows are numbered by doubling."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    if len(seen) == len(words):
        return 0
    span = 1
    while span < window:
        step = min(span, window - span)
        pairs = ids[: len(ids) - step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(pairs, return_inverse=True)[1]
        span += step
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The values of MEASURES for one text."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        *_cases(text),
        text.count("!"),
        sum(map(eq, words, words[1:])),
    )


def _cases(text: str) -> tuple[int, int, int]:
    """Letters of class Lu, letters of all classes and ASCII digits, by code point."""
    if text.isascii():
        codes = np.frombuffer(text.encode(), np.uint8)
        count = np.bincount(codes, minlength=128)
        upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
        return upper, upper + lower, int(count[48:58].sum())
    seen = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
    pairs = [(chr(c), int(n)) for c, n in zip(*seen, strict=True)]
    return (
        sum(n for c, n in pairs if unicodedata.category(c) == "Lu"),
        sum(n for c, n in pairs if c.isalpha()),
        sum(n for c, n in pairs if "0" <= c <= "9"),
    )


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def measures(text: pa.Array) -> pa.Array:
    rows = np.array([measure(t or "") for t in text.to_pylist()], np.int64).reshape(-1, len(MEASURES))
    return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(MEASURES))], MEASURES)


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and `failed_rules`, a long with bit k set if rule k fails.

    Null and empty texts have no words. Ties, repeated rows and null doc_ids are rows like any other; an empty table
    gives an empty ledger.
    """
    book = narrow(docs, "doc_id", "text").select("doc_id", measures("text").alias("m")).select("doc_id", "m.*")
    return book.withColumn("failed_rules", failed_rules())


def failed_rules() -> Column:
    bits = [F.shiftleft(cond.cast("long"), k) for k, cond in enumerate(_rules().values())]
    return reduce(Column.bitwiseOR, bits)


def mask(rules: tuple[str, ...]) -> int:
    names = list(_rules())
    return sum(1 << names.index(r) for r in rules)


def passes(version: str = CURRENT) -> Column:
    return F.col("failed_rules").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0


def ablations(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """(policy, rule, n_failed, n_only, n_kept, n_kept_without): one row per rule of the policy, from one grouping of the
    ledger by its bit patterns (as many groups as patterns occur, whatever the number of documents)."""
    held = mask(POLICIES[version])
    patterns = book.groupBy(F.col("failed_rules").bitwiseAND(F.lit(held)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit")) for r in POLICIES[version]))
    each = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    only = F.col("bits") == F.col("bit")
    clean = F.col("bits") == 0

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")

    out = each.groupBy("rule").agg(total(has).alias("n_failed"), total(only).alias("n_only"), total(clean).alias("n_kept"))
    return out.select(
        F.lit(version).alias("policy"), "rule", "n_failed", "n_only", "n_kept",
        (F.col("n_kept") + F.col("n_only")).alias("n_kept_without"),
    )


def keep_good(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of docs (with their own columns) that pass the policy; text never leaves its row."""
    names = [F.col(f"`{n}`") for n in docs.columns]
    whole = docs.select(F.struct(*names).alias("_row"), measures("text").alias("_m"))
    flat = whole.select("_row", *(F.col(f"_m.{m}").alias(m) for m in MEASURES))
    return flat.withColumn("failed_rules", failed_rules()).where(passes(version)).select("_row.*")


def sole_rule(version: str = CURRENT) -> Column:
    """The one rule of the policy that a document fails: without it the document would be kept. Null if it fails none or several."""
    held = F.col("failed_rules").bitwiseAND(F.lit(mask(POLICIES[version])))
    return F.coalesce(*(F.when(held == mask((rule,)), F.lit(rule)) for rule in POLICIES[version]))


def quality_digest(docs: DataFrame) -> DataFrame:
    """The ledger, stored once, with the verdict of the current policy and, for documents that one rule alone rejects, that rule
    and how many documents the policy would keep without it. The table of ablations has one row per rule and is broadcast."""
    book = stored(ledger(docs))
    base_failed = ~passes("base")
    figures = ablations(book).select(F.col("rule").alias("sole_rule"), "n_kept_without")
    return book.withColumn("sole_rule", sole_rule()).join(F.broadcast(figures), "sole_rule", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & passes(CURRENT)).alias("kept"), "failed_rules", "sole_rule", "n_kept_without",
    )
