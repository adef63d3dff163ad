"""Texts against a table of keywords, where the list is data and not part of the query: one automaton over a bounded part of the list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of keywords that one automaton takes (it needs some 100 times as much memory); a longer list takes several passes.
LIST_BYTES = 1 << 20


def automata(words: DataFrame, list_bytes: int = LIST_BYTES) -> list[list[str]]:
    """The different, non-empty keywords (column word) in lists of about list_bytes at most, by a hash of the word."""
    words = words.select("word").where(F.col("word") != "").distinct()
    total = words.agg(F.coalesce(F.sum(F.octet_length("word") + F.lit(1)), F.lit(0))).first()[0]
    rounds = -(-total // list_bytes)
    part = F.pmod(F.xxhash64("word"), F.lit(max(1, rounds)))
    lists = ([r["word"] for r in words.where(part == k).collect()] for k in range(rounds))
    return [some for some in lists if some]


def keyword_hits(texts: DataFrame, key: str, text: str, words: DataFrame, list_bytes: int = LIST_BYTES) -> DataFrame:
    """(key, word): which texts contain which keywords, each once. Case counts. Texts stay where they are; each list of keywords
    is a pass over them, and only hits are moved on."""
    kind = texts.schema[key].dataType.simpleString()
    texts = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    found = None
    for some in automata(words, list_bytes):
        hits = _pass(texts, some, kind)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = texts.select("key", F.lit("").alias("word")).limit(0)
    return found.withColumnRenamed("key", key)


def _pass(texts: DataFrame, words: list[str], kind: str) -> DataFrame:
    held = texts.sparkSession.sparkContext.broadcast(words)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in held.value:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for batch in batches:
            places, words = [], []
            for k, text in enumerate(batch.column("text")):
                found = {word for _, word in automaton.iter(text.as_py())}
                places += [k] * len(found)
                words += sorted(found)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(places, pa.int64())), pa.array(words, pa.string())], ["key", "word"])

    return texts.mapInArrow(search, f"key {kind}, word string")
