"""Calls to a caller's model as an operator over batches of rows: bounded retries, and null where it does not answer.

The verdicts have the form that the rules take (`classify.verdict`, `extract.raw_pages`): a null one falls back to the rule.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VERDICT = T.StructType([T.StructField("class", T.StringType()), T.StructField("confidence", T.DoubleType())])
_ARROW = pa.struct([("class", pa.string()), ("confidence", pa.float64())])

#: Texts -> for each a (class, confidence), or None.
Ask = Callable[[Sequence[str]], Sequence[tuple[str, float] | None]]


def answers(ask: Ask, texts: Sequence[str], tries: int, wait: float) -> list[tuple[str, float] | None]:
    """ask(texts), again after any error with twice the wait, `tries` times in all; then no verdicts."""
    for k in range(tries):
        try:
            found = list(ask(texts))
            if len(found) != len(texts):
                raise ValueError("a verdict for each text is needed")
            return found
        except Exception:  # whatever a foreign model raises: the rules take its place
            if k + 1 < tries:
                time.sleep(wait * 2**k)
    return [None] * len(texts)


def asked(df: DataFrame, text: str, ask: Ask, into: str = "verdict", batch: int = 32, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """df with a struct<class, confidence> from ask, called with up to `batch` texts at once. Null texts are not asked about. A task
    that is run again asks again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                some = rows.slice(at, batch)
                texts = some.column(text).to_pylist()
                known = [t for t in texts if t is not None]
                found = iter(answers(ask, known, tries, wait) if known else [])
                verdicts = [None if t is None else next(found) for t in texts]
                column = pa.array([None if v is None else {"class": v[0], "confidence": float(v[1])} for v in verdicts], _ARROW)
                yield pa.RecordBatch.from_arrays([*some.columns, column], [*some.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, VERDICT)]))
