"""Canonical exact digests: NFKC, case and white-space folding, then 128-bit xxhash; bytes decide inside equal buckets."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyceum.llm.shared import arrow_batches, heavy_join, narrow, place_among, stored, text_or_empty

FIRST_ID = -(1 << 63)


def canonical(text: str) -> bytes:
    """The folded form that equal documents share."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.casefold()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(folded: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(folded)


def likeness(a: tuple[str, bytes], b: tuple[str, bytes]) -> float:
    """1 if two (digest, folded form) are the same document, else 0; the bytes are compared where digests are equal."""
    return 1.0 if a[0] == b[0] and a[1] == b[1] else 0.0


def with_canonical(docs: DataFrame, folded: bool = True) -> DataFrame:
    """(doc_id, fingerprint, and if wanted the folded form) for each row of docs; a null text counts as empty."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            forms = [canonical(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), pa.array(list(map(digest, forms)), pa.string()), pa.array(forms, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns[: 2 + folded], ["doc_id", "fingerprint", "folded"][: 2 + folded])

    slim = narrow(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    return slim.mapInArrow(fold, "doc_id long, fingerprint string" + ", folded binary" * folded)


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, group_id, n_docs): documents of one canonical form, group_id being their smallest doc_id. A null
    doc_id never names a group of others."""
    return with_groups(stored(with_canonical(docs)))


def with_groups(rows: DataFrame) -> DataFrame:
    """rows (doc_id, fingerprint, folded, ...) with group_id and n_docs in place of folded, which is null in rows whose fingerprint
    no other has: these are groups of their own. rows are read several times and should be stored.

    Copies are combined before the shuffle, and grouping by (fingerprint, folded bytes) compares the bytes inside an equal
    bucket, so a collision of digests gives two groups. Rows are joined with their group by the fingerprint where its bucket
    has one form, and by the bytes where it has several.
    """
    alone = rows.where(F.col("folded").isNull()).withColumn("group_id", F.col("doc_id")).withColumn("n_docs", F.lit(1).cast("long"))
    several = rows.where(F.col("folded").isNotNull())
    forms = stored(several.groupBy("fingerprint", "folded").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n_docs")))
    buckets = stored(
        forms.groupBy("fingerprint").agg(
            F.count("*").alias("n_forms"), F.min("group_id").alias("group_id"), F.sum("n_docs").alias("n_docs"), F.sum("n_docs").alias("weight")
        )
    )
    grouped = heavy_join(several, buckets, ["fingerprint"], "weight", "inner")
    same = grouped.where(F.col("n_forms") == 1)
    clash = grouped.where(F.col("n_forms") > 1).drop("group_id", "n_docs").join(forms, ["fingerprint", "folded"])
    names = [*(c for c in rows.columns if c != "folded"), "group_id", "n_docs"]
    return alone.select(*names).unionByName(same.select(*names)).unionByName(clash.select(*names))


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id): documents whose fingerprint another row has too; nothing but ids and digests is moved."""
    marks = stored(with_canonical(docs, folded=False))
    buckets = marks.groupBy("fingerprint").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return heavy_join(marks, stored(buckets), ["fingerprint"], "n", "inner").select("doc_id").distinct()


def next_text_ranges(docs: DataFrame) -> tuple[list[int], list[tuple[int, int]]]:
    """Bounds that cut doc_id into about as many ranges as there are shuffle partitions, and for each range with rows
    (range, its smallest id). Both are bounded by the number of partitions."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.coalesce("doc_id", F.lit(FIRST_ID)).alias("_id"))
    cuts = [k / n for k in range(1, n)]
    found = ids.agg(F.percentile_approx("_id", cuts, 20 * n)).first()[0] if cuts else []
    bounds = sorted(set(found or []))
    heads = ids.groupBy(place_among(F.col("_id"), bounds).alias("range")).agg(F.min("_id").alias("head"))
    return bounds, sorted((r["range"], r["head"]) for r in heads.collect())


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text of docs (doc_id, text) and of its edited text.

    Edited: the last n_chars div 4 code points give way to the first as many (or all) of the next document in ascending
    doc_id; after the last comes the first. Null texts are empty, a null doc_id stands before all others, rows of one
    doc_id follow one another by text. One row per row of docs; an empty table gives an empty result. group_id and n_docs are
    the smallest doc_id and the number of all documents with the same canonical form, as in exact_groups.

    Texts are shuffled once, by ranges of doc_id; the first document of a range is sent to the range before it as well. Beside
    them go the ids of documents with copies, for only their folded forms are grouped by their bytes afterwards.
    """
    slim = narrow(docs, "doc_id", "text")
    bounds, heads = next_text_ranges(slim)
    # The range that also needs the head of a range: the one before it, and the last for the first.
    back = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    order = F.coalesce("doc_id", F.lit(FIRST_ID))
    own = place_among(F.col("_order"), bounds)
    names = sorted(back)
    at = place_among(F.col("_order"), names)
    before = F.when(
        F.get(F.lit(names or [0]).cast("array<long>"), at) == F.col("_order"),
        F.get(F.lit([back[h] for h in names] or [0]).cast("array<int>"), at),
    )
    homes = F.array_compact(
        F.array(
            F.struct(own.alias("range"), F.lit(False).alias("copy")),
            F.when(before.isNotNull(), F.struct(before.alias("range"), F.lit(True).alias("copy"))),
        )
    )
    marks = copies(slim).select("doc_id", F.lit(None).cast("string").alias("text"), order.alias("_order"))
    both = slim.select("doc_id", text_or_empty().alias("text"), order.alias("_order")).unionByName(marks)
    dealt = both.select(
        "doc_id", "text", "_order", F.explode(homes).alias("h")
    )
    parted = (
        dealt.select("doc_id", "text", "_order", "h.range", "h.copy")
        .repartitionById(len(bounds) + 1, F.col("range"))
        .sortWithinPartitions("range", "copy", "_order", "text")
    )
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, folded binary"
    )
    edited = parted.select("doc_id", "text", "range", "copy").mapInArrow(_edited, schema)
    return with_groups(stored(edited))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each held until its successor in the same range is there; copies are successors only. A row without a text
    says that the documents of its id, which follow, have copies."""
    held, several = None, None
    for batch in arrow_batches(batches):
        out = []
        for doc_id, text, part, copy in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if text is None:
                several = (doc_id, part)
                continue
            folded = canonical(text)
            mark = (digest(folded), folded)
            if held and held[2] == part:
                out.append(_row(*held[:2], held[3], text, mark, held[4]))
            held = None if copy else (doc_id, text, part, mark, several == (doc_id, part))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES
            )


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "folded"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.binary()]


def _row(doc_id, text: str, mark, after: str, after_mark, several: bool) -> tuple:
    n = len(text) // 4
    edited = text[: len(text) - n] + after[:n]
    folded = canonical(edited)
    edited_mark = (digest(folded), folded)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    near = likeness(mark, edited_mark), likeness(mark, after_mark)
    return (doc_id, len(text), sha, mark[0], edited_mark[0], *near, mark[1] if several else None)
