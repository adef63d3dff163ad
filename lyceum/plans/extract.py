"""From fetched pages to stored facts: raw documents, processing of what is not processed yet, inspection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyceum import schemas
from lyceum.functions import admission, classify, fixed, placement
from lyceum.operators import html as H
from lyceum.operators import store

Hook = Callable[[Column], Column]


def raw_pages(pages: DataFrame, college: Column, at: Column, session: str, hook: Hook | None = None) -> DataFrame:
    """Raw documents of fetched pages (page_id, url, html): main text, type by rules or by the hook's verdict, and the parsed
    page beside them for further use."""
    parsed = H.parse_pages(pages)
    kind = classify.page_type(F.col("page.plain"), hook(F.col("page.plain")) if hook else None)
    meta = F.struct(
        F.lit(200).alias("http_status"), F.lit(session).alias("crawler_session"), F.lit(0).alias("depth"),
        F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("int").alias("table_index"),
        F.lit(None).cast("bigint").alias("content_length"), F.lit(None).cast("string").alias("file_extension"),
    )
    return parsed.select(
        F.col("page_id").cast("string").alias("raw_id"), college.alias("college_name"), "url", kind.alias("page_type"),
        F.lit("text/html").alias("content_type"), F.col("page.main_text").alias("raw_content"),
        F.col("html").alias("raw_html"), at.alias("extraction_date"), meta.alias("metadata"), "page",
    )


def facts(raw: DataFrame, college: str, at: Column, enhancer: Hook | None = None) -> tuple[DataFrame, DataFrame]:
    """(admission, placement): processed documents of raw ones (raw_id, page_type, raw_content). The rules see the stored text;
    tables count only where the stored content is HTML itself."""
    text, tables = content_parts(F.col("raw_content"), raw)
    base = raw.withColumn("_text", text).withColumn("_tables", tables)

    def of(kind: str, data: Column) -> DataFrame:
        rows = base.where(F.col("page_type") == kind)
        return rows.select(
            F.col("raw_id").alias("raw_data_id"), college, at.alias("last_updated"), at.alias("processing_date"),
            F.lit(fixed.CONFIDENCE).alias("confidence_score"), data.alias(f"{kind}_data"),
        )

    a = admission.admission_data(F.col("_text"), F.col("_tables"))
    p = placement.placement_data(F.col("_text"), F.col("_tables"))
    return of("admission", enhancer(a) if enhancer else a), of("placement", enhancer(p) if enhancer else p)


def content_parts(content: Column, df: DataFrame) -> tuple[Column, Column]:
    """Text and tables of a content: parsed where it is HTML, else the text as it is and no tables."""
    page = H.parsed(F.when(H.is_html(content), content), "text", "tables")
    none = F.array().cast(schemas.NO_TABLES)
    tables = F.when(H.is_html(content), H.data_tables(page)).otherwise(none)
    return F.when(H.is_html(content), page["text"]).otherwise(content), tables


def process(raw: DataFrame, processed: DataFrame, at: Column, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Facts of the raw documents that no processed one names, of one college if a name is given (exactly as written)."""
    chosen = raw if name is None else raw.where(F.col("college_name") == name)
    return facts(store.unprocessed(chosen, processed), "college_name", at)


def embedded(raw: DataFrame) -> DataFrame:
    """Raw documents of the tables in raw pages (with their parsed page), each with its own markup and naming its page as parent."""
    both = F.arrays_zip(F.col("page.tables").alias("t"), F.col("page.table_html").alias("html"))
    tables = H.each_of(raw, both, "t", "raw_id", "college_name", "url", "extraction_date")
    return tables.select(
        F.concat_ws("-", "raw_id", F.col("t.t.table_index").cast("string")).alias("raw_id"), "college_name", "url",
        F.lit("table").alias("page_type"), F.col("t.t.text").alias("raw_content"), F.col("t.html").alias("raw_html"), "extraction_date",
        F.col("raw_id").alias("parent_id"), F.col("t.t.table_index").alias("table_index"),
    )


def inspect(processed: DataFrame, field: str, n: int = 5, *order: str) -> DataFrame:
    """The first n processed documents that have the field."""
    return store.head(processed.where(F.col(field).isNotNull()), n, *(order or ("raw_data_id",)))
