"""HTML pages as columns: one parse per page in Arrow batches gives what is wanted of text, main text, tables, links and data images.

Everything that follows from these (table rows as maps, link rules, typing) is done by column expressions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lyceum.functions import fixed
from lyceum.functions import url as U
from lyceum.functions.rx import let
from lyceum.operators.markup import Node, Page, tree

BLOCKS = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "li"))
DROPPED = frozenset(("script", "style", "nav", "footer", "header"))
CELLS, ROWS, HEADS, HEADER_CELLS, DATA_CELLS = ("td", "th"), ("tr",), ("thead",), ("th",), ("td",)
#: Place of the content selectors, by id, class and name.
_PLACES = {
    sign: {s.lstrip("#."): k for k, s in reversed(list(enumerate(fixed.CONTENT_SELECTORS))) if (s[0] if s[0] in "#." else "") == sign}
    for sign in ("#", ".", "")
}

#: Characters of text that a page may have through elements that stand in each other: unclosed ones do, and their texts come again.
MAX_TEXT = 1 << 26


def texts(page: Page, elements: list[int], between: str = "") -> list[str]:
    """The text of each element; fails beyond MAX_TEXT characters in all."""
    out, total = [], 0
    for k in elements:
        out.append(page.text(k, between))
        total += len(out[-1])
        if total > MAX_TEXT:
            raise ValueError("the texts of nested elements are too large")
    return out


def block_text(page: Page, k: int) -> str:
    """Text of paragraphs, headings and list items by line (nested ones come again); else all strings by line."""
    return "\n".join(filter(None, texts(page, page.find(k, BLOCKS)))) or page.text(k, "\n")


def main_part(page: Page) -> int | None:
    """The first element of the first content selector that finds one, else the body."""
    found, place = None, len(fixed.CONTENT_SELECTORS)
    by_id, by_class, by_name = _PLACES["#"], _PLACES["."], _PLACES[""]
    for k, (name, attrs) in enumerate(zip(page.names, page.attrs, strict=True)):
        if name is None:
            continue
        here = by_name.get(name, place)
        if attrs:
            here = min(here, by_id.get(attrs.get("id"), place), *(by_class.get(c, place) for c in attrs.get("class", "").split()))
        if here < place:
            found, place = k, here
    return next(iter(page.find(0, ("body",))), None) if found is None else found


def table_cells(table: Node) -> tuple[list[str], list[list[str]]]:
    """Headers and rows of cells. Headers: the cells th of thead, else of the first row, else that row's td. With headers the
    first row is no data; rows without cells are left out."""
    page, find = table.page, table.page.find
    rows, heads = find(table.at, ROWS), find(table.at, HEADS)
    headers = texts(page, find(heads[0], HEADER_CELLS)) if heads else []
    if not headers and rows:
        headers = texts(page, find(rows[0], HEADER_CELLS) or find(rows[0], DATA_CELLS))
    cells = [texts(page, find(r, CELLS)) for r in rows[bool(headers) :]]
    return headers, [r for r in cells if r]


def is_data_image(image: Node, known: dict[int, bool]) -> bool:
    """No small image, and a word for charts or data in its description or in the text of up to three elements around it. known
    keeps what was found out about elements of this page."""
    page, attrs = image.page, image.attrs
    for side in ("width", "height"):
        digits = attrs.get(side, "").strip()
        if digits.isdecimal() and len(digits) < 10 and int(digits) < 200:
            return False
    for key in ("alt", "title", "class"):
        said = attrs.get(key, "").lower()
        if said and any(word in said for word in fixed.IMAGE_INDICATORS):
            return True
    node = page.parents[image.at]
    for _ in range(3):
        if node <= 0:
            break
        if node not in known:
            near = "".join(page.parts(node)).lower()
            known[node] = any(word in near for word in fixed.IMAGE_INDICATORS)
        if known[node]:
            return True
        node = page.parents[node]
    return False


#: error: what kept a page from being read, null if nothing did. odd: places of the markup that had to be guessed at.
FIELDS = ("text", "main_text", "plain", "tables", "table_html", "links", "images", "error", "odd")


def read_page(html: str | None, wanted: tuple[str, ...] = FIELDS) -> dict | None:
    """The wanted fields of a page; nothing is worked out for others. A page that can't be read has its error and empty fields."""
    if html is None:
        return None
    try:
        root, odd = tree(html)
        bare = root.page.without(DROPPED) if "text" in wanted or "main_text" in wanted else root.page
        own = {"error": None, "odd": odd}
        return {name: own[name] if name in own else _READERS[name](root, bare) for name in wanted}
    except (ValueError, MemoryError) as e:
        none = {"text": "", "main_text": "", "plain": "", "error": f"{type(e).__name__}: {e}", "odd": None}
        return {name: none.get(name, []) for name in wanted}


def _main_text(root: Node, bare: Page) -> str:
    part = main_part(bare)
    return bare.text(0, "\n") if part is None else block_text(bare, part)


def _tables(root: Node, bare: Page) -> list[dict]:
    tables = []
    for k, table in enumerate(root.find_all("table")):
        headers, rows = table_cells(table)
        tables.append({"table_index": k, "headers": headers, "raw_rows": rows, "text": table.text("\n")})
    return tables


def _table_html(root: Node, bare: Page) -> list[str]:
    out, total = [], 0
    for table in root.find_all("table"):
        out.append(table.html())
        total += len(out[-1])
        if total > MAX_TEXT:
            raise ValueError("nested tables are too large")
    return out


def _images(root: Node, bare: Page) -> list[str]:
    known: dict[int, bool] = {}
    return [i.attrs["src"] for i in root.find_all("img") if i.attrs.get("src") and is_data_image(i, known)]


_READERS = {
    "text": lambda root, bare: block_text(bare, 0),
    "main_text": _main_text,
    "plain": lambda root, bare: "".join(root.strings()),
    "tables": _tables,
    "links": lambda root, bare: [{"href": a.attrs["href"], "text": a.text()} for a in root.find_all("a") if a.attrs.get("href")],
    "table_html": _table_html,
    "images": _images,
}
_strings, _texts = pa.list_(pa.string()), T.ArrayType(T.StringType())
#: Field -> its Arrow type and its Spark type.
_TYPES = {
    "text": (pa.string(), T.StringType()),
    "main_text": (pa.string(), T.StringType()),
    "plain": (pa.string(), T.StringType()),
    "tables": (
        pa.list_(pa.struct([("table_index", pa.int32()), ("headers", _strings), ("raw_rows", pa.list_(_strings)), ("text", pa.string())])),
        T.ArrayType(T.StructType([
            T.StructField("table_index", T.IntegerType()), T.StructField("headers", _texts),
            T.StructField("raw_rows", T.ArrayType(_texts)), T.StructField("text", T.StringType()),
        ])),
    ),
    "links": (
        pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())])),
        T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())])),
    ),
    "table_html": (_strings, _texts),
    "images": (_strings, _texts),
    "error": (pa.string(), T.StringType()),
    "odd": (pa.int64(), T.LongType()),
}


def parsed(html: Column, *wanted: str) -> Column:
    """struct of the wanted fields of a page, all of FIELDS if none is named; null for null. Any string is read; the few that are too
    large in the end give a struct with their error, never a failed task."""
    names = wanted or FIELDS
    arrow = pa.struct([(n, _TYPES[n][0]) for n in names])

    def read(pages: pa.Array) -> pa.Array:
        return pa.array([read_page(h, names) for h in pages.to_pylist()], arrow)

    read.__annotations__ = {"pages": pa.Array, "return": pa.Array}
    return F.arrow_udf(read, T.StructType([T.StructField(n, _TYPES[n][1]) for n in names]))(html)


def parse_pages(pages: DataFrame, *wanted: str, html: str = "html", into: str = "page") -> DataFrame:
    """pages with the parsed struct, parsed once per row."""
    return pages.withColumn(into, parsed(F.col(html), *wanted))


def each_of(pages: DataFrame, items: Column | str, name: str, *kept: str | Column) -> DataFrame:
    """(kept, place, name): a row for each item of an array that comes from the parser. The outer form keeps the optimiser from
    asking for the array's size below, which would parse each page a second time."""
    each = pages.select(*kept, F.posexplode_outer(items).alias("place", name))
    return each.where(F.col("place").isNotNull())


def stripped_text(html: Column) -> Column:
    """Text between tags without parsing: scripts, styles and comments go with their content, other tags alone."""
    blocks = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
    return F.regexp_replace(F.regexp_replace(html, blocks, ""), "<[^>]*>", "")


def is_html(content: Column) -> Column:
    """Whether content counts as HTML; tags are looked for in lower case only."""
    return content.contains("<html") | content.contains("<body")


def data_tables(page: Column) -> Column:
    """Tables with rows: array<struct<table_index, headers, raw_rows, text>>; tables without any are left out."""
    return F.filter(page["tables"], lambda t: F.size(t["raw_rows"]) > 0)


def table_rows(table: Column) -> Column:
    """raw_rows as maps by header; surplus cells are column_<place>, of equal headers the last counts, missing cells have no
    entry. Without headers there are no maps."""

    def as_map(row: Column) -> Column:
        entries = F.transform(
            row,
            lambda v, i: F.struct(
                F.coalesce(F.get(table["headers"], i), F.concat(F.lit("column_"), (i + 1).cast("string"))).alias("k"), v.alias("v")
            ),
        )
        last = F.filter(
            entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"])
        )
        return F.map_from_entries(last)

    return F.when(F.size(table["headers"]) > 0, F.transform(table["raw_rows"], as_map)).otherwise(
        F.array().cast("array<map<string,string>>")
    )


def links(pages: DataFrame, key: str, base: str = "url", page: str = "page") -> DataFrame:
    """(key, place, text, url): all links but scripts and the bare #, resolved against the page."""
    each = each_of(pages, f"{page}.links", "link", key, base)
    kept = each.where(~F.col("link.href").startswith("javascript:") & (F.col("link.href") != "#"))
    return kept.select(key, "place", F.col("link.text").alias("text"), U.joined(F.col(base), F.col("link.href")).alias("url"))


def crawl_links(pages: DataFrame, key: str, base: str = "url", page: str = "page") -> DataFrame:
    """(key, place, url): links that can lead to pages: no scripts, no fragments of the page itself, no mail."""
    each = each_of(pages, f"{page}.links", "link", key, base)
    kept = each.where(~F.col("link.href").startswith("javascript:") & ~F.col("link.href").startswith("#"))
    resolved = kept.select(key, "place", U.joined(F.col(base), F.col("link.href")).alias("url"))
    return resolved.where(~F.col("url").startswith("mailto:"))


def file_links(pages: DataFrame, key: str, base: str = "url", page: str = "page") -> DataFrame:
    """(key, place, url, file_type, content_type) of links to files worth a download."""
    def typed(link: Column) -> Column:  # before they become rows, as a condition on rows would resolve each once more
        return let(U.joined(F.col(base), link["href"]), lambda u: F.struct(u.alias("url"), U.file_type(u).alias("file_type")))

    each = each_of(pages, F.transform(f"{page}.links", typed), "link", key).select(key, "place", "link.*")
    files = each.where(F.col("file_type").isin(fixed.FILE_TYPES))
    return files.withColumn("content_type", U.mime_type(F.col("file_type")))


def image_links(pages: DataFrame, key: str, base: str = "url", page: str = "page") -> DataFrame:
    """(key, place, url) of images that likely show data."""
    each = each_of(pages, f"{page}.images", "src", key, base)
    return each.select(key, "place", U.joined(F.col(base), F.col("src")).alias("url"))


def table_documents(pages: DataFrame, key: str, page: str = "page") -> DataFrame:
    """(key, table_index, text, headers, raw_rows, html): one row for each table of a page; nested ones are rows of their own and part
    of the tables around them."""
    both = F.arrays_zip(F.col(f"{page}.tables").alias("t"), F.col(f"{page}.table_html").alias("html"))
    return each_of(pages, both, "t", key).select(
        key, "t.t.table_index", "t.t.text", "t.t.headers", "t.t.raw_rows", "t.html"
    )


def page_errors(pages: DataFrame, key: str, page: str = "page") -> DataFrame:
    """(key, error, odd): the pages that could not be read, or only by guessing."""
    found = pages.select(key, F.col(f"{page}.error").alias("error"), F.col(f"{page}.odd").alias("odd"))
    return found.where(F.col("error").isNotNull() | (F.col("odd") > 0))
