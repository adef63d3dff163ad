"""Tables and paragraphs from positioned text: lines of spans (text, x, y, font, size, flags), as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lyceum.functions import rx

HEADER_FLAG, NEAR, ALIKE, LOOKED_AT, FONT_STEP = 2, 5.0, 0.7, 5, 1.0


def text_blocks(blocks: Column) -> Column:
    """The lines of each text block of a dump (type 0), their spans with x and y of their own."""

    def span(s: Column) -> Column:
        x, y = (F.get(s["origin"], F.lit(k)).alias(name) for k, name in enumerate("xy"))
        return F.struct(s["text"].alias("text"), x, y, s["font"].alias("font"), s["size"].alias("size"), s["flags"].alias("flags"))

    def line(one: Column) -> Column:
        return F.struct(F.transform(F.coalesce(one["spans"], F.array()), span).alias("spans"))

    return F.transform(F.filter(blocks, lambda b: b["type"] == 0), lambda b: F.transform(F.coalesce(b["lines"], F.array()), line))


def tables_of(blocks: Column) -> Column:
    """The tables among blocks (lines of each), as structs of as_table; blocks that are none are left out."""
    return F.filter(F.transform(F.filter(blocks, lambda b: F.coalesce(is_table(b), F.lit(False))), as_table), lambda t: t.isNotNull())


def is_table(lines: Column) -> Column:
    """Whether lines look like a table: of the first five all have equally many spans, more than one, or some later line has
    most starts near those of the first. False below two lines; null if the first line is empty and counts differ."""

    def of(starts: Column) -> Column:
        counts = F.array_distinct(F.transform(starts, lambda x: F.size(x)))
        first = F.get(starts, F.lit(0))

        def aligned(other: Column) -> Column:
            near = F.zip_with(first, other, lambda a, b: F.coalesce(F.abs(a - b) < NEAR, F.lit(False)))
            return F.size(F.filter(near, lambda x: x)) >= F.lit(ALIKE) * F.size(first)

        later = F.exists(F.slice(starts, 2, LOOKED_AT), aligned)

        def told(regular: Column) -> Column:
            return F.when(~((F.size(first) == 0) & ~regular), regular | later)

        return rx.let(counts, lambda c: told((F.size(c) == 1) & (F.get(c, F.lit(0)) > 1)))

    def seen(lines: Column) -> Column:
        starts = F.transform(F.slice(lines, 1, LOOKED_AT), lambda line: F.transform(line["spans"], lambda s: s["x"]))
        return F.when(F.size(lines) < 2, F.lit(False)).otherwise(rx.let(starts, of))

    return rx.let(lines, seen)


def as_table(lines: Column) -> Column:
    """struct<headers, rows, raw_text>: the first line is the header if one of its spans has the header flag or its mean font
    size differs from the second line's by more than a point; else headers are blank. Blank rows are left out of rows."""

    def mean(line: Column) -> Column:
        total = F.aggregate(line["spans"], F.lit(0.0), lambda n, s: n + s["size"].cast("double"))
        return total / F.size(line["spans"])

    def headed(full: Column) -> Column:
        first, second = F.get(full, F.lit(0)), F.get(full, F.lit(1))
        flagged = F.exists(first["spans"], lambda s: s["flags"].bitwiseAND(F.lit(HEADER_FLAG)) > 0)
        return (F.size(full) > 1) & (flagged | (F.abs(mean(first) - mean(second)) > FONT_STEP))

    def read(table: Column) -> Column:
        cells, head = table["cells"], F.get(table["cells"], F.lit(0))
        headers = F.when(table["headed"], head).otherwise(F.transform(head, lambda _: F.lit("")))
        body = F.when(table["headed"], F.slice(cells, F.lit(2), F.size(cells))).otherwise(cells)
        rows = F.filter(body, lambda row: F.exists(row, lambda c: c != ""))
        text = F.array_join(F.transform(cells, lambda row: F.array_join(row, " | ")), "\n")
        return F.struct(headers.alias("headers"), rows.alias("rows"), text.alias("raw_text"))

    def of(full: Column) -> Column:
        cells = F.transform(full, lambda line: F.transform(line["spans"], lambda s: rx.stripped(s["text"])))
        return F.when(F.size(full) > 0, rx.let(F.struct(cells.alias("cells"), headed(full).alias("headed")), read))

    return rx.let(F.filter(lines, lambda line: F.size(line["spans"]) > 0), of)


def formatted(blocks: Column) -> Column:
    """Text of blocks (array of lines each): a block's lines joined by spaces; list items end with one line break, other blocks
    with two."""

    def of(lines: Column) -> Column:
        texts = F.transform(lines, lambda line: F.array_join(F.transform(line["spans"], lambda s: s["text"]), ""))
        joined = rx.stripped(F.array_join(F.filter(texts, lambda t: rx.stripped(t) != ""), " "))
        item = joined.startswith("•") | joined.startswith("-") | joined.rlike(r"^\d+\.")
        return F.when(joined == "", "").otherwise(F.concat(joined, F.when(item, "\n").otherwise("\n\n")))

    return F.array_join(F.transform(blocks, of), "")
