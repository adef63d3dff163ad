"""Placement facts out of a page's text and tables, as nested columns; conventions as for admission facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lyceum.functions import fixed, rx
from lyceum.functions.admission import (
    any_header, cleaned_number, first_column, has_cell, last_column, last_entries, low_headers, number_or_text, rows_of,
)


def names_lakh(pattern: str) -> bool:
    """Judged by the pattern's own text, as the scaling rule has it."""
    return "lakh" in pattern.lower() or "lac" in pattern.lower()


def statistics(text: Column, tables: Column) -> Column:
    """struct of six doubles. Small summary tables fill what the text leaves open, unscaled; a missing percentage follows from
    the two counts if both are there and not 0."""
    summary = F.filter(
        tables, lambda t: any_header(t, fixed.STATISTIC_HEADERS) & (F.size(t["raw_rows"]) <= fixed.SUMMARY_ROWS)
    )
    lines = F.flatten(F.transform(summary, lambda t: F.transform(t["raw_rows"], lambda r: F.lower(F.array_join(r, " ")))))

    def in_text(pattern: str) -> Column:
        number = F.regexp_replace(rx.first(text, pattern), ",", "").cast("double")
        return number if names_lakh(pattern) else F.when(number < 100, number).otherwise(number / fixed.LAKH)

    def in_line(patterns: Sequence[str]) -> Column:
        found = F.transform(lines, lambda x: F.regexp_replace(rx.first_of(x, patterns), ",", "").cast("double"))
        return F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0))

    values = {name: F.coalesce(*map(in_text, ps), in_line(ps)) for name, ps in fixed.STATISTICS.items()}
    placed, total = values["students_placed_count"], values["total_students"]
    derived = F.when((placed != 0) & (total != 0), F.round(placed / total * 100, 2))
    values["placement_percentage"] = F.coalesce(values["placement_percentage"], derived)
    return F.struct(*(v.alias(n) for n, v in values.items()))


def listed(text: Column, sections: Sequence[str]) -> Column:
    """Names in the first match of each section pattern, split at separators, without noise."""

    def of(section: Column) -> Column:
        parts = F.transform(F.split(section, r"[,;/\n•]"), rx.stripped)
        return F.filter(parts, lambda p: is_name(p) & ~F.lower(p).isin(fixed.NOISE))

    found = [F.coalesce(of(rx.first(text, p)), F.array().cast("array<string>")) for p in sections]
    return F.concat(*found)


def is_name(text: Column) -> Column:
    return (F.length(text) > 2) & ~text.rlike(r"^\d+$")


def column_names(tables: Column, words: Sequence[str], only: Sequence[str] | None = None) -> Column:
    """Names in the first column whose header has one of the words, of tables with one of the `only` headers."""

    def columns(t: Column) -> Column:
        at = first_column(low_headers(t), lambda h: rx.contains_any(h, words))
        fits = at.isNotNull() if only is None else at.isNotNull() & any_header(t, only)
        return F.when(fits, F.struct(at.alias("at")))

    def of_row(row: Column, c: Column) -> Column:
        return F.when(has_cell(row, c["at"]), rx.stripped(F.get(row, c["at"])))

    return F.filter(rows_of(tables, columns, of_row), lambda x: x.isNotNull() & is_name(x))


def recruiters(text: Column, tables: Column) -> Column:
    """struct<top_companies, total_companies_visited>; names keep the order of their first mention."""
    names = F.concat(listed(text, fixed.COMPANY_SECTIONS), column_names(tables, fixed.COMPANY_HEADERS))
    return F.struct(
        F.array_distinct(names).alias("top_companies"),
        rx.first_of(text, fixed.COMPANY_TOTALS).cast("int").alias("total_companies_visited"),
    )


def history(tables: Column) -> Column:
    """struct<year_wise: map<year, struct<avg_package, placed>>>; of equal years the last row counts."""

    def columns(t: Column) -> Column:
        low = low_headers(t)
        is_year = lambda h: rx.contains_any(h, fixed.YEAR_HEADERS)
        is_package = lambda h: rx.contains_any(h, fixed.PACKAGE_HEADERS)
        year = last_column(low, is_year)
        package = last_column(low, lambda h: is_package(h) & ~is_year(h))
        percentage = last_column(low, lambda h: rx.contains_any(h, fixed.PERCENTAGE_HEADERS) & ~is_year(h) & ~is_package(h))
        fits = year.isNotNull() & any_header(t, fixed.YEAR_STATISTIC_HEADERS)
        return F.when(fits, F.struct(year.alias("year"), package.alias("package"), percentage.alias("percentage")))

    def of_row(row: Column, c: Column) -> Column:
        cell = F.when(has_cell(row, c["year"]), rx.stripped(F.get(row, c["year"])))
        year = F.coalesce(*(rx.first(cell, p) for p in fixed.YEARS))
        digits = lambda x: F.regexp_replace(x, r"[^\d.]", "")
        pay = F.when(has_cell(row, c["package"]), F.get(row, c["package"]))
        share = F.when(has_cell(row, c["percentage"]), F.get(row, c["percentage"]))
        package = F.when(digits(pay) != "", cleaned_number(pay))
        number = rx.as_double(digits(share))
        placed = F.when(digits(share) != "", F.coalesce(F.concat(number.cast("string"), F.lit("%")), share))
        known = year.isNotNull() & (package.isNotNull() | placed.isNotNull())
        return F.when(
            known, F.struct(year.alias("k"), F.struct(package.alias("avg_package"), placed.alias("placed")).alias("v"))
        )

    entries = F.filter(rows_of(tables, columns, of_row), lambda x: x.isNotNull())
    return F.struct(F.map_from_entries(last_entries(entries)).alias("year_wise"))


def percent_or_count(text: Column, patterns: Sequence[str]) -> Column:
    return F.coalesce(*(rx.first(text, p).cast("double") for p in patterns))


def path_cells(words: Sequence[str], earlier: Sequence[str]):
    """table -> the cells of a path's columns, each from the first row that is long enough."""

    def fits(h: Column) -> Column:
        return rx.contains_any(h, words) & ~rx.contains_any(h, earlier)

    def cells(t: Column) -> Column:
        found = F.transform(low_headers(t), lambda h, i: F.when(fits(h), i))
        places = F.filter(found, lambda i: i.isNotNull())
        each = F.transform(places, lambda i: F.get(F.get(F.filter(t["raw_rows"], lambda r: F.size(r) > i), F.lit(0)), i))
        return F.when(any_header(t, fixed.ALTERNATIVE_TABLE_HEADERS), each).otherwise(F.array().cast("array<string>"))

    return cells


def alternative_paths(text: Column, tables: Column) -> Column:
    """struct of number-or-text for three paths. Tables fill what the text leaves open: the first column of a path with a
    number in its first full row decides."""
    out, earlier = [], []
    for name, patterns in fixed.ALTERNATIVE_PATHS.items():
        words = fixed.ALTERNATIVE_HEADERS[name]
        found = F.flatten(F.transform(tables, path_cells(words, list(earlier))))
        cell = F.get(F.filter(found, lambda x: F.regexp_replace(x, "[^0-9.]", "") != ""), F.lit(0))
        stated = percent_or_count(text, patterns)
        told = F.when(stated.isNotNull(), number_or_text(stated, F.lit(None).cast("string")))
        out.append(told.when(cell.isNotNull(), cleaned_number(cell)).alias(name))
        earlier += words
    return F.struct(*out)


def internships(text: Column, tables: Column) -> Column:
    """struct<count, companies, percentage>."""
    names = F.concat(
        listed(text, fixed.INTERNSHIP_SECTIONS),
        column_names(tables, fixed.INTERNSHIP_COMPANY_HEADERS, only=fixed.INTERNSHIP_HEADERS),
    )
    return F.struct(
        rx.first_of(text, fixed.INTERNSHIP_COUNTS).cast("int").alias("count"),
        F.array_distinct(names).alias("companies"),
        rx.first_of(text, fixed.INTERNSHIP_PERCENTAGES).cast("double").alias("percentage"),
    )


def recruitment_types(text: Column) -> Column:
    """struct of three doubles: percentages or counts."""
    return F.struct(
        *(percent_or_count(text, [p % word for p in fixed.RECRUITMENT_TYPES]).alias(n) for n, word in fixed.RECRUITMENT_KINDS.items())
    )


def placement_data(text: Column, tables: Column) -> Column:
    return F.struct(
        statistics(text, tables).alias("statistics"),
        recruiters(text, tables).alias("recruiters"),
        history(tables).alias("historical_data"),
        alternative_paths(text, tables).alias("alternative_paths"),
        internships(text, tables).alias("internships"),
        recruitment_types(text).alias("recruitment_types"),
    )
