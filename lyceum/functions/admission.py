"""Admission facts out of a page's text and tables, as nested columns.

Tables are array<struct<headers, raw_rows, ...>>; headers are tested in lower case for the words they contain, and of several
columns that fit the last one counts. Text rules take the first match of the first pattern that has one.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lyceum.functions import fixed, rx
from lyceum.functions.text import dates

NUM_OR_STR = "struct<num:double,raw:string>"
NO_ENTRIES = f"array<struct<k:string,v:{NUM_OR_STR}>>"


def low_headers(table: Column) -> Column:
    return F.transform(table["headers"], lambda h: F.lower(h))


def last_column(headers: Column, fits) -> Column:
    """Place of the last header that fits, null without one."""
    places = F.filter(F.transform(headers, lambda h, i: F.when(fits(h), i)), lambda i: i.isNotNull())
    return F.array_max(places)


def first_column(headers: Column, fits) -> Column:
    places = F.filter(F.transform(headers, lambda h, i: F.when(fits(h), i)), lambda i: i.isNotNull())
    return F.array_min(places)


def any_header(table: Column, words: Sequence[str]) -> Column:
    return F.exists(low_headers(table), lambda h: rx.contains_any(h, words))


def bound(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def has_cell(row: Column, at: Column) -> Column:
    return at.isNotNull() & (F.size(row) > at)


def number_or_text(number: Column, raw: Column) -> Column:
    return F.struct(number.alias("num"), F.when(number.isNull(), raw).alias("raw"))


def last_entries(entries: Column) -> Column:
    """Entries (k, v) without those whose key comes again later; a key keeps its first place."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.transform(
        keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"].alias("v"))
    )


def rows_of(tables: Column, wanted, of_row) -> Column:
    """of_row(row, columns) over all rows of the tables for which `wanted(table)` gives a struct of columns, in order."""
    each = F.transform(
        tables, lambda t: bound(wanted(t), lambda c: F.when(c.isNotNull(), F.transform(t["raw_rows"], lambda r: of_row(r, c))))
    )
    return F.flatten(F.filter(each, lambda x: x.isNotNull()))


def deadline_type(text: Column) -> Column:
    low, out = F.lower(text), F.lit("other")
    for name, words in reversed(list(fixed.DEADLINE_TYPES.items())):
        out = F.when(rx.contains_any(low, words), name).otherwise(out)
    return out


def deadlines(text: Column, tables: Column) -> Column:
    """array<struct<date_str, context, event_type>>: dates near a deadline phrase, then rows of date tables."""
    near = F.filter(dates(text), lambda d: rx.contains_any(F.lower(d["context"]), fixed.DEADLINE_PHRASES))
    in_text = F.transform(
        near,
        lambda d: F.struct(d["date_str"].alias("date_str"), d["context"].alias("context"), deadline_type(d["context"]).alias("event_type")),
    )

    def columns(t: Column) -> Column:
        at = last_column(low_headers(t), lambda h: h.contains("date"))
        event = last_column(low_headers(t), lambda h: rx.contains_any(h, fixed.EVENT_HEADERS))
        return F.when(at.isNotNull(), F.struct(at.alias("date"), event.alias("event")))

    def of_row(row: Column, c: Column) -> Column:
        kind = F.when(has_cell(row, c["event"]), deadline_type(F.get(row, c["event"]))).otherwise("application")
        found = F.struct(
            F.get(row, c["date"]).alias("date_str"), F.array_join(row, " - ").alias("context"), kind.alias("event_type")
        )
        return F.when(has_cell(row, c["date"]), found)

    in_tables = F.filter(rows_of(tables, columns, of_row), lambda x: x.isNotNull())
    return F.concat(in_text, in_tables)


def courses(text: Column, tables: Column) -> Column:
    """array<struct<name, duration, seats, fee>> from tables; from the lists after a course phrase if tables give none."""

    def columns(t: Column) -> Column:
        kinds = [
            ("course", fixed.COURSE_HEADERS), ("duration", fixed.DURATION_HEADERS), ("seats", fixed.COURSE_SEAT_HEADERS),
            ("fee", fixed.COURSE_FEE_HEADERS),
        ]
        at: dict[str, Column] = {}
        for name, words in kinds:
            earlier = [w for _, ws in kinds[: len(at)] for w in ws]
            at[name] = last_column(
                low_headers(t), lambda h, words=words, earlier=earlier: rx.contains_any(h, words) & ~rx.contains_any(h, earlier)
            )
        has = any_header(t, fixed.COURSE_TABLE_HEADERS) & at["course"].isNotNull()
        return F.when(has, F.struct(*(at[n].alias(n) for n in at)))

    def of_row(row: Column, c: Column) -> Column:
        cell = lambda n: F.when(has_cell(row, c[n]), F.get(row, c[n])).alias(n)
        named = has_cell(row, c["course"]) & (F.get(row, c["course"]) != "")
        return F.when(named, F.struct(F.get(row, c["course"]).alias("name"), cell("duration"), cell("seats"), cell("fee")))

    in_tables = F.filter(rows_of(tables, columns, of_row), lambda x: x.isNotNull())
    sections = F.concat(
        *(rx.every(text, rf"(?:{p})[:\s]+((?:.+?(?:\n|$)){{1,10}})", 1) for p in fixed.COURSE_PHRASES)
    )
    parts = F.flatten(F.transform(sections, lambda s: F.transform(F.split(s, r"[,;\n•\-]"), rx.stripped)))
    named = F.filter(parts, lambda p: (F.length(p) > 3) & ~p.rlike(r"^\d+$"))
    none = F.lit(None).cast("string")
    in_text = F.transform(
        named, lambda p: F.struct(p.alias("name"), none.alias("duration"), none.alias("seats"), none.alias("fee"))
    )
    return F.when(F.size(in_tables) > 0, in_tables).otherwise(in_text)


def seats(text: Column, tables: Column) -> Column:
    """struct<total, category_wise: map>: counts that are no whole numbers stay text; without a stated total the numeric ones
    are added up."""
    stated = rx.first_of(text, fixed.SEAT_TOTALS).cast("long")

    def columns(t: Column) -> Column:
        low = low_headers(t)
        category = last_column(low, lambda h: rx.contains_any(h, fixed.CATEGORY_HEADERS))
        count = last_column(low, lambda h: rx.contains_any(h, fixed.SEAT_HEADERS) & ~rx.contains_any(h, fixed.CATEGORY_HEADERS))
        both = category.isNotNull() & count.isNotNull()
        return F.when(both, F.struct(category.alias("category"), count.alias("count")))

    def of_row(row: Column, c: Column) -> Column:
        cell = F.get(row, c["count"])
        number = F.when(rx.stripped(cell).rlike(r"^[+-]?\d+$"), rx.stripped(cell).cast("double"))
        inside = F.size(row) > F.greatest(c["category"], c["count"])
        return F.when(inside, F.struct(F.get(row, c["category"]).alias("k"), number_or_text(number, cell).alias("v")))

    entries = last_entries(F.filter(rows_of(tables, columns, of_row), lambda x: x.isNotNull()))
    numeric = F.filter(entries, lambda e: e["v"]["num"].isNotNull())
    added = F.aggregate(numeric, F.lit(0).cast("long"), lambda s, e: s + e["v"]["num"].cast("long"))
    total = F.coalesce(stated, F.when(F.size(numeric) > 0, added))
    return F.struct(total.alias("total"), F.map_from_entries(entries).alias("category_wise"))


def cleaned_number(cell: Column) -> Column:
    """The digits and dots of a cell as a number, the cell itself where they make none."""
    return number_or_text(rx.as_double(F.regexp_replace(cell, r"[^\d.]", "")), cell)


def fees(text: Column, tables: Column) -> Column:
    """struct<course_wise: map, payment_schedule, hostel_fee, first_year, general_fee>; of equal keys the last counts."""

    def columns(t: Column) -> Column:
        low = low_headers(t)
        course = last_column(low, lambda h: rx.contains_any(h, fixed.FEE_COURSE_HEADERS))
        fee = last_column(low, lambda h: rx.contains_any(h, fixed.FEE_HEADERS) & ~rx.contains_any(h, fixed.FEE_COURSE_HEADERS))
        return F.when(fee.isNotNull(), F.struct(course.alias("course"), fee.alias("fee")))

    def of_row(row: Column, c: Column) -> Column:
        whole = F.lower(F.array_join(row, " "))
        kind = (
            F.when(has_cell(row, c["course"]), "course")
            .when(whole.contains("hostel"), "hostel_fee")
            .when(whole.contains("first") | whole.contains("1st"), "first_year")
            .otherwise("general_fee")
        )
        name = F.when(has_cell(row, c["course"]), F.get(row, c["course"]))
        found = F.struct(kind.alias("kind"), name.alias("k"), cleaned_number(F.get(row, c["fee"])).alias("v"))
        return F.when(has_cell(row, c["fee"]), found)

    found = F.filter(rows_of(tables, columns, of_row), lambda x: x.isNotNull())

    def one(kind: str) -> Column:
        return F.try_element_at(F.filter(found, lambda x: x["kind"] == kind), F.lit(-1))["v"].alias(kind)

    by_course = F.transform(F.filter(found, lambda x: x["kind"] == "course"), lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v")))
    return F.struct(
        F.map_from_entries(last_entries(by_course)).alias("course_wise"),
        rx.stripped(rx.first_of(text, fixed.SCHEDULES)).alias("payment_schedule"),
        one("hostel_fee"), one("first_year"), one("general_fee"),
    )


def hostel(text: Column) -> Column:
    """struct<boys_hostel, girls_hostel, hostel_fee>: a stated availability, else true where the hostel is mentioned at all."""

    def of(whom: str) -> Column:
        stated = rx.first_of(text, [p % whom for p in fixed.HOSTELS])
        mentioned = F.when(text.rlike(rx.flagged(rf"{whom}\s+hostel")), F.lit(True))
        return F.coalesce(F.lower(stated).isin("available", "separate", "dedicated"), mentioned)

    fee = F.regexp_replace(rx.first_of(text, fixed.HOSTEL_FEES), ",", "").cast("double")
    return F.struct(of("boys").alias("boys_hostel"), of("girls").alias("girls_hostel"), fee.alias("hostel_fee"))


def eligibility(text: Column) -> Column:
    """struct<academic_requirements, entrance_exams, cutoff_scores: map>."""
    exams, scores = [], []
    for exam in fixed.EXAMS:
        named = re.escape(exam)
        mentioned = text.rlike(rx.flagged(rf"\b{named}\b"))
        score = rx.first_of(text, [p % named for p in fixed.CUTOFFS]).cast("double")
        exams.append(F.when(mentioned, F.lit(exam)))
        scores.append(F.when(mentioned & score.isNotNull(), F.struct(F.lit(exam).alias("k"), score.alias("v"))))
    least = rx.first_of(text, fixed.MINIMUM_PERCENTAGES).cast("double")
    scores.append(F.when(least.isNotNull(), F.struct(F.lit(fixed.PERCENTAGE_KEY).alias("k"), least.alias("v"))))
    return F.struct(
        rx.stripped(rx.first_of(text, fixed.REQUIREMENTS)).alias("academic_requirements"),
        F.array_compact(F.array(*exams)).alias("entrance_exams"),
        F.map_from_entries(F.array_compact(F.array(*scores))).alias("cutoff_scores"),
    )


def admission_data(text: Column, tables: Column) -> Column:
    return F.struct(
        deadlines(text, tables).alias("application_deadlines"),
        courses(text, tables).alias("courses_offered"),
        seats(text, tables).alias("seats_available"),
        fees(text, tables).alias("fee_structure"),
        hostel(text).alias("hostel_facilities"),
        eligibility(text).alias("eligibility_criteria"),
    )
