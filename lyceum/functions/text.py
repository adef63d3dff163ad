"""Text functions: dates, numbers, contacts, cleaning, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lyceum.functions import fixed, rx


def context(text: Column, position: Column, size: int = fixed.CONTEXT) -> Column:
    """Up to size code points to both sides of a position, with ... where text was cut."""
    start = F.greatest(position - size, F.lit(0))
    end = F.least(F.length(text), position + size)
    return F.concat(
        F.when(start > 0, "...").otherwise(""),
        F.substring(text, start + 1, end - start),
        F.when(end < F.length(text), "...").otherwise(""),
    )


DATES = "array<struct<date_str:string,match_groups:array<string>,position:int,context:string>>"
NUMBERS = "array<struct<match:string,value:string,numeric_value:double,position:int,context:string>>"


def with_digits_only(text: Column, found: Column, kind: str) -> Column:
    """found, an array of this kind, is searched only in texts with a digit, which its patterns need; else it is empty."""
    return F.when(text.rlike("[0-9]"), found).when(text.isNotNull(), F.array().cast(kind))


def dates(text: Column) -> Column:
    """array<struct<date_str, match_groups, position, context>>, pattern by pattern; a date two patterns match comes twice. The text
    is worked out once, and patterns with names of months are searched only where one may begin."""

    def found(text: Column, pattern: str) -> Column:
        return F.transform(
            rx.hits(text, pattern, 3),
            lambda h: F.struct(
                h["match"].alias("date_str"), h["groups"].alias("match_groups"), h["position"].alias("position"),
                context(text, h["position"]).alias("context"),
            ),
        )

    def of(text: Column) -> Column:
        named = rx.let(F.lower(text), lambda low: rx.contains_any(low, fixed.MONTH_STARTS))

        def every(named: Column) -> Column:
            return F.concat(*(
                F.when(named, found(text, p)).otherwise(F.array().cast(DATES)) if "Feb" in p else found(text, p) for p in fixed.DATE_PATTERNS
            ))

        return with_digits_only(text, rx.let(named, every), DATES)

    return rx.let(text, of)


def numbers(text: Column) -> Column:
    """array<struct<match, value, numeric_value, position, context>>, pattern by pattern (case matters in currency names)."""

    def found(text: Column, pattern: str) -> Column:
        return F.transform(
            rx.hits(text, pattern, 1, case=True),
            lambda h: F.struct(
                h["match"].alias("match"), F.get(h["groups"], F.lit(0)).alias("value"),
                F.regexp_replace(F.get(h["groups"], F.lit(0)), ",", "").cast("double").alias("numeric_value"),
                h["position"].alias("position"), context(text, h["position"]).alias("context"),
            ),
        )

    return rx.let(text, lambda t: with_digits_only(t, F.concat(*(found(t, p) for p in fixed.NUMBER_PATTERNS)), NUMBERS))


def plain_numbers(text: Column) -> Column:
    """array<double>; a sign counts before a decimal point only."""
    return F.transform(rx.every(text, fixed.PLAIN_NUMBER), lambda x: x.cast("double"))


def emails(text: Column) -> Column:
    return rx.every(text, fixed.EMAIL, case=True)


def phones(text: Column) -> Column:
    return rx.every(text, fixed.PHONE, case=True)


def clean(text: Column) -> Column:
    """White space folded to single spaces, then control characters dropped, then trimmed; null becomes empty."""
    blank = F.translate(F.coalesce(text, F.lit("")), rx.BLANKS, " " * len(rx.BLANKS))
    return F.trim(F.regexp_replace(F.regexp_replace(blank, " {2,}", " "), r"[\x00-\x08\x0e-\x1f\x7f]", ""))


def parse_date(text: Column) -> Column:
    """timestamp by the first format that fits, null without one; white space around it is left out."""
    trimmed = rx.stripped(text)
    return F.coalesce(*(F.try_to_timestamp(trimmed, F.lit(f)) for f in fixed.DATE_FORMATS))


def format_datetime(ts: Column, form: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(ts, form)


def human_size(size: Column) -> Column:
    """0B, or two decimals and the largest unit that leaves at least 1."""
    out = F.lit(None).cast("string")
    for k, unit in reversed(list(enumerate(fixed.SIZE_UNITS))):
        value = F.format_string(f"%.2f {unit}", F.bround(size.cast("double") / F.lit(float(1024**k)), 2))
        last = k == len(fixed.SIZE_UNITS) - 1
        out = value if last else F.when(size.cast("double") < F.lit(float(1024 ** (k + 1))), value).otherwise(out)
    return F.when(size == 0, "0B").otherwise(out)


def truncated(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def word_count(text: Column) -> Column:
    """Words between white space; 0 for blank or null texts."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"[{rx.SPACE}]+"), lambda w: w != ""))
