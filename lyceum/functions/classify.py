"""Rules that name the kind of a page, a file or an image. A model's verdict can come first where the caller has one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from lyceum.functions import fixed
from lyceum.functions.text import word_count


def hit_count(text: Column, words: Sequence[str]) -> Column:
    """How many of the words text contains (each counts once); text is lower-cased by the caller.

    A plain sum, not a lambda over the words: so text, however dear, is computed once for all of them.
    """
    return reduce(add, (text.contains(w).cast("int") for w in words))


def verdict(hook: Column | None, otherwise: Column, least: float = 0.6) -> Column:
    """The class of a struct<class, confidence> if it is sure enough, else the rule."""
    return otherwise if hook is None else F.when(hook["confidence"] > least, hook["class"]).otherwise(otherwise)


def page_type(text: Column, hook: Column | None = None) -> Column:
    """admission if it leads in indicators or in keywords, else placement if that leads in either, else general."""
    low = F.lower(text)
    a_i, p_i = hit_count(low, fixed.ADMISSION_INDICATORS), hit_count(low, fixed.PLACEMENT_INDICATORS)
    a_k, p_k = hit_count(low, fixed.ADMISSION_KEYWORDS), hit_count(low, fixed.PLACEMENT_KEYWORDS)
    rule = (
        F.when((a_i > p_i) | (a_k > p_k), "admission").when((p_i > a_i) | (p_k > a_k), "placement").otherwise("general")
    )
    return verdict(hook, rule)


def file_type(text: Column, hook: Column | None = None) -> Column:
    """admission or placement by strict majority of the words contained, else general."""
    low = F.lower(text)
    a, p = hit_count(low, fixed.FILE_ADMISSION_WORDS), hit_count(low, fixed.FILE_PLACEMENT_WORDS)
    return verdict(hook, F.when(a > p, "admission").when(p > a, "placement").otherwise("general"))


def image_type(is_chart: Column, has_table: Column, text: Column) -> Column:
    """chart, table, text (over 30 words) or photo, in this order; unknown if nothing looked at the image."""
    seen = is_chart.isNotNull() | has_table.isNotNull() | text.isNotNull()
    kind = F.when(is_chart, "chart").when(has_table, "table").when(word_count(text) > 30, "text").otherwise("photo")
    return F.when(seen, kind).otherwise("unknown")
