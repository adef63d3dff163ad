"""Regular expressions as columns: one place for flags, misses and positions.

Patterns ignore case unless told otherwise, and only \\n ends a line. A miss is null, not the empty string.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space in texts: those of Unicode and the four information separators.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: The same characters, each once.
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def stripped(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.btrim(text, F.lit(BLANKS))


def flagged(pattern: str, case: bool = False) -> str:
    """The pattern with its flags, and with all white space for \\s (classes nest, so also inside brackets)."""
    pattern = pattern.replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    return ("(?d)" if case else "(?id)") + pattern


def first(text: Column, pattern: str, group: int = 1, case: bool = False) -> Column:
    """The group of the first match, null without one."""
    p = flagged(pattern, case)
    return F.when(text.rlike(p), F.regexp_extract(text, p, group))


def first_of(text: Column, patterns: Sequence[str], group: int = 1) -> Column:
    """The group of the first match of the first pattern that matches."""
    return F.coalesce(*(first(text, p, group) for p in patterns))


def every(text: Column, pattern: str, group: int = 0, case: bool = False) -> Column:
    return F.regexp_extract_all(text, F.lit(flagged(pattern, case)), F.lit(group))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def hits(text: Column, pattern: str, groups: int, case: bool = False) -> Column:
    """array<struct<match, groups, position>> of all matches; position counts code points from 0. The pattern has no look-around,
    anchors or boundaries: a match is matched alike where nothing is around it, so its groups are read from it alone.

    A match begins after all pieces between matches and all matches before it. The text is searched once for each of these, however
    many matches it has.
    """
    p = flagged(pattern, case)

    def begin(so_far: Column, gap: Column, own: Column) -> Column:
        at = so_far["end"] + gap
        return F.struct((at + own).alias("end"), F.concat(so_far["begins"], F.array(at)).alias("begins"))

    def of(found: Column) -> Column:
        matches, begins = found["matches"], found["begins"]["begins"]

        def at(match: Column, i: Column) -> Column:
            own = F.array(*(F.nullif(F.regexp_extract(match, p, g), F.lit("")) for g in range(1, groups + 1))).cast("array<string>")
            return F.struct(match.alias("match"), own.alias("groups"), F.get(begins, i).alias("position"))

        return F.transform(matches, at)

    def measured(found: Column) -> Column:
        sizes = F.transform(found["matches"], lambda m, i: F.struct(F.length(F.get(found["pieces"], i)).alias("gap"), F.length(m).alias("own")))
        none = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("begins"))
        begins = F.aggregate(sizes, none, lambda so_far, x: begin(so_far, x["gap"], x["own"]))
        return let(F.struct(found["matches"].alias("matches"), begins.alias("begins")), of)

    matches = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    found = let(F.struct(matches.alias("matches"), F.split(text, p, -1).alias("pieces")), measured)
    none = F.array().cast("array<struct<match:string,groups:array<string>,position:int>>")
    return F.when(text.rlike(p), found).otherwise(F.when(text.isNotNull(), none))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether text contains any of the words, as they are."""
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def as_double(text: Column) -> Column:
    """A plain number, else null; never fails."""
    return F.when(text.rlike(r"^(\d+\.?\d*|\.\d+)$"), text.cast("double"))
