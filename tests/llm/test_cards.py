"""Card numbers beside other numbers."""

import re
import time

import pytest
from pyspark.sql import functions as F

from lyceum.llm import pii

CARD = "4111 1111 1111 1111"


@pytest.fixture(scope="module")
def moved(spark):
    def of(*texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return [(r["text"], [p["kind"] for p in r["_pii"]]) for r in pii.pseudonymised(df, 20250101).orderBy("doc_id").collect()]

    return of


def test_a_card_beside_a_number_is_moved_as_alone(moved):
    beside = [
        "{} 12/25", "{} 123", "7 {}", "{} 2nd", "x {} 1234", "12 345 {} 99 12", "1234 {} 1234", "{} 555-123-4567", "7 555-123-4567 {}.",
    ]
    (alone, _), *rest = moved(CARD, *(b.format(CARD) for b in beside))
    assert alone != CARD and re.fullmatch(r"4\d{3} \d{4} \d{4} \d{4}", alone)
    for shape, (text, kinds) in zip(beside, rest, strict=True):
        assert alone in text and CARD not in text and "555-123-4567" not in text and "card" in kinds
        if "555" not in shape:
            assert text == shape.format(alone)
    assert moved(CARD.replace(" ", "-") + " 123")[0][0] == alone.replace(" ", "-") + " 123"


def test_runs_of_several_cards_and_of_none(moved):
    (alone, _), (both, kinds), (none, _), (table, _) = moved(
        CARD, f"{CARD} 5500 0000 0000 0004", "4041894974608796 12", " ".join(["1"] * 3000)
    )
    assert both.startswith(alone) and "5500 0000 0000 0004" not in both and kinds == ["card", "card"]
    assert none == "4041894974608796 12" and len(table) == 5999


def test_texts_of_many_cards_take_little_more_than_one(moved):
    def seconds(text):
        began = time.time()
        found = moved(text)
        return time.time() - began, found[0]

    base, (alone, _) = seconds(CARD)
    for text, cards in [(", ".join([CARD] * 10_000), 10_000), (" ".join([CARD] * 10_000), 10_000), ("12 34 " * 10_000, 2_000), (" ".join(["1"] * 20_000), 0)]:
        took, (new, kinds) = seconds(text)
        assert took < base + 30 and len(new) == len(text)
        assert len(kinds) == max(cards, 1) and (new == text) == (cards == 0)
        if cards == 10_000:
            assert set(re.findall(r"\d{4} \d{4} \d{4} \d{4}", new)) == {alone}


def test_no_two_dates_share_a_pseudonym(spark):
    """All texts of 1900 to 2099 of each format, day first and month first: as many pseudonyms, of the same format."""
    days = spark.range(73049).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    for separator in "/-.":
        for wide in (True, False):
            d, m = ("dd", "MM") if wide else ("d", "M")
            orders = [f"{d}{separator}{m}{separator}yyyy", f"{m}{separator}{d}{separator}yyyy"][: 1 if separator == "." else 2]
            texts = days.select(F.explode(F.array(*(F.date_format("day", o) for o in orders))).alias("value")).distinct()
            shape = rf"^[0-9]{{{'2' if wide else '1,2'}}}\{separator}[0-9]{{{'2' if wide else '1,2'}}}\{separator}(19|20)[0-9]{{2}}$"
            row = texts.select("value", pii.new_date(F.col("value"), 20250101).alias("new")).agg(
                F.count("*").alias("n"), F.count_distinct("new").alias("different"), F.count_if(F.col("new").rlike(shape)).alias("formed")
            ).first()
            assert row.n == row.different == row.formed and row.n > 70_000, (separator, wide)


def test_short_international_numbers_keep_their_country(moved):
    ((text, kinds),) = moved("+49 30 123456 and +420 777 123 456 and +1 555 123 4567")
    assert kinds == ["phone"] * 3 and re.fullmatch(r"\+49 \d\d \d{6} and \+420 \d{3} \d{3} \d{3} and \+1 \d{3} \d{3} \d{4}", text)
    assert "123456" not in text
