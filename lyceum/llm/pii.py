"""Format-preserving Feistel pseudonyms of personal data and secrets (DataFrame functions only).

A match is validated, then permuted within its own format by a keyed Feistel network, so that equal values get equal
pseudonyms in all documents and different values different ones. Dates and addresses are permuted as numbers (with
cycle-walking where the range is not the domain), card and account numbers keep their issuer and get right check digits, other
values keep each character's class. Numbers are permuted without their separators, so spelling does not break a link. The
key decides everything and is the caller's secret: who has it can invert all pseudonyms.

Covered: e-mail addresses; access keys (AKIA, ASIA); what follows password, passwd, pwd, secret, token or api_key and = or :, also
as JSON; dates of 1900 to 2099 in ISO order or with the year last, also before a time; IPv4 addresses; IPv6 addresses that are
written out or begin like a global or local one; phone numbers as NNN-NNN-NNNN with separators, and international ones with
a plus; IBANs with right check digits; numbers of the form NNN-NN-NNNN; card numbers with a right check digit. Bare runs of ten
digits are no phone numbers here, as nothing tells them from other numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyceum.functions.urljoin import let
from lyceum.llm.sharding import feistel, permuted

ROUNDS = 8
#: Steps of cycle-walking of secrets: a walk goes on with a chance of 6 in 26 for each letter at most.
WALK = 32
FIRST_DAY, DAYS = "1900-01-01", 73049
#: Steps of cycle-walking of dates that only the month-first order can read: six in ten days are such.
DATE_WALK = 64
#: Groups of a run of digits that are scanned for cards in one fold.
RUN_PART = 128
#: Country codes of two digits; 1 and 7 have one, all others three.
TWO_DIGIT_COUNTRIES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

#: Kind -> pattern, in order of precedence; each is also what its match must fully look like.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api_?key)[\x22\x27]?[ \t]{0,3}[=:][ \t]{0,3}[\x22\x27]?[A-Za-z0-9+/_.=-]{8,}+[\x22\x27]?",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})(?![0-9A-SU-Za-z/-]|T(?![0-9]))",
    "address": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "address6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[23][0-9A-Fa-f]{3}|[Ff][C-Fc-f][0-9A-Fa-f]{2})(?::[0-9A-Fa-f]{1,4}){0,5}:(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|(?<![0-9])[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])\+[1-9](?:[ .-]?[0-9]){7,14}(?![0-9A-Za-z])",
    "person_number": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z])(?=[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]))[0-9]++(?:[ -][0-9]++(?![A-Za-z]))*+",
}
#: Cards are searched between the matches of all other kinds: as whole runs of digit groups, in which new_cards finds them.
OTHERS = "|".join(p for k, p in KINDS.items() if k != "card")
CARD_LENGTHS = (16, 15, 13, 14, 19, 17, 18)


def may_match(text: Column) -> Column:
    """False only for texts that no pattern can match: cheap scans spare most texts the search."""
    found = text.rlike("[0-9]")
    for part in ("@", "=", ":", "AKIA", "ASIA"):
        found = found | text.contains(part)
    return found


def chars(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))


def shifted(char: Column, by: Column, letters: int) -> Column:
    """char moved within its class: digits, and small and large letters (the first `letters` of them)."""

    def within(first: str, n: int) -> Column:
        return F.char(F.lit(ord(first)) + F.pmod(F.ascii(char) - F.lit(ord(first)) + F.pmod(by, F.lit(n)), F.lit(n)))

    small, large = chr(ord("a") + letters - 1), chr(ord("A") + letters - 1)
    return (
        F.when(char.between("0", "9"), within("0", 10))
        .when(char.between("a", small), within("a", letters))
        .when(char.between("A", large), within("A", letters))
        .otherwise(char)
    )


def permuted_text(value: Column, key: int, letters: int = 26) -> Column:
    """A keyed bijection among the strings with the same character classes: in turns, one half moves each character of the
    other by a hash of itself and the place."""

    def turn(s: Column, k: Column) -> Column:
        moved = F.transform(chars(s["l"]), lambda c, i: shifted(c, F.xxhash64(s["r"], k, i, F.lit(key)), letters))
        return F.struct(s["r"].alias("l"), F.array_join(moved, "").alias("r"))

    def of(whole: Column) -> Column:
        half = F.floor(F.length(whole) / 2).cast("int")
        start = F.struct(F.substring(whole, F.lit(1), half).alias("l"), F.substring(whole, half + 1, F.length(whole)).alias("r"))
        return F.aggregate(F.array(*(F.lit(k) for k in range(ROUNDS))), start, turn, lambda s: F.concat(s["l"], s["r"]))

    return let(value, of)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def with_digits(value: Column, digits: Column) -> Column:
    """value with its digits replaced in turn; separators stay."""

    def of(pieces: Column) -> Column:
        """pieces: what stands before each digit, and behind the last one."""
        before = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
        return F.concat(F.array_join(F.zip_with(before, chars(digits), lambda gap, digit: F.concat(gap, digit)), ""), F.element_at(pieces, -1))

    return let(F.split(value, "[0-9]", -1), of)


def luhn(digits: Column, doubled_last: bool) -> Column:
    """Digit sum modulo 10 in which every other digit counts double, from the last or the one before it."""

    def of(whole: Column) -> Column:
        n = F.length(whole)

        def add(total: Column, i: Column) -> Column:
            d = F.substring(whole, n - i, F.lit(1)).cast("int")
            twice = F.pmod(i, F.lit(2)) == (0 if doubled_last else 1)
            return total + F.when(twice, F.get(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), d)).otherwise(d)

        return F.pmod(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add), F.lit(10))

    return let(digits, of)


def new_card(value: Column, key: int) -> Column:
    """value, which has a right check digit, permuted."""

    def of(digits: Column) -> Column:
        inner = permuted_text(F.substring(digits, F.lit(2), F.length(digits) - 2), key)
        return F.concat(F.substring(digits, 1, 1), inner)

    def checked(body: Column) -> Column:
        return F.concat(body, F.pmod(F.lit(10) - luhn(body, True), F.lit(10)).cast("string"))

    return let(value, lambda v: with_digits(v, let(let(digits_of(v), of), checked)))


def new_cards(run: Column, key: int) -> Column:
    """struct(cards, new) of a run of digit groups: windows of whole groups with a right check digit are permuted; cards has them.

    Of the windows at a group the first of CARD_LENGTHS is taken, from left to right; a window of another length than 16
    gives way to one of 16 that starts inside it. A run without a window stays as it is. Windows are tested over the 19 digits
    behind a group only, and a run is put together in parts of RUN_PART groups, so the work is proportional to its length.
    """
    groups = F.regexp_extract_all(run, F.lit("[0-9]+[ -]?"), F.lit(0))

    def windows(all_: Column) -> Column:
        """For each group, struct(rank, size) of its best window, rank 99 if it has none."""
        none = F.struct(F.lit(99).alias("rank"), F.lit(0).alias("size"))

        def behind(ahead: Column) -> Column:
            """ahead: the digits of the next groups, 19 at most."""

            def of(k: Column) -> Column:
                window = F.array_join(F.slice(ahead, F.lit(1), k), "")
                return F.struct(F.array_position(F.lit(list(CARD_LENGTHS)), F.length(window)).cast("int").alias("rank"), k.alias("size"), window.alias("window"))

            fitting = F.filter(F.transform(F.sequence(F.lit(1), F.size(ahead)), of), lambda w: w["rank"] > 0)
            good = F.filter(fitting, lambda w: luhn(w["window"], False) == 0)
            return F.coalesce(F.array_min(F.transform(good, lambda w: F.struct(w["rank"].alias("rank"), w["size"].alias("size")))), none)

        def of(digits: Column) -> Column:
            return F.transform(digits, lambda _, i: let(F.slice(digits, i + 1, F.lit(19)), behind))

        return let(F.transform(all_, digits_of), of)

    def scan(all_: Column, best: Column) -> Column:
        size = F.size(all_)

        def step(s: Column, i: Column) -> Column:
            b = F.get(best, i)
            inside = F.slice(best, i + 2, F.greatest(b["size"] - 1, F.lit(0)))
            whole = (b["rank"] == 1) | ~F.exists(inside, lambda x: x["rank"] == 1)
            free = (i >= s["next"]) & (b["rank"] < 99) & whole
            card = let(F.array_join(F.slice(all_, i + 1, b["size"]), ""), lambda x: new_card(x, key))
            piece = F.when(free, card).when(i >= s["next"], F.get(all_, i)).otherwise("")
            return let(piece, lambda p: F.struct(
                F.when(free, i + b["size"]).otherwise(s["next"]).alias("next"),
                F.when(free, F.concat(s["cards"], F.array(p))).otherwise(s["cards"]).alias("cards"),
                F.concat(s["new"], F.array(p)).alias("new"),
            ))

        none = F.array().cast("array<string>")

        def part(s: Column, at: Column) -> Column:
            start = F.struct(s["next"].alias("next"), none.alias("cards"), none.alias("new"))
            inside = F.sequence(at, F.least(at + RUN_PART, size) - 1)
            return F.aggregate(inside, start, step, lambda x: F.struct(
                x["next"].alias("next"), F.concat(s["cards"], F.array(x["cards"])).alias("cards"),
                F.concat(s["new"], F.array(F.array_join(x["new"], ""))).alias("new"),
            ))

        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<array<string>>").alias("cards"), none.alias("new"))
        parts = F.sequence(F.lit(0), size - 1, F.lit(RUN_PART))
        return F.aggregate(parts, start, part, lambda s: F.struct(F.flatten(s["cards"]).alias("cards"), F.array_join(s["new"], "").alias("new")))

    return let(groups, lambda all_: let(windows(all_), lambda best: scan(all_, best)))


def new_address(value: Column, key: int) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n * 256 + x)
    moved = feistel(number, 1 << 16, 1 << 16, key)
    octets = [F.shiftright(moved, 8 * k).bitwiseAND(F.lit(255)).cast("string") for k in (3, 2, 1, 0)]
    valid = F.forall(parts, lambda x: x <= 255)
    return F.when(valid, F.concat_ws(".", *octets)).otherwise(value)


def new_date(value: Column, key: int) -> Column:
    """Dates of 1900 to 2099, day first where both readings are valid; others stay as they are.

    A date that only the month-first order can read moves among such dates, so that no two dates get one text.
    """
    separator = F.regexp_extract(value, "[./-]", 0)
    year_first = value.rlike("^[0-9]{4}")
    pad = F.length(value) == 10

    def joined(fields) -> Column:
        return F.call_function("concat_ws", separator, *map(F.lit, fields))

    def form(*fields: str) -> Column:
        wide = [f if f == "yyyy" else f + f for f in fields]
        return F.when(pad, joined(wide)).otherwise(joined(fields))

    first = F.when(year_first, form("yyyy", "M", "d")).otherwise(form("d", "M", "yyyy"))
    second = F.when(year_first | (separator == "."), first).otherwise(form("M", "d", "yyyy"))
    start = F.lit(FIRST_DAY).cast("date")

    def read(form: Column, only_second: bool) -> Column:
        return F.struct(F.try_to_timestamp(value, form).cast("date").alias("day"), form.alias("form"), F.lit(only_second).alias("walks"))

    def move(found: Column) -> Column:
        day = F.date_diff(found["day"], start).cast("long")

        def again(moved: Column, _: Column) -> Column:
            ambiguous = found["walks"] & (F.dayofmonth(F.date_add(start, moved.cast("int"))) <= 12)
            return F.when(ambiguous, permuted(moved, DAYS, key)).otherwise(moved)

        steps = F.when(found["walks"], F.sequence(F.lit(1), F.lit(DATE_WALK))).otherwise(F.array().cast("array<int>"))
        moved = F.date_add(start, F.aggregate(steps, permuted(day, DAYS, key), again).cast("int"))
        return F.when((day >= 0) & (day < DAYS), F.call_function("date_format", moved, found["form"]))

    valid = F.filter(F.array(read(first, False), read(second, True)), lambda x: x["day"].isNotNull())
    return F.coalesce(F.get(F.transform(F.slice(valid, 1, 1), move), F.lit(0)), value)


def new_address6(value: Column, key: int) -> Column:
    """Written out in full; the first group, which tells the kind of address, stays. Other spellings of one address are linked."""
    parts = F.split(F.lower(value), "::", -1)
    groups = F.transform(parts, lambda x: F.filter(F.split(x, ":"), lambda g: g != ""))
    missing = F.lit(8) - F.aggregate(groups, F.lit(0), lambda n, g: n + F.size(g))
    zeros = F.array_repeat(F.lit("0"), missing)
    whole = F.when(F.size(groups) == 2, F.concat(groups[0], zeros, F.get(groups, 1))).otherwise(groups[0])
    digits = F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")
    moved = F.concat(F.substring(digits, 1, 4), permuted_text(F.substring(digits, F.lit(5), F.lit(28)), key, 6))
    parted = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.substring(moved, 4 * k + 1, F.lit(4))), ":")
    return F.when((F.size(whole) == 8) & (missing >= F.size(groups) - 1), parted).otherwise(value)


def rest97(text: Column) -> Column:
    """A text of digits and capital letters (A is 10, B is 11 and so on) as a number, modulo 97."""

    def step(rest: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.pmod(F.when(digit, rest * 10 + c.cast("int")).otherwise(rest * 100 + F.ascii(c) - 55), F.lit(97))

    return F.aggregate(chars(text), F.lit(0), step)


def new_iban(value: Column, key: int) -> Column:
    """Country and form stay, the account moves, and the check digits are made anew."""
    solid = F.regexp_replace(value, " ", "")
    country, account = F.substring(solid, 1, 2), F.substring(solid, F.lit(5), F.length(solid))
    valid = rest97(F.concat(account, F.substring(solid, 1, 4))) == 1
    moved = permuted_text(account, key)
    check = F.lpad((F.lit(98) - rest97(F.concat(moved, country, F.lit("00")))).cast("string"), 2, "0")
    whole = F.concat(country, check, moved)

    def at(c: Column, i: Column) -> Column:
        return F.when(c == " ", c).otherwise(F.substring(whole, F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), " ", "")), F.lit(1)))

    return F.when(valid, F.array_join(F.transform(chars(value), at), "")).otherwise(value)


def new_phone(value: Column, key: int) -> Column:
    """The last ten digits move; of numbers with a plus all behind the country code, if these are fewer."""

    def of(digits: Column) -> Column:
        code = F.when(F.substring(digits, 1, 1).isin("1", "7"), 1).when(F.substring(digits, 1, 2).isin(*TWO_DIGIT_COUNTRIES), 2).otherwise(3)
        lead = F.greatest(F.length(digits) - 10, F.when(value.contains("+"), code).otherwise(0))
        return F.concat(F.substring(digits, F.lit(1), lead), permuted_text(F.substring(digits, lead + 1, F.lit(10)), key))

    return with_digits(value, let(digits_of(value), of))


def new_email(value: Column, key: int) -> Column:
    """Everything but the top-level domain moves; case does not break a link."""
    low = F.lower(value)
    name = F.regexp_extract(low, r"^(.*)(\.[a-z]+)$", 1)
    return F.concat(permuted_text(name, key), F.regexp_extract(low, r"^(.*)(\.[a-z]+)$", 2))


def new_secret(value: Column, key: int) -> Column:
    """Hexadecimal bodies stay hexadecimal; others are permuted until they are not, so that no two bodies meet."""
    shape = r"^([A-Za-z_]+[\x22\x27]?[ \t]*[=:][ \t]*[\x22\x27]?)(.*?)([\x22\x27]?)$"
    hexadecimal = "^[0-9a-f]+$"

    def other(body: Column) -> Column:
        steps = F.array(*(F.lit(k) for k in range(WALK)))
        first = permuted_text(body, key)
        out = F.aggregate(steps, first, lambda s, _: F.when(s.rlike(hexadecimal), permuted_text(s, key)).otherwise(s))
        return F.when(out.rlike(hexadecimal), F.raise_error(F.lit("cycle walk too long: choose another key"))).otherwise(out)

    def moved(body: Column) -> Column:
        return F.when(body.rlike(hexadecimal), permuted_text(body, key, 6)).otherwise(other(body))

    body = F.transform(F.array(F.regexp_extract(value, shape, 2)), moved)[0]
    return F.concat(F.regexp_extract(value, shape, 1), body, F.regexp_extract(value, shape, 3))


def new_key(value: Column, key: int) -> Column:
    return F.concat(F.substring(value, 1, 4), permuted_text(F.substring(value, F.lit(5), F.length(value)), key))


def new_person_number(value: Column, key: int) -> Column:
    return with_digits(value, permuted_text(digits_of(value), key))


PSEUDONYMS = {
    "email": new_email, "key": new_key, "secret": new_secret, "date": new_date, "address": new_address,
    "address6": new_address6, "iban": new_iban, "phone": new_phone, "person_number": new_person_number,
}


def kind_of(value: Column) -> Column:
    """The kind of a match, by its own shape."""
    inside = {k: p.replace("(?<![0-9])", "") for k, p in KINDS.items() if k != "card"}
    out = F.lit(None).cast("string")
    for kind in reversed(list(inside)):
        out = F.when(value.rlike(f"^(?:{inside[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def pseudonym(value: Column, key: int) -> Column:
    """struct(kind, new) of a match: new equals the match where validation fails."""

    def of(kind: Column) -> Column:
        new = value
        for name, make in reversed(list(PSEUDONYMS.items())):
            new = F.when(kind == name, make(value, key)).otherwise(new)
        return F.struct(kind.alias("kind"), new.alias("new"))

    return F.transform(F.array(kind_of(value)), of)[0]


def woven(gaps: Column, between: Column) -> Column:
    """The gaps with what stands between them."""
    pairs = F.zip_with(gaps, between, lambda gap, new: F.array(gap, F.coalesce(new, F.lit(""))))
    return F.concat_ws("", F.flatten(pairs))


def with_cards(gap: Column, key: int) -> Column:
    """struct(text, kinds): a text between other matches with its cards permuted, and a (kind, new) for each card, or for a run of
    digits that has none."""

    def of(cards: Column) -> Column:
        each = F.transform(cards, lambda c: F.transform(
            F.when(F.size(c["cards"]) > 0, c["cards"]).otherwise(F.array(c["new"])), lambda x: F.struct(F.lit("card").alias("kind"), x.alias("new"))
        ))
        text = F.when(F.size(cards) > 0, woven(F.split(gap, KINDS["card"], -1), cards["new"]))
        return F.struct(F.coalesce(text, gap).alias("text"), F.flatten(each).alias("kinds"))

    runs = F.regexp_extract_all(gap, F.lit(KINDS["card"]), F.lit(0))
    return let(F.transform(runs, lambda run: new_cards(run, key)), of)


def pseudonymised(docs: DataFrame, key: int) -> DataFrame:
    """docs with `text` pseudonymised and `_pii`, the array of struct(kind, new) of its matches.

    Null texts stay null, and texts without a match stay as they are, byte for byte. All other columns stay, save that
    _pii is replaced. Rows are independent of each other, so ties and repeated rows need no care.
    """
    base = docs.drop("_pii")
    none = F.array().cast("array<struct<kind:string,new:string>>")
    searched = may_match(F.col("text"))
    found = F.when(searched, F.regexp_extract_all("text", F.lit(OTHERS), F.lit(0)))
    gaps = F.when(searched, F.transform(F.split("text", OTHERS, -1), lambda gap: with_cards(gap, key)))
    marked = base.withColumn("_other", F.coalesce(F.transform(found, lambda x: pseudonym(x, key)), none)).withColumn("_gaps", gaps)
    order = F.zip_with(F.col("_gaps.kinds"), "_other", lambda cards, other: F.concat(
        cards, F.when(other.isNotNull(), F.array(other)).otherwise(none)
    ))
    marked = marked.withColumn("_pii", F.coalesce(F.flatten(order), none))
    text = F.when(F.size("_pii") > 0, woven(F.col("_gaps.text"), F.col("_other.new"))).otherwise(F.col("text"))
    return marked.select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in base.columns), "_pii")


def pseudonym_digest(docs: DataFrame, key: int) -> DataFrame:
    """(doc_id, text, n_found, and the number of matches of each kind)."""
    out = pseudonymised(docs.select("doc_id", "text"), key)

    def count(kind: str) -> Column:
        return F.size(F.filter("_pii", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", "text", F.size("_pii").cast("long").alias("n_found"), *(count(k) for k in KINDS))
