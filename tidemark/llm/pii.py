"""Format-preserving Feistel pseudonyms for personal numbers and dates.

Only built-in functions: one pass of a fixed pattern marks the candidate values of a text, each
validated value goes through a keyed Feistel network over exactly the set of values of its format,
and the parts are joined again. The networks are permutations, so equal values get equal pseudonyms
in all documents and different ones stay different. All patterns have possessive or bounded
repetitions, so the work grows with a text's length and not with its square.

========  =============================================  ========================================
kind      validated by                                   permuted
========  =============================================  ========================================
card      13 to 19 digits, Luhn digit right              all but the first; the check digit follows
ip        four numbers of at most 255                    the 32 bits
date      a day that exists, 1800-03-01 to 2200-02-28    the day; the same in every notation
ssn       area, group and serial in use                  among those in use
phone     8 to 15 digits with +, 10 to 15 with           the last ten digits; all but the first of
          brackets, 3-3-4 digits, or 9 to 12 from a 0    fewer than ten, or after a leading 0
email     name@host, at most 64 characters, a dotted     letters and digits of the name; of letters
          host with two letters after a dot              beyond A-Z those of the same Unicode block
iban      15 to 34 characters, remainder 97 right        the last 18 digits; check digits follow
========  =============================================  ========================================

Separators, padding, the order of a date's parts and everything else in the text stay as they are.
A value that fails its validation stays as it is. Cards are validated at each place where one may
start, so a number before a card does not hide it, and phones end before a card, a date or an IP
address. Dates are year first or last with separators, or with an English month name.

The key comes from a one-row table through a scalar subquery, so neither plans nor event logs show it.

Defined cases: a null text stays null, an empty one empty, both with 0 replaced. Repeated rows
are treated alike. Texts of any length are rewritten whole. An empty table gives an empty result.
Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

#: Marks inside a text while it is taken apart: a noncharacter and a second one that tells what it
#: stands for. The text's own are escaped first, so no text can be mistaken for a mark.
ESCAPE, CARD_HERE, ITSELF, VALUE = "\ufdd0", "\ufdd0\ufdd1", "\ufdd0\ufdd2", "\ufdd0\ufdd3"

NAME = r"[\p{L}\p{N}._%+\x{FDD0}\x{FDD1}-]"
#: The name's limit of 64 characters is that of RFC 5321.
EMAIL = rf"(?<!{NAME}){NAME}{{1,64}}+@(?=[A-Za-z0-9.-]*?\.[A-Za-z]{{2}})[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
#: A card may seem to start at any of its groups.
_HERE = f"(?:{CARD_HERE})?"
IBAN = rf"(?<![A-Za-z0-9])[A-Z]{{2}}{_HERE}\d{{2}}(?: ?{_HERE}[A-Z0-9]{{4}}){{2,7}}(?: ?{_HERE}[A-Z0-9]{{1,3}})?(?![A-Za-z0-9])"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
ISO_DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d./])(?:\d{4}/\d{2}/\d{2}|\d{4}\.\d{2}\.\d{2})(?![\d/])"
MONTHS = "January February March April May June July August September October November December".split()
MONTH = f"(?:{'|'.join(MONTHS)}|{'|'.join(m[:3] for m in MONTHS)})"
NAMED_DATE = rf"(?<![\w.])\d{{1,2}} {MONTH},? \d{{4}}(?!\d)|\b{MONTH} \d{{1,2}}, \d{{4}}(?!\d)"
DAY_DATE = r"(?<![\d./])\d{1,2}([./])\d{1,2}\1\d{4}(?![\d/])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d+])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
#: Plain national numbers: 3-3-4 digits, or groups from a leading 0 on.
NATIONAL = r"(?<![\d+])(?<!\d[ ./-])(?:\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{1,4}(?:[ /-]\d{2,8}){1,4})(?![ ./-]?\d)"
BRACKETED = r"(?<![\d+])\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\d)"


CARD_START = rf"(?={CARD})"
PHONE = rf"(?<![\w+])\+[1-9](?:\d{{9,14}}(?!\d)|(?:[ ./()-]{{0,2}}(?!{CARD_HERE}|{IP}|{ISO_DATE}|\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}}(?!\d))\d){{7,14}}(?!\d))"
#: A valid card, which may have further marks where its own groups could start another one.
MARKED_CARD = rf"{CARD_HERE}(?:\d{{13,19}}|\d{{4}}(?:[ -]{_HERE}\d{{4}}){{2}}[ -]{_HERE}\d{{1,7}}|\d{{4}}[ -]{_HERE}\d{{6}}[ -]{_HERE}\d{{5}})(?!\d)"
CANDIDATE = "|".join([EMAIL, IP, ISO_DATE, DAY_DATE, NAMED_DATE, SSN, IBAN, MARKED_CARD, PHONE, BRACKETED, NATIONAL])


def with_card_marks(text: Column) -> Column:
    """``text`` with a mark before each valid card, from every place where one may start.

    The text is split before each such place; the candidate that starts there comes from a second
    pass, so both have the same order, and the parts are joined with a mark where it is valid.
    """
    parts = F.split(text, CARD_START, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(f"(?=({CARD}))"), F.lit(1)), lambda v: let(_digits(v), _has_luhn_digit))
    # A candidate at the very start leaves no part before it.
    before = F.when(text.rlike(f"^{CARD_START}"), F.expr("CAST(array() AS array<boolean>)")).otherwise(F.array(F.lit(False)))
    marks = F.zip_with(parts, F.concat(before, found), lambda p, valid: F.concat(F.when(valid, F.lit(CARD_HERE)).otherwise(""), p))
    return F.when(text.rlike(r"\d(?:[ -]?\d){12}"), F.array_join(marks, "")).otherwise(text)


#: The days of one Gregorian cycle, 146,097 = 189 * 773, from this day on.
FIRST_DAY, DAYS_HIGH, DAYS_LOW = "1800-03-01", 189, 773


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _round_value(key: Column | str, kind: str, number: Column, other: Column) -> Column:
    """60 bits that depend on the key, the kind of value, the round and the other half."""
    secret = key if isinstance(key, Column) else F.lit(key)
    digest = F.sha2(F.concat_ws("|", secret, F.lit(kind), number.cast("string"), other.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(key: Column | str, kind: str, high: Column, low: Column, highs: Column, lows: Column) -> Column:
    """The permutation of all pairs of ``high`` below ``highs`` and ``low`` below ``lows``."""

    def step(state: Column, number: Column) -> Column:
        odd = number % 2 == 1
        x, y = state.getField("x"), state.getField("y")
        return F.struct(
            F.when(odd, F.pmod(x + _round_value(key, kind, number, y), highs)).otherwise(x).alias("x"),
            F.when(odd, y).otherwise(F.pmod(y + _round_value(key, kind, number, x), lows)).alias("y"),
        )

    start = F.struct(high.cast("long").alias("x"), low.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def permuted_digits(key: Column | str, kind: str, digits: Column) -> Column:
    """A string of 2 to 20 digits, permuted among those of its length."""
    tens = lambda k: F.pow(F.lit(10.0), k).cast("long")

    def moved(halves: Column) -> Column:
        x, y = halves.getField("x"), halves.getField("y")
        left, right = F.char_length(x), F.char_length(y)
        state = let(F.struct(tens(left).alias("x"), tens(right).alias("y")), lambda most: feistel(key, kind, x, y, most.getField("x"), most.getField("y")))
        return let(state, lambda s: F.concat(F.lpad(s.getField("x").cast("string"), left, "0"), F.lpad(s.getField("y").cast("string"), right, "0")))

    def halved(whole: Column) -> Column:
        left = F.floor(F.char_length(whole) / 2).cast("int")
        return F.struct(F.substring(whole, F.lit(1), left).alias("x"), F.substring(whole, left + 1, F.char_length(whole)).alias("y"))

    return let(let(digits, halved), moved)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _with_digits(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, one by one, by those of ``digits``."""
    chars = F.regexp_extract_all(value, F.lit(r"(?s)."), F.lit(0))
    new = F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0))

    def step(state: Column, char: Column) -> Column:
        digit = char.between("0", "9")
        out, at, new = state.getField("out"), state.getField("at"), state.getField("new")
        return F.struct(
            F.concat(out, F.when(digit, F.element_at(new, at)).otherwise(char)).alias("out"),
            F.when(digit, at + 1).otherwise(at).alias("at"),
            new.alias("new"),
        )

    # The new digits travel in the state: an expression inside the steps would be computed again for each character.
    return F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(1).alias("at"), new.alias("new")), step, lambda s: s.getField("out"))


def luhn_digit(payload: Column) -> Column:
    """The check digit for a string of digits, as a string."""

    def step(state: Column, digit: Column) -> Column:
        # From the last digit on every other one is doubled, and the digits of what it gives are added.
        number, odd = digit.cast("int"), state.getField("odd")
        value = number * F.when(odd, 2).otherwise(1) - F.when(odd & (number > 4), 9).otherwise(0)
        return F.struct((state.getField("total") + value).alias("total"), (~odd).alias("odd"))

    digits = F.regexp_extract_all(F.reverse(payload), F.lit("[0-9]"), F.lit(0))
    start = F.struct(F.lit(0).alias("total"), F.lit(True).alias("odd"))
    return F.aggregate(digits, start, step, lambda s: F.pmod(10 - s.getField("total") % 10, F.lit(10)).cast("string"))


def _has_luhn_digit(digits: Column) -> Column:
    return luhn_digit(F.substring(digits, F.lit(1), F.char_length(digits) - 1)) == F.substring(digits, -1, 1)


def _card(key: Column | str, value: Column) -> Column:
    def swap(digits: Column) -> Column:
        payload = F.substring(digits, F.lit(1), F.char_length(digits) - 1)
        valid = _has_luhn_digit(digits)
        first = F.substring(digits, 1, 1)
        moved = F.concat(first, permuted_digits(key, "card", F.substring(payload, F.lit(2), F.char_length(payload) - 1)))
        return F.when(valid, _with_digits(value, let(moved, lambda p: F.concat(p, luhn_digit(p))))).otherwise(value)

    return let(_digits(value), swap)


def _ip(key: Column | str, value: Column) -> Column:
    def swap(parts: Column) -> Column:
        number = lambda i: F.element_at(parts, i).cast("int")
        valid = F.forall(parts, lambda p: p.cast("int") <= 255)
        state = feistel(key, "ip", number(1) * 256 + number(2), number(3) * 256 + number(4), F.lit(65536), F.lit(65536))
        text = lambda s: F.concat_ws(".", *[f(s.getField(h)).cast("string") for h in "xy" for f in (lambda v: F.shiftright(v, 8), lambda v: v % 256)])
        return F.when(valid, let(state, text)).otherwise(value)

    return let(F.split(value, r"\."), swap)


def _ssn(key: Column | str, value: Column) -> Column:
    def swap(digits: Column) -> Column:
        area, group, serial = (F.substring(digits, a, n).cast("int") for a, n in ((1, 3), (4, 2), (6, 4)))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        state = feistel(
            key, "ssn", area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999)
        )

        def text(s: Column) -> Column:
            x, y = s.getField("x"), s.getField("y")
            new_area = x + F.when(x >= 665, 2).otherwise(1)
            return F.format_string("%03d-%02d-%04d", new_area, F.floor(y / 9999) + 1, y % 9999 + 1)

        return F.when(valid, let(state, text)).otherwise(value)

    return let(_digits(value), swap)


def _phone(key: Column | str, value: Column) -> Column:
    def swap(digits: Column) -> Column:
        n = F.char_length(digits)
        plus, plain = F.startswith(value, F.lit("+")), value.rlike(r"^\d{3}[ .-]\d{3}[ .-]\d{4}$")
        trunk = ~plain & F.startswith(value, F.lit("0"))
        valid = F.when(plus, n.between(8, 15)).when(trunk, n.between(9, 12)).otherwise(n.between(10, 15))
        last = F.when(trunk | (n < 10), n - 1).otherwise(10).cast("int")
        moved = F.concat(F.substring(digits, F.lit(1), n - last), permuted_digits(key, "phone", F.substring(digits, n - last + 1, last)))
        return F.when(valid, _with_digits(value, moved)).otherwise(value)

    return let(_digits(value), swap)


def permuted_day(key: Column | str, day: Column) -> Column:
    """Another day of the same Gregorian cycle; null outside it."""
    number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    state = feistel(key, "date", F.floor(number / DAYS_LOW), number % DAYS_LOW, F.lit(DAYS_HIGH), F.lit(DAYS_LOW))
    moved = let(state, lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s.getField("x") * DAYS_LOW + s.getField("y")).cast("int")))
    return F.when(number.between(0, DAYS_HIGH * DAYS_LOW - 1), moved)


def _date(key: Column | str, value: Column) -> Column:
    """ISO notation, or day.month.year with month/day/year where only that is a date."""
    parts = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))

    def as_day(year: Column, month: Column, day: Column) -> Column:
        return F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")

    def swap(p: Column) -> Column:
        a, b, c = (F.element_at(p, i) for i in (1, 2, 3))
        iso = F.char_length(a) == 4
        separator = F.regexp_extract(value, "([^0-9])", 1)
        day_first = F.when(~iso, as_day(c, b, a))
        month_first = F.when(~iso & day_first.isNull(), as_day(c, a, b))
        day = F.coalesce(F.when(iso, as_day(a, b, c)), day_first, month_first)

        def text(d: Column) -> Column:
            year, month, dom = (f(d).cast("int") for f in (F.year, F.month, F.dayofmonth))
            y, m, dd = F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(dom.cast("string"), 2, "0")
            return (
                F.when(iso, F.concat(y, separator, m, separator, dd))
                .when(day_first.isNotNull(), F.concat(dd, separator, m, separator, y))
                .otherwise(F.concat(m, separator, dd, separator, y))
            )

        return F.coalesce(let(permuted_day(key, day), text), value)

    return let(parts, swap)


def _named_date(key: Column | str, value: Column) -> Column:
    """Day and month name in their order, the name as long or as short as it was."""
    name = F.regexp_extract(value, MONTH, 0)
    number = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.substring(name, 1, 3))
    year, dom = F.regexp_extract(value, r"(\d{4})$", 1), F.regexp_extract(value, r"(?<!\d)(\d{1,2})(?!\d)", 1)
    day = F.try_to_timestamp(F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(dom, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")

    def text(d: Column) -> Column:
        full = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(d))
        month = F.when((F.char_length(name) == 3) & (name != "May"), F.substring(full, 1, 3)).otherwise(full)
        new_dom, new_year = F.dayofmonth(d).cast("string"), F.lpad(F.year(d).cast("string"), 4, "0")
        comma = F.when(F.contains(value, F.lit(",")), ", ").otherwise(" ")
        return F.when(value.rlike(r"^\d"), F.concat(new_dom, F.lit(" "), month, comma, new_year)).otherwise(
            F.concat(month, F.lit(" "), new_dom, comma, new_year)
        )

    return F.coalesce(let(permuted_day(key, day), text), value)


def _email(key: Column | str, value: Column) -> Column:
    """A Feistel network over the halves of the name, character by character within its class."""
    name, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    # First code and number of each class: digits, ASCII letters, letters of Latin-1 and Latin Extended-A
    # (without the signs among them), Greek and Cyrillic.
    classes = ((48, 10), (65, 26), (97, 26), (192, 23), (216, 31), (248, 8), (256, 128), (945, 25), (1040, 32), (1072, 32))

    def moved(half: Column, other: Column, number: Column) -> Column:
        def one(char: Column, at: Column) -> Column:
            code = F.ascii(char)
            shift = _round_value(key, "email", F.concat_ws(",", number, at), other)
            found = char
            for first, size in classes:
                inside = code.between(first, first + size - 1)
                found = F.when(inside, _character(F.pmod(code - first + shift, F.lit(size)) + first)).otherwise(found)
            return found

        return F.array_join(F.transform(F.regexp_extract_all(half, F.lit("(?s)."), F.lit(0)), one), "")

    def step(state: Column, number: Column) -> Column:
        x, y = state.getField("x"), state.getField("y")
        odd = number % 2 == 1
        return F.struct(F.when(odd, moved(x, y, number)).otherwise(x).alias("x"), F.when(odd, y).otherwise(moved(y, x, number)).alias("y"))

    half = F.floor(F.char_length(name) / 2).cast("int")
    start = F.struct(F.substring(name, F.lit(1), half).alias("x"), F.substring(name, half + 1, F.char_length(name)).alias("y"))
    return let(
        F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step),
        lambda s: F.concat(s.getField("x"), s.getField("y"), F.lit("@"), host),
    )


def _character(code: Column) -> Column:
    """The character of a code point below 2,048."""
    two = F.unhex(F.lpad(F.hex((49280 + F.floor(code / 64) * 256 + code % 64).cast("long")), 4, "0"))
    return F.when(code < 128, F.chr(code.cast("long"))).otherwise(F.decode(two, "UTF-8"))


def _remainder_97(text: Column) -> Column:
    """The remainder of a string of digits and capital letters (A is 10) as ISO 7064 takes it."""

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code < 65, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.regexp_extract_all(text, F.lit("."), F.lit(0)), F.lit(0), step)


def _iban(key: Column | str, value: Column) -> Column:
    def swap(plain: Column) -> Column:
        country, rest = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.char_length(plain))
        valid = F.char_length(plain).between(15, 34) & (_remainder_97(F.concat(rest, F.substring(plain, 1, 4))) == 1)
        digits = _digits(rest)
        last = F.least(F.char_length(digits), F.lit(18))
        kept = F.char_length(digits) - last
        moved = F.concat(F.substring(digits, F.lit(1), kept), permuted_digits(key, "iban", F.substring(digits, kept + 1, last)))

        def with_check(body: Column) -> Column:
            check = F.lpad((98 - _remainder_97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
            return _with_digits(value, F.concat(check, _digits(body)))

        return F.when(valid & (F.char_length(digits) >= 2), let(_with_digits(rest, moved), with_check)).otherwise(value)

    return let(F.replace(value, F.lit(" "), F.lit("")), swap)


def pseudonym(key: Column | str, value: Column) -> Column:
    """The pseudonym of one candidate value, or the value itself where it is not valid."""
    whole = lambda pattern: value.rlike(f"^(?:{pattern})$")
    return (
        F.when(F.contains(value, F.lit("@")), _email(key, value))
        .when(whole(r"\d{1,3}(?:\.\d{1,3}){3}"), _ip(key, value))
        .when(whole(r"\d{4}[-/.]\d{2}[-/.]\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4}"), _date(key, value))
        .when(whole(IBAN), _iban(key, value))
        .when(value.rlike("[A-Z]"), _named_date(key, value))
        .when(whole(r"\d{3}-\d{2}-\d{4}"), _ssn(key, value))
        .when(whole(CARD), _card(key, value))
        .otherwise(_phone(key, value))
    )


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, text, n_candidates, n_replaced``."""
    if not key:
        raise ValueError("pseudonyms need a key")
    secret = docs.sparkSession.sql("SELECT secret FROM VALUES (:key) AS given(secret)", args={"key": key})
    worth = F.col("text").rlike(r"[0-9]|@")
    escaped = F.replace(F.col("text"), F.lit(ESCAPE), F.lit(ITSELF))
    marked = F.replace(F.regexp_replace(with_card_marks(escaped), CANDIDATE, VALUE + "$0" + VALUE), F.lit(CARD_HERE), F.lit(""))
    # Gaps and values take turns, a gap first and last.
    parts = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .withColumn("secret", secret.scalar())
        .withColumn("parts", F.when(worth, F.split(marked, VALUE, -1)))
        .withColumn("swapped", F.transform("parts", lambda v, i: F.when(i % 2 == 1, pseudonym(F.col("secret"), v)).otherwise(v)))
    )
    some = F.size("parts") > 1
    joined = F.replace(F.array_join("swapped", ""), F.lit(ITSELF), F.lit(ESCAPE))
    changed = F.size(F.filter(F.zip_with("parts", "swapped", lambda a, b: a != b), lambda x: x))
    return parts.select(
        "doc_id",
        F.when(some, joined).otherwise(F.col("text")).alias("text"),
        F.when(some, F.floor(F.size("parts") / 2)).otherwise(0).cast("long").alias("n_candidates"),
        F.when(some, changed).otherwise(0).cast("long").alias("n_replaced"),
    )
