"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers and dates that pass their kind's test are permuted by a keyed Feistel network within their format, so that equal
values get equal pseudonyms in every document and different values stay different. Kinds, tried in this order:

* e-mail: the local part's letters among letters and digits among digits, place by place, case kept; the domain stays.
* IBAN (two letters, two check digits, 11 to 30 more; mod 97 = 1): the digits after the bank's letters are permuted, check digits renewed.
* payment card (13 to 19 digits, blanks or hyphens between; Luhn): all but the check digit are permuted, which is renewed.
* account number (16 digits that fail Luhn; validated by their number): likewise, keeping the Luhn sum, so that none becomes a card.
* phone (``+`` country code and 7 to 14 more digits; or 3-3-4 digits with separators): digits after the country code.
* IPv4 address: its 32 bits.
* social security number 3-2-4 with a valid area, group and serial: its place among all valid ones.
* date (1900-2099, year first, or day and month first with ``/`` or ``.``; in the calendar): among the dates that are written
  alike, with the same order of the parts, widths and separators; leap days among leap days. A date in which both orders
  are possible is read day first, before and after. One date in two notations has two pseudonyms.

Every character between digits stays where it is. A value that fails its test is left as it is.

Rounds are alternating: with x = (a, b) in Z_m x Z_n, a += F(b) mod m, then b += F(a) mod n; F is the first 15 hex digits
of SHA-256 over key, kind, format, round and the other half. Each round is a bijection, and so is the whole.

Defined cases: null text stays null and empty text empty; other columns, and extra ones, pass through; overlapping
candidates are read from left to right. n_chars, where the table has it, is the new text's length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The key is a parameter; this one is for tests.
KEY = "not-a-secret"
ROUNDS = 8

# Candidates: one pattern whose alternatives start by what tells the kinds apart. None tries a long run from each of its places.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
DATE = r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.][0-9]{1,2}[/.](?:19|20)[0-9]{2})(?![0-9]|[./-][0-9])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])"
PHONE = r"\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}(?![0-9])|(?<![0-9(])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])(?:[0-9][ -]?){12,18}[0-9](?![0-9])"
CANDIDATE = "|".join((EMAIL, IBAN, DATE, IPV4, SSN, PHONE, CARD))
#: Every candidate has an @, or a digit and another one after at most a separator and a bracket; a text without is left as it is.
GATE = r"@|[0-9][ .-]?\(?[0-9]|[0-9]\)[ .-]?\(?[0-9]"


def _prf(key: str, tag: Column, i: int, half: Column) -> Column:
    """A number of 60 bits from the key, the format, the round and the other half."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}|"), tag, F.lit(f"|{i}|"), half.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, m: Column, n: Column, tag: Column, key: str, rounds: int = ROUNDS) -> tuple[Column, Column]:
    """The permutation of Z_m x Z_n, for moduli under 2^60."""
    # steps are kept as array entries, so that an expression isn't repeated for each time it is used
    def step(i: int):
        # a lambda of one parameter: a second one would be the entry's index
        if i % 2:
            return lambda s: F.array(s[0], F.pmod(s[1] + F.pmod(_prf(key, tag, i, s[0]), n), n))
        return lambda s: F.array(F.pmod(s[0] + F.pmod(_prf(key, tag, i, s[1]), m), m), s[1])

    state = F.array(a, b)
    for i in range(rounds):
        state = _let(state, step(i))
    return state[0], state[1]


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.transform(F.array(value), f)[0]


def digits_permuted(d: Column, kind: str, key: str) -> Column:
    """A string of 2 to 34 digits, permuted within its length."""

    def run(s: Column) -> Column:
        left = F.floor(F.length(s) / 2).cast("int")
        a, b = F.substring(s, F.lit(1), left), F.substr(s, left + 1)
        m, n = F.pow(F.lit(10.0), left).cast("long"), F.pow(F.lit(10.0), F.length(s) - left).cast("long")
        pair = F.array(*feistel(a.cast("long"), b.cast("long"), m, n, F.concat(F.lit(f"{kind}|"), F.length(s).cast("string")), key))
        return _let(pair, lambda p: F.concat(F.lpad(p[0].cast("string"), left, "0"), F.lpad(p[1].cast("string"), F.length(s) - left, "0")))

    return F.when(F.length(d) < 2, d).otherwise(_let(d, run))


def refill(shape: Column, new: Column, what: str = "[0-9]") -> Column:
    """``shape`` with its i-th character of the kind ``what`` replaced by the i-th of ``new``."""
    gaps = F.split(shape, what, -1)
    return F.array_join(F.zip_with(gaps, F.split(new, "", -1), lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")


def luhn(d: Column) -> Column:
    """The Luhn sum of a string of digits, the last of which counts once, mod 10."""
    each = F.transform(F.split(F.reverse(d), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10


def mod97(iban: Column) -> Column:
    """An IBAN's remainder, without blanks: the first four characters moved to the end, letters as numbers from 10."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    numbers = F.transform(F.split(moved, ""), lambda x: F.when(x.rlike("[0-9]"), x.cast("int")).otherwise(F.ascii(x) - 55))
    return F.aggregate(numbers, F.lit(0), lambda s, x: F.when(x > 9, s * 100 + x).otherwise(s * 10 + x) % 97)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def card(x: Column, key: str) -> Column:
    def run(d: Column) -> Column:
        def renewed(body: Column) -> Column:
            return F.concat(body, F.pmod(F.lit(10) - luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))

        body = F.substr(d, F.lit(1), F.length(d) - 1)
        rest = luhn(d)
        account = lambda new: _let(rest, lambda r: F.concat(new, F.pmod(F.lit(10) - luhn(F.concat(new, F.lit("0"))) + r, F.lit(10)).cast("string")))
        return F.when(rest == 0, refill(x, _let(digits_permuted(body, "card", key), renewed))).when(F.length(d) == 16, refill(x, _let(digits_permuted(body, "account", key), account))).otherwise(x)

    return _let(_digits(x), run)


def phone(x: Column, key: str) -> Column:
    code = F.regexp_extract(x, r"^\+[0-9]{1,3}(?=[^0-9])|^\+(?:1|7|[2-9][0-9])", 0)
    rest = F.substr(x, F.length(code) + 1)
    return F.when(_digits(rest).rlike("^[0-9]{7,14}$"), F.concat(code, refill(rest, digits_permuted(_digits(rest), "phone", key)))).otherwise(x)


# Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999: fixed bounds of valid numbers.
_AREAS, _NO_AREA, _SERIALS, _RESTS = 898, 666, 9999, 99 * 9999


def ssn(x: Column, key: str) -> Column:
    """The number's place among all valid ones is permuted, as area and rest, so that a valid number always has a valid one."""

    def run(d: Column) -> Column:
        number = lambda at, n: F.substring(d, at, n).cast("long")
        area = number(1, 3) - 1 - F.when(number(1, 3) > _NO_AREA, 1).otherwise(0)
        rest = (number(4, 2) - 1) * _SERIALS + number(6, 4) - 1
        return _let(F.array(*feistel(area, rest, F.lit(_AREAS), F.lit(_RESTS), F.lit("ssn"), key)), lambda h: F.concat_ws("-", *written(h[0] + 1, h[1])))

    def written(area: Column, rest: Column) -> tuple[Column, ...]:
        parts = ((area + F.when(area >= _NO_AREA, 1).otherwise(0), 3), (F.floor(rest / _SERIALS) + 1, 2), (rest % _SERIALS + 1, 4))
        return tuple(F.lpad(v.cast("string"), n, "0") for v, n in parts)

    return F.when(x.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), _let(_digits(x), run)).otherwise(x)


def ipv4(x: Column, key: str) -> Column:
    def run(p: Column) -> Column:
        n = lambda i: p[i].cast("long")
        new = _let(F.array(*feistel(n(0) * 256 + n(1), n(2) * 256 + n(3), F.lit(65536), F.lit(65536), F.lit("ipv4"), key)), lambda h: F.concat_ws(".", *(F.floor(h[0] / 256).cast("string"), (h[0] % 256).cast("string"), F.floor(h[1] / 256).cast("string"), (h[1] % 256).cast("string"))))
        return F.when(F.forall(p, lambda y: y.cast("int") <= 255), new).otherwise(x)

    return _let(F.split(x, r"\."), run)


def _days(kind: str) -> str:
    """Month and day, as four digits each, of the dates of a kind: "i" year first, "d" day first, "m" month first (the day is over 12); then widths of the parts."""
    found = []
    for month, last in enumerate((31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31), 1):
        for day in range(1, last + 1):
            parts = {"i": (), "d": (day, month), "m": (month, day)}[kind[0]]
            if all(w == "2" or p < 10 for p, w in zip(parts, kind[1:], strict=False)) and (kind[0] != "m" or day > 12):
                found.append(f"{month:02}{day:02}")
    return " ".join(found)


_KINDS = ("i", "d11", "d12", "d21", "d22", "m12", "m22")
_YEARS, _FIRST, _FIRST_LEAP, _LEAPS = 200, 1900, 1904, 7  # 7 x 7 leap days


def date(x: Column, key: str) -> Column:
    def run(p: Column) -> Column:
        iso = F.length(p[0]) == 4
        swapped = ~iso & (p[1].cast("int") > 12)
        year, month, day = (F.when(iso, p[a]).otherwise(p[b]) for a, b in ((0, 2), (1, 1), (2, 0)))
        month, day = F.when(swapped, day).otherwise(month), F.when(swapped, month).otherwise(day)
        widths = F.concat(F.length(p[0]).cast("string"), F.length(p[1]).cast("string"))
        kind = F.when(iso, "i").otherwise(F.concat(F.when(swapped, "m").otherwise("d"), widths))
        state = F.struct(year.cast("long").alias("year"), F.concat(F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).alias("day"), kind.alias("kind"), iso.alias("iso"), swapped.alias("swapped"), p.alias("p"))
        value = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
        return F.when(value.isNotNull(), _let(state, moved)).otherwise(x)

    def moved(s: Column) -> Column:
        days = F.split(reduce(lambda other, k: F.when(s["kind"] == k, F.lit(_days(k))).otherwise(other), _KINDS, F.lit("")), " ")
        tag = F.concat(F.lit("date|"), s["kind"])
        leap = F.floor((s["year"] - _FIRST_LEAP) / 4).cast("long")
        year = _let(F.array(*feistel(F.floor(leap / _LEAPS).cast("long"), leap % _LEAPS, F.lit(_LEAPS), F.lit(_LEAPS), F.concat(tag, F.lit("|29")), key)), lambda h: _FIRST_LEAP + 4 * (h[0] * _LEAPS + h[1]))
        other = _let(days, lambda d: _let(F.array(*feistel(F.array_position(d, s["day"]) - 1, s["year"] - _FIRST, F.size(d).cast("long"), F.lit(_YEARS), tag, key)), lambda h: written(s, d[h[0].cast("int")], h[1] + _FIRST)))
        return F.when(s["day"] == "0229", _let(year, lambda y: written(s, s["day"], y))).otherwise(other)

    def written(s: Column, day: Column, year: Column) -> Column:
        month, day, p, year = F.substring(day, 1, 2), F.substring(day, 3, 2), s["p"], year.cast("string")
        one, two = F.when(s["swapped"], month).otherwise(day), F.when(s["swapped"], day).otherwise(month)
        part = lambda v, old: F.when(F.length(old) == 1, F.substring(v, 2, 1)).otherwise(v)
        separator = lambda at: F.substr(x, at, F.lit(1))
        short = F.concat(part(one, p[0]), separator(F.length(p[0]) + 1), part(two, p[1]), separator(F.length(p[0]) + F.length(p[1]) + 2), year)
        return F.when(s["iso"], F.concat_ws("-", year, month, day)).otherwise(short)

    return _let(F.split(x, "[-/.]"), run)


def iban(x: Column, key: str) -> Column:
    def run(v: Column) -> Column:
        body = F.substr(v, F.lit(5))
        new = refill(body, digits_permuted(F.substr(_digits(body), F.lit(1), F.lit(34)), "iban", key))
        done = _let(new, lambda b: F.concat(F.substring(v, 1, 2), F.lpad((F.lit(98) - mod97(F.concat(F.substring(v, 1, 2), F.lit("00"), b))).cast("string"), 2, "0"), b))
        return F.when((F.length(v) >= 15) & (F.length(v) <= 34) & (mod97(v) == 1), refill(x, done, "[A-Z0-9]")).otherwise(x)

    return _let(F.replace(x, F.lit(" "), F.lit("")), run)


def email(x: Column, key: str) -> Column:
    """The halves of the local part's letters and digits are shifted in turn, each place within its alphabet by a digit of a keyed hash of the other half."""
    local, domain = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)

    def shifted(half: Column, other: Column, shape: Column, i: int) -> Column:
        def run(hashed: Column) -> Column:
            def char(c: Column, at: Column) -> Column:
                by = F.conv(F.substr(hashed, at % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")
                letter = F.char(F.pmod(F.ascii(c) - 97 + by, F.lit(26)) + 97)
                return F.when(c.rlike("[0-9]"), F.pmod(c.cast("int") + by, F.lit(10)).cast("string")).otherwise(letter)

            return F.array_join(F.transform(F.split(half, ""), char), "")

        return F.when(F.length(half) == 0, half).otherwise(_let(F.sha2(F.concat(F.lit(f"{key}|email|"), shape, F.lit(f"|{i}|"), other), 256), run))

    def run(plain: Column) -> Column:
        shape = F.concat(F.regexp_replace(F.regexp_replace(plain, "[a-z]", "a"), "[0-9]", "0"), F.lit("|"), F.lower(domain))
        left = F.floor(F.length(plain) / 2).cast("int")

        def step(i: int):
            return (lambda s: F.array(s[0], shifted(s[1], s[0], shape, i))) if i % 2 else (lambda s: F.array(shifted(s[0], s[1], shape, i), s[1]))

        state = F.array(F.substring(plain, F.lit(1), left), F.substr(plain, left + 1))
        for i in range(ROUNDS):
            state = _let(state, step(i))
        return _let(state, lambda s: F.concat(s[0], s[1]))

    new = F.split(refill(local, _let(F.regexp_replace(F.lower(local), "[^a-z0-9]", ""), run), "[A-Za-z0-9]"), "")
    return F.concat(F.array_join(F.zip_with(F.split(local, ""), new, lambda old, c: F.when(old.rlike("[A-Z]"), F.upper(c)).otherwise(c)), ""), F.lit("@"), domain)


def pseudonym(x: Column, key: str) -> Column:
    """A candidate's pseudonym, by the first kind whose pattern it has."""
    kinds = ((EMAIL, email), (IBAN, iban), (DATE, date), (IPV4, ipv4), (SSN, ssn), (PHONE, phone), (CARD, card))
    whole = lambda p: f"^(?:{p})$"
    return reduce(lambda otherwise, kind: F.when(x.rlike(whole(kind[0])), kind[1](x, key)).otherwise(otherwise), reversed(kinds), x)


def replaced(text: Column, key: str = KEY) -> Column:
    """``text`` with every candidate replaced."""
    gaps, found = F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    joined = F.array_join(F.zip_with(gaps, F.transform(found, lambda x: pseudonym(x, key)), lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")
    return F.when(text.rlike(GATE), joined).otherwise(text)


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with the values in ``text`` replaced, in the same columns."""
    changed = {"text": replaced(F.col("text"), key)}
    out = docs.withColumns(changed)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def report(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text (null: null), changed (null where text is), n_candidates."""
    old = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", replaced(F.col("text"), key).alias("new"))
    return out.select("doc_id", F.col("new").alias("text"), (F.col("text") != F.col("new")).alias("changed"), F.coalesce(F.size(old), F.lit(0)).cast("long").alias("n_candidates"))
