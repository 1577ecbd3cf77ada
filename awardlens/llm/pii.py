"""Format-preserving pseudonyms for personal data, in DataFrame operations alone.

Validated numbers (payment cards, phone numbers, social security numbers, IPv4 addresses) and dates are permuted within
their format by a keyed Feistel network: a card becomes another card with a right check digit, a date another date of the
same layout. The permutation depends on key, kind and value only, so equal values stay linked across documents, and who
holds the key can reverse it. E-mail addresses have no fixed format to permute in; they become keyed digests.

A value is split into two numbers l < a and r < b; rounds add a keyed hash of one to the other, modulo a or b in turn,
which is a bijection for any a and b.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8
MARK, ESCAPE = "\u0001\u0002", "\u0001\u0003"

#: The formats. Dates are within 1900-2099; phone numbers have ten digits, grouped 3-3-4.
#: Groups are repeated a bounded number of times (a domain has 127 labels at most): the JVM matches each repetition of a
#: group one call deeper, so that an unbounded one would overflow the stack on long texts.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,24}"
IPV4 = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)"
SSN = r"(?<![\w-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])"
PHONE = r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"
ISO_DATE = r"(?<![\w/-])(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\w-])"
SLASH_DATE = r"(?<![\w/-])\d{2}/\d{2}/(?:19|20)\d{2}(?![\w/])"
DOT_DATE = r"(?<![\w.])\d{2}\.\d{2}\.(?:19|20)\d{2}(?!\w|\.\d)"
CARD = r"(?<![\w])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\w)"
ANY = "|".join((EMAIL, IPV4, SSN, PHONE, ISO_DATE, SLASH_DATE, DOT_DATE, CARD))
DAYS = 73049  # 1900-01-01 to 2099-12-31; 319 * 229 is the next product of two like factors
DAY_FACTORS = (319, 229)
MOST_STEPS = 80  # of a walk to a day above 12; 0.4 to the 80th is 1e-32


def feistel(kind: str, left: Column, right: Column, a: Column | int, b: Column | int, key: str, inverse: bool = False, rounds: int = ROUNDS) -> Column:
    """A struct (l, r): the pair (left, right), left < a and right < b, permuted under key and kind, or back."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))

    def turn(x: Column, i: Column, other: Column, n: Column) -> Column:
        digest = F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), i.cast("string"), other.cast("string")), 256), 1, 15)
        h = F.conv(digest, 16, 10).cast("long") % n
        return F.pmod(x - h if inverse else x + h, n).cast("long")

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, turn(acc["l"], i, acc["r"], a)).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(turn(acc["r"], i, acc["l"], b)).alias("r"))

    order = F.sequence(F.lit(rounds - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(rounds - 1))
    return F.aggregate(order, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _let(value: Column, then) -> Column:
    """``then(value)`` with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(value: Column, digits: Column) -> Column:
    """value with its digits replaced, in order, by those given; all else stays in place."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(acc["out"], F.when(digit, F.substr(digits, acc["k"], F.lit(1))).otherwise(c)).alias("out"), (acc["k"] + F.when(digit, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.split(value, ""), start, step, lambda acc: acc["out"])


def _pad(n: Column, width: Column | int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a number whose last digit is its check digit."""
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        double = (n - i) % 2 == 1
        return acc + F.when(double, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step)


def _card(value: Column, key: str, inverse: bool) -> Column:
    def permuted(d: Column) -> Column:
        n = F.length(d)
        half = F.floor((n - 2) / 2).cast("int")
        ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
        body = feistel("card", F.substr(d, F.lit(2), half).cast("long"), F.substr(d, half + 2, n - 2 - half).cast("long"), ten(half), ten(n - 2 - half), key, inverse)

        def checked(x: Column) -> Column:
            front = F.concat(F.substr(d, F.lit(1), F.lit(1)), _pad(x["l"], half), _pad(x["r"], n - 2 - half))
            return _let(front, lambda f: F.concat(f, ((10 - luhn_sum(F.concat(f, F.lit("0"))) % 10) % 10).cast("string")))

        return F.when(luhn_sum(d) % 10 == 0, _refill(value, _let(body, checked))).otherwise(value)

    return _let(_digits(value), permuted)


def _phone(value: Column, key: str, inverse: bool) -> Column:
    """Area and exchange codes begin with 2 to 9; each stays on its side of 200, so that a number in use becomes another such number."""

    def permuted(d: Column) -> Column:
        body = F.right(d, F.lit(10))
        area, exchange = (F.substr(body, F.lit(k), F.lit(3)).cast("long") for k in (1, 4))
        least, many = (lambda code, x=x: F.when(code >= 200, x[0]).otherwise(x[1]) for x in ((200, 0), (800, 200)))
        code = (area - least(area)) * many(exchange) + exchange - least(exchange)
        new = feistel("phone", code, F.substr(body, F.lit(7), F.lit(4)).cast("long"), many(area) * many(exchange), F.lit(10_000), key, inverse)
        back = lambda x: F.concat(_pad(F.floor(x["l"] / many(exchange)) + least(area), 3), _pad(x["l"] % many(exchange) + least(exchange), 3))
        return _refill(value, _let(new, lambda x: F.concat(F.substr(d, F.lit(1), F.length(d) - 10), back(x), _pad(x["r"], 4))))

    return _let(_digits(value), permuted)


def _ssn(value: Column, key: str, inverse: bool) -> Column:
    def permuted(d: Column) -> Column:
        area = F.substr(d, F.lit(1), F.lit(3)).cast("long")
        left = (area - F.when(area > 666, 2).otherwise(1)) * 99 + F.substr(d, F.lit(4), F.lit(2)).cast("long") - 1
        new = feistel("ssn", left, F.substr(d, F.lit(6), F.lit(4)).cast("long") - 1, 898 * 99, 9999, key, inverse)

        def back(x: Column) -> Column:
            area = F.floor(x["l"] / 99) + 1
            return F.concat(_pad(F.when(area >= 666, area + 1).otherwise(area), 3), _pad(x["l"] % 99 + 1, 2), _pad(x["r"] + 1, 4))

        return _refill(value, _let(new, back))

    return _let(_digits(value), permuted)


def _ipv4(value: Column, key: str, inverse: bool) -> Column:
    def permuted(o: Column) -> Column:
        part = lambda i: F.element_at(o, i).cast("long")
        new = feistel("ipv4", part(1) * 256 + part(2), part(3) * 256 + part(4), 65536, 65536, key, inverse)
        return _let(new, lambda x: F.concat_ws(".", *[y.cast("string") for y in (F.floor(x["l"] / 256), x["l"] % 256, F.floor(x["r"] / 256), x["r"] % 256)]))

    return _let(F.split(value, r"\."), permuted)


def _day(date: Column, key: str, inverse: bool, day_first: bool) -> Column:
    """A date permuted within 1900-2099, or within the days above 12 of these (``day_first``).

    The network covers two numbers more; from those, and from days that aren't meant, it walks on to the next. Two in five
    days are 12 and below: no walk is ``MOST_STEPS`` long.
    """
    a, b = DAY_FACTORS
    since = F.lit("1900-01-01").cast("date")

    def walk(x: Column, _i: Column) -> Column:
        new = feistel("date", F.floor(x / b), x % b, a, b, key, inverse)
        outside = (x >= DAYS) | (F.dayofmonth(F.date_add(since, x.cast("int"))) <= 12) if day_first else x >= DAYS
        return F.when((_i == 0) | outside, _let(new, lambda y: (y["l"] * b + y["r"]).cast("long"))).otherwise(x)

    start = F.datediff(date, since).cast("long")
    return F.date_add(since, F.aggregate(F.sequence(F.lit(0), F.lit(MOST_STEPS if day_first else 2)), start, walk).cast("int"))


def _date(value: Column, layout: str, key: str, inverse: bool, day_first: bool = False) -> Column:
    parsed = F.try_to_date(value, layout)
    return F.when(parsed.isNotNull(), F.date_format(_day(parsed, key, inverse, day_first), layout))


def _email(value: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), F.lower(value)), 256), 1, 16), F.lit("@redacted.invalid"))


def pseudonym(value: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of one value that :data:`ANY` matched; values that fail their validation stay."""
    whole = lambda pattern: value.rlike(f"^(?:{pattern})$")
    slash = F.coalesce(_date(value, "MM/dd/yyyy", key, inverse), _date(value, "dd/MM/yyyy", key, inverse, day_first=True), value)
    return (
        F.when(value.contains("@"), value if inverse else _email(value, key))
        .when(whole(IPV4), _ipv4(value, key, inverse))
        .when(whole(SSN), _ssn(value, key, inverse))
        .when(whole(PHONE), _phone(value, key, inverse))
        .when(whole(ISO_DATE), F.coalesce(_date(value, "yyyy-MM-dd", key, inverse), value))
        .when(whole(SLASH_DATE), slash)
        .when(whole(DOT_DATE), F.coalesce(_date(value, "dd.MM.yyyy", key, inverse), value))
        .otherwise(_card(value, key, inverse))
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", inverse: bool = False) -> DataFrame:
    """``docs`` with its text pseudonymised and a column pii_values: how many values were replaced.

    ``key`` is the caller's secret; there is none by default, as whoever knows it can reverse the pseudonyms.
    Rows and their other columns stay, whatever they are called; a column named pii_values is replaced. A null text stays
    null with 0 values, an empty one empty. Texts may be of any length; repeated rows get equal results, an empty table
    an empty one. Any text may hold the marker characters used inside; they come back unchanged. Numbers that fail
    their check (Luhn, calendar, octets) are no personal data here and stay. ``inverse`` brings permuted values back;
    e-mail digests can't be reversed. A slashed date is month first where it can be; those that are only valid day first are
    permuted among themselves, so that different texts stay different and each is read back by its own layout.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    keep = [c for c in docs.columns if c != "pii_values"]
    parts, fresh_parts = fresh(keep, "pii_parts", "pii_new")
    text = F.col(f"`{text_col}`")
    marked = F.regexp_replace(F.regexp_replace(text, "\u0001", ESCAPE), ANY, f"{MARK}$0{MARK}")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.when(text.rlike("[0-9@]"), F.split(marked, MARK)).alias(parts))
    found = F.size(parts) > 1
    rows = rows.withColumn(fresh_parts, F.when(found, F.transform(parts, lambda s, i: F.when(i % 2 == 1, pseudonym(s, key, inverse)).otherwise(s))))
    changed = F.size(F.filter(F.zip_with(parts, fresh_parts, lambda x, y: x != y), lambda x: x))
    new = F.regexp_replace(F.array_join(fresh_parts, ""), ESCAPE, "\u0001")
    return rows.select(*[F.when(found, new).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in keep], F.when(found, changed).otherwise(0).cast("long").alias("pii_values"))
