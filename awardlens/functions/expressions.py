"""Column expressions of the award rules. All are built-in functions, so plans stay in generated code."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Award type codes and the descriptions that the data holds.
AWARD_TYPES = {"A": "BPA CALL", "B": "PURCHASE ORDER", "C": "DELIVERY ORDER", "D": "DEFINITIVE CONTRACT"}
SOLE_SOURCE = ("%NOT COMPETED%", "%NOT AVAILABLE%", "%SOLE SOURCE%")
FULL_AND_OPEN = "%FULL AND OPEN%"

EXPECTED_DIGITS = [math.log10(1 + 1 / d) for d in range(1, 10)]


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(value: Column | str) -> Column:
    """Null for null, empty and the text null."""
    v = column(value)
    return F.when(~v.isin("", "null"), v)


def award_date(value: Column | str) -> Column:
    """The date before a T, in ISO forms; anything else is null."""
    day = F.split(blank_to_null(value), "T").getItem(0)
    iso = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(day, "yyyy-MM-dd"))
    spaced = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2} "), F.try_to_date(F.substring(day, 1, 10), "yyyy-MM-dd"))
    return F.coalesce(iso, spaced, F.when(day.rlike(r"^\d{8}$"), F.try_to_date(day, "yyyyMMdd")))


def entity_date(value: Column | str) -> Column:
    """The date before a T, year first with dashes or month first with slashes; anything else is null."""
    day = F.split(blank_to_null(value), "T").getItem(0)
    return F.coalesce(F.when(day.rlike(r"^\d{4}-"), F.try_to_date(day, "yyyy-M-d")), F.try_to_date(day, "M/d/yyyy"))


def number(value: Column | str) -> Column:
    return blank_to_null(value).try_cast("double")


def whole_number(value: Column | str) -> Column:
    """Texts with characters that no whole number has are null without a cast, as each failed one raises an error within Spark."""
    text = blank_to_null(value)
    return F.when(~text.rlike(r"[^0-9+\-\x00-\x20\x7F]"), text.try_cast("int"))


def business_types(items: Column | str) -> Column:
    """Descriptions, or codes where there is none, joined by commas; null if there are none."""
    names = F.transform(column(items), lambda x: F.coalesce(F.nullif(x["businessTypeDesc"], F.lit("")), F.nullif(x["businessTypeCode"], F.lit(""))))
    return F.nullif(F.concat_ws(", ", F.filter(names, lambda n: n.isNotNull())), F.lit(""))


def leading_digit(amount: Column | str) -> Column:
    """First significant digit after rounding to ten digits; null for null, not positive, infinite or NaN.

    Away from whole multiples of a power of ten, and from the ends of the range, a product gives it; only the rest is formatted,
    which takes many times as long.
    """
    x = column(amount)
    lead = x * F.pow(F.lit(10.0), -F.floor(F.log10(x)))
    sure = x.between(1e-290, 1e290) & (lead > 1) & (lead < 10) & (lead - F.floor(lead)).between(1e-8, 1 - 1e-8)
    written = F.substring(F.format_string("%.9e", x), 1, 1).try_cast("int")
    return F.when((x > 0) & ~F.isnan(x) & (x != float("inf")), F.when(sure, F.floor(lead).cast("int")).otherwise(written))


def deviation(counts: Sequence[Column], n: Column) -> Column:
    """The largest gap between the cumulative shares of digits 1-9 and the expected ones."""
    gaps, seen, expected = [], F.lit(0), 0.0
    for count, share in zip(counts, EXPECTED_DIGITS, strict=True):
        seen, expected = seen + count, expected + share
        gaps.append(F.abs(seen / n - F.lit(expected)))
    return F.greatest(*gaps)


def kolmogorov_survival(x: Column) -> Column:
    """P(K > x) of the limiting Kolmogorov distribution, by the series that converges fast on each side of 0.5."""
    zero = F.lit(0.0)
    terms = F.sequence(F.lit(1), F.lit(20))
    sign = lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0)
    high = 2 * F.aggregate(terms, zero, lambda a, k: a + sign(k) * F.exp(-2.0 * k * k * x * x))
    low = 1 - F.lit(math.sqrt(2 * math.pi)) / x * F.aggregate(terms, zero, lambda a, k: a + F.exp(-(2 * k - 1) * (2 * k - 1) * F.lit(math.pi**2 / 8) / (x * x)))
    return F.when(x <= 0, 1.0).when(x < 0.5, low).otherwise(high)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def sigmoid(x: Column | str, threshold: float) -> Column:
    """1 / (1 + e^(threshold - x)); an overflow of e is infinite and gives 0."""
    return 1 / (1 + F.exp(F.lit(threshold) - column(x)))


def z_score(value: Column, mean: Column, deviation: Column) -> Column:
    return F.when(deviation > 0, (value - mean) / deviation).otherwise(F.lit(0.0))


def sole_source(competition: Column | str) -> Column:
    upper = F.upper(column(competition))
    first, *others = (upper.like(p) for p in SOLE_SOURCE)
    for other in others:
        first = first | other
    return first


def share_of(condition: Column) -> Column:
    """The share of rows that meet a condition; null counts as not met."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def is_modification(number: Column | str) -> Column:
    return column(number).isNotNull() & (column(number) != "0")


def fiscal_year_start(year: Column | str) -> Column:
    return F.make_date(column(year) - 1, F.lit(10), F.lit(1))


def fiscal_year_end(year: Column | str) -> Column:
    return F.make_date(column(year), F.lit(9), F.lit(30))


def fiscal_year_of(day: Column | str) -> Column:
    return F.year(F.add_months(column(day), 3))


def midpoint(start: Column | str, end: Column | str) -> Column:
    """The day halfway, rounded down; null where the span is empty."""
    span = F.datediff(column(end), column(start))
    return F.when(span > 0, F.date_add(column(start), F.floor(span / 2).cast("int")))


def snapshot_key(cgac: Column | str, year: Column | str, day: Column | str) -> Column:
    """The archive's file name; codes are padded to three digits, longer ones stay whole."""
    code = column(cgac).cast("string")
    return F.format_string("FY%d_%s_Contracts_Full_%s.zip", column(year).cast("int"), F.lpad(code, F.greatest(F.length(code), F.lit(3)), "0"), column(day))


def json_details(**parts: Column) -> Column:
    """A JSON object that keeps nulls."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]), {"ignoreNullFields": "false"})
