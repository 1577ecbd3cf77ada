from __future__ import annotations

import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from awardlens.llm import pii as P


KEY = "a key of the tests"
SF = "/root/testdata/sf0.001"


def plain_feistel(kind, left, right, a, b, key=KEY):
    for i in range(P.ROUNDS):
        if i % 2 == 0:
            left = (left + int(hashlib.sha256(f"{key}:{kind}:{i}:{right}".encode()).hexdigest()[:15], 16) % a) % a
        else:
            right = (right + int(hashlib.sha256(f"{key}:{kind}:{i}:{left}".encode()).hexdigest()[:15], 16) % b) % b
    return left, right


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def run(spark, *texts, inverse=False, **extra):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id int, text string, pii_values string")
    return {r["doc_id"]: r for r in P.pseudonymise(docs, KEY, inverse=inverse).collect()}


def test_matches_a_plain_version(spark):
    r = run(spark, "ip 10.20.30.40.", "ssn 123-45-6789", "call (301) 555-3824", "pay 4111 1111 1111 1111")
    left, right = plain_feistel("ipv4", 10 * 256 + 20, 30 * 256 + 40, 65536, 65536)
    assert r[0]["text"] == f"ip {left >> 8}.{left & 255}.{right >> 8}.{right & 255}."
    left, right = plain_feistel("ssn", 122 * 99 + 44, 6788, 898 * 99, 9999)
    area = left // 99 + 1
    assert r[1]["text"] == f"ssn {area + (area >= 666):03d}-{left % 99 + 1:02d}-{right + 1:04d}"
    left, right = plain_feistel("phone", 101 * 800 + 355, 3824, 640_000, 10**4)
    assert r[2]["text"] == f"call ({left // 800 + 200:03d}) {left % 800 + 200:03d}-{right:04d}"
    left, right = plain_feistel("card", 1111111, 1111111, 10**7, 10**7)
    digits = re.sub(r"\D", "", r[3]["text"])
    assert digits[:15] == f"4{left:07d}{right:07d}" and luhn(digits) and re.fullmatch(r"pay \d{4} \d{4} \d{4} \d{4}", r[3]["text"])


def test_equal_values_stay_linked_across_layouts_and_documents(spark):
    r = run(spark, "4111111111111111", "x 4111-1111-1111-1111 y 4111111111111111***", "a.b@c.example.com A.B@C.example.com")
    digits = [re.findall(r"\d{16}", x["text"].replace("-", "")) for x in (r[0], r[1])]
    assert len({d for ds in digits for d in ds}) == 1 and r[1]["pii_values"] == 2
    first, second = r[2]["text"].split()
    assert first == second and first.endswith("@redacted.invalid")


def test_dates_are_a_bijection_and_come_back(spark):
    days = spark.range(0, P.DAYS, 7).select(F.col("id").alias("doc_id"), F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    out = P.pseudonymise(days, KEY)
    assert out.select("text").distinct().count() == days.count()
    assert P.pseudonymise(out, KEY, inverse=True).select("doc_id", "text").exceptAll(days).count() == 0
    assert out.filter(F.col("text").between("1900-01-01", "2099-12-31")).count() == days.count()


@pytest.mark.parametrize("text", ["4111111111111112", "2001-02-30", "999-12-1234", "256.1.1.1", "1.2.3.4.5", "12345678901", "plain words 42", "", None, "\u0001\u0002 only marks \u0001\u0003", "x" * 100_000, "1 " * 50_000, "9" * 100_000])
def test_what_is_no_personal_data_stays(spark, text):
    r = run(spark, text)[0]
    assert r["text"] == text and r["pii_values"] == 0


def test_marks_in_texts_and_round_trip(spark):
    texts = ["\u0001\u0002 1.2.3.4 \u0001\u0003 31.12.1999 \u0001", "378282246310005 and 3782 822463 10005", "2024-02-29, 02/29/2024"]
    r = run(spark, *texts)
    back = run(spark, *[r[i]["text"] for i in range(3)], inverse=True)
    assert [back[i]["text"] for i in range(3)] == texts and all(r[i]["text"] != t for i, t in enumerate(texts))
    assert P.pseudonymise(spark.createDataFrame([], "doc_id int, text string"), KEY).count() == 0


@pytest.mark.parametrize("layout", ["MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "yyyy-MM-dd"])
def test_distinct_dates_stay_distinct_in_all_layouts(spark, layout):
    """All dates of 1900-2099 as texts, of slashed ones those of both layouts together: no two share a pseudonym, and each comes back."""
    every = spark.range(0, P.DAYS).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    texts = every.select(F.date_format("day", layout).alias("doc_id"))
    if "/" in layout:
        texts = texts.union(every.select(F.date_format("day", "MM/dd/yyyy" if layout[0] == "d" else "dd/MM/yyyy").alias("doc_id"))).distinct()
    texts = texts.repartition(8)
    out = P.pseudonymise(texts.withColumn("text", F.col("doc_id")), KEY)
    back = P.pseudonymise(out.drop("pii_values"), KEY, inverse=True).withColumnRenamed("text", "back").drop("pii_values")
    n, distinct, same, kept = out.join(back, "doc_id").agg(F.count(F.lit(1)), F.count_distinct("text"), F.count_if(F.col("back") == F.col("doc_id")), F.count_if(F.length("text") == 10)).first()
    assert n == distinct == same == kept == texts.count() >= P.DAYS


def test_phones_stay_valid_and_distinct(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.format_string("%03d-%03d-%04d", F.col("id") * 7 % 800 + 200, F.col("id") % 800 + 200, F.col("id") * 3 % 10000).alias("text"))
    out = P.pseudonymise(rows, KEY)
    assert out.filter(F.col("text").rlike(r"^[2-9]\d\d-[2-9]\d\d-\d{4}$")).count() == 3000 == out.select("text").distinct().count()
    assert P.pseudonymise(out.drop("pii_values"), KEY, inverse=True).select("doc_id", "text").exceptAll(rows).count() == 0
    odd = run(spark, "000-123-4567 and 199-999-0000")[0]["text"]
    assert re.fullmatch(r"[01]\d\d-[01]\d\d-\d{4} and [01]\d\d-[2-9]\d\d-\d{4}", odd)


def plain_value(v, key=KEY):
    """A matched value's pseudonym, digit by digit in Python."""
    digits = re.sub("[^0-9]", "", v)

    def refill(new):
        left = iter(new)
        return "".join(next(left) if c in "0123456789" else c for c in v)

    def date(layout, most=0):
        try:
            day = datetime.datetime.strptime(v, layout).date()
        except ValueError:
            return None
        n, first = (day - datetime.date(1900, 1, 1)).days, True
        while first or n >= P.DAYS or (datetime.date(1900, 1, 1) + datetime.timedelta(days=n)).day <= most:
            left, right = plain_feistel("date", n // P.DAY_FACTORS[1], n % P.DAY_FACTORS[1], *P.DAY_FACTORS, key)
            n, first = left * P.DAY_FACTORS[1] + right, False
        return (datetime.date(1900, 1, 1) + datetime.timedelta(days=n)).strftime(layout)

    whole = lambda pattern: re.fullmatch(pattern, v, re.ASCII)
    if "@" in v:
        return "u" + hashlib.sha256(f"{key}:email:{v.lower()}".encode()).hexdigest()[:16] + "@redacted.invalid"
    if whole(P.IPV4):
        a, b, c, d = map(int, v.split("."))
        left, right = plain_feistel("ipv4", a * 256 + b, c * 256 + d, 65536, 65536, key)
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    if whole(P.SSN):
        area = int(digits[:3])
        left, right = plain_feistel("ssn", (area - (2 if area > 666 else 1)) * 99 + int(digits[3:5]) - 1, int(digits[5:]) - 1, 898 * 99, 9999, key)
        area = left // 99 + 1
        return refill(f"{area + (area >= 666):03d}{left % 99 + 1:02d}{right + 1:04d}")
    if whole(P.PHONE):
        codes = [int(digits[-10:-7]), int(digits[-7:-4])]
        (least, many), (least2, many2) = ((200, 800) if c >= 200 else (0, 200) for c in codes)
        left, right = plain_feistel("phone", (codes[0] - least) * many2 + codes[1] - least2, int(digits[-4:]), many * many2, 10**4, key)
        return refill(f"{digits[:-10]}{left // many2 + least:03d}{left % many2 + least2:03d}{right:04d}")
    if whole(P.ISO_DATE):
        return date("%Y-%m-%d") or v
    if whole(P.SLASH_DATE):
        return date("%m/%d/%Y") or date("%d/%m/%Y", 12) or v
    if whole(P.DOT_DATE):
        return date("%d.%m.%Y") or v
    if not luhn(digits):
        return v
    half = (len(digits) - 2) // 2
    rest = len(digits) - 2 - half
    left, right = plain_feistel("card", int(digits[1 : 1 + half]), int(digits[1 + half : -1]), 10**half, 10**rest, key)
    front = f"{digits[0]}{left:0{half}d}{right:0{rest}d}"
    return refill(front + next(c for c in "0123456789" if luhn(front + c)))


def plain_text(text, key=KEY):
    pieces, changed, at = [], 0, 0
    for m in re.finditer(P.ANY, text, re.ASCII):
        new = plain_value(m.group(), key)
        changed += new != m.group()
        pieces += [text[at : m.start()], new]
        at = m.end()
    return "".join(pieces) + text[at:], changed


def test_query_on_whole_texts_matches_a_plain_version(spark):
    from awardlens.llm.queries_pii import op6_pseudonyms, session_key

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r["doc_id"]: (r["text"], r["pii_values"]) for r in op6_pseudonyms(spark, SF).collect()}
    key = session_key(spark)
    assert found == {i: (None, 0) if t is None else plain_text(t, key) for i, t in texts.items()}
    assert sum(n for _, n in found.values()) > 0


def test_layouts_match_a_plain_version(spark):
    texts = [
        "on 31.12.1999 and 12/31/1999, 31/12/1999 or 02/30/2000; 1999-12-31", "mail a.b+c@d-e.example.org, X@y.co.", "12345678901234567890 4111-1111-1111-1111 378282246310005 3782 822463 10005",
        "+1 (301) 555-3824 301.555.3824 1-301-555-3824", "(123-45-6789) 078-05-1120 899-99-9999 665-01-0001 667-01-0001", "0.0.0.0 255.255.255.255, 8.8.8.8.", "2000-02-29 29.02.2000 29.02.1900 1900-01-01 2099-12-31",
    ]
    r = run(spark, *texts)
    assert {i: (x["text"], x["pii_values"]) for i, x in r.items()} == dict(enumerate(map(plain_text, texts)))


LONG = ["x@" + "a." * 500_000, "x@" + "a-" * 500_000, "a." * 500_000 + "@b", "@a" * 500_000, "1." * 500_000, "1-" * 500_000, "12/" * 330_000, "4111 " * 200_000, "9" * 1_000_000, "(301) " * 160_000, "a@b.c" * 200_000, "-" * 1_000_000]


def test_long_runs_of_every_pattern_do_not_overflow_the_stack(spark):
    r = run(spark, *LONG, "x@" + "a." * 5000 + " 4111111111111111", "x@" + "a." * 125 + "com")
    for i, t in enumerate(LONG):
        assert r[i]["text"] == plain_text(t)[0]
    assert r[len(LONG)]["pii_values"] == 1 and r[len(LONG) + 1]["text"].endswith("@redacted.invalid")


def test_clashing_columns_repeated_rows_and_keys(spark):
    rows = [(1, "mail a@b.cd", "p", "n"), (1, "mail a@b.cd", "p", "n"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, pii_parts string, PII_NEW string")
    out = P.pseudonymise(docs, KEY)
    assert out.columns == [*docs.columns, "pii_values"]
    got = sorted(map(tuple, out.collect()), key=str)
    assert got[0] == got[1] and got[0][2:] == ("p", "n", 1) and got[2] == (None, None, None, None, 0)
    assert P.pseudonymise(docs, "another key").exceptAll(out).count() == 2
    with pytest.raises(ValueError):
        P.pseudonymise(docs, "")
