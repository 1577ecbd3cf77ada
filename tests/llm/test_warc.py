from __future__ import annotations

import base64
import hashlib

import pytest
import zstandard

from awardlens.llm import warc as W


def pages(spark, rows):
    return spark.createDataFrame([(*r, b"x") for r in rows], "page_id long, url string, html string, archive binary")


def test_records_round_trip_and_revisits(spark):
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, "http://c d\r\ne", "é" * 5000), (4, "u", None), (5, "u", ""), (6, "u", "x" * 300_000), (7, "u", "same"), (None, "u", "same"), (None, "u", "lone"), (2, None, "same")]
    out = W.read_archives(W.write_archives(pages(spark, rows))).collect()
    assert len(out) == len(rows)
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    for r in out:
        html = next((h for i, _, h in rows if i == r["page_id"] and i is not None), None)
        if r["page_id"] is not None:
            data = (html or "").encode()
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode() and r["payload_bytes"] == len(data)
            first = top[html or ""]
            assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == first else ("revisit", first))
            assert r["record_type"] == "revisit" or bytes(r["payload"]) == data
    assert sorted((r["payload_bytes"], r["record_type"]) for r in out if r["page_id"] is None) == [(4, "response"), (4, "revisit")]


def test_small_payloads_may_be_left_alone(spark):
    out = W.read_archives(W.write_archives(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), least=3)).collect()
    assert {r["page_id"]: r["record_type"] for r in out} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_archives_roll_and_each_record_stands_alone():
    records = [W.record(i, f"http://x/{i}", (f"<html><p>page {i} of many</p>" * 40).encode() + bytes([i % 251]) * (i % 97), None) for i in range(3000)]
    files = list(W.archives(iter(records), size=64 << 10))
    assert len(files) > 1 and sum(len(o) for _, o in files) == len(records)
    k = 0
    for data, offsets in files:
        words, at = W.embedded_dictionary(data)
        assert offsets[0] == at and data[8:12] == W.TRAINED
        ends = [*offsets[1:], len(data)]
        for a, b in list(zip(offsets, ends, strict=True))[::50]:
            assert zstandard.ZstdDecompressor(dict_data=words).decompress(data[a:b]) == records[k + offsets.index(a)]
        assert [f["warc-page-id"] for f, _ in W.read_records(data)] == [str(i) for i in range(k, k + len(offsets))]
        k += len(offsets)


def test_too_little_for_a_dictionary_and_broken_archives(spark):
    (data, _), = W.archives(iter([W.record(1, "u", b"", None)]))
    assert [f["warc-page-id"] for f, _ in W.read_records(data)] == ["1"]
    assert list(W.archives(iter([]))) == []
    with pytest.raises(ValueError):
        list(W.read_records(data[8:]))
    assert W.read_archives(W.write_archives(pages(spark, []))).count() == 0


def test_text_ids_dates_and_clashing_columns(spark):
    rows = [("a/1\r\nX: y", "u", "same", "2024-05-06T07:08:09Z", "v"), ("b", "u", "same", None, "w"), ("é", None, "other", None, "x"), (None, "u", "same", None, "z")]
    docs = spark.createDataFrame(rows, "page_id string, url string, html string, w_date string, v_page string")
    written = W.write_archives(docs, date_col="w_date")
    out = W.read_archives(written, "string").collect()
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["error"]) for r in out) == [("None", "revisit", "b", None), ("a/1\r\nX: y", "revisit", "b", None), ("b", "response", None, None), ("é", "response", None, None)]
    dates = [f["warc-date"] for r in written.collect() for f, _ in W.read_records(bytes(r["archive"]))]
    assert sorted(dates) == ["2024-05-06T07:08:09Z", *[W.DATE] * 3]


def test_shuffled_revisits_and_broken_archives_become_rows(spark, monkeypatch):
    rows = [(i, "u", f"page {i % 7}") for i in range(60)]
    monkeypatch.setattr(W, "BROADCAST_ROWS", -1)
    written = W.write_archives(pages(spark, rows).coalesce(1))
    out = W.read_archives(written).collect()
    assert {r["page_id"]: r["refers_to"] for r in out} == {i: None if i + 7 >= 60 else max(k for k in range(60) if k % 7 == i % 7) for i in range(60)}
    ((archive, offsets),) = [(bytes(r["archive"]), r["offsets"]) for r in written.collect()]
    broken = spark.createDataFrame([(bytearray(archive[: len(archive) * 2 // 3]), offsets), (bytearray(b"nothing"), [0]), (bytearray(b""), [0]), (None, None)], W.ARCHIVES)
    got = W.read_archives(broken).collect()
    errors = [r for r in got if r["error"]]
    assert len(errors) == 3 and all(r["page_id"] is None for r in errors)
    assert {r["page_id"] for r in got if not r["error"]} <= set(range(60))
