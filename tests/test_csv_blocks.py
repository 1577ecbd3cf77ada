"""CSV by blocks: the same rows as Spark's multi-line reader, whatever the block size, by many tasks a file."""

from __future__ import annotations

import csv
import io
import random

import pytest

from awardlens.sources.csv_awards import scan_csv
from awardlens.sources.csv_blocks import inside_after


def plain_inside(text: str) -> bool:
    """By the character: a quote opens a value only at its start, two in it are one."""
    inside, start, i = False, True, 0
    while i < len(text):
        c = text[i]
        if inside:
            if c == '"':
                if text[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    inside = False
        elif c == '"' and start:
            inside = True
        start = not inside and c in ",\n"
        i += 1
    return inside


def test_transitions_match_the_scan_by_character():
    rng = random.Random(1)
    fields = ["", "a", "5 in", '""', '"a"', '"a, b"', '"a ""b"""', 'x"y', '"open']
    for _ in range(4000):
        line = ",".join(rng.choice(fields) for _ in range(rng.randrange(1, 6)))
        assert inside_after(line, False) == plain_inside(line), line
        assert inside_after(line, True) == plain_inside('"' + line), line


def multi_line(spark, path):
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def sample(n: int, seed: int, end: str) -> str:
    rng = random.Random(seed)
    out = io.StringIO()
    write = csv.writer(out, lineterminator=end)
    write.writerow(["id", "odd `name`", "text", "last"])
    words = ["one", "two, three", 'say "so"', "line\nbreak", "\n\n", "", "é€", "x" * 90, '"', 'tail"', ",", "\n,\n"]
    for k in range(n):
        write.writerow([k, rng.choice(words), "".join(rng.choice(words) for _ in range(rng.randrange(8))), rng.choice(words)])
    return out.getvalue()


@pytest.mark.parametrize("block", [64, 500, 7000, 1 << 27])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_same_rows_as_the_multi_line_reader(spark, tmp_path, block, end):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_bytes(sample(120 if block > 64 else 25, k, end).encode())
    (tmp_path / "none.csv").write_bytes(b"")
    (tmp_path / "header.csv").write_bytes(b"id,odd `name`,text,last" + end.encode())
    paths = [f"{tmp_path}/{k}.csv" for k in (0, 1, 2, "none", "header")]
    key = "spark.sql.files.maxPartitionBytes"
    before, cost = spark.conf.get(key), spark.conf.get("spark.sql.files.openCostInBytes")
    want = multi_line(spark, paths).collect()
    spark.conf.set(key, block)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = scan_csv(spark, paths)
        assert got.columns == ["id", "odd `name`", "text", "last"]
        rows = got.collect()
        tasks = spark.read.text(paths[0]).rdd.getNumPartitions()
    finally:
        spark.conf.set(key, before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    order = lambda r: tuple(x or "" for x in r)
    assert sorted(rows, key=order) == sorted(want, key=order)
    assert tasks > 10 or block > 500


def test_one_value_over_many_blocks_and_an_open_one(spark, tmp_path):
    long = "\n".join(f"line {k}" for k in range(300))
    (tmp_path / "a.csv").write_text(f'id,text\n1,"{long}"\n2,short\n3\n4,x,too many\n\n5,"never closed\nto the end\n', encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100)
    try:
        rows = {r["id"]: r["text"] for r in scan_csv(spark, str(tmp_path / "a.csv")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert set(rows) == {"1", "2", "3", "4", "5"} and rows["1"] == long
    assert (rows["2"], rows["3"], rows["4"]) == ("short", None, "x") and rows["5"].startswith("never closed\nto the end")
