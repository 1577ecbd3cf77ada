from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from awardlens.llm import progressive_jpeg as J
from awardlens.llm.queries_media import op1_progressive_jpeg


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 6 * 64 * 3, 576 * 40])
def test_payload_round_trip(size):
    payload = J.padded(np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes())
    height, width, arrays, parts, quantisers, comments = J.coefficients(J.encode(payload))
    assert J.held_payload(arrays, comments) == payload
    assert J.rgb(height, width, arrays, parts, quantisers).shape == (height, width, 3)


def plain_inverse(block):
    """The textbook sum, sample by sample."""
    out = np.zeros((8, 8))
    for y in range(8):
        for x in range(8):
            for v in range(8):
                for u in range(8):
                    c = (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4
                    out[y, x] += c * block[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
    return out


def test_inverse_transform_and_colours():
    values = np.random.default_rng(1).integers(-40, 40, 64)
    zigzag = np.zeros(64, int)
    zigzag[J.ZIGZAG] = values
    part = J._Component(1, 1, 0)
    grey = J.rgb(8, 8, [values.reshape(1, 1, 64)], [part], {0: np.ones(64, np.float32)})
    want = np.clip(np.rint(plain_inverse(zigzag.reshape(8, 8))) + 128, 0, 255)
    assert np.abs(grey[:, :, 0].astype(int) - want).max() <= 1
    flat = lambda dc: np.concatenate(([dc], np.zeros(63, int))).reshape(1, 1, 64)
    red = J.rgb(8, 8, [flat(0), flat(0), flat(800)], [part] * 3, {0: np.ones(64, np.float32)})
    assert tuple(red[0, 0]) == (255, 57, 128)


class Writer:
    """Writes bits one by one: scans that the library's own encoder never makes."""

    def __init__(self):
        self.text = ""

    def put(self, value, n):
        self.text += f"{value:0{n}b}" if n else ""

    def symbol(self, table, s):
        self.put(*J._codes(table)[s])

    def value(self, v):
        n = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << n) - 1, n)

    def data(self):
        text = self.text + "1" * (-len(self.text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\0")


def test_decodes_runs_end_of_bands_and_refinement():
    """Two grey blocks, sparse coefficients, first scans one bit short, then refined, with new coefficients and corrections."""
    blocks = np.zeros((2, 64), int)
    blocks[0, [0, 3, 20, 63]] = 11, -6, 3, 1
    blocks[1, [0, 2]] = -7, -1
    dc = (bytes([0, 0, 0, 12] + [0] * 12), bytes(range(12)))
    ac_symbols = [0x00, 0x10, 0xF0, *(r << 4 | s for r in range(16) for s in (1, 2, 3))]
    ac = (bytes([0] * 6 + [len(ac_symbols)] + [0] * 9), bytes(ac_symbols))
    first = Writer()
    last = 0
    for b in blocks:
        d = (int(b[0]) >> 1) - last
        last = int(b[0]) >> 1
        first.symbol(dc, abs(d).bit_length())
        first.value(d)
    sent = Writer()  # coefficients halved towards zero: block 0 has -3 at 3 and 1 at 20, block 1 none
    sent.symbol(ac, 2 << 4 | 2)
    sent.value(-3)
    sent.symbol(ac, 0xF0)
    sent.symbol(ac, 0 << 4 | 1)
    sent.value(1)
    sent.symbol(ac, 0x10)  # a run of two or three end-of-bands: 2
    sent.put(0, 1)
    fine = Writer()  # block 0: -6 has bit 0, 3 has bit 1, then a new 1 at 63
    for correction in (0, 1):
        fine.symbol(ac, 0xF0)
        fine.put(correction, 1)
    rest = 63 - 1 - 2 - 32
    while rest > 15:
        fine.symbol(ac, 0xF0)
        rest -= 16
    fine.symbol(ac, rest << 4 | 1)
    fine.put(1, 1)
    fine.symbol(ac, 1 << 4 | 1)  # block 1: one zero is passed, then a new -1 at 2
    fine.put(0, 1)
    fine.symbol(ac, 0x00)
    low = Writer()
    for b in blocks:
        low.put(int(b[0]) & 1, 1)
    head = b"\xff\xd8" + J._segment(0xDB, b"\0" + b"\1" * 64) + J._segment(0xC2, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
    head += J._segment(0xC4, b"\x00" + dc[0] + dc[1]) + J._segment(0xC4, b"\x10" + ac[0] + ac[1])
    file = head + J._scan((1,), 0, 0, 0, 1, 0) + first.data() + J._scan((1,), 1, 63, 0, 1, 0) + sent.data() + J._scan((1,), 1, 63, 1, 0, 0) + fine.data() + J._scan((1,), 0, 0, 1, 0, 0) + low.data() + b"\xff\xd9"
    _, _, arrays, _, _, comments = J.coefficients(file)
    assert arrays[0].reshape(2, 64).tolist() == blocks.tolist() and comments == []


def test_refuses_what_it_does_not_read():
    for data in (b"", b"GIF89a", b"\xff\xd8\xff\xd9", b"\xff\xd8" + J._segment(0xC0, bytes(8))):
        with pytest.raises(ValueError):
            J.coefficients(data)


def test_columns(spark, tmp_path):
    texts = ["", None, "é" * 300, "a" * 200_000, "a" * 200_000, "퟿\x00 x"]
    docs = spark.createDataFrame([(i, t, "kept", "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, media string")
    files = J.encode_texts(docs)
    assert files.columns == ["doc_id", "lang", "n_bytes", "media"]
    rows = {r["doc_id"]: r for r in J.decode_media(files).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        r = rows[i]
        assert bytes(r["payload"]) == J.padded(data) and r["n_bytes"] == len(data) and len(r["rgb"]) == 3 * r["height"] * r["width"]
    assert bytes(rows[0]["media"]) == bytes(rows[1]["media"]) and bytes(rows[3]["media"]) == bytes(rows[4]["media"])
    none = spark.createDataFrame([(1, None)], "id long, media binary")
    assert J.decode_media(none).first()["payload"] is None
    assert J.decode_media(J.encode_texts(docs.limit(0))).count() == 0
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op1_progressive_jpeg(spark, str(tmp_path)).collect():
        payload = J.padded((texts[r["doc_id"]] or "").encode())
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        media = J.encode(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert len(r["rgb"]) == 3 * r["height"] * r["width"]


def test_contract_columns_count_bytes_of_any_text_and_keep_ids(spark, tmp_path):
    """Texts that fill their last unit end in characters of several bytes; bytes that are no UTF-8 stay; ids beside a null one don't become doubles."""
    texts = {1: "é" * 288, 2: "日本語" * 64, 3: "a" * 551 + "\U0001f600" * 6, (1 << 53) + 1: "ñ" * 285, None: "x" * 570 + "é" * 3, 4: None}
    data = {k: (t or "").encode() for k, t in texts.items()} | {5: b"a\xff\xfe\x80" * 144}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "doc_id long, b binary").coalesce(1)
    rows.selectExpr("doc_id", "cast(b as string) text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op1_progressive_jpeg(spark, str(tmp_path)).drop("rgb").collect()}
    assert set(got) == set(data)
    for k, v in data.items():
        payload = J.padded(v)
        want = (len(v), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (got[k]["n_bytes"], got[k]["payload_bytes"], got[k]["payload_sha256"], got[k]["tail_crc32"]) == want, k


def plain_feature(rgb, height, width):
    """The feature as told, pixel by pixel."""
    pixel = lambda y, x: rgb[3 * (y * width + x) : 3 * (y * width + x) + 3]
    total = sum(rgb)
    bits = 0
    for i in range(8):
        for j in range(8):
            rows, columns = range(i * height // 8, (i + 1) * height // 8), range(j * width // 8, (j + 1) * width // 8)
            bits = bits << 1 | (64 * sum(sum(pixel(y, x)) for y in rows for x in columns) > total)
    mean = bytes(sum(rgb[c::3]) // (height * width) for c in range(3))
    return f"{bits:016x}-{mean.hex()}-{width}x{height}"


def test_tensors_and_features_match_a_plain_version(spark, tmp_path):
    spark.createDataFrame([(1, "The quick brown fox é " * 20), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op1_progressive_jpeg(spark, str(tmp_path)).collect():
        payload = J.padded(("The quick brown fox é " * 20 if r["doc_id"] == 1 else "").encode())
        height, width, arrays, parts, quantisers, _ = J.coefficients(J.encode(payload))
        planes = []
        for a, p in zip(arrays, parts, strict=True):
            plane = np.zeros((a.shape[0] * 8, a.shape[1] * 8))
            for y in range(a.shape[0]):
                for x in range(a.shape[1]):
                    block = np.zeros(64)
                    block[J.ZIGZAG] = a[y, x] * quantisers[p.quantiser]
                    plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = plain_inverse(block.reshape(8, 8))
            plane = np.clip(np.rint(plane) + 128, 0, 255)
            v, h = max(q.v for q in parts) // p.v, max(q.h for q in parts) // p.h
            planes.append([[plane[i // v, j // h] for j in range(width)] for i in range(height)])
        y, cb, cr = (np.array(x) for x in planes)
        want = np.clip(np.rint(np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], axis=2)), 0, 255)
        got = np.frombuffer(bytes(r["rgb"]), np.uint8).reshape(height, width, 3)
        assert (r["height"], r["width"]) == (height, width) and np.abs(got - want).max() <= 2
        assert r["feature"] == plain_feature(bytes(r["rgb"]), height, width)


def test_damaged_files_become_error_rows(spark):
    good = J.encode(J.padded(b"text " * 300))
    cuts = [good[:n] for n in range(0, len(good), 97)] + [good[:300] + bytes([good[300] ^ 255]) + good[301:], b"no image", b""]
    rows = J.decode_media(spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate([good, *cuts])], "id long, media binary")).collect()
    by = {r["id"]: r for r in rows}
    assert len(by) == len(cuts) + 1 and by[0]["error"] is None and bytes(by[0]["payload"])[:1500] == b"text " * 300
    assert by[1]["error"] and by[1]["rgb"] is None and by[len(cuts)]["error"]


def test_stored_tensors_and_clashing_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one", "a", 3), (1, "one", "a", 3), (None, None, None, None)], "doc_id long, text string, j_text string, error int")
    out = J.store_media(docs, f"{tmp_path}/store")
    assert out.columns == ["doc_id", "j_text", "n_bytes", "media", "height", "width", "rgb", "payload", "feature", "error"]
    assert out.count() == 3 and spark.read.parquet(f"{tmp_path}/store/media").count() == 3
    assert {(r["doc_id"], r["j_text"], r["error"], bytes(r["payload"])[:3]) for r in out.collect()} == {(1, "a", None, b"one"), (None, None, None, b"\xff" * 3)}
