"""Media columns: progressive JPEG files in a binary column, decoded to full-resolution RGB tensors.

The decoder takes any Huffman-coded progressive file (SOF2, 8 bit, up to four components, restart intervals): scans of
spectral selection and successive approximation accumulate in coefficient arrays, which are inverse-transformed in numpy,
chroma is upsampled and the image converted to RGB. Runs of equal codes and end-of-band runs are decoded as arrays.

Payloads are kept in the format's lossless unit, the quantised coefficient: with all quantisers 1, a DCT of 8-bit samples
still rounds, but coefficients are coded exactly. A block holds 64 payload bytes u: the DC coefficient is u - 128, an AC
coefficient the value of magnitude category 8 whose appended bits are u. DC and AC come in a first scan without their
lowest bit and are refined by one more.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

UNIT = 576
BATCH_BYTES = 4 << 20
MCU_ROW = 4095  # most blocks of 16 pixels in a row

ZIGZAG = np.array([x[2] for x in sorted((i + j, (i if (i + j) % 2 else j), 8 * i + j) for i in range(8) for j in range(8))])
BASIS = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: Row k: the samples of a block that has coefficient k, in zigzag order, alone.
INVERSE = np.kron(BASIS, BASIS)[ZIGZAG].astype(np.float32)

Table = tuple[bytes, bytes]  # numbers of codes by length 1-16, and their symbols
DC_TABLE: Table = (bytes([0, 0, 7, 1] + [0] * 12), bytes(range(8)))
AC_FIRST: Table = (bytes([1] + [0] * 15), bytes([7]))
AC_REFINE: Table = (bytes([0, 0, 0, 15] + [0] * 12), bytes(r << 4 for r in range(15)))
SCAN_END = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]")
RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _codes(table: Table) -> dict[int, tuple[int, int]]:
    """symbol: (code, length)"""
    code, k, out = 0, 0, {}
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            out[table[1][k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(64)
def _lookup(table: Table) -> tuple[np.ndarray, np.ndarray]:
    """Length and symbol of the code with which 16 bits begin; length 0 where none fits."""
    lengths, symbols = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for symbol, (code, n) in _codes(table).items():
        lengths[code << 16 - n : (code + 1) << 16 - n] = n
        symbols[code << 16 - n : (code + 1) << 16 - n] = symbol
    return lengths, symbols


@lru_cache(1)
def _dc_strings() -> dict[int, str]:
    codes, out = _codes(DC_TABLE), {}
    for d in range(-127, 128):
        size = abs(d).bit_length()
        code, n = codes[size]
        out[d] = f"{code:0{n}b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "")
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(4096)
def _mcu_order(across: int, down: int, h: int, v: int) -> np.ndarray:
    """Raster indexes of a component's blocks in the order of an interleaved scan."""
    return np.arange(across * h * down * v).reshape(down, v, across, h).transpose(0, 2, 1, 3).reshape(-1)


_FIXED = _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + _segment(0xDB, b"\0" + b"\1" * 64)
_TABLES = _segment(0xC4, b"".join(bytes([k]) + counts + symbols for k, (counts, symbols) in ((0x00, DC_TABLE), (0x10, AC_FIRST), (0x11, AC_REFINE))))


def _scan(components: tuple[int, ...], first: int, last: int, high: int, low: int, table: int) -> bytes:
    return _segment(0xDA, bytes([len(components)]) + b"".join(bytes([c, table]) for c in components) + bytes([first, last, high << 4 | low]))


def _stuffed(bits: np.ndarray) -> bytes:
    rest = -len(bits) % 8
    return np.packbits(np.concatenate((bits, np.ones(rest, np.uint8))) if rest else bits).tobytes().replace(b"\xff", b"\xff\x00")


@lru_cache(4096)
def _end_of_bands(run: int) -> np.ndarray:
    r = run.bit_length() - 1
    code, n = _codes(AC_REFINE)[r << 4]
    text = f"{code:0{n}b}" + (f"{run - (1 << r):0{r}b}" if r else "")
    return np.frombuffer(text.encode(), np.uint8) - 48


def encode(payload: bytes) -> bytes:
    """A progressive 4:2:0 file that holds ``payload``, whose length stands in a comment."""
    n = max(1, -(-len(payload) // (6 * 64)))
    down = -(-n // MCU_ROW)
    across = -(-n // down)
    m = across * down
    u = np.frombuffer(payload.ljust(6 * 64 * m, b"\xff"), np.uint8).reshape(-1, 64)
    parts = (u[: 4 * m], u[4 * m : 5 * m], u[5 * m :])
    order = _mcu_order(across, down, 2, 2)
    dc = (u[:, 0].astype(np.int16) - 128) >> 1
    y, cb, cr = dc[: 4 * m][order], dc[4 * m : 5 * m], dc[5 * m :]
    diffs = np.concatenate([np.diff(x, prepend=np.int16(0)).reshape(m, -1) for x in (y, cb, cr)], axis=1).ravel().tolist()
    strings = _dc_strings()
    text = "".join([strings[d] for d in diffs])
    text += "1" * (-len(text) % 8)
    low = u & 1
    out = [b"\xff\xd8", _FIXED, _segment(0xFE, b"payload=%d" % len(payload)), _segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + b"\1\x22\0\2\x11\0\3\x11\0"), _TABLES]
    out += [_scan((1, 2, 3), 0, 0, 0, 1, 0x00), int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")]
    for c, first, last in ((1, 1, 5), (2, 1, 63), (3, 1, 63), (1, 6, 63)):
        out += [_scan((c,), first, last, 0, 1, 0x00), (parts[c - 1][:, first : last + 1] >> 1).tobytes()]  # code 0 and seven bits
    for c in (1, 2, 3):
        part = parts[c - 1]
        bits = ((part ^ ~(part >> 7)) & 1)[:, 1:]
        runs = [x for i in range(0, len(part), 32767) for x in (_end_of_bands(min(32767, len(part) - i)), bits[i : i + 32767].ravel())]
        out += [_scan((c,), 1, 63, 1, 0, 0x01), _stuffed(np.concatenate(runs))]
    mixed = np.concatenate([low[: 4 * m, 0][order].reshape(m, 4), low[4 * m : 5 * m, :1], low[5 * m :, :1]], axis=1)
    out += [_scan((1, 2, 3), 0, 0, 1, 0, 0x00), _stuffed(mixed.ravel()), b"\xff\xd9"]
    return b"".join(out)


class _Bits:
    """The bits of one entropy-coded segment."""

    def __init__(self, data: bytes) -> None:
        self.data, self.n = data.replace(b"\xff\x00", b"\xff"), 0
        self.n, self.at = 8 * len(self.data), 0
        self.padded = self.data + b"\xff" * 8
        self._array: np.ndarray | None = None

    @property
    def array(self) -> np.ndarray:
        if self._array is None:
            self._array = np.unpackbits(np.frombuffer(self.data, np.uint8))
        return self._array

    def peek(self) -> int:
        i = self.at >> 3
        return int.from_bytes(self.padded[i : i + 3], "big") >> (8 - (self.at & 7)) & 0xFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        i = self.at >> 3
        out = int.from_bytes(self.padded[i : i + 4], "big") >> (32 - (self.at & 7) - n) & ((1 << n) - 1)
        self.at += n
        return out

    def many(self, n: int) -> np.ndarray:
        out = self.array[self.at : self.at + n]
        self.at += n
        return out if len(out) == n else np.concatenate((out, np.ones(n - len(out), np.uint8)))


def _extend(v: int, size: int) -> int:
    return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _dc_first(bits: _Bits, tables: list[Table], n: int) -> list[int]:
    """n differences, whose tables follow one another in turn. All bit positions are decoded at once, then the right ones followed."""
    raw = np.frombuffer(bits.padded, np.uint8).astype(np.int64)
    words = (raw[:-4] << 32) | (raw[1:-3] << 24) | (raw[2:-2] << 16) | (raw[3:-1] << 8) | raw[4:]
    words = words[: len(bits.data) + 1]
    shifts = np.arange(8)
    tops = ((words[:, None] >> (24 - shifts)) & 0xFFFF).ravel()
    wide = ((words[:, None] << shifts) & ((1 << 40) - 1)).ravel()
    steps, values = {}, {}
    for table in set(tables):
        lengths, symbols = _lookup(table)
        length, size = lengths[tops], symbols[tops]
        v = (wide >> (40 - length - size)) & ((1 << size) - 1)
        values[table] = np.where((size > 0) & (v < (1 << np.maximum(size - 1, 0))), v - (1 << size) + 1, v).tolist()
        steps[table] = np.where(length > 0, length + size, 1).tolist()
    pairs = [(steps[t], values[t]) for t in tables]
    out, at, period, end = [], 0, len(pairs), len(tops) - 1
    for k in range(n):
        step, value = pairs[k % period]
        at = min(at, end)
        out.append(value[at])
        at += step[at]
    return out


def _ac_first(bits: _Bits, coefficients: np.ndarray, first: int, last: int, low: int, table: Table) -> None:
    """coefficients: (blocks, 64), of which first to last are set."""
    lengths, symbols = _lookup(table)
    blocks, width = len(coefficients), last - first + 1
    band = np.zeros(blocks * width, np.int32)
    at, end, raw = 0, blocks * width, np.frombuffer(bits.data, np.uint8)
    while at < end and bits.at < bits.n:
        top = bits.peek()
        length, symbol = int(lengths[top]), int(symbols[top])
        if not length:
            raise ValueError("no such code")
        run, size = symbol >> 4, symbol & 15
        if size and not run:
            stride = length + size
            n = min(end - at, (bits.n - bits.at) // stride)
            if n >= 8:
                if stride == 8 and not bits.at & 7:
                    part = raw[bits.at >> 3 : (bits.at >> 3) + n]
                    same, values = part >> size == top >> (16 - length), (part & ((1 << size) - 1)).astype(np.int32)
                else:
                    part = bits.array[bits.at : bits.at + n * stride].reshape(n, stride)
                    same, values = (part[:, :length] == part[0, :length]).all(axis=1), part[:, length:].astype(np.int32) @ (1 << np.arange(size)[::-1]).astype(np.int32)
                k = n if same.all() else int(same.argmin())
                values = values[:k]
                band[at : at + k] = np.where(values >> (size - 1), values, values - (1 << size) + 1)
                at, bits.at = at + k, bits.at + k * stride
                continue
        bits.at += length
        if size:
            at += run
            if at < end:
                band[at] = _extend(bits.take(size), size)
            at += 1
        elif run == 15:
            at += 16
        else:
            at = (at // width + (1 << run) + bits.take(run)) * width
    coefficients[:, first : last + 1] = band.reshape(blocks, width) * (1 << low)


def _ac_refine(bits: _Bits, coefficients: np.ndarray, first: int, last: int, low: int, table: Table) -> None:
    lengths, symbols = _lookup(table)
    one, block = 1 << low, 0

    def correct(part: np.ndarray) -> None:
        """One more bit of each coefficient that isn't zero."""
        there = part != 0
        chosen = part[there]
        part[there] = chosen + np.where(bits.many(len(chosen)) == 1, np.sign(chosen) * one, 0)

    while block < len(coefficients) and bits.at < bits.n:
        k = first
        while k <= last:
            top = bits.peek()
            length, symbol = int(lengths[top]), int(symbols[top])
            if not length:
                raise ValueError("no such code")
            bits.at += length
            run, size = symbol >> 4, symbol & 15
            if not size and run < 15:
                n = (1 << run) + bits.take(run)
                row = coefficients[block, k : last + 1].copy()
                correct(row)
                coefficients[block, k : last + 1] = row
                if n > 1:
                    rest = coefficients[block + 1 : block + n, first : last + 1].copy()
                    correct(rest)
                    coefficients[block + 1 : block + n, first : last + 1] = rest
                block += n - 1
                break
            new = (one if bits.take(1) else -one) if size else 0
            while k <= last:
                c = coefficients[block, k]
                if c:
                    if bits.take(1):
                        coefficients[block, k] = c + (one if c > 0 else -one)
                elif run == 0:
                    coefficients[block, k] = new
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
        block += 1


class _Component:
    def __init__(self, h: int, v: int, quantiser: int) -> None:
        self.h, self.v, self.quantiser = h, v, quantiser


def coefficients(data: bytes) -> tuple[int, int, list[np.ndarray], list[_Component], dict[int, np.ndarray], list[bytes]]:
    """Height, width, the components' coefficient arrays (rows, columns, 64 in zigzag order), their factors, quantisers and comments."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    at, quantisers, tables, comments, restart = 2, {}, {}, [], 0
    parts: dict[int, _Component] = {}
    arrays: dict[int, np.ndarray] = {}
    height = width = across = down = 0
    while at < len(data):
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.float32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                k = 17 + sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17:k])
                body = body[k:]
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xFE:
            comments.append(body)
        elif marker == 0xC2:
            precision, height, width, count = struct.unpack(">BHHB", body[:6])
            if precision != 8:
                raise ValueError("only 8-bit samples are read")
            for i in range(count):
                c, hv, q = body[6 + 3 * i : 9 + 3 * i]
                parts[c] = _Component(hv >> 4, hv & 15, q)
            top_h, top_v = max(p.h for p in parts.values()), max(p.v for p in parts.values())
            across, down = -(-width // (8 * top_h)), -(-height // (8 * top_v))
            for c, p in parts.items():
                arrays[c] = np.zeros((down * p.v, across * p.h, 64), np.int32)
        elif marker in (0xC0, 0xC1, 0xC3):
            raise ValueError("no progressive file")
        elif marker == 0xDA:
            count = body[0]
            chosen = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(count)]
            first, last, high, low = body[1 + 2 * count], body[2 + 2 * count], body[3 + 2 * count] >> 4, body[3 + 2 * count] & 15
            end = m.start() if (m := SCAN_END.search(data, at)) else len(data)
            pieces, at = [data[at:end]], end
            if restart:
                pieces = RESTART.split(pieces[0])
            if count == 1:
                c, t = chosen[0]
                p, whole = parts[c], arrays[c]
                rows, columns = -(-(-(-height * p.v // max(x.v for x in parts.values()))) // 8), -(-(-(-width * p.h // max(x.h for x in parts.values()))) // 8)
                flat = whole[:rows, :columns].reshape(-1, 64) if (rows, columns) != whole.shape[:2] else whole.reshape(-1, 64)
                units = len(flat)
                step = restart or units
                for i, piece in enumerate(pieces):
                    part, bits = flat[i * step : (i + 1) * step], _Bits(piece)
                    if first:
                        (_ac_refine if high else _ac_first)(bits, part, first, last, low, tables[0x10 | t & 15])
                    elif high:
                        part[:, 0] |= bits.many(len(part)).astype(np.int32) << low
                    else:
                        part[:, 0] = np.cumsum(_dc_first(bits, [tables[t >> 4]], len(part))) << low
                if (rows, columns) != whole.shape[:2]:
                    whole[:rows, :columns] = flat.reshape(rows, columns, 64)
            else:
                mcus = across * down
                step = restart or mcus
                orders = [_mcu_order(across, down, parts[c].h, parts[c].v) for c, _ in chosen]
                sizes = [parts[c].h * parts[c].v for c, _ in chosen]
                found: list[np.ndarray] = []
                for i, piece in enumerate(pieces):
                    n, bits = min(step, mcus - i * step), _Bits(piece)
                    if n <= 0:
                        break
                    if high:
                        found.append(bits.many(n * sum(sizes)).astype(np.int32).reshape(n, -1))
                    else:
                        plan = [tables[t >> 4] for (_, t), k in zip(chosen, sizes, strict=True) for _ in range(k)]
                        found.append(np.array(_dc_first(bits, plan, n * sum(sizes)), np.int32).reshape(n, -1))
                start = 0
                for (c, _), order, k in zip(chosen, orders, sizes, strict=True):
                    flat = arrays[c].reshape(-1, 64)
                    columns = [x[:, start : start + k].ravel() for x in found]
                    values = np.concatenate(columns if high else [np.cumsum(x) for x in columns])
                    if high:
                        flat[order[: len(values)], 0] |= values << low
                    else:
                        flat[order[: len(values)], 0] = values << low
                    start += k
    if not parts:
        raise ValueError("no frame")
    return height, width, [arrays[c] for c in parts], list(parts.values()), quantisers, comments


@lru_cache(64)
def _inverse(quantiser: bytes) -> np.ndarray:
    return np.frombuffer(quantiser, np.float32)[:, None] * INVERSE


def rgb(height: int, width: int, arrays: list[np.ndarray], parts: list[_Component], quantisers: dict[int, np.ndarray]) -> np.ndarray:
    """The image as (height, width, 3) bytes: inverse transform, chroma upsampled by repetition, YCbCr to RGB."""
    top_h, top_v = max(p.h for p in parts), max(p.v for p in parts)
    planes = []
    for a, p in zip(arrays, parts, strict=True):
        rows, columns, _ = a.shape
        samples = a.reshape(-1, 64).astype(np.float32) @ _inverse(quantisers[p.quantiser].tobytes())
        plane = samples.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        plane = np.clip(np.rint(plane) + 128, 0, 255)
        if (p.v, p.h) != (top_v, top_h):
            plane = plane.repeat(top_v // p.v, axis=0).repeat(top_h // p.h, axis=1)
        planes.append(plane[:height, :width])
    if len(planes) < 3:
        return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, axis=2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.empty((height, width, 3), np.float32)
    out[:, :, 0] = y + 1.402 * cr
    out[:, :, 1] = y - 0.344136 * cb - 0.714136 * cr
    out[:, :, 2] = y + 1.772 * cb
    return np.clip(np.rint(out, out=out), 0, 255, out=out).astype(np.uint8)


def held_payload(arrays: list[np.ndarray], comments: list[bytes]) -> bytes | None:
    """The payload that :func:`encode` stored, or None in a file without any."""
    size = next((int(c[8:]) for c in comments if c.startswith(b"payload=")), None)
    if size is None:
        return None
    blocks = np.concatenate([a.reshape(-1, 64) for a in arrays])
    out = np.where(blocks > 0, blocks, blocks + 255)
    out[:, 0] = blocks[:, 0] + 128
    return out.astype(np.uint8).tobytes()[:size]


def feature(image: np.ndarray) -> str:
    """A 64-bit hash (cells of an 8 by 8 grid brighter than the mean), the mean colour and the size."""
    height, width, _ = image.shape
    grey = image.sum(axis=2, dtype=np.int64)
    rows, columns = np.arange(8) * height // 8, np.arange(8) * width // 8
    cells = np.add.reduceat(np.add.reduceat(grey, rows, axis=0), columns, axis=1).ravel()
    bits = np.packbits(cells * 64 > cells.sum()).tobytes().hex()
    mean = image.reshape(-1, 3).sum(axis=0, dtype=np.int64) // (height * width)
    return f"{bits}-{bytes(mean.astype(np.uint8)).hex()}-{width}x{height}"


def padded(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b"\xff")


ENCODED = "n_bytes long, media binary"
DECODED = "height int, width int, rgb binary, payload binary, feature string, error string"
DECODED_TYPES = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string())


def _beside(batch: pa.RecordBatch, part: slice, kept: Sequence[str], names: Sequence[str], added: Sequence[pa.Array]) -> pa.RecordBatch:
    """A slice of a batch's first columns, as they are (ids beside nulls stay whole numbers), and further columns."""
    columns = [c.slice(part.start, part.stop - part.start) for c in batch.columns[: len(kept)]]
    return pa.RecordBatch.from_arrays([*columns, *added], names=[*kept, *names])


def _limited(batch: pa.RecordBatch, sizes: list[int]) -> Iterator[slice]:
    """Slices of a batch of about ``BATCH_BYTES`` each, so that memory follows the largest row, not the batch."""
    held, start = 0, 0
    for i, n in enumerate(sizes, 1):
        held += n
        if held >= BATCH_BYTES or i == len(batch):
            yield slice(start, i)
            held, start = 0, i


def encode_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with n_bytes and media: the text's UTF-8 bytes as a progressive JPEG file.

    Null counts as empty. All rows stay, repeated ones too; equal texts give equal files. Columns named like an added one
    are replaced, all others stay whatever they are called.
    """
    keep = [f for f in docs.schema.fields if f.name not in {text_col, "n_bytes", "media"}]
    (source,) = fresh([*(f.name for f in keep), "n_bytes", "media"], "j_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [t or b"" for t in batch.column(batch.num_columns - 1).to_pylist()]
            for part in _limited(batch, [len(x) for x in data]):
                added = pa.array([len(x) for x in data[part]], pa.int64()), pa.array([encode(padded(x)) for x in data[part]], pa.binary())
                yield _beside(batch, part, [f.name for f in keep], ("n_bytes", "media"), added)

    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [ENCODED])
    return docs.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{text_col}`").cast("binary").alias(source)).mapInArrow(run, kinds)


def decode_media(files: DataFrame, media_col: str = "media", tensors: bool = True) -> DataFrame:
    """``files`` with height, width, rgb (the tensor's bytes, row by row), payload (null if the file holds none), feature and error.

    A null file gives nulls; a file that is no progressive JPEG, or a damaged one, gives nulls and what is wrong with it.
    ``tensors=False`` leaves rgb null where only what follows from it is wanted. Columns named like an added one are
    replaced, all others stay whatever they are called; all rows stay.
    """
    names = ["height", "width", "rgb", "payload", "feature", "error"]
    keep = [f for f in files.schema.fields if f.name not in names]

    def decoded(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6
        try:
            height, width, arrays, parts, quantisers, comments = coefficients(data)
            image = rgb(height, width, arrays, parts, quantisers)
            return height, width, image.tobytes() if tensors else None, held_payload(arrays, comments), feature(image), None
        except (ValueError, IndexError, KeyError, TypeError, OverflowError, ZeroDivisionError, MemoryError) as e:  # what damaged files lead to
            return (None,) * 5 + (f"{type(e).__name__}: {e}"[:200],)

    kept = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(kept.index(media_col)).to_pylist()
            for part in _limited(batch, [len(x or b"") for x in data]):
                rows = zip(*[decoded(x) for x in data[part]], strict=True)
                yield _beside(batch, part, kept, names, [pa.array(column, t) for column, t in zip(rows, DECODED_TYPES, strict=True)])

    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [DECODED])
    return files.select(*[F.col(f"`{f.name}`") for f in keep]).mapInArrow(run, kinds)


def store_media(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with its texts as media files, written to ``path``/media, read back, decoded, and stored with their tensors in ``path``/tensors.

    The table of tensors is returned, as read. It takes about 1.5 bytes of media and 2.3 of pixels for a byte of text.
    """
    files = encode_texts(docs, text_col)
    files.write.parquet(f"{path}/media")
    stored = docs.sparkSession.read.schema(files.schema).parquet(f"{path}/media")
    decoded = decode_media(stored)
    decoded.write.parquet(f"{path}/tensors")
    return docs.sparkSession.read.schema(decoded.schema).parquet(f"{path}/tensors")
