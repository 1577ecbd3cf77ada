"""WARC archives with a Zstandard dictionary: written per partition, each record compressed on its own.

An archive is a dictionary, built from the archive's first records and embedded in a leading skippable frame, followed by
one frame per record. Archives are rows of a table (archive bytes and the records' offsets), so that Spark's committers
write them to any store, again if an executor is lost; the bytes of a row are a complete .warc.zst file.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table_path

#: Fixed values of the formats.
SKIPPABLE, TRAINED = 0x184D2A5D, b"\x37\xa4\x30\xec"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 1 << 20
DATE = "2026-01-01T00:00:00Z"
ARCHIVES = "archive binary, offsets array<long>"
RECORDS = "page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, url string, payload binary, error string"
BROADCAST_ROWS = 500_000  # revisits with whole-number ids, about 60 MB; more are joined by a shuffle
PageId = int | str


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: PageId | None, sha: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{sha}')}>"


def record(page_id: PageId | None, url: str | None, payload: bytes, refers_to: PageId | None, date: str = DATE) -> bytes:
    """A response record, or a revisit record without payload where refers_to is given."""
    sha = digest(payload)
    named = lambda i: urllib.parse.quote(str(i), safe="", errors="surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, sha)}", f"WARC-Date: {date}"]
    head.append("WARC-Target-URI: " + ("".join(url.split()) if url and url.strip() else f"urn:page:{named(page_id)}"))
    head.append(f"WARC-Payload-Digest: sha1:{sha}")
    if page_id is not None:
        head.append(f"WARC-Page-ID: {named(page_id)}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, sha)}", f"WARC-Refers-To-Page-ID: {named(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; from too little material, the records' own beginning as raw content."""
    pieces = [r[i : i + 4096] for r in records for i in range(0, len(r), 4096)]
    try:
        return zstandard.train_dictionary(size, pieces, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[:size]


def dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == TRAINED else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(data, dict_type=kind)


def archives(records: Iterator[bytes], size: int = ARCHIVE_BYTES) -> Iterator[tuple[bytes, list[int]]]:
    """Archives of about ``size`` bytes and the offset of each record's frame. Memory holds one archive and its sample."""
    more = True
    while more:
        sample, n = [], 0
        for r in records:
            sample.append(r)
            n += len(r)
            if n >= SAMPLE_BYTES:
                break
        else:
            more = False
        if not sample:
            return
        data = build_dictionary(sample)
        press = zstandard.ZstdCompressor(level=3, dict_data=dictionary(data), write_content_size=True)
        out, offsets = bytearray(struct.pack("<II", SKIPPABLE, len(data)) + data), []
        for r in sample:
            offsets.append(len(out))
            out += press.compress(r)
        while more and len(out) < size:
            r = next(records, None)
            if r is None:
                more = False
            else:
                offsets.append(len(out))
                out += press.compress(r)
        yield bytes(out), offsets


def embedded_dictionary(archive: bytes) -> tuple[zstandard.ZstdCompressionDict, int]:
    """The dictionary of an archive and the offset at which its records begin."""
    magic, n = struct.unpack_from("<II", archive)
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    return dictionary(archive[8 : 8 + n]), 8 + n


def read_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record, read one after another."""
    words, at = embedded_dictionary(archive)
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=words).stream_reader(io.BytesIO(archive[at:]), read_across_frames=True), 1 << 16)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("a record doesn't begin with its version")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            fields[name.lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a record ends early")
        yield fields, block
        stream.read(4)


def _write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def records() -> Iterator[bytes]:
        for batch in batches:
            for page_id, url, html, refers_to, date in zip(batch["w_page"], batch["w_url"], batch["w_html"], batch["w_refers"], batch["w_date"], strict=True):
                plain = lambda x: x if isinstance(x, str) else None if pd.isna(x) else int(x)
                yield record(plain(page_id), url, (html or "").encode("utf-8", "surrogatepass"), plain(refers_to), date)

    for archive, offsets in archives(records()):
        yield pd.DataFrame({"archive": [archive], "offsets": [offsets]})


def _parsed(fields: dict[str, str], block: bytes, whole: bool) -> tuple:
    page = lambda k: None if k not in fields else int(fields[k]) if whole else urllib.parse.unquote(fields[k], errors="surrogatepass")
    head, _, payload = block.partition(b"\r\n\r\n")
    kind, sha = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    length = int(head.rpartition(b"Content-Length: ")[2])
    wrong = kind == "response" and (length != len(payload) or digest(payload) != sha)
    error = f"record {fields['warc-record-id']} doesn't hold the payload it names" if wrong else None
    return page("warc-page-id"), length, sha, kind, page("warc-refers-to-page-id"), fields["warc-target-uri"], payload if kind == "response" else None, error


def revisits(pages: DataFrame, id_col: str, html_col: str, least: int) -> DataFrame:
    """v_page, v_digest, v_refers: the pages whose payload a larger page id has too. Only ids and digests are shuffled."""
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    ids = pages.filter(F.octet_length(html) >= least).select(F.col(f"`{id_col}`").cast(_kind(pages, id_col)).alias("v_page"), F.sha1(html).alias("v_digest"))
    largest = ids.groupBy("v_digest").agg(F.max("v_page").alias("v_refers"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    found = ids.join(largest, "v_digest").filter("v_page is null and v_refers is not null or v_page < v_refers")
    return cut(found.distinct(), "warc-revisits")


def _kind(pages: DataFrame, id_col: str) -> str:
    return "bigint" if pages.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long") else "string"


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date_col: str | None = None) -> DataFrame:
    """The archives of ``pages``, as written: archive (binary) and offsets. Other columns of ``pages`` aren't archived.

    Of records with equal payloads of at least ``least`` bytes the one with the largest page id is a response, the others
    revisit it. Page ids are whole numbers, or texts in the order of their code points. A null html is an empty payload,
    a null url is named after the page. A null page id is smaller than any. Rows that repeat an id and its payload are one
    capture, written as often: all responses or all revisits, with one record id. ``date_col`` has the records' time as
    text, such as 2026-01-01T00:00:00Z, which is also that of nulls and of all without such a column. An empty table has
    no archives. Up to ``BROADCAST_ROWS`` revisits go to the pages, which then don't move; more than that, or text ids,
    whose length has no bound, cost one shuffle of all pages.
    """
    kind = _kind(pages, id_col)
    back = revisits(pages, id_col, html_col, least)
    date = F.coalesce(F.col(f"`{date_col}`").cast("string"), F.lit(DATE)) if date_col else F.lit(DATE)
    rows = pages.select(F.col(f"`{id_col}`").cast(kind).alias("w_page"), F.col(f"`{url_col}`").cast("string").alias("w_url"), F.col(f"`{html_col}`").alias("w_html"), date.alias("w_date"))
    match = rows["w_page"].eqNullSafe(back["v_page"]) & (F.sha1(F.coalesce(rows["w_html"], F.lit(""))) == back["v_digest"])
    few = F.broadcast(back) if kind == "bigint" and back.count() <= BROADCAST_ROWS else back
    rows = rows.join(few, match, "left").select("w_page", "w_url", "w_html", "w_date", F.col("v_refers").alias("w_refers"))
    path = table_path(pages.sparkSession, "warc")
    rows.mapInPandas(_write, ARCHIVES).write.parquet(path)
    return pages.sparkSession.read.schema(ARCHIVES).parquet(path)


def read_archives(archives: DataFrame, kind: str = "bigint") -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (null for revisits), error.

    ``kind`` is the type of the page ids, bigint or string. A record that doesn't hold the payload it names has an error;
    a broken archive gives the records before the damage and a row with its error alone. A null archive has no records.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload", "error"]
        for batch in batches:
            for archive, offsets in zip(batch["archive"], batch["offsets"], strict=True):
                rows: list[tuple] = []
                try:
                    for fields, block in read_records(archive) if archive is not None else ():
                        rows.append(_parsed(fields, block, kind != "string"))
                    if archive is not None and offsets is not None and len(rows) != len(offsets):
                        raise ValueError(f"{len(rows)} of {len(offsets)} records")
                except (ValueError, KeyError, struct.error, zstandard.ZstdError, UnicodeDecodeError) as e:  # what broken archives lead to
                    rows.append((None,) * 7 + (f"{type(e).__name__}: {e}"[:200],))
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"payload_bytes": "Int64"} | ({} if kind == "string" else {"page_id": "Int64", "refers_to": "Int64"}))

    return archives.select("archive", "offsets").mapInPandas(run, RECORDS.format(kind=kind))
