"""WARC archives in Zstandard: one frame a record, the dictionary in a leading skippable frame.

Files are written by Spark's text writer, which reaches any store that Spark reaches: each row is a frame, and what the
writer puts after each row is an empty skippable frame, which readers of the format pass over."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, small_batches, stage, stage_path

#: Fixed values of the format: little-endian numbers that start a frame, a dictionary's frame, a dictionary.
FRAME, DICTIONARY_FRAME, DICTIONARY = 0xFD2FB528, 0x184D2A5D, 0xEC30A437
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
#: A skippable frame of no bytes, all ASCII.
EMPTY_FRAME = "P*M\x18\0\0\0\0"
#: Records in a file, with the dictionary's row. Texts of a sample for the dictionary, bytes taken of each, its size.
PER_FILE, SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 4096, 256, 16384, 32768
#: Firsts of repeated payloads up to which they are broadcast.
BROADCAST_FIRSTS = 50_000
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, problem string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+|none)>", record)
    if not found:
        raise ValueError(f"no record id of a page: {record[:80]}")
    return None if found[1] == "none" else int(found[1])


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One WARC record: an HTTP response with its payload, or a revisit with the response's headers alone."""
    digest = sha1_base32(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda x: f"%{ord(x[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_to))]
    else:
        fields.append(("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"))
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def trained(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for records like the samples, or b"" where they are too few or too much alike for one."""
    if sum(map(len, samples)) < 8 * size:
        size = sum(map(len, samples)) // 8
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if size >= 256 else b""
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame: the dictionary, itself compressed."""
    body = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICTIONARY_FRAME, len(body)) + body


def headers(data: bytes, at: int, first: bytes) -> tuple[dict[str, str], int]:
    """Header fields of a block that begins with the line `first`, by lower-case name, and where its body begins."""
    end = data.find(b"\r\n\r\n", at)
    if not data.startswith(first, at) or end < 0:
        raise ValueError(f"no headers after {first.decode()}")
    fields = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#-'*+.0-9A-Z^-z|~-]+", name):
            raise ValueError(f"no header line: {line[:40]!r}")
        name = name.decode().lower()
        if name in fields:
            raise ValueError(f"header {name} twice")
        fields[name] = value.strip().decode()
    return fields, end + 4


def number(fields: dict[str, str], name: str) -> int:
    if not re.fullmatch(r"\d{1,18}", fields.get(name, "")):
        raise ValueError(f"{name} is no length: {fields.get(name)!r}")
    return int(fields[name])


def parsed(data: bytes) -> dict:
    """The page of one record of a frame, all of whose headers, lengths and digests must agree."""
    fields, at = headers(data, 0, b"WARC/1.1\r\n")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    size = number(fields, "content-length")
    if data[at + size :] != b"\r\n\r\n":
        raise ValueError(f"a block of {size} bytes does not end its record of {len(data)}")
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        raise ValueError(f"record of type {kind}")
    http, body = headers(data, at, b"HTTP/1.1 ")
    length, payload = number(http, "content-length"), data[body : at + size]
    digest = re.fullmatch(r"sha1:([A-Z2-7]{32})", fields.get("warc-payload-digest", ""))
    if not digest:
        raise ValueError("no payload digest")
    out = {"page_id": page_of(fields["warc-record-id"]), "record_type": kind, "payload_bytes": length, "payload_digest": digest[1], "refers_to": None, "payload": None}
    out["url"] = fields.get("warc-target-uri")
    if kind == "revisit":
        if payload or fields.get("warc-profile") != REVISIT:
            raise ValueError("a revisit with a payload or another profile")
        out["refers_to"] = page_of(fields.get("warc-refers-to", ""))
        return out
    if len(payload) != length:
        raise ValueError(f"{len(payload)} bytes of payload, {length} by its header")
    if sha1_base32(payload) != digest[1] or fields.get("warc-block-digest", "sha1:" + sha1_base32(data[at : at + size])) != "sha1:" + sha1_base32(data[at : at + size]):
        raise ValueError("a digest differs")
    return out | {"payload": payload}


def frames(archive: bytes, most: int = 1 << 31) -> Iterator[bytes]:
    """The records' bytes of an archive, one of each frame. A dictionary is loaded from the leading skippable frame, which
    holds it as it is or compressed; other skippable frames are passed over. No frame decodes to more than `most` bytes."""
    view, at, reader = memoryview(archive), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        if len(view) - at < 8:
            raise ValueError(f"{len(view) - at} bytes left over at {at}")
        magic, size = struct.unpack_from("<II", view, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(view):
                raise ValueError(f"a skippable frame of {size} bytes at {at} is cut off")
            if at == 0 and magic == DICTIONARY_FRAME:
                body = bytes(view[8 : 8 + size])
                if body[:4] == struct.pack("<I", FRAME):
                    body = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 27)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            at += 8 + size
            continue
        if magic != FRAME:
            raise ValueError(f"no frame at {at}")
        one, parts, got, where, ahead = reader.decompressobj(), [], 0, at, 4096
        while not one.eof and where < len(view):
            step = view[where : where + ahead]
            parts.append(one.decompress(step))
            got, where, ahead = got + len(parts[-1]), where + len(step), min(2 * ahead, 1 << 20)
            if got > most:
                raise ValueError(f"the frame at {at} is of over {most} bytes")
        if not one.eof:
            raise ValueError(f"the frame at {at} is cut off")
        at, told = where - len(one.unused_data), zstandard.get_frame_parameters(view[at : at + 18]).content_size
        if told not in (zstandard.CONTENTSIZE_UNKNOWN, got):
            raise ValueError(f"a frame of {got} bytes says {told}")
        yield b"".join(parts)


def firsts(pages: DataFrame) -> DataFrame:
    """digest, n, first: payloads (sha2 of the html) that several rows have, and the smallest page_id of each."""
    each = pages.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    return each.where("n > 1").select("digest", "first")


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", per_file: int = PER_FILE) -> None:
    """Write a record for each row of pages to `path` as .warc.zst files of at most per_file - 1 records.

    Of rows with equal payloads, those with the smallest page_id are responses and the others revisit it: the smallest id, so
    rows that repeat it are responses too. Null ids come last; where no row of a payload has an id, all are responses. A null
    html is empty, and equal to other empty ones. A null url is left out; what no URI may hold (white space, control characters)
    is written as %XX. The dictionary is trained on SAMPLE_BYTES bytes of
    each of SAMPLE rows, and changes sizes only. Payloads meet their first id by a broadcast of the repeated ones, where
    these are at most BROADCAST_FIRSTS, else by a join whose larger side adaptive execution splits.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("body", 256)))
    again = stage(firsts(rows.select("page_id", "digest")), "firsts")
    draw, one_in = F.xxhash64("page_id", "digest"), max(1, rows.count() // (4 * SAMPLE))
    some = rows.where((F.length("body") > 0) & (F.pmod(draw, F.lit(one_in)) == 0)).select(draw.alias("draw"), F.substring("body", 1, SAMPLE_BYTES).alias("body"))
    samples = [bytes(r.body) for r in some.orderBy("draw").limit(SAMPLE).collect()]
    dictionary = trained([record(k, f"https://host{k}.org/", x) for k, x in enumerate(samples)])
    lead = [dictionary_frame(dictionary)] if dictionary else []
    held = spark.sparkContext.broadcast((dictionary, lead))
    joined = rows.join(F.broadcast(again) if again.count() <= BROADCAST_FIRSTS else again, "digest", "left").select("page_id", "url", "body", "first")

    def packed(batches) -> Iterator[pa.RecordBatch]:
        dictionary, lead = held.value
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
        n = 0
        for b in small_batches(batches, "body"):
            out = []
            for page, address, body, first in zip(*(b.column(x).to_pylist() for x in ("page_id", "url", "body", "first")), strict=True):
                if n % (per_file - len(lead)) == 0:
                    out += lead
                n += 1
                out.append(c.compress(record(page, address, body, first, first is not None and page != first)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    files = joined.mapInArrow(packed, "frame binary").select(F.col("frame").cast("string").alias("value"))
    files.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", per_file).text(path)


def read(spark, path: str, strict: bool = True) -> DataFrame:
    """The records of all archives under `path`: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload
    (null for revisits) and problem. Headers, lengths and digests are checked; what is wrong raises, or without `strict`
    is told in `problem`, in a row of its own; after a broken frame the rest of its archive cannot be read and is one
    such row. Each archive is one row for Spark, of at most 2 GB."""
    bound_batches(spark)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "content"):
            for archive in b.column("content"):
                held, size = [], 0
                for row in _rows(archive.as_buffer(), strict):
                    held.append(row)
                    size += len(row["payload"] or b"") + 256
                    if size > 8 << 20:
                        yield _batch(held)
                        held, size = [], 0
                yield _batch(held)

    def _rows(archive, strict: bool) -> Iterator[dict]:
        none = dict.fromkeys(names)
        try:
            for data in frames(archive):
                try:
                    yield none | parsed(data)
                except ValueError as e:
                    if strict:
                        raise
                    yield none | {"problem": str(e)}
        except (ValueError, zstandard.ZstdError) as e:
            if strict:
                raise
            yield none | {"problem": f"unreadable from here: {e}"}

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def _batch(held: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], kinds[t]) for n, t in (x.split() for x in SCHEMA.split(", "))], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, SCHEMA)


def op12(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page's record, read back from the archives."""
    path = stage_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP12_SQL = """
WITH b AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), x AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', h[i]) - 3, 4)), '') AS bits FROM b
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * bits[5 * k + 1]::INT + 8 * bits[5 * k + 2]::INT + 4 * bits[5 * k + 3]::INT + 2 * bits[5 * k + 4]::INT + bits[5 * k + 5]::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM x
"""
