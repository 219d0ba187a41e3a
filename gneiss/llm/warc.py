"""Operator 9: dictionary-compressed WARC archives.

An archive starts with a skippable Zstandard frame that holds a dictionary built from records of the
archive itself; each record follows as a frame of its own, compressed with that dictionary, so any
record can be read with the dictionary and its offset alone.  Payloads are not shuffled: only the
digests of repeated ones are, and their keepers go to where the pages are read.  Archives are rows (name, records,
data) of about ARCHIVE_BYTES each: Spark's writers bring them to any store.

Records whose payloads are equal and of at least `least` bytes are stored once, with the largest
page id; the others are revisit records that name it.  Null payloads are empty.  Repeated rows of
the same id and payload: all that carry the largest id are responses.  Rows without an id revisit
like others but are never the stored one unless no other exists.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.base import durable, pick

SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
BROADCAST_BYTES = 64_000_000  # repeated payloads' digests and keepers are sent to the pages up to this size
HOT_SHARE = 10_000  # beyond it, digests of at least this part of all pages are still sent, and only they
ARCHIVE_BYTES = 8_000_000  # of payload in one archive; one larger record makes an archive of its own
DICTIONARY_BYTES = 32_768  # at most; a small archive has a dictionary of a 32nd of its records' bytes
TRAINING_BYTES = 1_500_000  # records that a dictionary is built from, spread over the archive
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # Fixed value: the URL namespace of RFC 4122


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}')}>"


def encode_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes) -> tuple[dict[str, str], bytes]:
    end = data.index(b"\r\n\r\n")
    version, *lines = data[:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    size = int(headers["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) != size or data[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError("truncated WARC record")
    return headers, block


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from records taken at even steps; few or small ones are used raw."""
    total = sum(map(len, records))
    step = max(1, -(-total // TRAINING_BYTES))
    samples = records[::step]
    size = min(DICTIONARY_BYTES, max(1024, total // 32))
    if sum(map(len, samples)) >= 5 * size and len(samples) >= 8:
        try:
            return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
        except zstandard.ZstdError:  # too uniform for the trainer
            pass
    return b"".join(r[: size // max(1, len(samples))] for r in samples)[:size]


def compress(records: list[bytes], level: int = 3) -> bytes:
    """An archive of the records."""
    raw = build_dictionary(records)
    dictionary = zstandard.ZstdCompressionDict(raw)
    dictionary.precompute_compress(level=level)
    writer = zstandard.ZstdCompressor(dict_data=dictionary, write_checksum=True, write_content_size=True)
    return struct.pack("<II", SKIPPABLE, len(raw)) + raw + b"".join(map(writer.compress, records))


def decompress(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        end = frame_end(data, at)
        yield reader.decompress(view[at:end])
        at = end


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends: by its header and the sizes of its blocks,
    without decompressing anything."""
    try:
        magic, flags = struct.unpack_from("<IB", data, at)
        if magic != FRAME:
            raise ValueError("not a Zstandard frame")
        single = flags >> 5 & 1
        content = (1 if single else 0, 2, 4, 8)[flags >> 6]
        at += 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + content
        last = 0
        while not last:
            head = int.from_bytes(data[at : at + 3], "little")
            last = head & 1
            at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)  # a run is one byte, whatever its length
            if at > len(data):
                raise ValueError("truncated archive")
        at += 4 * (flags >> 2 & 1)
    except struct.error as short:
        raise ValueError("truncated archive") from short
    if at > len(data):
        raise ValueError("truncated archive")
    return at


def with_keepers(rows: DataFrame, kept: DataFrame, size: int, repeated: int, least: int, bound: int = BROADCAST_BYTES) -> DataFrame:
    """rows with `kept`, the page that keeps the payload, null where the payload is not repeated.  The
    table of repeated digests (`size` bytes) goes to the pages, which stay where they are read; where
    it is too large, digests of many pages still do, and only pages of other digests are shuffled."""
    on = (F.col("digest") == F.col("kept_digest")) & (F.octet_length("payload") >= least)
    if size <= bound:
        return rows.join(F.broadcast(kept.drop("n")), on, "left").drop("kept_digest")
    many = F.col("n") * HOT_SHARE >= repeated  # at most HOT_SHARE digests
    hot = rows.join(F.broadcast(kept.filter(many).select("kept_digest", F.col("kept").alias("hot_kept"))), on, "left").withColumnRenamed("kept_digest", "hot_digest")
    rest = hot.filter("hot_digest IS NULL").drop("hot_digest", "hot_kept").join(kept.filter(~many).drop("n"), on, "left").drop("kept_digest")
    return hot.filter("hot_digest IS NOT NULL").withColumnRenamed("hot_kept", "kept").drop("hot_digest").unionByName(rest)


def archives(df: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least: int = 1000) -> DataFrame:
    """Rows archive (name), records, data (binary): every row of df becomes a WARC record."""
    rows = pick(df, page_id=id_column, url=url_column, html=payload_column)
    rows = rows.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    # the page that keeps a repeated payload: one row per repeated digest, counted before the shuffle
    large = rows.filter(F.octet_length("payload") >= least).select("page_id", "digest")
    kept = large.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("kept_digest"), "kept", "n")
    kept = durable(kept)
    told = kept.agg(F.count("*"), F.sum("n"), F.coalesce(F.sum(F.octet_length(F.col("kept").cast("string"))), F.lit(0)).cast("long")).first()
    joined = with_keepers(rows, kept, told[0] * 60 + told[2], told[1] or 0, least)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    joined = joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))

    def write(batches):
        held, size = [], 0

        def close():
            data = compress([encode_record(h, b) for h, b in held])
            name = hashlib.sha1(data).hexdigest()[:16] + ".warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([data], pa.binary())], names=["archive", "records", "data"])

        for batch in batches:
            for page, url, payload, digest, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                page, payload, refers_to = page.as_py(), payload.as_py(), refers_to.as_py()
                head = [
                    ("WARC-Type", "response" if refers_to is None else "revisit"),
                    ("WARC-Record-ID", record_id(page)),
                    ("WARC-Date", "1970-01-01T00:00:00Z"),
                    ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: f"%{ord(m[0]):02X}", url.as_py() or "urn:none")),
                    ("Content-Type", "text/html"),
                    ("WARC-Payload-Digest", f"sha1:{digest.as_py().hex()}"),
                    ("Page-ID", "" if page is None else str(page)),
                    ("Payload-Length", str(len(payload))),
                ]
                if refers_to is not None:
                    head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to)), ("Refers-To-Page", str(refers_to))]
                    payload = b""
                held.append((head, payload))
                size += len(payload) + 500
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return joined.mapInArrow(write, "archive string, records long, data binary")


def read(archived: DataFrame, kind: str = "long") -> DataFrame:
    """One row per record: page_id, url, record_type, payload_bytes and payload_digest (of the full
    payload; a response's are recomputed from the stored bytes and must agree), refers_to, payload."""

    def run(batches):
        for batch in batches:
            for data in batch.column("data"):
                out = []
                for record in decompress(data.as_py()):
                    h, block = decode_record(record)
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and hashlib.sha1(block).hexdigest() != digest:
                        raise ValueError(f"digest of {h['WARC-Record-ID']} does not match its payload")
                    size = len(block) if h["WARC-Type"] == "response" else int(h["Payload-Length"])
                    out.append((h["Page-ID"] or None, h["WARC-Target-URI"], h["WARC-Type"], size, digest, h.get("Refers-To-Page"), block))
                columns = [*zip(*out, strict=True)] or [()] * 7
                kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    got = archived.select("data").mapInArrow(run, "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary")
    return got.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def export(archived: DataFrame, folder: str) -> None:
    """Writes each archive as a file of its own into a folder that is mounted on all executors."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("archive"), batch.column("data"), strict=True):
                with open(f"{folder}/{name.as_py()}", "wb") as f:
                    f.write(data.as_py())
            yield batch.select(["archive"])

    archived.select("archive", "data").mapInArrow(run, "archive string").count()
