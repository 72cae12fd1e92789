"""WARC archives compressed with Zstandard: writer and reader.

An archive is a skippable frame (magic 0x184D2A5D) that holds a dictionary, then one Zstandard frame for each record, as
in the public "WARC/1.1 with Zstandard" layout. The reader loads the dictionary from that frame, decodes one frame at a
time, and validates version line, header fields, the record's length and its digest.

Rows with equal payloads of `least` bytes or more: the one with the largest id is a response, the others are revisit
records without payload that name it. The choice needs digests only: an aggregate per digest is written, then joined with
row numbers and digests, so that adaptive execution can split the copies of a hot payload (a side straight from an aggregate
can't be dealt anew). Payloads are shuffled once, by row number. Archives are bounded in bytes and kept as rows
(name, content) of a table in the shared folder, so any store that Spark can write holds them.

Defined cases: a null payload is empty; smaller payloads are all responses; repeated rows are records of their own, and
those that share the largest id are all responses; a null id is written as such and read as null; an empty table gives
no archives; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.llm.shared import by_bytes, saved, stable_rows

SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 16 << 10
#: WARC/1.1 names of header fields, and this writer's own for the payload's size.
TYPE, ID, REFERS, DIGEST, LENGTH, URI, SIZE = "WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Payload-Digest", "Content-Length", "WARC-Target-URI", "X-Payload-Length"
DATE, PROFILE, SAME_PAYLOAD = "WARC-Date", "WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of records whose pages say none.
NO_DATE = "1970-01-01T00:00:00Z"
VERSION = b"WARC/1.1"


class BadArchive(ValueError):
    """What is read is not an archive of this layout."""


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool, date: str = NO_DATE) -> bytes:
    clean = "".join(c for c in url or "" if c not in "\r\n")
    fields = [(TYPE, "revisit" if revisit else "response"), (ID, f"<urn:page:{'' if page_id is None else page_id}>"), (DATE, date), (URI, clean), (DIGEST, f"sha1:{digest}"), (SIZE, str(size))]
    if revisit:
        fields.append((PROFILE, SAME_PAYLOAD))
        fields.append((REFERS, f"<urn:page:{'' if refers_to is None else refers_to}>"))
    body = b"" if revisit else payload
    fields.append((LENGTH, str(len(body))))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + body + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A raw-content dictionary: the common heads and tails of a few payloads."""
    taken = b"".join(s[-256:] + s[:768] for s in samples[:64])
    return taken[-DICTIONARY_BYTES:] or b"\0" * 8


def write_archive(records: list[bytes], dictionary: bytes, level: int = 3) -> bytes:
    known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    coder = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True)
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary + b"".join(coder.compress(r) for r in records)


def frames(archive: bytes) -> Iterator[bytes]:
    """The decoded records of an archive, one frame each."""
    if len(archive) < 8:
        raise BadArchive("shorter than a frame header")
    magic, size = struct.unpack_from("<II", archive)
    if magic != SKIPPABLE or 8 + size > len(archive):
        raise BadArchive("the leading frame is no dictionary frame, or is cut off")
    dictionary = archive[8 : 8 + size]
    if dictionary[:4] == struct.pack("<I", FRAME):  # a dictionary may itself be compressed
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    known = zstandard.ZstdCompressionDict(dictionary)
    decoder = zstandard.ZstdDecompressor(dict_data=known)
    rest = memoryview(archive)[8 + size :]
    while len(rest):
        if len(rest) < 4 or struct.unpack_from("<I", rest)[0] != FRAME:
            raise BadArchive("no frame where a record should begin")
        try:
            one = decoder.decompressobj()
            text = one.decompress(rest)
        except zstandard.ZstdError as e:
            raise BadArchive(f"damaged frame: {e}") from e
        if not one.eof:
            raise BadArchive("the last frame is cut off")
        yield text
        rest = rest[len(rest) - len(one.unused_data) :]


def parse(text: bytes) -> dict:
    """Header fields and payload of one record, validated."""
    head, gap, body = text.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise BadArchive("no WARC/1.1 header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or name.decode() in fields:
            raise BadArchive(f"bad header line {line[:60]!r}")
        fields[name.decode()] = value.strip().decode()
    for name in (TYPE, ID, DATE, DIGEST, LENGTH, SIZE):
        if name not in fields:
            raise BadArchive(f"{name} is missing")
    if fields[TYPE] not in ("response", "revisit") or (fields[TYPE] == "revisit") != (REFERS in fields) or (fields[TYPE] == "revisit") != (fields.get(PROFILE) == SAME_PAYLOAD):
        raise BadArchive("bad record type")
    if not fields[LENGTH].isdecimal() or not fields[SIZE].isdecimal() or len(body) != int(fields[LENGTH]) + 4 or body[-4:] != b"\r\n\r\n":
        raise BadArchive("the record's length is not what its header says")
    payload = body[:-4]
    digest = fields[DIGEST].removeprefix("sha1:")
    if fields[TYPE] == "response" and (len(payload) != int(fields[SIZE]) or hashlib.sha1(payload).hexdigest() != digest):
        raise BadArchive("the payload is not what its digest says")
    return {"page_id": _page(fields[ID]), "url": fields.get(URI), "payload_bytes": int(fields[SIZE]), "payload_digest": digest, "record_type": fields[TYPE], "refers_to": _page(fields[REFERS]) if REFERS in fields else None, "payload": payload if fields[TYPE] == "response" else None}


def _page(urn: str) -> int | None:
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise BadArchive(f"bad record id {urn[:60]}")
    inner = urn[10:-1]
    return int(inner) if inner else None


def _write(archive_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "payload", archive_bytes):
            rows = batch.to_pylist()
            dictionary = train([r["payload"] for r in rows if r["payload"]])
            made = [record(r["id"], r["url"], r["payload"] or b"", r["size"], r["digest"], r["refers_to"], r["revisit"], date) for r in rows]
            content = write_archive(made, dictionary)
            name = f"pages-{hashlib.sha1(content).hexdigest()}.warc.zst"
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary()), pa.array([len(rows)], pa.int64())], names=["archive", "content", "records"])

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, archive_bytes: int = ARCHIVE_BYTES, date: str = NO_DATE) -> DataFrame:
    """Archives (archive, content, records) with a record for each row of pages; `date` is every record's."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = stable_rows(rows, "rid").withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    key = ["digest", "size"]
    large = saved(rows.where(F.col("size") >= least).select("rid", "id", *key), "digests")
    equal = saved(large.groupBy(*key).agg(F.max("id").alias("top"), F.count("*").alias("n")).where("n > 1").select(*key, "top"), "equal")
    copies = large.join(equal.hint("merge"), key).where(F.col("id").isNull() | (F.col("id") < F.col("top"))).select("rid", F.col("top").alias("refers_to"), F.lit(True).alias("revisit"))
    marked = rows.join(copies.hint("merge"), "rid", "left").withColumn("revisit", F.coalesce("revisit", F.lit(False)))
    marked = marked.select("id", "url", "size", "digest", "refers_to", "revisit", F.when(~F.col("revisit"), F.col("payload")).alias("payload"))
    return marked.mapInArrow(_write(archive_bytes, date), "archive string, content binary, records long")


def _read(with_payload: bool):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = [parse(f) for f in frames(batch.column("content")[i].as_py())]
                if len(found) != batch.column("records")[i].as_py():
                    raise BadArchive("the archive has not the number of records that was written")
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, types, strict=False)], names=names)

    return run


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of archives (content, records): page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return archives.select("content", "records").mapInArrow(_read(with_payload), schema + (", payload binary" if with_payload else ""))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages' archives to the shared folder and reads them back."""
    return read_archives(saved(write_archives(pages, **options), "warc"))
