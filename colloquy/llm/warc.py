"""WARC archives: one gzip member per record, read back sequentially.

Writing: every record is a WARC/1.1 header, an empty line, the payload and two line ends, compressed as a gzip member of its own. Of records
with equal payloads of at least `least` bytes the one with the largest id is a response and the others are revisits
without payload that name it. Members are written with Spark's text writer: a member ends with a zero byte (the top of its
32-bit length; a record of 16 MB or more gets an empty member behind it), which becomes the line separator, so that the files hold
gzip members and nothing else. Records are dealt out evenly over files of about `archive_bytes`.

Reading: a task takes an archive and goes through its members with one incremental decompressor after another, in
pieces of `CHUNK` bytes; header lines end at an empty line, the content length frames the payload, and the SHA-1 of every payload is compared
with its header. A broken member or record raises an error that names archive and offset.

Defined results: a null payload is empty; equal rows are records of their own (of several with the largest id each is a
response); a record without an id refers to the response like the others, and is a response if no equal payload has an id. An empty
table gives an empty archive folder and no records. Columns besides id, url and payload are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.texts import byte_texts, prepared
from colloquy.session import shared_folder

#: Fixed values of the format: version line, line end, and the profile of a revisit with the same payload.
VERSION, END = b"WARC/1.1", b"\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST = 1000
ARCHIVE_BYTES = 16 << 20
CHUNK = 64 << 10


class Broken(ValueError):
    """An archive that can't be read."""


def plain(value: str | None) -> bytes:
    """A header value on one line."""
    return re.sub(rb"[\r\n]+", b" ", (value or "").encode("utf-8", "replace")).strip()


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member; of a revisit only the length and digest of the payload are stored."""
    digest = hashlib.sha1(payload).digest()
    name = b"none" if key is None else b"%d" % key
    head = [
        VERSION, b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_URL, f"{key} {url} {digest.hex()}")).encode() + b">",
        b"WARC-Target-URI: " + plain(url), b"WARC-Payload-Digest: sha1:" + base64.b32encode(digest),
        b"X-Payload-Length: %d" % len(payload), b"X-Record-Key: " + name,
    ]
    if revisit:
        head += [b"WARC-Profile: " + PROFILE, b"X-Refers-To-Key: %d" % refers_to]
    body = b"" if revisit else payload
    head += [b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(body)]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(END.join(head) + END + END + body + END + END) + deflate.flush()


def closed(member: bytes) -> bytes:
    """The member without its last byte, which is zero; if it isn't, an empty member that ends with zero follows."""
    if member[-1]:
        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
        member += deflate.compress(b"") + deflate.flush()
    return member[:-1]


def members(archive: bytes):
    """(offset, content) of every gzip member, decompressed step by step; empty members are passed over."""
    view, at = memoryview(archive), 0
    while at < len(view):
        inflate, parts, begin = zlib.decompressobj(31), [], at
        while not inflate.eof:
            piece = view[at : at + CHUNK]
            if not piece:
                raise Broken(f"the member at {begin} ends too early")
            try:
                parts.append(inflate.decompress(piece))
            except zlib.error as e:
                raise Broken(f"the member at {begin} is no gzip: {e}") from None
            at += len(piece) - len(inflate.unused_data)
        if content := b"".join(parts):
            yield begin, content


def parsed(content: bytes, where: str) -> dict:
    """Header fields (names in lower case) and payload of a record; lengths and digests are verified."""
    head, mark, rest = content.partition(END + END)
    lines = head.split(END)
    if not mark or lines[0] not in (VERSION, b"WARC/1.0"):
        raise Broken(f"no WARC record at {where}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken(f"a header line without a colon at {where}")
        fields[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    length = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else -1
    if length < 0 or rest[length:] != END + END:
        raise Broken(f"the content length doesn't frame the record at {where}")
    block = rest[:length]
    whole = fields.get("warc-block-digest", "")
    if whole.startswith("sha1:") and sha1_of(whole) != hashlib.sha1(block).hexdigest():
        raise Broken(f"a wrong block digest at {where}")
    # A captured HTTP message has its payload behind its own header.
    message = fields.get("content-type", "").replace(" ", "").lower().startswith("application/http")
    payload = block.partition(END + END)[2] if message else block
    said, kind = fields.get("warc-payload-digest", ""), fields.get("warc-type")
    digest = sha1_of(said) if said.startswith("sha1:") else None
    if kind != "revisit":
        own = hashlib.sha1(payload).hexdigest()
        if digest not in (None, own):
            raise Broken(f"a wrong digest at {where}")
        digest = own
    return {"fields": fields, "payload": payload, "digest": digest}


def sha1_of(said: str) -> str | None:
    """Hex SHA-1 from a digest field in base 32 or hex; None if it is neither."""
    value = said.removeprefix("sha1:")
    try:
        raw = bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())
    except ValueError:
        return None
    return raw.hex() if len(raw) == 20 else None


def write_archives(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the pages as WARC files into the folder `path`, which must not exist."""
    spark = pages.sparkSession
    prepared(spark)
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.coalesce(payload, F.lit("")).alias("payload"))
    size = F.octet_length("payload")
    # SHA-256, so that made-up SHA-1 twins stay apart.
    rows = rows.withColumn("content", F.unhex(F.sha2("payload", 256)))
    narrow = rows.where(size >= least).select("key", "content")
    firsts = narrow.groupBy("content").agg(F.max("key").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    # Digests alone move to find equal payloads; the payloads move once, to the task that writes their file.
    copies = narrow.join(firsts.select("content", "first"), "content").where("key is null or key <> first").distinct()
    total = rows.agg(F.sum(size + 600).alias("n")).head()["n"] or 0
    files = int(1 + total // (4 * archive_bytes))
    name = F.coalesce(F.col("key").cast("string"), F.lit("")).alias("name")
    whole = rows.select("key", "url", "payload", name, "content").repartition(files, "name", "content")
    named = copies.select(name, "content", "first").repartition(files, "name", "content")
    dealt = whole.join(named, ["name", "content"], "left").select("key", "url", "payload", "first")

    def compress(batches):
        for batch in batches:
            keys, urls, firsts = (batch.column(i).to_pylist() for i in (0, 1, 3))
            done = [closed(record(k, u, p, first, first is not None)) for k, u, p, first in zip(keys, urls, byte_texts(batch.column(2)), firsts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], names=["member"])

    dealt.mapInArrow(compress, "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\u0000").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record below path: key, url, record_type, refers_to, payload_bytes, payload_digest (hex), payload (null of a revisit), archive, offset.

    An archive is one cell of a task, so it should not be larger than some hundred megabytes; write_archives keeps that.
    """
    prepared(spark)
    schema = "key long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, archive string, offset long"
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in schema.split(", ")]

    def number(text: str | None) -> int | None:
        return int(text) if text and text.lstrip("-").isdigit() else None

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for offset, text in members(content.as_py()):
                    got = parsed(text, f"{name}, offset {offset}")
                    f, body = got["fields"], got["payload"]
                    revisit = f.get("warc-type") == "revisit"
                    rows.append((number(f.get("x-record-key")), f.get("warc-target-uri"), f.get("warc-type"), number(f.get("x-refers-to-key")), number(f.get("x-payload-length")) if revisit else len(body), got["digest"], None if revisit else body, name, offset))
                    held += len(body)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content").mapInArrow(read, schema)


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write pages into a new archive folder in the shared folder and read them back."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **options)
    return read_archives(spark, path)
