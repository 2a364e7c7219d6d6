"""WARC archives: one gzip member per record, written and read back in sequence.

Writing: each page becomes one record (response, or revisit of the page that
keeps the payload) in a gzip member of its own. Members reach the archive files
through Spark's text sink, so the files land wherever Spark can write, under its
commit protocol. The sink ends each value with a separator of one byte; a gzip
member of less than 16 MB ends in a zero byte (the top of its length field), so
that byte is the separator and the files hold the members and nothing else. A
longer member is followed by an empty member, which ends in zero, too. Members go to
the sink in chunks of some CHUNK bytes, CHUNKS_PER_FILE a file, and a member of k
chunks comes after k - 1 empty members, so a file has at most CHUNK * CHUNKS_PER_FILE
bytes and one member more, however long the pages are.

Reading: bytes of an archive pass in small pieces through incremental zlib
decompression, members are taken one after another, the header is parsed, the
block is framed by its Content-Length, and the payload digest is computed again.

Defined cases: null html is an empty payload; a null url is an empty target; a
null page_id sorts below every other and has an empty record id part; rows that
share the largest page_id of a payload are all responses; an empty table gives
no rows; further columns are ignored.
"""

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import fresh, kept

LEAST_REVISIT = 1000
LEVEL = 4
PIECE = 1 << 16
CHUNK, CHUNKS_PER_FILE = 4 << 20, 64
SALTS = 16

READ = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, digest_ok boolean, payload binary"


def record(page: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has no payload but names digest, length and record of the page it repeats."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = "" if page is None else str(page)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member; time and system fields are fixed, so equal records give equal bytes."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    if out[-1]:
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        out += packer.compress(b"") + packer.flush()
    return out


def members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The decompressed members of a stream of byte pieces, in order; an unfinished member is an error."""
    unpacker, out = zlib.decompressobj(31), []
    begun = False
    for piece in pieces:
        while piece:
            begun = True
            out.append(unpacker.decompress(piece))
            piece = unpacker.unused_data
            if unpacker.eof:
                whole = b"".join(out)
                if whole:
                    yield whole
                unpacker, out, begun = zlib.decompressobj(31), [], False
            else:
                piece = b""
    if begun:
        raise EOFError("the archive ends inside a gzip member")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record, framed by its Content-Length."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) != size or data[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError("a record's block doesn't have its Content-Length")
    return fields, block


def _written(batches, chunk):
    def out(values):
        return pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], names=["value"])

    held, size, empty = [], 0, member(b"")[:-1]
    for batch in batches:
        for page, url, payload, first, revisit in zip(*(batch.column(k) for k in range(5)), strict=True):
            data = member(record(page.as_py(), url.as_py(), payload.as_py(), first.as_py(), revisit.as_py()))
            if held and size + len(data) > chunk:
                yield out([b"".join(held)[:-1]])
                held, size = [], 0
            if len(data) > chunk:
                yield out([empty] * ((len(data) - 1) // chunk))
            held.append(data)
            size += len(data)
    if held:
        yield out([b"".join(held)[:-1]])


def _page(name: str | None) -> int | None:
    digits = (name or "")[len("<urn:page:") : -1]
    return int(digits) if digits else None


def _read(batches):
    for batch in batches:
        for content in batch.column(0):
            view = memoryview(content.as_buffer())
            rows, held = [], 0
            for data in members(bytes(view[k : k + PIECE]) for k in range(0, len(view), PIECE)):
                fields, block = parse(data)
                revisit = fields["WARC-Type"] == "revisit"
                told = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                found = told if revisit else hashlib.sha1(block).hexdigest()
                size = int(fields["WARC-Payload-Length"]) if revisit else len(block)
                rows.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"],
                             _page(fields.get("WARC-Refers-To")), found, size, found == told, None if revisit else block))
                held += len(block)
                if held > 4 << 20 or len(rows) >= 2000:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows):
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]
    names = [x.split()[0] for x in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, first, revisit: `first` is the largest page_id of the equal payloads of at least LEAST_REVISIT bytes.

    Payloads are equal if SHA-256 and length agree. Counting sees digests only. A repeated digest's row is laid out
    under SALTS salts, so the pages of one payload are dealt out over as many tasks; pages too short to repeat each
    have a key of their own.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        payload.alias("payload"),
        F.when(F.length(payload) >= LEAST_REVISIT, F.sha2(payload, 256)).alias("digest"),
    )
    repeated = kept(
        rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("same"), "first"),
        "repeated-payloads",
    )
    salted = repeated.select("same", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("dealt"))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    short = F.concat(F.lit("short:"), F.xxhash64("page_id", "url").cast("string"))
    keyed = rows.select("page_id", "url", "payload", F.coalesce("digest", short).alias("digest"), salt.alias("salt"))
    joined = keyed.join(salted, (F.col("digest") == F.col("same")) & (F.col("salt") == F.col("dealt")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "first", revisit.alias("revisit"))


def write(pages: DataFrame, path: str, chunk: int = CHUNK, chunks: int = CHUNKS_PER_FILE) -> None:
    """WARC files under `path`, as many as the plan has tasks or more, of at most `chunks` chunks of some `chunk` bytes and one member more."""
    packed = with_revisits(pages).mapInArrow(partial(_written, chunk=chunk), "value binary")
    packed.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", chunks).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files under `path`, with payloads and the outcome of the digest check."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    path = fresh(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)
