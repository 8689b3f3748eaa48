"""WARC archives compressed with Zstandard: one frame a record, the dictionary in the leading frame.

Writing goes through Spark's text writer, which puts a column's bytes into files of any store and
commits them task by task. Its line separator is an empty skippable frame, which decoders pass
over, so the files are plain ``.warc.zst`` content. Reading goes through the binary file source.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowframe.llm.common import arrow_map, column_name, materialize, scratch_path

#: Fixed values of the formats.
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
EMPTY_FRAME = b"\x50\x2a\x4d\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: Headers that a record may have more than once.
REPEATABLE = ("warc-concurrent-to",)
DATE = re.compile(r"\d{4}(-\d\d(-\d\d(T\d\d:\d\d(:\d\d(\.\d{1,9})?)?Z)?)?)?")

#: An archive is closed once it holds this many bytes; the reader takes one archive at a time.
ARCHIVE_BYTES = 32 << 20
#: A dictionary is trained on up to so many leading payloads of its archive, of so many bytes each.
DICTIONARY_SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 8 << 10, 32 << 10
#: A record that would be larger is a fault: a small frame may unpack to anything.
MOST_RECORD_BYTES = 1 << 30
#: Repeated payloads up to this number are sent to the tasks; beyond it they meet their pages in a join.
BROADCAST_GROUPS = 100_000


class BadRecord(ValueError):
    """A frame, header or length that does not hold."""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str | None, name: str) -> str:
    """A header value: a null or empty address is named after its record, blanks and controls are escaped."""
    if not url:
        return name
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def format_record(name: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}",
            f"WARC-Target-URI: {_clean(url, name)}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes], once: bool = False) -> dict[str, str]:
    """Names in lower case; with ``once`` only REPEATABLE ones may be there twice."""
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise BadRecord(f"not a header: {line[:80]!r}")
        known = name.decode("utf-8", "replace").lower()
        value = value.strip().decode("utf-8", "replace")
        if known in out and (once and known not in REPEATABLE or known == "content-length" and out[known] != value):
            raise BadRecord(f"two headers {known}")
        out[known] = value
    return out


def _number(text: str, what: str) -> int:
    if not (text.isascii() and text.isdigit()):
        raise BadRecord(f"{what} is not a number: {text[:40]!r}")
    return int(text)


def parse_record(data: bytes) -> tuple:
    """(record_id, record_type, target_uri, date, payload_digest, payload_bytes, refers_to, payload) of one record.

    Checks the version, that the required headers are there and none is doubled, the date's form,
    the block's length and end, the HTTP content length and the payload's digest.
    """
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or not version.startswith(b"WARC/1."):
        raise BadRecord("no WARC header")
    h = _headers(lines, once=True)
    for name in REQUIRED:
        if name not in h:
            raise BadRecord(f"no {name}")
    if not DATE.fullmatch(h["warc-date"]):
        raise BadRecord(f"not a date: {h['warc-date'][:40]!r}")
    length = _number(h["content-length"], "content-length")
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise BadRecord(f"content-length {length} against {max(0, len(rest) - 4)} bytes")
    block, kind = rest[:length], h["warc-type"]
    name, refers = h["warc-record-id"].strip("<>"), h.get("warc-refers-to")
    payload, size = block, length
    if h.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise BadRecord("no end of the HTTP header")
        told = _headers(http.split(b"\r\n")[1:]).get("content-length")
        size = len(payload) if told is None else _number(told, "HTTP content-length")
    if kind == "revisit":
        if refers is None:
            raise BadRecord("a revisit that refers to nothing")
        payload = None
    elif size != len(payload):
        raise BadRecord(f"HTTP content-length {size} against {len(payload)} bytes")
    digest = h.get("warc-payload-digest", "")
    if digest.startswith("sha1:"):
        digest = digest[5:]
        if payload is not None and digest != digest_of(payload):
            raise BadRecord("the payload does not have its digest")
    return name, kind, h.get("warc-target-uri"), h["warc-date"], digest or None, size, refers.strip("<>") if refers else None, payload


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, by its header and the headers of its blocks."""
    if at + 6 > len(data) or data[at:at + 4] != FRAME_MAGIC:
        raise BadRecord(f"no frame at byte {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    last = False
    while not last:
        if at + 3 > len(data):
            raise BadRecord("the archive ends inside a frame")
        word = int.from_bytes(data[at:at + 3], "little")
        last, kind, size = word & 1, word >> 1 & 3, word >> 3
        if kind == 3:
            raise BadRecord("a block of a reserved kind")
        at += 3 + (1 if kind == 1 else size)
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise BadRecord("the archive ends inside a frame")
    return at


def unpack(reader: zstandard.ZstdDecompressor, frame: bytes, most: int = MOST_RECORD_BYTES) -> bytes:
    """What a frame holds, unpacked piece by piece and never beyond ``most`` bytes."""
    told = zstandard.frame_content_size(frame)
    if told > most:
        raise BadRecord(f"a record of {told} bytes")
    parts, size = [], 0
    with reader.stream_reader(frame) as stream:
        while part := stream.read(1 << 20):
            size += len(part)
            if size > most:
                raise BadRecord(f"a record of more than {most} bytes")
            parts.append(part)
    return b"".join(parts)


def records(data: bytes) -> Iterator[bytes | BadRecord]:
    """The records of one archive, a frame each; a frame that cannot be read ends it with the fault."""
    at, dictionary = 0, None
    try:
        if data[:4] == DICTIONARY_MAGIC:
            size = struct.unpack_from("<I", data, 4)[0]
            own = data[8:8 + size]
            if len(own) != size:
                raise BadRecord("the dictionary is cut off")
            if own[:4] == FRAME_MAGIC:
                own = unpack(zstandard.ZstdDecompressor(), own)
            dictionary, at = zstandard.ZstdCompressionDict(own), 8 + size
        reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
        while at < len(data):
            if data[at + 1:at + 4] == b"\x2a\x4d\x18" and data[at] >> 4 == 5:
                if at + 8 > len(data):
                    raise BadRecord("the archive ends inside a skippable frame")
                at += 8 + struct.unpack_from("<I", data, at + 4)[0]
                continue
            end = frame_end(data, at)
            yield unpack(reader, data[at:end])
            at = end
    except (BadRecord, zstandard.ZstdError, struct.error) as fault:
        yield fault if isinstance(fault, BadRecord) else BadRecord(str(fault))


def train(payloads: list[bytes]) -> bytes | None:
    """A Zstandard dictionary for payloads, None where there are too few to train one."""
    samples = [p[:SAMPLE_BYTES] for p in payloads if p]
    if len(samples) < 16 or sum(map(len, samples)) < 16 * 1024:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return None


def revisits(pages: DataFrame, id_col: str, payload_col: str, first: str, least_bytes: int) -> DataFrame:
    """Adds ``first``: for payloads held by several rows, the largest id that holds them (else null).

    Payloads are equal where their SHA-256 digests are. Those of under ``least_bytes`` bytes stay apart.
    """
    key, other = column_name(pages, "payload_hash"), column_name(pages, "payload_hash_of")
    content = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    named = pages.withColumn(key, F.when(F.length(content) >= least_bytes, F.unhex(F.sha2(content, 256))))
    groups = named.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(other)).agg(F.max(id_col).alias(first), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    groups = materialize(groups, "warc-groups")
    # proven by counting; otherwise a join that adaptive execution splits
    few = groups.count() <= BROADCAST_GROUPS
    return named.join(F.broadcast(groups) if few else groups, F.col(key) == F.col(other), "left").drop(key, other)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   least_revisit_bytes: int = 0, prefix: str = "urn:page:", date: str = "2020-01-01T00:00:00Z", level: int = 3) -> str:
    """Writes one record a row into archives under ``path``; returns the path.

    Of rows with equal payloads of ``least_revisit_bytes`` bytes and more, those with the largest
    id become responses, all others revisits of it. (Rows that repeat both id and payload are all
    responses.) Null payloads are empty ones. Null ids count as smaller than others; their records
    are named "null". Null and empty addresses become the record's name. Other columns are not
    written. An empty table makes no archive. Each task writes archives of about ARCHIVE_BYTES,
    each with its own dictionary, trained on its leading payloads where there are enough. A record
    is held whole, so a payload must fit into a task's memory a few times over.
    """
    first = column_name(pages, "first_id")
    rows = revisits(pages, id_col, payload_col, first, least_revisit_bytes)
    refers = F.when(F.col(first).isNotNull() & ~F.col(id_col).eqNullSafe(F.col(first)), F.concat(F.lit(prefix), F.col(first).cast("string")))
    rows = rows.select(F.concat(F.lit(prefix), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("name"), F.col(url_col).cast("string").alias("url"),
                       F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"), refers.alias("refers_to"))

    def write(batches):
        import pyarrow as pa

        roll = seq = size = 0
        held, writer = [], None

        def table(parts):
            nonlocal seq
            out = pa.RecordBatch.from_arrays([pa.array([roll] * len(parts), pa.int32()), pa.array(range(seq, seq + len(parts)), pa.int64()), pa.array(parts, pa.binary())], names=["roll", "seq", "frame"])
            seq += len(parts)
            return out

        def opened():
            """The dictionary's frame, if there is one, and a compressor that uses it."""
            own = train([r[2] for r in held])
            options = {"level": level, "write_checksum": True, "write_content_size": True}
            if own is None:
                return [], zstandard.ZstdCompressor(**options)
            return [DICTIONARY_MAGIC + struct.pack("<I", len(own)) + own], zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(own), **options)

        def pack():
            nonlocal held, writer, size, roll
            parts = []
            if writer is None:
                parts, writer = opened()
            parts += [writer.compress(format_record(*r, date)) for r in ((n, u, p, f) for n, u, p, f in held)]
            held = []
            out = table(parts)
            size += sum(map(len, parts))
            if size >= ARCHIVE_BYTES:
                roll, size, writer = roll + 1, 0, None
            return out

        held_bytes = 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = tuple(batch.column(c)[k].as_py() for c in range(4))
                held.append(row)
                held_bytes += len(row[2])
                if len(held) >= DICTIONARY_SAMPLES or held_bytes >= 4 << 20:
                    held_bytes = 0
                    yield pack()
        if held:
            yield pack()

    frames = rows.mapInArrow(write, "roll int, seq bigint, frame binary").sortWithinPartitions("roll", "seq")
    frames.select("roll", F.col("frame").cast("string").alias("value")).write.partitionBy("roll").option("lineSep", EMPTY_FRAME.decode("latin-1")).option("maxRecordsPerFile", 0).text(path)
    return path


def read_archives(spark: SparkSession, path: str, payload: bool = True, strict: bool = True) -> DataFrame:
    """One row a record of the archives under ``path``.

    (record_id, record_type, target_uri, date, payload_digest string, payload_bytes bigint,
    refers_to string, payload binary, error string). payload_bytes and payload_digest are those of
    the full payload, for revisits as their headers tell. A revisit's payload is null. A record
    that fails a check raises an error, or with ``strict`` false becomes a row with only ``error``.
    An archive is read as one row: it must be smaller than 2 GB and fit into a task's memory, as those
    that write_archives makes do. A record that unpacks to more than MOST_RECORD_BYTES fails. Records
    of equal names are records like others; an empty folder gives no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def make():
        def run(data):
            for record in records(data):
                try:
                    if isinstance(record, BadRecord):
                        raise record
                    *fields, body = parse_record(record)
                    yield (*fields, body if payload else None, None)
                except BadRecord as fault:
                    if strict:
                        raise
                    yield (None,) * 8 + (str(fault),)

        return run

    return arrow_map(files, make, "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_bytes bigint, refers_to string, payload binary, error string")


def archive_path(spark: SparkSession) -> str:
    return scratch_path(spark, "warc")
