"""WARC archives compressed record by record with a shared Zstandard dictionary.

A dictionary is trained on a bounded sample of records. Each archive starts with a skippable frame
that holds it; every record follows as a frame of its own, so one can be read from its offset with
the dictionary alone. Archives are written by Spark's own file writer and commit protocol, so a task
that is lost or run twice leaves one whole file: a row is the bytes of a frame, and the separator
between rows is an empty skippable frame, which readers of the format pass over.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import shared_dir

#: Magic numbers of the frames, as the formats fix them: dictionary, empty separator, Zstandard.
DICTIONARY_MAGIC, GAP, FRAME_MAGIC = 0x184D2A5D, b"P*M\x18\x00\x00\x00\x00", 0xFD2FB528
#: Bounds of the training sample and of the dictionary.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 1_000, 4_000_000, 65_536
#: Payload bytes of an archive, about.
ARCHIVE_BYTES = 256_000_000
#: Payloads shorter than this are always written in full.
LEAST_SHARED = 100
_DATE = "2024-01-01T00:00:00Z"


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest, refers_to): refers_to is the least id that has
    an equal payload of at least 100 bytes, where that is another's; null for responses.

    Payloads are UTF-8, null counts as empty. Rows with a null id never are the one referred to; rows
    that repeat the least id are all responses."""
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    own = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"),
        F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("digest"),
    )
    marks = pages.select(F.col(id_col).cast("long").alias("page_id"), F.octet_length(body).alias("n"), F.sha2(body, 256).alias("digest"))
    first = (
        marks.where(F.col("n") >= LEAST_SHARED).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("times")).where("times > 1").select("digest", "first")
    )
    joined = own.join(first, "digest", "left")
    refers = F.when((F.col("payload_bytes") >= LEAST_SHARED) & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """The bytes of a WARC record; a revisit has no payload, but the payload's digest and length."""
    name = f"<urn:page:{'' if page_id is None else page_id}>"
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": name,
        "WARC-Date": _DATE,
        "WARC-Target-URI": re.sub(r"[\r\n]", " ", url) if url is not None else None,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Payload-Length": str(length),
    }
    if refers_to is not None:
        head["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        payload = b""
    head["Content-Type"] = "text/html; charset=utf-8"
    head["Content-Length"] = str(len(payload))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + payload + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's headers (lower-cased names) and its payload; raises on a malformed record."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not mark or not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    found = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = int(found["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return found | {"payload": rest[:length]}


def train(records: list[bytes]) -> bytes:
    """A dictionary from sample records; empty where there are too few to train on."""
    if len(records) < 8:
        return b""
    total = sum(map(len, records))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 10)), records, level=3).as_bytes()
    except zstandard.ZstdError:
        return b""


def sample(pages: DataFrame, n: int, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> list[bytes]:
    """At most SAMPLE_ROWS records and SAMPLE_BYTES bytes of n pages, the same for the same rows. A share
    of the rows, by hash, is looked at, so that few are sent however many there are."""
    width, mark = SAMPLE_BYTES // SAMPLE_ROWS, F.xxhash64(id_col)
    share = min(1.0, 1.5 * SAMPLE_ROWS / max(1, n))
    near = pages.where(F.pmod(mark, F.lit(1_000_003)) <= int(share * 1_000_003))
    body = F.substring(F.coalesce(F.col(payload_col), F.lit("")).cast("binary"), 1, width)
    rows = near.select(mark.alias("_m"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"))
    chosen = rows.orderBy("_m", "page_id", "payload").limit(SAMPLE_ROWS).collect()
    made = [(r.page_id, r.url, bytes(r.payload)) for r in chosen]
    return [record(i, url, x, hashlib.sha256(x).hexdigest(), len(x), None) for i, url, x in made]


def _dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def write_archives(rows: DataFrame, folder: str, dictionary: bytes, level: int = 3) -> None:
    """Writes rows of with_revisits() as archives, one for each partition that has rows."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=True, write_checksum=True)
        begun = False
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256).to_pylist()
                frames = [packer.compress(record(r["page_id"], r["url"], r["payload"], r["digest"], r["payload_bytes"], r["refers_to"])) for r in part]
                if not begun:
                    frames.insert(0, _dictionary_frame(shared.value))
                    begun = True
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    frames = rows.select("page_id", "url", "payload", "payload_bytes", "digest", "refers_to").mapInArrow(run, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", GAP.decode("latin-1")).option("compression", "none").text(folder)


def frames(data: bytes) -> Iterator[tuple[bytes | None, bytes]]:
    """(dictionary, frame) of each record's frame; the dictionary is what the leading frame holds."""
    view, at, dictionary = memoryview(data), 0, b""
    while at < len(data):
        magic = struct.unpack_from("<I", view, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = struct.unpack_from("<I", view, at + 4)[0]
            if magic == DICTIONARY_MAGIC and at == 0:
                dictionary = bytes(view[8 : 8 + size])
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = at + _frame_length(view, at)
            yield dictionary, bytes(view[at:end])
            at = end
        else:
            raise ValueError(f"no frame at byte {at}")


def _frame_length(view: memoryview, at: int) -> int:
    """The length of a Zstandard frame, from its block headers."""
    kind = view[at + 4]
    single = kind >> 5 & 1
    size = 4 + 1 + (not single) + (0, 1, 2, 4)[kind & 3] + ((1 if single else 0), 2, 4, 8)[kind >> 6]
    while True:
        block = int.from_bytes(view[at + size : at + size + 3], "little")
        size += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return size + 4 * (kind >> 2 & 1)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to) of all records.

    Of a response, length and digest are those of the payload as read, and have to agree with its
    headers; of a revisit they are the headers', and the payload is null. A folder without archives
    gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows, size, reader, of = [], 0, None, None
                for dictionary, frame in frames(content.as_py()):
                    if reader is None or dictionary != of:
                        of = dictionary
                        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(of) if of else None)
                    rows.append(_row(parse(reader.decompress(frame))))
                    size += len(rows[-1][3] or b"")
                    if size > 4_000_000 or len(rows) == 1000:
                        yield packed(rows)
                        rows, size = [], 0
                if rows:
                    yield packed(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(run, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def _row(found: dict) -> tuple:
    def number(x: str | None) -> int | None:
        digits = (x or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    kind, digest = found["warc-type"], found["warc-payload-digest"].removeprefix("sha256:")
    length, payload = int(found["warc-payload-length"]), found["payload"]
    if kind == "response":
        if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("a payload differs from its headers")
    else:
        payload = None
    return number(found["warc-record-id"]), found.get("warc-target-uri"), kind, payload, length, digest, number(found.get("warc-refers-to"))


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the archives of pages to a folder (a new one in the shared folder by default) and reads
    them back."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    told = pages.agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("size")).first()
    archives = max(spark.sparkContext.defaultParallelism, (told["size"] or 0) // ARCHIVE_BYTES)
    # neighbouring partitions go to one archive: however finely a join is dealt, files stay few
    rows = with_revisits(pages).coalesce(archives)
    write_archives(rows, folder, train(sample(pages, told["n"])))
    return read_archives(spark, folder)


def payload_digest(column: Column) -> Column:
    """The bare hexadecimal SHA-256 of a text's UTF-8 bytes, null counting as empty."""
    return F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256)
