"""WARC archives: one gzip member per record, written by tasks and read by a
splittable reader.

Reading: the archives are cut into byte ranges.  A task looks for the gzip
magic from the start of its range, takes a place for a member only when the
bytes there inflate to a WARC header, and owns every record whose member
starts inside its range, reading past the end of the range to finish the
last one.  From a valid member on, the next starts where it ends; after
damaged bytes the search for the magic goes on.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import scratch_path
from .common import arrow_schema, batches_of, open_fs, shuffle_parts, write_file, written

MAGIC = b"\x1f\x8b\x08"
MIN_REVISIT_BYTES = 100
READ = 1 << 18
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _header_value(s: str) -> str:
    """Line ends and other controls, percent-encoded: a value is one line."""
    return "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in s)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record.  A revisit holds the HTTP header alone; its payload's
    digest and length are in its header.  A null page id or url is left out."""
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def deduplicated(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: of equal payloads of at
    least ``min_bytes`` that with the smallest page id is the response
    (``refers_to`` null) and the others revisit it.  Null html is an empty
    payload; rows without page id are responses; repeated rows of the
    smallest page id are all responses."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256))
    long = base.where((F.length("payload") >= min_bytes) & F.col("page_id").isNotNull())
    groups = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    groups = groups.where("first < last").select("digest", "first")
    return base.join(groups, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.expr("CASE WHEN first < page_id THEN first END").alias("refers_to")
    )


def write_archives(rows: DataFrame, path: str) -> DataFrame:
    """One ``.warc.gz`` file per task under ``path``; returns (path, bytes)."""

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        uri = f"{path}/part-{TaskContext.get().partitionId():06d}.warc.gz"

        def members():
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    for r in batch.slice(at, 256).to_pylist():
                        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                        raw = record_bytes(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"])
                        yield pack.compress(raw) + pack.flush()

        size = write_file(uri, members())
        yield pa.RecordBatch.from_pydict({"path": [uri], "bytes": [size]})

    return written(rows.mapInArrow(write, "path string, bytes long"), "warc-files").where("bytes > 0")


def _is_member(f, at: int) -> bool:
    f.seek(at)
    head = f.read(512)
    if not head.startswith(MAGIC):
        return False
    try:
        return zlib.decompressobj(31).decompress(head, 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def next_member(f, lo: int, hi: int) -> int | None:
    """The first valid member that starts in [lo, hi)."""
    while lo < hi:
        f.seek(lo)
        raw = f.read(min(READ, hi - lo + len(MAGIC) - 1))
        found = raw.find(MAGIC)
        while found >= 0:
            if lo + found < hi and _is_member(f, lo + found):
                return lo + found
            found = raw.find(MAGIC, found + 1)
        if len(raw) < len(MAGIC):
            return None
        lo += len(raw) - len(MAGIC) + 1
    return None


def read_member(f, at: int) -> tuple[bytes, int]:
    """The inflated member and the place behind it; ValueError if damaged."""
    f.seek(at)
    unpack, out, end = zlib.decompressobj(31), [], at
    while not unpack.eof:
        raw = f.read(READ)
        if not raw:
            raise ValueError("the member is cut off")
        try:
            out.append(unpack.decompress(raw))
        except zlib.error as e:
            raise ValueError(str(e)) from e
        end += len(raw)
    return b"".join(out), end - len(unpack.unused_data)


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return {
        "record_id": fields.get("warc-record-id"),
        "record_type": fields.get("warc-type"),
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"),
        "digest": fields.get("warc-payload-digest"),
        "payload_length": int(fields.get("x-payload-length", -1)),
        "payload": block.partition(b"\r\n\r\n")[2],
    }


def records_in(f, size: int, lo: int, hi: int):
    """Records whose members start in [lo, hi) of an open archive."""
    hi = min(hi, size)
    at = next_member(f, lo, hi)
    while at is not None and at < hi:
        try:
            raw, end = read_member(f, at)
            record = parse_record(raw)
        except (ValueError, KeyError):
            at = next_member(f, at + 1, hi)
            continue
        yield record
        at = end if end < hi and _is_member(f, end) else next_member(f, end, hi)


RECORD_SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, digest string, "
    "payload_length long, payload binary"
)


def read_archives(spark: SparkSession, files: DataFrame, split_bytes: int = 4 << 20) -> DataFrame:
    """All records of the archives ``(path, bytes)``, one task per group of
    byte ranges of ``split_bytes``; a task holds one record at a time."""
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("lo"))
    dealt = ranges.repartition(shuffle_parts(spark), "path", "lo")
    schema = arrow_schema(RECORD_SCHEMA)

    def read(batches):
        def each(rows):
            for r in rows:
                fs, path = open_fs(r["path"])
                with fs.open_input_file(path) as f:
                    for rec in records_in(f, r["bytes"], r["lo"], r["lo"] + split_bytes):
                        yield tuple(rec.values())

        yield from batches_of(each, schema, 64)(batches)

    return dealt.mapInArrow(read, RECORD_SCHEMA)


def _page(col: str) -> F.Column:
    return F.regexp_extract(col, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back: per record ``page_id,
    payload_bytes, payload_digest, record_type, refers_to``."""
    spark = pages.sparkSession
    files = write_archives(deduplicated(pages), scratch_path(spark, "warc"))
    records = read_archives(spark, files)
    whole = F.col("record_type") == "response"
    return records.select(
        _page("record_id").alias("page_id"),
        F.when(whole, F.length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.substring_index("digest", ":", -1)).alias("payload_digest"),
        "record_type",
        _page("refers_to").alias("refers_to"),
    )
