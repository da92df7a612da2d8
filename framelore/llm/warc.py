"""WARC archives of web pages, and a splittable reader for them.

Writing: one gzip member a record, so a reader can begin at any member. Payloads that repeat are stored once: of records with
equal payloads of at least LEAST_REVISIT bytes that of the largest page_id is a response, the others are revisits.

Reading: a task takes a byte range, looks for the gzip magic, and validates a candidate member by decoding its header lines.
It owns the records that start inside its range, reads the last one to its end beyond the range, and decodes member by member,
so one very large file is read by many tasks and a chance occurrence of the magic is no record.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, scratch, table

LEAST_REVISIT = 1000
RANGE_BYTES = 8 << 20
FILE_BYTES = 256 << 20
CHUNK = 1 << 16
MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One gzip member holding a record. Header values can hold no line ends, so those of a URL are percent-encoded."""
    target = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields and payload of a decoded member, or None if it is no whole record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not fields.get("content-length", "").isdigit():
        return None
    size = int(fields["content-length"])
    return (fields, rest[:size]) if len(rest) == size + 4 else None


def members(source, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of the members of a file that start in [start, end) and decode to records."""
    at = start
    while at < end:
        # Find the next place where the magic stands; it may run over a chunk's end.
        source.seek(at)
        data = source.read(min(CHUNK, size - at))
        hit = data.find(MAGIC)
        if hit < 0:
            if at + len(data) >= size:
                return
            at += max(1, len(data) - len(MAGIC) + 1)
            continue
        at += hit
        if at >= end:
            return
        decoded, length = _member(source, at, size)
        if decoded is None:
            at += 1
        else:
            yield at, decoded
            at += length


def _member(source, at: int, size: int) -> tuple[bytes | None, int]:
    """The decoded member at an offset and its length; None where the bytes there begin no record."""
    unpack = zlib.decompressobj(31)
    source.seek(at)
    out, read, valid = bytearray(), 0, False
    try:
        while not unpack.eof:
            data = source.read(min(CHUNK, size - at - read))
            if not data:
                return None, 0
            read += len(data)
            out += unpack.decompress(data)
            if not valid and len(out) >= 7:
                if not out.startswith(b"WARC/1."):
                    return None, 0
                valid = True
    except zlib.error:
        return None, 0
    return (bytes(out), read - len(unpack.unused_data)) if valid else (None, 0)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every row of ``pages`` to WARC files under ``folder``, a URI that pyarrow reads; returns path, bytes of each.

    Decisions about revisits come from digests alone; pages themselves are shuffled once, by page_id, so a group of equal
    pages is spread over all tasks. Within a group, rows that share the largest page_id are all responses. A null page_id
    counts as smaller than any other. A file is written under a name of its task's attempt and renamed when whole, so a lost
    or doubled attempt leaves no half file. A null html is an empty payload; a page is one record, held whole in memory however
    long. An empty table gives no files, and other columns are ignored.
    """
    spark = pages.sparkSession
    payload = F.coalesce("html", F.lit("")).cast("binary")
    base = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload").cast("long"))
    repeated = base.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    decisions = base.where(F.col("size") >= LEAST_REVISIT).select("page_id", "digest").join(repeated, "digest").where("first is not null and not page_id <=> first").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first").distinct()
    slices = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    joined = base.join(decisions, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    dealt = joined.select("page_id", "url", "payload", "digest", "size", F.col("first").alias("refers_to")).sortWithinPartitions("page_id", "digest")
    run_id = uuid.uuid4().hex

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, path = fs.FileSystem.from_uri(folder)
        out = None
        number = written = 0
        for page_id, url, payload, digest, size, refers_to in rows:
            if out is None:
                name = f"{path}/{run_id}-{task.partitionId():05d}-{number:04d}.warc.gz"
                part = f"{name}.{task.taskAttemptId()}"
                out, written = system.open_output_stream(part, compression=None), 0
            data = record("response" if refers_to is None else "revisit", page_id, url, payload, digest, size, refers_to)
            out.write(data)
            written += len(data)
            if written >= FILE_BYTES:
                out.close()
                system.move(part, name)
                yield name, written
                out, number = None, number + 1
        if out is not None:
            out.close()
            system.move(part, name)
            yield name, written

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    files = map_rows(dealt, ["page_id", "url", "payload", "digest", "size", "refers_to"], "path string, bytes long", run)
    manifest = f"{folder}-manifest"
    files.write.parquet(manifest)
    return spark.read.schema(files.schema).parquet(manifest)


def read_archives(files: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of the archives in ``files`` (path, bytes): record_type, page_id, url, payload_bytes, payload_digest, refers_to, payload.

    payload_bytes and payload_digest of a response are those of the payload read back; a revisit names those of the record
    it refers to.
    """
    spark = files.sparkSession
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    dealt = ranges.repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "start")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(folder)
        for path, size, start in rows:
            with system.open_input_file(path) as source:
                for _, data in members(source, size, start, min(size, start + range_bytes)):
                    found = parse(data)
                    if found is None:
                        raise ValueError(f"damaged record in {path}")
                    fields, payload = found
                    kind = fields["warc-type"]
                    own = kind == "response"
                    length = len(payload) if own else int(fields["x-payload-length"])
                    digest = hashlib.sha1(payload).hexdigest() if own else fields["warc-payload-digest"].removeprefix("sha1:")
                    url = fields["warc-target-uri"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                    yield kind, _page(fields["warc-record-id"]), url, length, digest, _page(fields.get("warc-refers-to", "")), payload if own else None

    return map_rows(dealt, ["path", "bytes", "start"], "record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary", run)


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    files = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(files, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
g AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g ON g.payload_digest = p.payload_digest
"""
