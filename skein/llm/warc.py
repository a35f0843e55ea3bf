"""WARC archives: written with an index of byte ranges first, read back by coalesced ranges of the selected records.

Each task writes one archive of gzip members, a record each, under a name of its own attempt; the index (Parquet: page id,
file, offset, length, URL, digest, record type) is the tasks' committed output, so that a second attempt or a lost executor
leaves a file that no index row names. Equal payloads of at least `least` bytes are stored once: the record with the smallest
page id is the response, the others revisit it. A reader selects index rows, sorts their ranges and reads neighbours together.

Defined cases: a null html is an empty payload; a null URL is `urn:page:<id>`; a null id never is the one referred to while
another holds the payload; rows that repeat an id and a payload are responses alike where that id is the smallest; an empty
table gives an empty index; further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import bounded_batches, join_checked, open_fs, released, task_count, task_tag, written

INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string, record_type string"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Ranges that are at most so far apart are read at once, up to so many bytes a read.
GAP, READ = 64 << 10, 4 << 20
#: Bytes of records that a task reads, about.
TASK = 64 << 20
#: A fixed value: payloads carry no date, and records of one content shall be equal.
DATE = "1970-01-01T00:00:00Z"


def _record(page_id, url: str, payload: bytes | None, n: int, digest: str, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    block = http + (payload or b"") if kind == "response" else http
    name = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Identified-Payload-Length: {n}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_fs(folder)
        name, out, place = f"{task_tag()}.warc.gz", None, 0
        for b in batches:
            rows = []
            for page, url, html, n, digest, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "n", "digest", "refers_to")), strict=True):
                if out is None:
                    fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                url = " ".join(url.split()) if url else f"urn:page:{'' if page is None else page}"
                data = _record(page, url, html.encode() if html and first is None else None, n, digest, first)
                out.write(data)
                rows.append((page, name, place, len(data), url, digest, "response" if first is None else "revisit"))
                place += len(data)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            names = ("page_id", "file", "offset", "length", "url", "payload_digest", "record_type")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=names)
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str, least: int = 100) -> None:
    """Write archives and their index below a new folder."""
    bounded_batches(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("n"), F.sha2(html, 256).alias("digest"))
    large = rows.where(F.col("n") >= least).groupBy(F.col("digest").alias("__digest")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    first = written(large.select("__digest", "first"), "copies", task_count(pages))
    rows = join_checked(rows, first, F.col("digest") == F.col("__digest"), "left")  # pages move only where the digests that repeat outgrow a broadcast
    rows = rows.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("__digest", "first")
    rows.mapInArrow(released(_write(f"{folder}/archive")), INDEX).repartition(task_count(pages)).write.parquet(f"{folder}/index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def parse_record(member: bytes) -> dict:
    """The fields of RECORD from one gzip member; a response's payload is held against its digest."""
    data = gzip.GzipFile(fileobj=io.BytesIO(member)).read()
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    number = lambda x: int(x) if x else None
    named = lambda k: number(fields[k].removeprefix("<urn:page:").removesuffix(">")) if k in fields else None
    block = rest[: int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2] if fields["warc-type"] == "response" else None
    digest, n = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["warc-identified-payload-length"])
    if payload is not None and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != n):
        raise ValueError("a payload differs from its digest")
    return {"page_id": named("warc-record-id"), "url": fields["warc-target-uri"], "payload": payload, "payload_bytes": n, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": named("warc-refers-to")}


def coalesced(ranges: Iterator[tuple[str, int, int]], gap: int = GAP, most: int = READ) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) joined to reads (file, start, end, the ranges in it)."""
    now: tuple | None = None
    for file, offset, length in ranges:
        if now and now[0] == file and offset <= now[2] + gap and offset + length - now[1] <= most:
            now[3].append((offset, length))
            now = (file, now[1], max(now[2], offset + length), now[3])
        else:
            if now:
                yield now
            now = (file, offset, offset + length, [(offset, length)])
    if now:
        yield now


def _read(folder: str, payloads: bool):
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int]]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_fs(folder)
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        opened, file = None, None
        for name, start, end, inside in coalesced(ranges(batches)):
            if name != file:
                if opened:
                    opened.close()
                opened, file = fs.open_input_file(f"{at}/{name}"), name
            data = opened.read_at(end - start, start)
            rows = [parse_record(data[o - start : o - start + n]) for o, n in inside]
            if not payloads:
                for r in rows:
                    r["payload"] = None
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
        if opened:
            opened.close()

    return run


def read_records(selected: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of selected index rows. payloads=False checks them but leaves them out."""
    spark = selected.sparkSession
    bounded_batches(spark)
    rows = selected.select("file", "offset", "length")
    size = rows.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK))
    return rows.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(released(_read(f"{folder}/archive", payloads)), RECORD)
