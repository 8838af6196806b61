"""WARC archives: gzip members with a record each, and a reader whose tasks share a file by byte ranges.

Both ends go through Spark's text source, so archives lie in any store that Spark reaches. The writer's rows
are chunks of members as raw bytes, and an empty gzip member ends each row. The reader has the gzip magic
as line separator: a task scans its byte range for it and owns the records that start inside, as lines do.
Magic also occurs by chance within compressed data. A candidate is a record only if its bytes inflate to
a WARC header; else it goes on with the record before it, also across the ranges of two tasks.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: The start of a gzip member that uses deflate, and a member without content.
MAGIC = b"\x1f\x8b\x08"
EMPTY = MAGIC + bytes([0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
DATE = "2000-01-01T00:00:00Z"
CHUNK = 4 << 20
#: Payloads of at least this many bytes are written once, and revisited by their copies.
MIN_REVISIT = 0


def member(page_id: int | None, url: str | None, payload: bytes, kind: str, refers: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = lambda i: "<urn:page:" + ("" if i is None else str(i)) + ">"
    uri = "".join(c if 32 < ord(c) != 127 else f"%{ord(c):02X}" for c in url or "")
    body = payload if kind == "response" else b""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {len(payload)}",
            "Content-Type: text/html", f"Content-Length: {len(body)}"]
    if kind == "revisit":
        head[4:4] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                     f"WARC-Refers-To: {name(refers)}"]
    record = ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(record) + deflate.flush()


def plan_revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, kind, refers): which rows are responses, and which revisit another.

    Of equal payloads the row with the largest page_id is the response; null ids come first. Rows that repeat
    that page_id with that payload are responses too. Payloads are told apart by SHA-1.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload")).withColumn(
        "digest", F.sha1("payload"))
    # One row for each digest; a payload that many pages share makes a skewed join that Spark can split.
    best = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("best")).select(
        F.col("digest").alias("d"), "best")
    rows = rows.join(best, F.col("digest") == F.col("d"), "left")
    revisit = F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    return rows.select("page_id", "url", "payload",
                       F.when(revisit, "revisit").otherwise("response").alias("kind"),
                       F.when(revisit, F.col("best")).alias("refers"))


def write_warc(pages: DataFrame, path: str, least: int = MIN_REVISIT) -> None:
    """Write a record per row of pages (page_id, url, html); a null html is an empty payload."""

    def run(batches):
        parts, size = [], 0
        for b in batches:
            for r in zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "payload", "kind", "refers")]):
                parts.append(member(*r))
                size += len(parts[-1])
                if size >= CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["value"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["value"])

    rows = plan_revisits(pages, least).mapInArrow(run, "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option(
        "lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


SCHEMA = ("page_id long, url string, record_type string, payload_digest string, payload_bytes long, "
          "refers_to long, payload binary, file string, block long, seq long, orphan boolean, raw binary")


def parse(data: bytes) -> dict | None | bool:
    """The record of a whole member; None if data starts none; False if it starts one that goes on."""
    inflate = zlib.decompressobj(31)
    try:
        out = inflate.decompress(data)
    except zlib.error:
        return None
    if not inflate.eof:
        return False if b"WARC/1."[:len(out)] == out[:7] else None
    if not out:
        return {}
    if not out.startswith(b"WARC/1."):
        return None
    head, _, rest = out.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    return fields | {"": rest[:int(fields.get("content-length", 0))]}


def _row(x: dict) -> tuple:
    number = lambda s: int(m) if (m := s[s.rfind(":") + 1:].rstrip(">")).lstrip("-").isdigit() else None
    payload, kind = x[""], x.get("warc-type", "")
    whole = kind != "revisit"
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if whole else x["warc-payload-digest"][5:]
    if whole and x.get("warc-payload-digest", "sha1:" + digest) != "sha1:" + digest:
        raise ValueError(f"payload digest differs in {x.get('warc-record-id')}")
    return (number(x.get("warc-record-id", "")), x.get("warc-target-uri"), kind, digest,
            len(payload) if whole else int(x.get("payload-length", 0)), number(x.get("warc-refers-to", "")), payload)


def _members(pieces):
    """Records of consecutive pieces, each without its magic; at the end what is unresolved.

    Yields ("record", fields), ("orphan", bytes) for pieces that go on with something before them, and
    ("open", bytes) for a record that goes on after them.
    """
    held: list[bytes] | None = None
    for piece in pieces:
        data = MAGIC + piece
        x = parse(data)
        if held is not None and x in (None, False):  # the magic was part of the held member, perhaps
            held.append(data)
            y = parse(b"".join(held))
            if y:
                yield "record", y
                held = None
            elif y == {}:
                held = None
            elif x is False and y is None:
                held = [data]
            continue
        if x is None:
            yield "orphan", data
        elif x is False:
            held = [data]
        else:
            held = None
            if x:
                yield "record", x
    if held is not None:
        yield "open", b"".join(held)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload) per record.

    Files are split by bytes, whatever their size; their names must not end in .gz, or Spark inflates them.
    A record that a false magic cuts just where two ranges meet is put together from both ranges' rests.
    A payload whose digest is not the written one is an error. No file gives no rows.
    """
    lines = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    lines = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
                         F.col("_metadata.file_block_start").alias("block"))
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows), (
                pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(),
                pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], columns)

    def run(batches):
        def stretches():
            """(file, block, pieces) of one byte range after the other, in order."""
            for b in batches:
                yield from zip(b.column("file").to_pylist(), b.column("block").to_pylist(),
                               b.column("value").to_pylist())

        from itertools import groupby

        out, size = [], 0
        for (file, block), group in groupby(stretches(), key=lambda r: r[:2]):
            pieces = (r[2] for r in group)
            if block == 0:
                next(pieces, None)  # what stands before the first magic of a file: nothing
            for n, (kind, x) in enumerate(_members(pieces)):
                out.append((*_row(x), None, None, None, None, None) if kind == "record" else
                           (*[None] * 7, file, block, n, kind == "orphan", x))
                size += len(x[""]) if kind == "record" else len(x)
                if size > CHUNK:
                    yield batch(out)
                    out, size = [], 0
        if out:
            yield batch(out)

    found = lines.mapInArrow(run, SCHEMA)
    names = columns[:7]
    # Rests are as rare as false magic at the ends of ranges. Each open record and what follows it form a run.
    rests = found.where("raw is not null").withColumn("start", F.sum(F.when(F.col("orphan"), 0).otherwise(1)).over(
        W.partitionBy("file").orderBy("block", "seq")))
    runs = rests.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "raw"))).alias("r"))

    def mend(batches):
        for b in batches:
            rows = []
            for r in b.column("r").to_pylist():
                x = parse(b"".join(p["raw"] for p in r))
                if x is None or x is False:
                    raise ValueError("not a WARC record")
                if x:
                    rows.append((*_row(x), *[None] * 5))
            if rows:
                yield batch(rows)

    mended = runs.select("r").mapInArrow(mend, SCHEMA)
    return found.where("raw is null").select(names).unionByName(mended.select(names))
