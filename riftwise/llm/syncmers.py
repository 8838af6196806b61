"""Document fingerprints from closed syncmers.

A k-mer is a closed syncmer if its smallest inner s-mer stands at one of its ends, which depends on the k-mer
alone: the same passage gives the same anchors wherever it occurs, and no K - S k-mers in a row are without
one. A fingerprint holds all anchors of a text with their positions. Two fingerprints are matched by
position: anchors of equal hash are paired, the longest chain of pairs that rises in both texts is kept,
and the likeness is the share of the anchored bytes that the chain covers.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_key

K, S = 64, 8
#: Odd multipliers for mixing (fixed values).
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(MIX[0])
    x ^= x >> np.uint64(32)
    x *= np.uint64(MIX[1])
    return x ^ (x >> np.uint64(29))


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(positions, 32-bit hashes) of the closed syncmers of data, in order of position.

    A text without any, such as one below K bytes, is one anchor as a whole; an empty one has none.
    """
    n = len(data)
    if n >= K:
        x = np.empty(n - S + 1, np.uint64)
        for j in range(min(S, len(x))):
            x[j::S] = np.frombuffer(data, "<u8", (n - j) // S, j)
        h = _mix(x)
        w = K - S + 1
        low, span = h, 1
        while 2 * span <= w:
            low, span = np.minimum(low[:-span], low[span:]), 2 * span
        count = len(h) - w + 1
        low = np.minimum(low[:count], low[w - span:w - span + count])
        at = np.flatnonzero((h[:count] == low) | (h[w - 1:] == low))
        y = np.zeros(len(at), np.uint64)
        for j in range(0, K, S):
            y = _mix(y ^ (h[at + j] + np.uint64(j)))
        if len(at):
            return at, (y >> np.uint64(32)).astype(np.uint32)
    short = int.from_bytes(hashlib.blake2b(data, digest_size=4).digest(), "little")
    return np.zeros(min(n, 1), np.int64), np.full(min(n, 1), short, np.uint32)


def as_text(found: tuple[np.ndarray, np.ndarray]) -> str:
    """Ten hexadecimal digits an anchor: the distance from the one before, below K, and the hash."""
    at, h = found
    out = np.empty((len(at), 5), np.uint8)
    out[:, 0] = np.diff(at, prepend=0)
    out[:, 1:] = h.astype(">u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes().hex()


def from_text(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The anchors that as_text() wrote."""
    x = np.frombuffer(bytes.fromhex(text), np.uint8).reshape(-1, 5)
    return np.cumsum(x[:, 0], dtype=np.int64), x[:, 1:].copy().view(">u4").ravel().astype(np.uint32)


def _numbered(h: np.ndarray) -> np.ndarray:
    """Each hash with how many equal ones stand before it."""
    order = np.argsort(h, kind="stable")
    new = np.flatnonzero(np.diff(h[order], prepend=h[order[:1]] + np.uint32(1)))
    nth = np.empty(len(h), np.uint64)
    nth[order] = np.arange(len(h)) - np.repeat(new, np.diff(new, append=len(h)))
    return h.astype(np.uint64) << np.uint64(32) | nth


def _chain(x: np.ndarray) -> np.ndarray:
    """Indices of a longest rising subsequence of x."""
    if (np.diff(x) > 0).all():
        return np.arange(len(x))
    tops, ends, back = [], [], []
    for i, v in enumerate(x.tolist()):
        k = bisect_left(tops, v)
        tops[k:k + 1], ends[k:k + 1] = [v], [i]
        back.append(ends[k - 1] if k else -1)
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return np.array(out[::-1], np.int64)


def _covered(at: np.ndarray) -> int:
    """Bytes that k-mers at rising positions cover."""
    return int(np.minimum(np.diff(at), K).sum()) + K if len(at) else 0


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of the anchored bytes of both that matched anchors cover, 0 to 1. Two empty ones are alike.

    The nth anchor of a hash in one text pairs with the nth of that hash in the other; of the pairs, a longest
    chain that rises in both counts. Takes n log n steps for n anchors.
    """
    every = _covered(a[0]) + _covered(b[0])
    if not every:
        return 1.0
    _, one, two = np.intersect1d(_numbered(a[1]), _numbered(b[1]), assume_unique=True, return_indices=True)
    order = np.argsort(one)
    one, two = one[order], two[order]
    kept = _chain(two)
    return (_covered(a[0][one[kept]]) + _covered(b[0][two[kept]])) / every


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fingerprint) per row of docs; null and empty texts have an empty fingerprint."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("key"),
                 pa.array([as_text(anchors(t or b"")) for t in b.column("text").to_pylist()], pa.string())],
                ["doc_id", "text_key", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"),
                       F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, text_key long, fingerprint string")


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """SCHEMA's columns per row of docs (doc_id, text): each text against its edited form and the next text.

    The next document is the one with the next smaller doc_id; nulls come last, ties go by a hash of the text,
    and after the last comes the first. Null texts are empty. Equal texts have equal fingerprints; empty
    ones an empty fingerprint, of likeness 1 to each other and 0 to others. A single document is its own
    next. An empty table gives an empty result.

    The ids alone are sorted first, and the first of every range comes to the driver: four a shuffle
    partition. Texts then go to their range in one shuffle, the first of each range also to the one before.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"),
                       F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = (F.col("doc_id").desc_nulls_last(), F.col("key"))
    ranged = rows.select("doc_id", "key").repartitionByRange(n, *order)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), (-F.coalesce("doc_id", F.lit(0))).alias("down"), "key")
    firsts = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min(rank).alias("r")).select("r.*").collect()
    bounds = sorted((bool(r["none"]), r["down"], r["key"]) for r in firsts)

    def route(batches):
        for b in batches:
            ids, keys = b.column("doc_id").to_pylist(), b.column("key").to_pylist()
            at, take, ahead = [], [], []
            for i, (d, k) in enumerate(zip(ids, keys)):
                t = (d is None, -(d or 0), k)
                p = bisect_right(bounds, t) - 1
                at.append(p), take.append(i), ahead.append(0)
                if t == bounds[p]:
                    at.append(p - 1 if p else len(bounds) - 1), take.append(i), ahead.append(1)
            got = b.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array(ahead, pa.int32()), *got.columns],
                ["range", "ahead", "doc_id", "key", "text"])

    def compare(batches):
        held = None  # (range, doc_id, text, anchors), waiting for the next document
        for b in batches:
            out = []
            for p, ahead, d, text in zip(*[b.column(c).to_pylist() for c in ("range", "ahead", "doc_id", "text")]):
                mine = None
                if held is not None and held[0] == p:
                    _, before, old, theirs = held
                    mine = theirs if text == old else anchors(text.encode())
                    half = len(old) // 2
                    new = (old[:len(old) - half] + text[:half]).encode()
                    edit = anchors(new)
                    out.append((before, len(old), hashlib.sha256(new).hexdigest(), as_text(theirs), as_text(edit),
                                likeness(theirs, edit), likeness(theirs, mine)))
                if ahead:
                    held = None
                else:
                    held = p, d, text, anchors(text.encode()) if mine is None else mine
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip((c.split()[0] for c in SCHEMA.split(", ")), x)) for x in out],
                                                 schema=kinds)

    kinds = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]])
                       for c in SCHEMA.split(", ")])
    routed = rows.mapInArrow(route, "range int, ahead int, doc_id long, key long, text string")
    return routed.repartition("range").sortWithinPartitions("range", "ahead", *order).mapInArrow(compare, SCHEMA)
