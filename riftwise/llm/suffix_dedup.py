"""Removal of repeated 400-byte strings by the contexts in which they stand.

Column-wise construction of a suffix order (Bauer, Cox and Rosone) inserts one symbol of every document per
round and so takes as many passes over the collection as the longest text has bytes. Instead, windows that may
be equal are brought together by ever longer parts that equal windows share, at every size of the input and
of a group in the same way:

1. Of all GRAM-byte grams of a WIDTH-byte window, the one with the least hash is the window's anchor, so equal
   windows have equal anchors at equal offsets. Windows in a row with one anchor form a context. A context met
   twice repeats in whole; one whose anchor nowhere else occurs does not repeat.
2. The distinct contexts of an anchor that are left are cut into pieces of STEP offsets from the anchor. All windows
   of a piece share its core, WIDTH - STEP + 1 bytes. A piece met twice repeats in whole; one whose core
   nowhere else occurs does not repeat.
3. The distinct pieces of a core that are left are cut into their windows, which are counted.

Each step counts by hash, with partial counts before each shuffle, so that no task holds a group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_key

WIDTH, GRAM = 400, 128
#: Grams that start in a window.
REACH = WIDTH - GRAM
#: Offsets from the anchor that a piece spans.
STEP = 16
#: Contexts that are cut into pieces at a time.
CUT = 2000
#: Windows of a text that are handled at a time.
STRETCH = 1 << 22
BASE = 0x9E3779B97F4A7C15


class Hasher:
    """Hashes of all substrings of a text from prefix sums of symbol * BASE^position, modulo 2^64."""

    powers = np.ones(1, np.uint64)
    backs = np.ones(1, np.uint64)
    symbols = np.random.default_rng(400).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Hasher.powers) < n:
            size = 1 << n.bit_length()
            for name, base in (("powers", BASE), ("backs", pow(BASE, -1, 1 << 64))):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(Hasher, name, np.multiply.accumulate(x))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(self.symbols[data] * self.powers[:n - 1], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.backs[start]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def contexts(data: bytes) -> tuple[np.ndarray, ...]:
    """(p0, p1, a, gram, whole): windows p0..p1 with anchor a, hashes of the gram and of bytes p0..p1+WIDTH."""
    n = len(data) - WIDTH + 1
    parts = []
    for at in range(0, max(n, 0), STRETCH):
        some = np.frombuffer(data, np.uint8)[at:at + STRETCH + WIDTH - 1]
        h = Hasher(some)
        starts = np.arange(len(some) - GRAM + 1)
        grams = h.of(slice(0, len(starts)), slice(GRAM, GRAM + len(starts)))
        # The leftmost of the least; what decides depends on the window's bytes alone.
        low, span, w = (grams & ~np.uint64((1 << 24) - 1)) | starts.astype(np.uint64), 1, REACH + 1
        while 2 * span <= w:
            low, span = np.minimum(low[:-span], low[span:]), 2 * span
        count = len(some) - WIDTH + 1
        low = np.minimum(low[:count], low[w - span:w - span + count])
        a = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        cut = np.flatnonzero(np.diff(a)) + 1
        p0, p1 = np.concatenate(([0], cut)), np.concatenate((cut - 1, [count - 1]))
        parts.append((p0 + at, p1 + at, a[p0] + at, grams[a[p0]], h.of(p0, p1 + WIDTH)))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 5


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("o"),
                       text_key(F.col("text")).alias("k"),
                       F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text"))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _context_rows(batches):
    for b in batches:
        found = [contexts(t) for t in b.column("text").to_pylist()]
        sizes = [len(x[0]) for x in found]
        p0, p1, a, gram, whole = (np.concatenate(x) for x in zip(*found))
        if len(p0):
            rep = lambda c: pa.array(np.repeat(b.column(c).to_numpy(), sizes))
            yield pa.RecordBatch.from_arrays(
                [rep("o"), rep("k"), pa.array(p0 << 20 | (a - p0) << 10 | (p1 - p0)),
                 _signed(gram.astype(np.uint64)), _signed(whole.astype(np.uint64))], ["o", "k", "loc", "gram", "whole"])


def _fetch(batches):
    """Bytes of the contexts asked for; locs holds (loc, gram)."""
    for b in batches:
        rows = []
        for o, k, text, locs in zip(*[b.column(c).to_pylist() for c in ("o", "k", "text", "locs")]):
            for x in locs:
                p0, anchor, run = x["loc"] >> 20, x["loc"] >> 10 & 1023, x["loc"] & 1023
                rows.append((x["gram"], o, k, p0, anchor, text[p0:p0 + run + WIDTH]))
                if len(rows) >= 4096:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows):
    return pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
        ["gram", "o", "k", "p0", "anchor", "data"])


def _pieces(batches):
    """Pieces of contexts: hashes of core and whole, place s, number n of windows, bytes before and after the core."""
    for b in batches:
        for part in (b.slice(at, CUT) for at in range(0, len(b), CUT)):
            data, anchor = part.column("data").to_pylist(), part.column("anchor").to_numpy().astype(np.int64)
            sizes = np.array([len(x) for x in data])
            base, run = np.cumsum(sizes) - sizes, sizes - WIDTH
            # Piece r of a context has the windows STEP r to STEP r + STEP - 1 bytes before the anchor.
            first, last = (anchor - run) // STEP, anchor // STEP
            count = last - first + 1
            row = np.repeat(np.arange(len(data)), count)
            r = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
            core = anchor[row] - STEP * r
            lo, hi = np.maximum(0, core - STEP + 1), np.minimum(run[row], core)
            h, at = Hasher(np.frombuffer(b"".join(data), np.uint8)), base[row]
            end = core + WIDTH - STEP + 1
            cut = lambda x, y: pa.array([data[i][s:e] for i, s, e in zip(row.tolist(), x.tolist(), y.tolist())], pa.binary())
            take = lambda c: part.column(c).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [take("gram"), pa.array(r.astype(np.int32)), _signed(h.of(at + core, at + end)), _signed(h.of(at + lo, at + hi + WIDTH)),
                 take("o"), take("k"), pa.array(part.column("p0").to_numpy()[row] + lo), pa.array((hi - lo + 1).astype(np.int32)),
                 cut(lo, core), cut(end, hi + WIDTH)],
                ["gram", "r", "core", "whole", "o", "k", "s", "n", "left", "right"])


def _kinds(found: DataFrame, group: list[str], values: list[str], name: str) -> DataFrame:
    """Distinct (group, whole) of groups met twice or more: n, how often; kinds, how many the group has; any row's values."""
    # first() takes all values from one row; any row of a kind will do, and the result is written once.
    wholes = found.groupBy(*group, "whole").agg(F.count("*").alias("times"), F.first(F.struct(*values)).alias("row"))
    shared = wholes.groupBy(*group).agg(F.sum("times").alias("all"), F.count("*").alias("kinds")).where("all > 1")
    return materialize(wholes.join(shared.select(*group, "kinds").hint("merge"), group).select(
        *group, "whole", "times", "kinds", "row.*"), name)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(o, k, s, e): byte ranges covered by strings of WIDTH bytes that also start elsewhere in the texts."""
    rows = _rows(docs)
    found = rows.where(F.octet_length("text") >= WIDTH).mapInArrow(
        _context_rows, "o long, k long, loc long, gram long, whole long")
    kinds = _kinds(found, ["gram"], ["o", "k", "loc"], "kinds")
    full = found.join(kinds.where("times > 1").select("gram", "whole").hint("merge"), ["gram", "whole"]).select(
        "o", "k", F.shiftright("loc", 20).alias("s"),
        (F.shiftright("loc", 20) + F.col("loc").bitwiseAND(F.lit(1023)) + WIDTH).alias("e"))
    asked = kinds.where("kinds > 1").select("gram", "o", "k", "loc")
    locs = asked.groupBy("o", "k").agg(F.collect_list(F.struct("loc", "gram")).alias("locs"))
    data = materialize(rows.dropDuplicates(["o", "k"]).join(locs, ["o", "k"]).mapInArrow(
        _fetch, "gram long, o long, k long, p0 long, anchor int, data binary"), "contexts")

    pieces = data.mapInArrow(_pieces, "gram long, r int, core long, whole long, o long, k long, s long, n int, left binary, right binary")
    group = ["gram", "r", "core"]
    cut = _kinds(pieces, group, ["o", "k", "s", "n", "left", "right"], "pieces")
    # Of pieces met twice, those of contexts met once are still to be found; the rows say where all of them are.
    spans = full.unionByName(pieces.select(*group, "whole", "o", "k", "s", "n").join(
        cut.where("times > 1").select(*group, "whole").hint("merge"), [*group, "whole"]).select(
        "o", "k", "s", (F.col("s") + F.col("n") + (WIDTH - 1)).alias("e")))
    windows = cut.where("kinds > 1").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    windows = windows.select("gram", "core", "o", "k", (F.col("s") + F.col("i")).alias("s"), F.xxhash64(
        F.col("r"), F.octet_length("left") - F.col("i"), F.expr("substr(left, i + 1)"),
        F.expr(f"substr(right, 1, {STEP - 1} - octet_length(left) + i)")).alias("window"))
    twice = windows.groupBy("gram", "core", "window").agg(F.count("*").alias("times")).where("times > 1")
    return spans.unionByName(windows.join(twice.drop("times").hint("merge"), ["gram", "core", "window"]).select(
        "o", "k", "s", (F.col("s") + WIDTH).alias("e")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_bytes, n_removed, n_spans, kept_sha256, kept) per row of docs (doc_id, text).

    Every byte covered by a WIDTH-byte string that also starts elsewhere goes, in the same text or another,
    overlaps included, judged on the input. Texts are UTF-8 bytes, null ones empty; matches never cross
    texts. Rows that repeat a doc_id, or a whole row, are documents of their own, so that copies of
    at least WIDTH bytes lose everything. kept is binary: a cut may fall within a character. An empty
    table gives an empty result.
    """
    spans = repeated_spans(docs).groupBy("o", "k").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("o"),
        text_key(F.col("text")).alias("k"), F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text"))

    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                kept, end, count = [], 0, 0
                start = None
                for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                    if start is None or s > end:
                        kept.append(text[end:s])
                        count += 1
                        start, end = s, e
                    else:
                        end = max(end, e)
                kept.append(text[end:])
                whole = b"".join(kept)
                out.append((len(text), len(text) - len(whole), count, hashlib.sha256(whole).hexdigest(), whole))
            n, gone, count, sha, kept = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("k"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())],
                ["doc_id", "text_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.join(spans, ["o", "k"], "left").select("doc_id", "k", "text", "spans").mapInArrow(
        run, "doc_id long, text_key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
