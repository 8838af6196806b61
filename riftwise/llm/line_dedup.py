"""Line deduplication by pairwise patience alignment.

Documents that share a line are paired with the first document that holds it, and so are those that share
two lines with text that follow each other but for the same blank lines: every block of two such lines has
one. A star per line and per couple of lines, so pairs grow with the rows that share them and not with
their square, for rare and frequent lines alike. Each pair is aligned by patience diff over line hashes, and
blocks of aligned lines go from the later one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, materialize, text_key

#: An aligned block is deleted if it has this many lines with text, or this many characters.
MIN_LINES = 2
MIN_CHARS = 100
#: Document frequency up to which a line is rare; such lines also pair each holder with the one before.
RARE = 8
#: Lines of the pairs that a worker holds as Python objects at a time, one pair at least.
HELD = 1 << 16


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) of a and b, both rising: common ends, then lines unique to both sides."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, ie, j, je = todo.pop()
        while i < ie and j < je and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            found.append((ie, je))
        if i == ie or j == je:
            continue
        one, two = Counter(a[i:ie]), Counter(b[j:je])
        at = {x: k for k, x in enumerate(b[j:je], j) if two[x] == 1 and one[x] == 1}
        pairs = [(k, at[x]) for k, x in enumerate(a[i:ie], i) if x in at]
        tops, ends, back = [], [], []
        for n, (_, y) in enumerate(pairs):
            k = bisect_left(tops, y)
            tops[k:k + 1], ends[k:k + 1] = [y], [n]
            back.append(ends[k - 1] if k else -1)
        n = ends[-1] if ends else -1
        hi, hj = ie, je
        while n >= 0:
            x, y = pairs[n]
            todo.append((x, hi, y, hj))
            hi, hj, n = x, y, back[n]
        if hi < ie:
            todo.append((i, hi, j, hj))
    return sorted(found)


def deletable(a: list[int], b: list[int], chars: list[int]) -> list[int]:
    """Positions in b of the blocks aligned with a that are large enough; zero marks blank lines."""
    out, block, last = [], [], None
    for i, j in [*patience(a, b), (-9, -9)]:
        if last is None or (i, j) != (last[0] + 1, last[1] + 1):
            full = [k for k in block if b[k]]
            if len(full) >= MIN_LINES or sum(chars[k] for k in full) >= MIN_CHARS:
                out += full
            block = []
        block.append(j)
        last = i, j
    return out


def aligned(batches):
    """Positions to delete, gone, for each row (o, k, before, lines, chars); a batch is taken HELD lines at a time."""
    for b in batches:
        lists = [b.column(c) for c in ("before", "lines", "chars")]
        ends = np.cumsum(pc.add(pc.list_value_length(lists[0]), pc.list_value_length(lists[1])).to_numpy().astype(np.int64))
        cuts = (np.flatnonzero(np.diff(ends // HELD)) + 1).tolist()
        for i, e in zip([0, *cuts], [*cuts, len(ends)]):
            gone = [deletable(x, y, c) for x, y, c in zip(*[x.slice(i, e - i).to_pylist() for x in lists])]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c).slice(i, e - i) for c in ("o", "k")], pa.array(gone, pa.list_(pa.int32()))], ["o", "k", "gone"])


def line_table(docs: DataFrame) -> DataFrame:
    """(o, k, lines, chars) per document: hash of each line without its outer spaces, zero if blank.

    o is the doc_id, nulls last; k a hash of the text. Documents are ordered by (o, k).
    """
    rows = F.split(F.coalesce("text", F.lit("")), "\n")
    bare = F.transform(rows, lambda x: F.btrim(x, F.lit(SPACE_CHARS)))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("o"), text_key(F.col("text")).alias("k"),
        F.transform(bare, lambda x: F.when(x == "", F.lit(0)).otherwise(F.xxhash64(x))).alias("lines"),
        F.transform(bare, F.length).alias("chars"))


def couples(full: str):
    """A hash of each two lines with text, (x, i) in full, that follow each other and of the distance between them."""
    return F.expr(f"""zip_with(slice({full}, 1, greatest(size({full}) - 1, 0)), slice({full}, 2, greatest(size({full}) - 1, 0)),
        (s, t) -> xxhash64(s.x, t.i - s.i, t.x))""")


def removed_lines(docs: DataFrame) -> DataFrame:
    """(o, k, gone): positions of the lines to delete, for documents that have any.

    Rows that agree in doc_id and text count as one document; identical texts are aligned in whole.
    """
    table = materialize(line_table(docs).dropDuplicates(["o", "k"]), "lines")
    full = F.expr("filter(transform(lines, (x, i) -> struct(x, i)), s -> s.x <> 0)")
    held = table.withColumn("full", full).select("o", "k", F.explode(F.array_distinct(F.concat("lines", couples("full")))).alias("line")).where("line <> 0")
    me = F.struct("o", "k")
    owners = held.groupBy("line").agg(F.min(me).alias("first"), F.count("*").alias("n")).where("n > 1")
    owners = materialize(owners, "owners")
    stars = held.join(owners.select("line", "first"), "line").select(F.col("first").alias("a"), me.alias("b"))
    rare = held.join(owners.where(F.col("n").between(3, RARE)).select("line"), "line").groupBy("line").agg(
        F.array_sort(F.collect_list(me)).alias("all"))  # at most RARE members
    steps = rare.select(F.explode(F.expr(
        "transform(sequence(1, size(all) - 1), i -> struct(all[i - 1] as a, all[i] as b))")).alias("p")).select("p.a", "p.b")
    pairs = stars.unionByName(steps).where("a <> b").distinct().select(
        F.col("a.o").alias("ao"), F.col("a.k").alias("ak"), F.col("b.o").alias("o"), F.col("b.k").alias("k"))
    left = table.select(F.col("o").alias("ao"), F.col("k").alias("ak"), F.col("lines").alias("before"))
    both = pairs.join(left, ["ao", "ak"]).join(table, ["o", "k"]).select("o", "k", "before", "lines", "chars")

    hits = both.mapInArrow(aligned, "o long, k long, gone array<int>").where("size(gone) > 0")
    # One row for each line of a document at most, however many partners found it.
    lines = hits.select("o", "k", F.explode("gone").alias("at")).distinct()
    return lines.groupBy("o", "k").agg(F.array_sort(F.collect_list("at")).alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the columns n_lines, n_removed and kept added; text stays as it was.

    Earlier documents by doc_id, then by text hash, keep their lines. Blank lines stay unless no line with
    text is left. Null texts stay null and have no lines. Rows that repeat doc_id and text share a result.
    Further columns are carried along; a column of docs with an added name is replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "kept")
    names = docs.columns
    gone = removed_lines(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("o"),
                       text_key(F.col("text")).alias("k"))
    rows = rows.join(gone, ["o", "k"], "left").select("row", "gone", F.split("row.text", "\n").alias("lines"))
    kept = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(_without("lines", "gone"))
    return rows.select(
        "row.*", F.when(F.col("row.text").isNull(), 0).otherwise(F.size("lines")).alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_removed"), kept.alias("kept"))


def _without(lines: str, gone: str):
    """Lines less those at the sorted positions, joined: what lies between one removed line and the next."""
    return F.expr(f"""
        array_join(flatten(transform(sequence(0, size({gone})), i ->
            slice({lines}, if(i = 0, 1, {gone}[i - 1] + 2),
                  if(i = size({gone}), size({lines}), {gone}[i]) - if(i = 0, 0, {gone}[i - 1] + 1)))), '\\n')
    """)


def keep_deduped(docs: DataFrame) -> DataFrame:
    """docs with the deleted lines gone from text; documents that lose all their lines with text go."""
    names = docs.columns
    found = dedup_lines(docs).where(
        (F.col("n_removed") == 0) | (F.btrim(F.col("kept"), F.lit(SPACE_CHARS)) != ""))
    return found.withColumn("text", F.col("kept")).select(*[F.col(f"`{c}`") for c in names])
