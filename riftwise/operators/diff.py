"""Comparison of two versions: names on either side, and aligned blocks of lines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Local names, block labels and numbers of metadata nodes in instructions.
LOCAL, LABEL, NUMBER = re.compile(r"%[-\w.$]+"), re.compile(r"label %([-\w.$]+)"), re.compile(r"!\d+")


def module_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): names that only one module has."""
    l, r = left.select(key, F.lit(True).alias("l")).distinct(), right.select(key, F.lit(True).alias("r")).distinct()
    return l.join(r, key, "full_outer").where("l is null or r is null").select(
        key, F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


def block_diff(pairs: DataFrame) -> DataFrame:
    """pairs (id, before, after) of line arrays with matched, left and right line counts of a longest alignment."""

    def run(batches):
        for b in batches:
            out = []
            for i, x, y in zip(b["id"], b["before"], b["after"]):
                # Common ends belong to some longest alignment; what lies between takes a row of the table at a time.
                x, y, ends = list(x), list(y), 0
                while x and y and x[-1] == y[-1]:
                    x.pop(), y.pop()
                    ends += 1
                start = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
                x, y, ends = x[start:], y[start:], ends + start
                row = [0] * (len(y) + 1)
                for p in x:
                    last, row = row, [0]
                    for j, q in enumerate(y):
                        row.append(last[j] + 1 if p == q else max(row[j], last[j + 1]))
                out.append((i, row[-1] + ends, len(x) - row[-1], len(y) - row[-1]))
            yield pd.DataFrame(out, columns=["id", "matched", "left_only", "right_only"])

    return pairs.select("id", "before", "after").mapInPandas(
        run, "id long, matched long, left_only long, right_only long")


def _walk(left, right) -> tuple[int, int]:
    """Matched and differing instructions of two functions, blocks paired from the entries along the branches.

    left and right map a block to its instructions (result, text), entry first. Local names correspond one to one.
    """
    to, back, matched, differ = {}, {}, 0, 0

    def same(a, b):
        if to.setdefault(a, b) == b and back.setdefault(b, a) == a:
            return True
        return False

    todo, seen = [(next(iter(left)), next(iter(right)))], set()
    while todo:
        pair = todo.pop(0)
        if pair in seen:
            continue
        seen.add(pair)
        xs, ys = left.get(pair[0], []), right.get(pair[1], [])
        differ += abs(len(xs) - len(ys))
        for (r, x), (s, y) in zip(xs, ys):
            a, b = LOCAL.findall(x), LOCAL.findall(y)
            equal = NUMBER.sub("!", LOCAL.sub("%", x)) == NUMBER.sub("!", LOCAL.sub("%", y)) and (r is None) == (s is None)
            equal = equal and all([same(p, q) for p, q in zip(a, b)]) and (r is None or same(r, s))
            matched, differ = matched + equal, differ + (not equal)
            todo += zip(LABEL.findall(x), LABEL.findall(y))
    return matched, differ


def function_diff(left: DataFrame, right: DataFrame, left_functions: DataFrame, right_functions: DataFrame,
                  on: tuple[str, ...] = ("module", "func")) -> DataFrame:
    """(on, status, matched, differ): status same, changed, left (only there) or right.

    Functions are paired by module and name, or for two versions of one module of other names by on=("func",),
    and compared block by block; two that are only declared are the same, and one
    that is defined on one side only, or whose parameters differ in number, has changed. instructions as
    riftwise.sources.ir has them; a task holds the two bodies of one name.
    """
    on = list(on)
    names = [*on, "ord", "bb", "result", "text"]
    cut = lambda d: d.select(*names).toDF(*names)

    def apply(key, l, r):
        def blocks(d):
            out: dict = {}
            for t in d.sort_values("ord").itertuples(index=False):
                out.setdefault(t.bb, []).append((t.result, t.text))
            return out

        m, d = _walk(blocks(l), blocks(r)) if len(l) and len(r) else (0, len(l) + len(r))
        return pd.DataFrame([(*key, m, d)], columns=[*on, "matched", "differ"])

    walked = cut(left).groupBy(*on).cogroup(cut(right).groupBy(*on)).applyInPandas(
        apply, ", ".join(f"{c} string" for c in on) + ", matched long, differ long")
    of = lambda d, p: d.select(*on, F.col("defined").alias(f"{p}_defined"), F.size("params").alias(f"{p}_params"))
    both = of(left_functions, "l").join(of(right_functions, "r"), on, "full_outer").join(walked, on, "left")
    n = F.coalesce("differ", F.lit(0))
    changed = (F.col("l_defined") != F.col("r_defined")) | (F.col("l_defined") & ((F.col("l_params") != F.col("r_params")) | (n > 0)))
    return both.select(*on, F.when(F.col("l_defined").isNull(), "right").when(F.col("r_defined").isNull(), "left")
                       .when(changed, "changed").otherwise("same").alias("status"),
                       F.coalesce("matched", F.lit(0)).alias("matched"), n.alias("differ"))
