"""Matching line ranges with functions, loops and instructions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def intersects(a_begin: Column, a_end: Column, b_begin: Column, b_end: Column) -> Column:
    return (b_end >= a_begin) & (b_begin <= a_end)


def includes(a_begin: Column, a_end: Column, b_begin: Column, b_end: Column) -> Column:
    return (a_begin <= b_begin) & (b_end <= a_end)


def interval_join(left: DataFrame, right: DataFrame, on: list[str], width: int, contains: bool = False) -> DataFrame:
    """Pairs of the same `on` whose closed ranges (b, e) and (b2, e2) meet, or the first contains the second.

    Ranges are cut into stretches of `width`; a pair is found in the stretch where the later of both begins, so
    each is found once and a long history of one key is spread over tasks.
    """
    cells = lambda b, e: F.explode(F.sequence(F.floor(F.col(b) / width), F.floor(F.col(e) / width)))
    a, z = left.withColumn("cell", cells("b", "e")), right.withColumn("cell", cells("b2", "e2"))
    test = includes if contains else intersects
    cond = test(F.col("b"), F.col("e"), F.col("b2"), F.col("e2"))
    first = F.floor(F.greatest("b", "b2") / width) == F.col("cell")
    return a.join(z, [*on, "cell"]).where(cond & first).drop("cell")


def fill_last_line(sps: DataFrame, file: list[str]) -> DataFrame:
    """Unknown last lines become the line before the next function's, or its line if both start together."""
    nxt = F.lead("linenumber").over(W.partitionBy(*file).orderBy("linenumber"))
    return sps.withColumn("lastline", F.coalesce("lastline", F.greatest(nxt - 1, F.col("linenumber"))))


def first_module(files: DataFrame) -> DataFrame:
    """(file_name, module): the first module in order that has a file, of any rows with the two."""
    return files.groupBy("file_name").agg(F.min("module").alias("module"))


def match_functions(scopes: DataFrame, sps: DataFrame, file: list[str], scope_key: list[str], first_only: bool = True) -> DataFrame:
    """scopes (file.., scope_key.., begin, end) with the functions (linenumber, lastline) they touch.

    A function that ends on the scope's first line is passed over unless it has one line, and so is one of
    several lines that starts on the scope's last. first_only keeps the first function of a scope.
    """
    one_line = F.col("linenumber") == F.col("lastline")
    hit = scopes.join(sps, file).where(
        (F.col("linenumber") <= F.col("end")) & (F.col("lastline").isNull() | (F.col("lastline") >= F.col("begin")))
        & (one_line | F.col("lastline").isNull() | (F.col("lastline") > F.col("begin")))
        & (one_line | (F.col("linenumber") < F.col("end"))))
    if not first_only:
        return hit
    w = W.partitionBy(*scope_key).orderBy("linenumber", "name")
    return hit.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def match_in_order(insts: DataFrame, keys: list[str], begin: Column, end: Column, after: Column | None = None) -> DataFrame:
    """Instructions (keys, ord, line) that a forward scan for lines begin..end accepts.

    The scan stops at the first line beyond end; it accepts lines in the range that do not fall below an
    accepted one. Unknown lines are passed over. A scan that follows one for lines up to `after` starts where
    that one stopped, at the first line beyond; a null `after` starts at the first instruction.
    """
    w = W.partitionBy(*keys).orderBy("ord")
    x = insts.where("line is not null")
    if after is not None:
        x = x.withColumn("begun", F.max((after.isNull() | (F.col("line") > after)).cast("int")).over(w)).where(
            "begun = 1").drop("begun")
    x = x.withColumn("cut", F.max((F.col("line") > end).cast("int")).over(w))
    ranged = F.when(F.col("line").between(begin, end), F.col("line"))
    top = F.max(ranged).over(w.rowsBetween(W.unboundedPreceding, -1))
    return x.where("cut = 0").withColumn("top", F.coalesce(top, begin)).where(
        F.col("line").between(begin, end) & (F.col("line") >= F.col("top"))).drop("cut", "top")


def block_scopes(insts: DataFrame) -> DataFrame:
    """(module, func, bb, first, last): lines of each block's first and last instruction, in order; null if unknown."""
    return insts.groupBy("module", "func", "bb").agg(
        F.min_by("line", "ord").alias("first"), F.max_by("line", "ord").alias("last"))


def loop_scopes(insts: DataFrame, nest: DataFrame) -> DataFrame:
    """(module, func, header, parent, depth, b, e): line range of each loop; parent is null at the outside.

    insts (module, func, bb, ord, line) and nest (module, func, bb, headers). A block reaches from its first
    instruction's line to its last's and has no range if one of them is unknown; a loop begins with its
    header and ends with the block that ends last. Loops without a range are left out.
    """
    at = ["module", "func"]
    blocks = block_scopes(insts).where("first is not null and last is not null")
    held = nest.select(*at, "bb", F.posexplode("headers").alias("depth", "header"),
                       F.col("headers")).withColumn("parent", F.expr("get(headers, depth - 1)")).drop("headers")
    ends = held.join(blocks, [*at, "bb"]).groupBy(*at, "header", "depth", "parent").agg(
        F.max("last").alias("e"), F.max(F.when(F.col("bb") == F.col("header"), F.col("first"))).alias("b"))
    return ends.where("b is not null").select(*at, "header", "parent", "depth", "b", "e")


def match_loops(scopes: DataFrame, loops: DataFrame, key: list[str]) -> DataFrame:
    """(key, module, func, header): of each scope (key, module, func, begin, end) the loop that it touches.

    The first outermost loop that meets the scope, or the last loop right inside it that does.
    """
    at = ["module", "func"]
    hit = scopes.select(*key, *at, "begin", "end").join(loops, at).where(
        intersects(F.col("b"), F.col("e"), F.col("begin"), F.col("end")))
    top = hit.where("depth = 0").groupBy(*key, *at).agg(F.min_by("header", F.struct("b", "header")).alias("top"))
    sub = hit.where("depth = 1").groupBy(*key, *at, F.col("parent").alias("top")).agg(
        F.max_by("header", F.struct("b", "header")).alias("sub"))
    return top.join(sub, [*key, *at, "top"], "left").select(*key, *at, F.coalesce("sub", "top").alias("header"))


def innermost(pairs: DataFrame, key: list[str], begin: str, end: str) -> DataFrame:
    """Of the scopes around each key the one that begins last and ends first."""
    w = W.partitionBy(*key).orderBy(F.col(begin).desc(), F.col(end), *[c for c in pairs.columns if c not in (begin, end, *key)])
    return pairs.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
