"""Control sequences of hunks (+ - ~ in order) to modifications with their line ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def pair_changes(seq: Column) -> Column:
    """A control sequence with deletions paired with later additions of the same chunk, first in first out.

    ^ is a replaced line; additions that were paired are gone. Chunks lie between ~. An addition with no deletion
    waiting is free, and all deletions before it are paired; so what is left of a chunk after its last free
    addition is ^ for each pair and - for each deletion that still waits. A sequence stays in its row.
    """
    pairs = lambda a: F.concat(a["out"], F.repeat(F.lit("^"), a["paired"]), F.repeat(F.lit("-"), a["found"] - a["paired"]))
    state = lambda out, found, paired: F.struct(out.alias("out"), found.alias("found"), paired.alias("paired"))
    zero = F.lit(0)

    def step(a, c):
        return F.when(c == "-", state(a["out"], a["found"] + 1, a["paired"])).when(
            a["paired"] < a["found"], state(a["out"], a["found"], a["paired"] + 1)).otherwise(
            state(F.concat(a["out"], F.repeat(F.lit("^"), a["paired"]), F.lit("+")), zero, zero))

    fold = lambda c: F.aggregate(F.split(c, ""), state(F.lit(""), zero, zero), step, pairs)
    mixed = lambda c: c.contains("+") & c.contains("-")
    return F.array_join(F.transform(F.split(seq, "~"), lambda c: F.when(mixed(c), fold(c)).otherwise(c)), "~")


def modifications(hunks: DataFrame, keys: list[str], paired: Column, start=None, rep_start=None) -> DataFrame:
    """(keys, mod_idx, type, scope_begin, scope_end, rep_begin, rep_end) from runs of equal characters.

    paired is a sequence that pair_changes() made. The old line advances on - ^ ~, the new line on + ^ ~; start
    and rep_start name columns with the hunk's first lines, 1 without.
    """
    one = F.lit(1).cast("long")
    x = hunks.select(*keys, (F.col(start).cast("long") if start else one).alias("_a"),
                     (F.col(rep_start).cast("long") if rep_start else one).alias("_b"),
                     F.posexplode(F.regexp_extract_all(paired, F.lit(r"(~+|\++|-+|\^+)"), F.lit(1))).alias("run", "text"))
    x = x.select("*", F.substring("text", 1, 1).alias("ch"), F.length("text").cast("long").alias("n"))
    w = W.partitionBy(*keys).orderBy("run")
    line = F.sum(F.when(F.col("ch") != "+", F.col("n")).otherwise(0)).over(w) + F.col("_a") - 1
    rep = F.sum(F.when(F.col("ch") != "-", F.col("n")).otherwise(0)).over(w) + F.col("_b") - 1
    x = x.withColumn("line", line).withColumn("rep", rep).where("ch <> '~'")
    kind = F.when(F.col("ch") == "+", "ADD").when(F.col("ch") == "-", "DEL").otherwise("REP")
    first = lambda c, skip: F.when(F.col("ch") == skip, F.col(c)).otherwise(F.col(c) - F.col("n") + 1)
    return x.select(*keys, (F.row_number().over(w) - 1).alias("mod_idx"), kind.alias("type"),
                    first("line", "+").alias("scope_begin"), F.col("line").alias("scope_end"),
                    first("rep", "-").alias("rep_begin"), F.col("rep").alias("rep_end"))


def enclosing(mods: DataFrame, keys: list[str]) -> DataFrame:
    """Scope from the first modification's begin to the last one's end, old and new."""
    return mods.groupBy(*keys).agg(
        F.min_by("scope_begin", "mod_idx").alias("scope_begin"), F.max_by("scope_end", "mod_idx").alias("scope_end"),
        F.min_by("rep_begin", "mod_idx").alias("rep_begin"), F.max_by("rep_end", "mod_idx").alias("rep_end"))


def well_formed(seq: Column) -> Column:
    """Whether no addition of a reduced sequence comes before a replaced line."""
    return ~seq.rlike(r"(?s)\+.*\^")
