"""Textual compiler IR (version 3.0 assembly with its debug metadata) as fact tables, from the text source.

A file is a module. Everything is window and string functions over its lines, except the loop nest, which
riftwise.operators.cfg finds a function at a time.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riftwise.functions.paths import canonpath
from riftwise.sources.shared import materialize

#: Tags of the debug metadata (fixed values).
COMPILE_UNIT, SUBPROGRAM, FILE = 720913, 720942, 720937
#: Opcodes that end a block (fixed values).
TERMINATORS = ("br", "switch", "indirectbr", "invoke", "ret", "resume", "unreachable", "unwind")

NAME = r"(?:[-\w.$]+|\"[^\"]+\")"
TYPE = r"((?:<[^>]*>|\[[^\]]*\]|\{[^}]*\}|%?[\w.]+)(?: \([^)]*\))?\**)"
WORDS = r"(?:(?:nsw|nuw|exact|volatile|atomic|inbounds|fast|nnan|ninf|nsz|arcp|[fiosu][a-z]{1,2}|true|false) )*"


class Module(NamedTuple):
    """functions (module, func, defined, params), instructions (module, func, bb, bb_ord, ord, result, opcode, type,
    to_type, callee, refs, args, line, text), edges (module, func, src, dst, nth), units (module, directory,
    filename), subprograms (module, path, name, linenumber, lastline, func)."""

    functions: DataFrame
    instructions: DataFrame
    edges: DataFrame
    units: DataFrame
    subprograms: DataFrame


def _bare(name: Column) -> Column:
    return F.translate(name, '"', "")


def flat(text: Column, depth: int = 4) -> Column:
    """Text without what stands in brackets, so that commas separate arguments only."""
    for _ in range(depth):
        text = F.regexp_replace(text, r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>", "")
    return text


def _args(text: Column) -> Column:
    """Arguments of a call or parameters of a definition: the bracket after the first global name, or local one."""
    inside = F.regexp_extract(text, r"[@%]" + NAME + r"\((.*)\)", 1)
    parts = F.split(flat(inside), r"\s*,\s*")
    return F.filter(parts, lambda a: F.btrim(a) != "")


def read_ir(lines: DataFrame, settle=lambda table: table) -> Module:
    """Fact tables of modules given as lines (file, pos, line). Unknown lines of code are null.

    settle may write a table out: the lines and the instructions, from which others are made, go through it.
    """
    lines = settle(lines)
    w = W.partitionBy("file").orderBy("pos")
    x = lines.withColumn("module", F.col("file"))
    head = F.regexp_extract("line", r"^(?:define|declare) .*?@(" + NAME + r")\s*\(", 1)
    x = x.withColumn("head", F.when(head != "", _bare(head)))
    heads = x.where("head is not null")
    functions = heads.select("module", F.col("head").alias("func"), F.col("line").startswith("define").alias("defined"),
                             _args(F.col("line")).alias("params"))

    begins, ends = F.col("line").startswith("define "), F.col("line") == "}"
    x = x.withColumn("depth", F.sum(begins.cast("int") - ends.cast("int")).over(w))
    x = x.withColumn("func", F.last("head", True).over(w)).where((F.col("depth") > 0) & ~begins)
    x = x.where(F.btrim("line") != "")
    label = F.regexp_extract("line", r"^(?:; <label>:)?(" + NAME + r")(?::|\s|$)", 1)
    is_label = F.col("line").rlike(r"^(?:; <label>:\d+|" + NAME + r":)")
    fw = W.partitionBy("module", "func").orderBy("pos")
    x = x.withColumn("bb", F.coalesce(F.last(F.when(is_label, _bare(label)), True).over(fw), F.lit("")))
    x = x.withColumn("bb_ord", F.sum(is_label.cast("int")).over(fw)).where(~is_label & ~F.col("line").startswith(";"))
    # Switch tables and the labels of an invoke go on for further lines.
    starts = F.col("line").rlike(r"^  [^\s\]]")
    x = x.withColumn("ord", F.sum(starts.cast("int")).over(fw))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.btrim("line").alias("line")))),
                                      lambda s: s["line"]), " ")
    x = x.groupBy("module", "func", "ord").agg(F.first("bb").alias("bb"), F.min("bb_ord").alias("bb_ord"), joined.alias("text"))

    result = F.regexp_extract("text", r"^(%" + NAME + ") = ", 1)
    body = F.regexp_replace("text", r"^%" + NAME + r" = |(?:, )?!dbg !\d+", "")
    x = x.withColumn("dbg", F.regexp_extract("text", r"!dbg !(\d+)", 1)).withColumn(
        "result", F.when(result != "", result)).withColumn("text", F.regexp_replace(body, r"^(?:tail|musttail) ", ""))
    x = x.withColumn("opcode", F.regexp_extract("text", r"^(\w+)", 1))
    is_call = F.col("opcode").isin("call", "invoke")
    callee = _bare(F.regexp_extract("text", r"^[^@]*?@(" + NAME + r")\(", 1))
    first = F.regexp_extract("text", r"^\w+ " + WORDS + TYPE, 1)
    second = F.regexp_extract("text", r"^select [^,]+, " + TYPE, 1)
    pointee = F.regexp_replace(first, r"\*$", "")
    kind = (F.when(F.col("opcode") == "select", second).when(F.col("opcode") == "load", pointee)
            .when(~is_call, first))
    x = x.select(
        "module", "func", "bb", "bb_ord", "ord", "result", "opcode", kind.alias("type"),
        F.nullif(F.regexp_extract("text", r" to " + TYPE + "$", 1), F.lit("")).alias("to_type"),
        F.when(is_call & (callee != ""), callee).alias("callee"),
        F.expr(r"regexp_extract_all(text, '([%@][-\\w.$]+)', 1)").alias("refs"),
        F.when(is_call, _args(F.col("text"))).alias("args"), "dbg", "text")

    meta = lines.where(F.col("line").startswith("!")).select(
        F.col("file").alias("module"), F.regexp_extract("line", r"^!(\d+) = ", 1).alias("id"), "line")
    places = meta.select("module", F.col("id").alias("dbg"), F.regexp_extract(
        "line", r"^!\d+ = metadata !\{i32 (\d+), i32 \d+, metadata ![^\"]*$", 1).alias("n")).where("n <> ''").select(
        "module", "dbg", F.nullif(F.col("n").cast("int"), F.lit(0)).alias("line"))
    instructions = settle(x.join(places, ["module", "dbg"], "left").drop("dbg"))

    edges = instructions.where(F.col("opcode").isin(*TERMINATORS)).select(
        "module", "func", F.col("bb").alias("src"),
        F.posexplode(F.expr(r"regexp_extract_all(text, 'label %([-\\w.$]+)', 1)")).alias("nth", "dst"))

    part = lambda pattern, g: F.regexp_extract("line", pattern, g)
    unit = rf'^!\d+ = metadata !\{{i32 {COMPILE_UNIT}, i32 \d+, i32 \d+, metadata !"([^"]*)", metadata !"([^"]*)"'
    units = meta.where(F.col("line").rlike(unit)).select(
        "module", part(unit, 2).alias("directory"), part(unit, 1).alias("filename"))
    place = rf'^!\d+ = metadata !\{{i32 {FILE}, metadata !"([^"]*)", metadata !"([^"]*)"'
    path = F.when(part(place, 1).startswith("/"), part(place, 1)).otherwise(F.concat(part(place, 2), F.lit("/"), part(place, 1)))
    files = meta.where(F.col("line").rlike(place)).select(
        "module", F.col("id").alias("file_id"), canonpath(path).alias("path"))
    sub = (rf'^!\d+ = metadata !\{{i32 {SUBPROGRAM}, i32 \d+, [^,]+, metadata !"([^"]*)", metadata !"([^"]*)", '
           rf'metadata !"([^"]*)", metadata !(\d+), i32 (\d+),')
    last = instructions.groupBy("module", "func").agg(F.max_by("line", "ord").alias("lastline"))
    subprograms = meta.where(F.col("line").rlike(sub)).select(
        "module", part(sub, 1).alias("name"), part(sub, 4).alias("file_id"), part(sub, 5).cast("int").alias("linenumber"),
        F.nullif(_bare(part(r"\* @(" + NAME + "),", 1)), F.lit("")).alias("func")).where(
        "name <> '' and linenumber > 0").join(files, ["module", "file_id"]).join(last, ["module", "func"], "left").select(
        "module", "path", "name", "linenumber", "lastline", "func")
    return Module(functions, instructions, edges, units, subprograms)


def settled(m: Module) -> Module:
    """The tables written once, for analyses that read them many times over."""
    return Module(*[materialize(table, "ir") for table in m])


def read_settled(lines: DataFrame) -> Module:
    """settled(read_ir(lines)), with the lines split and the instructions read once, not for each table made of them."""
    m = read_ir(lines, lambda table: materialize(table, "ir"))
    return Module(*[table if table is m.instructions else materialize(table, "ir") for table in m])


def call_sites(m: Module) -> DataFrame:
    """(module, used, caller, bb, ord): functions named anywhere in a call, as callee or as an argument."""
    used = m.instructions.where("opcode = 'call'").select(
        "module", F.col("func").alias("caller"), "bb", "ord", F.explode(F.array_distinct("refs")).alias("ref"))
    names = m.functions.select("module", F.concat(F.lit("@"), "func").alias("ref"), F.col("func").alias("used")).distinct()
    return used.join(names, ["module", "ref"]).select("module", "used", "caller", "bb", "ord")
