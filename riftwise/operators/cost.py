"""Costs of instructions on one fixed target: 64-bit x86 with SSE4.2 and without AVX.

Types are given as text. What the target lacks, such as vectors over 128 bits, counts once for each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Opcodes by class (fixed values).
FLOW = ("ret", "phi", "br")
ARITHMETIC = ("add", "fadd", "sub", "fsub", "mul", "fmul", "udiv", "sdiv", "fdiv", "urem", "srem", "frem", "shl", "lshr",
              "ashr", "and", "or", "xor")
COMPARE = ("icmp", "fcmp", "select")
CASTS = ("trunc", "zext", "sext", "fptoui", "fptosi", "uitofp", "sitofp", "fptrunc", "fpext", "ptrtoint", "inttoptr", "bitcast")
ELEMENTS = ("extractelement", "insertelement")
#: Vector operations that the target lacks: done an element at a time (fixed values).
SCALAR_ONLY = ("udiv", "sdiv", "urem", "srem", "frem")
#: Levels of cost (fixed values).
FREE, BASIC, EXPENSIVE = 0, 1, 4
UNKNOWN = -1


def _size(kind: Column) -> Column:
    """(lanes, bits, vector, real, kind) of a type: elements, bits of each (null if unknown; pointers have 64)."""
    n = F.nullif(F.regexp_extract(kind, r"^<(\d+) x", 1), F.lit("")).cast("int")
    e = F.regexp_extract(kind, r"^(?:<\d+ x )?([^>]*)", 1)
    bits = (F.when(e.endswith("*"), 64).when(e == "float", 32).when(e == "double", 64).when(e == "x86_fp80", 80)
            .when(e == "fp128", 128).otherwise(F.nullif(F.regexp_extract(e, r"^i(\d+)$", 1), F.lit("")).cast("int")))
    return F.struct(F.coalesce(n, F.lit(1)).alias("lanes"), bits.alias("bits"), n.isNotNull().alias("vector"),
                    e.isin("float", "double").alias("real"), e.isin("x86_fp80", "fp128").alias("long"))


def _parts(s: Column) -> Column:
    """Registers that a value takes: 64 bits each for scalars, 128 for vectors; 1 if the type is unknown."""
    room = F.when(s["vector"], 128).otherwise(64)
    return F.when(s["long"], 1).otherwise(F.greatest(F.lit(1), F.ceil(s["lanes"] * s["bits"] / room))).cast("int")


def _scalarised(s: Column) -> Column:
    """Extracts and inserts of all elements; the first of a vector of floats is free both times."""
    return 2 * (s["lanes"] - s["real"].cast("int"))


def with_raw_cost(df: DataFrame) -> DataFrame:
    """df (opcode, type, to_type, args) with cost, -1 if unknown. Calls cost their arguments and one more.

    Sizes of types are columns first, as cost names them often: one expression would outgrow a compiled method.
    """
    x = df.withColumn("_a", _size(F.col("type"))).withColumn("_b", _size(F.col("to_type")))
    x = x.withColumn("_m", F.struct(_parts(F.col("_a")).alias("a"), _parts(F.col("_b")).alias("b"),
                                    _scalarised(F.col("_a")).alias("sa"), _scalarised(F.col("_b")).alias("sb")))
    a, b, m, op = F.col("_a"), F.col("_b"), F.col("_m"), F.col("opcode")
    cast = (F.when((op == "bitcast") & (a["vector"] == b["vector"]), FREE)
            .when(op == "bitcast", F.greatest(m["sa"], m["sb"]) / 2)
            .when(a["vector"] & (op == "trunc") & (a["lanes"] * a["bits"] == b["lanes"] * b["bits"]), FREE)
            .when(a["vector"] & (m["a"] == m["b"]), F.when(op == "sext", 2).otherwise(1))
            .when(a["vector"], m["sb"] + a["lanes"])
            .when((op == "trunc") & (b["bits"] < a["bits"]), FREE)
            .when((op == "zext") & (a["bits"] == 32) & (b["bits"] == 64), FREE)
            .when(F.greatest(a["bits"], b["bits"]) > 64, EXPENSIVE)
            .when(op.isin("uitofp", "fptoui") & (F.least(a["bits"], b["bits"]) > 32), EXPENSIVE).otherwise(BASIC))
    cost = (F.when(op.isin(*FLOW, *ELEMENTS), BASIC).when(op == "alloca", FREE)
            .when(a["vector"] & op.isin(*SCALAR_ONLY), m["sa"] + a["lanes"])
            .when(op.isin(*ARITHMETIC, *COMPARE, "load", "store"), F.coalesce(m["a"], F.lit(1)))
            .when(op.isin(*CASTS), cast)
            .when(op == "call", F.coalesce(F.size("args"), F.lit(0)) + 1)
            .otherwise(UNKNOWN).cast("int"))
    return x.withColumn("cost", cost).drop("_a", "_b", "_m")


def with_cost(instructions: DataFrame) -> DataFrame:
    """instructions with cost; intrinsics are free, unknown costs null, so that sums pass over them."""
    x = with_raw_cost(instructions)
    return x.withColumn("cost", F.when(F.col("callee").startswith("llvm."), FREE).otherwise(
        F.nullif(F.col("cost"), F.lit(UNKNOWN))))


def block_cost(instructions: DataFrame) -> DataFrame:
    """(module, func, bb, cost): sum of the known costs."""
    return instructions.groupBy("module", "func", "bb").agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"))


def loop_cost(instructions: DataFrame, loops: DataFrame) -> DataFrame:
    """(module, func, header, cost): a loop's blocks, those of loops within included."""
    inside = loops.select("module", "func", "bb", F.explode("headers").alias("header"))
    return block_cost(instructions).join(inside, ["module", "func", "bb"]).groupBy("module", "func", "header").agg(
        F.sum("cost").alias("cost"))
