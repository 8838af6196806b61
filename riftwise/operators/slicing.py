"""Dependences between instructions, and slices along them within and across functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riftwise.sources.ir import Module
from riftwise.sources.shared import materialize

AT = ["module", "func"]


def _ends(df: DataFrame, kind: str) -> DataFrame:
    return df.select("module", "src_func", "src", "dst_func", "dst", F.lit(kind).alias("kind")).distinct()


def value_edges(m: Module) -> DataFrame:
    """From the instruction that makes a value to those that use it."""
    made = m.instructions.where("result is not null").select(*AT, F.col("result").alias("ref"), F.col("ord").alias("src"))
    used = m.instructions.select(*AT, F.col("ord").alias("dst"), F.explode(F.array_distinct("refs")).alias("ref"))
    x = used.join(made, [*AT, "ref"]).where("src <> dst")
    return _ends(x.withColumn("src_func", F.col("func")).withColumn("dst_func", F.col("func")), "value")


def memory_edges(m: Module) -> DataFrame:
    """From the last store before it, in order of layout, to each load of the same pointer.

    An approximation without aliases: stores through other names of a location are not seen.
    """
    pointer = F.element_at("refs", -1)
    x = m.instructions.where("opcode in ('load', 'store') and size(refs) > 0").withColumn("pointer", pointer)
    w = W.partitionBy(*AT, "pointer").orderBy("ord")
    x = x.withColumn("src", F.last(F.when(F.col("opcode") == "store", F.col("ord")), True).over(w))
    x = x.where("opcode = 'load' and src is not null").select(*AT, "src", F.col("ord").alias("dst"))
    return _ends(x.withColumn("src_func", F.col("func")).withColumn("dst_func", F.col("func")), "memory")


def call_edges(m: Module) -> DataFrame:
    """From a call to the uses of the parameters its arguments bind, by position, and from returns to the call."""
    calls = m.instructions.where("opcode in ('call', 'invoke') and callee is not null").select(
        "module", "func", "ord", "callee", F.posexplode("args").alias("nth", "arg"))
    params = m.functions.where("defined").select(
        "module", F.col("func").alias("callee"), F.posexplode("params").alias("nth", "param")).select(
        "module", "callee", "nth", F.regexp_extract("param", r"(%[-\w.$]+)$", 1).alias("ref"))
    uses = m.instructions.select("module", F.col("func").alias("callee"), F.col("ord").alias("dst"),
                                 F.explode(F.array_distinct("refs")).alias("ref"))
    down = calls.join(params, ["module", "callee", "nth"]).join(uses, ["module", "callee", "ref"]).select(
        "module", F.col("func").alias("src_func"), F.col("ord").alias("src"), F.col("callee").alias("dst_func"), "dst")
    exits = m.instructions.where("opcode = 'ret'").select("module", F.col("func").alias("callee"), F.col("ord").alias("src"))
    up = m.instructions.where("opcode in ('call', 'invoke')").select(
        "module", F.col("func").alias("dst_func"), F.col("ord").alias("dst"), "callee").join(exits, ["module", "callee"])
    return _ends(down, "argument").unionByName(_ends(up.withColumnRenamed("callee", "src_func"), "return"))


def dependences(m: Module, kinds: tuple[str, ...] = ("value", "memory", "argument", "return")) -> DataFrame:
    """(module, src_func, src, dst_func, dst, kind) of the kinds asked for."""
    made = {"value": value_edges, "memory": memory_edges, "argument": call_edges, "return": call_edges}
    parts = {made[k] for k in kinds}
    out = None
    for part in sorted(parts, key=lambda f: f.__name__):
        out = part(m) if out is None else out.unionByName(part(m))
    return out.where(F.col("kind").isin(*kinds))


def slice_of(edges: DataFrame, criteria: DataFrame, forward: bool = True) -> DataFrame:
    """(module, func, ord) that depend on the criteria (module, func, ord), or with forward=False they depend on.

    Rounds extend what the last one found and stop when nothing is new; criteria are included.
    """
    near, far = ("src", "dst") if forward else ("dst", "src")
    steps = materialize(edges.select("module", F.col(f"{near}_func").alias("func"), F.col(near).alias("ord"),
                                     F.col(f"{far}_func").alias("to_func"), F.col(far).alias("to_ord")).distinct(), "steps")
    found = new = materialize(criteria.select("module", "func", "ord").distinct(), "slice")
    while not new.isEmpty():
        ahead = new.join(steps, ["module", "func", "ord"]).select(
            "module", F.col("to_func").alias("func"), F.col("to_ord").alias("ord")).distinct()
        new = materialize(ahead.join(found, ["module", "func", "ord"], "left_anti"), "slice")
        found = found.unionByName(new)  # only what a round finds is written
    return found


def risk_in_slice(touched: DataFrame, levels: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, func, ord, risk): of each touched instruction the greatest risk of what depends on it, itself included.

    Risks (module, func, ord, risk) spread against the edges, so that a long slice is never listed for each start.
    """
    back = edges.select("module", F.col("src_func").alias("func"), F.col("src").alias("ord"),
                        F.col("dst_func").alias("f"), F.col("dst").alias("o")).distinct()
    best = materialize(levels.select("module", "func", "ord", "risk"), "risk")
    while True:
        ahead = back.join(best.select("module", F.col("func").alias("f"), F.col("ord").alias("o"), F.col("risk").alias("r")),
                          ["module", "f", "o"]).groupBy("module", "func", "ord").agg(F.max("r").alias("r"))
        new = materialize(best.join(ahead, ["module", "func", "ord"], "left").select(
            "module", "func", "ord", F.greatest("risk", F.coalesce("r", "risk")).alias("risk"),
            (F.col("r") > F.col("risk")).alias("rose")), "risk")
        best = new.drop("rose")
        if new.where("rose").isEmpty():
            return touched.select("module", "func", "ord").join(best, ["module", "func", "ord"])
