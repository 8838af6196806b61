"""Whole analyses: the risk of a patch to a module, the static profile of a module, the diff of two modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riftwise.functions import paths as P
from riftwise.operators import cfg, cost, match, reduce, risk
from riftwise.sources.ir import Module, call_sites

HUNK = ["patchname", "chapter", "name", "hunk"]
INST = ["module", "func", "ord"]


def instruction_levels(m: Module, profile: DataFrame) -> DataFrame:
    """instructions with cost, intrinsic, exp, hot: how dear each is and how often its place runs.

    exp: callees in SYSCALL, LOCKCALL or EXPCALL are expensive, other named ones normal, indirect ones minor; other
    instructions go by cost. Conditional branches of which some successors only hold expensive instructions are
    expensive. hot: 2 in hot functions, else 1 in functions without loops, else by the outermost loop, which is
    hot unless its trip count is known and small.
    """
    dear = profile.where("segment <> 'FREQCALL'").select(F.col("func").alias("callee"), F.lit(True).alias("dear")).distinct()
    x = cost.with_cost(m.instructions).join(dear, "callee", "left")
    intrinsic = F.coalesce(F.col("callee").startswith("llvm."), F.lit(False))
    called = F.when(F.col("callee").isNull() | intrinsic, 0).when(F.col("dear"), 2).otherwise(1)
    x = x.withColumn("intrinsic", intrinsic).withColumn(
        "exp", F.when(F.col("opcode") == "call", called).otherwise(risk.expensiveness(F.col("cost"))))

    expensive = x.where("exp = 2").groupBy("module", "func", F.col("bb").alias("dst")).agg(F.count("*").alias("n"))
    ahead = m.edges.join(expensive, ["module", "func", "dst"], "left").groupBy("module", "func", F.col("src").alias("bb")).agg(
        F.sum(F.coalesce("n", F.lit(0))).alias("exps"), F.count("*").alias("succs"))
    x = x.join(ahead, ["module", "func", "bb"], "left")
    branch = (F.col("opcode") == "br") & (F.col("succs") > 1) & risk.sensitive_branch(F.col("exps"), F.col("succs"))
    x = x.withColumn("exp", F.when(F.coalesce(branch, F.lit(False)), 2).otherwise(F.col("exp"))).drop("exps", "succs", "dear")

    nest = cfg.loops(m.instructions, m.edges)
    sites = call_sites(m).join(nest.withColumnRenamed("func", "caller"), ["module", "caller", "bb"], "left").select(
        F.concat_ws("\n", "module", "caller").alias("caller"), F.concat_ws("\n", "module", "used").alias("callee"),
        F.col("headers").isNotNull().alias("in_loop"))
    frequent = profile.where("segment = 'FREQCALL'").select("func").distinct()
    often = m.functions.join(frequent, "func").select(F.concat_ws("\n", "module", "func").alias("func")).distinct()
    hot = risk.caller_hotness(sites, often).where("hot").unionByName(
        often.select(F.col("func").alias("callee"), F.lit(True).alias("hot"))).distinct().select(
        F.split("callee", "\n")[0].alias("module"), F.split("callee", "\n")[1].alias("func"), F.lit(True).alias("hot_func"))
    looped = nest.select("module", "func", F.lit(True).alias("looped")).distinct()
    outer = nest.select("module", "func", "bb", F.col("headers")[0].alias("header")).join(
        cfg.trip_counts(m.instructions, m.edges), ["module", "func", "header"], "left")
    x = x.join(outer, ["module", "func", "bb"], "left").join(hot, ["module", "func"], "left").join(
        looped, ["module", "func"], "left")
    own = risk.loop_hotness(F.col("trip"), F.col("header").isNotNull())
    return x.withColumn("hot", F.when(F.col("hot_func"), 2).when(F.col("looped").isNull(), 1).otherwise(own)).drop(
        "hot_func", "looped", "header", "trip")


def _touched(hunks: DataFrame, m: Module, strips: int) -> tuple[DataFrame, DataFrame]:
    """Modifications of hunks, and (patchname, chapter, hunk, module, func, linenumber, lastline) they touch."""
    hunks = hunks.where(P.src2obj(F.col("name")).isNotNull()).withColumn("name", P.renamed(F.col("name")))
    keys = [*HUNK, "start_line", "rep_start_line"]
    mods = reduce.modifications(hunks, keys, reduce.pair_changes(F.col("ctrlseq")), "start_line", "rep_start_line")
    scopes = reduce.enclosing(mods, HUNK).select(*HUNK, F.col("rep_begin").alias("begin"), F.col("rep_end").alias("end"))
    sps = m.subprograms.withColumn("name", F.col("func")).withColumn("file_name", P.stripname(F.col("path"), strips))
    sps = match.fill_last_line(sps, ["module", "path"])
    sps = sps.join(match.first_module(sps), ["file_name", "module"])
    hit = match.match_functions(scopes.withColumn("file_name", F.col("name")).withColumnRenamed("name", "chapter_name"),
                                sps, ["file_name"], ["patchname", "chapter", "hunk"])
    return mods, hit.select("patchname", "chapter", "hunk", "module", "func", "linenumber", "lastline")


def touched_functions(hunks: DataFrame, m: Module, strips: int) -> DataFrame:
    """(patchname, chapter, hunk, module, func, linenumber, lastline): the first function that each hunk touches.

    A chapter belongs to the first module with its path, strips leading components off; headers are passed over.
    """
    return _touched(hunks, m, strips)[1]


def patched_instructions(hunks: DataFrame, m: Module, strips: int) -> DataFrame:
    """(patchname, chapter, name, module, func, ord): instructions that a patch's new lines touch, each once.

    Modifications go in order to the instructions of the function that their hunk touches; deletions are
    passed over.
    """
    mods, hit = _touched(hunks, m, strips)
    changed = mods.where("type <> 'DEL'").join(hit, ["patchname", "chapter", "hunk"]).where("rep_end >= linenumber")
    changed = changed.select(*HUNK, "mod_idx", "module", "func",
                             F.greatest("rep_begin", "linenumber").alias("begin"),
                             F.least("rep_end", F.coalesce("lastline", "rep_end")).alias("end"))
    # A function's modifications are scanned for in order, each from where the one before it stopped.
    order = W.partitionBy("patchname", "chapter", "module", "func").orderBy("hunk", "mod_idx")
    changed = changed.where("begin <= end").withColumn("after", F.lag("end").over(order))
    lined = m.instructions.select(*INST, "line").join(changed, ["module", "func"])
    got = match.match_in_order(lined, [*HUNK, "mod_idx", "module", "func"], F.col("begin"), F.col("end"), F.col("after"))
    return got.select("patchname", "chapter", "name", *INST).distinct()


def assess(hunks: DataFrame, m: Module, profile: DataFrame, strips: int) -> DataFrame:
    """(patchname, chapter, name, module, func, ord, risk) of the instructions that patches touch."""
    levels = instruction_levels(m, profile).withColumn("risk", risk.risk_level(F.col("hot"), F.col("exp"), F.col("intrinsic")))
    return patched_instructions(hunks, m, strips).join(levels.select(*INST, "risk"), INST)


def is_trivial(hunks: DataFrame, m: Module, strips: int) -> bool:
    """Whether patches touch no function of the module."""
    return touched_functions(hunks, m, strips).isEmpty()


def static_profile(m: Module) -> DataFrame:
    """(module, func, cost, sites): the cost of each defined function's dearest path, and its call sites."""
    total = cfg.function_cost(cost.with_cost(m.instructions), m.edges)
    sites = call_sites(m).groupBy("module", F.col("used").alias("func")).agg(F.count("*").alias("sites"))
    return m.functions.where("not func like 'llvm.%'").select("module", "func").distinct().join(
        total, ["module", "func"], "left").join(sites, ["module", "func"], "left").select(
        "module", "func", F.coalesce("total", F.lit(0)).alias("cost"), F.coalesce("sites", F.lit(0)).alias("sites"))


def list_units(m: Module) -> DataFrame:
    """(module, unit): directory#file of each compile unit, in order."""
    return m.units.select("module", F.concat_ws("#", "directory", "filename").alias("unit")).orderBy("module", "unit")
