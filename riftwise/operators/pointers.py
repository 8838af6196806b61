"""Pointers in IR: constraint rules, what pointers point to, targets of indirect calls and what functions modify.

A variable is module, function and local name, or module and global name. The name of a stack slot, a global or
a function stands for what it holds; its address is taken where it is used as a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftwise.operators import graph
from riftwise.sources.ir import Module
from riftwise.sources.shared import materialize

#: Functions that allocate, free and copy memory (fixed values).
ALLOCATE = ("malloc", "calloc", "realloc", "alloca", "valloc", "_Znwm", "_Znam", "_Znwj", "_Znaj")
FREE = ("free", "_ZdlPv", "_ZdaPv")
COPY = r"^(memcpy|memmove|llvm\.memcpy\..*|llvm\.memmove\..*)$"
KINDS = ("address", "copy", "load", "store")
NAME = r"([%@][-\w.$]+)"
#: What may follow the last operand of a load or store.
TAIL = r"(?:, align \d+)?(?:, !.*)?$"
#: Words that may stand between a type and a name (fixed values).
ATTRIBUTES = ("byval", "inreg", "nest", "noalias", "nocapture", "signext", "sret", "zeroext")


def _var(module: Column, func: Column, name: Column) -> Column:
    """A local name belongs to its function, a global one to its module; anything else is no variable."""
    return F.when(name.startswith("%"), F.concat_ws("\n", module, func, name)).when(
        name.startswith("@"), F.concat_ws("\n", module, name))


def _operand(pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract("text", pattern, group), F.lit(""))


def _last(text: Column) -> Column:
    """The name that a typed operand ends with."""
    return F.nullif(F.regexp_extract(text, NAME + "$", 1), F.lit(""))


def assignments(m: Module) -> DataFrame:
    """(module, lval, l_deref, rval, r_deref): pointer assignments as they are written, before addresses are told apart.

    Loads, stores, casts, element addresses, merges, selections, aggregates, allocations, memory copies and what
    direct calls pass and return. Constants assign nothing.
    """
    at = lambda d, lval, rval, l=False, r=False: d.select(
        "module", _var(F.col("module"), F.col("func"), lval).alias("lval"), F.lit(l).alias("l_deref"),
        _var(F.col("module"), F.col("func"), rval).alias("rval"), F.lit(r).alias("r_deref"))
    i, own = m.instructions, F.col("result")
    op = lambda *names: i.where(F.col("opcode").isin(*names))
    tail, typed = TAIL, r", [^,(]*(?:\([^)]*\)\**)? ?"
    parts = [
        at(op("load"), own, _operand(NAME + tail), r=True),
        at(op("store"), _operand(NAME + tail), _operand(NAME + typed + NAME + tail), l=True),
        at(op("bitcast"), own, _operand(NAME + r" to ")),
        at(op("getelementptr"), own, _operand(r"^getelementptr (?:inbounds )?[^,]*?" + NAME + r"(?:,|$)")),
        at(op("extractvalue"), own, _operand(r"^extractvalue .*?" + NAME + r", \d+")),
        at(op("insertvalue"), own, _operand(r"^insertvalue .*?" + NAME + r", ")),
        at(op("insertvalue"), own, _operand(NAME + r"(?:, \d+)+$")),
        at(op("select"), own, _operand(NAME + r", [^,]*$")),
        at(op("select"), own, _operand(NAME + "$")),
        at(op("phi").select("module", "func", "result", F.explode(
            F.expr(r"regexp_extract_all(text, '\\[ ([%@][-\\w.$]+),', 1)")).alias("v")), own, F.col("v")),
        at(op("call").where(F.col("callee").rlike(COPY)), _last(F.get("args", F.lit(0))), _last(F.get("args", F.lit(1))), True, True),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    direct = i.where("opcode in ('call', 'invoke') and callee is not null").select("module", "func", "ord", "callee")
    return out.unionByName(passed(m, direct)).where("lval is not null and rval is not null").distinct()


def passed(m: Module, calls: DataFrame) -> DataFrame:
    """Assignments of arguments to parameters by position, and of returned values, for calls (module, func, ord, callee)."""
    known = m.instructions.select("module", "func", "ord", "result", "args").join(calls, ["module", "func", "ord"])
    args = known.select("module", "func", "callee", F.posexplode("args").alias("nth", "arg"))
    params = m.functions.where("defined").select(
        "module", F.col("func").alias("callee"), F.posexplode("params").alias("nth", "param"))
    bound = args.join(params, ["module", "callee", "nth"]).select(
        "module", _var(F.col("module"), F.col("callee"), _last(F.col("param"))).alias("lval"), F.lit(False).alias("l_deref"),
        _var(F.col("module"), F.col("func"), _last(F.col("arg"))).alias("rval"), F.lit(False).alias("r_deref"))
    exits = m.instructions.where("opcode = 'ret'").select(
        "module", F.col("func").alias("callee"), _var(F.col("module"), F.col("func"), _last(F.col("text"))).alias("rval"))
    back = known.where("result is not null").join(exits, ["module", "callee"]).select(
        "module", _var(F.col("module"), F.col("func"), F.col("result")).alias("lval"), F.lit(False).alias("l_deref"),
        "rval", F.lit(False).alias("r_deref"))
    return bound.unionByName(back).where("lval is not null and rval is not null").distinct()


def objects(m: Module) -> DataFrame:
    """(name): variables whose names stand for what they hold: stack slots, functions and other globals."""
    slots = m.instructions.where("opcode = 'alloca'").select(_var(F.col("module"), F.col("func"), F.col("result")).alias("name"))
    globals_ = m.instructions.select("module", F.explode(F.array_distinct("refs")).alias("ref")).where("ref like '@%'").select(
        F.concat_ws("\n", "module", "ref").alias("name"))
    functions = m.functions.select(F.concat_ws("\n", "module", F.concat(F.lit("@"), "func")).alias("name"))
    return slots.unionByName(globals_).unionByName(functions).distinct()


def rules(m: Module, assigned: DataFrame) -> DataFrame:
    """(kind, lval, rval) with kind address, copy, load or store, from assignments.

    lval = &rval, lval = rval, lval = *rval and *lval = rval. An address that is stored, and what is copied from
    place to place, go through a variable of their own.
    """
    named = objects(m)
    left = named.select(F.col("name").alias("lval"), F.lit(True).alias("l_object"))
    right = named.select(F.col("name").alias("rval"), F.lit(True).alias("r_object"))
    x = assigned.join(left, "lval", "left").join(right, "rval", "left")
    # What an object's name reaches through one dereference is the object itself.
    x = x.select("lval", "rval", (F.col("l_deref") & F.col("l_object").isNull()).alias("l_deref"),
                 (F.col("r_deref") & F.col("r_object").isNull()).alias("r_deref"),
                 (~F.col("r_deref") & F.col("r_object").isNotNull()).alias("r_address"))
    first = F.when(F.col("r_address"), "address").when(F.col("r_deref"), "load").otherwise("copy")
    through = F.concat_ws("\n", F.lit("="), first, F.col("rval"))
    two = F.col("l_deref") & (first != "copy")
    steps = F.when(two, F.array(F.struct(first.alias("kind"), through.alias("lval"), "rval"),
                                F.struct(F.lit("store").alias("kind"), "lval", through.alias("rval")))).otherwise(
        F.array(F.struct(F.when(F.col("l_deref"), "store").otherwise(first).alias("kind"), "lval", "rval")))
    made = x.select(F.explode(steps).alias("s")).select("s.*")
    sites = m.instructions.where("opcode in ('call', 'invoke') and result is not null").where(
        F.col("callee").isin(*ALLOCATE)).select(
        F.lit("address").alias("kind"), _var(F.col("module"), F.col("func"), F.col("result")).alias("lval"),
        F.concat_ws("\n", "module", "func", F.concat(F.lit("site "), F.col("ord").cast("string"))).alias("rval"))
    return made.unionByName(sites).distinct()


def _solve(found: DataFrame, known: DataFrame | None) -> DataFrame:
    """Points-to sets of rules, from what fewer rules gave."""
    of = {k: found.where(F.col("kind") == k).select("lval", "rval") for k in KINDS}
    start = of["address"] if known is None else of["address"].unionByName(known.toDF("lval", "rval"))
    return graph.points_to(start, of["copy"], of["load"], of["store"])


def points_to(m: Module) -> tuple[DataFrame, DataFrame]:
    """(ptr, loc) of all pointers, and the calls (module, func, ord, callee) that go through pointers.

    The targets of indirect calls pass arguments too, so both are found in turn until no call gets a new target.
    m is read many times: riftwise.sources.ir.settled saves parsing it anew.
    """
    indirect = m.instructions.where("opcode in ('call', 'invoke') and callee is null").select(
        "module", "func", "ord", _var(F.col("module"), F.col("func"), _operand(
            r"^\w+ [^%]*(?:%[-\w.$]+\** )*?(%[-\w.$]+)\(")).alias("ptr")).where("ptr is not null")
    functions = m.functions.select(F.concat_ws("\n", "module", F.concat(F.lit("@"), "func")).alias("loc"), F.col("func").alias("callee"))
    assigned, known = materialize(assignments(m), "assignments"), 0
    pts = None
    while True:  # each round adds targets, of which there are finitely many
        pts = _solve(materialize(rules(m, assigned), "rules"), pts)
        targets = materialize(indirect.join(pts, "ptr").join(functions.distinct(), "loc").select(
            "module", "func", "ord", "callee").distinct(), "targets")
        n = targets.count()
        if n == known:
            return pts, targets
        known, assigned = n, materialize(assigned.unionByName(passed(m, targets)).distinct(), "assignments")


def types_of(values) -> Column:
    """Types of arguments or parameters, without their attributes and names."""
    bare = lambda v: F.regexp_replace(v, rf"\b(?:{'|'.join(ATTRIBUTES)})\b", "")
    value = r"\s+(?:[%@]\S+|-?\d\S*|null|undef|true|false|(?:getelementptr|bitcast|inttoptr)\b.*)\s*$"
    return F.transform(values, lambda v: F.regexp_replace(F.btrim(F.regexp_replace(bare(v), value, "")), r"\s+", " "))


def by_signature(m: Module) -> DataFrame:
    """(module, func, ord, callee): for calls through pointers every defined function with parameters of the same types.

    The coarse choice where nothing is known of what pointers point to.
    """
    indirect = m.instructions.where("opcode in ('call', 'invoke') and callee is null and text not like '% asm %'").select(
        "module", "func", "ord", types_of("args").alias("types"))
    able = m.functions.where("defined").select("module", F.col("func").alias("callee"), types_of("params").alias("types"))
    return indirect.join(able, ["module", "types"]).select("module", "func", "ord", "callee").distinct()


def modified(m: Module, pts: DataFrame, indirect: DataFrame) -> DataFrame:
    """(module, func, loc): what each function, or one that it calls, stores to; its own stack slots included."""
    stores = m.instructions.where("opcode = 'store'").select(
        "module", "func", _var(F.col("module"), F.col("func"), _operand(NAME + TAIL)).alias("ptr")).where("ptr is not null")
    objs = objects(m).withColumnRenamed("name", "ptr")
    own = stores.join(objs, "ptr", "left_semi").select("module", "func", F.col("ptr").alias("loc")).unionByName(
        stores.join(objs, "ptr", "left_anti").join(pts, "ptr").select("module", "func", "loc")).distinct()
    calls = m.instructions.where("opcode in ('call', 'invoke') and callee is not null").select("module", "func", "callee").unionByName(
        indirect.select("module", "func", "callee")).distinct()
    reach = graph.closure(calls.select(F.concat_ws("\n", "module", "func").alias("src"), F.concat_ws("\n", "module", "callee").alias("dst")))
    part = lambda c, n: F.split(c, "\n")[n]
    called = reach.select(part("src", 0).alias("module"), part("src", 1).alias("by"), part("dst", 1).alias("func")).join(
        own, ["module", "func"]).select("module", F.col("by").alias("func"), "loc")
    return own.unionByName(called).distinct()
