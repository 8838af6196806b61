import pytest
from pyspark.sql import functions as F

from riftwise.functions.names import demangle, demangled
from riftwise.operators import cfg, cost, diff, slicing
from riftwise.plans import patches
from riftwise.sources import ir, text
from riftwise.streaming.patches import watch
from samples import COMPACT, CUT_PATCH, NESTED, PATCH, TANK


@pytest.fixture(scope="module")
def load(spark):
    made = {}

    def get(code):
        if code not in made:
            made[code] = ir.Module(*(d.cache() for d in ir.read_ir(lines(spark, code))))
        return made[code]

    yield get
    for m in made.values():
        for d in m:
            d.unpersist()


def test_instructions(load):
    m = load(TANK)
    fs = {r["func"]: r for r in m.functions.collect()}
    assert fs["refill"]["defined"] and not fs["pour"]["defined"] and fs["refill"]["params"] == ["%tank* %t", "i32 %want"]
    rows = m.instructions.where("func = 'refill'").orderBy("ord").collect()
    assert [r["opcode"] for r in rows] == ["getelementptr", "load", "icmp", "br", "call", "call", "icmp", "br", "phi", "ret"]
    pour = rows[4]
    assert (pour["callee"], pour["line"], pour["result"], len(pour["args"])) == ("pour", 45, "%got", 2)
    assert rows[-1]["bb"] == "full" and rows[0]["bb"] == "start" and rows[1]["type"] == "i32"


def test_debug_metadata(load):
    m = load(TANK)
    assert {(r["name"], r["linenumber"], r["lastline"], r["func"]) for r in m.subprograms.collect()} == {
        ("refill", 41, 49, "refill"), ("shift", 55, 57, "shift")}
    assert patches.list_units(m).first()["unit"] == "/home/dev/plant#lib/tank.c"


def test_loops(load):
    m = load(NESTED)
    got = {(r["func"], r["bb"]): r["headers"] for r in cfg.loops(m.instructions, m.edges).collect()}
    assert got["grid", "body"] == ["a", "b", "c"]
    assert got["grid", "a.next"] == ["a"] and ("grid", "out") not in got and ("main", "entry") not in got


def test_dominators(load):
    m = load(NESTED)
    got = {r["bb"]: (r["idom"], r["depth"]) for r in cfg.dominators(m.instructions, m.edges).where("func = 'choose'").collect()}
    assert got == {"entry": (None, 0), "then": ("entry", 1), "else": ("entry", 1), "end": ("entry", 1)}


def test_control_dependences(load):
    m = load(NESTED)
    rows = cfg.control_dependences(m.instructions, m.edges).collect()
    got = lambda f: {(r["bb"], r["decider"]) for r in rows if r["func"] == f}
    assert got("choose") == {("then", "entry"), ("else", "entry")}
    assert got("spin") == {(b, "head") for b in ("head", "body", "next")} and got("main") == set()


@pytest.mark.parametrize("profile,want", [
    ([], {("refill", 3): 3}),
    ([("LOCKCALL", "pour")], {("refill", 4): 2, ("refill", 3): 1}),
    ([("EXPCALL", "pour"), ("SYSCALL", "settle"), ("FREQCALL", "refill")], {("refill", 4): 1, ("refill", 3): 2})])
def test_patch_risk(spark, load, profile, want):
    hunks = text.read_id(lines(spark, COMPACT))
    known = spark.createDataFrame(profile, "segment string, func string")
    got = patches.assess(hunks, load(TANK), known, 4).groupBy("func", "risk").count().collect()
    assert {(r["func"], r["risk"]): r["count"] for r in got} == want


def test_trivial_patches(spark, load):
    hunks = text.read_id(lines(spark, COMPACT))
    assert not patches.is_trivial(hunks, load(TANK), 4) and patches.is_trivial(hunks, load(TANK), 3)


def test_costs(spark):
    rows = [("add", "i32", None, 1), ("add", "i128", None, 2), ("fadd", "<8 x float>", None, 2), ("sdiv", "<4 x i32>", None, 12),
            ("icmp", "<4 x i32>", None, 1), ("trunc", "i64", "i32", 0), ("zext", "i32", "i64", 0), ("zext", "i8", "i32", 1),
            ("bitcast", "i8*", "i32*", 0), ("load", "<8 x i32>", None, 2), ("alloca", "i32", None, 0), ("getelementptr", "i32*", None, -1),
            ("ret", None, None, 1), ("store", "%struct.x", None, 1)]
    df = spark.createDataFrame(rows, "opcode string, type string, to_type string, want int")
    got = cost.with_raw_cost(df.withColumn("args", F.array()))
    assert [(r["opcode"], r["cost"]) for r in got.collect()] == [(r[0], r[3]) for r in rows]


def test_static_profile(load):
    got = {r["func"]: (r["cost"], r["sites"]) for r in patches.static_profile(load(TANK)).collect()}
    assert got["pour"] == (0, 1) and got["settle"] == (0, 1) and got["refill"][1] == 1 and got["refill"][0] > 0


def test_function_cost_counts_loops_once(spark):
    e = [("a", "b", 0), ("b", "c", 0), ("b", "d", 1), ("c", "b", 0)]
    insts = spark.createDataFrame([("m", "f", b, i, c) for i, (b, c) in enumerate([("a", 1), ("b", 2), ("c", 7), ("d", 3)])],
                                  "module string, func string, bb string, bb_ord int, cost int")
    edges = spark.createDataFrame([("m", "f", *x) for x in e], "module string, func string, src string, dst string, nth int")
    assert cfg.function_cost(insts, edges).first()["total"] == 10
    nest = cfg.loops(insts, edges)
    assert {(r["header"], r["cost"]) for r in cost.loop_cost(insts, nest).collect()} == {("b", 9)}


CODE = """define i32 @callee(i32 %a, i32 %b) {
entry:
  %p = alloca i32
  store i32 %a, i32* %p
  %v = load i32* %p
  switch i32 %v, label %out [
    i32 1, label %one
    i32 2, label %out
  ]

one:                                              ; preds = %entry
  br label %out

out:                                              ; preds = %one, %entry
  ret i32 %v
}

define void @caller(i32 %n) {
  %x = add i32 %n, 1
  %y = mul i32 %n, 2
  %r = call i32 @callee(i32 %x, i32 %y)
  %s = sub i32 %r, 1
  ret void
}
"""


def lines(spark, code, name="m"):
    return text.split_lines(spark.createDataFrame([(name, code)], "file string, value string"))


def test_switch_and_slices(spark):
    m = ir.read_ir(lines(spark, CODE))
    assert {(r["src"], r["dst"]) for r in m.edges.collect()} == {("entry", "out"), ("entry", "one"), ("one", "out")}
    rows = m.instructions.collect()
    at = {(r["func"], r["result"] or r["opcode"]): r["ord"] for r in rows}
    back = {v: k for k, v in at.items()}
    named = lambda d: {(r["func"], next(k[1] for k, v in at.items() if k[0] == r["func"] and v == r["ord"])) for r in d.collect()}
    edges = slicing.dependences(m)
    seed = lambda f, k: spark.createDataFrame([("m", f, at[f, k])], m.instructions.select("module", "func", "ord").schema)
    assert named(slicing.slice_of(edges, seed("caller", "%s"), forward=False)) >= {("caller", "%r"), ("callee", "ret"), ("callee", "%v"), ("callee", "store"), ("caller", "%x")}
    ahead = named(slicing.slice_of(slicing.dependences(m, ("value", "memory")), seed("callee", "store")))
    assert ahead == {("callee", "store"), ("callee", "%v"), ("callee", "switch"), ("callee", "ret")}
    levels = m.instructions.select("module", "func", "ord", F.when(F.col("opcode") == "sub", 4).otherwise(1).alias("risk"))
    got = slicing.risk_in_slice(m.instructions, levels, edges).where("func = 'caller'").collect()
    assert {r["ord"]: r["risk"] for r in got}[at["caller", "%x"]] == 4 and back


def test_function_diff(spark):
    old = ir.read_ir(lines(spark, CODE))
    renamed = CODE.replace("%v", "%w").replace("one:", "uno:").replace("%one", "%uno")
    changed = renamed.replace("mul i32 %n, 2", "mul i32 %n, 3") + "declare void @extra()\n"
    new = ir.read_ir(lines(spark, changed))
    got = diff.function_diff(old.instructions, new.instructions, old.functions, new.functions).collect()
    assert {r["func"]: (r["status"], r["differ"]) for r in got} == {"callee": ("same", 0), "caller": ("changed", 1), "extra": ("right", 0)}


def test_function_diff_of_several_modules(spark):
    both = text.split_lines(spark.createDataFrame([("m", CODE), ("n", CODE.replace("%n, 2", "%n, 5"))], "file string, value string"))
    m = ir.read_ir(both)
    got = diff.function_diff(m.instructions, m.instructions, m.functions, m.functions).collect()
    assert sorted((r["module"], r["func"], r["status"]) for r in got) == [
        (x, f, "same") for x in "mn" for f in ("callee", "caller")]


def longest(x, y):
    """Length of a longest common subsequence, by trying all subsequences of the shorter."""
    import itertools

    x, y = sorted((x, y), key=len)
    for n in range(len(x), 0, -1):
        for pick in itertools.combinations(x, n):
            rest = iter(y)
            if all(c in rest for c in pick):
                return n
    return 0


def test_block_diff(spark):
    import random

    rng = random.Random(4)
    rows = [(i, *[[rng.choice("abc") for _ in range(rng.randint(0, 7))] for _ in range(2)]) for i in range(60)]
    got = {r["id"]: (r["matched"], r["left_only"], r["right_only"]) for r in diff.block_diff(
        spark.createDataFrame(rows, "id long, before array<string>, after array<string>")).collect()}
    assert got == {i: ((n := longest(x, y)), len(x) - n, len(y) - n) for i, x, y in rows}


@pytest.mark.parametrize("name,want", [
    ("_ZL4joinPcPKcS1_i", "join(char*, char const*, char const*, int)"),
    ("_ZN4tree4NodeIPNS_4LeafEED1Ev", "tree::Node<tree::Leaf*>::~Node()"),
    ("_Z3foov", "foo()"), ("_ZNK3Foo3barEi", "Foo::bar(int) const"), ("_ZN3FooC1ERKS_", "Foo::Foo(Foo const&)"),
    ("_Z3maxIiET_S0_S0_", "int max<int>(int, int)"), ("main", "main"), ("_Z", "_Z"), ("_Z9", "_Z9"), (None, None)])
def test_demangle(name, want):
    assert demangled(name) == want


def test_demangle_column(spark):
    df = spark.createDataFrame([("_Z1fi",), (None,), ("g",)], "n string")
    assert [r["d"] for r in df.select(demangle("n").alias("d")).collect()] == ["f(int)", None, "g"]


def test_watched_folder(spark, tmp_path):
    for d in ("in", "out"):
        (tmp_path / d).mkdir()
    (tmp_path / "in" / "a.diff").write_text(PATCH)
    run = lambda: watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    run()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    (tmp_path / "in" / "b.diff").write_text(CUT_PATCH)
    run()
    both = spark.read.parquet(str(tmp_path / "out"))
    assert first == 5 and both.count() == 6 and both.select("batch").distinct().count() == 2


def test_straight_functions_need_no_python(spark):
    """Functions without edges stay out of the tables that go to Python, and the others keep their loops; texts are read once."""
    code = "define void @a() {\nx:\n  br label %y\ny:\n  br label %y\n}\ndefine void @b() {\nx:\n  ret void\n}\n"
    plain, m = ir.read_ir(lines(spark, code)), ir.read_settled(lines(spark, code))
    assert cfg._branching(m.instructions, m.edges).select("func").distinct().collect() == [("a",)]
    assert cfg.loops(m.instructions, m.edges).select("func", "bb", "headers").collect() == [("a", "y", ["y"])]
    for one, other in zip(plain, m):
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
