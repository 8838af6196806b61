import pytest
from pyspark.sql import functions as F

from riftwise.functions import paths as P
from riftwise.operators import cfg, graph, match, pointers, reduce, risk
from riftwise.plans import patches
from riftwise.sources import ir, text

CODE = """@table = global void ()* @one

define void @one() {
  ret void
}

define void @two() {
  store i32 7, i32* @count
  ret void
}

define i32* @same(i32* %q) {
entry:
  ret i32* %q
}

define void @main(i1 %c) {
entry:
  %slot = alloca void ()*
  %cell = alloca i32
  %hold = alloca i32*, align 8
  store void ()* @two, void ()** %slot, align 8
  %f = load void ()** %slot, align 8
  call void %f()
  %a = call i32* @same(i32* %cell)
  %h = call i8* @malloc(i64 4)
  %b = bitcast i8* %h to i32*
  %x = select i1 %c, i32* %a, i32* %b
  store i32* %x, i32** %hold, align 8
  %y = load i32** %hold, align 8
  store i32 1, i32* %y, align 4
  %g = getelementptr inbounds i32** %hold, i64 0
  %z = load i32** %g, align 8
  ret void
}

declare i8* @malloc(i64)
"""


def module(spark, code=CODE):
    return ir.read_ir(text.split_lines(spark.createDataFrame([("m", code)], "file string, value string")))


def test_points_to_and_modified(spark):
    m = ir.settled(module(spark))
    pts, targets = pointers.points_to(m)
    got = {}
    for r in pts.collect():
        got.setdefault(r["ptr"].removeprefix("m\n"), set()).add(r["loc"].removeprefix("m\n"))
    site = next(iter(got["main\n%h"]))
    assert got["main\n%f"] == {"@two"} and got["main\n%a"] == got["same\n%q"] == {"main\n%cell"}
    assert site.startswith("main\nsite ") and got["main\n%b"] == {site}
    assert got["main\n%x"] == got["main\n%y"] == got["main\n%z"] == {site, "main\n%cell"}
    assert [(r["func"], r["callee"]) for r in targets.collect()] == [("main", "two")]
    coarse = {r["callee"] for r in pointers.by_signature(m).collect()}
    assert coarse == {"one", "two"}
    mods = {(r["func"], r["loc"].removeprefix("m\n")) for r in pointers.modified(m, pts, targets).collect()}
    assert {("two", "@count"), ("main", "@count"), ("main", site), ("main", "main\n%cell")} <= mods
    assert not any(f == "one" for f, _ in mods)


def test_strong_components_and_roots(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 4), (6, 6)], "src long, dst long")
    got = {r["node"]: r["component"] for r in graph.strong_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    assert {r["node"] for r in graph.roots(e).collect()} == {5, 6}


@pytest.mark.parametrize("start,step,stay,bound", [
    (s, d, p, b) for p in cfg.OPPOSITE for s, d, b in [(0, 1, 10), (0, 3, 10), (10, -1, 0), (10, -3, 0), (5, 1, 5), (5, 0, 5), (0, 2, 7), (3, 1, 0)]])
def test_rounds(start, step, stay, bound):
    holds = {"eq": int.__eq__, "ne": int.__ne__, "lt": int.__lt__, "le": int.__le__, "gt": int.__gt__, "ge": int.__ge__}[stay]
    n, v = 0, start
    while holds(v, bound) and n < 1000:
        n, v = n + 1, v + step
    assert cfg.rounds(start, step, stay, bound) == (n if n < 1000 else None)


LOOPS = """define void @f(i32 %n) {
entry:
  br label %outer

outer:
  %i = phi i32 [ 0, %entry ], [ %i.next, %next ]
  br label %inner

inner:
  %j = phi i32 [ 8, %outer ], [ %j.next, %inner ]
  %j.next = add nsw i32 %j, -2
  %done = icmp sgt i32 %j.next, 0
  br i1 %done, label %inner, label %next

next:
  %i.next = add i32 %i, 1
  %more = icmp slt i32 %i.next, 12
  br i1 %more, label %outer, label %third

third:
  %k = phi i32 [ 0, %next ], [ %k.next, %third ]
  %k.next = add i32 %k, 1
  %on = icmp ne i32 %k.next, %n
  br i1 %on, label %third, label %end

end:
  ret void
}
"""


def test_trip_counts(spark):
    m = module(spark, LOOPS)
    assert {r["header"]: r["trip"] for r in cfg.trip_counts(m.instructions, m.edges).collect()} == {"outer": 12, "inner": 4, "third": 0}
    none = spark.createDataFrame([], "segment string, func string")
    hot = {(r["bb"], r["hot"]) for r in patches.instruction_levels(m, none).collect()}
    assert hot == {("entry", 0), ("end", 0), ("outer", 2), ("inner", 2), ("next", 2), ("third", 2)}
    few = module(spark, LOOPS.replace("%i.next, 12", "%i.next, 3"))
    hot = {(r["bb"], r["hot"]) for r in patches.instruction_levels(few, none).collect()}
    assert ("inner", 1) in hot and ("third", 2) in hot


def test_loops_touched(spark):
    insts = spark.createDataFrame(
        [("m", "f", b, i, n) for i, (b, n) in enumerate([("h", 10), ("h", 11), ("i", 13), ("i", 14), ("j", 16), ("j", 17), ("t", 20), ("k", 30)])],
        "module string, func string, bb string, ord int, line int")
    nest = spark.createDataFrame([("m", "f", "h", ["h"]), ("m", "f", "i", ["h", "i"]), ("m", "f", "j", ["h", "j"]), ("m", "f", "t", ["h"]),
                                  ("m", "f", "k", ["k"])], "module string, func string, bb string, headers array<string>")
    loops = match.loop_scopes(insts, nest)
    assert {(r["header"], r["parent"], r["b"], r["e"]) for r in loops.collect()} == {
        ("h", None, 10, 20), ("i", "h", 13, 14), ("j", "h", 16, 17), ("k", None, 30, 30)}
    scopes = spark.createDataFrame([(1, "m", "f", 14, 14), (2, "m", "f", 14, 16), (3, "m", "f", 19, 40), (4, "m", "f", 30, 31), (5, "m", "f", 50, 60)],
                                   "id int, module string, func string, begin int, end int")
    assert {r["id"]: r["header"] for r in match.match_loops(scopes, loops, ["id"]).collect()} == {1: "i", 2: "j", 3: "h", 4: "k"}


def test_scans_follow_each_other(spark):
    """Lines 5 6 3 5 9 4 for 3..5 and then 6..9: the second scan starts at the first line beyond 5."""
    lines = [3, 5, 6, 3, 7, None, 5, 12, 8]
    rows = [(k, i, n, *r) for k, r in enumerate([(3, 5, None), (4, 8, 5), (4, 8, 11), (1, 9, None)]) for i, n in enumerate(lines)]
    df = spark.createDataFrame(rows, "k int, ord int, line int, b int, e int, a int")
    got = match.match_in_order(df, ["k"], F.col("b"), F.col("e"), F.col("a")).collect()

    def scan(begin, end, at):
        out = []
        for i in range(at, len(lines)):
            if lines[i] is not None and lines[i] > end:
                return out, i
            if lines[i] is not None and lines[i] >= begin:
                out.append(i)
                begin = lines[i]
        return out, len(lines)

    want = {0: scan(3, 5, 0), 1: scan(4, 8, scan(3, 5, 0)[1]), 2: scan(4, 8, scan(1, 11, 0)[1]), 3: scan(1, 9, 0)}
    for k, (o, _) in want.items():
        assert sorted(r["ord"] for r in got if r["k"] == k) == o


def one(spark, col, **row):
    return spark.createDataFrame([row], ", ".join(f"{k} string" for k in row)).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("line,letter", [("5a", "a"), ("5,6a", None), ("5,6c  ", "c"), ("d", "d"), ("3s/.//", "s"), ("5,c", None), ("12", None), ("ab", None), ("", None)])
def test_ed_command(spark, line, letter):
    assert one(spark, P.ed_command(F.col("s")), s=line) == letter


@pytest.mark.parametrize("root,n", [("/home/x/project", 4), ("/home/x/", 3), ("/m/storage/innodb_plugin", 2), ("/pg/src/", 2)])
def test_count_strips(spark, root, n):
    assert one(spark, P.count_strips(F.col("s")), s=root) == n


@pytest.mark.parametrize("stamp,gone,second", [
    ("1970-01-01 00:00:00", True, 0), ("1970-01-01 00:00:00.000000000 +0000", True, 0), ("1969-12-31 19:00:00 -0500", True, 0),
    ("2011-05-06 10:00:00.123456789 +0200", False, 1304668800), ("rubbish", False, None), (None, False, None)])
def test_patch_times(spark, stamp, gone, second):
    got = spark.createDataFrame([(stamp,)], "s string").select(P.is_epoch(F.col("s")).alias("g"), F.unix_timestamp(P.patch_time(F.col("s"))).alias("t")).first()
    assert got["g"] is gone and got["t"] == second


def test_names(spark):
    x = F.array(*[F.col(c) for c in "abc"])
    assert one(spark, P.best_name(x), a="x/y/long.c", b=None, c="z/long.c") == "z/long.c"
    assert one(spark, P.best_name(x), a="x/ab.c", b="yyy/a.c", c="z/a.c") == "z/a.c"
    assert one(spark, P.best_name(x), a=None, b=None, c=None) is None
    assert one(spark, P.renamed(F.col("p")), p="src/backend/port/sysv_shmem.c") == "src/backend/port/pg_shmem.c"
    assert one(spark, P.renamed(F.col("p")), p="a.c") == "a.c"
    assert one(spark, reduce.well_formed(F.col("s")), s="~^+~") and not one(spark, reduce.well_formed(F.col("s")), s="+~^")
    assert one(spark, risk.named(F.col("n"), risk.RISKS), n="4") == "extreme risk" and one(spark, risk.named(F.col("n"), risk.RISKS), n="5") == "UNKNOWN"


def test_texts_written(spark, tmp_path):
    rows = [("p", 1, "a.c", "source", 1), ("p", 1, "a.c", "source", 2), ("p", 2, "b.c", "created", 1), ("p", 3, "c.txt", "non-source", 1), ("p", 4, "d.c", "deleted", 1)]
    hunks = spark.createDataFrame(rows, "file string, chapter int, name string, status string, hunk int")
    assert text.log_lines(hunks).first()["value"] == "+ b.c\n$ c.txt\n- d.c\nScanned total: 4; Non-source: 1; Delete: 1; Create: 1"
    assert text.source_lines(hunks).first()["value"] == "a.c\nb.c"
    profile = spark.createDataFrame([("f", 5, 1), ("g", 9, 0), ("h", 5, 7)], "func string, cost long, sites long")
    text.write_texts(text.profile_lines(profile, 2).coalesce(1), str(tmp_path / "p"))
    back = text.read_profile(text.read_lines(spark, str(tmp_path / "p" / "*.txt"))).collect()
    assert [(r["segment"], r["func"]) for r in sorted(back, key=lambda r: (r["segment"], r["func"]))] == [
        ("EXPCALL", "f"), ("EXPCALL", "g"), ("FREQCALL", "f"), ("FREQCALL", "h")]
    assert text.profile_lines(profile, None, True).first()["value"].splitlines()[3:] == ["g: 9", "f: 5", "h: 5"]
    levels = spark.createDataFrame([("_Z1fi", 1), ("_Z1fi", 4), ("g", 1)], "func string, risk int")
    got = [r["value"] for r in risk.summaries(levels, "func").collect()]
    assert got[0] == "===='f(int)' risk summary====\nno risk:\t0\nlow risk:\t1\nmoderate risk:\t0\nhigh risk:\t0\nextreme risk:\t1"
    assert got[-1].startswith("====Overall risk summary====\nno risk:\t0\nlow risk:\t2")
