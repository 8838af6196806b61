import itertools
import random

import pytest
from pyspark.sql import functions as F

from riftwise.functions import paths as P
from riftwise.operators import graph, match, reduce, risk
from riftwise.sources import text
from samples import CUT_HUNKS, CUT_PATCH, DASHES, HUNKS, PATCH, PROFILE


def one(spark, col, **row):
    return spark.createDataFrame([row], ", ".join(f"{k} string" for k in row)).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("path,out", [
    ("/x//y/./z.c", "/x/y/z.c"), ("/x/y/../../z/", "/z"), ("/../../x", "/x"), ("/", "/"), ("x/./y/..", "x"),
    ("x/../../y", None), ("..", None), ("", None), (None, None)])
def test_canonpath(spark, path, out):
    assert one(spark, P.canonpath(F.col("p")), p=path) == out


@pytest.mark.parametrize("path,n,out", [
    ("plant/lib//tank.c", -1, "tank.c"), ("plant//lib/tank.c", 1, "lib/tank.c"), ("plant/lib/", -1, ""),
    ("/plant/tank.c", 1, "plant/tank.c"), ("plant/tank.c", 0, "plant/tank.c"), ("plant/tank.c", 7, "tank.c")])
def test_stripname(spark, path, n, out):
    assert one(spark, P.stripname(F.col("p"), n), p=path) == out


@pytest.mark.parametrize("path,end,hit", [
    ("plant/lib/tank.c", "tank.c", True), ("plant/lib/tank.c", "ank.c", False), ("plant/lib/tank.c", "/lib/tank.c", True),
    ("plant/lib/tank.c", "plant/lib/tank.c", True), ("plant/lib/tank.c", "ib/tank.c", False), ("tank.c", "lib/tank.c", False)])
def test_pendswith(spark, path, end, hit):
    assert one(spark, P.pendswith(F.col("p"), F.col("e")), p=path, e=end) is hit


def test_src2obj(spark):
    got = [one(spark, P.src2obj(F.col("p")), p=p) for p in ("lib/tank.c", "valve.cpp", "lib/tank.h")]
    assert got == ["lib/tank.o", "valve.o", None]


def simulate(seq):
    """First in, first out pairing of each chunk, step by step."""
    out = []
    for k, group in itertools.groupby(seq, lambda c: c == "~"):
        chunk = list(group)
        if k:
            out += chunk
            continue
        waiting, mark, pairs = 0, {}, 0
        for i, c in enumerate(chunk):
            if c == "-":
                waiting += 1
            elif waiting:
                waiting, pairs, mark[i] = waiting - 1, pairs + 1, None
        dels = [i for i, c in enumerate(chunk) if c == "-"][:pairs]
        out += [("^" if i in dels else c) for i, c in enumerate(chunk) if i not in mark]
    return "".join(out)


def test_pairing(spark):
    rng = random.Random(1)
    seqs = [(i, "".join(rng.choices("+-~", (4, 4, 1), k=rng.randint(1, 40)))) for i in range(300)]
    df = spark.createDataFrame(seqs, "id long, seq string")
    found = {r["id"]: r["s"] for r in df.select("id", reduce.pair_changes(F.col("seq")).alias("s")).collect()}
    assert all(found[i] == simulate(s) for i, s in seqs)


@pytest.mark.parametrize("start,rep,seq,mods", [
    (7, 9, "~--+~", [("REP", 8, 8, 10, 10), ("DEL", 9, 9, 10, 10)]),
    (1, 1, "++~-", [("ADD", 0, 0, 1, 2), ("DEL", 2, 2, 3, 3)]),
    (5, 5, "~~~", []), (4, 6, "-+-+~+", [("REP", 4, 5, 6, 7), ("ADD", 6, 6, 9, 9)])])
def test_modifications(spark, start, rep, seq, mods):
    df = spark.createDataFrame([(1, start, rep, seq)], "id long, a long, c long, seq string")
    got = reduce.modifications(df, ["id", "a", "c"], reduce.pair_changes(F.col("seq")), "a", "c").orderBy("mod_idx").collect()
    assert [(r["type"], r["scope_begin"], r["scope_end"], r["rep_begin"], r["rep_end"]) for r in got] == mods


def lines(spark, code):
    return text.split_lines(spark.createDataFrame([("p", code)], "file string, value string"))


@pytest.mark.parametrize("patch,want", [(PATCH, HUNKS), (CUT_PATCH, CUT_HUNKS)])
def test_patch_compiler(spark, patch, want):
    hunks = text.compile_patch(lines(spark, patch))
    got = hunks.where("status = 'source'").orderBy("hunk").collect()
    assert [(r["start_line"], r["rep_start_line"], r["ctrlseq"]) for r in got] == want
    if patch == PATCH:
        assert {(r["name"], r["status"]) for r in hunks.collect()} == {
            ("lib/tank.c", "source"), ("valve.c", "created"), ("pipe.c", "deleted"), ("todo.txt", "non-source")}


def test_lines_like_headers(spark):
    got = text.compile_patch(lines(spark, DASHES)).orderBy("chapter").collect()
    assert [(r["name"], r["ctrlseq"]) for r in got] == [("a.sql", "~-+"), ("b.c", "~+")]


def test_small_path_functions(spark):
    got = [one(spark, P.parse_int(F.col("p")), p=p) for p in ("12,3", "0", "x", "9" * 30, "", None)]
    assert got == [12, 0, None, None, None, None]


def test_profiles(spark):
    rows = text.read_profile(lines(spark, PROFILE)).collect()
    assert [(r["segment"], r["func"]) for r in rows] == [
        ("SYSCALL", "open"), ("SYSCALL", "read"), ("EXPCALL", "sort"), ("SYSCALL", "read")]


def test_id_round_trip(spark, tmp_path):
    hunks = text.compile_patch(lines(spark, PATCH))
    text.write_id(hunks, str(tmp_path / "out"))
    back = text.read_id(text.read_lines(spark, str(tmp_path / "out")))
    assert [r["ctrlseq"] for r in back.orderBy("chapter", "hunk").collect()] == [
        r["ctrlseq"] for r in hunks.where("status = 'source'").orderBy("chapter", "hunk").collect()]


def test_match_in_order(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.choice([None, *range(1, 12)])) for g in range(60) for i in range(12)]
    want = set()
    for g in range(60):
        top = 3
        for _, i, line in (r for r in rows if r[0] == g):
            if line is None:
                continue
            if line > 9:
                break
            if line >= top:
                want.add((g, i))
                top = line
    got = match.match_in_order(spark.createDataFrame(rows, "g long, ord long, line long"), ["g"], F.lit(3), F.lit(9))
    assert {(r["g"], r["ord"]) for r in got.collect()} == want


def test_function_boundaries(spark):
    sps = spark.createDataFrame([("f", "a", 10, 20), ("f", "b", 21, 21), ("f", "c", 25, 40)], "file string, name string, linenumber long, lastline long")
    scopes = spark.createDataFrame([("f", 1, 12, 14), ("f", 2, 20, 20), ("f", 3, 21, 21), ("f", 4, 22, 25), ("f", 5, 20, 30)],
                                   "file string, id long, begin long, end long")
    got = match.match_functions(scopes, sps, ["file"], ["id"])
    assert {r["id"]: r["name"] for r in got.collect()} == {1: "a", 3: "b", 5: "b"}


def test_interval_join(spark):
    rng = random.Random(3)
    rows = [(k, i, (b := rng.randint(0, 300)), b + rng.randint(0, 90)) for k in range(3) for i in range(40)]
    a = spark.createDataFrame(rows, "k long, i long, b long, e long")
    z = a.select("k", F.col("i").alias("j"), F.col("b").alias("b2"), F.col("e").alias("e2"))
    got = sorted((r["k"], r["i"], r["j"]) for r in match.interval_join(a, z, ["k"], 25).collect())
    assert got == sorted((x[0], x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and y[3] >= x[2] and y[2] <= x[3])


def test_risk_levels(spark):
    df = spark.createDataFrame([(h, e) for h in range(3) for e in range(3)], "h int, e int")
    got = {(r["h"], r["e"]): r["x"] for r in df.select("*", risk.risk_level(F.col("h"), F.col("e"), F.lit(False)).alias("x")).collect()}
    assert got == {(h, e): max(1, h + e) for h in range(3) for e in range(3)}


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "src long, dst long")
    assert graph.closure(e).count() == 10
    assert {(r["node"], r["component"]) for r in graph.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    dag = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4)], "src long, dst long")
    cost = spark.createDataFrame([(1, 1), (2, 5), (3, 2), (4, 1)], "node long, cost long")
    assert {r["node"]: r["total"] for r in graph.longest_path(dag, cost).collect()} == {1: 1, 2: 6, 3: 3, 4: 7}


def test_longest_path_sends_no_large_table(spark):
    """400,000 nodes are below the threshold of broadcasts in files, but far over it in memory."""
    n = 400_000
    nodes = spark.range(n).select(F.concat(F.lit("n"), "id").alias("node"), (F.col("id") % 3 - 1).alias("cost"))
    edges = spark.range(n).where("id % 4 < 3").select(
        F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("n"), F.col("id") + 1).alias("dst"))
    want = [0] * n
    for i in range(n):
        want[i] = i % 3 - 1 + (max(0, want[i - 1]) if i % 4 else 0)
    limits = {"spark.sql.autoBroadcastJoinThreshold": "4m", "spark.sql.maxBroadcastTableSize": str(10 << 20)}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        got = graph.longest_path(edges, nodes).select(F.expr("int(substr(node, 2))"), "total").toPandas()
    finally:
        for k in limits:
            spark.conf.unset(k)
    assert dict(got.itertuples(index=False, name=None)) == dict(enumerate(want))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
