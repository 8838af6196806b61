"""The kernels on the driver's tables, and their SQL for DuckDB.

customers and suppliers stand for functions, orders and line items for instructions and calls, events for
lines in order, page paths for file names and documents for control sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riftwise.functions import paths as P
from riftwise.functions.names import demangle
from riftwise.operators import cfg, cost, diff, graph, match, pointers, reduce, risk, slicing
from riftwise.plans import patches
from riftwise.sources import ir, text

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"), spark)
        if sql:
            SQL[name] = sql
        return f

    return add


RISKED = """
risked AS (
  SELECT o_custkey, o_orderkey, c_mktsegment, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE greatest(1, hot + exp) END AS risk
  FROM (SELECT *, CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_totalprice < 250000 THEN 1 ELSE 2 END AS exp FROM orders)
  JOIN (SELECT o_custkey AS k, CASE WHEN count(*) > 12 THEN 2 WHEN count(*) > 8 THEN 1 ELSE 0 END AS hot FROM orders GROUP BY 1)
    ON o_custkey = k JOIN customer ON o_custkey = c_custkey)"""


def risked(t) -> DataFrame:
    orders = t("orders")
    hot = orders.groupBy("o_custkey").agg(F.count("*").alias("n")).select(
        "o_custkey", F.when(F.col("n") > 12, 2).when(F.col("n") > 8, 1).otherwise(0).alias("hot"))
    exp = F.when(F.col("o_totalprice") < 100000, 0).when(F.col("o_totalprice") < 250000, 1).otherwise(2)
    return orders.join(hot, "o_custkey").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_custkey", "o_orderkey", "c_mktsegment",
        risk.risk_level(F.col("hot"), exp, F.col("o_orderstatus") == "P").alias("risk"))


COUNTS = ", ".join(f"count(*) FILTER (risk = {k}) AS risk_{k}" for k in range(5))


@query("q01_risk_histogram", f"WITH {RISKED} SELECT risk, count(*) AS n FROM risked GROUP BY risk")
def q01(t, spark):
    return risked(t).groupBy("risk").agg(F.count("*").alias("n"))


@query("q02_risk_by_function", f"WITH {RISKED} SELECT c_mktsegment, {COUNTS} FROM risked GROUP BY 1")
def q02(t, spark):
    return risk.histogram(risked(t), "c_mktsegment")


#: Turns of a conversation depend on the turn before; each conversation is a function.
TURNS = "turns AS (SELECT conv_id, turn, length(coalesce(text, '')) % 5 AS risk, role FROM conversations)"


def turns(t) -> DataFrame:
    return t("conversations").select(F.lit("m").alias("module"), F.col("conv_id").cast("string").alias("func"),
                                     F.col("turn").alias("ord"), "role", (F.length(F.coalesce("text", F.lit(""))) % 5).alias("risk"))


def turn_edges(t) -> DataFrame:
    x = turns(t).select("module", F.col("func").alias("src_func"), F.col("ord").alias("src"))
    return x.join(x.select(F.col("src_func").alias("dst_func"), F.col("src").alias("dst")),
                  (F.col("src_func") == F.col("dst_func")) & (F.col("src") + 1 == F.col("dst")))


@query("q03_max_risk", f"""WITH {TURNS}, run AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM turns)
  SELECT conv_id::VARCHAR AS func, turn AS ord, max(risk) OVER (PARTITION BY conv_id, part ORDER BY turn DESC) AS risk FROM run""")
def q03(t, spark):
    """The greatest risk of what depends on each turn."""
    got = slicing.risk_in_slice(turns(t), turns(t), turn_edges(t))
    return got.select("func", "ord", F.col("risk").cast("long").alias("risk"))


@query("q04_profile_semi", """SELECT l_returnflag, count(*) AS n FROM lineitem
  WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10) GROUP BY 1""")
def q04(t, spark):
    profile = t("part").where("p_size <= 10").select(F.col("p_partkey").alias("l_partkey"))
    return t("lineitem").join(profile, "l_partkey", "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("n"))


TOP = "(SELECT o_custkey AS k FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50)"


def frequent(t) -> DataFrame:
    counts = t("orders").groupBy(F.col("o_custkey").alias("func")).agg(F.count("*").alias("n"))
    return risk.top_k(counts, "n", "func").select("func")


@query("q05_frequent_hot", f"""SELECT c_mktsegment, count(*) FILTER (k IS NOT NULL) AS hot, count(*) AS n
  FROM customer LEFT JOIN {TOP} ON c_custkey = k GROUP BY 1""")
def q05(t, spark):
    x = t("customer").join(frequent(t), F.col("c_custkey") == F.col("func"), "left")
    return x.groupBy("c_mktsegment").agg(F.count("func").alias("hot"), F.count("*").alias("n"))


@query("q06_caller_hotness", f"""
WITH calls AS (SELECT l_partkey AS callee, o_custkey AS caller, l_quantity >= 49 AS in_loop
               FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey <> o_custkey)
SELECT callee, bool_or(in_loop) OR bool_or(k1.k IS NOT NULL) OR bool_or(k2.k IS NOT NULL) OR 1 + count(*) > 10 AS hot
FROM calls LEFT JOIN {TOP} k1 ON caller = k1.k LEFT JOIN {TOP} k2 ON callee = k2.k GROUP BY 1""")
def q06(t, spark):
    calls = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_partkey").alias("callee"), F.col("o_custkey").alias("caller"), (F.col("l_quantity") >= 49).alias("in_loop"))
    return risk.caller_hotness(calls, frequent(t))


@query("q07_callsite_topk", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, 1 LIMIT 50")
def q07(t, spark):
    return risk.top_k(t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")), "n", "l_partkey")


@query("q08_cost_topk", """SELECT l_suppkey, sum(CASE WHEN l_quantity >= 5 THEN l_quantity::BIGINT END)::BIGINT AS cost
  FROM lineitem GROUP BY 1 ORDER BY cost DESC, 1 LIMIT 50""")
def q08(t, spark):
    cost = F.when(F.col("l_quantity") >= 5, F.col("l_quantity").cast("long"))
    return risk.top_k(t("lineitem").groupBy("l_suppkey").agg(F.sum(cost).alias("cost")), "cost", "l_suppkey")


def scopes(t) -> DataFrame:
    sec = F.unix_timestamp("ts")
    return t("events").where("value is not null").select(
        "event_id", "user_id", "event_type", sec.alias("b"), (sec + 60 + F.round("value").cast("long") % 240).alias("e"))


def _pairs(t, contains: bool) -> DataFrame:
    x = scopes(t)
    y = x.select(F.col("event_id").alias("other"), "user_id", F.col("b").alias("b2"), F.col("e").alias("e2"))
    return match.interval_join(x.drop("event_type"), y, ["user_id"], 600, contains).where("event_id <> other")


SECONDS = "epoch(date_trunc('second', ts))::BIGINT"
SCOPES = f"""SELECT event_id, user_id, event_type, {SECONDS} AS b, {SECONDS} + 60 + round(value)::BIGINT % 240 AS e FROM events"""


@query("q09_scope_intersects", f"""WITH s AS ({SCOPES}) SELECT a.event_id, z.event_id AS other FROM s a JOIN s z USING (user_id)
  WHERE a.event_id < z.event_id AND z.e >= a.b AND z.b <= a.e""")
def q09(t, spark):
    return _pairs(t, False).where("event_id < other").select("event_id", "other")


@query("q10_scope_includes", f"""WITH s AS ({SCOPES}) SELECT a.event_id, z.event_id AS other FROM s a JOIN s z USING (user_id)
  WHERE a.event_id <> z.event_id AND a.b <= z.b AND z.e <= a.e""")
def q10(t, spark):
    return _pairs(t, True).select("event_id", "other")


@query("q11_innermost_scope", f"""WITH s AS ({SCOPES}) SELECT z.event_id, a.event_id AS scope FROM s a JOIN s z USING (user_id)
  WHERE a.event_id <> z.event_id AND a.b <= z.b AND z.e <= a.e
  QUALIFY row_number() OVER (PARTITION BY z.event_id ORDER BY a.b DESC, a.e, a.event_id) = 1""")
def q11(t, spark):
    x = _pairs(t, True).select(F.col("other").alias("event_id"), F.col("event_id").alias("scope"), "b", "e")
    return match.innermost(x, ["event_id"], "b", "e").select("event_id", "scope")


@query("q12_first_module_wins", "SELECT s_nationkey::VARCHAR AS file_name, min(s_name) AS module FROM supplier GROUP BY 1")
def q12(t, spark):
    return match.first_module(t("supplier").select(F.col("s_nationkey").cast("string").alias("file_name"), F.col("s_name").alias("module")))


@query("q13_lastline_fill", """SELECT event_id, coalesce(CASE WHEN event_type = 'click' THEN event_id + 5 END,
  greatest(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1, event_id)) AS lastline FROM events""")
def q13(t, spark):
    x = t("events").select("event_id", "user_id", F.col("event_id").alias("linenumber"),
                           F.when(F.col("event_type") == "click", F.col("event_id") + 5).alias("lastline"))
    return match.fill_last_line(x, ["user_id"]).select("event_id", "lastline")


@query("q14_block_scope", """SELECT user_id::VARCHAR AS module, 'f' AS func, event_type AS bb, arg_min(v, event_id) AS first, arg_max(v, event_id) AS last
  FROM (SELECT *, round(value)::BIGINT AS v FROM events) GROUP BY 1, 3""")
def q14(t, spark):
    return match.block_scopes(t("events").select(
        F.col("user_id").cast("string").alias("module"), F.lit("f").alias("func"), F.col("event_type").alias("bb"),
        F.col("event_id").alias("ord"), F.round("value").cast("long").alias("line")))


@query("q15_ordered_line_match", """
WITH x AS (SELECT event_id, user_id, round(value)::BIGINT % 50 AS line FROM events),
y AS (SELECT *, max((line > 40)::INT) OVER w AS cut, max(CASE WHEN line BETWEEN 3 AND 40 THEN line END) OVER
  (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
  FROM x WHERE line IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, user_id, line FROM y WHERE cut = 0 AND line BETWEEN 3 AND 40 AND line >= coalesce(top, 3)""")
def q15(t, spark):
    x = t("events").select("event_id", "user_id", F.col("event_id").alias("ord"),
                           (F.round("value").cast("long") % 50).alias("line"))
    return match.match_in_order(x, ["user_id"], F.lit(3), F.lit(40)).select("event_id", "user_id", "line")


#: Vowels are deletions, white space context, other characters additions.
CHARS = """
chars AS (SELECT doc_id, unnest(range(1, length(seq) + 1)) AS pos, unnest(string_split(seq, '')) AS ch FROM (
  SELECT doc_id, translate(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^aeiou \n]', '+', 'g'), '[aeiou]', '-', 'g'), ' ' || chr(10), '~~') AS seq
  FROM documents)),
chunks AS (SELECT *, sum((ch = '~')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS chunk FROM chars),
summed AS (SELECT *, sum(CASE ch WHEN '-' THEN 1 WHEN '+' THEN -1 ELSE 0 END) OVER w AS s, sum((ch = '-')::INT) OVER w AS nth
  FROM chunks WINDOW w AS (PARTITION BY doc_id, chunk ORDER BY pos)),
freed AS (SELECT *, ch = '+' AND s < least(coalesce(min(s) OVER (PARTITION BY doc_id, chunk ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS free FROM summed),
counted AS (SELECT *, sum((ch = '+' AND NOT free)::INT) OVER (PARTITION BY doc_id, chunk) AS m FROM freed),
paired AS (SELECT doc_id, pos, CASE WHEN ch = '-' AND nth <= m THEN '^' ELSE ch END AS ch FROM counted WHERE ch <> '+' OR free)"""
MODS = f"""{CHARS},
lined AS (SELECT *, sum((ch <> '+')::INT) OVER w AS line, sum((ch <> '-')::INT) OVER w AS rep,
  lag(ch) OVER w AS before FROM paired WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
runs AS (SELECT *, sum((before IS DISTINCT FROM ch)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM lined),
mods AS (SELECT doc_id, run, CASE any_value(ch) WHEN '+' THEN 'ADD' WHEN '-' THEN 'DEL' ELSE 'REP' END AS type,
  min(line) AS sb, max(line) AS se, min(rep) AS rb, max(rep) AS re FROM runs WHERE ch <> '~' GROUP BY doc_id, run)"""


def paired(t) -> DataFrame:
    text = F.lower(F.coalesce("text", F.lit("")))
    seq = F.translate(F.regexp_replace(F.regexp_replace(text, r"[^aeiou \n]", "+"), "[aeiou]", "-"), " \n", "~~")
    return t("documents").select("doc_id", reduce.pair_changes(seq).alias("seq"))


@query("q16_ctrlseq_reduce", f"""WITH {CHARS} SELECT doc_id, count(*) FILTER (ch = '^') AS rep, count(*) FILTER (ch = '-') AS del,
  count(*) FILTER (ch = '+') AS add FROM documents LEFT JOIN paired USING (doc_id) GROUP BY 1""")
def q16(t, spark):
    n = lambda c: (F.length("seq") - F.length(F.replace("seq", F.lit(c), F.lit("")))).cast("long")
    return paired(t).select("doc_id", n("^").alias("rep"), n("-").alias("del"), n("+").alias("add"))


@query("q17_mods_scopes", f"""WITH {MODS} SELECT doc_id, arg_min(sb, run)::BIGINT AS scope_begin, arg_max(se, run)::BIGINT AS scope_end,
  arg_min(rb, run)::BIGINT AS rep_begin, arg_max(re, run)::BIGINT AS rep_end FROM mods GROUP BY 1""")
def q17(t, spark):
    return reduce.enclosing(reduce.modifications(paired(t), ["doc_id"], F.col("seq")), ["doc_id"])


@query("q18_modtype_counts", f"WITH {MODS} SELECT type, count(*) AS n FROM mods GROUP BY 1")
def q18(t, spark):
    return reduce.modifications(paired(t), ["doc_id"], F.col("seq")).groupBy("type").agg(F.count("*").alias("n"))


PATH = "regexp_extract(url, '://[^/]*(/[^?#]*)', 1)"


def urls(t) -> DataFrame:
    return t("pages").select("page_id", F.regexp_extract("url", "://[^/]*(/[^?#]*)", 1).alias("p"))


@query("q19_canonpath", f"SELECT page_id, '/' || trim({PATH}, '/') || '/y' AS path FROM pages")
def q19(t, spark):
    return urls(t).select("page_id", P.canonpath(F.concat(F.lit("/../a/..//."), "p", F.lit("/x/.././/y/"))).alias("path"))


@query("q20_stripname", f"SELECT page_id, array_to_string(string_split({PATH}, '/')[3:], '/') AS name FROM pages")
def q20(t, spark):
    return urls(t).select("page_id", P.stripname(F.col("p"), 2).alias("name"))


@query("q21_basename", f"SELECT page_id, string_split({PATH}, '/')[-1] AS name FROM pages")
def q21(t, spark):
    return urls(t).select("page_id", P.stripname(F.col("p"), -1).alias("name"))


@query("q22_pendswith", f"SELECT page_id, string_split({PATH}, '/')[-1] IN ('5.html', '15.html', '25') AS hit FROM pages")
def q22(t, spark):
    hit = [P.pendswith(F.col("p"), F.lit(e)) for e in ("5.html", "/15.html", "25")]
    return urls(t).select("page_id", (hit[0] | hit[1] | hit[2]).alias("hit"))


def files(t) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, (".c", ".h", ".cc", ".cpp", ".C", ".hpp", ".cs", ".txt"))), F.col("p_size") % 8 + 1)
    return t("part").select("p_partkey", F.concat("p_name", suffix).alias("f"))


@query("q23_src2obj", "SELECT p_partkey, CASE WHEN p_size % 8 IN (0, 2, 3, 4, 5) THEN p_name || '.o' END AS obj FROM part")
def q23(t, spark):
    return files(t).select("p_partkey", P.src2obj(F.col("f")).alias("obj"))


@query("q24_countchr", f"SELECT page_id, length({PATH}) - length(replace({PATH}, '/', '')) AS n, instr(url, ':') AS at, length(url) - instr(reverse(url), '/') + 1 AS last FROM pages")
def q24(t, spark):
    x = t("pages").select("page_id", "url", F.regexp_extract("url", "://[^/]*(/[^?#]*)", 1).alias("p"))
    return x.select("page_id", P.countchr(F.col("p"), "/").alias("n"), P.strnchr(F.col("url"), 100, ":").alias("at"),
                    P.lastof(F.col("url"), "/").alias("last"))


@query("q25_common_prefix", """
SELECT page_id, list_max(list_filter(range(0, least(length(url), length(nxt)) + 1), lambda i: url[1:i] = nxt[1:i])) AS n
FROM (SELECT a.page_id, a.url, b.url AS nxt FROM pages a JOIN pages b ON b.page_id = a.page_id + 1)""")
def q25(t, spark):
    a = t("pages").select("page_id", "url")
    b = a.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("nxt"))
    return a.join(b, "page_id").select("page_id", F.length(P.common_prefix(F.col("url"), F.col("nxt"))).alias("n"))


@query("q26_issource", "SELECT p_size % 8 <> 7 AS source, p_size % 8 IN (5, 6) AS ignored, count(*) AS n FROM part GROUP BY 1, 2")
def q26(t, spark):
    return files(t).groupBy(P.issource(F.col("f")).alias("source"), P.ignored(F.col("f")).alias("ignored")).agg(F.count("*").alias("n"))


@query("q27_run_counters", """SELECT count(*) AS total, count(*) FILTER (p_size % 4 = 1) AS non_source, count(*) FILTER (p_size % 4 = 2) AS deleted,
  count(*) FILTER (p_size % 4 = 3) AS created FROM part""")
def q27(t, spark):
    status = F.element_at(F.array(*map(F.lit, ("source", "non-source", "deleted", "created"))), F.col("p_size") % 4 + 1)
    return text.run_counters(t("part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("chapter"), status.alias("status")))


@query("q28_segment_ffill", """SELECT c_nationkey::VARCHAR AS file, ['SYSCALL', 'LOCKCALL', 'EXPCALL', 'FREQCALL'][c_custkey % 4 + 1] AS segment,
  c_name AS func FROM customer""")
def q28(t, spark):
    """A profile for each nation, with a segment for each fourth of its customers."""
    kind = F.element_at(F.array(*map(F.lit, text.KINDS)), (F.col("c_custkey") % 4 + 1).cast("int"))
    parts = t("customer").groupBy("c_nationkey", kind.alias("kind")).agg(F.array_join(F.sort_array(F.collect_list("c_name")), "\n").alias("names"))
    one = F.concat(F.lit("====\n"), "kind", F.lit("\n====\n"), "names")
    texts = parts.groupBy(F.col("c_nationkey").cast("string").alias("file")).agg(F.array_join(F.sort_array(F.collect_list(one)), "\n").alias("value"))
    return text.read_profile(text.split_lines(texts))


@query("q29_module_diff", """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' ELSE 'left' END AS side
  FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey < 20) a
  FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_nationkey > 4) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def q29(t, spark):
    return diff.module_diff(t("customer").where("c_nationkey < 20").select(F.col("c_nationkey").alias("k")),
                            t("supplier").where("s_nationkey > 4").select(F.col("s_nationkey").alias("k")), "k")


@query("q30_anti_left", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def q30(t, spark):
    urgent = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return diff.module_diff(t("customer"), urgent, "c_custkey").where("side = 'left'").select("c_custkey")


@query("q31_anti_right", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q31(t, spark):
    return diff.module_diff(t("labels"), t("documents"), "doc_id").where("side = 'right'").select("doc_id")


#: Turns as nodes of a graph: an edge leads from each to the next, and from the last of every second conversation to its first.
NODES = "n AS (SELECT conv_id, conv_id * 100000 + turn AS node FROM conversations)"
EDGES = f"""{NODES}, e AS (SELECT lag(node) OVER (PARTITION BY conv_id ORDER BY node) AS src, node AS dst FROM n)"""


def edges(t) -> DataFrame:
    node = (F.col("conv_id") * 100000 + F.col("turn")).alias("dst")
    return t("conversations").select(F.lag(node).over(W.partitionBy("conv_id").orderBy(node)).alias("src"), node).where("src is not null")


@query("q32_closure", f"WITH {NODES} SELECT a.node AS src, b.node AS dst FROM n a JOIN n b USING (conv_id) WHERE a.node < b.node")
def q32(t, spark):
    return graph.closure(edges(t))


@query("q33_bounded_reach", f"""WITH {NODES} SELECT node, level FROM (SELECT node, (row_number() OVER w - 1)::INT AS level, count(*) OVER (PARTITION BY conv_id) AS c
  FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY node)) WHERE level <= 3 AND c > 1""")
def q33(t, spark):
    return graph.bounded_reach(edges(t), graph.roots(edges(t)), 3)


@query("q34_longest_path", """SELECT 'o' || o_orderkey AS node, round(c_acctbal)::BIGINT + 1000 + c_nationkey + 5 AS total
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE round(c_acctbal)::BIGINT + 1000 + c_nationkey > 0
  UNION ALL SELECT 'o' || o_orderkey, 5 FROM orders JOIN customer ON o_custkey = c_custkey WHERE round(c_acctbal)::BIGINT + 1000 + c_nationkey <= 0
  UNION ALL SELECT 'c' || c_custkey, round(c_acctbal)::BIGINT + 1000 + c_nationkey FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 1000 + n_nationkey FROM nation""")
def q34(t, spark):
    """Nations lead to their customers, customers to their orders."""
    key = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    e = t("customer").select(key("n", "c_nationkey").alias("src"), key("c", "c_custkey").alias("dst")).unionByName(
        t("orders").select(key("c", "o_custkey").alias("src"), key("o", "o_orderkey").alias("dst")))
    costs = t("nation").select(key("n", "n_nationkey").alias("node"), (F.col("n_nationkey") + 1000).cast("long").alias("cost")).unionByName(
        t("customer").select(key("c", "c_custkey").alias("node"), F.round("c_acctbal").cast("long").alias("cost"))).unionByName(
        t("orders").select(key("o", "o_orderkey").alias("node"), F.lit(5).cast("long").alias("cost")))
    return graph.longest_path(e, costs)


@query("q35_outermost_loop", "SELECT 'c' || c_custkey AS node, 'r' || n_regionkey AS root FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q35(t, spark):
    link = lambda d, a, p, b, q: d.select(F.concat(F.lit(a), p).alias("node"), F.concat(F.lit(b), q).alias("parent"))
    nest = link(t("customer"), "c", "c_custkey", "n", "c_nationkey").unionByName(
        link(t("nation"), "n", "n_nationkey", "r", "n_regionkey")).unionByName(
        t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent")))
    return graph.outermost(nest).where(F.col("node").startswith("c"))


@query("q36_cost_lookup", """SELECT cost, count(*) AS n FROM (SELECT coalesce(c, -1) AS cost FROM part LEFT JOIN
  (VALUES (1, 0), (2, 1), (3, 1), (4, 4), (5, 12)) x(s, c) ON p_size % 7 = s) GROUP BY 1""")
def q36(t, spark):
    table = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 4), (5, 12)], "s int, cost int")
    x = risk.cost_lookup(t("part").withColumn("s", F.col("p_size") % 7), table, ["s"])
    return x.groupBy("cost").agg(F.count("*").alias("n"))


@query("q37_known_cost_sum", """SELECT l_orderkey::VARCHAR AS module, 'f' AS func, l_returnflag AS bb,
  coalesce(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::BIGINT END), 0)::BIGINT AS cost FROM lineitem GROUP BY 1, 3""")
def q37(t, spark):
    return cost.block_cost(t("lineitem").select(
        F.col("l_orderkey").cast("string").alias("module"), F.lit("f").alias("func"), F.col("l_returnflag").alias("bb"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("long")).alias("cost")))


@query("q38_sensitive_branch", """SELECT l_orderkey, count(*) FILTER (l_quantity > 40) <> 0 AND count(*) FILTER (l_quantity > 40) <> count(DISTINCT l_suppkey) AS sensitive
  FROM lineitem GROUP BY 1""")
def q38(t, spark):
    return t("lineitem").groupBy("l_orderkey").agg(risk.sensitive_branch(
        F.count_if(F.col("l_quantity") > 40), F.countDistinct("l_suppkey")).alias("sensitive"))


@query("q40_slice_reach", f"""WITH {TURNS}, run AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM turns),
  x AS (SELECT *, max((risk = 4)::INT) OVER (PARTITION BY conv_id, part ORDER BY turn) AS hit FROM run)
  SELECT conv_id::VARCHAR AS func, turn AS ord FROM x WHERE hit = 1""")
def q40(t, spark):
    """What depends on turns of the greatest risk."""
    return slicing.slice_of(turn_edges(t), turns(t).where("risk = 4")).select("func", "ord")


@query("q42_points_to")
def q42(t, spark):
    """Nations point to their regions, and copy, load and store among themselves."""
    n = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("lval"), F.concat(F.lit("r"), "n_regionkey").alias("rval"))
    k = lambda a: F.concat(F.lit("n"), a.cast("string"))
    c = t("nation").select(F.col("n_nationkey").alias("i"))
    rule = lambda m, d: c.where(F.col("i") % m == 0).select(k(F.col("i")).alias("lval"), k((F.col("i") + d) % 25).alias("rval"))
    return graph.points_to(n, rule(5, 1), rule(7, 2), rule(11, 3))


@query("q43_block_diff")
def q43(t, spark):
    a = t("documents").select(F.col("doc_id").alias("id"), F.split(F.coalesce("text", F.lit("")), "\n").alias("before"))
    b = t("documents").select((F.col("doc_id") - 1).alias("id"), F.split(F.coalesce("text", F.lit("")), "\n").alias("after"))
    return diff.block_diff(a.join(b, "id"))


@query("q44_equivalence_classes", f"""WITH {NODES} SELECT node, min(node) OVER (PARTITION BY conv_id) AS component FROM n
  QUALIFY count(*) OVER (PARTITION BY conv_id) > 1""")
def q44(t, spark):
    return graph.components(edges(t))


@query("q45_strip_count", """SELECT p_partkey, [4, 4, 4 - 1, 3 - 2][p_size % 4 + 1] AS strips FROM part""")
def q45(t, spark):
    root = F.element_at(F.array(F.lit("/a/b/c"), F.lit("/a/b/c/"), F.lit("/a/b/src/"), F.lit("/a/innodb_plugin")), F.col("p_size") % 4 + 1)
    return t("part").select("p_partkey", P.count_strips(root).alias("strips"))


@query("q46_demangle", """
SELECT p_partkey, split_part(p_name, ' ', 1) || '::' || split_part(p_brand, '#', 1) || '(int, char const*)' AS name FROM part""")
def q46(t, spark):
    word = lambda c: F.concat(F.length(c).cast("string"), c)
    mangled = F.concat(F.lit("_ZN"), word(F.split_part("p_name", F.lit(" "), F.lit(1))),
                       word(F.split_part("p_brand", F.lit("#"), F.lit(1))), F.lit("EiPKc"))
    return t("part").select("p_partkey", demangle(mangled).alias("name"))


@query("q47_instruction_cost", """
SELECT opcode, type, count(*) AS n, CAST(sum(CASE
    WHEN opcode = 'br' THEN 1 WHEN opcode = 'alloca' THEN 0 WHEN opcode = 'getelementptr' THEN -1
    WHEN opcode = 'sdiv' AND type = '<8 x i32>' THEN 24 WHEN opcode = 'sdiv' AND type = '<4 x i32>' THEN 12
    WHEN type = 'i128' THEN 2 WHEN type = '<8 x i32>' THEN 2 ELSE 1 END) AS BIGINT) AS cost
FROM (SELECT ['add', 'sdiv', 'icmp', 'load', 'br', 'alloca', 'getelementptr'][CAST(l_partkey % 7 AS INT) + 1] AS opcode,
             ['i32', 'i128', '<4 x i32>', '<8 x i32>'][CAST(l_suppkey % 4 AS INT) + 1] AS type FROM lineitem) GROUP BY 1, 2""")
def q47(t, spark):
    pick = lambda names, key: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names)).cast("int") + 1)
    ops = t("lineitem").select(
        pick(("add", "sdiv", "icmp", "load", "br", "alloca", "getelementptr"), "l_partkey").alias("opcode"),
        pick(("i32", "i128", "<4 x i32>", "<8 x i32>"), "l_suppkey").alias("type"))
    costed = cost.with_raw_cost(ops.withColumns({"to_type": F.lit(None).cast("string"), "args": F.array()}))
    return costed.groupBy("opcode", "type").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))


def modules(t) -> DataFrame:
    """A module for each customer with orders, as IR text: a function that calls one of five for each order."""
    callee = F.concat(F.lit("@prio_"), F.substring("o_orderpriority", 1, 1))
    x = t("orders").groupBy("o_custkey").agg(
        F.array_sort(F.collect_list(F.concat(F.lit("  call void "), callee, F.lit("(i32 "), "o_orderkey", F.lit(")")))).alias("calls"),
        F.array_sort(F.collect_set(F.concat(F.lit("declare void "), callee, F.lit("(i32)")))).alias("known"))
    return x.select(F.col("o_custkey").cast("string").alias("file"), F.concat(
        F.lit("define void @f_"), "o_custkey", F.lit("() {\nentry:\n"), F.array_join("calls", "\n"),
        F.lit("\n  ret void\n}\n"), F.array_join("known", "\n")).alias("value"))


@query("q48_ir_call_sites", """
SELECT 'prio_' || substr(o_orderpriority, 1, 1) AS used, count(*) AS sites, count(DISTINCT o_custkey) AS callers
FROM orders GROUP BY 1""")
def q48(t, spark):
    sites = ir.call_sites(ir.read_ir(text.split_lines(modules(t))))
    return sites.groupBy("used").agg(F.count("*").alias("sites"), F.countDistinct("caller").alias("callers"))


@query("q49_ir_static_profile", """
SELECT CAST(o_custkey AS VARCHAR) AS module, 'f_' || o_custkey AS func, 2 * count(*) + 1 AS cost, CAST(0 AS BIGINT) AS sites
FROM orders GROUP BY o_custkey
UNION ALL
SELECT CAST(o_custkey AS VARCHAR), 'prio_' || substr(o_orderpriority, 1, 1), 0, count(*) FROM orders GROUP BY 1, 2""")
def q49(t, spark):
    return patches.static_profile(ir.read_ir(text.split_lines(modules(t))))


@query("q50_strong_components", f"""WITH {NODES} SELECT node, CASE WHEN conv_id % 2 = 0 THEN min(node) OVER (PARTITION BY conv_id) ELSE node END AS component FROM n
  QUALIFY count(*) OVER (PARTITION BY conv_id) > 1""")
def q50(t, spark):
    """The last turn of every second conversation leads back to its first."""
    ends = edges(t).groupBy(F.floor(F.col("dst") / 100000).alias("c")).agg(F.max("dst").alias("src"), F.min("src").alias("dst"))
    return graph.strong_components(edges(t).unionByName(ends.where("c % 2 = 0").select("src", "dst")))


LEVELS = " || ".join(f"chr(10) || '{name}:' || chr(9) || risk_{k}" for k, name in enumerate(risk.RISKS))


@query("q51_risk_summary", f"""WITH {RISKED}, h AS (
  SELECT '''' || c_mktsegment || ''' risk summary' AS title, {COUNTS} FROM risked GROUP BY c_mktsegment
  UNION ALL SELECT 'Overall risk summary', {COUNTS} FROM risked)
  SELECT '====' || title || '====' || {LEVELS} AS value FROM h""")
def q51(t, spark):
    return risk.summaries(risked(t), "c_mktsegment")


@query("q52_ir_trip_counts", """SELECT s_suppkey::VARCHAR AS module, 'f_' || s_suppkey AS func, 'loop' AS header,
  (greatest(0, ceil((s_suppkey - s_nationkey - 1 - s_suppkey % 7) / (1 + s_suppkey % 7)::DOUBLE)) + 1)::BIGINT AS trip FROM supplier""")
def q52(t, spark):
    """A module for each supplier: a loop that counts from its nation to its key."""
    code = F.concat(F.lit("define void @f_"), "s_suppkey", F.lit("() {\nentry:\n  br label %loop\n\nloop:\n  %i = phi i64 [ "),
                    "s_nationkey", F.lit(", %entry ], [ %n, %loop ]\n  %n = add i64 %i, "), (F.col("s_suppkey") % 7 + 1).cast("string"),
                    F.lit("\n  %c = icmp slt i64 %n, "), "s_suppkey",
                    F.lit("\n  br i1 %c, label %loop, label %end\n\nend:\n  ret void\n}"))
    m = ir.read_ir(text.split_lines(t("supplier").select(F.col("s_suppkey").cast("string").alias("file"), code.alias("value"))))
    return cfg.trip_counts(m.instructions, m.edges)


@query("q53_ir_call_targets", """SELECT n_name AS module, 'g_' || n_regionkey AS callee FROM nation
  UNION SELECT n_name, 'g_' || n_nationkey % 5 FROM nation WHERE n_nationkey % 2 = 0""")
def q53(t, spark):
    """A module for each nation: a slot that holds one function or two of five, and a call through it."""
    put = lambda k: F.concat(F.lit("  store void ()* @g_"), k.cast("string"), F.lit(", void ()** %s, align 8\n"))
    code = F.concat(F.lit("".join(f"define void @g_{k}() {{\n  ret void\n}}\n\n" for k in range(5))),
                    F.lit("define void @f() {\nentry:\n  %s = alloca void ()*\n"), put(F.col("n_regionkey")),
                    F.when(F.col("n_nationkey") % 2 == 0, put(F.col("n_nationkey") % 5)).otherwise(""),
                    F.lit("  %v = load void ()** %s, align 8\n  call void %v()\n  ret void\n}"))
    m = ir.settled(ir.read_ir(text.split_lines(t("nation").select(F.col("n_name").alias("file"), code.alias("value")))))
    return pointers.points_to(m)[1].select("module", "callee").distinct()


@query("q54_header_times", f"SELECT event_id, {SECONDS} - 7200 AS at, false AS gone FROM events")
def q54(t, spark):
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(".000000000 +0200"))
    return t("events").select("event_id", F.unix_timestamp(P.patch_time(stamp)).alias("at"), P.is_epoch(stamp).alias("gone"))


@query("q55_best_name", """SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN p_name || '.c'
  WHEN length(p_name) + 2 < length(p_brand) THEN 'src/' || p_name || '.c' ELSE 'a/' || p_brand END AS name FROM part""")
def q55(t, spark):
    first = F.concat(F.when(F.col("p_size") % 2 == 1, "").otherwise("src/"), "p_name", F.lit(".c"))
    names = F.array(first, F.lit(None).cast("string"), F.concat(F.lit("a/"), "p_brand"))
    return t("part").select("p_partkey", P.best_name(names).alias("name"))


@query("q56_ed_commands", """SELECT letter, count(*) AS n FROM (SELECT CASE
    WHEN substr(o_orderpriority, 1, 1) IN ('2', '3') THEN ['c', 'd'][substr(o_orderpriority, 1, 1)::INT - 1]
    WHEN o_orderkey % 2 = 0 AND substr(o_orderpriority, 1, 1) IN ('1', '4') THEN ['a', 'i'][substr(o_orderpriority, 1, 1)::INT // 3 + 1]
  END AS letter FROM orders) GROUP BY 1""")
def q56(t, spark):
    letter = F.translate(F.substring("o_orderpriority", 1, 1), "12345", "acdix")
    line = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 1, ",99999999").otherwise(""), letter, F.lit(" "))
    return t("orders").groupBy(P.ed_command(line).alias("letter")).agg(F.count("*").alias("n"))


def _segment_sql(kind: str, n: str) -> str:
    return (f"SELECT '====' || chr(10) || '{kind}' || chr(10) || '====' || chr(10) || string_agg(func, chr(10) ORDER BY {n} DESC, func) AS value "
            f"FROM (SELECT * FROM p ORDER BY {n} DESC, func LIMIT 50)")


@query("q57_profile_text", f"""WITH p AS (SELECT l_partkey::VARCHAR AS func, sum(l_quantity::BIGINT)::BIGINT AS cost, count(*) AS sites
  FROM lineitem GROUP BY 1) {_segment_sql("EXPCALL", "cost")} UNION ALL {_segment_sql("FREQCALL", "sites")}""")
def q57(t, spark):
    return text.profile_lines(t("lineitem").groupBy(F.col("l_partkey").cast("string").alias("func")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("cost"), F.count("*").alias("sites")))


@query("q58_continued_scan", """
WITH x AS (SELECT event_id, user_id, round(value)::BIGINT % 50 AS line FROM events),
v AS (SELECT *, max((line > 10)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS begun FROM x WHERE line IS NOT NULL),
y AS (SELECT *, max((line > 40)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS cut,
  max(CASE WHEN line BETWEEN 3 AND 40 THEN line END) OVER
  (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM v WHERE begun = 1)
SELECT event_id, user_id, line FROM y WHERE cut = 0 AND line BETWEEN 3 AND 40 AND line >= coalesce(top, 3)""")
def q58(t, spark):
    x = t("events").select("event_id", "user_id", F.col("event_id").alias("ord"),
                           (F.round("value").cast("long") % 50).alias("line"))
    return match.match_in_order(x, ["user_id"], F.lit(3), F.lit(40), F.lit(10)).select("event_id", "user_id", "line")


#: Code of each customer: a call for each order, of which those of odd keys take the value of the one before.
CODE = """
rows AS (SELECT o_custkey AS k, substr(o_orderpriority, 1, 1) AS p, o_orderstatus AS status, o_orderkey,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
chained AS (SELECT *, i > 1 AND o_orderkey % 2 = 1 AS chained FROM rows)"""
HEAD, OTHER = "src/c", "9"


def code(t, changed: bool = False) -> DataFrame:
    """IR of a module for each customer, with its debug metadata; changed: orders of status P call another function."""
    p = F.substring("o_orderpriority", 1, 1)
    called = F.when((F.col("o_orderstatus") == "P") & F.lit(changed), OTHER).otherwise(p)
    rows = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", called.alias("p")))).alias("all"))
    text_ = lambda *parts: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])
    s = lambda c: c.cast("string")
    k = s(F.col("o_custkey"))
    calls = F.transform("all", lambda o, i: text_(
        "  %v", s(i + 1), " = call i32 @prio_", o["p"], "(i32 %",
        F.when((i > 0) & (o["o_orderkey"] % 2 == 1), F.concat(F.lit("v"), s(i))).otherwise("a"), "), !dbg !", s(i + 101)))
    places = F.transform(F.sequence(F.lit(1), F.size("all") + 1), lambda i: text_(
        "!", s(i + 100), " = metadata !{i32 ", s(i + 10), ", i32 3, metadata !1, null}"))
    known = F.transform(F.array_distinct("all.p"), lambda x: text_("declare i32 @prio_", x, "(i32)"))
    n = F.size("all")
    return rows.select(k.alias("file"), text_(
        "define i32 @f_", k, "(i32 %a) nounwind {\nentry:\n", F.array_join(calls, "\n"), "\n  ret i32 %v", s(n), ", !dbg !", s(n + 101),
        "\n}\n\n", F.array_join(known, "\n"),
        "\n\n!0 = metadata !{i32 720913, i32 0, i32 12, metadata !\"src/c", k, ".c\", metadata !\"/b\", metadata !\"cc\", i1 true}\n",
        "!1 = metadata !{i32 720942, i32 0, metadata !2, metadata !\"f_", k, "\", metadata !\"f_", k, "\", metadata !\"\", metadata !2, i32 10, ",
        "metadata !3, i1 false, i1 true, i32 0, i32 0, i32 0, i32 256, i1 false, i32 (i32)* @f_", k, ", null, null, metadata !4}\n",
        "!2 = metadata !{i32 720937, metadata !\"src/c", k, ".c\", metadata !\"/b\", null}\n", F.array_join(places, "\n")).alias("value"))


def module_of(t, changed: bool = False):
    return ir.read_settled(text.split_lines(code(t, changed)))


@query("q39_ssa_edges", f"""WITH {CODE} SELECT k::VARCHAR AS module, 'f_' || k AS func, i - 1 AS src, i AS dst FROM chained WHERE chained
  UNION ALL SELECT k::VARCHAR, 'f_' || k, n, n + 1 FROM chained WHERE i = n""")
def q39(t, spark):
    got = slicing.value_edges(ir.read_ir(text.split_lines(code(t))))
    return got.select("module", F.col("src_func").alias("func"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


@query("q59_patch_risk", f"""WITH {CODE}, hot AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
  SELECT 'f_' || k AS func, 1 + (p IN ('1', '2'))::INT + CASE WHEN c_custkey IS NOT NULL THEN 2 ELSE 1 END AS risk, count(*) AS n
  FROM chained LEFT JOIN hot ON k = c_custkey WHERE status = 'O' GROUP BY 1, 2""")
def q59(t, spark):
    """Risk of a patch that adds the lines of open orders: from compact patch, IR and profile to levels."""
    rows = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(
        "o_orderkey", F.when(F.col("o_orderstatus") == "O", "+").otherwise("~").alias("ch")))).alias("all"))
    k = F.col("o_custkey").cast("string")
    patch = rows.select(k.alias("file"), F.concat(F.lit("****\np"), k, F.lit("\n====\nsrc/c"), k, F.lit(".c\n####11,11\n"),
                                                  F.array_join("all.ch", "")).alias("value"))
    profile = spark.createDataFrame([("EXPCALL", "prio_1"), ("LOCKCALL", "prio_2")], "segment string, func string").unionByName(
        t("customer").where("c_mktsegment = 'BUILDING'").select(F.lit("FREQCALL").alias("segment"), F.concat(F.lit("f_"), "c_custkey").alias("func")))
    found = patches.assess(text.read_id(text.split_lines(patch)), module_of(t), profile, 2)
    return found.groupBy("func", "risk").agg(F.count("*").alias("n"))


@query("q60_patch_compile", """
WITH rows AS (SELECT o_custkey AS k, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)
SELECT k::VARCHAR AS file, 'src/c' || k || '.c' AS name, 'source' AS status, i::INT AS hunk, (10 * i)::INT AS start_line, (10 * i + 1)::INT AS rep_start_line,
  CASE o_orderstatus WHEN 'O' THEN '~-+~' WHEN 'F' THEN '~+' ELSE '-~' END AS ctrlseq FROM rows""")
def q60(t, spark):
    """A unified diff for each customer, a hunk for each order; lines of some look like headers."""
    rows = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("all"))
    k = F.col("o_custkey").cast("string")

    def hunk(o, i):
        at = lambda c, n: F.concat((10 * (i + 1) + c).cast("string"), F.lit(f",{n}"))
        mark = lambda b, d: F.concat(F.lit("@@ -"), at(0, b), F.lit(" +"), at(1, d), F.lit(" @@ main\n"))
        return F.when(o["o_orderstatus"] == "O", F.concat(mark(3, 3), F.lit(" x\n--- a\n+++ b\n y"))).when(
            o["o_orderstatus"] == "F", F.concat(mark(1, 2), F.lit(" x\n+++ c"))).otherwise(F.concat(mark(2, 1), F.lit("--- d\n z")))

    patch = rows.select(k.alias("file"), F.concat(
        F.lit("diff of c"), k, F.lit("\n--- src/c"), k, F.lit(".c\t2020-05-04 03:02:01\n+++ src/c"), k, F.lit(".c\t2020-05-04 03:02:02\n"),
        F.array_join(F.transform("all", hunk), "\n")).alias("value"))
    return text.compile_patch(text.split_lines(patch)).drop("chapter").withColumn("hunk", F.col("hunk").cast("int"))


@query("q61_function_diff", f"""WITH {CODE} SELECT k::VARCHAR AS module, 'f_' || k AS func,
  CASE WHEN bool_or(status = 'P') THEN 'changed' ELSE 'same' END AS status, count(*) FILTER (status <> 'P') + 1 AS matched,
  count(*) FILTER (status = 'P') AS differ FROM chained GROUP BY k""")
def q61(t, spark):
    a, b = module_of(t), module_of(t, True)
    return diff.function_diff(a.instructions, b.instructions, a.functions, b.functions).where("func like 'f\\_%'")


@query("q62_ir_units", "SELECT DISTINCT o_custkey::VARCHAR AS module, '/b#src/c' || o_custkey || '.c' AS unit FROM orders")
def q62(t, spark):
    return patches.list_units(ir.read_ir(text.split_lines(code(t))))


@query("q63_touched_functions", f"""WITH {CODE} SELECT 'f_' || k AS func, 10 AS linenumber, max(11 + n)::INT AS lastline FROM chained WHERE i = 1 GROUP BY k""")
def q63(t, spark):
    hunks = t("orders").select(F.lit("p").alias("patchname"), F.dense_rank().over(W.partitionBy("o_custkey").orderBy(F.lit(1))).alias("chapter"),
                               F.concat(F.lit("src/c"), "o_custkey", F.lit(".c")).alias("name"), F.col("o_custkey").alias("hunk"),
                               F.lit(11).alias("start_line"), F.lit(11).alias("rep_start_line"), F.lit("-+").alias("ctrlseq")).distinct()
    return patches.touched_functions(hunks.withColumn("chapter", F.col("hunk")), module_of(t), 2).select("func", "linenumber", "lastline")


@query("q64_ir_subprograms", f"""WITH {CODE} SELECT k::VARCHAR AS module, '/b/src/c' || k || '.c' AS path, 'f_' || k AS name, 10 AS linenumber,
  (11 + n)::INT AS lastline FROM chained WHERE i = 1""")
def q64(t, spark):
    return ir.read_ir(text.split_lines(code(t))).subprograms.select("module", "path", "name", "linenumber", "lastline")


def branches(t):
    """IR for each nation: a loop around a branch, whose blocks hold as many calls as its keys say."""
    call = "  call void @g()\n"
    many = lambda c: F.repeat(F.lit(call), (F.col(c) % 5).cast("int"))
    return t("nation").select(F.col("n_name").alias("file"), F.concat(
        F.lit("define void @f(i1 %p, i1 %q) {\nentry:\n  br label %head\n\nhead:\n  br i1 %p, label %then, label %else\n\nthen:\n"), many("n_nationkey"),
        F.lit("  br label %next\n\nelse:\n"), many("n_regionkey"),
        F.lit("  br label %next\n\nnext:\n  br i1 %q, label %head, label %out\n\nout:\n  ret void\n}\n\ndeclare void @g()\n")).alias("value"))


@query("q65_control_dependences", """SELECT n_name AS module, 'f' AS func, unnest(['then', 'else', 'head', 'next']) AS bb,
  unnest(['head', 'head', 'next', 'next']) AS decider FROM nation""")
def q65(t, spark):
    m = ir.read_ir(text.split_lines(branches(t)))
    return cfg.control_dependences(m.instructions, m.edges)


@query("q66_loop_cost", """SELECT n_name AS module, 'f' AS func, 'head' AS header, (4 + n_nationkey % 5 + n_regionkey % 5)::BIGINT AS cost FROM nation""")
def q66(t, spark):
    m = ir.read_ir(text.split_lines(branches(t)))
    return cost.loop_cost(cost.with_cost(m.instructions), cfg.loops(m.instructions, m.edges))


@query("q67_dominators", """SELECT n_name AS module, 'f' AS func, unnest(['entry', 'head', 'then', 'else', 'next', 'out']) AS bb,
  unnest([NULL, 'entry', 'head', 'head', 'head', 'next']) AS idom, unnest([0, 1, 2, 2, 2, 3]) AS depth FROM nation""")
def q67(t, spark):
    m = ir.read_ir(text.split_lines(branches(t)))
    return cfg.dominators(m.instructions, m.edges)


@query("q68_indirect_by_type", """SELECT n_name AS module, 'c' AS func, CASE WHEN n_regionkey % 2 = 0 THEN 'one' ELSE 'two' END AS callee FROM nation""")
def q68(t, spark):
    """A call through a pointer: of two functions of one parameter each, the type tells."""
    arg = F.when(F.col("n_regionkey") % 2 == 0, "i32 7").otherwise("i8* null")
    value = F.concat(F.lit("define void @one(i32 %a) {\n  ret void\n}\n\ndefine void @two(i8* nocapture %b) {\n  ret void\n}\n\n"
                           "define void @c(void (i32)* %f, i64 %n) {\n  call void %f("), arg, F.lit(")\n  ret void\n}\n"))
    m = ir.read_ir(text.split_lines(t("nation").select(F.col("n_name").alias("file"), value.alias("value"))))
    return pointers.by_signature(m).select("module", "func", "callee")
