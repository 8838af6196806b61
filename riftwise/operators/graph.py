"""Graph operators over edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftwise.sources.shared import materialize


def _settled(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration."""
    return materialize(df, "graph")


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) for each dst reachable over one edge or more.

    Each round writes only what it finds: pairs found in the last one, at distances d/2 to d, are extended by
    all pairs within d. Rounds grow with the logarithm of the longest shortest path.
    """
    all_ = new = _settled(edges.select("src", "dst").distinct())
    while not new.isEmpty():
        step = new.alias("n").join(all_.alias("e"), F.col("n.dst") == F.col("e.src")).select(
            F.col("n.src").alias("src"), F.col("e.dst").alias("dst")).distinct()
        new = _settled(step.join(all_, ["src", "dst"], "left_anti"))
        all_ = all_.unionByName(new)
    return all_


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node reaches and is reached from; itself if alone.

    From the closure, whose size is that of all reachable pairs: for call graphs of single modules.
    """
    edges = edges.select("src", "dst").distinct()
    far = closure(edges)
    back = far.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    cycles = far.join(back, ["src", "dst"]).groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least"))
    return nodes.join(cycles, "node", "left").select("node", F.least("node", "least").alias("component"))


def roots(edges: DataFrame) -> DataFrame:
    """(node): sources that nothing leads to."""
    return edges.select(F.col("src").alias("node")).distinct().join(
        edges.where("src <> dst").select(F.col("dst").alias("node")), "node", "left_anti")


def bounded_reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, level): nodes within depth edges of seeds (node), at their least level."""
    found = seeds.select("node", F.lit(0).alias("level")).distinct()
    front = found
    for level in range(1, depth + 1):
        front = front.join(edges, F.col("node") == F.col("src")).select(
            F.col("dst").alias("node"), F.lit(level).alias("level")).distinct()
        front = front.join(found, "node", "left_anti")
        found = found.unionByName(front)
    return found


def longest_path(edges: DataFrame, costs: DataFrame) -> DataFrame:
    """(node, total): largest sum of costs (node, cost) over the paths of a DAG that end in node.

    Relaxation by rounds; a round aggregates before it joins. A cycle is an error.
    """
    # Nodes pack so tightly in files that Spark would take millions of them for few bytes and broadcast them.
    best = _settled(costs.select("node", "cost", F.col("cost").alias("total")))
    for _ in range(best.count() + 1):  # no path of a DAG has more edges
        into = edges.join(best.hint("merge"), F.col("src") == F.col("node")).groupBy("dst").agg(F.max("total").alias("before"))
        new = best.withColumnRenamed("total", "old").join(into, F.col("node") == F.col("dst"), "left").withColumn(
            "total", F.col("cost") + F.greatest(F.coalesce("before", F.lit(0)), F.lit(0)))
        new = _settled(new.select("node", "cost", "total", (F.col("total") != F.col("old")).alias("moved")))
        best = new.drop("moved")
        if new.where("moved").isEmpty():
            return best.drop("cost")
    raise RuntimeError("the graph has a cycle or too long a path")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each node's component, by spreading the least label."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    label = _settled(both.select(F.col("src").alias("node"), F.col("src").alias("component")).distinct())
    while True:
        near = both.join(label, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("near"))
        new = _settled(label.join(near, F.col("node") == F.col("src"), "left").select(
            "node", F.least("component", "near").alias("component"), (F.col("near") < F.col("component")).alias("moved")))
        label = new.select("node", "component")
        if new.where("moved").isEmpty():
            return label


def outermost(parents: DataFrame) -> DataFrame:
    """(node, root) from (node, parent), parent null at the root: the outermost loop of a nest."""
    up = _settled(parents.select("node", F.coalesce("parent", "node").alias("root")))
    for _ in range(64):  # a round doubles the levels climbed: only a cycle goes on
        jump = up.select(F.col("node").alias("n"), F.col("root").alias("r"))
        new = _settled(up.join(jump, F.col("root") == F.col("n"), "left").select(
            "node", F.coalesce("r", "root").alias("root"), (F.coalesce("r", "root") != F.col("root")).alias("moved")))
        up = new.select("node", "root")
        if new.where("moved").isEmpty():
            return up
    raise RuntimeError("the nest has a cycle")


def points_to(addresses: DataFrame, copies: DataFrame, loads: DataFrame, stores: DataFrame) -> DataFrame:
    """(ptr, loc): inclusion-based points-to sets (Andersen, 1994) from rules (lval, rval).

    lval = &rval, lval = rval, lval = *rval and *lval = rval.
    """
    pts = _settled(addresses.select(F.col("lval").alias("ptr"), F.col("rval").alias("loc")).distinct())
    while True:
        of = lambda p: pts.select(F.col("ptr").alias(p), F.col("loc").alias(f"{p}_loc"))
        copied = copies.join(of("rval"), "rval").select(F.col("lval").alias("ptr"), F.col("rval_loc").alias("loc"))
        loaded = loads.join(of("rval"), "rval").join(of("via"), F.col("rval_loc") == F.col("via")).select(
            F.col("lval").alias("ptr"), F.col("via_loc").alias("loc"))
        stored = stores.join(of("lval"), "lval").join(of("rval"), "rval").select(
            F.col("lval_loc").alias("ptr"), F.col("rval_loc").alias("loc"))
        new = _settled(pts.unionByName(copied).unionByName(loaded).unionByName(stored).distinct())
        if new.count() == pts.count():
            return new
        pts = new
