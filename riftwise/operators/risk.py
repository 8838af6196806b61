"""Hotness, cost and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftwise.functions.names import demangle

#: Thresholds and labels of the levels (fixed values).
TIGHT_LOOP = EXPENSIVE = HOT_CALLERS = 10
RISKS = ("no risk", "low risk", "moderate risk", "high risk", "extreme risk")
HOTNESS = ("cold", "regular", "hot")
EXPENSIVENESS = ("minor", "normal", "expensive")


def risk_level(hot: Column, exp: Column, intrinsic: Column) -> Column:
    """0..4 from hotness and expensiveness, each 0..2; none for intrinsics."""
    return F.when(intrinsic, 0).otherwise(F.greatest(F.lit(1), hot + exp))


def named(level: Column, names: tuple[str, ...]) -> Column:
    """Name of a level; UNKNOWN outside the scale."""
    return F.coalesce(F.get(F.array(*map(F.lit, names)), level.cast("int")), F.lit("UNKNOWN"))


def expensiveness(cost: Column) -> Column:
    return F.when(F.coalesce(cost, F.lit(0)) == 0, 0).when(cost > EXPENSIVE, 2).otherwise(1)


def loop_hotness(outer_trip: Column, in_loop: Column) -> Column:
    """The outermost loop decides: hot if its trip count is unknown or above the threshold."""
    return F.when(~in_loop, 0).when(F.coalesce(outer_trip, F.lit(0)).between(1, TIGHT_LOOP), 1).otherwise(2)


def sensitive_branch(expensive: Column, successors: Column) -> Column:
    return (expensive != 0) & (expensive != successors)


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, risk_0 .. risk_4): counts, zero where there are none."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col("risk") == k).alias(f"risk_{k}") for k in range(5)])


def summary(counts: DataFrame, title: Column) -> DataFrame:
    """(value): a text block for each row of a histogram, a line with the title and one for each level."""
    lines = [F.concat(F.lit(f"{name}:\t"), F.col(f"risk_{k}")) for k, name in enumerate(RISKS)]
    return counts.select(F.concat_ws("\n", F.concat(F.lit("===="), title, F.lit("====")), *lines).alias("value"))


def summaries(df: DataFrame, func: str) -> DataFrame:
    """(value): the summary of each function, named as written in its source, and the one over all, which comes last."""
    by = summary(histogram(df, func), F.concat(F.lit("'"), demangle(F.col(func)), F.lit("' risk summary"))).orderBy("value")
    return by.unionByName(summary(histogram(df), F.lit("Overall risk summary")))


def caller_hotness(calls: DataFrame, frequent: DataFrame) -> DataFrame:
    """(callee, hot) from calls (caller, callee, in_loop) and frequent (func).

    Hot: frequent itself, called in a loop, called by a frequent function, or more than HOT_CALLERS - 1 calls
    from others. Calls are summed by pair before the join, so a hot callee costs one row a caller.
    """
    pairs = calls.where("caller <> callee").groupBy("callee", "caller").agg(
        F.count("*").alias("n"), F.max("in_loop").alias("loop"))
    flagged = pairs.join(frequent.select(F.col("func").alias("caller"), F.lit(True).alias("freq")), "caller", "left")
    sums = flagged.groupBy("callee").agg(
        F.sum("n").alias("n"), F.max("loop").alias("loop"), F.max(F.coalesce("freq", F.lit(False))).alias("freq"))
    own = frequent.select(F.col("func").alias("callee"), F.lit(True).alias("own"))
    return sums.join(own, "callee", "left").select(
        "callee", (F.coalesce("own", F.lit(False)) | F.col("loop") | F.col("freq")
                   | (F.col("n") + 1 > HOT_CALLERS)).alias("hot"))


def top_k(df: DataFrame, value: str, key: str, k: int | None = 50) -> DataFrame:
    """The k rows of the largest value, ties by key; all of them, in order, without k."""
    rows = df.orderBy(F.desc(value), key)
    return rows.limit(k) if k and k > 0 else rows


def cost_lookup(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Costs from a dimension table; -1 where it has none."""
    return df.join(table, on, "left").withColumn("cost", F.coalesce("cost", F.lit(-1)))
