"""Mixing sources to target weights, in DataFrame operations only.

The words of each source are laid end to end, documents in pseudorandom order, and cut into blocks of
BLOCK words. The mixture is written in output shards of SHARD slots. Each shard draws how many of its slots
each source gets: the whole part of its expected number, and multinomial draws by the remainders for the slots
that are left. The nth slot of a shard and source becomes an index among all slots of the source, and a
keyed permutation of the block indices, another one for every pass over the source, maps it to a block, which
is joined by index. No block is taken by more passes than MOST.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import SPACE_CHARS, SPACES, materialize, text_key, words_of

BLOCK = 128
#: Slots of an output shard.
SHARD = 4096
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
#: Rounds of a permutation, and the prime by which they mix.
ROUNDS, PRIME = 16, (1 << 31) - 1
#: Expected numbers of slots count in parts of 1 / PARTS, remainders in parts of 1 / FINE.
PARTS, FINE = 1024, 1 << 20
#: Cells by which a draw finds its source.
CELLS = 1024


def word_count(text: Column) -> Column:
    """Number of words; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACES))).cast("long")


def draw(*parts: Column) -> Column:
    """31 pseudorandom bits from the columns: the start of an MD5, which every engine computes alike."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit((1 << 31) - 1))


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """sizes with sid, weight and target; sizes has a row (source, source_size, ...) for each source, sid is its rank.

    Weights repeat over the sources in code point order, null last. Targets share `share` of all words by
    weight; those over `most` times their source's size stop there and the excess goes to the others, until
    none is above. That is target = least(cap, level * weight) with one level for all: with the sources
    sorted by cap / weight, the level is that of the first which it would not fill; later ones give less.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    order = W.orderBy("ratio", F.col("source").isNull(), "source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("sid") % len(weights) + 1)
    x = sizes.withColumn("sid", F.row_number().over(by_name) - 1)
    x = x.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    x = x.withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = (x.withColumn("all_words", F.sum("source_size").over(everything) * F.lit(share))
          .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
          .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    x = x.withColumn("level", (F.col("all_words") - F.col("full")) / F.col("open"))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    x = x.withColumn("target", F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("weight")))
    return x.select(*sizes.columns, "sid", "weight", "target")


def place(docs: DataFrame) -> DataFrame:
    """docs (doc_id, key, sid, runs, size) with start: where each document's words start in its source.

    Runs of a source, cut by hash, are summed and placed first, then documents within each run. A source of n
    documents has about sqrt(n) runs of sqrt(n) documents, so that no task holds a whole source.
    """
    docs = docs.withColumn("d", draw(F.col("doc_id"))).withColumn("run", F.col("d") % F.col("runs"))
    before = W.orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    sums = docs.groupBy("sid", "run").agg(F.sum("size").alias("words")).select(
        "sid", "run", F.coalesce(F.sum("words").over(before.partitionBy("sid")), F.lit(0)).alias("base"))
    inner = W.partitionBy("sid", "run").orderBy("d", "doc_id", "key").rowsBetween(W.unboundedPreceding, -1)
    docs = docs.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return docs.join(sums, ["sid", "run"]).withColumn("start", F.col("base") + F.col("inner")).drop(
        "d", "run", "runs", "base", "inner")


def _blocks(size: Column) -> Column:
    return F.ceil(size / BLOCK).cast("long")


def _stretches(x: DataFrame, count: Column, name: str, step: int = SHARD) -> DataFrame:
    """x with a row for each number below count, made in stretches that tasks share."""
    x = x.where(count > 0).withColumn("_n", count.cast("long")).withColumn(
        "_at", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {step}"))))
    x = x.repartition(*[c for c in x.columns if c != "_n"])
    return x.withColumn(name, F.explode(F.sequence(F.col("_at") * step, F.least((F.col("_at") + 1) * step, F.col("_n")) - 1))).drop(
        "_n", "_at")


def shard_counts(plan: DataFrame) -> DataFrame:
    """(shard, sid, n): how many slots of each output shard each source gets.

    plan: (source, sid, source_size, target). All shards but the last have SHARD slots. A shard gives each
    source the whole part of its expected number of slots; the slots that are left are drawn one by one by
    the remainders, so the counts are multinomial beyond their whole parts and sum to the shard's slots.
    """
    spark = plan.sparkSession
    share = F.floor(F.col("target") * _blocks(F.col("source_size")) / F.col("source_size") * PARTS + 0.5).cast("long")
    x = materialize(plan.where("source_size > 0").select("sid", share.alias("share")).where("share > 0"), "shares")
    whole = x.agg(F.sum("share")).first()[0] or 0
    slots = (whole + PARTS // 2) // PARTS
    full, rest = divmod(slots, SHARD)
    out = spark.createDataFrame([], "shard long, sid int, n long")
    for size, first, count in ((SHARD, 0, full), (rest, full, int(rest > 0))):
        if not count:
            continue
        y = x.withColumns({"whole": F.expr(f"{size}L * share div {whole}L"),
                           "part": F.floor((F.lit(size).cast("long") * F.col("share") % whole) / F.lit(float(whole)) * FINE)})
        y = materialize(y.withColumn("hi", F.sum("part").over(W.orderBy("sid"))).withColumn("lo", F.col("hi") - F.col("part")), "parts")
        total, given = y.agg(F.max("hi"), F.sum("whole")).first()
        base = _stretches(y.where("whole > 0"), F.lit(count), "shard").select(
            (F.col("shard") + first).alias("shard"), "sid", F.col("whole").alias("n"))
        out = out.unionByName(base)
        if size > given and total:
            cell = lambda c: F.expr(f"({c}) * {CELLS} div {total}")
            found = y.where("part > 0").withColumn("cell", F.explode(F.sequence(cell("lo"), cell("hi - 1")))).select(
                "cell", "sid", "lo", "hi")
            draws = spark.range(first, first + count).select(F.col("id").alias("shard"), F.explode(F.sequence(
                F.lit(1), F.lit(size - given))).alias("i")).select(
                "shard", (draw(F.lit("shard"), F.col("shard"), F.col("i")) % total).alias("v"))
            drawn = draws.withColumn("cell", cell("v")).join(found, "cell").where("lo <= v and v < hi")
            out = out.unionByName(drawn.select("shard", "sid", F.lit(1).cast("long").alias("n")))
    return out.groupBy("shard", "sid").agg(F.sum("n").alias("n"))


def permuted(at: str, n: str, keys: str) -> Column:
    """Where a keyed permutation of range(n) takes the number at: by every key (k, a) it swaps or not.

    A round pairs x with k - x modulo n, and a bit that both share decides whether they change places
    (Hoang, Morris and Rogaway, 2012), which is a permutation for any n.
    """
    y = f"pmod(e.k - v, {n})"
    h = f"((greatest(v, {y}) % {PRIME} + e.a) % {PRIME})"
    return F.expr(f"aggregate({keys}, {at}, (v, e) -> if(shiftright({h} * {h} % {PRIME} * 48271 % {PRIME}, 16) & 1 = 1, {y}, v))")


def slots(plan: DataFrame) -> DataFrame:
    """(sid, shard, nth, pass, block) for every slot that the shards give to sources.

    Slots of a source beyond MOST passes over its blocks, which draws may give it, stay empty.
    """
    counts = materialize(shard_counts(plan), "counts")
    # Numbers of the source's slots before a shard: by groups of shards, then within each group.
    group = F.floor(F.sqrt(F.col("shard"))).cast("long")  # the group g holds 2 g + 1 shards
    counts = counts.withColumn("group", group)
    before = W.partitionBy("sid").orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    sums = counts.groupBy("sid", "group").agg(F.sum("n").alias("all")).select(
        "sid", "group", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inner = W.partitionBy("sid", "group").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    x = counts.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(sums, ["sid", "group"]).select(
        "sid", "shard", "n", (F.col("base") + F.col("inner")).alias("from"))
    x = x.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    sizes = plan.where("source_size > 0").select("sid", "source", _blocks(F.col("source_size")).alias("blocks"))
    passes = sizes.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(int(MOST) - 1).cast("long"))))
    keyed = passes.withColumn("keys", F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda r: F.struct(
        (draw(F.col("source"), F.col("pass"), r, F.lit("k")) % F.col("blocks")).alias("k"),
        draw(F.col("source"), F.col("pass"), r, F.lit("a")).alias("a")))).select("sid", "pass", "keys")
    x = x.join(sizes.select("sid", "blocks"), "sid").withColumn("at", F.col("from") + F.col("nth"))
    x = x.withColumn("pass", F.expr("at div blocks")).withColumn("at", F.expr("at % blocks"))
    x = x.join(keyed, ["sid", "pass"])
    return x.select("sid", "shard", "nth", "pass", permuted("at", "blocks", "keys").alias("block"))


def _measured(docs: DataFrame) -> DataFrame:
    return materialize(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"),
        F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "sizes")


def _pieces(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc_id, key, sid, pass, lo, hi): word ranges [lo, hi) of the documents in the blocks that slots take.

    sized: (doc_id, key, sid, runs, size).
    """
    put = place(sized).where("size > 0").withColumn("block", F.explode(F.sequence(
        F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK))))
    put = put.withColumn("lo", F.greatest(F.lit(0), F.col("block") * BLOCK - F.col("start"))).withColumn(
        "hi", F.least("size", (F.col("block") + 1) * BLOCK - F.col("start")))
    # Both sides grow with the data, and index rows shrink so much in a shuffle that its size misleads.
    return put.join(slots(plan).select("sid", "block", "pass").hint("merge"), ["sid", "block"]).select(
        "doc_id", "key", "sid", "pass", "lo", "hi")


def plan_of(sized: DataFrame) -> DataFrame:
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"),
                                       F.ceil(F.sqrt(F.count("*"))).cast("long").alias("runs"))
    return materialize(targets(sums), "targets")


def _numbered(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """sized with sid and runs instead of source."""
    ids = plan.select(F.col("source").alias("s"), "sid", "runs")
    return sized.join(ids, F.col("source").eqNullSafe(F.col("s"))).drop("source", "s")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of docs (doc_id, text, source).

    Null and blank texts have size 0 and none is taken. A null source is a source of its own, the last in
    order; a source without words has target 0. No document is taken more than twice over. Rows that repeat
    doc_id, text and source are placed one after the other and share the mean of what the mix takes of
    them. An empty table gives an empty result. Reruns agree: every draw is a hash of ids.
    """
    sized = _measured(docs)
    plan = plan_of(sized)
    sized = _numbered(sized, plan)
    taken = _pieces(sized, plan).groupBy("doc_id", "key", "sid").agg(
        F.sum(F.col("hi") - F.col("lo")).alias("words")).select(
        F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("sid").alias("s"), "words")
    same = sized.groupBy("doc_id", "key", "sid", "size").agg(F.count("*").alias("rows"))
    same = same.join(taken.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))
                     & (F.col("sid") == F.col("s")), "left").drop("s")
    return same.join(plan.select("sid", "source_size", "target"), "sid").select(
        "doc_id", "size", "source_size", "target",
        F.floor(F.coalesce("words", F.lit(0)) / F.col("rows")).alias("taken"),
        F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy")).drop("copy")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mixture as documents, in the columns of docs: a row for each pass over a document's words.

    A pass that takes every word keeps the text as it is; one that takes part of them has those words,
    joined by single spaces, and n_chars, if there is such a column, is their length. Rows that repeat
    doc_id, text and source count once. Texts without words are in no block, and an empty table gives none.
    """
    names = docs.columns
    sized = _measured(docs.dropDuplicates(["doc_id", "text", "source"]))
    plan = plan_of(sized)
    got = _pieces(_numbered(sized, plan), plan).groupBy("doc_id", "key", "sid", "pass").agg(
        F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("parts")).join(plan.select("sid", "source"), "sid").select(
        F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("source").alias("s"), "parts")
    row = docs.dropDuplicates(["doc_id", "text", "source"]).select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        text_key(F.col("text")).alias("key"), F.col("source").cast("string").alias("source"))
    both = row.join(got, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))
                    & F.col("source").eqNullSafe(F.col("s"))).select(
        "row", "parts", words_of(F.col("row.text")).alias("words"))
    part = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(
        F.col("words"), (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")))), " ")
    whole = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["hi"] - p["lo"]) == F.size("words")
    both = both.withColumn("new", F.when(whole, F.col("row.text")).otherwise(part))
    swap = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    return both.select(*[swap[c].alias(c) if c in swap else F.col(f"row.`{c}`").alias(c) for c in names])
