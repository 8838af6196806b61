"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

STEPS is a fixed sequence of rules with cutoffs, each of which rejects what it finds beyond its cutoff in addition
to all steps before it. Labelled holdouts decide, per stratum, how many steps are taken: a step is certified
if the exact binomial tail P(Bin(n, RISK) <= k), for k of n good documents rejected by it or by any step
before it, is at most ERROR over the number of strata, and so were all steps before it. Testing in a fixed
sequence needs no further correction within a stratum, and Bonferroni's corrects for the strata: with
probability 1 - ERROR no stratum loses more than RISK of its good documents to all rules together. A
stratum with too few labels certifies no step and rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, materialize, text_key, words_of

_SYMBOLS, _LINES, _REPEATS, _LENGTH = ("n_symbols / n_words", "n_dup_lines / n_lines", "n_repeat_words / n_words",
                                       "word_chars / n_words")
#: (measure, sign, cutoff) in the order of testing: rejected if sign * measure > sign * cutoff.
STEPS = (
    (_SYMBOLS, 1, 0.5), (_LENGTH, -1, 2.0), (_LENGTH, 1, 15.0), (_LINES, 1, 0.5), (_REPEATS, 1, 0.15),
    (_SYMBOLS, 1, 0.3), (_LENGTH, -1, 2.5), (_LENGTH, 1, 12.0), (_SYMBOLS, 1, 0.2), (_LINES, 1, 0.4),
    (_SYMBOLS, 1, 0.1), (_REPEATS, 1, 0.1), (_LENGTH, -1, 3.0), (_LENGTH, 1, 10.0), (_LINES, 1, 0.3),
)
#: False rejections allowed in each stratum by all rules together, and the chance that any bound fails.
RISK, ERROR = 0.02, 0.05


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """docs' columns `keep` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    A null text has no words. n_repeat_words counts the words in five-word windows that occur twice or more in
    the text: the windows' hashes are sorted with their positions, so a text costs n log n, however
    repetitive it is.
    """
    x = docs.select(*keep, F.coalesce("text", F.lit("")).alias("t"))
    x = x.select(*keep, words_of(F.col("t")).alias("w"),
                 (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
                 F.filter(F.split("t", "\n"), lambda s: F.btrim(s, F.lit(SPACE_CHARS)) != "").alias("lines"))
    x = x.select(*keep, "n_symbols", F.size("w").cast("long").alias("n_words"),
                 F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                 F.size("lines").cast("long").alias("n_lines"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.transform("w", lambda s: F.xxhash64(s)).alias("h"))
    x = x.withColumn("v", F.expr(
        "if(size(h) < 5, array(), transform(sequence(0, size(h) - 5),"
        " i -> xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4])))")).drop("h")
    x = x.withColumn("v", F.expr("if(size(array_distinct(v)) = size(v), array(), v)"))
    # Sorted by hash, equal windows stand together; their positions follow in order.
    x = x.withColumn("v", F.expr("sort_array(transform(v, (h, i) -> struct(h, i)))"))
    x = x.withColumn("v", F.expr(
        "sort_array(transform(filter(transform(v, (p, j) -> struct(p, j)), s ->"
        " (s.j > 0 and v[greatest(s.j - 1, 0)].h = s.p.h)"
        " or (s.j < size(v) - 1 and v[least(s.j + 1, size(v) - 1)].h = s.p.h)), s -> cast(s.p.i as long)))"))
    return x.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.expr(
        "aggregate(v, named_struct('n', 0L, 'e', 0L), (a, p) -> named_struct("
        "'n', a.n + p + 5 - greatest(a.e, p), 'e', p + 5), a -> a.n)").alias("n_repeat_words"))


def base_failed():
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def _measure(text: str):
    top, bottom = text.split(" / ")
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def tail(n: str, k: str, p: float) -> str:
    """SQL for P(Bin(n, p) <= k) where k <= n p, and 1 elsewhere: the terms summed in logarithms."""
    return (f"if({k} > {n} * {p}D, 1D, aggregate(sequence(1L, greatest({k}, 1L)),"
            f" named_struct('l', {n} * ln(1 - {p}D), 's', exp({n} * ln(1 - {p}D))), (a, i) -> if(i > {k}, a, named_struct("
            f"'l', a.l + ln(({n} - i + 1) / i) + ln({p}D / (1 - {p}D)),"
            f" 's', a.s + exp(a.l + ln(({n} - i + 1) / i) + ln({p}D / (1 - {p}D))))), a -> a.s))")


def level():
    """The first step that rejects a document, counted from 1; null where none does."""
    return F.coalesce(*[F.when(_measure(m) * sign > c * sign, F.lit(j)) for j, (m, sign, c) in enumerate(STEPS, 1)])


def certified(holdout: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, n, steps): documents of the holdout and how many steps they certify.

    holdout: stratum and level of documents labelled good that pass the base rules. It is summed to one row
    a stratum before anything else.
    """
    steps = range(1, len(STEPS) + 1)
    sums = materialize(holdout.groupBy("stratum").agg(F.count("*").alias("n"), *[
        F.count_if(F.col("level") <= j).alias(f"k{j}") for j in steps]), "holdout")
    limit = error / max(sums.count(), 1)
    # k rises with the steps, and so does the tail: the last step within the limit has all before it within.
    passed = [F.when(F.expr(tail("n", f"k{j}", risk)) <= limit, j).otherwise(0) for j in steps]
    return sums.select("stratum", "n", F.greatest(*passed).alias("steps"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) per row of docs.

    labels (doc_id, quality): documents of quality 1 are the holdout of their stratum, a column of docs; null
    strata form one. Documents with several labels count for each. Without labels only the base rules
    reject. Rows that repeat a doc_id are judged one by one. An empty table gives an empty result.
    """
    x = materialize(measures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                                         F.coalesce(F.col(stratum).cast("string"), F.lit("?")).alias("stratum")),
                             "doc_id", "stratum").withColumn("base_failed", base_failed()).withColumn("level", level()), "measures")
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    steps = materialize(certified(x.where("not base_failed").join(good, "doc_id"), risk, error), "steps")
    x = x.join(steps, "stratum", "left")
    rejected = F.coalesce(F.col("level") <= F.col("steps"), F.lit(False))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~(F.col("base_failed") | rejected)).alias("kept"))
