"""URL filtering by rules and a tree of path templates, in DataFrame operations only.

Segments of a path that hold digits become wildcards, and pages are counted by host and path at once, so
everything after that works on distinct paths. Each host's tree is generalised level by level from the root, and
the children of branches that became one wildcard are pooled before the next level is judged. Of a node's
children, those with few pages beside many siblings are taken for values of a variable, and those whose
labelled share of bad pages a two-proportion test cannot tell from their siblings' for similar branches; both
join the node's wildcard. A child with too few labels for a test stays as it is unless it is such a value. A
template is rejected if its share of bad pages, smoothed towards its host's and the host's towards all, is
above a half.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rules (verdict, host and path); the longest that fits wins. A list that is part of the plan, so keep it short.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Levels of a tree; the rest of a longer path is one segment.
DEPTH = 8
#: A child with fewer than THIN pages, of a node with more children than FANOUT, is a value of a variable.
FANOUT, THIN = 20, 5
#: Labels that a child and its siblings need each, and the standard normal quantile of the test (5 %, two-sided).
LEAST, Z = 5, 1.96
#: Weight of the smoothing, and purity of a rejected template.
STRENGTH, PURITY = 4.0, 0.5


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1),
                       string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits: its host is the URL's or a domain above it, its path starts the URL's."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def lexical(path: Column) -> Column:
    """Segments of a path, DEPTH at most, those with digits generalised; a file's ending stays."""
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/", DEPTH), lambda s: F.when(
        s.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z]+)$", 1))).otherwise(s))


def generalised(kids: DataFrame) -> DataFrame:
    """(host, branch, seg): the children that join their node's wildcard, of kids (host, branch, seg, pages, n, bad)."""
    sums = kids.groupBy("host", "branch").agg(
        F.count("*").alias("kids"), F.sum("n").alias("all"), F.sum("bad").alias("worse")).where("kids > 1")
    x = kids.join(sums, ["host", "branch"]).withColumns({"rest": F.col("all") - F.col("n"), "p": F.col("worse") / F.col("all")})
    gap = F.col("bad") / F.col("n") - (F.col("worse") - F.col("bad")) / F.col("rest")
    tested = (F.col("n") >= LEAST) & (F.col("rest") >= LEAST)
    like = gap * gap <= F.col("p") * (1 - F.col("p")) * (F.lit(1.0) / F.col("n") + F.lit(1.0) / F.col("rest")) * (Z * Z)
    thin = (F.col("kids") > FANOUT) & (F.col("pages") < THIN)
    return x.where(thin | F.when(tested, like).otherwise(False)).select("host", "branch", "seg", F.lit(True).alias("any"))


def template_tree(counts: DataFrame) -> DataFrame:
    """(host, segs, template, bad_share) for counts (host, segs, pages, n, bad) of distinct paths.

    A level takes one aggregation and a join of distinct paths, and its result is written out.
    """
    deepest = counts.agg(F.max(F.size("segs"))).first()[0] or 0
    x = counts.withColumn("branch", F.array().cast("array<string>"))
    for d in range(deepest):  # DEPTH times at most
        at = x.withColumn("seg", F.get("segs", F.lit(d)))
        kids = at.where("seg is not null").groupBy("host", "branch", "seg").agg(*[F.sum(c).alias(c) for c in ("pages", "n", "bad")])
        named = at.join(generalised(kids), ["host", "branch", "seg"], "left")
        step = F.when(F.col("any"), "*").otherwise(F.col("seg"))
        x = materialize(named.select("host", "segs", "pages", "n", "bad", F.when(
            F.col("seg").isNull(), F.col("branch")).otherwise(F.array_append("branch", step)).alias("branch")), "level")
    x = x.withColumn("template", F.array_join("branch", "/"))
    total = x.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    base = (total["bad"] or 0) / max(total["n"] or 0, 1)
    hosts = x.groupBy("host").agg(
        ((F.sum("bad") + F.lit(base * STRENGTH)) / (F.sum("n") + F.lit(STRENGTH))).alias("host_share"))
    shares = x.groupBy("host", "template").agg(F.sum("n").alias("tn"), F.sum("bad").alias("tb")).join(hosts, "host")
    shares = shares.select("host", "template", (
        (F.col("tb") + F.col("host_share") * STRENGTH) / (F.col("tn") + F.lit(STRENGTH))).alias("bad_share"))
    return x.select("host", "segs", "template").join(shares, ["host", "template"])


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, bad_share) per row of pages (page_id, url).

    labels (doc_id, quality, toxic) rate the page whose page_id is doc_id; poor or toxic is bad. Several
    labels of a page count as one, bad if any is. Null urls, and those without ://, have empty host and
    path. Without labels, what no rule blocks is allowed. Rows that repeat a page_id are judged one by one.
    An empty table gives an empty result.
    """
    x = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"),
                     path_of(F.col("url")).alias("path"))
    x = x.withColumn("segs", lexical(F.col("path")))
    rated = labels.where("doc_id is not null and quality is not null").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("bad"))
    counts = x.join(rated, F.col("page_id") == F.col("doc_id"), "left").groupBy("host", "segs").agg(
        F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = materialize(template_tree(materialize(counts, "templates")), "tree")
    x = x.join(tree, ["host", "segs"]).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.create_map(*[F.lit(v) for verdict, rule in rules for v in (rule, verdict)])
    verdict = F.when(F.col("rule").isNotNull(), F.element_at(by_rule, F.col("rule"))).otherwise(
        F.when(F.col("bad_share") > PURITY, "block").otherwise("allow"))
    return x.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "bad_share")
