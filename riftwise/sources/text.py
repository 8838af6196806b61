"""Readers of patches, their compact form and profiles, all from the text source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riftwise.functions.paths import issource

#: The line that starts a hunk of a unified diff (fixed format).
MARK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
KINDS = ("SYSCALL", "LOCKCALL", "EXPCALL", "FREQCALL")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line): files are read whole, so that lines keep their order; carriage returns go."""
    return split_lines(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))


def split_lines(texts: DataFrame) -> DataFrame:
    """(file, pos, line) of whole texts (file, value)."""
    return texts.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("pos", "line"))


def _w(*keys):
    return W.partitionBy(*keys).orderBy("pos")


def _counts():
    """Numbers in the mark of a hunk: old line and count, new line and count."""
    num = lambda g: F.regexp_extract("line", MARK, g)
    count = lambda g: F.when(num(g) == "", "1").otherwise(num(g)).cast("int")
    return num(1).cast("int"), count(2), num(3).cast("int"), count(4)


def _in_hunks(lines: DataFrame) -> DataFrame:
    """lines with old_left and new_left: old and new lines that the hunk around each line still calls for, 0 outside."""
    is_mark = F.col("line").rlike(MARK)
    _, old, _, new = _counts()
    x = lines.withColumn("_h", F.sum(is_mark.cast("int")).over(_w("file")))
    of = W.partitionBy("file", "_h")
    before = _w("file", "_h").rowsBetween(W.unboundedPreceding, -1)
    sign = F.substring("line", 1, 1)
    used = lambda *signs: F.coalesce(F.sum(F.when(~is_mark & sign.isin(*signs), 1).otherwise(0)).over(before), F.lit(0))
    left = lambda n, *signs: F.when((F.col("_h") > 0) & ~is_mark, F.max(F.when(is_mark, n)).over(of) - used(*signs)).otherwise(0)
    return x.select("file", "pos", "line", left(old, " ", "", "-").alias("old_left"), left(new, " ", "", "+").alias("new_left"))


def compile_patch(lines: DataFrame) -> DataFrame:
    """Hunks of unified diffs: (file, chapter, name, status, hunk, start_line, rep_start_line, ctrlseq).

    status is source, non-source, created or deleted; a chapter's is that of its first hunk. Consecutive lines
    of context are ~, added ones +, deleted ones -. Text before the first header of a file is passed over. Lines
    that the counts of a hunk still call for are none of a header, whatever they look like; but where a new
    hunk follows before the counts are used up, the hunk was cut off, and the header counts.
    """
    w = _w("file")
    x = _in_hunks(lines)
    pair = F.col("line").rlike(r"^--- ") & F.lead("line").over(w).rlike(r"^\+\+\+ ")
    cut_off = F.lead("line", 2).over(w).rlike(MARK) & ~((F.col("old_left") == 1) & (F.col("new_left") == 1))
    head = pair & (((F.col("old_left") <= 0) & (F.col("new_left") <= 0)) | F.coalesce(cut_off, F.lit(False)))
    x = x.withColumn("chapter", F.coalesce(head.cast("int"), F.lit(0))).drop("old_left", "new_left")
    x = x.withColumn("chapter", F.sum("chapter").over(w)).where("chapter > 0")
    stamp = r"([^\t]+?)(?:\t.*|\s+\d{4,}-\d\d-\d\d.*)?$"  # a timestamp follows a tab, or spaces
    by = W.partitionBy("file", "chapter")
    # The first two lines of a chapter are its header.
    x = x.withColumn("nth", F.row_number().over(_w("file", "chapter")))
    named = lambda n, sign: F.first(F.when(F.col("nth") == n, F.regexp_extract("line", sign + stamp, 1)), True).over(by)
    x = x.withColumn("name", named(2, r"^\+\+\+ ")).withColumn("old", named(1, "^--- ")).where("nth > 2")
    x = x.withColumn("name", F.when(F.col("name") == "/dev/null", F.col("old")).otherwise(F.col("name")))
    mark = MARK
    x = x.withColumn("hunk", F.sum(F.col("line").rlike(mark).cast("int")).over(_w("file", "chapter"))).where("hunk > 0")
    heads = x.where(F.col("line").rlike(mark)).select(
        "file", "chapter", "hunk", "name", *[n.alias(c) for n, c in zip(_counts(), "abcd")])
    body = x.where(~F.col("line").rlike(mark)).join(heads.drop("name"), ["file", "chapter", "hunk"])
    ch = F.when(F.col("line").startswith("+"), "+").when(F.col("line").startswith("-"), "-").when(
        F.col("line").startswith(" ") | (F.col("line") == ""), "~")
    # A hunk ends when its line counts are used up; what follows belongs to no hunk.
    hw = _w("file", "chapter", "hunk").rowsBetween(W.unboundedPreceding, -1)
    body = body.withColumn("ch", ch).where("ch is not null")
    used = lambda skip: F.coalesce(F.sum((F.col("ch") != skip).cast("int")).over(hw), F.lit(0))
    body = body.withColumn("u", used("+")).withColumn("v", used("-")).where(
        ((F.col("ch") != "+") & (F.col("u") < F.col("b"))) | ((F.col("ch") == "+") & (F.col("v") < F.col("d"))))
    seqs = body.groupBy("file", "chapter", "hunk").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda s: s["ch"]), "").alias("ctrlseq"))
    heads = heads.withColumn("f", F.min_by(F.struct("a", "b", "c", "d"), "hunk").over(by))
    status = (F.when((F.col("f.a") == 0) & (F.col("f.b") == 0), "created")
              .when((F.col("f.c") == 0) & (F.col("f.d") == 0), "deleted")
              .when(~issource(F.col("name")), "non-source").otherwise("source"))
    zero = lambda line, n: F.col(line) + (F.col(n) == 0).cast("int")
    # Context that a cut-off hunk lacks at its end, on both sides alike, was blank lines.
    size = lambda skip: F.length(F.translate("ctrlseq", skip, ""))
    lacks = F.least(F.col("b") - size("+"), F.col("d") - size("-"))
    seqs = seqs.join(heads, ["file", "chapter", "hunk"]).select(
        "file", "chapter", "hunk", F.concat("ctrlseq", F.repeat(F.lit("~"), F.greatest(lacks, F.lit(0)))).alias("ctrlseq"))
    return heads.join(seqs, ["file", "chapter", "hunk"]).select(
        "file", "chapter", "name", status.alias("status"), "hunk", zero("a", "b").alias("start_line"),
        zero("c", "d").alias("rep_start_line"), "ctrlseq")


def run_counters(hunks: DataFrame) -> DataFrame:
    """One row: chapters in all and by status."""
    c = hunks.select("file", "chapter", "status").distinct()
    return c.agg(F.count("*").alias("total"), *[
        F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in ("non-source", "deleted", "created")])


def read_id(lines: DataFrame) -> DataFrame:
    """Hunks of compact patches: (file, patchname, chapter, name, hunk, start_line, rep_start_line, ctrlseq)."""
    w = _w("file")
    before = F.lag("line").over(w)
    x = lines.withColumn("tag", F.when(before == "****", "patch").when(before == "====", "chapter").when(
        before.rlike(r"^####\d+,\d+$"), "hunk")).withColumn("head", before)
    x = x.withColumn("patchname", F.last(F.when(F.col("tag") == "patch", F.col("line")), True).over(w))
    x = x.withColumn("chapter", F.sum((F.coalesce("tag", F.lit("")) == "chapter").cast("int")).over(w))
    x = x.withColumn("name", F.last(F.when(F.col("tag") == "chapter", F.col("line")), True).over(w))
    x = x.where("tag = 'hunk'").withColumn("hunk", F.row_number().over(W.partitionBy("file", "chapter").orderBy("pos")))
    num = lambda g: F.regexp_extract("head", r"^####(\d+),(\d+)$", g).cast("int")
    return x.select("file", "patchname", "chapter", "name", "hunk", num(1).alias("start_line"),
                    num(2).alias("rep_start_line"), F.col("line").alias("ctrlseq"))


def write_id(hunks: DataFrame, path: str) -> None:
    """Hunks of sources in compact form, a file for each task; a patch's chapters stay together."""
    text = F.concat(F.lit("####"), F.col("start_line"), F.lit(","), F.col("rep_start_line"), F.lit("\n"), F.col("ctrlseq"))
    chapters = hunks.where("status = 'source'").groupBy("file", "chapter", "name").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("hunk", text.alias("t")))), lambda s: s["t"]), "\n").alias("t"))
    one = F.concat(F.lit("====\n"), F.col("name"), F.lit("\n"), F.col("t"))
    patches = chapters.groupBy("file").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("chapter", one.alias("t")))), lambda s: s["t"]), "\n").alias("t"))
    patches.select(F.concat(F.lit("****\n"), F.substring_index("file", "/", -1), F.lit("\n"), F.col("t")).alias("value")).write.text(path)


def log_lines(hunks: DataFrame) -> DataFrame:
    """(file, value): a text for each patch that names what was created (+), deleted (-) or no source ($), and counts."""
    chapters = hunks.groupBy("file", "chapter").agg(F.first("name").alias("name"), F.first("status").alias("status"))
    sign = F.when(F.col("status") == "created", "+ ").when(F.col("status") == "deleted", "- ").when(
        F.col("status") == "non-source", "$ ")
    named = F.when(sign.isNotNull(), F.struct("chapter", F.concat(sign, "name").alias("line")))
    count = lambda s: F.count_if(F.col("status") == s).cast("string")
    counts = F.concat(F.lit("Scanned total: "), F.count("*").cast("string"), F.lit("; Non-source: "), count("non-source"),
                      F.lit("; Delete: "), count("deleted"), F.lit("; Create: "), count("created"))
    return chapters.groupBy("file").agg(F.array_sort(F.collect_list(named)).alias("lines"), counts.alias("counts")).select(
        "file", F.array_join(F.concat("lines.line", F.array("counts")), "\n").alias("value"))


def source_lines(hunks: DataFrame) -> DataFrame:
    """(file, value): the source files of each patch in order, a line each, created ones included."""
    chapters = hunks.where((F.col("status") == "source") | ((F.col("status") == "created") & issource(F.col("name")))).groupBy(
        "file", "chapter").agg(F.first("name").alias("name"))
    return chapters.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("chapter", "name"))).alias("all")).select(
        "file", F.array_join("all.name", "\n").alias("value"))


def write_texts(texts: DataFrame, path: str) -> None:
    """Texts (value) to a folder of text files, as tasks hold them."""
    texts.select("value").write.text(path)


def profile_lines(profile: DataFrame, top: int | None = 50, detail: bool = False) -> DataFrame:
    """(value): a static profile (func, cost, sites) as a text that read_profile reads.

    EXPCALL lists the `top` functions of the highest cost, FREQCALL those of the most call sites, ties by name; all
    of them without top. detail appends the figures, for people to read.
    """
    def segment(kind: str, n: str) -> DataFrame:
        rows = profile.orderBy(F.desc(n), "func").limit(top) if top and top > 0 else profile
        name = F.concat("func", F.lit(": "), n) if detail else F.col("func")
        listed = F.array_sort(F.collect_list(F.struct((-F.col(n)).alias("n"), "func", name.alias("line"))))
        return rows.agg(F.array_join(F.concat(F.array(F.lit("===="), F.lit(kind), F.lit("====")), listed["line"]), "\n").alias("value"))

    return segment("EXPCALL", "cost").unionByName(segment("FREQCALL", "sites"))


def read_profile(lines: DataFrame) -> DataFrame:
    """(file, segment, func) from segments headed by ====, a kind and ====; an unknown kind is an error."""
    w = _w("file")
    bar = F.col("line") == "===="
    # Bars open and close the heads in turn.
    x = lines.where(F.btrim("line") != "").withColumn("bars", F.sum(bar.cast("int")).over(w))
    x = x.withColumn("kind", F.when((F.col("bars") % 2 == 1) & ~bar, F.col("line")))
    x = x.withColumn("kind", F.when(F.col("kind").isNull() | F.col("kind").isin(*KINDS), F.col("kind")).otherwise(
        F.raise_error(F.concat(F.lit("unknown segment "), F.col("kind"))).cast("string")))
    x = x.withColumn("segment", F.last("kind", True).over(w)).where(~bar & F.col("kind").isNull())
    return x.select("file", "segment", F.col("line").alias("func"))


def read_list(lines: DataFrame) -> DataFrame:
    """Sorted lines that are not blank."""
    return lines.where(F.btrim("line") != "").select("line").orderBy("line")
