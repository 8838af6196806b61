"""Path and name functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of source files, of files left out, and of files that compile to an object (fixed values).
SOURCE = ("c", "h", "cc", "cpp", "C", "hpp", "cs")
IGNORED = ("hpp", "cs")
COMPILED = ("c", "cc", "cpp", "C", "hpp")
#: Files known by another name in the modules (fixed values).
RENAMED = {"src/backend/port/sysv_shmem.c": "src/backend/port/pg_shmem.c"}


def canonpath(path: Column) -> Column:
    """Lexically normal path. Null for null, empty and what climbs above a relative start; the root is its own parent."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    rooted = path.startswith("/")
    # A null element marks a climb above the start of a relative path.
    stack = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(
        x != "..", F.concat(acc, F.array(x))).when(
        F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(
        rooted, acc).otherwise(F.array(F.lit(None).cast("string"))))
    bad = F.exists(stack, lambda x: x.isNull())
    return F.when(path.isNull() | (path == ""), None).when(~bad, F.concat(
        F.when(rooted, "/").otherwise(""), F.array_join(stack, "/")))


def stripname(path: Column, strips: int) -> Column:
    """Without `strips` leading components: all as it is for 0, the base name below 0. A leading slash counts as one."""
    if strips == 0:
        return path
    if strips < 0:
        return F.substring_index(path, "/", -1)
    has = F.regexp_count(path, F.lit("/+"))
    cut = F.regexp_replace(path, rf"^(?:[^/]*/+){{1,{strips}}}", "")
    return F.when(has == 0, path).otherwise(cut)


def path_equal(a: Column, b: Column, strips: int) -> Column:
    return stripname(canonpath(a), strips) == b


def paths_equal(a: Column, b: Column, strips_a: int, strips_b: int) -> Column:
    return stripname(canonpath(a), strips_a) == stripname(canonpath(b), strips_b)


def pendswith(path: Column, ending: Column) -> Column:
    """Whether ending ends path at a component's start."""
    before = F.substring(path, F.length(path) - F.length(ending), F.lit(1))
    return path.endswith(ending) & ((F.length(path) == F.length(ending)) | ending.startswith("/") | (before == "/"))


def _suffix(name: Column, endings) -> Column:
    return name.rlike(r"\.(" + "|".join(endings) + ")$")


def issource(name: Column) -> Column:
    return _suffix(name, SOURCE)


def ignored(name: Column) -> Column:
    return _suffix(name, IGNORED)


def src2obj(name: Column) -> Column:
    """Name of the object file; null where none is compiled."""
    return F.when(_suffix(name, COMPILED), F.regexp_replace(name, r"\.[^.]*$", ".o"))


def strnchr(text: Column, n: int, c: str) -> Column:
    """Position (from 1) of the first c in the first n characters; 0 if there is none."""
    return F.instr(F.substring(text, 1, n), c)


def lastof(text: Column, c: str) -> Column:
    """Position (from 1) of the last c; 0 if there is none."""
    at = F.instr(F.reverse(text), c)
    return F.when(at == 0, 0).otherwise(F.length(text) - at + 1)


def countchr(text: Column, c: str, n: int = 0) -> Column:
    """Occurrences of c in the first n characters, in all for 0 and -1."""
    part = text if n in (0, -1) else F.substring(text, 1, n)
    return F.length(part) - F.length(F.replace(part, F.lit(c), F.lit("")))


def common_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: a.substr(F.lit(1), i) == b.substr(F.lit(1), i))
    return a.substr(F.lit(1), F.array_max(same))


def isempty(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def parse_int(text: Column) -> Column:
    """Digits up to a comma or the end; null for anything else and on overflow."""
    return F.try_to_number(F.regexp_extract(text, r"^(\d{1,18})(?:,|$)", 1), F.lit("9" * 18)).cast("long")


def prefix_components(path: Column) -> Column:
    """Number of directories; a leading slash is not counted."""
    return F.regexp_count(path, F.lit("(?<=[^/])/+"))


def squeeze(text: Column) -> Column:
    """For comparing lines whatever their white space."""
    return F.btrim(F.regexp_replace(text, r"[ \t]+", " "))


def renamed(path: Column) -> Column:
    """The name by which modules know a file."""
    out = path
    for old, new in RENAMED.items():
        out = F.when(path == old, new).otherwise(out)
    return out


def count_strips(root: Column) -> Column:
    """Leading components of absolute paths under root, the common prefix of all directories.

    A root that is a known subdirectory of its project counts as the project's own.
    """
    n = countchr(root, "/") + (~root.endswith("/")).cast("int")
    return n - F.when(root.endswith("innodb_plugin"), 2).when(root.endswith("src/"), 1).otherwise(0)


def best_name(names: Column) -> Column:
    """Of an array of names the one with the fewest directories, then the shortest base name, then the shortest.

    The first of those that tie; nulls are passed over, and without any name it is null.
    """
    ranked = F.transform(names, lambda x, i: F.struct(
        prefix_components(x).alias("n"), F.length(stripname(x, -1)).alias("base"), F.length(x).alias("length"),
        i.alias("i"), x.alias("name")))
    return F.array_min(F.filter(ranked, lambda s: s["name"].isNotNull()))["name"]


def ed_command(line: Column) -> Column:
    """Letter of an ed command (a, c, d, i or s/.//), null for other lines. a and i take one line number."""
    letter = F.regexp_extract(line, r"^(?:(?:\d+)?([ai])|(?:\d+(?:,\d+)?)?(?:([cd])|(s)/\.//))[ \t]*$", 0)
    return F.nullif(F.regexp_extract(letter, "[a-z]", 0), F.lit(""))


def _offset(stamp: Column) -> Column:
    """A header's time with at most six decimals and its offset as +hh:mm, right after the seconds."""
    text = F.regexp_replace(F.btrim(stamp), r"(\.\d{6})\d+", "$1")
    return F.regexp_replace(text, r" ?([-+]\d\d)(\d\d)$", "$1:$2")


def patch_time(stamp: Column) -> Column:
    """Time of a file in a patch's header, by its own offset or as UTC; null if it cannot be read."""
    text = _offset(stamp)
    return F.try_to_timestamp(F.when(text.rlike(r"[-+]\d\d:\d\d$"), text).otherwise(F.concat(text, F.lit("Z"))))


def is_epoch(stamp: Column) -> Column:
    """Whether a header's time stands for a file that does not exist: the epoch, up to 51 hours later.

    A time without an offset counts as one 25 hours west, so that the epoch of every zone is in the range.
    """
    local = F.when(_offset(stamp).rlike(r"[-+]\d\d:\d\d$"), 0).otherwise(25 * 3600)
    return F.coalesce((F.unix_timestamp(patch_time(stamp)) + local).between(0, 51 * 3600 - 1), F.lit(False))
