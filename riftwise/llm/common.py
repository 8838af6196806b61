"""Helpers shared by the training-data operators.

Every operator first selects the columns that it needs, so further columns of any name in its input
do no harm. Intermediate tables go to the folder in ``spark.checkpoint.dir``, which driver and
executors share; a lost executor then costs a re-read, not a recomputation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riftwise.sources.shared import materialize, remove, shared_dir, shared_path, written  # noqa: F401

#: Words are maximal runs of characters outside this class.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def text_key(text: Column) -> Column:
    """A 64-bit hash of a text, by which rows that repeat a doc_id are told apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
