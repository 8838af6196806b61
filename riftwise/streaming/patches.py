"""Patches that arrive in a folder, compiled as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riftwise.sources.text import compile_patch, split_lines


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, files_a_batch: int = 1000,
          available_now: bool = False) -> StreamingQuery:
    """Compile each patch file once it is in folder; hunks go to out, one folder for each batch.

    A batch is written anew if it is run again, so that a restart from the checkpoint leaves no row twice. Files
    must appear whole, by a rename.
    """
    texts = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_a_batch).load(
        folder).select(F.col("_metadata.file_path").alias("file"), "value")

    def write(batch: DataFrame, n: int) -> None:
        compile_patch(split_lines(batch)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream = texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()
