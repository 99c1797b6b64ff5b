"""Search over files as they arrive: the batch search's predicate inside Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EngineError


def arriving_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of files that appear in a folder: value, path. Records are not numbered across files."""
    return spark.readStream.option("lineSep", "\n").text(folder).select(F.regexp_replace("value", r"\r$", "").alias("value"), F.col("_metadata.file_path").alias("path"))


def matching(lines: DataFrame, needle: str) -> DataFrame:
    """Lines that hold the needle; stateless, so it works on batches and streams alike."""
    if not needle:
        raise EngineError("usage", "an empty search string matches everything", "空的搜尋字串會符合一切")
    return lines.where(F.contains("value", F.lit(needle)))
