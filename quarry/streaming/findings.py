"""An extension: findings of source files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import findings


def arriving_files(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """path, content, modified of files that appear below a folder, at most so many a trigger."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files).load(folder)
    return raw.select("path", F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"))


def finding_stream(files: DataFrame, late: str = "1 hour", rules: tuple[findings.Rule, ...] = findings.RULES) -> DataFrame:
    """Each finding once within the watermark: path, modified, rule, type, severity, line, column."""
    found = findings.match_rules(files, rules, keep=("path", "modified"))
    rows = found.select("path", "modified", "rule", "type", "severity", "line", "column")
    return rows.withWatermark("modified", late).dropDuplicatesWithinWatermark(["path", "rule", "line", "column"])


def severity_windows(stream: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by severity in tumbling windows of arrival; expects findings with a watermark or adds one."""
    return stream.withWatermark("modified", late).groupBy(F.window("modified", width), "severity").agg(F.count(F.lit(1)).alias("n"))
