"""Streams: new objects and commits as they are appended to a table, and late-tolerant counts over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.operators.objects import commit_headers


def commit_stream(objects: DataFrame) -> DataFrame:
    """A stream of objects -> a stream of commits with their time; each (repo_id, oid) once within the watermark."""
    rows = commit_headers(objects).filter("error is null").withColumn("at", F.timestamp_seconds("committer_time"))
    return rows.withWatermark("at", "1 day").dropDuplicatesWithinWatermark(["repo_id", "oid"])


def commits_per_window(commits: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """(repo_id, start, n_commits) in tumbling windows of commit time; rows later than the delay are dropped."""
    counted = commits.withWatermark("at", delay).groupBy("repo_id", F.window("at", window).alias("w")).agg(F.count(F.lit(1)).alias("n_commits"))
    return counted.select("repo_id", F.col("w.start").alias("start"), "n_commits")
