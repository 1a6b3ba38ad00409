"""Committed positions of consumer groups.

Commits are a changelog: ``seq`` is the order in which the broker took them, a null ``next_offset`` forgets the position, a negative one is
refused. The position is always the next offset to read. Written twice, a commit counts once. The fold is an aggregate that is
combined before its shuffle, so a group with most commits doesn't weigh on one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.common import chunked_lag
from tidelog.operators.log import TP

GTP = ["group_id", *TP]


def replay(commits: DataFrame) -> DataFrame:
    """Present positions: the last commit of each group and partition, without those that were forgotten."""
    taken = commits.where("next_offset is null or next_offset >= 0")
    last = taken.groupBy(*GTP).agg(F.max(F.struct("seq", "next_offset", "metadata", "commit_ts_ms")).alias("c"))
    return last.select(*GTP, "c.*").where("next_offset is not null")


def forgotten(commits: DataFrame) -> DataFrame:
    """Positions whose last word is to forget them."""
    taken = commits.where("next_offset is null or next_offset >= 0")
    return taken.groupBy(*GTP).agg(F.max(F.struct("seq", "next_offset")).alias("c")).where("c.next_offset is null").select(*GTP, F.col("c.seq").alias("seq"))


def fetch_positions(requests: DataFrame, positions: DataFrame) -> DataFrame:
    """The position for each request (group, topic, partition), -1 where none was committed (0 is a position)."""
    return requests.join(positions.select(*GTP, "next_offset"), GTP, "left").withColumn("next_offset", F.coalesce("next_offset", F.lit(-1)))


def fenced(commits: DataFrame, generations: DataFrame) -> DataFrame:
    """Commits with error codes: those of a member must carry the present generation (group_id, generation) of their group; a standalone
    consumer (negative generation) needs none; a group that isn't known has no members."""
    joined = commits.join(generations.withColumnRenamed("generation", "__now"), "group_id", "left")
    code = F.when(F.col("generation") < 0, 0).when(F.col("__now").isNull(), 13).when(F.col("generation") != F.col("__now"), 12).when(F.col("next_offset") < 0, 1).otherwise(0)
    return joined.withColumn("error", code).drop("__now")


def lag(positions: DataFrame, log_bounds: DataFrame) -> DataFrame:
    """Records between the position and the log end; a position beyond the end or below the start is clipped."""
    joined = positions.join(log_bounds, TP)
    at = F.least(F.greatest("next_offset", "log_start"), "log_end")
    return joined.select(*GTP, "next_offset", "log_end", (F.col("log_end") - at).alias("lag"))


def went_back(commits: DataFrame) -> DataFrame:
    """Commits that set a position below the one before them."""
    taken = commits.where("next_offset >= 0").dropDuplicates(["seq"])
    return chunked_lag(taken, GTP, "seq", F.col("next_offset"), "before").where("next_offset < before").select("seq", *GTP, "next_offset", "before")
