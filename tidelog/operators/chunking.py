"""Per-key results when a few keys hold most rows: exact offset chunking.

Rows lie in *blocks*, the input partitions of this operator: ``BLOCK_OFFSETS`` successive offsets of one log partition
(being a rule on the data, a retried task finds the same blocks). Rows are counted per key and block, a prefix sum over the blocks of a
key gives each block its first row number, and rows are numbered from there. Each key is then cut into chunks of
``CHUNK_ROWS`` rows; chunks are processed alone, whichever task they fall to, and their states, which hold what a
neighbour needs to know (first and last row), are merged in order.

Scale: no task gets more than a block or a chunk of a key. The prefix sum sees one row per key and block, 1/BLOCK_OFFSETS of the rows
of a hot key. The log is read and shuffled once; what is
numbered is written then, and read for counts and for numbers. Nothing is broadcast or collected.

Nulls and odd input: rows with a null key belong to no key and are left out; an empty key is a key; rows written twice
count once; an empty table gives an empty result; ties in the order can't occur, as offsets are unique in a partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.common import materialize

BLOCK_OFFSETS = 16_384
CHUNK_ROWS = 16_384


def place_rows(df: DataFrame, key: list[str], lane: list[str], order: str, block: int = BLOCK_OFFSETS) -> DataFrame:
    """Distinct rows of ``df`` in blocks, each with its place in the block; written once, as they are counted and numbered then. Null keys are keys here.

    ``lane`` names the ordered input (a log partition), ``order`` a bigint that is unique in its lane.
    """
    cut = df.where(F.col(order).isNotNull()).withColumn("__block", F.floor(F.col(order) / block))
    part = [*key, *[c for c in lane if c not in key], "__block"]
    # one shuffle by key, lane and block serves the removal of rows written twice and the numbering
    unique = cut.repartition(*part).dropDuplicates([*part, order])
    return materialize(unique.withColumn("__rn", F.row_number().over(W.partitionBy(*part).orderBy(order))), "placed")


def number_rows(placed: DataFrame, key: list[str], lane: list[str]) -> DataFrame:
    """Placed rows with ``rn``: the place of the row among those of its key, by lane and order. Rows with a null key are left out."""
    part = [*key, *[c for c in lane if c not in key], "__block"]
    inside = placed.dropna(subset=key)
    counts = inside.groupBy(*part).agg(F.max("__rn").alias("__n"))
    before = W.partitionBy(*key).orderBy(*[c for c in lane if c not in key], "__block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return inside.join(starts, part).withColumn("rn", F.col("__start") + F.col("__rn")).drop("__start", "__rn", "__block")


def per_key(df: DataFrame, key: list[str], lane: list[str], order: str, value: str, chunk: int = CHUNK_ROWS, block: int = BLOCK_OFFSETS) -> DataFrame:
    """Ordered results per key: ``n_rows``, ``total``, ``first_value`` and ``last_value``, ``n_changes`` (rows whose value isn't that
    of the row before) and ``max_step`` (greatest rise from one row to the next), over all rows of the key in the order of ``rn``.

    ``value`` is a bigint or int without nulls.
    """
    return of_placed(place_rows(df, key, lane, order, block), key, lane, value, chunk)


def of_placed(placed: DataFrame, key: list[str], lane: list[str], value: str, chunk: int = CHUNK_ROWS) -> DataFrame:
    """``per_key`` of rows that are placed already."""
    numbered = number_rows(placed, key, lane).withColumn("__chunk", F.floor((F.col("rn") - 1) / chunk))
    part = [*key, "__chunk"]
    before = F.lag(value).over(W.partitionBy(*part).orderBy("rn"))
    states = (
        numbered.withColumn("__before", before)
        .groupBy(*part)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.col(value).cast("bigint")).alias("total"),
            F.min_by(value, "rn").cast("bigint").alias("first_value"),
            F.max_by(value, "rn").cast("bigint").alias("last_value"),
            F.count_if(F.col(value) != F.col("__before")).alias("n_changes"),
            F.max((F.col(value) - F.col("__before")).cast("bigint")).alias("max_step"),
        )
    )
    left = F.lag("last_value").over(W.partitionBy(*key).orderBy("__chunk"))
    joined = states.withColumn("__left", left)
    return joined.groupBy(*key).agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("total").alias("total"),
        F.min_by("first_value", "__chunk").alias("first_value"),
        F.max_by("last_value", "__chunk").alias("last_value"),
        (F.sum("n_changes") + F.count_if(F.col("first_value") != F.col("__left"))).alias("n_changes"),
        F.greatest(F.max("max_step"), F.max(F.col("first_value") - F.col("__left"))).alias("max_step"),
        F.count(F.lit(1)).alias("n_chunks"),
    )


def record_keys(records: DataFrame) -> DataFrame:
    """Ordered results of every topic and key; the value is the encoded size of the record."""
    rows = records.select("topic", "rec_key", "partition_id", "log_offset", "size_bytes")
    return per_key(rows, ["topic", "rec_key"], ["topic", "partition_id"], "log_offset", "size_bytes")


def heavy_keys(records: DataFrame, commits: DataFrame, record_share: float = 0.01, commit_share: float = 0.40) -> DataFrame:
    """Record keys holding at least ``record_share`` of all records, and the topic partitions holding at least
    ``commit_share`` of the commits of a group. Both counts are those of the chunked operator."""
    key, lane = ["topic", "rec_key"], ["topic", "partition_id"]
    placed = place_rows(records.select(*key, "partition_id", "log_offset"), key, lane, "log_offset")
    keys = of_placed(placed.withColumn("one", F.lit(1)), key, lane, "one").select(*key, "n_rows")
    every = placed.agg(F.count(F.lit(1)).alias("n"))  # with those that have no key
    by_record = keys.where(F.col("n_rows") >= every.scalar() * record_share)

    lanes = commits.select("group_id", "topic", "partition_id", "seq", F.lit(1).alias("one"))
    spots = per_key(lanes, ["group_id", "topic", "partition_id"], [], "seq", "one").select("group_id", "topic", "partition_id", "n_rows")
    share = F.sum("n_rows").over(W.partitionBy("group_id"))  # one row per topic partition of the group
    by_commit = spots.withColumn("all_rows", share).where(F.col("n_rows") >= F.col("all_rows") * commit_share)
    return by_record.select(F.lit("record").alias("kind"), "topic", F.lit(-1).alias("partition_id"), F.hex("rec_key").alias("key_text")).unionByName(
        by_commit.select(F.lit("commit").alias("kind"), "topic", "partition_id", F.col("group_id").alias("key_text"))
    )
