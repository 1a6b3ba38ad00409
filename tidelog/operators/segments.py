"""Segments: rolling, sparse index, lookup, contiguity, truncation and recovery.

Rolling and indexing restart a running total at every boundary they set, which no window can do: each boundary depends on
the one before. They run as one pass over the metadata of batches (61 bytes a batch, no record is read), sorted within tasks
and streamed, so no partition is ever held in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.common import asof, chunked_lag, chunked_running_sum, ship
from tidelog.operators.log import BEFORE_LENGTH, TP

ROLLED = "topic string, partition_id int, base_offset bigint, segment_base bigint, position bigint"
#: Entries that an index holds by default: 10 MiB of 8 bytes each.
INDEX_ENTRIES = 1_310_720
INDEXED = "topic string, partition_id int, segment_base bigint, rel_offset bigint, position bigint"


def _sized(batches: DataFrame) -> DataFrame:
    return batches.select(*TP, "base_offset", "last_offset_delta", "max_timestamp", "segment_base", (F.col("batch_length") + BEFORE_LENGTH).cast("bigint").alias("bytes"), F.unix_millis("append_ts").alias("arrived_ms"))


def _roll(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    place, base, size, begun, since, entries = None, 0, 0, 0, 0, 0
    for part in parts:
        out = []
        for row in part.itertuples():
            if (row.topic, row.partition_id) != place or size >= row.max_segment_bytes or entries >= row.max_entries or row.arrived_ms - begun >= row.max_segment_age_ms:
                place, base, size, begun, since, entries = (row.topic, row.partition_id), row.base_offset, 0, row.arrived_ms, 0, 0
            elif since >= row.index_interval_bytes:
                since, entries = 0, entries + 1
            out.append((row.topic, row.partition_id, row.base_offset, base, size))
            size += row.bytes
            since += row.bytes
        yield pd.DataFrame(out, columns=["topic", "partition_id", "base_offset", "segment_base", "position"])


def roll(batches: DataFrame, meta: DataFrame, max_entries: int = INDEX_ENTRIES) -> DataFrame:
    """Segment and byte position of every batch under the limits of its topic: a segment that isn't empty is closed before an append
    when it has reached the size limit, its index is full, or its first append is as old as the age limit. It may exceed the size by one batch."""
    ship(batches.sparkSession)
    limits = meta.select("topic", "max_segment_bytes", "max_segment_age_ms", "index_interval_bytes").distinct().withColumn("max_entries", F.lit(max_entries))
    sized = _sized(batches).join(F.broadcast(limits), "topic")  # a row per topic
    return sized.repartition(*TP).sortWithinPartitions(*TP, "base_offset").mapInPandas(_roll, ROLLED)


def _index(most: int):
    def index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, since, entries = None, 0, 0
        for part in parts:
            out = []
            for row in part.itertuples():
                if (row.topic, row.partition_id, row.segment_base) != place:
                    place, since, entries = (row.topic, row.partition_id, row.segment_base), 0, 0
                if since >= row.index_interval_bytes and row.position > 0:
                    if entries < most:
                        out.append((row.topic, row.partition_id, row.segment_base, row.base_offset - row.segment_base, row.position))
                    since, entries = 0, entries + 1
                since += row.bytes
            yield pd.DataFrame(out, columns=["topic", "partition_id", "segment_base", "rel_offset", "position"])

    return index


def sparse_index(batches: DataFrame, meta: DataFrame, max_entries: int = INDEX_ENTRIES) -> DataFrame:
    """Index entries: one for a batch when an interval of bytes was written since the last, never for the first batch of a segment; a full index drops the rest."""
    ship(batches.sparkSession)
    every = meta.select("topic", "index_interval_bytes").distinct()
    placed = chunked_running_sum(_sized(batches), [*TP, "segment_base"], "base_offset", "bytes", "position").join(F.broadcast(every), "topic")
    segment = [*TP, "segment_base"]
    return placed.repartition(*segment).sortWithinPartitions(*segment, "base_offset").mapInPandas(_index(max_entries), INDEXED)


def lookup(targets: DataFrame, segments: DataFrame, index: DataFrame) -> DataFrame:
    """Segment and greatest indexed position at or below each target (topic, partition_id, target); position 0 where the index has none."""
    held = asof(targets, "target", segments.select(*TP, "base_offset", F.col("base_offset").alias("segment_base")), "base_offset", TP, ["segment_base"]).where("segment_base is not null")
    entries = index.withColumn("entry_offset", F.col("segment_base") + F.col("rel_offset"))
    found = asof(held, "target", entries.select(*TP, "segment_base", "entry_offset", "rel_offset", "position"), "entry_offset", [*TP, "segment_base"], ["rel_offset", "position"])
    return found.withColumns({"rel_offset": F.coalesce("rel_offset", F.lit(0)), "position": F.coalesce("position", F.lit(0))})


def contiguity(segments: DataFrame, meta: DataFrame) -> DataFrame:
    """Segments whose end doesn't meet the next base: on a topic that deletes they must be equal, on a compacted one they may not overlap."""
    after = F.lead("base_offset").over(W.partitionBy(*TP).orderBy("base_offset"))
    joined = segments.withColumn("next_base", after).join(F.broadcast(meta.select("topic", "cleanup").distinct()), "topic")
    wrong = F.when(F.col("cleanup") == 1, F.col("next_offset") > F.col("next_base")).otherwise(F.col("next_offset") != F.col("next_base"))
    return joined.withColumn("broken", F.coalesce(wrong, F.lit(False))).select(*TP, "base_offset", "next_offset", "next_base", "broken")


def end_states(batches: DataFrame) -> DataFrame:
    """Per segment: next offset, greatest time stamp, bytes and batches, from its batches alone."""
    return _sized(batches).groupBy(*TP, "segment_base").agg(
        F.max(F.col("base_offset") + F.col("last_offset_delta") + 1).alias("next_offset"),
        F.max("max_timestamp").alias("max_ts_ms"),
        F.sum("bytes").alias("size_bytes"),
        F.count(F.lit(1)).alias("n_batches"),
    )


def gaps(batches: DataFrame) -> DataFrame:
    """Batches that don't follow the one before them in their partition, with what they should have been."""
    cut = batches.select(*TP, "base_offset", "last_offset_delta")
    followed = chunked_lag(cut, TP, "base_offset", F.col("base_offset") + F.col("last_offset_delta") + 1, "expected")
    return followed.where("base_offset <> expected").select(*TP, "base_offset", "expected", (F.col("base_offset") - F.col("expected")).alias("gap"))


def missing(segments: DataFrame) -> DataFrame:
    """Segments before which others were removed, and how many offsets are missing there."""
    before = F.lag("next_offset").over(W.partitionBy(*TP).orderBy("base_offset"))
    return segments.withColumn("prev", before).where("base_offset > prev").select(*TP, "base_offset", (F.col("base_offset") - F.col("prev")).alias("missing"))


def truncate(batches: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep the whole batches that end below the cut (topic, partition_id, cut) of their partition. Returns them, and where each log then
    ends: after the last batch kept, or at the cut where nothing is left."""
    joined = batches.join(cuts, TP).withColumn("kept", F.col("base_offset") + F.col("last_offset_delta") < F.col("cut"))
    last = F.max(F.when(F.col("kept"), F.col("base_offset") + F.col("last_offset_delta") + 1))
    return joined.where("kept").drop("kept", "cut"), joined.groupBy(*TP, "cut").agg(F.coalesce(last, F.col("cut")).alias("log_end"), F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_cut"))


def recover(batches: DataFrame, good: str = "good") -> DataFrame:
    """The batches of each segment that survive a crash: the longest prefix in which every batch is whole (``good``) and begins where
    the one before ended."""
    order = W.partitionBy(*TP, "segment_base").orderBy("base_offset")
    expected = F.coalesce(F.lag(F.col("base_offset") + F.col("last_offset_delta") + 1).over(order), F.col("segment_base"))
    marked = batches.withColumn("bad", ~F.col(good) | (F.col("base_offset") != expected))
    return marked.withColumn("lost", F.bool_or("bad").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).where("not lost").drop("bad", "lost")
