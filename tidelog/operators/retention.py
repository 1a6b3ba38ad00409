"""Retention of whole sealed segments, by age and by size. The active segment is never deleted.

One row per segment; ordered work is per log partition over its segments, of which even a partition of terabytes has thousands.
Topics that are compacted keep their newest values instead and are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators.log import TP


def _with_limits(segments: DataFrame, meta: DataFrame) -> DataFrame:
    limits = meta.select("topic", "retention_ms", "retention_bytes", "cleanup").distinct()
    return segments.join(F.broadcast(limits), "topic").where("cleanup = 0").drop("cleanup")  # a row per topic


def _too_old(now_ms: int) -> Column:
    """Oldest first until the first that is young enough: a segment without time stamps stops the walk unless it is empty."""
    empty = F.col("next_offset") == F.col("base_offset")
    old = (F.col("max_ts_ms") >= 0) & (F.lit(now_ms) - F.col("max_ts_ms") >= F.col("retention_ms"))
    keep = ~F.col("sealed") | ~(empty | F.coalesce(old, F.lit(False)))
    return ~F.bool_or(keep).over(W.partitionBy(*TP).orderBy("base_offset").rowsBetween(W.unboundedPreceding, W.currentRow))


def _too_much() -> Column:
    """Oldest first while what is left, the active segment included, exceeds the limit; no limit keeps all."""
    tail = F.sum("size_bytes").over(W.partitionBy(*TP).orderBy(F.col("base_offset").desc()).rowsBetween(W.unboundedPreceding, W.currentRow))
    return F.col("sealed") & F.coalesce(tail > F.col("retention_bytes"), F.lit(False))


def by_age(segments: DataFrame, meta: DataFrame, now_ms: int) -> DataFrame:
    """Segments with ``expired``."""
    return _with_limits(segments, meta).withColumn("expired", _too_old(now_ms)).drop("retention_ms", "retention_bytes")


def by_size(segments: DataFrame, meta: DataFrame) -> DataFrame:
    """Segments with ``evicted``."""
    return _with_limits(segments, meta).withColumn("evicted", _too_much()).drop("retention_ms", "retention_bytes")


def by_both(segments: DataFrame, meta: DataFrame, now_ms: int) -> DataFrame:
    """Age first, then size over what is left: segments with ``expired`` and ``evicted``."""
    aged = _with_limits(segments, meta).withColumn("expired", _too_old(now_ms))
    tail = F.sum(F.when(~F.col("expired"), F.col("size_bytes")).otherwise(0)).over(W.partitionBy(*TP).orderBy(F.col("base_offset").desc()).rowsBetween(W.unboundedPreceding, W.currentRow))
    over = F.col("sealed") & ~F.col("expired") & F.coalesce(tail > F.col("retention_bytes"), F.lit(False))
    return aged.withColumn("evicted", over).drop("retention_ms", "retention_bytes")


def new_bounds(judged: DataFrame) -> DataFrame:
    """Log start, bytes and segments of each partition after retention."""
    gone = F.col("expired") | F.col("evicted")
    return judged.groupBy(*TP).agg(
        F.min(F.when(~gone, F.col("base_offset"))).alias("log_start"),
        F.sum(F.when(~gone, F.col("size_bytes")).otherwise(0)).alias("size_bytes"),
        F.count_if(~gone).alias("n_kept"),
        F.count_if(gone).alias("n_deleted"),
    )


def sweep(segments: DataFrame, meta: DataFrame, now_ms: int) -> DataFrame:
    """One maintenance pass over all segments: what becomes of each. The active segment is ``rolled`` when it has reached a limit of its topic and isn't
    empty, sealed ones are ``expired`` or ``evicted`` by retention, the rest are ``kept``."""
    limits = meta.select("topic", "max_segment_bytes", "max_segment_age_ms").distinct()
    judged = by_both(segments, meta, now_ms).select(*TP, "base_offset", "expired", "evicted")
    joined = segments.join(F.broadcast(limits), "topic").join(judged, [*TP, "base_offset"], "left")
    full = (F.col("size_bytes") >= F.col("max_segment_bytes")) | ((F.col("max_ts_ms") >= 0) & (F.lit(now_ms) - F.col("max_ts_ms") >= F.col("max_segment_age_ms")))
    rolled = ~F.col("sealed") & (F.col("next_offset") > F.col("base_offset")) & full
    return joined.select(*TP, "base_offset", F.when(F.col("expired"), "expired").when(F.col("evicted"), "evicted").when(rolled, "rolled").otherwise("kept").alias("fate"))
