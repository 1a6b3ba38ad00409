"""Compaction: the newest record of every key, tombstones kept until their horizon.

Only sealed segments take part; the active one is neither read for the newest offsets nor rewritten. Of a sealed record: without a
key it stays; if its key has a newer sealed record it goes; with a value it stays; a tombstone (null value; an empty one is a value)
stays while younger than the horizon. Offsets never change.

Scale: the newest offset of each key is a map-side combined aggregate, and it is joined back by offset, not by key: a
key that holds a third of all rows spreads evenly. The limits of topics, a row each, are broadcast. A record without time stamp counts as older than any horizon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.common import _file_system, chunked_running_sum
from tidelog.operators.log import BEFORE_LENGTH, TP


def newest_offsets(records: DataFrame, key: str = "rec_key") -> DataFrame:
    """Greatest offset per partition and key."""
    return records.where(F.col(key).isNotNull()).groupBy(*TP, key).agg(F.max("log_offset").alias("log_offset"))


def with_sealed(records: DataFrame, segments: DataFrame) -> DataFrame:
    """Records with ``sealed`` of their segment; joined with one row per active segment."""
    active = segments.where("not sealed").select(*TP, F.col("base_offset").alias("segment_base"), F.lit(False).alias("__sealed"))
    return records.join(active, [*TP, "segment_base"], "left").withColumn("sealed", F.coalesce("__sealed", F.lit(True))).drop("__sealed")


def is_tombstone(value: Column) -> Column:
    return value.isNull()


def judged(records: DataFrame, segments: DataFrame, meta: DataFrame, now_ms: int) -> DataFrame:
    """Records of compacted topics with ``newest`` and ``retained``."""
    topics = meta.where("cleanup = 1").select("topic", "delete_retention_ms").distinct()
    marked = with_sealed(records.join(F.broadcast(topics), "topic"), segments)
    top = newest_offsets(marked.where("sealed")).select(*TP, "log_offset", F.lit(True).alias("__newest"))
    age_us = F.lit(now_ms * 1000) - F.unix_micros("ts")
    young = F.coalesce(age_us < F.col("delete_retention_ms") * 1000, F.lit(False))
    newest = F.coalesce("__newest", F.lit(False))
    retained = F.when(~F.col("sealed") | F.col("rec_key").isNull(), True).when(~newest, False).when(F.col("rec_value").isNotNull(), True).otherwise(young)
    return marked.join(top, [*TP, "log_offset"], "left").withColumns({"newest": newest, "retained": retained}).drop("__newest", "delete_retention_ms")


def pass_report(marked: DataFrame) -> DataFrame:
    """What a pass does per partition: records kept and dropped, keys, segments rewritten and removed; clean segments aren't touched."""
    by_segment = marked.where("sealed").groupBy(*TP, "segment_base").agg(F.count_if("retained").alias("kept"), F.count_if(~F.col("retained")).alias("dropped"), F.count_if("newest").alias("keys"))
    return by_segment.groupBy(*TP).agg(
        F.sum("kept").alias("n_kept"),
        F.sum("dropped").alias("n_dropped"),
        F.sum("keys").alias("n_keys"),
        F.count_if((F.col("dropped") > 0) & (F.col("kept") > 0)).alias("n_rewritten"),
        F.count_if((F.col("dropped") > 0) & (F.col("kept") == 0)).alias("n_removed"),
        F.count_if(F.col("dropped") == 0).alias("n_clean"),
    )


def dirty_ratio(segments: DataFrame, marks: DataFrame) -> DataFrame:
    """Share of sealed bytes at or above the mark (topic, partition_id, mark) up to which the log is clean; 0 where nothing is sealed."""
    joined = segments.join(marks, TP, "left")
    sealed = F.when(F.col("sealed"), F.col("size_bytes")).otherwise(0)
    dirty = F.when(F.col("sealed") & (F.col("base_offset") >= F.coalesce("mark", F.lit(0))), F.col("size_bytes")).otherwise(0)
    return joined.groupBy(*TP).agg(F.coalesce(F.try_divide(F.sum(dirty), F.sum(sealed)), F.lit(0.0)).alias("dirty_ratio"))


def dirtiest(ratios: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The partition to clean next: the dirtiest strictly above the threshold, the first by name among equals."""
    return ratios.where(F.col("dirty_ratio") > threshold).orderBy(F.desc("dirty_ratio"), *TP).limit(1)


def holes(records: DataFrame) -> DataFrame:
    """Records before which offsets of their segment are missing, and how many; the first of a segment is held against its base."""
    order = W.partitionBy(*TP, "segment_base").orderBy("log_offset")
    expected = F.coalesce(F.lag("log_offset").over(order) + 1, F.col("segment_base"))
    return records.withColumn("expected", expected).where("log_offset <> expected").select(*TP, "segment_base", "log_offset", (F.col("log_offset") - F.col("expected")).alias("missing"))


def dump(records: DataFrame, segments: DataFrame) -> DataFrame:
    """Per segment: records, batches, holes, tombstones, bytes, and the offsets missing between it and the one before."""
    by_segment = records.groupBy(*TP, "segment_base").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_distinct("batch_base").alias("n_batches"),
        F.count_if(F.col("rec_value").isNull()).alias("n_tombstones"),
    )
    missing = holes(records).groupBy(*TP, "segment_base").agg(F.count(F.lit(1)).alias("n_holes"))
    before = F.lag("next_offset").over(W.partitionBy(*TP).orderBy("base_offset"))
    listed = segments.select(*TP, F.col("base_offset").alias("segment_base"), "next_offset", "size_bytes", "sealed", F.greatest(F.col("base_offset") - before, F.lit(0)).alias("gap_before"))
    out = listed.join(by_segment, [*TP, "segment_base"], "left").join(missing, [*TP, "segment_base"], "left")
    return out.fillna(0, ["n_records", "n_batches", "n_tombstones", "n_holes", "gap_before"])


def dump_batches(records: DataFrame, batches: DataFrame) -> DataFrame:
    """Per batch: its position in the segment and bytes, newest time stamp, records with their first and last offset, tombstones, and the holes and missing offsets up to each of its records."""
    order = W.partitionBy(*TP, "segment_base").orderBy("log_offset")
    expected = F.coalesce(F.lag("log_offset").over(order) + 1, F.col("segment_base"))
    held = records.withColumn("gap", F.col("log_offset") - expected).groupBy(*TP, F.col("batch_base").alias("base_offset")).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.min("log_offset").alias("first_offset"),
        F.max("log_offset").alias("last_offset"),
        F.count_if(F.col("rec_value").isNull()).alias("n_tombstones"),
        F.count_if(F.col("gap") != 0).alias("n_holes"),
        F.sum("gap").alias("n_missing"),
    )
    sized = batches.select(*TP, "segment_base", "base_offset", (F.col("batch_length") + BEFORE_LENGTH).cast("bigint").alias("bytes"), "max_timestamp")
    return chunked_running_sum(sized, [*TP, "segment_base"], "base_offset", "bytes", "position").join(held, [*TP, "base_offset"])


def replace_segments(cleaned: DataFrame, touched: DataFrame, path: str) -> None:
    """Put cleaned segments in the place of old ones in a table partitioned by topic, partition_id and segment_base.

    ``touched`` names the segments from which something was dropped; only those are written. The folder of a touched segment without
    survivors is deleted. ``cleaned`` must not be read from ``path`` itself. Where a touched segment is gone, as retention may have taken it meanwhile, nothing is replaced and LookupError tells which.
    """
    spark = cleaned.sparkSession
    part = [*TP, "segment_base"]
    for r in touched.select(*part).distinct().toLocalIterator():  # names of segments, one at a time
        fs, folder = _file_system(spark, f"{path}/topic={r['topic']}/partition_id={r['partition_id']}/segment_base={r['segment_base']}")
        if not fs.exists(folder):
            raise LookupError(str(folder))
    written = cleaned.join(touched.select(*part).distinct(), part, "left_semi")
    written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*part).parquet(path)
    gone = touched.select(*part).distinct().join(cleaned.select(*part).distinct(), part, "left_anti")
    for r in gone.toLocalIterator():  # names of emptied segments, one at a time
        fs, folder = _file_system(spark, f"{path}/topic={r['topic']}/partition_id={r['partition_id']}/segment_base={r['segment_base']}")
        fs.delete(folder, True)
