"""K-slack reordering: event-time aggregates over records that arrive late and out of order.

Records of a partition arrive batch by batch in the order of ``base_offset``. A record's event time ``e`` is the batch's
``first_timestamp`` plus the record's ``timestamp_delta`` (none if ``first_timestamp`` is -1). The *progress* seen by a
batch is the greatest ``e`` of earlier batches of the partition, without times later than the arrival of their own
batch, which a fast clock has made. A record waits in the buffer until progress has passed ``e`` by the slack K;
then it is released, in the order of ``e``, to the final aggregation. Until then it counts in a provisional value.
A record that arrives when progress has already passed ``e`` by more than K is beyond the cut-off: the buffer refuses it, it is reported and
not aggregated.

``reorder`` runs that buffer over chunks of a partition's batches. A chunk begins with the progress made before it, its boundary state, which a
running maximum over one row per chunk carries forward; it refuses what is late, releases in the order of ``e`` what progress passes, and hands on as ``held`` what is still waiting at
its end. As every release is of what lies below a bound that only rises, the released sequence of a partition is that of event time, so held records take their place in it by ``e``
whichever later chunk releases them: final aggregation merges slices of event time.

Scale: records meet their batch by (topic, partition, base_offset), and are buffered by (topic, partition, chunk), so a partition that holds a third of all rows is
still spread evenly; ordered aggregation runs on slices of event time with boundary states merged after. The log is read and joined once. Nothing is broadcast or collected.

Nulls and odd input: rows written twice count once; a record without its batch, with a null delta or first_timestamp
-1 has no event time, so it is neither late nor aggregated; an empty table gives an empty result; other columns of the
inputs are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.common import CHUNK_OFFSETS, materialize, ship

TP = ["topic", "partition_id"]
BATCH = [*TP, "batch_base"]
CUTOFF_MS = 7_200_000
PERIOD_MS = 3_600_000
#: Event time is cut into slices of this many ms for ordered work; a slice holds at most as many distinct times.
SLICE_MS = 600_000
LATE, RELEASED, HELD = "late", "released", "held"
REORDERED = "topic string, partition_id int, batch_base bigint, log_offset bigint, e bigint, size_bytes int, progress bigint, kind string, released_by bigint"


def event_times(records: DataFrame, batches: DataFrame) -> DataFrame:
    """Records with ``e`` (ms), and ``seen`` = e where it isn't later than the arrival of its batch."""
    heads = (
        batches.where(F.col("first_timestamp") != -1)
        .select("topic", "partition_id", F.col("base_offset").alias("batch_base"), "first_timestamp", F.unix_micros("append_ts").alias("arrived_us"))
        .dropDuplicates(BATCH)
    )
    return (
        records.select(*BATCH, "log_offset", "timestamp_delta", "size_bytes")
        .join(heads, BATCH)
        .withColumn("e", F.col("first_timestamp") + F.col("timestamp_delta"))
        .withColumn("seen", F.when(F.col("e") * 1000 <= F.col("arrived_us"), F.col("e")))
        .drop("first_timestamp", "timestamp_delta", "arrived_us")
    )


def buffer(batch: np.ndarray, offset: np.ndarray, e: np.ndarray, seen: np.ndarray, progress: int | None, slack_ms: int) -> tuple[np.ndarray, ...]:
    """The buffer over the records of some batches, sorted by (batch, offset), that begin with ``progress``. ``seen`` is the least bigint where a record makes no progress.

    Returns, in the order in which records leave the buffer (refused ones first, then by event time, held ones last): their index, the progress on arrival, what became of them, and the place (in
    ``steps``) of the batch that released them; then ``steps``, the batches.
    """
    least = np.iinfo(np.int64).min
    steps, first = np.unique(batch, return_index=True)
    tops = np.maximum.reduceat(seen, first) if len(batch) else seen
    after = np.maximum.accumulate(np.concatenate(([least if progress is None else progress], tops)))
    nth = np.searchsorted(steps, batch)
    before = after[:-1][nth]
    bound = np.where(after > least, after - slack_ms, least)  # what lies below it has been released after each step
    late = e < bound[:-1][nth]
    by = np.searchsorted(bound[1:], e, "right")  # the first step whose bound is above e
    kind = np.where(late, 0, np.where(by < len(steps), 1, 2))
    order = np.lexsort((offset, e, kind))
    return order, before[order], kind[order], np.where(kind == 1, by, -1)[order], steps


def _reorder(slack_ms: int):
    def run(table: pa.Table) -> pa.Table:
        from tidelog.operators import kslack as k

        least = np.iinfo(np.int64).min
        table = table.sort_by([("batch_base", "ascending"), ("log_offset", "ascending")])
        column = lambda name: table.column(name).fill_null(least).to_numpy()
        batch, offset, e, seen = (column(c).astype(np.int64) for c in ("batch_base", "log_offset", "e", "seen"))
        carried = table.column("carried")[0].as_py()
        order, before, kind, by, steps = k.buffer(batch, offset, e, seen, carried, slack_ms)
        out = table.select(["topic", "partition_id", "batch_base", "log_offset", "e", "size_bytes"]).take(pa.array(order))
        out = out.append_column("progress", pa.array(before, mask=before == least)).append_column("kind", pa.array([k.LATE, k.RELEASED, k.HELD]).take(pa.array(kind)))
        out = out.append_column("released_by", pa.array(steps[by] if len(steps) else by, mask=by < 0))
        # a row without event time only makes progress; a row written twice leaves once
        again = np.concatenate(([False], (offset[order][1:] == offset[order][:-1]) & (e[order][1:] == e[order][:-1])))
        return out.filter(pa.array((e[order] != least) & ~again))

    return run


def reorder(timed: DataFrame, slack_ms: int = CUTOFF_MS, chunk: int = CHUNK_OFFSETS, carried: DataFrame | None = None) -> DataFrame:
    """Every record with an event time, once, and what the buffer did with it (REORDERED).

    ``kind`` is ``late`` for what it refused, ``released`` for what left it within its chunk, by the batch ``released_by``, and ``held`` for what waits at the end of the chunk; ``progress`` is that on
    arrival. ``carried`` (topic, partition_id, progress): progress that partitions begin with. ``timed`` is read twice.
    """
    ship(timed.sparkSession)
    cut = timed.withColumn("chunk", F.floor(F.col("batch_base") / chunk))
    before = W.partitionBy(*TP).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    heads = cut.groupBy(*TP, "chunk").agg(F.max("seen").alias("top")).withColumn("carried", F.max("top").over(before)).drop("top")
    if carried is not None:
        heads = heads.join(carried.select(*TP, F.col("progress").alias("__from")), TP, "left").withColumn("carried", F.greatest("carried", "__from")).drop("__from")
    return cut.join(heads, [*TP, "chunk"]).groupBy(*TP, "chunk").applyInArrow(_reorder(slack_ms), REORDERED)


def k_slack(records: DataFrame, batches: DataFrame, slack_ms: int = CUTOFF_MS, chunk: int = CHUNK_OFFSETS) -> DataFrame:
    """The records of a whole log through the buffer: see ``reorder``."""
    return reorder(materialize(event_times(records, batches), "timed"), slack_ms, chunk)


def beyond_cutoff(records: DataFrame, batches: DataFrame, slack_ms: int = CUTOFF_MS) -> DataFrame:
    """Names of the records that the buffer refused, each once."""
    return k_slack(records, batches, slack_ms).where(F.col("kind") == LATE).select(*TP, "log_offset")


def period_values(records: DataFrame, batches: DataFrame, slack_ms: int = CUTOFF_MS, period_ms: int = PERIOD_MS) -> DataFrame:
    """Counts and sums per topic and period of event time, with order-sensitive values of the released sequence.

    ``n_first`` is what was published when progress first passed the end of the period (all that had arrived by then),
    ``n_corrected`` what late records added within the cut-off, ``n_beyond`` what came after it and isn't counted.
    ``n_released`` of the records are in partitions where the period is ``final``, as none can be added any more; it is provisional before. ``n_held`` records
    still are in the buffer at the end. ``max_gap_ms`` is the longest pause between successive event times of a partition within the
    period, taken in released order.
    """
    timed = materialize(event_times(records, batches), "timed")
    end = timed.groupBy(*TP).agg(F.max("seen").alias("end_progress"))  # one row per partition
    return aggregated(reorder(timed, slack_ms), end, slack_ms, period_ms)


def aggregated(reordered: DataFrame, end: DataFrame, slack_ms: int = CUTOFF_MS, period_ms: int = PERIOD_MS) -> DataFrame:
    """Final and provisional values of what the buffer gave: see ``period_values``. ``end``: the progress that partitions have made (topic, partition_id, end_progress)."""
    tp = TP
    by_time = (
        reordered.withColumn("beyond", F.col("kind") == LATE)
        .withColumn("period_ms", F.floor(F.col("e") / period_ms) * period_ms)
        .withColumn("passed", F.coalesce(F.col("progress") >= F.col("period_ms") + period_ms, F.lit(False)))
        # ties in event time are pre-aggregated: a slice has at most SLICE_MS rows, however hot it is
        .groupBy(*tp, "period_ms", "e")
        .agg(
            F.count_if(~F.col("beyond")).alias("n"),
            F.count_if(~F.col("beyond") & ~F.col("passed")).alias("n_first"),
            F.count_if("beyond").alias("n_beyond"),
            F.sum(F.when(~F.col("beyond"), F.col("size_bytes").cast("bigint"))).alias("bytes"),
        )
        .join(end, tp)
        # released by some chunk: progress has passed it by the slack; the rest is in the buffer
        .withColumn("n_held", F.when(F.coalesce(F.col("e") >= F.col("end_progress") - slack_ms, F.lit(True)), F.col("n")).otherwise(0))
        .drop("end_progress")
    )
    slice_ = [*tp, "period_ms", "slice"]
    in_slice = W.partitionBy(*slice_).orderBy("e")
    sliced = (
        by_time.withColumn("slice", F.floor(F.col("e") / SLICE_MS))
        .withColumn("kept", F.when(F.col("n") > 0, F.col("e")))
        .withColumn("before", F.last("kept", ignorenulls=True).over(in_slice.rowsBetween(W.unboundedPreceding, -1)))
        .groupBy(*slice_)
        .agg(
            *[F.sum(c).alias(c) for c in ("n", "n_first", "n_beyond", "n_held", "bytes")],
            F.min("kept").alias("first_e"),
            F.max("kept").alias("last_e"),
            F.max(F.greatest(F.col("kept") - F.col("before"), F.when(F.col("n") > 1, 0))).alias("gap"),  # a tie is a pause of 0
        )
    )
    across = W.partitionBy(*tp, "period_ms").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    merged = (
        sliced.withColumn("gap", F.greatest("gap", F.col("first_e") - F.last("last_e", ignorenulls=True).over(across)))
        .groupBy(*tp, "period_ms")
        .agg(*[F.sum(c).alias(c) for c in ("n", "n_first", "n_beyond", "n_held", "bytes")], F.min("first_e").alias("first_e"), F.max("last_e").alias("last_e"), F.max("gap").alias("gap"))
    )
    return (
        merged.join(end, tp)
        .withColumn("final", F.coalesce(F.col("end_progress") >= F.col("period_ms") + period_ms + slack_ms, F.lit(False)))
        .groupBy("topic", "period_ms")
        .agg(
            F.sum("n").alias("n_records"),
            F.sum("bytes").alias("sum_bytes"),
            F.sum("n_first").alias("n_first"),
            F.sum(F.col("n") - F.col("n_first")).alias("n_corrected"),
            F.sum("n_beyond").alias("n_beyond"),
            F.sum(F.when(F.col("final"), F.col("n")).otherwise(0)).alias("n_released"),
            F.sum("n_held").alias("n_held"),
            F.min("first_e").alias("first_e"),
            F.max("last_e").alias("last_e"),
            F.max("gap").alias("max_gap_ms"),
            F.bool_and("final").alias("final"),
        )
    )
