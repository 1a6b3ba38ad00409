"""The log: offsets, reads, bounds, metadata.

A log is a DataFrame with one row per record and the columns ``topic, partition_id, log_offset``; batches and segments are
DataFrames of their own (``base_offset``, ``next_offset``). Offsets count records within a partition, from 0 and without holes when
they are given out; compaction and truncation leave holes and never renumber. Rows written twice are one record. Reading deletes nothing.

Nulls: a record without topic, partition or offset isn't in the log. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.common import asof, chunked_lag, chunked_running_sum, materialize

TP = ["topic", "partition_id"]
# The error codes of the protocol.
ERRORS = {
    0: "none",
    1: "unknown broker error",
    2: "offset out of range",
    3: "corrupt message",
    4: "not leader for partition",
    5: "unknown topic or partition",
    6: "topic already exists",
    7: "invalid topic name",
    8: "request timed out",
    9: "unsupported api version",
    10: "group coordinator not available",
    11: "not the coordinator for this group",
    12: "stale generation",
    13: "unknown member id",
    14: "rebalance in progress — rejoin",
    15: "invalid group id",
}
OK, UNKNOWN, OUT_OF_RANGE, CORRUPT, NOT_LEADER, UNKNOWN_TOPIC, TOPIC_EXISTS, INVALID_TOPIC = range(8)
#: Ordered passes over positions in bytes take chunks of this many.
CHUNK_BYTES = 1 << 30
#: Bytes of the header of a batch, and those of it that batch_length doesn't count.
HEADER_BYTES, BEFORE_LENGTH = 61, 12


def records_once(records: DataFrame) -> DataFrame:
    """Each record once, however often its row was written."""
    return records.dropna(subset=[*TP, "log_offset"]).dropDuplicates([*TP, "log_offset"])


def batches_once(batches: DataFrame) -> DataFrame:
    return batches.dropna(subset=[*TP, "base_offset"]).dropDuplicates([*TP, "base_offset"])


def append(rows: DataFrame, partition: Column, order: list[str], slice_: Column, ends: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``partition_id`` and ``log_offset``: dense numbers per partition in the given order, going on from ``ends``
    (partition_id, log_end) where given.

    ``slice_`` is a coarse, monotone part of the order (an hour, a block of ids); it spreads a partition over
    tasks: rows are numbered in their slice, and a prefix sum over the slices gives each its first offset.
    """
    cut = rows.withColumn("partition_id", partition).withColumn("__slice", slice_)
    part = ["partition_id", "__slice"]
    numbered = cut.withColumn("__rn", F.row_number().over(W.partitionBy(*part).orderBy(*order)))
    sizes = cut.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy("partition_id").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    out = numbered.join(starts, part)
    carry: Column = F.lit(0)
    if ends is not None:
        out = out.join(F.broadcast(ends.select("partition_id", "log_end")), "partition_id", "left")  # a row per partition
        carry = F.coalesce("log_end", F.lit(0))
    return out.withColumn("log_offset", (carry + F.col("__start") + F.col("__rn") - 1).cast("bigint")).drop("__slice", "__rn", "__start", "log_end")


def bounds(segments: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Log start (base of the oldest segment) and log end (one past the newest offset); with ``records`` also the first and last
    offset that is really there, which compaction may have moved."""
    out = segments.groupBy(*TP).agg(F.min("base_offset").alias("log_start"), F.max("next_offset").alias("log_end"))
    if records is None:
        return out
    there = records.groupBy(*TP).agg(F.min("log_offset").alias("first_offset"), F.max("log_offset").alias("last_offset"))
    return out.join(there, TP, "left")


def status(requests: DataFrame, log_bounds: DataFrame, offset: str = "fetch_offset") -> DataFrame:
    """Requests with error code, high watermark and log start: a partition that isn't there is an error of its own row.

    The end itself may be read (nothing is there yet); beyond it, or below the start, is out of range.
    """
    at = F.col(offset)
    code = F.when(F.col("log_end").isNull(), UNKNOWN_TOPIC).when((at > F.col("log_end")) | (at < F.col("log_start")), OUT_OF_RANGE).otherwise(OK)
    place = F.when(F.col("log_end").isNull(), "unknown").when(at > F.col("log_end"), "above_end").when(at == F.col("log_end"), "at_end").when(at < F.col("log_start"), "below_start").otherwise("inside")
    joined = requests.join(log_bounds.select(*TP, "log_start", "log_end"), TP, "left")
    return joined.select(*requests.columns, code.cast("int").alias("error"), place.alias("place"), F.coalesce("log_end", F.lit(-1)).alias("high_watermark"), F.coalesce("log_start", F.lit(-1)).alias("log_start"))


def fetch_from(records: DataFrame, starts: DataFrame) -> DataFrame:
    """Records at or after the start (topic, partition_id, fetch_offset) of their partition; holes are passed over."""
    return records.join(starts, TP).where("log_offset >= fetch_offset")


def fetch_batches(requests: DataFrame, batches: DataFrame) -> DataFrame:
    """What a read of at most ``max_bytes`` from ``fetch_offset`` returns, in whole batches and at least one.

    It starts with the batch that holds the offset. Running totals of bytes turn both ends into lookups of the greatest value
    below a bound, so a request costs two rows of a sort, whatever it spans.
    """
    sized = batches.select(*TP, "base_offset", (F.col("base_offset") + F.col("last_offset_delta")).alias("last_offset"), (F.col("batch_length") + BEFORE_LENGTH).cast("bigint").alias("bytes"))
    totals = materialize(chunked_running_sum(sized, TP, "base_offset", "bytes", "before").withColumn("through", F.col("before") + F.col("bytes")), "totals")  # read by three passes
    last = asof(requests, "fetch_offset", totals, "base_offset", TP, ["last_offset", "base_offset", "before", "through"])
    # where a hole holds the offset, reading begins with the batch after it
    here = F.col("last_offset") >= F.col("fetch_offset")
    begun = last.select(*requests.columns, F.when(here, F.col("before")).otherwise(F.coalesce("through", F.lit(0))).alias("from_bytes"))
    first = asof(begun, "from_bytes", totals.select(*TP, F.col("before").alias("start_bytes"), F.col("base_offset").alias("first_base"), F.col("through").alias("first_through")), "start_bytes", TP, ["first_base", "first_through", "start_bytes"], CHUNK_BYTES)
    ready = first.where("start_bytes = from_bytes").drop("start_bytes").withColumn("limit_bytes", F.greatest(F.col("from_bytes") + F.col("max_bytes"), "first_through"))
    end = asof(ready, "limit_bytes", totals.select(*TP, "through", F.col("through").alias("to_bytes"), F.col("last_offset").alias("last_read")), "through", TP, ["to_bytes", "last_read"], CHUNK_BYTES)
    return end.select(*requests.columns, "first_base", "last_read", (F.col("to_bytes") - F.col("from_bytes")).alias("bytes_read"))


def fetch(requests: DataFrame, log_bounds: DataFrame, batches: DataFrame, records: DataFrame, block: int = 1_024) -> tuple[DataFrame, DataFrame]:
    """Answers to requests (seq, topic, partition_id, fetch_offset, max_bytes) over many partitions: the status of each, and its records.

    Records are those of the whole batches of ``fetch_batches``; a request with an error has none. They meet by blocks of ``block`` offsets, of which the cap of a request bounds how many it has.
    """
    answers = status(requests, log_bounds)
    good = answers.where(F.col("error") == OK).select(*requests.columns)
    spans = fetch_batches(good, batches).select("seq", *TP, "first_base", "last_read")
    blocks = F.sequence(F.floor(F.col("first_base") / block), F.floor(F.col("last_read") / block))
    cut = spans.withColumn("__block", F.explode(blocks))
    found = records.withColumn("__block", F.floor(F.col("log_offset") / block)).join(cut, [*TP, "__block"]).where("log_offset between first_base and last_read")
    return answers, found.drop("__block", "first_base", "last_read")


def resume(requests: DataFrame, log_bounds: DataFrame) -> DataFrame:
    """Where a reader goes on: below the log start, whose records were deleted, at the start; past the end it fails, and so it does where there is no such partition."""
    joined = requests.join(log_bounds.select(*TP, "log_start", "log_end"), TP, "left")
    at = F.col("fetch_offset")
    code = F.when(F.col("log_end").isNull(), UNKNOWN_TOPIC).when(at > F.col("log_end"), OUT_OF_RANGE).otherwise(OK)
    return joined.select(*requests.columns, code.alias("error"), F.when(code == OK, F.greatest(at, "log_start")).alias("resume_at"))


def epoch_ends(requests: DataFrame, batches: DataFrame, log_bounds: DataFrame) -> DataFrame:
    """Answers to (topic, partition_id, asked): the newest epoch up to that asked for, and one past its last offset, which is where the next epoch began or the log end; -1 where there is none."""
    begun = batches.groupBy(*TP, "leader_epoch").agg(F.min("base_offset").alias("start_offset"))  # a row per epoch
    after = begun.withColumn("next_start", F.lead("start_offset").over(W.partitionBy(*TP).orderBy("leader_epoch")))
    found = asof(requests, "asked", after, "leader_epoch", TP, ["leader_epoch", "next_start"])
    joined = found.join(log_bounds.select(*TP, "log_end"), TP)
    end = F.when(F.col("leader_epoch").isNull(), -1).otherwise(F.coalesce("next_start", "log_end"))
    return joined.select(*TP, "asked", F.col("leader_epoch").alias("epoch"), end.alias("end_offset"))


def acknowledge(batches: DataFrame, replicas: DataFrame, least: int) -> DataFrame:
    """Batches with the ``answer`` to a producer that waits for all replicas in sync (topic, partition_id, high_watermark, n_in_sync) until its time is up: refused where fewer than ``least`` are."""
    answer = (
        F.when(F.col("n_in_sync") < least, "not enough replicas")
        .when(F.col("base_offset") + F.col("last_offset_delta") < F.col("high_watermark"), "acknowledged")
        .otherwise("timed out")
    )
    return batches.join(F.broadcast(replicas.select(*TP, "high_watermark", "n_in_sync")), TP).withColumn("answer", answer)  # a row per partition


def metadata(segments: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Partitions of each topic, sorted. Asked for all, internal topics (``__...``) are hidden; asked for by name, they are shown, and an
    unknown name gives an error row."""
    listed = segments.select(*TP).distinct().groupBy("topic").agg(F.sort_array(F.collect_list("partition_id")).alias("partitions"))
    if requested is None:
        return listed.where(~F.col("topic").startswith("__")).withColumn("error", F.lit(OK))
    asked = requested.select("topic").distinct().join(listed, "topic", "left")
    return asked.withColumn("error", F.when(F.col("partitions").isNull(), UNKNOWN_TOPIC).otherwise(OK))


def resolve_start(log_bounds: DataFrame, wanted: list[str]) -> DataFrame:
    """Start offsets for ``earliest``, ``latest`` or a number, per partition."""
    what = F.explode(F.array(*[F.lit(w) for w in wanted]))
    at = F.when(F.col("start") == "earliest", F.col("log_start")).when(F.col("start") == "latest", F.col("log_end")).otherwise(F.col("start").try_cast("bigint"))
    return log_bounds.select(*TP, "log_start", "log_end", what.alias("start")).select(*TP, "start", at.alias("start_offset"))


def produce(requests: DataFrame, log_bounds: DataFrame) -> DataFrame:
    """Errors and base offsets of produce requests (request_id, topic, partition_id, magic, crc_ok, record_count), per row.

    The broker gives the base offset: requests of a partition follow each other in the order of request_id, the refused ones take none.
    """
    joined = requests.join(log_bounds.select(*TP, "log_end"), TP, "left")
    code = F.when(F.col("log_end").isNull(), NOT_LEADER).when(~F.col("crc_ok") | (F.col("magic") != 2), CORRUPT).when(F.col("record_count") < 1, UNKNOWN).otherwise(OK)
    coded = joined.withColumn("error", code).withColumn("taken", F.when(F.col("error") == OK, F.col("record_count")).otherwise(0).cast("bigint"))
    placed = chunked_running_sum(coded, TP, "request_id", "taken", "earlier")
    return placed.select("request_id", *TP, "error", F.when(F.col("error") == OK, F.col("log_end") + F.col("earlier")).otherwise(-1).alias("base_offset"))


def create_topics(requests: DataFrame, existing: DataFrame, defaults: dict[str, int | None]) -> DataFrame:
    """Codes of topic creation requests (topic, partition_count, overrides, ``compact``) and the settings that result: overrides that are null or below 1 mean the default (null: no limit), as does a
    ``compact`` that is null."""
    from tidelog.functions.names import usable_name

    known = existing.select("topic").distinct().withColumn("there", F.lit(True))
    code = F.when(~usable_name(F.col("topic")) | (F.col("partition_count") < 1), INVALID_TOPIC).when(F.col("there"), TOPIC_EXISTS).otherwise(OK)
    joined = requests.join(known, "topic", "left").withColumn("error", code).drop("there")
    chosen = joined.withColumns({c: F.when(F.coalesce(F.col(c), F.lit(0)) >= 1, F.col(c)).otherwise(F.lit(v)).cast("bigint") for c, v in defaults.items()})
    return chosen.withColumn("cleanup", F.coalesce(F.col("compact"), F.lit(False)).cast("tinyint")).drop("compact")


def error_text(code: Column) -> Column:
    """What an error code means."""
    out = F.lit("unrecognised error code")
    for k, text in ERRORS.items():
        out = F.when(code == k, text).otherwise(out)
    return out


# The requests of the protocol by number; all have version 0 only.
APIS = {
    0: "Produce",
    1: "Fetch",
    2: "ListOffsets",
    3: "Metadata",
    8: "OffsetCommit",
    9: "OffsetFetch",
    10: "FindCoordinator",
    11: "JoinGroup",
    12: "Heartbeat",
    13: "LeaveGroup",
    14: "SyncGroup",
    19: "CreateTopic",
}
#: Partitions of the topic that keeps committed positions.
OFFSETS_PARTITIONS = 8


def list_offsets(requests: DataFrame, log_bounds: DataFrame) -> DataFrame:
    """Answers to (topic, partition_id, timestamp): -2 is the log start, -1 the log end; a search by time isn't offered and is an error."""
    joined = requests.join(log_bounds.select(*TP, "log_start", "log_end"), TP, "left")
    at = F.col("timestamp")
    code = F.when(F.col("log_end").isNull(), UNKNOWN_TOPIC).when(~at.isin(-2, -1), UNKNOWN).otherwise(OK)
    return joined.withColumn("error", code).select(*requests.columns, "error", F.when(F.col("error") != OK, -1).when(at == -2, F.col("log_start")).otherwise(F.col("log_end")).alias("answer"))


def supported(requests: DataFrame) -> DataFrame:
    """Requests (api, version) with their error code: another number or version isn't supported."""
    known = F.col("api").isin(*APIS) & (F.col("version") == 0)
    return requests.withColumn("error", F.when(known, OK).otherwise(9))


def visible(records: DataFrame, ceilings: DataFrame, follower: bool = False) -> DataFrame:
    """What a reader may see: a consumer what lies below the high watermark (topic, partition_id, high_watermark, log_end), a follower everything."""
    top = F.col("log_end") if follower else F.col("high_watermark")
    return records.join(F.broadcast(ceilings.select(*TP, "high_watermark", "log_end")), TP).where(F.col("log_offset") < top).drop("high_watermark", "log_end")  # a row per partition


def settings(meta: DataFrame, fallback: dict[str, int]) -> DataFrame:
    """Settings of each topic: what its own metadata say wins over the fallback."""
    return meta.select("topic", *[F.coalesce(F.col(c), F.lit(v)).cast("bigint").alias(c) for c, v in fallback.items()]).distinct()


def follow(batches: DataFrame, ends: DataFrame) -> DataFrame:
    """Batches a follower appends unchanged (topic, partition_id, base_offset, last_offset_delta) onto its own end: the first must begin
    there and each where the one before ended; from the first that doesn't, all of the partition are refused."""
    onto = batches.join(F.broadcast(ends.select(*TP, F.col("log_end").alias("__end"))), TP)  # a row per partition
    lagged = chunked_lag(onto, TP, "base_offset", F.col("base_offset") + F.col("last_offset_delta") + 1, "__expected")
    bad = F.col("base_offset") != F.coalesce("__expected", "__end")
    first = lagged.where(bad).groupBy(*TP).agg(F.min("base_offset").alias("__first_bad"))
    return lagged.join(F.broadcast(first), TP, "left").withColumn("accepted", F.col("__first_bad").isNull() | (F.col("base_offset") < F.col("__first_bad"))).drop("__first_bad", "__expected", "__end")
