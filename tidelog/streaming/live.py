"""Live versions: offsets, consumption, K-slack, compacted view and group coordinator on Structured Streaming.

Each takes a streaming DataFrame and writes to a folder with a checkpoint; run with ``availableNow`` they catch up and end, and their result
equals that of the batch operator. Groups and windowed counts keep their state per key in the state store; offsets, the K-slack buffer and the compacted view keep it in
files, numbered by epoch, and spread a key over tasks, as each micro-batch is a step of the batch operator. A micro-batch is read under the limits of its source (``maxFilesPerTrigger``), which bound what one key brings at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.common import CHUNK_OFFSETS, Manifest, asof, chunked_lag, chunked_running_sum, ship
from tidelog.operators import kslack, log, lsm
from tidelog.operators.groups import EVENTS, RESULTS, names


def read_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table of a folder as a stream of its files."""
    sample = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    reader = spark.readStream.schema(sample.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    path = f"{sf_dir}/{name}.parquet"
    is_folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if is_folder.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(is_folder).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_to_end(out: DataFrame, base: str, mode: str = "append") -> DataFrame:
    """Run what is there to a folder and read it."""
    query = out.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{base}/out")


def give_offsets(stream: DataFrame, order: str, base: str, block: int = CHUNK_OFFSETS) -> DataFrame:
    """``partition_id``, ``order`` (a bigint) and ``log_offset``: the next numbers of each partition, in the given order within a micro-batch; kept in ``base``, from which it goes on after any stop.

    A micro-batch is appended by the batch operator, in slices of ``block`` of the order, so a partition that brings most of it is spread. Where each log ends lies in files, numbered by epoch in a manifest.
    """
    spark, manifest = stream.sparkSession, Manifest(stream.sparkSession, f"{base}/steps")
    out, ends = f"partition_id int, {order} bigint, log_offset bigint", "partition_id int, log_end bigint"
    read = lambda step, what, schema: spark.read.schema(schema).parquet(f"{base}/{step}/{what}") if step else spark.createDataFrame([], schema)

    def number(batch: DataFrame, epoch: int) -> None:
        if epoch + 1 in manifest.versions():
            return
        name, was = f"step{epoch:09d}-{uuid.uuid4().hex}", read(manifest.read(epoch + 1)[1].get("step"), "ends", ends)
        log.append(batch, F.col("partition_id"), [order], F.floor(F.col(order) / block), was).select("partition_id", order, "log_offset").write.parquet(f"{base}/{name}/out")
        new = read(name, "out", out).groupBy("partition_id").agg((F.max("log_offset") + 1).alias("log_end"))  # a row per partition
        was.unionByName(new).groupBy("partition_id").agg(F.max("log_end").alias("log_end")).write.parquet(f"{base}/{name}/ends")
        if not manifest.add(epoch + 1, {"step": name}):
            raise RuntimeError(f"another query has taken step {epoch} in {base}")

    rows = stream.select(F.col("partition_id").cast("int"), F.col(order).cast("bigint"))
    rows.writeStream.foreachBatch(number).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    parts = [read(manifest.read(v + 1)[1]["step"], "out", out) for v in manifest.versions()]
    return reduce(DataFrame.unionByName, parts) if parts else read(None, "out", out)


TIMED = "topic string, partition_id int, batch_base bigint, log_offset bigint, size_bytes int, e bigint, seen bigint"
SLACK_STATE = {
    "held": "topic string, partition_id int, batch_base bigint, log_offset bigint, e bigint, size_bytes int",
    "progress": "topic string, partition_id int, progress bigint, open_base bigint, open_top bigint",
    "spans": "topic string, partition_id int, lo bigint, hi bigint",
    "periods": "topic string, period_ms bigint, n_final bigint, bytes_final bigint",
}
SLACK_OUT = {
    "out": "topic string, partition_id int, kind string, log_offset bigint, e bigint",
    "published": "topic string, period_ms bigint, n_final bigint, bytes_final bigint, n_held bigint, bytes_held bigint",
}
TP = kslack.TP


class KSlack:
    """The K-slack buffer on a stream of records with event times (TIMED), in a folder from which it goes on after any stop.

    Each micro-batch is one step of the batch operator, from the state that the step before left in files: the records held in the buffer, the progress of each partition, the spans of
    offsets met so far, and the final values of periods. ``out`` gets ``late`` records and ``released`` ones; ``published`` the values of all periods after the step, final ones from what was released and
    provisional ones from the buffer.

    A batch of the log may come in several micro-batches: the top of the newest batch of a partition waits in the state until a later batch begins. A record that was met before is known by
    its offset and does nothing. A partition that holds most of the stream is spread by chunks, as the step is the batch operator. Steps are numbered by epoch in a manifest: a micro-batch that is run
    again after its step was published does nothing.
    """

    def __init__(self, spark: SparkSession, base: str, slack_ms: int = kslack.CUTOFF_MS, period_ms: int = kslack.PERIOD_MS, chunk: int = CHUNK_OFFSETS) -> None:
        self.spark, self.base, self.slack_ms, self.period_ms, self.chunk = spark, base, slack_ms, period_ms, chunk
        self.manifest = Manifest(spark, f"{base}/steps")

    def _read(self, step: str | None, name: str) -> DataFrame:
        schema = (SLACK_STATE | SLACK_OUT)[name]
        return self.spark.read.schema(schema).parquet(f"{self.base}/{step}/{name}") if step else self.spark.createDataFrame([], schema)

    def step(self, batch: DataFrame, epoch: int) -> None:
        if epoch + 1 in self.manifest.versions():
            return
        was = self.manifest.read(epoch + 1)[1].get("step")
        name = f"step{epoch:09d}-{uuid.uuid4().hex}"

        def keep(df: DataFrame, what: str) -> DataFrame:
            df.select(*[c.split()[0] for c in (SLACK_STATE | SLACK_OUT).get(what, TIMED).split(", ")]).write.parquet(f"{self.base}/{name}/{what}")
            return self._read(name, what) if what != "new" else self.spark.read.schema(TIMED).parquet(f"{self.base}/{name}/new")

        spans, progress = self._read(was, "spans"), self._read(was, "progress")
        fresh = batch.where("e is not null").dropDuplicates([*TP, "log_offset"])
        new = keep(asof(fresh, "log_offset", spans, "lo", TP, ["hi"], self.chunk).where("hi is null or log_offset > hi"), "new")
        # the newest batch of each partition may go on: it takes part again, by its top alone
        ghost = progress.where("open_base is not null").select(*TP, F.col("open_base").alias("batch_base"), F.lit(None).cast("bigint").alias("log_offset"), F.lit(None).cast("int").alias("size_bytes"), F.lit(None).cast("bigint").alias("e"), F.col("open_top").alias("seen"))
        told = kslack.reorder(new.unionByName(ghost), self.slack_ms, self.chunk, progress)
        tops = new.unionByName(ghost).groupBy(*TP, "batch_base").agg(F.max("seen").alias("top"))
        newest = tops.groupBy(*TP).agg(F.max(F.struct("batch_base", "top")).alias("open"))  # a row per partition
        done = tops.join(newest, TP).where(F.col("batch_base") < F.col("open.batch_base")).groupBy(*TP).agg(F.max("top").alias("done"))
        now = newest.join(done, TP, "left").join(progress.select(*TP, "progress"), TP, "left").select(*TP, F.greatest("progress", "done").alias("progress"), F.col("open.batch_base").alias("open_base"), F.col("open.top").alias("open_top"))
        now = keep(now.unionByName(progress.join(newest, TP, "left_anti")), "progress")
        late = told.where(F.col("kind") == kslack.LATE).select(*TP, "kind", "log_offset", "e")
        waiting = told.where(F.col("kind") != kslack.LATE).select(*TP, "batch_base", "log_offset", "e", "size_bytes").unionByName(self._read(was, "held"))
        waiting = waiting.join(now.select(*TP, "progress"), TP).withColumn("passed", F.coalesce(F.col("e") < F.col("progress") - self.slack_ms, F.lit(False)))
        held = keep(waiting.where("not passed"), "held")
        out = keep(late.unionByName(waiting.where("passed").select(*TP, F.lit(kslack.RELEASED).alias("kind"), "log_offset", "e")), "out")
        period = F.floor(F.col("e") / self.period_ms) * self.period_ms
        sizes = new.select(*TP, "log_offset", "size_bytes").unionByName(self._read(was, "held").select(*TP, "log_offset", "size_bytes"))
        final = out.where(F.col("kind") == kslack.RELEASED).join(sizes, [*TP, "log_offset"]).groupBy("topic", period.alias("period_ms")).agg(F.count(F.lit(1)).alias("n_final"), F.sum(F.col("size_bytes").cast("bigint")).alias("bytes_final"))
        total = self._read(was, "periods").unionByName(final).groupBy("topic", "period_ms").agg(F.sum("n_final").alias("n_final"), F.sum("bytes_final").alias("bytes_final"))
        total = keep(total, "periods")
        waits = held.groupBy("topic", period.alias("period_ms")).agg(F.count(F.lit(1)).alias("n_held"), F.sum(F.col("size_bytes").cast("bigint")).alias("bytes_held"))
        keep(total.join(waits, ["topic", "period_ms"], "full").fillna(0), "published")
        pieces = chunked_lag(spans.unionByName(new.select(*TP, F.col("log_offset").alias("lo"), F.col("log_offset").alias("hi"))), TP, "lo", F.col("hi"), "before", self.chunk)
        begun = pieces.withColumn("begins", F.when(F.col("lo") <= F.col("before") + 1, 0).otherwise(1))
        numbered = chunked_running_sum(begun, TP, "lo", "begins", "earlier", self.chunk)
        keep(numbered.groupBy(*TP, (F.col("earlier") + F.col("begins")).alias("island")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "spans")
        if not self.manifest.add(epoch + 1, {"step": name}):
            raise RuntimeError(f"another query has taken step {epoch} in {self.base}")

    def run(self, timed: DataFrame) -> KSlack:
        """Take in what is there, then end."""
        timed.select(*[c.split()[0] for c in TIMED.split(", ")]).writeStream.foreachBatch(self.step).option("checkpointLocation", f"{self.base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return self

    def _steps(self) -> list[str]:
        return [self.manifest.read(v + 1)[1]["step"] for v in self.manifest.versions()]

    def out(self) -> DataFrame:
        """Late and released records of all steps, with the number of the step."""
        parts = [self._read(s, "out").withColumn("step", F.lit(k)) for k, s in enumerate(self._steps())]
        return reduce(DataFrame.unionByName, parts) if parts else self._read(None, "out").withColumn("step", F.lit(0))

    def published(self) -> DataFrame:
        """Values of all periods after the last step."""
        return self._read(next(iter(self._steps()[::-1]), None), "published")


def compacted_view(changes: DataFrame, base: str, buckets: int) -> DataFrame:
    """Apply a stream of changes (topic, partition_id, rec_key, seq, rec_value) to the table in ``base``, a sorted run for each micro-batch, and read the present rows.

    The table's manifest is numbered by epoch: a micro-batch that is run again after a failure finds its run there, or else writes it; after a restart the table goes on from the folder.
    """
    view = lsm.Table(changes.sparkSession, f"{base}/table", buckets)
    changes.writeStream.foreachBatch(lambda batch, epoch: view.append(batch, epoch + 1)).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return view.present()


def staged(rows: DataFrame, part: Column, parts: int, path: str) -> DataFrame:
    """``rows`` as a stream that comes in ``parts`` micro-batches, by the number ``part`` of each row: a file after the other, as a log grows."""
    spark = rows.sparkSession
    numbered = rows.withColumn("__part", part)
    for k in range(parts):
        numbered.where(F.col("__part") == k).drop("__part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def starting_at(stream: DataFrame, resumed: DataFrame) -> DataFrame:
    """The stream from where ``log.resume`` says (topic, partition_id, error, resume_at); fails where a position is past the end or there is no such partition."""
    if wrong := [tuple(r) for r in resumed.where("error <> 0").select(*TP, "error").collect()]:  # a row per partition
        raise ValueError(f"can't read from these positions (topic, partition, error): {wrong}")
    return stream.join(F.broadcast(resumed.select(*TP, F.col("resume_at").alias("__from"))), TP).where("log_offset >= __from").drop("__from")


def consume(stream: DataFrame, base: str, handle: Callable[[DataFrame, int], None], at_most_once: bool = False, follow: Callable[[], bool] | None = None, poll_ms: int = 200) -> int:
    """Hand every micro-batch to ``handle`` and return how many there were. Ends when all is read, or with ``follow`` goes on, looking for more every ``poll_ms``, as long as that says so.

    At least once: the position is committed after the output, so a crash in between hands the batch out again. At most once: an epoch
    whose mark is already there is passed over, and the mark is set before the output.
    """
    spark, seen = stream.sparkSession, []
    hadoop = spark._jvm.org.apache.hadoop.fs

    def one(batch: DataFrame, epoch: int) -> None:
        if at_most_once:
            mark = hadoop.Path(f"{base}/marks/{epoch}")
            if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(mark):
                return
        handle(batch, epoch)
        seen.append(epoch)

    when = {"processingTime": f"{poll_ms} milliseconds"} if follow else {"availableNow": True}
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{base}/checkpoint").trigger(**when).start()
    while not query.awaitTermination(poll_ms / 1000) if follow else query.awaitTermination():
        if not follow():
            query.stop()
    return len(seen)


def consume_group(stream: DataFrame, group: str, base: str, handle: Callable[[DataFrame, int], None], positions: str, committed: DataFrame | None = None) -> int:
    """Consume for a group, from its ``committed`` positions (group_id, topic, partition_id, next_offset) or else from offset 0: after the output of a micro-batch, its next offsets are
    added to the commits at ``positions``.

    A batch handed out again commits the same positions under the same epoch, in the same place.
    """
    if committed is not None:
        mine = committed.where(F.col("group_id") == group).select(*TP, F.col("next_offset").alias("__from"))  # a row per partition
        stream = stream.join(F.broadcast(mine), TP, "left").where(F.col("log_offset") >= F.coalesce("__from", F.lit(0))).drop("__from")

    def one(batch: DataFrame, epoch: int) -> None:
        handle(batch, epoch)
        ends = batch.groupBy(*TP).agg((F.max("log_offset") + 1).alias("next_offset"))
        ends.select(F.lit(epoch).cast("bigint").alias("seq"), F.lit(group).alias("group_id"), *TP, "next_offset").write.mode("overwrite").parquet(f"{positions}/group={group}/epoch={epoch}")

    return consume(stream, base, one)


def coordinate(events: DataFrame, late: str = "1 second") -> DataFrame:
    """The group coordinator over a stream of group events (EVENTS with ``issued``), one state per group, forgotten when its last member is gone.

    A group that falls silent expires by timer: when the watermark, ``late`` behind the newest event of any group, has passed the deadline of a member, a row with the op ``timer``
    and no ``seq`` tells what became of the group.
    """
    ship(events.sparkSession)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        from tidelog.operators import groups as g

        group = g.Group.loads(state.get[0]) if state.exists else g.Group()
        now = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            gone = group.expire(now)
            rows = [(None, key[0], "timer", ",".join(sorted(gone)), g.NONE, group.generation, group.state, len(group.members), group.leader, group.protocol, "", [])]
        else:
            rows = [g.apply_event(group, e) for e in pd.concat(list(parts)).sort_values("seq").itertuples()]
        if group.members:
            state.update((group.dumps(),))
            state.setTimeoutTimestamp(max(group.deadline_ms(), now + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=g.names(g.RESULTS)).astype({"seq": "Int64"})

    timed = events.select(*names(EVENTS)).withColumn("__at", F.timestamp_millis("ts_ms")).withWatermark("__at", late)
    return timed.groupBy("group_id").applyInPandasWithState(run, RESULTS, "value string", "append", GroupStateTimeout.EventTimeTimeout)


def hourly_counts(stream: DataFrame, time: str, key: str, late: str = "2 hours") -> DataFrame:
    """Counts per hour and key with a watermark; an hour is given out once it can't change any more."""
    windowed = stream.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", late)
    return windowed.groupBy(F.window("__at", "1 hour"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), key, "n")
