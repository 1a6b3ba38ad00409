"""python -m tidelog COMMAND DIRECTORY ...: look into a directory of segment files, or make one.

    create DIR TOPIC PARTITIONS          make empty partitions with their metadata
    produce DIR TOPIC PARTITION FILE     append the lines of a file, a batch each
    generate DIR TOPIC N [SEGMENT_BYTES] write N generated records
    describe DIR                         partitions with start, end and counts
    consume DIR TOPIC PARTITION [START]  records from earliest, latest or an offset
    dump DIR                             segments with batches, records, holes and tombstones
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import codec, metas
from tidelog.operators import compaction, log
from tidelog.sources.segment_files import register, write_segments

TP = log.TP


def read(spark: SparkSession, root: str) -> DataFrame:
    register(spark)
    return spark.read.format("segments").load(root).where("error is null")


def create(spark: SparkSession, root: str, topic: str, partitions: str) -> None:
    settings = {"max_segment_bytes": 1 << 30, "max_segment_age_ms": 604_800_000, "index_interval_bytes": 4_096, "max_index_bytes": 10 << 20, "retention_ms": 604_800_000, "retention_bytes": None, "delete_delay_ms": 60_000}
    rows = [(topic, p, *settings.values(), 0, 86_400_000) for p in range(int(partitions))]
    metas.write(spark.createDataFrame(rows, metas.META), root)


def _batches(records: DataFrame, segment_base: int) -> tuple[DataFrame, DataFrame]:
    """Records (with ``ts``) and their batches, one each, of a segment."""
    made = records.select(
        *TP, F.col("log_offset").alias("batch_base"), F.lit(0).alias("offset_delta"), F.lit(0).cast("bigint").alias("timestamp_delta"), "rec_key", "rec_value",
        F.array().cast("array<struct<hkey:binary,hvalue:binary>>").alias("headers"), "ts",
    )
    ms = F.coalesce(F.unix_millis("ts"), F.lit(-1))
    return made, made.select(
        *TP, F.col("batch_base").alias("base_offset"), F.lit(segment_base).cast("bigint").alias("segment_base"), F.lit(-1).alias("leader_epoch"), F.lit(0).alias("attributes"), ms.alias("first_timestamp"),
        ms.alias("max_timestamp"), F.lit(-1).cast("bigint").alias("producer_id"), F.lit(-1).alias("producer_epoch"), F.lit(-1).alias("base_sequence"), F.lit(0).alias("last_offset_delta"), F.col("ts").alias("append_ts"),
    )


def produce(spark: SparkSession, root: str, topic: str, partition: str, path: str) -> DataFrame:
    """Lines as records without key, after what is there, in a segment of their own."""
    from tidelog.sources.generator import read_lines

    there = read(spark, root).where((F.col("topic") == topic) & (F.col("partition_id") == int(partition)))
    end = there.agg(F.coalesce(F.max("log_offset") + 1, F.lit(0))).first()[0]
    lines = read_lines(spark, path, topic).withColumns({"__line": F.monotonically_increasing_id(), "ts": F.lit(None).cast("timestamp")})
    numbered = log.append(lines, F.lit(int(partition)), ["__line"], F.shiftright("__line", 33), spark.createDataFrame([(int(partition), end)], "partition_id int, log_end bigint"))
    made, batches = _batches(numbered, end)
    write_segments(codec.encode_batches(made.drop("ts"), batches), root)
    return numbered.agg(F.count(F.lit(1)).alias("n_records"), F.min("log_offset").alias("first_offset"), F.max("log_offset").alias("last_offset"))


def generate(spark: SparkSession, root: str, topic: str, n: str, segment_bytes: str = "700") -> DataFrame:
    """Generated records, a batch each, rolled by size."""
    from tidelog.operators.segments import roll
    from tidelog.sources.generator import generate as records

    made, batches = _batches(records(spark, int(n), topic), 0)
    sizes = codec.encode_batches(made, batches).select(*TP, "base_offset", (F.octet_length("batch") - log.BEFORE_LENGTH).alias("batch_length"))
    limits = spark.createDataFrame([(topic, int(segment_bytes), 10**15, 4_096)], "topic string, max_segment_bytes bigint, max_segment_age_ms bigint, index_interval_bytes bigint")
    rolled = roll(batches.join(sizes, [*TP, "base_offset"]), limits).select(*TP, "base_offset", "segment_base")
    write_segments(codec.encode_batches(made, batches.drop("segment_base").join(rolled, [*TP, "base_offset"])), root)
    return rolled.groupBy(*TP, "segment_base").agg(F.count(F.lit(1)).alias("n_batches")).orderBy("segment_base")


def describe(spark: SparkSession, root: str) -> DataFrame:
    r = read(spark, root)
    return r.groupBy(*TP).agg(F.min("segment_base").alias("log_start"), (F.max("log_offset") + 1).alias("log_end"), F.count(F.lit(1)).alias("n_records")).orderBy(*TP)


def consume(spark: SparkSession, root: str, topic: str, partition: str, start: str = "earliest") -> DataFrame:
    r = read(spark, root).where((F.col("topic") == topic) & (F.col("partition_id") == int(partition)))
    ends = r.groupBy(*TP).agg(F.min("segment_base").alias("log_start"), (F.max("log_offset") + 1).alias("log_end"))
    starts = log.resolve_start(ends, [start]).select(*TP, F.col("start_offset").alias("fetch_offset"))
    text = lambda c: F.coalesce(F.try_to_binary(F.hex(c), F.lit("hex")).cast("string"), F.lit("null")).alias(c)
    return log.fetch_from(r, starts).orderBy("log_offset").select("log_offset", text("rec_key"), text("rec_value"))


def dump(spark: SparkSession, root: str) -> DataFrame:
    r = read(spark, root)
    segments = r.groupBy(*TP, F.col("segment_base").alias("base_offset")).agg((F.max("log_offset") + 1).alias("next_offset"), F.lit(None).cast("bigint").alias("size_bytes"), F.lit(None).cast("boolean").alias("sealed"))
    return compaction.dump(r, segments).drop("size_bytes", "sealed").orderBy(*TP, "segment_base")


COMMANDS = {f.__name__: f for f in (create, produce, generate, describe, consume, dump)}


def main(args: list[str], spark: SparkSession | None = None) -> DataFrame | None:
    if len(args) < 2 or args[0] not in COMMANDS:
        sys.exit(__doc__)
    spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    return COMMANDS[args[0]](spark, *args[1:])


def show(result: DataFrame) -> None:
    """Prints all rows, a partition at a time, with tabs between the columns."""
    marks = str.maketrans({"\n": "\\n", "\r": "\\r", "\t": "\\t"})
    print(*result.columns, sep="\t")
    for row in result.toLocalIterator():
        print(*("NULL" if v is None else str(v).translate(marks) for v in row), sep="\t")


if __name__ == "__main__":
    if (result := main(sys.argv[1:])) is not None:
        show(result)
