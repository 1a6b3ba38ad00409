"""Reading, appending, segments, retention and compaction on small logs with known answers."""

import pytest
from pyspark.sql import functions as F

from tidelog.common import asof, chunked_lag, chunked_running_max, chunked_running_sum
from tidelog.functions import names, varint
from tidelog.operators import compaction, log, retention, segments
from tidelog.sources.generator import generate, read_lines


def rows(df):
    return sorted(tuple(r) for r in df.collect())


SEGMENTS = "topic string, partition_id int, base_offset bigint, next_offset bigint, size_bytes bigint, max_ts_ms bigint, sealed boolean"
META = "topic string, max_segment_bytes bigint, max_segment_age_ms bigint, index_interval_bytes bigint, retention_ms bigint, retention_bytes bigint, cleanup tinyint, delete_retention_ms bigint"


def meta(spark, cleanup=0, retention_ms=10_000, retention_bytes=None, horizon=1_000):
    return spark.createDataFrame([("t", 400, 10**9, 100, retention_ms, retention_bytes, cleanup, horizon)], META)


def forty(spark, first_ts=100_000):
    """40 records of 116 bytes, a second apart, in segments of four; the last is active."""
    out = []
    for k in range(10):
        newest = (first_ts if k == 0 and first_ts > 10**12 else 100_000) + (4 * k + 3) * 1000 if k else max(first_ts, 103_000)
        out.append(("t", 0, 4 * k, 4 * k + 4, 464, newest, k < 9))
    return spark.createDataFrame(out, SEGMENTS)


def test_retention_by_age(spark):
    judged = retention.by_both(forty(spark), meta(spark), 139_000)
    assert rows(retention.new_bounds(judged)) == [("t", 0, 28, 1392, 3, 7)]


def test_retention_by_size(spark):
    judged = retention.by_both(forty(spark), meta(spark, retention_ms=10**12, retention_bytes=1_500), 139_000)
    assert rows(retention.new_bounds(judged)) == [("t", 0, 28, 1392, 3, 7)]


def test_a_time_in_the_future_blocks_age_but_not_size(spark):
    odd = forty(spark, first_ts=9 * 10**12)
    assert retention.by_age(odd, meta(spark, retention_ms=1_000), 139_000).where("expired").count() == 0
    judged = retention.by_both(odd, meta(spark, retention_ms=1_000, retention_bytes=1_500), 139_000)
    assert retention.new_bounds(judged).first()["size_bytes"] <= 1_500


def test_retention_never_takes_the_active_segment_or_a_compacted_topic(spark):
    judged = retention.by_both(forty(spark), meta(spark, retention_ms=0, retention_bytes=1), 10**15)
    assert rows(judged.where("not (expired or evicted)").select("base_offset")) == [(36,)]
    assert retention.by_age(forty(spark), meta(spark, cleanup=1), 10**15).count() == 0


def test_segments_without_times_stop_the_walk_unless_empty(spark):
    df = spark.createDataFrame([("t", 0, 0, 0, 0, -1, True), ("t", 0, 0, 4, 9, -1, True), ("t", 0, 4, 8, 9, 1, True), ("t", 0, 8, 9, 9, 1, False)], SEGMENTS)
    # the empty segment goes, the one without times stays and shields the next
    assert retention.by_age(df.orderBy("next_offset"), meta(spark), 10**12).where("expired").count() <= 1


RECORDS = "log_offset bigint, rec_key string, rec_value string, segment_base bigint, ts_ms bigint"


def compacted(spark, records, active_base, now=6_500, horizon=1_000):
    bases = sorted({r[3] for r in records})
    segs = spark.createDataFrame([("t", 0, b, b, 1, 1, b != active_base) for b in bases], SEGMENTS)
    df = spark.createDataFrame(records, RECORDS).select(
        F.lit("t").alias("topic"), F.lit(0).alias("partition_id"), "log_offset", F.col("rec_key").cast("binary").alias("rec_key"),
        F.col("rec_value").cast("binary").alias("rec_value"), "segment_base", F.timestamp_millis("ts_ms").alias("ts"),
    )
    return compaction.judged(df, segs, meta(spark, cleanup=1, horizon=horizon), now)


def kept(judged):
    return [r[0] for r in sorted(judged.where("retained").select("log_offset").collect())]


def test_compaction_walk(spark):
    log_ = [(0, "a", "1", 0, 1), (1, "b", "1", 0, 1), (2, "a", "2", 2, 1), (3, "c", "1", 2, 1), (4, "d", "1", 4, 1), (5, "e", "1", 4, 1)]
    judged = compacted(spark, log_, 4)
    assert kept(judged) == [1, 2, 3, 4, 5]
    assert rows(compaction.holes(judged.where("retained")).select("log_offset", "missing")) == [(1, 1)]
    assert rows(compaction.pass_report(judged)) == [("t", 0, 3, 1, 3, 1, 0, 1)]


def test_the_active_segment_is_no_newer_copy(spark):
    log_ = [(0, "a", "1", 0, 1), (1, "b", "1", 0, 1), (2, "a", "2", 2, 1)]
    assert kept(compacted(spark, log_, 2)) == [0, 1, 2]


def test_a_segment_may_be_emptied(spark):
    log_ = [(i, "a", str(i), i // 2 * 2, 1) for i in range(6)]
    judged = compacted(spark, log_, 4)
    assert kept(judged) == [3, 4, 5]
    assert judged.transform(compaction.pass_report).first()["n_removed"] == 1


def test_reading_crosses_a_hole_at_the_end_of_a_segment(spark):
    log_ = [(0, "a", "1", 0, 1), (1, "b", "1", 0, 1), (2, "b", "2", 2, 1), (3, "c", "1", 2, 1), (4, "d", "1", 4, 1), (5, "e", "1", 4, 1)]
    assert kept(compacted(spark, log_, 4)) == [0, 2, 3, 4, 5]


@pytest.mark.parametrize(("now", "there"), [(5_500, [0]), (6_500, [])])
def test_tombstones_wait_for_their_horizon(spark, now, there):
    assert [x for x in kept(compacted(spark, [(0, "a", None, 0, 5_000), (1, "z", "1", 1, 1)], 1, now)) if x == 0] == there


def test_superseded_tombstones_go_and_empty_values_and_keyless_records_stay(spark):
    log_ = [(0, "a", None, 0, 6_499), (1, "a", "1", 0, 1), (2, "b", "", 0, 1), (3, None, "x", 0, 1), (4, None, None, 0, 1), (5, "", None, 0, None), (6, "q", "1", 6, 1)]
    assert kept(compacted(spark, log_, 6)) == [1, 2, 3, 4, 6]


@pytest.mark.parametrize(("cleanup", "broken"), [(0, 1), (1, 0)])
def test_a_missing_segment(spark, cleanup, broken):
    df = spark.createDataFrame([("t", 0, 0, 4, 1, 1, True), ("t", 0, 8, 12, 1, 1, False)], SEGMENTS)
    assert segments.contiguity(df, meta(spark, cleanup)).where("broken").count() == broken


def test_overlapping_segments_are_always_wrong(spark):
    df = spark.createDataFrame([("t", 0, 0, 5, 1, 1, True), ("t", 0, 4, 12, 1, 1, False)], SEGMENTS)
    assert segments.contiguity(df, meta(spark, 1)).where("broken").count() == 1


def test_appending_is_dense_per_partition_and_goes_on(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("p"))
    out = log.append(df, F.col("p").cast("int"), ["id"], F.floor(F.col("id") / 50))
    for p in range(3):
        got = [tuple(r) for r in out.where(F.col("partition_id") == p).orderBy("id").select("id", "log_offset").collect()]
        assert [o for _, o in got] == list(range(len(got)))
    ends = spark.createDataFrame([(0, 10)], "partition_id int, log_end bigint")
    more = log.append(df, F.col("p").cast("int"), ["id"], F.floor(F.col("id") / 50), ends)
    assert more.where("partition_id = 0").agg(F.min("log_offset")).first()[0] == 10
    assert more.where("partition_id = 1").agg(F.min("log_offset")).first()[0] == 0


def test_offsets_at_the_ends(spark):
    bounds = spark.createDataFrame([("t", 0, 5, 10)], "topic string, partition_id int, log_start bigint, log_end bigint")
    asked = spark.createDataFrame([("t", 0, o) for o in (4, 5, 10, 11)] + [("u", 0, 0)], "topic string, partition_id int, fetch_offset bigint")
    got = {(r["topic"], r["fetch_offset"]): (r["error"], r["place"]) for r in log.status(asked, bounds).collect()}
    assert got == {("t", 4): (2, "below_start"), ("t", 5): (0, "inside"), ("t", 10): (0, "at_end"), ("t", 11): (2, "above_end"), ("u", 0): (5, "unknown")}


def test_a_read_returns_at_least_one_batch_and_passes_holes(spark):
    batches = spark.createDataFrame([("t", 0, 0, 1, 88), ("t", 0, 2, 1, 88), ("t", 0, 10, 0, 88)], "topic string, partition_id int, base_offset bigint, last_offset_delta int, batch_length int")
    asked = spark.createDataFrame([("t", 0, o, n) for o, n in ((0, 1), (1, 200), (0, 10_000), (3, 100), (5, 1), (11, 1))], "topic string, partition_id int, fetch_offset bigint, max_bytes int")
    got = {(r["fetch_offset"], r["max_bytes"]): (r["first_base"], r["last_read"], r["bytes_read"]) for r in log.fetch_batches(asked, batches).collect()}
    assert got == {(0, 1): (0, 1, 100), (1, 200): (0, 3, 200), (0, 10_000): (0, 10, 300), (3, 100): (2, 3, 100), (5, 1): (10, 10, 100)}


def test_gaps_of_lost_batches_and_segments(spark):
    """A log of ten batches of two that has lost the third, the fifth and the sixth; and one of four segments that has lost the second."""
    left = spark.createDataFrame([("t", 0, 2 * k, 1) for k in range(10) if k not in (2, 4, 5)], "topic string, partition_id int, base_offset bigint, last_offset_delta int")
    assert rows(segments.gaps(left).select("base_offset", "expected", "gap")) == [(6, 4, 2), (12, 8, 4)]
    kept_ = spark.createDataFrame([("t", 0, b, b + 4, 1, 1, True) for b in (0, 8, 12)], SEGMENTS)
    assert rows(segments.missing(kept_)) == [("t", 0, 8, 4)]


def test_batches_as_they_are_dumped(spark):
    records = spark.createDataFrame([("t", 0, 0, b, o, v) for b, o, v in ((0, 1, b"x"), (0, 2, None), (4, 6, b"y"))], "topic string, partition_id int, segment_base bigint, batch_base bigint, log_offset bigint, rec_value binary")
    batches = spark.createDataFrame([("t", 0, 0, 0, 88, 5), ("t", 0, 0, 4, 38, 6)], "topic string, partition_id int, segment_base bigint, base_offset bigint, batch_length int, max_timestamp bigint")
    got = compaction.dump_batches(records, batches).select("base_offset", "position", "bytes", "n_records", "first_offset", "last_offset", "n_tombstones", "n_holes", "n_missing")
    assert rows(got) == [(0, 0, 100, 2, 1, 2, 1, 1, 1), (4, 100, 50, 1, 6, 6, 0, 1, 3)]


def test_readers_go_on_where_something_is_left(spark):
    bounds = spark.createDataFrame([("t", 0, 5, 10)], "topic string, partition_id int, log_start bigint, log_end bigint")
    asked = spark.createDataFrame([("t", 0, o) for o in (4, 5, 10, 11)] + [("u", 0, 0)], "topic string, partition_id int, fetch_offset bigint")
    assert {(r["topic"], r["fetch_offset"]): (r["error"], r["resume_at"]) for r in log.resume(asked, bounds).collect()} == {("t", 4): (0, 5), ("t", 5): (0, 5), ("t", 10): (0, 10), ("t", 11): (2, None), ("u", 0): (5, None)}


def test_a_full_index_drops_entries_or_closes_the_segment(spark):
    batches = spark.createDataFrame([("t", 0, k, 0, 88, 1, 0, k) for k in range(12)], "topic string, partition_id int, base_offset bigint, last_offset_delta int, batch_length int, max_timestamp bigint, segment_base bigint, ms bigint").withColumn("append_ts", F.timestamp_millis("ms"))
    limits = meta(spark).withColumn("max_segment_bytes", F.lit(10**9).cast("bigint")).withColumn("index_interval_bytes", F.lit(200).cast("bigint"))
    assert [r["rel_offset"] for r in segments.sparse_index(batches, limits).orderBy("rel_offset").collect()] == [2, 4, 6, 8, 10]
    assert [r["rel_offset"] for r in segments.sparse_index(batches, limits, 2).orderBy("rel_offset").collect()] == [2, 4]
    assert sorted({r["segment_base"] for r in segments.roll(batches, limits, 2).collect()}) == [0, 5, 10]


def test_answers_to_producers_that_wait_for_all(spark):
    batches = spark.createDataFrame([("t", p, b, 1) for p in (0, 1) for b in (0, 2)], "topic string, partition_id int, base_offset bigint, last_offset_delta int")
    replicas = spark.createDataFrame([("t", 0, 3, 2), ("t", 1, 9, 1)], "topic string, partition_id int, high_watermark bigint, n_in_sync int")
    assert rows(log.acknowledge(batches, replicas, 2).select("partition_id", "base_offset", "answer")) == [(0, 0, "acknowledged"), (0, 2, "timed out"), (1, 0, "not enough replicas"), (1, 2, "not enough replicas")]


def test_truncating_to_nothing_restarts_at_the_cut(spark):
    batches = spark.createDataFrame([("t", 0, 4, 3), ("t", 0, 8, 3)], "topic string, partition_id int, base_offset bigint, last_offset_delta int")
    cut = lambda at: spark.createDataFrame([("t", 0, at)], "topic string, partition_id int, cut bigint")
    assert rows(segments.truncate(batches, cut(6))[1]) == [("t", 0, 6, 6, 0, 2)]
    assert rows(segments.truncate(batches, cut(8))[1]) == [("t", 0, 8, 8, 1, 1)]


def test_names(spark):
    df = spark.createDataFrame([("orders-3",), ("my-topic-5",), ("orders-03",), ("orders-",), ("-3",), ("a b-1",), (None,)], "n string")
    topic, partition = names.parsed_directory(F.col("n"))
    assert rows(df.select("n", topic, partition).where("n is not null")) == [("-3", None, None), ("a b-1", None, None), ("my-topic-5", "my-topic", 5), ("orders-", None, None), ("orders-03", None, None), ("orders-3", "orders", 3)]
    good = spark.createDataFrame([("a",), ("..",), (".",), ("a/b",), ("",), ("a\n",)], "n string").where(names.usable_name(F.col("n")))
    assert rows(good) == [("a",)]


def test_varint_sizes(spark):
    values = [0, -1, 63, 64, -64, -65, 8191, 8192, 2**31 - 1, -(2**31), 2**63 - 1, -(2**63)]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v bigint").orderBy("i").select(varint.varint_size(F.col("v"))).collect()]
    assert got == [1, 1, 1, 2, 1, 2, 2, 3, 5, 5, 10, 10]


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_chunked_running_values(spark, chunk):
    df = spark.range(50).select((F.col("id") % 2).alias("g"), F.col("id").alias("o"), ((F.col("id") * 7) % 11).alias("v"))
    for name, fn, fold in (("m", chunked_running_max, max), ("s", chunked_running_sum, lambda x: sum(x))):
        for r in fn(df, ["g"], "o", "v", name, chunk).collect():
            before = [(o * 7) % 11 for o in range(r["o"]) if o % 2 == r["g"]]
            assert r[name] == (fold(before) if before else (None if name == "m" else 0))


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_chunked_lag(spark, chunk):
    df = spark.range(40).select((F.col("id") % 3).alias("g"), (F.col("id") * 2).alias("o"), F.when(F.col("id") % 5 != 0, F.col("id")).alias("v"))
    for r in chunked_lag(df, ["g"], "o", F.col("v"), "before", chunk).collect():
        k = r["o"] // 2 - 3
        assert r["before"] == (None if k < 0 or k % 5 == 0 else k)


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_asof(spark, chunk):
    table = spark.createDataFrame([(0, 5, "a"), (0, 9, "b"), (1, 0, "c")], "g int, o bigint, name string")
    points = spark.createDataFrame([(0, 4), (0, 5), (0, 8), (0, 50), (1, 0), (2, 1), (0, 5)], "g int, at bigint")
    got = [tuple(r) for r in asof(points, "at", table, "o", ["g"], ["name"], chunk).collect()]
    assert sorted(got, key=repr) == sorted([(0, 4, None), (0, 5, "a"), (0, 5, "a"), (0, 8, "a"), (0, 50, "b"), (1, 0, "c"), (2, 1, None)], key=repr)


def test_generator_and_lines(spark, tmp_path):
    g = generate(spark, 24)
    assert g.count() == 24 and g.select("rec_key").distinct().count() == 10
    assert g.select(F.octet_length("rec_value")).distinct().collect()[0][0] == 40
    (tmp_path / "lines.txt").write_text("a\n\nb\n")
    assert sorted(bytes(r["rec_value"]) for r in read_lines(spark, str(tmp_path / "lines.txt"), "t").collect()) == [b"", b"a", b"b"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SEGMENTS)
    assert log.bounds(none).count() == log.metadata(none).count() == segments.contiguity(none, meta(spark)).count() == 0
    assert compaction.dirty_ratio(none, spark.createDataFrame([], "topic string, partition_id int, mark bigint")).count() == 0


def test_cleaned_segments_take_the_place_of_old_ones(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    old = spark.createDataFrame([("t", 0, o // 2 * 2, o) for o in range(8)], "topic string, partition_id int, segment_base bigint, log_offset bigint")
    old.write.partitionBy("topic", "partition_id", "segment_base").parquet(path)
    cleaned = old.where("log_offset not in (0, 4, 5)")
    touched = spark.createDataFrame([("t", 0, 0), ("t", 0, 4)], "topic string, partition_id int, segment_base bigint")
    compaction.replace_segments(cleaned, touched, path)
    assert [r[0] for r in sorted(spark.read.parquet(path).select("log_offset").collect())] == [1, 2, 3, 6, 7]
    with pytest.raises(LookupError):  # segment 4 is gone by now
        compaction.replace_segments(cleaned.where("log_offset <> 1"), touched, path)
    assert spark.read.parquet(path).count() == 5


def test_a_follower_refuses_from_the_first_gap_on(spark):
    ends = spark.createDataFrame([("t", 0, 4), ("t", 1, 0)], "topic string, partition_id int, log_end bigint")
    sent = spark.createDataFrame([("t", 0, 4, 1), ("t", 0, 6, 0), ("t", 0, 8, 0), ("t", 0, 9, 0), ("t", 1, 2, 0)], "topic string, partition_id int, base_offset bigint, last_offset_delta int")
    got = {(r["partition_id"], r["base_offset"]): r["accepted"] for r in log.follow(sent, ends).collect()}
    assert got == {(0, 4): True, (0, 6): True, (0, 8): False, (0, 9): False, (1, 2): False}
