"""Assignment, the coordinator's state machine, positions, and their live versions."""

import pytest
from pyspark.sql import functions as F

from tidelog.operators import groups, offsets
from tidelog.operators.groups import Group
from tidelog.plans import reference
from tidelog.streaming import live

MEMBERS = "group_id string, member_id string, topic string"


def assigned(spark, how, wants, counts):
    m = spark.createDataFrame([("g", who, t) for who, ts in wants.items() for t in ts], MEMBERS)
    p = spark.createDataFrame([(t, i) for t, n in counts.items() for i in range(n)], "topic string, partition_id int")
    out = {}
    for r in groups.ASSIGNORS[how](m, p).collect():
        out.setdefault(r["member_id"], []).append((r["topic"], r["partition_id"]))
    return {k: sorted(v) for k, v in out.items()}


def test_range(spark):
    assert assigned(spark, "range", {"a": ["o"], "b": ["o"]}, {"o": 3}) == {"a": [("o", 0), ("o", 1)], "b": [("o", 2)]}
    two = assigned(spark, "range", {"x": ["o", "p"], "y": ["o", "p"]}, {"o": 3, "p": 3})
    assert (len(two["x"]), len(two["y"])) == (4, 2)
    assert assigned(spark, "range", {k: ["o"] for k in "abcd"}, {"o": 2}) == {"a": [("o", 0)], "b": [("o", 1)]}


@pytest.mark.parametrize("how", ["roundrobin", "roundrobin-unequal"])
def test_round_robin(spark, how):
    assert assigned(spark, how, {"a": ["o"], "b": ["o"]}, {"o": 5}) == {"a": [("o", 0), ("o", 2), ("o", 4)], "b": [("o", 1), ("o", 3)]}
    two = assigned(spark, how, {"x": ["o", "p"], "y": ["o", "p"]}, {"o": 3, "p": 3})
    assert (len(two["x"]), len(two["y"])) == (3, 3)


@pytest.mark.parametrize("how", ["range", "roundrobin-unequal"])
def test_members_get_only_what_they_want(spark, how):
    got = assigned(spark, how, {"a": ["o"], "b": ["p"]}, {"o": 2, "p": 2})
    assert got == {"a": [("o", 0), ("o", 1)], "b": [("p", 0), ("p", 1)]}


def join(g, who, now=1_000, topics=("o",), protocols=("range",), timeout=5_000, issued=1):
    e = groups.Event("join", now, who, "c", issued, -1, list(topics), list(protocols), timeout)
    return g.take(e), e.member


def test_expiry_is_by_each_members_own_timeout():
    g = Group()
    join(g, "", issued=0)
    join(g, "", issued=1, timeout=9_000)
    join(g, "c-0")
    assert g.deadline_ms() == 6_000 and g.expire(5_999) == [] and g.expire(6_500) == ["c-0"] and g.state == "preparing"
    assert join(g, "c-1", now=6_500) == (0, "c-1") and g.expire(11_499) == [] and g.expire(20_000) == ["c-1"]
    assert g == Group() and join(g, "c-1")[0] == 13


def test_a_timeout_below_one_is_the_default():
    g = Group()
    join(g, "", issued=0, timeout=0)
    assert g.deadline_ms() == 1_000 + groups.SESSION_MS


def test_what_a_leader_is_told(spark):
    told = {r["seq"]: r["members"] for r in groups.replay_events(reference.history(spark)).collect()}
    assert told[6] == ["a-1", "b-3"] and told[4] == [] and told[11] == [] and told[32] == ["a-7"]


def test_state_round_trip():
    g = Group()
    join(g, "", issued=0)
    join(g, "", issued=1)
    assert Group.loads(g.dumps()) == g


def test_live_coordinator_equals_replay(spark, data, tmp_path):
    """A long history of commits, as a table and as a stream in three parts; watermarks stay behind all of it."""
    events = reference.group_events_of(spark.read.parquet(f"{data}/commits.parquet"))
    columns = groups.names(groups.RESULTS)
    replayed = sorted((tuple(r) for r in groups.replay_events(events).select(*columns).collect()), key=repr)
    stream = live.staged(groups.issue(events), F.floor(F.col("seq") * 3 / (events.agg(F.max("seq")).first()[0] + 1)).cast("int"), 3, f"file://{tmp_path}/in")
    streamed = sorted((tuple(r) for r in live.run_to_end(live.coordinate(stream, "40000 hours"), f"file://{tmp_path}/run").select(*columns).collect()), key=repr)
    assert replayed == streamed and {r[4] for r in replayed} >= {0, 12, 13, 14}


def test_silent_groups_expire_by_timer(spark, tmp_path):
    stream = live.staged(groups.issue(reference.history(spark).drop("issued")), F.floor((F.col("seq") - 1) / 10).cast("int"), 4, f"file://{tmp_path}/in")
    told = live.run_to_end(live.coordinate(stream), f"file://{tmp_path}/run").where("op = 'timer'").collect()
    assert {(r["group_id"], r["member_id"], r["state"], r["n_members"]) for r in told} == {("g", "c-4", "empty", 0), ("h", "b-2", "empty", 0)}


COM = "seq bigint, group_id string, topic string, partition_id int, next_offset bigint, metadata string, commit_ts_ms bigint"


def test_positions(spark):
    c = spark.createDataFrame([(i, "g", "t", i % 4, i, None, 0) for i in range(9000)] + [(9000, "h", "t", 0, 5, "m", 1), (9001, "h", "t", 0, None, None, 1), (9002, "i", "t", 0, 5, None, 1), (9003, "i", "t", 0, -1, None, 1)], COM)
    now = offsets.replay(c)
    assert {(r["group_id"], r["partition_id"]): r["next_offset"] for r in now.collect()} == {**{("g", p): 8996 + p for p in range(4)}, ("i", 0): 5}
    assert [r["group_id"] for r in offsets.forgotten(c).collect()] == ["h"]
    asked = spark.createDataFrame([("g", "t", 9), ("i", "t", 0)], "group_id string, topic string, partition_id int")
    assert {r["group_id"]: r["next_offset"] for r in offsets.fetch_positions(asked, now).collect()} == {"g": -1, "i": 5}


SLACK = "topic string, partition_id int, batch_base bigint, log_offset bigint, size_bytes int, e bigint, seen bigint"


def slack_rows(spark, rows):
    """Rows (batch, offset, e): all times make progress."""
    return spark.createDataFrame([("t", 0, b, o, 10, e, e) for b, o, e in rows], SLACK)


def test_live_slack_over_cut_batches_repeats_and_restarts(spark, tmp_path):
    """A batch that comes in two micro-batches makes its progress when it is over; a record delivered again, even long after, does nothing; each run is a new process on the same folder."""
    src, base = f"file://{tmp_path}/in", f"file://{tmp_path}/run"
    parts = [
        [(0, 0, 1_000), (0, 1, 90_000)],
        [(0, 2, 2_000), (3, 3, 3_000), (3, 4, 100_000)],  # the rest of batch 0 isn't late by its own batch; 3,000 is late by batch 0
        [(0, 0, 1_000), (0, 1, 90_000), (3, 3, 3_000), (5, 5, 95_000)],  # all but the last again
        [(5, 6, 89_000), (7, 7, 200_000), (7, 8, 50_000), (0, 2, 2_000)],
        [(9, 9, 300_000)],
    ]
    told = []
    for part in parts:
        slack_rows(spark, part).coalesce(1).write.mode("append").parquet(src)
        k = live.KSlack(spark, base, 10_000, 60_000, chunk=4).run(spark.readStream.schema(SLACK).parquet(src))
        told.append({(r["kind"], r["log_offset"]) for r in k.out().collect()})
    assert told[0] == set() and told[1] == {("late", 3), ("released", 0), ("released", 2)}  # progress is 90,000 now
    assert told[2] == told[1]  # progress is 100,000, which doesn't pass 90,000 by more than the slack
    rows = live.KSlack(spark, base, 10_000, 60_000, chunk=4).out().collect()
    assert len(rows) == len({r["log_offset"] for r in rows})
    assert {(r["kind"], r["log_offset"]) for r in rows} == {("late", 3), ("late", 8), ("late", 6), *(("released", o) for o in (0, 2, 1, 5, 4))}
    order = [r["e"] for r in sorted(rows, key=lambda r: (r["step"], r["e"])) if r["kind"] == "released"]
    assert order == sorted(order)
    got = {r["period_ms"]: (r["n_final"], r["n_held"]) for r in k.published().collect()}
    assert got == {0: (2, 0), 60_000: (3, 0), 180_000: (0, 1), 300_000: (0, 1)}
    again = k.published().collect()
    k.step(slack_rows(spark, parts[4]), 4)  # a step that was taken
    assert sorted(k.published().collect()) == sorted(again)


def test_live_slack_equals_batch_however_the_stream_is_cut(spark, data, tmp_path):
    from tidelog.operators import kslack

    tables = [spark.read.parquet(f"{data}/{t}.parquet") for t in ("log_records", "batches")]
    timed = kslack.event_times(*tables).where("topic in ('stock-level', 'gate-tokens')")
    ends = timed.groupBy("topic", "partition_id").agg(F.min("log_offset").alias("lo"), F.max("log_offset").alias("hi"))
    cut = timed.join(ends, ["topic", "partition_id"]).withColumn("part", F.floor((F.col("log_offset") - F.col("lo")) * 3 / (F.col("hi") - F.col("lo") + 1)).cast("int"))
    again = cut.where("log_offset % 7 = 0").withColumn("part", F.least(F.col("part") + 1, F.lit(2)))  # some come once more, later
    stream = live.staged(cut.unionByName(again).drop("lo", "hi"), F.col("part"), 3, f"file://{tmp_path}/in")
    k = live.KSlack(spark, f"file://{tmp_path}/run").run(stream)
    want = {tuple(r) for r in kslack.k_slack(*tables).where("kind = 'late' and topic in ('stock-level', 'gate-tokens')").select("topic", "partition_id", "log_offset").collect()}
    rows = k.out().select("topic", "partition_id", "log_offset", "kind").collect()
    assert {tuple(r)[:3] for r in rows if r["kind"] == "late"} == want and len(rows) == len({tuple(r)[:3] for r in rows})


def test_a_compacted_view_goes_on_after_a_restart(spark, tmp_path):
    src, base = f"file://{tmp_path}/in", f"file://{tmp_path}/run"
    schema = "topic string, partition_id int, rec_key binary, seq bigint, rec_value binary"
    view = lambda: {bytes(r["rec_key"]): bytes(r["rec_value"]) for r in live.compacted_view(spark.readStream.schema(schema).parquet(src), base, 2).collect()}
    put = lambda *rows: spark.createDataFrame([("t", 0, k, s, v) for k, s, v in rows], schema).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([], schema).write.parquet(src)
    assert view() == {}
    put((b"a", 1, b"x"), (b"b", 2, b"y"))
    assert view() == {b"a": b"x", b"b": b"y"}
    put((b"c", 3, b"z"), (b"a", 4, None))
    assert view() == view() == {b"b": b"y", b"c": b"z"}
    put((b"b", 1, b"old"))
    put((b"a", 6, b""))
    assert view() == {b"a": b"", b"b": b"y", b"c": b"z"}


def test_consume_again_and_at_most_once(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    spark.range(10).write.parquet(src)
    got = []
    run = lambda once=False, base="a": live.consume(spark.readStream.schema("id bigint").parquet(src), f"file://{tmp_path}/{base}", lambda df, k: got.extend(r[0] for r in df.collect()), once)
    assert run() == 1 and sorted(got) == list(range(10))
    assert run() == 0  # what was committed isn't read again
    spark.range(10, 12).write.mode("append").parquet(src)
    assert run() == 1 and sorted(got) == list(range(12))
    got.clear()
    assert run(True, "b") == 1 and sorted(got) == list(range(12))


def test_following_goes_on_until_told_to_stop(spark, tmp_path):
    src, got = f"file://{tmp_path}/in", []
    spark.range(10).write.parquet(src)

    def handle(df, epoch):
        got.extend(r[0] for r in df.collect())
        if len(got) == 10:
            spark.range(10, 12).write.mode("append").parquet(src)  # comes while the query runs

    assert live.consume(spark.readStream.schema("id bigint").parquet(src), f"file://{tmp_path}/a", handle, follow=lambda: len(got) < 12) == 2 and sorted(got) == list(range(12))


def test_reading_starts_where_something_is_left_or_fails(spark, tmp_path):
    from tidelog.operators import log

    src = f"file://{tmp_path}/in"
    spark.range(5, 10).selectExpr("'t' as topic", "0 as partition_id", "id as log_offset").write.parquet(src)
    stream = lambda: spark.readStream.schema("topic string, partition_id int, log_offset bigint").parquet(src)
    bounds = spark.createDataFrame([("t", 0, 5, 10)], "topic string, partition_id int, log_start bigint, log_end bigint")
    at = lambda o: log.resume(spark.createDataFrame([("t", 0, o)], "topic string, partition_id int, fetch_offset bigint"), bounds)
    for o, first in ((0, 5), (7, 7)):
        got = []
        live.consume(live.starting_at(stream(), at(o)), f"file://{tmp_path}/{o}", lambda df, k, got=got: got.extend(r["log_offset"] for r in df.collect()))
        assert sorted(got) == list(range(first, 10))
    with pytest.raises(ValueError):
        live.starting_at(stream(), at(11))


def test_offsets_given_out_go_on_after_a_restart(spark, tmp_path):
    src, base = f"file://{tmp_path}/in", f"file://{tmp_path}/run"
    for k in range(3):
        spark.range(100 * k, 100 * k + 50).selectExpr("id", "cast(id % 7 = 0 as int) as partition_id").write.mode("append").parquet(src)
        out = live.give_offsets(spark.readStream.schema("id bigint, partition_id int").parquet(src), "id", base, 16)
    for p in (0, 1):
        rows = [tuple(r) for r in out.where(F.col("partition_id") == p).orderBy("id").select("id", "log_offset").collect()]
        assert [o for _, o in rows] == list(range(len(rows))) and len(rows) > 20
