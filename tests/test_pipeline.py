"""The pipeline operators against brute force, on odd and skewed input."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.operators import chunking, dedup, kslack, ledger, lsm

REC = "topic string, partition_id int, log_offset bigint, batch_base bigint, offset_delta int, timestamp_delta bigint, rec_key binary, rec_value binary, size_bytes int, e string, high string, slice string"
BAT = "topic string, partition_id int, base_offset bigint, first_timestamp bigint, append_ms bigint, producer_id bigint, producer_epoch smallint, base_sequence int, prefix string"


def make(spark, seed, n_batches=60, hot=0.4, slow=5_000):
    """A log with late records, clocks ahead, repeated messages, rows written twice, nulls, and columns of clashing names."""
    r = random.Random(seed)
    records, batches, offset = [], [], {}
    for _ in range(n_batches):
        p = 0 if r.random() < hot else r.randint(1, 3)
        base, n = offset.get(p, r.choice([0, 100])), r.randint(1, 5)
        offset[p] = base + n
        now = 1_000_000 + 1000 * len(batches)
        first = -1 if r.random() < 0.1 else now - r.randint(0, slow * 3)
        batches.append(("t", p, base, first, now, r.choice([-1, 1, 1, 2]), 0, r.choice([0, 3, 2**31 - 2]), "x"))
        for d in range(n):
            key = r.choice([None, b"", b"hot", b"hot", b"hot", str(r.randint(0, 9)).encode()])
            records.append(("t", p, base + d, base, d, r.choice([0, -slow, slow, 7]), key, r.choice([None, b"", b"v"]), r.randint(1, 99), "e", "h", "s"))
    twice = [r.choice(records) for _ in range(20)], [r.choice(batches) for _ in range(5)]
    odd = [(None, None, None, None, None, None, None, None, None, None, None, None), ("t", 9, 5, 5, 0, 0, b"k", b"v", 1, None, None, None)]
    all_r = records + twice[0] + odd
    r.shuffle(all_r)
    df = spark.createDataFrame(all_r, REC)
    bat = spark.createDataFrame(batches + twice[1] + [(None,) * 9], BAT).withColumn("append_ts", F.timestamp_millis("append_ms")).drop("append_ms")
    return records, batches, df, bat


def found(df):
    got = [tuple(r) for r in df.select("topic", "partition_id", "log_offset").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize(("seed", "chunk"), [(1, 65_536), (2, 1), (3, 7)])
def test_late_records(spark, seed, chunk):
    records, batches, df, bat = make(spark, seed)
    heads = {(b[1], b[2]): b for b in batches}
    want = set()
    for p in range(4):
        progress = None
        for _, _, base, first, now, *_ in sorted(b for b in batches if b[1] == p):
            own = [x for x in records if x[1] == p and x[3] == base]
            es = [(x, first + x[5]) for x in own] if first != -1 else []
            want |= {x[:3] for x, e in es if progress is not None and e < progress - 6_000}
            progress = max([e for _, e in es if e <= now] + ([progress] if progress is not None else []), default=None)
    assert heads and found(kslack.k_slack(df, bat, 6_000, chunk).where("kind = 'late'")) == want


@pytest.mark.parametrize(("seed", "chunk"), [(1, 65_536), (2, 1), (3, 7)])
def test_the_buffer_step_by_step(spark, seed, chunk):
    """Against a heap that takes one batch after the other: what is refused, which batch releases what, in which order."""
    records, batches, df, bat = make(spark, seed)
    got = kslack.k_slack(df, bat, 6_000, chunk).where("partition_id < 9").collect()
    assert len({(r["partition_id"], r["log_offset"]) for r in got}) == len(got)
    for p in range(4):
        progress, heap, want, batch_of = None, [], {}, {x[2]: x[3] for x in records if x[1] == p}
        for _, _, base, first, now, *_ in sorted(b for b in batches if b[1] == p):
            es = [(first + x[5], x[2]) for x in records if x[1] == p and x[3] == base] if first != -1 else []
            for e, o in es:
                if progress is not None and e < progress - 6_000:
                    want[o] = ("late", None)
                else:
                    heapq.heappush(heap, (e, o))
            progress = max([e for e, _ in es if e <= now] + ([progress] if progress is not None else []), default=None)
            while heap and progress is not None and heap[0][0] < progress - 6_000:
                want[heapq.heappop(heap)[1]] = ("released", base)
        want |= {o: ("held", None) for _, o in heap}
        mine = {r["log_offset"]: (r["kind"], r["released_by"]) for r in got if r["partition_id"] == p}
        assert set(mine) == set(want)
        for o, (kind, by) in want.items():
            # a chunk hands on what a later one releases
            assert mine[o] == (kind, by) or (kind == "released" and mine[o] == ("held", None) and batch_of[o] // chunk < by // chunk)


def test_periods_add_up(spark):
    records, batches, df, bat = make(spark, 4)
    p = kslack.period_values(df, bat, 6_000, 10_000).agg(*[F.sum(c).alias(c) for c in ("n_records", "n_first", "n_corrected", "n_beyond", "n_released")]).first()
    timed = sum(1 for x in records if next(b for b in batches if b[1] == x[1] and b[2] == x[3])[3] != -1)
    assert p["n_records"] + p["n_beyond"] == timed and p["n_first"] + p["n_corrected"] == p["n_records"] and p["n_released"] <= p["n_records"]


def copies_of(records, batches):
    seen, out = {}, set()
    heads = {(b[1], b[2]): b for b in batches}
    for x in sorted(records, key=lambda x: (x[1], x[2])):
        b = heads[x[1], x[3]]
        if b[5] != -1:
            name = (x[1], b[5], b[6], (b[7] + x[4]) % 2**31)
            if name in seen:
                out.add(x[:3])
            seen.setdefault(name, x[2])
    return out


@pytest.mark.parametrize("slices", [1, 3, 7])
def test_copies(spark, slices):
    records, batches, df, bat = make(spark, 5)
    want = copies_of(records, batches)
    assert want and found(dedup.copies(df, bat, slices)) == want
    kept = found(dedup.deduplicated(df, bat).where("topic is not null and partition_id < 9"))
    assert kept == {x[:3] for x in records} - want


def test_one_message_with_most_copies(spark):
    n = 30_000
    df = spark.range(n).select(F.lit("t").alias("topic"), F.lit(0).alias("partition_id"), F.col("id").alias("log_offset"), F.col("id").alias("batch_base"), F.lit(0).alias("offset_delta"))
    bat = spark.range(n).select(
        F.lit("t").alias("topic"), F.lit(0).alias("partition_id"), F.col("id").alias("base_offset"), F.lit(1).cast("bigint").alias("producer_id"), F.lit(0).cast("smallint").alias("producer_epoch"),
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).cast("int").alias("base_sequence"),
    )
    got = dedup.copies(df, bat)
    # 0, 2, 4, ... are one message, of which 7 (odd) is another copy
    assert got.count() == n // 2 and got.agg(F.min("log_offset")).first()[0] == 2


def test_runs_are_immutable_and_merged_and_keep_their_first_offsets(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PREFIX_IDS", 1)
    r = random.Random(3)
    values = [r.randint(-(2**63), 2**63 - 1) for _ in range(60)]
    index, first, written = dedup.Index(spark), {}, {}
    for k in range(7):
        ids = [(100 * k + i, v, v % 7 - 3) for i, v in enumerate(r.sample(values, 20) + [5, 5])]
        met = dedup.Index(spark, index.base).ingest(spark.createDataFrame(ids, "log_offset bigint, high bigint, low bigint"))
        again = {x["high"]: x["first_offset"] for x in met.collect()}
        assert set(again) == {v for _, v, _ in ids if v in first} | {5}
        for o, v, _ in ids:
            first.setdefault(v, o)
        assert all(o == first[v] for v, o in again.items())
        runs = index.runs()
        assert len(runs) <= dedup.MAX_RUNS + 1
        bits = index.manifest.read()[1]["bits"]
        for run in runs:
            held = [x for p in range(1 << bits) if (x := dedup.read_prefix(index.base, run, p))]
            rows = [(*pair.item(), int(o)) for ids_, offsets in held for pair, o in zip(ids_, offsets, strict=True)]
            assert written.setdefault((run, bits), rows) == rows and len({x[:2] for x in rows}) == len(rows)  # what was written stays as it is
    assert sum(len(rows) for (run, bits_), rows in written.items() if run in runs and bits_ == bits) == len(first) == index.manifest.read()[1]["n"]
    assert bits > 4  # prefixes were cut finer as the index grew


def test_a_second_call_takes_only_what_is_new(spark):
    records, batches, df, bat = make(spark, 5)
    want, base = copies_of(records, batches), dedup.Index(spark).base
    old = found(dedup.copies(df.where("log_offset < 60"), bat, 2, base))
    new = found(dedup.copies(df.where("log_offset >= 55"), bat, 2, base))  # some come again
    assert old == {x for x in want if x[2] < 60} and new == {x for x in want if x[2] >= 55}


@pytest.mark.parametrize(("chunk", "block"), [(16_384, 16_384), (3, 5), (1, 1)])
def test_per_key_results(spark, chunk, block):
    records, _, df, _ = make(spark, 6)
    rows = df.select("topic", "rec_key", "partition_id", "log_offset", "size_bytes")
    got = {bytes(r["rec_key"]): r for r in chunking.per_key(rows, ["topic", "rec_key"], ["topic", "partition_id"], "log_offset", "size_bytes", chunk, block).where("topic = 't'").collect()}
    keys = {x[6] for x in records if x[6] is not None}
    assert set(got) == keys | {b"k"}
    for k in keys:
        sizes = [x[8] for x in sorted(records, key=lambda x: (x[1], x[2])) if x[6] == k]
        steps = [b - a for a, b in zip(sizes, sizes[1:], strict=False)]
        r = got[k]
        assert (r["n_rows"], r["total"], r["first_value"], r["last_value"]) == (len(sizes), sum(sizes), sizes[0], sizes[-1])
        assert (r["n_changes"], r["max_step"]) == (sum(s != 0 for s in steps), max(steps, default=None))


def test_heavy_keys(spark):
    _, _, df, _ = make(spark, 7)
    commits = spark.createDataFrame([(i, "g", "t", 0 if i < 4 else i, 1) for i in range(10)] + [(0, "g", "t", 0, 1), (99, "h", "t", 1, 1)], "seq bigint, group_id string, topic string, partition_id int, next_offset bigint")
    got = {tuple(r) for r in chunking.heavy_keys(df, commits, 0.2).collect()}
    assert ("commit", "t", 0, "g") in got and ("commit", "t", 1, "h") in got and ("record", "t", -1, b"hot".hex().upper()) in got
    assert len([g for g in got if g[0] == "commit"]) == 2


def changes(spark, rows):
    return spark.createDataFrame([("t", 0, k, s, v) for k, s, v in rows], "topic string, partition_id int, rec_key binary, seq bigint, rec_value binary")


@pytest.mark.parametrize("slices", [1, 3, 8])
def test_changes_in_any_order(spark, slices):
    r = random.Random(slices)
    feed = [(str(r.randint(0, 20)).encode(), s, r.choice([None, b"", b"x", str(s).encode()])) for s in range(300)] + [(b"", 300, b"e"), (b"gone", 301, None)]
    present = {}
    for k, s, v in feed:
        present[k] = (s, v)
    want = {(k, s, v) for k, (s, v) in present.items() if v is not None}
    mixed = feed + feed[:50] + [(None, 5, b"nobody")]
    r.shuffle(mixed)
    got = lsm.present_rows(changes(spark, mixed), slices)
    assert {(bytes(x["rec_key"]), x["seq"], bytes(x["rec_value"])) for x in got.collect()} == want and got.count() == len(want)


@pytest.mark.parametrize("k", [1, 2, 5])
def test_sorted_runs_are_merged(k):
    r = np.random.default_rng(k)
    runs = []
    for n in r.integers(0, 40, k):
        run = np.zeros(n, lsm._SORTED)
        run["high"], run["low"], run["seq"], run["at"] = r.integers(-3, 3, n), r.integers(-2, 2, n), r.integers(0, 9, n), r.integers(0, 99, n)
        runs.append(np.sort(run, order=("high", "low", "seq")))
    out = lsm.merged(runs)
    key = lambda x: (x["high"], x["low"], x["seq"])
    assert [key(x) for x in out] == sorted(key(x) for run in runs for x in run)
    assert sorted(x["at"] for x in out) == sorted(x["at"] for run in runs for x in run)
    assert [(x["high"], x["low"]) for x in lsm.newest_of(out)] == sorted({(x["high"], x["low"]) for x in out})


def test_a_table_goes_on_in_later_calls(spark):
    base = lsm.Table(spark).base
    there = lambda t: {bytes(x["rec_key"]): x["seq"] for x in t.present().collect()}
    assert there(lsm.apply_feed(changes(spark, [(b"a", 1, b"x"), (b"b", 2, b"y")]), 1, base)) == {b"a": 1, b"b": 2}
    assert there(lsm.apply_feed(changes(spark, [(b"a", 3, None), (b"c", 4, b"")]), 1, base)) == {b"b": 2, b"c": 4}
    assert len(lsm.Table(spark, base).runs()) == 2
    # an older change that comes late doesn't win, and the runs are merged by the next
    assert there(lsm.apply_feed(changes(spark, [(b"a", 2, b"late"), (b"b", 1, b"late"), (b"d", 9, b"new")]), 2, base)) == {b"b": 2, b"c": 4, b"d": 9}
    assert sorted((r["topic"], r["seq"]) for r in lsm.Table(spark, base).places().collect()) == [("t", 2), ("t", 4), ("t", 9)]


def test_an_empty_feed(spark):
    assert lsm.present_rows(changes(spark, [])).count() == 0


COM = "seq bigint, group_id string, topic string, partition_id int, next_offset bigint"


def test_positions_and_work(spark):
    log = spark.range(100).select(F.lit("t").alias("topic"), F.lit(0).alias("partition_id"), (F.col("id") + 50).alias("log_offset"))
    log = log.unionByName(log.limit(30))
    commits = spark.createDataFrame([(1, "a", "t", 0, 60), (2, "a", "t", 0, 140), (2, "a", "t", 0, 140), (3, "a", "t", 0, -5), (1, "b", "t", 0, 70), (2, "b", "t", 0, None), (1, "c", "t", 0, 10), (1, "d", "t", 0, 150), (1, "e", "t", 7, 0), (1, "f", "t", 0, 9_999)], COM)
    got = {(r["group_id"], r["log_offset"]) for r in ledger.unprocessed(commits, log).collect()}
    assert got == {("a", o) for o in range(140, 150)} | {(g, o) for g in "bc" for o in range(50, 150)}
    assert ledger.unprocessed(commits, log).count() == len(got)
    assert ledger.unprocessed(commits, log.limit(0)).count() == ledger.unprocessed(commits.limit(0), log).count() == 0


def offsets_log(spark, n=40):
    return spark.range(n).select(F.lit("t").alias("topic"), F.lit(0).alias("partition_id"), F.col("id").alias("log_offset"))


def test_leases_expire_and_stale_tokens_are_refused(spark):
    book = ledger.Ledger(spark, item=16)
    items = book.extend(spark.createDataFrame([(1, "g", "t", 0, 5)], COM), offsets_log(spark))
    assert sorted((r["block"], r["from_offset"], r["to_offset"]) for r in items.collect()) == [(0, 5, 15), (1, 16, 31), (2, 32, 39)]
    first = book.change(lambda s, _: ledger.lease(s, "one", 0, 100, F.col("block") < 2))
    assert {(r["block"], r["state"], r["token"]) for r in first.collect()} == {(0, "leased", 1), (1, "leased", 1), (2, "pending", 0)}
    assert ledger.expire(first, 99).where("state = 'leased'").count() == 2
    # the worker is lost: its leases run out, and another takes all
    second = book.change(lambda s, _: ledger.lease(ledger.expire(s, 100), "two", 100, 100))
    assert {(r["block"], r["worker"], r["token"]) for r in second.collect()} == {(0, "two", 2), (1, "two", 2), (2, "two", 1)}
    # the lost worker comes back with its old token and changes nothing, nor does one whose own lease has run out
    late = ledger.complete(second, first.where("state = 'leased'"), 110)
    assert late.where("state = 'done'").count() == 0 and late.count() == 3
    assert ledger.complete(second, second, 200).where("state = 'done'").count() == 0
    done = book.change(lambda s, _: ledger.complete(s, second.unionByName(first.where("state = 'leased'")), 120))
    assert done.where("state = 'done'").count() == 3 and done.count() == 3
    # what is done isn't leased again, and a later process finds the ledger by its folder alone
    assert ledger.lease(ledger.expire(done, 10**9), "three", 10**9, 100).where("worker = 'three'").count() == 0
    assert ledger.Ledger(spark, book.base).load().where("state = 'done'").count() == 3


def test_of_two_writers_one_gives_way(spark):
    """Another takes its step between reading and publishing: the slower one takes its own again, on the state of the faster."""
    book, other = (ledger.Ledger(spark, base, 16) for base in [ledger.Ledger(spark).base] * 2)
    book.extend(spark.createDataFrame([(1, "g", "t", 0, 0)], COM), offsets_log(spark))
    tried = []

    def slow(state, n):
        if not tried:
            other.change(lambda s, _: ledger.lease(s, "fast", 0, 100, F.col("block") == 0))
        tried.append(n)
        return ledger.lease(state, "slow", 0, 100)

    got = {r["block"]: r["worker"] for r in book.change(slow).collect()}
    assert tried == [2, 3] and got == {0: "fast", 1: "slow", 2: "slow"}


@pytest.mark.parametrize("dies_after", ["extend", "take", "process", "finish"])
def test_a_crash_between_any_two_steps_neither_skips_nor_repeats(spark, dies_after):
    """The process is lost after a step; another knows the folder only. Then the log grows, and a second run gives just what is new."""
    commits = spark.createDataFrame([(1, "g", "t", 0, 5), (2, "h", "t", 0, None)], COM)
    log, base = offsets_log(spark, 40), ledger.Ledger(spark).base
    book = ledger.Ledger(spark, base, 16)
    book.extend(commits, log)
    if dies_after != "extend":
        held = book.take("one", 0, 100)
        if dies_after != "take":
            book.process(held, log)
        if dies_after == "finish":
            book.finish(held, 50)
    del book
    names = lambda df: sorted((r["group_id"], r["log_offset"]) for r in df.collect())
    want = [("g", o) for o in range(5, 40)] + [("h", o) for o in range(40)]
    ledger.Ledger(spark, base, 16).run(commits, log, "two", 200)  # leases of the lost one have run out
    assert names(ledger.Ledger(spark, base, 16).results()) == want
    assert ledger.Ledger(spark, base, 16).run(commits, log, "three", 300).count() == 0
    more = ledger.Ledger(spark, base, 16).run(commits, offsets_log(spark, 55), "four", 400)
    assert names(more) == [(g, o) for g in "gh" for o in range(40, 55)]
    assert names(ledger.Ledger(spark, base, 16).results()) == sorted(want + names(more))
    assert {r["group_id"]: r["next_offset"] for r in ledger.Ledger(spark, base).positions().collect()} == {"g": 55, "h": 55}


def test_a_restart_within_the_lease_and_a_stale_worker(spark):
    log, commits = offsets_log(spark), spark.createDataFrame([(1, "g", "t", 0, 5)], COM)
    offsets = lambda b: sorted(r["log_offset"] for r in b.results().collect())
    base = ledger.Ledger(spark).base
    book = lambda: ledger.Ledger(spark, base)
    book().extend(commits, log)
    held = book().take("one", 0, 100)
    book().process(held, log)  # ... and the worker dies before it can say so
    assert offsets(book()) == []
    stale = book().take("one", 50, 100)  # it comes back in time and goes on with its lease
    assert stale.select("token", "path").distinct().collect() == held.select("token", "path").distinct().collect()
    book().process(stale, log)
    other = book().take("two", 200, 100)  # it is too slow: another has the items now
    book().process(other, log)
    book().process(stale, log)  # writes where nobody reads
    book().finish(stale, 210)  # refused
    assert offsets(book()) == [] and book().positions().first()["next_offset"] == 5
    book().finish(other, 220)
    assert offsets(book()) == list(range(5, 40)) and book().positions().first()["next_offset"] == 40


def test_several_leases_at_once(spark):
    log, commits = offsets_log(spark, 400), spark.createDataFrame([(1, "g", "t", 0, 0)], COM)
    book = ledger.Ledger(spark, item=16)
    book.extend(commits, log)
    held = [book.take(f"w{k}", 0, 100, ledger.share(k, 3)) for k in range(3)]
    assert sum(h.count() for h in held) == 25 and all(h.count() for h in held)
    for h in held[:2]:
        book.process(h, log)
        book.finish(h, 10)
    assert book.results().count() == 400 - held[2].agg(F.sum(F.col("to_offset") - F.col("from_offset") + 1)).first()[0]
    assert book.positions().first()["next_offset"] == held[2].agg(F.min("from_offset")).first()[0]
    book.process(held[2], log)
    book.finish(held[2], 20)
    assert sorted(r["log_offset"] for r in book.results().collect()) == list(range(400))


def test_empty_tables(spark):
    _, _, df, bat = make(spark, 8)
    none, nob = df.limit(0), bat.limit(0)
    assert kslack.beyond_cutoff(none, nob).count() == kslack.period_values(none, nob).count() == 0
    assert dedup.copies(none, nob).count() == dedup.copies(df, nob).count() == 0
    assert chunking.heavy_keys(none, spark.createDataFrame([], COM)).count() == 0
