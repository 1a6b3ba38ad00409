"""Filters without false negatives, with the promised rate of false positives, and the whole answer against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.llm import ribbon


def fnv(key, start):
    for b in key:
        start = (start ^ b) * ribbon.FNV_PRIME % 2**64
    return start - 2**64 if start >> 63 else start


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=50), max_size=20), st.integers(0, 3))
def test_digests(keys, skip):
    high, low = ribbon.fnv_pair(pa.array(keys, pa.binary())[skip:])
    assert list(zip(high.tolist(), low.tolist(), strict=True)) == [(fnv(k, ribbon.HIGH_START), fnv(k, ribbon.LOW_START)) for k in keys[skip:]]


@pytest.mark.parametrize("n", [0, 1, 2, 100, 20_000])
def test_filter(n):
    r = np.random.default_rng(n)
    keys = np.unique(r.integers(-(2**63), 2**63 - 1, n))
    seed, slots, solution = ribbon.solve(keys)
    assert ribbon.probe(keys, seed, slots, solution).all()
    absent = np.setdiff1d(r.integers(-(2**63), 2**63 - 1, 200_000), keys)
    rate = ribbon.probe(absent, seed, slots, solution).mean()
    assert rate < 3 * 2.0**-ribbon.FINGERPRINT
    assert slots <= n * ribbon.SLACK * 1.05 + 2 * ribbon.WIDTH + 1


REC = "topic string, partition_id int, log_offset bigint, rec_key binary, digest_high bigint, hashed string, nth string"
HIS = "pass_id bigint, topic string, partition_id int, digest_high bigint, digest_low bigint, newest_offset bigint"


def run(spark, records, history, **kwargs):
    got = [tuple(r) for r in ribbon.seen_before(spark.createDataFrame(records, REC), spark.createDataFrame(history, HIS), "g", **kwargs).collect()]
    assert len(got) == len(set(got))
    return set(got)


def told(spark, records, history, **kwargs):
    return {r["generation"]: r for r in ribbon.rates(spark.createDataFrame(records, REC), spark.createDataFrame(history, HIS), "g", **kwargs).collect()}


@pytest.mark.parametrize(("generation", "fan"), [(4_096, 16), (100, 16), (20, 2)])
def test_against_brute_force(spark, generation, fan):
    r = random.Random(generation)
    keys = [None, b"", b"hot", b"hot", b"x" * 5_000] + [str(i).encode() for i in range(80)]
    records = [("g", r.randint(0, 1), o, r.choice(keys), None, "x", "y") for o in range(600)]
    old = [r.choice(keys[1:]) for _ in range(40)]
    history = [(k % 3, "g", k % 2, fnv(x, ribbon.HIGH_START), fnv(x, ribbon.LOW_START), 1) for k, x in enumerate(old)]
    history += [(1, "other", 0, fnv(b"9", ribbon.HIGH_START), fnv(b"9", ribbon.LOW_START), 1), (1, "g", 0, None, None, 1), (1, None, None, 5, 5, 5)]
    past = {(h[2], h[3], h[4]) for h in history if h[1] == "g" and h[3] is not None}
    want, met = set(), set()
    for t, p, o, k, *_ in records:
        if k is not None:
            if (p, k) in met or (p, fnv(k, ribbon.HIGH_START), fnv(k, ribbon.LOW_START)) in past:
                want.add((t, p, o))
            met.add((p, k))
    mixed = records + records[:50] + [("else", 0, 1, b"hot", None, "", ""), ("g", 0, None, b"hot", None, "", "")]
    r.shuffle(mixed)
    assert run(spark, mixed, history, generation=generation, fan=fan) == want


def test_a_key_with_most_rows(spark):
    records = [("g", 0, o, b"hot" if o % 3 else str(o).encode(), None, "", "") for o in range(6_000)]
    assert run(spark, records, []) == {("g", 0, o) for o in range(6_000) if o % 3 and o > 1}


def test_empty_tables(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [("g", 0, 1, b"k", None, "", "")], []) == set()


def test_the_filters_decide(spark, monkeypatch):
    """Filters that hold everything make every first record seen, filters that hold nothing none of a later generation: no other path answers."""
    records = [("g", 0, o, str(o % 50).encode(), None, "", "") for o in range(150)] + [("g", 0, 150 + o, f"new{o}".encode(), None, "", "") for o in range(50)]
    history = [(1, "g", 0, fnv(b"new7", ribbon.HIGH_START), fnv(b"new7", ribbon.LOW_START), 1)]
    right = {("g", 0, o) for o in range(50, 150)} | {("g", 0, 157)}
    assert run(spark, records, history, generation=50, fan=2) == right
    answer = ribbon.answered
    monkeypatch.setattr(ribbon, "answered", lambda asking, filters: answer(asking, filters).withColumn("hit", F.lit(True)))
    assert run(spark, records, history, generation=50, fan=2) == {("g", 0, o) for o in range(200)}
    monkeypatch.setattr(ribbon, "answered", lambda asking, filters: answer(asking, filters).withColumn("hit", F.lit(False)))
    assert run(spark, records, history, generation=50, fan=2) == set()


def test_generations_and_who_asks_them(spark):
    """Four generations of ten keys, the second a repeat of the first, in a tree of fan 2."""
    records = [("g", 0, o, str(o % 10 if o < 20 else o).encode(), None, "", "") for o in range(40)]
    got = told(spark, records, [(5, "g", 0, 1, 2, 3)], generation=10, fan=2)
    assert {k: (r["n_keys"], r["n_asked"]) for k, r in got.items()} == {"log:0:0": (10, 10), "log:0:2": (10, 10), "log:1:0": (10, 20), "past:5": (1, 30)}
    assert all(r["wrong_rate"] < 3 * 2.0**-ribbon.FINGERPRINT and r["wrong_expected"] <= r["n_asked"] * r["wrong_rate"] for r in got.values())


def test_measured_rates(spark, data):
    rates = ribbon.rates(spark.read.parquet(f"{data}/log_records.parquet"), spark.read.parquet(f"{data}/digest_history.parquet")).collect()
    assert sum(r["n_probes"] for r in rates) > 100_000
    rate = sum(r["n_agree"] for r in rates) / sum(r["n_probes"] for r in rates)
    assert 0.5 < rate * 2**ribbon.AUDIT_BITS < 2 and sum(r["wrong_expected"] for r in rates) < 1e-3


def test_query_equals_sql(compare):
    from tidelog.llm import queries

    for name, text in queries.SQL.items():
        compare(queries.QUERIES[name], text)
