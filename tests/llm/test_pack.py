"""Packing against a plain first-fit decreasing, and its invariants."""

from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.llm import pack


def plain(sizes, capacity):
    """First-fit decreasing over whole items, bin by bin."""
    bins = []
    for n in sorted(sizes, reverse=True):
        for i, used in enumerate(bins):
            if used + n <= capacity:
                bins[i] += n
                break
        else:
            bins.append(n)
    return bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 70))
def test_equals_plain_first_fit_decreasing(sizes, capacity):
    used = defaultdict(int)
    for _, _, n, b in pack.first_fit_decreasing(list(range(len(sizes))), sizes, capacity):
        used[b] += n
    assert [used[b] for b in range(len(used))] == plain(sizes, capacity)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=40), st.integers(1, 100))
def test_nothing_is_lost_or_cut_without_need(sizes, capacity):
    rows = pack.first_fit_decreasing(list(range(len(sizes))), sizes, capacity)
    total, used, pieces = defaultdict(int), defaultdict(int), defaultdict(list)
    for i, k, n, b in rows:
        total[i] += n
        pieces[i].append((k, n))
        if b is None:
            assert n == 0
        else:
            used[b] += n
    assert [total[i] for i in range(len(sizes))] == sizes
    assert all(u <= capacity for u in used.values()) and sorted(used) == list(range(len(used)))
    for i, n in enumerate(sizes):
        assert len(pieces[i]) == max(1, -(-n // capacity)) and [k for k, _ in sorted(pieces[i])] == list(range(len(pieces[i])))


def test_groups(spark):
    sizes = spark.range(3_000).select(F.col("id").alias("doc_id"), (F.col("id") * 7919 % 900).cast("int").alias("n_tokens"), F.lit("x").alias("bin"))
    packs = spark.createDataFrame([("s", 256, 1), ("l", 2048, 2), ("bad", 0, 3), ("none", None, 4), ("s", 256, 9)], "pack_name string, capacity_tokens int, pack_group int")
    packed = pack.pack_sizes(sizes.select("doc_id", "n_tokens"), packs, 3_000, 500)
    report = {r["pack_name"]: r for r in pack.pack_report(packed).collect()}
    assert set(report) == {"s", "l"}
    whole = sizes.agg(F.sum("n_tokens")).first()[0]
    for name, capacity in (("s", 256), ("l", 2048)):
        r = report[name]
        assert r["n_tokens"] == whole and r["max_used"] <= capacity and r["n_bins"] >= r["least_bins"]
        assert packed.where(F.col("pack_name") == name).select("doc_id").distinct().count() == 3_000
    assert report["l"]["fill"] > 0.98
    again = pack.pack_sizes(sizes.select("doc_id", "n_tokens").repartition(7), packs, 3_000, 500)
    assert sorted(map(tuple, packed.collect()), key=repr) == sorted(map(tuple, again.collect()), key=repr)


def test_repeated_and_missing_ids_and_empty_tables(spark):
    sizes = spark.createDataFrame([(1, 10), (1, 10), (None, 5), (2, 0), (3, 25)], "doc_id bigint, n_tokens int")
    packs = spark.createDataFrame([("p", 10)], "pack_name string, capacity_tokens int")
    got = pack.pack_sizes(sizes, packs, 5)
    assert sorted((r["doc_id"], r["piece"], r["n_tokens"]) for r in got.collect()) == [(1, 0, 10), (1, 0, 10), (2, 0, 0), (3, 0, 10), (3, 1, 10), (3, 2, 5)]
    assert got.where("bin is null").count() == 1 and got.where("bin is not null").select("bin").distinct().count() == 5
    assert pack.pack_sizes(sizes.limit(0), packs, 0).count() == pack.pack_sizes(sizes, packs.limit(0), 5).count() == 0


def test_documents(spark, data, vocabulary):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    packed = pack.pack_documents(docs, spark.read.parquet(f"{data}/pack_sizes.parquet"))
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert all(r["max_used"] <= r["capacity_tokens"] for r in pack.pack_report(packed).collect())
