"""Log-structured merge of a change feed into the present rows of a table.

Changes carry a key, a sequence that orders the changes of that key, and a value, null for a delete. Every slice of the
feed becomes one immutable *run* in the table's folder: the newest change of each key of the slice, hashed into buckets and sorted by
key and sequence in each. Keys are sorted by two independent 64-bit hashes of topic, partition and key (among 10**12 keys the chance that any two share both
is under 10**-14). Reading merges the sorted runs k ways: the place of each run's entries among those of the others is found by binary search, the
newest change of each key stays and is dropped if it is a tombstone. When a run is to be added to more than ``MAX_RUNS``, a compaction first merges those that are there into one. The list
of runs is a manifest that is replaced whole, so a table is read and extended by any later application, and of two writers one has to begin anew.

Scale: changes of a key are combined before the shuffle, so the hottest key is one row per task and slice. Merging reads hashes, sequence and the mark of a delete, 25 bytes a change
whatever the size of keys and values; buckets follow from the number of changes, so that one holds about ``BUCKET_ROWS`` per run. Keys and values are joined to
the changes that won by their place in the log. Repeated changes (same key and sequence) are one; the order in which changes arrive has no effect, as the sequence decides.

Nulls and odd input: changes with a null key name no row and are left out; an empty key is a key, an empty value is a
value; an empty feed gives an empty table.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.common import Manifest, shared_dir, ship

MAX_RUNS = 1
BUCKET_ROWS = 500_000
RUN = "topic string, partition_id int, rec_key binary, seq bigint, deleted boolean, rec_value binary, high bigint, low bigint, bucket int"
ENTRY = "bucket int, run int, high bigint, low bigint, seq bigint, deleted boolean, topic string, partition_id int"
KEY = ["topic", "partition_id", "rec_key"]
TP = KEY[:2]


def _newest(changes: DataFrame, buckets: int) -> DataFrame:
    """The newest change of each key, in its bucket."""
    return (
        changes.dropna(subset=[*KEY, "seq"])
        .groupBy(*KEY)
        .agg(F.max(F.struct("seq", F.col("rec_value").isNull().alias("deleted"), "rec_value")).alias("c"))
        .select(*KEY, "c.*", F.xxhash64(*KEY).alias("high"), F.xxhash64(F.lit("low"), *KEY).alias("low"))
        .withColumn("bucket", F.pmod("high", F.lit(buckets)).cast("int"))
    )


def merged(runs: list[np.ndarray]) -> np.ndarray:
    """Sorted runs of (high, low, seq, ...) merged into one in that order: each entry moves up by the entries of the other runs below it."""
    out = runs[0]
    for other in runs[1:]:
        # binary search by the first half of the key; where it is equal, the other half and the sequence decide, one step for all at a time
        at, end = np.searchsorted(out["high"], other["high"], "left"), np.searchsorted(out["high"], other["high"], "right")
        open_ = np.nonzero(end > at)[0]
        while len(open_):
            x, y = out[at[open_]], other[open_]
            open_ = open_[(x["low"] < y["low"]) | ((x["low"] == y["low"]) & (x["seq"] <= y["seq"]))]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        both = np.empty(len(out) + len(other), out.dtype)
        places = at + np.arange(len(other))
        rest = np.ones(len(both), bool)
        rest[places] = False
        both[places], both[rest] = other, out
        out = both
    return out


def newest_of(entries: np.ndarray) -> np.ndarray:
    """The last entry of each key of a merged run."""
    if not len(entries):
        return entries
    same = (entries["high"][1:] == entries["high"][:-1]) & (entries["low"][1:] == entries["low"][:-1])
    return entries[np.concatenate((~same, [True]))]


_SORTED = np.dtype([("high", "<i8"), ("low", "<i8"), ("seq", "<i8"), ("at", "<i8")])


def _merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """k-way merge of the runs of a bucket: the newest change of each key."""
    runs = []
    for _, places in sorted(rows.groupby("run").indices.items()):
        part = np.empty(len(places), _SORTED)
        part["at"] = places
        for c in ("high", "low", "seq"):
            part[c] = rows[c].to_numpy("int64")[places]
        # a run's file is sorted; where the shuffle brought its pieces in another order they are put back
        if (np.diff(part["high"]) < 0).any() or ((np.diff(part["high"]) == 0) & (np.diff(part["low"]) <= 0)).any():
            part.sort(order=("high", "low", "seq"))
        runs.append(part)
    return rows.iloc[newest_of(merged(runs))["at"]] if runs else rows


class Table:
    """A table of present rows in a folder: its runs and their manifest. Objects hold nothing but the folder's name."""

    def __init__(self, spark: SparkSession, base: str | None = None, buckets: int = 1) -> None:
        """``buckets`` is taken for a new table; one that is there keeps its own."""
        self.spark, self.base = spark, base or shared_dir(spark, "lsm")
        self.manifest = Manifest(spark, f"{self.base}/manifest")
        self.buckets = self.manifest.read()[1].get("buckets", buckets)

    def runs(self, before: int | None = None) -> list[str]:
        return self.manifest.read(before)[1].get("runs", [])

    def _write(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        rows.repartition("bucket").sortWithinPartitions("bucket", "high", "low", "seq").write.parquet(f"{self.base}/{name}")
        return name

    def append(self, changes: DataFrame, version: int | None = None) -> None:
        """Add one sorted run of ``changes`` (topic, partition_id, rec_key, seq, rec_value), after a compaction if there are enough runs.

        ``version`` names the step, counted from 1: taking a step that the manifest already has does nothing.
        """
        now, content = self.manifest.read(version)
        step = version or now + 1
        if version and version in self.manifest.versions():
            return
        runs = content.get("runs", [])
        if len(runs) > MAX_RUNS:
            runs = [self._write(self._rows(runs))]
        runs = [*runs, self._write(_newest(changes, self.buckets))]
        if not self.manifest.add(step, {"runs": runs, "buckets": self.buckets}):
            raise RuntimeError(f"another writer has changed {self.base}")

    def winners(self, runs: list[str]) -> DataFrame:
        """Newest change of every key over ``runs``, tombstones included, without keys and values (ENTRY)."""
        ship(self.spark)
        union = None
        for k, r in enumerate(runs):
            part = self.spark.read.schema(RUN).parquet(f"{self.base}/{r}").select("bucket", F.lit(k).alias("run"), "high", "low", "seq", "deleted", *TP)
            union = part if union is None else union.unionByName(part)
        return self.spark.createDataFrame([], ENTRY) if union is None else union.groupBy("bucket").applyInPandas(_merge, ENTRY)

    def _rows(self, runs: list[str], present: bool = False) -> DataFrame:
        """The changes that won, whole."""
        every = self.spark.read.schema(RUN).parquet(*[f"{self.base}/{r}" for r in runs]) if runs else self.spark.createDataFrame([], RUN)
        won = self.winners(runs).where("not deleted" if present else "true").select("high", "low", "seq")
        return every.join(won, ["high", "low", "seq"], "left_semi").dropDuplicates(["high", "low", "seq"]) if len(runs) > 1 else every.where("not deleted" if present else "true")

    def present(self) -> DataFrame:
        """The rows that are there: KEY, ``seq`` and ``rec_value``."""
        return self._rows(self.runs(), True).select(*KEY, "seq", "rec_value")

    def places(self) -> DataFrame:
        """``topic``, ``partition_id`` and ``seq`` of the rows that are there, without reading keys or values."""
        return self.winners(self.runs()).where("not deleted").select(*TP, "seq")


def apply_feed(changes: DataFrame, slices: int = 3, base: str | None = None) -> Table:
    """Append the feed slice by slice to the table in ``base``, or a new one."""
    size = changes.agg(F.count(F.lit(1)), F.min("seq"), F.max("seq")).first()
    n, lo, hi = size[0], size[1] or 0, size[2] or 0
    table = Table(changes.sparkSession, base, max(1, -(-n // BUCKET_ROWS)))
    width = (hi - lo) // slices + 1
    for k in range(slices):
        table.append(changes.where(F.col("seq").between(lo + k * width, lo + (k + 1) * width - 1)))
    return table


def present_rows(changes: DataFrame, slices: int = 3) -> DataFrame:
    """Apply the whole feed slice by slice and read the table: KEY, ``seq`` and ``rec_value`` of each row that is there."""
    return apply_feed(changes, slices).present()
