"""Exactly one copy of each message that was delivered at least once.

A message is named by topic, partition, producer id, producer epoch and sequence; its 128-bit identifier is two
independent 64-bit hashes of that name (for 10**12 messages the chance that any two share one is under 10**-14). An
index holds, by hash prefix, immutable *runs*: sorted arrays of identifiers. Each incoming slice of the log is
deduplicated in itself, what remains is looked up in the runs of its prefix by binary search, which the task reads from the index's folder, and the novel identifiers alone are
written as a new run; no run is ever changed. When there are more than ``MAX_RUNS`` runs before one is added, they are merged into one.
The list of runs is a manifest that is replaced whole: an index in a folder of the caller's serves any later call, which takes only the slices that are new.

Scale: identifiers are spread by hash prefix, with as many prefixes as keep a prefix near ``PREFIX_IDS`` identifiers; a merge cuts them finer when the index has grown. The index is never
shuffled: a task reads the files of its prefix, whatever the size of the rest.
Copies are combined before the shuffle, so a message delivered a million times is one row there. The copies are then
named by joining identifiers that occurred more than once; those with more than a thousandth of all copies are fewer
than ``HOT_KEYS`` and are joined by broadcast, all others by shuffle, so no hot message lands in one task. Index and verdicts are
files; the loss of an executor repeats a task, never a decision.

Nulls and odd input: records without a batch or with producer_id -1, and rows with a null part of the name, have no
identifier and are never copies; rows written twice, in one call or in several, are one record; of messages that come in several calls the copy of the first call is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.common import HOT_KEYS, Manifest, arrow_fs, materialize, put_file, shared_dir, ship

PREFIX_IDS = 1 << 18
MAX_RUNS = 1
SLICES = 3
NAME = ["topic", "partition_id", "producer_id", "producer_epoch", "sequence"]
OUT = "kind string, prefix int, high bigint, low bigint, first_offset bigint, n bigint"
_PAIR = np.dtype([("high", "<i8"), ("low", "<i8")])


def messages(records: DataFrame, batches: DataFrame) -> DataFrame:
    """Every copy of a message, rows written twice once, with the hashes of its identifier."""
    heads = (
        batches.where("producer_id <> -1")
        .select("topic", "partition_id", F.col("base_offset").alias("batch_base"), "producer_id", "producer_epoch", "base_sequence")
        .dropDuplicates(["topic", "partition_id", "batch_base"])
    )
    batch = ["topic", "partition_id", "batch_base"]
    joined = records.select(*batch, "log_offset", "offset_delta").join(heads, batch).dropDuplicates([*batch, "log_offset"])  # in the shuffle of the join
    # after 2147483647 comes 0
    named = joined.withColumn("sequence", F.pmod(F.col("base_sequence").cast("bigint") + F.col("offset_delta"), F.lit(2**31)))
    whole = named.dropna(subset=[*NAME, "log_offset"])
    return whole.select("topic", "partition_id", "log_offset", F.xxhash64(*NAME).alias("high"), F.xxhash64(F.lit("low"), *NAME).alias("low"))


def _pairs(high, low) -> np.ndarray:
    out = np.empty(len(high), _PAIR)
    out["high"], out["low"] = high, low
    return out


def _search(run: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each id in the sorted run, and whether it is there: binary search by the first half, then the second."""
    lo, hi = np.searchsorted(run["high"], ids["high"], "left"), np.searchsorted(run["high"], ids["high"], "right")
    found = hi > lo
    at = np.minimum(lo, max(0, len(run) - 1))
    if len(run):
        found &= run["low"][at] == ids["low"]
        for i in np.nonzero((hi - lo > 1) & ~found)[0]:  # two ids that share the first half
            span = run["low"][lo[i] : hi[i]]
            k = np.searchsorted(span, ids["low"][i])
            if k < len(span) and span[k] == ids["low"][i]:
                at[i], found[i] = lo[i] + k, True
    return at, found


def _file(base: str, run: str, prefix: int) -> str:
    return f"{base}/{run}/{prefix >> 10}/{prefix}"


def _write(base: str, run: str, prefix: int, ids: np.ndarray, offsets: np.ndarray) -> None:
    """The sorted identifiers of a prefix and their first offsets, as one file of three arrays."""
    put_file(_file(base, run, prefix), ids["high"].tobytes() + ids["low"].tobytes() + offsets.astype("<i8").tobytes())


def read_prefix(base: str, run: str, prefix: int) -> tuple[np.ndarray, np.ndarray] | None:
    """What a run holds of a prefix."""
    system, path = arrow_fs(_file(base, run, prefix))
    if not system.get_file_info(path).is_file:
        return None
    with system.open_input_file(path) as f:
        high, low, offsets = np.frombuffer(f.read(), "<i8").reshape(3, -1)
    return _pairs(high, low), offsets


def _index_of(base: str, runs: list[str], prefix: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [found for r in runs if (found := read_prefix(base, r, prefix))]


_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def _ingest_prefix(base: str, runs: list[str], name: str):
    def ingest(key: tuple, new: pd.DataFrame) -> pd.DataFrame:
        from tidelog.operators import dedup as d

        prefix = int(key[0])
        ids = d._pairs(new["high"].to_numpy("int64"), new["low"].to_numpy("int64"))
        first, n = new["first_offset"].to_numpy("int64").copy(), new["n"].to_numpy("int64")
        order = np.argsort(ids, order=("high", "low"))
        ids, first, n = ids[order], first[order], n[order]
        seen = np.zeros(len(ids), bool)
        for run, offsets in d._index_of(base, runs, prefix):
            at, found = d._search(run, ids)
            first[found] = offsets[at[found]]
            seen |= found
        if not seen.all():
            d._write(base, name, prefix, ids[~seen], first[~seen])
        rows = pd.DataFrame({"kind": "copy", "prefix": prefix, "high": ids["high"], "low": ids["low"], "first_offset": first, "n": n})[seen | (n > 1)]
        return pd.concat([rows, pd.DataFrame([("run", prefix, 0, 0, 0, int((~seen).sum()))], columns=d._COLUMNS)], ignore_index=True)

    return ingest


def _merge_prefixes(base: str, runs: list[str], name: str, bits: int, finer: int):
    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidelog.operators import dedup as d

        for part in parts:
            for prefix in part["id"].tolist():
                index = d._index_of(base, runs, prefix)
                if not index:
                    continue
                ids, offsets = index[0]
                for other, more in index[1:]:
                    ids, offsets = d._merged(ids, offsets, other, more)
                # bits of a prefix are the topmost of the first half taken as unsigned, whose sorting is that of the signed one within a prefix of a bit or more
                new = (ids["high"].view(np.uint64) >> np.uint64(64 - finer)).astype(np.int64) if finer > bits else np.full(len(ids), prefix)
                for p in np.unique(new):
                    d._write(base, name, int(p), ids[new == p], offsets[new == p])
            yield pd.DataFrame({"id": part["id"]})

    return merge


def _merged(ids: np.ndarray, offsets: np.ndarray, other: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs as one: each identifier of the other moves up by those of the first below it."""
    at, end = np.searchsorted(ids["high"], other["high"], "left"), np.searchsorted(ids["high"], other["high"], "right")
    open_ = np.nonzero(end > at)[0]  # where first halves are equal the second ones decide; as a run has novel identifiers only, they differ
    while len(open_):
        open_ = open_[ids["low"][at[open_]] < other["low"][open_]]
        at[open_] += 1
        open_ = open_[at[open_] < end[open_]]
    places, both, joint = at + np.arange(len(other)), np.empty(len(ids) + len(other), _PAIR), np.empty(len(ids) + len(other), np.int64)
    rest = np.ones(len(both), bool)
    rest[places] = False
    both[places], both[rest], joint[places], joint[rest] = other, ids, more, offsets
    return both, joint


def prefix_bits(ids: int) -> int:
    return max(4, math.ceil(math.log2(max(1, ids) / PREFIX_IDS)))


class Index:
    """The identifiers met so far, in a folder: runs and their manifest. Objects hold nothing but the folder's name."""

    def __init__(self, spark: SparkSession, base: str | None = None) -> None:
        self.spark, self.base = spark, base or shared_dir(spark, "dedup")
        self.manifest = Manifest(spark, f"{self.base}/manifest")

    def runs(self) -> list[str]:
        return self.manifest.read()[1].get("runs", [])

    def ingest(self, incoming: DataFrame, n_new: int = 0) -> DataFrame:
        """Look one slice of messages up and add its novel identifiers as a run. Returns the identifiers met again (high, low, first_offset, n).

        ``n_new``: how many identifiers are expected in all calls to come, where that is known.
        """
        ship(self.spark)
        version, content = self.manifest.read()
        bits, runs, total = content.get("bits", prefix_bits(n_new)), content.get("runs", []), content.get("n", 0)
        if len(runs) > MAX_RUNS:
            name, finer = f"run-{uuid.uuid4().hex}", max(bits, prefix_bits(total))
            tasks = min(1 << bits, max(self.spark.sparkContext.defaultParallelism, (1 << bits) // 64))
            self.spark.range(0, 1 << bits, 1, tasks).mapInPandas(_merge_prefixes(self.base, runs, name, bits, finer), "id bigint").agg(F.count("id")).collect()  # one number
            runs, bits = [name], finer
        ids = (
            incoming.groupBy("high", "low")
            .agg(F.min("log_offset").alias("first_offset"), F.count(F.lit(1)).alias("n"))
            .withColumn("prefix", F.shiftrightunsigned("high", 64 - bits).cast("int"))
        )
        name = f"run-{uuid.uuid4().hex}"
        path = f"{self.base}/verdicts-{name}"
        ids.groupBy("prefix").applyInPandas(_ingest_prefix(self.base, runs, name), OUT).write.partitionBy("kind").parquet(path)
        told = self.spark.read.schema(OUT).parquet(path)
        added = told.where("kind = 'run'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not self.manifest.add(version + 1, {"runs": [*runs, name], "bits": bits, "n": total + added}):
            raise RuntimeError(f"another writer has changed {self.base}")
        return told.where("kind = 'copy'").select("high", "low", "first_offset", "n")


def copies(records: DataFrame, batches: DataFrame, slices: int = SLICES, base: str | None = None) -> DataFrame:
    """The records to drop: all copies of a message but the one that came first, which within a call is the one with the smallest log_offset; each once.

    ``base``: the folder of an index that earlier calls have filled and later ones will use; ``records`` are then the new ones.
    """
    spark = records.sparkSession
    bounds = records.groupBy("topic", "partition_id").agg(F.min("log_offset").alias("lo"), F.max("log_offset").alias("hi"))  # a row per log partition
    share = (F.col("log_offset") - F.col("lo")) * slices / (F.col("hi") - F.col("lo") + 1)
    sliced = messages(records, batches).join(F.broadcast(bounds), ["topic", "partition_id"]).withColumn("slice", F.floor(share).cast("int")).drop("lo", "hi")
    incoming = materialize(sliced, "dedup-incoming", "slice")
    rows = incoming.count()
    index = Index(spark, base)
    # in the order of arrival, so that what is met first has the smallest offset
    met = reduce(DataFrame.unionByName, [index.ingest(incoming.where(F.col("slice") == k), rows) for k in range(slices)])
    met = met.groupBy("high", "low").agg(F.min("first_offset").alias("first_offset"), F.sum("n").alias("n"))
    hot = F.col("n") > max(10_000, rows // HOT_KEYS)
    few = F.broadcast(met.where(hot).select("high", "low", F.col("first_offset").alias("hot_first")))  # < HOT_KEYS rows
    tried = incoming.join(few, ["high", "low"], "left")
    out = ["topic", "partition_id", "log_offset"]
    by_broadcast = tried.where(F.col("log_offset") != F.col("hot_first")).select(*out)
    by_shuffle = tried.where(F.col("hot_first").isNull()).join(met.where(~hot), ["high", "low"]).where(F.col("log_offset") != F.col("first_offset")).select(*out)
    return by_broadcast.unionByName(by_shuffle)


def deduplicated(records: DataFrame, batches: DataFrame) -> DataFrame:
    """The log with exactly one copy of each message; records without identifier stay."""
    key = ["topic", "partition_id", "log_offset"]
    return records.dropDuplicates(key).join(copies(records, batches), key, "left_anti")
