"""Has this key been seen before? Ribbon filters over sealed generations, with a measured rate of wrong answers.

A *generation* is a sealed batch of keys: one pass of the history, or ``GENERATION_OFFSETS`` successive offsets of the log partitions. For
every generation and hash shard a Ribbon filter is built: each key gives one linear equation over GF(2), whose coefficients lie in a band of 64 bits
from a hashed start, and whose right side is the key's fingerprint. The banded system is solved by elimination as keys come and back
substitution at the end; the solution holds ``FINGERPRINT`` bits a slot and about 1.12 slots a key, and no key. A probe adds up the slots that the
equation of the key names: a key of the generation always gives its fingerprint, another one with chance 2**-FINGERPRINT.

Only within its own, still open, generation is a key compared with others: the records of at most ``GENERATION_OFFSETS`` offsets of a partition. The
first record of a key there then asks the filters, and their answer stands. The log's generations form a tree: ``FAN`` successive ones are sealed once more as one of
the next level, of the keys that no filter below had. A key asks the earlier siblings of its generation at each level, so for n generations fewer than FAN filters on each of log(n) levels,
and what a lower level has found isn't asked or stored above it. At last it asks the passes of the history.

Audit: every filter is asked for ``AUDIT`` keys that are certainly absent. As a whole fingerprint hardly ever agrees by chance, it is counted how often
the first ``AUDIT_BITS`` bits of it do; the rate of wrong answers is that rate times 2**(AUDIT_BITS - FINGERPRINT). A key that no generation holds is answered wrongly at the sum of
the rates of the filters it asks (and where two names of keys have the same 64-bit hash, with a chance of keys / 2**64). There are no wrong answers the other way.

Scale: hot keys are cut by generation before anything is compared, so one that holds a third of all rows costs a task at most GENERATION_OFFSETS rows; shards follow from the number of keys, so that one
holds about ``SHARD_KEYS`` keys on any level; filters meet keys by (part of the tree, shard), so neither is broadcast. What is written to the shared folder are 64-bit hashes of the keys that are still asked about, and filters.

Nulls and odd input: a null key is no key and never seen, an empty key is one; a record without partition or offset isn't in the log; digests are always taken from the key itself, as those in
the records may be absent; rows written twice are one record; empty tables give empty filters and an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.common import materialize, shared_dir, ship

WIDTH, FINGERPRINT, SLACK = 64, 32, 1.12
SHARD_KEYS, GENERATION_OFFSETS, FAN = 262_144, 4_096, 16
AUDIT, AUDIT_BITS = 4_096, 8
# Fixed values of the digest: the FNV-1a prime and the two starting values.
FNV_PRIME, HIGH_START, LOW_START = 0x100000001B3, 0xCBF29CE484222325, 0x9E3779B97F4A7C15
FILTER = "span bigint, shard int, child bigint, n_keys bigint, seed int, slots int, solution binary, n_probes int, n_agree int"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed: the multipliers of the splitmix64 finalizer


def fnv_pair(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Both digest halves of each key as signed 64-bit integers; all keys advance by one byte at a time."""
    keys = keys.cast(pa.large_binary())
    offsets = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
    data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)
    start, size = offsets[:-1], np.diff(offsets)
    high, low = np.full(len(keys), HIGH_START, np.uint64), np.full(len(keys), LOW_START, np.uint64)
    order = np.argsort(-size, kind="stable")
    ordered = size[order]
    prime = np.uint64(FNV_PRIME)
    for at in range(int(ordered[0]) if len(ordered) else 0):
        live = order[: np.searchsorted(-ordered, -at, "left")]  # keys longer than at
        byte = data[start[live] + at].astype(np.uint64)
        high[live] = (high[live] ^ byte) * prime
        low[live] = (low[live] ^ byte) * prime
    return high.view(np.int64), low.view(np.int64)


def with_digest(df: DataFrame, key: str = "rec_key") -> DataFrame:
    """``df`` with the digest halves ``high`` and ``low`` of its non-null key column."""
    ship(df.sparkSession)
    at = df.columns.index(key)

    def add(batches):
        from tidelog.llm import ribbon

        for batch in batches:
            high, low = ribbon.fnv_pair(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(high), pa.array(low)], names=[*batch.schema.names, "high", "low"])

    schema = T.StructType([*df.schema.fields, T.StructField("high", T.LongType()), T.StructField("low", T.LongType())])
    return df.mapInArrow(add, schema)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer over ``x`` moved by ``seed``."""
    z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


def equations(keys: np.ndarray, seed: int, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, coefficients (the lowest is always 1) and fingerprint of each key."""
    start = (mix(keys, 3 * seed) % np.uint64(slots - WIDTH + 1)).astype(np.int64)
    return start, mix(keys, 3 * seed + 1) | np.uint64(1), (mix(keys, 3 * seed + 2) >> np.uint64(64 - FINGERPRINT)).astype(np.uint32)


def _eliminate(start: np.ndarray, coefficients: np.ndarray, prints: np.ndarray, slots: int) -> tuple[list[int], list[int]] | None:
    rows, right = [0] * slots, [0] * slots
    order = np.argsort(start, kind="stable")
    for s, c, r in zip(start[order].tolist(), coefficients[order].tolist(), prints[order].tolist(), strict=True):
        while True:
            held = rows[s]
            if not held:
                rows[s], right[s] = c, r
                break
            c, r = c ^ held, r ^ right[s]
            if not c:
                if r:
                    return None  # the equations contradict each other: try another seed
                break
            shift = (c & -c).bit_length() - 1
            c, s = c >> shift, s + shift
    return rows, right


def solve(keys: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Seed, slots and solution of the system of ``keys`` (distinct 64-bit hashes)."""
    slots = int(len(keys) * SLACK) + 2 * WIDTH
    for seed in range(1_000):
        system = _eliminate(*equations(keys, seed, slots), slots)
        if system:
            break
        slots += slots // 50 + 1
    else:
        raise RuntimeError("no seed solves the system")
    solution, lanes = np.zeros(slots, np.uint32), np.arange(FINGERPRINT, dtype=np.uint64)
    state, one = np.zeros(FINGERPRINT, np.uint64), np.uint64(1)  # per bit of the fingerprint: the next WIDTH slots
    right = (np.array(system[1], np.uint64)[:, None] >> lanes) & one
    rows, weights = np.array(system[0], np.uint64), (1 << np.arange(FINGERPRINT)).astype(np.uint64)
    for i in range(slots - 1, -1, -1):
        state <<= one
        if rows[i]:
            bit = (np.bitwise_count(state & rows[i]) ^ right[i]) & one
            state |= bit
            solution[i] = bit @ weights
    return seed, slots, solution


def sums(keys: np.ndarray, seed: int, slots: int, solution: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the slots of each key add up to, and its fingerprint."""
    start, coefficients, prints = equations(keys, seed, slots)
    got = np.zeros(len(keys), np.uint32)
    for k in range(WIDTH):
        got ^= solution[start + k] * ((coefficients >> np.uint64(k)) & np.uint64(1)).astype(np.uint32)
    return got, prints


def probe(keys: np.ndarray, seed: int, slots: int, solution: np.ndarray) -> np.ndarray:
    """Whether the filter says that it holds each key."""
    got, prints = sums(keys, seed, slots, solution)
    return got == prints


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    span, shard, child = key
    keys = np.unique(rows["hashed"].to_numpy("int64"))
    seed, slots, solution = solve(keys)
    absent = mix(np.arange(AUDIT, dtype=np.uint64) + np.uint64(int(shard) << 20), 77 + int(child)).view(np.int64)
    absent = absent[~np.isin(absent, keys)]
    got, prints = sums(absent, seed, slots, solution)
    agree = int(((got ^ prints) >> np.uint32(FINGERPRINT - AUDIT_BITS) == 0).sum())
    return pd.DataFrame([(span, shard, child, len(keys), seed, slots, solution.tobytes(), len(absent), agree)], columns=[c.split()[0] for c in FILTER.split(", ")])


def build_filters(keys: DataFrame) -> DataFrame:
    """One filter per span, shard and child (the generation within its span) of ``keys`` (span, shard, child, hashed), kept in the shared folder."""
    ship(spark := keys.sparkSession)
    path = shared_dir(spark, "ribbon")
    keys.groupBy("span", "shard", "child").applyInPandas(_build, FILTER).write.parquet(path)
    return spark.read.schema(FILTER).parquet(path)


def _ask(key: tuple, asking: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """``hit``: whether a filter of an earlier child of the same span and shard has the key."""
    hashed, own, hit = asking["hashed"].to_numpy("int64"), asking["child"].to_numpy("int64"), np.zeros(len(asking), bool)
    for f in filters.itertuples():
        ask = np.nonzero((own > f.child) & ~hit)[0]
        hit[ask] = probe(hashed[ask], f.seed, f.slots, np.frombuffer(f.solution, np.uint32))
    return asking.assign(hit=hit)


def answered(asking: DataFrame, filters: DataFrame) -> DataFrame:
    """``asking`` (with span, shard, child, hashed) with ``hit``, the answer of the filters."""
    ship(asking.sparkSession)
    schema = T.StructType([*asking.schema.fields, T.StructField("hit", T.BooleanType())])
    columns = [f.name for f in schema.fields]

    def ask(key, a, f):
        from tidelog.llm import ribbon

        return ribbon._ask(key, a, f)[columns]

    return asking.groupBy("span", "shard").cogroup(filters.groupBy("span", "shard")).applyInPandas(ask, schema)


def arrivals_of(records: DataFrame, topic: str, generation: int = GENERATION_OFFSETS) -> DataFrame:
    """The keyed records of ``topic``: ``block``, the generation, and ``nth``, 1 for the first record of its key in the partition and generation."""
    keyed = records.where(F.col("topic") == topic).select("topic", "partition_id", "log_offset", "rec_key").dropna()
    spot = ["topic", "partition_id", "block", "rec_key"]
    cut = keyed.withColumn("block", F.floor(F.col("log_offset") / generation)).repartition(*spot).dropDuplicates([*spot, "log_offset"])
    return cut.withColumn("nth", F.row_number().over(W.partitionBy(*spot).orderBy("log_offset")))


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("hashed", F.xxhash64("topic", "partition_id", "high", "low"))


def _placed(df: DataFrame, level: int, fan: int, shards: int) -> DataFrame:
    child = F.floor(F.col("block") / fan**level)
    return df.withColumns({"span": F.floor(child / fan), "child": child, "shard": F.pmod(F.xxhash64("hashed", F.lit("shard")), F.lit(shards)).cast("int")})


def history_filters(history: DataFrame, topic: str) -> tuple[DataFrame, int]:
    """The filters of the passes of the history of ``topic``, and in how many shards."""
    spark = history.sparkSession
    past = history.where((F.col("topic") == topic) & F.col("digest_high").isNotNull() & F.col("digest_low").isNotNull())
    old = _hashed(past.select("topic", "partition_id", "pass_id", F.col("digest_high").alias("high"), F.col("digest_low").alias("low")))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-old.count() // SHARD_KEYS))
    # passes precede all of the log: their children have negative numbers
    placed = _placed(old.withColumn("block", F.lit(0)), 0, FAN, shards).withColumn("child", F.col("pass_id") - (1 << 62))
    return build_filters(placed.select("span", "shard", "child", "hashed")), shards


def answers(records: DataFrame, history: DataFrame, topic: str = "gate-tokens", generation: int = GENERATION_OFFSETS, fan: int = FAN) -> tuple[DataFrame, list[tuple[str, DataFrame, DataFrame]]]:
    """(topic, partition_id, log_offset) of the records whose key was seen before, and the generations asked: kind, filters and who asked."""
    spark = records.sparkSession
    name = ["topic", "partition_id", "log_offset"]
    arrivals = materialize(_hashed(with_digest(arrivals_of(records, topic, generation))).select(*name, "block", "nth", "hashed"), "arrivals")
    seen, asked = [arrivals.where("nth > 1").select(*name)], []
    asking = arrivals.where("nth = 1").select(*name, "block", "hashed")
    n, lo, hi = asking.agg(F.count(F.lit(1)), F.min("block"), F.max("block")).first()
    newest = asking.groupBy("topic", "partition_id").agg(F.max("block").alias("newest"))  # a row per partition
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = 0
    while n and lo // fan**level < hi // fan**level:
        spans = hi // fan ** (level + 1) - lo // fan ** (level + 1) + 1
        asking = _placed(asking, level, fan, max(1, -(-least // spans), -(-n // (spans * SHARD_KEYS))))
        # sealed: not the last generation of its partition, which is open. The last of a span has no later sibling that could ask it
        later = (F.col("child") < F.floor(F.col("newest") / fan**level)) & (F.col("child") % fan != fan - 1)
        sealed = asking.join(F.broadcast(newest), ["topic", "partition_id"]).where(later)
        filters = build_filters(sealed.select("span", "shard", "child", "hashed"))
        told = materialize(answered(asking, filters), f"answers{level}")
        asked.append((f"log:{level}", filters, asking))
        seen.append(told.where("hit").select(*name))
        asking = told.where("not hit").select(*name, "block", "hashed")
        level += 1
    filters, shards = history_filters(history, topic)
    asking = _placed(asking.withColumn("block", F.lit(0)), 0, fan, shards)
    asked.append(("past", filters, asking))
    seen.append(answered(asking, filters).where("hit").select(*name))
    out = seen[0]
    for s in seen[1:]:
        out = out.unionByName(s)
    return out, asked


def seen_before(records: DataFrame, history: DataFrame, topic: str = "gate-tokens", **how: int) -> DataFrame:
    """Names of the keyed records of ``topic`` whose key was met before in their partition or is in its history."""
    return answers(records, history, topic, **how)[0]


def rates(records: DataFrame, history: DataFrame, topic: str = "gate-tokens", **how: int) -> DataFrame:
    """Per generation: keys, bits a key, the audit with certainly absent keys, and the rate of wrong answers that follows.

    ``generation`` is ``past:<pass_id>`` or ``log:<level>:<number>``. ``n_asked`` keys asked it to give the answers of ``seen_before``, and ``wrong_expected`` of those that it doesn't hold
    are expected to have been answered wrongly.
    """
    _, asked = answers(records, history, topic, **how)
    out = None
    for kind, filters, asking in asked:
        child = F.col("child") + (1 << 62) if kind == "past" else F.col("child")
        size = filters.groupBy("span", "child").agg(*[F.sum(c).alias(c) for c in ("n_keys", "slots", "n_probes", "n_agree")])
        askers = asking.groupBy("span", F.col("child").alias("by")).agg(F.count(F.lit(1)).alias("n"))  # a row per generation
        n = size.select("span", "child").join(askers, "span").where("by > child").groupBy("span", "child").agg(F.sum("n").alias("n_asked"))
        rate = F.col("n_agree") / F.col("n_probes") / 2.0 ** (FINGERPRINT - AUDIT_BITS)
        part = size.join(n, ["span", "child"], "left").select(
            F.concat_ws(":", F.lit(kind), child).alias("generation"), "n_keys", (F.col("slots") * FINGERPRINT / F.col("n_keys")).alias("bits_per_key"), "n_probes", "n_agree",
            rate.alias("wrong_rate"), F.coalesce("n_asked", F.lit(0)).alias("n_asked"), (F.coalesce("n_asked", F.lit(0)) * rate).alias("wrong_expected"),
        )
        out = part if out is None else out.unionByName(part)
    return out
