"""The binary form of record batches: encoding, decoding and the CRC-32C that protects them.

All numbers are big-endian; lengths and deltas are zigzag variable-length integers; a null is length -1. A header of 61 bytes
precedes the records of a batch; its checksum covers everything from the attributes on, so that base offset and leader epoch can be
stamped without changing it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tidelog.common import ship

# Fixed values of the format.
CASTAGNOLI = 0x82F63B78
HEADER = struct.Struct(">qiibIhiqqqhii")  # base offset, length, leader epoch, magic, crc, attributes, last delta, first and max time, producer id, epoch, sequence, count
MAGIC, BEFORE_LENGTH, CRC_AT, CRC_FROM, COMPRESSION_MASK = 2, 12, 17, 21, 7


class Corrupt(ValueError):
    """Bytes that aren't a batch."""


@lru_cache(1)
def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CASTAGNOLI), table >> 1)
    return table


#: Bytes that one lane of the vectorized checksum takes; longer strings are cut into lanes and their checksums combined.
LANE = 1_024


@lru_cache(1)
def _shift() -> np.ndarray:
    """Tables by byte of what a checksum register becomes by LANE zero bytes."""
    one = np.uint32(1) << np.arange(32, dtype=np.uint32)  # the register is linear in its bits
    table = crc_table()
    for _ in range(LANE):
        one = (one >> 8) ^ table[one & 0xFF]
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            out[k] ^= np.where(np.arange(256) >> bit & 1, one[8 * k + bit], np.uint32(0))
    return out


def crc32c_many(blobs: list[bytes]) -> np.ndarray:
    """Checksums of many byte strings: all are cut into lanes of LANE bytes, which advance together by one byte at a time, and the lanes of each are combined."""
    if len(blobs) < 16 and max(map(len, blobs), default=0) <= 4 * LANE:  # too few to share the steps
        return np.array([crc32c(b) for b in blobs], np.uint32)
    table, sizes = crc_table(), np.array([len(b) for b in blobs], np.int64)
    data, starts = np.frombuffer(b"".join(blobs), np.uint8), np.concatenate(([0], np.cumsum(sizes)[:-1]))
    lanes = -(-sizes // LANE)
    owner = np.repeat(np.arange(len(blobs)), lanes)
    first = np.concatenate(([0], np.cumsum(lanes)[:-1]))
    nth = np.arange(len(owner)) - first[owner]
    short = (sizes - (lanes - 1) * LANE)[owner]  # the first lane takes what is over, so that all others are full
    length = np.where(nth == 0, short, LANE)
    at = starts[owner] + np.where(nth == 0, 0, short + (nth - 1) * LANE)
    crc, order = np.zeros(len(owner), np.uint32), np.argsort(-length, kind="stable")
    crc[first[lanes > 0]] = 0xFFFFFFFF
    ordered = length[order]
    for k in range(int(ordered[0]) if len(ordered) else 0):
        live = order[: np.searchsorted(-ordered, -k, "left")]
        crc[live] = (crc[live] >> 8) ^ table[(crc[live] ^ data[at[live] + k]) & 0xFF]
    out = np.full(len(blobs), 0xFFFFFFFF, np.uint32)
    out[lanes > 0] = crc[first[lanes > 0]]
    tables = _shift() if len(lanes) and lanes.max() > 1 else None
    for j in range(1, int(lanes.max()) if len(lanes) else 0):
        more = np.nonzero(lanes > j)[0]
        value = out[more]
        out[more] = tables[0][value & 255] ^ tables[1][value >> 8 & 255] ^ tables[2][value >> 16 & 255] ^ tables[3][value >> 24] ^ crc[first[more] + j]
    return out ^ np.uint32(0xFFFFFFFF)


def crc32c(data: bytes) -> int:
    """Checksum of one byte string."""
    if len(data) > 4 * LANE:
        return int(crc32c_many([data])[0])
    table, crc = _crc_list(), 0xFFFFFFFF
    for b in data:
        crc = crc >> 8 ^ table[(crc ^ b) & 0xFF]
    return crc ^ 0xFFFFFFFF


@lru_cache(1)
def _crc_list() -> list[int]:
    return crc_table().tolist()


def crc32c_column(value: Column) -> Column:
    """CRC-32C of a binary column; null for null. (Spark's own crc32 is another polynomial.)"""
    ship(SparkSession.getActiveSession())

    @pandas_udf("bigint")
    def checksum(s: pd.Series) -> pd.Series:
        from tidelog.functions.codec import crc32c_many

        there = s.notna()
        out = pd.Series([None] * len(s), dtype="Int64")
        out[there.to_numpy()] = crc32c_many([bytes(b) for b in s[there]]).astype(np.int64)
        return out

    return checksum(value)


@lru_cache(16_384)
def zigzag(n: int) -> bytes:
    """Variable-length zigzag form of a signed integer of up to 64 bits."""
    z, out = (n << 1) ^ (n >> 63), bytearray()
    z &= (1 << 64) - 1
    while z > 0x7F:
        out.append(z & 0x7F | 0x80)
        z >>= 7
    out.append(z)
    return bytes(out)


def read_zigzag(data: bytes, at: int, most: int = 10) -> tuple[int, int]:
    """Value and next position; more than ``most`` bytes, or bits beyond 32 (5 bytes) or 64, are refused."""
    z = 0
    for i in range(most):
        if at + i >= len(data):
            raise Corrupt("the data ends within a number")
        b = data[at + i]
        if i == most - 1 and b > (0x0F if most == 5 else 0x01):
            raise Corrupt("a number is too wide")
        z |= (b & 0x7F) << (7 * i)
        if b < 0x80:
            return (z >> 1) ^ -(z & 1), at + i + 1
    raise Corrupt("a number is too long")


def _nullable(value: bytes | None) -> bytes:
    return b"\x01" if value is None else zigzag(len(value)) + value


def encode_record(offset_delta: int, timestamp_delta: int, key: bytes | None, value: bytes | None, headers: list[tuple[bytes, bytes | None]] = ()) -> bytes:
    body = b"\x00" + zigzag(timestamp_delta) + zigzag(offset_delta) + _nullable(key) + _nullable(value) + zigzag(len(headers))
    body += b"".join(zigzag(len(k)) + k + _nullable(v) for k, v in headers)
    return zigzag(len(body)) + body


def sealed(batches: list[bytes]) -> list[bytes]:
    """Batches with their checksums set."""
    sums = crc32c_many([b[CRC_FROM:] for b in batches])
    return [b[:CRC_AT] + int(c).to_bytes(4, "big") + b[CRC_FROM:] for b, c in zip(batches, sums, strict=True)]


def unsealed_batch(records: list[tuple], base_offset: int = 0, first_timestamp: int = -1, max_timestamp: int = -1, leader_epoch: int = -1, attributes: int = 0, producer: tuple[int, int, int] = (-1, -1, -1)) -> bytes:
    """A batch of records (offset_delta, timestamp_delta, key, value, headers) with rising offset deltas, its checksum still 0."""
    if not records:
        raise ValueError("a batch has at least one record")
    deltas = [r[0] for r in records]
    if any(b <= a for a, b in zip(deltas, deltas[1:], strict=False)):
        raise ValueError("offset deltas must rise")
    body = b"".join(encode_record(*r) for r in records)
    return HEADER.pack(base_offset, HEADER.size - BEFORE_LENGTH + len(body), leader_epoch, MAGIC, 0, attributes, deltas[-1], first_timestamp, max_timestamp, *producer, len(records)) + body


def encode_batch(*args, **kwargs) -> bytes:
    """A whole batch; takes what ``unsealed_batch`` takes."""
    return sealed([unsealed_batch(*args, **kwargs)])[0]


def stamp(batch: bytes, base_offset: int, leader_epoch: int) -> bytes:
    """The batch under another base offset and leader epoch; its checksum stays good."""
    return struct.pack(">q", base_offset) + batch[8:12] + struct.pack(">i", leader_epoch) + batch[16:]


def batch_size(data: bytes, at: int = 0) -> int:
    if len(data) - at < HEADER.size:
        raise Corrupt("the data ends within a header")
    n = struct.unpack_from(">i", data, at + 8)[0] + BEFORE_LENGTH
    if n < HEADER.size:
        raise Corrupt("a batch is shorter than its header")
    return n


def verify(batch: bytes) -> bool:
    return len(batch) >= HEADER.size and struct.unpack_from(">I", batch, CRC_AT)[0] == crc32c(batch[CRC_FROM:])


def decode_batch(batch: bytes) -> tuple[dict, list[tuple]]:
    """Header and records of exactly one batch; anything odd is refused."""
    size = batch_size(batch)
    if size != len(batch):
        raise Corrupt("the batch has another length than its bytes")
    names = ("base_offset", "batch_length", "leader_epoch", "magic", "crc", "attributes", "last_offset_delta", "first_timestamp", "max_timestamp", "producer_id", "producer_epoch", "base_sequence", "record_count")
    head = dict(zip(names, HEADER.unpack_from(batch), strict=True))
    if head["magic"] != MAGIC:
        raise Corrupt("unknown version")
    if head["attributes"] & COMPRESSION_MASK:
        raise Corrupt("compressed batches can't be read")
    if head["record_count"] < 0 or head["last_offset_delta"] < 0:
        raise Corrupt("a count is negative")
    at, records = HEADER.size, []

    def number(most: int) -> int:
        nonlocal at
        if at < len(batch) and (b := batch[at]) < 0x80:  # mostly one byte
            at += 1
            return (b >> 1) ^ -(b & 1)
        n, at = read_zigzag(batch, at, most)
        return n

    def bytes_() -> bytes | None:
        nonlocal at
        n = number(5)
        if n < 0:
            return None
        if at + n > len(batch):
            raise Corrupt("the data ends within a field")
        at += n
        return batch[at - n : at]

    for _ in range(head["record_count"]):
        size = number(5)
        end = at + size
        if size < 1 or end > len(batch):
            raise Corrupt("a record has an impossible length")
        at += 1
        timestamp, delta = number(10), number(5)
        key, value, headers = bytes_(), bytes_(), []
        for _ in range(number(5)):
            name = bytes_()
            if name is None:
                raise Corrupt("a header has no name")
            headers.append((name, bytes_()))
        if at != end:
            raise Corrupt("a record has another length than its fields")
        records.append((delta, timestamp, key, value, headers))
    if at != len(batch) or (records and records[-1][0] != head["last_offset_delta"]):
        raise Corrupt("records don't match the header")
    return head, records


def walk(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Position and bytes of each batch of a segment; ends at the first that is torn or whose checksum is wrong."""
    at, found = 0, []
    while at < len(data):
        try:
            n = batch_size(data, at)
        except Corrupt:
            break
        if at + n > len(data):
            break
        found.append((at, data[at : at + n]))
        at += n
    for (at, batch), crc in zip(found, crc32c_many([b[CRC_FROM:] for _, b in found]), strict=True):
        if struct.unpack_from(">I", batch, CRC_AT)[0] != crc:
            return
        yield at, batch


ENCODED = "topic string, partition_id int, segment_base bigint, base_offset bigint, batch binary"
_ROW = ["topic", "partition_id", "segment_base", "base_offset", "leader_epoch", "attributes", "first_timestamp", "max_timestamp", "producer_id", "producer_epoch", "base_sequence", "rows"]


def encode_batches(records: DataFrame, batches: DataFrame) -> DataFrame:
    """One row per batch with its bytes. The records of a batch are brought together; a batch is bounded by the largest message."""
    ship(records.sparkSession)
    held = F.sort_array(F.collect_list(F.struct("offset_delta", "timestamp_delta", "rec_key", "rec_value", "headers"))).alias("rows")
    key = ["topic", "partition_id", "base_offset"]
    # one shuffle by batch, in as many partitions as the session says: encoding takes longer per byte than the sizes of partitions suggest
    placed = records.withColumnRenamed("batch_base", "base_offset").repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    grouped = placed.groupBy(*key).agg(held)
    joined = batches.join(grouped, key).select(*_ROW)

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidelog.functions import codec as c

        for part in parts:
            out = []
            for r in part.to_pylist():
                rows = [(x["offset_delta"], x["timestamp_delta"], x["rec_key"], x["rec_value"], [(h["hkey"], h["hvalue"]) for h in x["headers"] or ()]) for x in r["rows"]]
                out.append(c.unsealed_batch(rows, r["base_offset"], r["first_timestamp"], r["max_timestamp"], r["leader_epoch"], r["attributes"], (r["producer_id"], r["producer_epoch"], r["base_sequence"])))
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(c.sealed(out), pa.binary())], names=["topic", "partition_id", "segment_base", "base_offset", "batch"])

    return joined.mapInArrow(encode, ENCODED)


DECODED_COLUMNS = ["topic", "partition_id", "segment_base", "batch_base", "log_offset", "offset_delta", "timestamp_delta", "first_timestamp", "rec_key", "rec_value", "headers", "position"]
DECODED = "topic string, partition_id int, segment_base bigint, batch_base bigint, log_offset bigint, offset_delta int, timestamp_delta bigint, first_timestamp bigint, rec_key binary, rec_value binary, headers array<struct<hkey:binary,hvalue:binary>>, position bigint"


def decode_segments(segments: DataFrame) -> DataFrame:
    """Records of segment bytes (topic, partition_id, segment_base, content), up to the first batch that is torn or corrupt."""
    ship(segments.sparkSession)

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidelog.functions import codec as c

        for part in parts:
            places: list[tuple] = []
            rows: list[tuple] = []
            for topic, partition, segment, content in zip(*(col.to_pylist() for col in part.columns), strict=True):
                for at, batch in c.walk(content or b""):
                    try:
                        head, records = c.decode_batch(batch)
                    except c.Corrupt:  # whole, but not to be read: the segment ends here, others don't
                        break
                    place = (topic, partition, segment, head["base_offset"], head["first_timestamp"], at)
                    places += [place] * len(records)
                    rows += records
            topic, partition, segment, base, first, at = zip(*places, strict=True) if places else ((),) * 6
            delta, time, key, value, headers = zip(*rows, strict=True) if rows else ((),) * 5
            base, delta = pa.array(base, pa.int64()), pa.array(delta, pa.int32())
            header = pa.list_(pa.struct([("hkey", pa.binary()), ("hvalue", pa.binary())]))
            named = [[{"hkey": a, "hvalue": b} for a, b in h] if h else () for h in headers]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(topic, pa.string()), pa.array(partition, pa.int32()), pa.array(segment, pa.int64()), base, pc.add(base, delta.cast(pa.int64())), delta,
                    pa.array(time, pa.int64()), pa.array(first, pa.int64()), pa.array(key, pa.binary()), pa.array(value, pa.binary()), pa.array(named, header), pa.array(at, pa.int64()),
                ],
                names=c.DECODED_COLUMNS,
            )

    return segments.select("topic", "partition_id", "segment_base", "content").mapInArrow(decode, DECODED)
