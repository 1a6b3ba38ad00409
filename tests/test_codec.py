"""The binary form of batches, checksums and segment files."""

import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import codec, metas
from tidelog.sources.segment_files import register, remove_partition, sweep_removed, write_segments

KEYS = st.none() | st.binary(max_size=20)
RECORD = st.tuples(st.integers(-(2**62), 2**62), KEYS, KEYS, st.lists(st.tuples(st.binary(max_size=5), KEYS), max_size=3))


def batch_of(parts, **kwargs):
    return codec.encode_batch([(i, t, k, v, h) for i, (t, k, v, h) in enumerate(parts)], **kwargs)


@pytest.mark.parametrize(("data", "crc"), [(b"123456789", 0xE3069283), (bytes(32), 0x8A9136AA), (b"\xff" * 32, 0x62A8AB43), (b"", 0)])
def test_known_checksums(data, crc):
    assert codec.crc32c(data) == crc
    assert codec.crc32c_many([b"x", data, b""]).tolist() == [codec.crc32c(b"x"), crc, 0]


@given(st.lists(st.binary(max_size=40), max_size=10))
def test_many_checksums_equal_single_ones(blobs):
    assert codec.crc32c_many(blobs).tolist() == [codec.crc32c(b) for b in blobs]


@given(st.integers(-(2**63), 2**63 - 1))
def test_zigzag_round_trip(n):
    data = codec.zigzag(n)
    assert codec.read_zigzag(data, 0) == (n, len(data))


@pytest.mark.parametrize(("data", "most"), [(b"", 10), (b"\x80", 10), (b"\x80" * 5 + b"\x01", 5), (b"\xff\xff\xff\xff\x7f", 5), (b"\xff" * 9 + b"\x02", 10), (b"\x80" * 11, 10)])
def test_bad_numbers_are_refused(data, most):
    with pytest.raises(codec.Corrupt):
        codec.read_zigzag(data, 0, most)


@settings(max_examples=60, deadline=None)
@given(st.lists(RECORD, min_size=1, max_size=6))
def test_batch_round_trip(parts):
    raw = batch_of(parts, base_offset=7, first_timestamp=1)
    head, records = codec.decode_batch(raw)
    assert codec.verify(raw) and head["base_offset"] == 7 and head["record_count"] == len(parts)
    assert records == [(i, t, k, v, list(h)) for i, (t, k, v, h) in enumerate(parts)]


def test_known_sizes():
    assert len(batch_of([(0, None, b"x" * 48, [])])) == 116
    assert len(batch_of([(0, b"a", b"12", [])])) == 71
    assert len(batch_of([(0, b"user1", b"x" * 40, [])])) == 113


def test_null_and_empty_differ():
    _, [(_, _, key, value, _)] = codec.decode_batch(batch_of([(0, None, b"", [])]))
    assert key is None and value == b""


def test_stamping_keeps_the_checksum():
    raw = codec.stamp(batch_of([(0, b"k", b"v", [])]), 42, 7)
    head, _ = codec.decode_batch(raw)
    assert codec.verify(raw) and (head["base_offset"], head["leader_epoch"]) == (42, 7)


def test_every_truncation_and_flipped_bit_is_noticed():
    raw = batch_of([(5, b"key", b"value", [(b"h", None)])])
    for n in range(len(raw)):
        with pytest.raises((codec.Corrupt, struct.error)):
            codec.decode_batch(raw[:n])
        assert list(codec.walk(raw[:n])) == []
    for at in range(codec.CRC_AT, len(raw)):
        bad = raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :]
        assert not codec.verify(bad)


def test_trailing_bytes_compression_and_disordered_deltas_are_refused():
    raw = batch_of([(0, b"k", b"v", [])])
    with pytest.raises(codec.Corrupt):
        codec.decode_batch(raw + b"x")
    with pytest.raises(codec.Corrupt):
        codec.decode_batch(batch_of([(0, b"k", b"v", [])], attributes=1))
    with pytest.raises(ValueError):
        codec.encode_batch([(1, 0, None, None, []), (1, 0, None, None, [])])
    with pytest.raises(ValueError):
        codec.encode_batch([])


@pytest.mark.parametrize("n", [1_023, 1_024, 1_025, 5_000, 300_001])
def test_checksums_of_long_strings_are_combined(n):
    r = random.Random(n)
    data = r.randbytes(n)
    crc, table = 0xFFFFFFFF, codec.crc_table().tolist()
    for b in data:
        crc = crc >> 8 ^ table[(crc ^ b) & 255]
    assert codec.crc32c(data) == codec.crc32c_many([b"", data, b"x"])[1] == crc ^ 0xFFFFFFFF


def test_holes_in_a_batch():
    _, records = codec.decode_batch(codec.encode_batch([(0, 0, None, None, []), (5, 0, None, None, [])]))
    assert [r[0] for r in records] == [0, 5]


def test_checksum_column(spark):
    df = spark.createDataFrame([(b"123456789",), (None,), (b"",)], "v binary").select(codec.crc32c_column(F.col("v")).alias("c"))
    assert sorted((r["c"] for r in df.collect()), key=repr) == sorted([0xE3069283, None, 0], key=repr)


def test_segment_files(spark, tmp_path):
    records = spark.createDataFrame(
        [("t", 0, b, d, 0, f"k{b + d}".encode(), None if d else b"v", [(b"h", None)]) for b in (0, 2, 4) for d in (0, 1)],
        "topic string, partition_id int, batch_base bigint, offset_delta int, timestamp_delta bigint, rec_key binary, rec_value binary, headers array<struct<hkey:binary,hvalue:binary>>",
    )
    batches = spark.createDataFrame(
        [("t", 0, b, 0 if b < 4 else 4, 3, 0, 1000, 1000, -1, -1, -1) for b in (0, 2, 4)],
        "topic string, partition_id int, base_offset bigint, segment_base bigint, leader_epoch int, attributes int, first_timestamp bigint, max_timestamp bigint, producer_id bigint, producer_epoch int, base_sequence int",
    )
    write_segments(codec.encode_batches(records, batches), str(tmp_path))
    (tmp_path / "t-00").mkdir()  # not a partition
    (tmp_path / "t-1.5.delete").mkdir()
    torn = tmp_path / "t-0" / f"{0:020d}.log"
    register(spark)
    read = lambda **o: spark.read.format("segments").options(**o).load(str(tmp_path))
    offsets = lambda: sorted(r["log_offset"] for r in read().where("error is null").collect())
    errors = lambda: {(r["segment_base"], r["position"], r["error"]) for r in read().where("error is not null").collect()}
    assert offsets() == [0, 1, 2, 3, 4, 5] and errors() == set()
    first = read(headers_only="true").orderBy("base_offset").first()
    assert (first["segment_base"], first["position"], first["record_count"]) == (0, 0, 2)
    raw = torn.read_bytes()
    half = len(raw) // 2
    torn.write_bytes(raw[:-1])
    assert offsets() == [0, 1, 4, 5] and errors() == {(0, half, "the file ends within a batch")}
    assert read(headers_only="true").count() == 2
    # a whole batch with a good checksum that can't be read ends its segment, not the job
    odd = codec.sealed([raw[half : half + 22] + b"\x01" + raw[half + 23 :]])[0]
    torn.write_bytes(raw[:half] + odd)
    assert offsets() == [0, 1, 4, 5] and errors() == {(0, half, "compressed batches can't be read")} and read(headers_only="true").count() == 3
    torn.write_bytes(raw[:-1] + bytes([raw[-1] ^ 1]))
    assert errors() == {(0, half, "the checksum is wrong")}
    assert codec.decode_segments(spark.createDataFrame([("t", 0, 0, raw[:half] + odd), ("t", 0, 4, raw)], "topic string, partition_id int, segment_base bigint, content binary")).count() == 6
    # a removed partition is gone at once and deleted after its delay, or at the next start
    assert remove_partition(spark, f"file://{tmp_path}", "t", 0, 1_000) and not remove_partition(spark, f"file://{tmp_path}", "t", 0, 1_000)
    assert read().count() == 0 and sweep_removed(spark, f"file://{tmp_path}", 60_999) == ["t-1.5.delete"]
    assert sweep_removed(spark, f"file://{tmp_path}", 61_000) == ["t-0.1000.delete"] and not (tmp_path / "t-0.1000.delete").exists()
    (tmp_path / "u-0.7.delete").mkdir()
    assert sweep_removed(spark, f"file://{tmp_path}") == ["u-0.7.delete"]


SETTINGS = {c: k + 1 for k, c in enumerate(metas.NUMBERS)} | {"cleanup": 1, "delete_retention_ms": 9}


def test_metadata_versions_and_damage():
    raw = metas.encode_meta("orders", 3, SETTINGS)
    assert metas.decode_meta(raw) == {"topic": "orders", "partition_id": 3} | SETTINGS
    assert metas.decode_meta(metas.encode_meta("o", 0, SETTINGS | {"retention_bytes": None}))["retention_bytes"] is None
    old = metas.decode_meta(raw[:4] + struct.pack(">h", 1) + raw[6:-9])
    assert (old["cleanup"], old["delete_retention_ms"], old["retention_ms"]) == (0, None, SETTINGS["retention_ms"])
    for bad in (raw + b"x", b"x" + raw[1:], raw[:4] + struct.pack(">h", 3) + raw[6:], raw[:4] + struct.pack(">h", 0) + raw[6:], raw[:-9] + b"\x02" + raw[-8:]):
        with pytest.raises(codec.Corrupt):
            metas.decode_meta(bad)
    for n in range(len(raw)):
        with pytest.raises(codec.Corrupt):
            metas.decode_meta(raw[:n])


def test_metadata_are_replaced_and_belong_to_their_folder(spark, tmp_path):
    row = lambda p, n: ("t", p, *[n] * 5, None, n, 0, n)
    for n in (5, 6):
        metas.write(spark.createDataFrame([row(0, n), row(1, n)], metas.META), f"file://{tmp_path}")
    got = metas.read(spark, f"file://{tmp_path}").collect()
    assert {(r["partition_id"], r["retention_ms"], r["retention_bytes"], r["delete_retention_ms"]) for r in got} == {(0, 6, None, 6), (1, 6, None, 6)}
    (tmp_path / "t-1").rename(tmp_path / "t-2")
    with pytest.raises(Exception, match="of another partition"):
        metas.read(spark, f"file://{tmp_path}").collect()


def test_assignments():
    parts = [("b", 1), ("a", 2), ("a", 0)]
    raw = metas.encode_assignment(parts)
    assert metas.decode_assignment(raw) == sorted(parts) and metas.decode_assignment(b"") == [] and metas.decode_assignment(metas.encode_assignment([])) == []
    for bad in (raw + b"x", raw[:-1], b"\x00\x02" + raw[2:]):
        with pytest.raises(codec.Corrupt):
            metas.decode_assignment(bad)
