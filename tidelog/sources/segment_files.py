"""Directories of segments: ``<topic>-<partition>/<20 digits>.log``, each a run of record batches.

``register(spark)``, then ``spark.read.format("segments").load(directory)``. One input partition per segment
file, found by listing; directories and files under other names are passed over, those ending in ``.delete`` among them. A file
is read batch by batch, so a task holds one batch; it ends at the first that is torn, corrupt or can't be decoded, and a last row tells in ``error`` where and why, all else null. That doesn't
touch other files. With ``headers_only`` the 61 bytes of each header are read and the file is sought to the next: no body is read, and no checksum is computed.

Paths are those of any file system that both Spark and Arrow reach (file, hdfs, s3, gs). Writing is done by the executors: a task writes the batches of one segment, in order.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tidelog.common import _file_system, arrow_fs, listing, ship
from tidelog.functions.codec import CRC_AT, CRC_FROM, DECODED, HEADER, Corrupt, batch_size, crc32c, decode_batch

_DIRECTORY, _FILE = re.compile(r"([A-Za-z0-9._-]+)-(0|[1-9][0-9]*)"), re.compile(r"([0-9]{20})\.log")
HEADERS = "topic string, partition_id int, segment_base bigint, position bigint, base_offset bigint, batch_length int, leader_epoch int, record_count int, max_timestamp bigint"
#: Time that a removed partition waits before it is deleted.
DELETE_DELAY_MS = 60_000


class SegmentFile(InputPartition):
    def __init__(self, topic: str, partition: int, base: int, path: str) -> None:
        self.topic, self.partition, self.base, self.path = topic, partition, base, path


class SegmentReader(DataSourceReader):
    def __init__(self, root: str, headers_only: bool) -> None:
        self.root, self.headers_only = root, headers_only

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, base = arrow_fs(self.root)
        out = []
        for x in sorted(system.get_file_info(fs.FileSelector(base, recursive=True)), key=lambda x: x.path):
            folder, _, name = x.path.rpartition("/")
            place, number = _DIRECTORY.fullmatch(folder.rpartition("/")[2]), _FILE.fullmatch(name)
            if x.is_file and place and number and folder.rpartition("/")[0].rstrip("/") == base.rstrip("/"):
                out.append(SegmentFile(place[1], int(place[2]), int(number[1]), x.path))
        return out

    def read(self, partition: SegmentFile | None) -> Iterator[tuple]:
        if partition is None:  # a directory without segments
            return
        place = (partition.topic, partition.partition, partition.base)
        system, _ = arrow_fs(self.root)
        at = 0
        with system.open_input_file(partition.path) as f:
            end = f.size()
            while at < end:
                try:
                    f.seek(at)
                    head = f.read(min(HEADER.size, end - at))
                    n = batch_size(head)
                    if at + n > end:
                        raise Corrupt("the file ends within a batch")
                    if self.headers_only:
                        base, length, epoch, _, _, _, _, _, newest, *_, count = HEADER.unpack(head)
                        yield (*place, at, base, length, epoch, count, newest)
                    else:
                        batch = head + f.read(n - HEADER.size)
                        if int.from_bytes(batch[CRC_AT : CRC_AT + 4], "big") != crc32c(batch[CRC_FROM:]):
                            raise Corrupt("the checksum is wrong")
                        header, records = decode_batch(batch)
                        base, first = header["base_offset"], header["first_timestamp"]
                        for d, t, k, v, h in records:
                            yield (*place, base, base + d, d, t, first, k, v, [(a, b) for a, b in h], at, None)
                except Corrupt as e:
                    if not self.headers_only:
                        yield (*place, *[None] * 8, at, str(e))
                    return
                at += n


class SegmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segments"

    def _headers_only(self) -> bool:
        return str(self.options.get("headers_only", "false")).lower() == "true"

    def schema(self) -> str:
        return HEADERS if self._headers_only() else f"{DECODED}, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SegmentReader(self.options["path"], self._headers_only())


def register(spark: SparkSession) -> None:
    """Make the format ``segments`` known to a session and its executors."""
    ship(spark)
    spark.dataSource.register(SegmentSource)


def write_segments(encoded: DataFrame, root: str) -> None:
    """Write encoded batches (see ``encode_batches``) as segment files, replacing those of the same name.

    Batches of a segment are sorted in one task by the shuffle and streamed into a file aside, which is renamed when it is whole: a segment is bounded by its size limit, a repeated task
    writes it again.
    """
    ship(encoded.sparkSession)

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidelog.common import arrow_fs

        system, base = arrow_fs(root)
        place, out, names, written = None, None, ("", ""), 0

        def close() -> None:
            if out is not None:
                out.close()
                system.move(*names)

        for part in parts:
            for topic, partition, segment, batch in part.itertuples(index=False):
                if (topic, partition, segment) != place:
                    close()
                    place, folder = (topic, partition, segment), f"{base}/{topic}-{partition}"
                    system.create_dir(folder)
                    names = f"{folder}/.{segment:020d}-{uuid.uuid4().hex}", f"{folder}/{segment:020d}.log"
                    out, written = system.open_output_stream(names[0]), written + 1
                out.write(batch)
        close()
        yield pd.DataFrame({"n": [written]})

    key = ["topic", "partition_id", "segment_base"]
    sorted_ = encoded.repartition(*key).sortWithinPartitions(*key, "base_offset").select(*key, "batch")
    sorted_.mapInPandas(put, "n bigint").agg(F.sum("n")).collect()  # one number


def remove_partition(spark: SparkSession, root: str, topic: str, partition: int, now_ms: int) -> bool:
    """Take a partition out of the directory: it is renamed, and so no longer found, at once, and deleted by a later sweep. False where there is none."""
    fs, at = _file_system(spark, f"{root}/{topic}-{partition}")
    return fs.exists(at) and fs.rename(at, _file_system(spark, f"{root}/{topic}-{partition}.{now_ms}.delete")[1])


def sweep_removed(spark: SparkSession, root: str, now_ms: int | None = None, delay_ms: int = DELETE_DELAY_MS) -> list[str]:
    """Delete the removed partitions whose delay is over; at a start, without ``now_ms``, all of them, as nobody reads them any more. Returns their names."""
    gone = []
    for name in listing(spark, root):
        at = re.fullmatch(r".+\.([0-9]+)\.delete", name)
        if name.endswith(".delete") and (now_ms is None or (at and now_ms - int(at[1]) >= delay_ms)):
            fs, path = _file_system(spark, f"{root}/{name}")
            fs.delete(path, True)
            gone.append(name)
    return gone
