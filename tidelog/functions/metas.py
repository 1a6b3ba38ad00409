"""Binary forms of partition metadata and of assignments, with their versions; and the files in which metadata lie.

All numbers are big-endian; a text is its length in 16 bits and its bytes. Metadata of an older version are read (without what it hadn't), of a newer one refused, as are trailing bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.common import ship
from tidelog.functions.codec import Corrupt

# Fixed values of the formats.
META_MARK, META_VERSION, META_OLDEST, ASSIGNMENT_VERSION = 0x444B504D, 2, 1, 1
UNLIMITED = -1
META_FILE = "partition.meta"
NUMBERS = ["max_segment_bytes", "max_segment_age_ms", "index_interval_bytes", "max_index_bytes", "retention_ms", "retention_bytes", "delete_delay_ms"]
META = "topic string, partition_id int, " + ", ".join(f"{c} bigint" for c in NUMBERS) + ", cleanup tinyint, delete_retention_ms bigint"
COLUMNS = [c.split()[0] for c in META.split(", ")]


class Reader:
    """Numbers and texts from bytes, all of which must be used."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, form: str) -> int:
        if self.at + struct.calcsize(form) > len(self.data):
            raise Corrupt("the data end within a number")
        (value,) = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return value

    def text(self) -> str:
        n = self.take(">h")
        if n < 0 or self.at + n > len(self.data):
            raise Corrupt("a text has an impossible length")
        self.at += n
        return self.data[self.at - n : self.at].decode("utf-8")

    def end(self) -> None:
        if self.at != len(self.data):
            raise Corrupt("there are trailing bytes")


def _text(value: str) -> bytes:
    raw = value.encode("utf-8")
    return struct.pack(">h", len(raw)) + raw


def encode_meta(topic: str, partition_id: int, settings: dict[str, int | None]) -> bytes:
    numbers = [UNLIMITED if settings[c] is None else int(settings[c]) for c in NUMBERS]
    head = struct.pack(">Ih", META_MARK, META_VERSION) + _text(topic) + struct.pack(">i", partition_id)
    return head + struct.pack(">7qbq", *numbers, settings["cleanup"], settings["delete_retention_ms"])


def decode_meta(data: bytes) -> dict:
    """A row of META. Version 1 knew no compaction: it deletes, and its horizon is null."""
    r = Reader(data)
    if r.take(">I") != META_MARK:
        raise Corrupt("this isn't metadata")
    if not META_OLDEST <= (version := r.take(">h")) <= META_VERSION:
        raise Corrupt("unknown version")
    out = {"topic": r.text(), "partition_id": r.take(">i")}
    if not out["topic"] or out["partition_id"] < 0:
        raise Corrupt("an impossible partition")
    out |= {c: r.take(">q") for c in NUMBERS}
    out["retention_bytes"] = None if out["retention_bytes"] == UNLIMITED else out["retention_bytes"]
    out |= {"cleanup": 0, "delete_retention_ms": None}
    if version > 1:
        out |= {"cleanup": r.take(">b"), "delete_retention_ms": r.take(">q")}
        if out["cleanup"] not in (0, 1):
            raise Corrupt("unknown cleanup")
    r.end()
    return out


def write(partitions: DataFrame, root: str) -> None:
    """Write the metadata of partitions (META) to ``root/<topic>-<partition>/partition.meta``, each by its task: aside, then renamed over what was there, so that a reader meets one or the other whole."""
    ship(partitions.sparkSession)

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidelog.common import put_file
        from tidelog.functions import metas as m

        for part in parts:
            rows = part.astype(object).where(part.notna(), None).to_dict("records")
            for r in rows:
                settings = {c: None if r[c] is None else int(r[c]) for c in (*m.NUMBERS, "cleanup", "delete_retention_ms")}
                put_file(f"{root}/{r['topic']}-{r['partition_id']}/{m.META_FILE}", m.encode_meta(r["topic"], int(r["partition_id"]), settings))
            yield pd.DataFrame({"n": [len(rows)]})

    partitions.select(*COLUMNS).mapInPandas(put, "n bigint").agg(F.sum("n")).collect()


def read(spark: SparkSession, root: str) -> DataFrame:
    """The metadata of all partitions below ``root`` (META). Metadata that name another partition than their folder are refused."""
    ship(spark)

    def get(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidelog.functions import metas as m

        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                meta = m.decode_meta(bytes(content))
                if path.split("/")[-2] != f"{meta['topic']}-{meta['partition_id']}":
                    raise m.Corrupt(f"{path} is of another partition")
                rows.append(meta)
            out = pd.DataFrame(rows, columns=m.COLUMNS)
            yield out.astype({c: "Int64" for c in (*m.NUMBERS, "delete_retention_ms")})

    return spark.read.format("binaryFile").option("pathGlobFilter", META_FILE).load(f"{root}/*").select("path", "content").mapInPandas(get, META)


def encode_assignment(parts: list[tuple[str, int]]) -> bytes:
    by: dict[str, list[int]] = {}
    for topic, partition in sorted(parts):
        by.setdefault(topic, []).append(partition)
    return struct.pack(">hi", ASSIGNMENT_VERSION, len(by)) + b"".join(_text(t) + struct.pack(f">i{len(ps)}i", len(ps), *ps) for t, ps in by.items())


def decode_assignment(data: bytes) -> list[tuple[str, int]]:
    """Topics and partitions; no bytes are no assignment."""
    if not data:
        return []
    r = Reader(data)
    if r.take(">h") != ASSIGNMENT_VERSION:
        raise Corrupt("unknown version")
    out = []
    for _ in range(r.take(">i")):
        topic = r.text()
        out += [(topic, r.take(">i")) for _ in range(r.take(">i"))]
    r.end()
    return out


MEMBER = ["group_id", "member_id"]


def encode_assignments(assigned: DataFrame) -> DataFrame:
    """``assignment`` bytes of each member of (group_id, member_id, topic, partition_id)."""
    ship(assigned.sparkSession)
    held = assigned.groupBy(*MEMBER).agg(F.collect_list(F.struct("topic", "partition_id")).alias("parts"))  # the partitions of one member

    @F.pandas_udf("binary")
    def encoded(parts: pd.Series) -> pd.Series:
        from tidelog.functions.metas import encode_assignment

        return parts.map(lambda ps: encode_assignment([(p["topic"], int(p["partition_id"])) for p in ps]))

    return held.select(*MEMBER, encoded("parts").alias("assignment"))


def decode_assignments(members: DataFrame) -> DataFrame:
    ship(members.sparkSession)

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidelog.functions.metas import decode_assignment

        for part in parts:
            rows = [(g, m, *tp) for g, m, a in part[["group_id", "member_id", "assignment"]].itertuples(index=False) for tp in decode_assignment(bytes(a or b""))]
            yield pd.DataFrame(rows, columns=["group_id", "member_id", "topic", "partition_id"])

    return members.mapInPandas(decode, "group_id string, member_id string, topic string, partition_id int")
