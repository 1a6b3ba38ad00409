"""Filling containers of fixed capacity: first-fit decreasing with a tournament tree, in randomised groups.

Documents fall into groups by a hash of their id. In a group the items are taken from the largest to the smallest, and each goes
into the first bin with room for it; a tournament tree over the room left in the bins finds that bin in logarithmic time. A
document longer than the capacity is cut into full containers and a rest, which is an item like any other; no other document is
ever cut.

Scale: sizes are measured in one narrow pass; only (id, size) is shuffled, once for all capacities. Groups hold ``GROUP_DOCS`` documents on average, so their number grows
with the corpus and each costs the same; the room lost at the edge of a group is under one container of hundreds.

Nulls and odd input: a document without tokens (null or empty text) needs no room and is listed with a null bin and piece 0; rows of the same id
are separate items; ties in size are taken in the order of id and piece, so the result doesn't depend on partitioning; an empty table gives an empty result; capacities below
1 or null are left out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.common import ship
from tidelog.llm.tokenize import PATTERN, VOCABULARY, count_tokens

GROUP_DOCS = 4_096
SEED = 20_011
OUT = "pack_name string, capacity_tokens int, doc_id bigint, piece int, n_tokens int, pack_group int, bin int"


class Tournament:
    """Room left in bins 0, 1, ...; ``place(size)`` puts an item into the first bin with room and tells which."""

    def __init__(self, capacity: int, most_bins: int) -> None:
        self.capacity, self.leaves = capacity, 1 << max(0, most_bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)  # bins not begun are empty: they win only where no earlier bin has room

    def place(self, size: int) -> int:
        room, at = self.room, 1
        if size > room[1]:
            raise ValueError("no bin has room for the item")
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        found = at - self.leaves
        while at > 1:
            at //= 2
            most = room[2 * at] if room[2 * at] >= room[2 * at + 1] else room[2 * at + 1]
            if room[at] == most:
                break
            room[at] = most
        return found


def first_fit_decreasing(ids: list[int], sizes: list[int], capacity: int) -> list[tuple[int, int, int, int | None]]:
    """(id, piece, size, bin) for every piece of every item."""
    out: list[tuple[int, int, int, int | None]] = []
    rests: list[tuple[int, int, int]] = []
    full = 0
    for i, n in sorted(zip(ids, sizes, strict=True)):
        if n <= 0:
            out.append((i, 0, 0, None))
            continue
        pieces = (n - 1) // capacity  # all but the last piece fill a bin
        for k in range(pieces):
            out.append((i, k, capacity, full))
            full += 1
        rests.append((n - pieces * capacity, i, pieces))
    rests.sort(key=lambda x: (-x[0], x[1], x[2]))
    tree = Tournament(capacity, len(rests)) if rests else None
    out += [(i, k, n, full + tree.place(n)) for n, i, k in rests]
    return out


def _pack_group(kinds: list[tuple[str, int]]):
    def pack(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        from tidelog.llm.pack import OUT, first_fit_decreasing

        ids, sizes, out = items["doc_id"].tolist(), items["n_tokens"].tolist(), []
        for name, capacity in kinds:
            rows = pd.DataFrame(first_fit_decreasing(ids, sizes, capacity), columns=["doc_id", "piece", "n_tokens", "bin"])
            out.append(rows.astype({"bin": "Int32"}).assign(pack_name=name, capacity_tokens=capacity, pack_group=key[0]))
        return pd.concat(out)[[c.split()[0] for c in OUT.split(", ")]]

    return pack


def pack_sizes(sizes: DataFrame, packs: DataFrame, n_docs: int, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pack ``sizes`` (doc_id, n_tokens) into every capacity of ``packs`` (pack_name, capacity_tokens)."""
    ship(sizes.sparkSession)
    groups = max(1, round(n_docs / group_docs))
    # the capacities are a parameter of the job: a handful of rows
    kinds = sorted({(r["pack_name"], int(r["capacity_tokens"])) for r in packs.where("capacity_tokens >= 1").select("pack_name", "capacity_tokens").distinct().collect()})
    grouped = sizes.where("doc_id is not null").withColumn("pack_group", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(groups)).cast("int"))
    # a small shuffle and long work: in as many partitions as the session says, whatever their size
    spread = (grouped if kinds else grouped.limit(0)).repartition(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pack_group")
    return spread.groupBy("pack_group").applyInPandas(_pack_group(kinds or [("", 1)]), OUT)


def pack_documents(documents: DataFrame, packs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Every document, whole or in pieces, with its container in each kind of pack: (pack_group, bin) names a container of the kind."""
    n = documents.select("doc_id").count()
    return pack_sizes(count_tokens(documents, path=path, pattern=pattern), packs, n, group_docs)


def pack_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens and the share of room used, per kind of pack, with the least number of containers that could do."""
    bins = packed.where("bin is not null").groupBy("pack_name", "capacity_tokens", "pack_group", "bin").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n_pieces"))
    return bins.groupBy("pack_name", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("n_bins"),
        F.sum("used").alias("n_tokens"),
        F.sum("n_pieces").alias("n_pieces"),
        F.max("used").alias("max_used"),
        F.ceil(F.sum("used") / F.first("capacity_tokens")).alias("least_bins"),
        (F.sum("used") / (F.count(F.lit(1)) * F.first("capacity_tokens"))).alias("fill"),
    )
