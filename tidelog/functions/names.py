"""Names of topics, partition directories and segment files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable_name(name: Column) -> Column:
    """Letters, digits, dot, underscore and dash only, and neither ``.`` nor ``..``; null isn't usable."""
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9._-]+\z") & ~name.isin(".", ".."), F.lit(False))


def directory_name(topic: Column, partition: Column) -> Column:
    return F.concat(topic, F.lit("-"), partition.cast("string"))


def parsed_directory(name: Column) -> tuple[Column, Column]:
    """Topic and partition of ``topic-N``, cut at the last dash; null unless writing them again gives the name (``orders-03`` doesn't)."""
    topic, number = F.regexp_extract(name, r"\A(.+)-([0-9]+)\z", 1), F.regexp_extract(name, r"\A(.+)-([0-9]+)\z", 2)
    n = number.try_cast("int")
    good = n.isNotNull() & (n.cast("string") == number) & usable_name(topic)
    return F.when(good, topic), F.when(good, n)


def segment_name(base: Column, suffix: str = ".log") -> Column:
    """Base offset in 20 digits."""
    return F.concat(F.lpad(base.cast("string"), 20, "0"), F.lit(suffix))


def parsed_segment(name: Column, suffix: str = ".log") -> Column:
    """Base offset of a segment file; null for anything but 20 digits that fit and the suffix."""
    digits = F.regexp_extract(name, r"\A([0-9]{20})" + suffix.replace(".", r"\.") + r"\z", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def removed_name(topic: Column, partition: Column, at_ms: Column) -> Column:
    """The name under which a removed partition waits to be deleted."""
    return F.concat(directory_name(topic, partition), F.lit("."), at_ms.cast("string"), F.lit(".delete"))


def bucket_of(key: Column, n: int) -> Column:
    """Partition of a text or binary key among ``n``: the first eight hex digits of its MD5, which any engine can repeat."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % n).cast("int")
