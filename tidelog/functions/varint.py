"""Sizes of variable-length integers and encoded records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def varint_size(value: Column) -> Column:
    """Bytes of the zigzag variable-length form of an integer column: seven bits a byte, at most ten."""
    v = value.cast("bigint")
    # zigzag takes one more bit than the magnitude, which is the value with the bits of a negative one turned over
    bits = F.length(F.bin(v.bitwiseXOR(F.shiftright(v, 63))))
    return F.floor((bits + 7) / 7).cast("int")


def bytes_size(value: Column) -> Column:
    """Bytes of a nullable byte string with its length; null is length -1."""
    n = F.octet_length(value)
    return F.when(value.isNull(), 1).otherwise(varint_size(n) + n)


def record_size(timestamp_delta: Column, offset_delta: Column, key: Column, value: Column, headers: Column) -> Column:
    """Encoded size of a record, its own length included. Null headers are none."""
    of_headers = F.aggregate(headers, F.lit(0), lambda total, h: total + bytes_size(h["hkey"]) + bytes_size(h["hvalue"]))
    n = F.when(headers.isNull(), 0).otherwise(F.size(headers))
    body = F.lit(1) + varint_size(timestamp_delta) + varint_size(offset_delta) + bytes_size(key) + bytes_size(value) + varint_size(n) + F.coalesce(of_headers, F.lit(0))
    return (varint_size(body) + body).cast("int")
