"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.common import table
from tidelog.llm import mojibake, pack, ribbon, tokenize


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return ribbon.seen_before(table(spark, d, "log_records"), table(spark, d, "digest_history"))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """Every generation with its keys, bits a key, audit and rate of wrong answers."""
    return ribbon.rates(table(spark, d, "log_records"), table(spark, d, "digest_history"))


def p2_keys(spark: SparkSession, d: str) -> DataFrame:
    """The keys of every generation of the first level and of the history, and whether the audit keeps within twice the rate that the fingerprint promises."""
    r = p2_rates(spark, d).where("generation not like 'log:%' or generation like 'log:0:%'")
    return r.select("generation", "n_keys", (F.col("wrong_rate") < 2 * 2.0**-ribbon.FINGERPRINT + 60.0 / F.col("n_probes") * 2.0 ** (ribbon.AUDIT_BITS - ribbon.FINGERPRINT)).alias("within"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents"))


def p8_packs(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack_report(p8_packs(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "documents"))


def p9_repaired(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repaired(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_rates, p2_keys, p7_ids, p8_packs, p8_report, p9_found, p9_repaired)}

_DIGEST = """(SELECT CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END::BIGINT FROM (SELECT list_reduce(
  list_prepend({start}::HUGEINT, list_transform(range(octet_length(rec_key)), lambda i: ('0x' || substr(hex(rec_key), 2 * i + 1, 2))::HUGEINT)),
  lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS h))"""

SQL = {
    "p2_found": f"""WITH rec AS (SELECT DISTINCT topic, partition_id, log_offset, rec_key FROM log_records WHERE topic = 'gate-tokens' AND rec_key IS NOT NULL),
keys AS (SELECT topic, partition_id, rec_key, min(log_offset) AS first_offset FROM rec GROUP BY ALL),
dig AS (SELECT *, {_DIGEST.format(start=0xCBF29CE484222325)} AS high, {_DIGEST.format(start=0x9E3779B97F4A7C15)} AS low FROM keys),
known AS (SELECT d.topic, d.partition_id, d.rec_key, d.first_offset,
  EXISTS (SELECT 1 FROM digest_history x WHERE x.topic = d.topic AND x.partition_id = d.partition_id AND x.digest_high = d.high AND x.digest_low = d.low) AS past FROM dig d)
SELECT r.topic, r.partition_id, r.log_offset FROM rec r JOIN known k ON r.topic = k.topic AND r.partition_id = k.partition_id AND r.rec_key = k.rec_key
WHERE r.log_offset > k.first_offset OR k.past""",
    "p2_keys": f"""WITH rec AS (SELECT DISTINCT topic, partition_id, log_offset, rec_key FROM log_records WHERE topic = 'gate-tokens' AND rec_key IS NOT NULL),
gen AS (SELECT DISTINCT partition_id, rec_key, log_offset // {ribbon.GENERATION_OFFSETS} AS g FROM rec), top AS (SELECT partition_id, max(g) AS newest FROM gen GROUP BY partition_id)
SELECT 'log:0:' || g AS generation, count(*) AS n_keys, true AS within FROM gen JOIN top USING (partition_id) WHERE g < newest AND g % {ribbon.FAN} <> {ribbon.FAN - 1} GROUP BY g
UNION ALL SELECT 'past:' || pass_id, count(DISTINCT (partition_id, digest_high, digest_low)), true FROM digest_history
  WHERE topic = 'gate-tokens' AND digest_high IS NOT NULL AND digest_low IS NOT NULL GROUP BY pass_id""",
}
