"""Queries of the pipeline operators over the log tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.common import materialize, shared_dir, table
from tidelog.operators import chunking, dedup, kslack, ledger, log, lsm


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return kslack.beyond_cutoff(table(spark, d, "log_records"), table(spark, d, "batches"))


def p1_periods(spark: SparkSession, d: str) -> DataFrame:
    return kslack.period_values(table(spark, d, "log_records"), table(spark, d, "batches"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.copies(table(spark, d, "log_records"), table(spark, d, "batches"))


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    """Exactly one copy of each message, per topic and partition."""
    kept = dedup.deduplicated(table(spark, d, "log_records").select("topic", "partition_id", "log_offset", "batch_base", "offset_delta", "size_bytes"), table(spark, d, "batches"))
    return kept.groupBy("topic", "partition_id").agg(F.count(F.lit(1)).alias("n_records"), F.sum("size_bytes").alias("sum_bytes"), F.sum("log_offset").alias("sum_offset"))


def p3_calls(spark: SparkSession, d: str) -> DataFrame:
    """The copies found by two calls on one index, the second of which takes only the newer half of each partition."""
    records, batches = table(spark, d, "log_records"), table(spark, d, "batches")
    cuts = log.bounds(table(spark, d, "segments")).select(*log.TP, F.floor((F.col("log_start") + F.col("log_end")) / 2).alias("cut"))  # a row per partition
    cut = records.join(F.broadcast(cuts), log.TP)
    base = shared_dir(spark, "dedup")
    first = dedup.copies(cut.where("log_offset < cut").drop("cut"), batches, 2, base).withColumn("call", F.lit(1))
    return first.unionByName(dedup.copies(cut.where("log_offset >= cut").drop("cut"), batches, 2, base).withColumn("call", F.lit(2)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return chunking.heavy_keys(table(spark, d, "log_records"), table(spark, d, "commits"))


def p4_keys(spark: SparkSession, d: str) -> DataFrame:
    """Ordered per-key results of every key."""
    return chunking.record_keys(table(spark, d, "log_records")).drop("n_chunks").withColumn("rec_key", F.hex("rec_key"))


def _feed(spark: SparkSession, d: str) -> DataFrame:
    """The change feeds (topics with cleanup 1) without repeated deliveries."""
    topics = [r["topic"] for r in table(spark, d, "topic_meta").where("cleanup = 1").select("topic").distinct().collect()]  # a fixed table
    records = table(spark, d, "log_records").where(F.col("topic").isin(topics))  # reaches the scan
    key = ["topic", "partition_id", "log_offset"]
    twice = dedup.copies(records, table(spark, d, "batches"))
    keyed = records.where("rec_key is not null").select(*key, "rec_key", "rec_value")
    return materialize(keyed.join(twice, key, "left_anti").withColumnRenamed("log_offset", "seq"), "feed")  # read once per run


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lsm.apply_feed(_feed(spark, d)).places().select("topic", "partition_id", F.col("seq").alias("log_offset"))


def p5_rows(spark: SparkSession, d: str) -> DataFrame:
    """The present rows with their content."""
    return lsm.present_rows(_feed(spark, d)).select("topic", "partition_id", F.hex("rec_key").alias("rec_key"), F.col("seq").alias("log_offset"), F.hex("rec_value").alias("rec_value"))


def p5_calls(spark: SparkSession, d: str) -> DataFrame:
    """The feed applied in two calls to one table, opened anew for the second, which gets the newer half of each partition: the present rows after each."""
    feed = _feed(spark, d)
    cuts = log.bounds(table(spark, d, "segments")).select(*log.TP, F.floor((F.col("log_start") + F.col("log_end")) / 2).alias("cut"))  # a row per partition
    cut = feed.join(F.broadcast(cuts), log.TP)
    base = f"{shared_dir(spark, 'lsm')}"
    first = materialize(lsm.apply_feed(cut.where("seq < cut").drop("cut"), 2, base).places().withColumn("call", F.lit(1)), "p5-call")
    second = lsm.apply_feed(cut.where("seq >= cut").drop("cut"), 2, base).places().withColumn("call", F.lit(2))
    return first.unionByName(second).groupBy("call", "topic", "partition_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("seq").alias("sum_offset"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return ledger.unprocessed(table(spark, d, "commits"), table(spark, d, "log_records"))


def p6_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The planned work items per reader and partition."""
    items = ledger.plan_items(table(spark, d, "commits"), table(spark, d, "log_records"))
    return items.groupBy("group_id", "topic", "partition_id").agg(F.count(F.lit(1)).alias("n_items"), F.min("from_offset").alias("from_offset"))


def p6_runs(spark: SparkSession, d: str) -> DataFrame:
    """Three runs over one ledger, opened anew each time, of a log that grows in between (first its lower half, then all) and then doesn't: what each had to process."""
    commits, records = table(spark, d, "commits"), table(spark, d, "log_records")
    cuts = log.bounds(table(spark, d, "segments")).select(*log.TP, F.floor((F.col("log_start") + F.col("log_end")) / 2).alias("cut"))  # a row per partition
    half = records.join(F.broadcast(cuts), log.TP).where("log_offset < cut").drop("cut")
    base = ledger.Ledger(spark).base
    runs = [ledger.Ledger(spark, base).run(commits, r, f"worker{k}", k).withColumn("run", F.lit(k)) for k, r in enumerate((half, records, records))]
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).groupBy("run", *ledger.GTP).agg(
        F.count(F.lit(1)).alias("n_records"), F.min("log_offset").alias("first_offset"), F.max("log_offset").alias("last_offset")
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_periods, p3_found, p3_kept, p3_calls, p4_found, p4_keys, p5_found, p5_rows, p5_calls, p6_found, p6_ledger, p6_runs)}

TIMED_SQL = """
rec AS (SELECT DISTINCT topic, partition_id, log_offset, batch_base, timestamp_delta, size_bytes FROM log_records),
bat AS (SELECT DISTINCT topic, partition_id, base_offset, first_timestamp, epoch_us(append_ts) AS arrived FROM batches),
timed AS (
  SELECT r.topic, r.partition_id, r.log_offset, r.batch_base, r.size_bytes,
         CASE WHEN b.first_timestamp <> -1 THEN b.first_timestamp + r.timestamp_delta END AS e, b.arrived
  FROM rec r JOIN bat b ON r.topic = b.topic AND r.partition_id = b.partition_id AND r.batch_base = b.base_offset),
tops AS (
  SELECT topic, partition_id, batch_base, max(CASE WHEN e * 1000 <= arrived THEN e END) AS top FROM timed GROUP BY ALL),
prog AS (
  SELECT topic, partition_id, batch_base, max(top) OVER (PARTITION BY topic, partition_id ORDER BY batch_base
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS progress FROM tops),
al AS (
  SELECT t.*, p.progress, coalesce(t.e < p.progress - 7200000, false) AS beyond
  FROM timed t JOIN prog p ON t.topic = p.topic AND t.partition_id = p.partition_id AND t.batch_base = p.batch_base)"""

_COPIES = """
rec AS (SELECT DISTINCT topic, partition_id, log_offset, batch_base, offset_delta, size_bytes FROM log_records),
bat AS (SELECT DISTINCT topic, partition_id, base_offset, producer_id, producer_epoch, base_sequence FROM batches WHERE producer_id <> -1),
msg AS (
  SELECT r.topic, r.partition_id, r.log_offset, row_number() OVER (
    PARTITION BY r.topic, r.partition_id, b.producer_id, b.producer_epoch, (b.base_sequence::BIGINT + r.offset_delta) % 2147483648
    ORDER BY r.log_offset) AS nth
  FROM rec r JOIN bat b ON r.topic = b.topic AND r.partition_id = b.partition_id AND r.batch_base = b.base_offset),
twice AS (SELECT topic, partition_id, log_offset FROM msg WHERE nth > 1)"""

_PRESENT = f"""{_COPIES},
feed AS (
  SELECT DISTINCT l.topic, l.partition_id, l.log_offset, l.rec_key, l.rec_value FROM log_records l
  WHERE l.topic IN (SELECT topic FROM topic_meta WHERE cleanup = 1) AND l.rec_key IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM twice t WHERE t.topic = l.topic AND t.partition_id = l.partition_id AND t.log_offset = l.log_offset)),
newest AS (SELECT *, row_number() OVER (PARTITION BY topic, partition_id, rec_key ORDER BY log_offset DESC) AS nth FROM feed)"""

_SPANS = """
pos AS (
  SELECT group_id, topic, partition_id, next_offset, row_number() OVER (PARTITION BY group_id, topic, partition_id ORDER BY seq DESC) AS nth
  FROM (SELECT DISTINCT * FROM commits) WHERE next_offset IS NULL OR next_offset >= 0),
ends AS (SELECT topic, partition_id, min(log_offset) AS lo, max(log_offset) AS hi FROM log_records GROUP BY ALL),
spans AS (
  SELECT p.group_id, p.topic, p.partition_id, greatest(coalesce(p.next_offset, e.lo), e.lo) AS from_offset, e.hi
  FROM pos p JOIN ends e ON p.topic = e.topic AND p.partition_id = e.partition_id WHERE p.nth = 1)"""

SQL = {
    "p1_found": f"WITH {TIMED_SQL} SELECT topic, partition_id, log_offset FROM al WHERE beyond",
    "p1_periods": f"""WITH {TIMED_SQL},
ends AS (SELECT topic, partition_id, max(CASE WHEN e * 1000 <= arrived THEN e END) AS end_progress FROM timed WHERE e IS NOT NULL GROUP BY ALL),
per AS (SELECT *, (floor(e / 3600000.0) * 3600000)::BIGINT AS period_ms FROM al WHERE e IS NOT NULL),
gaps AS (SELECT topic, partition_id, period_ms, max(e - prev) AS gap FROM (
  SELECT *, lag(e) OVER (PARTITION BY topic, partition_id, period_ms ORDER BY e, log_offset) AS prev FROM per WHERE NOT beyond) GROUP BY ALL),
lanes AS (
  SELECT topic, partition_id, period_ms, count(*) FILTER (NOT beyond) AS n, sum(size_bytes) FILTER (NOT beyond) AS bytes,
    count(*) FILTER (NOT beyond AND NOT coalesce(progress >= period_ms + 3600000, false)) AS n_first,
    count(*) FILTER (beyond) AS n_beyond, count(*) FILTER (NOT beyond AND coalesce(e >= end_progress - 7200000, true)) AS n_held, min(e) FILTER (NOT beyond) AS first_e, max(e) FILTER (NOT beyond) AS last_e
  FROM per JOIN ends USING (topic, partition_id) GROUP BY ALL),
fin AS (
  SELECT l.*, CASE WHEN l.n > 1 THEN g.gap END AS gap, coalesce(x.end_progress >= l.period_ms + 3600000 + 7200000, false) AS final
  FROM lanes l JOIN ends x ON l.topic = x.topic AND l.partition_id = x.partition_id
  LEFT JOIN gaps g ON l.topic = g.topic AND l.partition_id = g.partition_id AND l.period_ms = g.period_ms)
SELECT topic, period_ms, sum(n)::BIGINT AS n_records, sum(bytes)::BIGINT AS sum_bytes, sum(n_first)::BIGINT AS n_first,
  sum(n - n_first)::BIGINT AS n_corrected, sum(n_beyond)::BIGINT AS n_beyond, sum(CASE WHEN final THEN n ELSE 0 END)::BIGINT AS n_released,
  sum(n_held)::BIGINT AS n_held, min(first_e) AS first_e, max(last_e) AS last_e, max(gap) AS max_gap_ms, bool_and(final) AS final
FROM fin GROUP BY topic, period_ms""",
    "p3_found": f"WITH {_COPIES} SELECT topic, partition_id, log_offset FROM twice",
    "p3_calls": f"""WITH {_COPIES}, cuts AS (SELECT topic, partition_id, (min(base_offset) + max(next_offset)) // 2 AS cut FROM segments GROUP BY ALL)
SELECT t.topic, t.partition_id, t.log_offset, CASE WHEN t.log_offset < c.cut THEN 1 ELSE 2 END AS call FROM twice t JOIN cuts c ON t.topic = c.topic AND t.partition_id = c.partition_id""",
    "p3_kept": f"""WITH {_COPIES} SELECT r.topic, r.partition_id, count(*) AS n_records, sum(r.size_bytes)::BIGINT AS sum_bytes,
  sum(r.log_offset)::BIGINT AS sum_offset FROM rec r ANTI JOIN twice t ON r.topic = t.topic AND r.partition_id = t.partition_id
  AND r.log_offset = t.log_offset GROUP BY ALL""",
    "p4_found": """WITH rec AS (SELECT DISTINCT topic, partition_id, log_offset, rec_key FROM log_records),
com AS (SELECT DISTINCT group_id, topic, partition_id, seq FROM commits)
SELECT 'record' AS kind, topic, -1 AS partition_id, hex(rec_key) AS key_text FROM rec WHERE rec_key IS NOT NULL
GROUP BY topic, rec_key HAVING count(*) >= 0.01 * (SELECT count(*) FROM rec)
UNION ALL
SELECT 'commit', topic, partition_id, c.group_id FROM com c JOIN (SELECT group_id, count(*) AS al FROM com GROUP BY group_id) g ON c.group_id = g.group_id
GROUP BY c.group_id, topic, partition_id, al HAVING count(*) >= 0.4 * al""",
    "p4_keys": """WITH rec AS (SELECT DISTINCT topic, partition_id, log_offset, rec_key, size_bytes FROM log_records WHERE rec_key IS NOT NULL),
o AS (SELECT *, lag(size_bytes) OVER w AS prev, row_number() OVER w AS rn FROM rec WINDOW w AS (PARTITION BY topic, rec_key ORDER BY partition_id, log_offset))
SELECT topic, hex(rec_key) AS rec_key, count(*) AS n_rows, sum(size_bytes)::BIGINT AS total, arg_min(size_bytes, rn)::BIGINT AS first_value,
  arg_max(size_bytes, rn)::BIGINT AS last_value, count(*) FILTER (size_bytes <> prev) AS n_changes, max(size_bytes - prev)::BIGINT AS max_step
FROM o GROUP BY topic, rec_key""",
    "p5_found": f"WITH {_PRESENT} SELECT topic, partition_id, log_offset FROM newest WHERE nth = 1 AND rec_value IS NOT NULL",
    "p5_rows": f"WITH {_PRESENT} SELECT topic, partition_id, hex(rec_key) AS rec_key, log_offset, hex(rec_value) AS rec_value FROM newest WHERE nth = 1 AND rec_value IS NOT NULL",
    "p5_calls": f"""WITH {_PRESENT.replace("newest AS", "newest0 AS")},
cuts AS (SELECT topic, partition_id, (min(base_offset) + max(next_offset)) // 2 AS cut FROM segments GROUP BY ALL),
each AS (SELECT f.*, 2 AS call FROM feed f UNION ALL SELECT f.*, 1 FROM feed f JOIN cuts c ON c.topic = f.topic AND c.partition_id = f.partition_id WHERE f.log_offset < c.cut),
newest AS (SELECT *, row_number() OVER (PARTITION BY call, topic, partition_id, rec_key ORDER BY log_offset DESC) AS nth FROM each)
SELECT call, topic, partition_id, count(*) AS n_rows, sum(log_offset)::BIGINT AS sum_offset FROM newest WHERE nth = 1 AND rec_value IS NOT NULL GROUP BY ALL""",
    "p6_found": f"""WITH {_SPANS} SELECT DISTINCT s.group_id, s.topic, s.partition_id, r.log_offset FROM spans s
JOIN log_records r ON r.topic = s.topic AND r.partition_id = s.partition_id AND r.log_offset >= s.from_offset""",
    "p6_ledger": f"""WITH {_SPANS} SELECT group_id, topic, partition_id, (hi // 16384 - from_offset // 16384 + 1)::BIGINT AS n_items, from_offset
FROM spans WHERE from_offset <= hi""",
    "p6_runs": f"""WITH {_SPANS},
cuts AS (SELECT topic, partition_id, (min(base_offset) + max(next_offset)) // 2 AS cut FROM segments GROUP BY ALL)
SELECT CASE WHEN log_offset < cut THEN 0 ELSE 1 END AS run, group_id, topic, partition_id, count(*) AS n_records, min(log_offset) AS first_offset, max(log_offset) AS last_offset FROM (
  SELECT DISTINCT s.group_id, s.topic, s.partition_id, r.log_offset, c.cut FROM spans s JOIN cuts c ON c.topic = s.topic AND c.partition_id = s.partition_id
  JOIN log_records r ON r.topic = s.topic AND r.partition_id = s.partition_id AND r.log_offset >= s.from_offset) GROUP BY ALL""",
}
