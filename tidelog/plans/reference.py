"""Queries of the log operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.common import materialize, shared_dir, table
from tidelog.functions import codec, metas, names, varint
from tidelog.operators import compaction, groups, kslack, log, offsets, retention, segments
from tidelog.plans.pipeline import TIMED_SQL
from tidelog.sources import segment_files
from tidelog.streaming import live

#: The clock of the tested queries.
NOW_MS = 1_743_292_800_000
MAX_BYTES = 4_096
DEFAULTS = {"retention_ms": 604_800_000, "retention_bytes": None, "max_segment_bytes": 1_073_741_824}
TP, GTP = log.TP, offsets.GTP


def _partition() -> Column:
    return F.pmod(F.col("user_id"), F.lit(4)).cast("int")


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _records(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    r = table(spark, d, "log_records")
    return log.records_once(r.select(*TP, "log_offset", *columns) if columns else r)


def _batches(spark: SparkSession, d: str) -> DataFrame:
    return log.batches_once(table(spark, d, "batches"))


def _bounds(spark: SparkSession, d: str) -> DataFrame:
    return log.bounds(table(spark, d, "segments"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Positions that groups once committed, as offsets to read from."""
    c = table(spark, d, "commits").where("next_offset >= 0")
    return c.select("seq", *GTP, F.col("next_offset").alias("fetch_offset")).dropDuplicates(["seq"])


REC = """rec AS (SELECT topic, partition_id, log_offset, any_value(batch_base) AS batch_base, any_value(offset_delta) AS offset_delta,
  any_value(timestamp_delta) AS timestamp_delta, any_value(ts) AS ts, any_value(rec_key) AS rec_key, any_value(rec_value) AS rec_value,
  any_value(segment_base) AS segment_base, any_value(size_bytes) AS size_bytes, any_value(headers) AS headers
  FROM log_records GROUP BY topic, partition_id, log_offset)"""
BAT = "bat AS (SELECT DISTINCT * FROM batches)"
BOUNDS = "bnd AS (SELECT topic, partition_id, min(base_offset) AS log_start, max(next_offset) AS log_end FROM segments GROUP BY ALL)"
REQ = "req AS (SELECT DISTINCT seq, group_id, topic, partition_id, next_offset AS fetch_offset FROM commits WHERE next_offset >= 0)"
POS = """pos AS (SELECT group_id, topic, partition_id, seq, next_offset, metadata, commit_ts_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id, topic, partition_id ORDER BY seq DESC) AS nth
  FROM (SELECT DISTINCT * FROM commits) WHERE next_offset IS NULL OR next_offset >= 0) WHERE nth = 1)"""
EVENT_LOG = """elog AS (SELECT *, (user_id % 4)::INT AS partition_id,
  row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS log_offset FROM events)"""

_CUTS = "cuts AS (SELECT topic, partition_id, (min(base_offset) + max(next_offset)) // 2 AS cut FROM segments GROUP BY ALL)"

# ---- appending and reading


def _event_log(spark: SparkSession, d: str, columns: tuple[str, ...] = ("user_id", "event_type", "value", "props")) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts", *columns)
    return log.append(e, _partition(), ["ts", "event_id"], F.date_trunc("hour", "ts"))


@query(f"WITH {EVENT_LOG} SELECT event_id, partition_id, log_offset FROM elog")
def append_offsets(spark, d):
    return _event_log(spark, d, ("user_id",)).select("event_id", "partition_id", "log_offset")


@query(f"WITH {EVENT_LOG} SELECT event_id, partition_id, log_offset FROM elog WHERE ts >= TIMESTAMP '2024-01-15'")
def append_carry_over(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id")
    old, new = e.where("ts < timestamp_ntz'2024-01-15'"), e.where("ts >= timestamp_ntz'2024-01-15'")
    ends = old.groupBy(_partition().alias("partition_id")).agg(F.count(F.lit(1)).alias("log_end"))
    return log.append(new, _partition(), ["ts", "event_id"], F.date_trunc("hour", "ts"), ends).select("event_id", "partition_id", "log_offset")


@query(f"""WITH {REC}, st AS (SELECT topic, partition_id, min(next_offset) AS fetch_offset FROM commits WHERE next_offset >= 0 GROUP BY ALL)
SELECT r.topic, r.partition_id, count(*) AS n_records, min(log_offset) AS first_offset, max(log_offset) AS last_offset, sum(size_bytes)::BIGINT AS sum_bytes
FROM rec r JOIN st s ON r.topic = s.topic AND r.partition_id = s.partition_id AND r.log_offset >= s.fetch_offset GROUP BY ALL""")
def fetch_from(spark, d):
    starts = table(spark, d, "commits").where("next_offset >= 0").groupBy(*TP).agg(F.min("next_offset").alias("fetch_offset"))
    read = log.fetch_from(_records(spark, d, "size_bytes"), starts)
    return read.groupBy(*TP).agg(F.count(F.lit(1)).alias("n_records"), F.min("log_offset").alias("first_offset"), F.max("log_offset").alias("last_offset"), F.sum("size_bytes").alias("sum_bytes"))


_STATUS = """SELECT q.seq, q.topic, q.partition_id, q.fetch_offset,
  CASE WHEN b.log_end IS NULL THEN 5 WHEN q.fetch_offset > b.log_end OR q.fetch_offset < b.log_start THEN 2 ELSE 0 END AS error,
  CASE WHEN b.log_end IS NULL THEN 'unknown' WHEN q.fetch_offset > b.log_end THEN 'above_end' WHEN q.fetch_offset = b.log_end THEN 'at_end'
       WHEN q.fetch_offset < b.log_start THEN 'below_start' ELSE 'inside' END AS place,
  coalesce(b.log_end, -1) AS high_watermark, coalesce(b.log_start, -1) AS log_start
FROM {req} q LEFT JOIN bnd b ON q.topic = b.topic AND q.partition_id = b.partition_id"""


@query(f"WITH {REQ}, {BOUNDS} {_STATUS.format(req='req')}")
def fetch_status(spark, d):
    return log.status(_requests(spark, d).select("seq", *TP, "fetch_offset"), _bounds(spark, d))


@query(f"WITH {REQ}, {BOUNDS}, r2 AS (SELECT seq, CASE WHEN seq % 5 = 0 THEN topic || '-gone' ELSE topic END AS topic, partition_id, fetch_offset FROM req) {_STATUS.format(req='r2')}")
def fetch_multi(spark, d):
    """A request over many partitions, some of which aren't there: errors are those of the partition only."""
    gone = F.when(F.col("seq") % 5 == 0, F.concat("topic", F.lit("-gone"))).otherwise(F.col("topic"))
    return log.status(_requests(spark, d).select("seq", gone.alias("topic"), "partition_id", "fetch_offset"), _bounds(spark, d))


@query(f"""WITH {REQ}, {BAT}, tot AS (SELECT topic, partition_id, base_offset, base_offset + last_offset_delta AS last_offset, batch_length + 12 AS bytes,
  coalesce(sum(batch_length + 12) OVER w, 0)::BIGINT AS before FROM bat WINDOW w AS (PARTITION BY topic, partition_id ORDER BY base_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
beg AS (SELECT q.seq, q.topic, q.partition_id, q.fetch_offset, min(t.base_offset) AS first_base, min(t.before) AS from_bytes
  FROM req q JOIN tot t ON q.topic = t.topic AND q.partition_id = t.partition_id AND t.last_offset >= q.fetch_offset GROUP BY ALL)
SELECT g.seq, g.topic, g.partition_id, g.fetch_offset, g.first_base, max(t.last_offset) AS last_read, sum(t.bytes)::BIGINT AS bytes_read
FROM beg g JOIN tot t ON g.topic = t.topic AND g.partition_id = t.partition_id AND t.base_offset >= g.first_base
  AND (t.base_offset = g.first_base OR t.before + t.bytes - g.from_bytes <= {MAX_BYTES}) GROUP BY ALL""")
def fetch_max_bytes(spark, d):
    asked = _requests(spark, d).select("seq", *TP, "fetch_offset", F.lit(MAX_BYTES).alias("max_bytes"))
    return log.fetch_batches(asked, _batches(spark, d)).drop("max_bytes")


@query(f"""WITH {REQ}, {BOUNDS} SELECT q.seq, q.topic, q.partition_id, q.fetch_offset, CASE WHEN log_end IS NULL THEN 5 WHEN fetch_offset > log_end THEN 2 ELSE 0 END AS error,
  CASE WHEN log_end IS NULL OR fetch_offset > log_end THEN NULL WHEN fetch_offset < log_start THEN log_start ELSE fetch_offset END AS resume_at FROM req q LEFT JOIN bnd b ON q.topic = b.topic AND q.partition_id = b.partition_id""")
def reset_positions(spark, d):
    """Where readers go on whose position may have been deleted, or lie past the end."""
    return log.resume(_requests(spark, d).select("seq", *TP, "fetch_offset"), _bounds(spark, d))


@query(f"""WITH {REQ}, {REC}, {BOUNDS}, {BAT}, ans AS ({SQL['fetch_max_bytes'].replace(f"WITH {REQ}, {BAT}, ", "WITH ")})
SELECT q.seq, q.topic, q.partition_id, q.fetch_offset, CASE WHEN b.log_end IS NULL THEN 5 WHEN q.fetch_offset > b.log_end OR q.fetch_offset < b.log_start THEN 2 ELSE 0 END AS error, coalesce(b.log_end, -1) AS high_watermark,
  count(r.log_offset) AS n_records, coalesce(sum(r.size_bytes), 0)::BIGINT AS sum_bytes, min(r.log_offset) AS first_offset, max(r.log_offset) AS last_offset
FROM (SELECT seq, CASE WHEN seq % 5 = 0 THEN topic || '-gone' ELSE topic END AS topic, partition_id, fetch_offset FROM req) q LEFT JOIN bnd b ON q.topic = b.topic AND q.partition_id = b.partition_id
LEFT JOIN ans a ON a.seq = q.seq AND q.topic = a.topic AND b.log_end IS NOT NULL AND q.fetch_offset BETWEEN b.log_start AND b.log_end
LEFT JOIN rec r ON r.topic = a.topic AND r.partition_id = a.partition_id AND r.log_offset BETWEEN a.first_base AND a.last_read GROUP BY ALL""")
def fetch_records(spark, d):
    """Requests over many partitions, some of which aren't there, answered with the records of whole batches up to the cap of each."""
    gone = F.when(F.col("seq") % 5 == 0, F.concat("topic", F.lit("-gone"))).otherwise(F.col("topic"))
    asked = _requests(spark, d).select("seq", gone.alias("topic"), "partition_id", "fetch_offset", F.lit(MAX_BYTES).alias("max_bytes"))
    answers, records = log.fetch(asked, _bounds(spark, d), _batches(spark, d), _records(spark, d, "size_bytes"))
    sums = records.groupBy("seq").agg(F.count(F.lit(1)).alias("n_records"), F.sum("size_bytes").alias("sum_bytes"), F.min("log_offset").alias("first_offset"), F.max("log_offset").alias("last_offset"))
    out = answers.join(sums, "seq", "left").fillna(0, ["n_records", "sum_bytes"])
    return out.select("seq", *TP, "fetch_offset", "error", "high_watermark", "n_records", "sum_bytes", "first_offset", "last_offset")


@query("SELECT topic, partition_id, min(base_offset) AS earliest, max(next_offset) AS latest FROM segments GROUP BY ALL")
def list_offsets(spark, d):
    return _bounds(spark, d).select(*TP, F.col("log_start").alias("earliest"), F.col("log_end").alias("latest"))


@query(f"""WITH {BOUNDS}, st AS (SELECT unnest(['earliest', 'latest', '100']) AS start)
SELECT topic, partition_id, start, CASE start WHEN 'earliest' THEN log_start WHEN 'latest' THEN log_end ELSE 100 END AS start_offset FROM bnd CROSS JOIN st""")
def start_resolution(spark, d):
    return log.resolve_start(_bounds(spark, d), ["earliest", "latest", "100"])


@query(f"""WITH {BOUNDS}, {REC}, f AS (SELECT topic, partition_id, min(log_offset) AS first_offset, max(log_offset) AS last_offset, count(*) AS n FROM rec GROUP BY ALL)
SELECT b.topic, b.partition_id, log_start, log_end, first_offset, last_offset, n AS n_records, log_end - log_start AS n_offsets FROM bnd b JOIN f ON b.topic = f.topic AND b.partition_id = f.partition_id""")
def log_bounds(spark, d):
    """Start, end, what is really there, and both counts: of records, and of offsets, which overcounts a compacted log."""
    r = _records(spark, d)
    n = r.groupBy(*TP).agg(F.count(F.lit(1)).alias("n_records"))
    return log.bounds(table(spark, d, "segments"), r).join(n, TP).withColumn("n_offsets", F.col("log_end") - F.col("log_start"))


@query("SELECT topic, array_to_string(list_sort(list(DISTINCT partition_id)), ',') AS partitions, 0 AS error FROM segments WHERE NOT starts_with(topic, '__') GROUP BY topic")
def metadata_topics(spark, d):
    return log.metadata(table(spark, d, "segments")).withColumn("partitions", F.array_join(F.col("partitions").cast("array<string>"), ","))


@query("""WITH asked AS (SELECT DISTINCT CASE WHEN partition_id > 2 THEN topic || '?' ELSE topic END AS topic FROM segments), l AS (
  SELECT topic, array_to_string(list_sort(list(DISTINCT partition_id)), ',') AS partitions FROM segments GROUP BY topic)
SELECT a.topic, partitions, CASE WHEN partitions IS NULL THEN 5 ELSE 0 END AS error FROM asked a LEFT JOIN l ON a.topic = l.topic""")
def metadata_named(spark, d):
    s = table(spark, d, "segments")
    asked = s.select(F.when(F.col("partition_id") > 2, F.concat("topic", F.lit("?"))).otherwise(F.col("topic")).alias("topic"))
    return log.metadata(s, asked).withColumn("partitions", F.array_join(F.col("partitions").cast("array<string>"), ","))


@query("""WITH n AS (SELECT DISTINCT CASE WHEN topic LIKE 'p%' THEN '__' || topic ELSE topic END AS topic FROM segments)
SELECT topic FROM n WHERE NOT starts_with(topic, '__')""")
def hidden_internal(spark, d):
    s = table(spark, d, "segments").withColumn("topic", F.when(F.col("topic").startswith("p"), F.concat(F.lit("__"), "topic")).otherwise(F.col("topic")))
    return log.metadata(s).select("topic")


@query("""SELECT request_id, topic, partition_id, error, CASE WHEN error = 0 THEN log_end + coalesce(sum(CASE WHEN error = 0 THEN record_count END) OVER (
  PARTITION BY topic, partition_id ORDER BY request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT ELSE -1 END AS base_offset
FROM (SELECT p.*, b.log_end, CASE WHEN b.log_end IS NULL THEN 4 WHEN NOT crc_ok OR magic <> 2 THEN 3 WHEN record_count < 1 THEN 1 ELSE 0 END AS error FROM (
  SELECT DISTINCT base_offset AS request_id, CASE WHEN base_offset % 31 = 0 THEN topic || '-gone' ELSE topic END AS topic, partition_id, magic, base_offset % 17 <> 0 AS crc_ok,
    CASE WHEN base_offset % 13 = 0 THEN 0 ELSE record_count END AS record_count FROM batches) p
  LEFT JOIN (SELECT topic, partition_id, max(next_offset) AS log_end FROM segments GROUP BY ALL) b ON p.topic = b.topic AND p.partition_id = b.partition_id)""")
def produce_results(spark, d):
    """The batches again as produce requests, some of them to unknown partitions, damaged or empty."""
    o = F.col("base_offset")
    asked = _batches(spark, d).select(
        o.alias("request_id"),
        F.when(o % 31 == 0, F.concat("topic", F.lit("-gone"))).otherwise(F.col("topic")).alias("topic"),
        "partition_id",
        "magic",
        (o % 17 != 0).alias("crc_ok"),
        F.when(o % 13 == 0, 0).otherwise(F.col("record_count")).alias("record_count"),
    )
    return log.produce(asked, _bounds(spark, d))


@query(f"""WITH q AS (SELECT DISTINCT source AS topic FROM documents WHERE source IS NOT NULL UNION SELECT DISTINCT url FROM documents WHERE url IS NOT NULL UNION SELECT topic FROM topic_meta)
SELECT q.topic, length(q.topic) % 3 AS partition_count, CASE WHEN NOT (regexp_full_match(q.topic, '[A-Za-z0-9._-]+') AND q.topic NOT IN ('.', '..')) OR length(q.topic) % 3 < 1 THEN 7
  WHEN m.topic IS NOT NULL THEN 6 ELSE 0 END AS error,
  CASE WHEN length(q.topic) % 2 = 0 THEN 1000 ELSE {DEFAULTS['retention_ms']} END::BIGINT AS retention_ms, CASE WHEN length(q.topic) % 5 = 0 THEN 5000 END::BIGINT AS retention_bytes, {DEFAULTS['max_segment_bytes']}::BIGINT AS max_segment_bytes,
  (CASE length(q.topic) % 4 WHEN 1 THEN 1 ELSE 0 END)::TINYINT AS cleanup
FROM q LEFT JOIN (SELECT DISTINCT topic FROM topic_meta) m ON q.topic = m.topic""")
def create_topics(spark, d):
    docs = table(spark, d, "documents")
    asked = docs.select(F.col("source").alias("topic")).union(docs.select("url")).union(table(spark, d, "topic_meta").select("topic")).where("topic is not null").distinct()
    n = F.length("topic")
    requests = asked.select(
        "topic", (n % 3).alias("partition_count"), F.when(n % 2 == 0, 1000).otherwise(-1).alias("retention_ms"), F.when(n % 5 == 0, 5000).when(n % 5 == 1, 0).alias("retention_bytes"),
        F.lit(None).cast("bigint").alias("max_segment_bytes"), F.when(n % 4 == 1, True).when(n % 4 == 2, False).alias("compact"),
    )
    return log.create_topics(requests, table(spark, d, "topic_meta"), DEFAULTS)


@query("""SELECT DISTINCT m.topic, s.partition_id, max_segment_bytes, max_segment_age_ms, index_interval_bytes, 10485760::BIGINT AS max_index_bytes, retention_ms, retention_bytes, 60000::BIGINT AS delete_delay_ms, cleanup, delete_retention_ms
FROM segments s JOIN topic_meta m ON s.topic = m.topic""")
def meta_roundtrip(spark, d):
    """The metadata of every partition in their binary form, written to files and read again."""
    parts = table(spark, d, "segments").select(*TP).distinct().join(F.broadcast(table(spark, d, "topic_meta").distinct()), "topic")  # a row per topic
    root = shared_dir(spark, "metas")
    metas.write(parts.withColumns({"max_index_bytes": F.lit(10_485_760).cast("bigint"), "delete_delay_ms": F.lit(60_000).cast("bigint")}), root)
    return metas.read(spark, root)


@query(f"""WITH {REQ}, {BOUNDS} SELECT q.seq, q.topic, q.partition_id, q.seq % 3 - 2 AS timestamp,
  CASE WHEN b.log_end IS NULL THEN 5 WHEN q.seq % 3 = 2 THEN 1 ELSE 0 END AS error, CASE WHEN b.log_end IS NULL OR q.seq % 3 = 2 THEN -1 WHEN q.seq % 3 = 0 THEN log_start ELSE log_end END AS answer
FROM req q LEFT JOIN bnd b ON q.topic = b.topic AND q.partition_id = b.partition_id""")
def list_offsets_answers(spark, d):
    asked = _requests(spark, d).select("seq", *TP, (F.col("seq") % 3 - 2).alias("timestamp"))
    return log.list_offsets(asked, _bounds(spark, d))


@query("""SELECT api::INT AS api, version::INT AS version, CASE WHEN version = 0 AND (api <= 3 OR api BETWEEN 8 AND 14 OR api = 19) THEN 0 ELSE 9 END AS error FROM range(20) a(api), range(2) v(version)""")
def api_support(spark, d):
    asked = spark.range(40).select((F.col("id") / 2).cast("int").alias("api"), (F.col("id") % 2).cast("int").alias("version"))
    return log.supported(asked)


@query("SELECT DISTINCT group_id, (('0x' || substr(md5(group_id), 1, 8))::BIGINT % 8)::INT AS offsets_partition FROM commits")
def find_coordinator(spark, d):
    """The partition of the positions topic, and so the broker, that a group belongs to."""
    g = table(spark, d, "commits").select("group_id").distinct()
    return g.withColumn("offsets_partition", names.bucket_of(F.col("group_id"), log.OFFSETS_PARTITIONS))


@query(f"WITH {REC} SELECT topic, (('0x' || substr(md5(rec_key), 1, 8))::BIGINT % 6)::INT AS bucket, count(*) AS n_records FROM rec WHERE rec_key IS NOT NULL GROUP BY ALL")
def key_partitions(spark, d):
    """How keys would spread over six partitions."""
    r = _records(spark, d, "rec_key").where("rec_key is not null")
    return r.groupBy("topic", names.bucket_of(F.col("rec_key"), 6).alias("bucket")).agg(F.count(F.lit(1)).alias("n_records"))


def _ceilings(spark: SparkSession, d: str) -> DataFrame:
    return _bounds(spark, d).withColumn("high_watermark", F.col("log_end") - 5 * F.col("partition_id"))


@query(f"""WITH {REC}, {BOUNDS} SELECT r.topic, r.partition_id, count(*) FILTER (log_offset < log_end - 5 * r.partition_id) AS consumer_sees, count(*) FILTER (log_offset < log_end) AS follower_sees
FROM rec r JOIN bnd b ON r.topic = b.topic AND r.partition_id = b.partition_id GROUP BY ALL""")
def fetch_ceiling(spark, d):
    """What a consumer sees, up to the high watermark, and a follower, up to the end."""
    r, top = _records(spark, d), _ceilings(spark, d)
    seen = lambda f, c: log.visible(r, top, f).groupBy(*TP).agg(F.count(F.lit(1)).alias(c))
    return seen(True, "follower_sees").join(seen(False, "consumer_sees"), TP, "left").fillna(0)


@query(f"""WITH {BAT}, {BOUNDS}, f AS (SELECT b.*, base_offset <> coalesce(lag(base_offset + last_offset_delta + 1) OVER w, log_start) AS bad FROM bat b JOIN bnd c ON b.topic = c.topic AND b.partition_id = c.partition_id
  WINDOW w AS (PARTITION BY b.topic, b.partition_id ORDER BY base_offset))
SELECT topic, partition_id, base_offset, NOT bool_or(bad) OVER (PARTITION BY topic, partition_id ORDER BY base_offset) AS accepted FROM f""")
def follower_append(spark, d):
    """All batches of each log for a follower that is empty: up to the first gap they are appended."""
    ends = _bounds(spark, d).select(*TP, F.col("log_start").alias("log_end"))
    return log.follow(_batches(spark, d).select(*TP, "base_offset", "last_offset_delta"), ends).select(*TP, "base_offset", "accepted")


@query("SELECT DISTINCT topic, coalesce(retention_ms, 1) AS retention_ms, coalesce(retention_bytes, -1) AS retention_bytes FROM topic_meta")
def topic_settings(spark, d):
    return log.settings(table(spark, d, "topic_meta"), {"retention_ms": 1, "retention_bytes": -1})


# ---- names, sizes, codec


@query("""WITH n AS (SELECT DISTINCT source AS name FROM documents WHERE source IS NOT NULL UNION SELECT DISTINCT url FROM documents WHERE url IS NOT NULL UNION SELECT unnest(['.', '..', 'a b', '']))
SELECT name, regexp_full_match(name, '[A-Za-z0-9._-]+') AND name NOT IN ('.', '..') AS usable FROM n""")
def topic_name_valid(spark, d):
    docs = table(spark, d, "documents")
    odd = docs.sparkSession.createDataFrame([(".",), ("..",), ("a b",), ("",)], "name string")
    all_ = docs.select(F.col("source").alias("name")).union(docs.select("url")).where("name is not null").union(odd).distinct()
    return all_.withColumn("usable", names.usable_name(F.col("name")))


@query("""WITH n AS (SELECT DISTINCT topic || '-' || partition_id AS name FROM segments UNION SELECT DISTINCT topic || '-0' || partition_id FROM segments UNION SELECT DISTINCT topic FROM segments),
p AS (SELECT name, regexp_extract(name, '^(.+)-(0|[1-9][0-9]*)$', 1) AS t, regexp_extract(name, '^(.+)-(0|[1-9][0-9]*)$', 2) AS k FROM n)
SELECT name, nullif(t, '') AS topic, CASE WHEN t <> '' THEN k::INT END AS partition_id FROM p""")
def dirname_parse(spark, d):
    s = table(spark, d, "segments")
    p = F.col("partition_id").cast("string")
    all_ = s.select(names.directory_name(F.col("topic"), p).alias("name")).union(s.select(F.concat("topic", F.lit("-0"), p))).union(s.select("topic")).distinct()
    topic, partition = names.parsed_directory(F.col("name"))
    return all_.select("name", topic.alias("topic"), partition.alias("partition_id"))


@query("SELECT DISTINCT topic, partition_id, lpad(base_offset::VARCHAR, 20, '0') || '.log' AS file_name, base_offset AS parsed, CAST(NULL AS BIGINT) AS odd FROM segments")
def segment_names(spark, d):
    s = table(spark, d, "segments").select(*TP, "base_offset", names.segment_name(F.col("base_offset")).alias("file_name")).distinct()
    return s.select(*TP, "file_name", names.parsed_segment(F.col("file_name")).alias("parsed"), names.parsed_segment(F.substring("file_name", 2, 30)).alias("odd"))


@query(f"""SELECT topic, partition_id, topic || '-' || partition_id || '.' || max(max_ts_ms) || '.delete' AS removed, {NOW_MS} - max(max_ts_ms) >= 60000 AS due FROM segments GROUP BY topic, partition_id""")
def graveyard_sweep(spark, d):
    """Removed partitions under the name they wait with, and whether their delay of a minute is over."""
    at = table(spark, d, "segments").groupBy(*TP).agg(F.max("max_ts_ms").alias("at_ms"))
    return at.select(*TP, names.removed_name(F.col("topic"), F.col("partition_id"), F.col("at_ms")).alias("removed"), (F.lit(NOW_MS) - F.col("at_ms") >= 60_000).alias("due"))


@query("""SELECT code, text FROM (VALUES (0, 'none'), (1, 'unknown broker error'), (2, 'offset out of range'), (3, 'corrupt message'), (4, 'not leader for partition'), (5, 'unknown topic or partition'),
(6, 'topic already exists'), (7, 'invalid topic name'), (8, 'request timed out'), (9, 'unsupported api version'), (10, 'group coordinator not available'), (11, 'not the coordinator for this group'),
(12, 'stale generation'), (13, 'unknown member id'), (14, 'rebalance in progress — rejoin'), (15, 'invalid group id'), (99, 'unrecognised error code')) t(code, text)""")
def error_codes(spark, d):
    codes = spark.range(0, 17).select(F.when(F.col("id") == 16, 99).otherwise(F.col("id")).cast("int").alias("code"))
    return codes.withColumn("text", log.error_text(F.col("code")))


_ZZ = "CASE WHEN {0} < 0 THEN -({0} + 1) ELSE {0} END"


def _size(x: str) -> str:
    out = "10"
    for n in range(9, 0, -1):
        out = f"CASE WHEN {_ZZ.format(x)} < {1 << (7 * n - 1)} THEN {n} ELSE {out} END"
    return f"({out})"


def _nullable(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN 1 ELSE octet_length({x}) + {_size(f'octet_length({x})')} END)"


@query(f"""WITH {REC} SELECT topic, partition_id, log_offset, {_size('timestamp_delta')} AS time_size, {_size('offset_delta')} AS offset_size, {_size('log_offset * 1099511627776')} AS wide_size FROM rec""")
def varint_sizes(spark, d):
    r = _records(spark, d, "timestamp_delta", "offset_delta")
    return r.select(*TP, "log_offset", varint.varint_size(F.col("timestamp_delta")).alias("time_size"), varint.varint_size(F.col("offset_delta")).alias("offset_size"), varint.varint_size(F.col("log_offset") * (1 << 40)).alias("wide_size"))


@query(f"""WITH {REC}, b AS (SELECT *, 1 + {_size('timestamp_delta')} + {_size('offset_delta')} + {_nullable('rec_key')} + {_nullable('rec_value')} + {_size('coalesce(len(headers), 0)')}
  + coalesce(list_sum(list_transform(headers, lambda h: {_nullable('h.hkey')} + {_nullable('h.hvalue')})), 0)::BIGINT AS body FROM rec)
SELECT topic, partition_id, log_offset, size_bytes, (body + {_size('body')})::INT AS computed FROM b""")
def record_sizes(spark, d):
    """The encoded size of every record from its fields, beside the one on record."""
    r = _records(spark, d, "timestamp_delta", "offset_delta", "rec_key", "rec_value", "headers", "size_bytes")
    computed = varint.record_size(*(F.col(c) for c in ("timestamp_delta", "offset_delta", "rec_key", "rec_value", "headers")))
    return r.select(*TP, "log_offset", "size_bytes", computed.alias("computed"))


@query(f"""WITH {REC}, {BAT} SELECT b.topic, b.partition_id, b.base_offset, b.batch_length + 12 AS total_bytes, 61 + sum(r.size_bytes)::BIGINT AS summed_bytes, count(*) AS n_records,
  max(r.offset_delta) = b.last_offset_delta AS delta_ok FROM bat b JOIN rec r ON b.topic = r.topic AND b.partition_id = r.partition_id AND b.base_offset = r.batch_base
GROUP BY b.topic, b.partition_id, b.base_offset, b.batch_length, b.last_offset_delta""")
def batch_sizes(spark, d):
    r = _records(spark, d, "batch_base", "size_bytes", "offset_delta").groupBy(*TP, F.col("batch_base").alias("base_offset"))
    sums = r.agg(F.sum("size_bytes").alias("s"), F.count(F.lit(1)).alias("n_records"), F.max("offset_delta").alias("delta"))
    joined = _batches(spark, d).join(sums, [*TP, "base_offset"])
    return joined.select(*TP, "base_offset", (F.col("batch_length") + log.BEFORE_LENGTH).alias("total_bytes"), (F.col("s") + log.HEADER_BYTES).alias("summed_bytes"), "n_records", (F.col("delta") == F.col("last_offset_delta")).alias("delta_ok"))


@query(f"""WITH {REC}, {BAT} SELECT r.topic, r.partition_id, r.log_offset, r.batch_base + r.offset_delta AS abs_offset, CASE WHEN b.first_timestamp <> -1 THEN b.first_timestamp + r.timestamp_delta END AS abs_ms,
  (b.attributes & 7)::INT AS compression FROM rec r JOIN bat b ON b.topic = r.topic AND b.partition_id = r.partition_id AND b.base_offset = r.batch_base""")
def absolute_positions(spark, d):
    """Absolute offsets and times from the deltas, and the compression flag of the batch."""
    b = _batches(spark, d).select(*TP, F.col("base_offset").alias("batch_base"), "first_timestamp", "attributes")
    r = _records(spark, d, "batch_base", "offset_delta", "timestamp_delta").join(b, [*TP, "batch_base"])
    at = F.when(F.col("first_timestamp") != -1, F.col("first_timestamp") + F.col("timestamp_delta"))
    return r.select(*TP, "log_offset", (F.col("batch_base") + F.col("offset_delta")).alias("abs_offset"), at.alias("abs_ms"), F.col("attributes").bitwiseAND(F.lit(codec.COMPRESSION_MASK).cast("smallint")).cast("int").alias("compression"))


@query(f"""WITH {BAT}, e AS (SELECT topic, partition_id, leader_epoch, min(base_offset) AS start_offset, max(base_offset + last_offset_delta) AS last_offset FROM bat GROUP BY ALL)
SELECT *, lead(start_offset) OVER (PARTITION BY topic, partition_id ORDER BY leader_epoch) AS next_start FROM e""")
def leader_epochs(spark, d):
    """Start of every leader epoch, its last offset and the start of the next."""
    from pyspark.sql import Window as W

    e = _batches(spark, d).groupBy(*TP, "leader_epoch").agg(F.min("base_offset").alias("start_offset"), F.max(F.col("base_offset") + F.col("last_offset_delta")).alias("last_offset"))
    return e.withColumn("next_start", F.lead("start_offset").over(W.partitionBy(*TP).orderBy("leader_epoch")))


@query(f"""WITH {BAT}, {BOUNDS}, e AS (SELECT topic, partition_id, leader_epoch, min(base_offset) AS start_offset FROM bat GROUP BY ALL), q AS (SELECT b.topic, b.partition_id, a.asked, b.log_end FROM bnd b, (SELECT unnest([-1, 0, 1, 2, 3, 1000]) AS asked) a)
SELECT q.topic, q.partition_id, q.asked::INT AS asked, max(e.leader_epoch) FILTER (e.leader_epoch <= asked) AS epoch, CASE WHEN max(e.leader_epoch) FILTER (e.leader_epoch <= asked) IS NULL THEN -1
  ELSE coalesce(min(e.start_offset) FILTER (e.leader_epoch > asked), q.log_end) END AS end_offset
FROM q LEFT JOIN e ON q.topic = e.topic AND q.partition_id = e.partition_id GROUP BY q.topic, q.partition_id, q.asked, q.log_end""")
def epoch_ends(spark, d):
    """Where the log of each partition ended in the epochs that a follower asks about."""
    asked = _bounds(spark, d).select(*TP, F.explode(F.array(*map(F.lit, (-1, 0, 1, 2, 3, 1000)))).alias("asked"))
    return log.epoch_ends(asked, _batches(spark, d), _bounds(spark, d))


@query(f"""WITH {BAT}, {BOUNDS}, r AS (SELECT b.*, i.r, log_end - i.r * (partition_id + 1) * 3 AS fetched, {NOW_MS} - i.r * (partition_id + 1) * 4000 AS came FROM bnd b, (SELECT unnest([0, 1, 2]) AS r) i),
h AS (SELECT topic, partition_id, min(fetched) FILTER ({NOW_MS} - came < 10000) AS high_watermark, count(*) FILTER ({NOW_MS} - came < 10000) AS n_in_sync FROM r GROUP BY ALL)
SELECT b.topic, b.partition_id, b.base_offset, CASE WHEN n_in_sync < 2 THEN 'not enough replicas' WHEN base_offset + last_offset_delta < high_watermark THEN 'acknowledged' ELSE 'timed out' END AS answer
FROM bat b JOIN h ON b.topic = h.topic AND b.partition_id = h.partition_id""")
def acks_all(spark, d):
    """What producers that wait for all replicas in sync, of which two are required, are told of each batch now that their time is up."""
    return log.acknowledge(_batches(spark, d), high_watermark(spark, d), 2).select(*TP, "base_offset", "answer")


@query(f"""WITH {REC}, steps AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 2197175160) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
sums AS (SELECT topic, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(rec_value)), lambda i: ('0x' || substr(hex(rec_value), 2 * i + 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))::BIGINT AS crc FROM rec, steps WHERE rec_value IS NOT NULL)
SELECT topic, count(*) AS n, sum(crc)::BIGINT AS sum_crc, max(crc) AS max_crc FROM sums GROUP BY topic""")
def crc_batches(spark, d):
    """CRC-32C of every value, per topic: count and sum."""
    r = _records(spark, d, "rec_value").where("rec_value is not null")
    return r.withColumn("crc", codec.crc32c_column(F.col("rec_value"))).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum("crc").alias("sum_crc"), F.max("crc").alias("max_crc"))


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    return codec.encode_batches(_records(spark, d, "batch_base", "offset_delta", "timestamp_delta", "rec_key", "rec_value", "headers"), _batches(spark, d))


@query(f"""WITH {BAT} SELECT topic, partition_id, base_offset, batch_length + 12 AS n_bytes, true AS crc_ok FROM bat""")
def batch_encode(spark, d):
    """Every batch in its binary form: its size is that on record, and its checksum verifies."""
    e = _encoded(spark, d)
    return e.select(*TP, "base_offset", F.octet_length("batch").alias("n_bytes"), (codec.crc32c_column(F.expr("substring(batch, 22)")) == F.conv(F.hex(F.expr("substring(batch, 18, 4)")), 16, 10).cast("bigint")).alias("crc_ok"))


@query(f"WITH {REC} SELECT topic, partition_id, log_offset, timestamp_delta, hex(rec_key) AS rec_key, hex(rec_value) AS rec_value, coalesce(len(headers), 0)::INT AS n_headers FROM rec")
def batch_codec_roundtrip(spark, d):
    """Every record encoded into its batch and decoded again."""
    whole = _encoded(spark, d).withColumnRenamed("batch", "content")
    return codec.decode_segments(whole).select(*TP, "log_offset", "timestamp_delta", F.hex("rec_key").alias("rec_key"), F.hex("rec_value").alias("rec_value"), F.size("headers").alias("n_headers"))


@query(f"""WITH {REC}, {BAT}, cut AS (SELECT topic, partition_id, segment_base, min(base_offset) AS bad FROM bat WHERE base_offset % 29 = 0 GROUP BY ALL)
SELECT r.topic, r.partition_id, r.segment_base, count(*) AS n_records, max(r.log_offset) AS last_offset FROM rec r LEFT JOIN cut c
  ON r.topic = c.topic AND r.partition_id = c.partition_id AND r.segment_base = c.segment_base WHERE c.bad IS NULL OR r.batch_base < c.bad GROUP BY ALL""")
def segment_scan(spark, d):
    """Segment files, some batches of which are damaged in one byte, scanned to the first damage."""
    damaged = F.when(F.col("base_offset") % 29 == 0, F.concat(F.expr("substring(batch, 1, length(batch) - 1)"), F.unhex(F.lpad(F.hex(F.lit(255) - F.conv(F.hex(F.expr("substring(batch, length(batch), 1)")), 16, 10).cast("int")), 2, "0")))).otherwise(F.col("batch"))
    root = shared_dir(spark, "damaged")
    segment_files.write_segments(_encoded(spark, d).withColumn("batch", damaged), root)
    segment_files.register(spark)
    found = spark.read.format("segments").load(root).where("error is null")
    return found.groupBy(*TP, "segment_base").agg(F.count(F.lit(1)).alias("n_records"), F.max("log_offset").alias("last_offset"))


def _written(spark: SparkSession, d: str) -> str:
    """All batches as segment files in a shared folder."""
    root = shared_dir(spark, "segments")
    segment_files.write_segments(_encoded(spark, d), root)
    segment_files.register(spark)
    return root


@query(f"""WITH {REC} SELECT topic, partition_id, segment_base, log_offset, timestamp_delta, hex(rec_key) AS rec_key, hex(rec_value) AS rec_value FROM rec""")
def segment_files_read(spark, d):
    """Every record, written to segment files by the executors and read back through the data source."""
    r = spark.read.format("segments").load(_written(spark, d))
    return r.where("error is null").select(*TP, "segment_base", "log_offset", "timestamp_delta", F.hex("rec_key").alias("rec_key"), F.hex("rec_value").alias("rec_value"))


@query(f"""WITH {BAT} SELECT topic, partition_id, segment_base, base_offset, batch_length, leader_epoch, record_count, max_timestamp,
  coalesce(sum(batch_length + 12) OVER (PARTITION BY topic, partition_id, segment_base ORDER BY base_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM bat""")
def segment_headers(spark, d):
    """The headers of all batches of the segment files, by seeking from one to the next."""
    h = spark.read.format("segments").option("headers_only", "true").load(_written(spark, d))
    return h.select(*TP, "segment_base", "base_offset", "batch_length", "leader_epoch", "record_count", "max_timestamp", "position")


# ---- segments and retention


@query(f"WITH {EVENT_LOG} SELECT partition_id, (log_offset // 100 * 100)::BIGINT AS segment_base, count(*) AS n_records, max(log_offset) + 1 AS next_offset, max(ts) AS max_ts FROM elog GROUP BY ALL")
def segments_fixed(spark, d):
    e = _event_log(spark, d, ("user_id",)).withColumn("segment_base", (F.floor(F.col("log_offset") / 100) * 100).cast("bigint"))
    return e.groupBy("partition_id", "segment_base").agg(F.count(F.lit(1)).alias("n_records"), (F.max("log_offset") + 1).alias("next_offset"), F.max("ts").alias("max_ts"))


_PLACED = """bb AS (SELECT topic, partition_id, base_offset, batch_length + 12 AS bytes, epoch_ms(append_ts) AS came, m.max_segment_bytes AS most, m.max_segment_age_ms AS age,
  row_number() OVER (PARTITION BY topic, partition_id ORDER BY base_offset) AS n FROM (SELECT DISTINCT * FROM batches) b JOIN (SELECT DISTINCT * FROM topic_meta) m USING (topic))"""


@query(f"""WITH RECURSIVE {_PLACED}, r AS (
  SELECT topic, partition_id, n, base_offset, base_offset AS segment_base, 0::BIGINT AS position, bytes, came AS begun FROM bb WHERE n = 1
  UNION ALL SELECT b.topic, b.partition_id, b.n, b.base_offset,
    CASE WHEN r.position + r.bytes >= b.most OR b.came - r.begun >= b.age THEN b.base_offset ELSE r.segment_base END,
    CASE WHEN r.position + r.bytes >= b.most OR b.came - r.begun >= b.age THEN 0 ELSE r.position + r.bytes END, b.bytes,
    CASE WHEN r.position + r.bytes >= b.most OR b.came - r.begun >= b.age THEN b.came ELSE r.begun END
  FROM r JOIN bb b ON b.topic = r.topic AND b.partition_id = r.partition_id AND b.n = r.n + 1)
SELECT topic, partition_id, base_offset, segment_base, position FROM r""")
def segment_roll_greedy(spark, d):
    return segments.roll(_batches(spark, d), table(spark, d, "topic_meta"))


_INDEX = """ib AS (SELECT topic, partition_id, segment_base, base_offset, batch_length + 12 AS bytes, m.index_interval_bytes AS every,
  row_number() OVER (PARTITION BY topic, partition_id, segment_base ORDER BY base_offset) AS n FROM (SELECT DISTINCT * FROM batches) b JOIN (SELECT DISTINCT * FROM topic_meta) m USING (topic)),
ix AS (SELECT topic, partition_id, segment_base, n, base_offset, 0::BIGINT AS position, bytes, bytes::BIGINT AS since, false AS entry FROM ib WHERE n = 1
  UNION ALL SELECT b.topic, b.partition_id, b.segment_base, b.n, b.base_offset, i.position + i.bytes, b.bytes,
    CASE WHEN i.since >= b.every THEN 0 ELSE i.since END + b.bytes, i.since >= b.every
  FROM ix i JOIN ib b ON b.topic = i.topic AND b.partition_id = i.partition_id AND b.segment_base = i.segment_base AND b.n = i.n + 1)"""


@query(f"WITH RECURSIVE {_INDEX} SELECT topic, partition_id, segment_base, base_offset - segment_base AS rel_offset, position FROM ix WHERE entry")
def sparse_index(spark, d):
    return segments.sparse_index(_batches(spark, d), table(spark, d, "topic_meta"))


#: Entries that the small indexes of the next queries hold.
FEW = 2


@query(f"""WITH RECURSIVE {_INDEX}, e AS (SELECT *, row_number() OVER (PARTITION BY topic, partition_id, segment_base ORDER BY base_offset) AS k FROM ix WHERE entry)
SELECT topic, partition_id, segment_base, base_offset - segment_base AS rel_offset, position FROM e WHERE k <= {FEW}""")
def sparse_index_full(spark, d):
    """Indexes with room for few entries: the rest are dropped."""
    return segments.sparse_index(_batches(spark, d), table(spark, d, "topic_meta"), FEW)


@query(f"""WITH RECURSIVE {_PLACED.replace('m.max_segment_age_ms AS age', 'm.max_segment_age_ms AS age, m.index_interval_bytes AS every')}, r AS (
  SELECT topic, partition_id, n, base_offset, base_offset AS segment_base, 0::BIGINT AS position, bytes, came AS begun, bytes::BIGINT AS since, 0 AS entries FROM bb WHERE n = 1
  UNION ALL SELECT topic, partition_id, n, base_offset, CASE WHEN roll THEN base_offset ELSE segment_base END, CASE WHEN roll THEN 0 ELSE position END, bytes, CASE WHEN roll THEN came ELSE begun END,
    CASE WHEN roll OR since >= every THEN 0 ELSE since END + bytes, CASE WHEN roll THEN 0 WHEN since >= every THEN entries + 1 ELSE entries END FROM (
    SELECT b.topic, b.partition_id, b.n, b.base_offset, b.bytes, b.came, b.every, r.segment_base, r.begun, r.since, r.entries, r.position + r.bytes AS position,
      r.position + r.bytes >= b.most OR b.came - r.begun >= b.age OR r.entries >= {FEW} AS roll
    FROM r JOIN bb b ON b.topic = r.topic AND b.partition_id = r.partition_id AND b.n = r.n + 1))
SELECT topic, partition_id, base_offset, segment_base, position FROM r""")
def segment_roll_index(spark, d):
    """Rolling where the index holds few entries: a full one closes the segment."""
    return segments.roll(_batches(spark, d), table(spark, d, "topic_meta"), FEW)


@query(f"""WITH RECURSIVE {_INDEX}, e AS (SELECT topic, partition_id, segment_base, base_offset, position FROM ix WHERE entry), {REQ},
h AS (SELECT q.seq, q.topic, q.partition_id, q.fetch_offset AS target, max(s.base_offset) AS segment_base FROM req q JOIN segments s
  ON q.topic = s.topic AND q.partition_id = s.partition_id AND s.base_offset <= q.fetch_offset GROUP BY ALL)
SELECT h.seq, h.topic, h.partition_id, h.target, h.segment_base, coalesce(max(e.base_offset) - h.segment_base, 0) AS rel_offset, coalesce(max(e.position), 0) AS position
FROM h LEFT JOIN e ON h.topic = e.topic AND h.partition_id = e.partition_id AND h.segment_base = e.segment_base AND e.base_offset <= h.target GROUP BY h.seq, h.topic, h.partition_id, h.target, h.segment_base""")
def index_lookup(spark, d):
    index = materialize(segments.sparse_index(_batches(spark, d), table(spark, d, "topic_meta")), "index")  # read by two passes
    targets = _requests(spark, d).select("seq", *TP, F.col("fetch_offset").alias("target"))
    return segments.lookup(targets, table(spark, d, "segments"), index)


@query("""SELECT topic, partition_id, base_offset, next_offset, next_base, coalesce(CASE WHEN cleanup = 1 THEN next_offset > next_base ELSE next_offset <> next_base END, false) AS broken
FROM (SELECT s.*, lead(base_offset) OVER (PARTITION BY topic, partition_id ORDER BY base_offset) AS next_base, m.cleanup FROM segments s JOIN (SELECT DISTINCT topic, cleanup FROM topic_meta) m USING (topic))""")
def contiguity_check(spark, d):
    return segments.contiguity(table(spark, d, "segments"), table(spark, d, "topic_meta"))


@query(f"""WITH {BAT}, x AS (SELECT topic, partition_id, base_offset, lag(base_offset + last_offset_delta + 1) OVER (PARTITION BY topic, partition_id ORDER BY base_offset) AS expected FROM bat)
SELECT *, base_offset - expected AS gap FROM x WHERE base_offset <> expected""")
def batch_gaps(spark, d):
    return segments.gaps(_batches(spark, d))


@query(f"""WITH {BAT} SELECT topic, partition_id, segment_base, max(base_offset + last_offset_delta + 1) AS next_offset, max(max_timestamp) AS max_ts_ms, sum(batch_length + 12)::BIGINT AS size_bytes, count(*) AS n_batches
FROM bat GROUP BY topic, partition_id, segment_base""")
def segment_end_state(spark, d):
    return segments.end_states(_batches(spark, d))


@query(f"""WITH {BAT}, {_CUTS} SELECT b.topic, b.partition_id, c.cut, coalesce(max(base_offset + last_offset_delta + 1) FILTER (base_offset + last_offset_delta < cut), cut) AS log_end,
  count(*) FILTER (base_offset + last_offset_delta < cut) AS n_kept, count(*) FILTER (base_offset + last_offset_delta >= cut) AS n_cut
FROM bat b JOIN cuts c ON b.topic = c.topic AND b.partition_id = c.partition_id GROUP BY b.topic, b.partition_id, c.cut""")
def truncate_to(spark, d):
    cuts = _bounds(spark, d).select(*TP, F.floor((F.col("log_start") + F.col("log_end")) / 2).alias("cut"))
    return segments.truncate(_batches(spark, d), cuts)[1]


@query(f"""WITH {BAT}, x AS (SELECT *, base_offset % 37 = 0 OR base_offset <> coalesce(lag(base_offset + last_offset_delta + 1) OVER w, segment_base) AS bad FROM bat
  WINDOW w AS (PARTITION BY topic, partition_id, segment_base ORDER BY base_offset)),
y AS (SELECT *, bool_or(bad) OVER (PARTITION BY topic, partition_id, segment_base ORDER BY base_offset) AS lost FROM x)
SELECT topic, partition_id, segment_base, base_offset FROM y WHERE NOT lost""")
def recover_prefix(spark, d):
    good = _batches(spark, d).withColumn("good", F.col("base_offset") % 37 != 0)
    return segments.recover(good).select(*TP, "segment_base", "base_offset")


_LIMITED = f"""lim AS (SELECT s.*, m.retention_ms, m.retention_bytes FROM segments s JOIN (SELECT DISTINCT topic, retention_ms, retention_bytes, cleanup FROM topic_meta) m USING (topic) WHERE m.cleanup = 0),
aged AS (SELECT *, NOT bool_or(NOT sealed OR NOT (next_offset = base_offset OR coalesce(max_ts_ms >= 0 AND {NOW_MS} - max_ts_ms >= retention_ms, false))) OVER (
  PARTITION BY topic, partition_id ORDER BY base_offset) AS expired FROM lim)"""


def _meta(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "topic_meta")


@query(f"WITH {_LIMITED} SELECT topic, partition_id, base_offset, expired FROM aged")
def retention_age(spark, d):
    return retention.by_age(table(spark, d, "segments"), _meta(spark, d), NOW_MS).select(*TP, "base_offset", "expired")


@query(f"""WITH {_LIMITED} SELECT topic, partition_id, base_offset, sealed AND coalesce(sum(size_bytes) OVER (PARTITION BY topic, partition_id ORDER BY base_offset DESC) > retention_bytes, false) AS evicted FROM lim""")
def retention_bytes(spark, d):
    return retention.by_size(table(spark, d, "segments"), _meta(spark, d)).select(*TP, "base_offset", "evicted")


@query(f"""WITH {_LIMITED}, j AS (SELECT *, expired OR (sealed AND coalesce(sum(CASE WHEN expired THEN 0 ELSE size_bytes END) OVER (PARTITION BY topic, partition_id ORDER BY base_offset DESC) > retention_bytes, false)) AS gone FROM aged)
SELECT topic, partition_id, min(base_offset) FILTER (NOT gone) AS log_start, coalesce(sum(size_bytes) FILTER (NOT gone), 0)::BIGINT AS size_bytes, count(*) FILTER (NOT gone) AS n_kept, count(*) FILTER (gone) AS n_deleted
FROM j GROUP BY topic, partition_id""")
def retention_both(spark, d):
    return retention.new_bounds(retention.by_both(table(spark, d, "segments"), _meta(spark, d), NOW_MS))


@query(f"""WITH {_LIMITED}, j AS (SELECT *, NOT expired AND sealed AND coalesce(sum(CASE WHEN expired THEN 0 ELSE size_bytes END) OVER (PARTITION BY topic, partition_id ORDER BY base_offset DESC) > retention_bytes, false) AS evicted FROM aged)
SELECT s.topic, s.partition_id, s.base_offset, CASE WHEN j.expired THEN 'expired' WHEN j.evicted THEN 'evicted'
  WHEN NOT s.sealed AND s.next_offset > s.base_offset AND (s.size_bytes >= m.max_segment_bytes OR (s.max_ts_ms >= 0 AND {NOW_MS} - s.max_ts_ms >= m.max_segment_age_ms)) THEN 'rolled' ELSE 'kept' END AS fate
FROM segments s JOIN (SELECT DISTINCT topic, max_segment_bytes, max_segment_age_ms FROM topic_meta) m ON s.topic = m.topic
LEFT JOIN j ON s.topic = j.topic AND s.partition_id = j.partition_id AND s.base_offset = j.base_offset""")
def maintenance_sweep(spark, d):
    return retention.sweep(table(spark, d, "segments"), _meta(spark, d), NOW_MS)


@query("SELECT topic, partition_id, sum(size_bytes)::BIGINT AS size_bytes, count(*) AS n_segments FROM segments GROUP BY ALL")
def partition_bytes(spark, d):
    return table(spark, d, "segments").groupBy(*TP).agg(F.sum("size_bytes").alias("size_bytes"), F.count(F.lit(1)).alias("n_segments"))


# ---- compaction


@query(f"""WITH {EVENT_LOG} SELECT partition_id, user_id, max(log_offset) AS log_offset, arg_max(value, log_offset) AS value, arg_max(event_type, log_offset) AS event_type FROM elog GROUP BY partition_id, user_id""")
def latest_per_key(spark, d):
    e = _event_log(spark, d)
    return e.groupBy("partition_id", "user_id").agg(F.max("log_offset").alias("log_offset"), F.max_by("value", "log_offset").alias("value"), F.max_by("event_type", "log_offset").alias("event_type"))


@query(f"WITH {REC} SELECT topic, partition_id, hex(rec_key) AS rec_key, max(log_offset) AS log_offset FROM rec WHERE rec_key IS NOT NULL GROUP BY ALL")
def newest_offsets(spark, d):
    return compaction.newest_offsets(_records(spark, d, "rec_key")).withColumn("rec_key", F.hex("rec_key"))


_JUDGED = f"""{REC}, s AS (SELECT r.*, coalesce(g.sealed, true) AS sealed, m.delete_retention_ms FROM rec r JOIN (SELECT DISTINCT topic, delete_retention_ms FROM topic_meta WHERE cleanup = 1) m USING (topic)
  LEFT JOIN segments g ON r.topic = g.topic AND r.partition_id = g.partition_id AND r.segment_base = g.base_offset),
top AS (SELECT topic, partition_id, rec_key, max(log_offset) AS newest_offset FROM s WHERE sealed AND rec_key IS NOT NULL GROUP BY ALL),
jdg AS (SELECT s.*, coalesce(s.sealed AND t.newest_offset = s.log_offset, false) AS newest,
  CASE WHEN NOT sealed OR s.rec_key IS NULL THEN true WHEN t.newest_offset IS DISTINCT FROM s.log_offset THEN false WHEN rec_value IS NOT NULL THEN true
    ELSE coalesce({NOW_MS} * 1000 - epoch_us(ts) < delete_retention_ms * 1000, false) END AS retained
  FROM s LEFT JOIN top t ON s.topic = t.topic AND s.partition_id = t.partition_id AND s.rec_key = t.rec_key)"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d, "rec_key", "rec_value", "ts", "segment_base")
    return compaction.judged(r, table(spark, d, "segments"), table(spark, d, "topic_meta"), NOW_MS)


@query(f"WITH {_JUDGED} SELECT topic, partition_id, log_offset FROM jdg WHERE retained")
def compact_sealed(spark, d):
    return _judged(spark, d).where("retained").select(*TP, "log_offset")


@query(f"WITH {_JUDGED} SELECT topic, partition_id, log_offset FROM jdg WHERE NOT retained")
def compact_dropped(spark, d):
    return _judged(spark, d).where("not retained").select(*TP, "log_offset")


@query(f"WITH {_JUDGED} SELECT topic, partition_id, log_offset, newest, retained FROM jdg WHERE sealed AND rec_key IS NOT NULL AND rec_value IS NULL")
def compact_tombstones(spark, d):
    j = _judged(spark, d).where(F.col("sealed") & F.col("rec_key").isNotNull() & compaction.is_tombstone(F.col("rec_value")))
    return j.select(*TP, "log_offset", "newest", "retained")


@query(f"WITH {_JUDGED} SELECT topic, partition_id, count(*) AS n_unkeyed, bool_and(retained) AS all_kept FROM jdg WHERE rec_key IS NULL GROUP BY ALL")
def compact_unkeyed(spark, d):
    return _judged(spark, d).where("rec_key is null").groupBy(*TP).agg(F.count(F.lit(1)).alias("n_unkeyed"), F.bool_and("retained").alias("all_kept"))


@query(f"""WITH {_JUDGED}, g AS (SELECT topic, partition_id, segment_base, count(*) FILTER (retained) AS kept, count(*) FILTER (NOT retained) AS dropped, count(*) FILTER (newest) AS keys FROM jdg WHERE sealed GROUP BY ALL)
SELECT topic, partition_id, sum(kept)::BIGINT AS n_kept, sum(dropped)::BIGINT AS n_dropped, sum(keys)::BIGINT AS n_keys, count(*) FILTER (dropped > 0 AND kept > 0) AS n_rewritten,
  count(*) FILTER (dropped > 0 AND kept = 0) AS n_removed, count(*) FILTER (dropped = 0) AS n_clean FROM g GROUP BY topic, partition_id""")
def compact_report(spark, d):
    return compaction.pass_report(_judged(spark, d))


_DIRTY = """cuts AS (SELECT topic, partition_id, (3 * min(base_offset) + max(next_offset)) // 4 AS cut FROM segments GROUP BY ALL), rat AS (SELECT s.topic, s.partition_id, coalesce(sum(size_bytes) FILTER (sealed AND base_offset >= cut) / nullif(sum(size_bytes) FILTER (sealed), 0), 0)::DOUBLE AS dirty_ratio,
  sum(size_bytes) FILTER (sealed) AS al FROM segments s JOIN cuts c ON s.topic = c.topic AND s.partition_id = c.partition_id GROUP BY s.topic, s.partition_id)"""


def _ratios(spark: SparkSession, d: str) -> DataFrame:
    marks = _bounds(spark, d).select(*TP, F.floor((3 * F.col("log_start") + F.col("log_end")) / 4).alias("mark"))  # as if a quarter had been cleaned
    return compaction.dirty_ratio(table(spark, d, "segments"), marks)


@query(f"WITH {_DIRTY} SELECT topic, partition_id, round(dirty_ratio, 9) AS dirty_ratio FROM rat")
def dirty_ratio(spark, d):
    return _ratios(spark, d).withColumn("dirty_ratio", F.round("dirty_ratio", 9))


@query(f"WITH {_DIRTY} SELECT topic, partition_id, round(dirty_ratio, 9) AS dirty_ratio FROM rat WHERE dirty_ratio > 0.5 ORDER BY rat.dirty_ratio DESC, topic, partition_id LIMIT 1")
def dirtiest(spark, d):
    return compaction.dirtiest(_ratios(spark, d)).withColumn("dirty_ratio", F.round("dirty_ratio", 9))


_HOLES = """ho AS (SELECT topic, partition_id, segment_base, log_offset, log_offset - expected AS missing FROM (
  SELECT *, coalesce(lag(log_offset) OVER (PARTITION BY topic, partition_id, segment_base ORDER BY log_offset) + 1, segment_base) AS expected FROM rec) WHERE log_offset <> expected)"""


@query(f"WITH {_JUDGED}, {_HOLES.replace('FROM rec)', 'FROM jdg WHERE retained)')} SELECT * FROM ho")
def holes(spark, d):
    """The holes that compaction leaves."""
    return compaction.holes(_judged(spark, d).where("retained"))


@query(f"""WITH {REC}, {_HOLES}, r AS (SELECT topic, partition_id, segment_base, count(*) AS n_records, count(DISTINCT batch_base) AS n_batches, count(*) FILTER (rec_value IS NULL) AS n_tombstones FROM rec GROUP BY ALL),
h AS (SELECT topic, partition_id, segment_base, count(*) AS n_holes FROM ho GROUP BY ALL),
s AS (SELECT *, greatest(base_offset - lag(next_offset) OVER (PARTITION BY topic, partition_id ORDER BY base_offset), 0) AS gap FROM segments)
SELECT s.topic, s.partition_id, s.base_offset AS segment_base, next_offset, size_bytes, sealed, coalesce(gap, 0) AS gap_before, coalesce(n_records, 0) AS n_records, coalesce(n_batches, 0) AS n_batches,
  coalesce(n_tombstones, 0) AS n_tombstones, coalesce(n_holes, 0) AS n_holes
FROM s LEFT JOIN r ON s.topic = r.topic AND s.partition_id = r.partition_id AND s.base_offset = r.segment_base LEFT JOIN h ON s.topic = h.topic AND s.partition_id = h.partition_id AND s.base_offset = h.segment_base""")
def dump_segments(spark, d):
    return compaction.dump(_records(spark, d, "segment_base", "batch_base", "rec_value"), table(spark, d, "segments"))


@query("""SELECT topic, partition_id, base_offset, base_offset - prev AS missing FROM (SELECT *, lag(next_offset) OVER (PARTITION BY topic, partition_id ORDER BY base_offset) AS prev FROM segments) WHERE base_offset > prev""")
def segment_gaps(spark, d):
    return segments.missing(table(spark, d, "segments"))


@query(f"""WITH {REC}, {BAT}, h AS (SELECT topic, partition_id, batch_base, count(*) AS n_records, min(log_offset) AS first_offset, max(log_offset) AS last_offset, count(*) FILTER (rec_value IS NULL) AS n_tombstones,
  count(*) FILTER (log_offset <> expected) AS n_holes, sum(log_offset - expected)::BIGINT AS n_missing FROM (
  SELECT *, coalesce(lag(log_offset) OVER (PARTITION BY topic, partition_id, segment_base ORDER BY log_offset) + 1, segment_base) AS expected FROM rec) GROUP BY topic, partition_id, batch_base)
SELECT b.topic, b.partition_id, b.segment_base, b.base_offset, coalesce(sum(batch_length + 12) OVER (PARTITION BY b.topic, b.partition_id, b.segment_base ORDER BY b.base_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position,
  (batch_length + 12)::BIGINT AS bytes, max_timestamp, h.n_records, h.first_offset, h.last_offset, h.n_tombstones, h.n_holes, h.n_missing
FROM bat b JOIN h ON b.topic = h.topic AND b.partition_id = h.partition_id AND b.base_offset = h.batch_base""")
def dump_batches(spark, d):
    """Every batch with its place in the segment, and what compaction has taken before and within it."""
    return compaction.dump_batches(_records(spark, d, "segment_base", "batch_base", "rec_value"), _batches(spark, d))


# ---- positions and groups


@query(f"WITH {POS} SELECT * FROM pos WHERE next_offset IS NOT NULL")
def offsets_replay(spark, d):
    return offsets.replay(table(spark, d, "commits"))


@query(f"WITH {POS} SELECT group_id, topic, partition_id, seq FROM pos WHERE next_offset IS NULL")
def offsets_forgotten(spark, d):
    return offsets.forgotten(table(spark, d, "commits"))


@query(f"""WITH {POS}, q AS (SELECT DISTINCT c.group_id, s.topic, s.partition_id FROM commits c JOIN segments s ON c.topic = s.topic)
SELECT q.*, coalesce(p.next_offset, -1) AS next_offset FROM q LEFT JOIN pos p ON q.group_id = p.group_id AND q.topic = p.topic AND q.partition_id = p.partition_id""")
def offset_fetch_default(spark, d):
    c = table(spark, d, "commits")
    asked = c.select("group_id", "topic").distinct().join(table(spark, d, "segments").select(*TP).distinct(), "topic")
    return offsets.fetch_positions(asked.select(*GTP), offsets.replay(c))


@query("""WITH c AS (SELECT DISTINCT seq, group_id, topic, partition_id, next_offset, CASE WHEN seq % 7 = 0 THEN -1 ELSE 1 + seq % 3 END AS generation FROM commits)
SELECT seq, group_id, topic, partition_id, next_offset, generation, CASE WHEN generation < 0 THEN 0 WHEN length(group_id) % 2 = 0 THEN 13 WHEN generation <> 2 THEN 12 WHEN next_offset < 0 THEN 1 ELSE 0 END AS error FROM c""")
def commit_fenced(spark, d):
    """Commits that claim a generation, against the present one (2); some groups aren't known to the coordinator."""
    seq = F.col("seq")
    c = table(spark, d, "commits").select("seq", *GTP, "next_offset").dropDuplicates(["seq"]).withColumn("generation", F.when(seq % 7 == 0, -1).otherwise(1 + seq % 3))
    now = c.select("group_id").distinct().where(F.length("group_id") % 2 == 1).withColumn("generation", F.lit(2))
    return offsets.fenced(c, now)


@query(f"""WITH {POS}, {BOUNDS} SELECT p.group_id, p.topic, p.partition_id, p.next_offset, b.log_end, b.log_end - least(greatest(p.next_offset, b.log_start), b.log_end) AS lag
FROM pos p JOIN bnd b ON p.topic = b.topic AND p.partition_id = b.partition_id WHERE p.next_offset IS NOT NULL""")
def consumer_lag(spark, d):
    return offsets.lag(offsets.replay(table(spark, d, "commits")), _bounds(spark, d))


@query("""WITH c AS (SELECT DISTINCT seq, group_id, topic, partition_id, next_offset FROM commits WHERE next_offset >= 0)
SELECT * FROM (SELECT seq, group_id, topic, partition_id, next_offset, lag(next_offset) OVER (PARTITION BY group_id, topic, partition_id ORDER BY seq) AS before FROM c) WHERE next_offset < before""")
def positions_back(spark, d):
    return offsets.went_back(table(spark, d, "commits"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Members as the notes of their commits name them, subscribed to the topics they commit for."""
    return table(spark, d, "commits").select("group_id", F.coalesce("metadata", F.lit("none")).alias("member_id"), "topic").distinct()


MEM = "mem AS (SELECT DISTINCT group_id, coalesce(metadata, 'none') AS member_id, topic FROM commits), par AS (SELECT DISTINCT topic, partition_id FROM segments)"


@query(f"""WITH {MEM}, m AS (SELECT *, row_number() OVER (PARTITION BY group_id, topic ORDER BY member_id) - 1 AS m, count(*) OVER (PARTITION BY group_id, topic) AS n FROM mem),
p AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY partition_id) - 1 AS i, count(*) OVER (PARTITION BY topic) AS k FROM par)
SELECT group_id, member_id, m.topic, partition_id FROM m JOIN p ON m.topic = p.topic
WHERE i >= m * (k // n) + least(m, k % n) AND i < (m + 1) * (k // n) + least(m + 1, k % n)""")
def assign_range(spark, d):
    return groups.ASSIGNORS["range"](_members(spark, d), table(spark, d, "segments"))


@query(SQL["assign_range"])
def assignment_roundtrip(spark, d):
    """The assignment of each member in its binary form and read again."""
    return metas.decode_assignments(metas.encode_assignments(assign_range(spark, d)))


@query(f"""WITH {MEM}, w AS (SELECT DISTINCT group_id, member_id FROM mem), m AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY member_id) - 1 AS m, count(*) OVER (PARTITION BY group_id) AS n FROM w),
p AS (SELECT x.group_id, q.topic, q.partition_id, row_number() OVER (PARTITION BY x.group_id ORDER BY q.topic, q.partition_id) - 1 AS i FROM (SELECT DISTINCT group_id, topic FROM mem) x JOIN par q ON x.topic = q.topic)
SELECT p.group_id, m.member_id, p.topic, p.partition_id FROM p JOIN m ON p.group_id = m.group_id AND p.i % m.n = m.m""")
def assign_roundrobin(spark, d):
    return groups.ASSIGNORS["roundrobin"](_members(spark, d), table(spark, d, "segments"))


@query(f"""WITH RECURSIVE {MEM}, w AS (SELECT group_id, member_id, row_number() OVER (PARTITION BY group_id ORDER BY member_id) - 1 AS m, count(*) OVER (PARTITION BY group_id) AS n FROM (SELECT DISTINCT group_id, member_id FROM mem)),
p AS (SELECT x.group_id, q.topic, q.partition_id, row_number() OVER (PARTITION BY x.group_id ORDER BY q.topic, q.partition_id) - 1 AS i FROM (SELECT DISTINCT group_id, topic FROM mem) x JOIN par q ON x.topic = q.topic),
r AS (SELECT DISTINCT group_id, 0::BIGINT AS i, 0::BIGINT AS turn FROM w UNION ALL
  SELECT r.group_id, r.i + 1, min(r.turn + (w.m - r.turn % w.n + w.n) % w.n) + 1 FROM r JOIN p ON p.group_id = r.group_id AND p.i = r.i JOIN w ON w.group_id = r.group_id
  JOIN mem ON mem.group_id = w.group_id AND mem.member_id = w.member_id AND mem.topic = p.topic GROUP BY r.group_id, r.i)
SELECT r.group_id, w.member_id, p.topic, p.partition_id FROM r JOIN p ON p.group_id = r.group_id AND p.i = r.i - 1 JOIN w ON w.group_id = r.group_id AND w.m = (r.turn - 1) % w.n""")
def assign_unequal(spark, d):
    return groups.ASSIGNORS["roundrobin-unequal"](_members(spark, d), table(spark, d, "segments"))


@query("""WITH m AS (SELECT DISTINCT group_id, coalesce(metadata, 'none') AS member_id, CASE length(coalesce(metadata, 'none')) % 3 WHEN 0 THEN ['range', 'roundrobin'] WHEN 1 THEN ['roundrobin', 'range'] ELSE ['roundrobin'] END AS protocols FROM commits),
h AS (SELECT group_id, min(member_id) AS leader_id, arg_min(protocols, member_id) AS wanted, count(*) AS n FROM m GROUP BY group_id),
c AS (SELECT h.group_id, p, list_position(wanted, p) AS place FROM h, (SELECT unnest(['range', 'roundrobin']) AS p) x WHERE list_contains(wanted, p)
  AND (SELECT count(*) FROM m WHERE m.group_id = h.group_id AND list_contains(m.protocols, p)) = n)
SELECT h.group_id, leader_id, n AS n_members, coalesce(min(c.p) FILTER (c.place = (SELECT min(place) FROM c c2 WHERE c2.group_id = h.group_id)), '') AS protocol FROM h LEFT JOIN c ON h.group_id = c.group_id GROUP BY ALL""")
def group_leader_protocol(spark, d):
    n = F.length("member_id") % 3
    lists = [F.array(F.lit("range"), F.lit("roundrobin")), F.array(F.lit("roundrobin"), F.lit("range")), F.array(F.lit("roundrobin"))]
    m = _members(spark, d).select("group_id", "member_id").distinct().withColumn("protocols", F.when(n == 0, lists[0]).when(n == 1, lists[1]).otherwise(lists[2]))
    return groups.leaders(m)


@query(f"""WITH h AS (SELECT DISTINCT group_id, coalesce(metadata, 'none') AS member_id, commit_ts_ms AS ts_ms FROM commits),
g AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY group_id, member_id ORDER BY ts_ms) AS silence FROM h)
SELECT group_id, member_id, max(ts_ms) AS last_ms, coalesce(max(silence), 0) AS longest_silence_ms, {NOW_MS} - max(ts_ms) >= 86400000 AS expired FROM g GROUP BY group_id, member_id""")
def member_expiry(spark, d):
    beats = table(spark, d, "commits").select("group_id", F.coalesce("metadata", F.lit("none")).alias("member_id"), F.col("commit_ts_ms").alias("ts_ms")).distinct()
    return groups.expiry(beats, NOW_MS, 86_400_000)


@query(f"""WITH {BOUNDS}, r AS (SELECT b.*, i.r, log_end - i.r * (partition_id + 1) * 3 AS fetched, {NOW_MS} - i.r * (partition_id + 1) * 4000 AS came FROM bnd b, (SELECT unnest([0, 1, 2]) AS r) i)
SELECT topic, partition_id, min(fetched) FILTER ({NOW_MS} - came < 10000) AS high_watermark, count(*) FILTER ({NOW_MS} - came < 10000) AS n_in_sync, max(log_end) AS log_end FROM r GROUP BY topic, partition_id""")
def high_watermark(spark, d):
    """High watermark over the replicas in sync (those that fetched within ten seconds), from a table of replica progress."""
    lag = F.col("r") * (F.col("partition_id") + 1)
    r = _bounds(spark, d).withColumn("r", F.explode(F.array(*map(F.lit, (0, 1, 2))))).withColumns({"fetched": F.col("log_end") - lag * 3, "at": F.lit(NOW_MS) - lag * 4000})
    recent = F.lit(NOW_MS) - F.col("at") < 10_000
    return r.groupBy(*TP).agg(F.min(F.when(recent, F.col("fetched"))).alias("high_watermark"), F.count_if(recent).alias("n_in_sync"), F.max("log_end").alias("log_end"))


# A history of groups: seq, group, op, member, client, generation, topics, protocols, time, assignments; and what must come of it: member, error,
# generation, state, members, leader, protocol, assignment.
_O, _R = ["o"], ["range"]
HISTORY = [
    # one member settles at once, and its own assignment comes back
    (1, "g", "join", "", "a", -1, _O, _R, 1000, {}, "a-1", 0, 1, "completing", 1, "a-1", "range", ""),
    (2, "g", "sync", "a-1", "a", 1, [], [], 1000, {"a-1": "x"}, "a-1", 0, 1, "stable", 1, "a-1", "range", "x"),
    # groups are independent, member numbers go on over all of them
    (3, "h", "join", "", "b", -1, _O, _R, 1000, {}, "b-2", 0, 1, "completing", 1, "b-2", "range", ""),
    # a second member starts a rebalance, of which the first hears by its heartbeat
    (4, "g", "join", "", "b", -1, _O, _R, 1000, {}, "b-3", 14, 1, "preparing", 2, "a-1", "range", ""),
    (5, "g", "heartbeat", "a-1", "a", 1, [], [], 1000, {}, "a-1", 14, 1, "preparing", 2, "a-1", "range", ""),
    (6, "g", "join", "a-1", "a", -1, _O, _R, 1000, {}, "a-1", 0, 2, "completing", 2, "a-1", "range", ""),
    # a stale generation is fenced out
    (7, "g", "heartbeat", "a-1", "a", 1, [], [], 1000, {}, "a-1", 12, 2, "completing", 2, "a-1", "range", ""),
    (8, "g", "sync", "a-1", "a", 1, [], [], 1000, {"a-1": "old"}, "a-1", 12, 2, "completing", 2, "a-1", "range", ""),
    # a follower that syncs before the leader asks again; then each gets its own assignment
    (9, "g", "sync", "b-3", "b", 2, [], [], 1000, {}, "b-3", 14, 2, "completing", 2, "a-1", "range", ""),
    (10, "g", "sync", "a-1", "a", 2, [], [], 1000, {"a-1": "p", "b-3": "q", "z": "r"}, "a-1", 0, 2, "stable", 2, "a-1", "range", "p"),
    # a retry after the group has settled is no rebalance, a new subscription is one
    (11, "g", "join", "b-3", "b", -1, _O, _R, 1000, {}, "b-3", 0, 2, "stable", 2, "a-1", "range", ""),
    (12, "g", "sync", "b-3", "b", 2, [], [], 1000, {}, "b-3", 0, 2, "stable", 2, "a-1", "range", "q"),
    (13, "g", "heartbeat", "b-3", "b", 2, [], [], 1000, {}, "b-3", 0, 2, "stable", 2, "a-1", "range", ""),
    (14, "g", "join", "b-3", "b", -1, ["o", "p"], _R, 1000, {}, "b-3", 14, 2, "preparing", 2, "a-1", "range", ""),
    (15, "g", "join", "a-1", "a", -1, _O, _R, 1000, {}, "a-1", 0, 3, "completing", 2, "a-1", "range", ""),
    # strangers are refused; who is left has to join again
    (16, "g", "leave", "nobody", "", -1, [], [], 1000, {}, "nobody", 13, 3, "completing", 2, "a-1", "range", ""),
    (17, "g", "leave", "b-3", "b", -1, [], [], 1000, {}, "b-3", 0, 3, "preparing", 1, "a-1", "range", ""),
    (18, "g", "join", "nobody", "b", -1, _O, _R, 1000, {}, "nobody", 13, 3, "preparing", 1, "a-1", "range", ""),
    (19, "g", "join", "a-1", "a", -1, _O, _R, 1000, {}, "a-1", 0, 4, "completing", 1, "a-1", "range", ""),
    # the last one's departure removes the group; the next of its name begins anew
    (20, "g", "leave", "a-1", "a", -1, [], [], 1000, {}, "a-1", 0, 0, "empty", 0, "", "", ""),
    (21, "g", "join", "", "c", -1, _O, _R, 1000, {}, "c-4", 0, 1, "completing", 1, "c-4", "range", ""),
    (22, "", "join", "", "d", -1, _O, _R, 1000, {}, "", 15, 0, "empty", 0, "", "", ""),
    (23, "h", "sync", "b-2", "b", 1, [], [], 1000, {"b-2": "w"}, "b-2", 0, 1, "stable", 1, "b-2", "range", "w"),
    # one member of two falls silent, then the other
    (24, "e", "join", "", "x", -1, _O, _R, 1000, {}, "x-5", 0, 1, "completing", 1, "x-5", "range", ""),
    (25, "e", "join", "", "y", -1, _O, _R, 1000, {}, "y-6", 14, 1, "preparing", 2, "x-5", "range", ""),
    (26, "e", "join", "x-5", "x", -1, _O, _R, 1000, {}, "x-5", 0, 2, "completing", 2, "x-5", "range", ""),
    (27, "e", "heartbeat", "x-5", "x", 2, [], [], 4000, {}, "x-5", 0, 2, "completing", 2, "x-5", "range", ""),
    (28, "e", "tick", "", "", -1, [], [], 6500, {}, "", 0, 2, "preparing", 1, "x-5", "range", ""),
    (29, "e", "heartbeat", "x-5", "x", 2, [], [], 6500, {}, "x-5", 14, 2, "preparing", 1, "x-5", "range", ""),
    (30, "e", "tick", "", "", -1, [], [], 20_000, {}, "", 0, 0, "empty", 0, "", "", ""),
    (31, "e", "heartbeat", "x-5", "x", 2, [], [], 20_000, {}, "x-5", 13, 0, "empty", 0, "", "", ""),
    # the protocol is one that all have, or none
    (32, "p", "join", "", "a", -1, _O, ["range", "roundrobin"], 20_000, {}, "a-7", 0, 1, "completing", 1, "a-7", "range", ""),
    (33, "p", "join", "", "b", -1, _O, ["roundrobin"], 20_000, {}, "b-8", 14, 1, "preparing", 2, "a-7", "range", ""),
    (34, "p", "join", "a-7", "a", -1, _O, ["range", "roundrobin"], 20_000, {}, "a-7", 0, 2, "completing", 2, "a-7", "roundrobin", ""),
    (35, "q", "join", "", "a", -1, _O, ["range"], 20_000, {}, "a-9", 0, 1, "completing", 1, "a-9", "range", ""),
    (36, "q", "join", "", "b", -1, _O, ["roundrobin"], 20_000, {}, "b-10", 14, 1, "preparing", 2, "a-9", "range", ""),
    (37, "q", "join", "a-9", "a", -1, _O, ["range"], 20_000, {}, "a-9", 0, 2, "completing", 2, "a-9", "", ""),
]
_TOLD = "seq, group_id, op, member_id, error, generation, state, n_members, leader, protocol, assignment"
_HISTORY_SQL = f"SELECT * FROM (VALUES {', '.join(str((x[0], x[1], x[2], *x[10:])) for x in HISTORY)}) t({_TOLD})"


def history(spark: SparkSession) -> DataFrame:
    rows = [(seq, g, op, who, client, None, gen, topics, protocols, 5_000 if g == "e" else 10_000, at, given) for seq, g, op, who, client, gen, topics, protocols, at, given, *_ in HISTORY]
    return spark.createDataFrame(rows, groups.EVENTS)


def group_events_of(commits: DataFrame) -> DataFrame:
    """A history of joins, syncs, heartbeats and departures made of commits: what a member does follows from ``seq``."""
    seq = F.col("seq")
    op = F.when(seq % 11 == 0, "leave").when(seq % 3 == 0, "heartbeat").when(seq % 3 == 1, "sync").otherwise("join")
    known = F.when(seq % 6 == 2, F.lit("")).otherwise(F.concat(F.lit("c-"), (seq % 40).cast("string")))
    return commits.dropDuplicates(["seq"]).select(
        "seq", "group_id", op.alias("op"), known.alias("member_id"), F.lit("c").alias("client_id"), (seq % 5).cast("int").alias("generation"), F.array("topic").alias("topics"),
        F.array(F.lit("range")).alias("protocols"), F.lit(2_000_000_000).alias("timeout_ms"), F.col("commit_ts_ms").alias("ts_ms"), F.create_map(known, F.col("topic")).alias("assignments"),
    )


@query(_HISTORY_SQL)
def group_replay(spark, d):
    """The coordinator over a written history, whose answers are written beside it."""
    return groups.replay_events(history(spark)).select(*_TOLD.split(", "))


# ---- streams

#: Micro-batches in which the tables come to the streaming queries.
TRIGGERS = 4


def _nth(order: str, lo: Column, hi: Column) -> Column:
    """The micro-batch of a row: equal shares of the range of ``order``."""
    return F.floor((F.col(order) - lo) * TRIGGERS / (hi - lo + 1)).cast("int")


def _as_stream(spark: SparkSession, d: str, name: str, order: str, by: list[str], columns: list[str] | None = None) -> DataFrame:
    """A table as it grows: the rows of each ``by`` come in the order of ``order``, in TRIGGERS micro-batches that cut through batches of the log."""
    rows = table(spark, d, name)
    ends = rows.groupBy(*by).agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"))  # a row per partition
    cut = rows.crossJoin(F.broadcast(ends)) if not by else rows.join(F.broadcast(ends), by)  # without ``by``, one row
    part = cut.withColumn("__at", _nth(order, F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")
    stream = live.staged(part.select(*(columns or rows.columns), "__at"), F.col("__at"), TRIGGERS, shared_dir(spark, f"stream-{name}"))
    return stream.drop("__at")


@query(SQL["append_offsets"])
def stream_offsets(spark, d):
    """Offsets given out by a stream; equal to those of one append."""
    e = _as_stream(spark, d, "events", "event_id", [], ["event_id", "user_id"]).withColumn("partition_id", _partition())
    return live.give_offsets(e, "event_id", shared_dir(spark, "stream-offsets")).select("event_id", "partition_id", "log_offset")


_CHANGES = "rec_key is not null"


@query(f"""WITH {REC} SELECT topic, partition_id, hex(rec_key) AS rec_key, log_offset AS seq FROM (
  SELECT *, row_number() OVER (PARTITION BY topic, partition_id, rec_key ORDER BY log_offset DESC) AS nth FROM rec WHERE rec_key IS NOT NULL
    AND topic IN (SELECT topic FROM topic_meta WHERE cleanup = 1)) WHERE nth = 1 AND rec_value IS NOT NULL""")
def stream_compacted(spark, d):
    """The compacted topics as a view kept up by a stream."""
    topics = [r["topic"] for r in table(spark, d, "topic_meta").where("cleanup = 1").select("topic").distinct().collect()]
    rows = _as_stream(spark, d, "log_records", "log_offset", TP, [*TP, "log_offset", "rec_key", "rec_value"])
    changes = rows.where(_CHANGES).where(F.col("topic").isin(topics)).select(*TP, "rec_key", F.col("log_offset").alias("seq"), "rec_value")
    view = live.compacted_view(changes, shared_dir(spark, "stream-compacted"), 4)
    return view.select(*TP, F.hex("rec_key").alias("rec_key"), "seq")


@query("SELECT topic, partition_id, count(DISTINCT log_offset) AS n_records FROM log_records GROUP BY ALL")
def stream_consume(spark, d):
    """Everything that is there, handed out batch by batch to a sink whose output a repeated batch overwrites."""
    base = shared_dir(spark, "stream-consume")
    stream = _as_stream(spark, d, "log_records", "log_offset", TP, [*TP, "log_offset"])
    live.consume(stream, base, lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}"))
    return spark.read.parquet(f"{base}/out").select(*TP, "log_offset").distinct().groupBy(*TP).agg(F.count(F.lit(1)).alias("n_records"))


@query(f"""WITH {POS}, mine AS (SELECT topic, partition_id, next_offset FROM pos WHERE group_id = (SELECT min(group_id) FROM commits))
SELECT r.topic, r.partition_id, count(DISTINCT r.log_offset) AS n_records, min(r.log_offset) AS first_offset, max(r.log_offset) + 1 AS next_offset FROM log_records r
LEFT JOIN mine m ON r.topic = m.topic AND r.partition_id = m.partition_id WHERE r.log_offset >= coalesce(m.next_offset, 0) GROUP BY ALL""")
def stream_group_consume(spark, d):
    """Everything that the first group by name hasn't consumed yet: it goes on from its committed positions and commits new ones after each output."""
    base, c = shared_dir(spark, "stream-group-consume"), table(spark, d, "commits")
    group = c.agg(F.min("group_id")).first()[0]
    stream = _as_stream(spark, d, "log_records", "log_offset", TP, [*TP, "log_offset"])
    live.consume_group(stream, group, base, lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}"), f"{base}/positions", offsets.replay(c))
    commits = spark.read.parquet(f"{base}/positions/*/*").groupBy(*TP).agg(F.max_by("next_offset", "seq").alias("next_offset"))
    read = spark.read.parquet(f"{base}/out").groupBy(*TP).agg(F.count_distinct("log_offset").alias("n_records"), F.min("log_offset").alias("first_offset"))
    return read.join(commits, TP)


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL
HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def stream_hourly(spark, d):
    """Counts per hour and type of event, given out as the watermark passes."""
    e = _as_stream(spark, d, "events", "event_id", [], ["event_id", "ts", "event_type"])
    return live.run_to_end(live.hourly_counts(e, "ts", "event_type"), shared_dir(spark, "stream-hourly"))


def _slack(spark: SparkSession, d: str) -> live.KSlack:
    timed = kslack.event_times(_as_stream(spark, d, "log_records", "log_offset", TP, [*kslack.BATCH, "log_offset", "timestamp_delta", "size_bytes"]), table(spark, d, "batches"))
    return live.KSlack(spark, shared_dir(spark, "stream-kslack")).run(timed)


_ENDS = """ends AS (SELECT topic, partition_id, max(top) AS done FROM (
  SELECT *, batch_base = max(batch_base) OVER (PARTITION BY topic, partition_id) AS open FROM tops WHERE batch_base IN (SELECT batch_base FROM timed t WHERE t.topic = tops.topic AND t.partition_id = tops.partition_id AND e IS NOT NULL)) WHERE NOT open GROUP BY ALL)"""


@query(_HISTORY_SQL)
def stream_group(spark, d):
    """The coordinator on the written history as a stream of micro-batches."""
    events = groups.issue(history(spark).drop("issued")).withColumn("__at", F.floor((F.col("seq") - 1) / 10).cast("int"))
    stream = live.staged(events, F.col("__at"), 4, shared_dir(spark, "stream-groups")).drop("__at")
    told = live.run_to_end(live.coordinate(stream), shared_dir(spark, "stream-group"))
    return told.where("op <> 'timer'").select(*_TOLD.split(", "))


@query(f"""WITH {TIMED_SQL}, {_ENDS} SELECT al.topic, al.partition_id, CASE WHEN beyond THEN 'late' ELSE 'released' END AS kind, log_offset, e
FROM al LEFT JOIN ends ON al.topic = ends.topic AND al.partition_id = ends.partition_id WHERE beyond OR e < done - 7200000""")
def stream_kslack(spark, d):
    """The K-slack buffer on a stream: the records that came too late, and those released so far, of four micro-batches that cut through batches."""
    return _slack(spark, d).out().drop("step")


@query(f"""WITH {TIMED_SQL}, {_ENDS}, x AS (SELECT al.*, (floor(e / 3600000.0) * 3600000)::BIGINT AS period_ms, coalesce(e < done - 7200000, false) AS final
  FROM al LEFT JOIN ends ON al.topic = ends.topic AND al.partition_id = ends.partition_id WHERE NOT beyond AND e IS NOT NULL)
SELECT topic, period_ms, count(*) FILTER (final) AS n_final, coalesce(sum(size_bytes) FILTER (final), 0)::BIGINT AS bytes_final, count(*) FILTER (NOT final) AS n_held,
  coalesce(sum(size_bytes) FILTER (NOT final), 0)::BIGINT AS bytes_held FROM x GROUP BY ALL""")
def stream_periods(spark, d):
    """Counts and sums per topic and hour of event time as published after the last micro-batch: final ones of what left the buffer, provisional ones of what is in it."""
    return _slack(spark, d).published()
