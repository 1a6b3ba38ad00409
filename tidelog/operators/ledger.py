"""Processing only what is new: a ledger of work items that outlives the runs that use it.

A run adds *work items*: for each reader (group) and log partition the offsets from where the ledger's items end, or else from the committed position, to the log
end, cut at multiples of ``ITEM_OFFSETS``. An item is ``pending``, ``leased`` (to a worker until a time, under a fencing token
greater than any before) or ``done``. A lease that expires returns the item to pending; a completion under an older token than
the item's present one is refused. Results go to a path that belongs to the lease alone, so a retry writes the same rows to
the same place, and readers take only rows of items that are done, written under the accepted token.

Each step is a pure function from one state of the ledger to the next. ``Ledger`` keeps the states in a folder: a state is written whole under a name of its own, then the next
number is given to it by a rename that never overwrites. So whoever opens the folder finds the newest complete state by listing; a crash between two steps leaves at most a state
without number, which nobody reads; and of two writers who changed the same state one wins, while the other takes its step again on the state that won.

Scale: an item spans at most ITEM_OFFSETS offsets, so a partition that holds a third of all rows is many items, and records meet their
items by (topic, partition, block): an even shuffle, whatever the positions. Records are shuffled once however many groups read them, and only those
at or after the least position of their partition that any item has (a row per log partition, broadcast).

Nulls and odd input: a null position means the first record; refused (negative) commits are left out; commits written twice
count once; groups never seen in the log have no items; an empty log or no commits give no items; a position that goes back after items were made changes nothing,
as what was processed isn't repeated.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.common import Manifest, shared_dir

ITEM_OFFSETS = 16_384
SHELF = 4_096
#: Changes of other writers that one step gives way to before it gives up.
ATTEMPTS = 100
TP = ["topic", "partition_id"]
GTP = ["group_id", *TP]
ITEM = [*GTP, "block", "from_offset"]
LEDGER = "group_id string, topic string, partition_id int, block bigint, from_offset bigint, to_offset bigint, state string, worker string, lease_until_ms bigint, token bigint, path string"
COLUMNS = [c.split()[0] for c in LEDGER.split(", ")]


class Conflict(RuntimeError):
    """Others changed the ledger again and again."""


def positions(commits: DataFrame) -> DataFrame:
    """Last position of every group, topic and partition by ``seq``; ``next_offset`` null where it was forgotten."""
    taken = commits.where(F.col("next_offset").isNull() | (F.col("next_offset") >= 0))
    newest = taken.groupBy(*GTP).agg(F.max(F.struct("seq", "next_offset")).alias("c"))
    return newest.select(*GTP, F.col("c.next_offset").alias("next_offset"))


def plan_items(commits: DataFrame, records: DataFrame, item: int = ITEM_OFFSETS, planned: DataFrame | None = None) -> DataFrame:
    """The items that are to be added: from the end of those ``planned`` (a ledger), else the position, else the first record, to the log end."""
    ends = records.groupBy(*TP).agg(F.min("log_offset").alias("lo"), F.max("log_offset").alias("hi"))
    at = positions(commits)
    if planned is not None:
        done = planned.groupBy(*GTP).agg((F.max("to_offset") + 1).alias("planned_to"))
        at = at.join(done, GTP, "left").withColumn("next_offset", F.greatest("next_offset", "planned_to")).drop("planned_to")
    start = F.greatest(F.coalesce("next_offset", "lo"), "lo")
    spans = at.join(ends, TP).withColumn("first_offset", start).where(F.col("first_offset") <= F.col("hi"))
    # in two steps, so that no row holds an array of more than SHELF blocks, or of all shelves
    first, last = F.floor(F.col("first_offset") / item), F.floor(F.col("hi") / item)
    shelves = spans.select("*", F.explode(F.sequence(F.floor(first / SHELF), F.floor(last / SHELF))).alias("shelf"))
    blocks = F.sequence(F.greatest(first, F.col("shelf") * SHELF), F.least(last, F.col("shelf") * SHELF + SHELF - 1))
    return shelves.select(*GTP, F.explode(blocks).alias("block"), "first_offset", "hi").select(
        *GTP,
        "block",
        F.greatest("first_offset", F.col("block") * item).alias("from_offset"),
        F.least("hi", F.col("block") * item + item - 1).alias("to_offset"),
        F.lit("pending").alias("state"),
        F.lit(None).cast("string").alias("worker"),
        F.lit(None).cast("bigint").alias("lease_until_ms"),
        F.lit(0).cast("bigint").alias("token"),
        F.lit(None).cast("string").alias("path"),
    )


def _change(ledger: DataFrame, when: Column, **values: Column) -> DataFrame:
    return ledger.withColumns({c: F.when(when, v).otherwise(F.col(c)) for c, v in values.items()}).select(*COLUMNS)


def expire(ledger: DataFrame, now_ms: int) -> DataFrame:
    """Leases that have run out return to pending; their token stays, so their holder is fenced off once another takes over."""
    out = (F.col("state") == "leased") & (F.col("lease_until_ms") <= now_ms)
    return _change(ledger, out, state=F.lit("pending"), worker=F.lit(None).cast("string"), lease_until_ms=F.lit(None).cast("bigint"))


def lease(ledger: DataFrame, worker: str, now_ms: int, for_ms: int, which: Column | None = None, path: str | None = None) -> DataFrame:
    """Give the pending items (of ``which``) to ``worker`` under the next token, their results to go to ``path``."""
    free = (F.col("state") == "pending") & (F.lit(True) if which is None else which)
    where = {} if path is None else {"path": F.lit(path)}
    return _change(ledger, free, state=F.lit("leased"), worker=F.lit(worker), lease_until_ms=F.lit(now_ms + for_ms).cast("bigint"), token=F.col("token") + 1, **where)


def complete(ledger: DataFrame, claims: DataFrame, now_ms: int) -> DataFrame:
    """Mark the items of ``claims`` (ITEM, worker, token) done. Claims under a stale token, another's lease or one that has run out change nothing."""
    held = claims.select(*ITEM, F.col("worker").alias("__worker"), F.col("token").alias("__token")).distinct()
    both = ledger.join(held, [*ITEM], "left")
    good = (F.col("state") == "leased") & (F.col("__worker") == F.col("worker")) & (F.col("__token") == F.col("token")) & (F.col("lease_until_ms") > now_ms)
    marked = both.withColumn("__good", F.coalesce(good, F.lit(False)))
    best = marked.groupBy(*COLUMNS).agg(F.bool_or("__good").alias("__good"))  # several claims on an item
    return _change(best, F.col("__good"), state=F.lit("done"), lease_until_ms=F.lit(None).cast("bigint"))


def share(part: int, parts: int) -> Column:
    """Every ``parts``-th of the items, for workers that lease at once."""
    return F.pmod(F.xxhash64(*ITEM), F.lit(parts)) == part


def rows_of(items: DataFrame, records: DataFrame, item: int = ITEM_OFFSETS) -> DataFrame:
    """The records of ``items``, each once per item."""
    least = items.groupBy(*TP).agg(F.min("from_offset").alias("__least"), F.max("to_offset").alias("__most"))  # a row per log partition
    wanted = records.select(*TP, "log_offset").join(F.broadcast(least), TP).where("log_offset between __least and __most")
    by_block = wanted.select(*TP, "log_offset", F.floor(F.col("log_offset") / item).alias("block")).repartition(*TP, "block").dropDuplicates()
    return by_block.join(items.select(*ITEM, "to_offset", "token"), [*TP, "block"]).where("log_offset between from_offset and to_offset")


class Ledger:
    """The states of a ledger in a folder, and the results of its items. Objects hold nothing but the folder's name."""

    def __init__(self, spark: SparkSession, base: str | None = None, item: int = ITEM_OFFSETS) -> None:
        self.spark, self.base, self.item = spark, base or shared_dir(spark, "ledger"), item
        self.log = Manifest(spark, f"{self.base}/log")

    def _at(self) -> tuple[int, DataFrame]:
        version, content = self.log.read()
        return version, self.spark.read.schema(LEDGER).parquet(f"{self.base}/states/{content['state']}") if version else self.spark.createDataFrame([], LEDGER)

    def load(self) -> DataFrame:
        """The newest state."""
        return self._at()[1]

    def change(self, step: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
        """Take ``step`` (of a state and the number of the next) from the newest state, on whichever that is when nobody else was faster."""
        for _ in range(ATTEMPTS):
            version, state = self._at()
            name = uuid.uuid4().hex
            step(state, version + 1).write.parquet(f"{self.base}/states/{name}")
            if self.log.add(version + 1, {"state": name}):
                return self.spark.read.schema(LEDGER).parquet(f"{self.base}/states/{name}")
        raise Conflict(self.base)

    def extend(self, commits: DataFrame, records: DataFrame) -> DataFrame:
        """Add what has come since the items of the ledger, or all from the committed positions on."""
        return self.change(lambda state, _: state.unionByName(plan_items(commits, records, self.item, state)))

    def take(self, worker: str, now_ms: int, for_ms: int = 600_000, which: Column | None = None) -> DataFrame:
        """The items that ``worker`` holds: those of a lease it still has (a restart goes on with them), else the pending ones (of ``which``)."""
        mine = (F.col("state") == "leased") & (F.col("worker") == worker) & (F.col("lease_until_ms") > now_ms)
        held = self.load().where(mine)
        if held.take(1):
            return held
        return self.change(lambda state, n: lease(expire(state, now_ms), worker, now_ms, for_ms, which, f"lease{n:012d}-{uuid.uuid4().hex}")).where(mine)

    def process(self, held: DataFrame, records: DataFrame) -> None:
        """Write the rows of held items. The path is that of their lease, so doing it again replaces them."""
        if first := held.select("path").first():  # one lease, one path
            rows_of(held, records, self.item).write.mode("overwrite").parquet(f"{self.base}/results/{first[0]}")

    def finish(self, held: DataFrame, now_ms: int) -> DataFrame:
        """Mark held items done, as far as their leases still are those of the ledger."""
        return self.change(lambda state, _: complete(state, held.select(*ITEM, "worker", "token"), now_ms))

    def positions(self) -> DataFrame:
        """``next_offset`` of every reader: the first offset that isn't done, which it can commit."""
        open_ = F.min(F.when(F.col("state") != "done", F.col("from_offset")))
        return self.load().groupBy(*GTP).agg(F.coalesce(open_, F.max("to_offset") + 1).alias("next_offset"))

    def results(self) -> DataFrame:
        """Rows of the items that are done, written under the token that was accepted."""
        done = self.load().where("state = 'done'").select(*ITEM, "token", "path")
        out = f"{self.base}/results"
        paths = [f"{out}/{r['path']}" for r in done.select("path").distinct().toLocalIterator()]  # a name per lease
        if not paths:
            return self.spark.createDataFrame([], "group_id string, topic string, partition_id int, log_offset bigint")
        rows = self.spark.read.parquet(*paths).withColumn("path", F.element_at(F.split(F.input_file_name(), "/"), -2))
        return rows.join(done, [*ITEM, "token", "path"], "left_semi").select(*GTP, "log_offset")

    def run(self, commits: DataFrame, records: DataFrame, worker: str, now_ms: int, for_ms: int = 600_000) -> DataFrame:
        """Add what is new, take, process and finish what is pending. Returns the rows of this run: those of the items that it finished."""
        self.extend(commits, records)
        held = self.take(worker, now_ms, for_ms)
        self.process(held, records)
        state = self.finish(held, now_ms)
        done = state.where("state = 'done'").join(held.select(*ITEM, "token"), [*ITEM, "token"], "left_semi")
        first = held.select("path").first()
        if not first:
            return self.spark.createDataFrame([], "group_id string, topic string, partition_id int, log_offset bigint")
        return self.spark.read.parquet(f"{self.base}/results/{first[0]}").join(done, [*ITEM, "token"], "left_semi").select(*GTP, "log_offset")


def unprocessed(commits: DataFrame, records: DataFrame, worker: str = "run", now_ms: int = 0) -> DataFrame:
    """The records that a next run of each group still has to process, through a new ledger."""
    return Ledger(records.sparkSession).run(commits, records, worker, now_ms)
