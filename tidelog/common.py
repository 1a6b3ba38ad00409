"""Session, table and shared-folder helpers used by every operator."""

from __future__ import annotations

import json
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Offsets of one ordered chunk. Every ordered pass works on chunks of at most this many offsets of one partition, never on a
#: whole partition, and joins the chunks by their boundary states.
CHUNK_OFFSETS = 65_536

#: A set of keys each holding more than 1/HOT_KEYS of all rows has fewer than HOT_KEYS members: the bound on what is broadcast.
HOT_KEYS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's Python files to the executors, once per application, so that their workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tidelog-")) / "tidelog.zip"  # on the driver, which serves it to the executors
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


_owned: set[str] = set()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that every executor reaches, for what one application needs; it is deleted when the application's JVM ends in order.

    It lies under ``spark.checkpoint.dir``. Where that is unset, a folder in /tmp serves local sessions only; on a
    cluster the setting is required, as a machine's own folder is lost with the machine. What is to outlive the application
    (a ledger, an index, a table of changes) gets a folder of the caller's.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = "file:///tmp/tidelog-shared"
    own = f"{base.rstrip('/')}/tidelog/{spark.sparkContext.applicationId}"
    if own not in _owned:
        fs, path = _file_system(spark, own)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _owned.add(own)
    return f"{own}/{purpose}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def arrow_fs(path: str):
    """The file system of a path for use within tasks, and the path in it: those that both Spark and Arrow reach (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if "://" in path else f"file://{path.removeprefix('file:')}")


def put_file(path: str, data: bytes) -> None:
    """Write a file within a task: aside, then renamed over what a former attempt may have left."""
    system, at = arrow_fs(path)
    folder, _, name = at.rpartition("/")
    system.create_dir(folder)
    aside = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as f:
        f.write(data)
    system.move(aside, at)


def listing(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none where it doesn't exist."""
    fs, at = _file_system(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _file_system(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _file_system(spark, path)
    stream = fs.create(at, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Make the small file ``path`` with ``text``, whole or not at all, unless there is one: whether it was this call that made it.

    The text is written aside and renamed without overwriting, so of several writers one wins and a reader never sees half a file.
    """
    folder, _, name = path.rpartition("/")
    aside = f"{folder}/.{name}-{uuid.uuid4().hex}"
    write_text(spark, aside, text)
    jvm, fs = spark._jvm, _file_system(spark, folder)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs[0].getUri(), spark._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(_file_system(spark, aside)[1], _file_system(spark, path)[1], never)
    except Py4JJavaError as e:
        fs[0].delete(_file_system(spark, aside)[1], False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise
    return True


class Manifest:
    """Numbered versions of a small list in ``folder``: each is written whole, and the next number goes to one writer only."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def versions(self) -> list[int]:
        return [int(n[1:]) for n in listing(self.spark, self.folder) if n[0] == "v" and n[1:].isdigit()]

    def read(self, before: int | None = None) -> tuple[int, dict]:
        """Number and content of the newest version (below ``before``); 0 and nothing where there is none."""
        there = [v for v in self.versions() if before is None or v < before]
        return (there[-1], json.loads(read_text(self.spark, f"{self.folder}/v{there[-1]:012d}"))) if there else (0, {})

    def add(self, version: int, content: dict) -> bool:
        """Make version ``version``; False where another writer was first."""
        return publish(self.spark, f"{self.folder}/v{version:012d}", json.dumps(content))


def materialize(df: DataFrame, purpose: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, purpose)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work that takes long per row; a table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *by)


def chunked_running_max(df: DataFrame, group: list[str], order: str, value: str, out: str, chunk: int = CHUNK_OFFSETS) -> DataFrame:
    """Greatest ``value`` over the rows of the same ``group`` with a smaller ``order``; null where there is none.

    ``order`` is a non-negative bigint, unique in its group. A group is cut into chunks of ``chunk`` order values, so
    a group holding most rows is still spread over all tasks; a second pass over one row per chunk carries
    the maxima forward.
    """
    from pyspark.sql import Window as W

    cut = df.withColumn("__chunk", F.floor(F.col(order) / chunk))
    keys = [*group, "__chunk"]
    inside = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    carried = W.partitionBy(*group).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    heads = cut.groupBy(*keys).agg(F.max(value).alias("__max")).withColumn("__carry", F.max("__max").over(carried)).drop("__max")
    return (
        cut.withColumn("__inside", F.max(value).over(inside))
        .join(heads, keys, "left")
        .withColumn(out, F.greatest("__inside", "__carry"))
        .drop("__inside", "__carry", "__chunk")
    )


def chunked_running_sum(df: DataFrame, group: list[str], order: str, value: str, out: str, chunk: int = CHUNK_OFFSETS) -> DataFrame:
    """Sum of ``value`` over the rows of the same ``group`` with a smaller ``order`` (0 at the first), taken in chunks like the running maximum."""
    from pyspark.sql import Window as W

    cut = df.withColumn("__chunk", F.floor(F.col(order) / chunk))
    keys = [*group, "__chunk"]
    inside = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    carried = W.partitionBy(*group).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    heads = cut.groupBy(*keys).agg(F.sum(value).alias("__sum")).withColumn("__carry", F.coalesce(F.sum("__sum").over(carried), F.lit(0))).drop("__sum")
    return (
        cut.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(heads, keys)
        .withColumn(out, F.col("__inside") + F.col("__carry"))
        .drop("__inside", "__carry", "__chunk")
    )


def chunked_lag(df: DataFrame, group: list[str], order: str, value: Column, out: str, chunk: int = CHUNK_OFFSETS) -> DataFrame:
    """``value`` of the row before in the order of its ``group``; null at the first. Taken in chunks like the running maximum."""
    from pyspark.sql import Window as W

    cut = df.withColumns({"__chunk": F.floor(F.col(order) / chunk), "__value": value})
    keys = [*group, "__chunk"]
    carried = W.partitionBy(*group).orderBy("__chunk")
    heads = cut.groupBy(*keys).agg(F.max_by("__value", order).alias("__last")).withColumn("__carry", F.lag("__last").over(carried)).drop("__last")
    inside = W.partitionBy(*keys).orderBy(order)
    lagged = cut.withColumns({"__before": F.lag("__value").over(inside), "__nth": F.row_number().over(inside)})
    return lagged.join(heads, keys).withColumn(out, F.when(F.col("__nth") == 1, F.col("__carry")).otherwise(F.col("__before"))).drop("__before", "__nth", "__carry", "__chunk", "__value")


def asof(points: DataFrame, at: str, rows: DataFrame, order: str, by: list[str], payload: list[str], chunk: int = CHUNK_OFFSETS) -> DataFrame:
    """Each point with the ``payload`` of the row of the same ``by`` that has the greatest ``order`` <= ``at``; null where there is none.

    One union and sort, without a range join; groups are cut into chunks of ``order`` and the last row of each is carried forward.
    """
    from pyspark.sql import Window as W

    row_type = rows.select(F.struct(F.col(order).cast("bigint").alias("o"), *payload)).schema[0].dataType
    point_type = points.select(F.struct(*points.columns)).schema[0].dataType
    left = points.select(*by, F.col(at).cast("bigint").alias("__o"), F.lit(None).cast(row_type).alias("__row"), F.struct(*points.columns).alias("__point"))
    right = rows.select(*by, F.col(order).cast("bigint").alias("__o"), F.struct(F.col(order).cast("bigint").alias("o"), *payload).alias("__row"), F.lit(None).cast(point_type).alias("__point"))
    both = left.unionByName(right).withColumn("__chunk", F.floor(F.col("__o") / chunk))
    keys = [*by, "__chunk"]
    inside = W.partitionBy(*keys).orderBy("__o").rangeBetween(W.unboundedPreceding, W.currentRow)
    carried = W.partitionBy(*by).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    heads = both.groupBy(*keys).agg(F.max("__row").alias("__last")).withColumn("__carry", F.max("__last").over(carried)).drop("__last")
    found = both.withColumn("__found", F.max("__row").over(inside)).join(heads, keys, "left").where("__point is not null")
    return found.withColumn("__found", F.coalesce("__found", "__carry")).select("__point.*", *[F.col(f"__found.{c}").alias(c) for c in payload])
