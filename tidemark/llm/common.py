"""What the corpus operators share: shared-folder tables, batch settings, column helpers and joins with hot keys."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ship_package

#: Rows and bytes per Arrow batch that Python workers receive: whichever is reached first ends a batch.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20
#: Groups that hold at least 1/HOT_SHARE of all rows are joined by broadcast: there can be no more than HOT_SHARE of them.
HOT_SHARE = 1 << 12
#: Bytes of a row group of work tables.
ROW_GROUP_BYTES = 16 << 20
#: Bytes of a table up to which it is broadcast where its rows and their width are known.
BROADCAST_BYTES = 32 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package and bound Arrow batches by rows and bytes, so that a Python worker's memory is bounded.

    The two settings belong to the session: they stay as they are where they are smaller already.
    """
    ship_package(spark)
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(str(spark.conf.get(key)).rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


_recorders: list[list[str]] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """A list of the shared folders that are made in this context, for who knows when they are no longer read."""
    made: list[str] = []
    _recorders.append(made)
    try:
        yield made
    finally:
        _recorders.remove(made)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share, as a path with its scheme.

    Only a local session may do without the setting (as in tests): it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = qualified(spark, f"{base.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}")
    for made in _recorders:
        made.append(path)
    return path


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority as Spark itself resolves it, so that Python workers open the same file system."""
    at, system = _hadoop(spark, path)
    return system.makeQualified(at).toString()


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder that no plan reads any more."""
    at, system = _hadoop(spark, path)
    system.delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)  # what a writing task holds in memory
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_name(name: str, *frames: DataFrame) -> str:
    """name, lengthened until no frame has a column of that name (case doesn't tell columns apart)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def joined_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, spread: str, hot_share: int = HOT_SHARE) -> DataFrame:
    """rows left-joined with groups (one row for each combination of keys), however many rows one group has.

    size names the column of groups that counts a group's rows, total the count of all. Groups of at least 1/hot_share of all
    rows, at most hot_share of them, are broadcast; their rows are then dealt out by `spread` and join nothing else.
    """
    values = [c for c in groups.columns if c not in keys]
    held, salt = free_name("__held", rows, groups), free_name("__salt", rows, groups)
    packed = groups.select(*keys, F.struct(*values).alias(held), F.col(size).alias(f"{held}n"))
    large = F.col(f"{held}n") * F.lit(hot_share) >= F.lit(total)
    hot = packed.filter(large).select(*keys, held)
    # Zero, but no constant: of a constant the optimizer would take the salt out of the join's keys.
    cold = packed.filter(~large).select(*keys, F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int").alias(salt), F.col(held).alias(f"{held}c"))
    met = rows.join(F.broadcast(hot), keys, "left")
    met = met.withColumn(salt, F.when(F.col(held).isNotNull(), 1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int")).otherwise(0))
    met = met.join(cold, [*keys, salt], "left")
    return met.select(*rows.columns, *(F.coalesce(f"{held}.{v}", f"{held}c.{v}").alias(v) for v in values))


def tidied(df: DataFrame, name: str) -> DataFrame:
    """written(), then let Spark's cleaner drop the shuffle files that only the written table's plan needed.

    Shuffle files go when their plan is collected as garbage; without a collection now, an iteration's would all stay until it ends.
    """
    out = written(df, name)
    del df
    released(out.sparkSession)
    return out


def released(spark: SparkSession) -> None:
    """Collect the driver's garbage, plans first, and give what its allocators hold back to the system.

    glibc keeps freed blocks: after a fit some 70 MB of the driver's Python process.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)
