"""Placement helpers shared by the operators: scratch tables, spreading, ordinals, size checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SMALL_ROWS = 1_000_000
SMALL_BYTES = 128 << 20
#: Bytes in memory for a stored byte, arrays and repeated words included.
STORED_FACTOR = 8
SPREAD_BYTES = 256 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only for a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="run-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage that outlives executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Stored bytes per file of a table that iterations read again and again; a smaller table has a
#: file per core, of CORE_BYTES at least.
FILE_BYTES, CORE_BYTES = 32 << 20, 1 << 20


def compact(stored: DataFrame) -> DataFrame:
    """A stored table in files of about FILE_BYTES, and enough of them for all cores: each job
    over it starts a task per file."""
    size, cores = leaf_bytes(stored) or 0, stored.sparkSession.sparkContext.defaultParallelism
    files = max(1, -(-size // FILE_BYTES), min(cores, size // CORE_BYTES))
    own = len(stored.inputFiles())
    if files <= own <= 2 * files:
        return stored
    return materialize(stored.coalesce(files) if own > files else stored.repartition(files), "compact")


def leaf_bytes(df: DataFrame) -> int | None:
    """Bytes of the tables below ``df`` as the planner knows them; None if one is unknown."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(size >= 1 << 60 for size in sizes) else sum(sizes)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash a small scan with too few splits over the cores.

    Only a table below SPREAD_BYTES is shuffled for it; a larger one is left to its splits,
    which ``spark.sql.files.maxPartitionBytes`` can make smaller.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = leaf_bytes(df)
    if size is None or size > SPREAD_BYTES or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


#: Bytes of the tables below rows of text, per task that works on the text.
TEXT_BYTES = 16 << 20


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows hashed into a task per core at least, and per TEXT_BYTES of what they are read from.

    For rows that are stored and whose text is then worked on: adaptive execution would join
    their partitions by size alone, and work on text takes a second per megabyte or more.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-(leaf_bytes(df) or 0) // TEXT_BYTES)), *keys)


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of literal rows whose size the planner knows (Arrow, not a Python RDD)."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    frame = pd.DataFrame(list(rows), columns=names)
    return spark.createDataFrame(frame, schema)


def small_side(df: DataFrame, rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> DataFrame:
    """Mark a dimension for broadcast once its rows and bytes are known to be few.

    A table of literal rows is judged by the planner's size. A derived one is run once, into
    a stored table that is both counted (from its footers) and used. A larger table comes
    back unmarked, and Spark joins it by a shuffle with adaptive skew handling.
    """
    leaves = df._jdf.queryExecution().optimizedPlan()
    if leaves.getClass().getSimpleName() == "LocalRelation":
        return F.broadcast(df) if leaf_bytes(df) <= max_bytes else df
    stored = materialize(df, "side")
    if stored.count() > rows or STORED_FACTOR * leaf_bytes(stored) > max_bytes:
        return stored
    return F.broadcast(stored)


def one_or_none(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` with a new column, without those where it is null.

    A test of a plain column would be pushed below it and make the value a second time.
    """
    made = rows.select("*", F.explode_outer(F.array(value)).alias(name))
    return made.where(F.col(name).isNotNull())


def split_repeated(df: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key stands once, and those of keys that repeat, None if there are none.

    What holds per key can be done inside the row for the first; only ids move to tell.
    """
    again = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_key"))
    again = materialize(again, "repeated")
    if again.isEmpty():
        return df, None
    side = small_side(again)
    same = F.col(key).eqNullSafe(F.col("_key"))
    return df.join(side, same, "left_anti"), df.join(side, same, "left_semi")


def number_rows(df: DataFrame, order: Sequence[Column], name: str, label: str = "numbered"):
    """Exact 1-based global row numbers without a single-task sort.

    Rows are range-partitioned and sorted in parallel, written once so that the
    partitions cannot change, then numbered by partition offset plus local index.
    """
    local = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33))
    )
    return _dense(materialize(local, label), name)


def _dense(stored: DataFrame, name: str, block: Sequence[str] = ("_part",)) -> DataFrame:
    offsets = (
        stored.groupBy(*block)
        .agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
        .withColumn(
            "_before",
            # one row per partition or file block
            F.coalesce(
                F.sum("_n").over(
                    Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_n")
    )
    return (
        stored.join(F.broadcast(offsets), list(block))
        .withColumn(name, F.col("_id") - F.col("_first") + F.col("_before") + 1)
        .drop("_id", "_first", "_before", *block)
    )


def shuffle_key(*cols: Column | str) -> Column:
    """A uniform, reproducible order key (32 hex digits) for seeded sampling and folds."""
    return F.md5(F.concat_ws(":", *cols))


def rank_in_groups(
    df: DataFrame, groups: Sequence[str], key: str, name: str, digits: int = 3
) -> DataFrame:
    """1-based rank by a uniform hex ``key`` within ``groups``, for groups of any size.

    A group is cut into ``16 ** digits`` slices by the leading digits of the key. The
    slices are ranked apart and shifted by the counts of the slices before them.
    """
    cut = df.withColumn("_slice", F.substring(key, 1, digits))
    before = Window.partitionBy(*groups).orderBy("_slice")
    offsets = (
        cut.groupBy(*groups, "_slice")
        .agg(F.count("*").alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .drop("_n")
    )
    within = Window.partitionBy(*groups, "_slice").orderBy(key)
    return (
        cut.withColumn("_rank", F.row_number().over(within))
        .join(offsets, [*groups, "_slice"])
        .withColumn(name, F.col("_rank") + F.col("_before"))
        .drop("_rank", "_before", "_slice")
    )
