"""What the operators of this folder share: input columns, task helpers, sizes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodmill.runtime import materialize

#: Text handed to one numpy or regex pass; bounds what a task holds beside its Arrow batch.
CHUNK_BYTES = 1 << 20

#: Largest key set that is broadcast, counted before it is.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as the empty one: other columns cannot clash."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables below ``df``, by file sizes; no job runs. What has no known size
    (rows of the driver) counts as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(size for size in sizes if size < 1 << 60)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``materialize``, after letting go of the shuffle files of finished steps."""
    let_go(df.sparkSession)
    return materialize(df, label)


def let_go(spark: SparkSession) -> None:
    """Spark drops finished shuffles when the driver collects its garbage, which a driver
    with little to do may not do for hours."""
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads; part of a table is the whole table."""
    for df in tables:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


def pieces(batches: Iterator[pd.DataFrame], column: str, most: int = CHUNK_BYTES):
    """Cut Arrow batches into runs of rows of about ``most`` characters, at least one row each."""
    for batch in batches:
        start, held = 0, 0
        for i, size in enumerate(batch[column].str.len()):
            if held and held + size > most:
                yield batch.iloc[start:i]
                start, held = i, 0
            held += int(size)
        if start < len(batch):
            yield batch.iloc[start:]


def placed(df: DataFrame, key_rows: int) -> DataFrame:
    """Broadcast ``df`` if the counted ``key_rows`` are few, else leave the choice to Spark."""
    return F.broadcast(df) if key_rows <= BROADCAST_ROWS else df
