"""What the training-data operators share: reading, scratch tables, text bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch of texts, which may be very long, and of a few numbers.
TEXT_ROWS, NARROW_ROWS = 500, 20_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is named and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/brevis-scratch"


def written(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """df, stored as Parquet in the shared folder, in a folder per value of `by`, and read again: lineage ends here, and a lost executor loses nothing."""
    path = f"{scratch_root(df.sparkSession)}/brevis/{tag}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = TEXT_ROWS) -> DataFrame:
    """mapInArrow over batches of at most `rows` rows.

    The session's limits are the same whichever operator sets them, so that a plan
    doesn't depend on what was built after it; shorter batches are slices.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", NARROW_ROWS)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)
    return df.mapInArrow(lambda batches: f(_sliced(batches, rows)), schema)


#: A key with more than a thousandth of all rows is hot; there are less than a thousand of them.
HOT_SHARE = 1000


def met(big: DataFrame, small: DataFrame, key: str, n: str = "n", total: int | None = None) -> DataFrame:
    """big joined with small on key, where small is a written table of one row per key and n counts big's rows of the key.

    Rows of a hot key stay where they are, and its one row of small is broadcast:
    less than HOT_SHARE rows, whatever the size. All others meet in a shuffle in
    which no key has more than a thousandth of the rows. Null keys meet nothing.
    """
    if total is None:
        total = small.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) * HOT_SHARE > F.lit(total)
    hot = small.filter(is_hot).drop(n)
    if hot.isEmpty():
        return big.join(small.drop(n), key)
    cold = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(small.filter(~is_hot).drop(n), key)
    return big.join(F.broadcast(hot), key).unionByName(cold)


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the key written as text, modulo n; null where the key is null."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)
