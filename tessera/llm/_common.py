"""What the operators share: reading tables, Arrow maps and tables in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessera.session import shared_dir, ship

#: Characters that part words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow with the package on the executors; a worker gives back what it doesn't use after each task.
    Batches are bounded in bytes (see ship())."""
    ship(df.sparkSession)

    def run(batches):
        yield from fn(batches)
        given_back()

    return df.mapInArrow(run, schema)


def given_back() -> None:
    """Returns this process's free memory to the system: Python workers wait for other tasks, and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of glibc only
        ctypes.CDLL(None).malloc_trim(0)


def integer_id(df: DataFrame, column: str) -> Column:
    """The column as bigint; one of another kind is refused here, before a cast could turn its values into nulls."""
    kind = df.schema[column].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{column} must hold integers, not {kind.simpleString()}")
    return df[column].cast("bigint")


#: Frees the shuffle files of a written table at once; they aren't needed again, as it is read from its files.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as Parquet in the shared folder and read back: cuts the lineage for good."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before) if before is not None else spark.conf.unset(_CLEAN_UP)
    found = spark.read.schema(df.schema).parquet(path)
    found.tessera_path = path
    return found


def removed(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once all that is read from them is written in turn."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.tessera_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Places of a bitmap that is collected and broadcast: 8 MB, whatever the input's size.
BITMAP_PLACES = 1 << 26


def bitmap(hashes: DataFrame) -> bytes:
    """A bitmap of the 64-bit hashes in the only column; may_hold() is true for each of them, and for few others."""
    place = hashes.select((F.col(hashes.columns[0]).bitwiseAND(BITMAP_PLACES - 1) + 1).alias("place"))  # from 1, as Spark's positions
    words = place.groupBy(F.bitmap_bucket_number("place").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros(BITMAP_PLACES // 8 + 8192, np.uint8)
    for r in words.collect():  # BITMAP_PLACES / 32768 rows of 4 kB at most
        at = (r.k - 1) * len(r.bits)
        out[max(0, at) : at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)[max(0, -at) :]
    return out.tobytes()


def may_hold(bits: bytes, value: int) -> int:
    """Whether the bitmap has the place of a hash."""
    at = value & (BITMAP_PLACES - 1)
    return bits[at >> 3] >> (at & 7) & 1


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4_000_000) -> Iterator[tuple[int, list]]:
    """Slices of a batch with about `limit` bytes of text each, whole rows: (first row, values)."""
    col = batch.column(column)
    first, held, out = 0, 0, []
    for i in range(len(col)):
        value = col[i].as_py()
        out.append(value)
        held += len(value) if value else 0
        if held >= limit:
            yield first, out
            first, held, out = i + 1, 0, []
    if out:
        yield first, out
