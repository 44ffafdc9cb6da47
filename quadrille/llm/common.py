"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts name it: [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, a folder in the warehouse,
    which they share too, or with a local master, where there is but one machine, a new temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    set_by = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_by.isDefined():
        return set_by.get()
    if spark.sparkContext.master.startswith(("local[", "local")) and not spark.sparkContext.master.startswith("local-cluster"):
        return f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its lineage, in the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def swept(spark: SparkSession) -> None:
    """Lets Spark's cleaner find, by a collection of the driver's garbage, the shuffles and checkpoints that nothing holds
    any more; between rounds of a loop, as their files would otherwise stay until the driver's memory is short."""
    spark.sparkContext._jvm.System.gc()


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back; columnar, so smaller than a checkpoint."""
    spark = df.sparkSession
    path = path or new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """At least as many partitions as cores, for Python work on inputs that Spark reads as a few large splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_column).cast("string")) % modulus


def remainder_of(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


class HashIndex:
    """Places of different unsigned 64-bit keys, looked up many at once in an open-addressed table; -1 for others.

    The largest such number marks free slots and is no key.
    """

    FREE = np.uint64(2**64 - 1)

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, len(keys).bit_length() + 1)
        self.keys = np.full(1 << self.bits, self.FREE, dtype=np.uint64)
        self.places = np.full(1 << self.bits, -1, dtype=np.int32)
        places, at = np.arange(len(keys), dtype=np.int32), self._slots(keys)
        while len(keys):
            slot, first = np.unique(at, return_index=True)
            first = first[self.keys[slot] == self.FREE]
            self.keys[at[first]], self.places[at[first]] = keys[first], places[first]
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            keys, places, at = keys[rest], places[rest], self._next(at[rest])

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slots(keys)
        held = self.keys[at]
        open_ = np.flatnonzero((held != keys) & (held != self.FREE))
        while len(open_):
            at[open_] = self._next(at[open_])
            held = self.keys[at[open_]]
            open_ = open_[(held != keys[open_]) & (held != self.FREE)]
        return self.places[at]  # -1 at a free slot
