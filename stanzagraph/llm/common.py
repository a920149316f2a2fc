"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with only the columns ``out=source``, matched by exact name.

    Extra columns are ignored, also those whose names differ from a wanted one
    only by case or that occur twice (the first is taken).
    """
    first = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    missing = [source for source in columns.values() if source not in first]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"c{first[source]}").alias(out) for out, source in columns.items()])


def per_process(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` made when this process first asked for ``key``: Python workers run many tasks.

    Until another operator's task runs there: see give_back().
    """
    kept = sys.__dict__.setdefault("_stanzagraph_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


#: Rows and bytes of text that a worker turns into Python objects at once.
SLICE_ROWS, SLICE_BYTES = 1000, 4 << 20


def slices(batches: Iterator[pa.RecordBatch], text: int, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows and, beyond one row, about ``size`` bytes of column ``text``."""
    for batch in batches:
        at, column = 0, batch.column(text)
        lengths = [0 if n is None else n for n in pa.compute.binary_length(column).to_pylist()]
        while at < batch.num_rows:
            end, held = at, 0
            while end < batch.num_rows and end - at < rows and (end == at or held + lengths[end] <= size):
                held += lengths[end]
                end += 1
            yield batch.slice(at, end - at)
            at = end


def give_back(keep: bool = False) -> None:
    """Return freed memory to the system: idle Python workers live on beside those of the next stage.

    Without ``keep``, what per_process() made for another operator's tasks is freed as well.
    """
    if not keep:
        sys.__dict__.get("_stanzagraph_kept", {}).clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


class Bounded(dict):
    """Values by short keys, in at most ``most`` bytes of both with what Python needs for them.

    Full, it takes no more, for what is met first is met most; but if four times as many
    keys as it holds weren't there since, it starts anew.
    """

    #: Longer keys are seldom met again, and aren't kept.
    LONGEST = 64
    #: What an entry takes besides its key and value: two objects' heads and a place in the table.
    ENTRY = 200

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held, self.missed = most, 0, 0

    def keep(self, key: str | bytes, value: Any, size: int = 0) -> None:
        if len(key) > self.LONGEST:
            return
        size += len(key) + self.ENTRY
        if self.held + size <= self.most:
            self.held += size
            self[key] = value
            return
        self.missed += 1
        if self.missed > 4 * len(self):
            self.clear()
            self.held = self.missed = 0


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; a cluster must set it.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="stanzagraph-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Folders of staged tables, in the order they were written.
STAGED: list[str] = []


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables that nothing will read again."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        at = path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        STAGED.remove(p)


def reads(df: DataFrame) -> str:
    """The folders that ``df`` is read from, as one text."""
    leaves, found = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            found.append(leaf.relation().location().rootPaths().toString())
    return " ".join(found)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    Lineage ends there: a lost executor costs no recomputation before this point, and
    what depends on partitions or their order is fixed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Shuffle partitions that hold ``rows_each`` rows, never fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def with_bases(rows: DataFrame, key: str, part: str, local: str, rank: str) -> DataFrame:
    """Turn ranks within (part, key) into ranks within ``key``.

    Each task numbers its rows of a key from 0; here a key's parts are laid end to end.
    Only counts per (key, part) are ordered together, so a key that holds a third of
    all rows is never gathered in one task.
    """
    from pyspark.sql import Window

    counts = rows.groupBy(key, part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(key, part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return rows.join(bases, [key, part]).withColumn(rank, F.col("__base") + F.col(local)).drop("__base")


#: Copies of a small side's rows, so that a key with a third of all rows joins in as many tasks.
SALTS = 16


def salted_join(big: DataFrame, small: DataFrame, key: str, spread: list[str]) -> DataFrame:
    """``big`` left-joined with ``small`` (one row a key), a key's rows dealt over SALTS tasks by ``spread``.

    Null keys join null keys.
    """
    copies = small.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed(key, "__k")
    dealt = big.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    joined = dealt.join(copies, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__salt") == F.col("__s")), "left")
    return joined.drop("__s", "__k", "__salt")
