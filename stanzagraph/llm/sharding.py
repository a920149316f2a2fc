"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stanzagraph.llm.common import pick, staged, with_bases

#: Points of each shard on the ring.
VIRTUAL_NODES = 128


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixer (the finalizer of splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ring(shards: int, virtual_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted points of the ring and the shard each belongs to."""
    shard, node = np.divmod(np.arange(shards * virtual_nodes, dtype=np.uint64), np.uint64(virtual_nodes))
    points = mix64(shard << np.uint64(32) | node)
    order = np.argsort(points, kind="stable")
    return points[order], shard[order].astype(np.int64)


def plan_loads(counts: np.ndarray, owner: np.ndarray, shards: int) -> np.ndarray:
    """Where the keys of each arc go when a shard holds no more than its share.

    ``counts``: keys by arc, clockwise. Shares are the mean rounded up for the first
    shards of the ring and down for the rest, so they add up to the keys. An arc's keys
    stay with its owner while that has room; the rest continue clockwise and enter the
    next shards that have room once their own arcs are in.

    Rows of the result: arc, first rank in the arc, shard, first slot in the shard.
    """
    total = int(counts.sum())
    met = list(dict.fromkeys(owner.tolist()))
    cap = np.full(shards, total // shards, np.int64)
    cap[met[: total % shards]] += 1
    load, rows, over = np.zeros(shards, np.int64), [], []
    for arc in np.flatnonzero(counts).tolist():
        s, n = owner[arc], int(counts[arc])
        stay = min(n, int(cap[s] - load[s]))
        if stay:
            rows.append((arc, 0, s, load[s]))
            load[s] += stay
        if n > stay:
            over.append((arc, stay, n))
    carried: list[tuple[int, int, int]] = []
    for arc in [*range(len(owner)), *range(len(owner))]:
        if over and over[0][0] == arc:
            carried.append(over.pop(0))
        s = owner[arc]
        while carried and load[s] < cap[s]:
            frm, rank, end = carried.pop(0)
            n = min(end - rank, int(cap[s] - load[s]))
            rows.append((frm, rank, s, load[s]))
            load[s] += n
            if rank + n < end:
                carried.insert(0, (frm, rank + n, end))
    return np.asarray(sorted(rows), np.int64).reshape(-1, 4)


def assign_shards(df: DataFrame, key: str, shards: int = 24, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """Add shard and slot to every row; shards' row counts differ by one at most.

    A row goes to the shard that owns the arc its key's hash falls in; what a full shard
    can't take continues clockwise. slot numbers a shard's rows from 0 without gaps. When
    a shard is added, a row moves only if its arc is split or its overflow shifts.

    The driver sees counts by arc (shards x virtual nodes) and plans ranks within arcs.
    Ranks follow the keys' hashes, then the rows' contents, so which rows of an arc overflow
    doesn't hang on the order of the input. Rows are dealt by ranges of these, with a salt
    behind them, and counted within tasks that are laid end to end, so a key or a row that a
    third of all rows repeat is never gathered.

    Null keys: all hash to one place, and overflow like a hot key. Ties (equal keys): by the
    other columns. Very long texts aren't looked at but for the tie. Repeated rows: each
    gets its own slot. Empty table: no rows. Input columns called shard or slot are
    replaced; other columns are kept, also those that share the helper columns' names.
    """
    names = [c for c in df.columns if c not in ("shard", "slot")]
    points, owner = ring(shards, virtual_nodes)
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[F.col(f"c{df.columns.index(c)}") for c in names])
    at = F.xxhash64(F.col(f"c{df.columns.index(key)}"))
    inner = flat.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(len(points), np.int64)
        for batch in batches:
            hashed = mix64(batch.column(batch.num_columns - 1).to_numpy().view(np.uint64))
            arc = np.searchsorted(points, hashed, "left") % len(points)
            order = np.argsort(arc, kind="stable")
            runs = np.r_[0, np.flatnonzero(np.diff(arc[order])) + 1] if len(arc) else np.zeros(0, np.int64)
            rank = np.empty(len(arc), np.int64)
            sizes = np.diff(np.r_[runs, len(arc)])
            rank[order] = np.arange(len(arc)) - np.repeat(runs, sizes) + seen[arc[order]]
            seen[arc[order[runs]]] += sizes
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(arc.astype(np.int32)), pa.array(np.full(len(arc), part, np.int32)), pa.array(rank)], names=[*inner, "arc", "part", "local_rank"])

    from pyspark.sql import types as T

    spread = flat.withColumn("at", at).withColumn("tie", F.xxhash64(*[F.col(c) for c in inner])).withColumn("salt", F.monotonically_increasing_id())
    keys = ["at", "tie", "salt"]
    dealt = spread.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys).drop("tie", "salt")
    extra = [T.StructField("arc", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("local_rank", T.LongType())]
    rows = staged(dealt.mapInArrow(number, T.StructType([*flat.schema.fields, *extra])), "arcs")
    counts = np.zeros(len(points), np.int64)
    for r in rows.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["arc"]] = r["n"]
    plan = plan_loads(counts, owner, shards)
    far = np.int64(1) << 44
    starts = plan[:, 0] * far + plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arc, rank = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("arc", "rank"))
            _, first, shard, slot = plan[np.searchsorted(starts, arc * far + rank, "right") - 1].T
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(shard.astype(np.int32)), pa.array(slot + rank - first)], names=[*inner, "shard", "slot"])

    ranked = with_bases(rows, "arc", "part", "local_rank", "rank").select(*inner, "arc", "rank")
    out = ranked.mapInArrow(place, T.StructType([*flat.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]))
    return out.toDF(*names, "shard", "slot")


def op4_consistent_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text")
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = assign_shards(rows, "doc_id", 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
