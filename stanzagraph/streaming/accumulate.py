"""Accumulation of a stream of rows, with the results of a batch whatever its chunks."""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stanzagraph.functions.columns import code_value, label, ordered_code_value, quoted, upper_triangle, weighted
from stanzagraph.functions.kernel import expand, ordered_row_cells, stanza_cells
from stanzagraph.operators.accumulate import counted, ordering, unit_metadata, used
from stanzagraph.spec import AccumulateSpec


#: Parts of all conversations whose states are kept together; fixed, since states are found by them.
BUCKETS = 1024
#: Rows whose cells are made at once.
ROWS = 20_000


def _coded(rows: DataFrame, spec: AccumulateSpec) -> tuple[DataFrame, list[str]]:
    """The columns of ``rows`` that are needed, ENA_UNIT, and the codes as __c0, __c1 and so on."""
    spec.check(rows)
    kinds = dict(rows.dtypes)
    value = code_value if spec.network == "standard" else ordered_code_value
    keep = list(dict.fromkeys([*spec.units, *spec.conversation, *spec.order_by, *spec.metadata]))
    named = rows.select(*[quoted(c) for c in keep], label(spec.units, kinds).alias("ENA_UNIT"), *[value(c, kinds[c]).alias(f"__c{i}") for i, c in enumerate(spec.codes)])
    return named, keep


def stream_rows(rows: DataFrame, spec: AccumulateSpec) -> DataFrame:
    """Cells of a stream's rows in moving windows, conversation by conversation.

    Conversations are dealt to BUCKETS by hash and a bucket's go through the windows together,
    in blocks, so that a call is paid for many conversations and a long one costs the memory
    of its rows, not of their cells. State holds the rows that windows still reach, at least a
    conversation's last, which has its last order key; where ``back`` has no bound a sum takes
    the place of earlier rows, where ``forward`` has none all rows stay.
    A row whose forward rows haven't all come is given with what there is and given again
    with a higher __version; its last version counts, so a stream that ends needs no flush.
    Micro-batches are sorted by the order key. A row that isn't behind all earlier ones of
    its conversation is late: it changes no cell, and __late tells at once, in a row of its
    own, how many there were. Null order keys come first.
    """
    named, keep = _coded(rows, spec)
    kinds = dict(rows.dtypes)
    edges, conversation, order = spec.edges(), list(spec.conversation), list(spec.order_by)
    cells, codes = [f"__cell{k}" for k in range(len(edges))], [f"__c{i}" for i in range(len(spec.codes))]
    kept = [f for f in named.schema if f.name in keep]
    # pandas would make doubles of whole numbers beside nulls, so nulls are told by a column of their own
    nulls = {f.name: f"__null{i}" for i, f in enumerate(kept) if isinstance(f.dataType, T.LongType)}
    out = T.StructType([*kept, *[T.StructField(c, T.BooleanType()) for c in nulls.values()], *[T.StructField(c, T.DoubleType()) for c in cells], T.StructField("__version", T.LongType()), T.StructField("__late", T.LongType())])
    shown = [f.name for f in out]
    back, forward, ordered = spec.back, spec.forward, spec.network == "ordered"
    most = None if forward is None else max(1, forward + (max(back, 1) - 1 if back is not None else 0))  # rows of a conversation that stay

    def made(c: np.ndarray, run: np.ndarray, carry: list | None = None) -> np.ndarray:
        if ordered:
            return ordered_row_cells(c, run, edges, back, carry)
        return stanza_cells(c, run, edges, back, forward, None if carry is None else np.asarray([math.fsum(x) for x in carry]))

    def blocks(c: np.ndarray, run: np.ndarray, carries: dict, names: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """The cells of all rows, in turn, with where they begin and end."""
        n = len(c)
        if back is None:  # each conversation has its own sum before it
            ends = np.flatnonzero(np.r_[run[1:] != run[:-1], True]) + 1
            for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                yield lo, hi, made(c[lo:hi], run[lo:hi], carries.get(names[lo]))
        elif forward is None:
            yield 0, n, made(c, run)
        else:
            for lo in range(0, n, ROWS):
                hi, begin = min(n, lo + ROWS), max(0, lo - max(back, 1) + 1)
                end = min(n, hi + forward + 1)
                yield lo, hi, made(c[begin:end], run[begin:end])[lo - begin : hi - begin]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, version, carries = pickle.loads(state.get[0]) if state.exists else (None, 0, {})
        both = list(parts)
        rows = pd.concat(both if held is None else [held, *both], ignore_index=True)
        del both
        old, version = 0 if held is None else len(held), version + 1
        conv = pd.factorize(rows["__conv"])[0]
        # sorted by conversation and order key, with earlier rows first among equals; null keys are -1
        ranks = [r for c in order for r in ([~rows[nulls[c]].to_numpy(bool)] if c in nulls else []) + [pd.factorize(rows[c], sort=True)[0]]]
        by = np.lexsort((np.arange(len(rows)), *ranks[::-1], conv))
        new = by >= old
        same = np.ones(len(by), bool)
        same[:1] = False
        for r in (conv, *ranks):
            same[1:] &= r[by][1:] == r[by][:-1]
        # late: not behind the conversation's held rows, or equal to the row before
        group = conv[by]
        last_held = np.full(conv.max() + 1, -1)
        np.maximum.at(last_held, group[~new], np.flatnonzero(~new))
        late = new & (same | (np.arange(len(by)) < last_held[group]))
        rows = rows.iloc[by]
        missed = np.bincount(group[late], minlength=len(last_held))
        told_late = np.zeros(len(last_held), np.int64)
        np.maximum.at(told_late, group[~new], rows["__late"].to_numpy()[~new].astype(np.int64))
        told_late += missed
        if late.any():
            first = np.unique(group[late], return_index=True)[1]
            marks = rows[late].iloc[first][[*conversation, *nulls.values()]].assign(__version=-1, __late=told_late[group[late][first]])
            blank = [c for c in nulls if c not in conversation]
            yield marks.assign(**{nulls[c]: True for c in blank}).reindex(columns=shown).fillna({c: 0 for c in blank})
        rows, new, group = rows[~late].reset_index(drop=True), new[~late], group[~late]
        rows["__late"] = told_late[group]
        n, size = len(rows), np.bincount(group, minlength=len(last_held))
        fresh = np.bincount(group[new], minlength=len(last_held))
        left = np.cumsum(size)[group] - 1 - np.arange(n)  # rows of the conversation behind each
        waits = left - fresh[group] < (n if forward is None else forward)
        give = (fresh[group] > 0) & (new | waits)
        c, names = rows[codes].to_numpy(float), rows["__conv"].to_numpy()
        plain = rows[[*(f.name for f in kept), *nulls.values()]]
        for lo, hi, x in blocks(c, group, carries, names):
            of = np.flatnonzero(give[lo:hi])
            for a in range(0, len(of), ROWS):
                some = of[a : a + ROWS]
                told = plain.iloc[lo + some].reset_index(drop=True)
                told = pd.concat([told, pd.DataFrame(x[some], columns=cells)], axis=1)
                yield told.assign(__version=version, __late=told_late[group[lo + some]])
        stay = np.ones(n, bool) if most is None else left < most
        if back is None and most is not None:
            for i in np.flatnonzero(~stay).tolist():
                carry = carries.setdefault(names[i], [[] for _ in codes])
                for s, v in zip(carry, c[i].tolist(), strict=True):
                    expand(s, v) if ordered else s.__setitem__(slice(None), [(s[0] if s else 0.0) + v])
        state.update((pickle.dumps((rows[stay].reset_index(drop=True), version, carries)),))

    dealt = named.drop("ENA_UNIT").withColumns({"__conv": _key(conversation, kinds), "__late": F.lit(0).cast("long")})
    dealt = dealt.withColumns({flag: quoted(c).isNull() for c, flag in nulls.items()})
    dealt = dealt.withColumns({c: F.coalesce(quoted(c), F.lit(0).cast("long")) for c in nulls} | {"__bucket": F.pmod(F.xxhash64("__conv"), F.lit(BUCKETS))})
    result = dealt.groupBy("__bucket").applyInPandasWithState(run, out, T.StructType([T.StructField("kept", T.BinaryType())]), "append", GroupStateTimeout.NoTimeout)
    final = [weighted(F.col(c), f, spec.weighting).alias(e.name) for c, f, e in zip(cells, spec.factors(), edges, strict=True)]
    result = result.withColumns({c: F.when(~F.col(flag), quoted(c)) for c, flag in nulls.items()})
    return result.select(*[quoted(f.name) for f in kept], label(spec.units, kinds).alias("ENA_UNIT"), "__version", "__late", *final)


def _key(names: list[str], kinds: dict[str, str]) -> Column:
    """One text for equal keys: columns' texts with their lengths, so that none run together; null is a text of its own."""
    def text(name: str) -> Column:
        c = quoted(name)
        if kinds[name] in ("double", "float"):
            c = c + F.lit(0.0).cast(kinds[name])  # no negative zero
        elif kinds[name].startswith("timestamp"):
            c = F.unix_micros(c) if kinds[name] == "timestamp" else c
        elif kinds[name] == "binary":
            c = F.hex(c)
        s = c.cast("string")
        return F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.concat(*[text(n) for n in names])


class AccumulationStream:
    """A stream into a folder of cells, and counts from it at any time.

    start() runs until the source has no more (``available_now``) or until stop(). After a
    restart with the same folder the stream goes on from its checkpoint; versions make rows
    that are written twice count once. Conversation windows need no state: the stream keeps
    the rows' codes, and they are summed when they are asked for.

    Results are those of a batch, for all models; rows that came late make asking for them an
    error, unless ``allow_late``.
    """

    def __init__(self, rows: DataFrame, spec: AccumulateSpec, folder: str, allow_late: bool = False):
        self.rows, self.spec, self.folder, self.allow_late = rows, spec, folder.rstrip("/"), allow_late
        self.moving = spec.window == "MovingStanzaWindow"
        self.cells = stream_rows(rows, spec) if self.moving else _coded(rows, spec)[0]
        self.query = None

    def start(self, available_now: bool = True) -> AccumulationStream:
        writer = self.cells.writeStream.format("parquet").outputMode("append").option("path", f"{self.folder}/cells").option("checkpointLocation", f"{self.folder}/checkpoint")
        self.query = (writer.trigger(availableNow=True) if available_now else writer).start()
        return self

    def finish(self) -> DataFrame:
        """Wait for the end of the source; counts as the model has them."""
        self.query.awaitTermination()
        return self.counts()

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()

    @property
    def progress(self) -> Iterable[dict]:
        return [] if self.query is None else self.query.recentProgress

    def _stored(self) -> DataFrame:
        """Every row once, in its last version."""
        spec = self.spec
        rows = self.rows.sparkSession.read.schema(self.cells.schema).parquet(f"{self.folder}/cells")
        if not self.moving:
            return rows.withColumn("__order", ordering(spec))
        if not self.allow_late:
            late = rows.filter("__version = -1").agg(F.sum(F.lit(1)), F.max("__late")).first()
            if late[0]:
                raise ValueError(f"rows came behind later ones of their conversation (up to {late[1]} in one)")
        keys = [quoted(c) for c in dict.fromkeys([*spec.conversation, *spec.order_by])]
        newest = Window.partitionBy(*keys).orderBy(F.desc("__version"))
        kept = rows.filter("__version >= 0").withColumn("__n", F.row_number().over(newest)).filter("__n = 1")
        return kept.drop("__n", "__version", "__late").withColumn("__order", ordering(spec))

    def row_edges(self) -> DataFrame:
        """The rows (in Conversation windows: the units of conversations) with their cells, ENA_UNIT and __order."""
        rows, spec = self._stored(), self.spec
        if self.moving:
            return rows
        codes = [F.col(f"__c{i}") for i in range(len(spec.codes))]
        keys = [quoted(k) for k in dict.fromkeys([*spec.conversation, *spec.units])]
        sums = rows.groupBy(*keys, "ENA_UNIT").agg(*[F.sum(c).alias(f"__c{i}") for i, c in enumerate(codes)], F.min("__order").alias("__order"))
        made: list[Column] = [weighted(x, f, spec.weighting).alias(e.name) for x, f, e in zip(upper_triangle(codes), spec.factors(), spec.edges(), strict=True)]
        return sums.select(*keys, "ENA_UNIT", "__order", *made)

    def counts(self) -> DataFrame:
        """Counts by unit, or by step for trajectories."""
        rows = self.row_edges()
        if self.spec.units_used is not None and not used(rows, self.spec).take(1):
            raise ValueError(f"units_used: no row has any of these labels: {list(self.spec.units_used)}")
        return counted(rows, self.spec, self.rows)

    def metadata(self) -> DataFrame:
        """The units' stable metadata, as a batch has them."""
        return unit_metadata(self._stored().drop("ENA_UNIT"), self.spec)


def accumulate_stream(spark: SparkSession, rows: DataFrame, spec: AccumulateSpec, folder: str) -> DataFrame:
    """Counts of a stream read to its end, in a new folder below ``folder``."""
    return AccumulationStream(rows, spec, f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}").start().finish()


@dataclass
class SessionState:
    """How far a session is. ``progress`` is 0 while the number of rows to come isn't known."""

    rows_seen: int = 0
    chunks_seen: int = 0
    progress: float = 0.0
    is_finished: bool = False
    is_disposed: bool = False


class AccumulationSession:
    """Chunks of rows that are pushed one after the other, and the batch's result at the end.

    A chunk is a DataFrame of ``schema``; it is put into the session's folder as one more
    piece of a stream, which takes it in at once. After finish() or dispose() nothing can be
    pushed; dispose() deletes the session's folder, and leaving a ``with`` block disposes.
    """

    def __init__(self, spark: SparkSession, schema: T.StructType, spec: AccumulateSpec, folder: str, expected_rows: int | None = None, on_progress: Callable[[float, SessionState], None] | None = None):
        self.spark, self.schema, self.expected_rows, self.on_progress = spark, schema, expected_rows, on_progress
        self.folder = f"{folder.rstrip('/')}/session-{uuid.uuid4().hex}"
        spark.createDataFrame([], schema).limit(0).write.parquet(f"{self.folder}/in/chunk=0")
        rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/in")
        self.stream, self.state = AccumulationStream(rows, spec, f"{self.folder}/out"), SessionState()

    def _tell(self, progress: float) -> None:
        self.state.progress = progress
        if self.on_progress is not None:
            self.on_progress(progress, self.state)

    def push(self, rows: DataFrame) -> SessionState:
        if self.state.is_finished or self.state.is_disposed:
            raise RuntimeError("the session is over: nothing can be pushed")
        try:
            missing = [c for c in self.schema.names if c not in rows.columns]
            if missing:
                raise ValueError(f"missing columns: {missing}")
            own = rows.select(*[quoted(f.name).cast(f.dataType) for f in self.schema])
            path = f"{self.folder}/in/chunk={self.state.chunks_seen + 1}"
            own.write.parquet(path)
            self.stream.start()
            self.stream.query.awaitTermination()
        except Exception:
            self.dispose()
            raise
        self.state.rows_seen += self.spark.read.schema(self.schema).parquet(path).count()
        self.state.chunks_seen += 1
        self._tell(min(0.99, self.state.rows_seen / self.expected_rows) if self.expected_rows else 0.0)
        return self.state

    def finish(self) -> DataFrame:
        """The counts; they are read from the session's folder, which dispose() deletes."""
        if self.state.is_finished or self.state.is_disposed:
            raise RuntimeError("the session is over")
        self.state.is_finished = True
        if not self.state.rows_seen:
            self.dispose()
            raise ValueError("no rows were pushed")
        out = self.stream.counts()
        self._tell(1.0)
        return out

    def dispose(self) -> None:
        if not self.state.is_disposed:
            self.state.is_finished = self.state.is_disposed = True
            self.stream.stop()
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> AccumulationSession:
        return self

    def __exit__(self, *_) -> None:  # noqa: ANN002
        self.dispose()


def accumulate_chunked(df: DataFrame, spec: AccumulateSpec, folder: str, chunks: int, on_progress: Callable[[float, SessionState], None] | None = None) -> AccumulationSession:
    """``df`` in ``chunks`` parts, in the order of its rows, through a session; its counts are finish()ed by the caller."""
    if chunks < 1:
        raise ValueError("chunks: a whole number from 1")
    session = AccumulationSession(df.sparkSession, df.schema, spec, folder, None, on_progress)
    try:
        # rows are dealt by range, sorted and written once; what stands before each range then numbers them
        dealt = df.repartitionByRange(*[quoted(c) for c in spec.order_by]).sortWithinPartitions(*[quoted(c) for c in spec.order_by]) if chunks > 1 else df
        path = f"{session.folder}/dealt"
        placed = dealt.withColumns({"__range": F.spark_partition_id(), "__place": F.monotonically_increasing_id().bitwiseAND(2**33 - 1)})
        placed.write.parquet(path)
        rows = df.sparkSession.read.schema(placed.schema).parquet(path)
        sizes = dict(rows.groupBy("__range").count().collect())
        n = session.expected_rows = sum(sizes.values())

        def before(place: int) -> Column:
            """Rows before the ``place``-th."""
            for r in sorted(sizes):
                if place < sizes[r]:
                    return (F.col("__range") < r) | (F.col("__range") == r) & (F.col("__place") < place)
                place -= sizes[r]
            return F.lit(True)

        done = 0
        for k in range(chunks):
            end = done + n // chunks + (k < n % chunks)
            session.push(rows.filter(before(end) & ~before(done)).select(*[quoted(c) for c in df.columns]))
            done = end
    except Exception:
        session.dispose()
        raise
    return session
