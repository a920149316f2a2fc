"""Cells and sums of many edges, and of ordered networks, with numpy over Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stanzagraph.functions.columns import quoted
from stanzagraph.functions.kernel import exactly_summed, expand, ordered_row_cells, stanza_cells
from stanzagraph.spec import AccumulateSpec

#: Edges beyond which a column for each leaves Spark's generated code.
WIDE = 100
#: Rows that are put into windows at once.
ROWS = 20_000


def vectorised(spec: AccumulateSpec) -> bool:
    """Whether cells are made here: ordered networks, whose sums are exact, and many edges."""
    if spec.window != "MovingStanzaWindow" or spec.forward is None or spec.plain_function:
        return False
    return spec.network == "ordered" or len(spec.edges()) > WIDE


def runs_of(table: pa.Table, names: list[str]) -> np.ndarray:
    """Numbers of the table's runs of rows with equal key columns."""
    new = np.zeros(table.num_rows, bool)
    for name in names:
        c = table.column(name).combine_chunks()
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))
        new[1:] |= ~same
    return np.cumsum(new)


def row_cells(named: DataFrame, spec: AccumulateSpec, by: list[Column], codes: list[Column]) -> DataFrame:
    """``named`` with __cells: every row's cells after threshold and mask, in the order of the edges.

    Rows are dealt and sorted by conversation and order, and go through windows in blocks
    that keep the rows which later ones still reach, so a conversation is never gathered.
    """
    edges, back, forward, ordered = spec.edges(), spec.back, spec.forward, spec.network == "ordered"
    factors, binary = np.asarray(spec.factors()), spec.weighting == "binary"
    keys = [f"__by{i}" for i in range(len(by))]
    out = named.columns
    dealt = named.withColumns(dict(zip(keys, by, strict=True)) | {"__codes": F.array(*codes)})
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, *[quoted(c) for c in spec.order_by])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done, carry, gathered, size = None, 0, None, [], 0

        def tables() -> Iterator[tuple[pa.Table, bool]]:
            nonlocal gathered, size
            for batch in batches:
                gathered.append(batch)
                size += batch.num_rows
                if size >= ROWS:
                    yield pa.Table.from_batches(gathered), False
                    gathered, size = [], 0
            if gathered or held is not None:
                yield (pa.Table.from_batches(gathered) if gathered else held.slice(0, 0)), True

        for new, last in tables():
            table = new if held is None else pa.concat_tables([held, new])
            n = table.num_rows
            if not n:
                continue
            run = runs_of(table, keys)
            values = table.column("__codes").combine_chunks()
            x = values.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            open_from = int(np.searchsorted(run, run[-1]))  # the last conversation may go on
            ready = n if last else max(open_from, n - forward)
            if ordered:
                cells = ordered_row_cells(x, run, edges, back, carry)
            else:
                cells = stanza_cells(x, run, edges, back, forward, None if carry is None else np.asarray([math.fsum(c) for c in carry]))
                if binary:
                    cells = (cells > 0).astype(float)
            made = np.where(factors == 0, 0.0, cells[done:ready] * factors) if len(edges) else cells[done:ready]
            if ready > done:
                offsets = pa.array(np.arange(0, (ready - done + 1) * len(edges), len(edges), dtype=np.int32))
                told = table.slice(done, ready - done).select(out).append_column("__cells", pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(made).ravel())))
                yield from told.to_batches(max_chunksize=ROWS)
            # without a bound one row stays, so that it shows whether the next rows go on with its conversation
            keep = max(open_from, min(ready, n - 1) if back is None else ready - max(0, back - 1))
            if back is None:
                if open_from > 0 or carry is None:
                    carry = [[] for _ in range(x.shape[1])]
                for row in x[open_from if open_from > 0 else 0 : keep]:
                    for c, v in zip(carry, row.tolist(), strict=True):
                        expand(c, v) if ordered else c.__setitem__(slice(None), [(c[0] if c else 0.0) + v])
            held, done = table.slice(keep), ready - keep

    schema = T.StructType([*named.schema.fields, T.StructField("__cells", T.ArrayType(T.DoubleType()))])
    return dealt.mapInArrow(run, schema)


def lines_of(counts: DataFrame, names: list[str], centre: np.ndarray | None = None, align: bool = True) -> DataFrame:
    """``counts`` with arrays instead of the edge columns: lines (the row on the unit sphere) and __signal, or with a ``centre`` centred.

    Rows are scaled by a power of two near their largest entry, so that no square overflows
    and no scaling rounds; a zero row stays zero.
    """
    keep = [f for f in counts.schema.fields if f.name not in names]
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(len(keep)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            signal = x.sum(axis=1) != 0 if align else np.ones(len(x), bool)
            top = np.abs(x).max(axis=1, initial=0, keepdims=True)
            scaled = np.ldexp(x, 1 - np.frexp(top)[1])
            norm = np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
            lines = scaled / np.where(norm > 0, norm, 1)
            offsets = pa.array(np.arange(0, (len(x) + 1) * width, width, dtype=np.int32))
            listed = lambda m: pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(m).ravel()))
            more = pa.array(signal) if centre is None else listed(np.where(signal[:, None], lines - centre, 0.0))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], listed(lines), more], names=[*[f.name for f in keep], "lines", "more"])

    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([*keep, T.StructField("lines", numbers), T.StructField("more", T.BooleanType() if centre is None else numbers)])
    made = counts.select(*[quoted(f.name) for f in keep], F.array(*[quoted(n) for n in names]).alias("__x")).mapInArrow(run, schema)
    return made.withColumnRenamed("more", "__signal" if centre is None else "centred")


def summed(rows: DataFrame, keys: list[str], edges: int) -> DataFrame:
    """__cells summed by the key columns, and the least __order: ``keys``, first_seen, __sums.

    Tasks sum their own rows, keeping what rounding loses beside each sum, and a key's few
    partial sums meet and are rounded once. A key has at most one partial sum a task.
    """
    kinds = {f.name: f for f in rows.schema.fields}
    picked = rows.select(*[quoted(k) for k in keys], "__order", "__cells")

    def first(order: dict | None) -> tuple:
        return () if order is None else tuple((v is not None, v) for v in (order.values() if isinstance(order, dict) else [order]))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[tuple, int] = {}
        seen: list = []
        high, low = np.zeros((0, edges)), np.zeros((0, edges))
        types = None
        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(keys) + 1)]
            of = []
            for key, order in zip(zip(*(batch.column(i).to_pylist() for i in range(len(keys))), strict=True), batch.column(len(keys)).to_pylist(), strict=True):
                at = place.setdefault(key, len(place))
                if at == len(seen):
                    seen.append(order)
                elif first(order) < first(seen[at]):
                    seen[at] = order
                of.append(at)
            if len(place) > len(high):
                more = np.zeros((max(len(place), 2 * len(high)) - len(high), edges))
                high, low = np.vstack([high, more]), np.vstack([low, more])
            x = batch.column(len(keys) + 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, edges)
            top = float(np.abs(x).sum() + np.abs(high).max(initial=0))
            if exactly_summed(2 * x, 2 * top) and exactly_summed(2 * high, 0.0):
                np.add.at(high, of, x)
                continue
            for at, row in zip(of, x, strict=True):
                total = high[at] + row
                part = total - high[at]
                low[at] += (high[at] - (total - part)) + (row - part)
                high[at] = total
        if place:
            n = len(place)
            columns = [pa.array(c, t) for c, t in zip(zip(*place, strict=True), types[:-1], strict=True)]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * edges, edges, dtype=np.int32)), pa.array(np.ascontiguousarray(m[:n]).ravel())) for m in (high, low)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(seen, types[-1]), *lists], names=[*keys, "__order", "high", "low"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sums = np.zeros((n, edges))
            parts = batch.column(len(keys) + 1)
            sizes = np.diff(parts.offsets.to_numpy())
            inner = parts.flatten()
            h, w = (inner.field(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, edges) for i in range(2))
            at = 0
            for i, k in enumerate(sizes.tolist()):
                own = np.vstack([h[at : at + k], w[at : at + k]])
                at += k
                if not np.isfinite(own).all():
                    raise ValueError("a unit's sums are beyond the range of doubles")
                sums[i] = own.sum(axis=0) if exactly_summed(2 * own, 2 * float(np.abs(own).sum())) else [math.fsum(c) for c in own.T.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 1], pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * edges, edges, dtype=np.int32)), pa.array(sums.ravel()))], names=[*keys, "first_seen", "__sums"])

    numbers = T.ArrayType(T.DoubleType())
    fields = [kinds[k] for k in keys]
    some = picked.mapInArrow(partial, T.StructType([*fields, kinds["__order"], T.StructField("high", numbers), T.StructField("low", numbers)]))
    met = some.groupBy(*[quoted(k) for k in keys]).agg(F.min("__order").alias("first_seen"), F.collect_list(F.struct("high", "low")).alias("parts"))
    return met.mapInArrow(merge, T.StructType([*fields, T.StructField("first_seen", kinds["__order"].dataType), T.StructField("__sums", numbers)]))
