"""Small dense algebra on the driver, and the reductions that feed it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks whose partial moments are added before the driver adds the rest.
COMBINED = 16


@dataclass(frozen=True)
class Moments:
    """Rows, sums and uncentred products of a vector column."""

    n: int
    sums: np.ndarray
    gram: np.ndarray

    @property
    def means(self) -> np.ndarray:
        return self.sums / max(1, self.n)

    @property
    def scatter(self) -> np.ndarray:
        """Products about the mean."""
        return self.gram - np.outer(self.sums, self.sums) / max(1, self.n)


def moments(df: DataFrame, vector: Column, width: int) -> Moments:
    """One pass over ``vector`` (array<double>): each task adds up its own rows, a few tasks
    add those up, and the driver adds the few. What moves is the square of the width."""
    return moments_by(df, F.lit(0), vector, width).get(0, Moments(0, np.zeros(width), np.zeros((width, width))))


def moments_by(df: DataFrame, key: Column, vector: Column, width: int) -> dict[int, Moments]:
    """The moments of each value of a whole-number ``key`` of a few values, in one pass."""
    none = lambda: [0, np.zeros(width), np.zeros((width, width))]

    def pack(found: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for k, (n, s, g) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([n], pa.int64()), pa.array([s.tobytes()], pa.binary()), pa.array([g.tobytes()], pa.binary())], names=["k", "n", "s", "g"])

    def add(found: dict[int, list], k: int, n: int, s: np.ndarray, g: np.ndarray) -> None:
        held = found.setdefault(k, none())
        held[0] += n
        held[1] += s
        held[2] += g

    def unpacked(row: Sequence) -> tuple[int, int, np.ndarray, np.ndarray]:
        k, n, s, g = row
        return k, n, np.frombuffer(bytes(s)), np.frombuffer(bytes(g)).reshape(width, width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            keys = b.column(0).to_numpy()
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for k in np.unique(keys).tolist():
                own = x[keys == k]
                add(found, k, len(own), own.sum(axis=0), own.T @ own)
        yield from pack(found)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                add(found, *unpacked(row))
        yield from pack(found)

    schema = "k long, n long, s binary, g binary"
    few = df.select(key.cast("long").alias("k"), vector.alias("v")).mapInArrow(partial, schema).repartition(COMBINED).mapInArrow(combine, schema).collect()
    total: dict[int, list] = {}
    for r in sorted(few, key=lambda r: (r["k"], r["n"], bytes(r["s"]))):
        add(total, *unpacked(r))
    return {k: Moments(*held) for k, held in total.items()}


def mapped(df: DataFrame, vector: Column, matrix: np.ndarray, name: str) -> DataFrame:
    """``df`` with ``name`` = vector times matrix, batch by batch."""
    matrix = np.ascontiguousarray(matrix, float)
    fields = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(matrix))
            y = x @ matrix
            offsets = pa.array(np.arange(0, (len(y) + 1) * matrix.shape[1], matrix.shape[1], dtype=np.int32)) if matrix.shape[1] else pa.array(np.zeros(len(y) + 1, np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], names=[*fields, name])

    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    return df.withColumn("__v", vector).mapInArrow(run, schema)


def eigen(symmetric: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first and none below 0, and columns whose largest entry is positive."""
    values, vectors = np.linalg.eigh((symmetric + symmetric.T) / 2)
    order = np.argsort(-values, kind="stable")
    return np.maximum(values[order], 0), signed(vectors[:, order])


def signed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that their entry of largest size is positive; the first of equals."""
    size = np.abs(vectors)
    top = np.argmax(size >= size.max(axis=0) * (1 - 1e-9), axis=0) if vectors.size else np.zeros(0, int)
    signs = np.sign(vectors[top, np.arange(vectors.shape[1])])
    return vectors * np.where(signs == 0, 1, signs)


def normalized(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v)
    return v / size if size > 0 else np.zeros_like(v, float)


def deflated(gram: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The Gram matrix of rows without their part along the unit vector ``u``."""
    keep = np.eye(len(u)) - np.outer(u, u)
    return keep @ gram @ keep


def completed(leading: Sequence[np.ndarray], gram: np.ndarray) -> tuple[np.ndarray, int]:
    """A square basis: the leading columns, then main directions of what they leave, then
    unit vectors made orthogonal. Also the number of leading columns."""
    e = len(gram)
    span: list[np.ndarray] = []
    for v in leading:
        w = normalized(v - sum((u * (u @ v) for u in span), np.zeros(e)))
        if np.linalg.norm(w) > 0.5:
            span.append(w)
    rest = gram
    for u in span:
        rest = deflated(rest, u)
    values, vectors = eigen(rest)
    columns, orthogonal = [normalized(v) for v in leading], list(span)

    def add(v: np.ndarray, least: float) -> None:
        w = v
        for _ in range(2):
            w = w - sum((u * (u @ w) for u in orthogonal), np.zeros(e))
        if np.linalg.norm(w) > least and len(columns) < e:
            orthogonal.append(normalized(w))
            columns.append(orthogonal[-1])

    for k in range(e):
        if values[k] > 1e-12 * max(values[0], 1e-300):
            add(vectors[:, k], 1e-10)
    for k in range(e):
        add(np.eye(e)[k], 1e-10)
    return np.column_stack(columns), len(leading)


def solved(a: np.ndarray, b: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """a x = b for a symmetric a; the least solution where a is singular."""
    a = a + ridge * np.eye(len(a))
    try:
        if np.linalg.cond(a) < 1e13:
            return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(a, b, rcond=None)[0]


def as_array(columns: Sequence[str]) -> Column:
    from stanzagraph.functions.columns import quoted

    return F.array(*[quoted(c).cast("double") for c in columns])
