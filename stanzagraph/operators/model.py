"""Units in a low-dimensional space: norms, centre, rotation, points, nodes, centroids."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stanzagraph.functions.columns import l2_norm, quoted, sphere_norm, total
from stanzagraph.functions.linalg import Moments, as_array, mapped, moments
from stanzagraph.functions.nodes import incidence, node_weights, positions
from stanzagraph.functions.rotations import Axes, Svd, Units, rotate
from stanzagraph.operators.accumulate import Accumulation
from stanzagraph.operators.vector import WIDE, lines_of
from stanzagraph.spec import AccumulateSpec, Edge


def line_weights(counts: DataFrame, edges: list[str]) -> DataFrame:
    """Every edge column on the unit sphere of its row."""
    keep = [quoted(c) for c in counts.columns if c not in edges]
    scaled, normed = sphere_norm(counts, edges)
    return scaled.select(*keep, *[c.alias(n) for c, n in zip(normed, edges, strict=True)])


def skip_sphere_norm(counts: DataFrame, edges: list[str]) -> DataFrame:
    """Every edge column over the largest row norm of all."""
    keep = [quoted(c) for c in counts.columns if c not in edges]
    top = F.broadcast(counts.agg(F.max(l2_norm([quoted(e) for e in edges])).alias("__top")))  # one row
    return counts.join(top).select(*keep, *[F.when(F.col("__top") > 0, quoted(e) / F.col("__top")).otherwise(F.lit(0.0)).alias(e) for e in edges])


def has_signal(edges: list[str]) -> Column:
    """A sum, not a norm: signed masks can cancel."""
    return total([quoted(e) for e in edges]) != 0


@dataclass
class Model:
    """A fitted rotation. transform() puts other accumulations into the same space."""

    edges: list[Edge]
    codes: list[str]
    axes: Axes
    center: np.ndarray
    align: bool
    method: str
    dimensions: int
    nodes: np.ndarray | None = None
    pair: tuple[str, ...] = ()

    @property
    def shown(self) -> list[str]:
        return self.axes.names[: self.dimensions]

    def centred(self, counts: DataFrame, carry_lines: bool = True) -> DataFrame:
        """counts with arrays: lines (the row's line weights) and centred."""
        names = [e.name for e in self.edges]
        if len(names) > WIDE:
            return lines_of(counts, names, self.center, self.align)
        keep = [quoted(c) for c in counts.columns if c not in names]
        signal = has_signal(names) if self.align else F.lit(True)
        scaled, normed = sphere_norm(counts, names)
        lines = scaled.select(*keep, signal.alias("__signal"), F.array(*normed).alias("lines"))
        centre = F.array(*[F.lit(float(x)) for x in self.center])
        zero = F.array(*[F.lit(0.0)] * len(names))
        return lines.withColumn("centred", F.when(F.col("__signal"), F.zip_with("lines", centre, lambda a, b: a - b)).otherwise(zero)).drop("__signal")

    def points(self, counts: DataFrame) -> DataFrame:
        """counts' keys with an array of all coordinates and a column for each shown axis."""
        rows = mapped(self.centred(counts), F.col("centred"), self.axes.matrix, "all_points")
        return rows.select(*[quoted(c) for c in rows.columns if c not in ("lines", "centred")], *[F.col("all_points")[i].alias(n) for i, n in enumerate(self.shown)])

    def transform(self, acc: Accumulation) -> DataFrame:
        """Another accumulation's points in this space."""
        if acc.spec.network == "ordered" or any(a != b for a, b in zip(acc.edges, self.edges, strict=False)) or len(acc.edges) != len(self.edges):
            raise ValueError("only standard networks with the same edges can be projected")
        return self.points(acc.counts)

    def variance(self, counts: DataFrame) -> dict[str, float]:
        """Each axis' share of the points' sample variance."""
        m = moments(self.centred(counts), F.col("centred"), len(self.edges))
        per = np.einsum("ij,ik,kj->j", self.axes.matrix, m.scatter, self.axes.matrix)
        whole = per.sum()
        return {n: float(v / whole) if whole > 0 else 0.0 for n, v in zip(self.axes.names, per, strict=True)}

    def weights(self, counts: DataFrame) -> DataFrame:
        """Node weights of every unit (an array, in the order of codes)."""
        h = incidence(self.edges, len(self.codes), self.method)
        raw = mapped(self.centred(counts), F.col("lines"), h, "weights")
        size = F.greatest(F.lit(1e-4), F.aggregate("weights", F.lit(0.0), lambda s, x: s + F.abs(x)))
        return raw.withColumn("weights", F.transform("weights", lambda x: x / size))

    def fit_nodes(self, counts: DataFrame) -> np.ndarray:
        """One pass: the weights' products with themselves and with the shown points."""
        h, matrix, p = incidence(self.edges, len(self.codes), self.method), self.axes.matrix[:, : self.dimensions], len(self.codes)
        keys = len(self.pair)
        width = p + matrix.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lines, centred = (b.column(keys + i).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for i in range(2))
                both = np.hstack([node_weights(lines, h), centred @ matrix]) if b.num_rows else np.zeros((0, width))
                offsets = pa.array(np.arange(0, (len(both) + 1) * width, width, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*b.columns[:keys], pa.ListArray.from_arrays(offsets, pa.array(both.ravel()))], names=[*self.pair, "v"])

        units = self.centred(counts).select(*[quoted(c) for c in self.pair], "lines", "centred")
        rows = units.mapInArrow(run, T.StructType([*[units.schema[c] for c in self.pair], T.StructField("v", T.ArrayType(T.DoubleType()))]))
        if self.pair:
            pairs = rows.groupBy(*[quoted(c) for c in self.pair]).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(F.col("v")[i]).alias(f"__v{i}") for i in range(width)])
            if pairs.filter("__n <> 2").take(1):
                raise ValueError("pairs of rows are asked for")
            rows = pairs.select(F.array(*[f"__v{i}" for i in range(width)]).alias("v"))
        m = moments(rows, F.col("v"), width)
        return positions(m.gram[:p, :p], m.gram[:p, p:])

    def node_table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, *map(float, r)) for c, r in zip(self.codes, self.nodes, strict=True)]
        return spark.createDataFrame(rows, T.StructType([T.StructField("code", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in self.shown]]))

    def centroids(self, counts: DataFrame) -> DataFrame:
        """Where each unit's weighted nodes lie."""
        out = mapped(self.weights(counts), F.col("weights"), self.nodes, "centroid")
        return out.select(F.col("ENA_UNIT").alias("unit"), *[F.col("centroid")[i].alias(n) for i, n in enumerate(self.shown)])

    def to_json(self) -> str:
        return json.dumps({"edges": [vars(e) for e in self.edges], "codes": self.codes, "names": self.axes.names, "matrix": self.axes.matrix.tolist(), "eigenvalues": self.axes.eigenvalues.tolist(), "center": self.center.tolist(), "align": self.align, "method": self.method, "dimensions": self.dimensions, "pair": self.pair, "nodes": None if self.nodes is None else self.nodes.tolist()})

    @classmethod
    def from_json(cls, text: str) -> Model:
        x = json.loads(text)
        axes = Axes(x["names"], np.asarray(x["matrix"]), np.asarray(x["eigenvalues"]))
        return cls([Edge(**e) for e in x["edges"]], x["codes"], axes, np.asarray(x["center"]), x["align"], x["method"], x["dimensions"], None if x["nodes"] is None else np.asarray(x["nodes"]), tuple(x.get("pair", ())))


def fit(acc: Accumulation, rotation=None, dimensions: int = 2, align: bool = True, method: str | None = None, metadata: DataFrame | None = None, nodes: bool = True, pair: Sequence[str] = ()) -> Model:  # noqa: ANN001
    """Fit a space to an accumulation's units.

    ``method`` places the nodes: undirected, directed, or (with ``pair``) paired, where the two
    rows of an ordered network that agree in the columns ``pair`` (a unit's ground and its
    response) are added before the nodes are fitted. ``metadata`` (with ENA_UNIT) brings columns that a rotation refers to. Only sums over
    units reach the driver: the centre, products of edges, means or cross products.
    """
    rotation = rotation or Svd()
    if acc.spec.network == "ordered" and not isinstance(rotation, Svd):
        raise ValueError("ordered networks are rotated by Svd only")
    method = method or ("directed" if acc.spec.network == "ordered" else "undirected")
    if method not in ("undirected", "directed", "paired") or (method != "undirected") != (acc.spec.network == "ordered"):
        raise ValueError("node positions: undirected for standard networks, directed or paired for ordered ones")
    if (method == "paired") != bool(pair) or not set(pair) <= set(acc.spec.units):
        raise ValueError("paired node positions need the unit columns that tell pairs")
    if isinstance(dimensions, bool) or not isinstance(dimensions, int) or dimensions < 1:
        raise ValueError("dimensions: a whole number from 1")
    names = acc.edge_names
    acc.materialized()
    if len(names) > WIDE:
        m = moments(lines_of(acc.counts, names, align=align).filter("__signal"), F.col("lines"), len(names))
    else:
        rows = acc.counts.filter(has_signal(names)) if align else acc.counts
        scaled, normed = sphere_norm(rows, names)
        m = moments(scaled, F.array(*normed), len(names))
    if align and m.n == 0:
        raise ValueError("no unit has any connection")
    blank = Axes([], np.zeros((len(names), 0)), np.zeros(0))
    model = Model(acc.edges, list(acc.spec.codes), blank, m.means, align, method, min(dimensions, len(names)), pair=tuple(pair))
    units = model.centred(acc.counts)
    if metadata is not None:
        extra = [c for c in metadata.columns if c not in units.columns]
        units = units.join(metadata.select("ENA_UNIT", *[quoted(c) for c in extra]), "ENA_UNIT", "left")
    # about their centre, units without connections add nothing but their number
    about = Moments(acc.counts.count(), np.zeros(len(names)), m.scatter)
    model.axes = rotate(Units(units, names, about), rotation)
    if nodes:
        model.nodes = model.fit_nodes(acc.counts)
    return model


def ena(df: DataFrame, spec: AccumulateSpec, rotation=None, **options) -> tuple[Accumulation, Model]:  # noqa: ANN001, ANN003
    """Accumulate and fit, with the stable metadata at hand."""
    from stanzagraph.operators.accumulate import accumulate, unit_metadata

    acc = accumulate(df, spec)
    metadata = unit_metadata(df, spec) if spec.metadata else None
    return acc, fit(acc, rotation, metadata=metadata, **options)


__all__ = ["Model", "as_array", "ena", "fit", "has_signal", "line_weights", "skip_sphere_norm"]
