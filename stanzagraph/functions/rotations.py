"""Directions to look along. Each works on sums over units, never on the units themselves."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stanzagraph.functions.columns import quoted
from stanzagraph.functions.linalg import Moments, completed, deflated, eigen, moments, moments_by, normalized, signed, solved
from stanzagraph.streaming.folders import shared_folder


@dataclass(frozen=True)
class Svd:
    pass


@dataclass(frozen=True)
class Mean:
    """Differences of two groups' means; a group is a list of unit labels or a condition in SQL."""

    groups: Sequence[tuple]


@dataclass(frozen=True)
class Generalized:
    """What x (a number or a group) changes, then y or the main direction of the rest."""

    x: str
    y: str | None = None
    select2: tuple | None = None
    covariates: Sequence[str] = ()


@dataclass(frozen=True)
class Regression:
    """``V ~ a + b + a:b``: the first term's coefficients; or ``target ~ V``: the edges' coefficients."""

    x: str
    y: str | None = None


@dataclass(frozen=True)
class Hena:
    """Coefficients of x (and y) beside controls and, if asked for, their product."""

    x: str
    y: str | None = None
    controls: Sequence[str] = ()
    centre: bool = True
    interaction: bool = False


@dataclass(frozen=True)
class Spherical:
    """A named edge or a vector as the first axis, another made orthogonal as the second."""

    first: str | Sequence[float]
    second: str | Sequence[float] | None = None


@dataclass(frozen=True)
class Axes:
    names: list[str]
    matrix: np.ndarray
    eigenvalues: np.ndarray


@dataclass(frozen=True)
class Units:
    """Centred units to rotate: ``df`` has ENA_UNIT, first_seen, metadata and the array ``centred``."""

    df: DataFrame
    edges: list[str]
    known: Moments | None = None

    def moments(self, extra: Sequence = ()):  # noqa: ANN001, ANN201
        """Of the centred edges and further columns beside them."""
        if not extra and self.known is not None:
            return self.known
        return moments(self.df, F.concat(F.col("centred"), F.array(*[c.cast("double") for c in extra])) if extra else F.col("centred"), len(self.edges) + len(extra))

    def numeric(self, name: str) -> bool:
        return dict(self.df.dtypes)[name] in ("int", "bigint", "double", "float", "boolean", "smallint", "tinyint") or dict(self.df.dtypes)[name].startswith("decimal")

    def levels(self, name: str) -> list[str]:
        found = [r[0] for r in self.df.select(quoted(name).cast("string")).distinct().collect()]
        if None in found:
            raise ValueError(f"{name} has nulls, so it can't be a target")
        return sorted(found)

    def group_means(self, name: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Levels, sizes and mean vectors of a text column's groups."""
        levels = self.levels(name)
        m = self.moments([(quoted(name).cast("string") == v).cast("double") for v in levels])
        e = len(self.edges)
        n = m.sums[e:]
        return levels, n, (m.gram[:e, e:] / n).T

    def coefficients(self, design: Sequence) -> np.ndarray:  # noqa: ANN001
        """Least squares of every edge on a constant and the design's columns: a row a column."""
        m = self.moments([F.lit(1.0), *design])
        e = len(self.edges)
        return solved(m.gram[e:, e:], m.gram[e:, :e])


def _member(group) -> F.Column:  # noqa: ANN001
    return F.expr(group) if isinstance(group, str) else F.col("ENA_UNIT").isin(list(group))


def _number(units: Units, name: str):  # noqa: ANN202
    """A numeric column as it is (null 0); text as its place from 1 among the sorted levels."""
    if units.numeric(name):
        return F.coalesce(quoted(name).cast("double"), F.lit(0.0))
    c = F.lit(None).cast("double")
    for i, v in enumerate(units.levels(name), 1):
        c = F.when(quoted(name).cast("string") == v, float(i)).otherwise(c)
    return c


def parsed(formula: str) -> tuple[str, list[list[str]]]:
    """Left side and terms (each a list of factors) of a formula of names, + and :."""
    inner = re.fullmatch(r"\s*lm\s*\(\s*(?:formula\s*=)?(.*?)\)\s*", formula, re.S)
    text = inner[1].split(",")[0] if inner else formula
    left, mark, right = text.partition("~")
    terms = [[f.strip() for f in t.split(":")] for t in right.split("+")]
    if not mark or not left.strip() or any(not re.fullmatch(r"[A-Za-z_.][\w.]*", f) for t in terms for f in t):
        raise ValueError(f"a formula of names, + and : is asked for, not {formula!r}")
    return left.strip(), terms


def _terms(units: Units, terms: list[list[str]]) -> list:
    out = []
    for t in terms:
        c = _number(units, t[0])
        for f in t[1:]:
            c = c * _number(units, f)
        out.append(c)
    return out


def _regressed(units: Units, formula: str, taken: list[str]) -> tuple[np.ndarray, str]:
    left, terms = parsed(formula)
    e = len(units.edges)
    if left == "V":
        direction, name = units.coefficients(_terms(units, terms))[1], f"{units.edges[0]}_reg"
    elif terms == [["V"]]:
        m = units.moments([F.lit(1.0), _number(units, left)])
        if m.n <= e:
            raise ValueError("regressing on V needs more units than edges")
        inside = [*range(e), e]
        direction, name = solved(m.gram[np.ix_(inside, inside)], m.gram[inside, e + 1])[:e], "V_reg"
    else:
        raise ValueError(f"V stands on one side of a formula: {formula!r}")
    clashes = sum(t == name or t.startswith(f"{name}.") for t in taken)
    return normalized(direction), f"{name}.{clashes}" if clashes else name


def _effect(units: Units, name: str, gram_of=None) -> np.ndarray:  # noqa: ANN001
    """Where a column moves the edges: the slope on a number, or the main direction of group means."""
    if units.numeric(name):
        return normalized(units.coefficients([_number(units, name)])[1])
    _, n, means = units.group_means(name)
    centre = (n[:, None] * means).sum(axis=0) / n.sum()
    away = means - centre
    return eigen((away * n[:, None]).T @ away)[1][:, 0]


def _orthogonal(v: np.ndarray, to: np.ndarray) -> np.ndarray:
    return normalized(v - to * (to @ v))


def _mean(units: Units, r: Mean) -> tuple[list[np.ndarray], list[str]]:
    e, found = len(units.edges), []
    for a, b in r.groups:
        m = units.moments([F.coalesce(_member(g), F.lit(False)).cast("double") for g in (a, b)])
        n = m.sums[e:]
        if (n == 0).any():
            raise ValueError("a group has no units")
        d = m.gram[:e, e] / n[0] - m.gram[:e, e + 1] / n[1]
        for u in found:
            d = d - u * (u @ d)
        if np.linalg.norm(d) > 1e-12:
            found.append(normalized(d))
    return found, [f"MR{i + 1}" for i in range(len(found))]


def _generalized(units: Units, r: Generalized, gram: np.ndarray) -> tuple[list[np.ndarray], list[str]]:
    if r.select2:
        found, _ = _mean(units, Mean([r.select2]))
        x = found[0]
    elif r.covariates and not units.numeric(r.x):
        x = _fitted_effect(units, r)
    else:
        x = _effect(units, r.x)
    if r.y:
        return [x, _orthogonal(_effect(units, r.y), x)], ["RR1", "RR2"]
    return [x, eigen(deflated(gram, x))[1][:, 0]], ["RR1", "SVD2"]


def _fitted_effect(units: Units, r: Generalized) -> np.ndarray:
    """The main direction of x's fitted part beside covariates, by an elastic net that doesn't
    penalize x. Units, in their order, are dealt to ten folds in turn; only sums of each fold
    reach the driver."""
    from stanzagraph.functions.elasticnet import cross_validated_moments

    columns = [_number(units, c) for c in [r.x, *r.covariates]]
    means = units.df.agg(*[F.avg(c) for c in columns]).first()
    centred = F.array(*[c - F.lit(float(m)) for c, m in zip(columns, means, strict=True)])
    rows, begins = in_order(units.df, F.concat(centred, F.col("centred")))
    fold = (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*ORDER)) - 1) % FOLDS
    e = len(units.edges)
    parts = moments_by(rows.join(begins, "part"), fold, F.col("value"), len(columns) + e)
    fit = cross_validated_moments([parts[k] for k in sorted(parts)], len(columns), factors=[0.0, *[1.0] * len(r.covariates)])
    found = fit.coefficients[0]
    return signed(normalized(found)[:, None])[:, 0] if found.any() else np.eye(e)[0]


#: What units are ordered by, and the folds of a cross-validation.
ORDER, FOLDS = ["first_seen", "ENA_UNIT"], 10


def in_order(df: DataFrame, value: F.Column) -> tuple[DataFrame, DataFrame]:
    """Units with ``value``, dealt by ranges of their order to numbered parts, and how many units lie before each part."""
    path = f"{shared_folder(df.sparkSession)}/units-{uuid.uuid4().hex}"
    df.select(*ORDER, value.alias("value")).repartitionByRange(*ORDER).withColumn("part", F.spark_partition_id()).write.parquet(path)
    dealt = df.sparkSession.read.parquet(path)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return dealt, sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def run_codes(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name``_f: the number of a text column's run in unit order, from 1; it changes at every change.

    Units are dealt by ranges of their order. Runs are numbered within each range, and a row
    a range tells where the numbers begin and whether a run goes on from the range before.
    """
    dealt, _ = in_order(df, quoted(name).cast("string"))
    inside = Window.partitionBy("part").orderBy(*ORDER)
    changed = F.coalesce((F.col("value") != F.lag("value").over(inside)).cast("int"), F.lit(0))
    runs = dealt.withColumn("changed", changed).withColumn("run", F.sum("changed").over(inside))
    place = F.struct(*ORDER)
    ends = runs.groupBy("part").agg(F.min_by("value", place).alias("first"), F.max_by("value", place).alias("last"), F.sum("changed").alias("changes"))
    w = Window.orderBy("part")  # a row a range
    onward = F.coalesce((F.col("first") != F.lag("last").over(w)).cast("int"), F.lit(0))
    begins = ends.withColumn("new", onward).select("part", (F.sum("new").over(w) + F.coalesce(F.sum("changes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    told = runs.join(begins, "part").select("ENA_UNIT", (F.col("before") + F.col("run") + 1).cast("double").alias(f"{name}_f"))
    return df.join(told, "ENA_UNIT")


def _hena(units: Units, r: Hena) -> tuple[list[np.ndarray], list[str]]:
    names, df = [], units.df
    for v in [r.x, *([r.y] if r.y else [])]:
        if not units.numeric(v):
            df = run_codes(df, v)
        names.append(v if units.numeric(v) else f"{v}_f")
    units = Units(df, units.edges)
    columns = [quoted(n).cast("double") for n in names]
    if r.centre:
        means = df.agg(*[F.avg(c) for c in columns]).first()
        columns = [c - F.lit(float(m)) for c, m in zip(columns, means, strict=True)]
    design = list(columns)
    for c in r.controls:
        design += [_number(units, c)] if units.numeric(c) else [(quoted(c).cast("string") == v).cast("double") for v in units.levels(c)[1:]]
    if r.interaction and len(columns) == 2:
        design.append(columns[0] * columns[1])
    b = units.coefficients(design)
    x = normalized(b[1])
    if not r.y:
        return [x], [f"x_{names[0]}"]
    return [x, _orthogonal(b[2], x)], [f"x_{names[0]}", f"y_{names[1]}"]


def _spherical(units: Units, r: Spherical) -> tuple[list[np.ndarray], list[str]]:
    def vector(v) -> np.ndarray:  # noqa: ANN001
        if isinstance(v, str):
            return np.eye(len(units.edges))[units.edges.index(v)]
        return normalized(np.asarray(v, float))

    first = vector(r.first)
    second = vector(r.second) if r.second is not None else np.eye(len(units.edges))[0]
    left = second - first * (first @ second)
    found = [first] + ([normalized(left)] if np.linalg.norm(left) > 1e-10 else [])
    return found, [f"SPH{i + 1}" for i in range(len(found))]


def rotate(units: Units, rotation) -> Axes:  # noqa: ANN001
    """A square matrix of axes, leading ones first, their names and eigenvalues."""
    m = units.moments()
    e = len(units.edges)
    if isinstance(rotation, Svd):
        values, vectors = eigen(m.gram)
        return Axes([f"SVD{i + 1}" for i in range(e)], vectors, values / max(1, m.n - 1))
    gram = m.scatter if isinstance(rotation, Mean | Hena) else m.gram
    if isinstance(rotation, Mean):
        leading, names = _mean(units, rotation)
    elif isinstance(rotation, Generalized):
        leading, names = _generalized(units, rotation, gram)
    elif isinstance(rotation, Hena):
        leading, names = _hena(units, rotation)
    elif isinstance(rotation, Spherical):
        leading, names = _spherical(units, rotation)
    elif isinstance(rotation, Regression):
        leading, names = [], []
        for formula in [f for f in (rotation.x, rotation.y) if f]:
            v, name = _regressed(units, formula, names)
            leading.append(v)
            names.append(name)
    else:
        raise TypeError(f"not a rotation: {rotation!r}")
    matrix, k = completed(leading, gram)
    names = [*names, *[f"SVD{i + 1}" for i in range(k, matrix.shape[1])]]
    return Axes(names, matrix, np.einsum("ij,ik,kj->j", matrix, gram, matrix) / max(1, m.n - 1))
