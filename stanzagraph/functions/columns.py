"""Column expressions: codes, keys, products of codes, norms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as a number in a string code. Spark alone would also take 1d.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY = float("inf")


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def code_value(name: str, kind: str) -> Column:
    """A standard code: its number; 0 for null, text and what isn't finite; true is 1."""
    c = quoted(name)
    if kind == "string":
        c = F.when(c.rlike(NUMBER), c)
    v = c.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == INFINITY), F.lit(0.0)).otherwise(v)


def ordered_code_value(name: str, kind: str) -> Column:
    """An ordered code: a finite number from 0; anything else stops the query."""
    c = quoted(name)
    v = (F.when(c.rlike(NUMBER), c) if kind == "string" else c).try_cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == INFINITY) | (v < 0)
    return F.when(bad, F.raise_error(F.lit(f"code {name}: finite numbers from 0 are asked for")).cast("double")).otherwise(v)


def shown(name: str, kind: str) -> Column:
    """A key's text: empty for null, whole doubles without a fraction."""
    c = quoted(name)
    if kind in ("double", "float"):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.coalesce(F.when(whole, c.try_cast("bigint").cast("string")).otherwise(c.cast("string")), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def label(names: Sequence[str], kinds: dict[str, str]) -> Column:
    """Key columns as one text, joined by ::."""
    return F.concat_ws("::", *[shown(n, kinds[n]) for n in names])


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def upper_triangle(values: Sequence[Column]) -> list[Column]:
    """Products of each two values, in the order of adjacency()."""
    return [values[j] * values[i] for i in range(1, len(values)) for j in range(i)]


def co_occurrences(values: Sequence[Column], binary: bool = True) -> list[Column]:
    """A row's own co-occurrences."""
    return [F.when(x > 0, 1.0).otherwise(0.0) if binary else x for x in upper_triangle(values)]


def _scale(columns: Sequence[Column]) -> Column:
    """The power of two at or just below the largest entry's size; 0 if all are 0."""
    top = F.greatest(*[F.abs(c) for c in columns]) if len(columns) > 1 else F.abs(columns[0])
    return F.when(top == 0, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), F.least(F.floor(F.log2(top)), F.lit(1023)).cast("double")))


def sphere_norm(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """``df`` with helper columns, and its columns ``names`` on the unit sphere of their row.

    A zero row stays zero. Rows are scaled by a power of two near their largest entry, so that
    no square overflows and no scaling rounds: 3 over the norm 10 is 0.3. Scale and norm are
    columns of their own: inlined, the expression would grow with the square of the edges and
    leave generated code.
    """
    columns = [quoted(n) for n in names]
    scaled = df.withColumn("__top", _scale(columns))
    scaled = scaled.withColumn("__norm", F.sqrt(total([F.try_divide(c, F.col("__top")) * F.try_divide(c, F.col("__top")) for c in columns])))
    return scaled, [F.when(F.col("__top") == 0, F.lit(0.0)).otherwise(c / F.col("__top") / F.col("__norm")) for c in columns]


def l2_norm(columns: Sequence[Column]) -> Column:
    top = _scale(columns)
    return F.when(top == 0, F.lit(0.0)).otherwise(top * F.sqrt(total([F.try_divide(c, top) * F.try_divide(c, top) for c in columns])))


def weighted(cell: Column, factor: float, weighting) -> Column:  # noqa: ANN001
    """A cell after threshold, mask and weight, in this order."""
    if weighting == "binary":
        cell = F.when(cell > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    if factor == 0:
        cell = F.lit(0.0)
    elif factor != 1:
        cell = cell * F.lit(factor)
    return weighting(cell) if callable(weighting) else cell
