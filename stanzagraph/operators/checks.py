"""Checks of stored results: what a batch wrote must fit the specification it is read with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stanzagraph.functions.columns import quoted
from stanzagraph.spec import AccumulateSpec


def check_counts(counts: DataFrame, spec: AccumulateSpec) -> None:
    """Edge columns are those of the specification, finite, and units occur once."""
    names = [e.name for e in spec.edges()]
    missing = [n for n in names if n not in counts.columns]
    extra = [c for c in counts.columns if " & " in c and c not in names]
    if missing or extra:
        raise ValueError(f"edge columns don't fit: missing {missing}, unknown {extra}")
    bad = [F.sum((quoted(n).isNull() | F.isnan(quoted(n).cast("double")) | (F.abs(quoted(n)) == float("inf"))).cast("long")) for n in names]
    found = counts.agg(*bad).first()
    wrong = [n for n, k in zip(names, found, strict=True) if k]
    if wrong:
        raise ValueError(f"edges that aren't finite: {wrong}")
    if spec.model == "EndPoint" and counts.groupBy("ENA_UNIT").count().filter("count > 1").take(1):
        raise ValueError("a unit's label occurs more than once")


def check_numbers(rows: DataFrame, spec: AccumulateSpec) -> None:
    """Ordered cells neither overflow nor vanish: names the first edge that does."""
    tests = []
    for e in spec.edges():
        cell, parts = quoted(e.name), [quoted(spec.codes[e.source_index]), quoted(spec.codes[e.target_index])]
        lost = (cell == 0) & (parts[0] > 0) & (parts[1] > 0) if e.source_index != e.target_index and (spec.mask is None or spec.mask[e.source_index][e.target_index] > 0) else F.lit(False)
        tests.append(F.max((F.isnan(cell) | (F.abs(cell) == float("inf")) | lost).cast("int")))
    found = rows.agg(*tests).first()
    wrong = [e.name for e, k in zip(spec.edges(), found, strict=True) if k]
    if wrong:
        raise ValueError(f"edges beyond the range of doubles: {wrong}")


def check_provenance(rows: DataFrame, spec: AccumulateSpec, row_id: str) -> None:
    """A stored provenance table is one chain for each horizon, and its lists follow the chain."""
    keys = [quoted(c) for c in spec.conversation]
    if rows.groupBy(quoted(row_id)).count().filter("count > 1").take(1):
        raise ValueError("a row occurs more than once")
    w = Window.partitionBy(*keys).orderBy(quoted(row_id))
    n = F.row_number().over(w) - 1
    want = n if spec.back is None else F.least(n, F.lit(spec.back - 1))
    faults = rows.select(
        (~F.lag(quoted(row_id)).over(w).eqNullSafe(F.col("previous"))).alias("link"),
        (F.col("prior_count") != want).alias("count"),
        (F.size("prior_rows") != F.col("prior_count")).alias("size"),
        ((F.size("prior_rows") > 0) & ~F.element_at("prior_rows", -1).eqNullSafe(F.col("previous"))).alias("last"),
    ).agg(*[F.max(F.coalesce(F.col(c), F.lit(True)).cast("int")).alias(c) for c in ("link", "count", "size", "last")]).first()
    wrong = [k for k, v in faults.asDict().items() if v]
    if wrong:
        raise ValueError(f"provenance is broken: {wrong}")
