"""Coded rows to edge counts by row, unit or step."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stanzagraph.functions.columns import code_value, label, ordered_code_value, quoted, upper_triangle, weighted
from stanzagraph.spec import AccumulateSpec, Edge
from stanzagraph.operators.vector import row_cells, summed, vectorised
from stanzagraph.streaming.folders import shared_folder


@dataclass
class Accumulation:
    """Lazy results: what isn't asked for is never computed."""

    spec: AccumulateSpec
    edges: list[Edge]
    rows: DataFrame
    counts: DataFrame
    source: DataFrame
    kept: bool = False

    def materialized(self) -> Accumulation:
        """Write the counts to the shared folder once; a model's passes then read units, not rows."""
        if not self.kept:
            spark = self.counts.sparkSession
            path = f"{shared_folder(spark)}/counts-{uuid.uuid4().hex}"
            self.counts.write.parquet(path)
            self.counts, self.kept = spark.read.schema(self.counts.schema).parquet(path), True
            most = self.spec.budget.cells if self.spec.network == "ordered" else None
            if most is not None and self.counts.count() * len(self.edges) > most:
                raise ValueError(f"ordered networks: more than {most} cells")
        return self

    @property
    def edge_names(self) -> list[str]:
        return [e.name for e in self.edges]

    @property
    def trajectories(self) -> DataFrame:
        s = self.spec
        return self.counts.select(*[quoted(c) for c in dict.fromkeys([*s.units, "ENA_UNIT", *s.conversation])])

    def adjacency(self) -> DataFrame:
        rows = [(i, e.source, e.target, e.name, e.source_index, e.target_index) for i, e in enumerate(self.edges)]
        return self.counts.sparkSession.createDataFrame(rows, "edge_id int, source string, target string, name string, source_index int, target_index int")


def _kinds(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def _keys(names, alias: str, legacy: bool, kinds: dict[str, str]) -> list[Column]:  # noqa: ANN001
    return [label(names, kinds)] if legacy else [quoted(n) for n in names]


def ordering(spec: AccumulateSpec) -> Column:
    return F.struct(*[quoted(c) for c in spec.order_by]) if spec.order_by else F.lit(0)


def check_order(df: DataFrame, spec: AccumulateSpec) -> None:
    """One small query: no two rows of a conversation share their order key."""
    keys = [quoted(c) for c in dict.fromkeys([*spec.conversation, *spec.order_by])]
    if df.groupBy(*keys).count().filter("count > 1").take(1):
        raise ValueError("order_by doesn't order the rows of every conversation totally")


def window_cells(spec: AccumulateSpec, codes: list[Column], by: list[Column]) -> tuple[dict[str, Column], dict[str, Column], list[Column]]:
    """Window columns that are needed, sums made of them, and a moving window's cells made of those.

    All frames share one partitioning and order, so the plan has one exchange and one sort.
    Sums that many cells use are columns of their own, so that each is computed once.
    """
    p, order = len(codes), [quoted(c) for c in spec.order_by]
    w = Window.partitionBy(*by).orderBy(*order)
    back = spec.back if spec.back is None or spec.back > 1 else 1
    start = Window.unboundedPreceding if back is None else -(back - 1)
    needed: dict[str, Column] = {}

    def frame(name: str, lo: int, hi: int) -> list[Column]:
        if lo > hi:
            return [F.lit(0.0)] * p
        for i, c in enumerate(codes):
            needed[f"__{name}{i}"] = F.coalesce(F.sum(c).over(w.rowsBetween(lo, hi)), F.lit(0.0))
        return [F.col(f"__{name}{i}") for i in range(p)]

    def earlier(until: int, name: str) -> list[Column]:
        return [F.lit(0.0)] * p if back == 1 else frame(name, start, until)

    before = earlier(-1, "prev") if spec.forward == 0 else []
    own = [F.col(f"__c{i}") for i in range(p)]
    sums: dict[str, Column] = {}

    def kept(name: str, columns: list[Column]) -> list[Column]:
        sums.update({f"__{name}{i}": c for i, c in enumerate(columns)})
        return [F.col(f"__{name}{i}") for i in range(p)]

    if spec.forward == 0:
        before = kept("before", before)
        whole = upper_triangle(kept("whole", [x + c for x, c in zip(before, own, strict=True)]) if back != 1 else own)
        return needed, sums, whole if back == 1 else [a - b for a, b in zip(whole, upper_triangle(before), strict=True)]
    last = Window.unboundedFollowing if spec.forward is None else spec.forward
    after, whole, head = frame("next", 1, last), upper_triangle(frame("whole", 0 if back == 1 else start, last)), None
    if back != 1 and spec.forward is not None:
        # the last rows of a conversation, which lack some of their forward rows, are in no head
        needed["__left"] = F.count(F.lit(1)).over(Window.partitionBy(*by)) - F.row_number().over(w)
        for i in range(p):
            needed[f"__early{i}"] = F.when(F.col("__left") > spec.forward, F.col(f"__c{i}")).otherwise(F.lit(0.0))
            needed[f"__head{i}"] = F.coalesce(F.sum(f"__early{i}").over(w.rowsBetween(start, -1)), F.lit(0.0))
        head = [F.col(f"__head{i}") for i in range(p)]
    tail = upper_triangle(after)
    if head is None:
        return needed, sums, [x - t for x, t in zip(whole, tail, strict=True)]
    return needed, sums, [x - h - t for x, h, t in zip(whole, upper_triangle(head), tail, strict=True)]


def row_edges(df: DataFrame, spec: AccumulateSpec) -> DataFrame:
    """Every input row (or, in a Conversation window, every unit of a conversation) with its edges.

    Adds ENA_UNIT, __order and a column for each edge.
    """
    spec.check(df)
    kinds, p = _kinds(df), len(spec.codes)
    value = code_value if spec.network == "standard" else ordered_code_value
    named = df.withColumns({"ENA_UNIT": label(spec.units, kinds), "__order": ordering(spec)} | {f"__c{i}": value(c, kinds[c]) for i, c in enumerate(spec.codes)})
    codes = [F.col(f"__c{i}") for i in range(p)]
    if spec.window == "Conversation":
        keys = list(dict.fromkeys([*spec.conversation, *spec.units]))
        sums = [F.sum(c).alias(f"__c{i}") for i, c in enumerate(codes)]
        grouped = named.groupBy(*[quoted(k) for k in keys], "ENA_UNIT").agg(*sums, F.min("__order").alias("__order"))
        cells, keep = upper_triangle(codes), [*[quoted(k) for k in keys], F.col("ENA_UNIT"), F.col("__order")]
        made = grouped
    else:
        by = _keys(spec.conversation, "conversation", spec.legacy_display_keys, kinds)
        keep = [*[quoted(c) for c in df.columns], F.col("ENA_UNIT"), F.col("__order")]
        if vectorised(spec):
            made = row_cells(named.drop(*[f"__c{i}" for i in range(p)]), spec, by, [value(c, kinds[c]) for c in spec.codes])
            return made.select(*keep, *[F.col("__cells")[i].alias(e.name) for i, e in enumerate(spec.edges())], "__cells")
        needed, sums, cells = window_cells(spec, codes, by)
        made = named
        for kind in ("__left", "__early"):
            made = made.withColumns({k: c for k, c in needed.items() if k.startswith(kind)})
        rest = {k: c for k, c in needed.items() if not k.startswith(("__left", "__early"))}
        for columns in (rest, {k: c for k, c in sums.items() if k.startswith("__before")}, {k: c for k, c in sums.items() if not k.startswith("__before")}):
            made = made.withColumns(columns) if columns else made
    out = [weighted(x, f, spec.weighting).alias(e.name) for x, f, e in zip(cells, spec.factors(), spec.edges(), strict=True)]
    return made.select(*keep, *out)


def used(df: DataFrame, spec: AccumulateSpec) -> DataFrame:
    """Rows of the units asked for. Only after the windows: other units' rows are context."""
    return df if spec.units_used is None else df.filter(F.col("ENA_UNIT").isin(list(spec.units_used)))


def accumulate(df: DataFrame, spec: AccumulateSpec) -> Accumulation:
    """Edge counts by unit, or by unit and conversation for trajectories.

    counts has the unit columns (and, for trajectories, the conversation columns),
    ENA_UNIT, first_seen (the least order key) and a column for each edge. An accumulated
    trajectory's step has the sums of its unit's steps so far. Sums of ordered networks
    are rounded once. If units_used names no unit that has a row, that is an error.
    """
    if spec.units_used is not None and not df.filter(label(spec.units, _kinds(df)).isin(list(spec.units_used))).take(1):
        raise ValueError(f"units_used: no row has any of these labels: {list(spec.units_used)}")
    rows = row_edges(df, spec)
    return Accumulation(spec, spec.edges(), rows.drop("__cells"), counted(rows, spec, df), df)


def counted(rows: DataFrame, spec: AccumulateSpec, source: DataFrame) -> DataFrame:
    """Counts as accumulate() has them, from rows with ENA_UNIT, __order and edges; ``source`` has the keys' types."""
    edges = spec.edges()
    sums = [F.sum(quoted(e.name)).alias(e.name) for e in edges]
    seen = F.min("__order").alias("first_seen")
    units = [quoted(u) for u in spec.units]
    keep = used(rows, spec)
    if "__cells" in rows.columns and not spec.legacy_display_keys:
        names = list(dict.fromkeys([*spec.units, *(spec.conversation if spec.model != "EndPoint" else [])]))
        made = summed(keep, [*names, "ENA_UNIT"], len(edges))
        counts = made.select(*[quoted(n) for n in names], "ENA_UNIT", "first_seen", *[F.col("__sums")[i].alias(e.name) for i, e in enumerate(edges)])
        return _steps(counts, spec, source)
    if spec.model == "EndPoint":
        keys = [] if spec.legacy_display_keys else units
        shown = [F.min(u).alias(n) for u, n in zip(units, spec.units, strict=True)] if spec.legacy_display_keys else []
        counts = keep.groupBy(*keys, "ENA_UNIT").agg(*shown, seen, *sums)
    else:
        steps = [quoted(c) for c in dict.fromkeys([*spec.units, *spec.conversation])]
        counts = keep.groupBy(*steps, "ENA_UNIT").agg(seen, *sums)
    return _steps(counts, spec, source)


def _steps(counts: DataFrame, spec: AccumulateSpec, source: DataFrame) -> DataFrame:
    """``counts`` by step as the model has them: summed up along their unit, and labelled."""
    if spec.model == "EndPoint":
        return counts
    if spec.model == "AccumulatedTrajectory":
        steps, names = [quoted(c) for c in dict.fromkeys([*spec.units, *spec.conversation])], [e.name for e in spec.edges()]
        so_far = Window.partitionBy(*[quoted(u) for u in spec.units]).orderBy("first_seen", *[quoted(c) for c in spec.conversation]).rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.select(*steps, "ENA_UNIT", "first_seen", *[F.sum(quoted(n)).over(so_far).alias(n) for n in names])
    return counts.withColumn("TRAJ_UNIT", F.concat_ws("::", "ENA_UNIT", label(spec.conversation, _kinds(source))))


def exact_counts(acc: Accumulation) -> DataFrame:
    """EndPoint counts whose sums are rounded once, in any partitioning; for fractional codes."""
    @F.pandas_udf("double")
    def exact(x: pd.Series) -> float:
        return math.fsum(x)

    keep = used(acc.rows, acc.spec)
    return keep.groupBy(*[quoted(u) for u in acc.spec.units], "ENA_UNIT").agg(*[exact(quoted(e.name)).alias(e.name) for e in acc.edges])


def stable_metadata(df: DataFrame, spec: AccumulateSpec) -> list[str]:
    """Metadata columns that don't vary within any unit. One small action."""
    if not spec.metadata or not spec.include_meta:
        return []
    units = [quoted(u) for u in spec.units]
    per_unit = df.groupBy(*units).agg(*[F.countDistinct(F.coalesce(quoted(m).cast("string"), F.lit(""))).alias(f"m{i}") for i, m in enumerate(spec.metadata)])
    most = per_unit.agg(*[F.max(f"m{i}") for i in range(len(spec.metadata))]).first()
    return [m for m, n in zip(spec.metadata, most, strict=True) if n is not None and n <= 1]


def unit_metadata(df: DataFrame, spec: AccumulateSpec) -> DataFrame:
    """ENA_UNIT, the unit columns, and each stable metadata column's first value."""
    kinds, order = _kinds(df), ordering(spec)
    named = df.withColumn("ENA_UNIT", label(spec.units, kinds))
    values = [F.min_by(quoted(m), order).alias(m) for m in stable_metadata(df, spec)]
    grouped = named.groupBy(*[quoted(u) for u in spec.units], "ENA_UNIT")
    return grouped.agg(F.min(order).alias("first_seen"), *values)


def provenance(df: DataFrame, spec: AccumulateSpec, row_id: str) -> DataFrame:
    """For each row of an ordered network: the row before it in its horizon, how many earlier
    rows its window has, and which, oldest first."""
    w = Window.partitionBy(*[quoted(c) for c in spec.conversation]).orderBy(*[quoted(c) for c in spec.order_by])
    lo = Window.unboundedPreceding if spec.back is None else -(spec.back - 1)
    position = F.row_number().over(w) - 1
    count = position if spec.back is None else F.least(position, F.lit(spec.back - 1))
    ids = F.array().cast("array<bigint>") if spec.back == 1 else F.collect_list(quoted(row_id)).over(w.rowsBetween(lo, -1)).cast("array<bigint>")
    return df.select(quoted(row_id), *[quoted(c) for c in spec.conversation], label(spec.conversation, _kinds(df)).alias("horizon_label"), F.lag(quoted(row_id)).over(w).alias("previous"), count.cast("bigint").alias("prior_count"), ids.alias("prior_rows"))


def row_lag_sums(df: DataFrame, columns: list[str], size: int, partition_by: list[str], order_by: list[str]) -> DataFrame:
    """Rolling sums over the last ``size`` rows, this one included; 0 sums nothing."""
    w = Window.partitionBy(*[quoted(c) for c in partition_by]).orderBy(*[quoted(c) for c in order_by])
    if size == 0:
        return df.withColumns({c: F.lit(0.0) for c in columns})
    return df.withColumns({c: F.sum(quoted(c).cast("double")).over(w.rowsBetween(-(size - 1), 0)) for c in columns})
