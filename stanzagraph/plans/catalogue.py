"""The engine's queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stanzagraph.functions.columns import co_occurrences, quoted
from stanzagraph.functions.linalg import moments
from stanzagraph.functions.rotations import Generalized, Hena, Mean, Regression, Spherical
from stanzagraph.operators import stats
from stanzagraph.operators.accumulate import accumulate, provenance, row_lag_sums, unit_metadata, used
from stanzagraph.operators.graph import network_edges
from stanzagraph.operators.model import ena, fit, has_signal, line_weights, skip_sphere_norm
from stanzagraph.plans import inputs
from stanzagraph.spec import AccumulateSpec, adjacency, ordered_adjacency


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}
CODES = inputs.EVENT_CODES
MASK = [[0.0 if i == j else float(1 + (i + 2 * j) % 3) if (i + j) % 4 else 0.0 for j in range(len(CODES))] for i in range(len(CODES))]
EVENTS = AccumulateSpec(units=["user_id"], conversation=["user_id"], codes=CODES, order_by=["event_id"], metadata=["parity"], back=4)


def safe(name: str) -> str:
    return name.replace(" & ", "_")


def plain(df: DataFrame, keep: list[str], names: list[str], digits: int | None = None) -> DataFrame:
    """Keys and edges under names that SQL needs no quotes for."""
    value = (lambda c: F.round(c, digits) + F.lit(0.0)) if digits is not None else (lambda c: c + F.lit(0.0))
    return df.select(*[quoted(k) for k in keep], *[value(quoted(n)).alias(safe(n)) for n in names])


# --- SQL texts ---------------------------------------------------------------------------


def _frame(codes: list[str], name: str, lo: str, hi: str, by: str, order: str) -> str:
    return ", ".join(f"coalesce(sum({c}) OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {lo} AND {hi}), 0) AS {name}{i}" for i, c in enumerate(codes))


def _tri(terms: list[str]) -> list[str]:
    return [f"({terms[j]}) * ({terms[i]})" for i in range(1, len(terms)) for j in range(i)]


def moving_sql(table: str, codes: list[str], back: int | None, forward: int | None, by: str, order: str, wrap: Callable[[str, int], str]) -> str:
    """The CTE ``re``: the table's rows with a column for each edge."""
    p, lo = len(codes), "UNBOUNDED PRECEDING" if back is None else f"{back - 1} PRECEDING"
    parts = [_frame(codes, "p", lo, "1 PRECEDING", by, order)] if back != 1 else [", ".join(f"0.0::DOUBLE AS p{i}" for i in range(p))]
    prev = [f"p{i}" for i in range(p)]
    tail = None
    if forward != 0:
        hi = "UNBOUNDED FOLLOWING" if forward is None else f"{forward} FOLLOWING"
        parts.append(_frame(codes, "n", "1 FOLLOWING", hi, by, order))
        tail = [f"n{i}" for i in range(p)]
    head = prev if forward == 0 else None
    if forward and back != 1:
        parts.append(f"{forward} - least({forward}, count(*) OVER (PARTITION BY {by}) - row_number() OVER (PARTITION BY {by} ORDER BY {order})) AS short")
        for s in range(forward + 1):
            if back is None or back - 1 >= 1 + s:
                parts.append(_frame(codes, f"h{s}_", lo, f"{1 + s} PRECEDING", by, order))
            else:
                parts.append(", ".join(f"0.0::DOUBLE AS h{s}_{i}" for i in range(p)))
        head = ["CASE short " + " ".join(f"WHEN {s} THEN h{s}_{i}" for s in range(forward + 1)) + " END" for i in range(p)]
    whole = _tri([f"{prev[i]} + {codes[i]}" + (f" + {tail[i]}" if tail else "") for i in range(p)])
    cells = [w + (f" - {h}" if h else "") + (f" - {t}" if t else "") for w, h, t in zip(whole, _tri(head) if head else [""] * len(whole), _tri(tail) if tail else [""] * len(whole), strict=True)]
    names = [safe(e.name) for e in adjacency(codes)]
    return f"wi AS (SELECT *, {', '.join(parts)} FROM {table}), re AS (SELECT *, " + ", ".join(f"{wrap(c, k)} AS {n}" for k, (c, n) in enumerate(zip(cells, names, strict=True))) + " FROM wi)"


def binary_sql(cell: str, k: int = 0) -> str:
    return f"CASE WHEN {cell} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def sum_sql(cell: str, k: int = 0) -> str:
    return cell


def ordered_sql(table: str, codes: list[str], back: int | None, by: str, order: str, mask=None) -> str:  # noqa: ANN001
    lo = "UNBOUNDED PRECEDING" if back is None else f"{back - 1} PRECEDING"
    p = len(codes)
    prev = _frame(codes, "p", lo, "1 PRECEDING", by, order) if back != 1 else ", ".join(f"0.0::DOUBLE AS p{i}" for i in range(p))
    cells = []
    for e in ordered_adjacency(codes):
        half = f" + 0.5::DOUBLE * {e.source} * {e.target}" if e.source != e.target else ""
        factor = "" if mask is None else f" * {mask[e.source_index][e.target_index]}::DOUBLE"
        cells.append(f"(p{e.source_index} * {e.target}{half}){factor} AS {safe(e.name)}")
    return f"wi AS (SELECT *, {prev} FROM {table}), re AS (SELECT *, {', '.join(cells)} FROM wi)"


def sums_sql(names: list[str], keys: str) -> str:
    return f"SELECT {keys}, " + ", ".join(f"CAST(sum({n}) AS DOUBLE) + 0e0 AS {n}" for n in names) + f" FROM re GROUP BY {keys}"


NAMES = [safe(e.name) for e in adjacency(CODES)]
EDGES = [e.name for e in adjacency(CODES)]
#: ev, re, ac (counts by user) and lw (their line weights) of the usual accumulation.
AC = f"WITH {inputs.EVENTS_SQL}, {moving_sql('ev', CODES, 4, 0, 'user_id', 'event_id', binary_sql)}, ac AS ({sums_sql(NAMES, 'user_id, parity')})"
NORM = "sqrt(" + " + ".join(f"{n} * {n}" for n in NAMES) + ")"
SIGNAL = " + ".join(NAMES) + " <> 0"
LW = AC + f", nm AS (SELECT *, {NORM} AS norm, {SIGNAL} AS signal FROM ac), lw AS (SELECT user_id, parity, signal, " + ", ".join(f"CASE WHEN norm = 0 THEN 0 ELSE {n} / norm END AS {n}" for n in NAMES) + " FROM nm)"
CE = LW + ", mu AS (SELECT " + ", ".join(f"avg({n}) AS m_{n}" for n in NAMES) + " FROM lw WHERE signal), ce AS (SELECT user_id, parity, " + ", ".join(f"CASE WHEN signal THEN {n} - m_{n} ELSE 0 END AS {n}" for n in NAMES) + " FROM lw, mu)"
#: pt: each user's place on the first spherical axis, which is its first centred edge.
PT = CE + f", pt AS (SELECT user_id, parity, {NAMES[0]} AS x, {NAMES[1]} AS y FROM ce)"


def rounded(names: list[str], keys: str = "") -> str:
    return keys + ", ".join(f"round({n}, 9) + 0e0 AS {n}" for n in names)


# --- accumulation ------------------------------------------------------------------------


def _accumulated(spec: AccumulateSpec, digits: int | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: plain(accumulate(inputs.events(spark, d), spec).counts, ["user_id"], EDGES, digits)


def _events_query(name: str, back: int | None, forward: int | None = 0, weight: str = "binary") -> None:
    wrap = binary_sql if weight == "binary" else sum_sql
    sql = f"WITH {inputs.EVENTS_SQL}, {moving_sql('ev', CODES, back, forward, 'user_id', 'event_id', wrap)} {sums_sql(NAMES, 'user_id')}"
    QUERIES[name] = Query(_accumulated(replace(EVENTS, back=back, forward=forward, weight=weight)), sql)


for _name, _args in {
    "acc_binary_b4": (4,), "acc_sum_b4": (4, 0, "sum"), "acc_backinf": (None,), "acc_b1": (1,), "acc_b2_sum": (2, 0, "sum"), "acc_b200": (200, 0, "sum"),
    "acc_forward1": (2, 1), "acc_forward3": (4, 3, "sum"), "acc_forward_only": (1, 2), "acc_forward_inf": (3, None, "sum"), "acc_backinf_forward2": (None, 2, "sum"), "acc_forward3_b2": (2, 3),
}.items():
    _events_query(_name, *_args)


def _wide_forward(spark: SparkSession, d: str) -> DataFrame:
    return plain(accumulate(inputs.events(spark, d), replace(EVENTS, back=3, forward=20, weight="sum")).counts, ["user_id"], EDGES)


QUERIES["acc_forward20"] = Query(_wide_forward, f"WITH {inputs.EVENTS_SQL}, {moving_sql('ev', CODES, 3, 20, 'user_id', 'event_id', sum_sql)} {sums_sql(NAMES, 'user_id')}")

#: Codes of very different size, whose sums a double holds exactly in any order.
SIZED = dict(zip(CODES, [0.25, 1048576.0, 0.5, 33554432.0, 0.125, 3.0], strict=True))
SIZED_SQL = "ev AS (SELECT * REPLACE (" + ", ".join(f"{c} * {x}::DOUBLE AS {c}" for c, x in SIZED.items()) + ") FROM e0)"


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return inputs.events(spark, d).withColumns({c: F.col(c) * x for c, x in SIZED.items()})


for _name, _args in {"sized_b200": (200, 0, "sum"), "sized_forward20": (3, 20, "sum"), "sized_binary_forward20": (200, 20, "binary")}.items():
    _wrap = binary_sql if _args[2] == "binary" else sum_sql
    QUERIES[_name] = Query(
        lambda spark, d, a=_args: plain(accumulate(_sized(spark, d), replace(EVENTS, back=a[0], forward=a[1], weight=a[2])).counts, ["user_id"], EDGES),
        f"WITH {inputs.EVENTS_SQL.replace('ev AS', 'e0 AS', 1)}, {SIZED_SQL}, {moving_sql('ev', CODES, _args[0], _args[1], 'user_id', 'event_id', _wrap)} {sums_sql(NAMES, 'user_id')}",
    )

_factor = [MASK[e.source_index][e.target_index] for e in adjacency(CODES)]
QUERIES["acc_mask"] = Query(_accumulated(replace(EVENTS, mask=MASK)), f"WITH {inputs.EVENTS_SQL}, {moving_sql('ev', CODES, 4, 0, 'user_id', 'event_id', lambda c, k: f'({binary_sql(c)}) * {_factor[k]}::DOUBLE')} {sums_sql(NAMES, 'user_id')}")
QUERIES["acc_weight_sqrt"] = Query(
    _accumulated(replace(EVENTS, weight=F.sqrt), 9),
    f"WITH {inputs.EVENTS_SQL}, {moving_sql('ev', CODES, 4, 0, 'user_id', 'event_id', lambda c, k: f'sqrt({c})')}, su AS ({sums_sql(NAMES, 'user_id')}) SELECT {rounded(NAMES, 'user_id, ')} FROM su",
)

_DAY = replace(EVENTS, conversation=["day"])


def _units_used(spark: SparkSession, d: str) -> DataFrame:
    return plain(accumulate(inputs.events(spark, d), replace(_DAY, units_used=["3", "7", "11", "20"])).counts, ["user_id"], EDGES)


_DAY_ROWS = f"WITH {inputs.EVENTS_SQL}, {moving_sql('ev', CODES, 4, 0, 'day', 'event_id', binary_sql)}"
QUERIES["acc_units_used"] = Query(_units_used, f"SELECT * FROM ({_DAY_ROWS} {sums_sql(NAMES, 'user_id')}) WHERE user_id IN (3, 7, 11, 20)")
QUERIES["acc_shared_horizon"] = Query(lambda spark, d: plain(accumulate(inputs.events(spark, d), _DAY).counts, ["user_id"], EDGES), f"{_DAY_ROWS} {sums_sql(NAMES, 'user_id')}")
QUERIES["row_edges"] = Query(lambda spark, d: plain(used(accumulate(inputs.events(spark, d), _DAY).rows, _DAY), ["event_id", "user_id"], EDGES), f"{_DAY_ROWS} SELECT event_id, user_id, {', '.join(NAMES)} FROM re")

_LINES = AccumulateSpec(units=["l_suppkey"], conversation=["l_orderkey"], codes=inputs.LINE_CODES, window="Conversation")
_LINE_EDGES = [e.name for e in adjacency(inputs.LINE_CODES)]
_LINE_SUMS = ", ".join(f"sum({c}) AS {c}" for c in inputs.LINE_CODES)
for _name, _weight, _wrap in (("acc_conversation", "binary", binary_sql), ("acc_conversation_sum", "sum", sum_sql)):
    _cells = ", ".join(f"{_wrap(c)} AS {safe(n)}" for c, n in zip(_tri(inputs.LINE_CODES), _LINE_EDGES, strict=True))
    QUERIES[_name] = Query(
        lambda spark, d, w=_weight: plain(accumulate(inputs.lines(spark, d), replace(_LINES, weight=w)).counts, ["l_suppkey"], _LINE_EDGES),
        f"WITH {inputs.LINES_SQL}, gr AS (SELECT l_orderkey, l_suppkey, {_LINE_SUMS} FROM li GROUP BY 1, 2), re AS (SELECT *, {_cells} FROM gr) {sums_sql([safe(n) for n in _LINE_EDGES], 'l_suppkey')}",
    )

_ORDERS = AccumulateSpec(units=["o_custkey"], conversation=["o_custkey"], codes=inputs.ORDER_CODES, order_by=["o_orderdate", "o_orderkey"], metadata=["segment"], back=3)
_ORDER_EDGES = [e.name for e in adjacency(inputs.ORDER_CODES)]
_ORDER_SQL = f"WITH {inputs.ORDERS_SQL}, {moving_sql('od', inputs.ORDER_CODES, 3, 0, 'o_custkey', 'o_orderdate, o_orderkey', binary_sql)}, ac AS ({sums_sql([safe(n) for n in _ORDER_EDGES], 'o_custkey, segment')})"
QUERIES["acc_orders_b3"] = Query(lambda spark, d: plain(accumulate(inputs.orders(spark, d), _ORDERS).counts, ["o_custkey"], _ORDER_EDGES), f"{_ORDER_SQL} SELECT * EXCLUDE (segment) FROM ac")

QUERIES["ref_lag"] = Query(
    lambda spark, d: row_lag_sums(inputs.events(spark, d), CODES, 3, ["user_id"], ["event_id"]).select("event_id", *CODES),
    f"WITH {inputs.EVENTS_SQL} SELECT event_id, " + ", ".join(f"sum({c}) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS {c}" for c in CODES) + " FROM ev",
)
QUERIES["co_occurrences"] = Query(
    lambda spark, d: inputs.events(spark, d).select("event_id", *[x.alias(n) for x, n in zip(co_occurrences([F.col(c) for c in CODES]), NAMES, strict=True)]),
    f"WITH {inputs.EVENTS_SQL} SELECT event_id, " + ", ".join(f"{binary_sql(c)} AS {n}" for c, n in zip(_tri(CODES), NAMES, strict=True)) + " FROM ev",
)


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    """parity is stable in every user and stays; day varies and goes."""
    out = unit_metadata(inputs.events(spark, d), replace(EVENTS, metadata=["parity", "day"]))
    return out.select("user_id", "ENA_UNIT", *[c for c in out.columns if c in ("parity", "day")], F.col("first_seen.event_id").alias("first_event"))


QUERIES["meta_stable"] = Query(_metadata, f"WITH {inputs.EVENTS_SQL} SELECT user_id, CAST(user_id AS VARCHAR) AS \"ENA_UNIT\", min(parity) AS parity, min(event_id) AS first_event FROM ev GROUP BY user_id")

_STEPS = f"{_DAY_ROWS}, st AS (SELECT user_id, day, min(event_id) AS seen, " + ", ".join(f"sum({n}) AS {n}" for n in NAMES) + " FROM re GROUP BY 1, 2)"


def _trajectory(model: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: plain(accumulate(inputs.events(spark, d), replace(_DAY, model=model)).counts, ["user_id", "day", "TRAJ_UNIT"], EDGES)


QUERIES["traj_separate"] = Query(_trajectory("SeparateTrajectory"), f"{_STEPS} SELECT user_id, day, user_id || '::' || day AS \"TRAJ_UNIT\", {', '.join(f'{n} + 0e0 AS {n}' for n in NAMES)} FROM st")
QUERIES["traj_accumulated"] = Query(_trajectory("AccumulatedTrajectory"), f"{_STEPS} SELECT user_id, day, user_id || '::' || day AS \"TRAJ_UNIT\", " + ", ".join(f"sum({n}) OVER (PARTITION BY user_id ORDER BY seen) + 0e0 AS {n}" for n in NAMES) + " FROM st")

# --- ordered networks --------------------------------------------------------------------

_ORDERED = replace(EVENTS, network="ordered")
_ORDERED_EDGES = [e.name for e in ordered_adjacency(CODES)]
for _name, _back, _mask in (("ordered_b1", 1, None), ("ordered_b4", 4, None), ("ordered_binf", None, None), ("ordered_mask", 4, MASK)):
    QUERIES[_name] = Query(
        lambda spark, d, b=_back, m=_mask: plain(accumulate(inputs.events(spark, d), replace(_ORDERED, back=b, mask=m)).counts, ["user_id"], _ORDERED_EDGES),
        f"WITH {inputs.EVENTS_SQL}, {ordered_sql('ev', CODES, _back, 'user_id', 'event_id', _mask)} {sums_sql([safe(n) for n in _ORDERED_EDGES], 'user_id')}",
    )


QUERIES["ordered_sized"] = Query(
    lambda spark, d: plain(accumulate(_sized(spark, d), replace(_ORDERED, back=200)).counts, ["user_id"], _ORDERED_EDGES),
    f"WITH {inputs.EVENTS_SQL.replace('ev AS', 'e0 AS', 1)}, {SIZED_SQL}, {ordered_sql('ev', CODES, 200, 'user_id', 'event_id')} {sums_sql([safe(n) for n in _ORDERED_EDGES], 'user_id')}",
)


def _provenance(spark: SparkSession, d: str) -> DataFrame:
    return provenance(inputs.events(spark, d), _ORDERED, "event_id").select("event_id", F.col("horizon_label").alias("horizon"), "previous", "prior_count")


_OVER = "(PARTITION BY user_id ORDER BY event_id)"
QUERIES["ordered_provenance"] = Query(_provenance, f"SELECT event_id, CAST(user_id AS VARCHAR) AS horizon, lag(event_id) OVER {_OVER} AS previous, least(row_number() OVER {_OVER} - 1, 3) AS prior_count FROM events")
QUERIES["ordered_prior_rows"] = Query(
    lambda spark, d: provenance(inputs.events(spark, d), _ORDERED, "event_id").select("event_id", F.concat_ws(",", F.transform("prior_rows", lambda x: x.cast("string"))).alias("prior_rows")),
    "SELECT event_id, concat_ws(',', " + ", ".join(f"lag(event_id, {k}) OVER {_OVER}" for k in (3, 2, 1)) + ") AS prior_rows FROM events",
)

# --- norms, centre, rotations ------------------------------------------------------------


def _fitted(spark: SparkSession, d: str, rotation=None, spec: AccumulateSpec = EVENTS, rows: DataFrame | None = None, nodes: bool = False):  # noqa: ANN001, ANN202
    rows = inputs.events(spark, d) if rows is None else rows
    acc = accumulate(rows, spec)
    return acc, fit(acc, rotation, metadata=unit_metadata(rows, spec), nodes=nodes)


QUERIES["line_weights"] = Query(lambda spark, d: plain(line_weights(accumulate(inputs.events(spark, d), EVENTS).counts, EDGES), ["user_id"], EDGES, 9), f"{LW} SELECT {rounded(NAMES, 'user_id, ')} FROM lw")
QUERIES["skip_norm"] = Query(lambda spark, d: plain(skip_sphere_norm(accumulate(inputs.events(spark, d), EVENTS).counts, EDGES), ["user_id"], EDGES, 9), f"{AC}, tp AS (SELECT max({NORM}) AS t FROM ac) SELECT user_id, {', '.join(f'round({n} / t, 9) + 0e0 AS {n}' for n in NAMES)} FROM ac, tp")


def _center(spark: SparkSession, d: str) -> DataFrame:
    counts = accumulate(inputs.events(spark, d), EVENTS).counts
    return line_weights(counts.filter(has_signal(EDGES)), EDGES).agg(*[(F.round(F.avg(quoted(e)), 9) + F.lit(0.0)).alias(safe(e)) for e in EDGES])


QUERIES["center_vector"] = Query(_center, f"{CE} SELECT {', '.join(f'round(m_{n}, 9) + 0e0 AS {n}' for n in NAMES)} FROM mu")


def _centred(spark: SparkSession, d: str) -> DataFrame:
    acc, model = _fitted(spark, d)
    return model.centred(acc.counts).select("user_id", *[(F.round(F.col("centred")[i], 9) + F.lit(0.0)).alias(n) for i, n in enumerate(NAMES)])


QUERIES["centered"] = Query(_centred, f"{CE} SELECT {rounded(NAMES, 'user_id, ')} FROM ce")


def _invariants(spark: SparkSession, d: str) -> DataFrame:
    acc, model = _fitted(spark, d)
    values = model.axes.eigenvalues
    n = acc.counts.count()
    return spark.range(1).select(F.lit(n).cast("long").alias("n"), F.round(F.lit(float(values.sum())), 9).alias("trace"), F.round(F.lit(float((values**2).sum())), 9).alias("squares"))


_gram2 = " + ".join(f"power(sum({a} * {b}), 2)" for a in NAMES for b in NAMES)
QUERIES["svd_invariants"] = Query(_invariants, f"{CE} SELECT count(*) AS n, round(sum({' + '.join(f'{n} * {n}' for n in NAMES)}) / (count(*) - 1), 9) AS trace, round(({_gram2}) / power(count(*) - 1, 2), 9) AS squares FROM ce")


def _points(spark: SparkSession, d: str, rotation=None, **more) -> DataFrame:  # noqa: ANN001, ANN003
    acc, model = _fitted(spark, d, rotation, **more)
    return model.points(acc.counts).select("user_id", *[quoted(n).alias(f"axis_{i + 1}") for i, n in enumerate(model.shown)])


def _first_axis(rotation) -> Callable[[SparkSession, str], DataFrame]:  # noqa: ANN001
    return lambda spark, d: _points(spark, d, rotation).select("user_id", (F.round("axis_1", 9) + F.lit(0.0)).alias("axis_1"))


def _direction_sql(weights: list[str], source: str) -> str:
    """Points along a direction whose parts are the expressions ``weights`` over ``source``."""
    names = [f"d_{n}" for n in NAMES]
    size = "sqrt(" + " + ".join(f"{x} * {x}" for x in names) + ")"
    return f"{CE}, di AS (SELECT {', '.join(f'{w} AS {x}' for w, x in zip(weights, names, strict=True))} FROM {source}) SELECT user_id, round(({' + '.join(f'{n} * {x}' for n, x in zip(NAMES, names, strict=True))}) / {size}, 9) + 0e0 AS axis_1 FROM ce, di"


QUERIES["svd_points"] = Query(_points)
QUERIES["mean_rotation_mr1"] = Query(_first_axis(Mean([("parity = 0", "parity = 1")])), _direction_sql([f"avg({n}) FILTER (WHERE parity = 0) - avg({n}) FILTER (WHERE parity = 1)" for n in NAMES], "ce"))
_slopes = _direction_sql([f"regr_slope({n}, parity)" for n in NAMES], "ce")
QUERIES["regression_x"] = Query(_first_axis(Regression("V ~ parity")), _slopes)
QUERIES["generalized_rr1"] = Query(_first_axis(Generalized("parity")), _slopes)
QUERIES["hena_x"] = Query(_first_axis(Hena("parity")), _slopes)
QUERIES["spherical_sph1"] = Query(_first_axis(Spherical(EDGES[0], EDGES[1])), f"{PT} SELECT user_id, round(x, 9) + 0e0 AS axis_1 FROM pt")


def _regression2(spark: SparkSession, d: str) -> DataFrame:
    """A user's days are the units, so that there are more of them than edges in every table."""
    acc, model = _fitted(spark, d, Regression("parity ~ V"), spec=replace(EVENTS, units=["user_id", "day"]))
    return model.points(acc.counts).select("user_id", "day", *[quoted(n).alias(f"axis_{i + 1}") for i, n in enumerate(model.shown)])


QUERIES["regression2"] = Query(_regression2)
QUERIES["generalized_select2"] = Query(_first_axis(Generalized("parity", select2=("parity = 0", "parity = 1"))), QUERIES["mean_rotation_mr1"].sql)


def _ena(spark: SparkSession, d: str) -> DataFrame:
    acc, model = ena(inputs.events(spark, d), EVENTS, Spherical(EDGES[0], EDGES[1]))
    return model.points(acc.counts).select("user_id", *[(F.round(n, 9) + F.lit(0.0)).alias(n) for n in ("SPH1", "SPH2")])


QUERIES["ena_points"] = Query(_ena, f'{PT} SELECT user_id, round(x, 9) + 0e0 AS "SPH1", round(y, 9) + 0e0 AS "SPH2" FROM pt')


def _generalized_segment(spark: SparkSession, d: str) -> DataFrame:
    acc, model = _fitted(spark, d, Generalized("segment"), _ORDERS, inputs.orders(spark, d))
    return model.points(acc.counts).select("o_custkey", *[quoted(n).alias(f"axis_{i + 1}") for i, n in enumerate(model.shown)])


QUERIES["generalized_segment"] = Query(_generalized_segment)


def _shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of two axes that are edges, and of all axes together."""
    acc, model = _fitted(spark, d, Spherical(EDGES[0], EDGES[1]))
    shares = model.variance(acc.counts)
    rows = [(n, round(shares[n], 9) + 0.0) for n in ("SPH1", "SPH2")] + [("all", round(sum(shares.values()), 9))]
    return spark.createDataFrame(rows, "axis string, share double")


_trace = " + ".join(f"var_samp({n})" for n in NAMES)
QUERIES["variance_shares"] = Query(_shares, f"{CE}, sh AS (SELECT var_samp({NAMES[0]}) / ({_trace}) AS a, var_samp({NAMES[1]}) / ({_trace}) AS b FROM ce) SELECT 'SPH1' AS axis, round(a, 9) + 0e0 AS share FROM sh UNION ALL SELECT 'SPH2', round(b, 9) + 0e0 FROM sh UNION ALL SELECT 'all', 1.0::DOUBLE")


def _axis_spread(spark: SparkSession, d: str) -> DataFrame:
    """Points on SVD axes: each axis' variance is its eigenvalue, and axes don't correlate; counted axes that hold to it."""
    acc, model = _fitted(spark, d)
    e = len(EDGES)
    scatter = moments(model.points(acc.counts), F.col("all_points"), e)
    spread = scatter.scatter / max(1, scatter.n - 1)
    held = int((abs(spread - np.diag(model.axes.eigenvalues)).max(axis=1) < 1e-9).sum())
    return spark.createDataFrame([(held, bool((np.diff(model.axes.eigenvalues) <= 1e-12).all()))], "axes int, descending boolean")


QUERIES["svd_axes"] = Query(_axis_spread, f"SELECT {len(EDGES)} AS axes, true AS descending")


def _ordered_points(spark: SparkSession, d: str) -> DataFrame:
    acc, model = _fitted(spark, d, spec=_ORDERED, nodes=True)
    return model.points(acc.counts).select("user_id", *[quoted(n).alias(f"axis_{i + 1}") for i, n in enumerate(model.shown)])


QUERIES["ordered_points"] = Query(_ordered_points)


def _node_weights(spec: AccumulateSpec) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        acc, model = _fitted(spark, d, spec=spec)
        return model.weights(acc.counts).select("user_id", *[(F.round(F.col("weights")[i], 9) + F.lit(0.0)).alias(c) for i, c in enumerate(CODES)])

    return run


def _node_sql(head: str, edges: list, share: str) -> str:
    norm = "sqrt(" + " + ".join(f"{safe(e.name)} * {safe(e.name)}" for e in edges) + ")"
    ends = {c: " + ".join(f"{share} * {safe(e.name)}" if e.source != e.target else safe(e.name) for e in edges if c in (e.source, e.target)) for c in CODES}
    raw = f"{head}, nn AS (SELECT *, {norm} AS norm FROM ac), nw AS (SELECT user_id, {', '.join(f'CASE WHEN norm = 0 THEN 0 ELSE ({x}) / norm END AS {c}' for c, x in ends.items())} FROM nn)"
    size = "greatest(0.0001, " + " + ".join(f"abs({c})" for c in CODES) + ")"
    return f"{raw} SELECT user_id, {', '.join(f'round({c} / {size}, 9) + 0e0 AS {c}' for c in CODES)} FROM nw"


QUERIES["node_weights_undirected"] = Query(_node_weights(EVENTS), _node_sql(AC, adjacency(CODES), "0.5"))
QUERIES["node_weights_directed"] = Query(_node_weights(_ORDERED), _node_sql(f"WITH {inputs.EVENTS_SQL}, {ordered_sql('ev', CODES, 4, 'user_id', 'event_id')}, ac AS ({sums_sql([safe(n) for n in _ORDERED_EDGES], 'user_id')})", ordered_adjacency(CODES), "1"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d, nodes=True)[1].node_table(spark)


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    acc, model = _fitted(spark, d, nodes=True)
    return model.centroids(acc.counts)


def _project_in(spark: SparkSession, d: str) -> DataFrame:
    """Even users' space, all users in it."""
    rows = inputs.events(spark, d)
    _, model = _fitted(spark, d, Spherical(EDGES[0], EDGES[1]), rows=rows.filter("parity = 0"))
    return model.transform(accumulate(rows, EVENTS)).select("user_id", *[(F.round(quoted(n), 9) + F.lit(0.0)).alias(f"axis_{i + 1}") for i, n in enumerate(model.shown)])


QUERIES |= {"node_positions": Query(_nodes), "centroids": Query(_centroids)}
QUERIES["project_in"] = Query(_project_in, f"{LW}, mu AS (SELECT avg({NAMES[0]}) AS a, avg({NAMES[1]}) AS b FROM lw WHERE signal AND parity = 0) SELECT user_id, round(CASE WHEN signal THEN {NAMES[0]} - a ELSE 0 END, 9) + 0e0 AS axis_1, round(CASE WHEN signal THEN {NAMES[1]} - b ELSE 0 END, 9) + 0e0 AS axis_2 FROM lw, mu")


def _node_fit(spark: SparkSession, d: str) -> DataFrame:
    """Normal equations of the nodes' places: what they leave of the points doesn't correlate with any code's weight."""
    acc, model = _fitted(spark, d, Spherical(EDGES[0], EDGES[1]), nodes=True)
    p = len(CODES)
    both = model.weights(acc.counts).select("ENA_UNIT", "weights", F.slice("centred", 1, 2).alias("point"))
    m = moments(both, F.concat("weights", "point"), p + 2)
    left = m.gram[:p, p:] - m.gram[:p, :p] @ model.nodes
    return spark.createDataFrame([(int((abs(left) < 1e-6 * max(1, m.n)).all(axis=1).sum()), m.n)], "codes int, units long")


QUERIES["node_fit"] = Query(_node_fit, f"SELECT {len(CODES)} AS codes, count(DISTINCT user_id) AS units FROM events")

# --- statistics --------------------------------------------------------------------------


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """user_id, parity, x and y: the two axes of a spherical rotation."""
    rows = inputs.events(spark, d)
    acc, model = _fitted(spark, d, Spherical(EDGES[0], EDGES[1]), rows=rows)
    points = model.points(acc.counts).select("user_id", "ENA_UNIT", "first_seen", quoted("SPH1").alias("x"), quoted("SPH2").alias("y"))
    return points.join(unit_metadata(rows, EVENTS).select("user_id", "parity"), "user_id")


def _round(c: str) -> Column:
    return (F.round(c, 9) + F.lit(0.0)).alias(c)


_G = f"{PT}, g AS (SELECT parity, count(x) AS n, avg(x) AS m, var_samp(x) AS v FROM pt GROUP BY 1), a AS (SELECT * FROM g WHERE parity = 0), b AS (SELECT * FROM g WHERE parity = 1)"
QUERIES["group_summary"] = Query(lambda spark, d: stats.group_summary(_placed(spark, d), "parity", ["x", "y"]).select("group", "n", _round("x"), _round("y")), f"{PT} SELECT CAST(parity AS VARCHAR) AS \"group\", count(*) AS n, round(avg(x), 9) + 0e0 AS x, round(avg(y), 9) + 0e0 AS y FROM pt GROUP BY 1")
_DIM = "SELECT '{d}' AS dimension, count(*) AS n, round(avg({d}), 9) + 0e0 AS mean, round(stddev_samp({d}), 9) AS sd, round(var_samp({d}), 9) AS variance, round(min({d}), 9) AS min, round(max({d}), 9) AS max FROM pt"
QUERIES["dimension_summary"] = Query(lambda spark, d: stats.dimension_summary(_placed(spark, d), ["x", "y"]).select("dimension", "n", *[_round(c) for c in ("mean", "sd", "variance", "min", "max")]), f"{PT} {_DIM.format(d='x')} UNION ALL {_DIM.format(d='y')}")
QUERIES["cohens_d"] = Query(lambda spark, d: stats.cohens_d(_placed(spark, d), "parity", "x").select(_round("d")), f"{_G} SELECT round(abs(a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 9) AS d FROM a, b")
QUERIES["welch_t"] = Query(
    lambda spark, d: stats.welch_t(_placed(spark, d), "parity", "x").select(F.round(F.abs("t"), 9).alias("t"), _round("df")),
    f"{_G} SELECT round(abs(a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 9) AS t, round(power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)), 9) AS df FROM a, b",
)


def _anova(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.orders(spark, d)
    acc, model = _fitted(spark, d, Spherical(_ORDER_EDGES[0]), _ORDERS, rows)
    points = model.points(acc.counts).select("o_custkey", "first_seen", quoted("SPH1").alias("x")).join(unit_metadata(rows, _ORDERS).select("o_custkey", "segment"), "o_custkey")
    return stats.anova(points, "segment", "x").select(F.round("f", 6).alias("f"), "df_between", "df_within")


_on = [safe(n) for n in _ORDER_EDGES]
_onorm = "sqrt(" + " + ".join(f"{n} * {n}" for n in _on) + ")"
QUERIES["anova"] = Query(
    _anova,
    f"{_ORDER_SQL}, nm AS (SELECT *, {_onorm} AS norm, {' + '.join(_on)} <> 0 AS signal FROM ac), lw AS (SELECT segment, signal, CASE WHEN norm = 0 THEN 0 ELSE {_on[0]} / norm END AS w FROM nm), mu AS (SELECT avg(w) AS m FROM lw WHERE signal), pt AS (SELECT segment, CASE WHEN signal THEN w - m ELSE 0 END AS x FROM lw, mu), g AS (SELECT segment, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM pt GROUP BY 1), t AS (SELECT avg(x) AS m FROM pt) "
    "SELECT round((sum(n * power(g.m - t.m, 2)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))), 6) AS f, count(*) - 1 AS df_between, CAST(sum(n) - count(*) AS BIGINT) AS df_within FROM g, t",
)
QUERIES["rank_avg"] = Query(
    lambda spark, d: stats.average_ranks(inputs.events(spark, d).select("event_id", "value"), "value").select("event_id", "rank"),
    "SELECT event_id, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS rank FROM events",
)


def _pairs(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """The correlation of pairwise differences of x and y, in user order."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        points = _placed(spark, d)
        found = stats.correlations(points.select("ENA_UNIT", "user_id", "x"), points.select(F.col("ENA_UNIT").alias("unit"), F.col("y").alias("x")), ["x"], order="user_id", kinds=(kind,))[0]
        return spark.createDataFrame([(found["pairs"], round(found[kind], 7 if kind == "pearson" else 5) + 0.0)], f"pairs long, {kind} double")

    return run


_DIFF = f"{PT}, df AS (SELECT a.x - b.x AS u, a.y - b.y AS v FROM pt a JOIN pt b ON a.user_id < b.user_id)"
QUERIES["pair_pearson"] = Query(_pairs("pearson"), f"{_DIFF} SELECT count(*) AS pairs, round(corr(u, v), 7) + 0e0 AS pearson FROM df")
QUERIES["pair_spearman"] = Query(_pairs("spearman"), f"{_DIFF}, dr AS (SELECT rank() OVER (ORDER BY u) + (count(*) OVER (PARTITION BY u) - 1) / 2 AS a, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS b FROM (SELECT round(u, 12) + 0e0 AS u, round(v, 12) + 0e0 AS v FROM df)) SELECT count(*) AS pairs, round(corr(a, b), 5) + 0e0 AS spearman FROM dr")


def _interval(spark: SparkSession, d: str) -> DataFrame:
    """Fisher's interval of pair_pearson, and normal quantiles."""
    points = _placed(spark, d)
    found = stats.correlations(points.select("ENA_UNIT", "user_id", "x"), points.select(F.col("ENA_UNIT").alias("unit"), F.col("y").alias("x")), ["x"], order="user_id", kinds=("pearson",))[0]
    return spark.createDataFrame([(round(found["interval"][0], 6) + 0.0, round(found["interval"][1], 6) + 0.0, round(stats.inverse_normal(0.975), 9), round(stats.inverse_normal(0.5), 9) + 0.0)], "low double, high double, q975 double, q500 double")


QUERIES["pearson_interval"] = Query(_interval, f"{_DIFF}, cr AS (SELECT atanh(corr(u, v)) AS z, 1.959963984540054 / sqrt(count(*) - 3) AS h FROM df) SELECT round(tanh(z - h), 6) + 0e0 AS low, round(tanh(z + h), 6) + 0e0 AS high, 1.959963985::DOUBLE AS q975, 0e0 AS q500 FROM cr")


def _all_stats(spark: SparkSession, d: str) -> DataFrame:
    points = _placed(spark, d).withColumnsRenamed({"x": "SPH1", "y": "SPH2"})
    found = stats.ena_stats(points, points.select(F.col("ENA_UNIT").alias("unit"), "SPH1", "SPH2"), [1, 2], "parity")
    t = {n: found[n]["test"] for n in ("SPH1", "SPH2")}
    return spark.createDataFrame([(n, round(abs(t[n]["t"]), 8), round(found[n]["cohens_d"], 8), r["n"], round(r["mean"], 9) + 0.0) for n, r in ((n, next(r for r in found["summary"] if r["dimension"] == n)) for n in t)], "dimension string, t double, cohens_d double, n long, mean double")


_tests = " UNION ALL ".join(
    f"SELECT '{axis}' AS dimension, round(abs(a.m{c} - b.m{c}) / sqrt(a.v{c} / a.n + b.v{c} / b.n), 8) AS t, round(abs(a.m{c} - b.m{c}) / sqrt(((a.n - 1) * a.v{c} + (b.n - 1) * b.v{c}) / (a.n + b.n - 2)), 8) AS cohens_d, (SELECT count(*) FROM pt) AS n, (SELECT round(avg({c}), 9) + 0e0 FROM pt) AS mean FROM a, b"
    for axis, c in (("SPH1", "x"), ("SPH2", "y"))
)
QUERIES["ena_stats"] = Query(_all_stats, f"{PT}, g AS (SELECT parity, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy FROM pt GROUP BY 1), a AS (SELECT * FROM g WHERE parity = 0), b AS (SELECT * FROM g WHERE parity = 1) {_tests}")

# --- graphs, streams ---------------------------------------------------------------------

QUERIES["network_edges"] = Query(
    lambda spark, d: network_edges(line_weights(accumulate(inputs.events(spark, d), EVENTS).counts, EDGES), adjacency(CODES), 0.3, ("user_id",)).select("user_id", "source", "target", _round("weight")),
    f"{LW} SELECT * FROM (" + " UNION ALL ".join(f"SELECT user_id, '{e.source}' AS source, '{e.target}' AS target, round({safe(e.name)}, 9) + 0e0 AS weight FROM lw WHERE abs({safe(e.name)}) > 0.3" for e in adjacency(CODES)) + ")",
)


def _streamed(spec: AccumulateSpec, keys: tuple[str, ...] = ("user_id",), edges: list[str] = EDGES) -> Callable[[SparkSession, str], DataFrame]:
    """The events in three files, one a micro-batch; files, checkpoint and cells are in the shared folder."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        from stanzagraph.streaming.accumulate import accumulate_stream
        from stanzagraph.streaming.folders import shared_folder

        rows, folder = inputs.events(spark, d), f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
        cuts = rows.agg(F.percentile_approx("event_id", F.array(F.lit(0.3), F.lit(0.7)), 1000)).first()[0]  # where the files part doesn't matter
        for k, part in enumerate((F.col("event_id") <= cuts[0], (F.col("event_id") > cuts[0]) & (F.col("event_id") <= cuts[1]), F.col("event_id") > cuts[1])):
            rows.filter(part).coalesce(1).write.parquet(f"{folder}/part={k}")
        files = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)
        return plain(accumulate_stream(spark, files, spec, shared_folder(spark)), list(keys), edges)

    return run


def _pushed(spark: SparkSession, d: str) -> DataFrame:
    """The events in two chunks that are pushed into a session."""
    from stanzagraph.streaming.accumulate import accumulate_chunked
    from stanzagraph.streaming.folders import shared_folder

    return plain(accumulate_chunked(inputs.events(spark, d), replace(EVENTS, metadata=[]), shared_folder(spark), 2).finish(), ["user_id"], EDGES)


_TOLD = replace(EVENTS, metadata=[])
_USER_DAYS = ", ".join(f"sum({c}) AS {c}" for c in CODES)
QUERIES["stream_binary_b4"] = Query(_streamed(_TOLD), QUERIES["acc_binary_b4"].sql)
QUERIES["stream_forward3"] = Query(_streamed(replace(_TOLD, forward=3, weight="sum")), QUERIES["acc_forward3"].sql)
QUERIES["stream_separate"] = Query(_streamed(replace(_TOLD, conversation=["day"], model="SeparateTrajectory"), ("user_id", "day", "TRAJ_UNIT")), QUERIES["traj_separate"].sql)
QUERIES["stream_accumulated"] = Query(_streamed(replace(_TOLD, conversation=["day"], model="AccumulatedTrajectory"), ("user_id", "day", "TRAJ_UNIT")), QUERIES["traj_accumulated"].sql)
QUERIES["stream_ordered_b4"] = Query(_streamed(replace(_TOLD, network="ordered"), edges=_ORDERED_EDGES), QUERIES["ordered_b4"].sql)
QUERIES["stream_conversation"] = Query(
    _streamed(replace(_TOLD, conversation=["day"], window="Conversation")),
    f"WITH {inputs.EVENTS_SQL}, gr AS (SELECT user_id, day, {_USER_DAYS} FROM ev GROUP BY 1, 2), re AS (SELECT *, {', '.join(f'{binary_sql(c)} AS {n}' for c, n in zip(_tri(CODES), NAMES, strict=True))} FROM gr) {sums_sql(NAMES, 'user_id')}",
)
QUERIES["session_binary_b4"] = Query(_pushed, QUERIES["acc_binary_b4"].sql)


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Counts written, read back and checked against their specification."""
    from stanzagraph.sources.tables import load_counts, read_rows, save_counts
    from stanzagraph.streaming.folders import shared_folder

    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    rows = read_rows(spark, f"{d}/events.parquet")
    codes = inputs.events(spark, d).join(rows.select("event_id"), "event_id", "left_semi")
    save_counts(accumulate(codes, _TOLD).counts, path)
    return plain(load_counts(spark, path, _TOLD), ["user_id"], EDGES)


QUERIES["stored_binary_b4"] = Query(_stored, QUERIES["acc_binary_b4"].sql)


def _elastic(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of places on group and user number; without a penalty they are least squares."""
    from stanzagraph.functions.elasticnet import net_of_moments
    from stanzagraph.functions.linalg import moments

    placed, columns = _placed(spark, d), [F.col(c).cast("double") for c in ("parity", "user_id", "x", "y")]
    means = placed.agg(*[F.avg(c) for c in columns]).first()
    found = net_of_moments(moments(placed, F.array(*[c - F.lit(m) for c, m in zip(columns, means, strict=True)]), 4), 2, 0.0)
    return spark.createDataFrame([(i, round(float(a), 6) + 0.0, round(float(b), 6) + 0.0) for i, (a, b) in enumerate(found.coefficients)], "predictor long, x double, y double")


_covs = ", ".join(f"covar_samp({a}, {b}) AS {k}" for k, a, b in (("pp", "parity", "parity"), ("uu", "user_id", "user_id"), ("pu", "parity", "user_id"), ("px", "parity", "x"), ("ux", "user_id", "x"), ("py", "parity", "y"), ("uy", "user_id", "y")))
_ols = lambda own, other, c: f"round(({own}{c} * {other}{other} - {other}{c} * pu) / (pp * uu - pu * pu), 6) + 0e0"
QUERIES["elastic_net"] = Query(_elastic, f"{PT}, cv AS (SELECT {_covs} FROM pt) SELECT 0::BIGINT AS predictor, {_ols('p', 'u', 'x')} AS x, {_ols('p', 'u', 'y')} AS y FROM cv UNION ALL SELECT 1::BIGINT, {_ols('u', 'p', 'x')}, {_ols('u', 'p', 'y')} FROM cv")
