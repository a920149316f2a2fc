"""Networks as edge tables, and plots as plain data."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stanzagraph.functions.columns import quoted
from stanzagraph.spec import Edge

#: Eight colours for groups, in turn.
PALETTE = ["#3366cc", "#dc3912", "#109618", "#ff9900", "#990099", "#0099c6", "#dd4477", "#66aa00"]


def network_edges(rows: DataFrame, edges: list[Edge], min_weight: float = 0.0, keep: tuple[str, ...] = ("ENA_UNIT",)) -> DataFrame:
    """One row for each row and edge whose weight is larger than ``min_weight`` in size."""
    each = F.array(*[F.struct(F.lit(e.source).alias("source"), F.lit(e.target).alias("target"), quoted(e.name).alias("weight")) for e in edges])
    return rows.select(*[quoted(k) for k in keep], F.explode(each).alias("e")).select(*[quoted(k) for k in keep], "e.source", "e.target", "e.weight").filter(F.abs("weight") > min_weight)


def select(rows: DataFrame, selector: dict | Column | None) -> DataFrame:
    """Rows whose columns equal the selector's values, or that meet a condition."""
    if selector is None:
        return rows
    if isinstance(selector, Column):
        return rows.filter(selector)
    for name, value in selector.items():
        rows = rows.filter(quoted(name).eqNullSafe(F.lit(value)))
    return rows


class Plot:
    """Traces over two axes of a model, from small tables."""

    def __init__(self, model, points: DataFrame, lines: DataFrame, title: str = "", dims: tuple[str, str] | None = None):  # noqa: ANN001
        self.model, self.points, self.lines, self.title = model, points, lines, title
        self.dims = dims or tuple((model.shown * 2)[:2])
        where = [model.shown.index(d) for d in self.dims]
        self.nodes = {c: tuple(float(row[i]) for i in where) for c, row in zip(model.codes, model.nodes, strict=True)}
        self.traces: list[dict] = []
        self.scale = 1.0

    @property
    def limit(self) -> float:
        """Half the length of both axes."""
        return 1.2 * max([1e-9, *(abs(x) for p in self.nodes.values() for x in p)])

    def _color(self) -> str:
        return PALETTE[len(self.traces) % len(PALETTE)]

    def add_points(self, selector=None, name: str = "points") -> Plot:  # noqa: ANN001
        rows = select(self.points, selector).select("ENA_UNIT", *[quoted(d) for d in self.dims]).orderBy("ENA_UNIT").collect()
        self.traces.append({"kind": "points", "name": name, "color": self._color(), "points": [{"unit": r[0], "x": r[1] * self.scale, "y": r[2] * self.scale} for r in rows]})
        return self

    def add_group(self, selector=None, name: str = "mean") -> Plot:  # noqa: ANN001
        r = select(self.points, selector).agg(*[F.avg(quoted(d)) for d in self.dims], F.count(F.lit(1))).first()
        self.traces.append({"kind": "group", "name": name, "color": self._color(), "x": r[0], "y": r[1], "n": r[2]})
        return self

    def add_network(self, selector=None, name: str = "network", min_weight: float = 0.0) -> Plot:  # noqa: ANN001
        """Mean line weights of the selected units."""
        names = self.model.edges
        mean = select(self.lines, selector).agg(*[F.avg(quoted(e.name)) for e in names]).first()
        edges = [{"source": e.source, "target": e.target, "weight": w} for e, w in zip(names, mean, strict=True) if w is not None and abs(w) > min_weight]
        self.traces.append({"kind": "network", "name": name, "color": self._color(), "edges": edges})
        return self

    def add_nodes(self, name: str = "codes") -> Plot:
        self.traces.append({"kind": "nodes", "name": name, "nodes": [{"code": c, "x": x, "y": y} for c, (x, y) in self.nodes.items()]})
        return self

    def add_trajectory(self, unit: str, order: str, name: str | None = None) -> Plot:
        rows = self.points.filter(F.col("ENA_UNIT") == unit).orderBy(quoted(order)).select(*[quoted(d) for d in self.dims]).collect()
        self.traces.append({"kind": "trajectory", "name": name or unit, "color": self._color(), "points": [{"x": r[0], "y": r[1]} for r in rows]})
        return self

    def scaled(self, factor: float) -> Plot:
        self.scale = factor
        return self

    def to_dict(self) -> dict:
        return {"title": self.title, "dimensions": list(self.dims), "range": [-self.limit, self.limit], "traces": self.traces}

    def to_plotly(self) -> dict:
        """Data and layout; an end that has no place lies at 0."""
        data = []
        for t in self.traces:
            if t["kind"] == "network":
                for e in t["edges"]:
                    a, b = self.nodes.get(e["source"], (0.0, 0.0)), self.nodes.get(e["target"], (0.0, 0.0))
                    data.append({"type": "scatter", "mode": "lines", "x": [a[0], b[0]], "y": [a[1], b[1]], "line": {"width": max(1, 4 * abs(e["weight"])), "color": t["color"]}, "name": f"{e['source']} & {e['target']}"})
            elif t["kind"] == "group":
                data.append({"type": "scatter", "mode": "markers", "x": [t["x"]], "y": [t["y"]], "marker": {"symbol": "square", "color": t["color"]}, "name": t["name"]})
            else:
                rows = t.get("points") or t.get("nodes") or []
                mode = "lines+markers" if t["kind"] == "trajectory" else "markers+text" if t["kind"] == "nodes" else "markers"
                data.append({"type": "scatter", "mode": mode, "x": [r["x"] for r in rows], "y": [r["y"] for r in rows], "text": [r.get("code") or r.get("unit") for r in rows], "name": t["name"]})
        axis = {"range": [-self.limit, self.limit], "zeroline": True}
        return {"data": data, "layout": {"title": self.title, "xaxis": axis | {"title": self.dims[0]}, "yaxis": axis | {"title": self.dims[1]}}}

    def to_svg(self, size: int = 500) -> str:
        place = lambda x, y: (size / 2 * (1 + x / self.limit), size / 2 * (1 - y / self.limit))
        out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {size} {size}"><title>{escape(self.title)}</title>', f'<path d="M0 {size / 2}H{size}M{size / 2} 0V{size}" stroke="#ccc"/>']
        for t in self.traces:
            if t["kind"] == "network":
                for e in t["edges"]:
                    (a, b), (c, d) = place(*self.nodes.get(e["source"], (0, 0))), place(*self.nodes.get(e["target"], (0, 0)))
                    out.append(f'<line x1="{a:.2f}" y1="{b:.2f}" x2="{c:.2f}" y2="{d:.2f}" stroke="{t["color"]}" stroke-width="{max(1, 4 * abs(e["weight"])):.2f}"/>')
            for r in [t] if t["kind"] == "group" else t.get("points") or t.get("nodes") or []:
                x, y = place(r["x"] or 0, r["y"] or 0)
                out.append(f'<circle cx="{x:.2f}" cy="{y:.2f}" r="4" fill="{t.get("color", "#333")}"/>')
                if "code" in r:
                    out.append(f'<text x="{x + 6:.2f}" y="{y:.2f}">{escape(r["code"])}</text>')
        return "".join([*out, "</svg>"])
