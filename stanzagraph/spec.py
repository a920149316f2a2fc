"""What to accumulate, checked before any plan is built."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

NETWORKS = ("standard", "ordered")
MODELS = ("EndPoint", "AccumulatedTrajectory", "SeparateTrajectory")
WINDOWS = ("MovingStanzaWindow", "Conversation")
#: Columns that results add.
RESERVED = ("ENA_UNIT", "TRAJ_UNIT")


@dataclass(frozen=True)
class Edge:
    """A pair of codes and the column that counts it."""

    source: str
    target: str
    source_index: int
    target_index: int

    @property
    def name(self) -> str:
        return f"{self.source} & {self.target}"


@dataclass(frozen=True)
class Budget:
    """Limits of an ordered network; its size grows with the square of the codes.

    ``cells`` (units times edges) is looked at when counts are written for a model; None: no limit.
    """

    codes: int = 64
    cells: int | None = None


@dataclass(frozen=True)
class AccumulateSpec:
    """Columns and options of an accumulation.

    ``back`` counts the current row (0 and 1: the row alone); None is without bound, also
    for ``forward``. ``order_by`` must order the rows of a conversation totally; moving
    windows need it. ``weight`` is "binary", "sum" or a function of one cell's Column.
    scalar() makes such a function of one of numbers. Without ``include_meta`` units have no
    metadata. ``mask`` has a row for each source (ground) and a column for each target (response).
    """

    units: Sequence[str]
    conversation: Sequence[str]
    codes: Sequence[str]
    order_by: Sequence[str] = ()
    metadata: Sequence[str] = ()
    network: str = "standard"
    model: str = "EndPoint"
    window: str = "MovingStanzaWindow"
    back: int | None = 1
    forward: int | None = 0
    weight: str | Callable[[Column], Column] | None = None
    mask: Sequence[Sequence[float]] | None = None
    units_used: Sequence[str] | None = None
    legacy_display_keys: bool = False
    include_meta: bool = True
    budget: Budget = field(default_factory=Budget)

    def __post_init__(self) -> None:
        def need(ok: bool, why: str) -> None:
            if not ok:
                raise ValueError(why)

        need(len(self.codes) >= 2 and len(set(self.codes)) == len(self.codes), "codes: at least two, all different")
        need(bool(self.units) and bool(self.conversation), "units and conversation need a column each")
        need(self.network in NETWORKS, f"network: one of {NETWORKS}")
        need(self.model in MODELS, f"model: one of {MODELS}")
        need(self.window in WINDOWS, f"window: one of {WINDOWS}")
        for name, value, least in (("back", self.back, int(self.network == "ordered")), ("forward", self.forward, 0)):
            need(value is None or isinstance(value, int) and not isinstance(value, bool) and value >= least, f"{name}: a whole number from {least}, or None")
        need(self.weight in (None, "binary", "sum") or callable(self.weight), "weight: binary, sum or a function")
        need(self.window == "Conversation" or bool(self.order_by), "order_by: moving windows need a total order of a conversation's rows")
        if self.mask is not None:
            p = len(self.codes)
            need(len(self.mask) == p and all(len(r) == p for r in self.mask), "mask: as many rows and columns as codes")
            need(all(isfinite(x) for r in self.mask for x in r), "mask: finite numbers")
        need(self.units_used is None or len(self.units_used) > 0, "units_used: at least one label")
        if self.network == "ordered":
            need(self.model == "EndPoint" and self.window == "MovingStanzaWindow" and self.forward == 0, "ordered networks: EndPoint, moving windows, no forward rows")
            need(self.weight in (None, "sum"), "ordered networks sum")
            need(self.mask is None or all(x >= 0 for r in self.mask for x in r), "mask: not negative in ordered networks")
            need(len(self.codes) <= self.budget.codes, f"ordered networks: at most {self.budget.codes} codes")
            names = [e.name for e in self.edges()]
            taken = {*self.units, *self.conversation, *self.metadata, *self.order_by, *self.codes, *RESERVED}
            need(len(set(names)) == len(names) and not set(names) & taken, "edge columns would clash with others")

    @property
    def weighting(self) -> str | Callable[[Column], Column]:
        return self.weight or ("sum" if self.network == "ordered" else "binary")

    @property
    def plain_function(self) -> bool:
        """Whether the weight is a function, of a cell's Column or (scalar()) of a number."""
        return callable(self.weight)

    def edges(self) -> list[Edge]:
        return adjacency(self.codes) if self.network == "standard" else ordered_adjacency(self.codes)

    def factors(self) -> list[float]:
        """The mask's entry of each edge."""
        return [1.0 if self.mask is None else float(self.mask[e.source_index][e.target_index]) for e in self.edges()]

    def check(self, df: DataFrame) -> None:
        """Columns are there and of a kind that can be used so."""
        have = {f.name: f.dataType for f in df.schema}
        missing = [c for c in [*self.units, *self.conversation, *self.codes, *self.order_by, *self.metadata] if c not in have]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        nested = [c for c in [*self.units, *self.conversation] if isinstance(have[c], T.ArrayType | T.MapType | T.StructType)]
        if nested:
            raise ValueError(f"nested columns can't name units or conversations: {nested}")
        if self.network == "ordered":
            bad = [c for c in self.codes if isinstance(have[c], T.BooleanType)]
            if bad:
                raise ValueError(f"ordered codes are numbers: {bad}")
            clash = {e.name for e in self.edges()} & set(df.columns)
            if clash:
                raise ValueError(f"edge columns are in the input already: {sorted(clash)}")


def adjacency(codes: Sequence[str]) -> list[Edge]:
    """Undirected pairs, target by target: (0,1), (0,2), (1,2), (0,3) ..."""
    return [Edge(codes[j], codes[i], j, i) for i in range(1, len(codes)) for j in range(i)]


def ordered_adjacency(codes: Sequence[str]) -> list[Edge]:
    """Directed pairs from ground to response, response by response, loops included."""
    return [Edge(g, r, gi, ri) for ri, r in enumerate(codes) for gi, g in enumerate(codes)]


def scalar(weight: Callable[[float], float]) -> Callable[[Column], Column]:
    """A weight that is a Python function of a number, applied batch by batch."""
    import pandas as pd
    from pyspark.sql import functions as F

    def each(x: pd.Series) -> pd.Series:
        return x.map(weight).astype(float)

    each.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(each, "double")


def pairs_of(n: int) -> list[tuple[int, int]]:
    """Pairs i < j in lexicographic order: (0,1), (0,2) ... (1,2) ..."""
    return [(i, j) for i in range(n) for j in range(i + 1, n)]
