"""Cells of conversations' rows from their codes, with numpy: for streams, ordered networks and many codes.

No sum is the difference of two others, so codes of very different size don't cancel, and
sums are taken from the earliest row to the latest, whatever the chunks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from stanzagraph.spec import Edge


def products(x: np.ndarray, edges: Sequence[Edge]) -> np.ndarray:
    return x[:, [e.source_index for e in edges]] * x[:, [e.target_index for e in edges]]


def starts_of(run: np.ndarray) -> np.ndarray:
    """For each row, the first row of its run of equal values."""
    new = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else np.zeros(0, np.int64)
    return np.repeat(new, np.diff(np.r_[new, len(run)]))


def frame_sums(codes: np.ndarray, run: np.ndarray, lo: int, hi: int, among: np.ndarray | None = None) -> np.ndarray:
    """For each row, the sum of the rows from ``lo`` to ``hi`` behind it in its run, of those ``among`` if given."""
    n, out = len(codes), np.zeros(codes.shape)
    for k in range(max(lo, 1 - n), min(hi, n - 1) + 1):
        to, of = (slice(-k, n), slice(0, n + k)) if k < 0 else (slice(0, n - k), slice(k, n))
        ok = run[to] == run[of]
        if among is not None:
            ok &= among[of]
        out[to] += np.where(ok[:, None], codes[of], 0.0)
    return out


def running(codes: np.ndarray, run: np.ndarray, carry: np.ndarray | None = None) -> np.ndarray:
    """Sums of each run up to each row; ``carry`` is what stands before the first run's rows."""
    out = codes.astype(float)
    new = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else []
    for a, b in zip(new, [*new[1:], len(run)], strict=True):
        if a == 0 and carry is not None:
            out[0] = carry + out[0]
        out[a:b] = np.cumsum(out[a:b], axis=0)
    return out


def stanza_cells(codes: np.ndarray, run: np.ndarray, edges: Sequence[Edge], back: int | None, forward: int | None, carry: np.ndarray | None = None) -> np.ndarray:
    """Cells of a moving window, before threshold, mask and weight.

    ``run`` numbers the conversations, whose rows stand together; where the first has had
    rows before these and ``back`` is None, ``carry`` is their sum.
    """
    n = len(codes)
    if not n:
        return np.zeros((0, len(edges)))
    first = starts_of(run)
    at = np.arange(n)
    left = first + np.bincount(first, minlength=n)[first] - 1 - at
    start = None if back is None else min(0, 1 - back)
    if forward == 0:
        before = before_of(codes, run, start, carry)
        return products(before + codes, edges) - products(before, edges)
    if forward is None:
        behind = running(codes[::-1], run[::-1])[::-1]  # this row and all that follow
        return products(before_of(codes, run, start) + behind, edges) - products(frame_tail(behind, left), edges)
    tail = frame_sums(codes, run, 1, forward)
    enough = left > forward
    if start is None:
        total = running(codes, run, carry)
        base = np.zeros(codes.shape) if carry is None else np.where((first == 0)[:, None], carry, 0.0)
        whole = total[at + np.minimum(left, forward)]
        upto = np.minimum(at - 1, at + left - forward - 1)
        head = np.where((upto >= first)[:, None], total[np.maximum(upto, 0)], base)
    else:
        whole = frame_sums(codes, run, start, forward)
        head = frame_sums(codes, run, start, -1, enough) if start < 0 else np.zeros(codes.shape)
    return products(whole, edges) - products(head, edges) - products(tail, edges)


def frame_tail(behind: np.ndarray, left: np.ndarray) -> np.ndarray:
    """What follows each row: what its next row has behind it."""
    nxt = np.vstack([behind[1:], np.zeros((1, behind.shape[1]))]) if len(behind) else behind
    return np.where((left > 0)[:, None], nxt, 0.0)


def before_of(codes: np.ndarray, run: np.ndarray, start: int | None, carry: np.ndarray | None = None) -> np.ndarray:
    """Sums of the earlier rows of each row's window."""
    if start is not None or not len(codes):
        return frame_sums(codes, run, start or 0, -1)
    total, first = running(codes, run, carry), starts_of(run)
    base = np.zeros(codes.shape) if carry is None else np.where((first == 0)[:, None], carry, 0.0)
    return np.where((np.arange(len(codes)) > first)[:, None], np.vstack([base[:1], total[:-1]]), base)


def exactly_summed(codes: np.ndarray, most: float) -> bool:
    """Whether sums that ``most`` bounds need no rounding: whole numbers below 2^53."""
    return most < 2**53 and bool((codes == np.floor(codes)).all())


def ordered_row_cells(codes: np.ndarray, run: np.ndarray, edges: Sequence[Edge], back: int | None, carry: Sequence[Sequence[float]] | None = None) -> np.ndarray:
    """Earlier ground to present response, and half of a row's own pairs each way.

    A window's sum is rounded once. A product that overflows, or that is 0 though its parts
    aren't, is an error. ``carry`` holds, for each code, numbers whose sum is
    that of the first conversation's earlier rows.
    """
    n, p = codes.shape
    if not n:
        return np.zeros((0, len(edges)))
    first = starts_of(run)
    size = np.arange(n) - first if back is None else np.minimum(np.arange(n) - first, back - 1)
    held = [list(c) for c in carry] if carry is not None else [[] for _ in range(p)]
    with np.errstate(over="ignore"):
        plain = exactly_summed(codes, float(codes.sum()))
    if plain and not any(held):
        before = before_of(codes, run, None if back is None else 1 - back)
    else:
        before, parts = np.zeros((n, p)), held
        for t in range(n):
            if back is not None:
                before[t] = [math.fsum(codes[t - size[t] : t, i]) for i in range(p)]
                continue
            if first[t] == t and t:
                parts = [[] for _ in range(p)]
            before[t] = [math.fsum(x) for x in parts]
            for i in range(p):
                expand(parts[i], float(codes[t, i]))
    g, r = [e.source_index for e in edges], [e.target_index for e in edges]
    big, small = np.maximum(codes[:, g], codes[:, r]), np.minimum(codes[:, g], codes[:, r])
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        lagged, same = before[:, g] * codes[:, r], np.where(np.asarray(g) != np.asarray(r), 0.5 * big * small, 0.0)
        cells = lagged + same
    lost = (lagged == 0) & (before[:, g] > 0) & (codes[:, r] > 0) | (same == 0) & (small > 0) & (np.asarray(g) != np.asarray(r))
    for bad, what in ((~np.isfinite(cells), "overflows"), (lost, "vanishes")):
        if bad.any():
            e = edges[int(np.flatnonzero(bad.any(axis=0))[0])]
            raise ValueError(f"edge {e.name} {what}: codes are beyond the range of doubles")
    return cells


def expand(parts: list[float], x: float) -> None:
    """Add to numbers that don't overlap, so that their sum stays exact."""
    kept = []
    for y in parts:
        if abs(x) < abs(y):
            x, y = y, x
        high = x + y
        low = y - (high - x)
        if low:
            kept.append(low)
        x = high
    parts[:] = [*kept, x] if x else kept
