"""Places of codes such that units' weighted codes come close to the units' points."""

from __future__ import annotations

import numpy as np

from stanzagraph.spec import Edge

RIDGE = 1e-10
LEAST = 1e-4


def incidence(edges: list[Edge], codes: int, method: str) -> np.ndarray:
    """Edges x codes: half of an edge to each end, or (directed, paired) all of it to each, a loop once."""
    share = 0.5 if method == "undirected" else 1.0
    h = np.zeros((len(edges), codes))
    for k, e in enumerate(edges):
        if method != "undirected" and e.source_index == e.target_index:
            h[k, e.source_index] = 1.0
        else:
            h[k, e.source_index] += share
            h[k, e.target_index] += share
    return h


def node_weights(lines: np.ndarray, h: np.ndarray) -> np.ndarray:
    w = lines @ h
    return w / np.maximum(LEAST, np.abs(w).sum(axis=1, keepdims=True))


def positions(gram: np.ndarray, products: np.ndarray) -> np.ndarray:
    """Codes x dimensions from the weights' Gram matrix and their products with the points."""
    return np.linalg.solve(gram + RIDGE * np.eye(len(gram)), products)
