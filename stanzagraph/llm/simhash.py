"""SimHash near-duplicates by a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stanzagraph.llm.common import STAGED, discard, give_back, partitions_for, pick, slices, staged
from stanzagraph.llm.graph import components

SEED = 42
#: Node pairs that are expanded at once; more are split and expanded one part after the other.
FRONTIER = 400_000
#: Node pairs with so few leaf pairs are compared at once.
LEAVES = 16
#: Fingerprints, counted once a table, that a task holds.
TASK_ROWS = 400_000


def fingerprint(raw: bytes, width: int = 4) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text; 0 without words."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]]
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :] - 1
    total = np.zeros(64, np.int64)
    for at in range(0, n, 16384):
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + 16384)].tolist(), last[at : at + 16384].tolist(), strict=False)), np.uint64)
        total += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(fp, row, columns ``keep`` as keep_0, keep_1 and so on): fp is the fingerprint's bits as a signed long, row a number of the row."""
    keep = keep or []
    names = [f"keep_{i}" for i in range(len(keep))]
    picked = pick(docs, raw=text, **dict(zip(names, keep, strict=True))).withColumn("raw", F.col("raw").cast("binary"))
    fields = "".join(f", {n} {picked.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for some in slices(batches, 0):
            fps = np.asarray([fingerprint(t or b"") for t in some.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.array(np.arange(at, at + len(fps))), *some.columns[1:]], names=["fp", "row", *names])
            at += len(fps)
        give_back()

    return picked.mapInArrow(run, "fp long, row long" + fields)


def union(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least index of each component) after the links a-b."""
    while True:
        la, lb = labels[a], labels[b]
        if not (differ := la != lb).any():
            return labels
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (up := labels[labels]).tobytes() != labels.tobytes():
            labels = up


def trie_links(group: np.ndarray, fps: np.ndarray, budget: int) -> np.ndarray:
    """Component labels of fingerprints under links of at most ``budget`` differing bits.

    The rows are sorted by (group, fp); only rows of one group are linked. Each group is a
    binary trie over its sorted fingerprints: a node is a range of rows, a bit splits it.
    Pairs of nodes go down together, starting from each root with itself; a pair whose
    paths differ in more bits than the budget is pruned. Budgets rise from 1, and a pair
    whose rows are all in one component already is pruned too, so a dense cloud of near
    copies isn't compared pair by pair.
    """
    n = len(fps)
    labels = np.arange(n)
    if n < 2:
        return labels
    roots = np.r_[0, np.flatnonzero(np.diff(group)) + 1]
    ends = np.r_[roots[1:], n]
    ones: dict[int, np.ndarray] = {}

    def split(lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        if depth not in ones:
            ones.clear()
            ones[depth] = np.r_[0, np.cumsum((fps >> np.uint64(63 - depth)) & np.uint64(1))].astype(np.int64)
        return hi - (ones[depth][hi] - ones[depth][lo])

    def compare(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        na, nb = a1 - a0, b1 - b0
        which = np.repeat(np.arange(len(na)), na * nb)
        k = np.arange(len(which)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
        i, j = a0[which] + k // nb[which], b0[which] + k % nb[which]
        near = (np.bitwise_count(fps[i] ^ fps[j]) <= most) & (i != j)
        return i[near], j[near]

    for most in range(1, budget + 1):
        change = np.r_[np.flatnonzero(np.diff(labels)) + 1, n]
        same_until = change[np.searchsorted(change, np.arange(n), "right")]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        wide = ends - roots > 1
        todo = [(0, np.stack([roots[wide], ends[wide], roots[wide], ends[wide]]), np.zeros(int(wide.sum()), np.int8))]
        while todo:
            depth, pairs, diff = todo.pop()
            if pairs.shape[1] > FRONTIER:
                half = pairs.shape[1] // 2
                todo += [(depth, pairs[:, :half], diff[:half]), (depth, pairs[:, half:], diff[half:])]
                continue
            a0, a1, b0, b1 = pairs
            settled = (same_until[a0] >= a1) & (same_until[b0] >= b1) & (labels[a0] == labels[b0])
            small = (a1 - a0) * (b1 - b0) <= LEAVES
            now = small & ~settled
            if now.any():
                found.append(compare(a0[now], a1[now], b0[now], b1[now], most))
            go = ~small & ~settled
            if depth == 64 or not go.any():
                continue
            a0, a1, b0, b1, diff = a0[go], a1[go], b0[go], b1[go], diff[go]
            am, bm = split(a0, a1, depth), split(b0, b1, depth)
            own = (a0 == b0) & (a1 == b1)
            parts = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1), (am[~own], a1[~own], b0[~own], bm[~own], diff[~own] + 1)]
            new, diffs = np.concatenate([np.stack(p[:4]) for p in parts], axis=1), np.concatenate([p[4] for p in parts])
            keep = (new[0] < new[1]) & (new[2] < new[3]) & (diffs <= most)
            todo.append((depth + 1, new[:, keep], diffs[keep]))
        if found:
            labels = union(labels, np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
    return labels


def blocks(n: int, budget: int) -> int:
    """How many blocks to cut 64 bits into so that about 64 of ``n`` random rows share a table's exact blocks."""
    m = budget + 1
    while n >> (64 * (m - budget) // m) > 64 and m < 2 * budget:
        m += 1
    return m


def similar(reps: DataFrame, n: int, budget: int) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints (fp) as all links within the budget do.

    Of m > budget blocks of bits, two fingerprints within the budget agree in m - budget
    whole blocks; each choice of such blocks is a table, and fingerprints that agree there
    are one trie. Every trie gives a star for each of its components, so there are no more
    links than rows.
    """
    m = blocks(n, budget)
    cuts = [64 * i // m for i in range(m + 1)]
    masks = []
    for chosen in combinations(range(m), m - budget):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(mask)).alias("shared")) for t, mask in enumerate(masks)])
    rows = reps.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.shared")
    parts = partitions_for(reps.sparkSession, n * comb(m, budget), TASK_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        fps, shared = (np.concatenate([b.column(c).to_numpy() for b in got]).view(np.uint64) for c in ("fp", "shared"))
        t = np.concatenate([b.column("t").to_numpy() for b in got])
        order = np.lexsort((fps, shared, t))
        fps, shared, t = fps[order], shared[order], t[order]
        group = np.cumsum(np.r_[0, (np.diff(t) != 0) | (shared[1:] != shared[:-1])])
        labels = trie_links(group, fps, budget)
        linked = np.flatnonzero(labels != np.arange(len(labels)))
        yield pa.RecordBatch.from_arrays([pa.array(fps[linked].view(np.int64)), pa.array(fps[labels[linked]].view(np.int64))], names=["a", "b"])

    return rows.repartition(parts, "t", "shared").mapInArrow(run, "a long, b long")


def firsts(rows: DataFrame, least: Column, budget: int) -> DataFrame:
    """(fp, first): for each fingerprint, the least value of its group of near-duplicates.

    Equal fingerprints are one row before any comparison.
    """
    before = len(STAGED)
    reps = staged(rows.groupBy("fp").agg(F.min(least).alias("least")), "distinct")
    roots = components(similar(reps, reps.count(), budget)).withColumnRenamed("node", "fp")
    rooted = reps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("first"))
    out = staged(rooted.join(named, "root").select("fp", "first"), "components")
    discard(out.sparkSession, STAGED[before:-1])
    return out


def near_duplicates(docs: DataFrame, budget: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every document.

    Fingerprints link at ``budget`` or fewer differing bits; component_id is the smallest
    doc_id that links reach.

    Null and wordless texts have fingerprint 0 and link like others. Null doc_ids are
    never a component_id unless a component has no other. Very long texts are hashed whole.
    Ties: equal fingerprints are one point. Repeated rows: each returned. Empty table: no
    rows. Extra columns are ignored.
    """
    rows = staged(fingerprints(docs, text, [doc_id]).withColumnRenamed("keep_0", "doc_id"), "fingerprints")
    return rows.join(firsts(rows, F.col("doc_id"), budget), "fp").select("doc_id", "fp", F.col("first").alias("component_id"))


def first_of_groups(docs: DataFrame, columns: list[str], budget: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with ``columns``: that with the least doc_id.

    Null doc_ids stand behind all others. Of rows with one doc_id the one whose columns hash
    lowest stays, of identical rows any one. Groups may share a doc_id: each keeps a row.
    Rows are chosen by a number of their own, so groups and copies that a third of all rows
    are don't meet in one task.
    """
    content = F.xxhash64(*[F.col(f"keep_{i}") for i in range(len(columns))])
    keep = [*columns, doc_id]
    rows = staged(fingerprints(docs, text, keep), "fingerprints")
    own = F.col(f"keep_{len(columns)}")
    chosen = firsts(rows, F.struct(own.isNull().alias("none"), own.alias("id"), content.alias("content"), F.col("row").alias("row")), budget)
    picked = chosen.select(F.col("first.row").alias("row")).distinct()
    return rows.join(picked, "row", "left_semi").select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(columns)])


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
