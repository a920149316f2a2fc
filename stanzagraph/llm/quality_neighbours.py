"""Quality by votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stanzagraph.llm.common import give_back, pick, slices

#: Labelled documents that vote, at most: those whose ids hash lowest.
LABELLED = 6000
#: Latent dimensions, neighbours, and the power of the cosine that is a neighbour's weight.
DIMENSIONS, NEIGHBOURS, POWER = 48, 40, 12
#: Documents in one block of cosine products.
ROWS = 512
#: score from which predicted is 1.
THRESHOLD = 0.3

#: Classes of bytes: small letters and parts of other letters, capitals, digits, blanks, line ends, and signs.
CLASSES = np.full(256, 0, np.int32)
for _k, _chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"!?", b"#*$%&|<>", b"'\"()-_/"], 1):
    CLASSES[list(_chars)] = _k
KINDS = 10
SHAPES, LETTERS, REPEATS = KINDS**3, 512, 3
TERMS = SHAPES + LETTERS + REPEATS


def terms(raw: bytes) -> np.ndarray:
    """Counts of a text's terms: trigrams of byte classes, hashed byte trigrams, and repeated words and lines."""
    out = np.zeros(TERMS, np.float32)
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, max(0, len(data) - 2), 1 << 20):
        part = data[at : at + (1 << 20) + 2]
        if len(part) < 3:
            break
        k = CLASSES[part]
        out[:SHAPES] += np.bincount((k[:-2] * KINDS + k[1:-1]) * KINDS + k[2:], minlength=SHAPES)
        low = (part | 0x20).astype(np.uint32)
        mixed = (low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA77) + low[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(23)
        out[SHAPES : SHAPES + LETTERS] += np.bincount(mixed, minlength=LETTERS)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    out[-3] = sum(map(bytes.__eq__, words, words[1:]))
    out[-2] = len(words) - len(set(words))
    out[-1] = len(lines) - len(set(lines))
    return out


@dataclass
class Space:
    """Weights of terms, latent axes, and the labelled documents' vectors and labels."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    @staticmethod
    def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * idf
        # each family of terms has a length of its own, so that letters don't drown shapes and repeats
        for a, b, w in ((0, SHAPES, 1.0), (SHAPES, SHAPES + LETTERS, 0.4)):
            norm = np.linalg.norm(x[:, a:b], axis=1, keepdims=True)
            x[:, a:b] *= w / np.where(norm > 0, norm, 1)
        size = 1 + np.log1p(counts[:, :SHAPES].sum(axis=1, keepdims=True))
        x[:, -REPEATS:] = np.log1p(counts[:, -REPEATS:]) / size
        return x

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray) -> Space:
        if not len(counts):
            return cls(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5)
        idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
        x = cls.weigh(counts, idf)
        values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        axes = vectors[:, np.argsort(values)[::-1][:DIMENSIONS]].astype(np.float32)
        space = cls(idf, axes, np.zeros((0, 1), np.float32), labels.astype(np.float32), float(labels.mean()))
        space.vectors = space.embed(counts)
        return space

    def embed(self, counts: np.ndarray) -> np.ndarray:
        z = self.weigh(counts, self.idf) @ self.axes
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        return z / np.where(norm > 0, norm, 1)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Mean label of the nearest vectors, by powers of their cosines; the prior where none is near."""
        if not len(self.vectors):
            return np.full(len(counts), self.prior)
        cosines = self.embed(counts) @ self.vectors.T
        k = min(NEIGHBOURS, cosines.shape[1])
        near = np.argpartition(cosines, cosines.shape[1] - k, axis=1)[:, -k:]
        top = np.take_along_axis(cosines, near, 1)
        weight = np.clip(top, 0, 1).astype(np.float64) ** POWER
        total, votes = weight.sum(axis=1), (weight * self.labels[near]).sum(axis=1)
        last = top.min(axis=1, keepdims=True)
        for i in np.flatnonzero((cosines >= last).sum(axis=1) > k):  # as near as the last of them: all vote
            own = np.flatnonzero(cosines[i] >= last[i])
            w = np.clip(cosines[i, own], 0, 1).astype(np.float64) ** POWER
            total[i], votes[i] = w.sum(), w @ self.labels[own]
        score = np.where(total > 0, votes / np.where(total > 0, total, 1), self.prior)
        return np.clip(score, 0, 1)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in slices(batches, 2, ROWS):
        rows = [terms(t or b"").tobytes() for t in some.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*some.columns[:2], pa.array(rows, pa.binary())], names=["doc_id", "label", "counts"])
    give_back()


def fit_neighbours(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text", most: int = LABELLED) -> Space:
    """The space of at most ``most`` labelled documents for which ``learn`` (on doc_id) holds.

    They are those whose ids hash lowest, and of one id those whose terms hash lowest, so the
    sample is the same each time. Rows with a null id or label don't count; several labels of
    one document count as their mean. Only ``most`` ids are sent to the texts' tasks, and
    ``most`` rows come back.
    """
    known = pick(labels, doc_id=doc_id, label=label).filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & learn)
    means = known.groupBy("doc_id").agg(F.avg("label").alias("label"))
    chosen = means.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = pick(docs, doc_id=doc_id, text=text).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", F.col("text").cast("binary"))
    rows = texts.mapInArrow(counted, "doc_id long, label double, counts binary").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("counts")).limit(most).collect()
    if not rows:
        return Space.fit(np.zeros((0, TERMS), np.float32), np.zeros(0))
    rows.sort(key=lambda r: (r["label"], bytes(r["counts"])))
    return Space.fit(np.stack([np.frombuffer(bytes(r["counts"]), np.float32) for r in rows]), np.asarray([r["label"] for r in rows]))


def score_quality(docs: DataFrame, space: Space, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every document; only the text is looked at.

    Every document's cosines to all labelled vectors are computed exactly, block by block;
    the nearest vote with weights. The space has a fixed size (LABELLED x DIMENSIONS).

    Null and empty texts have no direction and get the prior, the labels' mean. Ties: all
    labelled documents as near as the last neighbour vote. Very long texts are counted whole,
    a part at a time. Without labels the score is 0.5. Repeated rows: each returned. Empty table: no rows. Extra
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(space))  # plain arrays: executors need not have this package

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(**shared.value)
        for some in slices(batches, 1, ROWS):
            score = space.score(np.stack([terms(t or b"") for t in some.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(score)], names=["doc_id", "score"])
        give_back()

    scored = pick(docs, doc_id=doc_id, text=text).select("doc_id", F.col("text").cast("binary")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    space = fit_neighbours(docs, labels, rest != 0)
    return score_quality(docs, space).select("doc_id", (rest == 0).alias("held_out"), "score", "predicted")
