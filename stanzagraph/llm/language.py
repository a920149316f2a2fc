"""Language identification by a convolutional network over bytes, trained and run in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stanzagraph.llm.common import give_back, pick, slices

#: Bytes of a window, numbers a byte is embedded in, filters of each width.
WINDOW, EMBED, WIDTHS, FILTERS = 192, 6, (2, 3, 4), 12
SPAN = max(WIDTHS)
#: Windows that are learnt from, about: a sample of all windows of all texts that may be learnt.
LEARNT = 20_000
EPOCHS, BATCH, RATE = 4, 64, 0.01
#: Windows that are convolved at once.
AT_ONCE = 256

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[9:14] = 32


def cut(raw: bytes) -> np.ndarray:
    """A text's windows, one a row; the last is filled with blanks."""
    n = -(-len(raw) // WINDOW)
    return LOWER[np.frombuffer(raw.ljust(n * WINDOW), np.uint8)].reshape(n, WINDOW)


def hashes(windows: np.ndarray) -> np.ndarray:
    """64 bits of each window's bytes."""
    words = np.ascontiguousarray(windows).view(np.uint64)
    h = np.zeros(len(words), np.uint64)
    for c in range(words.shape[1]):
        h = (h ^ words[:, c]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class ByteNet:
    """Embedding, filters of several widths in one matrix, max pooling, softmax."""

    languages: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str], seed: int = 1) -> ByteNet:
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        filters = rng.normal(0, 0.3, (SPAN, EMBED, n)).astype(np.float32)
        net = cls(languages, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), filters, np.zeros(n, np.float32), rng.normal(0, 0.2, (n, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
        net.filters *= net.mask()
        return net

    @staticmethod
    def mask() -> np.ndarray:
        """Filters of a width below SPAN have zeros beyond it."""
        return np.concatenate([np.broadcast_to((np.arange(SPAN) < w)[:, None, None], (SPAN, EMBED, FILTERS)) for w in WIDTHS], axis=2).astype(np.float32)

    def convolve(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of SPAN embedded bytes at each place, and what the filters make of them."""
        x = self.embed[windows]
        places = WINDOW - SPAN + 1
        rows = np.lib.stride_tricks.as_strided(x, (len(x), places, SPAN * EMBED), (x.strides[0], x.strides[1], x.strides[2])).reshape(-1, SPAN * EMBED)
        return rows, (rows @ self.filters.reshape(SPAN * EMBED, -1)).reshape(len(x), places, -1)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(windows), AT_ONCE):
            _, made = self.convolve(windows[at : at + AT_ONCE])
            parts.append(np.maximum(made.max(axis=1) + self.bias, 0) @ self.out + self.out_bias)
        z = np.concatenate(parts).astype(np.float64)
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def train(self, windows: np.ndarray, labels: np.ndarray, seed: int = 2) -> None:
        """Adam on the cross entropy of windows."""
        rng = np.random.default_rng(seed)
        names = ["embed", "filters", "bias", "out", "out_bias"]
        first, second = ({n: np.zeros_like(getattr(self, n)) for n in names} for _ in range(2))
        mask, step = self.mask(), 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                rows, made = self.convolve(windows[own])
                best = made.argmax(axis=1)
                pooled = np.take_along_axis(made, best[:, None], 1)[:, 0] + self.bias
                hidden = np.maximum(pooled, 0)
                z = hidden @ self.out + self.out_bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(own)), labels[own]] -= 1
                p /= len(own)
                back = (p @ self.out.T) * (pooled > 0)
                chosen = rows.reshape(len(own), -1, SPAN * EMBED)[np.arange(len(own))[:, None], best]  # window, filter, input
                flat = self.filters.reshape(SPAN * EMBED, -1)
                grads = {"out": hidden.T @ p, "out_bias": p.sum(axis=0), "bias": back.sum(axis=0)}
                grads["filters"] = np.einsum("wfi,wf->if", chosen, back).reshape(self.filters.shape) * mask
                into = (back[:, :, None] * flat.T[None]).reshape(len(own), -1, SPAN, EMBED)
                at_bytes = windows[own][np.arange(len(own))[:, None, None], best[:, :, None] + np.arange(SPAN)]
                grads["embed"] = np.zeros_like(self.embed)
                np.add.at(grads["embed"], at_bytes.reshape(-1), into.reshape(-1, EMBED))
                step += 1
                for n in names:
                    g = grads[n].astype(np.float32)
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.999 * second[n] + 0.001 * g * g
                    rate = RATE / (1 + epoch) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    setattr(self, n, (getattr(self, n) - rate * first[n] / (np.sqrt(second[n]) + 1e-8)).astype(np.float32))


def fit_languages(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = LEARNT) -> ByteNet:
    """A network learnt from about ``most`` windows of documents with a language for which ``learn`` (on doc_id) holds.

    The sample is drawn from all windows of all these texts: those whose bytes hash below
    the share that ``most`` is of them, so it is the same whatever the order or number of
    rows, and a window that stands in very many documents is learnt once a language.
    """
    known = pick(docs, doc_id=doc_id, text=text, lang=lang).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn)
    total = known.agg(F.sum(F.ceil(F.octet_length("text") / WINDOW))).first()[0] or 0
    below = np.uint64(min(2**64 - 1, most * 2**64 // max(1, total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 1):
            rows = []
            for language, raw in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                got = cut(raw)
                rows += [(language, w.tobytes()) for w in got[hashes(got) <= below]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "window"])
        give_back()

    chosen = known.select("lang", F.col("text").cast("binary")).mapInArrow(run, "lang string, window binary").distinct()
    rows = sorted((r["lang"], bytes(r["window"])) for r in chosen.collect())
    languages = sorted({r[0] for r in rows})
    net = ByteNet.new(languages)
    if rows:
        net.train(np.stack([np.frombuffer(r[1], np.uint8) for r in rows]), np.asarray([languages.index(r[0]) for r in rows]))
    return net


def identify(docs: DataFrame, net: ByteNet, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every document; only the text is looked at.

    A text is cut into windows of 192 bytes, all of them are convolved, and the windows'
    log-probabilities, weighted by their bytes, decide. score is the mean probability that
    the windows give the language.

    Null texts, texts without a letter, and all texts if nothing was learnt: und, score 0.
    Ties: of equally likely languages the first by name. Very long texts: all their windows
    count, AT_ONCE at a time. Repeated rows: each returned. Empty table: no rows. Extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(net))  # plain arrays: executors need not have this package

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = ByteNet(**shared.value)
        for some in slices(batches, 1, 64):
            texts = [t or b"" for t in some.column(1).to_pylist()]
            lettered = [bool(net.languages) and any(map(str.isalpha, t.decode("utf-8", "replace"))) for t in texts]
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            own = [i for i, ok in enumerate(lettered) if ok]
            if own:
                parts = [cut(texts[i]) for i in own]
                log_p = net.log_probabilities(np.concatenate(parts))
                begin = 0
                for i, part in zip(own, parts, strict=True):
                    lp = log_p[begin : begin + len(part)]
                    begin += len(part)
                    weight = np.full(len(part), WINDOW, float)
                    weight[-1] = len(texts[i]) - WINDOW * (len(part) - 1)
                    weight /= weight.sum()
                    best = int((weight @ lp).argmax())
                    names[i], scores[i] = net.languages[best], float(min(1.0, weight @ np.exp(lp[:, best])))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])
        give_back()

    return pick(docs, doc_id=doc_id, text=text).select("doc_id", F.col("text").cast("binary")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    net = fit_languages(docs, rest != 2)
    return identify(docs, net).select("doc_id", (rest == 2).alias("held_out"), "lang_pred", "score")
