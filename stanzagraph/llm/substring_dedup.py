"""Removal of byte strings that an earlier document has, by suffix arrays of shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stanzagraph.llm.common import give_back, pick, slices, staged
from stanzagraph.llm.suffix_arrays import permuted_lcp, suffix_array

#: Bytes of the strings that are looked for, of the anchors inside them, and of anchors to choose from.
WINDOW, ANCHOR = 50, 24
CHOICES = WINDOW - ANCHOR + 1
#: A piece has at most CHOICES windows, so at most so many bytes; kept in rows of whole words.
PIECE = WINDOW + CHOICES - 1
WIDTH = -(-PIECE // 8) * 8
#: Bytes of text that are hashed at once, that a mapper gathers, that a block holds, and that come to a shard on average.
STRIDE, UNIT, BLOCK, SHARD = 1 << 14, 1 << 23, 4_000_000, 1_500_000
#: Anchors that a bucket holds.
BUCKET = 1_500_000
#: The id that null doc_ids have here: they come after all others.
LAST = np.iinfo(np.int64).max

#: Strings whose bytes are cut out at once.
AT_ONCE = 1 << 15

_rng = np.random.default_rng(20240229)
LETTERS = _rng.integers(0, 2**64, 256, dtype=np.uint64)
M = np.uint64(0x9E3779B97F4A7C15)
#: M to the powers 1, 2, 4 and 8: what joins hashes of so many bytes.
POWERS = [np.uint64(pow(int(M), k, 2**64)) for k in (1, 2, 4, 8)]


def anchored(data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, number of windows, anchor's hash.

    ``data`` holds texts end to end, ``lens`` their bytes. A window's anchor is its
    leftmost 24-byte string of least hash, so equal windows have equal anchors.
    """
    ends = np.cumsum(lens)
    step = np.zeros(len(data) + 1, np.int8)
    long = lens >= WINDOW
    np.add.at(step, (ends - lens)[long], 1)
    np.add.at(step, (ends - WINDOW + 1)[long], -1)
    inside = np.cumsum(step[:-1], dtype=np.int8).view(bool)
    firsts, counts, hashes = [], [], []
    for at in range(0, max(0, len(data) - WINDOW + 1), STRIDE):
        h1 = LETTERS[data[at : at + STRIDE + WINDOW - 1]]
        h2 = h1[:-1] * POWERS[0] + h1[1:]
        h4 = h2[:-2] * POWERS[1] + h2[2:]
        h8 = h4[:-4] * POWERS[2] + h4[4:]
        h16 = h8[:-8] * POWERS[3] + h8[8:]
        h = h16[:-8] * POWERS[3] + h8[16:]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        low = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        m = np.minimum(low[:-1], low[1:])
        for w in (2, 4, 8):
            m = np.minimum(m[:-w], m[w:])
        m = np.minimum(m[: len(h) - CHOICES + 1], m[CHOICES - 16 :][: len(h) - CHOICES + 1])
        where = (m & np.uint64((1 << 20) - 1)).astype(np.int32)
        ok = np.flatnonzero(inside[at : at + len(m)])
        if not len(ok):
            continue
        p = where[ok]
        new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (ok[1:] != ok[:-1] + 1)])
        firsts.append(ok[new] + at)
        counts.append(np.diff(np.r_[new, len(ok)]))
        hashes.append(h[p[new]])
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(hashes)


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    texts = [t or b"" for t in texts]
    return np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))


def packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as compressed differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)).tobytes())


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(unpacked(data), np.uint64))


def anchor_keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of an anchor's hash above its lower half."""
    return (h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)


#: The block of an anchor that nobody asks about: its unit knows already that documents share it.
NOBODY = -1


def list_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """Which anchors occur in which blocks, by cell, from each mapper's unit of text.

    Cell b from 0 on is a bucket of hashes: it gets an anchor that one document of the unit
    has with that document's block, and one that several have once, for NOBODY. What
    several have is shared for certain: these blocks are told through a cell below 0, dealt
    by unit. So a bucket gets an anchor at most once a unit, however many documents have it.
    """

    def rows(cell: np.ndarray, key: np.ndarray, block: np.ndarray) -> list[tuple]:
        order = np.lexsort((key, block, cell))
        cell, key, block = cell[order], key[order], block[order]
        cuts = np.r_[0, np.flatnonzero(np.diff(cell)) + 1, len(cell)] if len(cell) else np.zeros(1, np.int64)
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            ids, counts = np.unique(block[a:b], return_counts=True)
            keys = key[a:b] if cell[a] < 0 else key[a:b].astype(np.uint32)
            out.append((int(cell[a]), packed(keys.tobytes()) if cell[a] < 0 else keys.tobytes(), ids.astype(np.int32).tobytes(), counts.astype(np.int32).tobytes()))
        return out

    def flush(blocks: list[int], texts: list[bytes], teller: int) -> Iterator[pa.RecordBatch]:
        data, lens = joined(texts)
        first, _, h = anchored(data, lens)
        if not len(h):
            return
        doc, key = np.searchsorted(np.cumsum(lens), first, "right"), anchor_keys(h, buckets)
        order = np.lexsort((doc, key))
        doc, key = doc[order], key[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
        doc, key = doc[new], key[new]
        block = np.asarray(blocks, np.int64)[doc]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        several = np.diff(np.r_[starts, len(key)]) > 1
        known = np.repeat(several, np.diff(np.r_[starts, len(key)]))
        bucket = (key >> np.uint64(32)).astype(np.int64)
        said = starts[several]
        asked = np.flatnonzero(~known)
        out = rows(np.r_[bucket[asked], bucket[said]], np.r_[key[asked], key[said]], np.r_[block[asked], np.full(len(said), NOBODY)])
        told = np.unique(np.stack([block[known].astype(np.uint64), key[known]]), axis=1) if known.any() else np.zeros((2, 0), np.uint64)
        out += rows(np.full(told.shape[1], -1 - teller), told[1], told[0].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), *[pa.binary()] * 3], strict=True)], names=["cell", "keys", "blocks", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, texts, size, unit = [], [], 0, 0
        teller = lambda: (TaskContext.get().partitionId() * 31 + unit) % buckets
        for some in slices(batches, 1):
            blocks += some.column(0).to_pylist()
            texts += some.column(1).to_pylist()
            size += sum(len(t or b"") for t in texts[-some.num_rows :])
            if size >= UNIT:
                yield from flush(blocks, texts, teller())
                blocks, texts, size, unit = [], [], 0, unit + 1
        yield from flush(blocks, texts, teller())
        blocks = texts = None
        give_back()

    return docs.select("block", "text").mapInArrow(run, "cell long, keys binary, blocks binary, counts binary")


def shared_anchors(listed: DataFrame) -> DataFrame:
    """(block, keys): the anchors of each block that two documents or more have, in any number of rows a block."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows, cell = table.select(["keys", "blocks", "counts"]).to_pydict(), key[0].as_py()
        block = np.concatenate([np.repeat(np.frombuffer(x, np.int32), np.frombuffer(y, np.int32)) for x, y in zip(rows["blocks"], rows["counts"], strict=True)])
        if cell < 0:
            keys = np.concatenate([np.frombuffer(unpacked(x), np.uint64) for x in rows["keys"]])
        else:
            h = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["keys"]])
            order = np.argsort(h, kind="stable")
            h, block = h[order], block[order]
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            sizes = np.diff(np.r_[starts, len(h)])
            wanted = np.repeat((sizes > 1) | (np.minimum.reduceat(block, starts) == NOBODY), sizes) & (block != NOBODY)
            keys, block = np.uint64(cell) << np.uint64(32) | h[wanted].astype(np.uint64), block[wanted]
        order = np.lexsort((keys, block))
        keys, block = keys[order], block[order]
        new = np.r_[np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]) | (block[1:] != block[:-1])]
        keys, block = keys[new], block[new]
        cuts = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(block)] if len(block) else np.zeros(1, np.int64)
        pairs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        out = pa.table({"block": pa.array([int(block[a]) for a, _ in pairs], pa.int32()), "keys": pa.array([pack_keys(keys[a:b]) for a, b in pairs], pa.binary())})
        give_back()
        return out

    return listed.groupBy("cell").applyInArrow(run, "block int, keys binary")


class Pieces:
    """A block's texts and their pieces: runs of windows whose anchor other documents have."""

    def __init__(self, left: pa.Table, found: list[bytes], buckets: int):
        ids = [LAST if x is None else x for x in left.column("doc_id").to_pylist()]
        texts = [t or b"" for t in left.column("text").to_pylist()]
        #: The same order each time the block's rows are read.
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids = np.asarray([ids[i] for i in self.order], np.int64)
        self.data, self.lens = joined([texts[i] for i in self.order])
        self.padded = np.r_[self.data, np.zeros(WIDTH, np.uint8)]
        self.data = self.padded[: len(self.data)]
        first, count, h = anchored(self.data, self.lens)
        keys = np.sort(np.concatenate([unpack_keys(x) for x in found])) if found else np.zeros(0, np.uint64)
        own = anchor_keys(h, buckets)
        at = np.searchsorted(keys, own)
        ok = keys[np.minimum(at, len(keys) - 1)] == own if len(keys) else np.zeros(len(own), bool)
        self.first, self.count, self.hash = first[ok], count[ok], h[ok]
        self.doc = self.ids[np.searchsorted(np.cumsum(self.lens), self.first, "right")]
        self.size = self.count + WINDOW - 1
        every = np.arange(len(self.first))
        parts = [signature(*self.cut(every[a : a + AT_ONCE])) for a in range(0, len(every), AT_ONCE)]
        order, new = grouped(np.concatenate(parts) if parts else np.zeros((0, 2), np.uint64), lambda which: self.cut(which)[0])
        #: For each piece, the number of its string among the block's different strings.
        self.string = np.empty(len(order), np.int64)
        self.string[order] = np.cumsum(new) - 1
        #: For each string, a piece that has it, its least document, and whether there are more documents.
        starts = np.flatnonzero(new)
        self.some = order[starts]
        self.least = np.minimum.reduceat(self.doc[order], starts) if len(starts) else np.zeros(0, np.int64)
        self.several = self.least != np.maximum.reduceat(self.doc[order], starts) if len(starts) else np.zeros(0, bool)

    def cut(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of some pieces, as rows padded with zeros, and their lengths."""
        first, size = self.first[which], self.size[which]
        rows = np.lib.stride_tricks.sliding_window_view(self.padded, WIDTH)[first]
        rows[np.arange(WIDTH) >= size[:, None]] = 0
        return rows, size


def signature(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each row, to bring equal strings together."""
    words = np.ascontiguousarray(rows).view(np.uint64)
    out = np.empty((len(words), 2), np.uint64)
    for k, (a, b) in enumerate(((0xA0761D6478BD642F, 0xE7037ED1A0B428DB), (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))):
        h = sizes.astype(np.uint64) * np.uint64(b)
        for c in range(words.shape[1]):
            h = (h ^ words[:, c]) * np.uint64(a)
            h ^= h >> np.uint64(29 + 3 * k)
        out[:, k] = h * np.uint64(b) ^ (h >> np.uint64(32))
    return out


def grouped(keys: np.ndarray, cut: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal strings together, and where each group starts.

    Strings of one signature are neighbours; a neighbour with other bytes starts a group.
    """
    order = np.argsort(keys[:, 0])
    first, second = keys[order].T
    if ((first[1:] == first[:-1]) & (second[1:] != second[:-1])).any():
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        first, second = keys[order].T
    new = np.r_[np.ones(min(1, len(order)), bool), (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
    same = np.flatnonzero(~new)
    for a in range(0, len(same), AT_ONCE):
        at = same[a : a + AT_ONCE]
        new[at] = (cut(order[at]) != cut(order[at - 1])).any(axis=1)
    return order, new


def earliest(rows: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each window of each string, end to end: the least document that has the window.

    The strings are laid end to end and their suffixes sorted; neighbours that share a
    whole window are one class.
    """
    width = rows.shape[1]
    inside = np.arange(width) < sizes[:, None]
    s = np.ones((len(rows), width + 1), np.int16)
    s[:, :width] = rows.astype(np.int16) + 2
    keep = np.ones_like(s, bool)
    keep[:, :width] = inside
    s = np.r_[s[keep], np.zeros(1, np.int16)]
    heads = np.cumsum(sizes + 1) - sizes - 1
    windows = sizes - WINDOW + 1
    at = np.repeat(heads, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    whole = np.zeros(len(s), bool)
    whole[at] = True
    sa = suffix_array(s, 258)
    prefix = permuted_lcp(s, sa, heads, WIDTH + 2)
    together = (prefix[sa] >= WINDOW) & whole[sa]
    doc = np.full(len(s), LAST, np.int64)
    doc[at] = np.repeat(least, windows)
    starts = np.flatnonzero(~together)
    best = np.minimum.reduceat(doc[sa], starts)
    out = np.empty(len(s), np.int64)
    out[sa] = np.repeat(best, np.diff(np.r_[starts, len(sa)]))
    return out[at]


ANSWER = "block int, keys binary, strings binary, least binary"


def ask(block: int, pieces: Pieces, shards: int) -> pa.Table:
    """The block's different strings, by shard of their anchors."""
    some = pieces.some
    shard = (pieces.hash[some] * M >> np.uint64(32)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.r_[0, np.flatnonzero(np.diff(shard[order])) + 1, len(order)] if len(order) else np.zeros(1, np.int64)
    rows = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = order[a:b]
        text, sizes = pieces.cut(some[own])
        rows.append((int(shard[own[0]]), block, own.astype(np.uint32).tobytes(), packed(text.tobytes()), sizes.astype(np.uint8).tobytes(), pieces.least[own].tobytes(), pieces.several[own].astype(np.uint8).tobytes()))
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    names = ["shard", "block", "strings", "rows", "sizes", "least", "several"]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=names)


def answer(table: pa.Table) -> pa.Table:
    """For each block's strings with a window that an earlier document may have: each window's least document."""
    t = table.select(["block", "strings", "rows", "sizes", "least", "several"]).to_pydict()
    text = np.frombuffer(b"".join(map(unpacked, t["rows"])), np.uint8).reshape(-1, WIDTH)
    sizes, least, several = (np.frombuffer(b"".join(t[c]), k) for c, k in (("sizes", np.uint8), ("least", np.int64), ("several", np.uint8)))
    sizes = sizes.astype(np.int64)
    keys = signature(text, sizes)
    order, new = grouped(keys, lambda which: text[which])
    starts = np.flatnonzero(new)
    string = np.empty(len(order), np.int64)
    string[order] = np.cumsum(new) - 1
    some = order[starts]
    found = earliest(text[some], sizes[some], np.minimum.reduceat(least[order], starts))
    windows = sizes - WINDOW + 1
    begins = (np.cumsum(windows[some]) - windows[some])[string]
    rows, at = [], 0
    for block, strings in zip(t["block"], t["strings"], strict=True):
        ids = np.frombuffer(strings, np.uint32)
        own = np.arange(at, at + len(ids))
        at += len(ids)
        flat = np.repeat(begins[own], windows[own]) + np.arange(windows[own].sum()) - np.repeat(np.cumsum(windows[own]) - windows[own], windows[own])
        docs = found[flat]
        heads = np.cumsum(windows[own]) - windows[own]
        tell = (several[own] > 0) | (np.minimum.reduceat(docs, heads) < least[own])
        if tell.any():
            rows.append((block, None, ids[tell].tobytes(), packed(docs[np.repeat(tell, windows[own])].tobytes())))
    types = [pa.int32(), *[pa.binary()] * 3]
    out = pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, types, strict=True)], names=["block", "keys", "strings", "least"])
    del text, keys, found, string, order
    give_back()
    return out


def removed(pieces: Pieces, answers: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Which bytes of the block's texts go."""
    windows = pieces.count[pieces.some]
    begin = np.full(len(windows), -1, np.int64)
    docs, at = [], 0
    for strings, least in answers:
        ids = np.frombuffer(strings, np.uint32)
        docs.append(np.frombuffer(unpacked(least), np.int64))
        begin[ids] = at + np.cumsum(windows[ids]) - windows[ids]
        at += len(docs[-1])
    cover = np.zeros(len(pieces.data) + 1, np.int32)
    if docs:
        docs = np.concatenate(docs)
        asked = np.flatnonzero(begin[pieces.string] >= 0)
        n = pieces.count[asked]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = docs[np.repeat(begin[pieces.string[asked]], n) + k] < np.repeat(pieces.doc[asked], n)
        first = (np.repeat(pieces.first[asked], n) + k)[hit]  # no window is in two pieces
        cover[first] += 1
        cover[first + WINDOW] -= 1
    return np.cumsum(cover[:-1]) > 0


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, decode: bool = False) -> DataFrame:
    """Remove each byte covered by a 50-byte string that also starts in an earlier document.

    Returns, for every row: doc_id, n_bytes, n_removed, n_spans, kept (the bytes left; with
    ``decode`` the text left, without characters of which a part is gone), and the columns
    ``carry`` as they were.

    1. Each 50-byte window has an anchor, and equal windows have equal anchors. Mappers
       list the anchors of every text; a bucket of hashes finds those of two documents.
    2. Blocks of documents cut the pieces around such anchors and send each different
       string once to the shard of its anchor, with the least document that has it.
    3. A shard lays its different strings end to end, sorts their suffixes by induced
       sorting, and finds from permuted common prefixes which windows are the same.
    4. The shard tells each block the least document of its windows, and the block
       removes what an earlier document has.

    A passage or a group of copies that a third of all rows hold is one anchor for each
    UNIT of text in its bucket and one string for each BLOCK in its shard, so no task gathers
    its documents. Null text counts as empty; texts under 50 bytes take no part. Very long
    text: one block holds it whole. Null doc_ids come after all others. Rows with one doc_id
    are one document: they don't remove each other's bytes, and are dealt by their texts.
    Ties: a window's least doc_id decides, so the order of equal ids doesn't matter. Empty
    table: no rows. Extra columns are ignored unless carried.
    """
    carry = carry or []
    names = [f"carry_{i}" for i in range(len(carry))]
    picked = pick(docs, doc_id=doc_id, text=text, **dict(zip(names, carry, strict=True)))
    picked = picked.withColumn("text", F.col("text").cast("binary"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    total = picked.agg(F.sum(size)).first()[0] or 0
    blocks, buckets, shards = max(1, -(-total // BLOCK)), max(1, -(-total // (CHOICES // 2 * BUCKET))), max(1, -(-total // SHARD))
    rows = picked.filter(size >= WINDOW).withColumn("block", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(blocks)).cast("int"))
    found = staged(shared_anchors(list_anchors(rows, buckets)), "anchors")
    by_block = rows.groupBy("block")

    def send(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = ask(key[0].as_py(), Pieces(left, right.column("keys").to_pylist(), buckets), shards)
        give_back()
        return out

    asked = by_block.cogroup(found.groupBy("block")).applyInArrow(send, "shard int, block int, strings binary, rows binary, sizes binary, least binary, several binary")
    told = asked.groupBy("shard").applyInArrow(answer, ANSWER)
    both = found.select("block", "keys", F.lit(None).cast("binary").alias("strings"), F.lit(None).cast("binary").alias("least")).union(told)
    fields = ", ".join(f"{n} {picked.schema[n].dataType.simpleString()}" for n in names)

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        r = right.to_pydict()
        pieces = Pieces(left, [x for x in r["keys"] if x is not None], buckets)
        gone = removed(pieces, [(s, x) for s, x in zip(r["strings"], r["least"], strict=True) if s is not None])
        lost, spans, kept, at = [], [], [], 0
        for n in pieces.lens.tolist():
            own = gone[at : at + n]
            lost.append(int(own.sum()))
            spans.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()))
            left_over = (pieces.data[at : at + n][~own] if lost[-1] else pieces.data[at : at + n]).tobytes()
            kept.append(left_over.decode("utf-8", "ignore") if decode else left_over)
            at += n
        left = left.take(pa.array(pieces.order, pa.int64()))
        new = [left.column("doc_id"), pa.array(pieces.lens), pa.array(lost, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string() if decode else pa.binary())]
        del pieces, gone, kept
        give_back()
        return pa.table(new + [left.column(n) for n in names], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *names])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept " + ("string" if decode else "binary") + (f", {fields}" if fields else "")
    out = by_block.cogroup(both.groupBy("block")).applyInArrow(finish, schema)
    whole = F.coalesce("text", F.lit("").cast("binary"))
    none = F.lit(0).cast("long")
    short = picked.filter(size < WINDOW).select("doc_id", size.cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), (whole.cast("string") if decode else whole).alias("kept"), *names)
    out = out.union(short)
    return out.toDF("doc_id", "n_bytes", "n_removed", "n_spans", "kept", *carry)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
