"""Best-fit packing of tokenized documents into fixed-length sequences."""

from __future__ import annotations

import json
import re
import string
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stanzagraph.llm.common import Bounded, give_back, per_process, pick, slices, staged, with_bases

PIECES = "doc_id long, piece int, start long, length int, ids binary, part int, local_rank long"
PACKED = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
#: Bytes that a task's ids of chunks, of lower-case words and of signs after them may take.
REMEMBERED = 24 << 20, 80 << 20, 4 << 20


def byte_letters() -> str:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable in Latin-1, else the next from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(others)) for b in range(256))


class WordTokens:
    """White-space-separated chunk -> its ids as little-endian uint32 bytes.

    The tokenizers this serves never merge across white space, so a text's ids are its
    chunks' ids end to end. In those that lower-case and part letters from other signs,
    a word of Latin letters goes straight to the merges, and signs after it are encoded
    on their own; all else goes through the whole tokenizer.
    """

    #: White space to str.split() but not to the tokenizer's patterns.
    ODD = re.compile("[\x1c-\x1f]")
    #: The steps under which words of letters may go straight to the merges.
    STEPS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks, self.words, self.signs = map(Bounded, REMEMBERED)
        self.merges = None
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        try:
            before = made["pre_tokenizer"]["pretokenizers"]
            steps = [x["type"] for x in made["normalizer"]["normalizers"]], [x["type"] for x in before], before[0]["pattern"]["Regex"]
        except (KeyError, TypeError):
            steps = None
        if steps == self.STEPS and made["model"]["type"] == "BPE":
            m = made["model"]
            pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
            self.merges = BPE(vocab=m["vocab"], merges=pairs, end_of_word_suffix=m["end_of_word_suffix"], cache_capacity=0)
            self.letters = dict(enumerate(byte_letters()))

    def direct(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes | None:
        """Ids of a word of Latin letters; None if it turns out to hold anything else."""
        ids = self.words.get(word)
        if ids is not None:
            return ids
        if word.isascii():
            low = spelt = word.lower()
        else:
            low = "".join(map(str.lower, unicodedata.normalize("NFC", word)))
            if not low.isalpha():
                return None
            spelt = low.encode().decode("latin-1").translate(self.letters)
        return (None if low is word else self.words.get(low)) or self.merged(low, spelt)

    def merged(self, low: str, spelt: str) -> bytes:
        """Ids of a lower-case word that isn't known yet, by its letters in the vocabulary's spelling."""
        got = [t.id for t in self.merges.tokenize(spelt)]
        ids = struct.pack(f"<{len(got)}I", *got)
        self.words.keep(low, ids, len(ids))
        return ids

    def chunk(self, chunk: str) -> bytes:
        ids = None
        base = chunk.rstrip(string.punctuation)
        if self.merges is not None and base.isalpha() and (base.isascii() or max(base) < "\u0250"):
            ids = self.word(base)
            if ids is not None and len(base) < len(chunk):
                end = chunk[len(base) :]
                tail = self.signs.get(end)
                if tail is None:
                    tail = self.direct(end)
                    self.signs.keep(end, tail, len(tail))
                ids += tail
        if ids is None:
            ids = self.direct(chunk)
        self.chunks.keep(chunk, ids, len(ids))
        return ids

    def different(self, chunks: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of each of some different chunks. ASCII words with at most one sign behind them are taken apart by Arrow."""
        known, chunk, merged = self.chunks.get, self.chunk, self.merged
        if self.merges is None:
            return pa.array([known(c) or chunk(c) for c in chunks.to_pylist()], pa.large_binary())
        base = pc.utf8_rtrim(chunks, characters=string.punctuation)
        behind = pc.subtract(pc.binary_length(chunks), pc.binary_length(base))
        plain = pc.and_(pc.ascii_is_alpha(base), pc.less_equal(behind, 1)).to_numpy(zero_copy_only=False)
        easy, hard = pa.array(np.flatnonzero(plain)), pa.array(np.flatnonzero(~plain))
        low = pc.ascii_lower(base.take(easy)).dictionary_encode()
        known_word = self.words.get
        words = pa.array([known_word(w) or merged(w, w) for w in low.dictionary.to_pylist()], pa.large_binary())
        end = pc.if_else(pc.equal(behind.take(easy), 1), pc.utf8_slice_codeunits(chunks.take(easy), -1), "").dictionary_encode()
        signs = pa.array([self.direct(e) for e in end.dictionary.to_pylist()], pa.large_binary())
        joined = pc.binary_join_element_wise(words.take(low.indices), signs.take(end.indices), pa.scalar(b"", pa.large_binary()))
        others = pa.array([known(c) or chunk(c) for c in chunks.take(hard).to_pylist()], pa.large_binary())
        place = np.empty(len(plain), np.int64)
        place[plain], place[~plain] = np.arange(len(easy)), len(easy) + np.arange(len(hard))
        return pa.concat_arrays([joined, others]).take(pa.array(place))

    def encode_all(self, texts: pa.StringArray) -> list[bytes]:
        """Ids of each text (none null). A chunk is looked up once, however often the texts have it."""
        odd = pc.match_substring_regex(texts, self.ODD.pattern)
        split = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        coded = split.flatten().dictionary_encode()
        ids = self.different(coded.dictionary).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)[split.offsets.to_numpy()].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        out = [bytes(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.direct(texts[i].as_py())
        return out

    def forget(self) -> None:
        """Free what was remembered: a pool of idle workers would hold as many copies. The tokenizer stays."""
        self.chunks, self.words, self.signs = map(Bounded, REMEMBERED)
        give_back(keep=True)


def readable(texts: pa.Array) -> pa.StringArray:
    """Bytes as text: null is empty, and what isn't UTF-8 becomes replacement characters."""
    try:
        return pc.fill_null(texts.cast(pa.string()), "")
    except pa.ArrowInvalid:
        return pa.array([(t or b"").decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


def tokenize_pieces(docs: DataFrame, tokenizer: str, max_tokens: int, end_id: int) -> DataFrame:
    """Pieces of at most ``max_tokens`` ids, numbered by length within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, part = per_process(("words", tokenizer), lambda: WordTokens(tokenizer)), TaskContext.get().partitionId()
        end = np.asarray([end_id], "<u4").tobytes()
        seen = np.zeros(max_tokens + 1, np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids", pa.binary()), ("part", pa.int32()), ("local_rank", pa.int64())])
        for some in slices(batches, 1):
            rows: list[tuple] = []
            for doc_id, ids in zip(some.column(0).to_pylist(), words.encode_all(readable(some.column(1))), strict=True):
                ids += end
                for piece, start in enumerate(range(0, len(ids) // 4, max_tokens)):
                    own = ids[4 * start : 4 * (start + max_tokens)]
                    n = len(own) // 4
                    rows.append((doc_id, piece, start, n, own, part, int(seen[n])))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        words.forget()

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, PIECES)


def plan_slots(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over a histogram of lengths.

    Lengths go from longest to shortest; a length goes to the open sequences with the
    least sufficient room, as many copies in each as fit. Sequences with the same room
    are one entry, so the work and the plan follow the number of lengths, not of
    documents: each length ends at most one entry early and opens at most two.

    Rows of the result: length, first rank, copies in each sequence, first sequence,
    offset of the first copy. Ranks of a length start at 0; the rows are in their order.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences (first, how many)
    slots, opened = [], 0

    def put(length: int, rank: int, n: int, first: int, left: int) -> int:
        """``n`` pieces into sequences from ``first`` on; returns how many sequences they took."""
        each = left // length
        full, rest = divmod(n, each)
        slots.append((length, rank, each, first, capacity - left))
        if full:
            room.setdefault(left - each * length, []).append((first, full))
        if rest:
            room.setdefault(left - rest * length, []).append((first + full, 1))
        return full + bool(rest)

    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        for left in sorted(x for x in room if x >= length):
            runs = room.pop(left)
            while runs and rank < n:
                first, many = runs.pop()
                take = min(n - rank, many * (left // length))
                took = put(length, rank, take, first, left)
                rank += take
                if took < many:
                    runs.append((first + took, many - took))
            if runs:
                room.setdefault(left, []).extend(runs)
            if rank == n:
                break
        if rank < n:
            opened += put(length, rank, n - rank, opened, capacity)
    return np.asarray(slots, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack every document into as few sequences of ``max_tokens`` ids as best fit finds.

    ``tokenizer`` is the path of a ``tokenizers`` file whose ids don't depend on text
    beyond white space. A document is its ids and then ``end_id``; longer ones are cut
    into whole pieces and a rest. Returns, for each piece, doc_id, piece, start, length,
    ids (little-endian uint32 bytes), sequence_id and offset.

    The driver sees only the histogram of lengths (at most ``max_tokens`` rows) and makes
    a plan of a few rows a length; a piece finds its slot by its rank within its length.

    Null or empty text: one piece with only ``end_id``. Null doc_id: packed like others.
    Very long text: tokenized whole by one task, cut into pieces. Ties: pieces of one length
    are interchangeable to the plan; which takes which slot follows the tasks' order.
    Repeated rows: each is packed. Empty table: no rows. Extra columns are ignored.
    """
    pieces = staged(tokenize_pieces(pick(docs, doc_id=doc_id, text=text), tokenizer, max_tokens, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_slots(counts, max_tokens)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    plan = plan[order]
    far = np.int64(1) << 48
    starts = plan[:, 0] * far + plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "rank"))
            _, first_rank, each, first, offset = plan[np.searchsorted(starts, length * far + rank, "right") - 1].T
            sequence, turn = np.divmod(rank - first_rank, np.maximum(each, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("piece"), batch.column("start"), pa.array(length), batch.column("ids"), pa.array(first + sequence), pa.array(offset + turn * length)],
                names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
            )

    ranked = with_bases(pieces, "length", "part", "local_rank", "rank")
    return ranked.select("doc_id", "piece", "start", "length", "ids", "rank").mapInArrow(place, PACKED)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed_digest(docs: DataFrame) -> DataFrame:
    """The packed pieces with a checksum of their ids in place of the ids."""
    import public_tokenizers

    packed = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
