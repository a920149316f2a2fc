import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stanzagraph.llm.packing import WordTokens, pack, packed_digest, plan_slots, readable

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "Hello  world,\tit's 12 o'clock", "été \x1c\x1d odd", "<|endoftext|> a<|startoftext|>b", "word " * 9000, "İstanbul ΣΑΣ é", "x" * 500, "same", "same", "Word, WORD. Été! ÀÇ\u0301É;; ǅungla ß ſ x<|endoftext|> isn't I'M 's' (a) a.b 3kg ªº Ω µ Ĳ ŉ \u0130x e\u0301t\u0301 naïve-ly"]


def fits(counts, capacity):
    """Every rank of every length has one slot; sequences hold no more than they can."""
    used, seen = {}, {}
    rows = plan_slots(counts, capacity)
    by = {}
    for r in rows.tolist():
        by.setdefault(r[0], []).append(r)
    for length, n in counts.items():
        own = sorted(by[length], key=lambda r: r[1])
        for r, nxt in zip(own, [*own[1:], [0, n]]):
            for k in range(nxt[1] - r[1]):
                seq, off = r[3] + k // r[2], r[4] + k % r[2] * length
                used.setdefault(seq, []).append((off, length))
                seen[length] = seen.get(length, 0) + 1
    assert seen == {k: v for k, v in counts.items() if v}
    for spans in used.values():
        at = 0
        for off, length in sorted(spans):
            assert off == at
            at += length
        assert at <= capacity
    return len(used)


def best_fit(counts, capacity):
    room = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            ok = [i for i, x in enumerate(room) if x >= length]
            if ok:
                room[min(ok, key=lambda i: room[i])] -= length
            else:
                room.append(capacity - length)
    return len(room)


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 60))
    counts = {int(k): int(rng.integers(1, 30)) for k in rng.choice(np.arange(1, capacity + 1), size=min(capacity, 12), replace=False)}
    assert fits(counts, capacity) == best_fit(counts, capacity)


def test_pieces_match_the_tokenizer(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, Length int")
    got = packed_digest(docs).collect()
    t = Tokenizer.from_file(PATH)
    want = set()
    for i, text in enumerate(TEXTS):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            own = ids[s : s + 4096]
            want.add((i, k, s, len(own), zlib.crc32(np.asarray(own, "<u4").tobytes())))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want
    spans = {}
    for r in got:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in spans.values():
        at = 0
        for off, n in sorted(own):
            assert off == at
            at += n
        assert at <= 4096


def test_empty_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pack(none, PATH).count() == 0
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "doc_id long, text string")
    assert pack(rows, PATH).count() == 3


def test_chunks_of_many_texts_match_the_tokenizer():
    """Any signs, letters of other scripts, white space of all kinds; the same with words remembered or not."""
    letters = [*map(chr, range(32, 127)), *"éÀßΣİΩ中\u0301\u0149\x1c\t\n\x85\u3000'", "<|endoftext|>", "'s", " word", " THE"]
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(letters, n)) for n in rng.integers(0, 30, 5000)]
    words, t = WordTokens(PATH), Tokenizer.from_file(PATH)
    want = [t_bytes(t, x) for x in texts]
    for _ in range(2):
        assert words.encode_all(pa.array(texts)) == want
    assert words.encode_all(pa.array([], pa.string())) == [] and words.encode_all(pa.array(["", " \n"])) == [b"", b""]
    assert words.encode_all(readable(pa.array([None, b"a\xffb", "é".encode()]))) == [t_bytes(t, x) for x in ("", "a\ufffdb", "é")]


def t_bytes(tokenizer, text):
    return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
