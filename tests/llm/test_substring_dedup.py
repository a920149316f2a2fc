import hashlib

import numpy as np
import pytest

from stanzagraph.llm.substring_dedup import op6_suffix_array_dedup, remove_repeats
from stanzagraph.llm import suffix_arrays
from stanzagraph.llm.suffix_arrays import permuted_lcp, suffix_array


@pytest.mark.parametrize("seed", range(60))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(0, 400)), int(rng.integers(2, 7))
    body = rng.integers(1, k, n) if seed % 3 else np.repeat(rng.integers(1, k, n // 9 + 1), 9)[:n]
    s = np.r_[body, 0].astype(np.int16)
    want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
    sa = suffix_array(s, k)
    assert sa.tolist() == want
    heads = rng.integers(0, len(s), 3)
    got = permuted_lcp(s, sa, heads, len(s))
    for a, b in zip(want, want[1:]):
        x = 0
        while max(a, b) + x < len(s) and s[a + x] == s[b + x]:
            x += 1
        assert got[b] == x


def test_recursion_goes_on_with_large_alphabets(monkeypatch):
    levels, own = [], suffix_arrays.suffix_array
    monkeypatch.setattr(suffix_arrays, "suffix_array", lambda s, k: levels.append((len(s), k)) or own(s, k))
    rng = np.random.default_rng(8)
    words = [rng.integers(2, 28, int(n)) for n in rng.integers(2, 9, 900)]
    s = np.r_[np.concatenate([words[i] for i in rng.integers(0, 900, 30_000)]), 0].astype(np.int16)
    sa = suffix_arrays.suffix_array(s, 28)
    assert len(levels) >= 3 and levels[1][1] > 2048 and [n for n, _ in levels] == sorted((n for n, _ in levels), reverse=True)
    at = rng.integers(0, len(s) - 1, 3000)
    assert sorted(sa.tolist()) == list(range(len(s)))
    assert all(s[sa[i] :].tolist() < s[sa[i + 1] :].tolist() for i in at[:200])


def brute(rows):
    first = {}
    for d, t in rows:
        d = float("inf") if d is None else d
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(d, first.get(t[i : i + 50], d))
    out = []
    for d, t in rows:
        own = float("inf") if d is None else d
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < own:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d if d != float("inf") else None, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=str)


def test_small(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(map(chr, rng.integers(97, 105, int(rng.integers(2, 9)))))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(30), text(9)[:50]
    rows = [(5, passage), (3, text(40) + passage + text(20)), (9, passage[10:] + "é" + other), (7, other), (8, "x" * 300), (2, "x" * 60), (11, passage * 3 + other), (11, other + passage), (None, passage), (None, text(60)), (4, ""), (6, None), (12, ("ab" * 40) + passage[:49]), (1, "cab" + "ab" * 50), (20, passage), (21, passage)]
    docs = spark.createDataFrame([(d, t, "z", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, Text string, block int")
    assert got(remove_repeats(docs)) == brute([(d, (t or "").encode()) for d, t in rows])
    carried = remove_repeats(docs, carry=["block", "Text"])
    assert carried.columns[-2:] == ["block", "Text"] and sorted(r.block for r in carried.collect()) == list(range(len(rows)))


def test_test_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    out = op6_suffix_array_dedup(spark, sf)
    want = brute([(r.doc_id, (r.text or "").encode()) for r in docs])
    assert sorted(map(tuple, out.collect()), key=str) == want


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_without_an_id_over_many_blocks(spark, monkeypatch):
    from stanzagraph.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "BLOCK", 400)
    passage = " ".join(f"word{i * i}" for i in range(12))
    rows = [(None, f"{i} " * 30 + (passage if i % 2 else "")) for i in range(12)] + [(7, passage), (3, "before " + passage + " after")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(remove_repeats(docs)) == brute([(d, t.encode()) for d, t in rows])


def text_of(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(0, 10**7, n))


@pytest.mark.parametrize("hot", ["passage", "id", "copies", "no id"])
def test_a_third_of_all_rows_share(spark, monkeypatch, hot):
    from stanzagraph.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "BLOCK", 3000)
    monkeypatch.setattr(substring_dedup, "SHARD", 2000)
    monkeypatch.setattr(substring_dedup, "UNIT", 2500)
    rng = np.random.default_rng(5)
    passage, rows = text_of(rng, 14), []
    for i in range(90):
        own = text_of(rng, 20)
        third = i % 3 == 0
        rows.append({"passage": (i, own + " " + passage if third else own), "id": (1000 if third else i, own + passage if i % 2 else own), "copies": (i, passage * 3 if third else own), "no id": (None if third else i, passage if third else own + passage)}[hot])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(remove_repeats(docs)) == brute([(d, t.encode()) for d, t in rows])


def test_signatures_alone_do_not_make_strings_equal(monkeypatch, spark):
    from stanzagraph.llm import substring_dedup

    rng = np.random.default_rng(6)
    text = np.frombuffer(" ".join(text_of(rng, 9)[:80] for _ in range(40)).encode(), np.uint8)[: 40 * 80].reshape(40, 80)
    rows = text[rng.integers(0, 40, 300)]
    order, new = substring_dedup.grouped(np.zeros((300, 2), np.uint64), lambda which: rows[which])
    held = [rows[i].tobytes() for i in order]
    assert all(n == (k == 0 or held[k] != held[k - 1]) for k, n in enumerate(new.tolist()))


def test_a_very_long_text(spark):
    rng = np.random.default_rng(7)
    long = text_of(rng, 40_000)
    rows = [(3, long), (5, long[1000:3000] + "x"), (1, "y" + long[-700:]), (9, long)]
    out = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].n_removed == 0 and out[3].n_removed == 700 and out[5].n_removed == 2000 and bytes(out[5].kept) == b"x" and out[9].n_removed == len(long)
