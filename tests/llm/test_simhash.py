import re

import numpy as np
import pytest
import xxhash

from stanzagraph.llm import graph
from stanzagraph.llm.graph import components
from stanzagraph.llm.simhash import blocks, fingerprint, near_duplicates, similar, trie_links


def brute_fp(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(fps, budget):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", "One", "A b C", "a b c d", "É a B ç d e f A b c d", "x " * 400, "w1 w2 w3 w4 w5 w6 w7 w8"])
def test_fingerprint(text):
    assert fingerprint(text.encode()) == brute_fp(text)


def clouds(seed, n=300):
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        base = int(rng.integers(0, 2**63)) * 2
        for _ in range(int(rng.integers(1, 40))):
            x = base
            for b in rng.integers(0, 64, int(rng.integers(0, 7))):
                x ^= 1 << int(b)
            out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("seed", range(5))
def test_trie_links_all_pairs(seed):
    fps = clouds(seed)
    got = trie_links(np.zeros(len(fps), np.int64), np.asarray(fps, np.uint64), 4)
    assert got.tolist() == roots(fps, 4)


def test_tables_miss_no_link(spark):
    fps = clouds(9)
    reps = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    for n in (10, 10**8):  # other numbers of blocks
        got = {r.node: r.root for r in components(similar(reps, n, 4)).collect()}
        signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
        want = roots(fps, 4)
        mine = [got.get(s, s) for s in signed]
        groups = lambda xs: sorted(map(sorted, {k: [i for i, x in enumerate(xs) if x == k] for k in set(xs)}.values()))
        assert groups(mine) == groups(want)
    assert blocks(10, 4) == 5 < blocks(10**8, 4)


def test_documents(spark):
    base = " ".join(f"word{i}" for i in range(300))
    texts = [base, base + " end", None, "", "other text entirely here now", base.upper(), base, " \t", "Other  text entirely\nhere now"]
    docs = spark.createDataFrame([(i + 10, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fp, r.component_id) for r in near_duplicates(docs).collect()}
    fps = [brute_fp(t) for t in texts]
    assert [got[i + 10][0] % 2**64 for i in range(len(texts))] == fps
    assert [got[i + 10][1] - 10 for i in range(len(texts))] == roots(fps, 4)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_unfinished_components_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_ROUNDS", 1)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="rounds"):
        graph.components(edges)
