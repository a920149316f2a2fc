from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stanzagraph.llm.token_counts import TokenRollup, count_tokens, deltas, op9_token_rollup, revisions


def test_rollup(spark, tmp_path):
    rows = spark.createDataFrame([("s", "en", 5, 7), ("s", None, 1, 1), (None, "en", None, 2)], "source string, lang string, n long, m long")
    r = TokenRollup(spark, f"file://{tmp_path}/r")
    assert r.totals().count() == 0
    assert r.commit("a", deltas(rows, 1, "t1", "n")) and not r.commit("a", deltas(rows, 1, "t1", "n"))
    assert r.commit("b", revisions(rows, "t1", "n", "m"))
    state = lambda: sorted(map(str, r.totals().collect()))
    before = state()
    r.compact()
    assert state() == before and not r.commit("b", deltas(rows, 1, "t1", "n")) and r.batches() == {"a", "b"}
    r.commit("c", deltas(rows, -1, "t1", "m"))
    assert state() == []


def some(spark, n=3):
    return spark.createDataFrame([("s", "en", i, "extra", 1) for i in range(n)] + [("s", "en", 1, "extra", 1)], "source string, lang string, n long, Source string, Documents int")


def test_only_one_of_several_committers_adds_a_batch(spark, tmp_path):
    made = [TokenRollup(spark, f"file://{tmp_path}/r") for _ in range(6)]
    rows = deltas(some(spark), 1, "t", "n")
    with ThreadPoolExecutor(6) as pool:
        won = list(pool.map(lambda r: r.commit("same", rows), made))
        each = list(pool.map(lambda k: made[k].commit(f"own-{k}", rows), range(6)))
    assert sum(won) == 1 and all(each)
    assert [tuple(r) for r in made[0].totals().collect()] == [("s", "en", "t", 4 * 7, 4 * 7)]
    assert made[0].batches() == {"same", *(f"own-{k}" for k in range(6))}


def test_what_is_killed_changes_nothing(spark, tmp_path, monkeypatch):
    r = TokenRollup(spark, f"file://{tmp_path}/r")
    rows = deltas(some(spark), 1, "t", "n")
    r.commit("a", rows)
    r.commit("b", rows)
    state = lambda: [tuple(x) for x in r.totals().collect()]
    before = state()

    def killed(*_):
        raise KeyboardInterrupt

    for act in (lambda: r.commit("c", rows), r.compact):
        with monkeypatch.context() as m:
            m.setattr(r, "_publish", killed)
            with pytest.raises(KeyboardInterrupt):
                act()
        assert state() == before and r.batches() == {"a", "b"}
    r.compact()
    assert state() == before
    assert r.commit("c", rows) and not r.commit("c", rows)
    r.vacuum()
    assert state() == [("s", "en", "t", 12, 12)] and r.batches() == {"a", "b", "c"}
    with pytest.raises(ValueError):
        r.commit("../x", rows)


def test_a_commit_during_a_compaction_stays(spark, tmp_path, monkeypatch):
    r, other = (TokenRollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    rows = deltas(some(spark), 1, "t", "n")
    r.commit("a", rows)
    r.commit("b", rows)
    own = r._written
    monkeypatch.setattr(r, "_written", lambda df: (own(df), other.commit("c", rows))[0])
    r.compact()
    assert [tuple(x) for x in r.totals().collect()] == [("s", "en", "t", 12, 12)] and r.batches() == {"a", "b", "c"}


def test_counts_are_the_tokenizers_own(spark):
    texts = [None, "", "Hello  world\n it's 12 o'clock", "x" * 30_000, "été 日本 🙂" * 50, "<|endoftext|> a", "word " * 20_000, "same", "same"]
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, Text string")
    paths = {"w": "word_bpe_49k.json", "b": "byte_bpe_50k.tiktoken"}
    got = {r.doc_id: (r.w, r.b) for r in count_tokens(docs, {k: public_tokenizers.path(p) for k, p in paths.items()}, keep=["doc_id"]).collect()}
    w, b = (Tokenizer.from_file(public_tokenizers.path(f"{n}.json")) for n in ("word_bpe_49k", "byte_bpe_50k"))
    b.encode_special_tokens = True
    assert got == {i: tuple(len(t.encode(x or "", add_special_tokens=False).ids) for t in (w, b)) for i, x in enumerate(texts)}
    assert count_tokens(docs.limit(0), {"w": public_tokenizers.path("word_bpe_49k.json")}).count() == 0


def test_the_query_against_the_tokenizers(spark):
    sf = "/root/testdata/sf0.001"
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1").collect()}
    want = Counter()
    for name in ("word_bpe_49k", "byte_bpe_50k"):
        t = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        t.encode_special_tokens = name != "word_bpe_49k"
        for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
            if r.doc_id not in toxic:
                want[r.source, r.lang, name, "documents"] += 1
                want[r.source, r.lang, name, "tokens"] += len(t.encode(r.text or "", add_special_tokens=False).ids)
    got = op9_token_rollup(spark, sf).collect()
    assert {(r.source, r.lang, r.tokenizer, k): r[k] for r in got for k in ("documents", "tokens")} == dict(want)
