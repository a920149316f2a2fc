import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stanzagraph.llm import language
from stanzagraph.llm.language import FILTERS, WIDTHS, ByteNet, cut, fit_languages, identify
from stanzagraph.llm.quality_neighbours import NEIGHBOURS, POWER, TERMS, Space, fit_neighbours, op3_quality_neighbours, score_quality, terms


def test_quality_space(spark):
    good, bad = b"Some plain prose with many words. It goes on.", b"SPAM!! SPAM!! ### SPAM!! $$$"
    space = Space.fit(np.stack([terms(good + bytes([97 + i])) for i in range(20)] + [terms(bad * (1 + i % 3)) for i in range(20)]), np.array([1.0] * 20 + [0.0] * 20))
    docs = spark.createDataFrame([(1, "Other plain prose, also with some words."), (2, "BUY!! ### NOW!! $$$"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: (r.score, r.predicted) for r in score_quality(docs, space).collect()}
    assert got[1][1] == 1 and got[2][1] == 0 and got[3] == got[4] == (0.5, 1)
    assert Space.fit(np.zeros((0, TERMS), np.float32), np.zeros(0)).score(np.zeros((2, TERMS), np.float32)).tolist() == [0.5, 0.5]


def test_languages_held_out(spark):
    con = duckdb.connect()
    rows = con.execute("select doc_id, text, lang from '/root/testdata/sf0.001/documents.parquet' where lang is not null").fetchall()
    learn, rest = [r for r in rows if r[0] % 3], [r for r in rows if not r[0] % 3]
    names = sorted({r[2] for r in rows})
    windows = [(w, names.index(r[2])) for r in learn for w in cut(r[1].encode())[:6]]
    net = ByteNet.new(names)
    net.train(np.stack([w for w, _ in windows]), np.asarray([k for _, k in windows]))
    docs = spark.createDataFrame([*[(r[0], r[1]) for r in rest], (-1, None), (-2, "123 !"), (-3, "")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, net).collect()}
    assert all(got[k] == ("und", 0.0) for k in (-1, -2, -3))
    assert np.mean([got[r[0]][0] == r[2] for r in rest]) > 0.9


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    kept = corpus_pipeline.quality(spark, docs, sf)
    assert kept.columns == corpus_pipeline.COLUMNS
    done = corpus_pipeline.passage_dedup(spark, kept, sf)
    assert done.columns == corpus_pipeline.COLUMNS and done.count() == kept.count()
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "best_fit_packing"


def test_neighbours_against_brute_force():
    rng = np.random.default_rng(3)
    made = [rng.poisson(2, TERMS).astype(np.float32) for _ in range(60)]
    made[5:9] = [made[4]] * 4  # equally near
    labels = rng.integers(0, 2, 60).astype(float)
    space = Space.fit(np.stack(made), labels)
    asked = np.stack([made[4], *[rng.poisson(2, TERMS).astype(np.float32) for _ in range(9)], np.zeros(TERMS, np.float32)])
    place = lambda x: space.embed(np.stack([x]))[0].astype(float)
    known = [place(x) for x in made]
    for x, got in zip(asked, space.score(asked)):
        near = sorted(((float(place(x) @ v), k) for v, k in zip(known, labels)), reverse=True)
        voting = [(max(c, 0) ** POWER, k) for c, k in near if c >= near[NEIGHBOURS - 1][0] - 1e-6]
        total = sum(w for w, _ in voting)
        assert got == pytest.approx(sum(w * k for w, k in voting) / total if total else labels.mean(), abs=1e-4)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in op3_quality_neighbours(spark, sf).collect()]
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    judged = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and labels.get(r.doc_id) is not None]
    assert len(judged) > 40 and np.mean([a == b for a, b in judged]) > 0.9


def test_quality_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "plain words here", 0)] * 50 + [(None, "x", 0), (2, None, 1), (3, "SPAM!! $$$ " * 20_000, 1)], "doc_id long, text string, Text int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (2, None)], "doc_id long, quality int")
    space = fit_neighbours(docs, labels, F.lit(True), most=20)
    assert len(space.labels) == 20 and set(space.labels) <= {0.0, 0.5}
    assert score_quality(docs, space).count() == 53
    none = fit_neighbours(docs.limit(0), labels.limit(0), F.lit(True))
    assert {r.score for r in score_quality(docs, none).collect()} == {0.5} and score_quality(docs.limit(0), none).count() == 0


def slow_logits(net, window):
    """The network place by place."""
    sums = []
    for f in range(net.filters.shape[2]):
        width = WIDTHS[f // FILTERS]
        places = [sum(float(net.embed[window[p + k]] @ net.filters[k, :, f]) for k in range(width)) for p in range(len(window) - max(WIDTHS) + 1)]
        sums.append(max(0.0, max(places) + float(net.bias[f])))
    return np.asarray(sums) @ net.out + net.out_bias


def test_convolution_against_brute_force():
    rng = np.random.default_rng(9)
    net = ByteNet.new(["a", "b", "c"])
    windows = rng.integers(0, 256, (3, 192)).astype(np.uint8)
    for w, got in zip(windows, net.log_probabilities(windows)):
        z = slow_logits(net, w)
        assert got == pytest.approx(z - np.log(np.exp(z).sum()), abs=1e-4)


def test_training_follows_the_gradient(monkeypatch):
    """One step of Adam moves each weight against the sign of the loss's numerical slope."""
    rng = np.random.default_rng(10)
    windows, labels = rng.integers(97, 110, (8, 192)).astype(np.uint8), rng.integers(0, 3, 8)
    monkeypatch.setattr(language, "EPOCHS", 1)
    start, done = ByteNet.new(["a", "b", "c"]), ByteNet.new(["a", "b", "c"])
    done.train(windows, labels)
    loss = lambda net: -net.log_probabilities(windows)[np.arange(8), labels].mean()
    for name, at in (("out", (3, 1)), ("out_bias", (2,)), ("filters", (0, 2, 5)), ("filters", (1, 0, 20)), ("embed", (100, 3)), ("embed", (104, 0))):
        slopes = []
        for by in (2e-3, -2e-3):
            net = ByteNet.new(["a", "b", "c"])
            getattr(net, name)[at] += by
            slopes.append(loss(net))
        slope, moved = slopes[0] - slopes[1], getattr(done, name)[at] - getattr(start, name)[at]
        assert abs(slope) < 1e-5 or np.sign(moved) == -np.sign(slope), (name, at, slope, moved)


def test_languages_of_odd_tables(spark):
    rows = [(i, "the words of this text are english words " * 9 if i % 2 else "ces mots sont des mots dans une langue " * 9, "en" if i % 2 else "fr", 1) for i in range(40)]
    rows += [(1, rows[1][1], "en", 1)] * 30 + [(None, None, "en", 1), (100, "the words " * 60_000, "en", 2), (101, "", "fr", 0), (102, "12", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, Lang int")
    net = fit_languages(docs, F.coalesce(F.col("doc_id") != 100, F.lit(True)))
    again = fit_languages(docs.repartition(5), F.coalesce(F.col("doc_id") != 100, F.lit(True)))
    assert net.languages == ["en", "fr"] and all((a == b).all() for a, b in ((net.embed, again.embed), (net.out, again.out)))
    got = identify(docs, net).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.lang_pred) for r in got if r.doc_id in (100, 101, 102)} == {(100, "en"), (101, "und"), (102, "und")}
    none = fit_languages(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in identify(docs, none).collect()} == {"und"} and identify(docs.limit(0), net).count() == 0


def test_every_window_of_a_text_may_be_learnt(spark, monkeypatch):
    held = []
    monkeypatch.setattr(ByteNet, "train", lambda self, windows, labels: held.append(len(windows)))
    rng = np.random.default_rng(12)
    docs = spark.createDataFrame([(1, " ".join(map(str, rng.integers(0, 10**6, 30_000))), "en")], "doc_id long, text string, lang string")
    n = -(-len(docs.first().text) // 192)
    fit_languages(docs, F.lit(True), most=10**6)
    fit_languages(docs, F.lit(True), most=200)
    assert held[0] == n > 900 and 140 < held[1] < 260
