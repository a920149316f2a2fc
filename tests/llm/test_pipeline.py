import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from brute_leaks import leaks
from pyspark.sql import functions as F
from test_quality_rules import brute as brute_rules
from test_quality_rules import verdicts
from test_simhash import brute_fp, roots
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def failed(text):
    n, *_, again = brute_rules(text or "")
    return n < 50 or 100 * again > 50 * n


def rules(rows):
    hosts = defaultdict(list)
    for r in rows:
        hosts[r[3]].append(failed(r[1]))
    refused = verdicts({h: (len(v), sum(v)) for h, v in hosts.items()})
    return [r for r in rows if not failed(r[1]) and not refused[r[3]][1]]


def near(rows):
    rank = lambda r: (r[0] is None, r[0] or 0)
    rows = sorted(rows, key=rank)
    group = roots([brute_fp(r[1]) for r in rows], 4)
    return [r for i, r in enumerate(rows) if group[i] == i]


def passages(rows):
    order = lambda r: float("inf") if r[0] is None else r[0]
    first, out = {}, []
    for r in rows:
        t = r[1].encode()
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(order(r), first.get(t[i : i + 50], order(r)))
    for r in rows:
        t = r[1].encode()
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < order(r):
                gone[i : i + 50] = b"\1" * 50
        text = bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore")
        out.append((r[0], text, *r[2:4], len(text)))
    return out


def test_stages_and_result_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    fine = " ".join(f"plain{i} words{i * 7}" for i in range(60))
    more = [(None, fine + " ends here", "en", "news", 9), (None, fine + " ends here", "en", "news", 9), (9001, None, "en", None, 0), (9002, "", None, "news", None), (9003, "other " + fine[::-1], None, None, None), (9003, "other " + fine[::-1], None, None, None)]
    docs = docs.union(spark.createDataFrame(more, docs.schema)).withColumn("x", F.lit(1))
    sf = f"file://{tmp_path}"
    docs.repartition(5).write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    want = [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()]
    made = spark.read.parquet(f"{sf}/documents.parquet")
    brute = [rules, near, passages, lambda rows: [r for r in rows if not any(leaks(r[1], i) for i in items)]]
    for k, ((name, stage), slow) in enumerate(zip(corpus_pipeline.STAGES, brute, strict=False)):
        before, want = want, slow(want)
        stage(spark, made, sf).write.parquet(f"{sf}/stage{k}")
        made = spark.read.parquet(f"{sf}/stage{k}")
        assert made.columns == corpus_pipeline.COLUMNS
        assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, want)), name
        assert want and (name == "suffix_array_dedup" and want != before or len(want) < len(before)), name

    tokenizer, cut = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for r in want:
        ids = np.asarray([*tokenizer.encode(r[1], add_special_tokens=False).ids, 1], "<u4")
        cut += [(r[0], at // 4096, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for at in range(0, len(ids), 4096)]
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(str, cut)) == sorted(str(tuple(r)[:5]) for r in got)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) <= 1 + 1.1 * sum(x[3] for x in cut) / 4096


def test_groups_that_share_an_id_each_keep_a_row(spark):
    rng = np.random.default_rng(2)
    a, b = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(2))
    rows = [(5, a), (7, a), (5, b), (9, b), (None, a), (None, "alone " + b[::-1]), (None, "alone " + b[::-1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, Text int")
    got = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("5", a), ("5", b), ("None", "alone " + b[::-1])])


def test_all_stages_with_clashing_columns_and_a_very_long_text(spark, tmp_path):
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    rows = [(i, text(70), "en", "s", 1, i, None) for i in range(12)] + [(50, text(30_000), None, None, None, 7, 1.5), (None, text(60), "en", "s", 1, 0, 0.0)]
    sf = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, sequence_id int, key double").write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    assert sum(r.length for r in got if r.doc_id == 50) > 30_000 and max(r.piece for r in got if r.doc_id == 50) > 5


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
