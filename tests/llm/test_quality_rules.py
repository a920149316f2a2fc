import re

import duckdb
import numpy as np
import pytest

from stanzagraph.llm.quality_rules import OP5_SQL, apply_rules, host_verdicts, measure

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SAMPLES = ["", "a", "a b c a b c", "a a a a", "x\n\nx\n \nx", "é ü b\x1cc #*|", "one two three four one two three", "\r\n\v\f", "l1\nl1\nl1\n"]


def brute(t):
    w = WORD.findall(t)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    marked = {j for i, x in enumerate(win) if win.count(x) > 1 for j in range(i, i + 3)}
    lines = t.split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(marked)


@pytest.mark.parametrize("text", SAMPLES)
def test_measures(text):
    assert measure(text.encode()) == brute(text)


def verdicts(hosts):
    """{host: (n, failures)} to {host: (shrunk rate, refused)}."""
    rates = [f / n for n, f in hosts.values()]
    m, a = np.mean(rates), np.mean([1 / n for n, _ in hosts.values()])
    v = np.var(rates, ddof=1) if len(rates) > 1 else 0.0
    b = (v - m * (1 - m) * a) / (1 - a) if a < 1 else 0.0
    k = min(max(m * (1 - m) / b - 1, 1.0), 10000.0) if b > 0 else 10000.0
    limit = max(0.3, min(0.5, m + 3 * (m * (1 - m) / (k + 1)) ** 0.5))
    return {h: ((f + m * k) / (n + k), (f + m * k) / (n + k) > limit) for h, (n, f) in hosts.items()}


LONG = " ".join(f"w{i}" for i in range(80))


def of_hosts(spark, hosts):
    rows = [(h, LONG if i >= f else "bad") for h, (n, f) in hosts.items() for i in range(n)]
    return spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string").repartition(3)


def same_as_sql(docs):
    got = [(*r[:8], round(r[8], 9), r[9]) for r in apply_rules(docs).collect()]
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert sorted(map(str, got)) == sorted(map(str, con.execute(OP5_SQL).fetchall()))
    return sorted(got, key=str)


def test_same_as_sql(spark):
    rows = [(i, t, "good") for i, t in enumerate([*SAMPLES, None, *[LONG] * 30])] + [(100 + i, "bad text", "junk") for i in range(40)] + [(200 + i, LONG, "junk") for i in range(3)] + [(300, LONG, None), (301, "s", None)]
    got = same_as_sql(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert [r[7] for r in got if 200 <= r[0] < 300] == [False] * 3  # good texts of a refused host


@pytest.mark.parametrize("hosts", [{f"h{i}": (60, 5 + i % 3) for i in range(20)} | {"odd": (400, 180)}, {"a": (50, 49), "b": (4, 0), "c": (50, 2), None: (3, 2)}, {f"h{i}": (400, 36 + i % 9) for i in range(9)}, {"one": (9, 4)}, {"small": (2, 2)} | {f"h{i}": (200, 18 + i % 5) for i in range(30)}])
def test_hosts_are_judged_by_the_prior(spark, hosts):
    docs = of_hosts(spark, hosts)
    same_as_sql(docs)
    want = verdicts(hosts)
    got = {r.host: (r.shrunk_rate, r.refused) for r in host_verdicts(apply_rules(docs, carry=["source"]).withColumnRenamed("source", "host")).collect()}
    assert {h: r for h, (_, r) in got.items()} == {h: r for h, (_, r) in want.items()}
    assert all(got[h][0] == pytest.approx(want[h][0], rel=1e-9) for h in hosts)
    refused = {h for h, (_, r) in want.items() if r}
    assert refused == ({"odd"} if "odd" in hosts else {"a", None} if "a" in hosts else set())  # chance alone and two bad documents refuse nobody


def test_repeated_rows_long_texts_and_clashing_names(spark):
    long = "a b c " * 60_000
    rows = [(None, LONG, "hot", 1)] * 300 + [(1, long, "x", 2), (1, long, "x", 2), (2, None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, Source int")
    got = apply_rules(docs, carry=["Source"]).collect()
    assert sorted(r.Source for r in got) == sorted(r[3] for r in rows)
    assert all((r.n_words, r.n_repeat_words) == (180_000, 180_000) and not r.kept for r in got if r.Source == 2)
    assert all(r.kept and r.n_words == 80 for r in got if r.Source == 1)


def test_empty(spark):
    assert apply_rules(spark.createDataFrame([], "doc_id long, text string, source string, HOST int")).count() == 0
