import random
import string

import numpy as np
import pytest
from brute_leaks import leaks

from stanzagraph.llm import decontamination
from stanzagraph.llm.decontamination import find_leaks, op10_template_decontamination


@pytest.mark.parametrize("bytes_each", [10**9, 40])
def test_leaks(spark, monkeypatch, bytes_each):
    monkeypatch.setattr(decontamination, "BYTES_EACH", bytes_each)
    item = "A train leaves Paris at 9 am and travels 120 km in 2 hours while Paris sleeps quietly"
    other = item.replace("Paris", "Rome").replace("120", "300")
    mixed = item.replace("Paris", "Rome", 1)
    docs = spark.createDataFrame([(1, "x y. " + item), (2, other + " end"), (3, mixed), (4, item[:30]), (5, None), (6, ""), (7, item.upper())], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, "5 6 7 8 9")], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.item_id, r.kind) for r in find_leaks(docs, bench).collect()}
    assert got[1] == (True, 10, "verbatim") and got[2] == (True, 10, "reparameterised")
    assert got[3] == (True, 10, "reparameterised")  # Paris stands for two names, but 8 of the 9 windows agree
    assert not any(got[k][0] for k in (4, 5, 6))
    assert find_leaks(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert find_leaks(docs.limit(0), bench).count() == 0


def test_leaks_in_other_case_and_punctuation(spark):
    item = "A train leaves Paris at 9 am and travels 120 km in 2 hours while Paris sleeps quietly"
    inside = "Well-known facts. Don't ask Groß why y and o or a aren't here! Then: 3.5 km - or (so) he said; she wasn't sure."
    made = [item, inside, "Go there. Stop here. Nobody knows. Y o a é i u. Then all went home."]
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").orderBy("item_id").collect()]
    items = made + given
    signs = str.maketrans(dict.fromkeys(string.punctuation, ""))
    spaces = str.maketrans(dict.fromkeys(string.punctuation, " "))
    changes = [str, str.upper, str.lower, str.title, lambda t: t.translate(signs), lambda t: t.translate(spaces), lambda t: t.translate(signs).upper(), lambda t: t.translate(spaces).lower()]
    filler = "some other words stand here "
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for k, change in enumerate(changes):
        docs = spark.createDataFrame([(i, filler + change(t) + " " + filler) for i, t in enumerate(items)], "doc_id long, text string")
        missed = [r.doc_id for r in find_leaks(docs, bench).filter("not contaminated").collect()]
        assert not missed, (k, missed)
    docs = spark.createDataFrame([(7, item.upper()), (8, item.upper().replace("120", "300")), (9, "ALL OTHER WORDS " * 9)], "doc_id long, text string")
    got = {r.doc_id: (r.item_id, r.kind) for r in find_leaks(docs, bench.filter("item_id = 0")).collect()}
    assert got == {7: (0, "verbatim"), 8: (0, "reparameterised"), 9: (None, None)}


def test_leaks_of_items_with_repeated_windows(spark):
    item = "In a box there are 3 red balls and on the table there are 4 red balls, so how many red balls are there in all?"
    first, second = "On the big table there are 3 red balls in a box.", "On the big table there are 4 red balls in a box."
    texts = [
        item,
        item.replace("4", "9"),
        item.replace("3", "8").replace("4", "9"),
        "There are 7 red balls and on the table. " + item,
        f"{first} Well now. {second}".replace("3", "5"),
        f"{second} {first}",
        "In a box there are 3 red balls and then on another day they went out.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = [r.kind for r in find_leaks(docs, bench).orderBy("doc_id").collect()]
    assert got == ["verbatim", "reparameterised", "reparameterised", "verbatim", None, None, None]
    bench = spark.createDataFrame([(1, f"{first} {second}")], "item_id long, text string")
    got = [r.kind for r in find_leaks(docs, bench).orderBy("doc_id").collect()]
    assert got[:4] == [None] * 4 and got[6] is None
    twice = "Tom has 3 red balls in a box and Ann has 3 red balls in a bag."
    bench = spark.createDataFrame([(1, twice)], "item_id long, text string")
    docs = spark.createDataFrame([(0, twice.replace("3", "5")), (1, twice.replace("3", "5", 1))], "doc_id long, text string")
    assert [r.contaminated for r in find_leaks(docs, bench).orderBy("doc_id").collect()] == [True, False]


def test_leaks_of_items_with_few_literal_words(spark):
    items = ["Is 17 prime?", "Paris 5 km Rome 7 km Oslo 9 km", "5 6 7 8 9", "2 km"]
    texts = [*(f"Some words. {t} Other words." for t in items), "Is 19 prime?", "Paris 6 km Rome 8 km Oslo 10 km", "IS 17 PRIME"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = find_leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).orderBy("doc_id").collect()
    assert [(r.item_id, r.kind) for r in got] == [(0, "verbatim"), (1, "verbatim"), (2, "verbatim"), (None, None), (None, None), (None, None), (0, "verbatim")]


def test_chain_takes_the_most_windows_in_order():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pairs = sorted({(int(p), int(q)) for p, q in rng.integers(0, 9, (10, 2))})
        follows = lambda a, b: b[0] > a[0] and (b[0] - a[0] == b[1] - a[1] or b[0] >= a[0] + 2 and b[1] >= a[1] + 2)
        best = [1] * len(pairs)
        for i, b in enumerate(pairs):
            best[i] = 1 + max((best[j] for j, a in enumerate(pairs[:i]) if follows(a, b)), default=0)
        got = decontamination.chain(pairs, 2)
        assert len(got) == max(best) and all(follows(a, b) for a, b in zip(got, got[1:], strict=False))


def test_a_consistent_stretch_counts_whatever_stands_beside_it(spark):
    item = "Every day the old farmer sells 12 eggs to a neighbour who lives near the river and keeps 3 of them for a cake"
    words = item.split()
    torn = item.replace("12", "13", 1).replace("3 of", "5 of") + " " + item.replace("neighbour", "stranger")
    texts = [torn + " " + " ".join(words[:21]), " ".join(words[:21]), item.replace("12", "3"), item + " " + item.replace("3", "8")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).orderBy("doc_id").collect()
    assert [r.contaminated for r in got] == [leaks(t, item) for t in texts] == [True, True, True, True]
    assert got[0].kind == got[1].kind == got[3].kind == "verbatim"


@pytest.mark.parametrize("most", [decontamination.BROADCAST, 0])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "BROADCAST", most)
    monkeypatch.setattr(decontamination, "PAIRS_EACH", 40)
    rng = random.Random(11)
    common = "the of and to a in is it on as with at by for".split()
    word = lambda: rng.choice(common) if rng.random() < 0.4 else rng.choice(["Anna", "Oslo", "7", "12", "km", "three", f"w{rng.randrange(60)}", f"w{rng.randrange(60)}."])
    start = "How many apples does Anna have if"
    items = [(i, start + " " + " ".join(word() for _ in range(rng.randint(3, 16)))) for i in range(40)] + [(None, "a null id stands here now too"), (40, None), (41, ""), (42, "12 + 34 = 46 km"), (43, "9"), (44, items_text := "one two three four"), (44, items_text)]
    docs = []
    for i in range(160):
        parts = [" ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(2)]
        given = rng.choice(items)[1] or ""
        if rng.random() < 0.3:
            given = given.replace("Anna", "Berta").replace("12", "99")
        if rng.random() < 0.2:
            given = given.upper()
        if rng.random() < 0.2:
            given = " ".join(given.split()[: rng.randint(0, 30)])
        docs.append((i, f"{parts[0]} {given} {parts[1]}" if i % 3 else f"{start} {parts[0]}", 0))
    docs += [(200, None, 0), (201, "", 1), (None, docs[1][1], 2), (1, docs[1][1], 3), (202, "x " * 60_000 + items[0][1] + " y" * 60_000, 4)]
    table = spark.createDataFrame(docs, "doc_id long, text string, Text int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_leaks(table, bench, carry=["Text"])
    assert got.columns == ["doc_id", "contaminated", "n_items", "item_id", "coverage", "kind", "Text"]
    want = []
    for d, t, x in docs:
        own = {i for i, item in set(items) if t and item and leaks(t, item)}
        ids = sorted(i for i in own if i is not None)
        want.append((d, bool(own), len(own), ids[0] if ids else None, x))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.contaminated, r.n_items, r.item_id, r.Text)) for r in got.collect())
    assert sum(w[1] for w in want) > 60 and sum(not w[1] for w in want) > 40


def test_short_way_to_codes():
    known = decontamination.Known()
    words = [b"word", b"word.", b"word,", b"word:", b"Word", b"two", b"two.", b"km", b"km,", b"a", b"a.", b".", b"x1", b"caf\xc3\xa9", b"word..", b"word-", b"WORD", b"don't", b"{", b"word{", b"\xc3\xa9."]
    named, forms = known.of(words)
    assert list(zip(named.tolist(), forms.tolist())) == [decontamination.word_codes(w) for w in words]


def test_a_third_of_all_documents_leak_one_item(spark):
    item = "Which of the seven rivers in the old song runs through the town of Lund before it meets the sea?"
    docs = spark.range(600).selectExpr("id doc_id", f"case when id % 3 = 0 then concat('{item}', ' ', if(id % 2 = 0, '', string(id))) else concat('other words ', id, ' stand here') end text").repartition(5)
    got = find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id for r in got.filter("contaminated").collect()} == set(range(0, 600, 3)) and got.count() == 600


def test_the_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op10_template_decontamination(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        own = [i for i, t in items if leaks(texts[r.doc_id], t)]
        assert (r.n_items, r.item_id) == (len(own), min(own, default=None)), r
