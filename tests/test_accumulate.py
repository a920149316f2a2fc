import math
import random

import pytest

from stanzagraph.operators.accumulate import accumulate, check_order, exact_counts, provenance, unit_metadata, used
from stanzagraph.operators.checks import check_counts, check_numbers, check_provenance
from stanzagraph.spec import AccumulateSpec, Budget, adjacency, ordered_adjacency, pairs_of, scalar


def tri(v):
    return [v[j] * v[i] for i in range(1, len(v)) for j in range(i)]


def brute_cells(rows, back, forward):
    """A window's pairs, without those wholly before or wholly after the row."""
    out, n = [], len(rows)
    add = lambda part: [sum(r[k] for r in part) for k in range(len(rows[0]))]
    for t in range(n):
        e = 0 if back is None else t if back == 0 else max(0, t - back + 1)
        last = n - 1 if forward is None else min(t + forward, n - 1)
        window, tail = rows[e : last + 1], rows[t + 1 : last + 1]
        size = 0 if forward is None or back in (0, 1) else max(0, len(window) - 1 - forward)
        if forward == 0:
            size = t - e
        out.append([a - b - c for a, b, c in zip(tri(add(window)), tri(add(window[:size])), tri(add(tail)))])
    return out


@pytest.mark.parametrize("seed", range(14))
def test_windows_match_brute_force(spark, seed):
    rng = random.Random(seed)
    p = rng.randint(2, 4)
    codes = [f"K{i}" for i in range(p)]
    rows = [(f"u{rng.randint(0, 2)}", f"c{rng.randint(0, 1)}", i, *[float(rng.choice([0, 0, 1, 2])) for _ in range(p)]) for i in range(rng.randint(6, 30))]
    df = spark.createDataFrame(rows, ["unit", "conv", "seq", *codes]).repartition(3)
    back, forward = [(1, 0), (0, 2), (2, 0), (4, 0), (None, 0), (2, 1), (4, 3), (None, 2), (3, None), (2, 3), (None, None), (3, 20), (1, 1), (200, 0)][seed]
    weight = rng.choice(["binary", "sum"])
    mask = [[rng.choice([0.0, 1.0, 2.0]) for _ in codes] for _ in codes] if seed % 2 else None
    spec = AccumulateSpec(["unit"], ["conv"], codes, ["seq"], back=back, forward=forward, weight=weight, mask=mask)
    want = {}
    for conv in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == conv]
        for r, cells in zip(own, brute_cells([list(x[3:]) for x in own], back, forward)):
            for k, (x, e) in enumerate(zip(cells, adjacency(codes))):
                x = float(x > 0) if weight == "binary" else x
                x *= 1 if mask is None else mask[e.source_index][e.target_index]
                want[r[0], e.name] = want.get((r[0], e.name), 0) + x
    acc = accumulate(df, spec)
    got = {(r["unit"], e): r[e] for r in acc.counts.collect() for e in acc.edge_names}
    assert got == want
    check_counts(acc.counts, spec)


def test_ordered_window(spark):
    rows = [("u", "h", i, *[float(i == k) for k in range(4)]) for i in range(4)]
    df = spark.createDataFrame(rows, ["unit", "horizon", "seq", *"ABCD"])
    for back, want in ((2, ["A & B", "B & C", "C & D"]), (3, ["A & B", "A & C", "B & C", "B & D", "C & D"]), (4, ["A & B", "A & C", "B & C", "A & D", "B & D", "C & D"])):
        acc = accumulate(df, AccumulateSpec(["unit"], ["horizon"], list("ABCD"), ["seq"], network="ordered", back=back))
        row = acc.counts.first()
        assert [e.name for e in ordered_adjacency("ABCD") if row[e.name]] == want
        check_numbers(acc.rows, acc.spec)
        chain = provenance(df, acc.spec, "seq")
        check_provenance(chain, acc.spec, "seq")
        assert [r.prior_rows for r in chain.orderBy("seq").collect()] == [list(range(max(0, i - back + 1), i)) for i in range(4)]
        with pytest.raises(ValueError, match="broken"):
            check_provenance(chain.filter("seq <> 1"), acc.spec, "seq")


def test_coercion_keys_and_ties(spark):
    rows = [("a::b", "c", 1, "1", True, None), ("a", "b::c", 2, "1d", False, 2.0), ("a", None, 3, " 2 ", True, float("nan"))]
    df = spark.createDataFrame(rows, "x string, y string, seq int, A string, B boolean, C double")
    spec = AccumulateSpec(["x", "y"], ["x"], ["A", "B", "C"], ["seq"], weight="sum")
    counts = {r["ENA_UNIT"]: [r["A & B"], r["A & C"], r["B & C"]] for r in accumulate(df, spec).counts.filter("x = 'a'").collect()}
    assert counts == {"a::b::c": [0, 0, 0], "a::": [2, 0, 0]}
    assert accumulate(df, spec).counts.count() == 3  # tuples, not their labels, are units
    check_order(df, spec)
    with pytest.raises(ValueError, match="order"):
        check_order(df.union(df), spec)


def test_units_used_are_filtered_after_windows_and_metadata(spark):
    rows = [("a", "c", 1, 1.0, 0.0, "m", "x"), ("b", "c", 2, 0.0, 1.0, "n", "x"), ("b", "c", 3, 0.0, 0.0, "o", "x")]
    df = spark.createDataFrame(rows, ["u", "conv", "seq", "A", "B", "varies", "same"])
    spec = AccumulateSpec(["u"], ["conv"], ["A", "B"], ["seq"], back=2, units_used=["b"], metadata=["varies", "same"])
    acc = accumulate(df, spec)
    assert [(r["u"], r["A & B"]) for r in acc.counts.collect()] == [("b", 1.0)]
    assert acc.rows.count() == 3 and used(acc.rows, spec).count() == 2
    assert unit_metadata(df, spec).columns[-1] == "same" and "varies" not in unit_metadata(df, spec).columns


def test_fractional_codes_sum_exactly(spark):
    rows = [("u", i, 0.1, 1.0) for i in range(10)]
    acc = accumulate(spark.createDataFrame(rows, ["u", "seq", "A", "B"]), AccumulateSpec(["u"], ["u"], ["A", "B"], ["seq"], weight="sum"))
    assert exact_counts(acc).first()["A & B"] == 1.0


def test_specifications_are_checked(spark):
    good = dict(units=["u"], conversation=["c"], codes=["A", "B"], order_by=["s"])
    for bad in (dict(codes=["A"]), dict(codes=["A", "A"]), dict(back=-1), dict(back=1.5), dict(forward=-1), dict(weight="other"), dict(mask=[[1]]), dict(order_by=[]), dict(units_used=[]), dict(model="x"), dict(network="ordered", forward=1), dict(network="ordered", back=0), dict(network="ordered", weight="binary"), dict(network="ordered", mask=[[-1, 0], [0, 0]])):
        with pytest.raises(ValueError):
            AccumulateSpec(**(good | bad))
    with pytest.raises(ValueError, match="missing"):
        accumulate(spark.createDataFrame([(1,)], ["u"]), AccumulateSpec(**good))


def test_codes_of_very_different_size_do_not_cancel(spark):
    rows = [("u", 0, 1e16, 1e16), *[("u", i, 0.0, 0.0) for i in range(1, 150)], ("u", 150, 0.5, 0.5), ("u", 151, 1.0, 1.0)]
    df = spark.createDataFrame(rows, ["u", "seq", "A", "B"])
    for back, forward in ((2, 0), (100, 0), (129, 0), (3, 17), (3, 16)):
        acc = accumulate(df, AccumulateSpec(["u"], ["u"], ["A", "B"], ["seq"], back=back, forward=forward, weight="sum"))
        want = [c[0] for c in brute_cells([list(r[2:]) for r in rows], back, forward)]
        assert [r["A & B"] for r in acc.rows.orderBy("seq").collect()] == want


def test_legacy_keys_in_any_window(spark):
    rows = [("u", None, 0, 1.0, 0.0), ("u", "", 1, 0.0, 1.0), ("u", None, 2, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "u string, conv string, seq int, A double, B double")
    for forward in (2, 17, 40):
        spec = AccumulateSpec(["u"], ["conv"], ["A", "B"], ["seq"], back=3, forward=forward, weight="sum", legacy_display_keys=True)
        want = [c[0] for c in brute_cells([list(r[3:]) for r in rows], 3, forward)]
        assert [r["A & B"] for r in accumulate(df, spec).rows.orderBy("seq").collect()] == want


@pytest.mark.parametrize("more", [dict(back=3), dict(back=None, weight="sum"), dict(back=2, forward=3, weight="sum"), dict(back=None, forward=2), dict(back=3, network="ordered"), dict(back=None, network="ordered"), dict(back=3, model="AccumulatedTrajectory"), dict(back=4, legacy_display_keys=True), dict(back=2, units_used=["u1"])])
def test_many_edges_give_what_few_give(spark, monkeypatch, more):
    from stanzagraph.operators import vector

    rng = random.Random(3)
    codes = [f"K{i}" for i in range(5)]
    rows = [(f"u{rng.randint(0, 3)}", rng.choice(["a", "b", None]), i, *[rng.choice([0.0, 0.0, 1.0, 0.1, 3e15]) for _ in codes]) for i in range(160)]
    df = spark.createDataFrame(rows, "unit string, conv string, seq int, " + ", ".join(f"{c} double" for c in codes)).repartition(3)
    spec = AccumulateSpec(["unit"], ["conv"], codes, ["seq"], **more)
    told = lambda acc: sorted(((r["ENA_UNIT"], r.asDict().get("TRAJ_UNIT"), str(r["first_seen"])), [r[e] for e in acc.edge_names]) for r in acc.counts.collect())
    few = told(accumulate(df, spec))
    monkeypatch.setattr(vector, "WIDE", 1)
    monkeypatch.setattr(vector, "ROWS", 16)
    many = told(accumulate(df, spec))
    assert [k for k, _ in many] == [k for k, _ in few]
    assert all(a == pytest.approx(b, rel=1e-12) for (_, a), (_, b) in zip(many, few))


def test_ordered_sums_are_rounded_once(spark):
    rows = [("u", i, x, 1.0) for i, x in enumerate([1e16, 1.0, 1.0, 0.1, 0.2, 0.3, -0.0])]
    df = spark.createDataFrame(rows, ["u", "seq", "A", "B"]).repartition(3)
    acc = accumulate(df, AccumulateSpec(["u"], ["u"], ["A", "B"], ["seq"], network="ordered", back=4))
    own = [r[2] for r in rows]
    before = [math.fsum(own[max(0, i - 3) : i]) for i in range(len(own))]
    assert [r["A & B"] for r in acc.rows.orderBy("seq").collect()] == [b + 0.5 * x for b, x in zip(before, own)]
    assert acc.counts.first()["A & B"] == math.fsum(b + 0.5 * x for b, x in zip(before, own))


def test_ordered_networks_neither_overflow_nor_vanish(spark):
    spec = AccumulateSpec(["u"], ["u"], ["A", "B"], ["seq"], network="ordered", back=2)
    for a, b, what in ((1e200, 1e200, "overflows"), (1e-200, 1e-200, "vanishes")):
        df = spark.createDataFrame([("u", 0, a, 0.0), ("u", 1, 0.0, b)], ["u", "seq", "A", "B"])
        with pytest.raises(Exception, match=what):
            accumulate(df, spec).counts.collect()


def test_units_that_are_not_there_are_an_error(spark):
    df = spark.createDataFrame([("u", 0, 1.0, 1.0)], ["u", "seq", "A", "B"])
    with pytest.raises(ValueError, match="units_used"):
        accumulate(df, AccumulateSpec(["u"], ["u"], ["A", "B"], ["seq"], units_used=["nobody"]))


def test_scalar_weights_and_no_metadata(spark):
    df = spark.createDataFrame([("u", i, float(i), 4.0, "m") for i in range(4)], ["u", "seq", "A", "B", "meta"])
    spec = AccumulateSpec(["u"], ["u"], ["A", "B"], ["seq"], back=2, weight=scalar(math.sqrt), metadata=["meta"], include_meta=False)
    cells = [c[0] for c in brute_cells([[float(i), 4.0] for i in range(4)], 2, 0)]
    assert accumulate(df, spec).counts.first()["A & B"] == pytest.approx(sum(map(math.sqrt, cells)))
    assert "meta" not in unit_metadata(df, spec).columns
    with pytest.raises(ValueError, match="cells"):
        accumulate(df, AccumulateSpec(["u"], ["u"], ["A", "B"], ["seq"], network="ordered", budget=Budget(cells=3))).materialized()


def test_pairs():
    assert pairs_of(4) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
