import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stanzagraph import AccumulateSpec, ena
from stanzagraph.functions.elasticnet import cross_validated, elastic_net
from stanzagraph.functions.rotations import Generalized, Hena, Mean, Regression, Spherical, parsed
from stanzagraph.operators import stats
from stanzagraph.operators.accumulate import accumulate, unit_metadata
from stanzagraph.operators.graph import Plot, network_edges
from stanzagraph.operators.model import line_weights
from stanzagraph.sources.tables import load_counts, load_model, save_counts, save_model

# Example rows (unit, conversation, group and the codes A to D) whose counts,
# shares and statistics below are known.
TOY = [
    ("U1", "C1", "G1", 1, 0, 1, 0),
    ("U1", "C1", "G1", 0, 1, 0, 0),
    ("U2", "C1", "G1", 2, 1, 0, 1),
    ("U2", "C1", "G1", 0, 0, 2, 1),
    ("U3", "C1", "G2", 1, 0, 0, 1),
    ("U3", "C1", "G2", 0, 1, 1, 0),
    ("U4", "C1", "G2", 0, 0, 1, 1),
    ("U4", "C1", "G2", 1, 1, 0, 0),
    ("U1", "C2", "G1", 0, 1, 1, 0),
    ("U2", "C2", "G1", 1, 0, 1, 0),
    ("U3", "C2", "G2", 0, 1, 0, 1),
    ("U4", "C2", "G2", 1, 0, 0, 1),
]
SPEC = AccumulateSpec(["unit"], ["conv"], list("ABCD"), ["seq"], metadata=["grp", "num"], back=2)


@pytest.fixture(scope="module")
def toy(spark):
    rows = []
    for i, (u, c, g, *codes) in enumerate(TOY):
        rows.append((i, u, c, g, float(u[1]), *map(float, codes)))
    return spark.createDataFrame(rows, ["seq", "unit", "conv", "grp", "num", *"ABCD"])


@pytest.fixture(scope="module")
def fitted(toy):
    return ena(toy, SPEC)


def placed(toy, acc, model):
    return model.points(acc.counts).join(unit_metadata(toy, SPEC).select("unit", "grp", "num"), "unit")


def test_counts_and_shares(fitted):
    acc, model = fitted
    got = {r["unit"]: [int(r[e]) for e in acc.edge_names] for r in acc.counts.collect()}
    assert got == {"U1": [1, 1, 2, 0, 0, 0], "U2": [2, 2, 2, 2, 2, 1], "U3": [2, 2, 2, 2, 2, 3], "U4": [2, 1, 2, 2, 3, 1]}
    shares = list(model.variance(acc.counts).values())
    assert shares[:3] == pytest.approx([0.788065, 0.171323, 0.040612], abs=1e-6) and sum(shares) == pytest.approx(1)
    assert model.axes.matrix.T @ model.axes.matrix == pytest.approx(np.eye(6), abs=1e-9)


def test_statistics(toy, fitted):
    acc, model = fitted
    points = placed(toy, acc, model)
    assert [stats.cohens_d(points, "grp", d).first()["d"] for d in ("SVD1", "SVD2")] == pytest.approx([1.325104193491, 0.208352810801], abs=1e-9)
    t = stats.welch_t(points, "grp", "SVD1").first()
    assert (abs(t.t), t.df) == pytest.approx((1.325104193491, 1.001985915803), abs=1e-9)
    c = stats.correlations(points, model.centroids(acc.counts), ["SVD1", "SVD2"])
    assert [x["spearman"] for x in c] == pytest.approx([1, 1]) and [x["pearson"] for x in c] == pytest.approx([1, 1], abs=1e-6) and c[0]["pairs"] == 6
    assert stats.ena_stats(points, model.centroids(acc.counts), [1, 2], "grp")["SVD1"]["cohens_d"] == pytest.approx(1.325104193491)


def test_rank_correlation_of_more_units_than_the_driver_ranks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 9, 70) / 4, rng.normal(size=70)
    points = spark.createDataFrame([(f"u{i}", i, float(a)) for i, a in enumerate(x)], "ENA_UNIT string, o long, d double")
    centroids = spark.createDataFrame([(f"u{i}", float(b + a)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "unit string, d double")
    want = stats.correlations(points, centroids, ["d"], order="o")
    monkeypatch.setattr(stats, "PAIRS_ON_DRIVER", 69)
    got = stats.correlations(points, centroids, ["d"], order="o")
    assert 0 < want[0]["spearman"] < 1 and got[0]["spearman"] == pytest.approx(want[0]["spearman"], abs=1e-12)
    assert got[0]["spearman_interval"] == pytest.approx(want[0]["spearman_interval"], abs=1e-12)


def test_pairwise_pearson():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(2, 50))
    i, j = np.triu_indices(50, 1)
    assert stats.pair_pearson(50, x, y) == pytest.approx(np.corrcoef(x[i] - x[j], y[i] - y[j])[0, 1], abs=1e-12)


@pytest.mark.parametrize("rotation", [Mean([(["U1", "U2"], ["U3", "U4"])]), Generalized("num"), Generalized("grp", y="num"), Generalized("grp", covariates=["num"]), Regression("V ~ num", "V ~ grp + num:grp"), Hena("num"), Hena("grp", y="num", controls=["num"]), Spherical("A & B", "A & C")])
def test_rotations_are_complete(toy, rotation):
    acc, model = ena(toy, SPEC, rotation)
    assert np.linalg.matrix_rank(model.axes.matrix) == 6
    assert np.linalg.norm(model.axes.matrix, axis=0) == pytest.approx(np.ones(6))
    assert len(set(model.axes.names)) == 6


def test_projecting_and_storing(spark, toy, fitted, tmp_path):
    acc, model = fitted
    save_model(spark, model, f"{tmp_path}/m")
    save_counts(acc.counts, f"{tmp_path}/c")
    again = load_model(spark, f"{tmp_path}/m")
    load_counts(spark, f"{tmp_path}/c", SPEC)
    order = lambda df: [tuple(r) for r in df.select("unit", *model.shown).orderBy("unit").collect()]
    assert order(again.transform(acc)) == order(model.points(acc.counts))
    with pytest.raises(ValueError):
        model.transform(accumulate(toy, AccumulateSpec(["unit"], ["conv"], list("ABC"), ["seq"])))


def test_formulas():
    assert parsed("lm(formula = V ~ a + b + a:b)") == ("V", [["a"], ["b"], ["a", "b"]])
    with pytest.raises(ValueError):
        parsed("V ~ a*b")


def test_elastic_net_goldens():
    from tests_data import ELASTIC_X, ELASTIC_Y

    # The first response's coefficients by penalty.
    want = {0.5: [0.139294774, 0, 0, 0], 0.1: [0.139294774, 0.037236333, 0, 0], 0.02: [-0.004029421, 0.079162044, 0.069697368, 0.007858941], 0.004: [-0.090153212, 0.068545912, 0.114974227, -0.001000916]}
    for penalty, first in want.items():
        fit = elastic_net(ELASTIC_X, ELASTIC_Y, penalty, 1.0, [0, 1, 1, 1])
        assert fit.coefficients[:, 0] == pytest.approx(first, abs=1e-6)
    assert cross_validated(ELASTIC_X, ELASTIC_Y).penalty > 0


def test_plot(toy, fitted):
    acc, model = fitted
    lines = line_weights(acc.counts, acc.edge_names)
    edges = network_edges(lines, acc.edges, 0.4).collect()
    assert edges and all(abs(r.weight) > 0.4 for r in edges)
    plot = Plot(model, placed(toy, acc, model), lines, "toy").add_points({"grp": "G1"}).add_group(F.col("grp") == "G2").add_network().add_nodes()
    assert len(plot.to_dict()["traces"]) == 4 and len(plot.traces[0]["points"]) == 2
    json.dumps(plot.to_plotly())
    assert plot.to_svg().startswith("<svg")


def test_paired_nodes(spark):
    rng = np.random.default_rng(6)
    rows = [(f"u{i % 6}", ("ground", "response")[i % 2 ^ i // 6 % 2], i, *map(float, rng.integers(0, 3, 3))) for i in range(60)]
    df = spark.createDataFrame(rows, ["actor", "mode", "seq", *"ABC"])
    spec = AccumulateSpec(["actor", "mode"], ["actor"], list("ABC"), ["seq"], network="ordered", back=3)
    acc, model = ena(df, spec, method="paired", pair=["actor"])
    points = {(r.actor, r["mode"]): [r.SVD1, r.SVD2] for r in model.points(acc.counts).collect()}
    weights = {(r.actor, r["mode"]): r.weights for r in model.weights(acc.counts).collect()}
    added = lambda by: np.array([np.add(by[f"u{k}", "ground"], by[f"u{k}", "response"]) for k in range(6)])
    w, p = added(weights), added(points)
    assert model.nodes == pytest.approx(np.linalg.solve(w.T @ w + 1e-10 * np.eye(3), w.T @ p), abs=1e-6)
    for bad in (dict(method="paired"), dict(pair=["actor"]), dict(method="paired", pair=["seq"])):
        with pytest.raises(ValueError):
            ena(df, spec, **bad)
    with pytest.raises(ValueError, match="pairs"):
        ena(df.filter("actor <> 'u0' or mode = 'ground'"), spec, method="paired", pair=["actor"])


def test_runs_are_numbered_over_all_ranges(spark):
    from stanzagraph.functions.rotations import run_codes

    rng = np.random.default_rng(8)
    values = [None if v == 3 else f"g{v}" for v in np.repeat(rng.integers(0, 4, 60), rng.integers(1, 9, 60))]
    df = spark.createDataFrame([(f"u{i}", i, v) for i, v in enumerate(values)], "ENA_UNIT string, first_seen long, g string").repartition(5)
    want, n = [], 1
    for i, v in enumerate(values):
        if i and v is not None and values[i - 1] is not None and v != values[i - 1]:
            n += 1
        want.append(float(n))
    assert [r.g_f for r in run_codes(df, "g").orderBy("first_seen").collect()] == want


def test_elastic_net_meets_its_conditions():
    """At the least sum the gradient is the penalty along a row that is used, and within it elsewhere."""
    rng = np.random.default_rng(9)
    x = np.c_[rng.normal(size=(50, 3)) * [1, 5, 0.2] + [0, 40, 1], np.full(50, 2.0)]
    y = x[:, :3] @ rng.normal(size=(3, 2)) + rng.normal(size=(50, 2))
    for penalty, alpha in ((0.4, 1.0), (0.05, 0.5), (0.0, 1.0)):
        fit = elastic_net(x, y, penalty, alpha)
        scale = x.std(axis=0)
        b = fit.coefficients * scale[:, None]
        left = (x - x.mean(axis=0)) / np.where(scale > 0, scale, 1)
        gradient = left.T @ (y - fit.intercepts - x @ fit.coefficients) / 50
        assert fit.coefficients[3] == pytest.approx(0)
        for j in range(3):
            norm = np.linalg.norm(b[j])
            if norm:
                assert gradient[j] == pytest.approx(penalty * (alpha / norm + 1 - alpha) * b[j], abs=1e-9)
            else:
                assert np.linalg.norm(gradient[j]) <= penalty * alpha + 1e-9


def test_cross_validation_reads_sums_of_folds(spark):
    from stanzagraph.functions.rotations import Units, _fitted_effect

    rng = np.random.default_rng(10)
    group, c = rng.integers(0, 3, 83), rng.normal(size=83) * 3 + 50
    v = np.outer(group, rng.normal(size=4)) + np.outer(c, rng.normal(size=4)) / 9 + rng.normal(size=(83, 4)) / 2
    v -= v.mean(axis=0)
    rows = [(f"u{i % 7}-{i}", i // 2, "abc"[g], float(k), list(map(float, w))) for i, (g, k, w) in enumerate(zip(group, c, v, strict=True))]
    df = spark.createDataFrame(rows, "ENA_UNIT string, first_seen long, g string, c double, centred array<double>").repartition(5)
    rows.sort(key=lambda r: (r[1], r[0]))
    x = np.array([["abc".index(r[2]) + 1, r[3]] for r in rows], float)
    want = cross_validated(x, np.array([r[4] for r in rows]), factors=[0.0, 1.0]).coefficients[0]
    got = _fitted_effect(Units(df, list("wxyz")), Generalized("g", covariates=["c"]))
    assert abs(got @ want) / np.linalg.norm(want) == pytest.approx(1, abs=1e-9) and got[np.argmax(np.abs(got))] > 0


@pytest.mark.parametrize("places", [0, 40])
def test_rank_correlation_of_many_units_at_few_places(spark, monkeypatch, places):
    rng = np.random.default_rng(5)
    spots = rng.integers(0, 9, (30, 2)) / 4
    x, y = spots[rng.integers(0, 30, 90)].T
    a, b = np.triu_indices(90, 1)
    want = float(np.corrcoef(stats.ranks(x[a] - x[b]), stats.ranks(y[a] - y[b]))[0, 1])
    monkeypatch.setattr(stats, "PLACES_ON_DRIVER", places)
    monkeypatch.setattr(stats, "PAIRS_ON_DRIVER", 0)
    asked = []
    many = stats._spearman_of_many
    monkeypatch.setattr(stats, "_spearman_of_many", lambda *args: asked.append(1) or many(*args))
    assert stats.pair_spearman(spark, x, y) == pytest.approx(want, abs=1e-12)
    assert len(asked) == (places == 0)


def test_pearson_alone_ranks_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(stats, "pair_spearman", lambda *_: pytest.fail("pairs are ranked"))
    points = spark.createDataFrame([(f"u{i}", i, float(i * i % 7)) for i in range(9)], "ENA_UNIT string, o long, d double")
    found = stats.correlations(points, points.select(F.col("ENA_UNIT").alias("unit"), "d"), ["d"], order="o", kinds=("pearson",))
    assert found[0]["pearson"] == pytest.approx(1) and found[0]["pairs"] == 36 and "spearman" not in found[0]


def test_a_weight_at_the_threshold_is_not_beyond_it(spark):
    rows = [(f"u{k}", *[float(k * x) for x in v]) for k in (1, 3, 5, 7) for v in ([3, 7, 5, 4, 1, 0], [3, 9, 3, 1, 0, 0], [3, 6, 6, 4, 1, 1], [0, 3, 8, 5, 1, 1])]
    names = [e.name for e in SPEC.edges()]
    counts = spark.createDataFrame(rows, ["ENA_UNIT", *names])
    got = sorted((r[0], r[3]) for r in network_edges(line_weights(counts, names), SPEC.edges(), 0.3).collect())
    want = [(u, c / np.sqrt(sum(x * x for x in v))) for u, *v in rows for c in v]
    assert got == sorted((u, w) for u, w in want if abs(w) > 0.3)
    assert 0.3 in [w for _, w in want]
