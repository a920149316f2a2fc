import math
import time

import pytest

from stanzagraph.operators import stats
from stanzagraph.plans.jobs import Runs
from stanzagraph.sources.tables import read_rows, rows_from


def test_runs(spark):
    runs = Runs(spark, most=2)
    done = runs.start(lambda s: s.range(10).count(), tag="count")
    assert done.result(60) == 10
    failed = runs.start(lambda s: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        failed.result(60)
    slow = runs.start(lambda s: s.range(10**13).selectExpr("sum(id % 7)").collect(), tag="slow")
    with pytest.raises(ValueError, match="slow"):
        runs.start(lambda s: None, tag="slow")
    other = runs.start(lambda s: time.sleep(1) or 2)
    with pytest.raises(RuntimeError):
        runs.start(lambda s: None)
    assert other.result(30) == 2
    time.sleep(2)
    runs.cancel(slow)
    with pytest.raises(Exception, match="(?i)cancel|interrupt"):
        slow.result(50)


@pytest.mark.parametrize("kind", ["parquet", "json", "csv", "orc"])
def test_rows_from_files(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, 1.5)], "id long, name string, x double")
    df.coalesce(1).write.format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(f"{tmp_path}/t")
    got = read_rows(spark, f"{tmp_path}/t", kind, "id long, name string, x double")
    assert sorted(map(tuple, got.collect())) == [(1, "a", 0.5), (2, None, 1.5)]
    with pytest.raises(ValueError):
        read_rows(spark, f"{tmp_path}/t", "xml")


def test_rows_at_hand(spark):
    got = rows_from(spark, [{"u": "a", "A": 1.0}, {"u": "b", "B": 2.0}])
    assert [tuple(r) for r in got.orderBy("seq").collect()] == [("a", 1.0, None, 1), ("b", None, 2.0, 2)]


def test_quantiles_and_intervals():
    assert stats.inverse_normal(0.975) == pytest.approx(1.959963984540054) and stats.inverse_normal(0.5) == 0
    assert math.isnan(stats.inverse_normal(0)) and math.isnan(stats.inverse_normal(1))
    low, high = stats.fisher_interval(0.5, 103)
    assert (low, high) == pytest.approx((math.tanh(math.atanh(0.5) - 0.1959963984540054), math.tanh(math.atanh(0.5) + 0.1959963984540054)))
    assert all(map(math.isnan, stats.fisher_interval(0.5, 3)))


def test_spreads_of_one_unit_are_not_numbers(spark):
    points = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0)], "g string, x double")
    one = stats.dimension_summary(points.filter("g = 'a'"), ["x"]).first()
    assert math.isnan(one.sd) and math.isnan(one.variance) and one.mean == 1.0
    t = stats.welch_t(points, "g", "x").first()
    assert math.isnan(t.t) and math.isnan(t.df)
