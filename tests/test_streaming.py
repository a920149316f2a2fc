import random

import pytest

from stanzagraph.operators.accumulate import accumulate, unit_metadata
from stanzagraph.spec import AccumulateSpec
from stanzagraph.streaming.accumulate import AccumulationSession, AccumulationStream, accumulate_chunked

NAMES = ["seq", "u", "conv", "grp", "A", "B", "C"]


def made(n=40, huge=False):
    rng = random.Random(5)
    value = (lambda: rng.choice([0.0, 0.0, 1e16, 1.0, 0.1, 3.0])) if huge else (lambda: float(rng.choice([0, 0, 1, 2])))
    return [(i, f"u{rng.randint(0, 2)}", f"c{rng.randint(0, 1)}", f"g{i % 2}", value(), value(), value()) for i in range(n)]


def streamed(spark, tmp_path, rows, spec, cuts, **options):
    df = spark.createDataFrame(rows, NAMES)
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], NAMES).coalesce(1).write.parquet(f"{tmp_path}/in{len(cuts)}/part={k}")
    files = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in{len(cuts)}")
    return df, AccumulationStream(files, spec, f"{tmp_path}/out{len(cuts)}", **options).start()


def told(counts, spec):
    keys = [c for c in ("u", "conv", "TRAJ_UNIT", "ENA_UNIT") if c in counts.columns]
    return sorted(tuple(r[c] for c in keys) + tuple(r[e.name] for e in spec.edges()) for r in counts.collect())


@pytest.mark.parametrize(
    "more",
    [
        dict(back=3, weight="sum"),
        dict(back=2, forward=2, weight="sum"),
        dict(back=None, forward=1, weight="sum"),
        dict(back=None, forward=None),
        dict(back=3, network="ordered"),
        dict(back=None, network="ordered"),
        dict(back=3, model="SeparateTrajectory"),
        dict(back=2, forward=1, model="AccumulatedTrajectory", weight="sum"),
        dict(window="Conversation", weight="sum"),
        dict(window="Conversation", model="AccumulatedTrajectory"),
        dict(back=40, forward=20, weight="sum", units_used=["u1", "u2"]),
    ],
)
def test_any_chunks_give_the_batch_result(spark, tmp_path, more):
    spec = AccumulateSpec(["u"], ["conv"], ["A", "B", "C"], ["seq"], metadata=["grp", "conv"], **more)
    df, stream = streamed(spark, tmp_path, made(), spec, [7, 9, 30])
    assert told(stream.finish(), spec) == told(accumulate(df, spec).counts, spec)
    own = lambda m: sorted(map(str, m.drop("first_seen").collect()))
    assert own(stream.metadata()) == own(unit_metadata(df, spec))


@pytest.mark.parametrize("network", ["ordered", "standard"])
@pytest.mark.parametrize("back", [2, None])
def test_codes_of_very_different_size_in_every_chunking(spark, tmp_path, network, back):
    rows = [(0, "u", "c", "g", 1e16, 0.0, 0.0), (1, "u", "c", "g", 1.0, 0.0, 0.0), (2, "u", "c", "g", 0.0, 1.0, 0.0), (3, "u", "c", "g", 0.1, 1.0, 0.5)]
    spec = AccumulateSpec(["u"], ["conv"], ["A", "B", "C"], ["seq"], back=back, network=network, weight="sum")
    want = None
    for cuts in ([], [1], [1, 2, 3]):
        df, stream = streamed(spark, tmp_path, rows, spec, cuts)
        want = want or told(accumulate(df, spec).counts, spec)
        assert told(stream.finish(), spec) == want
    if back == 2:
        assert accumulate(df, spec).counts.first()["A & B"] == (1.2 if network == "standard" else 1.05)


def test_late_rows_are_an_error(spark, tmp_path):
    rows = made(12)
    spec = AccumulateSpec(["u"], ["conv"], ["A", "B", "C"], ["seq"], back=2)
    _, stream = streamed(spark, tmp_path, [*rows, rows[0]], spec, [12])
    with pytest.raises(ValueError, match="behind later ones"):
        stream.finish()
    df = spark.createDataFrame(rows, NAMES)
    lenient = AccumulationStream(stream.rows, spec, stream.folder, allow_late=True)
    assert told(lenient.counts(), spec) == told(accumulate(df, spec).counts, spec)


def test_null_order_keys_come_first(spark, tmp_path):
    rows = [(None, "u", "c", "g", 1.0, 0.0, 0.0), (3, "u", "c", "g", 0.0, 1.0, 0.0), (5, "v", "c", "g", 0.0, 0.0, 1.0)]
    spec = AccumulateSpec(["u"], ["conv"], ["A", "B", "C"], ["seq"], back=2)
    schema = "seq long, u string, conv string, grp string, A double, B double, C double"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = AccumulationStream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), spec, f"{tmp_path}/out").start()
    assert told(stream.finish(), spec) == told(accumulate(df, spec).counts, spec)


def test_sessions(spark, tmp_path):
    rows, seen = made(20), []
    df = spark.createDataFrame(rows, NAMES)
    spec = AccumulateSpec(["u"], ["conv"], ["A", "B", "C"], ["seq"], back=3)
    with AccumulationSession(spark, df.schema, spec, f"file://{tmp_path}", 20, lambda p, s: seen.append((p, s.rows_seen))) as session:
        session.push(df.filter("seq < 8"))
        state = session.push(df.filter("seq >= 8"))
        assert (state.rows_seen, state.chunks_seen, state.is_finished) == (20, 2, False)
        assert told(session.finish(), spec) == told(accumulate(df, spec).counts, spec)
        with pytest.raises(RuntimeError):
            session.push(df)
        with pytest.raises(RuntimeError):
            session.finish()
    assert seen == [(0.4, 8), (0.99, 20), (1.0, 20)] and session.state.is_disposed and not list(tmp_path.iterdir())
    session = AccumulationSession(spark, df.schema, spec, f"file://{tmp_path}")
    with pytest.raises(ValueError, match="missing"):
        session.push(df.drop("A"))
    assert session.state.is_disposed
    with pytest.raises(ValueError, match="no rows"):
        AccumulationSession(spark, df.schema, spec, f"file://{tmp_path}").finish()


def test_chunked(spark, tmp_path):
    df = spark.createDataFrame(made(15), NAMES)
    spec = AccumulateSpec(["u"], ["conv"], ["A", "B", "C"], ["seq"], back=3, forward=1)
    seen = []
    session = accumulate_chunked(df, spec, f"file://{tmp_path}", 3, lambda p, s: seen.append(p))
    assert told(session.finish(), spec) == told(accumulate(df, spec).counts, spec)
    assert seen == [5 / 15, 10 / 15, 0.99, 1.0]
    session.dispose()
    with pytest.raises(ValueError):
        accumulate_chunked(df, spec, f"file://{tmp_path}", 0)


@pytest.mark.parametrize("more", [dict(back=3, forward=2), dict(back=None, forward=1), dict(back=3, network="ordered")])
def test_conversations_of_one_bucket_keep_apart(spark, tmp_path, monkeypatch, more):
    from stanzagraph.streaming import accumulate as module

    monkeypatch.setattr(module, "BUCKETS", 1)
    monkeypatch.setattr(module, "ROWS", 5)
    spec = AccumulateSpec(["u"], ["conv", "u"], ["A", "B", "C"], ["seq"], weight="sum", **more)
    df, stream = streamed(spark, tmp_path, made(), spec, [7, 9, 30])
    assert told(stream.finish(), spec) == told(accumulate(df, spec).counts, spec)


def test_whole_numbers_beside_nulls_stay_whole(spark, tmp_path):
    big = 2**60
    rows = [(big + i if i else None, big + i % 2 if i % 5 else None, 1.0, float(i % 2), 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "seq long, u long, A double, B double, C double").coalesce(1)
    df.write.parquet(f"{tmp_path}/in")
    spec = AccumulateSpec(["u"], ["u"], ["A", "B", "C"], ["seq"], back=2)
    stream = AccumulationStream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), spec, f"{tmp_path}/out").start()
    counts = lambda c: sorted(map(str, c.select("u", *[f"`{e.name}`" for e in spec.edges()]).collect()))
    assert counts(stream.finish()) == counts(accumulate(df, spec).counts)


@pytest.mark.parametrize("n,chunks", [(11, 4), (2, 3)])
def test_chunks_are_numbered_without_one_task_for_all_rows(spark, tmp_path, capfd, n, chunks):
    df = spark.createDataFrame(made(15)[:n], NAMES).repartition(3)
    spec = AccumulateSpec(["u"], ["conv"], ["A", "B", "C"], ["seq"], back=3)
    seen = []
    spark.sparkContext.setLogLevel("WARN")
    session = accumulate_chunked(df, spec, f"file://{tmp_path}", chunks, lambda p, s: seen.append(s.rows_seen))
    spark.sparkContext.setLogLevel("ERROR")
    assert seen == ([3, 6, 9, 11] if n == 11 else [1, 2, 2])
    assert "No Partition Defined for Window" not in "".join(capfd.readouterr())
    assert told(session.finish(), spec) == told(accumulate(df, spec).counts, spec)
    session.dispose()
    assert not list(tmp_path.iterdir())
