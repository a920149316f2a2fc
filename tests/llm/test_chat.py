import duckdb
from pyspark.sql import functions as F

from stanzagraph.llm.chat import OP2_SQL, format_preferences, op2_chat_preference

TURNS = "pair_id long, turn long, role string, text string, Turn int, prompt string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], TURNS)


def brute(chosen, rejected):
    """Rows of (pair, turn, role, text) to {pair: (prompt, chosen, chosen mask, rejected, rejected mask)}."""
    out = {}
    for pair in {r[0] for r in chosen + rejected}:
        sides = [sorted((-(2**63) if r[1] is None else r[1], r[2] or "", r[3] or "") for r in side if r[0] == pair) for side in (chosen, rejected)]
        n = 0
        while n < min(map(len, sides)) and sides[0][n] == sides[1][n]:
            n += 1
        shown = lambda x: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, r, t in x)
        mask = lambda x: "".join(("-" * len(f"<|im_start|>{r}\n") + "+" * len(f"{t}<|im_end|>\n")) if r == "assistant" else "-" * len(shown([(0, r, t)])) for _, r, t in x)
        out[pair] = (shown(sides[0][:n]), shown(sides[0][n:]), mask(sides[0][n:]), shown(sides[1][n:]), mask(sides[1][n:]))
    return out


def spread(mask):
    return "".join("-" * int(a) + "+" * int(b) for a, b in (run.split("+") for run in mask.split(",") if run))


def got(df):
    rows = df.collect()
    assert len(rows) == len({r.pair_id for r in rows})
    return {r.pair_id: (r.prompt, r.chosen, spread(r.chosen_loss), r.rejected, spread(r.rejected_loss)) for r in rows}


def test_preferences(spark):
    a = [(1, 0, "user", "q"), (1, 1, "assistant", "good"), (2, 0, "user", "same"), (3, None, "user", None), (3, 70, "assistant", "late"), (4, 63, "user", "q"), (4, 64, "assistant", "a"), (5, 1, None, "x"), (5, 1, None, "x"), (None, 1, "user", "n"), (7, 1, "assistant", "é" * 5), (8, 1, "user", "b"), (8, 1, "user", "a")]
    b = [(1, 0, "user", "q"), (1, 1, "assistant", "bad!"), (2, 0, "user", "same"), (3, None, "user", None), (4, 63, "user", "q"), (4, 64, "assistant", "b"), (5, 1, None, "x"), (6, 1, "assistant", ""), (7, 1, "user", "é" * 5), (8, 1, "user", "a"), (8, 2, "assistant", None)]
    out = got(format_preferences(turns_of(spark, a), turns_of(spark, b)))
    assert out == brute(a, b)
    assert out[2][1:] == ("", "", "", "") and out[4][0] == "<|im_start|>user\nq<|im_end|>\n"
    empty = spark.createDataFrame([], TURNS)
    assert format_preferences(empty, empty).count() == 0


def test_very_long_conversations(spark):
    a = [(i % 2, i, "assistant" if i % 3 else "user", f"turn {i} " * (1 + i % 5)) for i in range(10_000)]
    b = [r if r[1] < 8000 else (*r[:3], r[3] + "!") for r in a if r[1] != 9001]
    assert got(format_preferences(turns_of(spark, a).repartition(7), turns_of(spark, b).repartition(5))) == brute(a, b)


def test_the_query_against_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    out = op2_chat_preference(spark, sf)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.execute(OP2_SQL).fetchall()
    assert out.count() == len(want) > 0
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert out.filter(F.col("chosen") != "").count() > 0


def test_no_python_on_the_main_path(spark):
    plan = op2_chat_preference(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "MapElements", "CartesianProduct"))
