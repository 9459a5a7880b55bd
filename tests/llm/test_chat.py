import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from layoutcheck.llm.chat import DEFAULT, format_chats, read_loss, read_turns

SCHEMA = "conv_id long, turn long, role string, text string"


def read(df):
    made = format_chats(df)
    return {r["conv_id"]: r for r in made.select("*", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("segments")).alias("loss")).collect()}


TEXT = st.lists(st.sampled_from([*"ab<|>\\/ \n", "<|end|>", "<|start|>", "<|text|>", "\\|", "é", "😀"]), max_size=12).map("".join)


@settings(deadline=None, max_examples=12, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|", "a<", ""]), TEXT), min_size=1, max_size=5), min_size=1, max_size=8))
def test_everything_reads_back(spark, chats):
    rows = [(c, t, role, text) for c, turns in enumerate(chats) for t, (role, text) in enumerate(turns)]
    got = read(spark.createDataFrame(rows, SCHEMA).repartition(3))
    for c, turns in enumerate(chats):
        assert [tuple(t) for t in got[c]["turns"]] == turns
        assert got[c]["loss"] == "".join(text for role, text in turns if role == "assistant")
        assert got[c]["formatted"] == "".join(s["text"] for s in got[c]["segments"])
        assert all(not s["loss"] for s in got[c]["segments"] if s["text"] in (DEFAULT.end,))


@pytest.mark.parametrize(("roles", "valid"), [("s u a", True), ("u a", True), ("u", True), ("s", False), ("a u", False), ("u u", False), ("s s u", False), ("u a a", False), ("u s a", False), ("u x", False), ("s u a u a u", True), ("u a u u a", False)])
def test_the_machine(spark, roles, valid):
    full = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    df = spark.createDataFrame([(1, i, full[r], "t") for i, r in enumerate(roles.split())], SCHEMA)
    row = format_chats(df).first()
    assert row["valid"] is valid and row["n_turns"] == len(roles.split())


def test_odd_rows(spark):
    rows = [(1, 2, "assistant", None), (1, None, "user", "first"), (1, 1, None, "x"), (1, 1, None, "x"), (None, 0, "user", "lost"), (2, 0, "user", "b"), (2, 0, "user", "a")]
    got = read(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS t", "2 AS segments", "3 AS state"))
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "first"), ("", "x"), ("", "x"), ("assistant", "")]
    assert [tuple(t) for t in got[2]["turns"]] == [("user", "a"), ("user", "b")]
    assert got[None]["n_turns"] == 1 and got[1]["loss"] == ""
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "<|end|>\\" * 50_000
    assert read(spark.createDataFrame([(1, 0, "assistant", long)], SCHEMA))[1]["loss"] == long


def test_query_matches_sql_and_plans_no_python(spark, tmp_path):
    import duckdb
    from layoutcheck.llm.queries import ORACLES, QUERIES

    rows = [(c, t, r, x) for c in range(5) for t, (r, x) in enumerate([("user", "q<|end|>"), ("assistant", "ä\\|")] * (c + 1))] + [(9, 0, "assistant", "x"), (9, 1, None, None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    df = QUERIES["op10_chat_format"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    con.execute(ORACLES["op10_chat_format"])
    columns = [c[0] for c in con.description]
    want = sorted(tuple(r[columns.index(c)] for c in df.columns) for r in con.fetchall())
    got = sorted(tuple(r) for r in df.collect())
    assert got == want and got[0][0] == -7
    text = "</s>[INST] ok [/INST]"
    assert got[0][2] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
