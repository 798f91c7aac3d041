import random

import duckdb
import pytest

from loomframe.llm import chat


def test_template_round_trip():
    rng = random.Random(2)
    bits = ["<", "|", "\\", "<|", "<|im_end|>", "<\\|", "x", "\n", "<|im_start|>assistant\n"]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "a\\n\nb", "<|im_end|>"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(1, 4))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_trees(spark):
    rows = [
        ("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 2.0), ("t", 4, 3, "user", "c", None),
        ("u", 1, 2, "x", "cycle", 0.0), ("u", 2, 1, "x", "cycle", 0.0), ("u", 3, 2, "x", "hangs on it", 0.0),
        (None, 7, 99, None, None, 0.0), (None, 7, 99, None, None, 0.0), ("t", 5, 4, "assistant", "d", 0.0),
    ]
    m = spark.createDataFrame(rows, "tree_id string, node_id int, parent_id int, role string, text string, score double")
    got = {(r.tree_id, r["rank"]): chat.parse(r.formatted) for r in chat.format_trees(m, score="score").collect()}
    assert got == {("t", 1): [("user", "q"), ("assistant", "b"), ("user", "c"), ("assistant", "d")], ("t", 2): [("user", "q"), ("assistant", "a")], (None, 1): [("", "")]}
    assert [r.leaf for r in chat.format_trees(m, score="score", keep=1).collect()].count("+2") == 0
    assert chat.format_trees(m.limit(0)).collect() == []
    assert chat.format_trees(m.selectExpr("1 AS t", "2 AS n", "3 AS c", "4 AS dist", "*"), score="score").count() == 3


def test_paths_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(t, n, rng.randrange(n) if n and rng.random() < 0.9 else None) for t in range(5) for n in range(40)]
    parent = {(t, n): p for t, n, p in rows}
    leaves = {k for k in parent} - {(t, p) for (t, _), p in parent.items() if p is not None}
    want = set()
    for t, n in leaves:
        path, at = [], n
        while at is not None:
            path.append(at)
            at = parent[t, at]
        want.add((t, tuple(path)))
    m = spark.createDataFrame(rows, "tree int, node int, parent int")
    got = {}
    for r in chat.paths(m, "tree", "node", "parent").collect():
        got.setdefault((int(r.t[1:]), r.leaf), {})[r.dist] = int(r.n[1:])
    assert {(t, tuple(v[i] for i in range(len(v)))) for (t, _), v in got.items()} == want


def test_leaves_that_hang_on_cycles_are_not_spelt_out(spark):
    """One such leaf beside a long chain and many trees: no round may grow its path."""
    rows = [("a", i, i - 1 if i else None) for i in range(300)] + [("b", 0, 1), ("b", 1, 2), ("b", 2, 0), ("b", 3, 0), ("b", 4, 3), ("b", 10, None), ("b", 11, 10)]
    rows += [(f"t{i}", k, k - 1 if k else None) for i in range(50) for k in range(3)]
    got = chat.paths(spark.createDataFrame(rows, "tree string, node int, parent int"), "tree", "node", "parent").collect()
    assert len(got) == 300 + 2 + 150 and {(r.leaf, r.n) for r in got if r.t == "+b"} == {("+11", "+11"), ("+11", "+10")}


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", None), (None, 1, "user", None), (None, None, None, "x"), (3, 0, "assistant", "<|im_end|>"), (3, 0, "assistant", "<|im_end|>")]])
def test_odd_conversations(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.read_back(chat.format_trees(chat.chain(df))).collect()}
    assert got == ({None: (3, 0), 3: (2, 20)} if rows else {})


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    df = chat.op3_chat(spark, sf_dir)
    rel = con.sql(chat.ORACLE).order("conv_id")
    assert df.columns == rel.columns and sorted(map(tuple, df.collect())) == rel.fetchall()
