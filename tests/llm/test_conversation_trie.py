"""The trie of conversations against plain dictionaries and its SQL twin."""

import random
from hashlib import sha256

import duckdb
import pytest
from finspan.llm import conversation_trie as ct

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """All prefixes of all rebuilt conversations, in dictionaries."""
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns.setdefault(c, []).append((turn is not None, turn or 0, role, sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    turns = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, own in turns.items():
        h = ct.head_length(c)
        built[c] = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
    nodes = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        childless = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        ends = ",".join(map(str, sorted(c for c in members if built[c] == path)))
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in below), len(childless), saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def some_rows(seed, convs, families=4, longest=6):
    r, out = random.Random(seed), []
    for _ in range(convs):
        c = r.randrange(families) * 100 + r.choice([0, 1, 2, 3, 50, 99])
        for turn in range(r.randrange(longest)):
            out.append((c, r.choice([turn, turn, None]), r.choice(["user", "assistant", None]), r.choice(["a", "bb", "", None, "ccc"])))
    return out


CASES = {
    "random": some_rows(1, 60),
    "one family": some_rows(2, 20, families=1),
    "copies": [(c, t, "user", f"same {t}") for c in range(0, 900, 7) for t in range(9)],
    "a long conversation": [(100, t, "user", str(t)) for t in range(150)] + [(201, t, "user", str(t)) for t in range(150)] + [(305, 0, "user", "0")],
    "repeated rows and ties": [(7, 1, "user", "a")] * 4 + [(7, 1, "user", "b"), (7, None, None, None), (7, None, "user", "z"), (107, 1, "user", "a")],
    "turnless, absent bases, negative and missing ids": [(1, 0, "u", "x"), (2, 0, "u", "y"), (5, 0, "u", "z"), (-3, 0, "u", "x"), (-3, 1, "v", "x"), (-100, 0, "u", "q"), (None, 0, "u", "x")],
    "borders": [(0, 0, "1", ":a"), (100, 0, "", "1:a"), (200, 0, "1:", "a"), (300, 0, "ä", "日本語")],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("part_nodes", [2, 7, ct.PART_NODES])
def test_against_dictionaries(spark, name, part_nodes):
    df = spark.createDataFrame(CASES[name], SCHEMA).repartition(3)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in ct.trie(df, part_nodes).collect()), key=str) == plain(CASES[name])


def test_query_against_sql(spark, tmp_path):
    rows = some_rows(3, 50) + CASES["repeated rows and ties"] + CASES["turnless, absent bases, negative and missing ids"]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as key", "1 as base", "2 as depth")
    df.coalesce(2).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in ct.op11_conversation_trie(spark, str(tmp_path)).collect()), key=str)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = duck.sql(ct.ORACLES["op11_conversation_trie"])
    at = [want.columns.index(c) for c in COLUMNS]
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str) == plain(rows)


def test_empty(spark):
    assert ct.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert ct.trie(spark.createDataFrame([(None, 1, "user", "a")], SCHEMA)).collect() == []
