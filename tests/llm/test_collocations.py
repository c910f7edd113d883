"""Collocations against plain counting and the SQL twin."""

import random
import re
from collections import Counter

import duckdb
import pytest
from finspan.llm import collocations as co

from tests.llm.helpers import DOCS, save_docs

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def lower(s):
    return "".join(x.lower() if "A" <= x <= "Z" else x for x in s)


def plain(rows, least, covered, top, most=4):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    found = [x for x in f if len(x) > 2 and f[x] >= least]
    out = []
    for lang, *words in found:
        a, m = f[(lang, *words)], len(words)
        if any(x[0] == lang and len(x) > m + 1 and 100 * f[x] >= covered * a and any(list(x[i : i + m]) == words for i in range(1, len(x) - m + 1)) for x in found):
            continue
        cuts = [(2_000_000 * a // (f[(lang, *words[:k])] + f[(lang, *words[k:])]), k) for k in range(1, m)]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, f[(lang, *words[:k])], f[(lang, *words[k:])], n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    rank = Counter()
    ranked = []
    for x in out:
        rank[x[0]] += 1
        if rank[x[0]] <= top:
            ranked.append((x[0], rank[x[0]], *x[1:]))
    return sorted(ranked)


def found(spark, rows, least=2, covered=80, top=2000):
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], DOCS).selectExpr("*", "1 as range", "'x' as phrase", "2 as f").repartition(3)
    return sorted(tuple(r[c] for c in COLUMNS) for r in co.collocations(df, least, covered, top).select(*COLUMNS).collect())


def random_rows(seed, n, vocabulary, marks=" "):
    r = random.Random(seed)
    return [("".join(r.choice(vocabulary) + r.choice(marks) for _ in range(r.randrange(40))), r.choice(["en", "de", None])) for _ in range(n)]


CASES = {
    "random": random_rows(1, 80, ["a", "b", "c", "A", "aa", "ab"], "   \t.\n"),
    "odd bytes": random_rows(2, 60, ["a", "a\0", "a\1", "\1\2", "\0", "é", "É", "日", "\x1c", " ", " "], " "),
    "overlaps": [("x x x x x x x", "en"), ("x x", "en"), ("y. y. y y", "en")],
    "nulls and empty": [(None, "en"), ("", None), (" \t\n.,;", "en"), ("a b a b", None), ("a b", "und")],
    "copies": [("the quick brown fox jumps over the lazy dog", "en")] * 50 + [("the quick red fox", "en")] * 3,
    "a frequent first word": [(f"the w{i % 13} w{i % 7} w{i % 5}", "en") for i in range(600)],
    "one long text": [("to be or not to be that is " * 3000, "en")],
}


@pytest.mark.parametrize("name", CASES)
def test_against_counting(spark, name):
    for least, covered, top in ((2, 80, 2000), (5, 50, 3)):
        assert found(spark, CASES[name], least, covered, top) == plain(CASES[name], least, covered, top)


def test_small_ranges_and_buffers(spark, monkeypatch):
    """Ranges that end inside the runs of prefixes, and tasks that send on at each chance, change nothing."""
    monkeypatch.setattr(co, "KEEP_SUFFIXES", 1)
    monkeypatch.setattr(co, "STEP_ROWS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        for name in ("random", "a frequent first word", "odd bytes"):
            assert found(spark, CASES[name]) == plain(CASES[name], 2, 80, 2000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark):
    assert found(spark, []) == []


def test_query_against_sql(spark, tmp_path):
    rows = [(i, f"the w{i % 3} said. Of the w{i % 3} said {i}" if i % 2 else None, [None, "en", "de"][i % 3]) for i in range(400)]
    path = save_docs(spark, tmp_path, rows, "'x' as words")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    want = duck.sql(co.ORACLES["op12_collocations"])
    at = [want.columns.index(c) for c in COLUMNS]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in co.op12_collocations(spark, path).collect())
    assert got and got == sorted(tuple(r[i] for i in at) for r in want.fetchall()) == plain([(t, lang) for _, t, lang in rows], 30, 80, 2000)
