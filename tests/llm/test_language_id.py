import math
import random

import numpy as np
from finspan.llm import language_id as li
from tests.llm.helpers import SF, save_docs


def naive(text, sample):
    """Phrases of a greedy parse by plain search."""
    n = i = 0
    while i < len(text):
        j = i
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        i = max(j, i + 1)
        n += 1
    return n


def test_phrases_equal_plain_search():
    r = random.Random(2)
    samples = {k: "".join(r.choice(a) for _ in range(300)) for k, a in (("aa", "abc "), ("bb", "bcd"))}
    m = li.Model({k: [np.array([ord(c) for c in v], np.uint32)] for k, v in samples.items()})
    texts = ["".join(r.choice("abcdx ") for _ in range(n)) for n in (1, 2, 7, 50, 1000, 5000, 0)]
    got = m.phrases([np.array([ord(c) for c in t], np.uint32) for t in texts])
    for t, row in zip(texts, got.tolist()):
        assert row == [naive(t, samples[k] + " ") for k in ("aa", "bb")]
    assert m.bits == [math.log2(301)] * 2


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "lang").distinct()
    got = li.op9_language_id(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = got.where("held_out").join(docs, "doc_id").collect()
    assert held and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in held)


def test_edges(spark, tmp_path):
    rows = [(i, "the cat and the dog of the house " * 5, "en") for i in range(20)] + [(i, "der hund und die katze im haus " * 5, "de") for i in range(20, 40)]
    rows += [(50, None, "en"), (51, "", "de"), (52, "123 !!", "en"), (53, "日本", None), (54, "und die katze " * 20000, "xx"), (None, "the house", "en"), (55, "the house", None), (55, "the house", None)]
    save_docs(spark, tmp_path, rows, "1 as score")
    got = {(r.doc_id, r.lang_pred) for r in li.op9_language_id(spark, str(tmp_path)).collect()}
    assert {(50, "und"), (51, "und"), (52, "und"), (55, "en"), (None, "en"), (1, "en"), (21, "de")} <= got
    save_docs(spark, tmp_path / "none", [])
    assert li.op9_language_id(spark, str(tmp_path / "none")).count() == 0
    save_docs(spark, tmp_path / "unlabelled", [(1, "abc", None)])
    assert [r.lang_pred for r in li.op9_language_id(spark, str(tmp_path / "unlabelled")).collect()] == ["und"]


def test_pieces_make_no_difference(monkeypatch):
    r = np.random.default_rng(2)
    text = lambda n, letters: "".join(r.choice(list(letters), n, p=np.array([3, 2, 1, 1, 1, 1, 1][: len(letters)]) / sum([3, 2, 1, 1, 1, 1, 1][: len(letters)])))
    m = li.Model({"a": [li.symbols(text(600, "abcd "))], "b": [li.symbols(text(600, "badce f"))]})
    texts = [li.symbols(text(n, "abcdefx")) for n in (1, 5, 8, 9, 40, 333, 2000)] + [li.symbols(text(3000, "abcd ")), np.full(100, ord("z"), np.uint32), li.symbols("abcd " * 50)]
    monkeypatch.setattr(li, "PIECE", 1 << 30)
    whole = m.phrases(texts)
    for size in (1, 3, 8, 64):
        monkeypatch.setattr(li, "PIECE", size)
        assert (m.phrases(texts) == whole).all()
