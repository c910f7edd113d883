"""Packing against the tokenizers library, sequential best fit and the least number of sequences."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from finspan.llm import packing as pk
from tokenizers import Tokenizer

from tests.llm.helpers import DOCS, SF, save_docs

PATH = P.path("byte_bpe_50k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "Hello, world! It's 10 o'clock.", "x\ny\n\nz ", "tab\t tab \t", " a  b　 c", "日本語 テキスト です", "naïve café Ω", "\x1c a \x1d b", "a ᠎b",
    "One. Two, three; one. Two,\nthree\nFour.\nFour, five", "a\n\nb", "a\n\n\nb \n c", "\nstart", "end.\n", "x.\r\ny", "it's. O'Neil, é. ü, ж. 9, a9. a.. a!?", "end\n.", ". , ;",
    "🙂 🙃🙂 x", "<|endoftext|> and <|endoftext|>", "a" * 3000, "word " * 500, "\0 \1", "don't   stop", " lead and trail ",
]


def test_encoder(monkeypatch):
    t, e = library(), pk.Encoder(PATH)
    more = TEXTS + [" ".join(chr(random.Random(i).randrange(32, 0x3100)) + "z" for i in range(j, j + 40)) for j in range(0, 4000, 40)]
    for known in (pk.KEEP_BYTES, 0):
        monkeypatch.setattr(pk, "KEEP_BYTES", known)
        for text, ids in zip(more, e.encode(more), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_slices():
    text = " ".join(TEXTS) * 3
    e, parts = pk.Encoder(PATH), list(pk.slices(text, 50))
    assert "".join(parts) == text and len(parts) > 20
    assert b"".join(x for p in parts for x in e.encode([p])) == e.encode([text])[0]


def test_cuts():
    for n in range(1, 50):
        found = pk.cuts(n, 8)
        assert sum(x for _, x in found) == n and [s for s, _ in found] == [sum(x for _, x in found[:i]) for i in range(len(found))]
        assert all(x == 8 for _, x in found[1:]) and (len(found) == 1 or n > 8)


def best_fit(lengths, capacity):
    """Number of sequences of sequential best fit, longest pieces first."""
    free = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= x]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= x
        else:
            free.append(capacity - x)
    return len(free)


def lengths_of(name, n, capacity):
    r = random.Random(name)
    return {
        "even": lambda: r.randint(1, capacity),
        "short": lambda: r.randint(1, 9),
        "one length": lambda: 7,
        "a hot length": lambda: 45 if r.random() < 0.4 else r.randint(1, capacity),
        "half": lambda: r.choice([capacity // 2, capacity // 2 + 1, capacity // 2 - 1]),
        "thirds": lambda: r.choice([34, 33, 35, 1]),
        "whole": lambda: capacity,
    }[name], n


@pytest.mark.parametrize("name", ["even", "short", "one length", "a hot length", "half", "thirds", "whole"])
@pytest.mark.parametrize("last", [50_000, 40])
def test_rounds(spark, monkeypatch, name, last):
    monkeypatch.setattr(pk, "LAST_ROWS", last)
    draw, n = lengths_of(name, 700, 100)
    lengths = [draw() for _ in range(n)]
    items = spark.createDataFrame([(i + 1, x) for i, x in enumerate(lengths)], "uid bigint, length bigint").repartition(3)
    rows = pk.assigned(items, 100).collect()
    assert sorted(r.uid for r in rows) == list(range(1, n + 1))
    used = defaultdict(int)
    for r in rows:
        used[r.seq] += lengths[r.uid - 1]
    assert max(used.values()) <= 100
    best = best_fit(lengths, 100)
    assert len(used) <= (best if last > n else best + max(2, best // 50))


def test_least_new():
    assert pk.least_new([(1, 10, 5)], 20) == 3  # by tokens 2.5
    assert pk.least_new([(1, 7, 5)], 20) == 3  # two to a sequence
    assert pk.least_new([(1, 7, 5), (0, 15, 2)], 20) == 1
    assert pk.least_new([(1, 7, 5), (0, 6, 90)], 20) == 3  # those gaps are too small
    assert pk.least_new([(1, 1, 5), (0, 6, 1)], 20) == 0


def packed(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).selectExpr("*", "1 as piece", "'x' as uid", "2 as length").repartition(2)
    return pk.pack_documents(df, PATH, **more)


def test_documents(spark):
    t = library()
    rows = list(enumerate(TEXTS)) + [(None, "without an id"), (3, "again"), (3, "again"), (70, None), (71, "a long text " * 900)]
    got = packed(spark, rows, capacity=64, with_ids=True).collect()
    want = defaultdict(list)
    for i, text in rows:
        want[i].append([*t.encode(text or "", add_special_tokens=False).ids, 0])
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: r.start):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.piece == -(-r.start // 64)
        found[r.doc_id].append(ids)
    for i, texts in want.items():
        assert sorted(x for ids in found[i] for x in ids) == sorted(x for ids in texts for x in ids)
        if len(texts) == 1:
            assert [x for ids in found[i] for x in ids] == texts[0]
            assert all(len(x) == 64 for x in found[i][1:])
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(x.length for x in parts[:i]) for i in range(len(parts))]
        assert sum(r.length for r in parts) <= 64
    whole = {r.sequence_id: r.ids for r in pk.sequences(packed(spark, rows, capacity=64, with_ids=True)).collect()}
    assert sum(map(len, whole.values())) == 4 * sum(r.length for r in got) and max(map(len, whole.values())) <= 256


def test_empty(spark):
    assert packed(spark, []).collect() == []


def test_query(spark):
    rows = pk.op13_best_fit_packing(spark, SF).toPandas()
    assert list(rows.columns).count("doc_id") == 1 and set(rows.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    t = library()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    for doc_id, text in zip(docs.doc_id, docs.text, strict=True):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for r in rows[rows.doc_id == doc_id].itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert rows[rows.doc_id == doc_id].length.sum() == len(ids)
    assert rows.sequence_id.nunique() == -(-rows.length.sum() // 2048) or rows.sequence_id.nunique() == best_fit(rows.length, 2048)


def test_files(spark, tmp_path):
    """The query's table as written files, with a clashing extra column."""
    path = save_docs(spark, tmp_path, [(1, "a b c"), (2, None)], "'x' as sequence_id")
    assert sorted((r.doc_id, r.length) for r in pk.op13_best_fit_packing(spark, path).collect()) == [(1, 4), (2, 1)]
