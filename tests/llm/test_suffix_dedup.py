import hashlib
import random

import numpy as np
from finspan.llm import suffix_dedup as sd
from tests.llm.helpers import SF, save_docs


def brute(rows, width=sd.WIDTH):
    seen = {}
    texts = [(t or "").encode() for _, t in rows]
    for x in texts:
        for i in range(len(x) - width + 1):
            w = x[i : i + width]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (d, _), x in zip(rows, texts):
        gone = bytearray(len(x))
        for i in range(len(x) - width + 1):
            if seen[x[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(c for c, g in zip(x, gone) if not g)
        out.append((d, len(x), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, path):
    return sorted((tuple(r) for r in sd.op7_suffix_dedup(spark, str(path)).collect()), key=str)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert got(spark, SF) == want and any(r[2] for r in want)


def rows_with_repeats():
    r = random.Random(7)
    text = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    passage, other = text(700), text(190)
    rows = [(1, None), (2, ""), (3, "x" * 199), (4, "y" * 200), (5, "z" * 201), (6, "ab" * 400), (None, passage), (7, passage), (7, passage), (8, text(50) + passage[100:450] + text(60)), (9, other + text(9)), (10, text(9) + other)]
    rows += [(20 + i, text(r.randrange(300)) + passage[i * 7 : i * 7 + 230] + text(r.randrange(300))) for i in range(25)]
    rows += [(60, passage[:200] + "Q" + passage[:200]), (61, passage[:199]), (62, text(400) + passage[300:500]), (63, "The. " * 300)]
    return rows


def test_edges(spark, tmp_path):
    save_docs(spark, tmp_path, rows_with_repeats(), "1 as n_bytes")
    assert got(spark, tmp_path) == brute(rows_with_repeats())
    save_docs(spark, tmp_path / "none", [])
    assert got(spark, tmp_path / "none") == []


def test_hot_anchors_and_small_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sd, "HOT", 2)
    monkeypatch.setattr(sd, "_CHUNK", 500)
    monkeypatch.setattr(sd, "BUCKET", 64)
    monkeypatch.setattr(sd, "BROADCAST_BYTES", 0)
    save_docs(spark, tmp_path, rows_with_repeats())
    assert got(spark, tmp_path) == brute(rows_with_repeats())


def test_cover():
    assert {(a - b) % sd.PERIOD for a in sd.COVER for b in sd.COVER} == set(range(sd.PERIOD))


def test_equal_windows_have_equal_anchors():
    r = np.random.default_rng(2)
    raw = r.integers(97, 100, 3000).astype(np.uint8)
    raw[2000:2400] = raw[500:900]
    _, _, begin, size, at = sd.runs_of(raw, np.array([len(raw)]))
    anchor = np.repeat(at, size) - (np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    assert size.sum() == 3000 - sd.WIDTH + 1 and (anchor[500:700] == anchor[2000:2200]).all()
