import difflib
import hashlib
import random

import numpy as np
from finspan.llm import line_dedup as ld
from tests.llm.helpers import SF, save_docs


def brute(rows):
    """Rows as op8 must return them, where each doc_id has one text."""
    first, keyed = {}, {}
    for d, t in rows:
        if d is not None and t:
            keyed[d] = ld.line_keys(t.encode())
            for k, n in zip(*(x.tolist() for x in keyed[d])):
                if n >= ld.SEED_BYTES:
                    first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        gone = set()
        if d in keyed:
            k, n = keyed[d]
            for f in {first[x] for x, z in zip(k.tolist(), n.tolist()) if z >= ld.SEED_BYTES} - {d}:
                gone |= set(ld.removed(k, n, keyed[f][0]))
        left = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        out.append((d, None if t is None else len(left), len(gone), None if t is None else hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


def test_patience():
    r = random.Random(4)
    for _ in range(300):
        a = [r.randrange(12) for _ in range(r.randrange(20))]
        b = [x for x in a if r.random() < 0.8] + [r.randrange(12) for _ in range(3)]
        got = ld.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    a = list(range(50))
    assert ld.patience(a, a[:10] + [99] + a[20:]) == [(i, i) for i in range(10)] + [(i, i - 9) for i in range(20, 50)]
    m = difflib.SequenceMatcher(None, a, a[5:]).ratio()
    assert m > 0.9 and len(ld.patience(a, a[5:])) == 45


def test_edges(spark, tmp_path):
    long = "a line that is long enough to be found and deleted"
    rows = [(1, f"{long}\nnext line, also long enough\n\nlast"), (2, f"own start of this\n  {long}\t\nnext line, also long enough\n\nother"), (2, f"own start of this\n  {long}\t\nnext line, also long enough\n\nother")]
    rows += [(3, None), (4, ""), (None, long), (5, long), (6, "short\nshort"), (7, "short\nshort"), (8, "\n\n\n"), (9, "\n".join(f"line {i} of a very long text with words" for i in range(3000)))]
    rows += [(10 + i, f"{long}\n{i}") for i in range(40)] + [(60, rows[-1][1] + "\nmore")]
    save_docs(spark, tmp_path, rows, "1 as removed_lines")
    assert sorted((tuple(r) for r in ld.op8_line_dedup(spark, str(tmp_path)).collect()), key=str) == brute(rows)
    save_docs(spark, tmp_path / "none", [])
    assert ld.op8_line_dedup(spark, str(tmp_path / "none")).count() == 0
    full = ld.delete_repeated_lines(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert set(full.columns) == {"doc_id", "text", "lang", "source", "n_chars", "removed_lines"}


def test_blank_lines_at_the_ends_of_a_block_stay():
    k, n = ld.line_keys(("x" * 50 + "\n\n" + "tail").encode())
    k2, _ = ld.line_keys(("x" * 50 + "\n\n" + "other").encode())
    assert ld.removed(k, n, k2) == [0] and isinstance(k, np.ndarray)


def against_all(rows):
    """Rows as op8 must return them where each doc_id has one text: each aligned with every earlier document that shares a line."""
    keyed = {d: ld.line_keys(t.encode()) for d, t in rows if d is not None and t}
    out = []
    for d, t in rows:
        gone = set()
        for f in keyed if d in keyed else ():
            if f < d and set(keyed[f][0].tolist()) & set(keyed[d][0].tolist()) - {0}:
                gone |= set(ld.removed(*keyed[d], keyed[f][0]))
        left = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        out.append((d, None if t is None else len(left), len(gone), None if t is None else hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


def test_blocks_of_any_earlier_document_go(spark, tmp_path):
    a, b, c, e = (f"{x} thirty bytes and some more.." for x in "abce")
    long = [f"line {i} of forty bytes and more, on its own" for i in range(4)]
    texts = [f"{a}\n1", f"{b}\n2", f"{a}\n{b}\n3", f"{a}\n{b}\n4"]  # both lines of the block were first seen apart
    texts += ["x: 1\ny: 2\n" + "\n".join(f"s{i}" for i in range(20)), "own\n" + "\n".join(f"s{i}" for i in range(20)) + "\nend"]  # short lines only
    texts += [f"{long[0]}\n{long[1]}", f"{long[1]}\nq\n{long[0]}", f"{long[1]}\nr\n{long[0]}"]  # in crossing order in the first holder
    texts += [long[2], f"{long[2]}\nu\n{long[2]}", f"{long[2]}\nv\n{long[2]}"]  # more than once
    texts += [f"{long[3]}\nend", f"{long[3]}\ntail\nw", f"{long[3]}\ntail\nz", f"{c}\nab\n{e}", f"k\n{c}\nab\n{e}"]  # a line beside a block
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    got = ld.op8_line_dedup(spark, save_docs(spark, tmp_path, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == against_all(rows)
    assert all({r.doc_id: r.removed_lines for r in got}[d] for d in (4, 6, 9, 12, 15, 17))


def test_whole_table_against_all_earlier_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in ld.op8_line_dedup(spark, SF).collect()), key=str) == against_all(rows)


def test_runs_cover_every_block():
    r = np.random.default_rng(5)
    for _ in range(200):
        sizes = r.choice([0, 5, 15, 25, 39, 40, 60], r.integers(1, 12)).astype(np.int32)
        h, first, last = ld.runs(np.where(sizes > 0, r.integers(1, 9, len(sizes)), 0), sizes)
        assert all(sizes[i:j].sum() >= ld.BLOCK_BYTES for i, j in zip(first, last))
        for i in range(len(sizes)):
            for j in range(i + 1, len(sizes) + 1):
                if sizes[i:j].sum() >= ld.BLOCK_BYTES:
                    inside = {k for a, b in zip(first, last) if i <= a and b <= j for k in range(a, b)}
                    assert set(i + np.flatnonzero(sizes[i:j])) <= inside


def test_runs_that_many_documents_have_go_wherever_they_stand(spark, tmp_path):
    x, y = "one line that very many documents have in common", "and another one of the same kind, as long"
    rows = [(i, f"{x}\n{i}\n{y}") for i in range(ld.MANY + 20)] + [(900, f"{y}\na\n{x}\nb\n{y}"), (901, "nothing of these")]
    got = {r.doc_id: r for r in ld.op8_line_dedup(spark, save_docs(spark, tmp_path, rows)).collect()}
    assert got[0].removed_lines == 0 and all(got[i].removed_lines == 2 for i in range(1, ld.MANY + 20))
    assert got[900].kept_sha256 == hashlib.sha256(b"a\nb").hexdigest() and got[901].removed_lines == 0


def test_five_documents_that_share_lines_with_others_first(spark, tmp_path):
    lines = [f"shared line {i}, long enough to be a seed by itself, as it has 60" for i in range(3)]
    rows = [(i + 1, f"{x}\nown {i}") for i, x in enumerate(lines)] + [(5, "\n".join(lines)), (9, "\n".join(["begin", *lines, "end"]))]
    got = {r.doc_id: r.removed_lines for r in ld.op8_line_dedup(spark, save_docs(spark, tmp_path, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 5: 3, 9: 3}
