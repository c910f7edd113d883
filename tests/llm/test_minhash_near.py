import random
import re

from finspan.llm import minhash_near, sketch
from tests.llm.helpers import SF, save_docs, words


def brute(rows):
    """What op10 must return: (doc_id, n_shingles, component_id, kept), by comparing all pairs."""
    sets = {}
    for d, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return sorted((d, len(sets[d]), top(d), top(d) == d) for d, _ in rows)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in minhash_near.op10_minhash_near(spark, SF).collect()) == brute(rows)


def test_chains_and_hot_group(spark, tmp_path):
    r = random.Random(3)
    base = words(1, 150)
    rows = [(1, " ".join(base)), (2, None), (3, ""), (4, " \t"), (5, "one two"), (6, "ONE\x0btwo"), (6, "ONE\x0btwo"), (7, "one two three")]
    for i in range(120):  # near copies of a text, of which many are near only to some of the others
        w = list(base)
        for _ in range(r.randrange(1, 9)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**9)}"
        rows.append((100 + i, " ".join(w)))
    w = words(2, 200)
    for i in range(30):  # a chain: each is near to the next only
        w = w[6:] + [f"c{i}_{j}" for j in range(6)]
        rows.append((400 - i, " ".join(w)))
    save_docs(spark, tmp_path, rows, "9 as component_id")
    got = sorted(tuple(x) for x in minhash_near.op10_minhash_near(spark, str(tmp_path)).collect())
    assert got == brute(rows)
    save_docs(spark, tmp_path / "none", [])
    assert minhash_near.op10_minhash_near(spark, str(tmp_path / "none")).count() == 0


def test_null_id(spark, tmp_path):
    save_docs(spark, tmp_path, [(None, "a b c d e f"), (2, "a b c d e f")])
    got = {tuple(x) for x in minhash_near.op10_minhash_near(spark, str(tmp_path)).collect()}
    assert got == {(None, 2, None, True), (2, 2, 2, True)}


def test_signature_estimates_jaccard():
    a = sketch.shingles(" ".join(f"a{i}" for i in range(1000)).encode())
    b = sketch.shingles(" ".join(f"a{i}" for i in range(100, 1100)).encode())
    j = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    same = (sketch.signature(a, 512) == sketch.signature(b, 512)).mean()
    assert abs(same - j) < 0.08
