import itertools
import random
import re

from finspan.llm import decontaminate as dc
from tests.llm.helpers import SF, save_docs, words


def toks(t):
    return [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]


def overlaps(doc, item):
    """Whether a diagonal has a window that agrees, by plain search."""
    width = min(dc.SPAN, len(item))
    for shift in range(-len(item) + 1, len(doc)):
        same = [0 <= i + shift < len(doc) and doc[i + shift] == x for i, x in enumerate(item)]
        if any(100 * sum(same[i : i + width]) >= dc.PERCENT * width for i in range(len(item) - width + 1)):
            return True
    return False


def brute(docs, items):
    return sorted((d, tuple(sorted({i for i, x in items if toks(x) and overlaps(toks(t), toks(x))}))) for d, t in docs)


def got(spark, path):
    rows = dc.op1_decontaminate(spark, str(path)).collect()
    assert all(r.contaminated == bool(r["items"]) == (not r.kept) for r in rows)
    return sorted(((r.doc_id, tuple(r["items"])) for r in rows), key=str)


def test_passages_with_substitutions(spark, tmp_path):
    r = random.Random(6)
    items = [(i, " ".join(words(100 + i, n))) for i, n in enumerate((12, 15, 25, 40, 60, 3, 1, 11))] + [(20, None), (21, ""), (22, " ".join(words(102, 25))), (None, "w1 w2 w3")]
    docs = [(1, None), (2, ""), (3, "!!! ...")]
    for k in range(60):
        i = items[k % 8][1].split()
        part = i if k % 3 else i[len(i) // 4 :]
        for j in range(len(part)):
            if r.random() < (0, 0.1, 0.2, 0.3)[k % 4]:
                part[j] = "changed"
        docs.append((10 + k, " ".join(words(k, 30)) + ", " + " ".join(part).upper() + ". " + " ".join(words(k + 900, 30))))
    docs += [(100 + k, " ".join(words(5000 + k, 200))) for k in range(20)] + [(200, "a b c " * 3000), (200, "a b c " * 3000)]
    save_docs(spark, tmp_path, docs, "1 as items")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert got(spark, tmp_path) == sorted(((d, x) for d, x in brute(docs, [i for i in items if i[0] is not None])), key=str)


def test_every_substitution_that_is_allowed_in_a_short_item_is_found(spark, tmp_path):
    items = [(n, " ".join(words(300 + n, n, 10_000))) for n in range(1, 12)]
    docs = []
    for n, text in items:
        for changed in itertools.combinations(range(n), n * (100 - dc.PERCENT) // 100):
            part = [f"x{i}" if i in changed else w for i, w in enumerate(text.split())]
            docs.append((len(docs), " ".join(["before", *part, "after"])))
        if n >= 10:
            docs.append((len(docs), " ".join(text.split()[2:])))
            docs.append((len(docs), " ".join(text.split()[:-2])))
    save_docs(spark, tmp_path, docs)
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = got(spark, tmp_path)
    assert all(x for _, x in found) and found == sorted(brute(docs, items), key=str)


def test_recall_on_long_windows():
    """Of 20 tokens with as many substitutions as are allowed, nearly all patterns leave a mask whole."""
    for n, least in ((12, 0.93), (16, 0.98), (20, 0.999)):
        patterns = list(itertools.combinations(range(n), n * (100 - dc.PERCENT) // 100))
        kept = [any(all(i + k < n and i + k not in p for k in m) for m in dc.MASKS for i in range(n)) for p in patterns]
        assert sum(kept) >= least * len(kept)


def test_small_tables_and_columns(spark, tmp_path):
    save_docs(spark, tmp_path, [], "1 as __x")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert got(spark, tmp_path) == []
    docs = spark.createDataFrame([(1, "a b"), (None, "q")], "doc_id bigint, text string")
    assert dc.decontaminated(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == 2


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    flat = [(d, " " + " ".join(toks(t)) + " ") for d, t in docs]
    exact = {(d, i) for d, t in flat for i, x in items if " " + " ".join(toks(x)) + " " in t}
    found = {(d, i) for d, x in got(spark, SF) for i in x}
    assert exact and exact <= found
