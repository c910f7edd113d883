import base64
import re

import corpus_pipeline as cp
import numpy as np
import public_tokenizers as P
import tiktoken
from tests.llm import test_decontaminate, test_line_dedup, test_minhash_near, test_quality_divergence
from tests.llm.helpers import DOCS, SF, save_docs


def test_stages_against_plain_code(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").dropDuplicates(["doc_id"])
    now = docs
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    sizes = []
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, now, SF)
        if i < len(cp.STAGES) - 1:
            assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(f"{tmp_path}/{i}")
        before = {r.doc_id: r.text for r in now.collect()}
        now = spark.read.parquet(f"{tmp_path}/{i}")
        after = {r.doc_id: r for r in now.collect()}
        if name == "quality_rules":
            assert all(not test_quality_divergence.base(r.text)[-1] for r in after.values())
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            good = [d in after for d in before if labels.get(d) == 1 and not test_quality_divergence.base(before[d])[-1]]
            assert sum(good) / len(good) > 0.97
        if name == "line_dedup":
            want = {d: n for d, n, _, _ in test_line_dedup.against_all(list(before.items()))}
            assert {d: len(r.text) for d, r in after.items()} == {d: n for d, n in want.items() if n}
        if name == "minhash_near":
            assert set(after) == {d for d, _, _, kept in test_minhash_near.brute(list(before.items())) if kept}
        if name == "decontaminate":
            flat = lambda t: " " + " ".join(test_decontaminate.toks(t)) + " "
            assert not [d for d, r in after.items() for _, x in items if flat(x) in flat(r.text)]
        sizes.append(len(after))
    assert sizes[0] < docs.count() and sizes[-1] == sizes[-2] > 0 and sizes == sorted(sizes, reverse=True)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for d, r in after.items():
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(before[d]) and r.n_tokens == len(r.ids) // 4


def test_run_and_edges(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, "the cat sat on the mat and then it went home again to sleep"), (3, "a " * 50)]
    rows += [(5, " ".join(chr(97 + i % 26) + chr(97 + i // 26) + "x" for i in range(60))), (5, " ".join(chr(97 + i % 26) + chr(97 + i // 26) + "x" for i in range(60)))]
    save_docs(spark, tmp_path, rows, "1 as n_tokens")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(str(r.doc_id) for r in cp.run(spark, str(tmp_path)).collect()) == ["5", "None"]
    save_docs(spark, tmp_path / "none", [])
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert cp.run(spark, str(tmp_path / "none")).count() == 0


def test_near_stage_joins_from_80_percent(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").dropDuplicates(["doc_id"]).collect()]
    text = [f"n{i}" for i in range(204)]  # 200 windows of five words
    rows += [(10**6, " ".join(text)), (10**6 + 1, " ".join(text[20:]))]  # 180 of 200 windows: 0.9
    rows += [(10**6 + 2, " ".join(["m", *text[39:]])), (10**6 + 3, " ".join(text[:100]))]  # 0.8 and more of the second only; 0.48
    sets = {}
    for d, t in rows:
        w = re.split("[\x20\x09-\x0d]+", (t or "").lower().strip("\x20\x09\x0a\x0b\x0c\x0d"))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w != [""] else set()
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    between = 0
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                between += 100 * both < 85 * (len(sets[a]) + len(sets[b]) - both)
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS)
    out = cp.near_deduplication(spark, docs, SF)
    assert between and sorted(r.doc_id for r in out.collect()) == sorted(d for d in sets if top(d) == d)
