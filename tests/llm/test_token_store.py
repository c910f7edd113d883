import shutil
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from finspan.llm import token_store as ts
from tests.llm.helpers import SF, save_docs
from tokenizers import Tokenizer

PATH = P.path("word_bpe_49k.json")


def brute(rows):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    start, out = 0, []
    for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in ts.op4_token_store(spark, SF).orderBy("start").collect()]
    assert len(got) == len(rows) and sorted((d, n, c) for d, _, n, c in got) == sorted((d, n, c) for d, _, n, c in brute(rows))
    if len({d for d, _ in rows}) == len(rows):
        assert got == brute(rows)
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n


def test_edges(spark, tmp_path):
    rows = [(7, None), (3, ""), (5, " \n"), (9, "<|endoftext|> a<|endoftext|>b"), (8, "CAFÉ Cafe\u0301 İx a\x1cb x\u00a0y \u0301z don't"), (1, "ab " * 9000), (2, "ab " * 9000), (None, "q"), (4, "日本語" * 500)]
    save_docs(spark, tmp_path, rows, "1 as start")
    got = [tuple(r) for r in ts.op4_token_store(spark, str(tmp_path)).orderBy("start").collect()]
    assert got == brute(rows)
    save_docs(spark, tmp_path / "none", [])
    assert ts.op4_token_store(spark, str(tmp_path / "none")).count() == 0


def test_store_reads_back_and_notices_damage(spark, tmp_path):
    rows = [(i, f"common words here {'and more of them ' * 300} {i % 3} end") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    store = str(tmp_path / "store")
    ts.write_store(docs, store, PATH)
    t = Tokenizer.from_file(PATH)
    for r in ts.read_ids(spark, store).collect():
        assert np.frombuffer(r.ids, "<u2").tolist() == [*t.encode(rows[r.doc_id][1], add_special_tokens=False).ids, 2]
    chunks = ts._chunks(spark, store)
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert spark.read.parquet(f"{store}/manifest").groupBy().sum("n_docs").first()[0] == 12
    bad = str(tmp_path / "bad")
    ts.write_store(docs, bad, PATH)
    spark.read.parquet(f"{store}/recipes").withColumn("root", __import__("pyspark").sql.functions.lit(b"x")).write.mode("overwrite").parquet(f"{bad}/recipes")
    with pytest.raises(Exception, match="root"):
        ts.digests(spark, bad).collect()


def test_damage_raises(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"{i} {'some words of a text ' * 400}{i}") for i in range(8)], "doc_id bigint, text string")
    for name, change in {
        "manifest": lambda d: spark.read.parquet(f"{d}/manifest").withColumn("n_docs", F.col("n_docs") + 1),
        "recipes": lambda d: spark.read.parquet(f"{d}/recipes").where("doc_id <> 3"),
        "raw/kind=1": lambda d: spark.read.parquet(f"{d}/raw/kind=1").limit(3),
    }.items():
        whole, bad = str(tmp_path / f"{name}-whole"), str(tmp_path / f"{name}-bad")
        ts.write_store(docs, whole, PATH)
        assert ts.digests(spark, whole).count() == 8
        shutil.copytree(whole, bad)
        shutil.rmtree(f"{bad}/{name}")
        change(whole).write.parquet(f"{bad}/{name}")
        with pytest.raises(Exception, match="manifest|missing"):
            ts.digests(spark, bad).collect()


def test_lone_marks():
    e = ts.WordEncoder(PATH)
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    for x in ("a b, c. d", "u.s. 3.5, x...\ty?! é, é,\nz;", ", . a,", "It's 5: a,b c,d, (x), <|endoftext|>, end.", "a.\u00a0b. c\u0301, d"):
        assert np.frombuffer(e.encode([x.encode()])[0], "<u2").tolist() == t.encode(x, add_special_tokens=False).ids


def test_cuts_follow_content():
    ids = np.random.default_rng(1).integers(0, 49000, 20000).astype("<u2")
    a, b = ts.cuts(ids), ts.cuts(np.concatenate([ids[:100], ids[150:]]))
    assert a[-1] == 20000 and max(np.diff([0, *a])) <= ts.MOST
    assert len({x - 50 for x in a} & set(b)) > 0.8 * len(a)


def test_repeated_rows_in_several_partitions_stay(spark, tmp_path):
    rows = [(None, None), (None, ""), (4, "one text"), (4, "one text"), (None, "another text"), (7, "last")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert docs.union(docs).union(docs).rdd.getNumPartitions() > 1
    store = str(tmp_path / "store")
    ts.write_store(docs.union(docs).union(docs), store, PATH)
    got = sorted((tuple(r) for r in ts.digests(spark, store).collect()), key=lambda r: r[1])
    want = brute(rows * 3)
    assert len(got) == len(want) and sorted((str(d), n, c) for d, _, n, c in got) == sorted((str(d), n, c) for d, _, n, c in want)
    assert [s for _, s, _, _ in got] == [sum(r[2] for r in got[:i]) for i in range(len(got))]
    assert len({r[0] for r in spark.read.parquet(f"{store}/raw").where("kind = 1").select("key").collect()}) == ts._chunks(spark, store).count()
