import base64
import hashlib
import random
import struct

import public_tokenizers as P
import tiktoken
from finspan.llm import byte_bpe
from tests.llm.helpers import SF, save_docs

PATH = P.path("byte_bpe_50k.tiktoken")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(enc, doc_id, text):
    ids = enc.encode_ordinary(text or "")
    return doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_whole_table(spark):
    enc = reference()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in byte_bpe.op5_byte_bpe(spark, SF).collect())
    assert got == sorted(expected(enc, *r) for r in docs)


def test_edges(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " "), (4, "  a \n\n b\tc  "), (4, "  a \n\n b\tc  "), (5, "x" * 30000), (6, "don't I'll 123 日本語 é  é 🎉  z"), (None, "ab <|endoftext|>"), (7, "a\x1c b \x1c"), (8, "a  b\n c")]
    save_docs(spark, tmp_path, rows, "1 as n_tokens")
    enc = reference()
    got = sorted((tuple(r) for r in byte_bpe.op5_byte_bpe(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected(enc, *r) for r in rows), key=str)
    save_docs(spark, tmp_path / "none", [])
    assert byte_bpe.op5_byte_bpe(spark, str(tmp_path / "none")).count() == 0


def test_append_and_edit():
    v = byte_bpe.Vocabulary.load(PATH)
    enc = tiktoken.Encoding("bare", pat_str=r"[\s\S]+", mergeable_ranks=v.ranks, special_tokens={})
    r = random.Random(5)
    for _ in range(200):
        data = bytes(r.choice(b"the anion. ") for _ in range(r.randrange(1, 40)))
        table = byte_bpe.PrefixTable(v)
        for i in range(len(data)):
            table.append(data[i : i + 1])
        assert table.ids() == enc._encode_single_piece(data) or len(table.ids()) == 1
        a = r.randrange(len(data))
        table.replace(a, a + 2, b"xyz")
        edited = data[:a] + b"xyz" + data[a + 2 :]
        assert bytes(table.data) == edited and table.ids() == enc._encode_single_piece(edited)
