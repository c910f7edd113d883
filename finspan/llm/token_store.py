"""Content-addressed store of token ids.

Layout of a store (all files are Parquet with zstd, written by Spark's own committer):

- chunks/: digest (16 bytes of blake2b over data), data (ids as little-endian unsigned 16-bit integers).
  A rolling hash over the last ids of a document's stream decides where a chunk ends, so that equal passages
  give equal chunks wherever they stand. Every chunk is stored once.
- recipes/: one row for each document in ascending doc_id order: doc_id, start (ids of all documents before
  it), n_tokens, digests (of its chunks, in order, joined), sizes (ids in each chunk, 32-bit, joined), root (of
  the Merkle tree over the digests), part.
- manifest/: for each recipe part the first start, documents, ids, and the Merkle root over its documents' roots.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finspan.llm import common
from finspan.llm.common import shared_dir, written

#: Words whose ids, and chunks whose digests, a Python worker keeps; on more, it keeps those in use. It bounds memory and changes no result.
KEEP_WORDS, KEEP_DIGESTS = 2_000_000, 500_000
#: Ids that the rolling hash sees, the mean length of a chunk beyond the least, least and most ids of a chunk.
WINDOW, MEAN, LEAST, MOST = 16, 256, 32, 4096
DIGEST = 16
#: Marks that end a word; they are a token apart from a letter or digit before them.
_MARKS = b".,;:!?"


def _one_piece(word: str) -> bool:
    """Whether the tokenizer takes the word as one piece: it has but letters, also once normalised."""
    return word.isalpha() if word.isascii() else unicodedata.normalize("NFC", word).lower().isalpha()


class WordEncoder:
    """Ids of texts under a word-level tokenizer file; words between ASCII white space are looked up whole, by 64-bit hashes.

    The tokenizer drops white space and lets no token cross it, so a text's ids are those of its words. A single mark
    behind an ASCII letter or digit is a token of its own and looked up apart. The strings of special tokens are ordinary text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain, self.marked = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        special = {i: t.content for i, t in self.marked.get_added_tokens_decoder().items()}
        self.special = re.compile("|".join(map(re.escape, special.values())).encode()).search
        self.mark_id, self.mark = max(special.items())
        #: Of each id, whether a piece ends with it.
        self.last = np.zeros(self.plain.get_vocab_size(), bool)
        self.last[[i for t, i in self.plain.get_vocab().items() if t.endswith("</w>")]] = True
        of_mark = [self.plain.encode(chr(x), add_special_tokens=False).ids for x in _MARKS]
        self.of_mark = np.zeros(256, "<u2")
        self.of_mark[list(_MARKS)] = [x[0] for x in of_mark]
        self.lone = bytes(m for m, x in zip(_MARKS, of_mark, strict=True) if len(x) == 1)
        self._forget()

    def _forget(self) -> None:
        """The known words: their hashes, ascending, and where their ids are in flat."""
        self.keys, self.begin, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u2")

    def _ids(self, words: list[str], joined: str) -> np.ndarray:
        groups = [joined.join(words[i : i + 64]) for i in range(0, len(words), 64)]
        return np.concatenate([np.array(e.ids, "<u2") for e in self.marked.encode_batch_fast([g + joined for g in groups], add_special_tokens=False)])

    def learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        known: dict[bytes, bytes] = {}
        whole, cut = [], []
        for w in words:
            if self.special(w):
                known[w] = np.array(self.plain.encode(w.decode(), add_special_tokens=False).ids, "<u2").tobytes()
            elif w[-1] in _MARKS and (core := w.rstrip(_MARKS)) and core[-1:].isalnum():  # else the marks may belong to a longer run
                cut.append((w, core, w[len(core) :]))
            else:
                whole.append(w)
        new = {x for _, core, marks in cut for x in (core, marks)} - known.keys()
        new.update(whole)
        text = b" ".join(new).decode().split(" ") if new else []
        one = sorted(filter(_one_piece, text))
        rest = list(set(text).difference(one))
        for i in range(0, len(one), 64_000):
            part = one[i : i + 64_000]
            ids = self._ids(part, " ")
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            raw = ids.tobytes()
            known.update(zip((w.encode() for w in part), [raw[2 * a : 2 * b] for a, b in zip([0, *ends], ends)], strict=True))
        for i in range(0, len(rest), 64_000):
            part = rest[i : i + 64_000]
            ids = self._ids(part, self.mark)
            ends = np.flatnonzero(ids == self.mark_id).tolist()
            raw = ids.tobytes()
            known.update(zip((w.encode() for w in part), [raw[2 * a : 2 * b] for a, b in zip([0, *(x + 1 for x in ends)], ends)], strict=True))
        for w, core, marks in cut:
            known[w] = known[core] + known[marks]
        return [known[w] for w in words]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        raw = common._LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]  # ASCII letters, which the tokenizer lower-cases anyway
        h, starts, ends = common.word_hashes(raw, False, self.lone)
        keys, first, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        new = at == len(self.keys)
        new[~new] = self.keys[at[~new]] != keys[~new]
        if len(self.keys) + new.sum() > KEEP_WORDS:
            self._forget()
            new[:] = True
        if new.any():
            ids = self.learn([raw[a:b].tobytes() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            size = np.array([len(x) // 2 for x in ids])
            order = np.argsort(np.concatenate([self.keys, keys[new]]), kind="stable")
            self.keys = np.concatenate([self.keys, keys[new]])[order]
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])[order]
            self.size = np.concatenate([self.size, size])[order]
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u2")])
            at = np.searchsorted(self.keys, keys)
        begin, size = self.begin[at][which], self.size[at][which]
        word_ends = np.append(starts[1:], len(raw)) if len(starts) else starts
        lone = (ends < word_ends) & (ends < len(raw))
        lone[lone] = ~common._IS_SPACE[raw[ends[lone]]]
        each = size + lone
        stop, before = np.cumsum(each), np.cumsum(size) - size
        out = np.empty(int(each.sum()), "<u2")
        nth = np.arange(int(size.sum()))
        out[np.repeat(stop - each - before, size) + nth] = self.flat[np.repeat(begin - before, size) + nth]
        out[stop[lone] - 1] = self.of_mark[raw[ends[lone]]]
        edges = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in texts]))
        edges = np.append(0, stop)[edges].tolist() if len(stop) else [0] * len(texts)
        return [out[a:b].tobytes() for a, b in zip([0, *edges], edges, strict=False)]


@lru_cache(2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


_ROLL = np.random.default_rng(41).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)


def all_cuts(streams: list[bytes]) -> list[list[int]]:
    """Where the chunks of each stream of 16-bit ids end.

    The hash runs over the streams joined, but no chunk ends within LEAST ids of a stream's begin, so that a window
    at which one may end never reaches back into another stream.
    """
    sizes = np.array([len(x) // 2 for x in streams])
    h = _ROLL[np.frombuffer(b"".join(streams), "<u2")]
    span = 1
    while span < WINDOW and len(h) > span:  # h[i] becomes the rolling hash of the ids from i - WINDOW + 1 to i
        more = h.copy()
        more[span:] += h[:-span] * np.uint32(pow(0x9E3779B1, span, 1 << 32))
        h, span = more, span * 2
    begin = np.cumsum(sizes) - sizes
    marks = np.flatnonzero((h >> np.uint32(7)) % np.uint32(MEAN) == 0) + 1
    edges = np.searchsorted(marks, np.append(begin, sizes.sum()), side="right").tolist()
    marks = marks.tolist()
    out = []
    for first, last, base, n in zip(edges, edges[1:], begin.tolist(), sizes.tolist(), strict=False):
        ends, at = [], 0
        for end in marks[first:last]:
            end -= base
            if end - at < LEAST:
                continue
            while end - at > MOST:
                at += MOST
                ends.append(at)
            if end > at:
                ends.append(end)
                at = end
        while n - at > MOST:
            at += MOST
            ends.append(at)
        if n > at:
            ends.append(n)
        out.append(ends)
    return out


def cuts(ids: np.ndarray) -> list[int]:
    return all_cuts([ids.astype("<u2").tobytes()])[0]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over leaves; an odd last node goes up as it is; no leaves: the digest of nothing."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        leaves = [digest(b"\1" + a + b) for a, b in zip(leaves[::2], leaves[1::2], strict=False)] + ([leaves[-1]] if len(leaves) % 2 else [])
    return leaves[0]


_RECORD = "kind int, key binary, doc_id bigint, n_tokens bigint, sizes binary, root binary, data binary"


def _records(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """A recipe of each document (kind 0; data: its chunks' digests) and each chunk once for every task (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sent, end = _encoder(path).encode, set(), np.array([end_id], "<u2").tobytes()
        row, task = 0, TaskContext.get().partitionId()  # rows of a task have keys of their own, also once it is run again
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [x.as_buffer() for x in batch.column(1)]
            sizes = np.cumsum([x.size for x in texts]) >> 21
            for part in np.unique(sizes).tolist():
                out: list[tuple] = []
                at = np.flatnonzero(sizes == part).tolist()
                streams = [x + end for x in encode([texts[i].to_pybytes() for i in at])]
                for i, stream, stops in zip(at, streams, all_cuts(streams), strict=True):
                    digests, lengths, begin = [], [], 0
                    for stop in stops:
                        data = stream[2 * begin : 2 * stop]
                        key = digest(data)
                        if key not in sent:
                            if len(sent) >= KEEP_DIGESTS:
                                sent.clear()
                            sent.add(key)
                            out.append((1, key, None, None, None, None, data))
                        digests.append(key)
                        lengths.append(stop - begin)
                        begin = stop
                    row += 1
                    key = digest(b"%d %d %r" % (task, row, ids[i]) + digests[0])
                    out.append((0, key, ids[i], len(stream) // 2, np.array(lengths, "<u4").tobytes(), merkle(digests), b"".join(digests)))
                kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["kind", "key", "doc_id", "n_tokens", "sizes", "root", "data"])

    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).mapInArrow(run, _RECORD)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the first of each key; the rows are in the order of key."""
    last = b""
    for batch in batches:
        keys = [last, *batch.column(1).to_pylist()]
        last = keys[-1]
        yield batch.filter(pa.array([a != b for a, b in zip(keys, keys[1:], strict=False)], pa.bool_()))


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode docs (doc_id, text) and write a store to path, a folder that all executors share.

    A null text is an empty one. Every document gets end_id at its end, so none is empty. Documents of equal
    doc_id, and those without one, which come first, are ordered by their ids' digests. Other columns are ignored.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    zstd = {"compression": "zstd"}
    _records(docs, tokenizer, end_id).repartition("key").sortWithinPartitions("key").mapInArrow(_once, _RECORD).write.partitionBy("kind").options(**zstd).parquet(f"{path}/raw")
    raw = spark.read.schema(_RECORD).parquet(f"{path}/raw")
    order = ["doc_id", "root"]
    rows = raw.where("kind = 0").select("doc_id", "n_tokens", "sizes", "root", F.col("data").alias("digests"))
    rows = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "recipes")
    each = rows.groupBy("part").agg(F.sum("n_tokens").alias("ids"), F.count("*").alias("n_docs"))
    before = each.withColumn("first", F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).select("part", "first")
    w = Window.partitionBy("part").orderBy("at")
    rows = rows.join(F.broadcast(before), "part").withColumn("start", F.col("first") + F.sum("n_tokens").over(w) - F.col("n_tokens"))
    rows.select("doc_id", "start", "n_tokens", "digests", "sizes", "root", "part").sortWithinPartitions("part", "start").write.options(**zstd).parquet(f"{path}/recipes")
    _parts(spark.read.parquet(f"{path}/recipes")).write.options(**zstd).parquet(f"{path}/manifest")


def _parts(recipes: DataFrame) -> DataFrame:
    """(part, start, n_docs, n_tokens, root) of each part of the recipes: the rows of the manifest."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root = [merkle([y[i : i + DIGEST] for i in range(0, len(y), DIGEST)]) for y in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(root, pa.binary())], names=["part", "start", "n_docs", "n_tokens", "root"])

    listed = recipes.groupBy("part").agg(F.min("start").alias("start"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("start", "root"))).alias("r"))
    listed = listed.select("part", "start", "n_docs", "n_tokens", F.unhex(F.array_join(F.transform("r", lambda x: F.hex(x["root"])), "")).alias("r"))
    return listed.mapInArrow(roots, "part int, start bigint, n_docs bigint, n_tokens bigint, root binary")


def verify(spark: SparkSession, path: str) -> None:
    """Hold the recipes against the manifest: raises if a part's documents, ids, start or Merkle root are others, or the parts do not follow each other."""
    manifest = spark.read.parquet(f"{path}/manifest")
    found = _parts(spark.read.parquet(f"{path}/recipes")).toDF("part", "start1", "n_docs1", "n_tokens1", "root1")
    same = " and ".join(f"{c} <=> {c}1" for c in ("start", "n_docs", "n_tokens", "root"))
    bad = manifest.join(found, "part", "full").where(f"not ({same})").select("part").take(1)
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bad = bad or manifest.withColumn("before", F.coalesce(before, F.lit(0))).where("start <> before").select("part").take(1)
    if bad:
        raise ValueError(f"the recipes of part {bad[0].part} do not have the root, counts and start that the manifest names")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_RECORD).parquet(f"{path}/raw").where("kind = 1").select(F.col("key").alias("digest"), "data")


def _uses(spark: SparkSession, path: str) -> DataFrame:
    """(start, at, digest, size, after): the chunks of each document; after: ids of the document behind the chunk.

    A recipe whose Merkle root isn't that of its digests raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, digests, sizes, root = (batch.column(i).to_pylist() for i in range(4))
            out: list[tuple] = []
            for s, d, z, r in zip(start, digests, sizes, root, strict=True):
                leaves = [d[i : i + DIGEST] for i in range(0, len(d), DIGEST)]
                if merkle(leaves) != r:
                    raise ValueError(f"the recipe at {s} does not have the root that it names")
                n = np.frombuffer(z, "<u4").astype(np.int64)
                after = n.sum() - np.cumsum(n)
                out += zip([s] * len(leaves), range(len(leaves)), leaves, n.tolist(), after.tolist(), strict=True)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            cols = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["start", "at", "digest", "size", "after"])

    return spark.read.parquet(f"{path}/recipes").select("start", "digests", "sizes", "root").mapInArrow(run, "start bigint, at bigint, digest binary, size bigint, after bigint")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the documents, put together from chunks; ids: little-endian 16-bit."""
    uses = _uses(spark, path).join(_chunks(spark, path), "digest")
    whole = uses.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("at", F.hex("data").alias("h")))).alias("c")).select("start", F.unhex(F.array_join(F.transform("c", lambda x: x["h"]), "")).alias("ids"))
    return spark.read.parquet(f"{path}/recipes").select("doc_id", "start", "n_tokens").join(whole, "start").select("doc_id", "start", "n_tokens", "ids")


@lru_cache(1)
def _shift_tables() -> list[np.ndarray]:
    """For k = 0, 1, ...: four tables by byte that move a crc32 over 2**k zero bytes."""
    one = np.array([(1 << i) for i in range(32)], np.uint64)
    images = np.array([zlib.crc32(b"\0", int(x)) ^ zlib.crc32(b"\0", 0) for x in one], np.uint32)
    out = []
    for _ in range(44):
        tables = np.zeros((4, 256), np.uint32)
        for b in range(4):
            for i in range(8):
                tables[b, (np.arange(256) >> i & 1).astype(bool)] ^= images[8 * b + i]
        out.append(tables)
        images = _apply(tables, images)
    return out


def _apply(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    return t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each crc32 adds, by exclusive or, to that of its string with n_bytes more behind it."""
    crc, n_bytes, k = crc.astype(np.uint32), n_bytes.copy(), 0
    while n_bytes.any():
        odd = (n_bytes & 1).astype(bool)
        crc[odd] = _apply(_shift_tables()[k], crc[odd])
        n_bytes >>= 1
        k += 1
    return crc


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Read a store back: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers).

    The recipes are held against the manifest. Each chunk is read where it lies, held against its digest, and its crc32
    taken; documents are put together from these by their recipes, whose roots are checked too. What doesn't fit raises.
    """
    common.small_batches(spark)
    verify(spark, path)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, n = [], []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest(data) != key:
                    raise ValueError("a chunk does not have the digest that it is stored under")
                crc.append(zlib.crc32(np.frombuffer(data, "<u2").astype("<u4").tobytes()))
                n.append(len(data) // 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64()), pa.array(n, pa.int64())], names=["digest", "crc", "n"])

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = crc_shift(batch.column(1).to_numpy(), batch.column(2).to_numpy() * 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc.astype(np.int64)), batch.column(3)], names=["start", "crc", "size"])

    stored = _chunks(spark, path).mapInArrow(sums, "digest binary, crc bigint, n bigint")
    uses = _uses(spark, path).join(stored, "digest", "left")
    uses = uses.select("start", F.coalesce("crc", F.raise_error("a chunk is missing").cast("bigint")).alias("crc"), "after", F.when(F.col("n") == F.col("size"), F.col("size")).otherwise(F.raise_error("a chunk has another length than its recipe says").cast("bigint")).alias("size"))
    whole = uses.mapInArrow(moved, "start bigint, crc bigint, size bigint").groupBy("start").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("size").alias("read"))
    recipes = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", "n_tokens")
    return recipes.join(whole, "start").select("doc_id", "start", F.col("read").alias("n_tokens"), "ids_crc32")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path = shared_dir(spark, "token-store")
    write_store(common.documents(spark, sf_dir), path, P.path("word_bpe_49k.json"))
    return digests(spark, path)


QUERIES = {"op4_token_store": op4_token_store}
ORACLES: dict[str, str] = {}
