"""Packing of tokenised documents into sequences of a fixed length, by best fit in bulk-synchronous rounds.

Pieces of over half a sequence open one each. In a round, the rest and the gaps of open sequences are range-sorted together by
size, largest first. Each range is swept: a piece takes the smallest gap that holds it, its successor. Pieces that find none in their
range go on to the gaps that larger ranges have left, nearest first: the ranges' counts, swept in order, say which ranks of a range's
pieces meet which ranks of another's gaps, so that no two want the same place. Each round begins with as many new sequences, as gaps of
full length, as what is left needs at least. Gaps are brought up to date after it; what is left in the end fits one range, which is
swept to its end.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finspan.llm import common
from finspan.llm.common import written

#: Tokens of a sequence; the id that ends a document.
CAPACITY, END = 2048, 0
#: Rows of a range at most; so few rows make one range, with which the rounds end.
RANGE_ROWS, LAST_ROWS = 500_000, 50_000
MARKS = ".,;:!?"
#: Bytes of parts and ids that a Python worker keeps; on more, it forgets those that were rare of late. Characters of a slice of a long text, and
#: of short texts that are encoded together.
KEEP_BYTES, SLICE, TOGETHER = 160 << 20, 1 << 20, 8 << 20

_GAP = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Encodes texts as the tokenizers library would with a byte-level vocabulary; ids come as little-endian 32-bit bytes. Strings of special
    tokens are ordinary text.

    A byte-level tokenizer always begins a new match at a single space or line end between other characters. Texts are cut there, many at once,
    and each distinct part is looked up: the first of a text, and further ones with their space or line end. New ones are encoded together and told
    apart by their bytes; a mark behind a letter is a match of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        #: Bytes of each token: a byte-level token has a character for each.
        self.widths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())])
        self.marks = {m: np.array(self.tokenizer.encode(m, add_special_tokens=False).ids, "<u4").tobytes() for m in MARKS}
        #: Ids of parts that had a space, or begin with a line end, of late, and of the time before.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.size = 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, part: str, ids: bytes) -> None:
        self.known[part] = ids
        self.size += 2 * len(part) + len(ids) + 150

    def _further(self, parts: list[str]) -> list[bytes]:
        """Ids of parts with a space before them, or a line end as their first character, and no other white space at their ends."""
        if self.size > KEEP_BYTES // 2:
            self.before, self.known, self.size = self.known, {}, 0
        known, before = self.known, self.before
        new, marked = set(), []
        for x in parts:
            if x not in known:
                ids = before.get(x)
                if ids is not None:
                    self._keep(x, ids)
                    continue
                core = x[:-1]
                if x[-1] in MARKS and core[-1:].isalpha() and core[-1] < "\u0250":
                    marked.append(x)
                    if core in known:
                        continue
                    if core in before:
                        self._keep(core, before[core])
                        continue
                    x = core
                new.add(x)
        joined = list(new)
        for i in range(0, len(joined), 20_000):
            some = [x if x[0] == "\n" else " " + x for x in joined[i : i + 20_000]]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends, wanted = np.cumsum(self.widths[ids]), np.cumsum([len(x.encode()) for x in some])
            at = np.searchsorted(ends, wanted)
            if not np.array_equal(ends[at], wanted):
                raise ValueError("a token reaches over a space")
            raw, at = ids.tobytes(), (4 * at + 4).tolist()
            for part, a, b in zip(joined[i : i + 20_000], [0, *at], at):
                self._keep(part, raw[a:b])
        for x in marked:
            self._keep(x, known[x[:-1]] + self.marks[x[-1]])
        return list(map(known.__getitem__, parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " \n"), " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes, parts = coded.indices.to_numpy().copy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        bare = np.array([(y := x.removeprefix("\n")) != "" and y.strip() == y for x in parts])
        apart = np.flatnonzero(np.logical_or.reduceat(~bare[codes], ends[:-1]))  # texts with white space beside a space or line end
        first = {}
        codes[ends[:-1]] = [len(parts) + first.setdefault(parts[c], len(first)) for c in codes[ends[:-1]].tolist()]
        usual = np.flatnonzero(bare)
        found: list[bytes] = [b""] * len(parts)
        for i, ids in zip(usual.tolist(), self._further([parts[i] for i in usual.tolist()]), strict=True):
            found[i] = ids
        found += self._whole(list(first))
        size = np.array([len(x) // 4 for x in found])
        begin, pool = np.cumsum(size) - size, np.frombuffer(b"".join(found), "<u4")
        each = size[codes]
        stop = np.cumsum(each)
        ids = pool[np.repeat((begin[codes] - stop + each).astype(np.int32), each) + np.arange(stop[-1], dtype=np.int32)].tobytes()
        edges = (4 * np.concatenate([[0], stop])[ends]).tolist()
        out = [ids[a:b] for a, b in zip(edges, edges[1:])]
        for i in apart.tolist():
            out[i] = self._cut(texts[i])
        return out

    def _cut(self, text: str) -> bytes:
        """A text with white space beside a space, cut at other spaces only."""
        first, *parts = _GAP.split(text)
        if not parts:
            return self._whole([first])[0]
        *parts, last = parts  # white space may stand at the end of the last
        return b"".join([self._whole([first])[0], *self._further(parts), *self._whole([" " + last])])


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """A long text in slices that can be encoded apart."""
    at = 0
    while len(text) - at > size and (cut := _GAP.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else whole ones behind a first that may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((i, capacity) for i in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Per piece of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids; a null text is empty, each text is followed by the end id."""
    common.small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()

    def batches_of(rows: list[tuple], ids: list[bytes], doc_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(columns[0], doc_type), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(ids, pa.binary())] if with_ids else arrays, names=[*names, "ids"] if with_ids else names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, kept, doc_type = [], [], pa.null()

        def documents() -> Iterator[tuple]:
            nonlocal doc_type
            for batch in batches:
                doc_type = batch.schema.field(0).type
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

        for doc_id, ids in _encoded(encoder(path), documents()):
            ids += last
            for k, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                part = ids[4 * start : 4 * (start + length)]
                rows.append((doc_id, k, start, length, zlib.crc32(part)))
                kept.append(part if with_ids else b"")
            if len(rows) > 10_000:
                yield batches_of(rows, kept, doc_type)
                rows, kept = [], []
        if rows:
            yield batches_of(rows, kept, doc_type)

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, schema)


def _encoded(e: Encoder, documents: Iterator[tuple]) -> Iterator[tuple]:
    """(doc_id, ids) of each (doc_id, text); short texts are encoded together, long ones in slices."""
    held: list[tuple] = []
    size = 0

    def done() -> Iterator[tuple]:
        yield from zip([x for x, _ in held], e.encode([x for _, x in held]), strict=True)

    for doc_id, text in documents:
        if len(text) > SLICE:
            yield from done()
            held, size = [], 0
            yield doc_id, b"".join(x for part in slices(text) for x in e.encode([part]))
            continue
        held.append((doc_id, text))
        size += len(text)
        if size > TOGETHER:
            yield from done()
            held, size = [], 0
    yield from done()


class _Gaps:
    """Gaps by size."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.of: dict[int, list[np.ndarray]] = {}

    def push(self, size: int, seqs: np.ndarray) -> None:
        if len(seqs):
            if size not in self.of:
                insort(self.sizes, size)
                self.of[size] = []
            self.of[size].append(seqs)

    def successor(self, size: int) -> int | None:
        """The least size not under size that there are gaps of."""
        i = bisect_left(self.sizes, size)
        return self.sizes[i] if i < len(self.sizes) else None

    def pop(self, size: int, n: int) -> np.ndarray:
        """n gaps of the size, or all if there are fewer."""
        of = self.of[size]
        found, have = [], 0
        while of and have < n:
            x = of.pop()
            if have + len(x) > n:
                of.append(x[n - have :])
                x = x[: n - have]
            found.append(x)
            have += len(x)
        if not of:
            del self.of[size]
            del self.sizes[bisect_left(self.sizes, size)]
        return np.concatenate(found)


def sweep(lengths: np.ndarray, uids: np.ndarray, frees: np.ndarray, seqs: np.ndarray, opened: int | None = None, capacity: int = CAPACITY) -> tuple[np.ndarray, _Gaps]:
    """The sequence of each piece, 0 where there is none, and the gaps afterwards; pieces of one length come together.

    From the longest on, each piece takes the smallest gap that holds it. With opened (sequences opened so far), pieces without a gap open new
    sequences -opened - 1, -opened - 2, ...
    """
    gaps = _Gaps()
    for size in np.unique(frees):
        gaps.push(int(size), seqs[frees == size])
    out = np.zeros(len(uids), np.int64)
    order = np.argsort(-lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order])) + 1
    for todo in np.split(order, edges) if len(order) else []:
        length = int(lengths[todo[0]])
        while len(todo):
            size = gaps.successor(length)
            if size is None and opened is None:
                break
            each = (capacity if size is None else size) // length
            n = -(-len(todo) // each)
            if size is None:
                size, into = capacity, -np.arange(opened + 1, opened + n + 1)
                opened += n
            else:
                into = gaps.pop(size, n)
            some, todo = todo[: each * len(into)], todo[each * len(into) :]
            out[some] = np.repeat(into, each)[: len(some)]
            over = len(some) - each * (len(into) - 1)  # in the last of them
            gaps.push(size - each * length, into[:-1])
            gaps.push(size - over * length, into[-1:])
    return out, gaps


def _swept(opened: int | None, capacity: int):
    """Rows kind (0 gap, 1 piece), id, size, sorted, to the same with a piece's sequence (seq), the range, and the rank of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not found:
            return
        kind, ids, size = (np.concatenate(c) for c in zip(*found, strict=True))
        least, doc = size.min(), kind == 1
        uids, lengths = ids[doc], size[doc]
        into, gaps = sweep(lengths, uids, size[~doc], ids[~doc], opened, capacity)
        here = TaskContext.get().partitionId()

        def batch(kind: int, ids: np.ndarray, size: np.ndarray, seq: np.ndarray | None, rank: np.ndarray | None) -> pa.RecordBatch:
            n = len(ids)
            none = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, kind, np.int32)), pa.array(ids), pa.array(size), none if seq is None else pa.array(seq), pa.array(np.full(n, here, np.int32)), none if rank is None else pa.array(rank)],
                names=["kind", "id", "size", "seq", "range", "rank"],
            )

        placed = into != 0
        yield batch(1, uids[placed], lengths[placed], into[placed], None)
        order = np.argsort(-lengths[~placed], kind="stable")
        yield batch(1, uids[~placed][order], lengths[~placed][order], None, np.arange(len(order)))
        at = 0
        for s in gaps.sizes:
            seqs = np.concatenate(gaps.of[s])
            rank = None
            if s >= least:  # not smaller than any piece of later ranges
                rank = np.arange(at, at + len(seqs))
                at += len(seqs)
            yield batch(0, seqs, np.full(len(seqs), s, np.int64), None, rank)

    return run


def successors(stats: list[tuple[int, int, int, int, int]]) -> list[tuple]:
    """Which ranks of the pieces left in a range meet which ranks of the gaps left in a range of larger sizes.

    stats: range, pieces left, the longest, gaps left, the smallest, by range. Returns (range, first rank, end, pieces to a gap, range of the
    gaps, first rank of the gaps).
    """
    out, stack = [], []
    for here, n, longest, n_gaps, smallest in stats:
        at = 0
        while at < n and stack:
            other = stack[-1]  # range, next rank, number of gaps, the smallest
            each = other[3] // longest
            places = min(other[2] - other[1], -(-(n - at) // each))
            end = min(n, at + places * each)
            out.append((here, at, end, each, other[0], other[1]))
            other[1] += places
            at = end
            if other[1] == other[2]:
                stack.pop()
        if n_gaps:
            stack.append([here, 0, n_gaps, smallest])
    return out


def least_new(sizes: list[tuple[int, int, int]], capacity: int) -> int:
    """How many new sequences any packing of the pieces needs at least, besides the gaps; sizes: kind (0 gap, 1 piece), size, number.

    Pieces of a size and more need room, by their tokens and by how many of them a place can hold, that gaps of that size and more don't have.
    """
    gaps, parts = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
    for kind, size, n in sizes:
        (parts if kind else gaps)[size] += n
    each, most = np.arange(capacity + 1), 0
    for size in np.flatnonzero(parts).tolist():
        tokens = int((parts[size:] * each[size:]).sum() - (gaps[size:] * each[size:]).sum())
        number = int(parts[size:].sum() - (gaps[size:] * (each[size:] // size)).sum())
        most = max(most, -(-tokens // capacity), -(-number // (capacity // size)))
    return most


_POOL = "kind int, id bigint, size bigint"


def _range_stats(swept: DataFrame) -> list[tuple]:
    piece, gap = "kind = 1 and seq is null", "kind = 0 and rank is not null"

    def of(f, where: str, c: str):
        return F.coalesce(f(F.when(F.expr(where), F.col(c))), F.lit(0))

    rows = swept.groupBy("range").agg(of(F.count, piece, "id"), of(F.max, piece, "size"), of(F.count, gap, "id"), of(F.min, gap, "size"))
    return sorted(tuple(r) for r in rows.collect())  # one row for each range


def assigned(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(uid, seq): a sequence for each of items (uid, length); uids are distinct and positive, lengths from 1 to capacity."""
    spark = items.sparkSession
    large = items.where(F.col("length") > capacity // 2)
    gaps = large.where(F.col("length") < capacity).select(F.lit(0).alias("kind"), F.col("uid").alias("id"), (capacity - F.col("length")).alias("size"))
    small = items.where(F.col("length") <= capacity // 2).select(F.lit(1).alias("kind"), F.col("uid").alias("id"), F.col("length").alias("size"))
    pool, opened, rounds = written(gaps.union(small), "packing-pool"), 0, []
    while True:
        sizes = [tuple(r) for r in pool.groupBy("kind", "size").count().collect()]  # two rows for each size
        shortest = min((size for kind, size, _ in sizes if kind), default=0)
        if not shortest:
            break
        sizes = [x for x in sizes if x[1] >= shortest]
        new = least_new(sizes, capacity)
        fresh = spark.range(opened + 1, opened + new + 1).select(F.lit(0).alias("kind"), (-F.col("id")).alias("id"), F.lit(capacity).cast("bigint").alias("size"))
        useful = pool.where(F.col("size") >= shortest).unionByName(fresh)
        opened += new
        rows, order = new + sum(x[2] for x in sizes), [F.desc("size"), F.asc("kind"), F.asc("id")]
        last = rows <= LAST_ROWS
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))
        dealt = useful.repartition(1) if last else useful.repartitionByRange(ranges, *order)
        swept = dealt.sortWithinPartitions(*order).mapInArrow(_swept(opened if last else None, capacity), f"{_POOL}, seq bigint, range int, rank bigint")
        swept = written(swept, "packing-swept")
        left, free = swept.where("kind = 1 and seq is null").select("id", "size", "range", "rank"), swept.where("kind = 0")
        rounds.append(swept.where("seq is not null").select(F.col("id").alias("uid"), "seq"))
        if last:
            break
        links = spark.createDataFrame(successors(_range_stats(swept)), "range int, first bigint, end bigint, each bigint, other int, place bigint")
        links = F.broadcast(links)  # a row or two for each range
        meets = (left["range"] == links["range"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
        met = left.join(links, meets).select("id", "size", "other", (F.col("place") + F.expr("(rank - first) div each")).alias("place"))
        places = free.where("rank is not null").select(F.col("range").alias("other"), F.col("rank").alias("place"), F.col("id").alias("seq"))
        found = written(met.join(places, ["other", "place"]).select("id", "size", "seq"), "packing-found")
        rounds.append(found.select(F.col("id").alias("uid"), "seq"))
        used = found.groupBy(F.col("seq").alias("id")).agg(F.sum("size").alias("used"))
        gaps = free.join(used, "id", "left").select("kind", "id", (F.col("size") - F.coalesce("used", F.lit(0))).alias("size"))
        rest = left.join(found.select("id"), "id", "left_anti").select(F.lit(1).alias("kind"), "id", "size")
        pool = written(gaps.where("size > 0").unionByName(rest), "packing-pool")
    out = large.select("uid", F.col("uid").alias("seq"))
    for x in rounds:
        out = out.unionByName(x)
    return out


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    docs: doc_id, text; other columns are ignored. A null or empty text has its end id alone. Rows with one doc_id, or none, and repeated rows are
    packed each for itself. Documents of up to `capacity` ids stay whole. No documents, no rows.
    """
    parts = written(pieces(docs, path, capacity, end, with_ids).withColumn("uid", F.monotonically_increasing_id() + 1), "packing-pieces")
    seqs = written(assigned(parts.select("uid", "length"), capacity), "packing-sequences")
    whole = parts.where(F.col("length") == capacity).withColumn("sequence_id", F.col("uid")).withColumn("offset", F.lit(0).cast("bigint"))
    rest = parts.where(F.col("length") < capacity).join(seqs.withColumnRenamed("seq", "sequence_id"), "uid")
    before = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint"))
    return rest.unionByName(whole).drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids (little-endian unsigned 32-bit) of each sequence of pack_documents(..., with_ids=True)."""
    in_order = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # of capacity ids at most
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.concat_ws("", F.transform(in_order, lambda x: F.hex(x["ids"]))).alias("h")).select("sequence_id", "n_tokens", F.unhex("h").alias("ids"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens; see pack_documents() for edges."""
    import public_tokenizers as P

    return pack_documents(common.documents(spark, sf_dir), P.path("byte_bpe_50k.json"))


QUERIES = {"op13_best_fit_packing": op13_best_fit_packing}
ORACLES: dict[str, str] = {}
