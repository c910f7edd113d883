"""Line de-duplication by pairwise alignment.

Lines are compared by the hash of what stands between leading and trailing ASCII white space. Seeds are the shortest
runs of lines with at least BLOCK_BYTES bytes that begin or end at a line: of a block that can be deleted, every line is
in such a run, so that each is met at a document that has all of the run. A document is paired with the first holder (the
least doc_id) of each of its seeds, rare or not, so that a common one costs one pair for each document. The two are
aligned by patience diff; runs of aligned lines of at least BLOCK_BYTES bytes are deleted from the later one. Seeds of
which lines are left (as the holder has them in another order, or more than once) are then paired with their other earlier
holders, in rounds that grow, until no line is left or no earlier holder untried. For seeds of more than MANY documents that
would take pairs by the square; of these, what the first holder leaves is aligned by itself, a run with the first holder's
same run, and deleted as well. All pairs are aligned on the input.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finspan.llm import common
from finspan.llm.common import written

#: SEED_BYTES is the earlier rule's, which a test still names; seeds have BLOCK_BYTES.
SEED_BYTES, BLOCK_BYTES = 20, 40
#: A seed of more documents than this is paired with its first holder only; what is left of it is aligned by itself.
MANY = 100
_SPACES = common.SPACES


def line_keys(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and length of each \\n-split line without the white space at its ends; a blank line has the key 0."""
    lines = [x.strip(_SPACES) for x in text.split(b"\n")]
    return np.array([xxhash.xxh3_64_intdigest(x) if x else 0 for x in lines], np.uint64).astype(np.int64), np.array([len(x) for x in lines], np.int32)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of equal items, ascending in both.

    Equal items at both ends are aligned; between them, items that occur once in both are aligned along their longest
    ascending run, and the gaps are aligned likewise.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        once: dict[int, int] = {}
        for k in range(i, m):
            once[a[k]] = -1 if a[k] in once else k
        other: dict[int, int] = {}
        for k in range(j, n):
            if once.get(b[k], -1) >= 0:
                other[b[k]] = -1 if b[k] in other else k
        both = sorted((once[x], k) for x, k in other.items() if k >= 0)
        ends: list[int] = []
        at: list[int] = []
        before: list[int] = []
        for x, (_, k) in enumerate(both):
            p = bisect_left(ends, k)
            if p == len(ends):
                ends.append(k)
                at.append(x)
            else:
                ends[p], at[p] = k, x
            before.append(at[p - 1] if p else -1)
        run, x = [], at[-1] if at else -1
        while x >= 0:
            run.append(both[x])
            x = before[x]
        for p, q in reversed(run):
            todo.append((i, p, j, q))
            out.append((p, q))
            i, j = p + 1, q + 1
        if run:
            todo.append((i, m, j, n))
    return sorted(out)


def removed(later: np.ndarray, sizes: np.ndarray, earlier: np.ndarray, block_bytes: int = BLOCK_BYTES) -> list[int]:
    """Lines of the later document in aligned blocks of at least block_bytes bytes; blank lines at a block's ends stay."""
    out: list[int] = []
    run: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(later.tolist(), earlier.tolist()), (len(later) + 9, -9)]:
        if (i - 1, j - 1) != last:
            if sizes[run].sum() >= block_bytes:
                full = [k for k, x in enumerate(run) if sizes[x]]
                out += run[full[0] : full[-1] + 1]
            run = []
        run.append(i)
        last = i, j
    return out


def runs(keys: np.ndarray, sizes: np.ndarray, block_bytes: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first line and end of the shortest runs of at least block_bytes bytes that begin or end at a line that is not blank."""
    n = len(keys)
    upto = np.zeros(n + 1, np.int64)
    np.cumsum(sizes, out=upto[1:])
    full = np.flatnonzero(sizes)
    end = np.searchsorted(upto, upto[full] + block_bytes)
    begin = np.searchsorted(upto, upto[full + 1] - block_bytes, side="right") - 1
    ahead, behind = end <= n, begin >= 0
    first, last = np.concatenate([full[ahead], begin[behind]]), np.concatenate([end[ahead], full[behind] + 1])
    first, last = np.divmod(np.unique(first * (n + 1) + last), n + 1)
    up, down = common._powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(keys.astype(np.uint64) * down[:-1], out=total[1:])
    return common.mix64((total[last] - total[first]) * up[first] ^ (last - first).astype(np.uint64)).astype(np.int64), first, last


def left_runs(keys: np.ndarray, sizes: np.ndarray, gone: list[int]) -> np.ndarray:
    """Hashes of the runs that have a line, not blank, which is not gone."""
    here = sizes > 0
    here[gone] = False
    left = np.zeros(len(keys) + 1, np.int64)
    np.cumsum(here, out=left[1:])
    h, first, last = runs(keys, sizes)
    return np.unique(h[left[last] > left[first]])


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, lines, sizes, mark: a hash of the lines) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = [line_keys(x.as_buffer().to_pybytes()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.tobytes() for a, _ in k], pa.binary()), pa.array([b.tobytes() for _, b in k], pa.binary()), pa.array([_mark(a) for a, _ in k], pa.binary())], names=["id", "lines", "sizes", "mark"])

    return docs.mapInArrow(run, "id bigint, lines binary, sizes binary, mark binary")


def _mark(keys: np.ndarray) -> bytes:
    return hashlib.blake2b(keys.tobytes(), digest_size=8).digest()


def _numbers(column: pa.Array, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _seeds(keyed: DataFrame) -> DataFrame:
    """(id, line) of the runs of each document, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.unique(runs(k, n)[0]) for k, n in zip(_numbers(batch.column(1), np.int64), _numbers(batch.column(2), np.int32), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(k) for k in keys])), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))], names=["id", "line"])

    return keyed.select("id", "lines", "sizes").mapInArrow(run, "id bigint, line bigint")


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, mark, lines, sizes, earlier) -> (id, mark, at): lines of the later document to delete."""
    for batch in batches:
        found = [removed(k, n, e) for k, n, e in zip(_numbers(batch.column(2), np.int64), _numbers(batch.column(3), np.int32), _numbers(batch.column(4), np.int64), strict=True)]
        row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array([i for x in found for i in x], pa.int32())], names=["id", "mark", "at"])


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, lines, sizes, at) -> (id, line): seeds of which a line is left."""
    for batch in batches:
        found = [left_runs(k, n, at or []) for k, n, at in zip(_numbers(batch.column(1), np.int64), _numbers(batch.column(2), np.int32), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in found])), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], names=["id", "line"])


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, mark, lines, sizes, seeds) -> (id, mark, at): the lines of the runs that have these hashes."""
    for batch in batches:
        found = []
        for k, n, seeds in zip(_numbers(batch.column(2), np.int64), _numbers(batch.column(3), np.int32), batch.column(4), strict=True):
            h, first, last = runs(k, n)
            here = np.isin(h, seeds.values.to_numpy())
            found.append(np.unique(np.concatenate([np.arange(a, b) for a, b in zip(first[here], last[here], strict=True)] or [np.zeros(0, np.int64)])))
        row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(found).astype(np.int32))], names=["id", "mark", "at"])


def delete_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with text rewritten, and the column `removed_lines` (their count, long).

    Rows with a null or empty text or without doc_id stay as they are and are never paired. Rows of equal doc_id are not
    compared with each other; a row is compared with one text for each other doc_id, of several the one with the least line keys.
    A document may end up with an empty text. Columns and rows are else kept; a column `removed_lines` is replaced.
    Texts are read to make line keys, and once more to be rewritten; what is joined is keys, pairs and places of lines.
    """
    common.small_batches(docs.sparkSession)
    own = docs.where("doc_id is not null and text <> ''").select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").cast("binary"))
    keyed = written(_keyed(own), "keyed")
    seeds = written(_seeds(keyed), "seeds")
    total = seeds.count()
    held = written(seeds.groupBy("line").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("line", "first", "n"), "held")

    def met(rows: DataFrame, held: DataFrame) -> DataFrame:
        """rows (id, line) with what held has for the line; lines of many rows are joined by broadcast."""
        hot = F.col("n") > common.HOT_SHARE * total
        some = F.broadcast(held.where(hot))
        return rows.join(some.select("line"), "line", "left_anti").join(held.where(~hot), "line").select("id", "line", "first", "n").union(rows.join(some, "line").select("id", "line", "first", "n"))

    shared = written(met(seeds, held), "shared")
    pairs = written(shared.where("id > first").select("id", "first").distinct(), "pairs")
    in_shared = keyed.join(shared.select("id").distinct(), "id", "left_semi")
    later = written(in_shared.dropDuplicates(["id", "mark"]), "later")
    one = written(later.groupBy("id").agg(F.min("lines").alias("earlier")).withColumnRenamed("id", "first"), "one")

    def aligned(pairs: DataFrame) -> DataFrame:
        with_earlier = common.salted_join(pairs, one, "first", "id").select("id", "earlier")
        return with_earlier.join(later, "id").select("id", "mark", "lines", "sizes", "earlier").mapInArrow(_align, "id bigint, mark binary, at int")

    def open_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
        at = gone.groupBy("id", "mark").agg(F.collect_set("at").alias("at"))
        rows = docs.join(at, ["id", "mark"], "left").select("id", "lines", "sizes", "at").mapInArrow(_left, "id bigint, line bigint")
        return written(met(rows, held).where("id > first").select("id", "line", "n").distinct(), "open")

    gone, tried = written(aligned(pairs), "gone"), pairs
    rows = open_rows(later, gone)
    # the holders of seeds that are left, of those that few documents have
    holders = met(shared.select("id", "line"), rows.where(F.col("n") <= MANY).groupBy("line").agg(F.lit(0).cast("bigint").alias("first"), F.max("n").alias("n"))).select("line", F.col("id").alias("holder")).distinct()
    holders = written(holders.withColumn("nth", F.row_number().over(Window.partitionBy("line").orderBy("holder"))), "holders")
    begin, end = 1, 3
    while begin <= MANY:
        some = holders.where((F.col("nth") >= begin) & (F.col("nth") < end))
        pairs = rows.where(F.col("n") <= MANY).join(some, "line").where("holder < id").select("id", F.col("holder").alias("first")).distinct()
        pairs = written(pairs.join(tried, ["id", "first"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            gone, tried = gone.union(written(aligned(pairs), "gone")), tried.union(pairs)
            rows = open_rows(later.join(rows.select("id").distinct(), "id", "left_semi"), gone)
        begin, end = end, 4 * end
    # those that many have are aligned by themselves with the first holder's
    alone = rows.where(F.col("n") > MANY).groupBy("id").agg(F.collect_set("line").alias("seeds"))
    gone = gone.union(written(later.join(alone, "id").select("id", "mark", "lines", "sizes", "seeds").mapInArrow(_alone, "id bigint, mark binary, at int"), "gone"))
    gone = gone.groupBy("id", "mark").agg(F.collect_set("at").alias("gone"))
    gone = gone.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.hex("mark").alias("k"), F.col("gone").alias("v")))).alias("__gone"))
    names = [c for c in docs.columns if c != "removed_lines"]
    key = F.coalesce(docs.doc_id.cast("bigint"), F.xxhash64(docs.text))  # so that rows without doc_id don't meet
    # always by a shuffle of the texts: a broadcast on small tables alone would make disk grow faster than the input
    full = docs.select(*names).join(gone.hint("merge"), (key == gone.id) & docs.doc_id.isNotNull(), "left").select(*names, "__gone")
    at_text, at_gone = names.index("text"), len(names)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, changed = batch.column(at_text), np.zeros(batch.num_rows, np.int64), {}
            for i, marks in enumerate(batch.column(at_gone)):
                x = texts[i].as_py() if marks.is_valid else None
                drop = set(dict(marks.as_py()).get(_mark(line_keys(x.encode())[0]).hex().upper(), ())) if x else None
                if drop:
                    changed[i] = "\n".join(s for k, s in enumerate(x.split("\n")) if k not in drop)
                    counts[i] = len(drop)
            if changed:
                texts = pa.array([changed[i] if i in changed else x.as_py() for i, x in enumerate(texts)], pa.string())
            cols = [texts if i == at_text else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts)], names=[*names, "removed_lines"])

    schema = docs.select(*names).withColumn("removed_lines", F.lit(0).cast("bigint")).schema
    return full.mapInArrow(rewrite, schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars (left), removed_lines and the sha256 of the text that is left; a null text has a null one."""
    out = delete_repeated_lines(common.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "removed_lines", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLES: dict[str, str] = {}
