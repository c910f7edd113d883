"""Exact substring de-duplication with blockwise suffix sorting over a difference cover.

A string of WIDTH bytes that starts in two places is removed wherever it stands. All suffixes of a corpus cannot
meet in one place, so they are first dealt by content: every window of WIDTH bytes is owned by the least
hash among its K-byte substrings (its anchor). Equal windows have equal anchors at equal offsets, so windows
need be compared only where an anchor's bytes occur at least twice. Neighbouring windows with one anchor make a
run; a run of n windows is n + WIDTH - 1 bytes of text.

- Runs of equal bytes: all their windows are repeated.
- Runs of one anchor but different bytes are sorted: the runs' bytes are laid out so that anchors fall on
  multiples of the cover's period; ranks of the suffixes at the cover's positions are computed by doubling;
  then the suffixes of the windows are sorted one bucket of leading bytes at a time, by their first 32 bytes and, where
  these tie, by the rank of the cover position that follows. Neighbours are compared on WIDTH bytes.
- Anchors with very many runs are dealt again, by windows' place to the anchor and the bytes that a
  few such windows share, so that no task gets all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finspan.llm import common
from finspan.llm.common import _BYTE, _powers, mix64, written

WIDTH, K = 200, 64
#: Period and offsets of the difference cover: every difference modulo the period is one of two offsets.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: An anchor with more runs than this is dealt again, by so many neighbouring windows.
HOT, SLICE = 10_000, 8
#: Bytes that are sorted together, at least (to the end of an anchor), and suffixes in a bucket, about.
SORT_BYTES, BUCKET = 2 << 20, 1 << 17
#: Bytes that are broadcast at most, as ENTRY bytes for each row and each thing in it; with more, texts are shuffled.
BROADCAST_BYTES, ENTRY = 256 << 20, 64
_STEP = np.uint64(0xD1342543DE82EF95)


def runs_of(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows in texts that stand one behind the other up to ends: anchor hash, bytes' hash, start, windows, anchor."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < WIDTH:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    h, span, factor = _BYTE[raw], 1, int(_STEP)
    while span < K:
        h = h[: len(h) - span] * np.uint64(factor) + h[span:]
        span, factor = span * 2, factor * factor % (1 << 64)
    h = mix64(h)
    low = np.uint64((1 << 24) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    need, span = WIDTH - K + 1, 1
    while span * 2 <= need:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[: n - WIDTH + 1], least[need - span : need - span + n - WIDTH + 1])
    anchor = (least & low).astype(np.int64)
    start = np.arange(n - WIDTH + 1)
    text = np.searchsorted(ends, start, side="right")
    good = start + WIDTH <= ends[text]
    new = good.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~good[:-1]
    begin = np.flatnonzero(new)
    stop = np.flatnonzero(good & ~np.append(good[1:] & ~new[1:], False)) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * down[:-1], out=total[1:])
    size, at = stop - begin, anchor[begin]
    own = (total[stop + WIDTH - 1] - total[begin]) * up[begin]
    return h[at], mix64(own ^ (size * 1024 + at - begin).astype(np.uint64)), begin, size, at


_CHUNK = 1 << 20


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Texts joined to about a chunk of bytes; longer ones are cut into chunks that overlap by a window.

    Yields first and last text, bytes, ends, and the offset of the bytes in the (single, long) text.
    """
    i = 0
    while i < len(texts):
        if len(texts[i]) > _CHUNK:
            raw = np.frombuffer(texts[i], np.uint8)
            for a in range(0, len(raw) - WIDTH + 1, _CHUNK):
                part = raw[a : a + _CHUNK + WIDTH - 1]
                yield i, i + 1, part, np.array([len(part)]), a
            i += 1
            continue
        j, total = i, 0
        while j < len(texts) and len(texts[j]) <= _CHUNK and total <= _CHUNK:
            total += len(texts[j])
            j += 1
        yield i, j, np.frombuffer(b"".join(texts[i:j]), np.uint8), np.cumsum([len(x) for x in texts[i:j]]), 0
        i = j


def _all_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column(0).to_numpy()
        texts = [x.as_buffer() for x in batch.column(1)]
        long = [i for i, x in enumerate(texts) if x.size >= WIDTH]
        rows, data = rows[long], [texts[i].to_pybytes() for i in long]
        for i, j, raw, ends, offset in _chunks(data):
            key, own, begin, size, at = runs_of(raw, ends)
            text = np.searchsorted(ends, begin, side="right")
            base = np.concatenate([[0], ends[:-1]])[text] - offset
            cols = [key.astype(np.int64), own.astype(np.int64), rows[i:j][text], begin - base, size.astype(np.int32), (at - begin).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "own", "row", "start", "size", "to_anchor"])


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, asked) -> the bytes of the runs asked for, hot ones in slices; a few MB at a time."""
    out: list[tuple] = []
    size_out = 0
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def full() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "own", "row", "start", "size", "to_anchor", "data"])

    for batch in batches:
        for row, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            raw = text.as_buffer()
            for r in zip(*(asked.values.field(c).to_pylist() for c in ("key", "own", "start", "size", "to_anchor", "hot")), strict=True):
                for x in _of_run(raw, row, *r):
                    out.append(x)
                    size_out += len(x[-1])
                    if size_out >= common.BATCH_BYTES:
                        yield full()
                        out.clear()
                        size_out = 0
    if out:
        yield full()


def _of_run(raw: pa.Buffer, row: int, key: int, own: int, start: int, size: int, to_anchor: int, hot: bool) -> Iterator[tuple]:
    if not hot:
        yield key, own, row, start, size, to_anchor, raw.slice(start, size + WIDTH - 1).to_pybytes()
        return
    a = 0
    while a < size:  # slices end where the distance to the anchor is a multiple of SLICE
        b = min(size, a + (to_anchor - a) % SLICE + 1)
        data = raw.slice(start + a, b - a + WIDTH - 1).to_pybytes()
        group = (to_anchor - a) // SLICE
        first = group * SLICE + SLICE - 1 - (to_anchor - a)  # windows of the slice missing at its front
        core = data[SLICE - 1 - first : WIDTH - first]
        yield _hash(b"%d %d" % (key, group), core), _hash(b"%d " % (to_anchor - a), data), row, start + a, b - a, to_anchor - a, data
        a = b


@lru_cache(1)
def _to_cover() -> np.ndarray:
    """For each residue, how far on the next position of the cover is."""
    return np.array([next(d for d in range(PERIOD) if (i + d) % PERIOD in COVER) for i in range(PERIOD)])


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 of rows by keys, the first the most significant; equal rows have equal ranks."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


def repeated(data: list[bytes], to_anchor: list[int], times: list[int]) -> list[np.ndarray]:
    """For each run's bytes, which of its windows occur more than once among all of them; times: copies of each run."""
    place, at = [], 0
    for x, a in zip(data, to_anchor, strict=True):
        at += -(at + a) % PERIOD
        place.append(at)
        at += len(x)
    text = np.zeros(at + 8 * PERIOD + 16, np.uint8)
    for p, x in zip(place, data, strict=True):
        text[p : p + len(x)] = np.frombuffer(x, np.uint8)
    word = text.astype(np.uint64)
    for shift in (1, 2, 4):
        word[:-shift] = (word[:-shift] << np.uint64(8 * shift)) | word[shift:]
    sample = np.flatnonzero(np.isin(np.arange(at) % PERIOD, COVER))
    rank = np.zeros(len(text) + 8 * PERIOD, np.int64)
    if len(sample):
        rank[sample] = _dense(word[sample], word[sample + 8], word[sample + 16], word[sample + PERIOD - 8])
        depth = PERIOD
        while depth < WIDTH:
            if rank[sample].max() == len(sample):
                break  # all differ already
            rank[sample] = _dense(rank[sample], rank[sample + depth])
            depth *= 2
    sizes = np.array([len(x) - WIDTH + 1 for x in data])
    owner = np.repeat(np.arange(len(data)), sizes)
    pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.array(place)[owner]
    weight = np.array(times)[owner]
    flag = np.zeros(len(pos), bool)
    lead = (word[pos] >> np.uint64(48)).astype(np.int64)
    by_lead = np.argsort(lead, kind="stable")
    edges = np.append(np.flatnonzero(np.diff(lead[by_lead], prepend=-1)), len(pos))
    a = 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + BUCKET, side="right")) - 1)
        block = by_lead[edges[a] : edges[b]]
        p = pos[block]
        cover = rank[p + _to_cover()[p % PERIOD]]
        order = np.lexsort((cover, p % PERIOD, word[p + 24], word[p + 16], word[p + 8], word[p]))
        p, block = p[order], block[order]
        same = p[1:] % PERIOD == p[:-1] % PERIOD
        for i in range(0, WIDTH, 8):
            j = np.flatnonzero(same)
            same[j] = word[p[j + 1] + i] == word[p[j] + i]
        group = np.cumsum(~np.append(False, same))
        total = np.bincount(group, weight[block])
        flag[block] = total[group] > 1
        a = b
    return np.split(flag, np.cumsum(sizes)[:-1])


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, own, to_anchor, times, data) in the order of key -> (key, own, first, last): stretches of repeated windows."""
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        flags = repeated([x[4] for x in held], [x[2] for x in held], [x[3] for x in held])
        out: list[tuple] = []
        for x, f in zip(held, flags, strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], f.view(np.int8), [0]])))
            out += [(x[0], x[1], a, b - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        cols = zip(*out, strict=True) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["key", "own", "first", "last"])

    for batch in batches:
        for x in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if size >= SORT_BYTES and held[-1][0] != x[0]:
                yield flush()
                held, size = [], 0
            held.append(x)
            size += len(x[4])
    if held:
        yield flush()


def _small(df: DataFrame, things: Column) -> DataFrame:
    """df to be broadcast if it is small; things: how many things of up to ENTRY bytes a row holds."""
    size = df.agg(F.sum((things + 1) * ENTRY)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _join_hot(rows: DataFrame, found: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """rows joined with found (one row for each keys; n: how many of the total rows have them) on keys, without n.

    Keys with more than HOT_SHARE of the rows, of which there can be but its inverse, are broadcast; the others are shuffled.
    """
    frequent = F.col(n) > common.HOT_SHARE * total
    hot, cold = F.broadcast(found.where(frequent).drop(n)), found.where(~frequent).drop(n)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(row, spans) for the rows (row, text as binary) with repeated bytes; spans: start and end pairs as 64-bit integers, ascending, apart.

    row must be distinct. The plan of rows must give the same rows when it is run again.
    """
    common.small_batches(rows.sparkSession)
    runs = written(rows.mapInArrow(_all_runs, "key bigint, own bigint, row bigint, start bigint, size int, to_anchor int"), "runs")
    twice = runs.groupBy("key").agg(F.count("*").alias("n"), F.min("own").alias("a"), F.max("own").alias("b")).where("n > 1").select("key", "n", F.expr("a <> b").alias("mixed"), (F.expr("a <> b") & (F.col("n") > HOT)).alias("hot"))
    total = runs.count()
    some = written(_join_hot(runs, written(twice, "repeated-keys"), ["key"], "n", total), "candidates")
    equal = written(some.groupBy("key", "own").agg(F.count("*").alias("same"), F.min(F.struct("row", "start", "size", "to_anchor")).alias("r"), F.first("mixed").alias("mixed"), F.first("hot").alias("hot")), "equal")
    full = _join_hot(some, equal.where("same > 1").select("key", "own", "same"), ["key", "own"], "same", total).select("row", F.col("start").alias("a"), (F.col("start") + F.col("size") + (WIDTH - 1)).alias("b"))
    ask = "struct(key, own, start, size, to_anchor, hot) as r"
    asked = equal.where("mixed and not hot").selectExpr("r.row as row", "struct(key, own, r.start as start, r.size as size, r.to_anchor as to_anchor, hot) as r")
    asked = asked.union(some.where("hot").selectExpr("row", ask)).groupBy("row").agg(F.collect_list("r").alias("asked"))
    asked = written(asked, "asked")
    kept = "key bigint, own bigint, row bigint, start bigint, size int, to_anchor int"
    slices = written(rows.join(_small(asked, F.size("asked")), "row").select("row", "text", "asked").mapInArrow(_slices, f"{kept}, data binary"), "slices")
    each = slices.groupBy("key", "own").agg(F.first("to_anchor").alias("to_anchor"), F.count("*").alias("times"), F.first("data").alias("data"))
    found = each.repartition("key").sortWithinPartitions("key").select("key", "own", "to_anchor", "times", "data").mapInArrow(_sorted_runs, "key bigint, own bigint, first int, last int")
    part = slices.select("key", "own", "row", "start").join(found, ["key", "own"]).select("row", (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + WIDTH).alias("b"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in batch.column(1):
                x = np.sort(np.array([(r["a"], r["b"]) for r in s.as_py()], dtype=[("a", "<i8"), ("b", "<i8")]))
                reach = np.maximum.accumulate(x["b"])
                new = np.append(True, x["a"][1:] > reach[:-1])
                out.append(np.column_stack([x["a"][new], reach[np.append(new[1:], True)]]).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["row", "spans"])

    return full.union(part).groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("s")).mapInArrow(merged, "row bigint, spans binary")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes left).

    A null text is an empty one. Rows, repeated ones too, stay one for one (equal texts of WIDTH bytes or more are removed whole);
    doc_id may be null; other columns are ignored. What is left need not be valid UTF-8.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    spans = written(repeated_spans(rows.select("row", "text")), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, gone, n = [], [], []
            for text, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = np.frombuffer(s or b"", "<i8").reshape(-1, 2).tolist()
                if x:
                    edges = [0, *(v for pair in x for v in pair), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                else:
                    kept = text
                left.append(kept)
                gone.append(len(text) - len(kept))
                n.append(len(x))
            size = [len(k) + g for k, g in zip(left, gone, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (size, gone, n)), pa.array(left, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    full = rows.join(_small(spans, F.length("spans") / 16), "row", "left").select("doc_id", "text", "spans")
    return full.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
ORACLES: dict[str, str] = {}
