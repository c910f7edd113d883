"""Phrase collocations by suffix sorting.

Every word starts a suffix of its piece of text, cut to the most words that a phrase has. Equal suffixes are added up where they
arise, then shuffled by language and first word: into ranges of (language, suffix), so that a frequent first word is split
further on. Sorted in reverse, each suffix comes before its prefixes, and one stack counts all prefixes in one pass. Only those at
a range's two ends can go on in the next range; they alone are added up once more. A phrase's parts are joined to it afterwards.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finspan.llm import common
from finspan.llm.common import written

#: Most words of a phrase, least occurrences of one, percent of a phrase's occurrences from which a longer one covers it, phrases of a language.
MAX_WORDS, LEAST, COVERED, TOP = 4, 30, 80, 2000
SCALE = 2_000_000
#: Distinct suffixes, and bytes of all, that a task adds up before it sends them on.
KEEP_SUFFIXES, KEEP_BYTES = 400_000, 256 << 20
#: For the ranges' bounds, about so many suffixes of so many documents are looked at for each range. They change where ranges end, and no result.
BOUND_ROWS, BOUND_DOCS, BOUND_BYTES = 60, 6, 64
#: Sorted rows that are counted at one time.
STEP_ROWS = 100_000

#: Letters lower-cased; what ends a piece becomes \n, what ends a word a space.
_PLAIN = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_ESCAPED = re.compile(b"\1([\1\2])")


def _text(docs: DataFrame) -> DataFrame:
    """lang, und where it is null, and the text's bytes."""
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def _escaped(words: bytes) -> bytes:
    return words.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1") if b"\0" in words or b"\1" in words else words


def _plain(words: bytes) -> bytes:
    return _ESCAPED.sub(lambda m: b"\0" if m[1] == b"\1" else b"\1", words) if b"\1" in words else words


def suffixes(lang: str, text: bytes, most: int = MAX_WORDS) -> Iterator[bytes]:
    """The suffix at each word, of so many words at most, behind its language, joined by zero bytes; those inside words are escaped."""
    head = _escaped(lang.encode())
    join = b"\0".join
    for piece in _escaped(text.translate(_PLAIN)).split(b"\n"):
        words = piece.split()
        n = len(words)
        if n >= most:
            yield from map(join, zip(repeat(head), *(words[i:] for i in range(most)), strict=False))
        for i in range(max(n - most + 1, 0), n):
            yield join([head, *words[i:]])


def _added_up(bounds: list[bytes], most: int):
    """Suffixes with their numbers and the range that they fall into. They go as strings, which Spark compares in place, unlike binaries."""

    def sent(counts: Counter) -> Iterator[pa.RecordBatch]:
        keys, numbers = list(counts), list(counts.values())
        for i in range(0, len(keys), 50_000):
            some = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([bisect_left(bounds, x) for x in some], pa.int32()), pa.array(some, pa.binary()).view(pa.string()), pa.array(numbers[i : i + 50_000], pa.int64())], names=["range", "suffix", "n"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rest = suffixes(lang, text, most)
                while some := list(islice(rest, 50_000)):
                    counts.update(some)
                    size += sum(map(len, some))
                    if size > KEEP_BYTES or len(counts) > KEEP_SUFFIXES:
                        yield from sent(counts)
                        counts, size = Counter(), 0
        yield from sent(counts)

    return run


def _bounds(text: DataFrame, ranges: int, most: int) -> list[bytes]:
    """Where ranges of about equal numbers of distinct suffixes end, from a sample of documents."""
    documents = max(text.count(), 1)
    sample = text.sample(fraction=min(1.0, (BOUND_DOCS * ranges + 100) / documents), seed=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[bytes] = set()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update(x[:BOUND_BYTES] for i, x in enumerate(suffixes(lang, text, most)) if not i % 16)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary())], names=["suffix"])

    few = sample.mapInArrow(run, "suffix binary").distinct().orderBy(F.xxhash64("suffix")).limit(BOUND_ROWS * ranges)
    rows = sorted(bytes(r[0]) for r in few.collect())  # BOUND_ROWS short rows for each range
    return sorted({rows[i * len(rows) // ranges] for i in range(1, ranges)}) if rows else []


class _Stack:
    """Counts of all prefixes of sorted suffixes: one number for each prefix of the last suffix that is still open.

    A prefix's count is whole unless its run of suffixes meets the range's first or last row. A language alone is a prefix of no words.
    """

    def __init__(self, width: int, least: int):
        self.width, self.least, self.last = width, least, None
        self.sums, self.first = np.zeros(width, np.int64), np.ones(width, bool)

    def _row(self, suffix: bytes, k: int, n: int, partial: bool) -> tuple:
        lang, *words = suffix.split(b"\0")[: k + 1]
        return _plain(lang), _plain(b" ".join(words)), k, n, partial

    def add(self, suffixes: pa.Array, n: np.ndarray) -> list[tuple]:
        """Go on with some rows; the rows lang, phrase, words, f, partial of prefixes that end among them."""
        if self.last is not None:
            suffixes, n = pa.concat_arrays([pa.array([self.last], pa.binary()), suffixes]), np.concatenate([[0], n])
        lists, m = pc.split_pattern(suffixes, b"\0"), len(n)
        sizes = lists.value_lengths().to_numpy()
        words = np.full((m, self.width), -1, np.int32)
        words[np.repeat(np.arange(m), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().dictionary_encode().indices.to_numpy()
        same = np.zeros((m, self.width), bool)
        same[1:] = np.logical_and.accumulate((words[1:] == words[:-1]) & (words[1:] >= 0), axis=1)
        total, out = np.concatenate([[0], np.cumsum(n)]), []
        for k in range(self.width):
            starts = np.flatnonzero(~same[:, k])
            sums = total[np.append(starts[1:], m)] - total[starts]
            partial = np.zeros(len(starts), bool)
            sums[0] += self.sums[k]
            partial[0] = self.first[k]
            ended = (words[starts, k] >= 0) & (partial | (sums >= (self.least if k else 0)))
            ended[-1] = False  # goes on with the rows to come
            out += [self._row(suffixes[int(starts[i])].as_py(), k, int(sums[i]), bool(partial[i]) or not k) for i in np.flatnonzero(ended)]
            there = words[-1, k] >= 0
            self.sums[k], self.first[k] = (sums[-1], partial[-1]) if there else (0, False)
        self.last = suffixes[m - 1].as_py()
        return out

    def end(self) -> list[tuple]:
        return [self._row(self.last, k, int(self.sums[k]), True) for k in range(self.last.count(b"\0") + 1)] if self.last is not None else []


def _prefixes(most: int, least: int):
    """Sorted suffixes and their numbers to the counts of their prefixes."""

    def counted(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        types = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "phrase", "words", "f", "partial"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, held, rows = _Stack(most + 1, least), [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= STEP_ROWS:
                yield counted(_go_on(stack, held))
                held, rows = [], 0
        if held:
            yield counted(_go_on(stack, held))
        yield counted(stack.end())

    return run


def _go_on(stack: _Stack, held: list[pa.RecordBatch]) -> list[tuple]:
    return stack.add(pa.concat_arrays([b.column(0).view(pa.binary()) for b in held]), np.concatenate([b.column(1).to_numpy() for b in held]))


def phrase_counts(docs: DataFrame, most: int = MAX_WORDS, least: int = LEAST) -> DataFrame:
    """lang, phrase, words, f of all phrases of 1 to `most` words that occur at least `least` times in a language; phrase '' has the number of all its words.

    docs: lang (null: und), text (null: empty). Pieces end at . , ; : ! ? and line ends, words at spaces and tabs; A-Z are lower-cased.
    """
    spark = docs.sparkSession
    common.small_batches(spark, rows=20_000)  # suffixes are short
    text = _text(docs)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = text.mapInArrow(_added_up(_bounds(text, ranges, most), most), "range int, suffix string, n bigint")
    rows = rows.repartitionById(ranges, "range").sortWithinPartitions(F.desc("suffix")).select("suffix", "n")
    counts = rows.mapInArrow(_prefixes(most, least), "lang binary, phrase binary, words int, f bigint, partial boolean")
    counts = counts.withColumn("lang", F.col("lang").cast("string")).withColumn("phrase", F.col("phrase").cast("string"))
    counts = written(counts, "phrases")
    ends = counts.where("partial").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))
    return counts.where("not partial").drop("partial").unionByName(ends)


def _exact(c: str):
    return F.col(c).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP, most: int = MAX_WORDS) -> DataFrame:
    """The best phrases of 2 to `most` words of each language: lang, rank, phrase, a, l, r, n, score.

    a counts the phrase, l and r its two parts at the cut with the lowest score floor(2000000 * a / (l + r)), of equal ones the first; n
    counts the language's words. Phrases whose words lie inside a longer one with at least `covered` percent of their occurrences are left
    out. Ties are ordered by a, then by the phrase's bytes. Documents without words, and empty tables, add nothing; repeated rows count
    as often as they occur; other columns are ignored.
    """
    freq = written(phrase_counts(docs, most, least), "frequent")
    totals = freq.where("words = 0").select("lang", F.col("f").alias("n"))
    parts = freq.where("words > 0").select("lang", "phrase", "f")
    found = freq.where("words > 1").withColumnRenamed("f", "a")
    cuts = found.select("lang", "phrase", "a", "words", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))
    cuts = cuts.join(parts.toDF("lang", "first", "l"), ["lang", "first"]).join(parts.toDF("lang", "rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("product", F.lit(SCALE).cast("decimal(7,0)") * _exact("a")).withColumn("both", _exact("l") + _exact("r"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("product div both").alias("score"), "k", "l", "r")).alias("cut"))
    spans = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), s -> array_join(slice(split(phrase, ' '), s, m), ' '))))")
    longer = found.where("words > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_exact("longer") * 100 < _exact("a") * covered))
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of all documents; see collocations() for edges."""
    return collocations(common.documents(spark, sf_dir))


QUERIES = {"op12_collocations": op12_collocations}
ORACLES = {
    "op12_collocations": r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
y AS (SELECT lang, w, i, unnest(range(1, 5)) AS k FROM s), c AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM y WHERE i + k - 1 <= len(w) GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY 1),
g AS (SELECT *, string_split(phrase, ' ') AS w FROM c WHERE k > 1 AND f >= 30),
u AS (SELECT lang, phrase, f, k, unnest(range(1, k)) AS j, w FROM g), v AS (SELECT lang, phrase, f, j, array_to_string(w[1:j], ' ') AS first, array_to_string(w[j + 1:], ' ') AS rest FROM u),
x AS (SELECT v.lang, v.phrase, v.f AS a, v.j, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * v.f) // (l.f + r.f) AS BIGINT) AS score FROM v
JOIN c l ON l.lang = v.lang AND l.phrase = v.first JOIN c r ON r.lang = v.lang AND r.phrase = v.rest),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS cut FROM x),
q AS (SELECT lang, w, k, f, unnest([1, 1, 2, 2, 3]) AS i, unnest([2, 3, 2, 3, 2]) AS m FROM g), o AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS f FROM q WHERE m < k AND i + m - 1 <= k GROUP BY 1, 2),
z AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE cut = 1 AND (o.f IS NULL OR 100 * o.f < 80 * a))
SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000"""
}
