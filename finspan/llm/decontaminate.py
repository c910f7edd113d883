"""Benchmark decontamination by spaced seeds.

Tokens are lower-cased runs of letters and digits. A seed is the hash of the tokens at the positions that a fixed mask
selects, so that it does not notice substitutions at the others. Items of fewer tokens than the longest mask spans have seeds
of their own: with k substitutions allowed, of every (k + 1)th token, from each of the first k + 1 on; k substitutions leave one
of these whole. Seeds of all benchmark items are joined with those of
all documents' positions; a hit names a diagonal, along which the item's and the document's tokens are compared: a
document is contaminated if some SPAN tokens in a row of the item (all, of a shorter one) agree with it in at least
PERCENT of 100. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finspan.llm import common
from finspan.llm.common import written

#: Offsets that the masks select; every mask has the same number of them.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 7, 8), (0, 2, 3, 5, 6, 10), (0, 1, 5, 6, 8, 11))
SPAN, PERCENT = 20, 80
#: Largest table of seeds that is broadcast, in rows; with more, the documents' seeds are shuffled.
BROADCAST_SEEDS = 2_000_000


def tokens(text: Column) -> Column:
    """64-bit hashes of the tokens; none of a null text."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda x: F.xxhash64(x))


def _seeds(h: Column, at: Column) -> Column:
    """The seeds that begin at a position: one for each mask that fits, the mask's number among what is hashed."""
    found = [F.when((at >= 0) & (at + mask[-1] < F.size(h)), F.xxhash64(F.lit(m), *(F.get(h, at + i) for i in mask))) for m, mask in enumerate(MASKS)]
    return F.array(*found)


def _may_differ(n: int) -> int:
    """Tokens of n that may differ."""
    return n * (100 - PERCENT) // 100


def _short(h: Column, n: int, at: Column) -> list[Column]:
    """Seeds of n tokens from a position on, which may stand over the ends of a document by as many tokens as may differ."""
    step = _may_differ(n) + 1
    masks = [range(r, n, step) for r in range(step)]
    return [F.when((at + m[0] >= 0) & (at + m[-1] < F.size(h)), F.xxhash64(F.lit(-n), F.lit(r), *(F.get(h, at + i) for i in m))) for r, m in enumerate(masks)]


def _exploded(df: DataFrame, lengths: list[int], whole: bool) -> DataFrame:
    """A row for each seed of each position (at); whole: only texts of just so many tokens have the short seeds, once."""
    over = 0 if whole else max(map(_may_differ, lengths), default=0)
    df = df.where(F.size("h") > 0).withColumn("at", F.explode(F.sequence(F.lit(-over), F.size("h") - 1)))
    h, at = F.col("h"), F.col("at")
    seeds = _seeds(h, at)
    if lengths:
        own = lambda n, x: F.when((F.size(h) == n) & (at == 0), x) if whole else x
        seeds = F.concat(seeds, F.array(*(own(n, x) for n in lengths for x in _short(h, n, at))))
    return df.withColumn("seed", F.explode(seeds)).where("seed is not null")


def agrees(item: Column, h: Column, shift: Column) -> Column:
    """Whether some window of the item agrees enough with the document's tokens on the diagonal: item position plus shift.

    The comparison is bound to a lambda's variable, as the optimizer would else repeat it for each window.
    """
    first = F.greatest(F.lit(0), -shift)
    width = F.least(F.lit(SPAN), F.size(item))
    n = F.least(F.size(item) - first, F.size(h) - first - shift)
    same = F.zip_with(F.slice(item, first + 1, n), F.slice(h, first + shift + 1, n), lambda a, b: (a == b).cast("int"))
    padded = F.concat(F.array_repeat(F.lit(0), first), same, F.array_repeat(F.lit(0), F.size(item) - first - n))
    window = lambda s: F.transform(F.sequence(F.lit(1), F.size(s) - width + 1), lambda i: F.aggregate(F.slice(s, i, width), F.lit(0), lambda a, x: a + x))
    return F.get(F.transform(F.array(padded), lambda s: F.array_max(window(s))), F.lit(0)) * 100 >= PERCENT * width


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, item_id): distinct pairs of documents (row, text) and benchmark items (item_id, text) that overlap.

    Null and empty texts have no tokens and match nothing. Items of one text all match; rows without item_id are ignored.
    The hits are first brought down to distinct diagonals, which then meet the tokens of their documents again. The plan
    of docs must give the same rows when it is run again.
    """
    items = written(benchmark.where("item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), tokens(F.col("text")).alias("item")).where(F.size("item") > 0).distinct(), "items")
    least = max(m[-1] for m in MASKS) + 1
    lengths = sorted(r[0] for r in items.select(F.size("item")).where(F.size("item") < least).distinct().collect())  # fewer than the longest mask spans
    seeds = written(_exploded(items.withColumnRenamed("item", "h"), lengths, whole=True).select("seed", "item_id", F.col("at").alias("item_at")).distinct(), "seeds")
    small = seeds.count() <= BROADCAST_SEEDS
    positions = _exploded(docs.select("row", tokens(F.col("text")).alias("h")), lengths, whole=False).select("row", "at", "seed")
    hits = positions.join(F.broadcast(seeds) if small else seeds, "seed")
    diagonals = written(hits.select("row", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "diagonals")
    few = diagonals.count() <= common.BROADCAST_IDS
    hit = diagonals.select("row").distinct()
    again = docs.join(F.broadcast(hit) if few else hit, "row", "left_semi").select("row", tokens(F.col("text")).alias("h"))
    again = again.join(F.broadcast(diagonals) if few else diagonals, "row").join(F.broadcast(items) if small else items, "item_id")
    return again.where(agrees(F.col("item"), F.col("h"), F.col("shift"))).select("row", "item_id").distinct()


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without those that overlap with the benchmark, with their columns."""
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    bad = matches(rows.select(F.col("__row").alias("row"), "text"), benchmark).select(F.col("row").alias("__row"))
    return common.by_row(rows, bad.distinct(), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, contaminated, kept (its opposite), items (ids of the benchmark items found in it, ascending)."""
    docs = common.documents(spark, sf_dir).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found = matches(docs.select("row", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    found = written(found.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items")), "found")
    bad = F.col("items").isNotNull()
    return docs.select("row", "doc_id").join(found, "row", "left").select("doc_id", bad.alias("contaminated"), (~bad).alias("kept"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLES: dict[str, str] = {}
