"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

1. Each text becomes its set of word shingles, a signature from two permutations of which one is circularly
   shifted, and band keys. Texts of equal sets are one from here on.
2. In each band bucket the member that meets most others over all its bands is the hub; hub and member are
   compared on their full sets. Links give components.
3. Where a bucket still holds several components, members of different components may yet be linked without
   the hub. Rather than comparing all of them, such sets are joined on the rare shingles that any linked
   pair must share (prefix and position filters, which lose nothing), and those pairs are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finspan.llm import common
from finspan.llm.common import written
from finspan.llm.graph import components
from finspan.llm.sketch import band_keys, set_key, shingles, signature


def sketches(docs: DataFrame, words: int, coordinates: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, bands = [], [], [], []
            for x in batch.column(1):
                h = shingles(x.as_buffer() or b"", words)
                n.append(len(h))
                a, b = set_key(h)
                s1.append(a)
                s2.append(b)
                bands.append(band_keys(signature(h, coordinates), rows) if len(h) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "s1", "s2", "bands"]
            )

    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).mapInArrow(run, "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, items): the sorted shingle hashes as 64-bit little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x.as_buffer(), words).tobytes() for x in batch.column(1)], pa.binary())], names=["doc_id", "items"])

    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).mapInArrow(run, "doc_id bigint, items binary")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b; a written table) with 100 * intersection >= percent * union; a is the one with more partners.

    Of the set of an a with very many partners so many copies are made that each meets a bounded share of them.
    """
    left, right = sets.withColumnsRenamed({"doc_id": "a", "items": "x"}), sets.withColumnsRenamed({"doc_id": "b", "items": "y"})
    both = common.salted_join(pairs, left, "a", "b").join(right, "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common_n = len(p) + len(q) - len(np.union1d(p, q))
                ok.append(100 * common_n >= percent * (len(p) + len(q) - common_n))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5, coordinates: int = 80, rows: int = 4) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Null and empty texts, and those without a word, have no shingles and no links. Rows of equal doc_id stay
    as they are, each with its doc_id's component. A row without doc_id links with nothing: its component is
    null and it is kept. Other columns are ignored.
    """
    common.small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sk = written(sketches(own, words, coordinates, rows), "sketches")
    full = sk.where("doc_id is not null and n_shingles > 0")
    same = full.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    copies = written(full.select("doc_id", "s1", "s2", "n_shingles").join(same, ["s1", "s2", "n_shingles"]).select("doc_id", "rep", "n_shingles").distinct(), "copies")
    reps = copies.where("doc_id = rep").groupBy("rep").agg(F.max("n_shingles").alias("n"))
    member = full.join(reps, full.doc_id == reps.rep, "left_semi").select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
    sizes = member.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    member = written(member.join(sizes, "key").join(reps, "rep"), "members")
    met = member.groupBy("rep").agg(F.sum("size").alias("met"))
    member_met = member.join(met, "rep")
    hub = member_met.groupBy("key").agg(F.max(F.struct("met", (-F.col("rep")).alias("rep"), "n")).alias("h")).select("key", (-F.col("h.rep")).alias("a"), F.col("h.n").alias("na"))
    fit = "100 * least(na, nb) >= {0} * greatest(na, nb)".format(percent)
    star = member.select("key", F.col("rep").alias("b"), F.col("n").alias("nb")).join(hub, "key").where("a <> b").where(fit).select("a", "b").distinct()
    pairs = written(star, "pairs")
    texts = own.where("doc_id is not null")

    def sets_of(ids: DataFrame) -> DataFrame:
        ids = written(ids.toDF("doc_id"), "ids")
        if ids.count() <= common.BROADCAST_IDS:  # else the texts are shuffled
            ids = F.broadcast(ids)
        return written(_sets(texts.join(ids, "doc_id", "left_semi"), words).dropDuplicates(["doc_id"]), "sets")

    sets = sets_of(pairs.select("a").union(pairs.select("b")).distinct())
    links = written(_linked(pairs, sets, percent), "links")
    found = components(links)

    # what hubs could not join
    of = member.where("size > 2").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_keys = of.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("key")
    open_reps = written(of.join(open_keys, "key", "left_semi").select("rep", "n", "component").distinct(), "open")
    more_sets = sets_of(open_reps.select("rep"))
    item = _exploded(more_sets).join(open_reps, F.col("doc_id") == F.col("rep")).select("rep", "n", "component", "item")
    often = item.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    ranked = item.join(often, "item", "left").withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy(F.coalesce("df", F.lit(1)), "item")))
    prefix = ranked.where(f"df > 1 and at <= n - ceil({percent} * n / 100) + 1").select("rep", "n", "component", "item", (F.col("at") - 1).alias("at"))
    prefix = written(prefix, "prefixes")
    p, q = prefix.alias("p"), prefix.alias("q")
    need = F.ceil(F.lit(percent) * (F.col("p.n") + F.col("q.n")) / F.lit(100 + percent) - F.lit(1e-9))
    cross = (
        p.join(
            q,
            (F.col("p.item") == F.col("q.item"))
            & (F.col("p.rep") < F.col("q.rep"))
            & (F.col("p.component") != F.col("q.component"))
            & (100 * F.least("p.n", "q.n") >= percent * F.greatest("p.n", "q.n"))
            & (F.least(F.col("p.n") - F.col("p.at"), F.col("q.n") - F.col("q.at")) >= need),
        )
        .select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b"))
        .distinct()
    )
    more = _linked(written(cross, "cross"), more_sets, percent)
    all_links = links.union(more).union(found)
    found = components(all_links)

    label = copies.join(found, copies.rep == found.node, "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    # components are of representatives, which are the smallest of their copies, so the smallest is that of all
    return sk.select("doc_id", "n_shingles").join(label.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs without the rows that near_duplicates does not keep, and with one row of each doc_id; columns are kept."""
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    kept = near_duplicates(docs, percent).where("kept").select("doc_id").distinct()
    ids = rows.select("__row", F.col("doc_id").cast("bigint").alias("doc_id"))
    first = ids.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("__row").alias("__row")).select("__row")
    return common.by_row(rows, first.union(ids.where("doc_id is null").select("__row")), "left_semi")


def _exploded(sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
            sizes = np.array([len(x) for x in sets])
            parts = np.cumsum(sizes) // 1_000_000
            for part in np.unique(parts):
                i = np.flatnonzero(parts == part)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i], sizes[i])), pa.array(np.concatenate([sets[j] for j in i]))], names=["doc_id", "item"])

    return sets.mapInArrow(run, "doc_id bigint, item bigint")


def op10_minhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))


QUERIES = {"op10_minhash_near": op10_minhash_near}
ORACLES: dict[str, str] = {}
