"""Prefix trie over rebuilt conversations, family first.

Conversations of one base id form a family. A family's turns meet in one task, sorted, as digests; they are rebuilt and put into the
family's own small trie as they stream by. Only the trie's nodes are shuffled: a node's key is a chained SHA-256 (128 bits) of its
turns, so that equal prefixes of different families meet. What lies below a node that one family alone has is settled in that
family; only the nodes that several share take part in the sums over the whole trie, by pointer doubling.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finspan.llm import common
from finspan.llm.common import written

#: Conversations of a family: ids that differ in their last two digits only.
FAMILY = 100
#: The base gives fewer than so many of its first turns.
MOST_HEAD = 6
#: Nodes that a task holds at most; a family with more goes on in a new part, and the nodes of both are merged like those of two families.
PART_NODES = 100_000
_ROOT = bytes(16)
_NODES = (
    "key binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_chars bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, unsettled boolean, ends string, first_end bigint, ends_sha256 string"
)


def head_length(conv_id: int) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % MOST_HEAD


def _turns(conversations: DataFrame) -> DataFrame:
    """base, conv_id, turn, role, text with nulls made empty and rows without an id left out."""
    c = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return c.select((F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).alias("base"), "*")


class _Family:
    """The trie of one family's conversations, which come by ascending id, or of a part of them."""

    def __init__(self) -> None:
        self.nodes: dict[bytes, list] = {}  # key: parent, depth, conv_id, n_convs, n_chars, n_children, unsettled, ends

    def visit(self, parent: bytes | None, key: bytes, depth: int, conv_id: int, n_chars: int) -> None:
        node = self.nodes.get(key)
        if node is None:
            self.nodes[key] = [parent, depth, conv_id, 1, n_chars, 0, False, []]
            if parent in self.nodes:
                self.nodes[parent][5] += 1
        else:
            node[3] += 1

    def broken_off(self, key: bytes, conv_id: int) -> _Family:
        """A new part, in which the conversation that stands at key goes on; that node and those above it aren't settled here."""
        depth, n_chars, parent = self.nodes[key][1], self.nodes[key][4], self.nodes[key][0]
        above: bytes | None = key
        while above in self.nodes:
            self.nodes[above][6] = True
            above = self.nodes[above][0]
        more = _Family()
        more.nodes[key] = [parent, depth, conv_id, 0, n_chars, 0, True, []]
        return more

    def rows(self) -> Iterator[tuple]:
        """A row for each node, with the sums over what lies below it in this trie."""
        leaves, saved = dict.fromkeys(self.nodes, 0), dict.fromkeys(self.nodes, 0)
        for key, (parent, depth, conv_id, n, n_chars, children, unsettled, ends) in reversed(self.nodes.items()):
            leaves[key] += not children
            saved[key] += (n - 1) * n_chars
            over = self.nodes.get(parent)
            if over is not None:
                leaves[parent] += leaves[key]
                saved[parent] += saved[key]
            listed = ",".join(map(str, ends))
            yield key, parent, depth, conv_id, over and over[2], n, n_chars, children, leaves[key], saved[key], unsettled, listed, ends[0] if ends else None, sha256(listed.encode()).hexdigest()


def _tries(part_nodes: int):
    names = [x.split()[0] for x in _NODES.split(", ")]
    types = [{"binary": pa.binary(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[x.split()[1]] for x in _NODES.split(", ")]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        family, base, conv, head = _Family(), None, None, []
        at, depth, left, own = _ROOT, 0, 0, 0

        def ready(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal out
            while len(out) > least:
                some, out = out[:20_000], out[20_000:]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], schema=schema)

        def step(digest: bytes, n_chars: int) -> None:
            nonlocal family, at, depth, out
            if len(family.nodes) >= part_nodes:
                more = family.broken_off(at, conv)
                out += family.rows()
                family = more
            parent, depth = at, depth + 1
            at = sha256(parent + digest).digest()[:16]
            family.visit(parent, at, depth, conv, n_chars)

        for batch in batches:
            for b, c, digest, n_chars in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv:
                    if conv is not None:
                        family.nodes[at][7].append(conv)
                    if b != base:
                        out += family.rows()
                        family, base, head = _Family(), b, []
                        yield from ready(20_000)
                    conv, at, depth, own = c, _ROOT, 0, 0
                    family.visit(None, _ROOT, 0, c, 0)
                    left = 0 if c == b else head_length(c)  # the base's own first turns are its own in any case
                    for d, n in head[:left]:
                        step(d, n)
                own += 1
                if c == b and own < MOST_HEAD:
                    head.append((digest, n_chars))
                if own > left:
                    step(digest, n_chars)
                    if len(out) > 20_000:
                        yield from ready(20_000)
        if conv is not None:
            family.nodes[at][7].append(conv)
        out += family.rows()
        yield from ready(0)

    return run


def family_nodes(conversations: DataFrame, part_nodes: int = PART_NODES) -> DataFrame:
    """The nodes of each family's own trie. Texts leave the first stage as digests only."""
    common.small_batches(conversations.sparkSession)
    t = _turns(conversations)
    turn = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    t = t.select("base", "conv_id", "turn", "role", F.unhex(F.sha2(turn, 256)).alias("digest"), F.length("text").cast("bigint").alias("n_chars"))
    t = t.repartition("base").sortWithinPartitions("base", "conv_id", F.asc_nulls_first("turn"), "role", "digest")
    return t.select("base", "conv_id", "digest", "n_chars").mapInArrow(_tries(part_nodes), _NODES)


def _joined_ends(rows: DataFrame) -> DataFrame:
    """key, ends_sha256 over the ends of all rows of a key in the order of their ids, streamed: a digest can't be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            keys, hashes = [], []
            for key, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key == now:
                    digest.update(b"," + ends.encode())
                    continue
                if now is not None:
                    keys.append(now)
                    hashes.append(digest.hexdigest())
                now, digest = key, sha256(ends.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], names=["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    return rows.repartition("key").sortWithinPartitions("key", "first_end").select("key", "ends").mapInArrow(run, "key binary, ends_sha256 string")


def _subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """key and values summed over the subtree of each node of (key, parent, depth, values), by pointer doubling.

    After round k a node has the sums over what is less than 2^k below it and points 2^k up.
    """
    rounds = int(nodes.agg(F.max("depth")).first()[0] or 0).bit_length()
    now = nodes.select("key", F.col("parent").alias("up"), *values)
    for _ in range(rounds):
        more = now.where("up is not null").groupBy(F.col("up").alias("key")).agg(*(F.sum(v).alias(f"__{v}") for v in values))
        higher = now.where("up is not null").select(F.col("key").alias("up"), F.col("up").alias("__up"))
        sums = [(F.col(v) + F.coalesce(f"__{v}", F.lit(0))).alias(v) for v in values]
        now = written(now.join(more, "key", "left").join(higher, "up", "left").select("key", F.col("__up").alias("up"), *sums), "trie-sums")
    return now.drop("up")


def trie(conversations: DataFrame, part_nodes: int = PART_NODES) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: conv_id, turn, role, text; other columns are ignored. Turns are ordered by turn, null first, then by role and by
    the digest of role and text, so that turns of one number have a defined order; repeated rows are turns of their own. Rows without
    conv_id belong to no conversation. Null roles and texts are empty. The base of a negative id is the next lower multiple of 100.
    No conversations, no rows. Memory is bounded by part_nodes; the turns of one family, and the ends of one node, stream through one task.
    """
    nodes = written(family_nodes(conversations, part_nodes), "trie-families")
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    once = ["parent", "depth", "n_chars", "parent_conv_id", "ends_sha256"]
    merged = nodes.groupBy("key").agg(
        (F.max("unsettled") | (F.count("*") > 1)).alias("shared"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in sums), *(F.min(c).alias(c) for c in once)
    )
    merged = written(merged, "trie-merged")
    shared = merged.where("shared")
    parents = shared.select(F.col("key").alias("parent"), F.col("conv_id").alias("__conv"))
    linked = written(merged.join(parents, "parent", "left").withColumn("parent_conv_id", F.coalesce("__conv", "parent_conv_id")), "trie-linked")

    def below(c: str):
        return F.sum(F.when(F.col("shared"), 0).otherwise(F.col(c))).alias(f"__{c}")

    kids = linked.where("__conv is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("__n"), below("n_leaves"), below("saved_tokens"))
    top = linked.where("shared").join(kids, "key", "left").withColumn("n_children", F.coalesce("__n", F.lit(0)))
    top = top.withColumn("n_leaves", F.coalesce("__n_leaves", F.lit(0)) + (F.col("n_children") == 0).cast("bigint"))
    top = written(top.withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("n_chars") + F.coalesce("__saved_tokens", F.lit(0))), "trie-top")
    whole = _subtree_sums(top, ["n_leaves", "saved_tokens"])
    ends = _joined_ends(nodes.where("ends <> ''").join(shared.select("key"), "key", "left_semi"))
    top = top.drop("n_leaves", "saved_tokens", "ends_sha256").join(whole, "key").join(ends, "key", "left")
    top = top.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return linked.where("not shared").select(*columns).unionByName(top.select(*columns))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations; see trie() for nulls, ties and empty tables."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op11_conversation_trie": op11_conversation_trie}
#: The bytes of a number's digits go through CRC-32 bit by bit.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
lambda r, x: list_reduce(list_prepend(xor(r, x), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda s, y: xor(s >> 1, 3988292384 * (s & 1)))), CAST(4294967295 AS BIGINT))"""
ORACLES = {
    "op11_conversation_trie": f"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(concat(length(coalesce(role, '')), ':', role, text))) AS k FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, c - ((c % 100) + 100) % 100 AS base FROM t), h AS (SELECT c, base, {_CRC} % 6 AS h FROM ids),
r AS (SELECT h.c, 0 AS part, k, role, text FROM h JOIN t ON t.c = h.base AND t.k <= h.h UNION ALL SELECT h.c, 1, k, role, text FROM h JOIN t ON t.c = h.c AND t.k > h.h),
o AS (SELECT c, sha256(concat(length(role), ':', role, text)) AS digest, length(text) AS chars, row_number() OVER (PARTITION BY c ORDER BY part, k) AS depth FROM r),
p AS (SELECT c, depth, chars, string_agg(digest, '') OVER (PARTITION BY c ORDER BY depth) AS path FROM o UNION ALL SELECT c, 0, 0, '' FROM ids),
e AS (SELECT *, depth = max(depth) OVER (PARTITION BY c) AS last FROM p),
n AS (SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM e GROUP BY 1, 2),
f AS (SELECT n.*, q.conv_id AS parent_conv_id, (SELECT count(*) FROM n k WHERE k.depth = n.depth + 1 AND starts_with(k.path, n.path)) AS n_children FROM n LEFT JOIN n q ON q.depth = n.depth - 1 AND q.path = left(n.path, length(n.path) - 64))
SELECT f.conv_id, f.depth, any_value(f.parent_conv_id) AS parent_conv_id, any_value(f.n_convs) AS n_convs, any_value(f.n_children) AS n_children,
CAST(count(*) FILTER (b.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((b.n_convs - 1) * b.chars) AS BIGINT) AS saved_tokens, any_value(f.ends_sha256) AS ends_sha256
FROM f JOIN f b ON starts_with(b.path, f.path) GROUP BY f.path, f.conv_id, f.depth"""
}
