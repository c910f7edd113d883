"""Shared helpers of the corpus operators."""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words: ASCII white space only.
SPACES = b" \t\n\x0b\x0c\r"
#: The same separators as a Java and SQL regular expression.
SPACE_RE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder's path inside the shared checkpoint folder that the session names.

    Where the session names none, a folder of the warehouse is taken, which all executors share too.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.finspan"
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage of df: write it to the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Bytes and rows of an Arrow batch, at most: what a Python worker holds of its input at one time.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2_000
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let the session cut Arrow batches to BATCH_BYTES and so many rows, unless it has them smaller already."""
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", rows)):
        key = f"spark.sql.execution.arrow.{name}"
        number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", spark.conf.get(key).lower()).groups()
        if not 0 < int(number) * _UNITS[unit] <= most:
            spark.conf.set(key, str(most))


#: Of all rows, a key with more than this share is salted or joined by broadcast; there can be but its inverse of them.
HOT_SHARE = 1 / 1000
#: Rows of one key that meet in one task in any case.
PER_COPY = 1_000


def salted_join(rows: DataFrame, others: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined with others on key, the rows of a frequent key dealt by a hash of their column `by`.

    The others' rows of such a key are copied as often as its rows are dealt. rows is run twice.
    """
    most = max(PER_COPY, rows.count() * HOT_SHARE)
    hot = rows.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("__copies")).where("__copies > 1")
    hot = F.broadcast(written(hot, "hot"))  # 1 / HOT_SHARE rows at most
    copies = F.coalesce("__copies", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(by), copies).cast("int")).drop("__copies")
    copied = others.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("__copies")
    return dealt.join(copied, [key, "__salt"]).drop("__salt")


#: So many row numbers or ids are broadcast at most; beyond, both sides of a join are shuffled.
BROADCAST_IDS = 2_000_000


def by_row(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """rows with a column __row, semi- or anti-joined (how) with ids, whose only column is __row; __row is dropped."""
    ids = written(ids, "rows")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "__row", how).drop("__row")


_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_IS_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
_A = np.uint64(0x9E3779B97F4A7C15 | 1)
_A_INV = np.uint64(pow(int(_A), -1, 2**64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        m = 1 << (n - 1).bit_length()
        for name, base in (("up", _A), ("down", _A_INV)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


#: Longer words get a cryptographic hash: sums of powers modulo 2^64 are equal for some different words of a thousand letters, whatever the base.
LONG_WORD = 100


def word_hashes(raw: np.ndarray, lower: bool = True, marks: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and ends of the words in an array of UTF-8 bytes.

    Separators are the ASCII white-space bytes; A-Z are lower-cased if asked for. Equal words
    have equal hashes wherever they stand. A last byte of a word that is in marks, behind an ASCII letter or digit, is left out.
    """
    if not len(raw):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    space = np.empty(len(raw) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = _IS_SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[0::2], edge[1::2]
    if marks:
        some = np.zeros(256, bool)
        some[list(marks)] = True
        ends = ends - ((ends - starts > 1) & some[raw[ends - 1]] & _IS_ALNUM[raw[ends - 2]])
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[raw] if lower else raw] * down[:-1], out=total[1:])
    h = mix64((total[ends] - total[starts]) * up[starts] ^ (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        word = raw[starts[i] : ends[i]]
        h[i] = int.from_bytes(hashlib.blake2b((_LOWER[word] if lower else word).tobytes(), digest_size=8).digest(), "little")
    return h, starts, ends
