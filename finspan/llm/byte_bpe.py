"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a piece has exactly one valid last token: the token that ends there and may follow
the last token of what stands before it. Storing these last tokens makes the encoding of any prefix
readable by walking back, so that bytes can be appended exactly and an edit needs new work only from
the edited byte on. Two tokens may stand side by side if encoding their joined bytes gives these two.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from finspan.llm import common

#: Pieces whose ids, and pairs and steps whose outcome, a Python worker keeps; on more, it starts anew. It bounds memory and changes no result.
KEEP_PIECES, KEEP_PAIRS, KEEP_STEPS = 400_000, 600_000, 1_000_000


class Vocabulary:
    """Byte tokens by rank, with each token's last merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.sizes = [len(x) for x in self.tokens]
        self.pairs: dict[int, bool] = {}
        #: Last merge of a token, none for single bytes.
        self.halves: dict[int, tuple[int, int]] = {}
        #: Tokens that their own bytes can be merged to.
        self.reachable: dict[bytes, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.reachable[token] = rank
                continue
            for cut in range(1, len(token)):
                a, b = self.reachable.get(token[:cut]), self.reachable.get(token[cut:])
                if a is not None and b is not None and self._stand(a, b, rank):
                    self.halves[rank] = a, b
                    self.reachable[token] = rank
                    break
        self.automaton = Automaton(self.reachable)

    @staticmethod
    @lru_cache(2)
    def load(path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return Vocabulary({base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())})

    def follows(self, a: int, b: int) -> bool:
        """Whether b may stand right after a."""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) > KEEP_PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self._stand(a, b, len(self.tokens))
        return known

    def _stand(self, a: int, b: int, below: int) -> bool:
        """No merge across the border of a and b, of a rank under below, comes before those inside them.

        Undo the merges inside a and b that touch the border, latest first; at each state a merge across the
        border would have been made if its rank is lower than that of the merge undone last. Of equal
        ranks the left one is made first.
        """
        left, right, limit = a, b, below
        while True:
            across = self.ranks.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < limit:
                return False
            l, r = self.halves.get(left), self.halves.get(right)
            if l is None and r is None:
                return True
            if r is None or (l is not None and left > right):
                limit, left = left, l[1]
            else:
                limit, right = right + 1, r[0]


class Automaton:
    """For a byte string read so far, the longest token that it ends with (Aho and Corasick's automaton)."""

    def __init__(self, reachable: dict[bytes, int]):
        self.step: dict[int, int] = {}  # node * 256 + byte -> node; what isn't in the trie is added when met
        own, depth = [-1], [0]
        step = self.step
        ends: dict[int, int] = {}
        for token, rank in reachable.items():
            node = 0
            for i, byte in enumerate(token):
                key = node << 8 | byte
                node = step.get(key)
                if node is None:
                    node = step[key] = len(own)
                    own.append(-1)
                    depth.append(i + 1)
            own[node] = rank
            ends[rank] = node
        self.fail = [0] * len(own)
        self.token = own
        for parent, byte, node in sorted(((x >> 8, x & 255, node) for x, node in step.items()), key=lambda x: depth[x[2]]):
            if parent:
                self.fail[node] = self.go(self.fail[parent], byte)
            if own[node] < 0:
                own[node] = own[self.fail[node]]
        #: The longest token that a token ends with, besides itself.
        self.shorter = [-1] * (max(ends) + 1)
        for rank, node in ends.items():
            self.shorter[rank] = own[self.fail[node]]

    def go(self, node: int, byte: int) -> int:
        found = self.step.get(node << 8 | byte)
        if found is None:
            found = self.go(self.fail[node], byte) if node else 0
            if len(self.step) < KEEP_STEPS:
                self.step[node << 8 | byte] = found
        return found


class PrefixTable:
    """The last tokens of all prefixes of a growing byte string."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.data = bytearray()
        self.last: list[int] = []
        self._nodes: list[int] = [0]

    def truncate(self, n: int) -> None:
        del self.data[n:], self.last[n:], self._nodes[n + 1 :]

    def append(self, more: bytes) -> None:
        v, last, nodes = self.vocabulary, self.last, self._nodes
        auto, sizes, pairs = v.automaton, v.sizes, v.pairs
        get, best, shorter = auto.step.get, auto.token, auto.shorter
        node, n = nodes[-1], len(self.data)
        self.data += more
        for byte in more:
            n += 1
            following = get(node << 8 | byte)
            node = auto.go(node, byte) if following is None else following
            nodes.append(node)
            token = best[node]
            while token >= 0:
                before = n - sizes[token]
                if not before:
                    break
                a = last[before - 1]
                fits = pairs.get(a << 32 | token)
                if v.follows(a, token) if fits is None else fits:
                    break
                token = shorter[token]
            else:
                raise ValueError("a byte has no token")
            last.append(token)

    def replace(self, start: int, end: int, by: bytes) -> None:
        """Edit bytes start to end; only what follows start is worked out again."""
        rest = bytes(self.data[end:])
        self.truncate(start)
        self.append(by + rest)

    def ids(self) -> list[int]:
        out, i, sizes, last = [], len(self.last), self.vocabulary.sizes, self.last
        while i:
            token = last[i - 1]
            out.append(token)
            i -= sizes[token]
        out.reverse()
        return out


class Encoder:
    """Encodes texts, each match of the pattern separately; ids come as little-endian 32-bit bytes.

    A text is first cut before every single space that stands between characters other than white space,
    where the pattern always begins a new match; so what is cut off can be looked up whole.
    """

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary.load(path)
        self.find = regex.compile(pattern).findall
        self.cut = re.compile(r"(?<=\S) (?=\S)").split
        self.known: dict[str, bytes] = {}  # of parts that had a space before them
        self.pieces: dict[str, bytes] = {}

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode pieces; in sorted order, each goes on from the prefix that it shares with the one before."""
        table, before, ranks = PrefixTable(self.vocabulary), b"", self.vocabulary.ranks
        for piece in sorted(x.encode() for x in pieces):
            whole = ranks.get(piece)
            if whole is not None:  # also those that no merges lead to
                ids = [whole]
            else:
                same, most = 0, min(len(piece), len(before))
                while same < most and piece[same] == before[same]:
                    same += 1
                table.truncate(same)
                table.append(piece[same:])
                before, ids = piece, table.ids()
            self.pieces[piece.decode()] = struct.pack(f"<{len(ids)}I", *ids)

    def _parts(self, parts: list[str]) -> list[bytes]:
        found = [self.find(x) for x in parts]
        missing = {x for pieces in found for x in pieces} - self.pieces.keys()
        if len(self.pieces) + len(missing) > KEEP_PIECES:
            self.pieces, missing = {}, {x for pieces in found for x in pieces}
        self.learn(missing)
        get = self.pieces.__getitem__
        return [get(x[0]) if len(x) == 1 else b"".join(map(get, x)) for x in found]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [x.split(" ") if x else [""] for x in texts]
        for i, parts in enumerate(split):
            if "" in parts or list(map(str.strip, parts)) != parts:  # white space beside a space
                split[i] = self.cut(texts[i] or "")
        used = set()
        for parts in split:
            used.update(parts[1:])
        missing = used - self.known.keys()
        if len(self.known) + len(missing) > KEEP_PIECES:
            self.known, missing = {}, used
        parts = list(missing)
        self.known.update(zip(parts, self._parts([" " + x for x in parts]), strict=True))
        first = self._parts([parts[0] for parts in split])
        get = self.known.__getitem__
        return [a + b"".join(map(get, parts[1:])) for a, parts in zip(first, split, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _groups(texts: list, size: int = 1 << 20) -> Iterator[list]:
    part, n = [], 0
    for x in texts:
        part.append(x)
        n += len(x or "")
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """Per row: the columns named in keep, n_tokens (long), ids (binary, little-endian unsigned 32-bit).

    Ids that don't decode to the text raise. A null or empty text has no ids. Rows, repeated ones too, stay one for one;
    other columns are dropped.
    """
    common.small_batches(docs.sparkSession)
    keep = list(keep)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            at = 0
            for texts in _groups(batch.column(len(keep)).to_pylist()):
                ids = e.encode(texts)
                for x, y in zip(texts, ids, strict=True):
                    if e.decode(y) != (x or "").encode():
                        raise ValueError("ids do not decode to the text")
                cols = [batch.column(i).slice(at, len(texts)) for i in range(len(keep))]
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*cols, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=[*keep, "n_tokens", "ids"])

    return docs.select(*keep, docs[text].cast("string").alias("__text")).mapInArrow(run, f"{schema}, n_tokens bigint, ids binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document; see encode_documents."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            at = 0
            for texts in _groups(batch.column(1).to_pylist()):
                ids = e.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(e.decode(x)).hexdigest() for x in ids]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                at += len(texts)

    return docs.select("doc_id", docs["text"].cast("string")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return digests(common.documents(spark, sf_dir), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
ORACLES: dict[str, str] = {}
