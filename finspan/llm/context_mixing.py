"""Language-model scores by logistic context mixing of hashed-context bit predictors that learn from the whole corpus.

A text is lower-cased (A-Z), cut into words and an end. Documents are dealt to streams by a hash, of about STREAM_BYTES each,
so that streams depend on the documents alone. A token is coded by bits:

1. Guesses: for contexts of the last 3 and the last 1 tokens, one bit each says whether the token is the one that followed
   the context's last occurrence in the document, or where it had none, the one that FOLLOWERS names. The first that is right ends the code.
2. Class: the bits of a prefix code of the class of the word's count (0, 1, 2 to 3, 4 to 7, ...) in all other documents to
   learn from. Within a class, words have their shares of the class's tokens.
3. Spelling: a word of class 0 is spelled by its bytes and a stop, each by the bits of a prefix code.

Bits of guesses and classes are predicted from five contexts (of preceding tokens, their classes, the guess and the length of
the run of right guesses, the document's share of new words so far), bits of a spelling from the last 1, 2, 3 and 5 bytes
of the word. Each context is hashed to a slot with the zeros and ones that followed. The predictions' logits are summed with
weights that a gate chooses, learned by the coding cost's gradient; a table by gate and logit refines the sum to
the share of ones seen there.

All of it is learned from all documents to learn from, in three passes over the streams:

1. Followers: a table of a fixed size says what followed a context, of each slot's contexts and followers the two that a stream has most often.
2. Learning: in each stream slots, weights and tables learn from batch to batch, each scored before it is learned from. Slots and
   tables of all streams are added up; weights are averaged by the curvature of the cost.
3. Scoring: held-out documents are scored by what all streams have learned, documents to learn from by what all other streams have.

Within a document that is mixed with the word's share of the document's tokens so far; the logit of the share's weight
is learned online from token to token, by the same gradient, anew in each document.

What streams have learned is told as whole numbers, which add up to the same in any order. The tables don't grow with the corpus.
"""

from __future__ import annotations

import copy
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finspan.llm import common

#: Bytes of text in a stream, about, and tokens in a batch, to the end of a document.
STREAM_BYTES, BATCH = 4 << 20, 50_000
#: Streams at least, so that small corpora too have others to score a stream's documents by, and at most, as their numbers are kept in few bits.
LEAST_STREAMS, STREAM_BITS = 8, 20
#: Contexts of guesses, in tokens.
GUESSES = (3, 1)
#: log2 of the slots of what followed a context, and numbers in a message between tasks.
FOLLOWER_BITS, CHUNK = 18, 1 << 14
#: Weights and curvatures are told in such fractions.
UNIT = 1 << 20
CLASSES = 48
#: Contexts of a token's bits, and log2 of the slots of each.
CONTEXTS, CONTEXT_BITS = 5, 18
#: Contexts of a spelling, in bytes, and log2 of the slots of each.
ORDERS, SLOT_BITS = (1, 2, 3, 5), (14, 17, 18, 18)
SPELLED = 4096
CELLS, REACH = 33, 8.0
#: Bits that are mixed at a time.
BLOCK = 1 << 14
END_HASH = np.uint64(0x5851F42D4C957F2D)
_BASE = np.concatenate([[0], np.cumsum([1 << b for b in SLOT_BITS])])
STOP = 0x20  # not in a word
_TO_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def prefix_code(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Huffman's code of the 256 symbols: for each, its code length, the nodes passed and the bits taken (row by symbol)."""
    heap = [(int(c) + 1, s, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    nodes = count(256)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        n = next(nodes)
        parent[a[2]], parent[b[2]] = (n, 0), (n, 1)
        heapq.heappush(heap, (a[0] + b[0], n, n))
    paths = []
    for s in range(256):
        path = []
        x = s
        while x in parent:
            path.append(parent[x])
            x = parent[x][0]
        paths.append(path[::-1])
    most = max(map(len, paths))
    node, bit = np.zeros((256, most), np.uint64), np.zeros((256, most), np.uint8)
    for s, path in enumerate(paths):
        node[s, : len(path)] = [n for n, _ in path]
        bit[s, : len(path)] = [b for _, b in path]
    return np.array([len(p) for p in paths]), node, bit


def _logit(n: np.ndarray) -> np.ndarray:
    return np.log((n.imag + np.float32(0.2)) / (n.real + np.float32(0.2)))


class Mixer:
    """Slots of counts, gated weights and refinement, learned online."""

    def __init__(self, slots: int, inputs: int, gates: int):
        self.counts = np.zeros(slots, np.complex64)  # zeros, and ones as the imaginary part, so that one look-up gives both
        self.weights = np.full((gates, inputs + 1), 1.2 / inputs)
        self.weights[:, -1] = 0
        self.curve = np.full((gates, inputs + 1), 30.0)  # of the cost, by weight
        self.ones, self.seen = np.zeros((gates, CELLS)), np.zeros((gates, CELLS))
        self.logits: np.ndarray | None = None  # by slot, once nothing is learned any more

    def predict(self, slots: np.ndarray, gate: np.ndarray, bit: np.ndarray, scores: bool = True) -> tuple[np.ndarray, tuple]:
        """log2 of the probability of each bit (without scores: nothing), and what learn needs; slots: input x bit."""
        n = len(bit)
        x, p, cell, out = np.empty((len(slots), n), np.float32), np.empty(n, np.float32), np.empty(n, np.int32), np.empty(n, np.float32)
        weights = self.weights.T.astype(np.float32)
        t = 0.5 * self.seen / (self.seen + 400)
        of_cell, t = (t * (self.ones + 1e-3) / (self.seen + 2e-3)).astype(np.float32).ravel(), (1 - t).astype(np.float32).ravel()
        for a in range(0, n, BLOCK):  # what is made of a block stays in the cache
            part = slice(a, a + BLOCK)
            g = gate[part].astype(np.int64)
            s = weights[-1][g]
            for i, at in enumerate(slots):
                x[i, part] = y = np.take(self.logits, at[part]) if self.logits is not None else _logit(np.take(self.counts, at[part]))
                s += y * weights[i][g]
            s = np.clip(s, np.float32(-12), np.float32(12))
            p[part] = q = 1 / (1 + np.exp(-s))
            at = g * CELLS + np.clip(np.rint((s + REACH) * ((CELLS - 1) / (2 * REACH))), 0, CELLS - 1).astype(np.int64)
            cell[part] = at
            if not scores:
                continue
            refined = np.clip(t[at] * q + of_cell[at], np.float32(1e-6), np.float32(1 - 1e-6))
            out[part] = np.log2(np.where(bit[part], refined, 1 - refined))
        return out, (slots, gate, bit, x, p, cell)

    def learn(self, known: tuple) -> None:
        slots, gate, bit, x, p, cell = known
        n = len(self.weights)
        self.count(slots, bit)
        self.ones += np.bincount(cell, bit, n * CELLS).reshape(n, CELLS)
        self.seen += np.bincount(cell, minlength=n * CELLS).reshape(n, CELLS)
        spread, pull = np.zeros((len(x) + 1, n)), np.zeros((len(x) + 1, n))
        for a in range(0, len(bit), BLOCK):
            part = slice(a, a + BLOCK)
            g, q = gate[part].astype(np.int64), p[part]
            miss, wide = bit[part] - q, q * (1 - q)
            for i in range(len(x)):
                spread[i] += np.bincount(g, wide * x[i, part] * x[i, part], n)
                pull[i] += np.bincount(g, miss * x[i, part], n)
            spread[-1] += np.bincount(g, wide, n)
            pull[-1] += np.bincount(g, miss, n)
        self.curve = self.curve * 0.98 + spread.T
        self.weights += np.clip(pull.T / self.curve / 3, -0.2, 0.2)

    def count(self, slots: np.ndarray, bit: np.ndarray) -> None:
        one = np.where(bit, np.complex64(1j), np.complex64(1))
        for at in slots:
            np.add.at(self.counts, at.astype(np.intp), one)

    def count_all(self, slots: list[np.ndarray], bits: list[np.ndarray]) -> None:
        """count of many bits at a time, one array of slots and bits for each part; an input's slots are next to each other."""
        for at in zip(*slots, strict=True):
            low, high = min(int(x.min(initial=len(self.counts))) for x in at), max(int(x.max(initial=-1)) for x in at) + 1
            if low < high:
                n = np.bincount(np.concatenate([(x - low) * 2 + b for x, b in zip(at, bits, strict=True)]), minlength=2 * (high - low))
                self.counts[low:high] += n.astype(np.float32).view(np.complex64)

    def told(self) -> np.ndarray:
        """All that is learned, as whole numbers to be added to those of others."""
        parts = [self.counts.real, self.counts.imag, self.weights * self.curve * UNIT, self.curve * UNIT, self.ones, self.seen]
        return np.concatenate([(x if x.dtype == np.float32 else np.rint(x)).ravel().astype(np.int64) for x in parts])  # counts are whole

    def take(self, told: np.ndarray) -> Mixer:
        """Be what the sum of some tell."""
        n, m = len(self.counts), self.weights.size
        zeros, ones, weights, curve, *cells = np.split(told, np.cumsum([n, n, m, m, self.ones.size]))
        self.counts = (zeros + 1j * ones).astype(np.complex64)
        if curve.any():
            self.weights, self.curve = (weights / np.maximum(curve, 1)).reshape(self.weights.shape), (curve / UNIT).reshape(self.curve.shape)
        self.ones, self.seen = (x.astype(np.float64).reshape(self.ones.shape) for x in cells)
        self.logits = _logit(self.counts)
        return self

    def without(self, counts: np.ndarray) -> Mixer:
        out = copy.copy(self)
        out.counts = self.counts - counts
        out.logits = _logit(out.counts)
        return out


@dataclass
class Bits:
    """The bits of some words: each word's first bit, and for each bit its value, its gate and its slots."""

    begin: np.ndarray
    bit: np.ndarray
    gate: np.ndarray
    slots: np.ndarray  # order x bit


def bits_of(words: list[bytes], code: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Bits:
    data = np.frombuffer(b"".join(w + b" " for w in words), np.uint8)
    sizes = np.array([len(w) + 1 for w in words])
    start = np.cumsum(sizes) - sizes
    place = np.arange(len(data)) - np.repeat(start, sizes)
    lengths, node, bit = code
    n_bits = lengths[data]
    symbol_begin = np.cumsum(n_bits) - n_bits
    of = np.repeat(np.arange(len(data)), n_bits)  # the byte of each bit
    nth = np.arange(len(of)) - np.take(symbol_begin, of)
    at_code = np.take(data * np.int64(node.shape[1]), of) + nth
    of_node = np.take((node.astype(np.uint32) * np.uint32(0x9E3779B1)).ravel(), at_code)
    slots = np.empty((len(ORDERS), len(of)), np.int32)
    h = np.full(len(data), 0x2545F491, np.uint64)
    k = 0
    for i, order in enumerate(ORDERS):
        while k < order:
            k += 1
            before = np.full(len(data), 257, np.uint64)
            before[k:] = data[: max(0, len(data) - k)]
            before[place < k] = 257
            h = (h + before) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        slots[i] = _slot(np.take(_half(h), of) + of_node, SLOT_BITS[i]) + np.uint32(_BASE[i])
    gate = np.take((np.minimum(place, 6) * 2).astype(np.int8), of) + (nth == 0)
    return Bits(symbol_begin[start], np.take(bit.ravel(), at_code), gate, slots)


def _half(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    """h: 32-bit hashes, which are changed."""
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0x297A2D39)
    return h >> np.uint32(32 - bits)


class Speller:
    """log2 of the probability of words by their bytes; seeded with known words."""

    def __init__(self, known: list[bytes], code: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.code = code or prefix_code(np.bincount(np.frombuffer(b" ".join(known) + b" ", np.uint8), minlength=256))
        self.mixer = Mixer(int(_BASE[-1]), len(ORDERS), 14)
        self.count(known)

    def count(self, words: list[bytes]) -> list[Bits]:
        out = [bits_of(words[i : i + SPELLED], self.code) for i in range(0, len(words), SPELLED)]
        if out:
            self.mixer.count_all([b.slots for b in out], [b.bit for b in out])
        return out

    def learn(self, words: list[bytes]) -> None:
        for i in range(0, len(words), SPELLED):
            b = bits_of(words[i : i + SPELLED], self.code)
            self.mixer.learn(self.mixer.predict(b.slots, b.gate, b.bit, False)[1])

    def log2(self, words: list[bytes], learn: bool, bits: list[Bits] | None = None) -> np.ndarray:
        """Of each word; they are learned from, batch by batch, after they are scored. bits: of the words, if they were counted before."""
        out = np.empty(len(words))
        for i in range(0, len(words), SPELLED):
            b = bits[i // SPELLED] if bits else bits_of(words[i : i + SPELLED], self.code)
            log2, known = self.mixer.predict(b.slots, b.gate, b.bit)
            out[i : i + SPELLED] = np.add.reduceat(log2, b.begin)
            if learn:
                self.mixer.learn(known)
        return out


def class_of(c: np.ndarray) -> np.ndarray:
    """0 for no occurrence, else 1 and the count's log2, without fraction."""
    return np.frexp(c.astype(np.float64))[1].astype(np.int64)


@dataclass
class Guess:
    has: np.ndarray
    word: np.ndarray
    hit: np.ndarray
    run: np.ndarray  # right guesses in a row before
    before: np.ndarray  # whether the guess was right where it stems from


def _back(word: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """The word k places before, plus 1; 0 before the document's begin. first: each token's document's begin."""
    out = np.zeros(len(word), np.int64)
    out[k:] = word[: max(0, len(word) - k)] + 1
    out[np.arange(len(word)) - k < first] = 0
    return out


def guesses(word: np.ndarray, first: np.ndarray, n_learn: int, order: int) -> Guess:
    """What followed the context's last occurrence, in the same document or in what is learned from (the first n_learn tokens)."""
    n = len(word)
    ctx = np.zeros(n, np.uint64)
    for k in range(1, order + 1):
        ctx = common.mix64(ctx * np.uint64(31) + _back(word, first, k).astype(np.uint64))
    p = np.argsort(ctx, kind="stable")
    new = np.append(True, ctx[p[1:]] != ctx[p[:-1]])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    one_before = np.append(-1, p[:-1])
    one_before[new] = -1
    learned = np.maximum.accumulate(np.where(p < n_learn, np.arange(n), -1))
    last = np.where((learned >= group) & (learned < np.arange(n)), p[learned], -1)
    ok = (one_before >= 0) & ((p < n_learn) | (first[one_before] == first[p]))
    prev = np.empty(n, np.int64)
    prev[p] = np.where(ok, one_before, last)
    has = prev >= 0
    guess = np.where(has, word[prev], -1)
    hit = has & (guess == word)
    miss_at = np.maximum.accumulate(np.maximum(np.where(hit, -1, np.arange(n)), first - 1))
    run = np.zeros(n, np.int64)
    run[1:] = np.arange(n - 1) - miss_at[:-1]
    run[np.arange(n) == first] = 0
    return Guess(has, guess, hit, np.minimum(run, 15), has & hit[prev])


def contexts_of(hashes: np.ndarray, first: np.ndarray, order: int) -> np.ndarray:
    """A hash of the words before each token, the same in all streams; hashes: each token's."""
    out = np.zeros(len(hashes), np.uint64)
    for k in range(1, order + 1):
        before = np.zeros(len(hashes), np.uint64)
        before[k:] = hashes[: max(0, len(hashes) - k)]
        before[np.arange(len(hashes)) - k < first] = 0
        out = common.mix64(out * np.uint64(31) + before)
    return out


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper bits of 64-bit hashes, ascending, and their places; those of equal keys ascend."""
    bits = np.uint64(max(1, len(keys).bit_length()))
    both = np.sort((keys >> bits << bits) | np.arange(len(keys), dtype=np.uint64))
    return both >> bits << bits, (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


class Followers:
    """What followed contexts: of each slot the two entries of highest rank, of different streams.

    An entry is a rank, a context and a word's hash; the rank is the number of times in the stream, some bits of a hash and the stream.
    """

    def __init__(self, table: np.ndarray | None = None):
        self.table = np.zeros((len(GUESSES), 2, 3, 1 << FOLLOWER_BITS), np.uint64) if table is None else table

    @staticmethod
    def insert(two: np.ndarray, at: np.ndarray, new: np.ndarray) -> None:
        """new: entries (3 x slots) of the slots at, each at most once."""
        for layer in two:
            old = layer[:, at]
            better = new[0] > old[0]
            layer[:, at] = np.where(better, new, old)
            new = np.where(better, old, new)

    def learn(self, stream: int, hashes: np.ndarray, first: np.ndarray) -> None:
        for two, order in zip(self.table, GUESSES, strict=True):
            ctx = contexts_of(hashes, first, order)
            pair, place = _sorted(common.mix64(ctx ^ (hashes * np.uint64(0x9E3779B97F4A7C15))))
            new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
            n, at, pair = np.diff(np.append(new, len(pair))), place[new], pair[new]
            slot = (ctx[at] >> np.uint64(64 - FOLLOWER_BITS)).astype(np.int64)
            rank = (np.minimum(n, (1 << 20) - 1).astype(np.uint64) << np.uint64(44)) | ((pair >> np.uint64(40)) << np.uint64(20)) | np.uint64(stream)
            best = np.zeros(1 << FOLLOWER_BITS, np.uint64)
            np.maximum.at(best, slot, rank)
            of = np.full(len(best), -1)
            top = np.flatnonzero(rank == best[slot])
            of[slot[top]] = top  # of equal ranks the last
            last = of[of >= 0]
            self.insert(two, slot[last], np.stack([rank[last], ctx[at][last], hashes[at][last]]))

    def guesses(self, stream: int, names: np.ndarray, word: np.ndarray, first: np.ndarray) -> list[Guess]:
        """By order, what followed last in the same document, or where nothing did, most often in another stream.

        names: the words' hashes, ascending; guesses are places there, or -1 for other words.
        """
        out = []
        n = len(word)
        hashes = names[word]
        for two, order in zip(self.table, GUESSES, strict=True):
            own = (two[0, 0] & np.uint64((1 << STREAM_BITS) - 1)) == np.uint64(stream)
            rank, of, name = (np.where(own, two[1, i], two[0, i]) for i in range(3))
            ctx = contexts_of(hashes, first, order)
            slot = (ctx >> np.uint64(64 - FOLLOWER_BITS)).astype(np.int64)
            key, p = _sorted(common.mix64(ctx + first.astype(np.uint64)))
            prev = np.full(n, -1)
            same = key[1:] == key[:-1]
            prev[p[1:][same]] = p[:-1][same]
            told = np.flatnonzero((prev < 0) & (of[slot] == ctx) & (rank[slot] > 0))
            asked, which = np.unique(slot[told], return_inverse=True)
            at = np.minimum(np.searchsorted(names, name[asked]), len(names) - 1)
            at = np.where(names[at] == name[asked], at, -1)
            guess, has = np.where(prev >= 0, word[prev], -1), prev >= 0
            guess[told], has[told] = at[which], True
            hit = has & (guess == word)
            miss_at = np.maximum.accumulate(np.maximum(np.where(hit, -1, np.arange(n)), first - 1))
            run = np.zeros(n, np.int64)
            run[1:] = np.arange(n - 1) - miss_at[:-1]
            run[np.arange(n) == first] = 0
            out.append(Guess(has, guess, hit, np.minimum(run, 15), (prev >= 0) & hit[prev]))
        return out


def new_mixer() -> Mixer:
    return Mixer(CONTEXTS << CONTEXT_BITS, CONTEXTS, 3 * (2 * 16 + 32))


def token_log2(
    word: np.ndarray,
    cls: np.ndarray,
    sizes: np.ndarray,
    n_learn_docs: int,
    code: tuple[np.ndarray, np.ndarray, np.ndarray],
    names: np.ndarray | None = None,
    found: list[Guess] | None = None,
    mixer: Mixer | None = None,
    whole: Mixer | None = None,
    scores: bool = True,
) -> tuple[np.ndarray, np.ndarray]:
    """log2 of the probability of each token's guesses and class bits, and whether a guess gave the token.

    word: numbers of the words, cls: their classes, sizes: tokens of each document, those to learn from first.
    names: hashes of the words, which are the same in all streams; found: guesses by order. mixer: what learns. whole: what all streams have
    learned; then nothing is learned here, and the counts of documents to learn from are left out of it where these are scored. scores: whether log2 is asked for.
    """
    n = len(word)
    stop = np.cumsum(sizes)
    first = np.repeat(stop - sizes, sizes)
    n_learn = int(stop[n_learn_docs - 1]) if n_learn_docs else 0
    found = [guesses(word, first, n_learn, k) for k in GUESSES] if found is None else found
    w1, w2 = _back(word, first, 1), _back(word, first, 2)
    c1 = np.where(w1 > 0, cls[np.maximum(np.arange(n) - 1, 0)] + 1, 0)
    c2 = np.where(w2 > 0, cls[np.maximum(np.arange(n) - 2, 0)] + 1, 0)
    if names is not None:
        w1 = np.where(w1 > 0, names[w1 - 1], 0)
    names = np.arange(word.max(initial=0) + 1).astype(np.uint64) if names is None else names
    fresh = np.cumsum(cls == 0) - (cls == 0)
    at = np.arange(n) - first
    share = np.where(at > 0, 1 + np.minimum(6, np.rint(12 * (fresh - fresh[first]) / np.maximum(at, 1))), 0).astype(np.int64) * 4 + np.minimum(at // 32, 3)
    lengths, node, bit = code
    mixer = mixer or new_mixer()
    out, done = np.zeros(n), np.zeros(n, bool)
    counted: list[tuple] = []  # bits of documents to learn from, until all of them are counted

    def hashed(context: np.ndarray) -> np.ndarray:
        return _half(context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def slots_of(what: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        slots, of_what = np.empty((CONTEXTS, len(what)), np.int32), what.astype(np.uint32) * np.uint32(0xC2B2AE3D)
        for j, c in enumerate(contexts):
            slots[j] = _slot(c + of_what, CONTEXT_BITS) + np.uint32(j << CONTEXT_BITS)
        return slots

    def coded(i: np.ndarray, what: np.ndarray, gate: np.ndarray, ones: np.ndarray, contexts: list[np.ndarray], learn: bool) -> None:
        slots = slots_of(what, contexts)
        if learn and whole is not None:
            counted.append((i.astype(np.int32), slots, gate.astype(np.int16), ones))
        else:
            scored(i, slots, gate, ones, learn)

    def scored(i: np.ndarray, slots: np.ndarray, gate: np.ndarray, ones: np.ndarray, learn: bool) -> None:
        often = np.take(mixer.counts, slots[-1])
        often = often.real + often.imag
        log2, known = mixer.predict(slots, gate * 3 + (often > 0.5) + (often > 8.5), ones, scores)
        if scores and len(i):
            low = int(i[0])  # i ascends
            got = np.bincount(i - low, log2)
            out[low : low + len(got)] += got
        if learn:
            mixer.learn(known)

    a = 0
    while a < n or counted:
        if counted and a >= n_learn:
            mixer.count_all([x[1] for x in counted], [x[3] for x in counted])
            mixer = whole.without(mixer.counts)
            for x in counted:
                scored(*x, False)
            counted.clear()
            continue
        if whole is not None and a == n_learn:
            mixer = whole
        b = int(stop[np.searchsorted(stop, min(a + BATCH, n))])
        b = min(b, n_learn) if a < n_learn else b  # documents to learn from have batches of their own
        learn, i = a < n_learn, np.arange(a, b)
        tried = np.full(b - a, -2)
        for k, g in enumerate(found):
            j = i[g.has[a:b] & ~done[a:b] & (g.word[a:b] != tried)]
            if len(j):
                guess = np.where(g.word[j] >= 0, names[g.word[j]], 0) * np.uint64(2) + (g.run[j] > 0).astype(np.uint64)
                coded(j, np.full(len(j), 600 + k), 16 * k + g.run[j], g.hit[j], [hashed(x) for x in (g.run[j] * 2 + g.before[j], c1[j] * 64 + g.run[j], share[j] * 2 + g.before[j], w1[j], guess)], learn)
                done[j] = g.hit[j]
                tried[j - a] = g.word[j]
        j = i[~done[a:b]]
        contexts = [hashed(x) for x in (np.zeros(len(j)), c1[j], c1[j] * 64 + c2[j], share[j], w1[j])]
        each = lengths[cls[j]]
        of = np.repeat(np.arange(len(j)), each)
        nth = np.arange(len(of)) - np.take(np.cumsum(each) - each, of)
        at_code = np.take(cls[j] * node.shape[1], of) + nth
        coded(np.take(j, of), np.take(node.ravel(), at_code), 32 + np.minimum(nth, 31), np.take(bit.ravel(), at_code), [np.take(x, of) for x in contexts], learn)
        a = b
    return out, done


#: Where the logit of the weight of a document's own counts begins, and its rate.
OWN_BEGIN, OWN_RATE = -3.0, 0.5
#: Documents that are gone through one by one rather than token by token, at most.
FEW = 24


def adapted(log10: np.ndarray, before: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 of the probability of documents, given that of each token under the model, how often its document had its word before, and the documents' sizes."""
    p_model = 10 ** np.maximum(log10, -290)
    begin = np.cumsum(sizes) - sizes
    by_size = np.argsort(-sizes, kind="stable")
    active = np.searchsorted(-sizes[by_size], -np.arange(sizes.max()), side="left")
    together = int(np.searchsorted(-active, -FEW, side="left"))  # with few documents left, each goes on by itself
    t_of = np.arange(len(log10)) - np.repeat(begin, sizes)
    more = before / np.maximum(t_of, 1) - p_model
    rank = np.empty(len(sizes), np.int64)
    rank[by_size] = np.arange(len(sizes))
    place = (np.cumsum(active) - active)[t_of] + np.repeat(rank, sizes)  # first tokens of all documents, then second ones
    p_of, by_place = np.empty(len(log10)), np.empty((2, len(log10)))
    by_place[:, place] = p_model, more
    logit, stop = np.full(len(sizes), OWN_BEGIN), np.cumsum(active).tolist()
    p_of[: stop[0]] = by_place[0, : stop[0]]
    for a, b in zip(stop[: max(0, together - 1)], stop[1:], strict=False):
        z, x = logit[: b - a], by_place[1, a:b]
        share = 1 / (1 + np.exp(-z))
        pull = share * x
        p_of[a:b] = p = pull + by_place[0, a:b]
        z += OWN_RATE * pull * (1 - share) / p
        np.minimum(np.maximum(z, -8, out=z), 8, out=z)
    p_of = p_of[place]
    t = max(1, together)
    for d in by_size[: int(active[t]) if t < len(active) else 0].tolist():
        a, b, z, ps = int(begin[d]) + t, int(begin[d] + sizes[d]), float(logit[rank[d]]), []
        for x, model in zip(more[a:b].tolist(), p_model[a:b].tolist(), strict=True):
            share = 1 / (1 + math.exp(-z))
            p = share * x + model
            ps.append(p)
            z += OWN_RATE * share * (1 - share) * x / p
            z = 8.0 if z > 8 else -8.0 if z < -8 else z
        p_of[a:b] = ps
    return np.add.reduceat(np.log10(p_of) + np.where(before == 0, np.minimum(0, log10 + 290), 0), begin)


def _packed(x: np.ndarray) -> bytes:
    """Numbers or bytes, compressed byte by byte of a number; what they have in the first place is their size."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpacked(raw: bytes, kind: type) -> np.ndarray:
    kind = np.dtype(kind)
    x = pa.Codec("zstd", 1).decompress(raw[8:], int.from_bytes(raw[:8], "little"))
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


@dataclass
class Stream:
    """A stream's documents as words, those to learn from first."""

    stream: int
    learn: np.ndarray  # by document
    n_bytes: np.ndarray
    sizes: np.ndarray  # tokens, with the end
    word: np.ndarray  # by token, a place in hashes
    hashes: np.ndarray  # by word, ascending
    counts: np.ndarray  # in all documents to learn from
    leads: np.ndarray  # whether the word's bytes are learned in this stream, as another stream has them otherwise
    ends: np.ndarray  # of the words' bytes
    spelt: bytes

    TYPES = {"learn": bool, "n_bytes": np.int64, "sizes": np.int64, "word": np.int32, "own": np.int32, "spelt": np.uint8}
    SCHEMA = f"stream bigint, doc_id array<bigint>, letters array<bigint>, {', '.join(f'{k} binary' for k in TYPES)}"

    @classmethod
    def of(cls, stream: int, texts: list[bytes], learn: np.ndarray, hashes: np.ndarray | None = None, counts: np.ndarray | None = None, leads: np.ndarray | None = None) -> Stream:
        """hashes: of the texts' words and of the end, ascending, where they are known."""
        low = [x.translate(_TO_LOWER) for x in texts]
        begin = np.cumsum([len(x) + 1 for x in low]) - [len(x) + 1 for x in low]
        data, cut = np.frombuffer(b" ".join(low) + b" ", np.uint8), np.searchsorted(begin, np.arange(0, int(begin[-1]) + 1, 1 << 18)).tolist()
        cut = [*dict.fromkeys(cut), len(low)]
        found = [(h, x + begin[a], y + begin[a]) for a, b in zip(cut, cut[1:], strict=False) for h, x, y in [common.word_hashes(data[begin[a] : begin[b - 1] + len(low[b - 1])], False)]]
        h, start, stop = (np.concatenate([x[i] for x in found]) for i in range(3))
        ends = np.searchsorted(start, begin + [len(x) for x in low], side="left")  # of texts, in words
        sizes = np.diff(ends, prepend=0) + 1
        every, start, stop = (np.insert(x, ends, y) for x, y in ((h, END_HASH), (start, 0), (stop, 0)))
        hashes, word = np.unique(every, return_inverse=True) if hashes is None else (hashes, np.searchsorted(hashes, every))
        which = np.empty(len(hashes), np.int64)  # one occurrence of each word
        which[word] = np.arange(len(word))
        place = np.stack([start[which], stop[which]])
        lengths = place[1] - place[0]
        end = np.searchsorted(hashes, END_HASH)
        lengths[end] = 0
        spelt = data[np.arange(int(lengths.sum())) + np.repeat(place[0] - np.cumsum(lengths) + lengths, lengths)].tobytes()
        at = int(lengths[:end].sum())
        lengths[end] = 1
        none = np.zeros(len(hashes), np.int64)
        return cls(stream, learn, np.array([len(x) for x in texts]), sizes, word, hashes, none if counts is None else counts, none > 0 if leads is None else leads, np.cumsum(lengths), spelt[:at] + b"\n" + spelt[at:])

    def row(self, ids: list) -> pa.RecordBatch:
        """What can be written before the words of all streams are counted; words are numbered by their frequency, the end is 0."""
        often = np.bincount(self.word, minlength=len(self.hashes))
        often[end := np.searchsorted(self.hashes, END_HASH)] = len(self.word) + 1
        by = np.argsort(-often, kind="stable")
        number = np.empty(len(by), np.int64)
        number[by] = np.arange(len(by))
        own = np.bincount(self.word[: self.n_learn], minlength=len(self.hashes))
        spelt = np.frombuffer(b" ".join(self.spell(by[1:])), np.uint8)
        letters = np.bincount(np.frombuffer(b" ".join(self.spell(np.flatnonzero(own))) + b" ", np.uint8), minlength=256) if self.n_learn else np.zeros(256, np.int64)
        parts = {"learn": self.learn, "n_bytes": self.n_bytes, "sizes": self.sizes, "word": number[self.word], "own": own[by], "spelt": spelt}
        columns = [pa.array([self.stream]), pa.array([ids], pa.list_(pa.int64())), pa.array([letters], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([_packed(np.asarray(parts[k], t))], pa.binary()) for k, t in self.TYPES.items())], names=["stream", "doc_id", "letters", *self.TYPES])

    @staticmethod
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(stream, learn, doc_id, text) in the order of streams, documents to learn from first -> a row for each stream."""
        for stream, group in groupby((x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)), lambda x: x[0]):
            _, learn, ids, texts = zip(*group, strict=True)
            yield Stream.of(stream, list(texts), np.array(learn)).row(list(ids))

    @staticmethod
    def words_of(x: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a row: the words' hashes, ascending, what order brings them there, and where each word's bytes begin and end."""
        h, start, stop = common.word_hashes(_unpacked(x["spelt"], np.uint8), False)
        h = np.append(END_HASH, h)
        order = np.argsort(h)
        return h[order], order, np.append(0, start)[order], np.append(0, stop)[order]

    @classmethod
    def read(cls, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Stream, list]]:
        """With the documents' ids."""
        for x in (x for batch in batches for x in batch.to_pylist()):
            part = {k: _unpacked(x[k], t) for k, t in cls.TYPES.items() if k in ("learn", "n_bytes", "sizes", "word")}
            hashes, order, start, stop = cls.words_of(x)
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            data, end = _unpacked(x["spelt"], np.uint8), int(np.searchsorted(hashes, END_HASH))
            lengths = stop - start
            spelt = data[np.arange(int(lengths.sum())) + np.repeat(start - np.cumsum(lengths) + lengths, lengths)].tobytes()
            at = int(lengths[:end].sum())
            lengths[end] = 1
            counts, leads = (_unpacked(x[k], t) if k in x else np.zeros(len(order), t) for k, t in (("counts", np.int64), ("leads", bool)))
            part["word"] = place[part["word"]]
            yield cls(stream=x["stream"], **part, hashes=hashes, counts=counts, leads=leads, ends=np.cumsum(lengths), spelt=spelt[:at] + b"\n" + spelt[at:]), x["doc_id"]

    def __post_init__(self):
        self.word = self.word.astype(np.int64)
        self.first = np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.n_learn_docs = int(self.learn.sum())
        self.n_learn = int(self.sizes[: self.n_learn_docs].sum())  # tokens

    def prefix(self) -> Stream:
        """Of the documents to learn from alone."""
        n = self.n_learn_docs
        return Stream(self.stream, self.learn[:n], self.n_bytes[:n], self.sizes[:n], self.word[: self.n_learn], self.hashes, self.counts, self.leads, self.ends, self.spelt)

    def measure(self) -> None:
        """before: how often the document had each token's word already; others: its occurrences in other documents to learn from; cls: their class."""
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        key, bits = doc * len(self.hashes) + self.word, max(1, len(doc).bit_length())
        if len(self.sizes) * len(self.hashes) < 1 << (63 - bits):
            key = np.sort(key << bits | np.arange(len(key)))
            order, key = key & ((1 << bits) - 1), key >> bits
        else:
            key = key[(order := np.argsort(key, kind="stable"))]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.diff(np.append(new, len(key)))
        self.before, own = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        self.before[order], own[order] = np.arange(len(key)) - np.repeat(new, times), np.repeat(times, times)
        self.others = np.maximum(self.counts[self.word] - np.where(self.learn[doc], own, 0), 0)
        self.cls = class_of(self.others)

    def spell(self, words: np.ndarray) -> list[bytes]:
        return [self.spelt[a:b] for a, b in zip((np.append(0, self.ends)[words]).tolist(), self.ends[words].tolist(), strict=True)]

    def spellings(self, done: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words whose bytes are known before, words to spell in documents to learn from, and in the others; in the order of their first places."""
        kinds, at = np.unique(self.word[(fresh := np.flatnonzero(~done & (self.cls == 0)))], return_index=True)
        by = np.argsort(at)
        kinds, places = kinds[by], fresh[at[by]]
        n = int(np.searchsorted(places, self.n_learn))
        seen = np.unique(self.word[: self.n_learn][self.cls[: self.n_learn] > 0])
        return np.setdiff1d(seen[self.leads[seen]], kinds[:n]), kinds[:n], kinds[n:]


def words_by_range(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """A stream's words as hashes and numbers of occurrences in documents to learn from, a row for each of 2^bits ranges of hashes."""
    for x in (x for batch in batches for x in batch.to_pylist()):
        hashes, order, *_ = Stream.words_of(x)
        own = _unpacked(x["own"], np.int32)[order].astype(np.uint64)
        part = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        v = [np.concatenate([hashes[a:b], own[a:b]]).tobytes() for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(part)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.array(np.full(len(cut), x["stream"])), pa.array(v, pa.binary())], names=["part", "stream", "v"])


def counted_words(t: pa.Table) -> pa.Table:
    """A range of hashes, a row for each stream: the occurrences of its words in all streams, and whether the stream leads: is the first to learn the word, or without such the first."""
    t = t.sort_by("stream")
    rows = [np.frombuffer(x.as_buffer(), np.uint64).reshape(2, -1) for x in t["v"]]
    hashes, own = np.concatenate([x[0] for x in rows]), np.concatenate([x[1] for x in rows]).astype(np.int64)
    kinds, which = np.unique(hashes, return_inverse=True)
    counts = np.zeros(len(kinds), np.int64)
    np.add.at(counts, which, own)
    place = np.arange(len(own)) + len(own) * (own == 0)
    first = np.full(len(kinds), 2 * len(own))
    np.minimum.at(first, which, place)
    counts, leads = counts[which], first[which] == place
    cut = np.cumsum([0, *(x.shape[1] for x in rows)]).tolist()
    v = [pa.array([_packed(x[a:b]) for a, b in zip(cut, cut[1:], strict=False)], pa.binary()) for x in (counts, leads)]
    return pa.table({"stream": t["stream"], "part": t["part"], "counts": v[0], "leads": v[1]})


def whole_counts(t: pa.Table) -> pa.Table:
    """The ranges of a stream put together, with its leading words: their number by class, and their occurrences."""
    t = t.sort_by("part")
    counts, leads = (np.concatenate([_unpacked(x.as_py(), kind) for x in t[k]]) for k, kind in (("counts", np.int64), ("leads", bool)))
    own = counts[leads]
    kind = class_of(own)
    mass = np.zeros(CLASSES + 1, np.int64)
    np.add.at(mass, kind, own)
    of_kind = [pa.array([x], pa.list_(pa.int64())) for x in (mass, np.bincount(kind, minlength=CLASSES + 1))]
    return pa.table({"stream": t["stream"][:1], "counts": pa.array([_packed(counts)], pa.binary()), "leads": pa.array([_packed(leads)], pa.binary()), "mass": of_kind[0], "kinds": of_kind[1]})


def whole_of(total: np.ndarray) -> tuple[Mixer, Mixer]:
    """The mixers of tokens and of spellings that the sum of what streams have learned makes."""
    mixer, speller = new_mixer(), Speller([], prefix_code(np.zeros(256)))
    n = len(mixer.told())
    return mixer.take(total[:n]), speller.mixer.take(total[n:])


def learned(s: Stream, followers: Followers, code: tuple, spelling: tuple) -> np.ndarray:
    """What a stream's documents to learn from tell to others."""
    s = s.prefix()
    mixer, speller = new_mixer(), Speller([], spelling)
    if len(s.word):
        s.measure()
        found = followers.guesses(s.stream, s.hashes, s.word, s.first)
        _, done = token_log2(s.word, s.cls, s.sizes, s.n_learn_docs, code, s.hashes, found, mixer, scores=False)
        seen, fresh, _ = s.spellings(done)
        speller.count(s.spell(seen))
        speller.learn(s.spell(fresh))
    return np.concatenate([mixer.told(), speller.mixer.told()])


def score_stream(s: Stream, followers: Followers, whole: tuple[Mixer, Mixer], mass: np.ndarray, code: tuple, spelling: tuple) -> dict[str, np.ndarray]:
    """n_bytes, n_tokens, n_known, base (sum of log10 of c + 1) and score of a stream's documents; mass: tokens by class, of class 0 the expected ones.

    whole: what all streams have learned, of tokens and of spellings. For documents to learn from, the stream's own counts are taken out of it again, but for
    spellings of words that other documents have too.
    """
    s.measure()
    found = followers.guesses(s.stream, s.hashes, s.word, s.first)
    log2, done = token_log2(s.word, s.cls, s.sizes, s.n_learn_docs, code, s.hashes, found, whole=whole[0])
    of_word = ~done & (s.cls > 0)
    log2[of_word] += np.log2(s.others[of_word] / np.maximum(mass[s.cls[of_word]], s.others[of_word]))
    _, *fresh = s.spellings(done)
    speller, cost = Speller([], spelling), np.zeros(len(s.hashes))
    if len(fresh[0]):
        words = s.spell(fresh[0])
        bits = speller.count(words)
        speller.mixer = whole[1].without(speller.mixer.counts)
        cost[fresh[0]] = speller.log2(words, False, bits)
    if len(fresh[1]):
        speller.mixer = whole[1]
        cost[fresh[1]] = speller.log2(s.spell(fresh[1]), False)
    log2 += np.where(~done & (s.cls == 0), cost[s.word], 0)
    begin, c = np.cumsum(s.sizes) - s.sizes, s.counts[s.word]
    return {
        "n_bytes": s.n_bytes,
        "n_tokens": s.sizes,
        "n_known": np.add.reduceat((c > 0).astype(np.int64), begin),
        "base": np.add.reduceat(np.log10(c + 1), begin),
        "score": adapted(log2 * math.log10(2), s.before, s.sizes),
    }


def _chunks(x: np.ndarray) -> Iterator[pa.RecordBatch]:
    x = x.ravel()
    for i in range(0, len(x), CHUNK):
        yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK]), pa.array([x[i : i + CHUNK].tobytes()], pa.binary())], names=["chunk", "v"])


def _together(streams: DataFrame, task, merge) -> np.ndarray:
    """What the tasks over streams yield in chunks, merged chunk by chunk; its length doesn't depend on the input."""

    def merged(t: pa.Table) -> pa.Table:
        parts = (np.frombuffer(x.as_buffer(), np.uint64) for x in t["v"])
        out = next(parts).copy()
        for x in parts:
            out = merge(out, x)
        return pa.table({"chunk": t["chunk"][:1], "v": pa.array([out.tobytes()], pa.binary())})

    few = streams.coalesce(2 * streams.sparkSession.sparkContext.defaultParallelism)  # each task tells a whole table, however many streams it has
    rows = few.mapInArrow(task, "chunk bigint, v binary").groupBy("chunk").applyInArrow(merged, "chunk bigint, v binary").collect()
    return np.frombuffer(b"".join(bytes(r.v) for r in sorted(rows, key=lambda r: r.chunk)), np.uint64)


def _merge_followers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tables of a chunk as slots of two entries of three numbers."""
    two = np.ascontiguousarray(a.reshape(-1, 2, 3).transpose(1, 2, 0))
    for layer in b.reshape(-1, 2, 3).transpose(1, 2, 0):
        Followers.insert(two, np.arange(two.shape[2]), layer)
    return two.transpose(2, 0, 1).ravel()


def _written(df: DataFrame, what: str) -> DataFrame:
    """As common.written; what is packed already is written as it is, in row groups of a stream's size."""
    path, schema = common.shared_dir(df.sparkSession, what), df.schema
    df.write.option("compression", "none").option("parquet.block.size", STREAM_BYTES).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def fit_and_score(docs: DataFrame, learn: str) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, learn (boolean), n_bytes, n_tokens, n_known, train_tokens, base_score, score.

    The rows for which the SQL condition learn holds are learned from, all of them; such a row is scored by the counts of the others and by what other
    streams have learned. A null text is an empty one: its only token is the end. Rows, repeated ones too, stay one for one; other columns are
    ignored. Without any row to learn from, a word's probability is that of its spelling. Results do not depend on
    the partitions of docs or of shuffles.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.expr(f"coalesce({learn}, false)").alias("learn"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    n_streams = -(-max(1, rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // STREAM_BYTES)
    n_streams = min(max(n_streams, LEAST_STREAMS), 1 << STREAM_BITS)
    rows = rows.withColumn("place", F.xxhash64("doc_id", "text")).withColumn("stream", F.pmod("place", F.lit(n_streams)))
    rows = rows.repartition("stream").sortWithinPartitions("stream", F.desc("learn"), "place", "doc_id").select("stream", "learn", "doc_id", "text")
    streams = _written(rows.mapInArrow(Stream.rows, Stream.SCHEMA), "token-streams")
    bits = max(6, (n_streams // 4).bit_length())  # words of some streams' length in each range
    parts = streams.select("stream", "own", "spelt").mapInArrow(lambda batches: words_by_range(batches, bits), "part bigint, stream bigint, v binary")
    parts = parts.groupBy("part").applyInArrow(counted_words, "stream bigint, part bigint, counts binary, leads binary")
    counts = _written(parts.groupBy("stream").applyInArrow(whole_counts, "stream bigint, counts binary, leads binary, mass array<bigint>, kinds array<bigint>"), "word-counts")

    def summed(df: DataFrame, column: str, n: int) -> np.ndarray:
        found = df.select(F.posexplode(column).alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()
        out = np.zeros(n, np.int64)
        out[[r.i for r in found]] = [r.n for r in found]
        return out

    mass, kinds = summed(counts, "mass", CLASSES + 1).astype(np.float64), summed(counts, "kinds", CLASSES + 1)
    n_all, n_kinds = int(mass.sum()), int(kinds[1:].sum())
    mass[0] = max(1.0, mass[1])  # as many new words as words that occur once
    code = prefix_code(np.concatenate([mass, np.zeros(256 - len(mass))]))
    spelling = prefix_code(summed(streams, "letters", 256))
    counted = streams.drop("own", "letters").join(counts.drop("mass", "kinds"), "stream")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Followers()
        for s, _ in Stream.read(batches):
            p = s.prefix()
            found.learn(s.stream, s.hashes[p.word], p.first)
        for i, two in enumerate(found.table):  # slots of one chunk have their entries together
            x = np.ascontiguousarray(two.transpose(2, 0, 1)).reshape(-1, 6 * (1 << 11))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x)) + i * len(x)), pa.array([y.tobytes() for y in x], pa.binary())], names=["chunk", "v"])

    table = _together(streams.drop("own", "letters"), follow, _merge_followers).reshape(len(GUESSES), -1, 2, 3).transpose(0, 2, 3, 1)
    followers = spark.sparkContext.broadcast(np.ascontiguousarray(table))

    def learn_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for s, _ in Stream.read(batches):
            total = total + learned(s, Followers(followers.value), code, spelling)
        if not np.isscalar(total):
            yield from _chunks(total)

    total = spark.sparkContext.broadcast(_together(counted, learn_all, np.add).view(np.int64))

    def score_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for s, ids in Stream.read(batches):
            whole = whole or whole_of(total.value)  # without any row nothing is told
            found = score_stream(s, Followers(followers.value), whole, mass, code, spelling)
            found["base"] = found["base"] - found["n_tokens"] * math.log10(n_all + 1 * (n_kinds + 1))
            columns = [pa.array(ids, pa.int64()), pa.array(s.learn), *(pa.array(found[k]) for k in ("n_bytes", "n_tokens", "n_known", "base", "score"))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "learn", "n_bytes", "n_tokens", "n_known", "base_score", "score"])

    out = counted.mapInArrow(score_all, "doc_id bigint, learn boolean, n_bytes bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(n_all).cast("bigint"))


HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 7 = 2, true)"


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without doc_id counts as held out. bits_per_byte: of the whole text, null where it has no byte."""
    out = fit_and_score(common.documents(spark, sf_dir).select("doc_id", "text"), f"not ({HELD_OUT})")
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", F.expr(f"try_divide(-score * {math.log2(10)}, n_bytes)").alias("bits_per_byte"))


QUERIES = {"op6_context_mixing": op6_context_mixing}
ORACLES: dict[str, str] = {}
