"""Language identification by cross-parsing.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is parsed greedily
into the longest phrases that occur in the sample; phrases * log2(sample length) / text length estimates
the cross entropy of the text under the language, and the least wins. The automata are laid out as one table, and
all texts and languages of a batch are parsed in step, by numpy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finspan.llm import common

#: The bound of the sample: whole documents a language, up to the one with which they reach so many characters; longer ones are
#: taken only where there are no others, and those beyond LONGEST never.
SAMPLE_DOCS, SAMPLE_CHARS, LONGEST = 16, 24_000, 1_000_000
#: Pieces of so many symbols of a text are parsed side by side; each then goes on from where the piece before it ended.
PIECE = 1024


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its lower case where that is one character."""
    is_letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            is_letter[i] = True
            if len(x := c.lower()) == 1:
                lower[i] = ord(x)
    return is_letter, lower


def symbols(text: str) -> np.ndarray:
    """Lower-case letters as code points, with one 32 for each run of others, none at the ends."""
    is_letter, lower = _letters()
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    good = is_letter[raw]
    out = np.where(good, lower[raw], np.uint32(32))
    keep = good.copy()
    keep[1:] |= good[:-1]  # the first of each run of others
    out = out[keep]
    if len(out) and out[0] == 32:
        out = out[1:]
    return out[:-1] if len(out) and out[-1] == 32 else out


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the states; the first is the root. Every path from the root spells a substring."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Model:
    """The automata of all languages as one table, row by state and column by symbol class.

    An entry holds the next row's place * 4, and phrases begun by the step: 0, 1, or 2 for a symbol that the language
    lacks, which is a phrase of its own and leads to the root, where the next phrase already counts as begun.
    """

    def __init__(self, samples: dict[str, list[np.ndarray]]):
        self.languages = sorted(samples)
        found = sorted({int(x) for parts in samples.values() for p in parts for x in np.unique(p)} | {32})
        self.width = len(found) + 1
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[found] = np.arange(1, self.width)
        tables, self.roots, self.bits, rows = [], [], [], 0
        for name in self.languages:
            text: list[int] = []
            for p in samples[name]:
                text += [*self.classes[p].tolist(), int(self.classes[32])]
            step = suffix_automaton(text)
            table = np.full((len(step), self.width), -1, np.int64)
            for i, d in enumerate(step):
                if d:
                    table[i, list(d)] = list(d.values())
            root = table[0].copy()
            begin = np.where(root >= 0, (root + rows) * self.width * 4 + 1, rows * self.width * 4 + 2)
            tables.append(np.where(table >= 0, (table + rows) * self.width * 4, begin[None, :]))
            tables[-1][0, root < 0] -= 1
            self.roots.append(rows * self.width)
            self.bits.append(math.log2(max(2, len(text))))
            rows += len(step)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int64)
        if len(self.table) * 4 < 2**31:
            self.table = self.table.astype(np.int32)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (row) under each language (column)."""
        n_lang, kind = len(self.languages), self.table.dtype
        out = np.zeros((len(texts), n_lang), np.int64)
        sizes = np.array([len(x) for x in texts])
        pieces = -(-sizes // PIECE)
        if not pieces.sum():
            return out
        flat = self.classes[np.concatenate(texts)].astype(kind)
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (np.cumsum(sizes) - sizes)[owner] + nth * PIECE
        length = np.minimum(sizes[owner] - nth * PIECE, PIECE)
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        later, last = nth[order] > 0, (nth + 1 == pieces[owner])[order]
        before, after = place[np.maximum(order - 1, 0)], place[np.minimum(order + 1, len(order) - 1)]
        owner, begin, length = owner[order], begin[order], length[order]
        roots = np.array(self.roots, kind)
        state = np.repeat(roots[:, None], len(owner), 1)
        count = np.zeros(state.shape, np.int32)
        many = np.searchsorted(-length, -np.arange(length[0]), side="left")  # pieces longer than t
        for t in range(length[0]):
            m = many[t]
            v = self.table[state[:, :m] + flat[begin[:m] + t]]
            if not t:
                v[:, ~later[:m]] += 1  # the first phrase of a text
            count[:, :m] += v & 3
            state[:, :m] = v >> 2
        self._carry(flat, begin, length, later, last, before, after, state, count)
        count -= (state == roots[:, None]) & last  # no phrase came
        for i in range(n_lang):
            out[:, i] = np.bincount(owner, count[i], len(texts)).astype(np.int64)
        return out

    def _carry(self, flat, begin, length, later, last, before, after, state, count) -> None:
        """Correct states and counts (language x piece) of pieces parsed from the root to go on from the piece before.

        A piece is parsed again from where it must begin, beside the parse that it had, until both are in one state.
        """
        begun = np.repeat(np.array(self.roots, state.dtype)[:, None], len(begin), 1)
        lang, piece = np.nonzero(later & (state[:, before] != begun))
        while len(piece):
            a, b = begun[lang, piece], state[lang, before[piece]]
            begun[lang, piece] = b
            more, live, ended, t = np.zeros(len(piece), np.int64), np.arange(len(piece)), [], 0
            while len(live):
                on = length[piece[live]] > t
                ended.append(live[~on])
                live = live[on]
                c = flat[begin[piece[live]] + t]
                va, vb = self.table[a[live] + c], self.table[b[live] + c]
                more[live] += (vb & 3).astype(np.int64) - (va & 3)
                a[live], b[live] = va >> 2, vb >> 2
                live = live[a[live] != b[live]]
                t += 1
            count[lang, piece] += more.astype(count.dtype)
            ended = np.concatenate(ended)
            lang, piece = lang[ended], piece[ended]
            state[lang, piece] = b[ended]
            go = ~last[piece]
            lang, piece = lang[go], after[piece[go]]
            go = state[lang, before[piece]] != begun[lang, piece]
            lang, piece = lang[go], piece[go]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and a score of each text: the share by which the second-best needs more than the best."""
        parsed = [symbols(x) if x else np.zeros(0, np.uint32) for x in texts]
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        cost = self.phrases(parsed) * np.array(self.bits)
        best = cost.argmin(1)
        ordered = np.sort(cost, 1)
        second = ordered[:, 1] if cost.shape[1] > 1 else np.full(len(texts), np.inf)
        score = 1 - ordered[:, 0] / np.maximum(second, 1e-9)
        blank = [not len(x) for x in parsed]
        return ["und" if b else self.languages[i] for b, i in zip(blank, best, strict=True)], [0.0 if b else float(min(1, max(0, s))) for b, s in zip(blank, score, strict=True)]


def fit(docs: DataFrame, learn: str, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model from the rows of docs (doc_id, text, lang) for which the SQL condition learn holds.

    Of each language the sample_docs documents with the least hash of doc_id are taken, whole, in this order until
    they have sample_chars characters, so what comes to the driver has a bound for each language.
    """
    good = docs.where(learn).where(f"lang is not null and length(text) <= {LONGEST} and text rlike '\\\\p{{L}}'").select("lang", "doc_id", "text", (F.length("text") > sample_chars).alias("long"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id"), "doc_id", "text"))
    samples: dict[str, list[np.ndarray]] = {}
    for r in good.withColumn("nth", nth).where(F.col("nth") <= sample_docs).orderBy("lang", "nth").toLocalIterator():
        taken = samples.setdefault(r.lang, [])
        if sum(map(len, taken)) < sample_chars:
            taken.append(symbols(r.text))
    return Model(samples)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of each row of docs (doc_id, text), by its whole text; `und` without a letter or a text."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            parts = np.cumsum([len(x or "") for x in texts]) >> 22
            names: list[str] = []
            scores: list[float] = []
            for part in np.unique(parts):
                a, b = shared.value.predict([texts[i] for i in np.flatnonzero(parts == part)])
                names += a
                scores += b
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, true)"


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without doc_id counts as held out."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = predict(docs, fit(docs, f"not ({HELD_OUT})"))
    return found.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
ORACLES: dict[str, str] = {}
