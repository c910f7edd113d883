"""Mentions of symbols in texts, with their places and contexts, and what they add up to."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
#: Patterns by kind of evidence, whose first group is the symbol.
PATTERNS = {
    "dollar": r"\$([A-Z][A-Z\.-]{0,4})\b",
    "exchange": r"\b(?i:NASDAQ|NYSE|NYSEARCA|NYSEAMERICAN|AMEX|OTC|TSX|LSE)\s*[:\-]\s*([A-Za-z][A-Za-z\.-]{0,4})\b",
    "site_path": r"/(?i:stock|stocks)/([A-Za-z][A-Za-z\.-]{0,4})(?:[/?#]|\b)",
    "bare": r"\b([A-Z]{2,5})\b",
}
#: Words of which a bare symbol needs two near it, or one beside an explicit hint.
KEYWORDS = (
    "stock stocks shares ticker tickers call calls put puts squeeze short volume bullish bearish yolo reddit meme float gamma wallstreetbets stocktwits"
).split()
HINTS = "$ ticker stock shares".split()
#: Capitals that are no symbols, large ones that are of no interest, and words that a bare symbol is taken for.
BLOCKED = (
    "THE AND FOR ARE BUT NOT YOU ALL CAN HER WSB CEO USA API ETF IPO FAQ PDF URL SEC IT GO AM SO UP AT IN ON TO OF OR BY GET NEW NOW DAY SEE USE TOP HOT BIG LOW "
    "HIGH LONG PUT CALL BUY SELL INC LLC LTD PLC CORP CO GROUP HOLD HOLDING HOLDINGS BANK NYSE NASDAQ JAMES JOHN JULIE CHASE HOYLE "
    "SPY QQQ VOO IWM DIA VIX TQQQ SQQQ NVDA AAPL MSFT GOOGL GOOG AMZN META TSLA TSM"
).split()
AMBIGUOUS = "AI AN ANY AS BACK BE CASH COM FREE HAS HERE MOST MORE NEXT OUT REAL SOME TIME TWO VIEW YEAR".split()
#: Characters on each side of a symbol: of the context that is kept, and of the one that is searched for keywords.
CONTEXT, NEAR = 100, 90


@dataclass(frozen=True)
class Rules:
    """What counts as a mention. Evidence of the kinds in `weak` needs keywords near it."""

    patterns: tuple[tuple[str, str], ...] = tuple(PATTERNS.items())
    weak: tuple[str, ...] = ("bare",)
    keywords: tuple[str, ...] = tuple(KEYWORDS)
    hints: tuple[str, ...] = tuple(HINTS)
    #: A path that makes any symbol explicit, with the symbol in lower case behind it.
    paths: tuple[str, ...] = ("/stock/", "/stocks/")
    blocked: frozenset[str] = frozenset(BLOCKED)
    ambiguous: frozenset[str] = frozenset(AMBIGUOUS)
    context: int = CONTEXT
    near: int = NEAR

    def symbol(self, raw: str) -> str | None:
        """A symbol in its normal form, null if it is blocked."""
        s = raw.upper().strip("$").replace(".", "-")
        return s if 2 <= len(s) <= 5 and s not in self.blocked else None

    def supported(self, symbol: str, text: str, start: int, end: int) -> bool:
        """Whether what stands near a weak mention speaks for it."""
        if symbol in self.ambiguous:
            return False
        near = text[max(0, start - self.near) : end + self.near].lower()
        hits = sum(k in near for k in self.keywords)
        return hits >= 2 or any(p + symbol.lower() in near for p in self.paths) or hits >= 1 and any(h in near for h in self.hints)


_BLANK = re.compile(r"\s+", re.ASCII)


def find(text: str, rules: Rules) -> Iterator[tuple[str, str, int, str]]:
    """symbol, evidence, start and context of each mention; a place may be evidence of several kinds."""
    for evidence, pattern in rules.patterns:
        for m in re.compile(pattern, re.ASCII).finditer(text):
            symbol = rules.symbol(m[1])
            start, end = m.span(1)
            if symbol and (evidence not in rules.weak or rules.supported(symbol, text, start, end)):
                yield symbol, evidence, start, _BLANK.sub(" ", text[max(0, start - rules.context) : end + rules.context]).strip()


def mentions(docs: DataFrame, keys: list[str], text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(keys, symbol, evidence, start, context) of all mentions in whole texts; start counts characters from 0. A null text has none."""
    kinds = [docs.schema[k].dataType.simpleString() for k in keys]
    schema = ", ".join(f"`{k}` {t}" for k, t in zip(keys, kinds, strict=True)) + ", symbol string, evidence string, start int, context string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []

            def made() -> pa.RecordBatch:
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                own = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)]
                return pa.RecordBatch.from_arrays([c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]] + own, names=[*keys, "symbol", "evidence", "start", "context"])

            for i, t in enumerate(batch.column(len(keys)).to_pylist()):
                for row in find(t or "", rules):
                    at.append(i)
                    rows.append(row)
                    if len(rows) >= 10_000:
                        yield made()
                        at, rows = [], []
            yield made()

    return docs.select(*keys, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def candidates(found: DataFrame, doc: str, source: str, samples: int = 3) -> DataFrame:
    """(symbol, n_docs, n_mentions, n_sources, evidence, contexts) of mentions with the columns doc and source.

    evidence: kinds, sorted. contexts: the first `samples` different ones by document and place.
    """
    g = found.groupBy("symbol").agg(
        F.count_distinct(doc).alias("n_docs"), F.count("*").alias("n_mentions"), F.count_distinct(source).alias("n_sources"), F.array_sort(F.collect_set("evidence")).alias("evidence")
    )
    first = found.groupBy("symbol", "context").agg(F.min(F.struct(doc, "start")).alias("at"))
    nth = F.row_number().over(Window.partitionBy("symbol").orderBy("at", "context"))
    few = first.withColumn("k", nth).where(F.col("k") <= samples).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("k", "context")))["context"].alias("contexts"))
    return g.join(few, "symbol")


def ranked(df: DataFrame, most: int, *explicit: str) -> DataFrame:
    """The first candidates by explicit evidence, sources, documents, mentions and name, with their rank; as many as asked for."""
    strong = F.size(F.array_intersect("evidence", F.array(*map(F.lit, explicit))))
    order = [F.desc(strong > 0), F.desc("n_sources"), F.desc("n_docs"), F.desc("n_mentions"), F.asc("symbol")]
    few = df.orderBy(*order).limit(most)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # of most rows


def profiles(prices: DataFrame, least: int = 15, window: int = 20) -> DataFrame:
    """(ticker, n_days, volume, avg_volume, volume_spike, change_1, change_5, rejected) of prices (ticker, date, close, volume) with a close.

    volume_spike: the last volume over the mean of up to `window` before it. changes: of the last close over that of 1 and 5 rows before, in percent.
    """
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    p = prices.where("close is not null").withColumn("k", F.row_number().over(w)).where(F.col("k") <= F.lit(max(window + 1, 6, least)))
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    change = lambda n: F.round(100 * (F.try_divide(at(1, "close"), at(1 + n, "close")) - 1), 4)
    before = F.avg(F.when((F.col("k") > 1) & (F.col("k") <= window + 1), F.col("volume")))
    g = p.groupBy("ticker").agg(F.count("*").alias("n_days"), at(1, "volume").alias("volume"), F.round(before, 4).alias("avg_volume"), change(1).alias("change_1"), change(5).alias("change_5"))
    return g.withColumn("volume_spike", F.round(F.try_divide("volume", "avg_volume"), 4)).withColumn("rejected", F.when(F.col("n_days") < least, "insufficient_history"))


def reasons(spike: float, day: float, week: float, many: int) -> Column:
    """What speaks for a candidate: its volume, its moves, and how many sources name it."""
    said = [
        F.when(F.col("volume_spike") >= spike, F.format_string("volume %.1fx", "volume_spike")),
        F.when(F.abs("change_1") >= day, F.format_string("1d %+.1f%%", "change_1")),
        F.when(F.abs("change_5") >= week, F.format_string("5d %+.1f%%", "change_5")),
        F.when(F.col("n_sources") >= many, F.format_string("%d sources", "n_sources")),
    ]
    return F.array_compact(F.array(*said))
