"""Queries over mentions in the documents: places and contexts, and candidates validated, scored and put into JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from finspan.functions import mentions as M
from finspan.plans.sqlbase import panel, registry
from finspan.sources.panels import prices, table
from finspan.sources.sinks import written

QUERIES, ORACLES, query = registry()

#: The tables have no ticker symbols: short capitalised words stand for them, before a full stop or bare.
RULES = M.Rules(
    patterns=(("sentence", r"([A-Z][a-z]{1,4})\."), ("bare", r"\b([A-Z][a-z]{1,4})\b")), keywords=("and", "the", "tion", "ing", "der", "que"), hints=("$", ":"), paths=("/",), blocked=frozenset(["THE", "DIE", "AND"]),
    ambiguous=frozenset(["OF", "IN", "TO"]),
)


def _places(evidence: str, pattern: str) -> str:
    """Places of a pattern's matches: what stands before each, added up."""
    return f"""{evidence}_s AS (SELECT doc_id, source, text, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', 1) AS g FROM documents WHERE text IS NOT NULL),
{evidence}_u AS (SELECT doc_id, source, text, unnest(p) AS p, unnest(list_append(m, NULL)) AS m, unnest(list_append(g, NULL)) AS g, unnest(range(len(p))) AS i FROM {evidence}_s WHERE len(m) > 0),
{evidence} AS (SELECT doc_id, source, text, upper(g) AS symbol, len(g) AS size, '{evidence}' AS evidence, CAST(sum(len(p)) OVER w + sum(len(m)) OVER w - len(m) AS INTEGER) AS start
FROM {evidence}_u WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""


_MENTIONS = f"""{_places("sentence", RULES.patterns[0][1])}, {_places("bare", RULES.patterns[1][1])},
n AS (SELECT *, lower(substring(text, CAST(greatest(0, start - 90) + 1 AS BIGINT), start + size + 90 - greatest(0, start - 90))) AS near FROM bare WHERE symbol IS NOT NULL AND symbol NOT IN ('OF', 'IN', 'TO')),
h AS (SELECT *, list_sum([CAST(contains(near, x) AS INT) FOR x IN ['and', 'the', 'tion', 'ing', 'der', 'que']]) AS hits FROM n),
a AS (SELECT doc_id, source, text, symbol, size, evidence, start FROM h WHERE hits >= 2 OR contains(near, '/' || lower(symbol)) OR (hits >= 1 AND (contains(near, '$') OR contains(near, ':')))
UNION ALL SELECT doc_id, source, text, symbol, size, evidence, start FROM sentence WHERE symbol IS NOT NULL),
found AS (SELECT doc_id, source, symbol, evidence, start, trim(regexp_replace(substring(text, CAST(greatest(0, start - 100) + 1 AS BIGINT), start + size + 100 - greatest(0, start - 100)), '\\s+', ' ', 'g')) AS context FROM a WHERE symbol NOT IN ('THE', 'DIE', 'AND')),
c AS (SELECT symbol, count(DISTINCT doc_id) AS n_docs, count(*) AS n_mentions, count(DISTINCT source) AS n_sources, array_to_string(list_sort(list(DISTINCT evidence)), ',') AS evidence FROM found GROUP BY 1),
o AS (SELECT symbol, context, min(struct_pack(doc_id := doc_id, start := start)) AS place FROM found GROUP BY 1, 2),
f AS (SELECT symbol, context, row_number() OVER (PARTITION BY symbol ORDER BY place, context) AS k FROM o)"""


@query(f"WITH {_MENTIONS} SELECT c.*, string_agg(context, ' | ' ORDER BY k) AS contexts FROM c JOIN f ON f.symbol = c.symbol WHERE k <= 3 GROUP BY ALL")
def mention_contexts(spark, sf):
    """Candidates of all documents with their evidence and first contexts."""
    c = M.candidates(written(M.mentions(table(spark, sf, "documents"), ["doc_id", "source"], rules=RULES), "mentions"), "doc_id", "source")
    return c.withColumn("evidence", F.array_join("evidence", ",")).withColumn("contexts", F.array_join("contexts", " | "))


#: Candidates of which the history is asked for.
ANALYSED = 40


@query(
    f"""WITH {_MENTIONS}, r AS (SELECT *, row_number() OVER (ORDER BY contains(evidence, 'sentence') DESC, n_sources DESC, n_docs DESC, n_mentions DESC, symbol) AS rank FROM c QUALIFY rank <= {ANALYSED}),
b AS (SELECT p_brand AS ticker, row_number() OVER (ORDER BY p_brand) AS nth FROM (SELECT DISTINCT p_brand FROM part)), t AS (SELECT r.*, b.ticker FROM r LEFT JOIN b ON nth = rank),
p AS ({panel("week")}), k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM p WHERE close IS NOT NULL),
q AS (SELECT ticker, count(*) AS n_days, max(CASE WHEN k = 1 THEN volume END) AS volume, round(avg(CASE WHEN k > 1 THEN volume END), 4) AS avg_volume,
round(100 * (max(CASE WHEN k = 1 THEN close END) / max(CASE WHEN k = 2 THEN close END) - 1), 4) AS d, round(100 * (max(CASE WHEN k = 1 THEN close END) / max(CASE WHEN k = 6 THEN close END) - 1), 4) AS w FROM k WHERE k <= 21 GROUP BY 1),
s AS (SELECT t.symbol, t.rank, n_docs, n_sources, d, w, CASE WHEN q.ticker IS NULL THEN 'no_history' WHEN n_days < 15 THEN 'insufficient_history' END AS no, round(volume / avg_volume, 4) AS spike FROM t LEFT JOIN q ON q.ticker = t.ticker),
y AS (SELECT *, CAST(coalesce(spike >= 1.5, false) AS INT) + CAST(coalesce(abs(d) >= 5, false) AS INT) + CAST(coalesce(abs(w) >= 10, false) AS INT) + CAST(n_sources >= 5 AS INT) AS n_reasons FROM s)
SELECT symbol, CAST(rank AS INT) AS rank, n_docs, n_sources, CASE WHEN no IS NOT NULL THEN no WHEN n_reasons = 0 THEN 'no_trigger' END AS rejected, CASE WHEN no IS NULL AND n_reasons > 0 THEN n_reasons END AS n_reasons,
CASE WHEN no IS NULL AND n_reasons > 0 THEN round(10 * least(coalesce(spike, 0), 5) + 2 * least(abs(coalesce(d, 0)), 10) + least(abs(coalesce(w, 0)), 20) + 3 * n_sources, 1) END AS score FROM y"""
)
def scored_candidates(spark, sf):
    """The first candidates by priority with the history of their tickers: rejected with a reason, or qualified with reasons and a score.

    Each goes through a JSON record and is read back by its schema; records that don't have it would raise.
    """
    found = M.mentions(table(spark, sf, "documents"), ["doc_id", "source"], rules=RULES)
    few = M.ranked(M.candidates(written(found, "mentions"), "doc_id", "source"), ANALYSED, "sentence")
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("ticker")).distinct()  # stand for the symbols' tickers, in order
    nth = brands.groupBy().agg(F.array_sort(F.collect_set("ticker")).alias("t")).select(F.posexplode("t").alias("nth", "ticker"))
    history = M.profiles(prices(spark, sf))
    j = few.join(nth, few["rank"] == nth["nth"] + 1, "left").join(history, "ticker", "left")
    no = F.when(F.col("n_days").isNull(), "no_history").otherwise(F.col("rejected"))
    j = j.withColumn("reasons", M.reasons(1.5, 5, 10, 5)).withColumn("rejected", F.when(no.isNotNull(), no).when(F.size("reasons") == 0, "no_trigger"))
    size = lambda c: F.abs(F.coalesce(c, F.lit(0.0)))
    score = 10 * F.least(F.coalesce("volume_spike", F.lit(0.0)), F.lit(5.0)) + 2 * F.least(size("change_1"), F.lit(10.0)) + F.least(size("change_5"), F.lit(20.0)) + 3 * F.col("n_sources")
    j = j.withColumn("score", F.when(F.col("rejected").isNull(), F.round(score, 1))).withColumn("reasons", F.when(F.col("rejected").isNull(), F.col("reasons")))
    fields = ["symbol", "rank", "n_docs", "n_sources", "evidence", "contexts", "rejected", "reasons", "score"]
    record = F.to_json(F.struct(*fields))
    back = j.select(F.from_json(record, j.select(*fields).schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return back.select("symbol", "rank", "n_docs", "n_sources", "rejected", F.when(F.col("reasons").isNotNull(), F.size("reasons")).alias("n_reasons"), "score")
