"""SQL of the views, for the queries' twins."""

from __future__ import annotations

from collections.abc import Callable


def panel(grain: str = "week", key: str = "p_brand") -> str:
    return f"""SELECT CAST(date_trunc('{grain}', l_shipdate) AS DATE) AS date, {key} AS ticker,
CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS close, sum(l_quantity) AS volume
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""


def history(name: str = "r", grain: str = "week", key: str = "p_brand") -> str:
    """CTEs up to {name}: date, ticker, close, volume, seq, ret."""
    n = name
    return f"""{n}_p AS ({panel(grain, key)}), {n}_n AS (SELECT date, count(*) AS n FROM {n}_p GROUP BY date),
{n}_c AS (SELECT date, row_number() OVER (ORDER BY date) AS seq FROM {n}_n WHERE n >= 0.5 * (SELECT max(n) FROM {n}_n)),
{n} AS (SELECT p.*, c.seq, CASE WHEN lag(c.seq) OVER w = c.seq - 1 THEN 100 * (close / lag(close) OVER w - 1) END AS ret
FROM {n}_p p JOIN {n}_c c ON p.date = c.date WINDOW w AS (PARTITION BY ticker ORDER BY c.seq)),
{n}_l AS (SELECT max(seq) AS last FROM {n})"""


LOTS = """lots AS (SELECT c_mktsegment AS broker, CAST(c_nationkey AS VARCHAR) AS account, p_brand AS symbol,
CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_quantity AS quantity, l_extendedprice / l_quantity AS avg_price,
CAST(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_extendedprice AS DECIMAL(18,2)) AS market_value,
CASE WHEN l_linenumber < 7 THEN CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * (CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) END AS open_pnl
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""

TAGS = """tags AS (SELECT DISTINCT p_brand AS ticker, split_part(p_name, ' ', o) AS tag, CASE WHEN o = 1 THEN 'Style' ELSE 'Sector' END AS axis, o - 1 AS ord
FROM part, (VALUES (1), (2)) v(o))"""

CROSS = "p_brand || '/' || p_type"
UNIVERSE = f"universe AS (SELECT DISTINCT {CROSS} AS ticker, p_type AS tier1, p_brand AS tier2 FROM part)"


def as_of(sql: str, date: str) -> str:
    """A query's SQL over what was known at the end of a day."""
    facts = ", ".join(f"{t} AS (SELECT * FROM main.{t} WHERE {c} < DATE '{date}' + INTERVAL 1 DAY)" for t, c in (("lineitem", "l_shipdate"), ("orders", "o_orderdate")))
    return f"WITH {facts}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {facts} {sql}"


def registry() -> tuple[dict, dict[str, str], Callable]:
    """A module's queries, their SQL twins, and the decorator that enters both by the function's name."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query
