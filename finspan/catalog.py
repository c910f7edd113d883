"""All queries of the library and their SQL twins, by name."""

from finspan.plans import catalogs, corpus, market, mentions, past, portfolio, review, snapshots, stream, universe

MODULES = (market, portfolio, snapshots, corpus, universe, review, stream, catalogs, mentions, past)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLES.items()}
