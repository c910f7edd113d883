"""Reports as a past day had them: plans of the market and the portfolio over what was known then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from finspan.plans import market, portfolio
from finspan.plans.sqlbase import as_of
from finspan.sources.panels import AsOf

DAY = "1996-05-17"
#: Any plan takes an AsOf folder; these are entered as queries.
NAMES = ("tier1_summary", "ytd_return", "streaks", "portfolio_summary")


def _then(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: plan(spark, AsOf(sf, DAY))


_PLANS, _SQL = market.QUERIES | portfolio.QUERIES, market.ORACLES | portfolio.ORACLES
QUERIES = {f"{n}_as_of": _then(_PLANS[n]) for n in NAMES}
ORACLES = {f"{n}_as_of": as_of(_SQL[n], DAY) for n in NAMES}
