"""Reads from a registry of portfolios: every predicate is optional, and only those that are given are applied, inside the source where it can."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finspan.sources import sqlite


@dataclass(frozen=True)
class Catalog:
    """A SQLite catalog; any number of them can be open, for reading, at once."""

    spark: SparkSession
    path: str

    def table(self, name: str, columns: list[str] | None = None, first: date | None = None, last: date | None = None, **equal) -> DataFrame:
        """Rows with a date from first to last, both included, and these values in these columns; None asks for nothing, a list for any of its values."""
        where = [("date", op, d) for op, d in ((">=", first), ("<=", last)) if d is not None]
        where += [(c, "in" if isinstance(v, list | tuple | set) else "=", sorted(v) if isinstance(v, set) else v) for c, v in equal.items() if v is not None]
        return sqlite.read(self.spark, self.path, name, columns, where)


def portfolios(catalog: Catalog, portfolio_id: str | None = None, active: bool | None = True) -> DataFrame:
    """Portfolios of the registry (portfolio_id, portfolio_name, is_active, ...), the active ones unless told otherwise."""
    return catalog.table("portfolios", portfolio_id=portfolio_id, is_active=active)


def holdings(catalog: Catalog, portfolio_id: str | None = None, on: date | None = None, resolved_only: bool = True) -> DataFrame:
    """Holdings (portfolio_id, date, ticker, resolution_status, ...) of a portfolio and a date, resolved ones unless told otherwise."""
    return catalog.table("portfolio_holdings", first=on, last=on, portfolio_id=portfolio_id, resolution_status="resolved" if resolved_only else None)


def holdings_until(catalog: Catalog, last: date | None = None, portfolio_id: str | None = None) -> DataFrame:
    """All holdings of dates not after last."""
    return catalog.table("portfolio_holdings", last=last, portfolio_id=portfolio_id)


def latest(rows: DataFrame, by: str = "portfolio_id") -> DataFrame:
    """Each portfolio's rows of its last date."""
    last = rows.groupBy(by).agg(F.max("date").alias("date"))
    return rows.join(last, [by, "date"])


def summary(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Positions, resolved ones, and the value held, long and short, of each group."""
    resolved = F.coalesce(F.col("resolution_status") == "resolved", F.lit(False))
    part = lambda c: F.sum(F.when(c, value)).alias
    return rows.groupBy(*by).agg(F.count("*").alias("n_positions"), F.count_if(resolved).alias("n_resolved"), part(value > 0)("long_value"), part(value < 0)("short_value"))
