"""Column expressions over symbols, labels and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def symbol_kind(c: Column) -> Column:
    """cash, derivative (a suffix C or P), identifier (nine characters with a digit) or ticker."""
    return F.when(c.rlike(r" [CP]$"), "derivative").when(c == "CASH", "cash").when(c.rlike(r"^[A-Z0-9]{9}$") & c.rlike(r"[0-9]"), "identifier").otherwise("ticker")


def priceable(c: Column) -> Column:
    return symbol_kind(c) == "ticker"


# fixed values: literals that stand for no label, and words that mark a refusal wherever they stand
NO_LABEL = ("nan", "none", "null", "n/a", "na")
REFUSALS = ("unable", "unknown", "unclassified", "error")


def valid_label(*tiers: Column) -> Column:
    """Whether every tier has a label: not null, blank or a literal for none, and without a word of refusal."""
    good = F.lit(True)
    for c in tiers:
        t = F.lower(F.trim(c.cast("string")))
        good = good & ~t.isin("", *NO_LABEL) & ~t.rlike("|".join(REFUSALS))
    return F.coalesce(good, F.lit(False))


def junk_name(name: Column, symbol: Column) -> Column:
    """A name that says nothing: missing, blank, the symbol itself or digits only."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return (n == "") | (n == F.coalesce(symbol, F.lit(""))) | n.rlike("^[0-9]+$")


def one_size(tags: Column, sizes: list[str]) -> Column:
    """An array of tags without those of size where it has two or more of them."""
    is_size = lambda x: x.isin(*sizes)
    return F.when(F.size(F.filter(tags, is_size)) >= 2, F.filter(tags, lambda x: ~is_size(x))).otherwise(tags)


def by_priority(df: DataFrame, name: str, choices: dict[str, Column]) -> DataFrame:
    """(key, name, origin): the first of the choices that is not null, and which it was."""
    origin = F.coalesce(*(F.when(c.isNotNull(), F.lit(k)) for k, c in choices.items()), F.lit("none"))
    return df.select("key", F.coalesce(*choices.values()).alias(name), origin.alias("origin"))


def business_days(a: Column, b: Column) -> Column:
    """Weekdays after a up to b, negative if b is before a: whole weeks since a Monday, and days of the last one."""
    since = lambda d: F.datediff(d, F.lit("1970-01-05").cast("date"))
    upto = lambda n: 5 * F.floor(n / 7) + F.least(F.pmod(n, F.lit(7)), F.lit(4))
    return (upto(since(b)) - upto(since(a))).cast("bigint")
