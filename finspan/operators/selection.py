"""Universe construction: deduplication, scores, quotas and similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key by a total order."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def seeded_order(df: DataFrame, seed: str, keys: list[str]) -> DataFrame:
    """Adds place: the row's number in the order of a hash of seed and keys.

    Rows are numbered in 4096 ranges of the hash; the ranges' sizes are told to all.
    """
    u = F.md5(F.concat(F.lit(seed), *keys))
    d = df.withColumn("__u", u).withColumn("__r", F.left("__u", F.lit(3)))
    each = d.groupBy("__r").agg(F.count("*").alias("__n"))
    before = each.withColumn("__before", F.sum("__n").over(Window.orderBy("__r")) - F.col("__n")).drop("__n")
    nth = F.row_number().over(Window.partitionBy("__r").orderBy("__u", *keys))
    return d.join(F.broadcast(before), "__r").withColumn("place", F.col("__before") + nth).drop("__u", "__r", "__before")


def min_max(df: DataFrame, *columns: str) -> DataFrame:
    """The columns scaled to 0..1 over all rows; a constant column becomes null."""
    ends = df.agg(*(F.min(c).alias(f"__lo_{c}") for c in columns), *(F.max(c).alias(f"__hi_{c}") for c in columns))
    j = df.join(F.broadcast(ends))  # one row
    return j.select(*(F.try_divide(F.col(c) - F.col(f"__lo_{c}"), F.col(f"__hi_{c}") - F.col(f"__lo_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns))


def quota_selection(df: DataFrame, group: str, source: str, order: list, target: int, shares: dict[str, float]) -> DataFrame:
    """Rows chosen in each group: first the best of each source up to its share of target, then the best of all others."""
    spark = df.sparkSession
    quota = spark.createDataFrame([(k, int(target * v)) for k, v in shares.items()], f"{source} string, __quota int")
    rank = F.row_number().over(Window.partitionBy(group, source).orderBy(*order))
    ranked = df.join(F.broadcast(quota), source, "left").withColumn("__first", F.coalesce(rank <= F.col("__quota"), F.lit(False)))
    n_first = F.sum(F.col("__first").cast("int")).over(Window.partitionBy(group))
    ranked = ranked.withColumn("__left", target - n_first)
    rest = F.row_number().over(Window.partitionBy(group, "__first").orderBy(*order))
    chosen = ranked.withColumn("__rest", rest).where(F.col("__first") | (F.col("__rest") <= F.col("__left")))
    return chosen.withColumn("stage", F.when(F.col("__first"), "quota").otherwise("fill")).drop("__quota", "__first", "__left", "__rest")


def rank_pct(df: DataFrame, group: str, value: str) -> Column:
    """Percent rank in a group with tied rows at their average, nulls left out."""
    w = Window.partitionBy(group, F.col(value).isNull())
    place = F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(group, value)) - 1) / 2
    return F.when(F.col(value).isNotNull(), place / F.count("*").over(w))


def near_pairs(df: DataFrame, key: str, group: str, metrics: list[str], radius: float) -> DataFrame:
    """(block, a, b): pairs of a group with a Euclidean distance of at most radius over the metrics; nulls are near nothing.

    For dimensions such as a universe, whose groups do not grow with the facts.
    """
    a = df.select(F.col(group).alias("block"), F.col(key).alias("a"), *(F.col(m).alias(f"x_{m}") for m in metrics))
    b = df.select(F.col(group).alias("block"), F.col(key).alias("b"), *(F.col(m).alias(f"y_{m}") for m in metrics))
    far = sum((F.pow(F.col(f"x_{m}") - F.col(f"y_{m}"), F.lit(2)) for m in metrics), F.lit(0.0))
    return a.join(b, "block").where((F.col("a") < F.col("b")) & (F.sqrt(far) <= radius)).select("block", "a", "b")


def ordinal_split(df: DataFrame, stratum: str, key: str, seed: int, shares: tuple[float, float]) -> DataFrame:
    """Adds split (train, val, test) by the order of a seeded hash within each stratum, with rounded-down counts for train and val."""
    w = Window.partitionBy(stratum)
    n = F.count("*").over(w)
    k = F.row_number().over(w.orderBy(F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string"))), key))
    return df.withColumn("split", F.when(k <= F.floor(n * shares[0]), "train").when(k <= F.floor(n * shares[0]) + F.floor(n * shares[1]), "val").otherwise("test"))


def rarity_sample(df: DataFrame, group: str, key: str, least: int, more: int) -> DataFrame:
    """(group, key, stage): least rows of each group, then more rows by weights inverse to their group's size.

    Draws come from a digest of group and key, so that a sample is the same at every run.
    """
    u = (F.conv(F.left(F.md5(F.concat(F.col(group), F.lit("/"), F.col(key))), F.lit(8)), 16, 10).cast("double") + 1) / F.lit(4294967297.0)
    n = df.groupBy(group).agg(F.count("*").alias("n"))
    drawn = df.select(group, key, u.alias("u")).join(n, group).withColumn("w", F.round(-F.log("u") * F.col("n"), 9))
    ranked = drawn.withColumn("first", F.row_number().over(Window.partitionBy(group).orderBy("u", key)) <= least)
    rest = ranked.where("not first").orderBy("w", group, key).limit(more)
    return ranked.where("first").select(group, key, F.lit("minimum").alias("stage")).union(rest.select(group, key, F.lit("rarity").alias("stage")))


def proportional_allocation(df: DataFrame, group: str, seats: int) -> DataFrame:
    """(group, n, seats): seats in proportion to the groups' rows, rounded down, the rest by largest remainder.

    There is one row a group when the windows over all of them run.
    """
    g = df.groupBy(group).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    g = g.join(F.broadcast(total)).withColumn("exact", F.lit(float(seats)) * F.col("n") / F.col("total")).withColumn("base", F.floor("exact"))
    k = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), group))
    left = seats - F.sum("base").over(Window.partitionBy())
    return g.select(group, "n", (F.col("base") + (k <= left).cast("long")).alias("seats"))


def compare_distributions(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, before, after, change): shares of the rows of two tables, zero where absent."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        g = df.groupBy(key).agg(F.count("*").alias("n"))
        return g.join(F.broadcast(g.agg(F.sum("n").alias("total")))).select(key, (F.col("n") / F.col("total")).alias(name))

    j = shares(before, "before").join(shares(after, "after"), key, "full_outer").fillna(0.0, ["before", "after"])
    return j.withColumn("change", F.col("after") - F.col("before"))


def keep_top(df: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each key by a total order."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__k") <= n).drop("__k")


def join_one_to_one(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """A join that fails at run time where a key occurs twice on a side."""

    def once(df: DataFrame, side: str) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(key))
        return df.withColumn("__n", n).where(F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.concat(F.lit(f"key repeated on the {side}: "), F.col(key).cast("string"))).cast("boolean"))).drop("__n")

    return once(left, "left").join(once(right, "right"), key, how)
