"""The SQLite source: round trips, filters inside the database, parts by row numbers, writers that can be broken off."""

import datetime
import decimal
import os
import sqlite3

import pytest
from finspan.sources import registry as R
from finspan.sources import sqlite as S
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

SCHEMA = "k bigint, i int, b boolean, d double, s string, x binary, day date, m decimal(20,3)"
DAY = datetime.date
ROWS = [
    (1, 2, True, 0.5, "a", b"\0\1", DAY(2024, 1, 1), decimal.Decimal("12345678901234567.125")),
    (2, None, False, float("inf"), "B", b"", DAY(2024, 2, 29), decimal.Decimal("-0.001")),
    (3, -5, None, None, "", None, None, None),
    (None, 7, True, -1.25, None, b"x", DAY(1969, 12, 31), decimal.Decimal("3.000")),
]


def saved(spark, path, parts=2, **more):
    S.write(spark.createDataFrame(ROWS, SCHEMA).repartition(parts), str(path), "t", **more)
    return str(path)


def test_round_trip(spark, tmp_path):
    path = saved(spark, tmp_path)
    df = S.read(spark, path, "t")
    assert df.schema == spark.createDataFrame(ROWS, SCHEMA).schema
    assert sorted(map(tuple, df.collect()), key=str) == sorted(ROWS, key=str)
    assert S.read(spark, path, "t", ["s", "k"]).columns == ["s", "k"]
    assert sorted(map(tuple, S.read(spark, f"file://{path}", "t", rows_per_partition=1).collect()), key=str) == sorted(ROWS, key=str)


CONDITIONS = {
    "k = 2": ("k", "=", 2), "k <> 2": ("k", "<>", 2), "k > 1": ("k", ">", 1), "k <=> null": ("k", "<=>", None), "i in (2, 7)": ("i", "in", [2, 7]), "b": ("b", "=", True), "s = 'B'": ("s", "=", "B"),
    "s >= 'B'": ("s", ">=", "B"), "s like 'a%'": ("s", "starts with", "a"), "s = ''": ("s", "=", ""), "day >= date'2024-01-01'": ("day", ">=", DAY(2024, 1, 1)), "day is null": ("day", "is null"),
    "day = date'1969-12-31'": ("day", "=", DAY(1969, 12, 31)), "d is not null": ("d", "is not null"), "d <= 0.5": ("d", "<=", 0.5), "i < 0": ("i", "<", 0),
}


def test_conditions(spark, tmp_path):
    path, plain = saved(spark, tmp_path), spark.createDataFrame(ROWS, SCHEMA)
    for condition, where in CONDITIONS.items():
        got = S.read(spark, path, "t", where=[where]).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, plain.where(condition).collect()), key=str), condition
    got = S.read(spark, path, "t", ["s"], [("k", ">=", 1), ("day", "is not null"), ("b", "=", False)]).collect()  # of columns that aren't fetched
    assert list(map(tuple, got)) == [("B",)]
    df = S.read(spark, path, "t", where=[("k", ">", 0)])
    assert sorted(r.k for r in df.where("k = 1").union(df.where("k = 3 or d = 0.5")).collect()) == [1, 1, 3]
    for where in (("m", "=", 1), ("k", "=", "1"), ("none", "=", 1), ("d", "=", float("nan"))):
        with pytest.raises(Exception, match="can't evaluate"):
            S.read(spark, path, "t", where=[where]).collect()


def test_what_is_pushed(spark, tmp_path):
    """Filters as Spark gives them to a source."""
    path = saved(spark, tmp_path)
    types = S.columns_of(S.shards(path, "t")[0], "t")
    reader = S.PushingReader(path, "t", types, S.ROWS, types)
    mine = [D.GreaterThanOrEqual(("day",), DAY(2024, 1, 1)), D.In(("s",), ("a", "B")), D.Not(D.IsNull(("k",)))]
    others = [D.EqualTo(("m",), decimal.Decimal(1)), D.EqualTo(("d",), float("nan")), D.StringContains(("s",), "a"), D.EqualTo(("a", "b"), 1), D.EqualTo(("k",), "1")]
    assert [id(f) for f in reader.pushFilters([*mine, *others])] == [id(f) for f in others]
    assert reader.where == ['"day" >= ?', '"s" COLLATE BINARY IN (?, ?)', 'NOT ("k" IS NULL)'] and reader.values == ["2024-01-01", "a", "B"]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.column(0).to_pylist()]
    assert sorted(rows) == [1, 2]  # only these leave the database


def test_filters_of_the_plan(spark, tmp_path):
    path, plain = saved(spark, tmp_path), spark.createDataFrame(ROWS, SCHEMA)
    more = ["d = 0.5 or k = 3", "i not in (2, 7)", "not b", "m > 1", "length(s) = 1", "d = double('NaN')", "x = X''", "not (k = 1)", "k > 1 and d < 1"]
    for condition in [*CONDITIONS, *more]:
        df = S.read(spark, path, "t", push_filters=True)
        assert sorted(map(tuple, df.where(condition).collect()), key=str) == sorted(map(tuple, plain.where(condition).collect()), key=str), condition
    plan = S.read(spark, path, "t", push_filters=True).where("k = 1")._jdf.queryExecution().executedPlan().toString()
    assert "(k#" not in plan.split("BatchScan")[0]  # nothing is left for Spark


def test_two_databases(spark, tmp_path):
    """A file of another program, opened read-only, beside a catalog of shards."""
    other = str(tmp_path / "a #1.db")
    with sqlite3.connect(other) as c:
        c.execute("CREATE TABLE names (id INTEGER PRIMARY KEY, name VARCHAR(9) COLLATE NOCASE, weight NUMERIC)")
        c.executemany("INSERT INTO names VALUES (?, ?, ?)", [(i, f"n{i}", i / 2) for i in range(1, 40)])
        c.execute("CREATE VIEW heavy AS SELECT * FROM names WHERE weight > 18")
    c.close()
    path = saved(spark, tmp_path / "shards")
    names = S.read(spark, other, "names", rows_per_partition=7)
    assert names.rdd.getNumPartitions() == 6
    assert names.where("name = 'N3'").count() == 0 and names.where("name = 'n3'").count() == 1
    assert [r.id for r in S.read(spark, other, "heavy").orderBy("id").collect()] == [37, 38, 39]
    got = names.join(S.read(spark, path, "t"), F.col("id") == F.col("k")).select("name", "s").orderBy("name").collect()
    assert list(map(tuple, got)) == [("n1", "a"), ("n2", "B"), ("n3", "")]


def test_append_overwrite_and_empty(spark, tmp_path):
    path = saved(spark, tmp_path)
    S.write(spark.createDataFrame(ROWS[:1], SCHEMA), path, "t", "append")
    assert S.read(spark, path, "t").count() == 5
    os.mkdir(f"{path}/t/v-broken-off")  # of a writer that never ended
    assert S.read(spark, path, "t").count() == 5
    S.write(S.read(spark, path, "t").where("k = 1"), path, "t")
    assert S.read(spark, path, "t").count() == 2
    S.write(spark.createDataFrame([], SCHEMA), path, "t", indexes=[["day"], ["k", "s"]])
    assert S.read(spark, path, "t").collect() == [] and S.read(spark, path, "t").columns == [x.split()[0] for x in SCHEMA.split(", ")]
    S.write(spark.createDataFrame([(1.0, "q"), (float("nan"), "r")], 'a double, "b c" string'.replace('"', "`")), path, "other")
    assert sorted(map(tuple, S.read(spark, path, "other").collect()), key=str) == [(1.0, "q"), (None, "r")]


def test_refused(spark, tmp_path):
    path = saved(spark, tmp_path)
    with pytest.raises(ValueError, match="mounted"):
        S.local("s3://bucket/x")
    with pytest.raises(ValueError, match="no type"):
        S.write(spark.range(1).select(F.array("id").alias("a")), path, "u")
    with pytest.raises(Exception, match="no table u"):
        S.read(spark, path, "u").count()


def test_registry(spark, tmp_path):
    rows = [("a", DAY(2024, 1, 1), "X", "resolved"), ("a", DAY(2024, 1, 2), "X", "failed"), ("a", DAY(2024, 1, 2), "Y", "resolved"), ("b", DAY(2023, 1, 1), "X", None)]
    c = R.Catalog(spark, str(tmp_path))
    S.write(spark.createDataFrame(rows, "portfolio_id string, date date, ticker string, resolution_status string"), c.path, "portfolio_holdings", indexes=[["portfolio_id", "date"]])
    S.write(spark.createDataFrame([("a", True), ("b", False), ("c", None)], "portfolio_id string, is_active boolean"), c.path, "portfolios")
    count = lambda **k: R.holdings(c, **k).count()
    assert (count(), count(resolved_only=False), count(portfolio_id="a"), count(on=DAY(2024, 1, 2)), count(portfolio_id="b")) == (2, 4, 2, 1, 0)
    assert c.table("portfolio_holdings", ticker=["X", "Z"], portfolio_id=None).count() == 3
    assert c.table("portfolio_holdings", first=DAY(2024, 1, 1), last=DAY(2024, 1, 1)).count() == 1 and R.holdings_until(c).count() == 4
    assert sorted((r.portfolio_id, r.ticker) for r in R.latest(R.holdings_until(c)).collect()) == [("a", "X"), ("a", "Y"), ("b", "X")]
    assert sorted((r.portfolio_id, r.date) for r in R.latest(R.holdings_until(c, DAY(2024, 1, 1))).collect()) == [("a", DAY(2024, 1, 1)), ("b", DAY(2023, 1, 1))]
    assert (R.portfolios(c).count(), R.portfolios(c, active=None).count(), R.portfolios(c, "b", None).count()) == (1, 3, 1)
