"""Evolving tables and views, work that is resumed, JSON checked against shapes."""

import pytest
from finspan.functions import validation as V
from finspan.sources import buckets as B
from finspan.sources import ledger, views
from pyspark.sql import functions as F


def test_columns_are_added(spark, tmp_path):
    path = str(tmp_path / "t")
    B.upsert(spark.createDataFrame([(i, "a") for i in range(20)], "k int, v string"), path, ["k"], buckets=4)
    folders = set(B.version(spark, path).data.values())
    new = spark.createDataFrame([(3, "b", 2.5), (50, "c", None)], "k int, v string, w double")
    B.upsert(new, path, ["k"])
    assert B.read(spark, path).columns == ["k", "v"]  # not unless asked for
    B.upsert(new, path, ["k"], evolve=True)
    rows = {r.k: (r.v, r.w) for r in B.read(spark, path).collect()}
    assert len(rows) == 21 and rows[3] == ("b", 2.5) and rows[50] == ("c", None) and rows[4] == ("a", None)
    assert folders & set(B.version(spark, path).data.values())  # some older files are still read, with the new column null
    B.add_columns(spark, path, "x array<string>, v string")
    assert B.read(spark, path).columns == ["k", "v", "w", "x"] and B.read(spark, path).where("x is null").count() == 21
    number = B.version(spark, path).number
    B.add_columns(spark, path, "x array<string>")
    assert B.version(spark, path).number == number
    B.upsert(spark.createDataFrame([(60,)], "k int"), path, ["k"])
    assert B.read(spark, path).where("k = 60 and v is null and w is null").count() == 1
    with pytest.raises(ValueError, match="w is double, not string"):
        B.upsert(spark.createDataFrame([(1, "z")], "k int, w string"), path, ["k"], evolve=True)
    assert B.read(spark, path, 1).columns == ["k", "v"]


def test_views(spark, tmp_path):
    catalog = str(tmp_path)
    B.upsert(spark.createDataFrame([(1, 2)], "k int, n int"), f"{catalog}/base", ["k"])
    assert views.open_catalog(spark, catalog) == ["base"]
    views.save_view(spark, catalog, "a_first", "SELECT n + 1 AS n FROM z_second")
    views.save_view(spark, catalog, "z_second", "SELECT n FROM base")
    views.save_view(spark, catalog, "z_second", "SELECT n * 10 AS n FROM base")
    assert sorted(views.open_catalog(spark, catalog)) == ["a_first", "base", "z_second"] and spark.table("a_first").first().n == 21
    views.save_view(spark, catalog, "broken", "SELECT nothing FROM base")
    with pytest.raises(Exception, match="nothing"):
        views.open_catalog(spark, catalog)


def test_a_run_that_breaks_off(spark, tmp_path):
    path, rows = str(tmp_path / "ledger"), spark.range(60).select(F.col("id").alias("k")).unionByName(spark.sql("select cast(null as bigint) as k"))
    seen = spark.sparkContext.accumulator(0)

    def work(breaks_at=None):
        def run(df):
            parts = [r.k for r in df.collect()]
            if breaks_at is not None and seen.value >= breaks_at:
                raise RuntimeError("broken off")
            seen.add(len(parts))
            bad = F.col("k") % 10 == 0
            return df.select("k", F.when(~bad, F.col("k") * 2).alias("twice"), F.when(bad, F.lit("no")).alias("error"))

        return run

    with pytest.raises(RuntimeError):
        ledger.resume(rows, "k", work(breaks_at=20), path, buckets=8)
    part = B.read(spark, path).count()
    assert 0 < part < 60 and part == seen.value
    assert ledger.resume(rows, "k", work(), path, most=1) > 0
    ledger.resume(rows, "k", work(), path)
    assert seen.value == 60 and B.read(spark, path).count() == 60  # no row twice
    assert ledger.resume(rows, "k", work(), path) == 0 and seen.value == 60
    ledger.resume(rows, "k", work(), path, retry=True)
    assert seen.value == 66 and B.read(spark, path).where("error = 'no'").count() == 6


SHAPE = {"a": V.ANY, "b": {"c": V.LIST, "d?": V.LIST}, "s?": ["Section", {"title": V.ANY, "tables?": ["Table", {"rows": V.ANY}]}]}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": 1, "b": {"c": []}}', []),
        ('{"a": null, "b": {"c": [1], "d": [2]}, "s": []}', []),
        ('{"b": {"d": 3}}', ["report missing 'a'", "b missing 'c'", "b d must be a list"]),
        ('{"a": 1, "b": 4, "s": {}}', ["b is not an object", "s must be a list"]),
        ('{"a": 1, "b": {"c": []}, "s": [{"title": 1}, 5, {"tables": [{"rows": 1}, {}, "x"]}, {"title": "t", "tables": 7}]}',
         ["Section 1 is not an object", "Section 2 missing 'title'", "Section 2, Table 1 missing 'rows'", "Section 2, Table 2 is not an object", "Section 3 must be a list"]),
        ("[1]", ["report is not an object"]), ('{"a": 1', ["not JSON"]), (None, ["not JSON"]), ("", ["not JSON"]),
    ],
)
def test_shapes(spark, text, want):
    r = V.validated(spark.createDataFrame([(text,)], "t string"), "t", SHAPE).first()
    assert (r.errors, r.valid) == (want, not want)
