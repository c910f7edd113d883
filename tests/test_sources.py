"""Landed files become tables."""

import json

import pytest
from finspan.sources import files
from pyspark.sql import functions as F


def test_export_is_conformed(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Broker,Account No,SYMBOL,Qty held,Unit cost\nx,1,AAA,10,2.5\nx,1,BBB,bad,NaN\n")
    df = files.read_export(spark, str(tmp_path / "a.csv"), files.HOLDING, {"account": "account", "qty": "quantity", "cost": "avg_price"})
    assert df.schema == files.HOLDING
    assert [tuple(r) for r in df.orderBy("symbol").collect()] == [("x", "1", "AAA", 10.0, 2.5, None), ("x", "1", "BBB", None, None, None)]
    with pytest.raises(ValueError, match="missing columns: z"):
        files.require(df, "symbol", "z")
    with pytest.raises(ValueError, match="keys repeated"):
        files.unique(df, "account")
    assert files.unique(df, "symbol") is df


def test_statement_and_accounts(spark, tmp_path):
    (tmp_path / "s.xml").write_text('<r><OpenPosition accountId="U1" symbol=" AAA " position="-3" costBasisPrice="x" positionValue="-30.5"/><OpenPosition accountId="U1" symbol="B" position="0"/></r>')
    a = files.read_statement(spark, str(tmp_path / "s.xml"))
    assert [tuple(r) for r in a.collect()] == [("statement", "U1", "AAA", -3.0, None, -30.5)]
    (tmp_path / "j.json").write_text(json.dumps({"account": "9", "positions": [{"symbol": "C", "longQuantity": 2, "shortQuantity": 5, "averagePrice": 1.5, "marketValue": -4.0}, {"symbol": "D"}]}))
    b = files.read_accounts(spark, str(tmp_path / "j.json"))
    assert [tuple(r) for r in b.collect()] == [("accounts", "9", "C", -3.0, 1.5, -4.0)]
    saved = spark.createDataFrame([("statement", "U1", "OLD", 1.0, 1.0, 1.0), ("other", "1", "E", 1.0, 1.0, 1.0)], files.HOLDING)
    assert sorted((r.broker, r.symbol, r.stale) for r in files.holdings([a, b], saved).collect()) == [("accounts", "C", False), ("other", "E", True), ("statement", "AAA", False)]


def test_labels_coverage_and_resumption(spark):
    h = spark.createDataFrame([("", 50.0), (" ", 500.0), (None, None), ("A", 1.0)], "symbol string, market_value double")
    assert sorted(r.symbol for r in files.labelled_holdings(h).collect()) == ["A", "UNKNOWN"]
    t = spark.createDataFrame([(x,) for x in "ABCD"], "ticker string")
    p = files.mock_prices(t, 5)
    assert p.count() == 20 and p.exceptAll(files.mock_prices(t, 5)).count() == 0
    assert files.covered(p, t).count() == 20
    with pytest.raises(ValueError, match="prices of 3 of 4"):
        files.covered(p.withColumn("close", F.when(F.col("ticker") != "A", F.col("close"))), t)
    assert {r.ticker for r in files.unloaded(t, p.where("ticker < 'C'"), "ticker").collect()} == {"C", "D"}
    last = files.newest(p, "date", "ticker")
    assert last.count() == 4 and last.select("date").distinct().count() == 1
