"""Mentions of symbols: evidence, places, contexts, and what is made of them."""

import datetime

import pytest
from finspan.functions import mentions as M
from pyspark.sql import functions as F

TEXTS = {
    "$GME and $BRK.B, $TOOLONGX $A": [("GME", "dollar", 1), ("BRK-B", "dollar", 10)],
    "nyse: gme, NASDAQ - BB; OTC:ALL": [("GME", "exchange", 6), ("BB", "exchange", 20)],
    "see /stock/amc/ and /STOCKS/Koss?x=1 or /stock/it": [("AMC", "site_path", 11), ("KOSS", "site_path", 28)],
    "I like PLTR shares, huge volume": [("PLTR", "bare", 7)],
    "I like PLTR a lot": [],
    "short squeeze in CLOV today": [("CLOV", "bare", 17)],
    "ticker TIME and AAPL, calls and puts": [],
    "x" * 300 + " HOOD yolo " + "y" * 78 + " gamma": [("HOOD", "bare", 301)],
    "x" * 300 + " HOOD yolo " + "y" * 79 + " gamma": [],
    "": [],
}


@pytest.mark.parametrize("text", TEXTS)
def test_find(text):
    assert [(s, e, at) for s, e, at, _ in M.find(text, M.Rules())] == TEXTS[text]


def test_context():
    text = "a " * 80 + "buy\n\n $GME \t now" + " b" * 80
    ((_, _, at, context),) = M.find(text, M.Rules())
    assert text[at : at + 3] == "GME" and "buy $GME now" in context and len(context) <= 203 and not context.startswith(" ")


def test_frames(spark):
    rows = [(1, "s1", "$GME GME shares volume"), (2, "s2", "stock: GME volume"), (None, None, "$GME"), (3, "s1", None), (4, "s1", "$AMC " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("symbol", F.lit("clash")).repartition(2)
    found = M.mentions(docs, ["doc_id", "source"])
    assert sorted((r.doc_id, r.evidence, r.start) for r in found.where("symbol = 'GME' and doc_id is not null").collect()) == [(1, "bare", 1), (1, "bare", 5), (1, "dollar", 1), (2, "bare", 7)]
    c = {r.symbol: r for r in M.candidates(found, "doc_id", "source", 2).collect()}
    assert (c["GME"].n_docs, c["GME"].n_mentions, c["GME"].n_sources, c["GME"].evidence) == (2, 5, 2, ["bare", "dollar"])
    assert len(c["GME"].contexts) == 2 and c["AMC"].n_mentions == 30_000 and len(c["AMC"].contexts) == 2
    ranks = M.ranked(M.candidates(found, "doc_id", "source"), 1, "dollar").collect()
    assert [(r.symbol, r["rank"]) for r in ranks] == [("GME", 1)]


def test_profiles_and_reasons(spark):
    day = datetime.date(2024, 1, 1)
    rows = [("A", day + datetime.timedelta(days=i), 100.0 + i, 10.0) for i in range(30)] + [("A", day + datetime.timedelta(days=30), 100.0, 40.0), ("A", day + datetime.timedelta(days=31), None, 1.0)]
    rows += [("B", day + datetime.timedelta(days=i), 5.0, 0.0) for i in range(3)]
    p = {r.ticker: r for r in M.profiles(spark.createDataFrame(rows, "ticker string, date date, close double, volume double")).withColumn("n_sources", F.lit(3)).withColumn("reasons", M.reasons(3, 20, 20, 3)).collect()}
    assert (p["A"].volume, p["A"].avg_volume, p["A"].volume_spike, p["A"].rejected) == (40, 10, 4, None)
    assert p["A"].change_1 == pytest.approx(100 * (100 / 129 - 1), abs=1e-4) and p["A"].change_5 == pytest.approx(100 * (100 / 125 - 1), abs=1e-4)
    assert p["A"].reasons == ["volume 4.0x", "1d -22.5%", "5d -20.0%", "3 sources"]
    assert (p["B"].rejected, p["B"].volume_spike, p["B"].change_5, p["B"].reasons) == ("insufficient_history", None, None, ["3 sources"])
