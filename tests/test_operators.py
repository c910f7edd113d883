"""Operators on small tables worked out by hand."""

import datetime

import numpy as np
import pytest
from finspan.functions import labels as L
from finspan.functions import text as T
from finspan.operators import clustering as C
from finspan.operators import portfolio as O
from finspan.operators import returns as R
from finspan.operators import selection as S
from finspan.operators import similarity as V
from finspan.sources import sinks
from pyspark.sql import functions as F

DAY = datetime.date(2024, 1, 1)


def history(spark, table):
    """ticker -> closes by day, None for a gap."""
    rows = [(DAY + datetime.timedelta(days=i), t, float(c), 10.0) for t, closes in table.items() for i, c in enumerate(closes) if c is not None]
    return spark.createDataFrame(rows, "date date, ticker string, close double, volume double")


def returns(spark, table, least=0.5):
    return R.daily_returns(R.on_calendar(history(spark, table), least))


def test_gaps_are_neither_filled_nor_skipped(spark):
    got = {(r.ticker, r.seq): r.ret for r in returns(spark, {"A": [100, 110, 121], "B": [50, None, 60], "C": [1, 1, 1]}).collect()}
    assert got["A", 2] == pytest.approx(10) and got["A", 3] == pytest.approx(10)
    assert got["B", 3] is None and got["B", 1] is None and got["C", 2] == 0


def test_sparse_dates_leave_the_calendar(spark):
    r = returns(spark, {"A": [100, 100.5, 102], "B": [50, None, 49], "C": [10, None, 11], "D": [7, None, 8]})
    got = {(x.ticker, x.seq): x.ret for x in r.collect()}
    assert got["A", 2] == pytest.approx(2) and got["B", 2] == pytest.approx(-2) and len(got) == 8


def test_returns_over_and_to_the_year(spark):
    on = R.on_calendar(history(spark, {"A": [100, 110, 121], "B": [None, 50, 55]}))
    assert {r.ticker: r.ret and round(r.ret, 6) for r in R.return_over(on, 2).collect()} == {"A": 21.0, "B": None}
    rows = [(datetime.date(2023, 12, 29), "A", 100.0), (datetime.date(2024, 1, 2), "A", 120.0), (datetime.date(2024, 1, 2), "N", 7.0)]
    ytd = R.ytd_return(spark.createDataFrame(rows, "date date, ticker string, close double"))
    assert {r.ticker: r.ret and round(r.ret, 6) for r in ytd.collect()} == {"A": 20.0, "N": None}


def test_own_beta_is_one_and_constants_have_none(spark):
    closes = [100 + (i * 37 % 11) for i in range(40)]
    r = returns(spark, {"A": closes, "K": [5] * 40})
    factor = r.where("ticker = 'A'").select("seq", F.col("ret").alias("fret"))
    got = {x.ticker: x.beta for x in R.beta_to(r, factor, 60, 30).collect()}
    assert got["A"] == pytest.approx(1) and got["K"] == pytest.approx(0)
    assert all(x.beta is None for x in R.beta_to(r, factor, 60, 100).collect())
    assert {x.ticker: x.vol for x in R.annualized_vol(r, 100).collect()}["K"] is None


def test_percentile_is_strict_and_streaks_stop_at_zero(spark):
    r = returns(spark, {"A": [1, 2, 3, 4, 9], "Z": [5, 6, 6, 7, 8]})
    assert {x.ticker: x.pct for x in R.return_percentile(r, 60, 2).collect()}["A"] == 75
    assert {x.ticker: x.streak for x in R.streaks(r, 15, 1).collect()} == {"A": 4, "Z": 2}


def test_lots_roll_up(spark):
    lots = [("b", "1", "A", 10.0, 5.0, 50, 1), ("b", "2", "A", -4.0, 6.0, -24, None), ("b", "1", "C", 5.0, 1.0, 5, 1), ("b", "1", "C", -5.0, 1.0, -5, 1)]
    df = spark.createDataFrame(lots, "broker string, account string, symbol string, quantity double, avg_price double, market_value int, open_pnl int")
    (a,) = O.aggregate_lots(df).collect()
    assert (a.symbol, a.quantity, a.market_value, a.open_pnl, a.accounts) == ("A", 6, 26.0, None, "1, 2")
    assert a.avg_price == pytest.approx((5 * 50 + 6 * 24) / 74)


def test_weights_and_contributions_tie_out(spark):
    held = spark.createDataFrame([("A", 10, 0.0), ("B", -5, 0.0), ("X", 1, 40.0)], "symbol string, quantity bigint, market_value double")
    move = spark.createDataFrame([("A", 11.0, 10.0, 10.0), ("B", 18.0, 20.0, -10.0)], "ticker string, close double, prev double, ret double")
    p = O.positions(held, move).collect()
    gross = sum(abs(r.bod) for r in p)
    assert sum(abs(r.weight) for r in p) == pytest.approx(1)
    dollars = sum(r.mtm - r.bod for r in p if r.ret is not None)
    assert sum(r.bod_weight * r.ret / 100 for r in p if r.ret is not None) * gross == pytest.approx(dollars)


def test_scenario_precedence(spark):
    slices = spark.createDataFrame([("A", "Eq", 100.0, None), ("B", "Eq", 100.0, None), ("C", "Other", 100.0, None)], "symbol string, class string, value double, ret double")
    shocks = spark.createDataFrame([("s", "Eq", -10.0), ("s", None, -5.0), ("t", "Eq", 1.0)], "scenario string, class string, pct double")
    own = spark.createDataFrame([("s", "A", 7.0)], "scenario string, symbol string, pct double")
    got = {(r.scenario, r.symbol): r.pnl for r in O.shocked(slices, shocks, own).collect()}
    assert got == {("s", "A"): 7, ("s", "B"): -10, ("s", "C"): -5, ("t", "A"): 1, ("t", "B"): 1, ("t", "C"): 0}


def test_look_through_by_class_and_region(spark):
    held = spark.createDataFrame([("MULTI", 200.0, 1.0), ("LP", 900.0, None), ("X", -100.0, 2.0), ("GONE", None, 1.0)], "symbol string, mtm double, ret double")
    own = spark.createDataFrame([("LP", "Equities", None), ("GONE", "Bonds", "US")], "symbol string, class string, region string")
    classes = spark.createDataFrame([("MULTI", "Equities", 0.5), ("MULTI", "Bonds", 0.3), ("MULTI", "Cash", 0.2), ("MULTI", "Other", 0.0)], "symbol string, class string, fraction double")
    regions = spark.createDataFrame([("MULTI", "Equities", "US", 0.75), ("MULTI", "Equities", "EM", 0.25), ("MULTI", "Cash", "US", 0.5)], "symbol string, class string, region string, share double")
    s = O.regional_slices(held, own, classes, regions, 50.0)
    got = {(r.level, r.parent, r.label): (r.n, r.value, r.ret) for r in O.regional_allocation(s).collect()}
    assert got[0, None, "Equities"] == (3, pytest.approx(1000), pytest.approx(1.0))
    assert got[1, "Equities", "US"][1] == pytest.approx(75) and got[1, "Equities", "EM"][1] == pytest.approx(25)
    assert got[1, "Equities", "Unclassified"] == (1, 900.0, None)
    assert got[1, "Bonds", "Unclassified"][1] == pytest.approx(60) and got[0, None, "Other"] == (1, -100.0, -2.0)
    assert got[0, None, "Cash"] == (2, pytest.approx(90), pytest.approx(40 / 90)) and len(got) == 8
    shocks = spark.createDataFrame([("s", "Equities", "US", -40.0), ("s", "Equities", None, -30.0), ("s", "Bonds", "US", 10.0)], "scenario string, class string, region string, pct double")
    own = spark.createDataFrame([("s", "X", -80.0)], "scenario string, symbol string, pct double")
    pnl = {}
    for r in O.shocked_by_region(s, shocks, own).collect():
        pnl[r.symbol] = pnl.get(r.symbol, 0) + r.pnl
    assert pnl == {"MULTI": pytest.approx(-37.5), "LP": pytest.approx(-270), "X": pytest.approx(80), "CASH": 0}


def test_tag_shares_and_active_weights(spark):
    tags = spark.createDataFrame([("A", "x", "S"), ("A", "y", "S"), ("B", "x", "S")], "ticker string, tag string, axis string")
    pnl = {r.tag: (r.bps, r.n) for r in O.tag_pnl(spark.createDataFrame([("A", 10.0), ("B", 4.0)], "ticker string, bps double"), tags).collect()}
    assert pnl == {"x": (9.0, 2), "y": (5.0, 1)}
    act = {r.tag: (r.book, r.bench) for r in O.tag_active(spark.createDataFrame([("B", 1.0)], "ticker string, w double"), tags).collect()}
    assert act == {"x": (1.0, 1.0), "y": (0.0, 0.5)}


def test_eta_squared_of_separate_groups_is_one(spark):
    v = spark.createDataFrame([("k", "a", 1.0), ("k", "a", 1.0), ("k", "b", 3.0), ("k", "b", 3.0)], "axis string, v string, ret double")
    assert O.eta_squared(v).first().eta2 == pytest.approx(1)


def test_quota_fill_and_ties(spark):
    rows = [("g", "s" if i < 3 else "t", i, float(i % 4)) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, source string, key bigint, score double")
    got = S.quota_selection(df, "g", "source", [F.desc("score"), "key"], 5, {"s": 0.4}).collect()
    assert sorted((r.key, r.stage) for r in got) == [(1, "quota"), (2, "quota"), (3, "fill"), (6, "fill"), (7, "fill")]
    ranked = spark.createDataFrame([("g", 1.0), ("g", 1.0), ("g", 2.0), ("g", None)], "g string, v double")
    assert sorted((r.v or 0, r.p) for r in ranked.select("v", S.rank_pct(ranked, "g", "v").alias("p")).collect() if r.v) == [(1.0, 0.5), (1.0, 0.5), (2.0, 1.0)]


def test_leaders_take_later_neighbours_only_once(spark):
    nodes = spark.createDataFrame([(0, k) for k in (1, 2, 3, 4, 5)], "block long, key long")
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 4)], "block long, a long, b long")
    assert {r.key: r.leader for r in C.leader_groups(nodes, edges).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_text_functions(spark):
    df = spark.createDataFrame([("  a \n b ", "https://www.news.example.com/x", "Buy $ABC or $ABCDEFG", "Value, value,, US", "1.5"), (" ", None, None, '["A","B","a"]', "NaN")], "t string, u string, s string, g string, n string")
    a, b = df.select(T.clean(F.col("t")).alias("t"), T.domain(F.col("u")).alias("u"), T.symbols(F.col("s")).alias("s"), T.tag_list(F.col("g")).alias("g"), T.number(F.col("n")).alias("n")).collect()
    assert (a.t, a.u, a.s, a.g, a.n) == ("a b", "example.com", ["ABC"], ["Value", "US"], 1.5)
    assert (b.t, b.u, b.g, b.n) == (None, None, ["A", "B"], None)


def test_sinks_can_run_again(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    path = str(tmp_path / "t")
    for _ in range(2):
        sinks.upsert(old, path, ["k"])
        sinks.upsert(new, path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    for _ in range(2):
        sinks.insert_absent(spark.createDataFrame([(3, "x"), (4, "y")], "k long, v string"), path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d"), (4, "y")]
    twice = spark.createDataFrame([(5, "p"), (5, "q")], "k long, v string")
    sinks.upsert(twice, path, ["k"])
    (tmp_path / "t").rename(tmp_path / "t.before")  # as if broken off between the two moves
    assert sinks.read(spark, path).where("k = 5").first().v == "q" and sinks.read(spark, path).count() == 5
    assert sinks.upserted(twice.limit(0), twice, ["k"], ["v"]).first().v == "p"
    parts = str(tmp_path / "p")
    sinks.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "d long, v string"), parts, "d")
    sinks.replace_partitions(spark.createDataFrame([(2, "z")], "d long, v string"), parts, "d")
    assert sorted((r.d, r.v) for r in spark.read.parquet(parts).collect()) == [(1, "a"), (2, "z")]


def test_empty_tables(spark):
    r = returns(spark, {})
    assert r.count() == 0 and R.streaks(r).count() == 0 and R.annualized_vol(r).count() == 0


def test_search_finds_what_plain_code_finds(spark):
    rng = np.random.default_rng(4)
    vs = {k: rng.normal(size=6).tolist() for k in range(60)} | {60: [0.0] * 6}
    df = spark.createDataFrame([*vs.items(), (61, None)], "key long, vector array<double>")
    queries = df.where("key % 5 = 0")
    unit = {k: np.array(v) / (np.linalg.norm(v) or 1) for k, v in vs.items()}
    cos = {(a, b): float(unit[a] @ unit[b]) for a in unit for b in unit if a % 5 == 0 and a != b}
    assert {(r.a, r.b) for r in V.search(queries, df, 0.5).collect()} == {k for k, v in cos.items() if v >= 0.5}
    got = {r.key: r.uniqueness for r in V.uniqueness(queries, df).collect()}
    assert got.keys() == {k for k in vs if k % 5 == 0}
    assert all(abs(v - (1 - np.mean([abs(c) for (a, _), c in cos.items() if a == k]))) < 1e-9 for k, v in got.items())


def test_one_to_one_join_fails_on_a_repeated_key(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), spark.createDataFrame([(1, "p")], "k long, w string")
    assert {(r.k, r.w) for r in S.join_one_to_one(a, b, "k", "left").collect()} == {(1, "p"), (2, None)}
    with pytest.raises(Exception, match="key repeated"):
        S.join_one_to_one(a, b.union(b), "k", "left").collect()


def test_near_pairs_lead_groups(spark):
    df = spark.createDataFrame([("a", "g", 0.0, 0.0), ("b", "g", 0.6, 0.8), ("c", "g", 1.5, 0.8), ("d", "h", 0.0, 0.0), ("e", "g", None, 0.0)], "t string, g string, x double, y double")
    pairs = S.near_pairs(df, "t", "g", ["x", "y"], 1.0)
    assert {(r.a, r.b) for r in pairs.collect()} == {("a", "b"), ("b", "c")}
    nodes = df.select(F.col("g").alias("block"), F.col("t").alias("key"))
    assert {r.key: r.leader for r in C.leader_groups(nodes, pairs).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}


def test_seats_and_samples(spark):
    df = spark.createDataFrame([("a", i) for i in range(7)] + [("b", i) for i in range(2)] + [("c", 0)], "g string, k long")
    assert {r.g: r.seats for r in S.proportional_allocation(df, "g", 4).collect()} == {"a": 3, "b": 1, "c": 0}
    drawn = S.rarity_sample(df, "g", "k", 1, 3).collect()
    assert sorted(r.g for r in drawn if r.stage == "minimum") == ["a", "b", "c"] and sum(r.stage == "rarity" for r in drawn) == 3


def test_answers_labels_and_days(spark):
    df = spark.createDataFrame([('```json\n{"label": "x",}\n```',), ('so {"label":"y"} it is',), ("none",), (None,)], "s string")
    assert [r[0] for r in df.select(T.answer_field(F.col("s"), "label")).collect()] == ["x", "y", None, None]
    df = spark.createDataFrame([(" NaN ",), ("Unable to say",), ("Equity",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(L.valid_label(F.col("s"))).collect()] == [False, False, True, False, False]
    df = spark.createDataFrame([("Equity", "it is Unknown"), ("Equity", "N/A"), ("Equity", " na "), ("Un-classified", "Value"), ("was unclassified", "Value"), ("ParseError", "x"), ("Equity", None), ("Equity", "Value")], "a string, b string")
    assert [r[0] for r in df.select(L.valid_label(F.col("a"), F.col("b"))).collect()] == [False, False, False, True, False, False, False, True]
    df = spark.createDataFrame([("A", "A"), ("12", "B"), (None, "C"), (" ", "D"), ("Fund 1", "E"), ("x", None)], "n string, s string")
    assert [r[0] for r in df.select(L.junk_name(F.col("n"), F.col("s"))).collect()] == [True, True, True, True, False, False]
    df = spark.createDataFrame([("AAPL",), ("CASH",), ("12345678X",), ("AB C",), (None,)], "s string")
    assert [r[0] for r in df.select(L.symbol_kind(F.col("s"))).collect()] == ["ticker", "cash", "identifier", "derivative", "ticker"]
    df = spark.sql("select date'2024-03-01' a, date'2024-03-04' b, date'2024-03-03' c")
    assert df.select(L.business_days(F.col("a"), F.col("b")), L.business_days(F.col("b"), F.col("a")), L.business_days(F.col("a"), F.col("c"))).first()[:] == (1, -1, 0)


def test_aliased_and_blended(spark):
    prices = spark.createDataFrame([(1, "A", 10.0), (2, "A", 11.0), (2, "F", 99.0)], "date int, ticker string, close double")
    unit = spark.createDataFrame([("F", 22.0)], "symbol string, unit double")
    out = R.aliased(prices, unit, spark.createDataFrame([("F", "A")], "symbol string, alias string"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "A", 10.0), (1, "F", 20.0), (2, "A", 11.0), (2, "F", 22.0)]
    mix = spark.createDataFrame([("f", "x", 0.5), ("f", "y", 0.3), ("f", "z", 0.2), ("g", "z", 1.0)], "fund string, class string, w double")
    got = {r.fund: (r.ret, r.priced) for r in O.blended(mix, spark.createDataFrame([("x", 2.0), ("y", -1.0)], "class string, ret double")).collect()}
    assert abs(got["f"][0] - 0.7 / 0.8) < 1e-9 and got["g"] == (None, 0.0)
