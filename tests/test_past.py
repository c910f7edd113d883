"""Plans over a past day give what they give on tables that end with that day."""

import pytest
from finspan import catalog
from finspan.plans import market, portfolio, snapshots
from finspan.sources import panels as P
from pyspark.sql import functions as F

from tests.test_queries import SF, rows

DAY = "1995-08-31"
PLANS = market.QUERIES | portfolio.QUERIES | snapshots.QUERIES


@pytest.fixture(scope="module")
def then(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("then"))
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        if name in P.KNOWN:
            df = df.where(F.to_date(P.KNOWN[name]) <= F.lit(DAY).cast("date"))
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["tier2_summary", "beta_vs_market", "category_streaks", "best_factor", "return_percentile", "subportfolios", "tag_pnl", "concentration", "scenario_impact", "weighted_ytd", "broker_rollup"])
def test_plans(spark, then, name):
    got, want = PLANS[name](spark, P.AsOf(SF, DAY)), PLANS[name](spark, then)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.collect())


def test_the_condition_reaches_the_scan(spark):
    plan = P.prices(spark, P.AsOf(SF, DAY))._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(l_shipdate" in plan
    assert P.table(spark, P.AsOf(SF, DAY), "part").count() == P.table(spark, SF, "part").count()


def test_registered(spark):
    assert "ytd_return_as_of" in catalog.ORACLES
