"""Every registered query against its SQL twin, or at least run. TIDEGRID_SF names another scale."""

import os

import pytest

import __spark_entry__ as contract
import compare

FOLDER = f"/root/testdata/sf{os.environ.get('TIDEGRID_SF', '0.001')}"
QUERIES, TWINS = contract.queries(), contract.oracle_sql()
SLOW = {"features_wide"}


@pytest.fixture(scope="module")
def sql():
    return compare.connect(FOLDER)


def test_twins_belong_to_queries():
    assert set(TWINS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(TWINS) - SLOW))
def test_query_equals_its_twin(spark, sql, name):
    ours = QUERIES[name](spark, FOLDER).toPandas()
    assert compare.difference(ours, sql.sql(TWINS[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert contract.entry(spark).columns[:2] == ["symbol", "t"]


@pytest.mark.parametrize("name", ["asof_nearest", "asof_price", "split_adjust", "news_window", "minmax_scale", "sentiment_series"])
def test_plans_have_no_pairwise_joins(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_whole_training_job(spark):
    """Features, nearest articles, ranking, selection, forecast and comparison in one go."""
    from tidegrid.operators import sentiment
    from tidegrid.plans import jobs
    from tidegrid.plans.lexicon import lexicon
    from tidegrid.sources import market

    scored = sentiment.sentiment_series(market.articles(spark, FOLDER), lexicon(spark))
    result = jobs.train_and_compare(market.bars(spark, FOLDER), scored, 900)
    rows = result.metrics().collect()
    assert len(rows) == 5 and all(r["n"] > 0 and r["mse"] >= 0 for r in rows)
    assert result.loss().count() == 5


def test_every_candidate_is_ranked(spark):
    from tidegrid.plans import jobs

    scored = QUERIES["feature_scores_all"](spark, FOLDER).select("feature").distinct().collect()
    wanted = {name for name in jobs.MODEL_COLUMNS if name != "close"} | {"positive", "negative", "neutral"}
    # at this scale no series has the 200 bars of the longest average
    assert {r["feature"] for r in scored} == wanted - {"MA200"} and len(wanted) == 35


def test_forecast_queries_run_the_whole_job(spark, monkeypatch):
    from tidegrid.plans import jobs

    kept = []
    made = spark.range(1)
    monkeypatch.setattr(jobs, "train_and_compare", lambda bars, *_: kept.append(bars.columns) or jobs.Forecast(made, made))
    for name in ("forecast", "comparison"):
        assert QUERIES[name](spark, FOLDER).count() == 1
    assert len(kept) == 2


def test_completeness_asks_every_column(spark, monkeypatch):
    from tidegrid.operators import asof
    from tidegrid.plans import jobs

    asked = []
    monkeypatch.setattr(asof, "complete_rows", lambda df, columns: asked.append(list(columns)) or df)
    QUERIES["asof_complete_all"](spark, FOLDER)
    assert asked == [jobs.MODEL_COLUMNS] and len(asked[0]) == 33
