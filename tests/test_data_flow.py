"""Sources, sequences, splits, ranking, selection, forecasts and streams."""

import json
import math
import random
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain
from test_indicators import collected, frame
from tidegrid.operators import forecast, metrics, resample, scaling, selection, sequences, window_model
from tidegrid.operators.series import ROW, ROWS, lay_out
from tidegrid.plans import jobs
from tidegrid.sources import bars as bar_source
from tidegrid.sources import news
from tidegrid.streaming import indicators as live
from tidegrid.streaming import jobs as live_jobs
from tidegrid.streaming import late as live_late

MINUTE = datetime(2024, 1, 2, 14, 30)


def test_bar_pages_round_trip(spark, tmp_path):
    df = frame(spark, plain.walk("A", 25) + plain.walk("B", 3, 2))
    path = str(tmp_path / "pages")
    bar_source.write_bar_pages(df, path, limit=10)
    assert sorted(map(tuple, bar_source.read_bar_pages(spark, path).collect())) == sorted(map(tuple, df.collect()))
    pages = [json.loads(r["value"]) for r in spark.read.text(path).collect()]
    assert sorted(len(p["bars"]) for p in pages) == [3, 5, 10, 10]
    assert sum(p["next_page_token"] is None for p in pages) == 2
    later = bar_source.read_bar_pages(spark, path, start=plain.START + timedelta(minutes=20))
    assert later.count() == 5


def test_bar_pages_without_bars_and_broken_pages(spark, tmp_path):
    folder = tmp_path / "symbol=A"
    folder.mkdir()
    (folder / "p.json").write_text('{"bars": null, "next_page_token": null}\n{"bars": []}\n')
    assert bar_source.read_bar_pages(spark, str(tmp_path)).collect() == []
    (folder / "q.json").write_text('{"bars": [{"t": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        bar_source.read_bar_pages(spark, str(tmp_path)).collect()


def test_bars_table_round_trip(spark, tmp_path):
    df = frame(spark, plain.walk("A", 25) + plain.walk("B", 3, 2))
    bar_source.write_bars(df, str(tmp_path / "bars"))
    assert sorted(map(tuple, bar_source.read_bars(spark, str(tmp_path / "bars")).collect())) == sorted(map(tuple, df.collect()))


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert {r["x"] for r in bar_source.without_nan(df).collect()} == {None, 1.0}


def test_news_pages(spark, tmp_path):
    page = {
        "news": [
            {"id": 1, "created_at": "2024-01-02T10:00:00Z", "headline": "h", "content": "c", "symbols": ["a", "b"]},
            {"id": 2, "created_at": "2024-01-03T10:00:00Z", "headline": "h", "content": "", "symbols": ["A"]},
        ]
    }
    (tmp_path / "p.json").write_text(json.dumps(page) + "\n")
    read = news.read_news_pages(spark, str(tmp_path))
    assert [(r["article_id"], r["symbol"]) for r in news.newest_first(read).collect()][0] == (2, "A")
    assert read.count() == 3
    assert news.read_news_pages(spark, str(tmp_path), symbol="a", drop_contentless=True).count() == 1


def test_bars_from_ticks_order_ties_and_zero_size(spark):
    ticks = [("A", MINUTE, 2, 5.0, 0.0), ("A", MINUTE, 1, 4.0, 0.0), ("A", MINUTE + timedelta(seconds=59), 3, 9.0, 0.0), ("A", MINUTE + timedelta(minutes=1), 4, 7.0, 2.0)]
    df = spark.createDataFrame(ticks, "symbol string, ts timestamp, seq bigint, price double, size double")
    first, second = resample.resample_ticks(df, "1 minute").orderBy("t").collect()
    assert (first["open"], first["high"], first["low"], first["close"], first["n"], first["vw"]) == (4, 9, 4, 9, 3, None)
    assert (second["t"], second["vw"]) == (MINUTE + timedelta(minutes=1), 7.0)


def test_daily_bars_follow_the_eastern_day(spark):
    ticks = [("A", datetime(2024, 7, 2, 3, 59), 1, 1.0, 1.0), ("A", datetime(2024, 7, 2, 4, 0), 2, 2.0, 1.0)]
    df = spark.createDataFrame(ticks, "symbol string, ts timestamp, seq bigint, price double, size double")
    days = resample.resample_ticks(df, daily=True).orderBy("t").collect()
    assert [(r["t"].day, r["close"]) for r in days] == [(1, 1.0), (2, 2.0)]


@pytest.mark.parametrize(("count", "made"), [(60, 0), (61, 1), (75, 15)])
def test_sequences(spark, count, made):
    rows = plain.walk("A", count)
    laid = sequences.sequences(lay_out(frame(spark, rows), block=16, back=64), ["open", "v"])
    got = collected(laid)
    assert len(got) == made
    for i, row in enumerate(got):
        assert row["y"] == rows[60 + i]["close"]
        assert row["x"] == [[r["open"], r["v"]] for r in rows[i : i + 60]]


def test_splits_have_the_right_sizes(spark):
    laid = lay_out(frame(spark, plain.walk("A", 103) + plain.walk("B", 7, 3)), block=16, back=0)
    numbered = laid.numbered()
    for symbol, n in (("A", 103), ("B", 7)):
        test = math.ceil(0.2 * n)
        split = sequences.time_split(numbered, F.col(ROW), F.col(ROWS)).filter(F.col("symbol") == symbol).orderBy("t")
        assert [r["split"] for r in split.collect()] == ["train"] * (n - test) + ["test"] * test
        valid = sequences.validation_split(numbered, F.col(ROW), F.col(ROWS)).filter(F.col("symbol") == symbol).orderBy("t")
        cut = math.floor(0.8 * (n - test))
        assert [r["split"] for r in valid.collect()] == ["train"] * cut + ["validation"] * (n - test - cut) + ["test"] * test
        shuffled = sequences.shuffled_split(laid).filter(F.col("symbol") == symbol).orderBy("t").collect()
        names = [r["split"] for r in shuffled]
        assert names.count("test") == test and len(names) == n
        if symbol == "A":
            assert names != ["train"] * (n - test) + ["test"] * test


def test_folds(spark):
    numbered = lay_out(frame(spark, plain.walk("A", 23)), back=0).numbered()
    folds = [r["fold"] for r in sequences.time_folds(numbered, F.col(ROW), F.col(ROWS), 3).orderBy("t").collect()]
    assert folds == [0] * 8 + [1] * 5 + [2] * 5 + [3] * 5


def test_metrics_of_constant_targets(spark):
    df = spark.createDataFrame([("A", 1.0, 1.0), ("A", 1.0, 1.0), ("B", 1.0, 2.0), ("C", 1.0, 2.0), ("C", 3.0, 2.0)], "symbol string, actual double, predicted double")
    assert {r["symbol"]: r["r2"] for r in metrics.regression_metrics(df).collect()} == {"A": 1.0, "B": 0.0, "C": 0.0}


def _scaled(spark, count=400):
    laid = lay_out(frame(spark, plain.walk("A", count) + plain.walk("B", count, 4)), block=64)
    return scaling.minmax_scale(laid, ["open", "high", "low", "v", "n", "close"])


def test_selection_equals_least_squares_on_the_folds(spark):
    laid, names = _scaled(spark), ["open", "high", "low", "v", "n"]
    scores = selection.feature_scores(laid.rows(), names, "close")
    chosen = selection.select_features(laid, scores, names, "close", folds=4)
    for symbol in "AB":
        data = laid.rows().filter(F.col("symbol") == symbol).orderBy("t").toPandas()
        ranked = scores.filter(F.col("symbol") == symbol).orderBy("place").toPandas()
        target = data["close"].to_numpy()
        x_bin, y_bin = (np.clip(np.floor(data[c].to_numpy() * 10), 0, 9).astype(int) for c in ("open", "close"))
        joint = np.histogram2d(x_bin, y_bin, bins=[range(11)] * 2)[0] / len(data)
        outer = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
        information = (joint[joint > 0] * np.log(joint[joint > 0] / outer[joint > 0])).sum()
        assert ranked.set_index("feature")["mi"]["open"] == pytest.approx(information)
        r2 = np.corrcoef(data["high"], target)[0, 1] ** 2
        assert ranked.set_index("feature")["f_score"]["high"] == pytest.approx(r2 * (len(data) - 2) / (1 - r2))
        order, size = ranked["feature"].tolist(), len(data) // 5
        first, rmse = len(data) - 4 * size, []
        for k in range(1, 6):
            x = np.column_stack([np.ones(len(data)), data[order[:k]].to_numpy()])
            errors = []
            for fold in range(4):
                end = first + fold * size
                weights = np.linalg.lstsq(x[:end], target[:end], rcond=None)[0]
                errors.append(np.sqrt(np.mean((target[end : end + size] - x[end : end + size] @ weights) ** 2)))
            rmse.append(np.mean(errors))
        got = chosen.filter(F.col("symbol") == symbol).orderBy("place").collect()
        best = int(np.argmin(rmse)) + 1
        assert [r["feature"] for r in got] == order[:best]
        assert [r["size_rmse"] for r in got] == pytest.approx(rmse[:best], rel=1e-4)


def test_feature_union():
    assert selection.feature_union(["b", "a"], ["c", "a"]) == ["a", "b", "c"]


@pytest.mark.parametrize("method", ["linear", "boosted", "descent"])
def test_forecast_of_a_learnable_series(spark, method):
    rows = plain.walk("A", 400)
    for i, row in enumerate(rows):
        row["close"] = 10 + math.sin(i / 5)
    result = jobs.forecast_close(frame(spark, rows), ["close"], method)
    score = result.metrics().first()
    assert score["n"] == math.ceil(0.2 * 340)
    assert score["r2"] > 0.9
    times = [r["t"] for r in result.compared.orderBy("t").collect()]
    assert times[-1] == rows[-1]["t"] and len(times) == score["n"]


def _short_and_long(spark):
    """A series of 150 bars, one of 700 and one of 3, laid out in blocks of 128 rows with every indicator."""
    from tidegrid.operators.series import lay_out

    rows = plain.walk("A", 150) + plain.walk("B", 700) + plain.walk("C", 3)
    bars = frame(spark, rows)
    laid = jobs.scaled_features(bars)
    return jobs.recut(laid.numbered(), lay_out(bars, block=128, back=64)), bars


def test_selection_of_a_series_too_short_for_some_columns(spark):
    laid, _ = _short_and_long(spark)
    names = ["open", "high", "RSI", "MA50", "MA200"]
    scores = selection.feature_scores(laid.rows(), names, "close")
    found = selection.select_features(laid, scores, names, "close").toPandas()
    short, long = found[found.symbol == "A"], found[found.symbol == "B"]
    assert "MA200" not in set(scores.filter("symbol = 'A'").toPandas().feature)
    assert "MA200" in set(scores.filter("symbol = 'B'").toPandas().feature)
    assert set(short.rows_used) == {150} and set(long.rows_used) == {700}
    assert np.isfinite(found.size_rmse).all() and "C" not in set(found.symbol)


def _written_out(laid, features, rows=60):
    """The sequences of a layout, as matrices per split."""
    data = laid.numbered().toPandas().sort_values(["symbol", "_row"])
    parts = {"train": [], "validation": [], "test": []}
    for _, own in data.groupby("symbol"):
        x, y = own[features].fillna(0.0).to_numpy(dtype=float), own["close"].to_numpy(dtype=float)
        total = max(len(own) - rows, 0)
        train = total - math.ceil(total * 0.2)
        cut = math.floor(train * 0.8)
        for k in range(total):
            name = "train" if k < cut else "validation" if k < train else "test"
            parts[name].append((x[k : k + rows].ravel(), y[k + rows]))
    return {name: (np.array([a for a, _ in found]), np.array([b for _, b in found])) for name, found in parts.items()}


def test_window_model_equals_the_written_out_one(spark):
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import LinearRegression

    laid, _ = _short_and_long(spark)
    features = ["close", "RSI", "MA200"]
    moments = window_model.WindowMoments.of(laid, features)
    parts = _written_out(laid, features)
    for name, (x, y) in parts.items():
        cells = np.column_stack([np.ones(len(x)), x, y])
        assert np.allclose(moments.sums[name], cells.T @ cells, atol=1e-9)
    x = np.concatenate([parts["train"][0], parts["validation"][0]])
    y = np.concatenate([parts["train"][1], parts["validation"][1]])
    rows = [(float(b), Vectors.dense(a)) for a, b in zip(x, y, strict=True)]
    learner = LinearRegression(labelCol="y", regParam=1e-3, elasticNetParam=0.0, solver="normal")
    model = learner.fit(spark.createDataFrame(rows, ["y", "features"]))
    weights = window_model.least_squares(moments)
    assert np.allclose(weights[1:], model.coefficients.toArray(), atol=1e-9) and weights[0] == pytest.approx(model.intercept, abs=1e-9)
    found = window_model.predict_windows(laid, features, weights).toPandas()
    x, y = parts["test"]
    assert sorted(found.predicted) == pytest.approx(sorted(x @ weights[1:] + weights[0])) and sorted(found.y) == pytest.approx(sorted(y))


def test_losses_of_the_rounds_are_those_of_their_weights(spark):
    laid, bars = _short_and_long(spark)
    moments = window_model.WindowMoments.of(laid, ["close", "RSI"])
    parts = _written_out(laid, ["close", "RSI"])
    done = window_model.descend(moments, rounds=60, patience=3, rate=0.05)
    for _, train, held, weights in done.rounds:
        for name, loss in (("train", train), ("validation", held)):
            x, y = parts[name]
            assert loss == pytest.approx(np.mean((x @ weights[1:] + weights[0] - y) ** 2), rel=1e-6, abs=1e-12)
    held = [r[2] for r in done.rounds]
    assert done.best == int(np.argmin(held)) and held[0] > held[done.best]
    assert len(held) == 60 or len(held) - 1 - done.best == 3
    result = jobs.forecast_laid(laid, ["close", "RSI"], scaling.scalers(bars, ["close"]), "descent")
    history = result.loss_history().toPandas()
    assert history["kept"].sum() == 1 and history.columns.tolist() == ["round", "train_loss", "validation_loss", "kept"]
    assert jobs.forecast_laid(laid, ["close"], scaling.scalers(bars, ["close"])).loss_history().count() == 0


def test_window_model_of_no_and_of_few_rows(spark):
    laid, _ = _short_and_long(spark)
    for kept in (laid.frame.filter("symbol = 'C'"), laid.frame.limit(0)):
        few = replace(laid, frame=kept)
        moments = window_model.WindowMoments.of(few, ["close"])
        weights = window_model.least_squares(moments)
        assert not weights.any() and len(window_model.descend(moments).rounds) == 1
        assert window_model.predict_windows(few, ["close"], weights).count() == 0


def test_forecast_plan_holds_no_sequences(spark):
    laid, bars = _short_and_long(spark)
    plan = jobs.forecast_laid(laid, ["close", "v"], scaling.scalers(bars, ["close"])).compared._jdf.queryExecution().optimizedPlan()
    assert "collect_list" not in plan.toString()


def test_unknown_method(spark):
    _, bars = _short_and_long(spark)
    with pytest.raises(ValueError):
        jobs.forecast_close(bars, ["close"], "guess")

    with pytest.raises(ValueError):
        forecast.fit_forecast(None, "guess")


def test_stream_of_ticks_in_several_files_equals_the_batch(spark, tmp_path):
    rng = random.Random(3)
    ticks = [("A" if rng.random() < 0.8 else "B", MINUTE + timedelta(seconds=rng.randint(0, 3600)), i, rng.random() * 9, 1.0) for i in range(400)]
    df = spark.createDataFrame(ticks, "symbol string, ts timestamp, seq bigint, price double, size double")
    for part in range(4):
        df.filter(F.col("seq") % 4 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live_jobs.upsert_batches(live_jobs.stream_bars(stream, "5 minutes", "2 hours"), str(tmp_path / "out"), str(tmp_path / "log"))
    query.awaitTermination()
    batch = resample.resample_ticks(df, "5 minutes")
    latest = live_jobs.latest_rows(spark, str(tmp_path / "out"), ["symbol", "t"]).select(*batch.columns)
    rounded = [F.round(c, 9).alias(c) if c in ("v", "vw") else F.col(c) for c in batch.columns]
    assert sorted(map(tuple, latest.select(*rounded).collect())) == sorted(map(tuple, batch.select(*rounded).collect()))


def _bars_of(df):
    rounded = [F.round(c, 9).alias(c) if c in ("v", "vw") else F.col(c) for c in ("symbol", "t", "open", "high", "low", "close", "v", "n", "vw")]
    return sorted(map(tuple, df.select(*rounded).collect()), key=repr)


def _batches_of(spark, batches, path, delay="10 minutes"):
    """Ticks taken batch by batch."""
    for batch_id, rows in enumerate(batches):
        live_late.take_ticks(spark.createDataFrame(rows, live_late.TICK), batch_id, path, "5 minutes", delay)


def test_late_ticks_wait_in_a_table_until_their_bars_are_repaired(spark, tmp_path):
    rng = random.Random(7)
    path = str(tmp_path)
    ticks = [("A" if rng.random() < 0.8 else None, MINUTE + timedelta(seconds=rng.randint(0, 3600)), i, rng.random() * 9, 1.0) for i in range(300)]
    ticks += [("A", MINUTE, 900, None, None), ("A", MINUTE, 901, 5.0, 0.0), ("A", MINUTE, 901, 5.0, 0.0)]
    batches = [ticks[k::3] for k in range(3)]
    _batches_of(spark, batches, path)
    newest, late, known = None, [], []
    for batch_id, rows in enumerate(batches):
        for tick in rows:
            end = MINUTE + timedelta(minutes=5 * ((tick[1] - MINUTE) // timedelta(minutes=5) + 1))
            behind = newest is not None and end <= newest - timedelta(minutes=10)
            (late if behind else known).append((*tick, batch_id) if behind else tick)
        newest = max([tick[1] for tick in rows] + [newest or rows[0][1]])
    assert late and sorted(map(tuple, live_late.late_ticks(spark, path).collect()), key=repr) == sorted(late, key=repr)
    whole = resample.resample_ticks(spark.createDataFrame(ticks, live_late.TICK), "5 minutes")
    in_time = resample.resample_ticks(spark.createDataFrame(known, live_late.TICK), "5 minutes")
    assert _bars_of(live_late.followed_bars(spark, path)) == _bars_of(in_time)
    _batches_of(spark, batches, path)  # repeated batches change nothing
    changed = _bars_of(live_late.repair_late(spark, path, "5 minutes"))
    keys = {(tick[0], MINUTE + timedelta(minutes=5 * ((tick[1] - MINUTE) // timedelta(minutes=5)))) for tick in late}
    assert changed == [row for row in _bars_of(whole) if row[:2] in keys]
    assert live_late.repair_late(spark, path, "5 minutes").count() == 0
    assert _bars_of(live_late.followed_bars(spark, path)) == _bars_of(whole)


def test_late_tables_of_no_ticks_and_of_ticks_without_a_time(spark, tmp_path):
    path = str(tmp_path)
    assert live_late.followed_bars(spark, path).count() == 0 and live_late.repair_late(spark, path, "5 minutes").count() == 0
    _batches_of(spark, [[], [("A", None, 1, 2.0, 1.0)], [("A", MINUTE, 2, 2.0, 1.0)]], path)
    assert live_late.late_ticks(spark, path).count() == 0
    assert [row["n"] for row in live_late.followed_bars(spark, path).collect()] == [1]


def test_stream_counts_a_repeated_article_once(spark, tmp_path):
    lexicon = spark.createDataFrame([("up", "positive", 1.0)], "word string, class string, weight double")
    rows = [(1, "A", MINUTE, "up", "x"), (2, "A", MINUTE, "x", "x")]
    df = spark.createDataFrame(rows, "article_id bigint, symbol string, created_at timestamp, headline string, content string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live_jobs.follow_sentiment(stream, lexicon, str(tmp_path / "out"), str(tmp_path / "log"), "1 hour").awaitTermination()
    row = live_jobs.minute_means(spark, str(tmp_path / "out")).first()
    chance = math.e / (math.e + 2)
    assert row["articles"] == 2 and row["positive"] == pytest.approx((chance + 1 / 3) / 2)


def test_stream_scores_with_a_lexicon_of_any_size(spark, tmp_path):
    words = spark.range(50_000).selectExpr("concat('w', id) AS word", "element_at(array('positive', 'negative', 'neutral'), cast(id % 3 AS int) + 1) AS class", "1.0 + id % 7 AS weight")
    rng = random.Random(2)
    rows = [(k, rng.choice("AB"), MINUTE + timedelta(seconds=rng.randint(0, 300)), f"w{rng.randrange(60_000)} x", f"<p>w{rng.randrange(60_000)}</p>") for k in range(200)]
    rows += [(900, "A", MINUTE, None, None)]
    df = spark.createDataFrame(rows, "article_id bigint, symbol string, created_at timestamp, headline string, content string")
    for part in range(4):
        df.filter(F.col("article_id") % 4 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live_jobs.follow_sentiment(stream, words, str(tmp_path / "out"), str(tmp_path / "log"), "1 hour").awaitTermination()
    found = live_jobs.minute_means(spark, str(tmp_path / "out")).toPandas().sort_values(["symbol", "t"])
    sums = live_jobs.minute_sums(df, words).toPandas().sort_values(["symbol", "t"])
    assert found["articles"].tolist() == sums["articles"].tolist() and found["articles"].sum() == 201
    assert found["negative"].tolist() == pytest.approx((sums["negative"] / sums["articles"]).tolist())


def _streamed(spark, rows, folder, files, **kept):
    df = frame(spark, rows)
    order = list(range(files))
    random.Random(files).shuffle(order)
    for part in order:
        df.filter(F.pmod(F.xxhash64("symbol", "t"), F.lit(files)) == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    live.follow_indicators(stream, f"{folder}/out", f"{folder}/log", **kept)
    shown = live.shown_indicators(spark, f"{folder}/out").orderBy("symbol", "t").collect()
    return [r.asDict() for r in shown], live.late_bars(spark, f"{folder}/out").collect()


def test_online_indicators_of_ten_files_in_any_order_equal_the_loops(spark, tmp_path):
    rows = plain.walk("A", 150) + plain.walk("B", 40, 2)
    shown, late = _streamed(spark, rows, str(tmp_path), 10, bucket_seconds=1800)
    assert late == [] and len(shown) == len(rows)
    for symbol in "AB":
        own, got = [r for r in rows if r["symbol"] == symbol], [r for r in shown if r["symbol"] == symbol]
        close = [r["close"] for r in own]
        plain.assert_column(got, "EMA20", plain.ema(close))
        plain.assert_column(got, "RSI", plain.rsi(close))
        plain.assert_column(got, "PSAR", plain.psar([r["high"] for r in own], [r["low"] for r in own]))


def test_bars_behind_the_kept_buckets_come_out_late(spark, tmp_path):
    rows = plain.walk("A", 120)
    shown, late = _streamed(spark, rows, str(tmp_path), 5, bucket_seconds=600, kept_buckets=2)
    assert late and len(shown) + len(late) == len(rows)
    assert {r["t"] for r in shown} | {r["t"] for r in late} == {r["t"] for r in rows}
    assert not {r["t"] for r in shown} & {r["t"] for r in late}


def test_online_state_equals_the_loops():
    rows = plain.walk("A", 200)
    state = dict.fromkeys(live.RUNNING.names, 0.0) | {"bars": 0}
    shown = []
    for row in rows:
        state = live.step_bar(state, row["high"], row["low"], row["close"])
        shown.append(dict(zip(("EMA20", "RSI", "PSAR"), state.pop("shown"))))
    close = [r["close"] for r in rows]
    plain.assert_column(shown, "EMA20", plain.ema(close))
    plain.assert_column(shown, "RSI", plain.rsi(close))
    plain.assert_column(shown, "PSAR", plain.psar([r["high"] for r in rows], [r["low"] for r in rows]))
