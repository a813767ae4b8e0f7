"""The reference flows end to end: training table, forecast, sentiment series, article listing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.text import CLASSES
from tidegrid.operators import fill, forecast, indicators, metrics, scaling, selection, sequences, window_model
from tidegrid.operators.asof import asof_join
from tidegrid.operators.series import ROW, ROWS, Laid, cut, lay_out
from tidegrid.schemas import BAR_VALUES
from tidegrid.session import cut_lineage

ARTICLE_TOLERANCE_SECONDS = 60
MODEL_COLUMNS = [*BAR_VALUES, *indicators.FEATURES]


def scaled_features(bars: DataFrame) -> Laid:
    """Bars with all indicators, scaled per series and filled forward, then backward.

    The features feed two summaries and the result, so they are kept in the shared folder rather than computed thrice.
    Filling only repeats values a column has, so it may come before the scaling and both can read the kept features.
    """
    laid = indicators.all_features(lay_out(bars))
    kept = recut(cut_lineage(laid.numbered()), laid)
    return scaling.minmax_scale(fill.fill(kept, MODEL_COLUMNS), MODEL_COLUMNS, base=kept)


def recut(numbered: DataFrame, like: Laid) -> Laid:
    """Rows that carry their numbers, in blocks of the same geometry."""
    return cut(numbered, like.key, like.time, like.block, like.back, like.ahead)


def combined_features(
    bars: DataFrame, sentiment: DataFrame, tolerance_seconds: int = ARTICLE_TOLERANCE_SECONDS
) -> Laid:
    """Scaled features with the class scores of the nearest article, carried over the bars between.

    The join, the search for series without articles and the fill all read the scores, so the texts are scored once and kept.
    """
    scaled = scaled_features(bars)
    sentiment = cut_lineage(sentiment.select(scaled.key, scaled.time, "article_id", *CLASSES))
    joined = asof_join(scaled.numbered(), sentiment, list(CLASSES), "nearest", tolerance_seconds)
    joined = fill.zero_without_articles(joined, sentiment, CLASSES, scaled.key)
    return fill.fill(recut(joined, scaled), CLASSES)


@dataclass(frozen=True)
class Forecast:
    scaled: DataFrame
    compared: DataFrame
    rounds: tuple[tuple[int, float, float, bool], ...] = ()

    def loss_history(self) -> DataFrame:
        """``round, train_loss, validation_loss, kept`` of a model trained by rounds; empty for others."""
        schema = "round int, train_loss double, validation_loss double, kept boolean"
        return self.scaled.sparkSession.createDataFrame(list(self.rounds), schema)

    def metrics(self) -> DataFrame:
        return metrics.regression_metrics(self.compared)

    def loss(self) -> DataFrame:
        return metrics.scaled_loss(self.scaled)


def forecast_close(bars: DataFrame, features: Sequence[str], method: str = "linear") -> Forecast:
    """Next close from the last 60 rows of the chosen columns: split by time, fitted, compared in price units."""
    scaled = scaling.minmax_scale(lay_out(bars), list(dict.fromkeys([*features, "close"])))
    return forecast_laid(scaled, features, scaling.scalers(bars, ["close"]), method)


def forecast_laid(scaled: Laid, features: Sequence[str], fitted: DataFrame, method: str = "linear") -> Forecast:
    """``linear``: ridge regression; ``descent``: the same model by rounds with early stopping; both from sums of products, without
    writing the sequences out. ``boosted``: trees on the sequences, stopped early by the validation rows."""
    if method == "boosted":
        made = sequences.sequences(scaled, features).numbered().select(scaled.key, scaled.time, ROW, ROWS, "x", "y")
        row, total = sequences.sequence_position()
        vectors = forecast.flat_vectors(sequences.validation_split(made, row, total)).drop(ROW, ROWS)
        model = forecast.fit_forecast(vectors, method)
        predicted = forecast.predict(model, vectors).select(scaled.key, scaled.time, "y", "predicted")
        return Forecast(predicted, forecast.comparison(predicted, fitted, key=scaled.key, time=scaled.time))
    if method not in ("linear", "descent"):
        raise ValueError(f"unknown method {method!r}")
    moments = window_model.WindowMoments.of(scaled, features)
    rounds: tuple[tuple[int, float, float, bool], ...] = ()
    if method == "linear":
        weights = window_model.least_squares(moments)
    else:
        found = window_model.descend(moments)
        weights, rounds = found.weights, tuple(found.history())
    predicted = window_model.predict_windows(scaled, features, weights)
    return Forecast(predicted, forecast.comparison(predicted, fitted, key=scaled.key, time=scaled.time), rounds)


def train_and_compare(
    bars: DataFrame, sentiment: DataFrame, tolerance_seconds: int = ARTICLE_TOLERANCE_SECONDS, method: str = "linear"
) -> Forecast:
    """The whole job: training table, ranking and selection of features, forecast, comparison.

    One model serves all series, so the features kept are those that were selected for at least half of them.
    """
    table = combined_features(bars, sentiment, tolerance_seconds)
    kept = recut(cut_lineage(table.numbered()), table)
    candidates = [name for name in MODEL_COLUMNS if name != "close"]
    scores = selection.feature_scores(kept.rows(), candidates, "close", by="quantile")
    chosen = selection.select_features(kept, scores, candidates, "close")
    series = chosen.select(kept.key).distinct().count()
    votes = chosen.groupBy("feature").count().filter(F.col("count") * 2 >= series)
    names = selection.feature_union([row["feature"] for row in votes.collect()], CLASSES)
    return forecast_laid(kept, names, scaling.scalers(bars, ["close"]), method)
