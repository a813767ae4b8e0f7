"""Feature ranking and selection against a target, per series.

Features and target are expected in [0, 1], as ``minmax_scale`` leaves them. A feature that is NULL throughout a series (a long
average of a short one) is no candidate there; rows with another NULL take no part, and the result says how many rows did.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.sequences import time_folds
from tidegrid.operators.series import BLOCK, ROW, ROWS, Laid
from tidegrid.session import cut_lineage

# The functions sent to the executors travel by value, so workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 10

#: Cells per step of the search for the values at which bins begin.
CELLS = 4096
#: Bytes of a table of one row per series up to which it is sent to every task.
MOST_BROADCAST_BYTES = 64 << 20


def _bin(value: Column, bins: int) -> Column:
    # greatest and least pass over NULLs, so those need a case of their own
    return F.when(value.isNotNull(), F.greatest(F.least(F.floor(value * bins), F.lit(bins - 1)), F.lit(0)).cast("int"))


def f_scores(df: DataFrame, features: Sequence[str], target: str, key: str = "symbol") -> DataFrame:
    """F statistic of the linear relation of each feature to the target; one aggregation for all features."""
    fits = []
    for name in features:
        fits += [
            F.regr_r2(target, name).alias(f"_r2_{name}"),
            F.regr_count(target, name).alias(f"_n_{name}"),
        ]
    rows = [
        F.struct(F.lit(n).alias("feature"), F.col(f"_r2_{n}").alias("r2"), F.col(f"_n_{n}").alias("n")) for n in features
    ]
    score = F.try_divide(F.col("r2") * (F.col("n") - 2), 1 - F.col("r2"))
    return df.groupBy(key).agg(*fits).select(key, F.inline(F.array(*rows))).select(key, "feature", score.alias("f_score"))


def _beside(df: DataFrame, table: DataFrame, key: str, row_bytes: int) -> DataFrame:
    """Joins a stored table of one row per series, sent to all tasks only if its counted size allows that."""
    small = table.count() * row_bytes <= MOST_BROADCAST_BYTES
    return df.join(F.broadcast(table) if small else table, key, "left")


def _per_series(table: DataFrame, key: str, features: Sequence[str], value: Column, prefix: str) -> DataFrame:
    """One row per series with a sorted array ``<prefix><feature>`` per feature, stored."""
    arrays = [F.array_sort(F.collect_set(F.when(F.col("feature") == n, value))).alias(f"{prefix}{n}") for n in features]
    return cut_lineage(table.groupBy(key).agg(*arrays))


def _with_places(counts: DataFrame, key: str, group: Sequence[str], by: str, start: Column) -> DataFrame:
    """``below``: values of the series in earlier cells, counted from ``start`` on within the group."""
    earlier = Window.partitionBy(key, "feature", *group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("below", start + F.coalesce(F.sum("count").over(earlier), F.lit(0)))


def _begins(bins: int) -> Column:
    """Places ``place`` (from 0) at which bins 1, 2, ... of ``n`` sorted values begin, the first ``n % bins`` being one longer."""
    n, j = F.col("n"), F.sequence(F.lit(1), F.lit(bins - 1))
    size, longer = F.floor(n / bins).cast("long"), n % bins
    places = F.transform(j, lambda i: F.struct(i.alias("bin"), (i * size + F.least(i.cast("long"), longer)).alias("place")))
    return F.filter(places, lambda p: p["place"] < n)


def _held(wanted: Column) -> Column:
    """Those of the wanted places that fall into a cell of ``count`` values after ``below`` others."""
    return F.filter(wanted, lambda p: (p["place"] >= F.col("below")) & (p["place"] < F.col("below") + F.col("count")))


def quantile_edges(df: DataFrame, features: Sequence[str], key: str = "symbol", bins: int = BINS) -> DataFrame:
    """One row per series with the values at which the bins of every feature begin, as ``ntile`` would cut them.

    ``_edges_<feature>`` is an array of ``bin, value, own``; ``own`` is false if equal values lie before the place, in the
    bin of the first of them. NULL and NaN take no part. No series is sorted in a task: values are counted in ``CELLS`` equal
    cells, then those cells that hold a wanted place are counted in ``CELLS`` cells each, and the values in the cells of
    that size that still hold one are counted one by one, equal ones as one row. Rows are exploded by feature only within
    their task; what is shuffled are counts. Exact for any values; cells suit values in [0, 1]. ``df`` is read three times, so it
    should be a stored table.
    """

    def cell(name: str, level: int) -> Column:
        top = float(CELLS**level)
        return F.floor(F.greatest(F.least(F.col(name), F.lit(1.0)), F.lit(0.0)) * top).cast("long")

    def known(name: str) -> Column:
        return F.col(name).isNotNull() & ~F.isnan(name)

    wide = df.select(key, *[F.col(n).cast("double").alias(n) for n in features])

    def counted(frame: DataFrame, picked: Mapping[str, Column], fields: Mapping[str, Mapping[str, Column]]) -> DataFrame:
        entries = [
            F.when(picked[n], F.struct(F.lit(n).alias("feature"), *[c.alias(f) for f, c in fields[n].items()])) for n in features
        ]
        long = frame.select(key, F.inline(F.array(*entries))).filter(F.col("feature").isNotNull())
        return long.groupBy(*long.columns).count()

    coarse = counted(wide, {n: known(n) for n in features}, {n: {"cell": cell(n, 1)} for n in features})
    whole = Window.partitionBy(key, "feature")
    placed = _with_places(coarse, key, (), "cell", F.lit(0).cast("long")).withColumn("n", F.sum("count").over(whole))
    cut = cut_lineage(placed.withColumn("wanted", _held(_begins(bins))).filter(F.size("wanted") > 0))
    row_bytes = len(features) * bins * 32
    for level in (1, 2):
        prefix = f"_cells{level}_"
        cells = _per_series(cut, key, features, F.col("cell"), prefix)
        frame = _beside(wide, cells, key, row_bytes)
        picked = {n: known(n) & F.array_contains(F.col(f"{prefix}{n}"), cell(n, level)) for n in features}
        finer = {n: cell(n, 2) if level == 1 else F.col(n) for n in features}
        counts = counted(frame, picked, {n: {"cell": cell(n, level), "finer": finer[n]} for n in features})
        outer = cut.select(key, "feature", "cell", F.col("below").alias("_start"), "wanted")
        placed = _with_places(counts.join(outer, [key, "feature", "cell"]), key, ("cell",), "finer", F.col("_start"))
        held = placed.withColumn("wanted", _held(F.col("wanted"))).filter(F.size("wanted") > 0)
        cut = cut_lineage(held.select(key, "feature", F.col("finer").alias("cell"), "below", "wanted"))
    found = cut.select(key, "feature", F.col("cell").alias("value"), "below", F.inline("wanted"))
    edge = F.struct("bin", "value", (F.col("below") == F.col("place")).alias("own"))
    return _per_series(found, key, features, edge, "_edges_")


def _quantile_bin(name: str) -> Column:
    value = F.when(~F.isnan(name), F.col(name).cast("double"))
    reached = F.filter(f"_edges_{name}", lambda e: (value > e["value"]) | (e["own"] & (value == e["value"])))
    count = F.when(F.col(f"_edges_{name}").isNull(), 0).otherwise(F.size(reached))  # a single value has no edges
    return F.when(value.isNotNull(), count)


def mutual_information(
    df: DataFrame, features: Sequence[str], target: str, key: str = "symbol", bins: int = BINS, by: str = "width"
) -> DataFrame:
    """Mutual information of each feature and the target over bins of equal width or, by ``"quantile"``, of equal size.

    Equal values share a bin. All features are counted in one shuffle of at most bins x bins rows per series and feature;
    for bins of equal size their edges are found first, which runs jobs at call time.
    """
    if by not in ("width", "quantile"):
        raise ValueError(f"unknown bins {by!r}")
    if by == "quantile":
        columns = list(dict.fromkeys([*features, target]))
        df = _beside(df, quantile_edges(df, columns, key, bins), key, len(columns) * bins * 32)
    binned = {n: _bin(F.col(n), bins) if by == "width" else _quantile_bin(n) for n in [*features, target]}
    cells = [F.struct(F.lit(n).alias("feature"), binned[n].alias("bx")) for n in features]
    long = df.select(key, binned[target].alias("by"), F.inline(F.array(*cells)))
    joint = long.filter(F.col("bx").isNotNull() & F.col("by").isNotNull()).groupBy(key, "feature", "bx", "by").count()
    table = Window.partitionBy(key, "feature")
    counted = joint.select(
        key,
        "feature",
        F.col("count").alias("n_xy"),
        F.sum("count").over(table).alias("n"),
        F.sum("count").over(Window.partitionBy(key, "feature", "bx")).alias("n_x"),
        F.sum("count").over(Window.partitionBy(key, "feature", "by")).alias("n_y"),
    )
    share = F.col("n_xy") / F.col("n")
    lift = F.col("n_xy").cast("double") * F.col("n") / (F.col("n_x").cast("double") * F.col("n_y"))
    return counted.groupBy(key, "feature").agg(F.sum(share * F.log(lift)).alias("mi"))


def feature_scores(
    df: DataFrame, features: Sequence[str], target: str, key: str = "symbol", bins: int = BINS, by: str = "width"
) -> DataFrame:
    """``feature, f_score, mi, place`` per series, best first by mutual information; without features NULL throughout the series."""
    scores = f_scores(df, features, target, key).join(
        mutual_information(df, features, target, key, bins, by), [key, "feature"]
    )
    best = Window.partitionBy(key).orderBy(F.round("mi", 9).desc(), "feature")
    return scores.withColumn("place", F.row_number().over(best))


def _moments(laid: Laid, columns: Sequence[str], folds: int) -> DataFrame:
    """Sums of all products of two columns (a leading 1 included) by series and fold: ``fold, cell, value``.

    Each block multiplies its own rows in its task; one row per block, fold and cell is then summed up. Columns that are NULL
    throughout a series are 0 there.
    """
    counts = laid.summary([F.count(F.col(n)).alias(f"_count_{n}") for n in columns])
    series = laid.blocks_all()
    held = counts.select(laid.key, BLOCK, *[F.sum(f"_count_{n}").over(series).alias(f"_count_{n}") for n in columns])
    known = laid.join_blocks(held).with_columns({n: F.when(F.col(f"_count_{n}") > 0, F.col(n)).otherwise(0.0) for n in columns})
    own = time_folds(known.frame.filter(laid.is_own), F.col(ROW), F.col(ROWS), folds)
    frame = own.select(laid.key, BLOCK, "fold", *[F.col(n).cast("double").alias(n) for n in columns])
    schema = T.StructType(
        [
            frame.schema[laid.key],
            T.StructField("fold", T.IntegerType()),
            T.StructField("cells", T.ArrayType(T.DoubleType())),
        ]
    )
    key, names = laid.key, list(columns)

    def products(table: pa.Table) -> pa.Table:
        fold = table.column("fold").to_numpy()
        values = np.column_stack([np.ones(len(fold))] + [table.column(n).to_numpy() for n in names])
        kept = ~np.isnan(values).any(axis=1)
        present = [int(f) for f in np.unique(fold)]
        sums = [(values[(fold == f) & kept].T @ values[(fold == f) & kept]).ravel() for f in present]
        series = table.column(key)[0].as_py()
        return pa.table(
            {
                key: pa.array([series] * len(present), table.schema.field(key).type),
                "fold": pa.array(present, pa.int32()),
                "cells": pa.array([s.tolist() for s in sums], pa.list_(pa.float64())),
            }
        )

    blocks = frame.groupBy(laid.key, BLOCK).applyInArrow(products, schema)
    return (
        blocks.select(laid.key, "fold", F.posexplode("cells").alias("cell", "value"))
        .groupBy(laid.key, "fold", "cell")
        .agg(F.sum("value").alias("value"))
    )


def select_features(
    laid: Laid, scores: DataFrame, features: Sequence[str], target: str, folds: int = 5, ridge: float = 1e-9
) -> DataFrame:
    """The best-ranked features up to the number that forecasts best: ``feature, place, size_rmse, rows_used``.

    Every prefix of the ranking is fitted by least squares on expanding time folds. All fits need only the sums of
    products per fold, so the data are read once whatever the number of features and folds; the systems solved per
    series are of the size of the feature list. Features that a series does not have are not in its ``scores``. A series too
    short for any fold selects nothing.
    """
    columns = [*features, target]
    moments = _moments(laid, columns, folds)
    ranking = scores.select(laid.key, "feature", "place")
    schema = T.StructType(
        [
            moments.schema[laid.key],
            T.StructField("feature", T.StringType()),
            T.StructField("place", T.IntegerType()),
            T.StructField("size_rmse", T.DoubleType()),
            T.StructField("rows_used", T.LongType()),
        ]
    )
    key, names, side = laid.key, list(features), len(columns) + 1

    def choose(sums: pa.Table, ranked: pa.Table) -> pa.Table:
        kinds = [sums.schema.field(key), ("feature", pa.string()), ("place", pa.int32()), ("size_rmse", pa.float64()), ("rows_used", pa.int64())]
        empty = pa.schema(kinds).empty_table()
        if sums.num_rows == 0 or ranked.num_rows == 0:
            return empty
        by_fold = np.zeros((folds + 1, side * side))
        by_fold[sums.column("fold").to_numpy(), sums.column("cell").to_numpy()] = sums.column("value").to_numpy()
        by_fold = by_fold.reshape(folds + 1, side, side)
        order = sorted(zip(ranked.column("place").to_pylist(), ranked.column("feature").to_pylist(), strict=True))
        order = [name for _, name in order]
        rmse = []
        for size in range(1, len(order) + 1):
            use = [0] + [1 + names.index(name) for name in order[:size]]
            errors = []
            for fold in range(1, folds + 1):
                train, test = by_fold[:fold].sum(axis=0), by_fold[fold]
                if train[0, 0] < 1 or test[0, 0] < 1:
                    continue
                system = train[np.ix_(use, use)] + ridge * np.eye(len(use))
                weights = np.linalg.lstsq(system, train[use, -1], rcond=None)[0]
                squares = test[-1, -1] - 2 * weights @ test[use, -1] + weights @ test[np.ix_(use, use)] @ weights
                errors.append(np.sqrt(max(squares, 0.0) / test[0, 0]))
            if not errors:
                return empty
            rmse.append(float(np.mean(errors)))
        best = int(np.argmin(rmse)) + 1
        series = sums.column(key)[0].as_py()
        return pa.table(
            {
                key: pa.array([series] * best, sums.schema.field(key).type),
                "feature": order[:best],
                "place": pa.array(range(1, best + 1), pa.int32()),
                "size_rmse": pa.array(rmse[:best], pa.float64()),
                "rows_used": pa.array([int(by_fold[:, 0, 0].sum())] * best, pa.int64()),
            }
        )

    return moments.groupBy(key).cogroup(ranking.groupBy(key)).applyInArrow(choose, schema)


def feature_union(selected: Sequence[str], extra: Sequence[str]) -> list[str]:
    """Sorted union of column names."""
    return sorted(set(selected) | set(extra))
