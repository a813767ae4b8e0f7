"""Bins of equal size against sorting in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import selection

SCHEMA = "symbol string, a double, b double, y double"


def plain_bins(values, bins):
    """Bin by bin as ``ntile`` deals sorted values; equal values go to the bin of the first of them."""
    kept = sorted(v for v in values if v is not None and not math.isnan(v))
    size, longer = divmod(len(kept), bins)
    tiles = [tile for tile in range(bins) for _ in range(size + (tile < longer))]
    first = {}
    for value, tile in zip(kept, tiles, strict=True):
        first.setdefault(value, tile)
    return [None if v is None or math.isnan(v) else first[v] for v in values]


def plain_information(xs, ys, bins):
    pairs = [(x, y) for x, y in zip(plain_bins(xs, bins), plain_bins(ys, bins), strict=True) if x is not None and y is not None]
    n, total = len(pairs), 0.0
    for x, y in set(pairs):
        both = pairs.count((x, y))
        of_x, of_y = sum(p[0] == x for p in pairs), sum(p[1] == y for p in pairs)
        total += both / n * math.log(both * n / (of_x * of_y))
    return total


def check(spark, rows, bins=10):
    table = spark.createDataFrame(rows, SCHEMA)
    found = {
        (r["symbol"], r["feature"]): r["mi"]
        for r in selection.mutual_information(table, ["a", "b"], "y", bins=bins, by="quantile").collect()
    }
    wanted = {}
    for symbol in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == symbol]
        for place, name in ((1, "a"), (2, "b")):
            xs, ys = [r[place] for r in own], [r[3] for r in own]
            if any(x is not None and not math.isnan(x) and y is not None for x, y in zip(xs, ys, strict=True)):
                wanted[symbol, name] = plain_information(xs, ys, bins)
    assert found.keys() == wanted.keys()
    for pair, value in wanted.items():
        assert found[pair] == pytest.approx(value, abs=1e-9), pair


def test_hot_symbol_ties_nulls_and_crowded_cells(spark):
    """One symbol holds most rows; values lie closer together than the finest cells, repeat, are NULL, NaN or outside [0, 1]."""
    chance = random.Random(5)
    rows = []
    for i in range(1500):
        symbol = "hot" if i % 3 else f"s{i % 4}"
        a = chance.choice([chance.random(), 0.25, 0.5 + chance.random() * 1e-12, None, math.nan, 1.0, 0.0])
        b = chance.choice([chance.random() * 1e-9, 3.0 + chance.random(), -2.0, 0.0, -0.0])
        rows.append((symbol, a, b, round(chance.random(), 2)))
    check(spark, rows)
    check(spark, rows, bins=7)


@pytest.mark.parametrize("count", [1, 2, 9, 10, 11])
def test_about_as_many_rows_as_bins(spark, count):
    check(spark, [("x", i / 16, 1.0, (i * 7 % count) / 16) for i in range(count)])


def test_feature_without_values_and_empty_table(spark):
    check(spark, [("x", None, i / 8, i / 8) for i in range(8)] + [("z", None, None, 0.5)])
    empty = spark.createDataFrame([], SCHEMA)
    assert selection.mutual_information(empty, ["a"], "y", by="quantile").count() == 0
    assert selection.feature_scores(empty, ["a"], "y", by="quantile").count() == 0


def test_large_tables_of_edges_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(selection, "MOST_BROADCAST_BYTES", 0)
    check(spark, [(f"s{i % 5}", (i * 37 % 101) / 101, (i * 11 % 17) / 17, (i * 53 % 97) / 97) for i in range(200)])


def test_edges_equal_ntile(spark):
    table = spark.range(5000).select(
        F.lit("x").alias("symbol"), (F.xxhash64("id") / F.lit(2.0**64) + 0.5).alias("a"), "id"
    )
    edges = selection.quantile_edges(table, ["a"]).collect()[0]["_edges_a"]
    ordered = sorted(r["a"] for r in table.collect())
    assert [(e["bin"], e["value"], e["own"]) for e in edges] == [(i, ordered[500 * i], True) for i in range(1, 10)]


def test_unknown_bins(spark):
    with pytest.raises(ValueError, match="unknown bins"):
        selection.mutual_information(spark.createDataFrame([], SCHEMA), ["a"], "y", by="depth")
