import pytest
from pyspark.sql import functions as F

import plain
from tidegrid.operators import fill, indicators, psar, scaling
from tidegrid.operators.series import lay_out, number_rows
from tidegrid.schemas import BARS

COUNT = 3000


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in BARS.names) for r in rows], BARS)


def collected(laid, symbol=None):
    df = laid.rows() if hasattr(laid, "rows") else laid
    if symbol is not None:
        df = df.filter(F.col("symbol") == symbol)
    return df.orderBy("symbol", "t").collect()


@pytest.fixture(scope="module")
def rows():
    return plain.walk("A", COUNT)


@pytest.fixture(scope="module")
def blocks(spark, rows):
    """One long series in blocks of 512 rows, numbered over buckets of 10 hours, and a short series beside it."""
    return lay_out(frame(spark, rows + plain.walk("B", 300, seed=2)), bucket_seconds=36000, block=512)


@pytest.fixture(scope="module")
def features(blocks):
    return collected(indicators.all_features(blocks), "A")


def test_row_numbers_span_buckets(spark, rows):
    numbered = number_rows(frame(spark, rows).repartition(7), bucket_seconds=3600).orderBy("t").collect()
    assert [r["_row"] for r in numbered] == list(range(COUNT))
    assert {r["_rows"] for r in numbered} == {COUNT}


def test_every_row_comes_back_once(blocks):
    assert [r["t"] for r in collected(blocks, "A")] == sorted({r["t"] for r in collected(blocks, "A")})
    assert blocks.rows().count() == COUNT + 300


def test_recursions_equal_loops_across_blocks(features, rows):
    high, low, close, volume = ([r[n] for r in rows] for n in ("high", "low", "close", "v"))
    plain.assert_column(features, "EMA20", plain.ema(close))
    plain.assert_column(features, "RSI", plain.rsi(close))
    line, signal = plain.macd(close)
    plain.assert_column(features, "MACD", line)
    plain.assert_column(features, "Signal", signal)
    plain.assert_column(features, "ATR", plain.atr(high, low, close))
    plain.assert_column(features, "CMF", plain.chaikin(high, low, close, volume), 1e-8)
    plain.assert_column(features, "OBV", plain.obv(close, volume))


@pytest.mark.parametrize("block", [512, 8192])
def test_long_periods_equal_loops(spark, rows, block):
    """Averages whose past spans many blocks, beside a series too short for them and one with missing prices."""
    gaps = [r if i % 50 else r | {"close": None} for i, r in enumerate(plain.walk("C", 1500, seed=3))]
    laid = lay_out(frame(spark, rows + plain.walk("B", 300, seed=2) + gaps), bucket_seconds=36000, block=block)
    high, low, close = ([r[n] for r in rows] for n in ("high", "low", "close"))
    for period in (100, 700, 2500):
        got = collected(indicators.ema(laid, period))
        plain.assert_column([r for r in got if r["symbol"] == "A"], f"EMA{period}", plain.ema(close, period))
        short = [r for r in got if r["symbol"] == "B"]
        plain.assert_column(short, f"EMA{period}", plain.ema([r["close"] for r in short], period))
    plain.assert_column(collected(indicators.rsi(laid, 600), "A"), "RSI", plain.rsi(close, 600))
    plain.assert_column(collected(indicators.atr(laid, 600), "A"), "ATR", plain.atr(high, low, close, 600))
    known = [r["close"] for r in gaps[:300] if r["close"] is not None]
    value, weight, wanted = plain.mean(known), 2 / 301, [None] * 299
    wanted.append(value)
    for r in gaps[300:]:
        value = (1 - weight) * value + (0.0 if r["close"] is None else weight * r["close"])
        wanted.append(value)
    plain.assert_column(collected(indicators.ema(laid, 300), "C"), "EMA300", wanted)


def test_windows_equal_loops_across_blocks(features, rows):
    high, low, close = ([r[n] for r in rows] for n in ("high", "low", "close"))
    for period in (20, 50, 200):
        expected = [plain.mean(close[i - period + 1 : i + 1]) if i >= period - 1 else None for i in range(COUNT)]
        plain.assert_column(features, f"MA{period}", expected)
    weights = [sum((j + 1) * close[i - 19 + j] for j in range(20)) / 210 if i >= 19 else None for i in range(COUNT)]
    plain.assert_column(features, "WMA20", weights)
    for name, period in (("Tenkan", 9), ("Kijun", 26)):
        middle = [(max(high[i - period + 1 : i + 1]) + min(low[i - period + 1 : i + 1])) / 2 if i >= period - 1 else None for i in range(COUNT)]
        plain.assert_column(features, name, middle)
    senkou = [(max(high[i - 77 : i - 25]) + min(low[i - 77 : i - 25])) / 2 if i >= 77 else None for i in range(COUNT)]
    plain.assert_column(features, "SenkouB", senkou)
    plain.assert_column(features, "Chikou", [close[i + 26] if i + 26 < COUNT else None for i in range(COUNT)])


def test_parabolic_sar_equals_loop_across_blocks(features, rows):
    plain.assert_column(features, "PSAR", plain.psar([r["high"] for r in rows], [r["low"] for r in rows]), 0.0)


def test_parabolic_sar_repairs_wrong_guesses(spark, rows):
    """With almost no rows to warm up on, most blocks are entered wrongly at first."""
    laid = lay_out(frame(spark, rows[:400]), block=7, back=3, ahead=0)
    got = collected(psar.parabolic_sar(laid))
    plain.assert_column(got, "PSAR", plain.psar([r["high"] for r in rows[:400]], [r["low"] for r in rows[:400]]), 0.0)


def test_parabolic_sar_small(spark):
    """Falling and rising starts, reversals, and a pace that reaches its limit."""
    shapes = {"A": [10, 8], "B": [10, 12], "C": [10, 11, 12, 9, 8, 7, 9, 13, 15], "D": list(range(10, 40))}
    rows = []
    for symbol, lows in shapes.items():
        rows += [r | {"low": float(x), "high": float(x + 1)} for r, x in zip(plain.flat(symbol, len(lows)), lows)]
    done = psar.parabolic_sar(lay_out(frame(spark, rows)))
    for symbol, lows in shapes.items():
        plain.assert_column(collected(done, symbol), "PSAR", plain.psar([x + 1.0 for x in lows], [float(x) for x in lows]), 0.0)


def test_blocks_partitions_and_other_series_do_not_matter(spark, rows):
    """One plan over several series of any length, once in a single block each and once cut small."""
    lengths = {"P": 600, "Q": 1, "R": 2, "S": 19, "T": 20}
    cuts = [r | {"symbol": s} for s, n in lengths.items() for r in rows[:n]]
    whole = collected(indicators.all_features(lay_out(frame(spark, cuts).repartition(1))))
    small = collected(indicators.all_features(lay_out(frame(spark, cuts).repartition(16), block=64)))
    for name in indicators.FEATURES:
        plain.assert_column(whole, name, [r[name] for r in small])
    longest = [r for r in whole if r["symbol"] == "P"]
    for symbol, count in lengths.items():
        series = [r for r in whole if r["symbol"] == symbol]
        assert [r["MA20"] is not None for r in series] == [i >= 19 for i in range(count)]
        for name in ("RSI", "EMA20", "OBV", "PSAR", "CCI", "PP"):
            plain.assert_column(series, name, [r[name] for r in longest[:count]] if count > 1 or name != "PSAR" else [None])


def test_flat_prices(spark):
    laid = lay_out(frame(spark, plain.flat("A", 30)))
    kinds = ("rsi", "stochastic", "cci", "chaikin", "atr", "roc", "bollinger")
    got = collected(indicators.run_recipes(laid, [getattr(indicators, f"{k}_recipe")(laid) for k in kinds]))
    last = got[-1]
    assert (last["RSI"], last["SlowK"], last["CCI"], last["CMF"], last["ATR"], last["ROC"]) == (0, 0, 0, 0, 0, 0)
    assert last["UpperBB"] == last["MiddleBB"] == last["LowerBB"] == 50.0
    scaled = collected(scaling.minmax_scale(lay_out(frame(spark, plain.flat("A", 30))), ["close", "v"]))
    assert {(r["close"], r["v"]) for r in scaled} == {(0.0, 0.0)}


def test_zero_volume(spark):
    got = collected(indicators.mfi(lay_out(frame(spark, plain.flat("A", 30, volume=0.0)))))
    assert [r["MFI"] for r in got] == [None] * 14 + [0.0] * 16


def test_layout_refuses_what_it_cannot_see(spark, rows):
    laid = lay_out(frame(spark, rows[:50]), back=10)
    with pytest.raises(ValueError):
        indicators.sma(laid)
    with pytest.raises(ValueError):
        indicators.ema(laid)


@pytest.mark.parametrize("block", [4, 8192])
def test_fills(spark, block):
    values = [None, None, 1.0, None, None, 2.0, None, None, None, 3.0, None, None]
    rows = plain.flat("A", len(values)) + plain.flat("B", 3)
    for row, value in zip(rows, [*values, None, None, None]):
        row["vw"] = value
    laid = lay_out(frame(spark, rows), block=block, back=0, ahead=0)
    shown = {k: [r["vw"] for r in collected(f(laid, ["vw"]))] for k, f in (("f", fill.ffill), ("b", fill.bfill), ("fb", fill.fill))}
    none = [None] * 3
    assert shown["f"] == [None, None, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, *none]
    assert shown["b"] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 3, None, None, *none]
    assert shown["fb"] == [1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, *none]
    articles = spark.createDataFrame([("A",), ("A",)], "symbol string")
    zeroed = fill.zero_without_articles(laid.rows(), articles, ["vw"]).orderBy("symbol", "t").collect()
    assert [r["vw"] for r in zeroed] == [*values, 0.0, 0.0, 0.0]


def test_scaling_inverts(spark, rows):
    df = frame(spark, rows[:200])
    scaled = scaling.minmax_scale(lay_out(df, block=32, back=0, ahead=0), ["close"]).rows()
    values = [r["close"] for r in scaled.collect()]
    assert min(values) == 0 and max(values) == 1
    back = scaling.unscale(scaled, ["close"], scaling.scalers(df, ["close"]), "close").orderBy("t").collect()
    plain.assert_column(back, "close", [r["close"] for r in rows[:200]])


def test_features_share_one_exchange_and_sort_of_the_blocks(blocks):
    plan = indicators.run_recipes(blocks, [indicators.rsi_recipe(blocks), indicators.macd_recipe(blocks), indicators.ichimoku_recipe(blocks)])
    text = plan.frame._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in text.splitlines() if "Sort [" in line and "_block" in line]
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "_block" in line]
    assert len(sorts) == 1 and len(exchanges) == 1


def test_volume_of_short_series_reads_the_layout_once(spark):
    rows = [(s, i, float(i * 7 % 5), float(i)) for s in ("a", "b") for i in range(40)]
    bars = spark.createDataFrame(rows, "symbol string, i int, close double, v double")
    bars = bars.select("symbol", F.timestamp_seconds(F.col("i") * 60).alias("t"), "close", "v")
    short, long = (indicators.on_balance_volume(lay_out(bars, block=block, back=8, ahead=8)).rows() for block in (64, 16))
    plans = [df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") for df in (short, long)]
    assert plans[0] < plans[1] and sorted(short.collect()) == sorted(long.collect()) and short.count() == 80
