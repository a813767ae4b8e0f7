"""Technical indicators over laid-out bars.

Every indicator is a recipe: expressions by phase, where a phase may use window functions over the columns of
earlier phases. Recipes are run together phase by phase, so all of them share the same few window passes, one
exchange and one sort. Rows in the warm-up are NULL, decided by the row number within the series.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.psar import parabolic_sar
from tidegrid.operators.recursion import Scan, Start, run_scans
from tidegrid.operators.series import BLOCK, ROW, Laid

# Below these the denominator counts as zero.
RSI_ZERO = 1e-8
VARIANCE_ZERO = 1e-8
MONEY_FLOW_ZERO = 1.0
CCI_SCALE = 0.015

# Window sums over more rows than this are taken as a difference of running sums.
LONG_WINDOW = 32

# Phases: LOOK..MIX and AFTER are window passes, SCAN and SCAN_AGAIN are recursions, OUTPUT is a projection.
# A result is finished in the earliest phase that can, so that its inputs are pruned from the later passes.
LOOK, DERIVE, MIX, SCAN, AFTER, SCAN_AGAIN, OUTPUT = range(7)

# Names of the output columns.
FEATURES = [
    "MA20", "MA50", "MA200", "RSI", "MACD", "Signal", "UpperBB", "MiddleBB", "LowerBB", "OBV", "SlowK", "SlowD",
    "ATR", "MFI", "Tenkan", "Kijun", "SenkouA", "SenkouB", "Chikou", "PP", "ROC", "CMF", "CCI", "PSAR", "EMA20",
    "WMA20",
]


@dataclass(frozen=True)
class Recipe:
    outputs: tuple[str, ...]
    phases: Mapping[int, Mapping[str, Column | Scan]]
    back: int = 0
    ahead: int = 0


def _from_row(row: int, value: Column) -> Column:
    return F.when(F.col(ROW) >= row, value)


def _typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def _lag(laid: Laid, value: Column | str, rows: int) -> Column:
    return F.lag(value, rows).over(laid.window)


def _seed(laid: Laid, value: Column, first: int, count: int) -> Column:
    """Mean of the values there are in ``count`` rows from row ``first`` on, as seen from the row where they are complete.

    A running sum of those rows: one step per row, where a sliding mean would take ``count``.
    """
    chosen = F.when(F.col(ROW).between(first, first + count - 1), value)
    return F.try_divide(F.sum(chosen).over(laid.running), F.count(chosen).over(laid.running))


def _seeded(seed_row: int, seed: Column, weight: float, value: Column, count: int | None = None) -> Scan:
    """Exponential average of ``value`` that starts from ``seed`` at ``seed_row``.

    If ``seed`` is the mean of the ``count`` rows up to that one and no window reads the average, any weight will do.
    """
    inflow = F.when(F.col(ROW) == seed_row, seed).when(F.col(ROW) > seed_row, value * weight).otherwise(0.0)
    return Scan(1 - weight, inflow, count and Start(value, seed_row - count + 1, count, weight))


def sma_recipe(laid: Laid, periods: Sequence[int] = (20, 50, 200)) -> Recipe:
    phases: dict[int, dict] = {LOOK: {}, DERIVE: {}, MIX: {}}
    for period in periods:
        if period <= LONG_WINDOW:
            phases[LOOK][f"_mean{period}"] = F.avg("close").over(laid.last_rows(period))
        else:
            phases[LOOK]["_close_sum"] = F.sum("close").over(laid.running)
            phases[LOOK]["_close_count"] = F.count("close").over(laid.running)
            earlier = F.coalesce(_lag(laid, "_close_sum", period), F.lit(0.0))
            fewer = F.coalesce(_lag(laid, "_close_count", period), F.lit(0))
            counted = F.col("_close_count") - fewer
            phases[DERIVE][f"_mean{period}"] = F.try_divide(F.col("_close_sum") - earlier, counted)
        phases[MIX][f"MA{period}"] = _from_row(period - 1, F.col(f"_mean{period}"))
    return Recipe(tuple(phases[MIX]), phases, back=max(periods))


def ema_recipe(laid: Laid, period: int = 20) -> Recipe:
    name = f"_ema{period}"
    return Recipe(
        (f"EMA{period}",),
        {
            LOOK: {f"_seed{period}": _seed(laid, F.col("close"), 0, period)},
            SCAN: {name: _seeded(period - 1, F.col(f"_seed{period}"), 2 / (period + 1), F.col("close"), period)},
            AFTER: {f"EMA{period}": _from_row(period - 1, F.col(name))},
        },
    )


def wma_recipe(laid: Laid, period: int = 20) -> Recipe:
    lags = {f"_close_{j}": _lag(laid, "close", j) for j in range(1, period)}
    total = F.col("close") * period
    for j in range(1, period):
        total = total + F.col(f"_close_{j}") * (period - j)
    return Recipe(
        (f"WMA{period}",),
        {
            LOOK: lags,
            DERIVE: {f"WMA{period}": _from_row(period - 1, total / (period * (period + 1) / 2))},
        },
        back=period,
    )


def rsi_recipe(laid: Laid, period: int = 14) -> Recipe:
    change = F.col("close") - F.col("_close_1")
    gain, loss = F.col("_avg_gain"), F.col("_avg_loss")
    ratio = F.when(gain + loss < RSI_ZERO, 0.0).otherwise(100 * F.try_divide(gain, gain + loss))
    return Recipe(
        ("RSI",),
        {
            LOOK: {"_close_1": _lag(laid, "close", 1)},
            DERIVE: {"_gain": F.greatest(change, F.lit(0.0)), "_loss": F.greatest(-change, F.lit(0.0))},
            MIX: {
                "_gain_seed": _seed(laid, F.col("_gain"), 1, period),
                "_loss_seed": _seed(laid, F.col("_loss"), 1, period),
            },
            SCAN: {
                "_avg_gain": _seeded(period, F.col("_gain_seed"), 1 / period, F.col("_gain"), period),
                "_avg_loss": _seeded(period, F.col("_loss_seed"), 1 / period, F.col("_loss"), period),
            },
            AFTER: {"RSI": _from_row(period, ratio)},
        },
    )


def macd_recipe(laid: Laid, fast: int = 12, slow: int = 26, signal: int = 9) -> Recipe:
    start = slow - 1
    shown = start + signal - 1
    gap = F.col("_macd_fast") - F.col("_macd_slow")
    return Recipe(
        ("MACD", "Signal"),
        {
            LOOK: {
                "_macd_fast_seed": _seed(laid, F.col("close"), slow - fast, fast),
                "_macd_slow_seed": _seed(laid, F.col("close"), 0, slow),
            },
            SCAN: {
                "_macd_fast": _seeded(start, F.col("_macd_fast_seed"), 2 / (fast + 1), F.col("close")),
                "_macd_slow": _seeded(start, F.col("_macd_slow_seed"), 2 / (slow + 1), F.col("close")),
            },
            AFTER: {"_macd": gap, "_signal_seed": _seed(laid, gap, start, signal)},
            SCAN_AGAIN: {"_signal": _seeded(shown, F.col("_signal_seed"), 2 / (signal + 1), F.col("_macd"))},
            OUTPUT: {
                "MACD": _from_row(shown, F.col("_macd")),
                "Signal": _from_row(shown, F.col("_signal")),
            },
        },
    )


def bollinger_recipe(laid: Laid, period: int = 20, width: float = 2.0) -> Recipe:
    mean, variance = F.col(f"_mean{period}"), F.col("_variance")
    spread = F.when(variance < VARIANCE_ZERO, 0.0).otherwise(F.sqrt(variance)) * width
    return Recipe(
        ("UpperBB", "MiddleBB", "LowerBB"),
        {
            LOOK: {
                f"_mean{period}": F.avg("close").over(laid.last_rows(period)),
                "_variance": F.var_pop("close").over(laid.last_rows(period)),
            },
            DERIVE: {
                "UpperBB": _from_row(period - 1, mean + spread),
                "MiddleBB": _from_row(period - 1, mean),
                "LowerBB": _from_row(period - 1, mean - spread),
            },
        },
    )


def stochastic_recipe(laid: Laid, fast: int = 14, slow_k: int = 3, slow_d: int = 3) -> Recipe:
    shown = fast - 1 + slow_k - 1 + slow_d - 1
    reach = F.col("_highest") - F.col("_lowest")
    fast_k = F.when(reach == 0, 0.0).otherwise(100 * F.try_divide(F.col("close") - F.col("_lowest"), reach))
    return Recipe(
        ("SlowK", "SlowD"),
        {
            LOOK: {
                "_highest": F.max("high").over(laid.last_rows(fast)),
                "_lowest": F.min("low").over(laid.last_rows(fast)),
            },
            DERIVE: {"_fast_k": fast_k},
            MIX: {"_slow_k": F.avg("_fast_k").over(laid.last_rows(slow_k))},
            AFTER: {"_slow_d": F.avg("_slow_k").over(laid.last_rows(slow_d))},
            OUTPUT: {"SlowK": _from_row(shown, F.col("_slow_k")), "SlowD": _from_row(shown, F.col("_slow_d"))},
        },
        back=shown,
    )


def atr_recipe(laid: Laid, period: int = 14) -> Recipe:
    previous = F.col("_close_1")
    true_range = F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous)
    )
    return Recipe(
        ("ATR",),
        {
            LOOK: {"_close_1": _lag(laid, "close", 1)},
            DERIVE: {"_true_range": F.when(F.col(ROW) > 0, true_range)},
            MIX: {"_range_seed": _seed(laid, F.col("_true_range"), 1, period)},
            SCAN: {"_atr": _seeded(period, F.col("_range_seed"), 1 / period, F.col("_true_range"), period)},
            AFTER: {"ATR": _from_row(period, F.col("_atr"))},
        },
    )


def mfi_recipe(laid: Laid, period: int = 14) -> Recipe:
    typical, previous = _typical(), F.col("_typical_1")
    flow = typical * F.col("v")
    up, down = F.col("_flow_up"), F.col("_flow_down")
    value = F.when(up + down < MONEY_FLOW_ZERO, 0.0).otherwise(100 * F.try_divide(up, up + down))
    return Recipe(
        ("MFI",),
        {
            LOOK: {"_typical_1": _lag(laid, typical, 1)},
            DERIVE: {
                "_up": F.when(typical > previous, flow).otherwise(0.0),
                "_down": F.when(typical < previous, flow).otherwise(0.0),
            },
            MIX: {
                "_flow_up": F.sum("_up").over(laid.last_rows(period)),
                "_flow_down": F.sum("_down").over(laid.last_rows(period)),
            },
            SCAN: {"MFI": _from_row(period, value)},
        },
        back=period + 1,
    )


def _stretches(rows: int, step: int) -> list[int]:
    """Lags at which stretches of ``step`` rows, overlapping where they must, cover the last ``rows`` rows."""
    return [*range(0, rows - step, step), rows - step]


def ichimoku_recipe(laid: Laid, periods: tuple[int, int, int] = (9, 26, 52)) -> Recipe:
    """Middles of three ranges. The longer ranges are put together from lags of the shortest one's extremes."""
    conversion, base, long = periods

    def middle(rows: int) -> Column:
        lags = [j for j in _stretches(rows, conversion) if j > 0]
        top = F.greatest("_top", *[_lag(laid, "_top", j) for j in lags])
        bottom = F.least("_bottom", *[_lag(laid, "_bottom", j) for j in lags])
        return (top + bottom) / 2

    return Recipe(
        ("Tenkan", "Kijun", "SenkouA", "SenkouB", "Chikou"),
        {
            LOOK: {
                "_top": F.max("high").over(laid.last_rows(conversion)),
                "_bottom": F.min("low").over(laid.last_rows(conversion)),
                "Chikou": F.lead("close", base).over(laid.window),
            },
            DERIVE: {
                "_tenkan": (F.col("_top") + F.col("_bottom")) / 2,
                "_kijun": middle(base),
                "_middle_long": middle(long),
            },
            MIX: {
                "Tenkan": _from_row(conversion - 1, F.col("_tenkan")),
                "Kijun": _from_row(base - 1, F.col("_kijun")),
                "SenkouA": _from_row(
                    2 * base - 1, _lag(laid, (F.col("_tenkan") + F.col("_kijun")) / 2, base)
                ),
                "SenkouB": _from_row(long + base - 1, _lag(laid, "_middle_long", base)),
            },
        },
        back=long + base,
        ahead=base,
    )


def pivot_points(bars: DataFrame) -> DataFrame:
    """Pivot and its resistance and support levels, from each bar's own high, low and close."""
    high, low, pivot = F.col("high"), F.col("low"), _typical()
    return bars.withColumns(
        {
            "PP": pivot,
            "R1": pivot * 2 - low,
            "S1": pivot * 2 - high,
            "R2": pivot + (high - low),
            "S2": pivot - (high - low),
            "R3": high + (pivot - low) * 2,
            "S3": low - (high - pivot) * 2,
        }
    )


def roc_recipe(laid: Laid, period: int = 10) -> Recipe:
    name = f"_close_{period}"
    change = (F.try_divide(F.col("close"), F.col(name)) - 1) * 100
    return Recipe(
        ("ROC",),
        {
            LOOK: {name: _lag(laid, "close", period)},
            DERIVE: {"ROC": _from_row(period, F.when(F.col(name) == 0, 0.0).otherwise(change))},
        },
        back=period,
    )


def chaikin_recipe(laid: Laid, fast: int = 3, slow: int = 10) -> Recipe:
    """Fast minus slow average of the accumulation line; a constant shift of the line cancels out."""
    high, low, close = F.col("high"), F.col("low"), F.col("close")
    reach = high - low
    flow = F.when(reach > 0, F.try_divide((close - low) - (high - close), reach) * F.col("v")).otherwise(0.0)
    line = F.col("_accumulation")
    return Recipe(
        ("CMF",),
        {
            LOOK: {"_accumulation": F.sum(flow).over(laid.running)},
            SCAN: {
                "_chaikin_fast": _seeded(0, line, 2 / (fast + 1), line),
                "_chaikin_slow": _seeded(0, line, 2 / (slow + 1), line),
            },
            AFTER: {"CMF": _from_row(slow - 1, F.col("_chaikin_fast") - F.col("_chaikin_slow"))},
        },
    )


def cci_recipe(laid: Laid, period: int = 14) -> Recipe:
    typical, mean = _typical(), F.col("_typical_mean")
    deviation = F.abs(typical - mean)
    for j in range(1, period):
        deviation = deviation + F.abs(F.col(f"_typical_{j}") - mean)
    deviation = deviation / period
    gap = typical - mean
    value = F.when((gap == 0) | (deviation == 0), 0.0).otherwise(F.try_divide(gap, deviation * CCI_SCALE))
    lags = {f"_typical_{j}": _lag(laid, typical, j) for j in range(1, period)}
    return Recipe(
        ("CCI",),
        {
            LOOK: {"_typical_mean": F.avg(typical).over(laid.last_rows(period)), **lags},
            DERIVE: {"CCI": _from_row(period - 1, value)},
        },
        back=period,
    )


def run_recipes(laid: Laid, recipes: Sequence[Recipe]) -> Laid:
    """All phases of all recipes, keeping the bars and the recipes' outputs."""
    laid.require(back=max(r.back for r in recipes), ahead=max(r.ahead for r in recipes))
    kept = laid.frame.columns + [name for recipe in recipes for name in recipe.outputs]
    for phase in range(OUTPUT + 1):
        columns: dict[str, Column | Scan] = {}
        for recipe in recipes:
            for name, step in recipe.phases.get(phase, {}).items():
                columns.setdefault(name, step)
        laid = laid.with_columns({n: c for n, c in columns.items() if not isinstance(c, Scan)})
        laid = run_scans(laid, {n: c for n, c in columns.items() if isinstance(c, Scan)})
    return replace(laid, frame=laid.frame.select(*dict.fromkeys(kept)))


def on_balance_volume(laid: Laid) -> Laid:
    """Running volume signed by the direction of the close: a running sum per block plus the earlier blocks' total.

    Series of one block have no earlier blocks, so if no series is longer the layout is not read a second time for totals.
    """
    laid.require(back=1)
    change = F.col("close") - F.lag("close", 1).over(laid.window)
    signed = F.when(F.col(ROW) == 0, F.col("v")).otherwise(F.signum(change) * F.col("v"))
    flows = laid.with_columns({"_signed": signed})
    running = F.sum(F.when(laid.is_own, F.col("_signed")).otherwise(0.0)).over(laid.running)
    if not laid.has_long_series():
        return flows.with_columns({"OBV": F.lit(0.0) + running}).drop("_signed")
    totals = flows.summary([F.sum("_signed").alias("_total")]).select(
        laid.key, BLOCK, F.coalesce(F.sum("_total").over(laid.blocks_before()), F.lit(0.0)).alias("_earlier")
    )
    return (
        flows.with_columns({"_running": running})
        .join_blocks(totals)
        .with_columns({"OBV": F.col("_earlier") + F.col("_running")})
        .drop("_signed", "_running", "_earlier")
    )


def sma(laid: Laid, periods: Sequence[int] = (20, 50, 200)) -> Laid:
    return run_recipes(laid, [sma_recipe(laid, periods)])


def ema(laid: Laid, period: int = 20) -> Laid:
    return run_recipes(laid, [ema_recipe(laid, period)])


def wma(laid: Laid, period: int = 20) -> Laid:
    return run_recipes(laid, [wma_recipe(laid, period)])


def rsi(laid: Laid, period: int = 14) -> Laid:
    return run_recipes(laid, [rsi_recipe(laid, period)])


def macd(laid: Laid, fast: int = 12, slow: int = 26, signal: int = 9) -> Laid:
    return run_recipes(laid, [macd_recipe(laid, fast, slow, signal)])


def bollinger(laid: Laid, period: int = 20, width: float = 2.0) -> Laid:
    return run_recipes(laid, [bollinger_recipe(laid, period, width)])


def stochastic(laid: Laid, fast: int = 14, slow_k: int = 3, slow_d: int = 3) -> Laid:
    return run_recipes(laid, [stochastic_recipe(laid, fast, slow_k, slow_d)])


def atr(laid: Laid, period: int = 14) -> Laid:
    return run_recipes(laid, [atr_recipe(laid, period)])


def mfi(laid: Laid, period: int = 14) -> Laid:
    return run_recipes(laid, [mfi_recipe(laid, period)])


def ichimoku(laid: Laid, periods: tuple[int, int, int] = (9, 26, 52)) -> Laid:
    return run_recipes(laid, [ichimoku_recipe(laid, periods)])


def roc(laid: Laid, period: int = 10) -> Laid:
    return run_recipes(laid, [roc_recipe(laid, period)])


def chaikin(laid: Laid, fast: int = 3, slow: int = 10) -> Laid:
    return run_recipes(laid, [chaikin_recipe(laid, fast, slow)])


def cci(laid: Laid, period: int = 14) -> Laid:
    return run_recipes(laid, [cci_recipe(laid, period)])


def all_features(laid: Laid) -> Laid:
    """The bars with all 26 indicator columns."""
    recipes = [
        recipe(laid)
        for recipe in (
            sma_recipe, rsi_recipe, macd_recipe, bollinger_recipe, stochastic_recipe, atr_recipe, mfi_recipe,
            ichimoku_recipe, roc_recipe, chaikin_recipe, cci_recipe, ema_recipe, wma_recipe,
        )
    ]
    bars = laid.frame.columns
    done = run_recipes(laid, recipes).with_columns({"PP": _typical()})
    done = parabolic_sar(on_balance_volume(done), bars=laid)
    return replace(done, frame=done.frame.select(*bars, *FEATURES))
