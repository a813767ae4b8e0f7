"""Sequential definitions of the indicators, written as loops over one series."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

START = datetime(2024, 1, 1)


def walk(symbol: str, count: int, seed: int = 1) -> list[dict]:
    rng = random.Random(seed)
    price, rows = 100.0, []
    for i in range(count):
        opening = price
        price = max(1.0, price + rng.gauss(0, 1))
        high, low = max(opening, price) + rng.random(), min(opening, price) - rng.random()
        rows.append(
            {
                "symbol": symbol, "t": START + timedelta(minutes=i), "open": opening, "high": high, "low": low,
                "close": price, "v": float(rng.randint(0, 50)), "n": rng.randint(1, 9), "vw": price,
            }
        )
    return rows


def flat(symbol: str, count: int, volume: float = 10.0) -> list[dict]:
    price = 50.0
    return [
        {
            "symbol": symbol, "t": START + timedelta(minutes=i), "open": price, "high": price, "low": price,
            "close": price, "v": volume, "n": 1, "vw": price,
        }
        for i in range(count)
    ]


def mean(values):
    return sum(values) / len(values)


def smoothed(values, start, seed, weight):
    out = [None] * len(values)
    for i in range(start, len(values)):
        out[i] = seed if i == start else weight * values[i] + (1 - weight) * out[i - 1]
    return out


def ema(close, period=20):
    return smoothed(close, period - 1, mean(close[:period]), 2 / (period + 1)) if len(close) >= period else [None] * len(close)


def rsi(close, period=14):
    change = [0.0] + [b - a for a, b in zip(close, close[1:])]
    gains, losses = [max(c, 0) for c in change], [max(-c, 0) for c in change]
    up = smoothed(gains, period, mean(gains[1 : period + 1]), 1 / period)
    down = smoothed(losses, period, mean(losses[1 : period + 1]), 1 / period)
    return [None if u is None else (0.0 if u + d < 1e-8 else 100 * u / (u + d)) for u, d in zip(up, down)]


def macd(close):
    fast = smoothed(close, 25, mean(close[14:26]), 2 / 13)
    slow = smoothed(close, 25, mean(close[:26]), 2 / 27)
    gap = [None if f is None else f - s for f, s in zip(fast, slow)]
    signal = smoothed([g or 0.0 for g in gap], 33, mean(gap[25:34]), 0.2)
    return [g if i >= 33 else None for i, g in enumerate(gap)], signal


def atr(high, low, close, period=14):
    ranges = [0.0] + [
        max(h - l, abs(h - c), abs(l - c)) for h, l, c in zip(high[1:], low[1:], close)
    ]
    return smoothed(ranges, period, mean(ranges[1 : period + 1]), 1 / period)


def obv(close, volume):
    out = [volume[0]]
    for i in range(1, len(close)):
        sign = (close[i] > close[i - 1]) - (close[i] < close[i - 1])
        out.append(out[-1] + sign * volume[i])
    return out


def chaikin(high, low, close, volume):
    line, total = [], 0.0
    for h, l, c, v in zip(high, low, close, volume):
        total += ((c - l) - (h - c)) / (h - l) * v if h > l else 0.0
        line.append(total)
    fast, slow = smoothed(line, 0, line[0], 0.5), smoothed(line, 0, line[0], 2 / 11)
    return [f - s if i >= 9 else None for i, (f, s) in enumerate(zip(fast, slow))]


def psar(high, low, step=0.02, limit=0.2):
    """Trend by trend: the stop follows the trend's extreme until a bar touches it."""
    out = [None] * len(high)
    fall, rise = low[0] - low[1], high[1] - high[0]
    rising = not (fall > 0 and fall > rise)
    best, stop, pace = (high[1], low[0], step) if rising else (low[1], high[0], step)
    for i in range(1, len(high)):
        h0, l0 = (high[i], low[i]) if i == 1 else (high[i - 1], low[i - 1])
        if rising and low[i] <= stop:
            stop = out[i] = max(best, h0, high[i])
            rising, best, pace = False, low[i], step
            stop = max(stop + pace * (best - stop), h0, high[i])
        elif not rising and high[i] >= stop:
            stop = out[i] = min(best, l0, low[i])
            rising, best, pace = True, high[i], step
            stop = min(stop + pace * (best - stop), l0, low[i])
        elif rising:
            out[i] = stop
            if high[i] > best:
                best, pace = high[i], min(pace + step, limit)
            stop = min(stop + pace * (best - stop), l0, low[i])
        else:
            out[i] = stop
            if low[i] < best:
                best, pace = low[i], min(pace + step, limit)
            stop = max(stop + pace * (best - stop), h0, high[i])
    return out


def close_enough(ours, theirs, tolerance=1e-9) -> bool:
    if (ours is None or ours != ours) or theirs is None:
        return (ours is None or ours != ours) and theirs is None
    return math.isclose(ours, theirs, rel_tol=tolerance, abs_tol=tolerance)


def assert_column(rows, name, expected, tolerance=1e-9):
    wrong = [(i, r[name], e) for i, (r, e) in enumerate(zip(rows, expected, strict=True)) if not close_enough(r[name], e, tolerance)]
    assert not wrong, f"{name}: {len(wrong)} differ, first {wrong[:3]}"
