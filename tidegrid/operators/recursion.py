"""Exponential recursions y[i] = d * y[i-1] + c[i] as window sums.

Within a segment of ``SEGMENT`` rows, y[i] = d^o * sum(c * d^-o) with o the row's offset in the segment, a
running sum. What earlier segments contribute is d^(o+1) times the value at the end of the previous segment; each
further pass adds one more segment of history. The number of passes is the smallest that leaves out less than
``RESIDUAL`` of the past, so the result equals the sequential recursion to rounding.

Averages whose past reaches beyond the copied rows are put together from blocks instead: a block turns the value y it is
entered with into d^rows * y + c, and these maps compose, so the value before a block is a fold over the c of the blocks
within ``RESIDUAL`` before it, one number each. Their period has no limit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidegrid.operators.series import BLOCK, ROW, SEGMENT, SUB, Laid

RESIDUAL = 1e-16
SMALLEST_DECAY = 10 ** (-290 / SEGMENT)  # below it d^-SEGMENT leaves the range of a double


@dataclass(frozen=True)
class Start:
    """Starts from the mean of ``value`` in ``count`` rows from row ``first`` on, then takes in ``weight * value`` per row."""

    value: Column
    first: int
    count: int
    weight: float

    @property
    def row(self) -> int:
        return self.first + self.count - 1


@dataclass(frozen=True)
class Scan:
    """One recursion: its decay d and its input c, which is 0 before the seed row.

    With ``start``, its past may reach beyond the copied rows; it is then NULL on copied rows.
    """

    decay: float
    inflow: Column
    start: Start | None = None


def history_rows(decay: float) -> int:
    """Rows of history after which a missing start no longer shows."""
    return math.ceil(math.log(RESIDUAL) / math.log(decay))


def run_scans(laid: Laid, scans: Mapping[str, Scan]) -> Laid:
    far = {name: scan for name, scan in scans.items() if scan.start and history_rows(scan.decay) > laid.back}
    laid = _run_near(laid, {name: scan for name, scan in scans.items() if name not in far})
    return _run_far(laid, far)


def _pass_block(decay: float) -> Callable[[Column, Column], Column]:
    return lambda y, c: y * decay + c


def _run_far(laid: Laid, scans: Mapping[str, Scan]) -> Laid:
    """Recursions from one summary row per block; the blocks looked back at depend on the decay alone."""
    if not scans:
        return laid
    block, sums, carries = laid.block, [], []
    lowest = 10 ** (-290 / block)  # below it d^-block leaves the range of a double
    offset = (F.col(ROW) - F.col(BLOCK) * block).cast("double")
    series = Window.partitionBy(laid.key)
    for i, (name, scan) in enumerate(scans.items()):
        start, decay = scan.start, F.lit(scan.decay)
        if not lowest < scan.decay < 1:
            raise ValueError(f"decay {scan.decay} is outside ({lowest:.3f}, 1) for blocks of {block} rows")
        seeding = F.when(F.col(ROW).between(start.first, start.row), start.value)
        taken = F.when(F.col(ROW) > start.row, start.value * start.weight * F.pow(decay, block - 1 - offset))
        sums += [F.sum(seeding).alias(f"_sum{i}"), F.count(seeding).alias(f"_count{i}"), F.sum(taken).alias(f"_in{i}")]
        seed = F.try_divide(F.sum(f"_sum{i}").over(series), F.sum(f"_count{i}").over(series))
        left = float((start.row // block + 1) * block - 1 - start.row)
        seeded = F.when(F.col(BLOCK) == start.row // block, seed * F.pow(decay, F.lit(left)))
        own = F.coalesce(F.col(f"_in{i}"), F.lit(0.0)) + F.coalesce(seeded, F.lit(0.0))
        back = series.orderBy(BLOCK).rowsBetween(-math.ceil(history_rows(scan.decay) / block), -1)
        carry = F.aggregate(F.collect_list(f"_own{i}").over(back), F.lit(0.0), _pass_block(scan.decay**block))
        carries.append((name, i, scan, seed, own, carry))
    blocks = laid.summary(sums)
    blocks = blocks.withColumns({f"_seed{i}": seed for _, i, _, seed, _, _ in carries} | {f"_own{i}": own for _, i, _, _, own, _ in carries})
    table = blocks.select(
        laid.key, BLOCK, *[F.col(f"_seed{i}") for _, i, *_ in carries], *[c.alias(f"_carry{i}") for _, i, _, _, _, c in carries]
    )
    laid = laid.join_blocks(table)
    values = {}
    for name, i, scan, *_ in carries:
        start, power = scan.start, F.pow(F.lit(scan.decay), offset)
        inflow = F.when(F.col(ROW) == start.row, F.col(f"_seed{i}")).when(F.col(ROW) > start.row, start.value * start.weight)
        inside = F.coalesce(F.sum(F.when(laid.is_own, inflow) / power).over(laid.running), F.lit(0.0))
        values[name] = F.when(laid.is_own, power * (inside + scan.decay * F.col(f"_carry{i}")))
    return laid.with_columns(values).drop(*[f"_{part}{i}" for _, i, *_ in carries for part in ("seed", "carry")])


def _run_near(laid: Laid, scans: Mapping[str, Scan]) -> Laid:
    if not scans:
        return laid
    for scan in scans.values():
        if not SMALLEST_DECAY < scan.decay < 1:
            raise ValueError(f"decay {scan.decay} is outside ({SMALLEST_DECAY:.3f}, 1)")
        laid.require(back=history_rows(scan.decay))
    offset = F.col(ROW) - F.col(SUB) * SEGMENT
    at_end = offset == SEGMENT - 1
    # d^o once per row and decay, as columns of their own.
    decays = sorted({scan.decay for scan in scans.values()})
    power = {decay: f"_power_{i}" for i, decay in enumerate(decays)}
    local = {name: f"_{name}_local" for name in scans}
    laid = laid.with_columns({power[d]: F.pow(F.lit(d), offset.cast("double")) for d in decays})
    laid = laid.with_columns(
        {
            local[name]: F.sum(scan.inflow / F.col(power[scan.decay])).over(laid.segment) * F.col(power[scan.decay])
            for name, scan in scans.items()
        }
    )
    passes = {name: math.ceil(history_rows(scan.decay) / SEGMENT) for name, scan in scans.items()}
    latest = dict(local)
    for turn in range(max(passes.values())):
        live = [name for name in scans if passes[name] > turn]
        carried = {
            name: F.coalesce(
                F.last(F.when(at_end, F.col(latest[name])), ignorenulls=True).over(laid.before), F.lit(0.0)
            )
            for name in live
        }
        laid = laid.with_columns(
            {
                name: F.col(local[name]) + F.col(power[scans[name].decay]) * scans[name].decay * carried[name]
                for name in live
            }
        )
        latest |= {name: name for name in live}
    return laid.drop(*local.values(), *power.values())
