"""Parabolic stop-and-reverse over blocks.

The indicator is a state machine, so a block can be run only from the state its predecessor ends in. Blocks are run in
parallel from a guess: the state reached by starting on the copied rows before the block. The guess is then compared
with the predecessor's end state, and only blocks that started wrongly are run again, until none is left. By induction
from block 0, whose start is known, the result is the one of a single sequential run. A reversal makes two runs meet, so
one round is the normal case. Series of one block need none of this.
"""

from __future__ import annotations

import sys
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.series import BLOCK, ROW, ROWS, Laid
from tidegrid.session import cut_lineage

# The functions below travel to the executors by value, so workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE = ("up", "stop", "extreme", "pace")
ENTRY = [f"_in_{part}" for part in STATE]
EXIT = [f"_out_{part}" for part in STATE]


def opening_state(high, low, at, step):
    """State before bar ``at + 1`` when the series starts at bar ``at``."""
    fall, rise = low[at] - low[at + 1], high[at + 1] - high[at]
    if fall > 0 and fall > rise:
        return (0.0, high[at], low[at + 1], step)
    return (1.0, low[at], high[at + 1], step)


def advance(high, low, begin, end, state, step, limit, first_bar, out):
    """Run bars begin..end-1 and note each bar's stop in ``out``; returns the state after them."""
    up, stop, extreme, pace = state
    for i in range(begin, end):
        before = i if i == first_bar else i - 1
        ceiling, floor = max(high[before], high[i]), min(low[before], low[i])
        turned = low[i] <= stop if up else high[i] >= stop
        if turned:
            stop = max(extreme, ceiling) if up else min(extreme, floor)
            up = 0.0 if up else 1.0
            pace = step
            extreme = high[i] if up else low[i]
            out[i] = stop
        else:
            out[i] = stop
            if (high[i] > extreme) if up else (low[i] < extreme):
                extreme = high[i] if up else low[i]
                pace = min(pace + step, limit)
        stop += pace * (extreme - stop)
        stop = min(stop, floor) if up else max(stop, ceiling)
    return (up, stop, extreme, pace)


def block_arrays(table, block):
    """Rows in order, the bars that have prices as lists, their places, and the positions of the block's own bars."""
    rows = table.column("_row").to_numpy()
    if len(rows) > 1 and not np.all(np.diff(rows) == 1):
        table = table.sort_by("_row")
        rows = table.column("_row").to_numpy()
    number = table.column("_block")[0].as_py()
    high, low = (table.column(name).to_numpy().astype(np.float64) for name in ("high", "low"))
    places = np.flatnonzero(~(np.isnan(high) | np.isnan(low)))
    begin = int(np.searchsorted(rows[places], number * block))
    end = int(np.searchsorted(rows[places], (number + 1) * block))
    return table, high[places].tolist(), low[places].tolist(), places, number, begin, end


def run_block(table, block, step, limit, entry=None):
    """Stops of the block's own bars, the state it was entered with and the state it ends in.

    Bars without prices have no stop and leave the state as it is.
    """
    table, high, low, places, number, begin, end = block_arrays(table, block)
    stops = [None] * len(high)

    def whole():
        out = [None] * table.num_rows
        for place, stop in zip(places.tolist(), stops, strict=True):
            out[place] = stop
        return out

    if len(high) < 2 and (entry is None or number == 0):
        return table, whole(), None, None
    if number == 0:
        entry = opening_state(high, low, begin, step)
        leaving = advance(high, low, begin + 1, end, entry, step, limit, begin + 1, stops)
        return table, whole(), entry, leaving
    if entry is None:
        lead = max(begin - 1, 0)
        start = 0 if lead > 0 else lead
        entry = opening_state(high, low, start, step)
        entry = advance(high, low, start + 1, begin, entry, step, limit, start + 1, stops)
        stops = [None] * len(high)
    leaving = advance(high, low, begin, end, entry, step, limit, 1, stops)
    return table, whole(), entry, leaving


def _states(frame: DataFrame, laid: Laid, step: float, limit: float) -> DataFrame:
    """Entry and exit state of every block of ``frame``, which may bring entry states along."""
    schema = T.StructType(
        [frame.schema[laid.key], T.StructField(BLOCK, T.LongType())]
        + [T.StructField(name, T.DoubleType()) for name in ENTRY + EXIT]
    )
    given = ENTRY[0] in frame.columns
    key, block, entry_names, exit_names = laid.key, laid.block, ENTRY, EXIT

    def states(table: pa.Table) -> pa.Table:
        start = tuple(table.column(name)[0].as_py() for name in entry_names) if given else None
        _, _, entry, leaving = run_block(table, block, step, limit, start)
        values = {key: [table.column(key)[0].as_py()], "_block": [table.column("_block")[0].as_py()]}
        for names, state in ((entry_names, entry), (exit_names, leaving)):
            values |= {n: pa.array([s], pa.float64()) for n, s in zip(names, state or (None,) * 4, strict=True)}
        return pa.table(values)

    return frame.groupBy(laid.key, BLOCK).applyInArrow(states, schema)


def _agreed_states(laid: Laid, step: float, limit: float) -> DataFrame:
    """States of the blocks of long series, such that every block starts where its predecessor ends."""
    bars = laid.frame.filter(F.col(ROWS) > laid.block).select(laid.key, BLOCK, ROW, "high", "low")
    states = cut_lineage(_states(bars, laid, step, limit))
    while True:
        expected = states.select(
            laid.key, (F.col(BLOCK) + 1).alias(BLOCK), *[F.col(o).alias(f"_want{i}") for i, o in zip(ENTRY, EXIT, strict=True)]
        )
        differs = F.lit(False)
        for name in ENTRY:
            differs = differs | ~F.col(name).eqNullSafe(F.col(f"_want{name}"))
        wrong = (
            states.join(expected, [laid.key, BLOCK])
            .filter(differs & F.col(f"_want{ENTRY[0]}").isNotNull())
            .select(laid.key, BLOCK, *[F.col(f"_want{name}").alias(name) for name in ENTRY])
        )
        if wrong.isEmpty():
            return states
        again = _states(bars.join(wrong, [laid.key, BLOCK]), laid, step, limit)
        kept = states.join(wrong.select(laid.key, BLOCK), [laid.key, BLOCK], "left_anti")
        states = cut_lineage(kept.unionByName(again))


def parabolic_sar(laid: Laid, step: float = 0.02, limit: float = 0.2, bars: Laid | None = None) -> Laid:
    """Adds PSAR. Where a series is longer than a block this runs jobs at call time, since blocks have to agree on
    their states first; ``bars`` may name the layout before other columns were added, to keep those jobs small.
    """
    laid.require(back=2)
    names, frame = laid.frame.columns, laid.frame
    bars = bars or laid
    if bars.has_long_series():
        states = _agreed_states(bars, step, limit).select(laid.key, BLOCK, *ENTRY)
        frame = laid.join_blocks(states).frame
    schema = T.StructType([laid.frame.schema[n] for n in names] + [T.StructField("PSAR", T.DoubleType())])
    block, entry_names, joined = laid.block, ENTRY, frame is not laid.frame

    def stops(table: pa.Table) -> pa.Table:
        start = tuple(table.column(name)[0].as_py() for name in entry_names) if joined else (None,)
        table, out, _, _ = run_block(table, block, step, limit, None if start[0] is None else start)
        return table.select(names).append_column("PSAR", pa.array(out, pa.float64()))

    return replace(laid, frame=frame.groupBy(laid.key, BLOCK).applyInArrow(stops, schema))
