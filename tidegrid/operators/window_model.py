"""Linear models of sliding sequences without the sequences: sums of products per block, and what follows from them.

A sequence is the ``rows`` rows before a row. Written out it would repeat every value ``rows`` times; here each task slides a
window over the rows of a block, adds up the products of all its cells and the target, and gives the sums per split. From them
come the least-squares fit, the squared loss of any weights on any split, and gradient descent with early stopping: one pass
over the data, whatever the number of rounds. What reaches the driver are ``(rows * features + 2) ** 2`` sums per split, which
depends on the columns chosen and not on the data.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.sequences import SEQUENCE_ROWS, sequence_position, validation_split
from tidegrid.operators.series import BLOCK, ROW, ROWS, Laid

# The functions sent to the executors travel by value, so workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLITS = ("train", "validation", "test")
#: Windows multiplied at once.
CHUNK = 1024

STRIPS = "split int, strip int, sums binary"


def _prepared(laid: Laid, features: Sequence[str], target: str, rows: int) -> DataFrame:
    """The rows of every block in order: number, whether a sequence ends before it, split, target and features.

    A NULL feature counts as 0, the least scaled value: a series that is too short for a column has 0 throughout.
    """
    laid.require(back=rows)
    row, total = sequence_position(rows)
    marked = validation_split(laid.frame, row, total)
    number = F.coalesce(*[F.when(F.col("split") == name, k) for k, name in enumerate(SPLITS)])
    columns = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{k}") for k, f in enumerate(features)]
    shown = marked.select(
        F.col(laid.key).alias("key"),
        F.col(BLOCK).alias("block"),
        F.col(laid.time).alias("time"),
        F.col(ROW).alias("row"),
        (laid.is_own & (F.col(ROW) >= rows)).alias("ends"),
        number.alias("split"),
        F.col(target).cast("double").alias("y"),
        *columns,
    )
    return shown.repartition("key", "block").sortWithinPartitions("key", "block", "row")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows -> the rows of one block after the other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, blocks = batch.column("key").to_numpy(zero_copy_only=False), batch.column("block").to_numpy()
        edges = np.flatnonzero((keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        for first, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if held and last != (keys[first], blocks[first]):
                yield pa.Table.from_batches(held)
                held = []
            last = keys[first], blocks[first]
            held.append(batch.slice(first, end - first))
    if held:
        yield pa.Table.from_batches(held)


def _windows(table: pa.Table, width: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a block that end a sequence, and a view of all runs of ``rows`` rows; run i ends before row i + rows."""
    x = np.column_stack([table.column(f"x{k}").to_numpy() for k in range(width)])
    numbers = table.column("row").to_numpy()
    ends = np.flatnonzero(table.column("ends").to_numpy(zero_copy_only=False))
    if len(ends) and (ends[0] < rows or numbers[-1] - numbers[0] != len(numbers) - 1):
        raise ValueError("a block lacks rows before a sequence")
    return ends, np.lib.stride_tricks.sliding_window_view(x, rows, axis=0).transpose(0, 2, 1) if len(x) >= rows else x[:0]


def _sums(width: int, rows: int):
    side = width * rows + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for table in _blocks(batches):
            ends, runs = _windows(table, width, rows)
            split, y = table.column("split").to_numpy(zero_copy_only=False), table.column("y").to_numpy(zero_copy_only=False)
            ends = ends[~np.isnan(y[ends].astype(np.float64))]
            for at in range(0, len(ends), CHUNK):
                part = ends[at : at + CHUNK]
                cells = np.ones((len(part), side))
                cells[:, 1:-1] = runs[part - rows].reshape(len(part), -1)
                cells[:, -1] = y[part]
                for number in np.unique(split[part]).tolist():
                    own = cells[split[part] == number]
                    sums[number] = sums.get(number, 0) + own.T @ own
        for number, found in sums.items():
            for first in range(0, side, 256):
                strips = found[first : first + 256]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(number)] * len(strips), pa.int32()),
                        pa.array(range(first, first + len(strips)), pa.int32()),
                        pa.array([s.tobytes() for s in strips], pa.binary()),
                    ],
                    names=["split", "strip", "sums"],
                )

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by split and strip -> one row each."""
    key, total = None, None

    def done() -> pa.RecordBatch:
        columns = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["split", "strip", "sums"])

    for batch in batches:
        for split, strip, sums in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if key != (split, strip):
                if key is not None:
                    yield done()
                key, total = (split, strip), np.zeros(len(sums) // 8)
            total = total + np.frombuffer(sums)
    if key is not None:
        yield done()


@dataclass
class WindowMoments:
    """Sums of products of (1, cells of the sequence, target) per split; a cell is (row of the sequence, feature)."""

    sums: dict[str, np.ndarray]
    side: int

    @staticmethod
    def of(laid: Laid, features: Sequence[str], target: str = "close", rows: int = SEQUENCE_ROWS) -> WindowMoments:
        """One pass over the blocks; each task adds up its blocks, strips of the sums are added over the tasks."""
        side = len(features) * rows + 2
        parts = _prepared(laid, features, target, rows).mapInArrow(_sums(len(features), rows), STRIPS)
        added = parts.repartition("split", "strip").sortWithinPartitions("split", "strip").mapInArrow(_added, STRIPS)
        sums: dict[str, np.ndarray] = {}
        for r in added.collect():  # side rows of side sums per split
            own = sums.setdefault(SPLITS[r["split"]], np.zeros((side, side)))
            own[r["strip"]] = np.frombuffer(r["sums"])
        return WindowMoments(sums, side)

    def of_splits(self, *names: str) -> np.ndarray:
        return sum((self.sums[n] for n in names if n in self.sums), np.zeros((self.side, self.side)))

    def loss(self, weights: np.ndarray, *names: str) -> float:
        """Mean squared error of the weights (the intercept first) on the named splits; NaN without sequences."""
        total = self.of_splits(*names)
        whole = np.append(weights, -1.0)
        return float(max(whole @ total @ whole, 0.0) / total[0, 0]) if total[0, 0] else float("nan")


@dataclass
class _Centred:
    """Covariances of standardised cells, and the way back to weights of the cells; constant cells have weight 0."""

    cells: np.ndarray
    target: np.ndarray
    spread: np.ndarray
    means: np.ndarray
    mean: float
    target_spread: float

    @staticmethod
    def of(total: np.ndarray) -> _Centred:
        n = total[0, 0]
        means, mean = total[0, 1:-1] / n, total[0, -1] / n
        cells = total[1:-1, 1:-1] / n - np.outer(means, means)
        target = total[1:-1, -1] / n - means * mean
        spread = np.sqrt(np.maximum(np.diag(cells), 0.0))
        spread[spread <= 1e-9 * np.maximum(np.abs(means), 1e-9)] = 0.0
        scale = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)
        variance = max(total[-1, -1] / n - mean**2, 0.0)
        return _Centred(cells * np.outer(scale, scale), target * scale, spread, means, mean, float(np.sqrt(variance)))

    def weights(self, standardised: np.ndarray) -> np.ndarray:
        own = np.divide(standardised, self.spread, out=np.zeros_like(standardised), where=self.spread > 0)
        return np.concatenate([[self.mean - own @ self.means], own])


def least_squares(moments: WindowMoments, penalty: float = 1e-3) -> np.ndarray:
    """Intercept and weights of the ridge regression on train and validation, with the penalty on standardised weights."""
    total = moments.of_splits("train", "validation")
    if not total[0, 0]:
        return np.zeros(moments.side - 1)
    centred = _Centred.of(total)
    if not centred.target_spread:
        return centred.weights(np.zeros(moments.side - 2))
    system = centred.cells + penalty / centred.target_spread * np.eye(moments.side - 2)
    return centred.weights(np.linalg.solve(system, centred.target))


@dataclass
class Descent:
    """Rounds of gradient descent: (round, train loss, validation loss, weights); the best round's weights are kept."""

    rounds: list[tuple[int, float, float, np.ndarray]]
    best: int

    @property
    def weights(self) -> np.ndarray:
        return self.rounds[self.best][3]

    def history(self) -> list[tuple[int, float, float, bool]]:
        return [(k, train, held, k == self.rounds[self.best][0]) for k, train, held, _ in self.rounds]


def descend(moments: WindowMoments, rounds: int = 100, patience: int = 10, rate: float = 0.02) -> Descent:
    """Adam on the squared loss of the train split, stopped when the validation loss has not fallen for ``patience`` rounds.

    The gradient of a round is that of all sequences, taken from their sums of products. Without validation sequences all rounds
    are run and the last is kept; without train sequences there is one round with weights 0.
    """
    total = moments.of_splits("train")
    if not total[0, 0]:
        nothing = np.zeros(moments.side - 1)
        return Descent([(1, moments.loss(nothing, "train"), moments.loss(nothing, "validation"), nothing)], 0)
    centred = _Centred.of(total)
    own = np.zeros(moments.side - 2)
    first, second = np.zeros_like(own), np.zeros_like(own)
    scale = centred.target_spread or 1.0
    done: list[tuple[int, float, float, np.ndarray]] = []
    best = 0
    for k in range(1, rounds + 1):
        slope = (centred.cells @ own - centred.target) / scale
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        own = own - rate * scale * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
        weights = centred.weights(own)
        done.append((k, moments.loss(weights, "train"), moments.loss(weights, "validation"), weights))
        if not done[-1][2] >= done[best][2]:
            best = k - 1
        elif k - 1 - best >= patience:
            break
    return Descent(done, best)


def predict_windows(
    laid: Laid, features: Sequence[str], weights: np.ndarray, target: str = "close", rows: int = SEQUENCE_ROWS, split: str = "test"
) -> DataFrame:
    """``key, time, y, predicted`` of every sequence of a split; the weights come as ``least_squares`` gives them."""
    frame = _prepared(laid, features, target, rows)
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    width, wanted = len(features), SPLITS.index(split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            ends, runs = _windows(table, width, rows)
            ends = ends[table.column("split").to_numpy(zero_copy_only=False)[ends] == wanted]
            for at in range(0, len(ends), CHUNK):
                part = ends[at : at + CHUNK]
                found = runs[part - rows].reshape(len(part), -1) @ weights[1:] + weights[0]
                own = table.select(["key", "time", "y"]).take(pa.array(part)).combine_chunks()
                columns = [own.column(k).combine_chunks() for k in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found)], names=["key", "time", "y", "predicted"])

    found = frame.mapInArrow(run, f"key {kinds['key']}, time {kinds['time']}, y double, predicted double")
    return found.withColumnsRenamed({"key": laid.key, "time": laid.time})
