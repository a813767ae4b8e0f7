"""Exact top-k search by inner product as a Voronoi kNN join.

Vectors and queries are dealt to the cells of pivots. Per cell a summary keeps the count and the greatest distance from the pivot;
since q.x = q.p + q.(x - p), no member of a cell scores more than q.p + |q| * radius. Each query is first answered in the few
cells with the highest bounds, which gives it a k-th best score; then it is sent only to the other cells whose bound reaches that
score. Cells are cut into blocks of bounded size, so a cell with a third of all vectors is many tasks; a block answers all its
queries with one integer matrix product, and the best of all blocks are merged by rank. No cell that could hold a result or a tie
is left out, so results are exact. Rows are ranked, not ids: rows that repeat with their id are ranked each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.tables import batch_of, stored

K = 5
#: Vectors of a block, queries of a packed row, cells probed for the first bound, and the most pivots (their table is broadcast).
BLOCK_VECTORS = 4096
PACKED_QUERIES = 256
FIRST_CELLS = 2
MOST_PIVOTS = 1024

FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """``id, parts``: floor(scale * x) of every component as double; vectors null, or with null or non-finite parts, are left out.

    Rows without an id take no part either: they could not be named.
    """
    x = F.col(vector_column).cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = vectors.filter(F.col(vector_column).isNotNull() & F.col(id_column).isNotNull() & whole)
    return kept.select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale)).alias("parts"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _unpacked(packed, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(packed, dtype="<i8").reshape(rows, width)


def _assigned(sent, width: int):
    """The nearest pivot of each vector and its distance, a little above the true one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = sent.value
        squares = (pivots**2).sum(axis=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("parts"), width)
            cell = (squares - 2.0 * (x.astype(np.float64) @ pivots.T)).argmin(axis=1)
            far = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-6
            packed = [row.tobytes() for row in np.ascontiguousarray(x, dtype="<i8")]
            yield batch_of(
                id=batch.column("id"),
                copies=batch.column("copies"),
                cell=pa.array(cell.astype(np.int32)),
                far=pa.array(far),
                vector=pa.array(packed, pa.binary()),
            )

    return run


def _bounds(pivots: np.ndarray, radius: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Per query and cell the most a member can score; empty cells have a radius below 0."""
    q = x.astype(np.float64)
    norms = np.sqrt((q**2).sum(axis=1))
    bound = q @ pivots.T + norms[:, None] * np.maximum(radius, 0)[None, :]
    bound += 1e-6 * (1 + np.abs(bound))
    bound[:, radius < 0] = -np.inf
    return bound


def _cells_for(sent, width: int, first: int | None):
    """Rows (cell, queries packed): the ``first`` best cells, or all further ones whose bound reaches the score at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radius = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy()
            copies = batch.column("copies").to_numpy()
            x = _unpacked(b"".join(batch.column("vector").to_pylist()), batch.num_rows, width)
            bound = _bounds(pivots, radius, x)
            order = np.argsort(-bound, axis=1, kind="stable")
            probed = np.zeros(bound.shape, dtype=bool)
            np.put_along_axis(probed, order[:, :FIRST_CELLS], True, axis=1)
            if first is not None:
                wanted = probed
            else:
                least = batch.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                least = np.where(np.isnan(least), -np.inf, least)
                wanted = (bound >= least[:, None]) & ~probed
            wanted &= np.isfinite(bound)
            cells, names, times, packs = [], [], [], []
            for cell in np.flatnonzero(wanted.any(axis=0)):
                rows = np.flatnonzero(wanted[:, cell])
                for at in range(0, len(rows), PACKED_QUERIES):
                    part = rows[at : at + PACKED_QUERIES]
                    cells.append(int(cell))
                    names.append(ids[part].astype("<i8").tobytes())
                    times.append(copies[part].astype("<i8").tobytes())
                    packs.append(np.ascontiguousarray(x[part]).tobytes())
            yield batch_of(
                cell=pa.array(cells, pa.int32()),
                ids=pa.array(names, pa.binary()),
                copies=pa.array(times, pa.binary()),
                packed=pa.array(packs, pa.binary()),
            )

    return run


def _solve(width: int, k: int):
    """One block of vectors against the queries sent to its cell: the k best of the block per query, ties to the smaller id.

    A row of the block is given as often as its query is stored.
    """

    def run(_key: tuple, data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        data = data.sort_values("id")
        ids = data["id"].to_numpy()
        x = _unpacked(b"".join(data["vector"]), len(data), width)
        query_ids, found, scores = [], [], []
        for names, copies, packed in zip(asked["ids"], asked["copies"], asked["packed"], strict=True):
            queries, times = np.frombuffer(names, dtype="<i8"), np.frombuffer(copies, dtype="<i8")
            score = _products(_unpacked(packed, len(queries), width), x)
            own = queries[:, None] == ids[None, :]
            for row, query in enumerate(queries.tolist()):
                mine, values = ids[~own[row]], score[row][~own[row]]
                if len(values) > k:
                    limit = np.partition(values, len(values) - k)[len(values) - k]
                    keep = np.flatnonzero(values >= limit)
                    keep = keep[np.lexsort((mine[keep], -values[keep]))][:k]
                    mine, values = mine[keep], values[keep]
                if times[row] > 1:
                    mine, values = np.repeat(mine, times[row]), np.repeat(values, times[row])
                query_ids.append(np.full(len(mine), query))
                found.append(mine)
                scores.append(values)
        return pd.DataFrame({"query_id": np.concatenate(query_ids), "vec_id": np.concatenate(found), "score": np.concatenate(scores)})

    return run


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating point where every partial sum is below 2**53, else in whole numbers."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < 1 << 53:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(points: DataFrame, queries: DataFrame, k: int = K, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """``id, parts`` rows of whole numbers -> ``query_id, rank, vec_id, score``: per query its k best other points.

    Points of the query's own id are no candidates. With fewer than k candidates all are returned; empty tables give an empty
    table. Every row counts: a point stored n times takes n ranks, and each point is ranked once for every row of the query.
    Vectors are ranked among those of their own length (without components all score 0). Components so large that a score might
    not fit a long raise a ValueError.
    """
    spark = points.sparkSession
    size, parts = F.size("parts").alias("w"), F.col("parts")
    top = F.greatest(F.array_max(parts), -(F.array_min(parts) + 1))
    shapes = points.groupBy(size).agg(F.count("*").alias("n"), F.max(top).alias("top")).orderBy("w").collect()  # a row per length
    for w, _, largest in shapes:
        if w and (largest + 1) ** 2 * w >= 1 << 63:
            raise ValueError(f"components up to {largest}: scores of {w} components may not fit a long")
    if len(shapes) == 1:
        return _of_width(points, queries, k, most_pivots, shapes[0][0], shapes[0][1])
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for w, n, _ in shapes:
        same = F.size("parts") == w
        found = found.union(_of_width(points.filter(same), queries.filter(same), k, most_pivots, w, n))
    return found


def _of_width(points: DataFrame, queries: DataFrame, k: int, most_pivots: int, width: int, total: int) -> DataFrame:
    """``top_k`` among ``total`` vectors of one length."""
    spark = points.sparkSession
    wanted = min(most_pivots, max(1, math.isqrt(total)))
    share = min(1.0, 4.0 * wanted / total)
    spread = F.pmod(F.xxhash64("parts"), F.lit(1_000_000)) < max(1, int(share * 1_000_000))
    drawn = points.filter(spread).select("parts").distinct().orderBy(F.xxhash64("parts"), "parts").limit(wanted).collect()
    pivots = np.array([r["parts"] for r in drawn] or [[0] * width], dtype=np.float64).reshape(max(len(drawn), 1), width)
    sent = spark.sparkContext.broadcast(pivots)
    schema = "id long, copies long, cell int, far double, vector binary"
    single = points.select("id", F.lit(1).cast("long").alias("copies"), "parts")
    dealt = stored(single.mapInArrow(_assigned(sent, width), schema).drop("copies"), "cells")
    summary = dealt.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
    sizes = summary.collect()  # at most one row per pivot
    radius = np.full(len(pivots), -1.0)
    blocks = {}
    for r in sizes:
        radius[r["cell"]] = r["radius"]
        blocks[r["cell"]] = -(-r["n"] // BLOCK_VECTORS)
    bounds = spark.sparkContext.broadcast((pivots, radius))
    block_of = spark.createDataFrame(list(blocks.items()), "cell int, blocks int")
    # by row and not by id, so that the rows of one id are dealt over the blocks, too
    row = F.xxhash64("id", F.monotonically_increasing_id())
    salted = dealt.withColumn("at", row).join(F.broadcast(block_of), "cell").withColumn("block", F.expr("CAST(pmod(at, blocks) AS INT)"))
    # more than k rows of one query change nothing: k of them give its best point k times
    several = queries.groupBy("id", "parts").agg(F.least(F.count("*"), F.lit(k)).cast("long").alias("copies"))
    asked = several.select("id", "copies", "parts").mapInArrow(_assigned(sent, width), schema).select("id", "copies", "vector")

    def answer(packed: DataFrame) -> DataFrame:
        every = packed.join(F.broadcast(block_of), "cell")
        every = every.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        data = salted.select("cell", "block", "id", "vector").groupBy("cell", "block")
        return data.cogroup(every.select("cell", "block", "ids", "copies", "packed").groupBy("cell", "block")).applyInPandas(
            _solve(width, k), FOUND
        )

    pack = "cell int, ids binary, copies binary, packed binary"
    first = stored(_best(answer(asked.mapInArrow(_cells_for(bounds, width, FIRST_CELLS), pack)), k), "first")
    least = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    bounded = asked.join(least, "id", "left")
    more = answer(bounded.mapInArrow(_cells_for(bounds, width, None), pack))
    return _best(first.select("query_id", "vec_id", "score").union(more), k).select("query_id", "rank", "vec_id", "score")


def exact_top_k(vectors: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """The k best of every vector whose ``vec_id`` is divisible by ``every``, see ``top_k``."""
    points = stored(quantised(vectors), "points")
    return top_k(points, points.filter(F.col("id") % every == 0), k)
