"""Centroid clustering over bit planes: exact dot products and distances from popcounts.

A vector of 64 whole numbers in two's complement is a short list of unsigned 64-bit words: word k holds bit k of all 64
components, the last word their signs. With weights 2**k, and -2**k for the sign plane, the dot product of two vectors is the
weighted sum over pairs of planes of the bits set in both, so distances need AND and popcount only and are exact.

Vectors are packed and written once; a round reads only the planes. Each task sums the members of each centroid, so a round
shuffles one row per task and centroid, whatever the sizes of the clusters; the driver holds the centroids and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.tables import arrow_map, batch_of, only, stored

#: Components of a vector: the bits of a plane.
WIDTH = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3

#: Vectors compared at once.
CHUNK = 2048
#: With more planes than this, sums of squares could leave 64 bits and are added up in Python's whole numbers.
NARROW_PLANES = 27
_LARGEST = (1 << 63) - 1

PACKED = "vec_id long, planes binary"
SUMS = "cluster int, members long, sums array<string>"
FOUND = "vec_id long, cluster int, distance long"


def planes_needed(parts: list[int]) -> int:
    """Planes of the two's complement of the numbers, the sign plane included."""
    return 1 + max((p if p >= 0 else -p - 1).bit_length() for p in parts)


def pack_planes(parts: np.ndarray, planes: int) -> np.ndarray:
    """Rows of 64 whole numbers -> rows of ``planes`` words; ``parts`` may hold Python's whole numbers of any size."""
    out = np.zeros((len(parts), planes), dtype=np.uint64)
    place = np.uint64(1) << np.arange(WIDTH, dtype=np.uint64)
    for k in range(planes):
        bits = ((parts >> k) & 1).astype(np.uint64)
        out[:, k] = (bits * place).sum(axis=1, dtype=np.uint64)
    return out


def unpack_planes(planes: np.ndarray) -> np.ndarray:
    """The whole numbers of packed rows, as 64-bit numbers where they fit."""
    count = planes.shape[1]
    kind = np.int64 if count <= 63 else object
    out = np.zeros((len(planes), WIDTH), dtype=kind)
    for k in range(count):
        bits = ((planes[:, k, None] >> np.arange(WIDTH, dtype=np.uint64)) & np.uint64(1)).astype(np.int64).astype(kind)
        out += bits * (-(1 << k) if k == count - 1 else 1 << k)
    return out


def dot_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of all rows of ``a`` with all rows of ``b``: popcounts of ANDed planes, summed by weight."""
    most_a, most_b = a.shape[1], b.shape[1]
    by_weight = np.zeros((most_a + most_b - 1, len(a), len(b)), dtype=np.int64)
    for j in range(most_a):
        for k in range(most_b):
            both = np.bitwise_count(a[:, j, None] & b[None, :, k])
            if (j == most_a - 1) != (k == most_b - 1):
                by_weight[j + k] -= both
            else:
                by_weight[j + k] += both
    kind = np.int64 if max(most_a, most_b) <= NARROW_PLANES else object
    total = np.zeros((len(a), len(b)), dtype=kind)
    for weight, counts in enumerate(by_weight):
        total += counts.astype(kind) * (1 << weight)
    return total


def squared_lengths(a: np.ndarray) -> np.ndarray:
    """The dot product of each row with itself."""
    count = a.shape[1]
    kind = np.int64 if count <= NARROW_PLANES else object
    total = np.zeros(len(a), dtype=kind)
    for j in range(count):
        for k in range(count):
            both = np.bitwise_count(a[:, j] & a[:, k]).astype(np.int64).astype(kind) * (1 << (j + k))
            total += -both if (j == count - 1) != (k == count - 1) else both
    return total


class PackedCentroids:
    """Centroids as bit planes, their squared lengths, and the nearest of them."""

    def __init__(self, centroids: list[list[int]]):
        planes = max(map(planes_needed, centroids))
        self.planes = pack_planes(np.array(centroids, dtype=np.int64 if planes <= 63 else object), planes)
        self.squares = squared_lengths(self.planes)

    def nearest(self, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each row, the smaller of equally near ones, and the squared distance."""
        wide = max(planes.shape[1], self.planes.shape[1]) > NARROW_PLANES
        squares = self.squares.astype(object) if wide else self.squares
        beyond = squares[None, :] - 2 * dot_products(planes, self.planes)
        cluster = np.argmin(beyond, axis=1)
        own = squared_lengths(planes)
        return cluster, (own.astype(object) if wide else own) + beyond[np.arange(len(planes)), cluster]


def _packed(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, WIDTH)
            # a power of two, so the product is exact unless it leaves the doubles; those take whole numbers
            scaled = np.floor(x * scale)
            top = np.abs(scaled).max(axis=1, initial=0.0)
            planes: list[bytes | None] = [None] * batch.num_rows
            small = top < 2.0**62
            whole = scaled[small].astype(np.int64)
            size = np.where(whole >= 0, whole, -whole - 1).max(axis=1, initial=0)
            needed = np.array([1 + int(s).bit_length() for s in size], dtype=np.int64)
            places = np.flatnonzero(small)
            for count in np.unique(needed).tolist():
                rows = np.flatnonzero(needed == count)
                for row, packed in zip(places[rows].tolist(), pack_planes(whole[rows], count), strict=True):
                    planes[row] = packed.astype("<u8").tobytes()
            for row in np.flatnonzero(~small).tolist():
                parts = [_floor_product(v, scale) for v in x[row].tolist()]
                planes[row] = pack_planes(np.array([parts], dtype=object), planes_needed(parts))[0].astype("<u8").tobytes()
            yield batch_of(vec_id=batch.column("vec_id"), planes=pa.array(planes, pa.binary()))

    return run


def _floor_product(value: float, scale: int) -> int:
    top, bottom = value.as_integer_ratio()
    return scale * top // bottom


def packed_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, planes``: floor(scale * x) of the vectors with exactly 64 components, none null or non-finite."""
    rows = only(vectors, ["vec_id", "embedding"]).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")
    )
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return arrow_map(rows.filter((F.size("x") == WIDTH) & finite), _packed(scale), PACKED)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]]:
    """(ids, [(rows, their planes)]) of at most CHUNK vectors; rows of one number of planes come together."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            packed = part.column("planes").to_pylist()
            sizes = np.array([len(p) // 8 for p in packed])
            groups = []
            for count in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == count)
                words = np.frombuffer(b"".join(packed[r] for r in rows.tolist()), dtype="<u8")
                groups.append((rows, words.reshape(len(rows), count)))
            yield part.column("vec_id"), groups


def _summed(centroids: PackedCentroids):
    """Per centroid the number of its members in this task and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(centroids.planes)
        members = np.zeros(many, dtype=np.int64)
        sums = np.zeros((many, WIDTH), dtype=object)
        for _, groups in _chunks(batches):
            for _, planes in groups:
                cluster, _ = centroids.nearest(planes)
                members += np.bincount(cluster, minlength=many)
                for c in np.unique(cluster).tolist():
                    own = planes[cluster == c]
                    # the members that have bit k in a component, times the weight of the plane
                    for k in range(own.shape[1]):
                        bits = (own[:, k, None] >> np.arange(WIDTH, dtype=np.uint64)) & np.uint64(1)
                        sums[c] += bits.sum(axis=0).astype(object) * (-(1 << k) if k == own.shape[1] - 1 else 1 << k)
        yield _sum_rows(members, sums)

    return run


def _sum_rows(members: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    busy = np.flatnonzero(members)
    return batch_of(
        cluster=pa.array(busy.astype(np.int32)),
        members=pa.array(members[busy]),
        sums=pa.array([[str(v) for v in row] for row in sums[busy]], pa.list_(pa.string())),
    )


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the sums of the tasks, one centroid at a time in the order they come."""
    members: dict[int, int] = {}
    sums: dict[int, list[int]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            c = row["cluster"]
            own = [int(v) for v in row["sums"]]
            members[c] = members.get(c, 0) + row["members"]
            sums[c] = [a + b for a, b in zip(sums[c], own, strict=True)] if c in sums else own
    yield batch_of(
        cluster=pa.array(list(sums), pa.int32()),
        members=pa.array([members[c] for c in sums], pa.int64()),
        sums=pa.array([[str(v) for v in row] for row in sums.values()], pa.list_(pa.string())),
    )


def _assigned(centroids: PackedCentroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, groups in _chunks(batches):
            cluster = np.zeros(len(ids), dtype=np.int32)
            distance: list[int | None] = [None] * len(ids)
            for rows, planes in groups:
                own, far = centroids.nearest(planes)
                cluster[rows] = own
                for row, d in zip(rows.tolist(), far.tolist(), strict=True):
                    distance[row] = d if d <= _LARGEST else None
            yield batch_of(vec_id=ids, cluster=pa.array(cluster), distance=pa.array(distance, pa.int64()))

    return run


class CentroidClustering:
    """The kept vectors of a table, packed once, and rounds of assignment and exact averages over them."""

    def __init__(self, vectors: DataFrame, centroids: int = CENTROIDS, scale: int = SCALE):
        if centroids < 1 or scale < 1 or scale & (scale - 1):
            raise ValueError("at least one centroid; the scale is a power of two")
        self.packed = stored(packed_vectors(vectors, scale), "planes")
        name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("name")
        # rows that share an id are told apart by their planes; rows without one come last
        order = [F.col("name").asc_nulls_last(), "planes"]
        seeds = self.packed.select(name, "planes").orderBy(*order).limit(centroids).collect()
        words = [np.frombuffer(r["planes"], dtype="<u8")[None, :] for r in seeds]
        self.centroids = [[int(v) for v in unpack_planes(w)[0]] for w in words]

    def round(self) -> None:
        """Each vector goes to its nearest centroid, then centroids move to the floor of their members' mean."""
        if not self.centroids:
            return
        parts = arrow_map(self.packed, _summed(PackedCentroids(self.centroids)), SUMS)
        totals = arrow_map(parts.repartition(len(self.centroids), "cluster"), _total, SUMS).collect()  # a row per centroid
        for row in totals:
            self.centroids[row["cluster"]] = [int(v) // row["members"] for v in row["sums"]]

    def assigned(self) -> DataFrame:
        """``vec_id, cluster, distance`` under the centroids at hand."""
        if not self.centroids:
            return self.packed.sparkSession.createDataFrame([], FOUND)
        return arrow_map(self.packed, _assigned(PackedCentroids(self.centroids)), FOUND)

    def names(self) -> list[str]:
        """SHA-256 of each centroid's components in decimal, joined by commas."""
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]


def centroid_clusters(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``: one row per kept vector.

    Vectors that are null, not of 64 components, or hold a null or non-finite component are left out; with none left the result
    is empty, with fewer than ``centroids`` each is a centroid at first. Repeated rows are clustered each; rows without an id
    start no centroid while others can. Ties go to the smaller number. Finite components of any size are exact; a distance or sum
    of distances that does not fit a long is null. Other columns are ignored.
    """
    found = CentroidClustering(vectors, centroids)
    for _ in range(rounds):
        found.round()
    spark = vectors.sparkSession
    rows = stored(found.assigned(), "clusters")
    summed = F.sum(F.col("distance").cast("decimal(38,0)"))
    lost = F.count(F.when(F.col("distance").isNull(), 1))
    # one row per centroid
    sums = {r["cluster"]: (r["s"], r["lost"]) for r in rows.groupBy("cluster").agg(summed.alias("s"), lost.alias("lost")).collect()}

    def fitting(total, lost: int) -> int | None:
        return int(total) if not lost and total <= _LARGEST else None

    every = fitting(sum(int(s or 0) for s, _ in sums.values()), sum(n for _, n in sums.values()))
    names = found.names()
    about = [(c, fitting(s, n), every, names[c]) for c, (s, n) in sorted(sums.items())]
    table = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
