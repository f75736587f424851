"""Exact k-means over whole-number vectors with bounded vectors and a shrinking search ball.

Every vector keeps its nearest and second-nearest centroid, an upper bound of the distance to the first and a lower bound of the
distance to all others. After a move of the centroids the bounds are widened by the ways they went; where the upper bound stays
below the lower one, or below half the way from the centroid to its next neighbour, nothing is computed. Other vectors measure both
remembered centroids, start from the closer one and scan its neighbours by distance. A neighbour j of p can only win or become second
if |p - j| <= |x - p| + |x - second|, so the ball of the search shrinks as better ones turn up. What is left in the ball is compared
by whole squared distances; ties go to the smaller number.

Rounds are passes over a stored table. Each task adds up its vectors per cluster, Spark sums these, and only the sums (centroids x
components) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import prepare, release, stored

SCALE = 256
# Below this, sums of squared differences of whole numbers keep to 64 bits for up to 64 components.
NARROW = 2**27
SAFE = 1e-9  # relative room for rounding in bounds, which are floating numbers
LIMB = 30
_EXACT_TOP = 2**63 - 1


def whole(values: list[float]) -> list[int]:
    """floor(256 * x) of each component, exactly."""
    out = []
    for x in values:
        top, bottom = x.as_integer_ratio()
        out.append(SCALE * top // bottom)
    return out


@dataclass
class Centroids:
    """Whole-number centroids with what the search needs: neighbours by distance, half the way to the next, the last moves."""

    exact: list[list[int]]
    moves: np.ndarray

    def __post_init__(self):
        k = len(self.exact)
        self.narrow = all(abs(v) < NARROW for row in self.exact for v in row)
        self.points = np.array(self.exact, np.int64 if self.narrow else object).reshape(k, -1)
        apart = np.zeros((k, k))
        for i in range(k):
            for j in range(i):
                apart[i, j] = apart[j, i] = _root(sum((a - b) ** 2 for a, b in zip(self.exact[i], self.exact[j])))
        others = np.where(np.eye(k, dtype=bool), -1.0, apart)
        # The centroid itself comes first and is left out.
        self.near = np.argsort(others, axis=1, kind="stable")[:, 1:]
        self.ways = np.take_along_axis(apart, self.near, axis=1)
        self.half = self.ways[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        # The farthest move of any other centroid.
        order = np.argsort(-self.moves, kind="stable")
        self.others_move = np.full(k, self.moves[order[0]] if k else 0.0)
        if k:
            self.others_move[order[0]] = self.moves[order[1]] if k > 1 else 0.0

    def moved(self, new: list[list[int]]) -> Centroids:
        return Centroids(new, np.array([_root(sum((a - b) ** 2 for a, b in zip(x, y))) for x, y in zip(self.exact, new)]))


def _root(square: int) -> float:
    try:
        return float(square) ** 0.5
    except OverflowError:
        return float("inf")


def nearest(vectors: np.ndarray, at: Centroids, first: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """(first, second, upper, lower) after the last moves, by bounds and ball search. `vectors` and centroids are narrow numbers."""
    n, k = len(vectors), len(at.exact)
    if k == 1:
        return np.zeros(n, np.int32), np.zeros(n, np.int32), np.full(n, np.inf), np.zeros(n)
    first, second = first.copy(), second.copy()
    upper = (upper + at.moves[first]) * (1 + SAFE)
    lower = np.maximum(lower - at.others_move[first], 0.0) * (1 - SAFE)
    bound = np.maximum(lower, at.half[first] * (1 - SAFE))

    def square(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
        gap = vectors[rows] - at.points[centroid]
        return np.einsum("ij,ij->i", gap, gap)

    loose = np.flatnonzero(~(upper < bound))
    own = square(loose, first[loose])
    upper[loose] = np.sqrt(own) * (1 + SAFE)
    still = ~(upper[loose] < bound[loose])
    rows, own = loose[still], own[still]
    if not len(rows):
        return first, second, upper, lower
    other = square(rows, second[rows])
    # The closer of the two remembered centroids is where the scan starts; equal ones in the order of their numbers.
    swap = (other < own) | ((other == own) & (second[rows] < first[rows]))
    start = np.where(swap, second[rows], first[rows])
    best, next_ = start.copy(), np.where(swap, first[rows], second[rows])
    best_square, next_square = np.where(swap, other, own), np.where(swap, own, other)
    reach = np.sqrt(best_square)  # from the vector to the centre of the ball; the centre stays
    known = next_.copy()
    open_ = np.arange(len(rows))
    for step in range(k - 1):
        way = at.ways[start[open_], step]
        open_ = open_[way <= (reach[open_] + np.sqrt(next_square[open_])) * (1 + SAFE)]
        if not len(open_):
            break
        centroid = at.near[start[open_], step]
        fresh = centroid != known[open_]
        take, centroid = open_[fresh], centroid[fresh]
        found = square(rows[take], centroid)
        wins = (found < best_square[take]) | ((found == best_square[take]) & (centroid < best[take]))
        follows = ~wins & ((found < next_square[take]) | ((found == next_square[take]) & (centroid < next_[take])))
        w, f = take[wins], take[follows]
        next_[w], next_square[w] = best[w], best_square[w]
        best[w], best_square[w] = centroid[wins], found[wins]
        next_[f], next_square[f] = centroid[follows], found[follows]
    first[rows], second[rows] = best, next_
    upper[rows] = np.sqrt(best_square) * (1 + SAFE)
    lower[rows] = np.sqrt(next_square) * (1 - SAFE)
    return first, second, upper, lower


def _wide_nearest(vector: list[int], at: Centroids) -> tuple[int, int]:
    """(squared distance, centroid) over all centroids, in numbers of any size."""
    return min((sum((a - b) ** 2 for a, b in zip(vector, c)), j) for j, c in enumerate(at.exact))


def _limbs(values: list[int]) -> Iterator[tuple[int, list[int]]]:
    """(place, signed parts below 2^LIMB) of whole numbers of any size; the parts can be summed apart."""
    place = 0
    while place == 0 or any(values):
        yield place, [(abs(v) & (2**LIMB - 1)) * (1 if v >= 0 else -1) for v in values]
        values = [(abs(v) >> LIMB) * (1 if v >= 0 else -1) for v in values]
        place += 1


_FIELDS = [
    ("first", pa.int32()), ("second", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("distance", pa.int64()),
    ("place", pa.int32()), ("members", pa.int64()), ("sums", pa.list_(pa.int64())),
]
_STATE = "first int, second int, upper double, lower double, distance bigint, place int, members bigint, sums array<bigint>"


class _Sums:
    """Sums and numbers of a task's vectors by cluster."""

    def __init__(self, k: int, dims: int):
        self.members = np.zeros(k, np.int64)
        self.narrow = np.zeros((k, dims), np.int64)
        self.wide: dict[int, list[int]] = {}

    def add(self, vectors: np.ndarray, clusters: np.ndarray) -> None:
        self.members += np.bincount(clusters, minlength=len(self.members))
        np.add.at(self.narrow, clusters, vectors)

    def add_wide(self, vector: list[int], cluster: int) -> None:
        self.members[cluster] += 1
        self.wide[cluster] = [a + b for a, b in zip(vector, self.wide.get(cluster, [0] * len(vector)))]

    def rows(self) -> Iterator[tuple[int, int, int, list[int]]]:
        """(cluster, place, members, sums)."""
        for j in np.flatnonzero(self.members).tolist():
            yield j, 0, int(self.members[j]), self.narrow[j].tolist()
            if j in self.wide:
                for place, parts in _limbs(self.wide[j]):
                    yield j, place, 0, parts


def _assign(rows: DataFrame, at: Centroids, dims: int) -> DataFrame:
    """One pass: every vector with its state after the last moves, and rows with the sums of each task (id and vector null)."""
    schema = rows.select("vec_id", "vector").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, kinds = _Sums(len(at.exact), dims), None
        for batch in batches:
            kinds = kinds or [batch.schema.field(0).type, batch.schema.field(1).type]
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            with np.errstate(over="ignore"):
                scaled = np.floor(values * SCALE)
            narrow = (np.abs(scaled) < NARROW).all(axis=1) & at.narrow
            n = len(values)
            first, second, upper, lower = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in (2, 3, 4, 5))
            distance: list[int | None] = [None] * n
            some = np.flatnonzero(narrow)
            vectors = scaled[some].astype(np.int64)
            state = nearest(vectors, at, first[some], second[some], upper[some], lower[some])
            for own, new in zip((first, second, upper, lower), state):
                own[some] = new
            gap = vectors - at.points[first[some]] if at.narrow else vectors
            for i, d in zip(some.tolist(), np.einsum("ij,ij->i", gap, gap).tolist()):
                distance[i] = d
            sums.add(vectors, first[some])
            for i in np.flatnonzero(~narrow).tolist():
                vector = whole(values[i].tolist())
                square, first[i] = _wide_nearest(vector, at)
                second[i], upper[i], lower[i] = 0, np.inf, 0.0
                distance[i] = square if square <= _EXACT_TOP else None
                sums.add_wide(vector, int(first[i]))
            nothing = [pa.nulls(n, kind) for _, kind in _FIELDS[5:]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *map(pa.array, (first, second, upper, lower)), pa.array(distance, pa.int64()), *nothing],
                ["vec_id", "vector", *(name for name, _ in _FIELDS)],
            )
        if kinds and (found := list(sums.rows())):
            cluster, place, members, parts = map(list, zip(*found))
            empty = [pa.nulls(len(found), kind) for kind in (*kinds, *(kind for _, kind in _FIELDS[1:5]))]
            columns = [*empty[:2], pa.array(cluster, pa.int32()), *empty[2:], *(
                pa.array(x, kind) for x, (_, kind) in zip((place, members, parts), _FIELDS[5:])
            )]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vector", *(name for name, _ in _FIELDS)])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return rows.select("vec_id", "vector", "first", "second", "upper", "lower").mapInArrow(run, f"{kinds}, {_STATE}")


def _means(found: DataFrame, at: Centroids) -> list[list[int]]:
    """floor(sum / count) of each cluster, in whole numbers; empty clusters stay. One row per cluster, component and limb is collected."""
    parts = found.filter("place is not null").select("first", "place", "members", F.posexplode("sums").alias("component", "part"))
    sums = parts.groupBy("first", "place", "component").agg(
        F.sum(F.col("part").cast("decimal(38,0)")).alias("part"), F.sum("members").alias("members")
    ).collect()
    members: dict[int, int] = {}
    total: dict[tuple[int, int], int] = {}
    for r in sums:
        key = (r["first"], r["component"])
        total[key] = total.get(key, 0) + (int(r["part"]) << (LIMB * r["place"]))
        if r["place"] == 0:
            members[r["first"]] = r["members"]
    return [
        [total[j, c] // members[j] for c in range(len(row))] if members.get(j) else row for j, row in enumerate(at.exact)
    ]


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has exactly `dims` components, none of them null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def _first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest hashes of their ids; of rows that share an id the smaller vector first."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    drawn = rows.select("vector", F.sha2(name, 256).alias("drawn")).orderBy("drawn", "vector").limit(k)
    return [whole(r["vector"]) for r in drawn.collect()]


def kmeans(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of every usable vector, after `rounds` moves of the centroids.

    `centroid` is an array of whole numbers as texts, as they may have any size. Vectors with a wrong length or a component that is
    null or not finite are left out. Repeated rows and rows that share an id all count. Ties go to the smaller cluster number. With
    fewer than k vectors there are as many clusters as vectors; a table without any gives no rows. Components above 2^27 in steps of
    1/256 are compared in numbers of any size, row by row; a squared distance (or sum of such) beyond 64 bits is null. Extra columns
    are left behind.
    """
    spark = prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).filter(usable(F.col("vector"), dims))
    exact = _first_centroids(rows, k, seed)
    state = {"first": F.lit(0), "second": F.lit(1 if len(exact) > 1 else 0), "upper": F.lit(float("inf")), "lower": F.lit(0.0)}
    held = rows.withColumns(state)
    if not exact:
        return held.select(
            "vec_id", F.col("first").alias("cluster"), *(F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")),
            F.array().cast("array<string>").alias("centroid"),
        ).filter("false")
    at, last = Centroids(exact, np.zeros(len(exact))), None
    for turn in range(rounds + 1):
        found = stored(_assign(held, at, dims), "clusters")
        if last is not None:
            release(last)
        last, held = found, found.filter("place is null")
        if turn < rounds:
            at = at.moved(_means(found, at))
    known = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = F.when(F.count("distance") == F.count("*"), known)
    per = {r["first"]: r["inertia"] for r in held.groupBy("first").agg(inertia.alias("inertia")).collect()}  # one row per cluster
    total = None if None in per.values() else sum(per.values())
    small = lambda x: None if x is None or x > _EXACT_TOP else int(x)
    about = spark.createDataFrame(
        [(j, small(per.get(j, 0)), small(total), [str(v) for v in row]) for j, row in enumerate(at.exact)],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid array<string>",
    )
    placed = held.select("vec_id", F.col("first").alias("cluster"), "distance")
    return placed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
