"""Centroid clustering of integer vectors by a tournament of bisectors.

For each pair of centroids i < j the bisector has the integer normal 2(cj - ci) and the threshold
|cj|^2 - |ci|^2: a vector lies nearer to j exactly if normal . x exceeds the threshold, and zero
favours the smaller number.  A vector starts with centroid 0; each of the k-1 linear sign tests
eliminates one of two centroids, and only the winner's distance is computed.  All arithmetic is
exact.  A round is one scan: tasks sum the vectors of each cluster, Spark adds these sums, and
the driver holds k centroids and nothing else, so a lost task is repeated from the table alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from knownat.llm.common import narrow_batches, settled

#: Integer components must stay below this size: squared distances then fit 64 bits.
LARGEST = 1 << 26
#: Below this size whole numbers are exact as doubles, so tests may use fast products.
_EXACT = float(1 << 53)


class Bisectors:
    """Normals and thresholds between all pairs of k integer centroids."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = np.asarray(centroids, np.int64)
        squares = (self.centroids**2).sum(axis=1)
        #: [i, j] is the test of j against i.
        self.normals = 2 * (self.centroids[None, :, :] - self.centroids[:, None, :])
        self.thresholds = squares[None, :] - squares[:, None]
        self._reach = float(np.abs(self.normals).max(initial=0)) * self.centroids.shape[1]
        self._fast = self.normals.astype(np.float64)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (ties: the smaller) and the squared distance to it."""
        standing = np.zeros(len(vectors), np.int64)
        exact_doubles = self._reach * float(np.abs(vectors).max(initial=0)) < _EXACT
        normals = self._fast if exact_doubles else self.normals
        points = vectors.astype(normals.dtype)
        for rival in range(1, len(self.centroids)):
            side = np.einsum("ij,ij->i", normals[standing, rival], points)
            standing[side > self.thresholds[standing, rival]] = rival
        away = vectors - self.centroids[standing]
        return standing, np.einsum("ij,ij->i", away, away)


def whole_vectors(values: pa.Array, size: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, vectors): rows that hold ``size`` finite components, as floor(scale * x)."""
    lengths = np.asarray(values.value_lengths().fill_null(-1))
    places = np.flatnonzero(lengths == size)
    flat = values.take(pa.array(places)).flatten().cast(pa.float64())
    numbers = flat.to_numpy(zero_copy_only=False).reshape(-1, size)  # a null becomes NaN
    good = np.isfinite(numbers).all(axis=1)
    scaled = np.floor(scale * numbers[good])
    if (np.abs(scaled) >= LARGEST).any():
        raise ValueError(f"scaled components must be smaller than {LARGEST} in size")
    return places[good], scaled.astype(np.int64)


def _vectors(
    batches: Iterator[pa.RecordBatch], size: int, scale: float
) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        places, vectors = whole_vectors(batch.column(1), size, scale)
        yield batch.column(0).take(pa.array(places)), vectors


def _list_column(vectors: np.ndarray) -> pa.Array:
    ends = np.arange(0, vectors.size + 1, max(1, vectors.shape[1]), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors.ravel()))


def first_centroids(rows: DataFrame, size: int, scale: float, k: int) -> np.ndarray:
    """The k vectors whose ids come first by SHA-256 of ``1:<id>`` (ties: by components)."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _vectors(batches, size, scale):
            yield pa.record_batch([ids, _list_column(vectors)], ["id", "vector"])

    order = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    chosen = (
        rows.mapInArrow(kept, "id long, vector array<long>")
        .select(order.alias("draw"), "vector")
        .orderBy(F.asc_nulls_last("draw"), "vector")
        .limit(k)
        .collect()
    )
    return np.array([r.vector for r in chosen], np.int64).reshape(len(chosen), size)


def _recentred(rows: DataFrame, centroids: np.ndarray, scale: float) -> np.ndarray:
    """Exact floor of the mean of each cluster; an empty cluster keeps its centroid."""
    bisectors, size = Bisectors(centroids), centroids.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for _, vectors in _vectors(batches, size, scale):
            cluster, _ = bisectors.nearest(vectors)
            for number in np.unique(cluster).tolist():
                own = vectors[cluster == number]
                count, held = totals.get(number, (0, None))
                added = own.sum(axis=0)
                totals[number] = [count + len(own), added if held is None else held + added]
        for number, (count, held) in totals.items():
            places = pa.array(np.arange(size, dtype=np.int32))
            yield pa.record_batch(
                [pa.array([number] * size, pa.int32()), places, pa.array(held),
                 pa.array([count] * size, pa.int64())],
                ["cluster", "place", "held", "rows"],
            )

    wide = DecimalType(38, 0)
    found = (
        rows.mapInArrow(sums, "cluster int, place int, held long, rows long")
        .groupBy("cluster", "place")
        .agg(F.sum(F.col("held").cast(wide)).alias("held"), F.sum("rows").alias("rows"))
        .collect()  # k times size rows at most
    )
    moved = centroids.copy()
    for row in found:
        moved[row.cluster, row.place] = int(row.held) // row.rows
    return moved


def fit_centroids(
    vectors: DataFrame, *, size: int = 64, scale: float = 64.0, k: int = 16, rounds: int = 3,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> np.ndarray:
    """Integer centroids after ``rounds`` of assignment and exact floors of means; see
    :func:`assign` for the rows that count.  Fewer rows than k give that many centroids."""
    rows = _input(vectors, id_column, vector_column)
    centroids = first_centroids(rows, size, scale, k)
    for _ in range(rounds if len(centroids) else 0):
        moved = _recentred(rows, centroids, scale)
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids


def _input(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    narrow_batches(vectors.sparkSession)
    return vectors.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(vector_column).cast("array<double>").alias("vector"),
    )


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def assign(
    vectors: DataFrame, centroids: np.ndarray, *, scale: float = 64.0,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """(id, cluster, distance) for each row whose vector has all its components.

    Rows with a null vector, another length, a null or a non-finite component give no row.
    Repeated rows and equal vectors each give one; a tie goes to the smaller number; a null id
    stays null.  An empty table, or no centroids, gives no rows.  Other columns are not read.
    Components of ``LARGEST`` or more in size are an error, for distances would not be exact.
    """
    rows = _input(vectors, id_column, vector_column)
    if not len(centroids):
        return rows.select(
            "id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")
        ).where("false")
    bisectors, size = Bisectors(centroids), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, kept in _vectors(batches, size, scale):
            cluster, distance = bisectors.nearest(kept)
            yield pa.record_batch(
                [ids, pa.array(cluster.astype(np.int32)), pa.array(distance)],
                ["id", "cluster", "distance"],
            )

    return rows.mapInArrow(run, "id long, cluster int, distance long")


def cluster_vectors(
    vectors: DataFrame, *, size: int = 64, scale: float = 64.0, k: int = 16, rounds: int = 3,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256), rows as in
    :func:`assign`; inertia is the sum of distances over a cluster, and over all of them."""
    names = {"id_column": id_column, "vector_column": vector_column}
    centroids = fit_centroids(vectors, size=size, scale=scale, k=k, rounds=rounds, **names)
    placed = settled(assign(vectors, centroids, scale=scale, **names))
    sums = placed.groupBy("cluster").agg(F.sum("distance").alias("held")).collect()  # k rows
    inertia = sum(row.held for row in sums)
    totals = placed.sparkSession.createDataFrame(
        [(r.cluster, r.held, inertia, centroid_digest(centroids[r.cluster])) for r in sums],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return placed.join(F.broadcast(totals), "cluster").select(  # k rows
        "id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


SQL = """
WITH kept AS (
    SELECT row_number() OVER () AS rid, vec_id,
           list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) = 64
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), started AS (
    SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR) NULLS LAST, v) - 1)::INT
               AS cluster, v AS centre
    FROM kept
    ORDER BY sha256('1:' || vec_id::VARCHAR) NULLS LAST, v
    LIMIT 16
), {rounds}, final AS (
    SELECT vec_id, cluster, distance FROM placed3
)
SELECT f.vec_id, f.cluster, f.distance,
       (sum(f.distance) OVER (PARTITION BY f.cluster))::BIGINT AS cluster_inertia,
       (sum(f.distance) OVER ())::BIGINT AS inertia,
       sha256(list_reduce(list_transform(c.centre, lambda x: x::VARCHAR), lambda a, b: a || ',' || b))
           AS centroid_sha256
FROM final f JOIN centres3 c ON f.cluster = c.cluster
"""

_PLACED = """placed{n} AS (
    SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v,
           arg_min(cluster, d * 16 + cluster)::INT AS cluster, min(d)::BIGINT AS distance
    FROM (
        SELECT k.rid, k.vec_id, k.v, c.cluster,
               list_sum(list_transform(list_zip(k.v, c.centre), lambda p: (p[1] - p[2]) * (p[1] - p[2])))
                   AS d
        FROM kept k CROSS JOIN {centres} c
    )
    GROUP BY rid
)"""

_MOVED = """sums{n} AS (
    SELECT cluster, place, sum(x)::HUGEINT AS held, count(*)::HUGEINT AS n
    FROM (
        SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS place FROM placed{before}
    )
    GROUP BY cluster, place
), means{n} AS (
    SELECT cluster,
           list(((held - ((held % n) + n) % n) // n)::BIGINT ORDER BY place) AS centre
    FROM sums{n} GROUP BY cluster
), centres{n} AS (
    SELECT o.cluster, coalesce(m.centre, o.centre) AS centre
    FROM {old} o LEFT JOIN means{n} m ON o.cluster = m.cluster
)"""


def sql() -> str:
    """The same in SQL: every distance to every centroid, three rounds and a last assignment."""
    steps, centres = [_PLACED.format(n=0, centres="started")], "started"
    for n in (1, 2, 3):
        steps.append(_MOVED.format(n=n, before=n - 1, old=centres))
        centres = f"centres{n}"
        steps.append(_PLACED.format(n=n, centres=centres))
    return SQL.replace("{rounds}", ", ".join(steps))
