import hashlib
import math
import random

import numpy as np
import pytest

from knownat.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, distance long, place int"


def told(rows, size, k, rounds, scale=64):
    """Plain k-means over exact integers."""
    kept = []
    for vec_id, vector in rows:
        if vector is None or len(vector) != size:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, [math.floor(scale * float(np.float32(x))) for x in vector]))
    drawn = sorted(
        kept,
        key=lambda r: (
            r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "",
            r[1],
        ),
    )
    centres = [v for _, v in drawn[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        own = [[] for _ in centres]
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        centres = [
            [sum(column) // len(held) for column in zip(*held)] if held else old
            for held, old in zip(own, centres)
        ]
    placed = [(i, *nearest(v)[::-1]) for i, v in kept]
    by = {}
    for _, n, d in placed:
        by[n] = by.get(n, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, n, d, by[n], sum(by.values()), digest[n]) for i, n, d in placed]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, 1, 2, 3) for i, v in rows], SCHEMA).repartition(3)


def odd_vectors():
    draw = random.Random(5)
    rows = [(i, [draw.choice((-0.5, 0.0, 0.26, draw.gauss(0, 1))) for _ in range(4)]) for i in range(90)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, [0.0] * 4), (95, [0.0] * 4)]
    rows += [(96, None), (97, []), (98, [1.0] * 3), (99, [1.0] * 5), (100, [1.0, None, 0.0, 0.0])]
    rows += [(101, [1.0, math.nan, 0.0, 0.0]), (102, [math.inf, 0.0, 0.0, 0.0])]
    return rows


@pytest.mark.parametrize(("k", "rounds"), [(16, 3), (5, 1), (1, 2), (200, 2)])
def test_against_plain_distances(spark, k, rounds):
    rows = odd_vectors()
    got = centroids.cluster_vectors(frame(spark, rows), size=4, k=k, rounds=rounds).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(told(rows, 4, k, rounds), key=repr)


def test_ties_go_to_the_smaller_number():
    bisectors = centroids.Bisectors(np.array([[0, 0], [2, 0], [2, 0], [0, 2]]))
    points = np.array([[1, 0], [2, 0], [1, 1], [0, 1], [3, 3]])
    cluster, distance = bisectors.nearest(points)
    assert cluster.tolist() == [0, 1, 0, 0, 1]
    assert distance.tolist() == [1, 0, 2, 1, 10]


def test_large_components_stay_exact():
    draw = np.random.default_rng(2)
    middle = draw.integers(-centroids.LARGEST, centroids.LARGEST, (7, 8))
    points = np.concatenate([middle + draw.integers(-2, 3, middle.shape), (middle[1:] + middle[:-1]) // 2])
    cluster, distance = centroids.Bisectors(middle).nearest(points)
    for v, n, d in zip(points.tolist(), cluster.tolist(), distance.tolist()):
        assert (d, n) == min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(middle.tolist()))


def test_empty_table_and_too_large(spark):
    assert centroids.cluster_vectors(frame(spark, []), size=4).collect() == []
    assert centroids.cluster_vectors(frame(spark, [(1, [1.0])]), size=4).collect() == []
    with pytest.raises(Exception, match="smaller than"):
        centroids.cluster_vectors(frame(spark, [(1, [1e30] * 4)]), size=4).collect()
