import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from knownat.llm import mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shared_out(sizes, weights, most):
    """Targets by repeated resharing, as the rule is told."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    free, left, target = set(names), float(sum(sizes.values())), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= over
    return target


def test_targets_and_words_taken(odd):
    rows = mixing.plan_mixture(odd).collect()
    assert len(rows) == odd.count()
    sizes = defaultdict(int)
    for r in odd.collect():
        sizes[r.source] += words(r.text)
    wanted = shared_out(sizes, mixing.WEIGHTS, 3)
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(wanted[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert sum(wanted.values()) == pytest.approx(sum(sizes.values()))
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= 1


def test_a_target_stops_at_three_times_its_source(spark):
    rows = [("a", 10), ("b", 500), ("c", 400)]
    got = mixing.source_targets(spark.createDataFrame(rows, "source string, size long"))
    found = {r.source: r.target for r in got.collect()}
    assert found == pytest.approx(shared_out(dict(rows), (5, 2, 1), 3))
    assert found["a"] == 30.0


def test_position_inverts_the_integrated_schedule(spark):
    knots = ((0.0, 2.0), (0.25, 1.0), (1.0, 3.0))
    area = 0.25 * 1.5 + 0.75 * 2.0
    at = [i / 20 for i in range(20)]

    def demand(t):
        if t <= 0.25:
            return (2 * t - 2 * t * t) / area
        u = t - 0.25
        return (0.25 * 1.5 + u + u * u * (4 / 3)) / area

    frame = spark.createDataFrame([(t, demand(t) * 1000) for t in at], "t double, word double")
    position = mixing.position_of(F.col("word"), F.lit(0), F.lit(1000.0), (knots,))
    for row in frame.select("t", position.alias("p")).collect():
        assert row.p == pytest.approx(row.t, abs=1e-9)


def test_mixture_comes_in_position_order_with_whole_rows(odd):
    mixed = mixing.mix(odd).collect()
    plan = mixing.with_positions(mixing.plan_mixture(odd)).collect()
    assert mixing.mix(odd).columns == odd.columns
    assert len(mixed) == len(plan)
    order = sorted((r.position, r.doc_id or -1) for r in plan)
    assert sorted(r.doc_id or -1 for r in mixed) == sorted(d for _, d in order)
    assert mixed == mixing.mix(odd).collect()
    texts = {(r.doc_id, r.text) for r in odd.collect()}
    assert {(r.doc_id, r.text) for r in mixed} <= texts


def test_empty_table(nothing):
    assert mixing.plan_mixture(nothing).count() == 0
    assert mixing.mix(nothing).count() == 0
