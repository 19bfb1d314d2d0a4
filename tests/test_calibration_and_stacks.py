import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import catalog
from knownat.operators import calibration, ensembles


def cells_of(rows):
    found = {}
    for score, label in rows:
        n, pos = found.get(score, (0, 0))
        found[score] = (n + 1, pos + label)
    return sorted((s, n, p) for s, (n, p) in found.items())


def isotonic(cells):
    """Largest of the smallest averages: the value at i by the max-min formula."""
    n, pos = np.array([c[1] for c in cells]), np.array([c[2] for c in cells])
    cn, cp = np.concatenate([[0], n.cumsum()]), np.concatenate([[0], pos.cumsum()])
    size = len(cells)
    return [
        max(min((cp[b + 1] - cp[a]) / (cn[b + 1] - cn[a]) for b in range(i, size)) for a in range(i + 1))
        for i in range(size)
    ]


def test_isotonic_against_the_max_min_formula(make):
    draw = random.Random(2)
    groups = {
        "noise": [(round(draw.random(), 2), int(draw.random() < 0.4)) for _ in range(400)],
        "rising": [(i / 100, int(draw.random() < i / 100)) for i in range(100) for _ in range(5)],
        "falling": [(i / 50, int(draw.random() > i / 50)) for i in range(50) for _ in range(3)],
        "one": [(0.5, 1), (0.5, 0)],
    }
    rows = [(g, s, n, p) for g, r in groups.items() for s, n, p in cells_of(r)]
    cells = make(rows, "g string, probability double, n long, pos long").repartition(4)
    blocks = calibration.isotonic_blocks(cells, ["g"])
    held = blocks.collect()
    asked = [(g, x) for g in groups for x in (-0.1, 0.005, 0.25, 0.333, 0.5, 0.777, 0.995, 1.5)]
    values = {
        (r.g, r.probability): r.v
        for r in calibration.isotonic_values(
            make(asked + [("none", 0.5)], "g string, probability double"), blocks, ["g"],
            "probability", "v",
        ).collect()
    }
    for g, found in groups.items():
        cells = cells_of(found)
        told = isotonic(cells)
        for (s, _, _), v in zip(cells, told, strict=True):
            assert [b.value for b in held if b.g == g and b.low <= s <= b.high] == pytest.approx([v])
        for x in {x for _, x in asked}:
            assert values[g, x] == pytest.approx(np.interp(x, [c[0] for c in cells], told), abs=1e-12)
    assert values["none", 0.5] is None


def test_lines_are_where_the_likelihood_is_flat(make):
    draw = random.Random(4)
    rows = []
    for g, slope, shift in (("a", 0.6, -1.0), ("b", 1.7, 0.4)):
        for _ in range(600):
            p = round(draw.uniform(0.02, 0.98), 2)
            z = math.log(p / (1 - p))
            rows.append((g, p, int(draw.random() < 1 / (1 + math.exp(-slope * z - shift)))))
    counted = [(g, s, n, k) for g in "ab" for s, n, k in cells_of([(p, y) for h, p, y in rows if h == g])]
    cells = make(counted, "g string, probability double, n long, pos long")
    for method in ("platt", "intercept"):
        for g, a, b in calibration.fit_lines(cells, ["g"], method):
            mine = [(math.log(p / (1 - p)), y) for h, p, y in rows if h == g]
            gap = [y - 1 / (1 + math.exp(-a * z - b)) for z, y in mine]
            assert sum(gap) == pytest.approx(0, abs=1e-6)
            if method == "platt":
                assert sum(e * z for e, (z, _) in zip(gap, mine, strict=True)) == pytest.approx(1e-6 * a, abs=1e-6)
            else:
                assert a == 1.0


def test_a_separating_score_still_settles(make):
    cells = make([(0.2, 5, 0), (0.8, 5, 5)], "probability double, n long, pos long")
    [(_, slope, _)] = calibration.fit_lines(cells.select(F.lit(0).alias("g"), "*"), ["g"], "platt")
    assert slope > 3


def stack_rows(seed=6, folds=4, each=60):
    draw, rows = random.Random(seed), []
    for f in range(folds):
        for i in range(each):
            y = int(draw.random() < 0.4)
            scores = {"a": draw.betavariate(2 + 2 * y, 3), "b": draw.betavariate(2 + y, 3), "c": draw.random()}
            if i % 9 == 4:
                scores.pop("c")
            rows += [(f"f{f}", f"d{f}-{i}", y, m, s) for m, s in scores.items()]
    return rows


def plain_stack(x, y, c):
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.diag([1 / c] * (x.shape[1] - 1) + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    return w


def test_stacking_scores_every_decision(spark, make):
    rows = stack_rows()
    base = make(rows, "fold_id string, decision_key string, deterioration_label int, model string, probability double")
    folds = make(
        [(f"f{i}", f"200{i}-01-01", f"200{i}-12-31") for i in range(4)],
        "fold_id string, origin string, validation_end string",
    )
    got = {r.decision_key: r for r in ensembles.rolling_stacking(base, folds, ["decision_key", "fold_id"]).collect()}
    wide = {}
    for f, d, y, m, s in rows:
        wide.setdefault((f, d, y), {})[m] = s
    assert set(got) == {d for _, d, _ in wide}
    for f, d, y in wide:
        scores = wide[f, d, y]
        past = [(k[2], v) for k, v in wide.items() if k[0] < f and len(v) == 3]
        if len(scores) < 3 or not past:
            assert got[d].stacking_source.startswith("average")
            assert got[d].probability == pytest.approx(np.mean(list(scores.values())))
        else:
            x = np.array([[v[m] for m in "abc"] for _, v in past])
            w = plain_stack(x, np.array([y for y, _ in past]), 0.1)
            wanted = 1 / (1 + np.exp(-(np.dot(w[:3], [scores[m] for m in "abc"]) + w[3])))
            assert got[d].probability == pytest.approx(wanted, abs=1e-7)
            assert got[d].stacking_source == "meta_model"
    later = base.where("fold_id = 'f3'").drop("fold_id")
    history = base.where("fold_id <> 'f3'")
    one = ensembles.champion_scores(
        "ensemble_stacking", later, ["decision_key"], history=history, inner=spark.createDataFrame(
            [("a", 0.7)], "model string, ROC_AUC double")
    ).collect()
    assert {r.decision_key: r.probability for r in one} == pytest.approx(
        {d: got[d].probability for f, d, _ in wide if f == "f3"}, abs=1e-7
    )
    with pytest.raises(ValueError, match="neither"):
        ensembles.champion_scores("unknown", later, ["decision_key"], history=history, inner=history)


def test_ensembles_and_champions_read_their_base_once(spark):
    for name in ("rolling_ensembles", "frozen_champion_scores", "rolling_stacking"):
        made = catalog.queries()[name](spark, "/root/testdata/sf0.001")
        assert "parquet" not in made._jdf.queryExecution().optimizedPlan().toString(), name
