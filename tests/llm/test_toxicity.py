import zlib

import numpy as np
import pytest

from knownat.llm import toxicity

from .conftest import prose

DOCS, LABELS = "doc_id long, text string, votes int", "doc_id long, toxic int, label int"
BAD = ["zorkful", "zorkless", "grimbat", "vexlout"]


@pytest.fixture(scope="module")
def marked():
    rows, labels = [], []
    for i in range(600):
        text, bad = prose(i, 50), i % 6 == 0
        if bad:
            text = f"{text} {BAD[i // 6 % 4]} and {BAD[i // 12 % 4]}"
        rows.append((i, text, 0))
        if i % 3:
            labels.append((i, 0, 0))
        else:
            labels.append((i, int(bad), 0))
    return rows, labels


def test_held_out_rows_are_told_apart(spark, marked):
    rows, labels = marked
    got = toxicity.score_toxicity(
        spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == (r.score >= 0.7)
    truth = {i: i % 6 == 0 for i, *_ in rows}
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert not [r for r in held if r.predicted and not truth[r.doc_id]]


def test_every_learnable_row_is_mined_however_few_the_classifier_takes(spark, marked, monkeypatch):
    rows, labels = marked
    seen, mine = [], toxicity.mine_lexicon

    def watched(texts):
        seen.append(texts.count())
        seen.append(mine(texts))
        return seen[1]

    monkeypatch.setattr(toxicity, "LEARNING_ROWS", 60)
    monkeypatch.setattr(toxicity, "mine_lexicon", watched)
    got = toxicity.score_toxicity(
        spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    )
    assert got.count() == len(rows)
    assert seen[0] == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, *_ in labels)
    assert {b"0" + word.encode() for word in BAD} <= set(seen[1].entries)


def test_held_out_labels_do_not_matter(spark, marked):
    rows, labels = marked
    turned = [(d, 1 - t if zlib.crc32(str(d).encode()) % 3 == 1 else t, e) for d, t, e in labels]
    docs = spark.createDataFrame(rows, DOCS)
    first, second = (
        {r.doc_id: r.score for r in toxicity.score_toxicity(docs, spark.createDataFrame(t, LABELS)).collect()}
        for t in (labels, turned + [(None, 1, 0), (2, None, 0)])
    )
    assert first == pytest.approx(second, abs=1e-9)


def test_label_model_recovers_rates_and_doubts_repeated_voters():
    draw = np.random.default_rng(4)
    truth = draw.random(60_000) < 0.2
    rates = np.full((2, toxicity.VOTERS), 0.02)
    rates[1, :6] = 0.6
    votes = (draw.random((60_000, toxicity.VOTERS)) < rates[truth.astype(int)]).astype(float)
    votes[:, 1] = votes[:, 0]  # a voter that repeats another
    known = np.where(draw.random(60_000) < 0.2, truth, -1).astype(float)
    cells, count = np.unique(np.column_stack([votes, known]), axis=0, return_counts=True)
    model = toxicity.LabelModel.fit(cells[:, :-1], cells[:, -1], count.astype(float))
    assert abs(model.balance - 0.2) < 0.03
    assert np.allclose(model.rates[1, :6], 0.6, atol=0.06)
    assert model.correlations[0, 0, 1] > 0.95
    assert model.weights[0] < 0.7 * model.weights[3]
    assert np.mean((model.posterior(votes) > 0.5) == truth) > 0.93


def test_odd_rows_and_missing_labels(spark, odd, nothing):
    none = spark.createDataFrame([], LABELS)
    got = toxicity.score_toxicity(odd, none).collect()
    assert len(got) == odd.count()
    assert all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    some = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (1, 1, 0)], LABELS)
    assert toxicity.score_toxicity(odd, some).count() == odd.count()
    assert toxicity.score_toxicity(nothing, none).count() == 0
