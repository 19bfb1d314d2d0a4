import random

import numpy as np
import pytest
import zlib

from knownat.llm import quality

from .conftest import prose

DOCS, LABELS = "doc_id long, text string, size long", "doc_id long, quality int, extra int"


@pytest.fixture(scope="module")
def marked():
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        text = prose(i, 60)
        if not good:
            text = " | ".join(text.split()) if i % 8 else text.upper().replace(" ", "!! ")
        rows.append((i, text, 1))
        labels.append((i, int(good), 0))
    return rows, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_rows_are_told_apart(spark, marked):
    rows, labels = marked
    docs, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    got = quality.score_quality(docs, *quality.learn_quality(docs, table)).collect()
    truth = {d: q for d, q, _ in labels}
    assert len(got) == len(rows)
    assert all(r.held_out == held(r.doc_id) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out]
    assert np.mean(right) > 0.95


def test_held_out_labels_do_not_matter(spark, marked):
    rows, labels = marked
    docs = spark.createDataFrame(rows, DOCS)
    turned = [(d, 1 - q if held(d) else q, e) for d, q, e in labels] + [(None, 1, 0), (3, None, 0)]
    scores = []
    for table in (labels, turned):
        model = quality.learn_quality(docs, spark.createDataFrame(table, LABELS))
        found = quality.score_quality(docs, *model).collect()
        scores.append({r.doc_id: r.score for r in found})
    assert scores[0] == pytest.approx(scores[1], abs=1e-9)


def test_context_vectors_agree_with_a_plain_count(spark):
    text = "a b a c, a"
    rows = quality.context_vectors(spark.createDataFrame([(1, text, 1), (2, None, 1)], DOCS)).collect()
    tokens = ["a", "b", "a", "c", ",", "a"]
    hashes = quality.WordHashes()
    bucket = [hashes[t.encode()] % quality.BUCKETS for t in tokens]
    wanted = {}
    for i, here in enumerate(tokens):
        vector = wanted.setdefault(bucket[i], np.zeros(quality.WIDTH))
        for j in range(max(0, i - 2), min(len(tokens), i + 3)):
            if j != i:
                h = hashes[tokens[j].encode()]
                for shift in (20, 34):
                    vector[h >> shift & 63] += (h >> shift + 8 & 1) * 2 - 1
    assert {r.bucket: list(r.vector) for r in rows} == {b: v.tolist() for b, v in wanted.items()}
    assert {r.bucket: r.n for r in rows} == {b: bucket.count(b) for b in wanted}


def test_temperature_calibrates_overconfident_logits():
    draw = np.random.default_rng(3)
    rows = draw.normal(size=(4000, 5))
    labels = (draw.random(4000) < 1 / (1 + np.exp(-2 * rows[:, 0]))).astype(int)
    aside = np.arange(4000) % 5 == 0
    model = quality.Network.fit(rows, labels, aside)
    chance = model.probabilities(rows[aside])
    assert abs(chance.mean() - labels[aside].mean()) < 0.05
    top = chance > 0.8
    assert abs(chance[top].mean() - labels[aside][top].mean()) < 0.08


def test_odd_rows_without_labels(spark, odd):
    table = spark.createDataFrame([], LABELS)
    got = quality.score_quality(odd, *quality.learn_quality(odd, table)).collect()
    assert len(got) == odd.count()
    assert {r.score for r in got} == {0.5}
    assert not any(r.held_out for r in got if r.doc_id is None)


def test_keeping_returns_whole_rows(spark, odd, marked):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 17)], LABELS)
    kept = quality.keep_good(odd, labels)
    model = quality.learn_quality(odd, labels)
    scored = quality.score_quality(odd, *model).where("predicted = 1")
    assert kept.columns == odd.columns
    assert kept.count() == scored.count()


def test_empty_table(spark, nothing):
    table = spark.createDataFrame([], LABELS)
    model = quality.learn_quality(nothing, table)
    assert quality.score_quality(nothing, *model).count() == 0
    assert quality.keep_good(nothing, table).count() == 0
