from collections import Counter, defaultdict

import numpy as np
import pytest

from knownat.llm import suffixes


def brute(docs, least=50):
    words = {t: t.encode().split() for _, t in docs if t is not None}
    owners = defaultdict(set)
    for text, w in words.items():
        for s in range(len(w) - least + 1):
            owners[tuple(w[s : s + least])].add(text)
    holders = Counter()
    for doc, text in {(d, t) for d, t in docs if t is not None}:
        holders[text] += 1
    found = set()
    for doc, text in docs:
        if text is None:
            continue
        w = words[text]
        if holders[text] > 1 and len(w) >= least:
            found.add((doc, 0, len(w)))
        starts = [
            s for s in range(len(w) - least + 1) if len(owners[tuple(w[s : s + least])]) > 1
        ]
        while starts:
            end = 0
            while end + 1 < len(starts) and starts[end + 1] == starts[end] + 1:
                end += 1
            found.add((doc, starts[0], starts[end] - starts[0] + least))
            starts = starts[end + 1 :]
    return sorted(found, key=repr)


def spans(frame):
    return sorted(((r.doc_id, r.start_word, r.n_words) for r in frame.collect()), key=repr)


def test_corpus_agrees_with_brute_force(corpus, corpus_frame):
    got = spans(suffixes.repeated_passages(corpus_frame))
    assert got == brute(corpus)
    assert len(got) > 15


def test_odd_rows(odd):
    got = spans(suffixes.repeated_passages(odd))
    assert got == brute([(r.doc_id, r.text) for r in odd.collect()])


@pytest.mark.parametrize("parts", [1, 7])
def test_runs_over_task_borders(spark, corpus, corpus_frame, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert spans(suffixes.repeated_passages(corpus_frame, least=40, sparse=20)) == brute(corpus, 40)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_keeper_is_the_smallest_holder(spark, corpus, corpus_frame):
    rows = suffixes.repeated_passages(corpus_frame).collect()
    assert all(r.first_doc_id <= r.doc_id for r in rows)
    assert any(r.first_doc_id == r.doc_id for r in rows)


def test_every_window_keeps_a_suffix():
    draw = np.random.default_rng(2)
    words = draw.integers(0, 40, 700).astype(np.uint64)
    grams, lowest, kept = suffixes.minimisers(words, 50, 26)
    chosen = set(kept.tolist())
    for start in range(len(words) - 49):
        run = grams[start : start + 26]
        assert lowest[start] == run.min()
        assert start + int(run.argmin()) in chosen
    for at in chosen:
        around = range(max(0, at - 25), min(at, len(lowest) - 1) + 1)
        assert any(lowest[s] == grams[at] for s in around)


def prose(name, words):
    return [f"{name}{i}" for i in range(words)]


def texts_of(spark, rows):
    made = [(i, " ".join(words)) for i, words in rows]
    return spark.createDataFrame(made, "doc_id long, text string").repartition(2)


def test_copies_keep_their_link_to_a_third_text(spark):
    passage = prose("p", 60)
    copy = prose("a", 40) + passage + prose("b", 40)
    rows = [(1, prose("c", 30) + passage + prose("d", 30)), (5, copy), (6, copy)]
    got = suffixes.repeated_passages(texts_of(spark, rows)).collect()
    found = sorted((r.doc_id, r.start_word, r.n_words, r.first_doc_id) for r in got)
    assert found == [(1, 30, 60, 1), (5, 0, 140, 5), (5, 40, 60, 1), (6, 0, 140, 5), (6, 40, 60, 1)]


def test_windows_over_two_neighbouring_passages_repeat_nowhere(spark):
    q, r = prose("q", 50), prose("r", 50)
    rows = [(1, q + r), (2, prose("x", 9) + q + prose("y", 9)), (3, prose("z", 5) + r)]
    got = suffixes.repeated_passages(texts_of(spark, rows)).collect()
    assert sorted((d.doc_id, d.start_word, d.n_words) for d in got) == [
        (1, 0, 50), (1, 50, 50), (2, 9, 50), (3, 5, 50)
    ]


def test_parts_name_the_smallest_holder_of_their_windows(spark):
    both = prose("w", 160)
    rows = [(1, both[:90] + prose("k", 20)), (2, prose("m", 20) + both[60:]), (9, both)]
    got = suffixes.repeated_passages(texts_of(spark, rows)).collect()
    [span] = [d for d in got if d.doc_id == 9 and d.start_word == 0]
    assert [tuple(p) for p in span.parts] == [(0, 90, 1)]
    [rest] = [d for d in got if d.doc_id == 9 and d.start_word > 0]
    assert (rest.start_word, rest.n_words, [tuple(p) for p in rest.parts]) == (60, 100, [(60, 100, 2)])
    rows = [(1, both[:90]), (2, both[41:]), (9, both)]
    [span] = [d for d in suffixes.repeated_passages(texts_of(spark, rows)).collect() if d.doc_id == 9]
    assert (span.start_word, span.n_words, span.first_doc_id) == (0, 160, 1)
    assert [tuple(p) for p in span.parts] == [(0, 90, 1), (41, 119, 2)]


def test_empty_table(nothing):
    assert suffixes.repeated_passages(nothing).count() == 0
