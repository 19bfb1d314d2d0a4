import random

import numpy as np
import pytest

from knownat.llm import partenum


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def told(docs):
    """Components over all pairs; (doc_id, n_shingles, component_id)."""
    sets = [shingles(text) for _, text in docs]
    root = list(range(len(docs)))

    def find(v):
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                shared = len(a & b)
                if 100 * shared >= 80 * (len(a) + len(b) - shared):
                    root[max(find(i), find(j))] = min(find(i), find(j))
    first = {}
    for n, (doc, _) in enumerate(docs):
        if doc is not None:
            first[find(n)] = min(first.get(find(n), doc), doc)
    return [
        (doc, len(own), first.get(find(n)) if own else doc)
        for n, ((doc, _), own) in enumerate(zip(docs, sets))
    ]


def check(docs, frame, **options):
    got = partenum.similar_groups(frame, **options).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(told(docs), key=repr)


def edited(text, share, seed):
    draw = random.Random(seed)
    words = text.split()
    for _ in range(max(1, int(share * len(words)))):
        at = draw.randrange(len(words))
        words[at : at + draw.choice((0, 1))] = [f"w{draw.randrange(10**6)}"]
    return " ".join(words)


@pytest.fixture(scope="module")
def families():
    """Chains of near copies, unrelated texts that share a passage, short texts and copies."""
    draw = random.Random(4)
    vocabulary = ["".join(draw.choices("abcdeilmnorst", k=draw.randint(2, 6))) for _ in range(400)]

    def plain(words):
        return " ".join(draw.choices(vocabulary, k=words))

    texts, passage = [], plain(60)
    for family in range(12):
        text = plain(draw.choice((6, 9, 14, 40, 90, 300)))
        for n in range(10):
            texts.append(text)
            text = edited(text, draw.choice((0.005, 0.01, 0.02, 0.03)), family * 100 + n)
        texts += [text] * 3
    texts += [plain(20) + " " + passage + " " + plain(draw.choice((5, 20, 60))) for _ in range(60)]
    texts += [" ".join(draw.choices("ab", k=draw.randint(1, 9))) for _ in range(60)]
    draw.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("bucket", "together"), [(64, 4096), (2, 4096), (2, 5)])
def test_families(spark, families, bucket, together):
    frame = spark.createDataFrame(families, "doc_id long, text string").repartition(4)
    check(families, frame, bucket=bucket, together=together)


def test_odd_rows(odd):
    check([(r.doc_id, r.text) for r in odd.collect()], odd)


def test_corpus(corpus, corpus_frame):
    check(corpus, corpus_frame)


def test_empty_table(nothing):
    assert partenum.similar_groups(nothing).collect() == []


def test_similar_sets_share_a_signature():
    """Pairs at the limit, of every size, under several partitions of the domain."""
    draw = np.random.default_rng(1)
    bands = partenum.Bands(80)
    for trial in range(1500):
        size = int(draw.choice([draw.integers(1, 30), draw.integers(30, 200), draw.integers(200, 900)]))
        base = draw.integers(0, 1 << 64, size, dtype=np.uint64)
        lost = int(draw.integers(0, size // 5 + 1))
        left = np.unique(base[lost:])
        room = (100 * (size - lost) // 80) - size  # new elements that keep 80 percent
        right = np.unique(np.concatenate([base, draw.integers(0, 1 << 64, max(0, room), dtype=np.uint64)]))
        shared = len(np.intersect1d(left, right))
        if not shared or 100 * shared < 80 * (len(left) + len(right) - shared) or len(left) == len(right) == shared:
            continue
        seed = trial % 3
        mine, other = (partenum.signatures(s, bands, seed) for s in (left, right))
        assert np.isin(mine, other).any(), (len(left), len(right), shared)


def test_bands_cover_partners():
    bands = partenum.Bands(80)
    for size in range(1, 3000):
        larger = 100 * size // 80
        mine = {band for band, *_ in bands.schemes(size)}
        for other in {size, min(size + 1, larger), larger}:
            if other > size:
                assert bands.number(other) in mine


def test_pairs_of_a_large_group(spark, monkeypatch):
    """Copies about the limit share many buckets; the rows made stay near their number."""
    draw = random.Random(11)
    base = [f"w{draw.randrange(10**6)}" for _ in range(400)]
    docs = []
    for n in range(160):
        words = list(base)
        for at in draw.sample(range(400), draw.randrange(2, 30)):
            words[at] = f"x{draw.randrange(10**6)}"
        docs.append((n, " ".join(words)))
    made, whole = [], partenum._pairs_within

    def counted(*args, **options):
        pairs = whole(*args, **options)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(partenum, "_pairs_within", counted)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    check(docs, frame, bucket=8)
    assert sum(made) < 100 * len(docs), made


def test_sketch_bounds_the_difference():
    """Never above the truth, and near it, so pairs well below the limit are ruled out."""
    draw = np.random.default_rng(3)
    for size, other in [(1, 1), (5, 4), (120, 130), (250, 300), (396, 396), (3000, 2900)]:
        common = draw.integers(0, 1 << 64, min(size, other) * 4 // 5, dtype=np.uint64)
        left, right = (
            np.unique(np.concatenate([common, draw.integers(0, 1 << 64, n - len(common), dtype=np.uint64)]))
            for n in (size, other)
        )
        cells = [partenum.sketch(s) for s in (left, right)]
        folded = [partenum._folded([c], min(map(len, cells))) for c in cells]
        apart, truth = partenum._apart(*folded)[0], len(np.setxor1d(left, right))
        assert truth * 0.7 <= apart <= truth, (size, other, apart, truth)


def test_many_sets_at_once_are_as_one_by_one():
    texts = [b"", b"a", b"a b", b"a b c d", b"A b c d e", b" \t ", b"a " * 9]
    draw = random.Random(5)
    texts += [" ".join(draw.choices("abcdefghij", k=draw.randrange(200))).encode() for _ in range(60)]
    words, bands = partenum.WordHashes(), partenum.Bands(80)
    found, sizes = partenum.shingle_sets(texts, words)
    assert sizes.tolist() == [len(shingles(text.decode())) for text in texts]
    sigs, owner = partenum.many_signatures(found, sizes, bands)
    for n, (own, cells) in enumerate(zip(partenum._each(found, sizes), partenum.sketches(found, sizes))):
        alone = partenum.shingle_sets([texts[n]], words)[0]
        assert alone.tolist() == own.tolist() == sorted(set(own.tolist()))
        assert sorted(partenum.signatures(alone, bands).tolist()) == sorted(sigs[owner == n].tolist())
        assert partenum.sketch(alone) == cells


def test_no_shuffle_files_stay(spark, families):
    def shuffled():
        env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
        blocks = env.blockManager().diskBlockManager().getAllBlocks().mkString(" ").split()
        return {block for block in blocks if block.startswith("shuffle_")}

    frame = spark.createDataFrame(families, "doc_id long, text string").repartition(4)
    before = shuffled()
    partenum.similar_groups(frame)
    assert len(shuffled() - before) < 50
