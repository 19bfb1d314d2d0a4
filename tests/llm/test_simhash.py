import random

import pytest
import xxhash

from knownat.llm import simhash
from knownat.llm.common import linked_components


def told(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    width = min(3, len(words))
    hashes = [
        xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42)
        for i in range(len(words) - width + 1)
    ]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, radius=3):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    values = sorted(root)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def check(docs, rows):
    prints = [told(text) for _, text in docs]
    root = groups(set(prints))
    first = {}
    for (doc, _), value in zip(docs, prints, strict=True):
        if doc is not None:
            first[root[value]] = min(first.get(root[value], doc), doc)
    wanted = [
        (doc, value, first.get(root[value])) for (doc, _), value in zip(docs, prints, strict=True)
    ]
    got = [(r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in rows]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_odd_rows(odd):
    check([(r.doc_id, r.text) for r in odd.collect()], simhash.near_duplicates(odd).collect())


def test_corpus(corpus, corpus_frame):
    check(corpus, simhash.near_duplicates(corpus_frame).collect())


@pytest.mark.parametrize("limit", [1 << 14, 8])
def test_links_connect_what_the_radius_connects(spark, limit):
    draw = random.Random(5)
    centres = [draw.getrandbits(64) for _ in range(12)]
    values = {0, (1 << 64) - 1, *centres}
    for centre in centres:
        for _ in range(40):
            value = centre
            for bit in draw.sample(range(64), draw.randint(1, 6)):
                value ^= 1 << bit
            values.add(value)
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "fingerprint long")
    links = simhash.near_links(frame.repartition(3), shard_limit=limit)
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    parents = {r.node: r.root for r in linked_components(links).collect()}
    wanted = groups(values)
    found = {}
    for v in values:
        found.setdefault(parents.get(simhash._signed(v), simhash._signed(v)), set()).add(v)
    told_groups = {}
    for v, r in wanted.items():
        told_groups.setdefault(r, set()).add(v)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, told_groups.values()))


def test_every_three_bit_change_shares_a_shard():
    masks = [m for _, _, m in simhash.shard_levels(5, 2)[0]]
    draw = random.Random(1)
    for _ in range(500):
        change = sum(1 << b for b in draw.sample(range(64), 3))
        assert any(change & m == 0 for m in masks)


def test_last_level_is_bounded():
    assert all(64 - m.bit_count() <= 15 for _, _, m in simhash.shard_levels(5, 2)[-1])


def test_long_chains_are_one_component(spark):
    rows = [(i, i + 1) for i in range(300)] + [(500, 501), (7, 7)]
    found = linked_components(spark.createDataFrame(rows, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {i: 0 for i in range(301)} | {500: 500, 501: 500}


def test_one_of_each_group_stays(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    root = groups({told(t) for _, t in rows})
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    got = kept.collect()
    assert len(got) == len({root[told(t)] for _, t in rows})
    for r in got:
        same = [d for d, t in rows if root[told(t)] == root[told(r.text)] and d is not None]
        assert r.doc_id == (min(same) if same else None)


def test_empty_table(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.drop_near_duplicates(nothing).count() == 0
