import hashlib
import random
import zlib

import pytest

from knownat.llm import prefixes

SCHEMA = (
    "conv_id long, turn long, role string, text string, base long, digest long, chars long, "
    "path int, key string, shard int, h int"
)
EXTRA = (1, 2, 3, 4, "k", 5, 6)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)


def rebuilt(rows):
    """Paths of (role, text) by conversation, straight from the contract."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    paths = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c, path in paths.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        made[c] = paths.get(base, [])[:h] + path[h:]
    return made


def told(paths):
    """Nodes by grouping every prefix of every path; (id, path) rows."""
    members, ends = {}, {}
    for conv, path in paths:
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(conv)
        ends.setdefault(tuple(path), []).append(conv)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = sum(saved[k] for k in below)
        if node:
            saved[node] += (len(members[node]) - 1) * len(node[-1][-1])
    return sorted(
        (
            min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]),
            len(kids.get(n, [])), leaves[n], saved[n],
            hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest(),
        )
        for n in members
    )


def got(frame):
    return sorted(map(tuple, frame.collect()))


def odd_turns():
    draw = random.Random(3)
    rows = []
    for c in [*range(0, 230), 1000, 1001, 1099, 2005, -3, -100, -150]:
        for t in range(draw.randint(1, 7)):
            rows.append((c, t, draw.choice(("user", "assistant", None)), draw.choice(("a", "bé", "", "ccc"))))
    rows += [(300, None, "user", "x"), (300, None, "user", "a"), (300, 1, None, None), (300, 1, None, None)]
    rows += [(301, 5, "", "userx"), (302, 5, "user", "x"), (None, 1, "user", "x"), (None, None, None, None)]
    rows += [(303, t, "user", "long " * 4000) for t in range(3)] + [(303, 9, None, "日本語" * 3000)]
    return rows


@pytest.mark.parametrize(("shard_turns", "piece"), [(1 << 15, 4096), (12, 2), (1, 1)])
def test_rebuilt_conversations(spark, shard_turns, piece):
    rows = odd_turns()
    made = prefixes.prefix_trie(
        prefixes.rebuilt_paths(frame(spark, rows)), shard_turns=shard_turns, piece=piece
    )
    assert got(made) == told(rebuilt(rows).items())


def test_many_copies_of_one_conversation(spark):
    """One path holds most conversations and spans many shards, the empty one others."""
    draw = random.Random(8)
    deep = [("u", "t" * (i % 5)) for i in range(40)]
    paths = [(i, deep[: draw.choice((40, 40, 40, 39, 7, 0))]) for i in range(400)]
    paths += [(1000 + i, deep[:i] + [("u", f"own {i}")]) for i in range(40)]

    def digest(turn):
        return bytearray(hashlib.sha256(repr(turn).encode()).digest())

    source = spark.createDataFrame(
        [(c, [digest(t) for t in p], [len(t[1]) for t in p]) for c, p in paths],
        "conv_id long, path array<binary>, chars array<long>",
    )
    for turns in (1 << 15, 50):
        assert got(prefixes.prefix_trie(source, shard_turns=turns, piece=3)) == told(paths)


def test_no_conversations(spark):
    assert got(prefixes.prefix_trie(prefixes.rebuilt_paths(frame(spark, [])))) == []


def test_tree_is_balanced():
    tree = prefixes.TernaryTree()
    tree.insert_sorted([[n] for n in range(1023)])

    def height(at):
        return 1 + max(height(n) if n else 0 for n in (tree.low[at], tree.high[at]))

    assert height(tree.below[0]) == 10
    assert len(tree.traversal()) == 1024
