"""Prefix trie of conversations: who shares which first turns, and what sharing saves.

Conversations become paths of turn digests, sorted and range partitioned by (path, id).  A task
reads its range as runs of bounded length; in each run (a shard of the trie) turns are encoded by
a dictionary into small integers and the distinct paths go into a ternary search tree, medians
first, so that the siblings of every node form a balanced search tree.  One iterative traversal
accumulates members, leaves and savings from the bottom.

A node can occur in several shards only if it lies on the first or last path of a shard.  These
boundary nodes leave their shard as partial sums without their boundary children; they are merged
by the digest of their path, and sums over the boundary tree are found by pointer doubling, in
logarithmically many rounds.  All other nodes are final in their shard.

A conversation is the unit: one task holds its turns as 32-byte digests (not its texts).  The
members that end at a node may be any share of all conversations; they stay in sorted pieces, and
their digest, which by definition reads them in sequence, streams over the pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.llm.common import narrow_batches, settled, written

#: Turns (and conversations) of one shard; a longer conversation is a shard of its own.
SHARD_TURNS = 1 << 15
#: Ids in one piece of the members that end at a boundary node.
PIECE = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()
_INTERIOR, _BOUNDARY, _ENDS = 0, 1, 2
_ROWS = (
    "kind int, shard long, key binary, parent_key binary, conv_id long, depth long, "
    "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "chars long, ends_sha256 string, piece int, ids array<long>"
)
_SCHEMA = pa.schema(
    [("kind", pa.int32()), ("shard", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary())]
    + [
        (name, pa.int64())
        for name in (
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
            "saved_tokens", "chars",
        )
    ]
    + [("ends_sha256", pa.string()), ("piece", pa.int32()), ("ids", pa.list_(pa.int64()))]
)


class TernaryTree:
    """Sequences of integers; each node has smaller and larger siblings and first children."""

    def __init__(self) -> None:
        self.code, self.low, self.high, self.below = [-1], [0], [0], [0]
        self.parent, self.depth = [-1], [0]

    def _add(self, code: int, parent: int) -> int:
        self.code.append(code)
        for links in (self.low, self.high, self.below):
            links.append(0)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        return len(self.code) - 1

    def insert(self, codes: list[int]) -> int:
        """Node of the whole sequence, made where it is missing."""
        at = 0
        for code in codes:
            links, place = self.below, at
            while (found := links[place]) and self.code[found] != code:
                links, place = (self.low if code < self.code[found] else self.high), found
            if not found:
                found = links[place] = self._add(code, at)
            at = found
        return at

    def insert_sorted(self, sequences: list[list[int]]) -> list[int]:
        """Insert distinct sorted sequences, the median of each range first."""
        ends, waiting = [0] * len(sequences), [(0, len(sequences))]
        while waiting:
            start, stop = waiting.pop()
            if start < stop:
                middle = (start + stop) // 2
                ends[middle] = self.insert(sequences[middle])
                waiting += [(start, middle), (middle + 1, stop)]
        return ends

    def traversal(self) -> list[int]:
        """All nodes, each before its children."""
        found, waiting = [], [0]
        while waiting:
            at = waiting.pop()
            found.append(at)
            waiting += [n for n in (self.low[at], self.high[at], self.below[at]) if n]
        return found


def _ids_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def shard_rows(
    run: list[tuple[int, list[bytes], list[int]]], shard: int, most_ids: int = PIECE
) -> list[dict]:
    """Rows of one shard: (id, path of digests, code points by turn) sorted by (path, id)."""
    turns = sorted({digest for _, path, _ in run for digest in path})
    codes = {digest: n for n, digest in enumerate(turns)}
    lengths = [0] * len(turns)
    sequences: list[list[int]] = []
    members: list[list[int]] = []
    for conv_id, path, chars in run:
        sequence = [codes[digest] for digest in path]
        for code, count in zip(sequence, chars, strict=True):
            lengths[code] = count
        if not sequences or sequences[-1] != sequence:
            sequences.append(sequence)
            members.append([])
        members[-1].append(conv_id)
    tree = TernaryTree()
    ends = dict(zip(tree.insert_sorted(sequences), members, strict=True))
    keys: dict[int, bytes] = {}  # nodes that other shards may hold too
    for end in (0, tree.insert(sequences[0]), tree.insert(sequences[-1])):
        path = []
        while end > 0 and end not in keys:
            path.append(end)
            end = tree.parent[end]
        keys.setdefault(0, b"")
        for at in reversed(path):
            keys[at] = hashlib.blake2b(
                keys[tree.parent[at]] + turns[tree.code[at]], digest_size=16
            ).digest()
    size = len(tree.code)
    first: list[int | None] = [None] * size
    count, children, leaves, saved = ([0] * size for _ in range(4))
    order = tree.traversal()
    for at in reversed(order):
        own = ends.get(at)
        if own:
            count[at] += len(own)
            least = min((i for i in own if i is not None), default=None)
            if first[at] is None or (least is not None and least < first[at]):
                first[at] = least
        above = tree.parent[at]
        if above < 0:
            continue
        count[above] += count[at]
        if first[at] is not None and (first[above] is None or first[at] < first[above]):
            first[above] = first[at]
        if at not in keys:
            leaves[at] = leaves[at] or 1
            saved[at] += (count[at] - 1) * lengths[tree.code[at]]
            children[above] += 1
            leaves[above] += leaves[at]
            saved[above] += saved[at]
    rows = []
    for at in order:
        above, own = tree.parent[at], ends.get(at, [])
        boundary = at in keys
        rows.append({
            "kind": _BOUNDARY if boundary else _INTERIOR, "shard": shard, "key": keys.get(at),
            "parent_key": keys.get(above), "conv_id": first[at], "depth": tree.depth[at],
            "parent_conv_id": first[above] if above >= 0 and above not in keys else None,
            "n_convs": count[at], "n_children": children[at], "n_leaves": leaves[at],
            "saved_tokens": saved[at], "chars": lengths[tree.code[at]] if at else 0,
            "ends_sha256": None if boundary else _ids_digest(own), "piece": None, "ids": None,
        })
        for start in range(0, len(own) if boundary else 0, most_ids):
            rows.append(dict.fromkeys(_SCHEMA.names) | {
                "kind": _ENDS, "shard": shard, "key": keys[at], "piece": start // most_ids,
                "ids": own[start : start + most_ids],
            })
    return rows


def _shards(most_turns: int, most_ids: int):
    """Cut a sorted partition into shards of bounded length and give the rows of each."""

    def run_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, made = [], 0, 0
        base = TaskContext.get().partitionId() << 32

        def closed() -> Iterator[pa.RecordBatch]:
            rows = shard_rows(run, base | made, most_ids)
            yield from pa.Table.from_pylist(rows, _SCHEMA).to_batches(1 << 13)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                weight = len(row[1]) + 1
                if run and held + weight > most_turns:
                    yield from closed()
                    run, held, made = [], 0, made + 1
                run.append(row)
                held += weight
        if run:
            yield from closed()

    return run_of


def _streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's ids over its sorted pieces, which are never held together."""
    key, digest = None, None
    for batch in batches:
        done = []
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = ",".join(map(str, ids)).encode()
            if own == key:
                digest.update(b"," + text)
            else:
                if digest:
                    done.append((key, digest.hexdigest()))
                key, digest = own, hashlib.sha256(text)
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done, strict=True)], ["key", "sha"])
    if digest:
        yield pa.record_batch([pa.array([key]), pa.array([digest.hexdigest()])], ["key", "sha"])


def _subtree_sums(nodes: DataFrame, deepest: int) -> DataFrame:
    """``leaves`` and ``saved`` of (key, up) added over all descendants.

    After round i a node has the sums of all within a distance below 2^i and points to its
    ancestor at 2^i; that ancestor's next sums take them over whole.
    """
    state, reach = nodes, 1
    while reach <= deepest:
        linked = state.where("up IS NOT NULL")
        added = linked.groupBy(F.col("up").alias("key")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        above = state.where("up IS NOT NULL").select(F.col("key").alias("up"), F.col("up").alias("next"))
        further = linked.join(above, "up").select("key", "next")
        state = settled(
            state.join(added, "key", "left").join(further, "key", "left").select(
                "key",
                F.col("next").alias("up"),
                (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            )
        )
        reach *= 2
    return state.select("key", "leaves", "saved")


def prefix_trie(
    paths: DataFrame, *, shard_turns: int = SHARD_TURNS, piece: int = PIECE
) -> DataFrame:
    """One row per node of the trie of (conv_id long, path array<binary>, chars array<long>).

    ``conv_id`` is the node's smallest member and ``parent_conv_id`` its parent's (root: null);
    ``n_convs`` counts members, ``n_children`` children, ``n_leaves`` childless nodes at or below;
    ``saved_tokens`` adds (members - 1) times the code points of the last turn over the subtree;
    ``ends_sha256`` digests the ids that end here, in order.  Equal paths (ties) are members of
    the same nodes; each row counts, repeated or not.  Empty paths are members of the root alone.
    No rows give no nodes.
    """
    narrow_batches(paths.sparkSession)
    kept = written(paths.select("conv_id", "path", "chars"), "paths")
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("path"), F.col("conv_id")]
    ranged = kept.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    made = written(ranged.mapInArrow(_shards(shard_turns, piece), _ROWS), "trie")

    partial = made.where(F.col("kind") == _BOUNDARY)
    merged = settled(
        partial.groupBy("key").agg(
            F.first("parent_key").alias("up"),
            F.first("depth").alias("depth"),
            F.max("chars").alias("chars"),
            F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        )
    )
    kin = merged.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(
        F.count("*").alias("kin")
    )
    counted = settled(
        merged.join(kin, "key", "left").withColumn(
            "n_children", F.col("n_children") + F.coalesce("kin", F.lit(0))
        )
    )
    deepest = counted.agg(F.max("depth")).first()[0] or 0
    sums = _subtree_sums(
        counted.select(
            "key", "up",
            (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("leaves"),
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        ),
        deepest,
    )
    digests = (
        made.where(F.col("kind") == _ENDS)
        .select("key", "ids", "shard", "piece")
        .repartition("key")
        .sortWithinPartitions("key", "shard", "piece")
        .mapInArrow(_streamed_digests, "key binary, sha string")
    )
    names = counted.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    outer = (
        counted.join(sums, "key")
        .join(digests, "key", "left")
        .join(names, "up", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
            F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
            F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
    )
    inner = made.where(F.col("kind") == _INTERIOR)
    columns = outer.columns
    by_shard = partial.select("shard", "key").join(
        names.withColumnRenamed("up", "key"), "key"
    ).select("shard", F.col("key").alias("parent_key"), F.col("parent_conv_id").alias("named"))
    hung = inner.where("parent_key IS NOT NULL").join(by_shard, ["shard", "parent_key"])
    return (
        inner.where("parent_key IS NULL").select(*columns)
        .union(hung.withColumn("parent_conv_id", F.col("named")).select(*columns))
        .union(outer)
    )


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, chars): the digest stands for (role, text), null being empty."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    marked = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(marked, 256)).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )


def rebuilt_paths(conversations: DataFrame, *, block: int = 100, longest: int = 5) -> DataFrame:
    """(conv_id, path, chars): the first h turns of the block's first conversation, then the own
    turns after the first h; h is crc32 of the decimal id modulo ``longest`` + 1.

    Turns are ordered by ``turn`` (null first), ties by the digest of role and text; repeated
    turns all stay.  Null roles and texts are empty.  Rows without a conv_id belong to no
    conversation and are left out.  A block holds fewer than 2 * ``block`` conversations.
    """
    base = F.col("conv_id") - F.col("conv_id") % block
    turns = turn_rows(conversations).where("conv_id IS NOT NULL").withColumn("base", base)
    own = turns.repartition("base").groupBy("base", "conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "digest", "chars"))).alias("turns")
    )
    heads = own.where("conv_id = base").select("base", F.slice("turns", 1, longest).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (longest + 1)).cast("int")
    none = F.slice("turns", 1, 0)
    rest = F.greatest(F.size("turns") - F.col("h"), F.lit(0))
    rebuilt = own.join(heads, "base", "left").withColumn("h", h).select(
        "conv_id",
        F.concat(
            F.coalesce(F.slice("head", F.lit(1), F.col("h")), none),
            F.slice("turns", F.col("h") + 1, rest),
        ).alias("turns"),
    )
    return rebuilt.select(
        "conv_id",
        F.transform("turns", lambda t: t.digest).alias("path"),
        F.transform("turns", lambda t: t.chars).alias("chars"),
    )


#: crc32 runs over the digits of an id, eight shifts a digit, as lists of integers.
SQL = """
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
           sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '')
                  || coalesce(text, '')) AS digest
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, list({'digest': digest, 'chars': length(text)}
                         ORDER BY turn NULLS FIRST, digest) AS turns
    FROM turns GROUP BY conv_id
), heads AS (
    SELECT conv_id, turns,
           xor(4294967295, list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(
                   string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
               lambda crc, byte: list_reduce(
                   list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                   lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) % 6 AS h
    FROM own
), rebuilt AS (
    SELECT o.conv_id,
           list_concat(CASE WHEN b.turns IS NULL OR o.h = 0 THEN [] ELSE b.turns[1:o.h] END,
                       o.turns[o.h + 1:]) AS path
    FROM heads o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), steps AS (
    SELECT conv_id, d, CASE WHEN d = 0 THEN [] ELSE path[1:d] END AS node
    FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
           (count(*) - 1) * coalesce(node[d].chars, 0) AS saved,
           CASE WHEN d > 1 THEN node[1:d - 1] WHEN d = 1 THEN [] END AS above
    FROM steps GROUP BY node, d
), kin AS (
    SELECT above AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY above
), sums AS (
    SELECT node, sum(saved) AS saved, sum(leaf) AS leaves
    FROM (
        SELECT CASE WHEN k = 0 THEN [] ELSE node[1:k] END AS node, saved, leaf
        FROM (
            SELECT n.node, n.saved, (k.node IS NULL)::INT AS leaf, unnest(range(0, n.d + 1)) AS k
            FROM nodes n LEFT JOIN kin k ON k.node = n.node
        )
    ) GROUP BY node
), ends AS (
    SELECT path AS node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha
    FROM rebuilt GROUP BY path
)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       coalesce(k.n_children, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM nodes n
JOIN sums s ON s.node = n.node
LEFT JOIN kin k ON k.node = n.node
LEFT JOIN ends e ON e.node = n.node
LEFT JOIN nodes p ON p.node = n.above
"""
