"""SimHash near-duplicates, searched with trees keyed by Hamming distance.

Texts become 64-bit fingerprints; equal fingerprints are one node.  Two fingerprints that differ
in at most three of five bit groups' bits agree on some two groups whole, so each fingerprint
joins the ten shards named by two of its groups, and every link lies inside a shard.  A shard is
searched with a tree whose children hang at their distance to the parent: within a radius r of a
query only edges from d-r to d+r can lead to an answer.  Trees live in the task that owns the
shard; they are not sent to all tasks, because together they hold every fingerprint and have no
bound.  A shard of more than ``SHARD`` members is divided again by two groups of its free bits,
twice at most, after which 15 bits are free and so 2**15 members the most.  Each tree reports a
spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.llm.common import linked_components, map_batches, prepare, raw_texts, settled

RADIUS = 3
SHINGLE = 3
SEED = 42
SHARD = 1 << 14
_GROUPS, _SAME = 5, 2
_CHUNK = 1 << 15


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Majority of each bit over the hashes of all shingles; zero for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    total = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, total, _CHUNK):
        part = words[start : start + _CHUNK + width - 1]
        runs = zip(*[part[i:] for i in range(width)], strict=False)
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, runs)], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, text_key, fingerprint): one row per row; a null text counts as empty."""
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.xxhash64(text_column).alias("text_key"),
        F.col(text_column).alias("text"),
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t) for t in raw_texts(batch.column(2))], np.uint64)
        return pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(found.view(np.int64))],
            ["doc_id", "text_key", "fingerprint"],
        )

    return map_batches(rows, run, "doc_id long, text_key long, fingerprint long")


class BkTree:
    """Integers under Hamming distance; children are keyed by their distance to the parent."""

    def __init__(self, radius: int) -> None:
        self.radius = radius
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def insert(self, value: int) -> list[int]:
        """Add a value; return the positions already held within the radius of it."""
        near: list[int] = []
        values, edges, radius = self.values, self.edges, self.radius
        if values:
            waiting = [0]
            while waiting:
                at = waiting.pop()
                away = (values[at] ^ value).bit_count()
                if away <= radius:
                    near.append(at)
                below = edges[at]
                for edge in range(max(0, away - radius), away + radius + 1):
                    if edge in below:
                        waiting.append(below[edge])
            at = 0
            while True:
                away = (values[at] ^ value).bit_count()
                following = edges[at].get(away)
                if following is None:
                    edges[at][away] = len(values)
                    break
                at = following
        values.append(value)
        edges.append({})
        return near


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect exactly the values linked within the radius, directly or by others."""
    tree = BkTree(radius)
    roots = list(range(len(values)))
    found = []
    for position, value in enumerate(values):
        for near in tree.insert(value):
            a, b = position, near
            while roots[a] != a:
                roots[a] = a = roots[roots[a]]
            while roots[b] != b:
                roots[b] = b = roots[roots[b]]
            if a != b:
                roots[max(a, b)] = min(a, b)
                found.append((values[near], value))
    return found


def _masks(free: list[int], groups: int, same: int) -> list[int]:
    """Masks of ``same`` out of ``groups`` even parts of the free bits."""
    bounds = [len(free) * i // groups for i in range(groups + 1)]
    parts = [sum(1 << b for b in free[lo:hi]) for lo, hi in zip(bounds, bounds[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, same)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def shard_levels(groups: int, same: int, levels: int = 3) -> list[list[tuple[int, int, int]]]:
    """Per level rows of (parent shard, shard, mask of the bits that the shard fixes)."""
    found, held = [], [(0, 0)]
    for _ in range(levels):
        rows = []
        for parent, fixed in held:
            free = [b for b in range(64) if not fixed >> b & 1]
            for mask in _masks(free, groups, same):
                rows.append((parent, len(rows), fixed | mask))
        found.append(rows)
        held = [(shard, mask) for _, shard, mask in rows]
    return found


def near_links(nodes: DataFrame, radius: int = RADIUS, shard_limit: int = SHARD) -> DataFrame:
    """(a, b): links among distinct ``fingerprint`` values that connect each linked group."""
    spark = nodes.sparkSession
    same = _GROUPS - radius
    if not 0 < same < _GROUPS:
        raise ValueError(f"radius must lie between 1 and {_GROUPS - 1}")
    levels = shard_levels(_GROUPS, same)
    members = nodes.select(F.lit(0).alias("shard"), F.lit(0).cast("long").alias("bits"), "fingerprint")
    trees = []
    for depth, rows in enumerate(levels):
        fixed = spark.createDataFrame(
            [(p, s, _signed(m)) for p, s, m in rows], "shard int, child int, mask long"
        )
        members = members.join(F.broadcast(fixed), "shard").select(  # at most 1000 fixed rows
            F.col("child").alias("shard"),
            F.col("fingerprint").bitwiseAND(F.col("mask")).alias("bits"),
            "fingerprint",
        )
        if depth == len(levels) - 1:
            trees.append(members)
            break
        crowded = settled(
            members.groupBy("shard", "bits").count().where(F.col("count") > shard_limit)
            .select("shard", "bits")
        )
        if crowded.isEmpty():
            trees.append(members)
            break
        trees.append(members.join(crowded, ["shard", "bits"], "left_anti"))
        members = members.join(crowded, ["shard", "bits"], "left_semi")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in chain(_shards(batches), [None]):
            pairs = []
            if batch is None:
                pairs += forest(held, radius) if len(held) > 1 else []
            else:
                keys, ends, values = batch
                start = 0
                for shard, end in zip(keys, ends, strict=True):
                    if shard != key:
                        pairs += forest(held, radius) if len(held) > 1 else []
                        key, held = shard, []
                    held += values[start:end]
                    start = end
            if pairs:
                ends = np.array(pairs, np.uint64).view(np.int64)
                yield pa.record_batch([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    found = None
    for level in trees:
        sorted_shards = level.repartition("shard", "bits").sortWithinPartitions("shard", "bits")
        links = sorted_shards.mapInArrow(search, "a long, b long")
        found = links if found is None else found.union(links)
    return found


def _shards(batches: Iterator[pa.RecordBatch]):
    """Per batch of sorted rows: keys of its runs, their ends and all values."""
    for batch in batches:
        shard, bits, values = (batch.column(i).to_numpy() for i in range(3))
        if not len(values):
            continue
        new = np.flatnonzero((shard[1:] != shard[:-1]) | (bits[1:] != bits[:-1])) + 1
        starts = np.concatenate([[0], new])
        keys = list(zip(shard[starts].tolist(), bits[starts].tolist(), strict=True))
        yield keys, [*new.tolist(), len(values)], values.view(np.uint64).tolist()


def near_duplicates(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
    radius: int = RADIUS,
) -> DataFrame:
    """(doc_id, text_key, fingerprint, component_id, root), one row per row of ``docs``.

    ``component_id`` is the smallest id reached over links of at most ``radius`` differing bits.
    Texts without words have fingerprint zero and are linked like others.  Repeated rows and
    equal texts share a fingerprint.  A row without an id belongs to its component like any
    other but never names it; a component of such rows only has a null id.  An empty table
    gives no rows; other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = settled(fingerprints(docs, id_column=id_column, text_column=text_column))
    nodes = settled(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    parents = linked_components(near_links(nodes, radius))
    rooted = nodes.join(
        parents.withColumnRenamed("node", "fingerprint"), "fingerprint", "left"
    ).select("fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(names, "root").select("fingerprint", "component_id", "root")
    return rows.join(named, "fingerprint").select(
        "doc_id", "text_key", "fingerprint", "component_id", "root"
    )


def drop_near_duplicates(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
    radius: int = RADIUS,
) -> DataFrame:
    """One document of each component stays: the smallest id, then the smallest text key."""
    found = near_duplicates(docs, id_column=id_column, text_column=text_column, radius=radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key"))
    stays = settled(
        found.groupBy("root")
        .agg(first.alias("kept"))
        .select(F.col("kept.doc_id").alias("__id"), F.col("kept.text_key").alias("__key"))
        .distinct()
    )
    keyed = docs.withColumn("__text_key", F.xxhash64(text_column))
    same = (F.col("__text_key") == F.col("__key")) & F.col(id_column).cast("long").eqNullSafe(
        F.col("__id")
    )
    left = keyed.join(stays, same, "left_semi").dropDuplicates([id_column, "__text_key"])
    return left.select(*docs.columns)
