"""Benchmark passages inside documents: size-partitioned MinHash containment, verified exactly.

A short item inside a long document has a tiny Jaccard similarity with it, so documents are cut
into tiles as long as the items looked for.  Items are partitioned by size (powers of two of
shingles) and each partition has tiles of its own length; within one the similarity of an item
and the tiles that hold it is high wherever it lies.  A tile is a candidate when it shares the
minimum of any one of ``PERMUTATIONS`` hash orders with an item, and a candidate document is kept
when it really contains enough of the item's distinct word shingles.

With one hash per band the chance to miss an item is (1 - p) ** PERMUTATIONS, where p is the
chance that an item's minimum is also that of a tile.  A tile of t shingles that holds m of an
item's n has it at m / (t + n - m) or more, and t is below 2 n; so p is at least 0.8 / 3 for an
item contained at 0.8, however the tiles share it out, and the chance is below 1e-8.  Items of at
most ``SHORT_ITEM`` distinct shingles do without: each of their shingles is looked up, and none
is missed.

Items are a stated query set: they are read in blocks of bounded size, one pass over the
documents for each, and a block's index is all that is sent to the tasks.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.llm.common import WordHashes, prepare, raw_texts, text_groups, window_hashes

WIDTH = 5
CONTAINMENT = 0.8
PERMUTATIONS = 64
SHORT_ITEM = 8
BLOCK_ITEMS = 4096
BLOCK_BYTES = 16 << 20
_PIECE = 1 << 16

_ORDERS = np.random.default_rng(20_24).integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class _Partition:
    """Items of one size: for each hash order the sorted minima and who has them.

    Short items have tiles of one shingle, one order and all shingles as minima.
    """

    tile: int
    orders: np.ndarray
    minima: list[np.ndarray] = field(default_factory=list)
    owners: list[dict[int, list[int]]] = field(default_factory=list)


class ItemIndex:
    """Signatures and shingles of one block of items."""

    def __init__(self, items: list[tuple[int, bytes]], width: int) -> None:
        self.width = width
        hashes = WordHashes()
        self.names: list[int] = []
        self.shingles: list[frozenset[bytes]] = []
        groups: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for name, text in items:
            words = text.lower().split()
            held = shingles_of(words, width)
            if not held:
                continue
            values = window_hashes(np.array([hashes[w] for w in words], np.uint64), width)
            values = np.unique(values)
            short = len(values) <= SHORT_ITEM
            tile = 1 if short else 1 << (len(values) - 1).bit_length()
            groups[tile].append((len(self.names), values))
            self.names.append(name)
            self.shingles.append(held)
        self.partitions = [self._partition(tile, group) for tile, group in sorted(groups.items())]

    @staticmethod
    def _partition(tile: int, group: list[tuple[int, np.ndarray]]) -> _Partition:
        found = _Partition(tile, _ORDERS if tile > 1 else _ORDERS[:1])
        for order in found.orders:
            owners: dict[int, list[int]] = defaultdict(list)
            for at, values in group:
                ordered = values * order
                for value in [ordered.min()] if tile > 1 else ordered:
                    owners[int(value)].append(at)
            found.minima.append(np.array(sorted(owners), np.uint64))
            found.owners.append(dict(owners))
        return found

    def candidates(self, shingles: list[np.ndarray]) -> set[tuple[int, int]]:
        """(document, item) positions that share a minimum in some tile and order."""
        held = [(i, s) for i, s in enumerate(shingles) if len(s)]
        found: set[tuple[int, int]] = set()
        if not held:
            return found
        values = np.concatenate([s for _, s in held])
        begins = np.cumsum([0, *[len(s) for _, s in held]])
        for part in self.partitions:
            starts = np.concatenate(
                [np.arange(a, b, part.tile) for a, b in zip(begins, begins[1:], strict=False)]
            )
            per_piece = max(1, _PIECE // part.tile)
            for first in range(0, len(starts), per_piece):
                mine = starts[first : first + per_piece]
                last = first + per_piece
                end = starts[last] if last < len(starts) else len(values)
                piece, cuts = values[mine[0] : end], mine - mine[0]
                for order, minima, owners in zip(
                    part.orders, part.minima, part.owners, strict=True
                ):
                    lowest = np.minimum.reduceat(piece * order, cuts)
                    near = np.searchsorted(minima, lowest)
                    near[near == len(minima)] = 0
                    for hit in np.flatnonzero(minima[near] == lowest):
                        where = int(np.searchsorted(begins, mine[hit], side="right")) - 1
                        document = held[where][0]
                        found.update((document, at) for at in owners[int(lowest[hit])])
        return found

    def contained(self, texts: list[bytes], threshold: float, hashes: WordHashes):
        """(document position, item name, shingles shared, shingles of the item), exact."""
        before = 0
        for group in text_groups(texts):
            for document, *found in self._contained(group, threshold, hashes):
                yield before + document, *found
            before += len(group)

    def _contained(self, texts: list[bytes], threshold: float, hashes: WordHashes):
        words = [t.lower().split() for t in texts]
        shingles = [
            window_hashes(np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)), self.width)
            for w in words
        ]
        held: dict[int, frozenset[bytes]] = {}
        for document, at in sorted(self.candidates(shingles)):
            if document not in held:
                held = {document: shingles_of(words[document], self.width)}
            wanted = self.shingles[at]
            shared = len(wanted & held[document])
            if shared >= threshold * len(wanted):
                yield document, self.names[at], shared, len(wanted)


def shingles_of(words: list[bytes], width: int) -> frozenset[bytes]:
    return frozenset(map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False)))


def _blocks(items: DataFrame, id_column: str, text_column: str) -> Iterator[DataFrame]:
    rows = items.select(
        F.col(id_column).cast("long").alias("id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    count, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(1, math.ceil(count / BLOCK_ITEMS), math.ceil((size or 0) / BLOCK_BYTES))
    for block in range(blocks):
        yield rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)


def _indexes(items: DataFrame, id_column: str, text_column: str, width: int):
    """Broadcast index of each block; a block has a bounded number of items and bytes."""
    spark = prepare(items.sparkSession)
    for block in _blocks(items, id_column, text_column):
        read = [(row.id, row.text.encode()) for row in block.collect()]
        yield spark.sparkContext.broadcast(ItemIndex(read, width))


def find_contained(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    threshold: float = CONTAINMENT,
) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles): items contained in a document at ``threshold``.

    Words are compared with A-Z in lower case.  An item of fewer than ``width`` words, a null or
    an empty text has no shingle and is neither found nor contains anything.  Repeated documents
    and items give a row each; a null id stays null.  Other columns are not read.  Empty tables
    give no rows.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    passes = []
    for index in _indexes(items, item_column, item_text, width):

        def find(batches, index=index):
            hashes = WordHashes()
            for batch in batches:
                hits = list(index.value.contained(raw_texts(batch.column(1)), threshold, hashes))
                at, names, shared, total = zip(*hits, strict=True) if hits else ((),) * 4
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(at, pa.int64())),
                        pa.array(names, pa.int64()),
                        pa.array(shared, pa.int64()),
                        pa.array(total, pa.int64()),
                    ],
                    ["doc_id", "item_id", "shared", "item_shingles"],
                )

        passes.append(
            rows.mapInArrow(find, "doc_id long, item_id long, shared long, item_shingles long")
        )
    return reduce(DataFrame.union, passes)


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    *,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    threshold: float = CONTAINMENT,
) -> DataFrame:
    """The documents that contain no item, whole rows, without moving any."""
    at = docs.columns.index(text_column)
    clean = docs
    for index in _indexes(items, item_column, item_text, width):

        def keep(batches, index=index):
            hashes = WordHashes()
            for batch in batches:
                texts = raw_texts(batch.column(at))
                stays = np.ones(len(texts), bool)
                for document, *_ in index.value.contained(texts, threshold, hashes):
                    stays[document] = False
                yield batch.filter(pa.array(stays))

        clean = clean.mapInArrow(keep, docs.schema)
    return clean
