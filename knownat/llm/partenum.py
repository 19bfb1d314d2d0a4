"""N-gram Jaccard join with PartEnum signatures.

A document is the set of its word shingles.  Two sets of sizes s <= t with a Jaccard similarity of
at least p percent differ in at most k = (100 - p)(s + t) / (100 + p) elements and satisfy
s >= p t / 100.  Sizes are cut into bands; the scheme of a band serves pairs whose larger set lies
in it, so a set takes part in the scheme of its own band and, if it is large enough, of the next.

A scheme partitions the feature domain by hash into n1 first-level parts of n2 second-level parts.
At most k/2 first-level parts hold two or more of the k differing elements, so in some other one
all but one of the second-level parts agree: each subset of n2 - 1 second-level parts, together
with the set's elements in them, is a signature, and similar sets share at least one.  Empty
projections would be shared by strangers.  They are left out by a set that has too few empty
parts to agree with another in these alone; a set with more of them emits them too.

Signatures are shuffled once.  A bucket of equal signatures is not expanded into pairs: each
member is first compared with the centre it meets most often, members of a large one also along a
forest of their nearest possible pairs, and links found so are merged.  Pairs that sizes and cell parities rule out are dropped before any text moves.
Buckets that still hold several groups give the pairs between different groups; in those of more
than ``BUCKET`` members a task compares cell parities first, and those of more than ``TOGETHER`` are
divided again by a new partition of the domain.  Every candidate
is verified on whole texts, so the result is exact up to collisions of 64-bit shingle hashes
within a pair of texts; sets are identified by 128 bits.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.llm.common import (
    GROUP_BYTES, WordHashes, linked_components, mixed, narrow_batches, raw_texts, settled,
    shuffles_freed, window_hashes, written,
)

SHINGLE = 5
PERCENT = 80
#: Members of a bucket that may be compared with each other, if in different groups.
BUCKET = 64
#: Divisions of a crowded bucket before its remaining pairs are compared as they are: texts that
#: nearly meet the limit share most buckets of any partition, so more divisions only repeat them.
LEVELS = 1
#: Members of a bucket that one task may compare by their cell parities.
TOGETHER = 1 << 12
#: Members that one copy of a centre's text is compared with.
PER_CENTRE = 256
#: Sets up to this size have three second-level parts, larger ones two.
_SMALL = 60
_CHUNK, _SEEN, _SETS = 1 << 12, 1 << 17, 1 << 15
#: Cells of a sketch, a power of two: at least twice the elements, within these bounds.
_FEWEST, _MOST = 1 << 8, 1 << 14


class Bands:
    """Size bands of the ratio 100 / percent and their partition schemes."""

    def __init__(self, percent: int) -> None:
        if not 0 < percent <= 100:
            raise ValueError("percent must be above 0 and at most 100")
        self.percent = percent
        self.uppers: list[int] = []

    def number(self, size: int) -> int:
        while not self.uppers or self.uppers[-1] < size:
            low = self.uppers[-1] + 1 if self.uppers else 1
            self.uppers.append(max(low, low * 100 // self.percent))
        return bisect_left(self.uppers, size)

    def schemes(self, size: int) -> Iterator[tuple[int, int, int, int]]:
        """(band, k, n1, n2) of the schemes that a set of this size takes part in."""
        own = self.number(size)
        self.number(self.uppers[own] + 1)
        for band in (own, own + 1):
            upper, lowest = self.uppers[band], self.uppers[band - 1] + 1 if band else 1
            k = (100 - self.percent) * 2 * upper // (100 + self.percent)
            if k and (band == own or size * 100 >= self.percent * lowest):
                if upper <= _SMALL:
                    yield band, k, k // 2 + 1 + (k // 2 + 1) // 5, 3
                else:
                    yield band, k, k // 2 + 1 + (k // 2 + 1) // 8, 2


def shingle_sets(
    texts: list[bytes], words_seen: dict, width: int = SHINGLE
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted within it, end to end; their numbers.

    Fewer words than the width make one shingle.
    """
    words = [text.lower().split() for text in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    known = map(words_seen.__getitem__, chain.from_iterable(words))
    hashes = np.fromiter(known, np.uint64, int(counts.sum()))
    sizes = np.where(counts < width, np.minimum(counts, 1), counts - width + 1)
    found, ends = np.empty(sizes.sum(), np.uint64), np.cumsum(sizes)
    starts, word_ends = ends - sizes, np.cumsum(counts)
    # Windows over the end of a text belong to no text.
    inside = np.ones(len(hashes), bool)
    for back in range(1, width):
        inside[word_ends[counts >= back] - back] = False
    windows = window_hashes(hashes, width)
    long = np.repeat(counts >= width, sizes)
    found[long] = windows[inside[: len(windows)]]
    for n in np.flatnonzero((counts > 0) & (counts < width)).tolist():
        own = hashes[word_ends[n] - counts[n] : word_ends[n]]
        found[starts[n]] = window_hashes(own, len(own))[0]
    for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
        found[start:end].sort()
    fresh = np.ones(len(found), bool)
    fresh[1:] = found[1:] != found[:-1]
    fresh[starts[sizes > 0]] = True
    return found[fresh], np.bincount(_owners(sizes)[fresh], minlength=len(sizes))


def _owners(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(sizes)), sizes)


def _each(shingles: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    for size in sizes.tolist():
        yield shingles[at : at + size]
        at += size


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return tuple(np.frombuffer(digest, np.int64).tolist())


def signatures(shingles: np.ndarray, bands: Bands, seed: int = 0) -> np.ndarray:
    """The set's signatures in the schemes of its size; any set of 1 ... has its own."""
    return many_signatures(shingles, np.array([len(shingles)]), bands, seed)[0]


def many_signatures(
    shingles: np.ndarray, sizes: np.ndarray, bands: Bands, seed: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets that stand end to end, and the number of the set of each."""
    if not len(shingles):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    spread = mixed(shingles ^ np.uint64(0xA0761D6478BD642F * (2 * seed + 1) % (1 << 64)))
    schemes = {n: list(bands.schemes(n)) for n in set(sizes.tolist()) if n}
    each = [schemes.get(n, []) for n in sizes.tolist()]
    owner, made, owners = _owners(sizes), [], []
    for turn in range(2):  # a set takes part in two schemes at most
        own = np.array([s[turn] if len(s) > turn else (0, 0, 0, 0) for s in each], np.int64)
        for n2 in (2, 3):
            band, k, n1 = np.where(own[:, 3] == n2, own[:, :3].T, 0)
            parts, some = n1 * n2, (n1 > 0)[owner]
            if not some.any():
                continue
            sig, of = _scheme(spread[some], owner[some], band, k, n1, parts, n2)
            made += sig
            owners += of
    if not made:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(made), np.concatenate(owners)


def _scheme(
    spread: np.ndarray, owner: np.ndarray, band: np.ndarray, k: np.ndarray, n1: np.ndarray,
    parts: np.ndarray, n2: int,
) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Signatures of one scheme for each set, all of ``n2`` second-level parts, and their sets."""
    first = np.cumsum(parts) - parts
    place = (spread >> np.uint64(32)) * parts.astype(np.uint64)[owner] >> np.uint64(32)
    place = place.astype(np.int64) + first[owner]
    sums = np.zeros(parts.sum(), np.uint64)
    np.add.at(sums, place, spread)
    filled = np.bincount(place, minlength=len(sums)) > 0
    holder = _owners(parts)
    number = np.arange(len(sums)) - first[holder]
    names = mixed((number + (band[holder] + 1 << 40)).astype(np.uint64))
    with np.errstate(over="ignore"):
        own = mixed(sums + names)
        if n2 == 2:  # at least 2 n1 - k of the parts agree, so one that is not empty does
            empty = parts - np.bincount(holder[filled], minlength=len(parts))
            kept = filled | (empty >= parts - k)[holder]
            return [own[kept]], [holder[kept]]
        own, filled, holder = own.reshape(-1, n2), filled.reshape(-1, n2), holder[::n2]
        poor = np.bincount(holder[filled.sum(axis=1) <= 1], minlength=len(parts))
        safe = (poor < n1 - k // 2)[holder]
        made, owners = [], []
        for left, right in combinations(range(n2), n2 - 1):
            both = mixed(own[:, left] * np.uint64(3) + own[:, right])
            kept = filled[:, left] | filled[:, right] | ~safe
            made.append(both[kept])
            owners.append(holder[kept])
    return made, owners


_DOC = "doc struct<doc_id: long, n_shingles: long, tail: long, text_key: long, sketch: binary>"
_DOC_TYPE = pa.struct(
    [(n, pa.int64()) for n in ("doc_id", "n_shingles", "tail", "text_key")]
    + [("sketch", pa.binary())]
)
#: A document beside its signatures: one column that is null in a signature's row.
_PACKED = "<?qqqq"


def sketch(shingles: np.ndarray) -> bytes:
    """One bit for each cell: whether it holds an odd number of the elements.

    Two sets differ in at least as many elements as their parities differ in cells.  With cells in
    proportion to the set few differences fall together, so the bound is close to the truth.
    """
    return sketches(shingles, np.array([len(shingles)]))[0]


def sketches(shingles: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Sketches of sets that stand end to end."""
    cells = np.array(
        [min(max(1 << max(0, 2 * n - 1).bit_length(), _FEWEST), _MOST) for n in sizes.tolist()],
        np.int64,
    )
    ends, owner = np.cumsum(cells), _owners(sizes)
    spread = (mixed(shingles ^ np.uint64(0x8EBC6AF09C88C6E3)) >> np.uint64(40)).astype(np.int64)
    place = (spread & (cells[owner] - 1)) + (ends - cells)[owner]
    counts = np.bincount(place, minlength=int(cells.sum()))
    held = np.packbits((counts & 1).astype(np.uint8)).tobytes()
    cuts = (np.append(0, ends) // 8).tolist()
    return [held[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _document_signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(sig, key, doc) of (text, doc_id, text_key): one row per signature and one per document.

    Copies of a set that a task has seen give no more signatures.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bands, seen, rows = WordHashes(), Bands(percent), set(), 0
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            shingles, sizes = shingle_sets(raw_texts(batch.column(0)), words, width)
            heads, docs, new = [], [], []
            ids = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            cells = sketches(shingles, sizes)
            for n, (own, (doc_id, text_key)) in enumerate(zip(_each(shingles, sizes), ids, strict=True)):
                key, tail = set_key(own)
                heads.append(key)
                docs.append(
                    struct.pack(_PACKED, doc_id is None, doc_id or 0, len(own), tail, text_key) + cells[n]
                )
                if (key, tail) not in seen and len(own):
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add((key, tail))
                    new.append(n)
            anywhere = mixed(np.arange(base + rows, base + rows + len(docs), dtype=np.uint64))
            rows += len(docs)
            yield pa.record_batch(
                [pa.array(_signed(anywhere)), pa.array(heads, pa.int64()), pa.array(docs, pa.binary())],
                ["sig", "key", "doc"],
            )
            fresh = np.zeros(len(sizes), bool)
            fresh[new] = True
            shingles, sizes = shingles[np.repeat(fresh, sizes)], sizes[fresh]
            made, owner = many_signatures(shingles, sizes, bands)
            yield _signature_batch(made, np.array(heads, np.int64)[fresh][owner])

    return docs.mapInArrow(run, "sig long, key long, doc binary")


def _signature_batch(sig: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(_signed(sig)), pa.array(key), pa.nulls(len(sig), pa.binary())],
        ["sig", "key", "doc"],
    )


def _unpacked(docs: list[bytes]) -> pa.StructArray:
    rows = []
    for packed in docs:
        unnamed, doc_id, *others = struct.unpack_from(_PACKED, packed)
        rows.append((None if unnamed else doc_id, *others, packed[struct.calcsize(_PACKED) :]))
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DOC_TYPE, strict=True)]
    return pa.StructArray.from_arrays(columns, fields=list(_DOC_TYPE))


def _divided_signatures(crowded: DataFrame, width: int, percent: int, seed: int) -> DataFrame:
    """Signatures of another partition of the domain inside each bucket: (text, sig, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bands = WordHashes(), Bands(percent)
        for batch in batches:
            shingles, sizes = shingle_sets(raw_texts(batch.column(0)), words, width)
            within, keys = (batch.column(i).to_numpy() for i in (1, 2))
            own, owner = many_signatures(shingles, sizes, bands, seed)
            yield _signature_batch(mixed(own ^ within.view(np.uint64)[owner]), keys[owner])

    return crowded.mapInArrow(run, "sig long, key long, doc binary")


_BUCKETS = f"sig long, centre long, members array<long>, weight long, key long, {_DOC}"


def _bucket_batch(rows: list[tuple]) -> pa.RecordBatch:
    sig, centre, members, weight = zip(*rows, strict=True)
    return pa.record_batch(
        [pa.array(sig, pa.int64()), pa.array(centre, pa.int64()),
         pa.array(members, pa.list_(pa.int64())), pa.array(weight, pa.int64()),
         pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), _DOC_TYPE)],
        ["sig", "centre", "members", "weight", "key", "doc"],
    )


def _buckets(limit: int):
    """(sig, key, doc) rows sorted by signature to buckets of two or more keys.

    Equal member lists become one row with their number; a bucket above the limit keeps its
    signature and comes in pieces, and only pieces may repeat a key.  Document rows pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[bytes, int] = {}
        large: list[tuple] = []
        sig, key = np.empty(0, np.int64), np.empty(0, np.int64)
        open_sig = centre = None  # bucket whose first pieces are already out

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for held, weight in sets.items():
                members = np.frombuffer(held, np.int64)
                rows.append((None, members[0], members, weight))
            rows += large
            sets.clear()
            large.clear()
            if rows:
                yield _bucket_batch(rows)

        def close(start: int, end: int) -> None:
            """Take in sig[start:end], all of one signature; nothing more of it follows."""
            members = key[start:end]
            if len(members) > limit or open_sig is not None and sig[start] == open_sig:
                spill(sig[start], members)
            elif len(members) > 1:
                held = members.tobytes()
                sets[held] = sets.get(held, 0) + 1

        def spill(own: int, members: np.ndarray) -> None:
            nonlocal open_sig, centre
            if open_sig is None or own != open_sig:
                open_sig, centre = own, members[0]
            for at in range(0, len(members), _CHUNK):
                large.append((open_sig, centre, members[at : at + _CHUNK], 1))

        for batch in batches:
            docs = batch.column(2)
            if docs.null_count < len(docs):
                own = batch.filter(docs.is_valid())
                size = own.num_rows
                yield pa.record_batch(
                    [pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()),
                     pa.nulls(size, pa.list_(pa.int64())), pa.nulls(size, pa.int64()),
                     own.column(1), _unpacked(own.column(2).to_pylist())],
                    ["sig", "centre", "members", "weight", "key", "doc"],
                )
                batch = batch.filter(docs.is_null())
            sig = np.concatenate([sig, batch.column(0).to_numpy()])
            key = np.concatenate([key, batch.column(1).to_numpy()])
            if not len(sig):
                continue
            shared, same = np.zeros(len(sig), bool), sig[1:] == sig[:-1]
            shared[1:], shared[-1] = same, True
            shared[:-1] |= same
            shared[0] |= open_sig is not None and sig[0] == open_sig
            sig, key = sig[shared], key[shared]
            order = np.lexsort((key, sig))
            sig, key = sig[order], key[order]
            fresh = np.ones(len(sig), bool)
            fresh[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
            sig, key = sig[fresh], key[fresh]
            starts = np.concatenate([[0], np.flatnonzero(sig[1:] != sig[:-1]) + 1])
            ends = np.append(starts[1:], len(sig))
            first = open_sig is not None and sig[0] == open_sig
            several = np.flatnonzero((ends - starts > 1) & (ends < len(sig)))
            if first and len(starts) > 1:
                several = np.union1d(several, [0])
            for n in several.tolist():
                close(int(starts[n]), int(ends[n]))
            last = int(starts[-1])
            sig, key = sig[last:], key[last:]
            if len(sig) > max(limit, _CHUNK):
                spill(sig[0], key)
                sig, key = sig[:0], key[:0]
            if len(sets) >= _SETS or sum(len(r[2]) for r in large) >= _SETS:
                yield from flush()
        if len(sig):
            close(0, len(sig))
        yield from flush()

    return run


def _gathered(signature_rows: DataFrame, limit: int, name: str) -> DataFrame:
    parts = int(signature_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = signature_rows.repartition(parts, "sig").sortWithinPartitions("sig")
    return written(dealt.mapInArrow(_buckets(limit), _BUCKETS), name)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) of the pairs whose sets are similar; ``texts`` holds (class, text).

    The members of a centre b are dealt to as many tasks as their number asks for, each with a
    copy of the centre's text; both sides move once.
    """
    salts = F.ceil(F.col("members") / PER_CENTRE).cast("int")
    counts = pairs.groupBy("b").agg(F.count("*").alias("members")).select("b", salts.alias("salts"))
    copies = counts.select(
        F.col("b").alias("class"), F.col("b").alias("centre"),
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.lit(None).cast("binary").alias("member"),
    )
    members = pairs.join(counts, "b").select(
        F.col("a").alias("class"), F.col("b").alias("centre"),
        F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"),
        F.col("a").alias("member"),
    )
    asked = copies.union(members)
    rows = texts.join(asked, "class").select("text", "centre", "salt", "member")
    dealt = rows.repartition("centre", "salt").sortWithinPartitions(
        "centre", "salt", F.col("member").asc_nulls_first()
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, centre, held = WordHashes(), None, None
        for batch in batches:
            found = []
            keys = zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)
            sets = _each(*shingle_sets(raw_texts(batch.column(0)), words, width))
            for shingles, (own, member) in zip(sets, keys, strict=True):
                if member is None:
                    centre, held = own, shingles.copy()
                elif own == centre:
                    shared = len(np.intersect1d(shingles, held, assume_unique=True))
                    if 100 * shared >= percent * (len(shingles) + len(held) - shared):
                        found.append((member, own))
            if found:
                yield pa.record_batch([pa.array(c) for c in zip(*found, strict=True)], ["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary")


def _possible(sizes: tuple, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and cells of other parity leave room for enough shared elements."""
    near = apart * (100 + percent) <= (100 - percent) * (sizes[0] + sizes[1])
    return near & (100 * np.minimum(*sizes) >= percent * np.maximum(*sizes))


def _apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.bitwise_count(left ^ right).sum(axis=-1, dtype=np.int64)


def _folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches of ``size`` bytes each; cells of longer ones are laid together."""
    rows = np.empty((len(sketches), size // 8), np.uint64)
    lengths = np.array([len(cells) for cells in sketches])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        words = np.frombuffer(b"".join(sketches[n] for n in at.tolist()), np.uint64)
        rows[at] = np.bitwise_xor.reduce(words.reshape(len(at), -1, size // 8), axis=1)
    return rows


def _within_bounds(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches do not rule out; only narrow rows move."""
    for side in ("a", "b"):
        held = classes.select(
            F.col("class").alias(side), F.col("n_shingles").alias(f"n_{side}"),
            F.col("sketch").alias(f"sketch_{side}"),
        )
        pairs = pairs.join(held, side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = tuple(batch.column(i).to_numpy() for i in (2, 3))
            left, right = (batch.column(i).to_pylist() for i in (4, 5))
            shorter = np.array([min(map(len, both)) for both in zip(left, right, strict=True)])
            apart = np.zeros(batch.num_rows, np.int64)
            for size in np.unique(shorter).tolist():
                at = np.flatnonzero(shorter == size)
                apart[at] = _apart(*(_folded([x[n] for n in at.tolist()], size) for x in (left, right)))
            yield batch.select([0, 1]).filter(pa.array(_possible(sizes, apart, percent)))

    columns = ("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    return settled(pairs.select(*columns).mapInArrow(run, "a binary, b binary"))


def _pairs_within(
    held: DataFrame, classes: DataFrame, percent: int, spanning: bool = False
) -> DataFrame:
    """Ordered pairs of different groups in each bucket that may be similar.

    A bucket is held by one task as sizes and sketches; pairs ruled out are never made.  When
    spanning, a pair made counts as a link and only the nearest of each group met is made, so a
    bucket gives fewer pairs than it has members.
    """
    rows = held.select("sig", "class", "root").join(
        classes.select("class", "n_shingles", "sketch"), "class"
    ).select("sig", "class", "root", "n_shingles", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, parts = None, []

        def pairs() -> Iterator[pa.RecordBatch]:
            bucket = pa.Table.from_batches(parts).combine_chunks()
            names = bucket.column(1).to_pylist()
            roots = np.unique(np.array(bucket.column(2).to_pylist(), object), return_inverse=True)[1]
            sizes, cells = bucket.column(3).to_numpy(), bucket.column(4).to_pylist()
            cells = _folded(cells, min(map(len, cells)))
            step = max(1, GROUP_BYTES // cells.nbytes)
            for at in range(0, len(names), step):
                own, end = np.s_[at : at + step, None], min(at + step, len(names))
                apart = _apart(cells[own], cells[:end])
                near = _possible((sizes[own], sizes[:end]), apart, percent)
                near &= (roots[own] != roots[:end]) & np.tri(end - at, end, at - 1, bool)
                ends = []
                for i in np.flatnonzero(near.any(axis=1)).tolist():
                    found = np.flatnonzero(near[i])
                    if spanning:
                        found = found[np.argsort(apart[i, found], kind="stable")]
                        found = found[roots[found] != roots[at + i]]
                        met, nearest = np.unique(roots[found], return_index=True)
                        found = found[nearest]
                        roots[np.isin(roots, met)] = roots[at + i]
                    name = names[at + i]
                    ends += [(max(name, names[j]), min(name, names[j])) for j in found.tolist()]
                if ends:
                    yield pa.record_batch(
                        [pa.array(c, pa.binary()) for c in zip(*ends, strict=True)], ["a", "b"]
                    )

        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if end > start and keys[start] != sig:
                    if parts:
                        yield from pairs()
                    sig, parts = keys[start], []
                parts.append(batch.slice(start, end - start))
        if parts:
            yield from pairs()

    dealt = rows.repartition("sig").sortWithinPartitions("sig", "class")
    return dealt.mapInArrow(run, "a binary, b binary")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()


def similar_groups(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
    width: int = SHINGLE, percent: int = PERCENT, bucket: int = BUCKET,
    together: int = TOGETHER,
) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``.

    A-Z are lower-cased; words are runs of anything but ASCII white space.  Texts of fewer words
    than the width are one shingle; null, empty and blank texts have none and are linked with
    nothing, so they name themselves.  Equal sets are one class, whatever their number, and are
    linked.  ``component_id`` is the smallest id reached; rows without an id belong to their
    component but never name it.  Texts of any length are read whole, in batches bounded by
    bytes.  An empty table gives no rows; other columns are not read.
    """
    narrow_batches(docs.sparkSession)
    keyed = docs.select(
        F.col(text_column).alias("text"),
        F.col(id_column).cast("long").alias("doc_id"),
        F.xxhash64(text_column).alias("text_key"),
    )
    with shuffles_freed(docs.sparkSession):
        made = _gathered(_document_signatures(keyed, width, percent), bucket, "signatures")
        name = F.unhex(F.concat(F.lpad(F.hex("key"), 16, "0"), F.lpad(F.hex("doc.tail"), 16, "0")))
        rows = made.where("doc IS NOT NULL").select(
            "doc.*", "key", name.alias("class"), (F.col("doc.n_shingles") == 0).alias("blank")
        )
        unnamed = F.col("doc_id").isNull().alias("unnamed")
        first = F.min(F.struct(unnamed, "doc_id", "text_key", "n_shingles", "sketch"))
        classes = settled(
            rows.where("NOT blank").groupBy("class", "key")
            .agg(F.min("doc_id").alias("first_id"), first.alias("one"))
            .select("class", "key", "first_id", F.col("one.doc_id").alias("doc_id"), "one.text_key",
                    "one.n_shingles", "one.sketch")
        )
        buckets = made.where("doc IS NULL")
        opened = _opened(buckets)
        texts = _texts_of(keyed, classes, opened)
        links = _links(buckets, opened, classes, texts, width, percent, bucket, together)
        roots = linked_components(links).select(F.col("node").alias("class"), "root")
    rooted = classes.join(roots, "class", "left").select(
        "class", "first_id", F.coalesce("root", "class").alias("root")
    )
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(names, "root").select("class", "component_id")
    linked = rows.where("NOT blank").join(named, "class").select(
        "doc_id", "n_shingles", "component_id"
    )
    alone = rows.where("blank").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def _opened(buckets: DataFrame) -> DataFrame:
    """(sig, centre, weight, key): one row for each member of a bucket, made once."""
    opened = buckets.select("sig", "centre", "weight", F.explode("members").alias("key"))
    return written(opened, "opened")


def _texts_of(keyed: DataFrame, classes: DataFrame, opened: DataFrame) -> DataFrame:
    """(class, text): one text for each class that meets another one in a bucket."""
    met = opened.select("key").distinct()
    wanted = classes.join(met, "key").select(
        F.col("class"), F.col("doc_id").alias("one_id"), F.col("text_key").alias("one_key")
    )
    same = (F.col("text_key") == F.col("one_key")) & F.col("doc_id").eqNullSafe(F.col("one_id"))
    return written(keyed.join(wanted, same).select("class", "text"), "texts")


def _links(
    buckets: DataFrame, opened: DataFrame, classes: DataFrame, texts: DataFrame, width: int,
    percent: int, limit: int, together: int,
) -> DataFrame:
    """Verified links that connect exactly the linked classes."""
    ids = classes.select("key", "class")
    centres = ids.withColumnRenamed("key", "centre").withColumnRenamed("class", "b")
    stars = (
        opened.where("key <> centre").groupBy("key", "centre").agg(F.sum("weight").alias("met"))
        .groupBy("key").agg(F.max(F.struct("met", "centre")).alias("most"))
        .select("key", F.col("most.centre").alias("centre"))
    )
    asked = settled(
        stars.join(ids.withColumnRenamed("class", "a"), "key").join(centres, "centre")
        .select("a", "b").where("a <> b")
    )
    trees = settled(_trees(opened, ids, classes, percent, together))
    near = _within_bounds(asked, classes, percent).union(trees)
    links = settled(_verified(near, texts, width, percent))
    tried = settled(_ordered(asked.union(trees)))
    for level in range(LEVELS + 1):
        roots = linked_components(links).select(F.col("node").alias("class"), "root")
        groups = settled(
            ids.join(roots, "class", "left").select(
                "key", "class", F.coalesce("root", "class").alias("root")
            )
        )
        crowded = _crowded(opened, groups)
        held = crowded.where(F.col("members") <= together)
        pairs = _pairs_between(buckets, groups).union(_pairs_within(held, classes, percent))
        crowded = crowded.where(F.col("members") > together)
        last = crowded.isEmpty()
        if level == LEVELS and not last:
            pairs, last = pairs.union(_pairs_inside(crowded)), True
        pairs = pairs.distinct()
        fresh = settled(pairs.join(tried, ["a", "b"], "left_anti"))
        near = _within_bounds(fresh, classes, percent)
        links = settled(links.union(_verified(near, texts, width, percent)))
        if last:
            break
        tried = settled(tried.union(fresh))
        inside = texts.join(crowded, "class").select("text", "sig", "key")
        divided = _divided_signatures(inside, width, percent, level + 1)
        buckets = _gathered(divided, limit, "divided")
        opened = _opened(buckets)
    return links


def _trees(
    opened: DataFrame, ids: DataFrame, classes: DataFrame, percent: int, together: int
) -> DataFrame:
    """Pairs that span what may be similar in each large bucket that a task can hold."""
    pieces = opened.where("sig IS NOT NULL").select("sig", "key").distinct()
    beyond = pieces.groupBy("sig").count().where(F.col("count") > together).select("sig")
    held = pieces.join(beyond, "sig", "left_anti").join(ids, "key").select(
        "sig", "class", F.col("class").alias("root")
    )
    return _pairs_within(held, classes, percent, spanning=True).distinct()


def _pairs_inside(crowded: DataFrame) -> DataFrame:
    """Ordered pairs of classes of different groups that share a crowded bucket."""
    left = crowded.select("sig", F.col("class").alias("a"), F.col("root").alias("x"))
    right = crowded.select("sig", F.col("class").alias("b"), F.col("root").alias("y"))
    return _ordered(left.join(right, "sig").where("x <> y AND a > b"))


def _pairs_between(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """Ordered pairs of classes of different groups that share a small bucket."""
    sets = buckets.where("sig IS NULL").groupBy("members").agg(F.lit(1).alias("one"))
    held = sets.select("members", F.explode("members").alias("key")).join(groups, "key")
    mixed_sets = held.groupBy("members").agg(
        F.collect_list(F.struct("class", "root")).alias("held"),
        F.min("root").alias("low"), F.max("root").alias("high"),
    ).where("low <> high")
    left = mixed_sets.select("held", F.explode("held").alias("l"))
    both = left.select("l", F.explode("held").alias("r")).where(
        (F.col("l.root") != F.col("r.root")) & (F.col("l.class") > F.col("r.class"))
    )
    return _ordered(both.select(F.col("l.class").alias("a"), F.col("r.class").alias("b")))


def _crowded(opened: DataFrame, groups: DataFrame) -> DataFrame:
    """(sig, class, key, root, members) of the large buckets that hold several groups."""
    held = opened.where("sig IS NOT NULL").select("sig", "key").distinct()
    rooted = settled(held.join(groups, "key"))
    several = rooted.groupBy("sig").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members")
    ).where("low <> high").select("sig", "members")
    return settled(rooted.join(several, "sig").select("sig", "class", "key", "root", "members"))
