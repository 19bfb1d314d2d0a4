"""Token ids in Arrow stream files of fixed-size lists: equal-length sequences with masks.

Documents are range partitioned and sorted, by id or an order given; each task encodes its range
and streams the ids, end id after every document, into a file of its own.  A record batch holds a fixed number of
sequences, a sequence a fixed number of ids, and a mask marks the ids that are not padding (only
the tail of a file's last sequence is).  All batches but the last therefore have one layout, and
a memory-mapped file gives any sequence as a view of its pages.  Texts are shuffled once, ids
never; an index row per document says which file holds it and where.

A task writes to a name of its own attempt and renames the finished file, so a retried or
speculative attempt replaces a file by an equal one.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knownat.llm.common import prepare, settled, shared_folder

SEQUENCE = 2048
BATCH_SEQUENCES = 64
#: Words and pieces, each, that a worker remembers before the memory turns into the old one.
_REMEMBERED = 1 << 19
#: Fixed value: how the byte-level vocabulary cuts a text before merging.
PRETOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: Fixed value: the pre-tokenizer that ``PRETOKEN`` writes out.
_BYTE_LEVEL = {
    "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True
}
INDEX = "doc_id long, part int, offset long, n_tokens long"


def _byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {byte: chr(byte if byte in plain else next(spare)) for byte in range(256)}


class _Irregular(Exception):
    """A word that does not stand alone: white space comes before the space that ends it."""


class _Recent(dict):
    """Values by key, made once: a full memory becomes the old one, and hits there move up."""

    def __init__(self, make, room: int) -> None:
        self.make, self.room, self.old = make, room, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.room:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Whole-text ids of a byte-level tokenizer, remembering words it has met.

    The pre-tokenizer never joins what stands before a space to the space, unless that is white
    space itself; so a text without white space before a space is the concatenation of its
    space-led words, and each distinct piece needs the library's model once.  Other texts, texts
    that spell a special token and other tokenizers go to the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        cut = json.loads(self.tokenizer.to_str())
        self.byte_level = cut["normalizer"] is None and cut["pre_tokenizer"] == _BYTE_LEVEL
        self.pretoken, self.characters = regex.compile(PRETOKEN), _byte_characters()
        self.pieces = _Recent(self.tokenized, _REMEMBERED)
        self.first = _Recent(self.learn, _REMEMBERED >> 4)
        self.words = _Recent(lambda word: self.learn(word, " "), _REMEMBERED)

    def library(self, text: str) -> bytes:
        return array(
            self.width, self.tokenizer.encode(text, add_special_tokens=False).ids
        ).tobytes()

    def tokenized(self, piece: str) -> bytes:
        written = piece.encode().decode("latin-1").translate(self.characters)
        found = [token.id for token in self.tokenizer.model.tokenize(written)]
        return array(self.width, found).tobytes()

    def learn(self, word: str, lead: str = "") -> bytes:
        """Ids of a word that stands alone, from those of its pieces."""
        if not word or word[-1].isspace():
            raise _Irregular
        if word.isalpha():
            return self.pieces[lead + word]
        if word[-1] in ",." and word[:-1].isalpha():
            return self.pieces[lead + word[:-1]] + self.pieces[word[-1]]
        return b"".join(map(self.pieces.__getitem__, self.pretoken.findall(lead + word)))

    def encode(self, text: str) -> bytes:
        """Ids of the text in native byte order."""
        if self.byte_level and not any(token in text for token in self.special):
            words = text.split(" ")
            try:
                return self.first[words[0]] + b"".join(map(self.words.__getitem__, words[1:]))
            except _Irregular:
                pass
        return self.library(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or ":/" in folder else f"file://{folder}")


def file_schema(width: str, length: int) -> pa.Schema:
    kind = pa.uint16() if width == "H" else pa.uint32()
    return pa.schema([
        pa.field("ids", pa.list_(kind, length)), pa.field("mask", pa.list_(pa.bool_(), length))
    ])


class SequenceWriter:
    """Packs a stream of ids into fixed-size record batches of one Arrow stream."""

    def __init__(self, sink, width: str, length: int, batch: int) -> None:
        self.kind = np.dtype("u2" if width == "H" else "u4")
        self.schema, self.length = file_schema(width, length), length
        self.stream = pa.ipc.new_stream(sink, self.schema)
        self.room, self.waiting, self.held = length * batch, [], 0

    def add(self, ids: np.ndarray) -> None:
        while len(ids):
            taken = ids[: self.room - self.held]
            self.waiting.append(taken)
            self.held += len(taken)
            ids = ids[len(taken) :]
            if self.held == self.room:
                self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        rows = -(-self.held // self.length)
        values = np.zeros(rows * self.length, self.kind)
        values[: self.held] = np.concatenate(self.waiting)
        valid = np.arange(len(values)) < self.held
        self.stream.write_batch(
            pa.record_batch(
                [
                    pa.FixedSizeListArray.from_arrays(pa.array(values), self.length),
                    pa.FixedSizeListArray.from_arrays(pa.array(valid), self.length),
                ],
                schema=self.schema,
            )
        )
        self.waiting, self.held = [], 0

    def close(self) -> None:
        self.flush()
        self.stream.close()


class SequenceFile:
    """Random access to the sequences of one local file without copying them."""

    def __init__(self, path: str) -> None:
        self.batches = list(pa.ipc.open_stream(pa.memory_map(path)))
        self.rows = len(self.batches[0]) if self.batches else 1

    def __len__(self) -> int:
        return sum(map(len, self.batches))

    def ids(self, at: int) -> np.ndarray:
        column = self.batches[at // self.rows].column(0)
        row = at % self.rows * column.type.list_size
        return column.values.slice(row, column.type.list_size).to_numpy(zero_copy_only=True)

    def mask(self, at: int) -> pa.BooleanArray:
        column = self.batches[at // self.rows].column(1)
        row = at % self.rows * column.type.list_size
        return column.values.slice(row, column.type.list_size)


class _IdStream:
    """Reads runs of ids at rising offsets from one file, holding one batch at a time."""

    def __init__(self, system: fs.FileSystem, path: str) -> None:
        self.batches = iter(pa.ipc.open_stream(system.open_input_stream(path)))
        self.values, self.start = np.empty(0, "u2"), 0

    def take(self, offset: int, count: int) -> np.ndarray:
        found = []
        while count:
            while offset >= self.start + len(self.values):
                self.start += len(self.values)
                self.values = next(self.batches).column(0).values.to_numpy()
            piece = self.values[offset - self.start :][:count]
            found.append(piece)
            offset, count = offset + len(piece), count - len(piece)
        return np.concatenate(found) if found else np.empty(0, "u2")


def write_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str | None = None,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    order: Sequence[Column] | None = None,
    end_id: int = 0,
    length: int = SEQUENCE,
    batch: int = BATCH_SEQUENCES,
    files: int | None = None,
) -> tuple[str, DataFrame]:
    """Write every text's ids and return (folder, index: doc_id, part, offset, n_tokens).

    A null or empty text is its end id alone.  Order is by the columns of ``order``, which should
    tell rows apart, or else by id, null ids first, equal ids by text; repeated rows are written
    each.  Other columns are not read.  An empty table writes
    no sequence.  ``files`` defaults to the session's shuffle partitions.
    """
    spark = prepare(docs.sparkSession)
    folder = folder or shared_folder(spark, "tokens")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = [column.alias(f"__place{n}") for n, column in enumerate(order or ())]
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), *places
    )
    if order:
        by = [f"__place{n}" for n in range(len(places))]
        ranged = rows.repartitionByRange(files, *by).sortWithinPartitions(*by)
    else:
        tie = F.xxhash64("text")  # a hot id spreads over several ranges
        ranged = rows.repartitionByRange(files, "doc_id", tie).sortWithinPartitions(
            "doc_id", tie, "text"
        )
    ranged = ranged.select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(folder)
        system.create_dir(base, recursive=True)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        draft = f"{base}/.part-{part:06d}.{attempt}"
        encode = encoder(tokenizer_path)
        kind = "u2" if encode.width == "H" else "u4"
        end = np.array([end_id], kind).tobytes()
        offset = 0
        with system.open_output_stream(draft) as sink:
            writer = SequenceWriter(sink, encode.width, length, batch)
            for rows in batches:
                ids = [
                    np.frombuffer(encode.encode(text or "") + end, kind)
                    for text in rows.column(1).to_pylist()
                ]
                for each in ids:
                    writer.add(each)
                counts = np.fromiter(map(len, ids), np.int64, len(ids))
                starts = offset + np.cumsum(counts) - counts
                offset += int(counts.sum())
                yield pa.record_batch(
                    [
                        rows.column(0),
                        pa.array(np.full(len(ids), part, np.int32)),
                        pa.array(starts),
                        pa.array(counts),
                    ],
                    ["doc_id", "part", "offset", "n_tokens"],
                )
            writer.close()
        system.move(draft, f"{base}/part-{part:06d}.arrows")

    return folder, settled(ranged.mapInArrow(write, INDEX))


def read_tokens(folder: str, index: DataFrame) -> DataFrame:
    """Read each indexed document's ids back: the index with ids_crc32.

    The index keeps a file's documents together and in order, so a task streams each file once;
    an index in another order only costs reopening files.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(folder)
        at, stream, upto = None, None, 0
        for rows in batches:
            sums = []
            for part, offset, count in zip(*(rows.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if part != at or offset < upto:
                    at, stream = part, _IdStream(system, f"{base}/part-{part:06d}.arrows")
                upto = offset + count
                sums.append(zlib.crc32(stream.take(offset, count).astype("<u4").tobytes()))
            yield pa.record_batch(
                [*rows.columns, pa.array(sums, pa.int64())],
                ["doc_id", "part", "offset", "n_tokens", "ids_crc32"],
            )

    return index.mapInArrow(read, f"{INDEX}, ids_crc32 long")


def with_starts(index: DataFrame) -> DataFrame:
    """Add ``start``: ids of all documents before this one.  Files are few; their totals are summed."""
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return index.join(bases, "part").withColumn("start", F.col("base") + F.col("offset"))


