"""ZIP archives read by many tasks, files written and digested as streams.

A first stage reads only the central directories of the archives, one row per member; a filter on
member names therefore acts before anything is inflated.  A second stage deals the members out by
hash, so one archive is inflated by as many tasks as there are partitions.  Tables are streamed
line by line and no member of theirs is held whole; a JSON document is one row and so is held once.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from io import TextIOWrapper

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knownat.scale import stable

#: Bytes of text, about, in one batch that a task hands to Spark.
BATCH_BYTES = 1 << 21
#: Bytes of text, about, that one task writes; the number of segments follows from the texts alone.
SEGMENT_BYTES = 1 << 26
_BLOCK = 1 << 22


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a local path or a URI as Spark writes it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files that a path or pattern names; contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def archive_members(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, member, place, bytes): the files in each archive whose names match ``pattern``."""

    def directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, plain = open_path(name)
                with system.open_input_file(plain) as source, zipfile.ZipFile(source) as archive:
                    found = [m for m in archive.infolist() if not m.is_dir()]
                yield pa.record_batch(
                    [
                        pa.array([name] * len(found), pa.string()),
                        pa.array([m.filename for m in found], pa.string()),
                        pa.array([m.header_offset for m in found], pa.int64()),
                        pa.array([m.file_size for m in found], pa.int64()),
                    ],
                    ["path", "member", "place", "bytes"],
                )

    schema = "path string, member string, place long, bytes long"
    listed = _apart(list_files(spark, path).select("path"), "path")
    members = listed.mapInArrow(directories, schema)
    return members.where(F.col("member").rlike(pattern)) if pattern else members


def _parallel(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _apart(df: DataFrame, name: str) -> DataFrame:
    """Short rows that stand for long files, over all partitions: none is merged for its size."""
    return df.repartition(_parallel(df), name)


def _dealt(members: DataFrame) -> DataFrame:
    """Members over all partitions by hash, those of an archive together inside each."""
    return (
        members.select("path", "member", "place")
        .repartition(_parallel(members), "path", "place")
        .sortWithinPartitions("path", "place")
    )


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, object]]:
    """(path, member, stream) in order; an archive stays open while its members last."""
    path = source = archive = None
    try:
        for batch in batches:
            for name, member in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                if name != path:
                    if source:
                        archive.close()
                        source.close()
                    system, plain = open_path(name)
                    path, source = name, system.open_input_file(plain)
                    archive = zipfile.ZipFile(source)
                with archive.open(member) as stream:
                    yield path, member, stream
    finally:
        if source:
            archive.close()
            source.close()


def member_payloads(members: DataFrame) -> DataFrame:
    """(path, member, payload): each member as one text; wrong UTF-8 is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)]
            return pa.record_batch(columns, ["path", "member", "payload"])

        for path, member, stream in _opened(batches):
            text = stream.read().decode("utf-8", errors="replace")
            rows.append((path, member, text))
            held += len(text)
            if held > BATCH_BYTES:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()

    return _dealt(members).mapInArrow(run, "path string, member string, payload string")


def member_lines(members: DataFrame) -> DataFrame:
    """(path, member, line, text): lines from 0, without their ends, streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, member, stream in _opened(batches):
            lines = TextIOWrapper(stream, encoding="utf-8", errors="replace", newline="\n")
            texts, held, first = [], 0, 0

            def batch(first: int, texts: list[str]) -> pa.RecordBatch:
                size = len(texts)
                return pa.record_batch(
                    [
                        pa.array([path] * size), pa.array([member] * size),  # noqa: B023
                        pa.array(range(first, first + size), pa.int64()), pa.array(texts),
                    ],
                    ["path", "member", "line", "text"],
                )

            for line in lines:
                texts.append(line.removesuffix("\n").removesuffix("\r"))
                held += len(line)
                if held > BATCH_BYTES:
                    yield batch(first, texts)
                    first, texts, held = first + len(texts), [], 0
            if texts:
                yield batch(first, texts)

    return _dealt(members).mapInArrow(run, "path string, member string, line long, text string")


def _in_ranges(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Contiguous ranges of ``keys`` of some ``SEGMENT_BYTES`` of text, one a task."""
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return rows.repartitionByRange(
        max(_parallel(rows), math.ceil(size / SEGMENT_BYTES)), *[F.col(k) for k in keys]
    )


def _copy(system: fs.FileSystem, path: str, sink, size: int | None = None) -> None:
    """Append a file, or its first ``size`` bytes, to an open stream block by block."""
    left = math.inf if size is None else size
    with system.open_input_stream(path) as source:
        while left and (block := source.read(int(min(_BLOCK, left)))):
            sink.write(block)
            left -= len(block)


def _joined(segments: DataFrame, folder: str, append, schema: str) -> DataFrame:
    """Hand (name, paths of its segments in order) to ``append``, one task a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_path(folder)
        for batch in batches:
            for name, paths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield append(system, name, paths)

    listed = segments.groupBy("name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("part", "path"))), lambda s: s["path"]
        ).alias("paths")
    )
    made = stable(_apart(listed, "name").mapInArrow(run, schema))
    system, base = open_path(f"{folder}/_segments")
    if system.get_file_info(base).type != fs.FileType.NotFound:
        system.delete_dir(base)
    return made


def write_archives(
    pieces: DataFrame, folder: str, *, archive: str = "archive", member: str = "member",
    place: str = "place", text: str = "text",
) -> DataFrame:
    """Write ``folder``/<archive>.zip; a member is its texts in the order of ``place``.

    A member is deflated by one task, the members of an archive by many.  Returns
    (archive, members), one row per archive.
    """
    kept = f"{folder}/_segments/{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_path(kept)
        system.create_dir(base, recursive=True)
        task = TaskContext.get().partitionId()
        name = sink = packed = entry = part = None
        written: list[tuple[str, int, str]] = []

        def close() -> None:
            if entry:
                entry.close()
            if packed:
                packed.close()
                sink.close()

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3)]
            for own, inner, piece in zip(*columns, strict=True):
                if own != name:
                    close()
                    name, part, entry = own, None, None
                    path = f"{base}/{task}-{len(written)}.zip"
                    written.append((name, task, path))
                    sink = system.open_output_stream(path)
                    packed = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
                if inner != part:
                    if entry:
                        entry.close()
                    part, entry = inner, packed.open(inner, "w", force_zip64=True)
                entry.write((piece or "").encode())
        close()
        if written:
            columns = zip(*written, strict=True)
            yield pa.record_batch([pa.array(c) for c in columns], ["name", "part", "path"])

    def append(system: fs.FileSystem, name: str, paths: list[str]) -> pa.RecordBatch:
        """Deflated members are copied as they are; only the directory is written anew."""
        _, base = open_path(folder)
        target = system.open_output_stream(f"{base}/{name}.zip")
        with target as sink, zipfile.ZipFile(sink, "w") as whole:
            for path in paths:
                start = sink.tell()
                with system.open_input_file(path) as source, zipfile.ZipFile(source) as segment:
                    size, members = segment.start_dir, segment.infolist()
                _copy(system, path, sink, size)
                for entry in members:
                    entry.header_offset += start
                    whole.filelist.append(entry)
                    whole.NameToInfo[entry.filename] = entry
            whole.start_dir = sink.tell()
            return pa.record_batch(
                [pa.array([name]), pa.array([len(whole.filelist)])], ["archive", "members"]
            )

    rows = pieces.select(
        F.col(archive).cast("string").alias("name"), F.col(member).alias("member"),
        F.col(place).alias("place"), F.col(text).alias("text"),
    )
    ranged = _in_ranges(rows, ["name", "member"], "text")
    segments = ranged.sortWithinPartitions("name", "member", "place").mapInArrow(
        run, "name string, part long, path string"
    )
    return _joined(stable(segments), folder, append, "archive string, members long")


def write_files(
    pieces: DataFrame, folder: str, *, file: str = "file", place: str | Column = "place",
    text: str = "text",
) -> DataFrame:
    """Write ``folder``/<file> from texts in the order of ``place``; returns (file, bytes)."""
    kept = f"{folder}/_segments/{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_path(kept)
        system.create_dir(base, recursive=True)
        task = TaskContext.get().partitionId()
        name = sink = None
        written: list[tuple[str, int, str]] = []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 2)]
            for own, piece in zip(*columns, strict=True):
                if own != name:
                    if sink:
                        sink.close()
                    path = f"{base}/{task}-{len(written)}"
                    name, sink = own, system.open_output_stream(path)
                    written.append((name, task, path))
                sink.write((piece or "").encode())
        if sink:
            sink.close()
            columns = zip(*written, strict=True)
            yield pa.record_batch([pa.array(c) for c in columns], ["name", "part", "path"])

    def append(system: fs.FileSystem, name: str, paths: list[str]) -> pa.RecordBatch:
        _, base = open_path(folder)
        with system.open_output_stream(f"{base}/{name}") as sink:
            for path in paths:
                _copy(system, path, sink)
            return pa.record_batch([pa.array([name]), pa.array([sink.tell()])], ["file", "bytes"])

    rows = pieces.select(
        F.col(file).cast("string").alias("name"), F.col(place).alias("place"),
        F.col(text).alias("text"),
    )
    segments = (
        _in_ranges(rows, ["name", "place"], "text")
        .sortWithinPartitions("name", "place")
        .mapInArrow(run, "name string, part long, path string")
    )
    return _joined(stable(segments), folder, append, "file string, bytes long")


def file_digests(files: DataFrame) -> DataFrame:
    """(path, sha256, bytes) of listed files, each read as a stream of any length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, plain = open_path(path)
                digest, size = hashlib.sha256(), 0
                with system.open_input_stream(plain) as stream:
                    while block := stream.read(_BLOCK):
                        digest.update(block)
                        size += len(block)
                yield pa.record_batch(
                    [pa.array([path]), pa.array([digest.hexdigest()]), pa.array([size])],
                    ["path", "sha256", "bytes"],
                )

    return _apart(files.select("path"), "path").mapInArrow(
        run, "path string, sha256 string, bytes long"
    )
