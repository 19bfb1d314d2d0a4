"""What the corpus operators share: words, shingles, shared folders and linked groups."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knownat.session import ensure_checkpoint_dir

#: A word: a run of anything but ASCII white space (Java and DuckDB read this pattern alike).
WORD = r"[^\x20\x09-\x0D]+"
#: Rows handed to a Python task at once; a batch of long texts has to fit beside the model.
BATCH_ROWS = 256
_KNOWN_WORDS = 1 << 18
#: Bytes of text whose words are held at once; a longer text stands alone.
GROUP_BYTES = 1 << 21


def prepare(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small enough for very long texts and name the shared folder."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ensure_checkpoint_dir(spark)
    return spark


def narrow_batches(spark: SparkSession) -> SparkSession:
    """As :func:`prepare`, for narrow rows: more rows to a batch, bounded by their bytes."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8192")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(GROUP_BYTES))
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors both reach."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Each action on a table made inside drops its shuffle files when it ends.

    For steps that are settled or written once; Spark makes the files anew if one runs again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def settled(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as a compressed table in the shared folder and read that instead."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_order() -> list[Column]:
    """Place of a row in a table that was written in order: its file, then its row there.

    Only for a table read from Parquet files; Spark numbers the files of a sorted write in order.
    """
    name = F.col("_metadata.file_name")
    number = F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long")
    return [number, name, F.col("_metadata.row_index")]


def map_batches(
    df: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """One output batch for each input batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield run(batch)

    return df.mapInArrow(each, schema)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null counts as empty."""
    return [text or b"" for text in column.cast(pa.large_binary()).to_pylist()]


def text_groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in order, cut into runs of bounded size; one empty run for no texts."""
    group, held = [], 0
    for text in texts:
        if group and held + len(text) > GROUP_BYTES:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    yield group


class WordHashes(dict):
    """64-bit hash of each word, remembered while the vocabulary seen so far is small."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(values: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def window_hashes(words: np.ndarray, width: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of ``width`` word hashes, by doubling; empty for shorter texts."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    base = np.uint64(seed | 1)
    power, factor = words, base
    done, total, span = None, 0, 1
    with np.errstate(over="ignore"):
        while True:
            if width & span:
                if done is None:
                    done, total = power, span
                else:
                    keep = len(words) - total - span + 1
                    done = mixed(done[:keep] * factor + power[total : total + keep])
                    total += span
            if total == width:
                return done if width > 1 else mixed(done)
            keep = len(words) - 2 * span + 1
            power = mixed(power[:keep] * factor + power[span : span + keep])
            span *= 2
            factor = factor * np.uint64(3)


def hash_share(column: Column, share: float) -> Column:
    """True for about ``share`` of the values, chosen by their hash alike on every run."""
    return F.pmod(F.xxhash64(F.lit("share"), column), F.lit(1_000_000)) < int(share * 1_000_000)


def learning_row(doc_id: Column) -> Column:
    """Rows whose labels may be learnt: crc32 of the id as text, modulo 3, is not 1."""
    return ~held_out(doc_id)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def linked_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Every node points to a smaller or equal one.  A round hooks the parent of one end of each
    edge under the smaller parent of the other and then halves all paths, so chains collapse in
    logarithmically many rounds.  Minima are combined before each shuffle; a hub's rows meet
    others only in joins, which adaptive execution can split.  Each round is checkpointed.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    links = settled(both.where("a <> b").distinct())
    parents = settled(
        links.groupBy(F.col("a").alias("node")).agg(
            F.least(F.first("a"), F.min("b")).alias("root")
        )
    )
    while True:
        near = (
            links.join(parents.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        seen = parents.join(near, "node").select(
            "node", "root", F.least("root", "near").alias("low")
        )
        hooks = seen.where("low < root").groupBy(F.col("root").alias("node")).agg(
            F.min("low").alias("hook")
        )
        lowered = seen.join(hooks, "node", "left").select(
            "node", F.least("low", F.coalesce("hook", "low")).alias("root")
        )
        lowered = settled(lowered)
        above = lowered.select(F.col("node").alias("root"), F.col("root").alias("top"))
        after = settled(lowered.join(above, "root").select("node", F.col("top").alias("root")))
        changed = after.join(
            parents.withColumnRenamed("root", "before"), "node"
        ).where("root <> before").limit(1).count()
        parents = after
        if not changed:
            return parents
