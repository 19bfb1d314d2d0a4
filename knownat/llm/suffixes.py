"""Passages repeated across documents, found with a sparse suffix array.

Of the suffixes that begin at a text's words only those at minimisers are kept: positions whose
run of ``GRAM`` words has the smallest hash among ``SPARSE`` neighbours.  Every passage of
``LEAST`` words holds a kept position within its first ``SPARSE`` words, chosen by its content
alone, so two equal passages keep suffixes that agree for ``LEAST - SPARSE + 1`` words at least.
Suffixes are sorted by a hash of those words over the whole corpus and compared with their
neighbours; those that agree with one of another text are extended to the left and right: each
window of ``LEAST`` words whose minimiser is such a suffix is looked for in other texts, and
windows that follow each other make up the maximal repeated passages.  Equal texts are one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knownat.llm.common import WORD, WordHashes, prepare, raw_texts, settled, window_hashes, written

LEAST = 50
SPARSE = 26
GRAM = 5
_SECOND = 0xD6E8FEB86659FD93


def _slide(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Minimum or maximum over every run of ``width`` values, by doubling."""
    done, span = values, 1
    while 2 * span <= width:
        done = pick(done[:-span], done[span:])
        span *= 2
    if span < width:
        done = pick(done[: len(values) - width + 1], done[width - span :])
    return done


def minimisers(words: np.ndarray, least: int, sparse: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, least gram hash of each window of ``least`` words, kept positions)."""
    grams = window_hashes(words, GRAM)
    lowest = _slide(grams[: len(words) - least + sparse], sparse, np.minimum)
    edge = np.zeros(sparse - 1, np.uint64)
    around = _slide(np.concatenate([edge, lowest, edge]), sparse, np.maximum)
    return grams, lowest, np.flatnonzero(grams[: len(around)] == around)


def _words(text: bytes, hashes: WordHashes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def sparse_suffixes(texts: DataFrame, least: int, sparse: int) -> DataFrame:
    """(seed, text_key, at) of each kept suffix of rows (text_key, text)."""
    reach = least - sparse + 1

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            seeds, owners, places = [], [], []
            for owner, text in enumerate(raw_texts(batch.column(1))):
                words = _words(text, hashes)
                if len(words) < least:
                    continue
                _, _, kept = minimisers(words, least, sparse)
                seeds.append(window_hashes(words, reach)[kept])
                owners.append(np.full(len(kept), owner))
                places.append(kept.astype(np.int32))
            if seeds:
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate(seeds).view(np.int64)),
                        batch.column(0).take(pa.array(np.concatenate(owners))),
                        pa.array(np.concatenate(places)),
                    ],
                    ["seed", "text_key", "at"],
                )

    return texts.mapInArrow(keep, "seed long, text_key long, at int")


def neighbouring(suffixes: DataFrame) -> DataFrame:
    """Suffixes whose seed another text holds too: (text_key, at).

    Sorted neighbours are compared within a task.  A run of equal seeds at either end of a
    task's range may go on in the next range, so it is kept; the windows decide later.
    """
    order = ["seed", "text_key", "at"]
    parallel = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = suffixes.repartitionByRange(parallel, *order).sortWithinPartitions(*order)

    def kept(rows: list[np.ndarray], runs: np.ndarray, wanted: np.ndarray) -> pa.RecordBatch:
        chosen = np.repeat(wanted, np.diff(runs))
        return pa.record_batch(
            [pa.array(rows[1][: runs[-1]][chosen]), pa.array(rows[2][: runs[-1]][chosen])],
            ["text_key", "at"],
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
        at_edge = True
        for batch in batches:  # the run at the end of what was read waits for its end
            new = [batch.column(i).to_numpy() for i in range(3)]
            rows = [np.concatenate(both) for both in zip(held, new, strict=True)]
            seed, key = rows[:2]
            runs = np.concatenate([[0], np.flatnonzero(seed[1:] != seed[:-1]) + 1])
            wanted = key[runs[:-1]] != key[runs[1:] - 1]
            if len(wanted):
                wanted[0] |= at_edge
                at_edge = False
                yield kept(rows, runs, wanted)
            held = [column[runs[-1] :] for column in rows]
        yield kept(held, np.array([0, len(held[0])]), np.array([True]))

    return ranged.mapInArrow(compare, "text_key long, at int")


def _windows(marked: DataFrame, least: int, sparse: int) -> DataFrame:
    """(high, low, text_key, first_id, starts): windows whose minimiser is marked, once per text.

    Rows are (text_key, first_id, marks, text); two hashes name a window's words.  A text that
    repeats a window in itself lists all its starts in one row.
    """

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            marks = batch.column(2).to_pylist()
            for row, text in enumerate(raw_texts(batch.column(3))):
                words = _words(text, hashes)
                grams, lowest, _ = minimisers(words, least, sparse)
                wanted = np.full(len(lowest) + sparse - 1, np.iinfo(np.uint64).max, np.uint64)
                wanted[marks[row]] = grams[marks[row]]
                starts = np.flatnonzero(_slide(wanted, sparse, np.minimum) == lowest)
                if not len(starts):
                    continue
                high = window_hashes(words, least)[starts].view(np.int64)
                low = window_hashes(words, least, _SECOND)[starts].view(np.int64) >> 32
                order = np.lexsort((starts, low, high))
                starts, high, low = starts[order], high[order], low[order]
                new = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
                first = np.concatenate([[0], np.flatnonzero(new) + 1])
                ends = np.append(first, len(starts)).astype(np.int32)
                yield pa.record_batch(
                    [
                        pa.array(high[first]),
                        pa.array(low[first].astype(np.int32)),
                        batch.column(0).take(pa.array(np.full(len(first), row))),
                        batch.column(1).take(pa.array(np.full(len(first), row))),
                        pa.ListArray.from_arrays(ends, starts.astype(np.int32)),
                    ],
                    ["high", "low", "text_key", "first_id", "starts"],
                )

    return marked.mapInArrow(
        extend, "high long, low int, text_key long, first_id long, starts array<int>"
    )


def repeated_passages(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    least: int = LEAST,
    sparse: int = SPARSE,
) -> DataFrame:
    """(doc_id, start_word, n_words, first_doc_id, parts): maximal spans whose every
    ``least``-word window occurs in another text as well.

    ``parts`` cuts a span where the smallest holder of its windows changes: (start_word, n_words,
    first_doc_id) each, overlapping by a window less one word; ``first_doc_id`` is the smallest
    of them.  A caller keeps a part whose first id is its own and may cut it elsewhere.  A text
    that several ids hold also gives its whole length as one span, next to those it shares with
    other texts, so no link is lost between copies and a third text.  Words are runs without
    ASCII white space, compared as written.  Null, empty and shorter texts give no row, nor do
    passages repeated only inside one text.  Repeated rows of one id and text count once and
    give their spans once; rows without an id join in, under a null id.  Texts of any length are
    read whole.  An empty table gives no rows; other columns are not read.
    """
    if not GRAM <= least - sparse + 1:
        raise ValueError("a passage must reach a gram beyond its sparse positions")
    prepare(docs.sparkSession)
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")
    ).where(F.col("text").isNotNull()).withColumn("text_key", F.xxhash64("text"))
    suffixes = written(
        sparse_suffixes(rows.select("text_key", "text"), least, sparse), "suffixes"
    )
    marks = neighbouring(suffixes).groupBy("text_key").agg(
        F.collect_set("at").alias("marks")  # no more than a text's words
    )
    ids = settled(
        rows.select("doc_id", "text_key", (F.regexp_count("text", F.lit(WORD))).alias("size"))
        .groupBy("text_key", "doc_id").agg(F.first("size").alias("size"))
    )
    texts = settled(
        ids.groupBy("text_key").agg(
            F.min("doc_id").alias("first_id"),
            F.count(F.lit(1)).alias("holders"),
            F.first("size").alias("size"),
        )
    )
    asked = marks.join(texts.select("text_key", "first_id"), "text_key").withColumnRenamed(
        "text_key", "key"
    )
    one = rows.join(
        asked,
        (rows["text_key"] == asked["key"]) & rows["doc_id"].eqNullSafe(asked["first_id"]),
    ).select("text_key", "first_id", "marks", "text")
    windows = written(_windows(one, least, sparse), "windows")
    shared = windows.groupBy("high", "low").agg(
        F.min("text_key").alias("least_key"),
        F.max("text_key").alias("most_key"),
        F.min("first_id").alias("keeper"),
    ).where("least_key <> most_key").select("high", "low", "keeper")
    found = (
        windows.join(shared, ["high", "low"])
        .select("text_key", F.explode("starts").alias("start"), "keeper")
        .distinct()
    )
    along = Window.partitionBy("text_key").orderBy("start")  # a text's windows
    apart = F.coalesce(F.col("start") > F.lag("start").over(along) + 1, F.lit(True))
    other = apart | ~F.col("keeper").eqNullSafe(F.lag("keeper").over(along))
    numbered = found.withColumns(
        {"apart": apart.cast("int"), "other": other.cast("int")}
    ).withColumns({"span": F.sum("apart").over(along), "part": F.sum("other").over(along)})
    words = (F.max("start") - F.min("start") + least).alias("n_words")
    parts = numbered.groupBy("text_key", "span", "part").agg(
        F.min("start").alias("start_word"), words, F.first("keeper").alias("first_doc_id")
    )
    last = F.max(F.col("start_word") + F.col("n_words"))
    spans = parts.groupBy("text_key", "span").agg(
        F.min("start_word").alias("start_word"),
        (last - F.min("start_word")).alias("n_words"),
        F.min("first_doc_id").alias("first_doc_id"),
        F.sort_array(F.collect_list(F.struct("start_word", "n_words", "first_doc_id"))).alias("parts"),
    ).drop("span")
    whole = texts.where((F.col("holders") > 1) & (F.col("size") >= least)).select(
        "text_key", F.lit(0).alias("start_word"), F.col("size").alias("n_words"),
        F.col("first_id").alias("first_doc_id"),
    )
    spans = settled(spans.select("text_key", "start_word", "n_words", "first_doc_id", "parts"))
    place = ["text_key", "start_word", "n_words"]
    whole = whole.join(spans.select(*place), place, "left_anti")
    part = F.array(F.struct("start_word", "n_words", "first_doc_id")).alias("parts")
    both = whole.select("*", part).union(spans)
    return ids.select("doc_id", "text_key").join(both, "text_key").drop("text_key")
