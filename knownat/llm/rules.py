"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

On a bounded sample every rule is timed and its rejections counted; rules are then asked in
order of rejections per second, and a text that one rule rejects is not shown to the next.  The
order decides how much work is done, never the verdict: a text is kept when no rule rejects it.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.llm.common import WordHashes, hash_share, prepare, raw_texts, window_hashes

LEAST_WORDS = 50
WINDOW = 3
#: Texts, about, on which cost and selectivity of the rules are measured.
SAMPLE_ROWS = 2000
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_LETTERS = re.compile(rb"[A-Za-z\x80-\xff]")
_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Measures:
    """Counts of one text; costly ones are taken when a rule first asks for them."""

    def __init__(self, text: bytes, hashes: WordHashes) -> None:
        self.text, self.hashes = text, hashes

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, _SPACE).decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, _SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.text.split(b"\n") if line.translate(None, _SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        if self.n_words < WINDOW + 1:
            return 0
        known = np.fromiter(map(self.hashes.__getitem__, self.words), np.uint64, self.n_words)
        runs = window_hashes(known, WINDOW)
        _, group, times = np.unique(runs, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(times[group] > 1)
        covered = np.zeros(self.n_words, bool)
        for step in range(WINDOW):
            covered[starts + step] = True
        return int(covered.sum())

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > 50 * self.n_words


def _word_length(m: Measures) -> bool:
    return not 2 * m.n_words <= m.word_chars <= 20 * m.n_words


def _symbols(m: Measures) -> bool:
    return 2 * m.n_symbols > m.n_words


def _repeated_lines(m: Measures) -> bool:
    return 2 * m.n_dup_lines > len(m.lines)


def _letterless(m: Measures) -> bool:
    return 10 * sum(1 for w in m.words if _LETTERS.search(w)) < 7 * m.n_words


def _shouting(m: Measures) -> bool:
    upper = len(m.text) - len(m.text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return 2 * upper > len(m.text)


def _stressed(m: Measures) -> bool:
    return 4 * m.text.count(b"!!") > m.n_words


def _bullets(m: Measures) -> bool:
    marked = sum(1 for line in m.lines if line.lstrip()[:1] in (b"-", b"*"))
    return len(m.lines) > 3 and 10 * marked > 9 * len(m.lines)


#: Rules beyond the base counts: name and whether it rejects.
RULES: dict[str, Callable[[Measures], bool]] = {
    "word_length": _word_length,
    "symbols": _symbols,
    "repeated_lines": _repeated_lines,
    "letterless": _letterless,
    "shouting": _shouting,
    "stressed": _stressed,
    "bullets": _bullets,
}


def order_rules(
    docs: DataFrame, rules: dict[str, Callable[[Measures], bool]] | None = None,
    *, id_column: str = "doc_id", text_column: str = "text", sample_rows: int = SAMPLE_ROWS,
) -> list[str]:
    """Rule names by rejections per second of work on the sample, highest first."""
    rules = RULES if rules is None else rules
    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample = docs.where(hash_share(F.col(id_column), share)).select(text_column)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        rejected, spent = dict.fromkeys(rules, 0), dict.fromkeys(rules, 0.0)
        for batch in batches:
            for text in raw_texts(batch.column(0)):
                for name, rejects in rules.items():
                    fresh = Measures(text, hashes)  # each rule pays for what it reads
                    begun = time.perf_counter()
                    rejected[name] += rejects(fresh)
                    spent[name] += time.perf_counter() - begun
        yield pa.record_batch(
            [
                pa.array(list(rules), pa.string()),
                pa.array([rejected[n] for n in rules], pa.int64()),
                pa.array([spent[n] for n in rules], pa.float64()),
            ],
            ["rule", "rejected", "seconds"],
        )

    totals = (
        sample.mapInArrow(measure, "rule string, rejected long, seconds double")
        .groupBy("rule").agg(F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))
    )
    worth = {r.rule: r.rejected / max(r.seconds, 1e-9) for r in totals.collect()}
    return sorted(rules, key=lambda name: (-worth.get(name, 0.0), name))


def judge_documents(
    docs: DataFrame,
    rules: dict[str, Callable[[Measures], bool]] | None = None,
    *, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    One row per row of ``docs``.  A null or empty text has no words and fails the base counts.
    Repeated rows are judged each; ids may be null.  Other columns are not read.
    """
    prepare(docs.sparkSession)
    rules = RULES if rules is None else rules
    order = order_rules(docs, rules, id_column=id_column, text_column=text_column)
    cascade = [rules[name] for name in order]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows, failed, kept = [], [], []
            for text in raw_texts(batch.column(1)):
                measures = Measures(text, hashes)  # a text's words go before the next is read
                rows.append([getattr(measures, c) for c in _COLUMNS])
                failed.append(measures.base_failed)
                kept.append(
                    not (measures.base_failed or any(rejects(measures) for rejects in cascade))
                )
            counts = [pa.array(column, pa.int64()) for column in zip(*rows, strict=True)]
            counts = counts or [pa.array([], pa.int64())] * len(_COLUMNS)
            yield pa.record_batch(
                [batch.column(0), *counts, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())],
                ["doc_id", *_COLUMNS, "base_failed", "kept"],
            )

    rows = docs.select(F.col(id_column).cast("long"), F.col(text_column))
    fields = ", ".join(f"{c} long" for c in ("doc_id", *_COLUMNS))
    return rows.mapInArrow(judge, f"{fields}, base_failed boolean, kept boolean")
