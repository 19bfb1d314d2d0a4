"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Words and word beginnings that go with toxicity are mined from all labelled rows that may be
learnt from, one of each group of near copies, by their likelihood ratio.  They make up lexicon voters; pattern
voters watch shouting, symbols and stressed punctuation.  The votes of all documents are counted
by vote pattern (``2**VOTERS`` at most), and expectation maximisation on those counts estimates
the class balance, each voter's rate in either class and the correlations that remain between
voters given the class, which discount voters that repeat one another.  Rows whose label may be
learnt keep it.  A logistic model over single lexicon entries is trained on the posterior labels
of a bounded sample.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.llm.common import (
    hash_share,
    held_out,
    learning_row,
    prepare,
    raw_texts,
    settled,
)

#: Labelled rows that the classifier is fitted on, and further rows by posterior alone, about.
LEARNING_ROWS = 20_000
#: Most entries that tasks may be sent; the likelihood-ratio threshold alone chooses them.
LEXICON = 1 << 17
#: Toxic rows that an entry needs: fewer are no evidence.
_LEAST_TOXIC = 3
#: Distinct entries counted in a task's memory before they are handed on.
_COUNTED = 1 << 18
THRESHOLD = 0.7
_KINDS, _SPLIT = 3, 3
PATTERNS = 3
VOTERS = _KINDS * _SPLIT + PATTERNS
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def entries_of(text: bytes) -> set[bytes]:
    """A text's distinct words and word beginnings; the first byte names the kind."""
    words = set(_WORD.findall(text.lower()))
    found = {b"0" + w for w in words}
    found.update(b"1" + w[:5] for w in words if len(w) > 5)
    found.update(b"2" + w[:4] for w in words if len(w) > 4)
    return found


def patterns_of(text: bytes) -> int:
    """Bits of the pattern voters: shouting, symbols, stressed punctuation."""
    size = max(len(text), 1)
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>@"))
    return (5 * upper > size) | (20 * symbols > size) << 1 | (text.count(b"!!") > 2) << 2


def _copy_key(text: bytes) -> int:
    """Smallest shingle hash; near copies nearly always share it."""
    words = text.lower().split()
    runs = zip(words, words[1:], words[2:], strict=False)
    return min((xxhash.xxh64_intdigest(b" ".join(r)) for r in runs), default=0) >> 1


@dataclass
class Lexicon:
    """Entries with the voter each belongs to."""

    entries: list[bytes]

    def __post_init__(self) -> None:
        self.at = {entry: i for i, entry in enumerate(self.entries)}
        self.voter = [
            int(e[:1]) * _SPLIT + xxhash.xxh64_intdigest(e) % _SPLIT for e in self.entries
        ]

    def hits(self, text: bytes) -> list[int]:
        known = self.at
        return sorted(known[e] for e in entries_of(text) & known.keys())

    def votes(self, hits: list[int], patterns: int) -> int:
        code = patterns << _KINDS * _SPLIT
        for hit in hits:
            code |= 1 << self.voter[hit]
        return code


def _marked(labels: DataFrame, label_column: str) -> DataFrame:
    return (
        labels.where(F.col(label_column).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("__id"))
        .agg((F.avg(label_column) >= 0.5).cast("int").alias("label"))
        .where(learning_row(F.col("__id")))
    )


def _labelled_texts(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """(label, text, first) of the labelled rows; one of the near copies of a label is ``first``.

    Keys and labels meet on narrow rows; then the texts move once, by one kind of join at every
    size.  An id that several rows hold brings all of them.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_copy_key(t) for t in raw_texts(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(keys, pa.int64())], ["__id", "key"])

    learnable = rows.where(F.col("__id").isNotNull() & learning_row(F.col("__id")))
    keys = learnable.mapInArrow(keyed, "__id long, key long")
    met = settled(keys.join(marked, "__id"))
    chosen = met.groupBy("key", "label").agg(F.min("__id").alias("__id")).select("__id").distinct()
    ids = met.select("__id", "label").distinct().join(
        chosen.withColumn("first", F.lit(True)), "__id", "left"
    )
    flagged = settled(ids.select("__id", "label", F.coalesce("first", F.lit(False)).alias("first")))
    return learnable.join(flagged.hint("merge"), "__id").select("label", "text", "first")


def mine_lexicon(texts: DataFrame) -> Lexicon:
    """Entries of labelled texts (label, text, first) that go with label 1 beyond chance.

    Near copies count once, by the ``first`` of them.  Counts of a bounded number of entries leave a task at a time.  More entries than the tasks
    may hold are an error, never dropped.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = defaultdict(lambda: [0, 0])

        def handed_on() -> Iterator[pa.RecordBatch]:
            names, counts = list(seen), list(seen.values())
            for start in range(0, len(names), 1 << 16):
                part = slice(start, start + (1 << 16))
                yield pa.record_batch(
                    [
                        pa.array(names[part], pa.binary()),
                        pa.array([c[0] for c in counts[part]], pa.int64()),
                        pa.array([c[1] for c in counts[part]], pa.int64()),
                    ],
                    ["entry", "clean", "toxic"],
                )
            seen.clear()

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                seen[b""][label] += 1
                for entry in entries_of(text):
                    seen[entry][label] += 1
                if len(seen) >= _COUNTED:
                    yield from handed_on()
        yield from handed_on()

    counts = settled(
        texts.where("first").select("label", "text").mapInArrow(counted, "entry binary, clean long, toxic long")
        .groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where((F.col("toxic") >= _LEAST_TOXIC) | (F.col("entry") == F.lit(b"")))
    )
    total = counts.where("entry = X''").first()
    if total is None or not total.toxic or not total.clean:
        return Lexicon([])
    share = total.toxic / (total.toxic + total.clean)
    least = 2 * np.log(counts.count()) + 2  # so many entries are tried; chance should name none
    seen = F.col("toxic") + F.col("clean")

    def part(count, expected):
        return F.when(count > 0, count * F.log(count / expected)).otherwise(0.0)

    ratio = 2 * (part(F.col("toxic"), seen * share) + part(F.col("clean"), seen * (1 - share)))
    best = (
        counts.where("entry <> X''")
        .where((F.col("toxic") > 4 * share * seen) & (ratio >= float(least)))
        .orderBy(ratio.desc(), "entry").select("entry")
    )
    entries = best.limit(LEXICON + 1).collect()
    if len(entries) > LEXICON:
        raise ValueError(f"more than {LEXICON} entries pass the threshold; raise LEXICON")
    return Lexicon([bytes(r.entry) for r in entries])


@dataclass
class LabelModel:
    """Class balance, voter rates per class and the weight that correlation leaves each voter."""

    balance: float
    rates: np.ndarray
    correlations: np.ndarray
    weights: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        fired = np.log(self.rates[1] / self.rates[0])
        silent = np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        score = np.log(self.balance / (1 - self.balance)) + (
            votes * fired + (1 - votes) * silent
        ) @ self.weights
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))

    @classmethod
    def fit(cls, votes: np.ndarray, known: np.ndarray, count: np.ndarray) -> LabelModel:
        """From distinct vote patterns, the known label (or -1) and rows of each."""
        voters = votes.shape[1]
        likely = np.where(known >= 0, known, votes[:, : _KINDS * _SPLIT].max(axis=1) * 0.8)
        model = None
        for _ in range(50):
            mass = np.stack([count * (1 - likely), count * likely])
            total = mass.sum(axis=1) + 2
            balance = float(np.clip(total[1] / total.sum(), 1e-3, 0.5))
            rates = np.clip((mass @ votes + 0.01) / (total[:, None] + 0.02), 1e-6, 1 - 1e-6)
            correlations = np.zeros((2, voters, voters))
            for y in range(2):
                apart = votes - rates[y]
                joint = (apart * mass[y][:, None]).T @ apart / total[y]
                spread = np.sqrt(np.maximum(np.diag(joint), 1e-12))
                correlations[y] = joint / np.outer(spread, spread)
            shared = np.clip(correlations.mean(axis=0), 0, 1)
            np.fill_diagonal(shared, 0)
            model = cls(balance, rates, correlations, 1 / (1 + shared.sum(axis=1)))
            now = np.where(known >= 0, known, model.posterior(votes))
            moved = float(np.abs(now - likely).max(initial=0))
            likely = now
            if moved < 1e-6:
                break
        return model


@dataclass
class Linear:
    weights: np.ndarray
    base: float

    def probability(self, hits: list[int], patterns: int) -> float:
        at = [*hits, *(len(self.weights) - PATTERNS + i for i in range(PATTERNS) if patterns >> i & 1)]
        score = self.base + self.weights[at].sum() if at else self.base
        return float(1 / (1 + np.exp(-np.clip(score, -30, 30))))

    @classmethod
    def fit(
        cls, rows: list[list[int]], target: np.ndarray, sure: np.ndarray, width: int
    ) -> Linear:
        """Penalised logistic loss on soft targets by Adam over the whole bounded sample.

        ``sure`` weighs the rows: a posterior near one half says little.
        """
        weights, base = np.zeros(width), -2.0
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        flat = np.fromiter((i for r in rows for i in r), np.int64, len(owner))
        moments = [np.zeros(width + 1), np.zeros(width + 1)]
        mass = max(float(sure.sum()), 1e-9)
        for step in range(1, 801 if len(rows) else 1):
            score = base + np.bincount(owner, weights[flat], minlength=len(rows))
            error = sure * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - target) / mass
            slope = np.append(
                np.bincount(flat, error[owner], minlength=width) + 1e-6 * weights, error.sum()
            )
            moments[0] = 0.9 * moments[0] + 0.1 * slope
            moments[1] = 0.999 * moments[1] + 0.001 * slope**2
            move = 0.1 * (moments[0] / (1 - 0.9**step)) / (
                np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-10
            )
            weights, base = weights - move[:-1], base - move[-1]
        return cls(weights, float(base))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, held_out, score, predicted, votes), one row per row of ``docs``.

    Labels are learnt only from rows whose crc32 of the id modulo 3 is not 1; ids labelled more
    than once take the mean label, null labels none.  Null and empty texts hit nothing and score
    the model's base.  Repeated rows are scored each; a null id counts as not held out.  Without
    labels of both kinds no lexicon can be mined and only pattern votes count.  Labels, language,
    source and id are not inputs.  Other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    marked = settled(_marked(labels, label_column))
    share = min(1.0, LEARNING_ROWS / max(marked.count(), 1))
    rows = docs.select(
        F.col(id_column).cast("long").alias("__id"), F.col(text_column).alias("text")
    )
    lexicon = mine_lexicon(_labelled_texts(rows, marked))
    shared = spark.sparkContext.broadcast(lexicon)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in batches:
            texts = raw_texts(batch.column(1))
            hits = [lexicon.hits(t) for t in texts]
            votes = [lexicon.votes(h, patterns_of(t)) for h, t in zip(hits, texts, strict=True)]
            yield pa.record_batch(
                [batch.column(0), pa.array(hits, pa.list_(pa.int32())), pa.array(votes, pa.int32())],
                ["doc_id", "hits", "votes"],
            )

    voted = settled(rows.mapInArrow(vote, "doc_id long, hits array<int>, votes int"))
    known = voted.join(marked.withColumnRenamed("__id", "doc_id"), "doc_id", "left")
    patterns = known.groupBy("votes", "label").count().toPandas()  # 3 * 2**VOTERS rows at most
    patterns = patterns.sort_values(["votes", "label"], kind="stable")
    bits = (patterns.votes.to_numpy(np.int64)[:, None] >> np.arange(VOTERS) & 1).astype(float)
    truth = patterns.label.fillna(-1).to_numpy(float)
    model = LabelModel.fit(bits, truth, patterns["count"].to_numpy(float))

    total = max(voted.count(), 1)
    unmarked = hash_share(F.col("doc_id"), min(1.0, LEARNING_ROWS / total))
    learnt = known.where(
        F.when(F.col("label").isNotNull(), hash_share(F.col("doc_id"), share)).otherwise(unmarked)
    ).select("doc_id", "hits", "votes", "label").toPandas()  # about twice LEARNING_ROWS rows
    learnt = learnt.sort_values(["doc_id", "votes"], kind="stable")
    codes = learnt.votes.to_numpy(np.int64)
    posterior = model.posterior((codes[:, None] >> np.arange(VOTERS) & 1).astype(float))
    target = np.where(learnt.label.isna(), posterior, learnt.label.fillna(0).to_numpy(float))
    width = len(lexicon.entries) + PATTERNS
    patterns_at = len(lexicon.entries)
    inputs = [
        [*hits, *(patterns_at + i for i in range(PATTERNS) if code >> (_KINDS * _SPLIT + i) & 1)]
        for hits, code in zip(learnt.hits, codes, strict=True)
    ]
    linear = spark.sparkContext.broadcast(Linear.fit(inputs, target, np.abs(2 * target - 1), width))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = linear.value
        for batch in batches:
            scores = [
                model.probability(hits, code >> _KINDS * _SPLIT)
                for hits, code in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            yield pa.record_batch(
                [batch.column(0), pa.array(scores, pa.float64()), batch.column(2)],
                ["doc_id", "score", "votes"],
            )

    return voted.mapInArrow(score, "doc_id long, score double, votes int").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "votes",
    )
