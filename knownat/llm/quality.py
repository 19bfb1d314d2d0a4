"""Quality classifier on pooled random-indexing vectors.

Every token has a sparse random index vector drawn from its hash; a token's context vector is the
sum of the index vectors around it over the whole corpus.  Tokens share 2**14 hashed rows, which
bounds the table (8 MB) that is summed by Spark, read by the driver and sent to the tasks.  A
document is the weighted mean of its tokens' context vectors, next to a few pooled measures of
length and repetition.  A two-layer network is trained in numpy on a bounded sample of labelled
rows, and a temperature fitted on rows kept aside calibrates its probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.llm.common import (
    WordHashes,
    hash_share,
    held_out,
    learning_row,
    prepare,
    raw_texts,
    text_groups,
)

BUCKETS = 1 << 14
WIDTH = 64
REACH = 2
#: Labelled rows that the network may learn from, about; more are thinned by a hash of the id.
LEARNING_ROWS = 12_000
HIDDEN = 32
EPOCHS = 40
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\x20\x09-\x0D0-9A-Za-z\x80-\xff]+")
_COMMON = 1e-3


def _tokens(texts: list[bytes], hashes: WordHashes) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Tokens of each text, all their hashes, and the text each belongs to."""
    tokens = [_TOKEN.findall(t) for t in texts]
    counts = [len(t) for t in tokens]
    flat = np.fromiter((hashes[w] for t in tokens for w in t), np.uint64, sum(counts))
    return tokens, flat, np.repeat(np.arange(len(texts)), counts)


def context_vectors(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(bucket, n, vector): summed neighbour index vectors of all tokens of each bucket.

    Each index vector has two entries of plus or minus one, so the sums are whole numbers and do
    not depend on the order of tasks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        sums = np.zeros(BUCKETS * WIDTH)
        seen = np.zeros(BUCKETS, np.int64)
        for texts in chain.from_iterable(text_groups(raw_texts(b.column(0))) for b in batches):
            _, flat, owner = _tokens(texts, hashes)
            bucket = (flat & np.uint64(BUCKETS - 1)).astype(np.int64)
            seen += np.bincount(bucket, minlength=BUCKETS)
            cells, signs = [], []
            for shift in (20, 34):
                place = ((flat >> np.uint64(shift)) & np.uint64(WIDTH - 1)).astype(np.int64)
                sign = ((flat >> np.uint64(shift + 8)) & np.uint64(1)).astype(np.int8) * 2 - 1
                for away in range(1, REACH + 1):
                    both = owner[away:] == owner[:-away]
                    for here, there in (
                        (slice(None, -away), slice(away, None)),
                        (slice(away, None), slice(None, -away)),
                    ):
                        cells.append((bucket[here] * WIDTH + place[there])[both])
                        signs.append(sign[there][both])
            if len(flat):
                sums += np.bincount(
                    np.concatenate(cells), np.concatenate(signs), minlength=BUCKETS * WIDTH
                )
        held = np.flatnonzero(seen)
        vectors = sums.reshape(BUCKETS, WIDTH)[held].astype(np.float32)
        for start in range(0, len(held), 2048):
            part = slice(start, start + 2048)
            yield pa.record_batch(
                [
                    pa.array(held[part], pa.int32()),
                    pa.array(seen[held[part]]),
                    pa.array(list(vectors[part]), pa.list_(pa.float32())),
                ],
                ["bucket", "n", "vector"],
            )

    partial = docs.select(text_column).mapInArrow(count, "bucket int, n long, vector array<float>")
    return partial.groupBy("bucket").agg(
        F.sum("n").alias("n"),
        F.array(*[F.sum(F.col("vector")[i].cast("double")) for i in range(WIDTH)]).alias("vector"),
    )


@dataclass
class WordVectors:
    vectors: np.ndarray
    weights: np.ndarray

    @classmethod
    def read(cls, contexts: DataFrame) -> WordVectors:
        """Unit context vectors and smooth inverse frequency weights, a row per bucket."""
        vectors, counts = np.zeros((BUCKETS, WIDTH)), np.zeros(BUCKETS)
        for row in contexts.collect():  # BUCKETS rows at most
            vectors[row.bucket], counts[row.bucket] = row.vector, row.n
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        share = counts / max(counts.sum(), 1)
        return cls(vectors.astype(np.float32), (_COMMON / (_COMMON + share)).astype(np.float32))

    def pool(self, texts: list[bytes], hashes: WordHashes) -> np.ndarray:
        """Feature rows of the texts; an empty text has zeros."""
        return np.concatenate([self._pool(group, hashes) for group in text_groups(texts)])

    def _pool(self, texts: list[bytes], hashes: WordHashes) -> np.ndarray:
        tokens, flat, owner = _tokens(texts, hashes)
        counts = np.bincount(owner, minlength=len(texts))
        full = np.flatnonzero(counts)
        out = np.zeros((len(texts), WIDTH + 5), np.float32)
        if len(full):
            bucket = (flat & np.uint64(BUCKETS - 1)).astype(np.int64)
            starts = (np.cumsum(counts) - counts)[full]
            for at, (start, size) in enumerate(zip(starts, counts[full], strict=True)):
                mine, times = np.unique(bucket[start : start + size], return_counts=True)
                weight = self.weights[mine] * times
                out[full[at], :WIDTH] = weight @ self.vectors[mine] / max(weight.sum(), 1e-9)
        for at in full:
            mine = tokens[at]
            size = len(mine)
            out[at, WIDTH:] = (
                np.log1p(size),
                len(set(mine)) / size,
                sum(a == b for a, b in zip(mine, mine[1:], strict=False)) / size,
                sum(map(len, mine)) / size / 10,
                np.linalg.norm(out[at, :WIDTH]),
            )
        return out


@dataclass
class Network:
    """Standardised inputs, one hidden layer of rectifiers, a logit and its temperature."""

    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, rows: np.ndarray) -> np.ndarray:
        first, bias, second, base = self.layers
        hidden = np.maximum((rows - self.mean) / self.spread @ first + bias, 0)
        return hidden @ second + base[0]

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows) / self.temperature, -30, 30)))

    @classmethod
    def constant(cls, width: int, share: float) -> Network:
        base = np.log(share / (1 - share))
        return cls(
            np.zeros(width), np.ones(width),
            [np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.array([base])],
        )

    @classmethod
    def fit(cls, rows: np.ndarray, labels: np.ndarray, aside: np.ndarray) -> Network:
        """Adam on mini-batches of the rows not set aside; temperature by the rows aside."""
        width = rows.shape[1]
        learn = ~aside
        if len(np.unique(labels[learn])) < 2:
            return cls.constant(width, float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)))
        draw = np.random.default_rng(7)
        mean, spread = rows[learn].mean(axis=0), rows[learn].std(axis=0) + 1e-6
        layers = [
            draw.normal(0, np.sqrt(2 / width), (width, HIDDEN)), np.zeros(HIDDEN),
            draw.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1),
        ]
        model = cls(mean, spread, layers)
        x, y = (rows[learn] - mean) / spread, labels[learn].astype(float)
        first_moment = [np.zeros_like(w) for w in layers]
        second_moment = [np.zeros_like(w) for w in layers]
        step = 0
        for _ in range(EPOCHS):
            order = draw.permutation(len(x))
            for start in range(0, len(x), 256):
                at = order[start : start + 256]
                step += 1
                raw = x[at] @ layers[0] + layers[1]
                hidden = np.maximum(raw, 0)
                out = 1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3], -30, 30)))
                error = (out - y[at]) / len(at)
                back = np.outer(error, layers[2]) * (raw > 0)
                slopes = [
                    x[at].T @ back + 1e-4 * layers[0], back.sum(axis=0),
                    hidden.T @ error + 1e-4 * layers[2], np.array([error.sum()]),
                ]
                for i, slope in enumerate(slopes):
                    first_moment[i] = 0.9 * first_moment[i] + 0.1 * slope
                    second_moment[i] = 0.999 * second_moment[i] + 0.001 * slope**2
                    layers[i] -= (
                        3e-3 * (first_moment[i] / (1 - 0.9**step))
                        / (np.sqrt(second_moment[i] / (1 - 0.999**step)) + 1e-8)
                    )
        if aside.any():
            logits, truth = model.logits(rows[aside]), labels[aside]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            losses = [np.mean(np.logaddexp(0, np.where(truth == 1, -1, 1) * logits / t)) for t in grid]
            model.temperature = float(grid[int(np.argmin(losses))])
        return model


def learn_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    corpus: DataFrame | None = None,
) -> tuple[WordVectors, Network]:
    """Word vectors of all of ``corpus`` (default ``docs``) and a network fitted on labelled rows.

    Only rows whose crc32 of the id modulo 3 is not 1 lend their label, about ``LEARNING_ROWS``
    of them, chosen by a hash of the id; one in five of those only calibrates.  Ids labelled
    more than once take the mean label, null labels none.
    """
    spark = prepare(docs.sparkSession)
    words = WordVectors.read(context_vectors(docs if corpus is None else corpus, text_column))
    marked = (
        labels.where(F.col(label_column).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("__id"))
        .agg((F.avg(label_column) >= 0.5).cast("int").alias("__label"))
        .where(learning_row(F.col("__id")))
    )
    share = min(1.0, LEARNING_ROWS / max(marked.count(), 1))
    chosen = marked.where(hash_share(F.col("__id"), share))
    texts = docs.select(
        F.col(id_column).cast("long").alias("__id"), F.col(text_column).alias("__text")
    ).join(chosen, "__id").select("__id", "__label", "__text")
    shared = spark.sparkContext.broadcast(words)
    sample = texts.mapInArrow(
        lambda batches: _pooled(batches, shared), "id long, label int, features array<float>"
    ).toPandas()  # about LEARNING_ROWS feature rows
    sample = sample.sort_values(["id", "label"], kind="stable")
    rows = np.array(sample.features.tolist(), np.float64).reshape(len(sample), WIDTH + 5)
    ids = sample.id.to_numpy(np.int64)
    return words, Network.fit(rows, sample.label.to_numpy(np.int64), ids % 5 == 0)


def _pooled(batches: Iterator[pa.RecordBatch], words) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        rows = words.value.pool(raw_texts(batch.column(2)), hashes)
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(list(rows), pa.list_(pa.float32()))],
            ["id", "label", "features"],
        )


def score_quality(
    docs: DataFrame, words: WordVectors, network: Network,
    *, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``.

    Null and empty texts are scored like any other (their features are zero).  A null id counts
    as not held out.  Labels, language, source and id are not inputs.  Without labels of both
    kinds every score is their share (0.5 without labels).
    """
    spark = prepare(docs.sparkSession)
    model = spark.sparkContext.broadcast((words, network))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        words, network = model.value
        for batch in batches:
            rows = words.pool(raw_texts(batch.column(1)), hashes)
            yield pa.record_batch(
                [batch.column(0), pa.array(network.probabilities(rows), pa.float64())],
                ["doc_id", "score"],
            )

    rows = docs.select(F.col(id_column).cast("long"), F.col(text_column))
    return rows.mapInArrow(score, "doc_id long, score double").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Rows of ``docs`` that the classifier predicts to be good, unmoved and with all columns."""
    spark = prepare(docs.sparkSession)
    words, network = learn_quality(docs, labels, id_column=id_column, text_column=text_column)
    model = spark.sparkContext.broadcast((words, network))
    at = docs.columns.index(text_column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        words, network = model.value
        for batch in batches:
            scores = network.probabilities(words.pool(raw_texts(batch.column(at)), hashes))
            yield batch.filter(pa.array(scores >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
