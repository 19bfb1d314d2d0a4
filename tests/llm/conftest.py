"""Small corpora with every awkward row: nulls, empty and long texts, ties, clashing columns."""

import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "size long, target double, position double, shard int, bits long, root long, node long, "
    "label int, votes int, start int, seed long, host string, part int, offset long"
)
EXTRA = (7, 1.5, 0.5, 1, 2, 3, 4, 1, 5, 6, 8, "h", 9, 10)


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    made = ["".join(draw.choices("abdeilmnorstu", k=draw.randint(2, 7))) for _ in range(words)]
    lines = [" ".join(made[i : i + 12]) for i in range(0, words, 12)]
    return "\n".join(lines)


def odd_rows() -> list[tuple]:
    base = prose(1, 120)
    texts = [
        (1, base), (2, base), (3, base.replace(" ", "  ", 3)), (4, base + " tail"),
        (5, prose(2, 90)), (6, ""), (7, None), (8, " \t\n\x0b "), (9, "one"), (10, "one two"),
        (11, prose(3, 30_000)), (12, "ÄÖ ß 日本 語  x"), (None, prose(4, 70)),
        (None, None), (13, prose(5, 60)), (13, prose(5, 60)), (13, prose(6, 60)),
        (14, "AAA BBB ccc"), (15, "aaa bbb CCC"), (16, "la " * 80),
    ]
    sources = ["a", "b", None, "c"]
    return [(i, t, None, sources[n % 4], None, *EXTRA) for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """(doc_id, text): near copies, shared passages and plain texts."""
    draw = random.Random(11)
    passage = prose(900, 70)
    rows = []
    for i in range(120):
        text = prose(i, draw.randint(5, 200))
        if i % 10 == 3:
            words = text.split(" ")
            at = draw.randint(0, len(words))
            text = " ".join([*words[:at], passage, *words[at:]])
        if i % 12 == 5:
            text = prose(i - 5, 150) + f" x{i}"
        rows.append((i, text))
    return rows


@pytest.fixture(scope="session")
def corpus_frame(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(4).cache()
