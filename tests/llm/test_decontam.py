import pytest

from knownat.llm import decontam

from .conftest import prose

ITEMS = "item_id long, text string"


def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def brute(docs, items, threshold=0.8, width=5):
    def shingles(text):
        w = folded(text)
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}

    found = []
    for doc, text in docs:
        held = shingles(text)
        for item, passage in items:
            wanted = shingles(passage)
            shared = len(wanted & held)
            if wanted and shared >= threshold * len(wanted):
                found.append((doc, item, shared, len(wanted)))
    return sorted(found, key=repr)


@pytest.fixture(scope="module")
def items():
    long = prose(3, 30_000).split()
    return [
        (1, " ".join(long[20_000:20_040])), (2, " ".join(long[100:300]).upper()),
        (3, " ".join([*long[5:12], "zz", *long[12:60]])), (4, None), (5, ""), (6, "one two three"),
        (7, prose(5, 60)), (7, prose(5, 60)), (8, prose(77, 40)), (None, prose(2, 90)),
        (9, " ".join(long[:10] + ["q"] * 30)), (10, "la " * 9),
    ]


def test_agrees_with_brute_force(spark, odd, items):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    found = decontam.find_contained(odd, spark.createDataFrame(items, ITEMS))
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == brute(docs, items)
    assert got


def test_passages_cut_anywhere_in_long_texts(spark):
    long = prose(50, 6000).split()
    items = [(i, " ".join(long[i * 53 : i * 53 + 15 + i % 40])) for i in range(100)]
    docs = spark.createDataFrame([(1, " ".join(long))], "doc_id long, text string")
    found = decontam.find_contained(docs, spark.createDataFrame(items, ITEMS))
    assert sorted(r.item_id for r in found.collect()) == list(range(100))


def test_short_items_in_long_texts_agree_with_brute_force():
    long = prose(60, 20_000).split()
    items = [(i, " ".join(long[i * 40 : i * 40 + 5 + i % 9])) for i in range(480)]
    items += [(1000 + i, " ".join([f"w{i}"] * 60)) for i in range(40)]  # one distinct shingle
    for i in range(40):
        long[i * 400 + 39 : i * 400 + 39] = [f"w{i}"] * 5
    text = " ".join(long)
    index = decontam.ItemIndex([(i, t.encode()) for i, t in items], 5)
    got = [(1, *hit) for _, *hit in index.contained([text.encode()], 0.8, decontam.WordHashes())]
    assert sorted(got, key=repr) == brute([(1, text)], items)
    assert len(got) > 400


def test_blocks_of_items_find_the_same(spark, odd, items, monkeypatch):
    table = spark.createDataFrame(items, ITEMS)
    whole = sorted(decontam.find_contained(odd, table).collect(), key=repr)
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 4)
    assert sorted(decontam.find_contained(odd, table).collect(), key=repr) == whole


def test_dropping_keeps_whole_clean_rows(spark, odd, items):
    table = spark.createDataFrame(items, ITEMS)
    kept = decontam.drop_contaminated(odd, table)
    bad = {d for d, *_ in brute([(i, r.text) for i, r in enumerate(odd.collect())], items)}
    wanted = [r for i, r in enumerate(odd.collect()) if i not in bad]
    assert kept.columns == odd.columns
    assert sorted(kept.collect(), key=repr) == sorted(wanted, key=repr)


def test_empty_tables(spark, odd, nothing, items):
    table = spark.createDataFrame(items, ITEMS)
    assert decontam.find_contained(nothing, table).count() == 0
    assert decontam.find_contained(odd, table.limit(0)).count() == 0
    assert decontam.drop_contaminated(odd, table.limit(0)).count() == odd.count()
