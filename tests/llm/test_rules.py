import re
from collections import Counter

from knownat.llm import rules
from knownat.llm.common import WordHashes

WORD = r"[^\x20\x09-\x0D]+"


def told(text):
    text = text or ""
    words = re.findall(WORD, text)
    runs = list(zip(words, words[1:], words[2:], strict=False))
    times, covered, seen, repeated = Counter(runs), set(), set(), 0
    for i, run in enumerate(runs):
        if times[run] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if re.search(WORD, line):
            repeated += line in seen
            seen.add(line)
    counts = (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated,
        len(covered),
    )
    return *counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


def kept(text):
    measures = rules.Measures((text or "").encode(), WordHashes())
    return not (measures.base_failed or any(r(measures) for r in rules.RULES.values()))


def test_counts_and_verdicts(odd):
    got = sorted((tuple(r) for r in rules.judge_documents(odd).collect()), key=repr)
    wanted = [(r.doc_id, *told(r.text), kept(r.text)) for r in odd.collect()]
    assert got == sorted(wanted, key=repr)
    assert any(row[-1] for row in got)


def test_junk_is_rejected_and_prose_kept():
    from .conftest import prose

    clean = prose(8, 90)
    assert kept(clean)
    assert not kept(clean.upper())
    assert not kept(" | ".join(clean.split()))
    assert not kept("\n".join(["the same line again"] * 30))
    assert not kept("### ".join(clean.split()))


def test_order_is_by_rejections_per_second(spark):
    import time

    docs = spark.createDataFrame([(i, "a b c") for i in range(40)], "doc_id long, text string")

    def slow(measures):
        time.sleep(0.002)
        return True

    asked = {"never": lambda m: False, "slow": slow, "quick": lambda m: True}
    assert rules.order_rules(docs, asked) == ["quick", "slow", "never"]


def test_verdicts_do_not_depend_on_the_order(odd):
    turned = dict(reversed(rules.RULES.items()))
    first = sorted(rules.judge_documents(odd).collect(), key=repr)
    assert first == sorted(rules.judge_documents(odd, turned).collect(), key=repr)


def test_empty_table(nothing):
    assert rules.judge_documents(nothing).count() == 0
