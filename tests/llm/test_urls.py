import pytest

from knownat.llm import urls

PAGES = "page_id long, url string, html string, rule string, verdict string, n long"


def judged(spark, addresses):
    rows = [(i, u, None, "x", "y", 1) for i, u in enumerate(addresses)]
    found = urls.judge_urls(spark.createDataFrame(rows, PAGES)).collect()
    assert len(found) == len(rows)
    return {r.page_id: r for r in found}


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("https://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/"),
        ("http://example.org/en/1", "example.org", "/en/1", "example.org/en/1"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/"),
        ("http://example.org", "example.org", "", None),
        ("http://x.com/fr/", "x.com", "/fr/", "com/fr/"),
        ("http://x.com/de/9", "x.com", "/de/9", "com/de/"),
        ("http://x.com?q=/fr/", "x.com", "", None),
        ("http://xcom/fr/1", "xcom", "/fr/1", None),
        ("x.com/fr/1", "", "", None),
        ("", "", "", None),
        (None, "", "", None),
        ("a://b://c/d", "b:", "//c/d", None),
    ],
)
def test_host_path_and_rule(spark, url, host, path, rule):
    row = judged(spark, [url])[0]
    assert (row.host, row.path, row.rule) == (host, path, rule)
    if rule:
        assert row.verdict == ("allow" if rule in ("org/", "com/fr/") else "block")


def test_a_branch_takes_the_verdict_of_its_labelled_pages(spark):
    pages = [f"http://a.com/de/x/{i}" for i in range(60)]
    pages += [f"http://a.com/fr/x/{i}" for i in range(40)]
    pages += ["http://a.com/en/x/1", "http://b.net/en/1"]
    rows = judged(spark, pages)
    assert rows[0].template == "/de/*/*"
    assert rows[70].template == "/fr/*/*"
    assert rows[100].template == "/*/*/*"
    smoothed = (40 + 10 * (40 + 1) / 102) / 110
    assert rows[100].purity == pytest.approx(smoothed)
    assert rows[100].verdict == "block"
    assert rows[101].purity == pytest.approx(41 / 102)


def test_many_rare_values_are_one_variable(spark):
    pages = [f"http://a.com/fr/{chr(97 + i % 26)}{chr(97 + i // 26)}/" for i in range(300)]
    rows = judged(spark, pages)
    assert {r.template for r in rows.values()} == {"/*/*"}


def test_without_labels_everything_passes(spark):
    rows = judged(spark, ["http://a.net/x", None, "http://a.net/x", "q"])
    assert {r.verdict for r in rows.values()} == {"allow"}
    assert {r.purity for r in rows.values()} == {0.5}


def test_empty_table(spark):
    assert urls.judge_urls(spark.createDataFrame([], PAGES)).count() == 0
