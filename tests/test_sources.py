import json
import zipfile

from pyspark.sql import functions as F

from knownat.sources import documents

CONCEPTS = {
    "revenue": {"preferred_tags": ["Sales", "Revenues"], "statement": "is",
                "period_type": "duration"},
    "total_assets": {"preferred_tags": ["Assets"], "statement": "bs", "period_type": "instant"},
    "assets_again": {"preferred_tags": ["Assets"], "statement": "bs", "period_type": "instant"},
}


def payload():
    seen = {"start": "2020-01-01", "end": "2020-03-31", "val": 5, "accn": "a", "fy": 2020,
            "fp": "Q1", "form": "10-Q", "filed": "2020-05-01"}
    return {
        "cik": 42, "entityName": "X",
        "facts": {"us-gaap": {
            "Revenues": {"units": {"USD": [seen, {**seen, "form": "8-K"}, {**seen, "end": "bad"}],
                                   "EUR": [seen]}},
            "Assets": {"units": {"USD": [{k: v for k, v in seen.items() if k != "start"}]}},
        }},
    }


def test_company_facts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(payload()))
    (tmp_path / "b.json").write_text("{broken")
    docs = documents.read_documents(spark, str(tmp_path))
    rows = documents.company_facts(docs, documents.concept_table(spark, CONCEPTS)).collect()
    assert sorted((r["concept"], r["tag_priority"], r["duration_days"]) for r in rows) == [
        ("assets_again", 0, None), ("revenue", 1, 91), ("total_assets", 0, None)]
    assert {r["cik"] for r in rows} == {"0000000042"}
    assert documents.rejected(docs, documents.FACT_DOCUMENT).count() == 1


def test_archives_and_screening(spark, tmp_path):
    def filer(cik, n, **extra):
        quarters = [f"{2010 + i // 4}-{i % 4 * 3 + 3:02d}-28" for i in range(n)]
        years = [f"{2010 + i}-12-31" for i in range(n // 3)]
        return {"cik": cik, "name": " Acme Co ", "sic": "4911", "entityType": "operating",
                "tickers": ["OT", "AC"], "exchanges": ["OTC", "NYSE"],
                "filings": {"recent": {
                    "form": ["10-Q"] * n + ["10-K"] * len(years),
                    "reportDate": quarters + years, "filingDate": quarters + years}}, **extra}

    path = tmp_path / "bulk.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("CIK0000000001.json", json.dumps(filer(1, 24)))
        z.writestr("CIK0000000002.json", json.dumps(filer(2, 8)))
        z.writestr("CIK0000000003.json", json.dumps(filer(3, 24, entityType="other")))
        z.writestr("CIK0000000004.json", json.dumps(filer(4, 24, name="Acme Trust")))
        z.writestr("CIK0000000005.json", json.dumps(filer(5, 24)))
        z.writestr("CIK0000000006.json", json.dumps(filer(6, 24, sic="1")))
        z.writestr("CIK0000000001-submissions-001.json", "{}")
        z.writestr("sub.txt", "adsh\tcik\nx-1\t7\nx-2\t8\n")
    members = documents.read_archive(spark, str(path), documents.FILER_MEMBER)
    assert members.count() == 6
    rules = [{"codes": [4911], "ranges": [], "sector": "Utilities", "industry": "Electric"}]
    made = {int(r["cik"]): r for r in documents.filer_candidates(
        members, rules, excluded_names=[" trust "], overrides={"0000000005": "NOT_PUBLIC"}
    ).collect()}
    assert {k: r["reason_code"] for k, r in made.items()} == {
        1: "CANDIDATE", 2: "INSUFFICIENT_PRELIMINARY_FILING_HISTORY", 3: "EXCLUDED_ENTITY_TYPE",
        4: "EXCLUDED_ENTITY_TYPE", 5: "NOT_PUBLIC"}
    assert made[1]["ticker"] == "AC" and made[1]["company_name"] == "Acme Co"
    table = documents.read_archived_table(spark, str(path), "sub.txt", "adsh string, cik int")
    assert sorted(map(tuple, table.collect())) == [("x-1", 7), ("x-2", 8)]


def test_series(spark, make):
    text = json.dumps({"observations": [
        {"date": "2020-01-01", "realtime_start": "2020-02-01", "realtime_end": "9999-12-31",
         "value": "."},
        {"date": "2020-02-01", "realtime_start": "2020-03-01", "realtime_end": "9999-12-31",
         "value": "1.5"}]})
    made = documents.series_observations(make([(text,)], "payload string"), F.lit("S")).collect()
    assert [r["value"] for r in made] == [None, 1.5]


def test_payloads_are_parsed_once(spark, make):
    docs = make([(json.dumps(payload()),), ("{broken",), ('{"entityName": "x"}',)], "payload string")
    facts = documents.company_facts(docs, documents.concept_table(spark, CONCEPTS))
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    assert {r["cik"] for r in facts.collect()} == {"0000000042"}
