"""Nested JSON documents and archives of them, flattened lazily.

A malformed payload parses to nothing but NULLs and is returned by ``rejected`` instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knownat.functions import clean_number, lenient_date, pad_id
from knownat.operators.filings import PERIODIC_FORMS
from knownat.operators.selection import (
    current_listing,
    domestic_filer,
    excluded_name,
    filing_history,
    range_rule_lookup,
    screening_reason,
)
from knownat.sources.archives import archive_members, member_lines, member_payloads

FACT_DOCUMENT = (
    "cik string, entityName string, facts map<string, map<string, struct<units: map<string, "
    "array<struct<`start`: string, `end`: string, val: string, accn: string, fy: string, "
    "fp: string, form: string, filed: string, frame: string>>>>>>"
)
FILER_DOCUMENT = (
    "cik string, name string, sic string, sicDescription string, entityType string, "
    "fiscalYearEnd string, stateOfIncorporation string, tickers array<string>, "
    "exchanges array<string>, filings struct<recent: struct<form: array<string>, "
    "reportDate: array<string>, filingDate: array<string>>>"
)
SERIES_DOCUMENT = (
    "observations array<struct<realtime_start: string, realtime_end: string, `date`: string, "
    "value: string>>"
)
FILER_MEMBER = r"^CIK\d{10}\.json$"
MINIMUM_QUARTERLY, MINIMUM_ANNUAL = 16, 6


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, payload): one row per JSON file."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("payload")
    )


def _parsed(documents: DataFrame, schema: str) -> DataFrame:
    """The fields of each payload, parsed once.

    A filter on a field of a plain column of ``from_json`` is pushed below it and parses again.
    """
    return documents.select(F.inline(F.array(F.from_json("payload", schema))))


def read_archive(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, member, payload): text members of ZIP files whose names match ``pattern``."""
    return member_payloads(archive_members(spark, path, pattern))


def read_archived_table(
    spark: SparkSession, path: str, member: str, schema: str, separator: str = "\t"
) -> DataFrame:
    """Rows of a delimited member (with a header line) of each archive, typed by ``schema``."""
    lines = member_lines(archive_members(spark, path).where(F.col("member") == member))
    kept = lines.where((F.col("line") > 0) & (F.length("text") > 0))
    parsed = kept.select(F.from_csv("text", schema, {"sep": separator}).alias("r"))
    return parsed.select("r.*")


def rejected(documents: DataFrame, schema: str, required: str | None = None) -> DataFrame:
    """Payloads that are not readable JSON objects, or whose ``required`` field is empty."""
    parsed = F.from_json(
        "payload", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"}
    )
    if required:
        return documents.where(F.coalesce(parsed[required].cast("string"), F.lit("")) == "")
    return documents.where(parsed.isNull() | parsed["__bad"].isNotNull())


def concept_table(spark: SparkSession, concepts: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """(taxonomy_tag, unit, concept, tag_priority, statement, period_type) from configuration."""
    rows = [
        (tag, spec.get("unit", "USD"), name, position, spec["statement"], spec["period_type"])
        for name, spec in concepts.items()
        for position, tag in enumerate(spec["preferred_tags"])
    ]
    return spark.createDataFrame(
        rows,
        "taxonomy_tag string, unit string, concept string, tag_priority int, statement string, "
        "period_type string",
    )


def company_facts(
    documents: DataFrame, concepts: DataFrame, *, taxonomy: str = "us-gaap"
) -> DataFrame:
    """One row per reported observation of a configured tag in its expected unit.

    ``ordinal`` keeps the order of observations inside a payload, the last tie-break when facts
    compete.  The concept list is configuration (a few dozen rows), hence the broadcast.
    """
    parsed = _parsed(documents, FACT_DOCUMENT).where(F.col("cik").isNotNull())
    tags = parsed.select(
        pad_id("cik").alias("cik"),
        F.col("entityName").alias("entity_name"),
        F.explode(F.try_element_at(F.col("facts"), F.lit(taxonomy))).alias(
            "taxonomy_tag", "fact"
        ),
    )
    units = tags.select(
        "cik", "entity_name", "taxonomy_tag", F.explode("fact.units").alias("unit", "seen")
    )
    wanted = units.join(F.broadcast(concepts), ["taxonomy_tag", "unit"])
    rows = wanted.select("*", F.posexplode("seen").alias("ordinal", "o")).where(
        F.col("o.form").isin(*PERIODIC_FORMS)
    )
    start, end = lenient_date("o.start"), lenient_date("o.end")
    flat = rows.select(
        "cik",
        "entity_name",
        "concept",
        "taxonomy_tag",
        "tag_priority",
        "statement",
        "period_type",
        "unit",
        start.alias("start_date"),
        end.alias("end_date"),
        clean_number("o.val").alias("value"),
        F.col("o.accn").alias("accession_number"),
        F.col("o.fy").try_cast("int").alias("fiscal_year"),
        F.col("o.fp").alias("fiscal_period"),
        F.col("o.form").alias("form"),
        lenient_date("o.filed").alias("filed_at"),
        F.col("o.frame").alias("frame"),
        (F.datediff(end, start) + 1).alias("duration_days"),
        "ordinal",
    )
    return flat.na.drop(
        subset=[
            "end_date", "filed_at", "value", "accession_number", "fiscal_year", "fiscal_period",
        ]
    )


def series_observations(documents: DataFrame, series_id: Column) -> DataFrame:
    """Vintage observations of one series per payload; '.' and unreadable values are NULL."""
    parsed = documents.select(
        series_id.alias("series_id"),
        F.explode(F.from_json("payload", SERIES_DOCUMENT)["observations"]).alias("o"),
    )
    return parsed.select(
        "series_id",
        lenient_date("o.date").alias("observation_date"),
        lenient_date("o.realtime_start").alias("realtime_start"),
        lenient_date("o.realtime_end").alias("realtime_end"),
        clean_number("o.value").alias("value"),
    )


def filer_candidates(
    members: DataFrame,
    rules: Sequence[Mapping[str, Any]],
    *,
    excluded_names: Sequence[str] = (),
    overrides: Mapping[str, str] | None = None,
    cutoff: str = "2025-12-31",
) -> DataFrame:
    """Screened issuers with one reason code each, from filer payloads.

    ``rules`` map industry codes to (sector, industry), first rule wins; ``overrides`` map an
    id to its own exclusion reason.
    """
    parsed = _parsed(members, FILER_DOCUMENT).where(F.col("cik").isNotNull())
    recent = "filings.recent"
    named = parsed.select(
        pad_id("cik").alias("cik"),
        F.trim(F.coalesce("name", F.lit(""))).alias("company_name"),
        current_listing("tickers", "exchanges").alias("listing"),
        F.coalesce(F.col("sic").try_cast("int"), F.lit(0)).alias("sic"),
        F.col("sicDescription").alias("sic_description"),
        F.col("fiscalYearEnd").alias("fiscal_year_end"),
        F.col("stateOfIncorporation").alias("state_of_incorporation"),
        F.col("entityType").alias("entity_type"),
        domestic_filer(f"{recent}.form").alias("domestic"),
        filing_history(
            f"{recent}.form", f"{recent}.reportDate", f"{recent}.filingDate", cutoff
        ).alias("h"),
    ).where(F.col("listing").isNotNull())
    mapped = range_rule_lookup(named, "sic", rules, outputs=["sector", "industry"])
    override = F.lit(None).cast("string")
    for identity, reason in (overrides or {}).items():
        override = F.when(F.col("cik") == identity, reason).otherwise(override)
    excluded = (
        ~F.coalesce(F.col("entity_type") == "operating", F.lit(False))
        | ~F.col("domestic")
        | (excluded_name("company_name", excluded_names) if excluded_names else F.lit(False))
    )
    short = (F.col("h.distinct_10q_periods") < MINIMUM_QUARTERLY) | (
        F.col("h.distinct_10k_periods") < MINIMUM_ANNUAL
    )
    reason = screening_reason(override, excluded, short)
    rows = mapped.select(
        "cik",
        "company_name",
        "listing.ticker",
        "listing.exchange",
        "sic",
        "sic_description",
        "sector",
        "industry",
        "fiscal_year_end",
        "state_of_incorporation",
        "h.distinct_10q_periods",
        "h.distinct_10k_periods",
        "h.earliest_periodic_filing",
        (reason == "CANDIDATE").alias("candidate_eligible"),
        reason.alias("reason_code"),
    )
    # One row per id: the first in (sector, industry) order.
    rest = [c for c in rows.columns if c not in ("cik", "sector", "industry")]
    first = rows.groupBy("cik").agg(F.min(F.struct("sector", "industry", *rest)).alias("r"))
    return first.select("cik", "r.*").select(*rows.columns)
