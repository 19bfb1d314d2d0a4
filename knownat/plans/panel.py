"""Facts to a leakage-checked point-in-time panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.operators.asof import assert_known, vintage_window_aggregate
from knownat.operators.audit import checked_lookup
from knownat.operators.checks import fail_if_duplicated
from knownat.operators.filings import (
    BALANCE_CONCEPTS,
    DURATION_CONCEPTS,
    filing_decisions,
    point_in_time_rows,
)
from knownat.operators.peers import peer_context
from knownat.operators.ratios import financial_kpis

METADATA = ("cik", "company_name", "ticker", "sector", "industry", "size_tier")


def series_vintages(
    observations: DataFrame, vintage_required: Mapping[str, bool]
) -> DataFrame:
    """Add ``available_at``: the vintage date, or the day after for series without vintages."""
    tracked = [s for s, needed in vintage_required.items() if needed]
    available = F.when(
        F.col("series_id").isin(*tracked) if tracked else F.lit(False), F.col("realtime_start")
    ).otherwise(F.date_add("observation_date", 1))
    return observations.withColumn("available_at", available)


def build_panel(
    facts: DataFrame,
    metadata: DataFrame,
    observations: DataFrame,
    series: Mapping[str, str],
    vintage_required: Mapping[str, bool],
    *,
    cutoff: str,
    flows: Sequence[str] = DURATION_CONCEPTS,
    balances: Sequence[str] = BALANCE_CONCEPTS,
    minimum_interest_expense: float = 1_000_000,
    verify: bool = True,
) -> DataFrame:
    """Decisions, vintage rows, KPIs, metadata, macro as then known, peers; then leakage checks."""
    decisions = filing_decisions(facts, cutoff=cutoff)
    rows = point_in_time_rows(facts, decisions, flows=flows, balances=balances)
    rows = financial_kpis(rows, minimum_interest_expense=minimum_interest_expense)
    rows = checked_lookup(rows, metadata.select(*METADATA), ["cik"])
    rows = vintage_window_aggregate(
        rows, series_vintages(observations, vintage_required), series
    )
    panel = peer_context(rows)
    if verify:
        fail_if_duplicated(rows, ["decision_key"], "panel repeats a decision key")
        assert_known(rows, "maximum_source_available_at", "decision_at")
        assert_known(rows, "macro_available_at_max", "decision_at")
    return panel
