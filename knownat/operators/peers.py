"""Peer-relative context: group medians, distances from them and average-tie percentile ranks.

A peer group (quarter x sector) has no size bound, so both statistics go through the primitives
of ``knownat.scale``.  Rows without a group key form no group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.functions import calendar_quarter_label
from knownat.operators.checks import fail_if_any, require_columns
from knownat.operators.history import (
    GROWTH_TERMS,
    RATIO_TERMS,
    TEMPORAL_FEATURES,
    structural_inputs,
    structural_ratios,
    temporal_features,
)
from knownat.operators.ratios import KPI_COLUMNS, source_quality
from knownat.scale import stable, with_standings

#: Features that get a standing among peers, by the names the result carries.
PEER_FEATURES = (
    "interest_coverage_ttm",
    "free_cash_flow_margin_ttm",
    "total_debt_to_assets",
    "short_term_debt_share",
    "refinancing_gap_to_assets",
    "working_capital_to_assets",
    "capital_expenditure_to_revenue",
    "revenue_growth_yoy",
    "asset_turnover",
    "net_income_margin_ttm",
)


def peer_standing(
    df: DataFrame, groups: Sequence[str], values: Sequence[str], *, median: str | None = None
) -> DataFrame:
    """``<value>_sector_percentile`` and ``<value>_vs_sector_median`` inside ``groups``.

    ``median`` is a name pattern under which the medians are kept.
    """
    name = median or "__median_{}"
    made = [p.format(v) for v in values for p in ("{}_sector_percentile", "{}_vs_sector_median")]
    rows = df.drop(*made, *[name.format(v) for v in values])
    rows = with_standings(rows, groups, values, median=name, share="{}_sector_percentile")
    rows = rows.withColumns(
        {f"{v}_vs_sector_median": F.col(v) - F.col(name.format(v)) for v in values}
    )
    return rows if median else rows.drop(*[name.format(v) for v in values])


def peer_context(
    panel: DataFrame,
    *,
    period_end: str = "period_end",
    sector: str = "sector",
    industry: str = "industry",
    kpis: Sequence[str] = KPI_COLUMNS,
) -> DataFrame:
    """Sector and industry context among rows of the same calendar quarter of period end."""
    rows = panel.withColumn("calendar_quarter", calendar_quarter_label(period_end))
    rows = stable(rows)
    rows = peer_standing(
        rows, ["calendar_quarter", sector], kpis, median="{}_sector_median"
    )
    return with_standings(
        stable(rows), ["calendar_quarter", sector, industry], kpis, median="{}_industry_median"
    )


def financial_features(
    panel: DataFrame,
    *,
    entity: str = "cik",
    time: str = "decision_at",
    sector: str = "sector",
    temporal: Sequence[str] = TEMPORAL_FEATURES,
    peers: Sequence[str] = PEER_FEATURES,
) -> DataFrame:
    """Debt, liquidity, operating, temporal, peer and data-quality signals of the panel."""
    made = {*RATIO_TERMS, *GROWTH_TERMS}
    given = [f for f in (*temporal, *peers) if f not in made]
    needed = [
        entity, time, "period_end", sector, "preferred_tag_share", "derived_fact_share",
        "maximum_source_available_at", *structural_inputs(), *KPI_COLUMNS, *given,
    ]
    require_columns(panel, needed, "financial features input")
    fail_if_any(
        panel,
        F.col("maximum_source_available_at") > F.col(time),
        "feature input contains future-available financial information",
    )
    rows = structural_ratios(panel, entity, time)
    rows = temporal_features(rows, entity, time, temporal)
    rows = rows.withColumn("calendar_quarter", calendar_quarter_label(time))
    rows = peer_standing(stable(rows), ["calendar_quarter", sector], peers)
    return source_quality(rows, decision_time=time)
