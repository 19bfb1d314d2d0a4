"""Backward-looking features of one entity's own rows.

The input is a panel with one row per entity and period, so a group is as long as the calendar
(a few hundred rows at most) however many raw records the entity has: the raw side was already
aggregated map-side when the panel was built.  All frames end at the current row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knownat.functions import guarded_ratio
from knownat.operators.checks import fail_if_any, fail_if_duplicated, require_columns
from knownat.operators.ratios import KPI_COLUMNS, category_interactions, missing_indicators


def entity_rows(entity: str, time: str):
    return Window.partitionBy(entity).orderBy(time)


def lags(df: DataFrame, entity: str, time: str, value: str, steps: Sequence[int]) -> DataFrame:
    w = entity_rows(entity, time)
    return df.withColumns({f"{value}_lag{k}": F.lag(value, k).over(w) for k in steps})


def change(value: str, k: int, window) -> Column:
    return F.col(value) - F.lag(value, k).over(window)


def relative_growth(value: str, k: int, window, minimum: float = 1e-9) -> Column:
    return guarded_ratio(F.col(value), F.lag(value, k).over(window), minimum) - 1


def rolling_std(value: str, window, rows: int, minimum: int) -> Column:
    frame = window.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(frame) >= minimum, F.stddev_samp(value).over(frame))


def rolling_slope(value: str, window, rows: int = 4, minimum: int = 3) -> Column:
    """Least-squares slope against 0..k-1 over the k present values of the frame.

    With positions centred on (k-1)/2 the slope is 12 * sum(centred * y) / (k * (k^2 - 1)).
    """
    present = F.collect_list(F.col(value).cast("double")).over(window.rowsBetween(-(rows - 1), 0))
    k = F.size(present)
    terms = F.transform(present, lambda y, i: (i - (k - 1) / 2.0) * y)
    weighted = F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)
    return F.when(k >= minimum, 12.0 * weighted / (k * (k * k - 1)))


def history_distance(value: str, window, minimum: int = 8) -> Column:
    """Distance from the entity's own running mean in running standard deviations."""
    frame = window.rowsBetween(Window.unboundedPreceding, 0)
    enough = F.count(value).over(frame) >= minimum
    spread = F.when(enough, F.stddev_samp(value).over(frame))
    centre = F.when(enough, F.avg(value).over(frame))
    return guarded_ratio(F.col(value) - centre, spread, 1e-9)


def trailing_sum(value: str, window, rows: int = 4) -> Column:
    """Sum of the last ``rows`` present rows, only when every one of them has a value."""
    frame = window.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(frame) == rows, F.sum(value).over(frame))


def historical_features(
    panel: DataFrame,
    *,
    entity: str = "cik",
    time: str = "decision_at",
    key: str = "decision_key",
    kpis: Sequence[str] = KPI_COLUMNS,
    macros: Sequence[str] = ("INDPRO", "RSAFS"),
    interactions: Sequence[tuple[str, str, str]] = (
        ("Utilities", "total_debt_to_assets", "utility_x_leverage"),
        ("Consumer Discretionary", "RSAFS_yoy_change", "discretionary_x_retail_sales_yoy"),
    ),
    sector: str = "sector",
    label: str = "deterioration_label",
) -> DataFrame:
    """Lags, year changes, volatility, trend, macro growth, interactions and missing flags."""
    require_columns(panel, [entity, time, key, *kpis, *macros], "feature input")
    w = entity_rows(entity, time)
    added: dict[str, Column] = {}
    for kpi in kpis:
        added |= {f"{kpi}_lag{k}": F.lag(kpi, k).over(w) for k in (1, 2, 4)}
        added[f"{kpi}_yoy_change"] = change(kpi, 4, w)
        added[f"{kpi}_volatility_4q"] = rolling_std(kpi, w, 4, 3)
        added[f"{kpi}_trend_4q"] = rolling_slope(kpi, w)
    for macro in macros:
        added[f"{macro}_yoy_change"] = relative_growth(macro, 4, w, 0.0)
    rows = panel.withColumns(added)
    if interactions:
        rows = category_interactions(rows, sector, interactions)
    rows = rows.withColumn(
        "feature_available_at",
        F.greatest("maximum_source_available_at", "macro_available_at_max"),
    )
    rows = missing_indicators(rows, exclude=[label])
    fail_if_any(
        panel,
        F.greatest("maximum_source_available_at", "macro_available_at_max") > F.col(time),
        "a feature uses information unavailable at decision time",
    )
    fail_if_duplicated(panel, [key], "feature output would repeat a decision key")
    return rows


TEMPORAL_FEATURES = (
    "current_ratio",
    "short_term_debt_share",
    "refinancing_gap_to_assets",
    "revenue_growth_yoy",
    "operating_margin_ttm",
    "asset_turnover",
    "interest_coverage_ttm",
    "free_cash_flow_margin_ttm",
    "total_debt_to_assets",
)


def temporal_features(
    df: DataFrame, entity: str, time: str, values: Sequence[str]
) -> DataFrame:
    """Quarter and year changes, eight-row volatility and distance from own history."""
    w = entity_rows(entity, time)
    added: dict[str, Column] = {}
    for value in values:
        added[f"{value}_qoq_change"] = change(value, 1, w)
        added[f"{value}_yoy_change_phase2"] = change(value, 4, w)
        added[f"{value}_volatility_8q"] = rolling_std(value, w, 8, 4)
        added[f"{value}_distance_from_history"] = history_distance(value, w)
    return df.withColumns(added)


#: Ratios as (top, what is taken from the top, bottom); growth rates over a year by their input.
RATIO_TERMS = {
    "short_term_debt_share": ("short_term_debt", None, "total_debt"),
    "refinancing_gap_to_assets": ("short_term_debt", "cash_and_equivalents", "total_assets"),
    "working_capital_to_assets": ("current_assets", "current_liabilities", "total_assets"),
    "capital_expenditure_to_revenue": ("capital_expenditures_ttm", None, "revenue_ttm"),
    "cash_flow_conversion": ("operating_cash_flow_ttm", None, "operating_income_ttm"),
    "asset_turnover": ("revenue_ttm", None, "total_assets"),
    "net_income_margin_ttm": ("net_income_ttm", None, "revenue_ttm"),
}
GROWTH_TERMS = {
    "interest_expense_growth_yoy": "interest_expense_ttm",
    "revenue_growth_yoy": "revenue_ttm",
}


def structural_inputs() -> list[str]:
    """Columns that the structural ratios are made of."""
    terms = {t for parts in RATIO_TERMS.values() for t in parts if t}
    return sorted(terms | set(GROWTH_TERMS.values()))


def structural_ratios(df: DataFrame, entity: str, time: str) -> DataFrame:
    """Debt structure, liquidity, funding and asset-use ratios, with two growth rates.

    Cash flow is related to the size of income, whatever its sign.
    """
    w = entity_rows(entity, time)
    added: dict[str, Column] = {}
    for name, (top, less, bottom) in RATIO_TERMS.items():
        over = F.abs(bottom) if name == "cash_flow_conversion" else F.col(bottom)
        added[name] = guarded_ratio(F.col(top) - F.col(less) if less else F.col(top), over, 1e-9)
    for name, term in GROWTH_TERMS.items():
        added[name] = relative_growth(term, 4, w)
    return df.withColumns(added)
