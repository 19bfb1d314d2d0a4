"""Guarded KPI ratios, warning flags and other row-wise projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knownat.functions import clamp, flag, guarded_ratio, null_aware_sum
from knownat.operators.checks import require_columns

KPI_COLUMNS = ("interest_coverage_ttm", "free_cash_flow_margin_ttm", "total_debt_to_assets")
HIGH_RISK, MEDIUM_RISK = 0.67, 0.33


def financial_kpis(panel: DataFrame, *, minimum_interest_expense: float = 1_000_000) -> DataFrame:
    """Trailing-year KPIs with the denominator flags that made a value missing."""
    optional = ("current_assets", "current_liabilities", "cash_and_equivalents")
    rows = panel.select(
        "*", *[F.lit(None).cast("double").alias(c) for c in optional if c not in panel.columns]
    )
    interest = F.abs(F.col("interest_expense_ttm"))
    revenue, assets = F.col("revenue_ttm"), F.col("total_assets")
    rows = rows.withColumns(
        {
            "interest_denominator_invalid": F.coalesce(
                interest < minimum_interest_expense, F.lit(True)
            ),
            "revenue_denominator_invalid": F.coalesce(revenue <= 0, F.lit(True)),
            "assets_denominator_invalid": F.coalesce(assets <= 0, F.lit(True)),
            "negative_operating_income": flag(F.col("operating_income_ttm") < 0),
            "free_cash_flow_ttm": F.col("operating_cash_flow_ttm")
            - F.col("capital_expenditures_ttm"),
        }
    )

    def unless(bad: str, value: Column) -> Column:
        return F.when(~F.col(bad), value)

    rows = rows.withColumns(
        {
            "interest_coverage_ttm": unless(
                "interest_denominator_invalid",
                guarded_ratio(F.col("operating_income_ttm"), interest),
            ),
            "free_cash_flow_margin_ttm": unless(
                "revenue_denominator_invalid", guarded_ratio("free_cash_flow_ttm", "revenue_ttm")
            ),
            "total_debt_to_assets": unless(
                "assets_denominator_invalid", guarded_ratio("total_debt", "total_assets")
            ),
            "operating_margin_ttm": unless(
                "revenue_denominator_invalid", guarded_ratio("operating_income_ttm", "revenue_ttm")
            ),
            "current_ratio": guarded_ratio("current_assets", "current_liabilities"),
            "cash_to_assets": guarded_ratio("cash_and_equivalents", "total_assets"),
        }
    )
    return rows.withColumns({f"{k}_missing": F.col(k).isNull() for k in KPI_COLUMNS})


def interest_coverage(operating_income: str, interest_expense: str) -> Column:
    return guarded_ratio(operating_income, interest_expense)


def free_cash_flow_margin(cash_flow: str, capital_spending: str, revenue: str) -> Column:
    return guarded_ratio(F.col(cash_flow) - F.col(capital_spending), F.col(revenue))


def debt_to_assets(short_term: str, long_term: str, assets: str) -> Column:
    zero = F.lit(0.0)
    debt = F.coalesce(F.col(short_term), zero) + F.coalesce(F.col(long_term), zero)
    return guarded_ratio(debt, F.col(assets))


def filled_total(total: str, *parts: str) -> Column:
    """A reported total, or the sum of the parts that are present."""
    return F.coalesce(F.col(total), null_aware_sum(*parts))


def warning_signals(
    df: DataFrame,
    *,
    coverage: str = "interest_coverage_ttm",
    cash_margin: str = "free_cash_flow_margin_ttm",
    operating_margin: str = "operating_margin_ttm",
) -> DataFrame:
    """Contemporaneous 0/1 warnings and their count; a missing value raises no warning."""
    require_columns(df, [coverage, cash_margin, operating_margin], "warning input")
    below = {
        limit: flag(F.col(coverage) < limit).cast("double") for limit in (1.5, 2.0)
    }
    cash = flag(F.col(cash_margin) < 0).cast("double")
    operating = flag(F.col(operating_margin) < 0).cast("double")
    return df.withColumns(
        {
            "interest_coverage_buffer_to_1_5": F.col(coverage) - 1.5,
            "interest_coverage_below_1_5": below[1.5],
            "interest_coverage_below_2_0": below[2.0],
            "negative_free_cash_flow": cash,
            "negative_operating_margin": operating,
            "current_weakness_signal_count": below[1.5] + cash + operating,
        }
    )


def category_interactions(
    df: DataFrame, category: str, pairs: Sequence[tuple[str, str, str]]
) -> DataFrame:
    """``(value, feature, output)``: the feature where the category equals value, else 0."""
    return df.withColumns(
        {
            output: flag(F.col(category) == value).cast("double") * F.col(feature)
            for value, feature, output in pairs
        }
    )


def missing_indicators(df: DataFrame, *, exclude: Sequence[str] = ()) -> DataFrame:
    """``<column>_missing`` for every numeric column that has none yet."""
    added = [
        F.col(field.name).isNull().alias(f"{field.name}_missing")
        for field in df.schema.fields
        if isinstance(field.dataType, T.NumericType)
        and field.name not in exclude
        and not field.name.endswith("_missing")
        and f"{field.name}_missing" not in df.columns
    ]
    return df.select("*", *added)


def modelling_eligibility(
    df: DataFrame,
    *,
    coverage: str,
    operating_income: str,
    interest: str,
    source_time: str,
    decision_time: str,
    lineage: str,
) -> DataFrame:
    """Row flags: the coverage ratio is meaningful, and its sources were known and traced."""
    meaningful = (
        F.col(coverage).isNotNull()
        & F.col(operating_income).isNotNull()
        & flag(F.col(interest) > 0)
    )
    traced = flag(F.col(source_time) <= F.col(decision_time)) & F.col(lineage).isNotNull()
    return df.withColumns(
        {
            "company_quarter_interest_coverage_eligible": meaningful,
            "company_quarter_lineage_eligible": traced,
            "company_quarter_modeling_eligible": meaningful & traced,
        }
    )


def source_quality(
    df: DataFrame,
    *,
    decision_time: str = "decision_at",
    period_end: str = "period_end",
    preferred: str = "preferred_tag_share",
    derived: str = "derived_fact_share",
) -> DataFrame:
    """Filing delay and a 0..1 quality score built from lineage shares and that delay."""
    delay = F.datediff(F.col(decision_time), F.col(period_end))
    return df.withColumns(
        {
            "filing_delay_days": delay,
            "low_preferred_tag_share": 1 - F.col(preferred),
            "source_quality_score": 0.5 * F.col(preferred)
            + 0.3 * (1 - F.col(derived))
            + 0.2 * (1 - clamp(delay.cast("double"), 0.0, 180.0) / 180),
        }
    )


def risk_band(probability: str) -> Column:
    p = F.col(probability)
    return F.when(p >= HIGH_RISK, "High").when(p >= MEDIUM_RISK, "Medium").otherwise("Low")


def case_type(label: str, alert: Column) -> Column:
    hit = F.col(label) == 1
    return (
        F.when(alert & hit, "true_positive")
        .when(alert & ~hit, "false_positive")
        .when(~alert & hit, "false_negative")
        .otherwise("true_negative")
    )
