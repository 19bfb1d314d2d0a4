"""Plain-language reasons: which observed values are unusual against a reference population."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knownat.operators.checks import require_columns
from knownat.operators.ratios import risk_band
from knownat.scale import running_sums


class ReasonRule(NamedTuple):
    feature: str
    direction: str  # "low" or "high": which tail is worrying
    label: str
    meaning: str


# The rules and texts that results must repeat.
REASON_RULES = (
    ReasonRule(
        "interest_coverage_ttm_sector_percentile",
        "low",
        "Weak debt-service capacity versus sector peers",
        "Lower operating earnings relative to interest expense leaves less protection for lenders.",
    ),
    ReasonRule(
        "interest_coverage_ttm_yoy_change",
        "low",
        "Interest coverage is deteriorating",
        "Coverage fell from the comparable quarter a year earlier.",
    ),
    ReasonRule(
        "free_cash_flow_margin_ttm_sector_percentile",
        "low",
        "Weak free cash flow versus sector peers",
        "Less cash remains after operating and capital-investment needs.",
    ),
    ReasonRule(
        "total_debt_to_assets_sector_percentile",
        "high",
        "High leverage versus sector peers",
        "A larger share of assets is financed by debt, increasing refinancing sensitivity.",
    ),
    ReasonRule(
        "total_debt_to_assets_yoy_change",
        "high",
        "Leverage is rising",
        "Debt relative to assets increased from the comparable quarter a year earlier.",
    ),
    ReasonRule(
        "BAA10Y",
        "high",
        "Corporate financing conditions are tight",
        "The corporate-to-Treasury yield spread is elevated, a proxy for refinancing pressure.",
    ),
    ReasonRule(
        "forecast_interest_coverage_uncertainty_4q",
        "high",
        "The coverage forecast is unusually uncertain",
        "A wide forecast range reduces confidence in the four-quarter central estimate.",
    ),
    ReasonRule(
        "filing_delay_days",
        "high",
        "Financial reporting was slower than usual",
        "Reporting delay is a data-quality association, not direct evidence of financial stress.",
    ),
)
NOT_CAUSAL = "predictive association, not a causal claim"
LIMITS = (
    "Reasons describe predictive associations and unusual observed conditions; "
    "they do not identify causes or prescribe management actions."
)
SEVERE = 0.75
MINIMUM_REFERENCE = 5


def reference_share_at_or_below(
    scored: DataFrame, reference: DataFrame, features: Sequence[str], key: Sequence[str]
) -> DataFrame:
    """(key, feature, value, share, n): the reference share at or below each scored value.

    Both sides are unpivoted and counted into cells of distinct (feature, value); one running
    total over the cells gives every share, then each scored row looks its own cell up.
    """

    def long(df: DataFrame, carry: Sequence[str]) -> DataFrame:
        return df.select(
            *carry,
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
                        for f in features
                    ]
                )
            ).alias("c"),
        ).select(*carry, "c.feature", "c.value").where("value IS NOT NULL")

    asked = long(scored, key)
    known = long(reference, [])
    cells = (
        known.select("feature", "value", F.lit(1).alias("__r"))
        .unionByName(asked.select("feature", "value", F.lit(0).alias("__r")))
        .groupBy("feature", "value")
        .agg(F.sum("__r").cast("long").alias("__r"))
    )
    upto = running_sums(
        cells, ["feature"], [F.col("value")], {"__upto": F.col("__r")}, totals={"n": "__upto"}
    )
    return asked.join(
        upto.where("n > 0").select("feature", "value", "__upto", "n"), ["feature", "value"]
    ).select(*key, "feature", "value", (F.col("__upto") / F.col("n")).alias("share"), "n")


def reason_codes(
    scored: DataFrame,
    reference: DataFrame,
    *,
    key: Sequence[str],
    rules: Sequence[ReasonRule] = REASON_RULES,
    maximum: int = 4,
) -> DataFrame:
    """The strongest reasons per row, one line each, ``reason_rank`` from 1."""
    usable = [r for r in rules if r.feature in scored.columns and r.feature in reference.columns]
    if not usable:
        raise ValueError("no reason rule applies to the given columns")
    spark = scored.sparkSession
    table = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(usable)],
        "position int, feature string, direction string, label string, financial_meaning string",
    )
    shares = reference_share_at_or_below(scored, reference, [r.feature for r in usable], key)
    severity = F.when(F.col("direction") == "low", 1 - F.col("share")).otherwise(F.col("share"))
    severe = (
        shares.where(F.col("n") >= MINIMUM_REFERENCE)
        .join(F.broadcast(table), "feature")  # one row per rule
        .withColumn("severity", severity)
        .where(F.col("severity") >= SEVERE)
    )
    best = Window.partitionBy(*key).orderBy(F.col("severity").desc(), "position")
    return (
        severe.withColumn("reason_rank", F.row_number().over(best))
        .where(F.col("reason_rank") <= maximum)
        .select(
            *key,
            "reason_rank",
            "feature",
            "label",
            "financial_meaning",
            "value",
            F.col("share").alias("development_percentile"),
            "severity",
        )
    )


def explanations(
    scored: DataFrame,
    reference: DataFrame,
    *,
    key: Sequence[str] = ("cik", "decision_at"),
    probability: str = "probability",
    rules: Sequence[ReasonRule] = REASON_RULES,
    maximum: int = 4,
) -> DataFrame:
    """Risk band and JSON reason list per scored row."""
    key = list(key)
    require_columns(scored, [*key, probability], "scored rows")
    reasons = reason_codes(scored, reference, key=key, rules=rules, maximum=maximum)
    packed = reasons.groupBy(*key).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "reason_rank",
                    F.struct(
                        "feature",
                        "label",
                        "financial_meaning",
                        "value",
                        "development_percentile",
                        "severity",
                        F.lit(NOT_CAUSAL).alias("interpretation"),
                    ).alias("r"),
                )
            )
        ).alias("__reasons")
    )
    return scored.select(*key, probability).join(packed, key, "left").select(
        *key,
        probability,
        risk_band(probability).alias("risk_band"),
        F.coalesce(F.size("__reasons"), F.lit(0)).alias("reason_count"),
        F.coalesce(
            F.to_json(F.transform("__reasons", lambda x: x["r"])), F.lit("[]")
        ).alias("reason_codes_json"),
        F.lit(LIMITS).alias("interpretation_limit"),
    )
