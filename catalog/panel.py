"""Panel features: ratios, history and peers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.roles import CQ, SQ, customer_panel, rounded, supplier_panel
from knownat.functions import guarded_ratio, round_half_away
from knownat.operators.history import (
    change,
    history_distance,
    lags,
    relative_growth,
    rolling_slope,
    rolling_std,
    trailing_sum,
)
from knownat.operators.peers import peer_standing
from knownat.operators.ratios import (
    category_interactions,
    missing_indicators,
    source_quality,
    warning_signals,
)

def entity_line():
    return Window.partitionBy("entity").orderBy("qpos")


@query(
    "ttm_sum_trailing_present",
    f"""WITH {CQ}
SELECT entity, qpos,
  CASE WHEN count(settled) OVER w = 4 THEN round(sum(settled) OVER w, 2) END AS settled_ttm,
  CAST(count(*) OVER w AS BIGINT) AS quarters_present
FROM cq WINDOW w AS (PARTITION BY entity ORDER BY qpos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
)
def ttm_sum_trailing_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customer_panel(spark, sf_dir)
    return rows.select(
        "entity",
        "qpos",
        round_half_away(trailing_sum("settled", entity_line()), 2).alias("settled_ttm"),
        F.count(F.lit(1)).over(entity_line().rowsBetween(-3, 0)).alias("quarters_present"),
    )


@query(
    "guarded_ratio_kpis",
    f"""WITH {SQ}
SELECT entity, qpos,
  (interest IS NULL OR interest < 20000) AS interest_denominator_invalid,
  CASE WHEN NOT (interest IS NULL OR interest < 20000) THEN round(income / interest, 6) END AS interest_coverage,
  CASE WHEN abs(revenue) > 1e-9 THEN round(cash / revenue, 6) END AS cash_margin,
  CASE WHEN abs(assets) > 1e-9 THEN round(coalesce(debt, 0) / assets, 6) END AS debt_to_assets,
  CASE WHEN abs(debt) > 1e-9 THEN round(interest / debt, 6) END AS cost_of_debt,
  debt IS NULL AS debt_missing
FROM sq""",
)
def guarded_ratio_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_panel(spark, sf_dir)
    invalid = F.coalesce(F.col("interest") < 20000, F.lit(True))
    made = rows.select(
        "entity",
        "qpos",
        invalid.alias("interest_denominator_invalid"),
        F.when(~invalid, guarded_ratio("income", "interest")).alias("interest_coverage"),
        guarded_ratio("cash", "revenue", 1e-9).alias("cash_margin"),
        guarded_ratio(F.coalesce("debt", F.lit(0.0)), "assets", 1e-9).alias("debt_to_assets"),
        guarded_ratio("interest", "debt", 1e-9).alias("cost_of_debt"),
        F.col("debt").isNull().alias("debt_missing"),
    )
    return rounded(made, "interest_coverage", "cash_margin", "debt_to_assets", "cost_of_debt")


@query(
    "lag_yoy_change",
    f"""WITH {SQ}
SELECT entity, qpos,
  lag(coverage, 1) OVER w AS coverage_lag1, lag(coverage, 2) OVER w AS coverage_lag2,
  lag(coverage, 4) OVER w AS coverage_lag4,
  round(coverage - lag(coverage, 4) OVER w, 6) AS coverage_yoy_change,
  round(coverage - lag(coverage, 1) OVER w, 6) AS coverage_qoq_change,
  CASE WHEN abs(lag(revenue, 4) OVER w) > 1e-9
    THEN round(revenue / lag(revenue, 4) OVER w - 1, 6) END AS revenue_growth_yoy
FROM sq WINDOW w AS (PARTITION BY entity ORDER BY qpos)""",
)
def lag_yoy_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lags(supplier_panel(spark, sf_dir), "entity", "qpos", "coverage", (1, 2, 4))
    return rows.select(
        "entity",
        "qpos",
        "coverage_lag1",
        "coverage_lag2",
        "coverage_lag4",
        round_half_away(change("coverage", 4, entity_line()), 6).alias("coverage_yoy_change"),
        round_half_away(change("coverage", 1, entity_line()), 6).alias("coverage_qoq_change"),
        round_half_away(relative_growth("revenue", 4, entity_line()), 6).alias("revenue_growth_yoy"),
    )


@query(
    "rolling_std_min_periods",
    f"""WITH {CQ}
SELECT entity, qpos,
  CASE WHEN count(settled) OVER w4 >= 3 THEN round(stddev_samp(settled) OVER w4, 4) END AS volatility_4q,
  CASE WHEN count(settled) OVER w8 >= 4 THEN round(stddev_samp(settled) OVER w8, 4) END AS volatility_8q
FROM cq WINDOW
  w4 AS (PARTITION BY entity ORDER BY qpos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW),
  w8 AS (PARTITION BY entity ORDER BY qpos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""",
)
def rolling_std_min_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customer_panel(spark, sf_dir)
    return rows.select(
        "entity",
        "qpos",
        round_half_away(rolling_std("settled", entity_line(), 4, 3), 4).alias("volatility_4q"),
        round_half_away(rolling_std("settled", entity_line(), 8, 4), 4).alias("volatility_8q"),
    )


@query(
    "rolling_slope_nonnull",
    f"""WITH {CQ},
f AS (SELECT entity, qpos,
    list_filter(list(settled) OVER (PARTITION BY entity ORDER BY qpos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW),
      lambda x: x IS NOT NULL) AS ys FROM cq),
g AS (SELECT entity, qpos, len(ys) AS k, ys FROM f)
SELECT entity, qpos,
  CASE WHEN k >= 3 THEN round(12.0::DOUBLE * list_sum(list_transform(range(1, k + 1),
      lambda i: (i - 1 - (k - 1) / 2.0::DOUBLE) * ys[i])) / (k * (k * k - 1)), 4) END AS settled_trend_4q
FROM g""",
)
def rolling_slope_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customer_panel(spark, sf_dir)
    return rows.select(
        "entity",
        "qpos",
        round_half_away(rolling_slope("settled", entity_line()), 4).alias("settled_trend_4q"),
    )


@query(
    "expanding_zscore",
    f"""WITH {SQ}
SELECT entity, qpos,
  CASE WHEN count(coverage) OVER w >= 8 AND stddev_samp(coverage) OVER w > 1e-9
    THEN round((coverage - avg(coverage) OVER w) / stddev_samp(coverage) OVER w, 6) END
    AS coverage_distance_from_history
FROM sq WINDOW w AS (PARTITION BY entity ORDER BY qpos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def expanding_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_panel(spark, sf_dir)
    return rows.select(
        "entity",
        "qpos",
        round_half_away(history_distance("coverage", entity_line()), 6).alias(
            "coverage_distance_from_history"
        ),
    )


PEERS = """CASE WHEN {v} IS NOT NULL THEN
    (rank() OVER (PARTITION BY {g} ORDER BY {v} NULLS LAST)
      + (count(*) OVER (PARTITION BY {g}, {v}) - 1) / 2.0::DOUBLE) / count({v}) OVER (PARTITION BY {g}) END"""


@query(
    "peer_median_gap",
    f"""WITH {SQ}
SELECT entity, qpos, round(m, 8) AS leverage_sector_median, round(leverage - m, 8) AS leverage_vs_sector_median
FROM (SELECT *, median(leverage) OVER (PARTITION BY qpos, sector) AS m FROM sq)""",
)
def peer_median_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = peer_standing(
        supplier_panel(spark, sf_dir), ["qpos", "sector"], ["leverage"],
        median="leverage_sector_median",
    )
    return rounded(
        rows.select("entity", "qpos", "leverage_sector_median", "leverage_vs_sector_median"),
        "leverage_sector_median",
        "leverage_vs_sector_median",
        digits=8,
    )


@query(
    "peer_pct_rank_avg_ties",
    f"""WITH {SQ}, t AS (SELECT entity, qpos, sector, round(leverage, 2) AS lev FROM sq)
SELECT entity, qpos, round({PEERS.format(v="lev", g="qpos, sector")}, 6) AS lev_sector_percentile FROM t""",
)
def peer_pct_rank_avg_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_panel(spark, sf_dir).withColumn("lev", round_half_away("leverage", 2))
    ranked = peer_standing(rows, ["qpos", "sector"], ["lev"])
    return rounded(ranked.select("entity", "qpos", "lev_sector_percentile"),
                   "lev_sector_percentile")


@query(
    "missing_indicators",
    f"""WITH {CQ}
SELECT entity, qpos, amount, settled, urgent, amount IS NULL AS amount_missing,
  settled IS NULL AS settled_missing, urgent IS NULL AS urgent_missing FROM cq""",
)
def missing_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customer_panel(spark, sf_dir).select("entity", "qpos", "amount", "settled", "urgent")
    return missing_indicators(rows, exclude=["entity", "qpos"])


@query(
    "warning_signal_count",
    f"""WITH {SQ}, k AS (SELECT *,
  CASE WHEN coalesce(coverage < 1.5, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS b1,
  CASE WHEN coalesce(coverage < 2.0, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS b2,
  CASE WHEN coalesce(cash_margin < 0, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c,
  CASE WHEN coalesce(income / revenue < 0, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o FROM sq)
SELECT entity, qpos, round(coverage - 1.5, 6) AS interest_coverage_buffer_to_1_5,
  b1 AS interest_coverage_below_1_5, b2 AS interest_coverage_below_2_0,
  c AS negative_free_cash_flow, o AS negative_operating_margin,
  b1 + c + o AS current_weakness_signal_count FROM k""",
)
def warning_signal_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_panel(spark, sf_dir).withColumn("margin", guarded_ratio("income", "revenue"))
    made = warning_signals(
        rows, coverage="coverage", cash_margin="cash_margin", operating_margin="margin"
    )
    return rounded(
        made.select(
            "entity",
            "qpos",
            "interest_coverage_buffer_to_1_5",
            "interest_coverage_below_1_5",
            "interest_coverage_below_2_0",
            "negative_free_cash_flow",
            "negative_operating_margin",
            "current_weakness_signal_count",
        ),
        "interest_coverage_buffer_to_1_5",
    )


@query(
    "sector_interactions",
    f"""WITH {SQ}
SELECT entity, qpos,
  CASE WHEN sector = 'ASIA' THEN leverage ELSE 0.0 * leverage END + 0.0 AS asia_x_leverage,
  CASE WHEN sector = 'EUROPE' THEN coverage ELSE 0.0 * coverage END + 0.0 AS europe_x_coverage
FROM sq""",
)
def sector_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = category_interactions(
        supplier_panel(spark, sf_dir),
        "sector",
        [("ASIA", "leverage", "asia_x_leverage"), ("EUROPE", "coverage", "europe_x_coverage")],
    )
    # Adding zero turns a negative zero into zero, so both engines show the same value.
    return made.select(
        "entity",
        "qpos",
        (F.col("asia_x_leverage") + 0.0).alias("asia_x_leverage"),
        (F.col("europe_x_coverage") + 0.0).alias("europe_x_coverage"),
    )


@query(
    "source_quality_score",
    f"""WITH {SQ}, s AS (SELECT *, round(1 - 1.0 / lines, 6) AS pref, round(1.0 / lines, 6) AS der,
    CAST(decision_at - period_end AS INTEGER) * 6 - 120 AS d FROM sq)
SELECT entity, qpos, CAST(d AS INTEGER) AS filing_delay_days, round(1 - pref, 6) AS low_preferred_tag_share,
  round(0.5 * pref + 0.3 * (1 - der) + 0.2 * (1 - least(greatest(d, 0), 180) / 180.0), 6) AS source_quality_score
FROM s""",
)
def source_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_panel(spark, sf_dir).withColumns(
        {
            "preferred_tag_share": round_half_away(1 - 1.0 / F.col("lines"), 6),
            "derived_fact_share": round_half_away(1.0 / F.col("lines"), 6),
            # stretch the delay so that both clipping bounds are met
            "known": F.expr(
                "date_add(period_end, datediff(decision_at, period_end) * 6 - 120)"
            ),
        }
    )
    made = source_quality(rows, decision_time="known")
    return rounded(
        made.select(
            "entity", "qpos", "filing_delay_days", "low_preferred_tag_share",
            "source_quality_score",
        ),
        "low_preferred_tag_share",
        "source_quality_score",
    )
