"""Forecasts, backtests and empirical intervals on the supplier panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.roles import SQ, rounded, supplier_panel
from knownat.operators import forecasting

ORIGINS = ("1999-01-01", "2000-01-01", "2001-01-01")
KPIS = ("coverage", "leverage")


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_panel(spark, sf_dir).withColumn(
        "leverage", F.when(F.col("qpos") % 6 != 0, F.col("leverage"))
    )


def _folds(spark: SparkSession) -> DataFrame:
    """The fold table is configuration: one row per origin."""
    return spark.createDataFrame(
        [(f"fold_{i + 1:02d}", day) for i, day in enumerate(ORIGINS)],
        "fold_id string, validation_start string",
    ).withColumn("validation_start", F.col("validation_start").cast("date"))


SERIES = f"""{SQ},
se AS (SELECT entity, sector, decision_key, decision_at, qpos, 'coverage' AS kpi, coverage AS v FROM sq
  UNION ALL SELECT entity, sector, decision_key, decision_at, qpos, 'leverage', CASE WHEN qpos % 6 <> 0 THEN leverage END FROM sq),
s1 AS (SELECT *, v - last_value(v IGNORE NULLS) OVER (PARTITION BY entity, kpi ORDER BY qpos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS step FROM se),
hs AS (SELECT *, count(v) OVER u AS n, first_value(v IGNORE NULLS) OVER u AS fv, last_value(v IGNORE NULLS) OVER u AS lv,
    coalesce(stddev_samp(step) OVER u, 0) AS sd
  FROM s1 WINDOW u AS (PARTITION BY entity, kpi ORDER BY qpos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(
    "naive_forecast_features",
    f"""WITH {SERIES},
f AS (SELECT decision_key, decision_at, kpi, CASE WHEN n >= 8 THEN lv + (lv - fv) / (n - 1) * 4 END AS m,
    CASE WHEN n >= 8 THEN (lv - fv) / (n - 1) * 4 END AS ch,
    CASE WHEN n >= 8 THEN 2 * 1.96 * greatest(sd, 2.220446049250313e-16) * 2 END AS w FROM hs)
SELECT decision_key, max(decision_at) AS forecast_feature_available_at,
  round(max(m) FILTER (kpi = 'coverage'), 10) AS forecast_coverage_4q, round(max(ch) FILTER (kpi = 'coverage'), 10) AS forecast_coverage_change_4q,
  round(max(w) FILTER (kpi = 'coverage'), 10) AS forecast_coverage_uncertainty_4q,
  round(max(m) FILTER (kpi = 'leverage'), 10) AS forecast_leverage_4q, round(max(ch) FILTER (kpi = 'leverage'), 10) AS forecast_leverage_change_4q,
  round(max(w) FILTER (kpi = 'leverage'), 10) AS forecast_leverage_uncertainty_4q
FROM f GROUP BY decision_key""",
)
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = forecasting.forecast_features(
        _panel(spark, sf_dir), kpis=KPIS, minimum_history=8, entity="entity"
    )
    return rounded(made, *[c for c in made.columns if c.endswith("_4q")], digits=10)


BACKTEST = f"""{SERIES},
fd AS (SELECT * FROM (VALUES {", ".join(f"('fold_{i + 1:02d}', DATE '{d}')" for i, d in enumerate(ORIGINS))}) t(fold_id, start)),
og AS (SELECT fd.fold_id, hs.* FROM hs JOIN fd ON hs.decision_at < fd.start
  QUALIFY row_number() OVER (PARTITION BY fd.fold_id, hs.entity, hs.kpi ORDER BY hs.decision_at DESC) = 1),
bt0 AS (SELECT o.fold_id, o.entity, o.sector, o.decision_key AS origin_decision_key, o.decision_at AS origin_at, t.decision_at AS target_at,
    o.kpi, h AS horizon, t.v AS actual, model, CASE model WHEN 'random_walk' THEN lv ELSE lv + (lv - fv) / (n - 1) * h END AS forecast,
    1.96 * greatest(sd, 2.220446049250313e-16) * sqrt(h) AS w
  FROM og o, (SELECT unnest([1, 4]) AS h), (SELECT unnest(['random_walk', 'random_walk_drift']) AS model), se t
  WHERE o.n >= 12 AND t.entity = o.entity AND t.kpi = o.kpi AND t.qpos = o.qpos + h AND t.v IS NOT NULL),
bt AS (SELECT *, forecast - w AS lower, forecast + w AS upper, forecast - actual AS error, forecast - w <= actual AND actual <= forecast + w AS cov FROM bt0)"""


def _backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasting.backtest(
        _panel(spark, sf_dir), _folds(spark), kpis=KPIS, minimum_history=12, entity="entity"
    )


@query(
    "random_walk_backtest",
    f"""WITH {BACKTEST}
SELECT fold_id, entity, origin_decision_key, kpi, model, CAST(horizon AS INTEGER) AS horizon, target_at, actual,
  round(forecast, 10) AS forecast, round(lower, 10) AS lower, round(upper, 10) AS upper, cov AS interval_covered FROM bt""",
)
def backtest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _backtest(spark, sf_dir)
    return rounded(
        made.select(
            "fold_id", "entity", "origin_decision_key", "kpi", "model", "horizon", "target_at",
            "actual", "forecast", "lower", "upper", "interval_covered",
        ),
        "forecast", "lower", "upper", digits=10,
    )


SUMMARY = f"""{BACKTEST},
sr AS (SELECT kpi, horizon, model, avg(r) AS m, stddev_samp(r) AS s FROM (SELECT kpi, horizon, model, sector,
    sqrt(avg(error * error)) AS r FROM bt GROUP BY ALL) GROUP BY ALL),
sm AS (SELECT kpi, horizon, model, count(*) AS n, avg(abs(error)) AS mae, sqrt(avg(error * error)) AS rmse,
    avg(CAST(cov AS INTEGER)) AS ic FROM bt GROUP BY ALL),
sf AS (SELECT *, row_number() OVER (PARTITION BY kpi, horizon ORDER BY rmse, mae, s, model) AS rank
  FROM sm JOIN sr USING (kpi, horizon, model))"""


@query(
    "random_walk_backtest_summary",
    f"""WITH {SUMMARY}
SELECT kpi, CAST(horizon AS INTEGER) AS horizon, model, CAST(n AS BIGINT) AS observations, round(mae, 6) AS "MAE", round(rmse, 6) AS "RMSE",
  round(ic, 6) AS interval_coverage, 1.0::DOUBLE AS convergence_rate, 0.0::DOUBLE AS fallback_rate,
  round(m, 6) AS sector_rmse_mean, round(s, 6) AS sector_rmse_std, CAST(rank AS INTEGER) AS rank, rank = 1 AS selected FROM sf""",
)
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = forecasting.forecast_champions(forecasting.summarize_forecasts(_backtest(spark, sf_dir)))
    return rounded(
        made, "MAE", "RMSE", "interval_coverage", "sector_rmse_mean", "sector_rmse_std"
    )


INTERVALS = f"""{BACKTEST},
rs AS (SELECT kpi, sector, horizon, abs(actual - forecast) AS r FROM bt WHERE model = 'random_walk'),
po AS (SELECT kpi, horizon, quantile_cont(r, 0.9) AS w, count(*) AS n FROM rs GROUP BY ALL),
ow AS (SELECT kpi, sector, horizon, quantile_cont(r, 0.9) AS w, count(*) AS n FROM rs GROUP BY ALL),
ca AS (SELECT ow.kpi, sector, ow.horizon, CASE WHEN ow.n >= {{}} THEN ow.w ELSE po.w END AS w, CASE WHEN ow.n >= {{}} THEN ow.n ELSE po.n END AS n,
    CASE WHEN ow.n >= {{}} THEN 'sector_kpi_horizon' ELSE 'pooled_kpi_horizon_fallback' END AS scope
  FROM ow JOIN po USING (kpi, horizon))""".replace("{}", "60")


@query(
    "empirical_interval_calibration",
    f"""WITH {INTERVALS}
SELECT kpi, sector, CAST(horizon AS INTEGER) AS horizon, round(w, 6) AS absolute_residual_quantile,
  CAST(n AS BIGINT) AS calibration_observations, scope AS calibration_scope, 0.9::DOUBLE AS interval_level FROM ca""",
)
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _backtest(spark, sf_dir).where("model = 'random_walk'")
    made = forecasting.fit_empirical_intervals(rows, level=0.9, minimum_group=60)
    return rounded(made, "absolute_residual_quantile")


FROZEN = INTERVALS.replace(
    "FROM bt WHERE model = 'random_walk'", "FROM bt WHERE model = 'random_walk' AND fold_id <> 'fold_03'"
)


@query(
    "empirical_interval_application",
    f"""WITH {FROZEN}
SELECT origin_decision_key, bt.kpi, CAST(bt.horizon AS INTEGER) AS horizon, round(forecast - ca.w, 6) AS lower_interval,
  round(forecast + ca.w, 6) AS upper_interval, actual BETWEEN forecast - ca.w AND forecast + ca.w AS interval_covered
FROM bt JOIN ca ON ca.kpi = bt.kpi AND ca.sector = bt.sector AND ca.horizon = bt.horizon
WHERE model = 'random_walk' AND fold_id = 'fold_03'""",
)
def application(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths frozen on the first two folds meet the forecasts of the last."""
    rows = _backtest(spark, sf_dir).where("model = 'random_walk'")
    widths = forecasting.fit_empirical_intervals(
        rows.where("fold_id <> 'fold_03'"), level=0.9, minimum_group=60
    )
    later = rows.where("fold_id = 'fold_03'").drop("interval_covered")
    made = forecasting.apply_empirical_intervals(later, widths)
    return rounded(
        made.select(
            "origin_decision_key", "kpi", "horizon", "lower_interval", "upper_interval",
            "interval_covered",
        ),
        "lower_interval", "upper_interval",
    )
