"""Forward labels, episodes and the folds built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.knowledge import LABELLED, labelled_panel
from catalog.registry import query
from catalog.roles import SQ, customer_panel, rounded, supplier_panel
from knownat.functions import round_half_away
from knownat.operators.folds import expanding_window_splits, rolling_folds, rolling_training_rows
from knownat.operators.labels import (
    cooldown_starts,
    coverage_label_grid,
    deterioration_label,
    deterioration_labels,
    episode_runs,
    event_counts,
    first_breach_lead,
    label_edge_cases,
    label_sensitivity_summary,
    multi_component_label,
    threshold_sensitivity,
)

HORIZONS, THRESHOLDS = (2, 4, 6), (1.0, 1.5, 2.0)
GRID = coverage_label_grid(HORIZONS, THRESHOLDS)


@query(
    "forward_deterioration_label",
    f"""WITH {LABELLED}
SELECT decision_key, deterioration_label, label_available_at,
  round(future_minimum, 6) AS future_minimum_interest_coverage,
  round(decline, 6) AS future_interest_coverage_relative_decline,
  coalesce(coverage < 1.5, false) AS already_below_coverage_threshold FROM lq""",
)
def forward_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_panel(spark, sf_dir)
    return rounded(
        rows.select(
            "decision_key",
            "deterioration_label",
            "label_available_at",
            "future_minimum_interest_coverage",
            "future_interest_coverage_relative_decline",
            "already_below_coverage_threshold",
        ),
        "future_minimum_interest_coverage",
        "future_interest_coverage_relative_decline",
    )


CQ_RATIO = """
cr AS (SELECT o_custkey AS entity, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS qpos,
    round(sum(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END) / 100000, 2) AS strength
  FROM orders GROUP BY 1, 2)"""


@query(
    "forward_label_sparse_panel",
    f"""WITH {CQ_RATIO},
a AS (SELECT *, qpos - lag(qpos) OVER (PARTITION BY entity ORDER BY qpos) AS step FROM cr),
b AS (SELECT *, min(strength) OVER f AS fmin, count(strength) OVER f AS fk, count(*) OVER f AS fn,
    min(step) OVER f AS smin, max(step) OVER f AS smax FROM a
  WINDOW f AS (PARTITION BY entity ORDER BY qpos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))
SELECT entity, qpos, CASE WHEN fn = 2 AND fk = 2 AND smin = 1 AND smax = 1 AND strength IS NOT NULL AND strength <> 0
  THEN CAST(fmin < 2.0 AND (strength - fmin) / greatest(abs(strength), 2.220446049250313e-16) >= 0.4 AS INTEGER) END
  AS label FROM b""",
)
def sparse_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customer_panel(spark, sf_dir).withColumn(
        "strength", round_half_away(F.col("settled") / 100000, 2)
    )
    made = deterioration_label(
        rows, entity="entity", time="period_end", coverage="strength", horizon=2, threshold=2.0,
        name="label",
    )
    return made.select("entity", "qpos", "label")


def _grid_sql(h: int, t: float) -> str:
    return (
        f"CASE WHEN n{h} = {h} AND k{h} = {h} AND lo{h} = 1 AND hi{h} = 1 AND coverage IS NOT NULL "
        f"AND coverage <> 0 THEN CAST(m{h} < {t} AND (coverage - m{h}) / greatest(abs(coverage), "
        f"2.220446049250313e-16) >= 0.4 AS INTEGER) END AS \"coverage_h{h}_threshold_{t:.1f}\""
    )


def _frames() -> str:
    return ", ".join(
        f"w{h} AS (PARTITION BY entity ORDER BY qpos ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
        for h in HORIZONS
    )


GRID_CTE = f"""{SQ},
g0 AS (SELECT *, qpos - lag(qpos) OVER (PARTITION BY entity ORDER BY qpos) AS step FROM sq),
g1 AS (SELECT *, {", ".join(
    f"min(coverage) OVER w{h} AS m{h}, count(coverage) OVER w{h} AS k{h}, count(*) OVER w{h} AS n{h}, "
    f"min(step) OVER w{h} AS lo{h}, max(step) OVER w{h} AS hi{h}" for h in HORIZONS)}
  FROM g0 WINDOW {_frames()}),
gr AS (SELECT entity, sector, qpos, decision_at, decision_key, coverage, cash_margin, leverage,
  {", ".join(_grid_sql(h, t) for h in HORIZONS for t in THRESHOLDS)} FROM g1)"""


@query(
    "label_threshold_grid",
    f"""WITH {GRID_CTE}
SELECT decision_key, {", ".join(f'"{n}"' for n in GRID)} FROM gr""",
)
def label_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deterioration_labels(
        supplier_panel(spark, sf_dir), GRID, entity="entity", coverage="coverage"
    )
    return rows.select("decision_key", *[F.col(f"`{n}`") for n in GRID])


MULTI_SQL = f"""{GRID_CTE},
mk AS (SELECT *, CASE WHEN "coverage_h4_threshold_1.5" IS NOT NULL AND leverage IS NOT NULL
    AND count(cash_margin) OVER f = 4 AND count(leverage) OVER f = 4
  THEN CAST("coverage_h4_threshold_1.5" + CAST(min(cash_margin) OVER f < 0 AS INTEGER)
    + CAST(max(leverage) OVER f - leverage >= 0.1 AS INTEGER) >= 2 AS INTEGER) END AS multi_kpi_two_of_three
  FROM gr WINDOW f AS (PARTITION BY entity ORDER BY qpos ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING))"""


def _multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_component_label(
        supplier_panel(spark, sf_dir),
        entity="entity",
        coverage="coverage",
        cash_margin="cash_margin",
        leverage="leverage",
    )


@query(
    "multi_component_label",
    f"WITH {MULTI_SQL} SELECT decision_key, multi_kpi_two_of_three FROM mk",
)
def multi_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _multi(spark, sf_dir).select("decision_key", "multi_kpi_two_of_three")


@query(
    "label_sensitivity_summary",
    f"""WITH {MULTI_SQL},
lg AS (UNPIVOT (SELECT entity, sector, qpos, decision_at, {", ".join(f'"{n}"' for n in GRID)},
    multi_kpi_two_of_three FROM mk) ON {", ".join(f'"{n}"' for n in GRID)}, multi_kpi_two_of_three
    INTO NAME label VALUE y),
st AS (SELECT *, CASE WHEN y = 1 AND NOT (coalesce(lag(y) OVER w = 1, false)
    AND coalesce((year(decision_at) * 4 + quarter(decision_at))
      - lag(year(decision_at) * 4 + quarter(decision_at)) OVER w = 1, false)) THEN 1 ELSE 0 END AS starts
  FROM lg WINDOW w AS (PARTITION BY label, entity ORDER BY decision_at))
SELECT label, coalesce(sector, 'Overall') AS sector, CAST(count(*) AS BIGINT) AS mature_company_quarters,
  CAST(sum(y) AS BIGINT) AS positive_company_quarters, round(avg(y), 6) AS prevalence,
  CAST(sum(starts) AS BIGINT) AS distinct_episodes, false AS selected_using_model_performance
FROM st GROUP BY GROUPING SETS ((label), (label, sector))""",
)
def sensitivity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deterioration_labels(
        _multi(spark, sf_dir), GRID, entity="entity", coverage="coverage"
    )
    made = label_sensitivity_summary(
        rows, [*GRID, "multi_kpi_two_of_three"], entity="entity"
    )
    return rounded(made, "prevalence")


@query(
    "episode_runs",
    f"""WITH {LABELLED},
s AS (SELECT *, coalesce(deterioration_label = 1, false) AND NOT (coalesce(lag(deterioration_label) OVER w = 1, false)
    AND coalesce((year(decision_at) * 4 + quarter(decision_at))
      - lag(year(decision_at) * 4 + quarter(decision_at)) OVER w = 1, false)) AS starts
  FROM lq WINDOW w AS (PARTITION BY entity ORDER BY decision_at))
SELECT decision_key, starts AS deterioration_episode_start,
  CASE WHEN deterioration_label = 1 THEN entity || '|episode_' || CAST(sum(CAST(starts AS INTEGER)) OVER
    (PARTITION BY entity ORDER BY decision_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) END
    AS deterioration_episode_id FROM s""",
)
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_panel(spark, sf_dir).drop("deterioration_episode_start")
    return episode_runs(rows, entity="entity").select(
        "decision_key", "deterioration_episode_start", "deterioration_episode_id"
    )


COOLDOWN = f"""{LABELLED},
ps AS (SELECT entity, list_sort(list(fiscal_year * 4 + fiscal_quarter_number) FILTER (deterioration_label = 1)) AS ps
  FROM lq GROUP BY entity),
st AS (SELECT entity, list_reduce(list_transform(coalesce(ps, []), lambda p: [p]),
    lambda kept, p: CASE WHEN len(kept) = 0 OR p[1] - kept[len(kept)] >= 4 THEN list_concat(kept, p) ELSE kept END,
    CAST([] AS INTEGER[])) AS starts FROM ps),
lc AS (SELECT lq.*, deterioration_label IS NOT NULL AND deterioration_label = 1
    AND list_contains(starts, fiscal_year * 4 + fiscal_quarter_number) AS deterioration_episode_start
  FROM lq JOIN st USING (entity))"""


@query(
    "episode_cooldown_starts",
    f"WITH {COOLDOWN} SELECT decision_key, deterioration_label, deterioration_episode_start FROM lc",
)
def cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_panel(spark, sf_dir).drop("deterioration_episode_start")
    return cooldown_starts(
        rows, entity="entity", time="period_end", label="deterioration_label"
    ).select("decision_key", "deterioration_label", "deterioration_episode_start")


@query(
    "first_breach_lead",
    f"""WITH {SQ}, t AS (SELECT *, CASE WHEN lines % 7 = 0 THEN NULL ELSE coverage END AS cov FROM sq),
a AS (SELECT decision_key, cov, [lead(cov, 1) OVER w, lead(cov, 2) OVER w, lead(cov, 3) OVER w, lead(cov, 4) OVER w] AS nx
  FROM t WINDOW w AS (PARTITION BY entity ORDER BY qpos)),
b AS (SELECT decision_key, cov, nx, list_position(list_transform(nx, lambda v: v IS NULL OR
    (v < 1.5 AND (cov - v) / greatest(abs(cov), 2.220446049250313e-16) >= 0.4)), true) AS p FROM a)
SELECT decision_key, CASE WHEN cov IS NOT NULL AND p > 0 AND nx[p] IS NOT NULL THEN CAST(p AS INTEGER) END
  AS first_breach_lead_quarters FROM b""",
)
def breach_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_panel(spark, sf_dir).withColumn(
        "cov", F.when(F.col("lines") % 7 != 0, F.col("coverage"))
    )
    return first_breach_lead(rows, entity="entity", time="period_end", coverage="cov").select(
        "decision_key", "first_breach_lead_quarters"
    )


@query(
    "event_counts_by_year_sector",
    f"""WITH {COOLDOWN}
SELECT CAST(year(decision_at) AS INTEGER) AS decision_year, sector, CAST(count(deterioration_label) AS BIGINT) AS labeled_rows,
  CAST(count(*) FILTER (deterioration_label = 1) AS BIGINT) AS positive_rows,
  CAST(count(*) FILTER (deterioration_episode_start) AS BIGINT) AS distinct_episodes,
  CAST(count(DISTINCT entity) FILTER (deterioration_episode_start) AS BIGINT) AS affected_companies,
  round(count(*) FILTER (deterioration_label = 1) / greatest(count(deterioration_label), 1), 6) AS row_prevalence
FROM lc GROUP BY 1, 2""",
)
def counts_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_panel(spark, sf_dir).withColumn("decision_year", F.year("decision_at"))
    return rounded(
        event_counts(rows, ["decision_year", "sector"], entity="entity"), "row_prevalence"
    )


ENTRY_SQL = f"""WITH {LABELLED}
SELECT sector, qpos, CAST(count(*) AS BIGINT) AS suppliers, CAST(count(deterioration_label) AS BIGINT) AS labeled,
  CAST(sum(deterioration_label) AS BIGINT) AS positives, round(avg(deterioration_label), 6) AS prevalence
FROM lq GROUP BY 1, 2"""


@query("panel_label_prevalence", ENTRY_SQL)
def panel_label_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel, guarded ratio, forward label and prevalence per region-quarter."""
    rows = labelled_panel(spark, sf_dir)
    y = F.col("deterioration_label")
    return rows.groupBy("sector", "qpos").agg(
        F.count(F.lit(1)).alias("suppliers"),
        F.count(y).alias("labeled"),
        F.sum(y.cast("long")).alias("positives"),
        round_half_away(F.avg(y.cast("double")), 6).alias("prevalence"),
    )


# --- folds -------------------------------------------------------------------------------------

FOLD_ARGS = {
    "holdout_start": "2001-01-01",
    "minimum_training_quarters": 6,
    "validation_window_quarters": 4,
    "step_quarters": 2,
}

FOLDS_SQL = f"""{LABELLED},
dv AS (SELECT * FROM lq WHERE decision_at < DATE '2001-01-01' AND deterioration_label IS NOT NULL),
og AS (SELECT CAST(row_number() OVER (ORDER BY s) AS INTEGER) AS number, CAST(s AS DATE) AS s,
    CAST(s + INTERVAL 12 MONTH AS DATE) AS e
  FROM (SELECT unnest(generate_series(
      (SELECT date_trunc('quarter', min(decision_at)) + INTERVAL 18 MONTH FROM lq WHERE decision_at < DATE '2001-01-01'),
      TIMESTAMP '2000-12-31', INTERVAL 6 MONTH)) AS s)
  WHERE s + INTERVAL 12 MONTH <= TIMESTAMP '2001-01-01'),
asg AS (SELECT number, s, e, decision_key, entity, decision_at, label_available_at,
    CASE WHEN decision_at < s AND label_available_at < s THEN 'TRAIN' WHEN decision_at < s THEN 'EMBARGO'
      WHEN decision_at < e THEN 'VALIDATION' END AS split
  FROM dv, og),
ok AS (SELECT number, s, e, count(DISTINCT CASE WHEN split = 'TRAIN' THEN year(decision_at) * 4 + quarter(decision_at) END) AS tq,
    min(decision_at) FILTER (split = 'TRAIN') AS training_start, max(decision_at) FILTER (split = 'TRAIN') AS training_end,
    count(*) FILTER (split = 'TRAIN') AS training_rows, count(*) FILTER (split = 'VALIDATION') AS validation_rows,
    count(*) FILTER (split = 'EMBARGO') AS embargoed_rows
  FROM asg GROUP BY ALL),
fo AS (SELECT *, format('fold_{{:02d}}', row_number() OVER (ORDER BY number)) AS fold_id FROM ok
  WHERE tq >= 6 AND validation_rows > 0)"""


def fold_tables(spark: SparkSession, sf_dir: str):
    return expanding_window_splits(labelled_panel(spark, sf_dir), entity="entity", **FOLD_ARGS)


@query(
    "expanding_folds_embargo",
    f"""WITH {FOLDS_SQL}
SELECT decision_key, asg.entity, asg.decision_at, fold_id, split FROM asg JOIN fo USING (number) WHERE split IS NOT NULL""",
)
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    assignments, _, _ = fold_tables(spark, sf_dir)
    return assignments


@query(
    "expanding_fold_summary",
    f"""WITH {FOLDS_SQL}
SELECT fold_id, training_start, training_end, s AS validation_start, CAST(e - 1 AS DATE) AS validation_end,
  CAST(training_rows AS BIGINT) AS training_rows, CAST(validation_rows AS BIGINT) AS validation_rows,
  CAST(embargoed_rows AS BIGINT) AS embargoed_rows FROM fo""",
)
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, summary = fold_tables(spark, sf_dir)
    return summary


@query(
    "rolling_origin_folds",
    f"""WITH {LABELLED},
og AS (SELECT CAST(row_number() OVER (ORDER BY s) AS INTEGER) AS number, CAST(s AS DATE) AS s,
    CAST(s + INTERVAL 3 MONTH AS DATE) AS e
  FROM (SELECT unnest(generate_series(TIMESTAMP '1998-01-01', TIMESTAMP '2000-12-31', INTERVAL 3 MONTH)) AS s))
SELECT format('phase3_fold_{{:02d}}', number) AS fold_id, s AS origin, CAST(e - 1 AS DATE) AS validation_end,
  CAST(count(*) AS BIGINT) AS validation_rows, CAST(sum(deterioration_label) AS BIGINT) AS validation_events
FROM lq JOIN og ON decision_at >= s AND decision_at < e WHERE deterioration_label IS NOT NULL
GROUP BY number, s, e HAVING sum(deterioration_label) > 0 AND sum(deterioration_label) < count(*)""",
)
def rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_folds(
        labelled_panel(spark, sf_dir), first_origin="1998-01-01", development_end="2000-12-31"
    )


@query(
    "rolling_training_rows",
    f"""WITH {LABELLED}
SELECT decision_key, decision_at, label_available_at, deterioration_label FROM lq
WHERE deterioration_label IS NOT NULL AND decision_at < DATE '1999-03-01' AND label_available_at < DATE '2000-01-01'""",
)
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rolling_training_rows(
        labelled_panel(spark, sf_dir), "2000-01-01", embargo_quarters=4
    )
    return rows.select("decision_key", "decision_at", "label_available_at", "deterioration_label")


# --- label audits ------------------------------------------------------------------------------

RULE_GRID = [(t, d) for t in (1.0, 1.5, 2.0) for d in (0.3, 0.4, 0.5)]


def _rule_sql(t: float, d: float) -> str:
    return f"""SELECT entity, fiscal_year * 4 + fiscal_quarter_number AS pos, {t}::DOUBLE AS absolute_threshold,
    {d}::DOUBLE AS relative_decline, CASE WHEN future_minimum IS NOT NULL AND coverage <> 0 THEN
      CAST(future_minimum < {t} AND decline >= {d} AS INTEGER) END AS y FROM lq"""


@query(
    "label_rule_sensitivity",
    f"""WITH {LABELLED}, lr AS ({" UNION ALL ".join(_rule_sql(t, d) for t, d in RULE_GRID)}),
ag AS (SELECT absolute_threshold, relative_decline, entity, count(y) AS labeled, count(*) FILTER (y = 1) AS positive,
    list_sort(coalesce(list(pos) FILTER (y = 1), [])) AS ps FROM lr GROUP BY ALL),
st AS (SELECT *, len(list_reduce(list_transform(ps, lambda p: [p]), lambda kept, p: CASE WHEN len(kept) = 0
    OR p[1] - kept[len(kept)] >= 4 THEN list_concat(kept, p) ELSE kept END, CAST([] AS INTEGER[]))) AS starts FROM ag)
SELECT absolute_threshold, relative_decline, CAST(sum(labeled) AS BIGINT) AS labeled_rows, CAST(sum(positive) AS BIGINT) AS positive_rows,
  CAST(sum(starts) AS BIGINT) AS distinct_episodes, CAST(count(*) FILTER (starts > 0) AS BIGINT) AS affected_companies,
  round(sum(positive) / greatest(sum(labeled), 1), 6) AS row_prevalence FROM st GROUP BY 1, 2""",
)
def rule_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = threshold_sensitivity(
        supplier_panel(spark, sf_dir), entity="entity", coverage="coverage"
    )
    return rounded(made, "row_prevalence")


@query(
    "label_edge_cases",
    f"""WITH {LABELLED} SELECT CAST(count(*) FILTER (income < 0) AS BIGINT) AS negative_operating_income_rows,
  CAST(count(*) FILTER (interest < 20000) AS BIGINT) AS invalid_interest_denominator_rows,
  CAST(count(*) FILTER (coverage < 1.5 AND deterioration_label IS NOT NULL) AS BIGINT) AS already_below_threshold_labeled_rows,
  CAST(count(*) FILTER (deterioration_label IS NULL) AS BIGINT) AS missing_future_window_rows FROM lq""",
)
def edge_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_panel(spark, sf_dir).withColumn("bad", F.col("interest") < 20000)
    return label_edge_cases(rows, operating_income="income", invalid="bad")
