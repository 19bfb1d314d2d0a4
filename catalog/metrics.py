"""Ranking, thresholds, calibration, queues, drift, explanations and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.knowledge import LABELLED, labelled_panel
from catalog.registry import query
from catalog.roles import HASH, LB, SQ, scored_documents, supplier_panel, table
from catalog.roles import rounded as rounded_to
from knownat.functions import round_half_away
from knownat.operators import drift, ensembles, resample, scoring
from knownat.operators.explain import ReasonRule, reason_codes
from knownat.operators.labels import episode_runs
from knownat.plans.evidence import development_evidence, sliced_metrics



def rounded(df: DataFrame, *names: str, digits: int = 10) -> DataFrame:
    """Shares of counts often end on a five; ten digits keep both engines off the tie."""
    return rounded_to(df, *names, digits=digits)


# Supplier-panel scores: a rational squash of current coverage, tied by rounding.
SQUASH = "round(0.5 - 0.5 * coverage / (abs(coverage) + 4.0), 3)"


def panel_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("coverage")
    rows = labelled_panel(spark, sf_dir).where(
        c.isNotNull() & F.col("deterioration_label").isNotNull()
    )
    return rows.select(
        "decision_key",
        F.col("entity").cast("string").alias("cik"),
        "decision_at",
        "sector",
        "industry",
        "qpos",
        "deterioration_label",
        round_half_away(0.5 - 0.5 * c / (F.abs(c) + 4.0), 3).alias("probability"),
    )


PB = f"""{LABELLED}, pb AS (SELECT decision_key, CAST(entity AS VARCHAR) AS cik, decision_at, sector, industry, qpos,
  deterioration_label, {SQUASH} AS probability FROM lq WHERE coverage IS NOT NULL AND deterioration_label IS NOT NULL)"""


def ranking_sql(source: str, keys: str) -> str:
    """Step-wise average precision, tie-averaged ROC area and Brier, from row-level windows."""
    k = keys
    return f"""
rk0 AS (SELECT {k}, probability AS p, deterioration_label AS y,
    sum(deterioration_label) OVER (PARTITION BY {k} ORDER BY probability DESC) AS tp,
    count(*) OVER (PARTITION BY {k} ORDER BY probability DESC) AS seen,
    rank() OVER (PARTITION BY {k} ORDER BY probability)
      + (count(*) OVER (PARTITION BY {k}, probability) - 1) / 2.0 AS ar FROM {source}),
rk AS (SELECT {k}, count(*) AS observations, sum(y) AS events, avg(y) AS event_prevalence,
    CASE WHEN sum(y) BETWEEN 1 AND count(*) - 1 THEN sum(CASE WHEN y = 1 THEN tp / seen END) / sum(y) END AS "PR_AUC",
    CASE WHEN sum(y) BETWEEN 1 AND count(*) - 1 THEN (sum(CASE WHEN y = 1 THEN ar END) - sum(y) * (sum(y) + 1) / 2.0)
      / (sum(y) * (count(*) - sum(y))) END AS "ROC_AUC",
    avg((p - y) * (p - y)) AS "Brier_score" FROM rk0 GROUP BY {k})"""


RANK_OUT = """CAST(observations AS BIGINT) AS observations, CAST(events AS BIGINT) AS events,
  round(event_prevalence, 10) AS event_prevalence, round("PR_AUC", 10) AS "PR_AUC", round("ROC_AUC", 10) AS "ROC_AUC",
  round("Brier_score", 10) AS "Brier_score" """
RANKED = ("event_prevalence", "PR_AUC", "ROC_AUC", "Brier_score")


@query(
    "average_precision_roc_brier",
    f"WITH {LB}, {ranking_sql('lb', 'model, sector')} SELECT model, sector, {RANK_OUT} FROM rk",
)
def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scoring.ranking_metrics(scored_documents(spark, sf_dir), ["model", "sector"])
    return rounded(made, *RANKED)


@query(
    "panel_ranking_metrics",
    f"WITH {PB}, pq AS (SELECT *, 1 AS one FROM pb), {ranking_sql('pq', 'one')} SELECT {RANK_OUT} FROM rk",
)
def panel_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.ranking_metrics(panel_scores(spark, sf_dir)), *RANKED)



def confusion_sql(source: str, keys: str, alert: str, name: str = "cf") -> str:
    return f"""
{name}0 AS (SELECT {keys}, count(*) AS n, count(*) FILTER ({alert} AND deterioration_label = 1) AS tp,
    count(*) FILTER ({alert} AND deterioration_label = 0) AS fp,
    count(*) FILTER (NOT ({alert}) AND deterioration_label = 1) AS fn,
    count(*) FILTER (NOT ({alert}) AND deterioration_label = 0) AS tn FROM {source} GROUP BY {keys}),
{name} AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
    CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
    CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS spec,
    (tp + fp) / n AS alert_rate, CASE WHEN tp + fp > 0 THEN fp / (tp + fp) ELSE 0.0 END AS false_alert_rate
  FROM {name}0)"""


@query(
    "threshold_metrics_by_slice",
    f"""WITH {LB}, x AS (SELECT *, 'Overall' AS slice FROM lb UNION ALL SELECT *, sector FROM lb),
{confusion_sql("x", "model, slice", "probability >= 0.45")}
SELECT model, slice, CAST(n AS BIGINT) AS observations, CAST(tp AS BIGINT) AS true_positive, CAST(fp AS BIGINT) AS false_positive,
  CAST(fn AS BIGINT) AS false_negative, CAST(tn AS BIGINT) AS true_negative, round(recall, 10) AS recall,
  round(precision, 10) AS precision, round(f1, 10) AS "F1", round((tp + tn) / n, 10) AS accuracy,
  round((recall + spec) / 2, 10) AS balanced_accuracy, round(alert_rate, 10) AS alert_rate,
  round(false_alert_rate, 10) AS false_alert_rate FROM cf""",
)
def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.with_overall(scored_documents(spark, sf_dir), {"sector": ""})
    made = scoring.confusion_metrics(rows, ["model", "slice"], F.col("probability") >= 0.45)
    return rounded(
        made, "recall", "precision", "F1", "accuracy", "balanced_accuracy", "alert_rate",
        "false_alert_rate",
    )


def queue_sql(source: str, keys: str, order: str, fractions: str) -> str:
    return f"""
qr AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS pos,
    count(*) OVER (PARTITION BY {keys}) AS n, sum(deterioration_label) OVER (PARTITION BY {keys}) AS ev FROM {source}),
qf AS (SELECT qr.*, f, greatest(CAST(ceil(n * f) AS BIGINT), 1) AS k FROM qr, (SELECT unnest({fractions}) AS f))"""


FR = "[0.05::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE]"


@query(
    "review_queue_topk",
    f"""WITH {LB}, {queue_sql("lb", "model", "probability DESC, decision_key", FR)}
SELECT model, f AS review_fraction, CAST(max(k) AS BIGINT) AS companies_quarters_reviewed,
  CAST(sum(deterioration_label) FILTER (pos <= k) AS BIGINT) AS events_captured,
  round(sum(deterioration_label) FILTER (pos <= k) / max(ev), 10) AS event_capture_rate,
  round(sum(deterioration_label) FILTER (pos <= k) / max(k), 10) AS precision,
  round((sum(deterioration_label) FILTER (pos <= k) / max(k)) / (max(ev) / max(n)), 10) AS lift_over_random
FROM qf GROUP BY model, f""",
)
def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scoring.review_queue(scored_documents(spark, sf_dir), ["model"])
    return rounded(made, "event_capture_rate", "precision", "lift_over_random")


EPISODES = f"""{PB},
es AS (SELECT *, deterioration_label = 1 AND NOT (coalesce(lag(deterioration_label) OVER w = 1, false)
    AND coalesce((year(decision_at) * 4 + quarter(decision_at))
      - lag(year(decision_at) * 4 + quarter(decision_at)) OVER w = 1, false)) AS starts
  FROM pb WINDOW w AS (PARTITION BY cik ORDER BY decision_at)),
ep AS (SELECT *, CASE WHEN deterioration_label = 1 THEN cik || '|episode_' || sum(CAST(starts AS INTEGER))
    OVER (PARTITION BY cik ORDER BY decision_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS episode FROM es)"""


@query(
    "episode_capture",
    f"""WITH {EPISODES}, {queue_sql("ep", "sector", "probability DESC, decision_key", FR)}
SELECT sector, f AS review_fraction, CAST(max(k) AS BIGINT) AS company_quarters_reviewed,
  CAST(count(DISTINCT episode) AS BIGINT) AS distinct_episodes,
  CAST(count(DISTINCT episode) FILTER (pos <= k) AS BIGINT) AS episodes_captured,
  round(count(DISTINCT episode) FILTER (pos <= k) / count(DISTINCT episode), 10) AS episode_capture_rate
FROM qf GROUP BY sector, f""",
)
def capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = episode_runs(panel_scores(spark, sf_dir))
    return rounded(scoring.episode_capture(marked, ["sector"]), "episode_capture_rate")


@query(
    "ece_equal_width",
    f"""WITH {LB}, b AS (SELECT model, sector, probability AS p, deterioration_label AS y,
    {" + ".join(f"CAST(probability >= {i} * 0.1::DOUBLE AS INTEGER)" for i in range(1, 10))} AS bin FROM lb),
g AS (SELECT model, sector, bin, count(*) AS n, avg(y) AS o, avg(p) AS e FROM b GROUP BY ALL)
SELECT model, sector, round(sum(n * abs(o - e)) / sum(n), 10) AS calibration_error FROM g GROUP BY 1, 2""",
)
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["model", "sector"]
    cells = scoring.score_cells(scored_documents(spark, sf_dir), keys)
    return rounded(scoring.equal_width_calibration_error(cells, keys), "calibration_error")


QUANTS = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"


@query(
    "ece_quantile_bins",
    f"""WITH {PB}, e AS (SELECT sector, list_distinct(quantile_cont(probability, {QUANTS})) AS ed FROM pb GROUP BY sector),
i AS (SELECT sector, list_sort(ed)[2:len(ed) - 1] AS ed FROM e),
b AS (SELECT sector, probability AS p, deterioration_label AS y,
    len(list_filter(ed, lambda x: x < probability)) AS bin FROM pb JOIN i USING (sector)),
g AS (SELECT sector, bin, count(*) AS n, avg(y) AS o, avg(p) AS m FROM b GROUP BY ALL)
SELECT sector, round(sum(n * abs(o - m)) / sum(n), 10) AS calibration_error FROM g GROUP BY 1""",
)
def ece_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = scoring.score_cells(panel_scores(spark, sf_dir), ["sector"])
    return rounded(scoring.quantile_calibration_error(cells, ["sector"]), "calibration_error")


@query(
    "brier_decomposition",
    f"""WITH {LB}, e AS (SELECT model, sector, list_sort(list_distinct(quantile_cont(probability, {QUANTS}))) AS ed FROM lb GROUP BY ALL),
b AS (SELECT model, sector, probability AS p, deterioration_label AS y,
    len(list_filter(ed[2:len(ed) - 1], lambda x: x <= probability)) AS bin FROM lb JOIN e USING (model, sector)),
t AS (SELECT model, sector, count(*) AS nn, avg(y) AS base, avg((p - y) * (p - y)) AS brier FROM b GROUP BY ALL),
g AS (SELECT model, sector, bin, count(*) AS n, avg(y) AS o, avg(p) AS m FROM b GROUP BY ALL),
d AS (SELECT model, sector, max(brier) AS brier, sum(n / nn * (m - o) * (m - o)) AS rel, sum(n / nn * (o - base) * (o - base)) AS res,
    max(base * (1 - base)) AS unc FROM g JOIN t USING (model, sector) GROUP BY ALL)
SELECT model, sector, round(brier, 10) AS "Brier_score", round(rel, 10) AS reliability, round(res, 10) AS resolution,
  round(unc, 10) AS uncertainty, round(rel - res + unc, 10) AS decomposition_approximation FROM d""",
)
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["model", "sector"]
    cells = scoring.score_cells(scored_documents(spark, sf_dir), keys)
    return rounded(
        scoring.brier_decomposition(cells, keys), "Brier_score", "reliability", "resolution",
        "uncertainty", "decomposition_approximation",
    )


@query(
    "decision_value",
    f"""WITH {LB}, {confusion_sql("lb", "model, sector", "probability >= 0.4")}
SELECT model, sector, CAST(tp AS BIGINT) AS true_positive, CAST(fp AS BIGINT) AS false_positive, CAST(fn AS BIGINT) AS false_negative,
  CAST(0.5 * tp - 1.0 * fp - 5.0 * fn AS DOUBLE) AS net_value, round((0.5 * tp - 1.0 * fp - 5.0 * fn) / n, 10) AS value_per_observation
FROM cf""",
)
def value(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scoring.decision_value(
        scored_documents(spark, sf_dir),
        ["model", "sector"],
        F.col("probability") >= 0.4,
        missed_event_cost=5.0,
        unnecessary_review_cost=1.0,
        correct_alert_benefit=0.5,
    )
    return rounded(made, "value_per_observation")


@query(
    "f2_threshold_grid",
    f"""WITH {LB}, e AS (SELECT model, unnest(list_distinct(quantile_cont(probability,
    [{", ".join(repr(0.5 + 0.45 * i / 18) for i in range(19))}]))) AS t FROM lb GROUP BY model),
c AS (SELECT e.model, t, count(*) AS n, count(*) FILTER (probability >= t) AS a,
    count(*) FILTER (probability >= t AND deterioration_label = 1) AS tp, sum(deterioration_label) AS pos
  FROM lb JOIN e USING (model) GROUP BY ALL),
s AS (SELECT model, t, 5 * (tp / a) * (tp / pos) / greatest(4 * (tp / a) + tp / pos, 2.220446049250313e-16) AS f2
  FROM c WHERE a > 0 AND a / n <= 0.35)
SELECT model, round(t, 10) AS threshold, round(f2, 10) AS f2 FROM s
QUALIFY row_number() OVER (PARTITION BY model ORDER BY f2 DESC, t) = 1""",
)
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = scoring.score_cells(scored_documents(spark, sf_dir), ["model"])
    made = scoring.f2_threshold(cells, ["model"], maximum_alert_rate=0.35)
    return rounded(made, "threshold", "f2")


TARGETS = (0.7, 0.8, 0.9)
RECALL = f"""
rc AS (SELECT model, sector, probability AS p, count(*) OVER w AS a,
    sum(deterioration_label) OVER w AS tp, sum(deterioration_label) OVER (PARTITION BY model, sector) AS ev,
    count(*) OVER (PARTITION BY model, sector) AS n FROM lb
  WINDOW w AS (PARTITION BY model, sector ORDER BY probability DESC)),
rt AS (SELECT DISTINCT model, sector, target, p, a, tp, ev, n FROM rc,
    (SELECT unnest([{", ".join(f"{t}::DOUBLE" for t in TARGETS)}]) AS target) WHERE tp / ev >= target
  QUALIFY row_number() OVER (PARTITION BY model, sector, target ORDER BY p DESC) = 1)"""


@query(
    "recall_first_threshold",
    f"""WITH {LB}, {RECALL}
SELECT model, sector, target AS required_recall, p AS threshold, round(tp / ev, 10) AS recall, round(a / n, 10) AS alert_rate,
  round(tp / a, 10) AS precision FROM rt""",
)
def recall_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = scoring.score_cells(scored_documents(spark, sf_dir), ["model", "sector"])
    made = scoring.recall_first_thresholds(cells, ["model", "sector"], TARGETS)
    return rounded(
        made.select(
            "model", "sector", "required_recall", "threshold", "recall", "alert_rate", "precision"
        ),
        "recall", "alert_rate", "precision",
    )


@query(
    "recall_first_policy",
    f"""WITH {LB}, {RECALL}
SELECT model, target AS required_recall, round(sum(a) / sum(n), 10) AS alert_rate, round(sum(tp) / sum(a), 10) AS precision,
  round(sum(tp) / sum(ev), 10) AS overall_recall, round(min(tp / ev), 10) AS minimum_sector_recall FROM rt GROUP BY 1, 2""",
)
def recall_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = scoring.score_cells(scored_documents(spark, sf_dir), ["model", "sector"])
    chosen = scoring.recall_first_thresholds(cells, ["model", "sector"], TARGETS)
    return rounded(
        scoring.recall_first_policy(chosen, ["model"]), "alert_rate", "precision",
        "overall_recall", "minimum_sector_recall",
    )


MODELS = f"""{LB}, {RECALL},
{ranking_sql("lb", "model").replace("rk0", "ro0").replace("rk AS", "ro AS")},
{ranking_sql("lb", "model, sector").replace("rk0", "rs0").replace("rk AS", "rs AS")},
op AS (SELECT model, sum(tp) AS tp, sum(a) - sum(tp) AS fp, sum(ev) - sum(tp) AS fn, sum(n) - sum(a) - sum(ev) + sum(tp) AS tn,
    sum(n) AS n, min(tp / ev) AS msr FROM rt WHERE target = 0.8 GROUP BY model),
mm AS (SELECT model, ro."ROC_AUC", ro."PR_AUC", ro."Brier_score", (tp + fp) / n AS alert_rate, tp / (tp + fp) AS precision,
    tp / (tp + fn) AS recall, 2.0 * tp / (2 * tp + fp + fn) AS f1, (tp + tn) / n AS accuracy,
    (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced, msr,
    (SELECT min("ROC_AUC") FROM rs WHERE rs.model = ro.model) AS weakest
  FROM ro JOIN op USING (model))"""


@query(
    "model_metrics",
    f"""WITH {MODELS} SELECT model, round("ROC_AUC", 10) AS "ROC_AUC", round("PR_AUC", 10) AS "PR_AUC",
  round("Brier_score", 10) AS "Brier_score", round(alert_rate, 10) AS alert_rate, round(precision, 10) AS precision,
  round(recall, 10) AS recall, round(f1, 10) AS "F1", round(accuracy, 10) AS accuracy, round(balanced, 10) AS balanced_accuracy,
  round(msr, 10) AS minimum_sector_recall, round(weakest, 10) AS "minimum_sector_ROC_AUC" FROM mm""",
)
def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scoring.model_metrics(scored_documents(spark, sf_dir))
    names = (
        "ROC_AUC", "PR_AUC", "Brier_score", "alert_rate", "precision", "recall", "F1", "accuracy",
        "balanced_accuracy", "minimum_sector_recall", "minimum_sector_ROC_AUC",
    )
    return rounded(made.select("model", *names), *names)


@query(
    "champion_choice",
    f"""WITH {MODELS} SELECT model, round("ROC_AUC", 10) AS "ROC_AUC" FROM mm
ORDER BY coalesce("PR_AUC" > 0.412, false) DESC, mm."ROC_AUC" DESC, mm."PR_AUC" DESC, alert_rate, model LIMIT 1""",
)
def champion(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = scoring.model_metrics(scored_documents(spark, sf_dir))
    chosen = scoring.choose_champion(table_, pr_auc_benchmark=0.412)
    return rounded(chosen.select("model", "ROC_AUC"), "ROC_AUC")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(spark, sf_dir).withColumns(
        {
            "feature_increment": F.lit("base"),
            "fold_id": F.concat(F.lit("fold_"), (F.col("decision_key") % 3).cast("string")),
            "threshold": 0.3 + (F.col("decision_key") % 5) * 0.05,
        }
    )


@query(
    "candidate_ranking",
    f"""WITH {LB}, cx AS (SELECT *, 'fold_' || decision_key % 3 AS fold_id, 0.3::DOUBLE + (decision_key % 5) * 0.05::DOUBLE AS th FROM lb),
{ranking_sql("cx", "model").replace("rk0", "ra0").replace("rk AS", "ra AS")},
{ranking_sql("cx", "model, fold_id").replace("rk0", "rf0").replace("rk AS", "rf AS")},
{ranking_sql("cx", "model, sector").replace("rk0", "rs0").replace("rk AS", "rs AS")},
md AS (SELECT model, median(th) AS cut FROM cx GROUP BY model),
cj AS (SELECT cx.*, cut FROM cx JOIN md USING (model)),
{confusion_sql("cj", "model", "probability >= cut")},
{queue_sql("cx", "model", "probability DESC, decision_key", "[0.1::DOUBLE]")},
li AS (SELECT model, (sum(deterioration_label) FILTER (pos <= k) / max(k)) / (max(ev) / max(n)) AS lift FROM qf GROUP BY model),
cal AS (SELECT model, sum(n * abs(o - e)) / sum(n) AS err FROM (SELECT model, bin, count(*) AS n, avg(y) AS o, avg(p) AS e FROM (
    SELECT model, probability AS p, deterioration_label AS y,
      {" + ".join(f"CAST(probability >= {i} * 0.1::DOUBLE AS INTEGER)" for i in range(1, 10))} AS bin FROM cx) GROUP BY ALL) GROUP BY model),
fin AS (SELECT model, ra."PR_AUC" AS pr, ra."Brier_score" AS br, recall, precision, alert_rate, false_alert_rate, lift, err,
    (SELECT stddev_pop("PR_AUC") FROM rf WHERE rf.model = ra.model) AS fs,
    (SELECT stddev_pop("PR_AUC") FROM rs WHERE rs.model = ra.model) AS ss
  FROM ra JOIN cf USING (model) JOIN li USING (model) JOIN cal USING (model))
SELECT model, round(pr, 10) AS "PR_AUC", round(br, 10) AS "Brier_score", round(recall, 10) AS recall, round(precision, 10) AS precision,
  round(alert_rate, 10) AS alert_rate, round(false_alert_rate, 10) AS false_alert_rate, round(lift, 10) AS top_decile_lift,
  round(err, 10) AS calibration_error, round(fs, 10) AS fold_pr_auc_std, round(ss, 10) AS sector_pr_auc_std,
  CAST(row_number() OVER (ORDER BY pr DESC, br, ss, fs, model) AS BIGINT) AS rank,
  row_number() OVER (ORDER BY pr DESC, br, ss, fs, model) = 1 AS selected FROM fin""",
)
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scoring.candidate_ranking(_candidates(spark, sf_dir))
    names = (
        "PR_AUC", "Brier_score", "recall", "precision", "alert_rate", "false_alert_rate",
        "top_decile_lift", "calibration_error", "fold_pr_auc_std", "sector_pr_auc_std",
    )
    return rounded(made.select("model", *names, "rank", "selected"), *names)


@query(
    "sliced_model_metrics",
    f"""WITH {LB}, mt AS (SELECT model, quantile_cont(probability, 0.8) AS cut FROM lb GROUP BY model),
x AS (SELECT lb.*, cut, 'Overall' AS slice FROM lb JOIN mt USING (model) UNION ALL SELECT lb.*, cut, sector FROM lb JOIN mt USING (model)),
{ranking_sql("x", "model, slice")},
{confusion_sql("x", "model, slice", "probability >= cut")}
SELECT model, slice, CAST(observations AS BIGINT) AS observations, round("PR_AUC", 10) AS "PR_AUC", round("Brier_score", 10) AS "Brier_score",
  round(recall, 10) AS recall, round(precision, 10) AS precision, round(alert_rate, 10) AS alert_rate,
  round(false_alert_rate, 10) AS false_alert_rate FROM rk JOIN cf USING (model, slice)""",
)
def sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sliced_metrics(scored_documents(spark, sf_dir))
    names = ("PR_AUC", "Brier_score", "recall", "precision", "alert_rate", "false_alert_rate")
    return rounded(made.select("model", "slice", "observations", *names), *names)


# --- drift -------------------------------------------------------------------------------------


def _periods(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line = table(spark, sf_dir, "lineitem").select(
        "l_shipdate",
        "l_quantity",
        F.when(F.col("l_tax") > 0.01, F.col("l_discount") * 1.0).alias("discount"),
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("price"),
    )
    edge = F.lit("2000-01-01").cast("timestamp")
    now = line.where(F.col("l_shipdate") >= edge).withColumn(
        "price", F.col("price") * 1.25
    ).withColumn("discount", F.when(F.col("l_quantity") < 40, F.col("discount")))
    return line.where(F.col("l_shipdate") < edge), now


PSI_FEATURES = ("l_quantity", "discount", "price")


@query(
    "psi_drift_report",
    f"""WITH l AS (SELECT l_shipdate < TIMESTAMP '2000-01-01' AS was, l_quantity,
    CASE WHEN l_tax > 0.01 THEN l_discount END AS discount,
    CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS price FROM lineitem),
m AS (SELECT was, l_quantity, CASE WHEN was OR l_quantity < 40 THEN discount END AS discount,
    CASE WHEN was THEN price ELSE price * 1.25 END AS price FROM l),
u AS (SELECT was, 'l_quantity' AS feature, l_quantity AS v FROM m UNION ALL SELECT was, 'discount', discount FROM m
  UNION ALL SELECT was, 'price', price FROM m),
e AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, {QUANTS}))) AS ed FROM u WHERE was GROUP BY feature),
b AS (SELECT u.feature, was, v, CASE WHEN v IS NOT NULL THEN len(list_filter(ed[2:len(ed) - 1], lambda x: x <= v)) END AS bin
  FROM u JOIN e USING (feature)),
t AS (SELECT feature, count(v) FILTER (was) AS bw, count(v) FILTER (NOT was) AS bi,
    1 - count(v) FILTER (was) / count(*) FILTER (was) AS rm, 1 - count(v) FILTER (NOT was) / count(*) FILTER (NOT was) AS cm
  FROM b GROUP BY feature),
s AS (SELECT feature, bin, greatest(count(*) FILTER (was) / max(bw), 1e-6) AS r, greatest(count(*) FILTER (NOT was) / max(bi), 1e-6) AS c
  FROM b JOIN t USING (feature) WHERE bin IS NOT NULL GROUP BY feature, bin),
p AS (SELECT feature, sum((c - r) * ln(c / r)) AS psi FROM s GROUP BY feature),
z AS (SELECT feature, psi, rm, cm, CASE WHEN psi >= 0.25 THEN 'escalation' WHEN psi >= 0.1 OR cm - rm >= 0.05 THEN 'warning'
    ELSE 'normal' END AS severity FROM p JOIN t USING (feature))
SELECT feature, round(psi, 10) AS population_stability_index, round(rm, 10) AS reference_missing_rate,
  round(cm, 10) AS current_missing_rate, round(cm - rm, 10) AS missingness_change, severity,
  CASE WHEN severity <> 'normal' THEN 'investigate_before_use' ELSE 'continue_monitoring' END AS action FROM z""",
)
def psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, current = _periods(spark, sf_dir)
    return rounded(
        drift.feature_monitoring(reference, current, PSI_FEATURES),
        "population_stability_index", "reference_missing_rate", "current_missing_rate",
        "missingness_change",
    )


@query(
    "population_mix_change",
    """WITH o AS (SELECT o_orderdate < TIMESTAMP '1999-01-01' AS was, CASE WHEN o_orderkey % 11 = 0 AND o_orderdate >= TIMESTAMP '1999-01-01'
    THEN 'NEW' ELSE o_orderpriority END AS c FROM orders),
g AS (SELECT c, count(*) FILTER (was) AS w, count(*) FILTER (NOT was) AS n FROM o GROUP BY c)
SELECT c AS category, round(w / sum(w) OVER (), 10) AS reference_share, round(n / sum(n) OVER (), 10) AS current_share,
  round(abs(n / sum(n) OVER () - w / sum(w) OVER ()), 10) AS absolute_change FROM g""",
)
def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = F.lit("1999-01-01").cast("timestamp")
    later = F.col("o_orderdate") >= edge
    orders = table(spark, sf_dir, "orders").select(
        "o_orderdate",
        F.when((F.col("o_orderkey") % 11 == 0) & later, "NEW")
        .otherwise(F.col("o_orderpriority"))
        .alias("category"),
    )
    made = drift.mix_change(orders.where(~later), orders.where(later), "category")
    return rounded(made, "reference_share", "current_share", "absolute_change")


@query(
    "operational_monitors",
    f"""WITH {PB}, pq AS (SELECT *, 1 AS one FROM pb), {ranking_sql("pq", "one")},
mx AS (SELECT max(abs(n - w)) AS v FROM (SELECT sector,
    count(*) FILTER (decision_at < DATE '1999-06-01') / sum(count(*) FILTER (decision_at < DATE '1999-06-01')) OVER () AS w,
    count(*) FILTER (decision_at >= DATE '1999-06-01') / sum(count(*) FILTER (decision_at >= DATE '1999-06-01')) OVER () AS n
  FROM sq GROUP BY sector)),
a AS (SELECT avg(deterioration_label) AS er, abs(avg(probability) - avg(deterioration_label)) AS gap,
    avg(CASE WHEN probability >= 0.3 THEN 1.0 ELSE 0.0 END) AS al FROM pb),
v AS (SELECT 'source_freshness' AS monitor, CAST(DATE '2001-12-31' - max(decision_at) AS DOUBLE) AS value FROM sq
  UNION ALL SELECT 'largest_sector_mix_change', v FROM mx UNION ALL SELECT 'matured_event_rate', er FROM a
  UNION ALL SELECT 'ranking_PR_AUC', "PR_AUC" FROM rk UNION ALL SELECT 'calibration_error', gap FROM a
  UNION ALL SELECT 'alert_rate', al FROM a)
SELECT monitor, round(value, 10) AS value, CASE monitor WHEN 'source_freshness' THEN CASE WHEN value < 0 THEN 'failure' ELSE 'normal' END
  WHEN 'largest_sector_mix_change' THEN CASE WHEN value >= 0.05 THEN 'warning' ELSE 'normal' END
  WHEN 'matured_event_rate' THEN 'diagnostic' WHEN 'ranking_PR_AUC' THEN 'development_only'
  WHEN 'calibration_error' THEN CASE WHEN value >= 0.05 THEN 'warning' ELSE 'normal' END
  ELSE CASE WHEN value > 0.5 THEN 'warning' ELSE 'normal' END END AS status FROM v""",
)
def monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = drift.operational_monitors(
        supplier_panel(spark, sf_dir),
        panel_scores(spark, sf_dir),
        boundary="1999-06-01",
        source_cutoff="2001-12-31",
        alert=F.col("probability") >= 0.3,
    )
    return rounded(made.select("monitor", "value", "status"), "value")


# --- explanations ------------------------------------------------------------------------------

RULES = (
    ReasonRule("coverage", "low", "Weak coverage", "Little room for interest."),
    ReasonRule("cash_margin", "low", "Weak cash", "Little cash is left."),
    ReasonRule("leverage", "high", "High leverage", "Debt finances much of the assets."),
    ReasonRule("lines", "high", "Busy", "Many lines."),
)


def _share_sql(feature: str, position: int, direction: str) -> str:
    severity = "1 - share" if direction == "low" else "share"
    return f"""SELECT decision_key, '{feature}' AS feature, {position} AS position, value, share, {severity} AS severity FROM (
    SELECT decision_key, {feature} AS value, (SELECT count(*) FROM ref r WHERE r.{feature} <= s.{feature})
      / (SELECT count({feature}) FROM ref) AS share FROM sc s WHERE {feature} IS NOT NULL)"""


@query(
    "reason_codes_ecdf",
    f"""WITH {SQ}, ref AS (SELECT * FROM sq WHERE decision_at < DATE '1999-01-01'),
sc AS (SELECT * FROM sq WHERE decision_at >= DATE '1999-01-01'),
a AS ({" UNION ALL ".join(_share_sql(r.feature, i, r.direction) for i, r in enumerate(RULES))}),
b AS (SELECT *, row_number() OVER (PARTITION BY decision_key ORDER BY severity DESC, position) AS rn FROM a WHERE severity >= 0.75)
SELECT decision_key, CAST(rn AS INTEGER) AS reason_rank, feature, round(value, 10) AS value,
  round(share, 10) AS development_percentile, round(severity, 10) AS severity FROM b WHERE rn <= 3""",
)
def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_panel(spark, sf_dir)
    edge = F.lit("1999-01-01").cast("date")
    made = reason_codes(
        rows.where(F.col("decision_at") >= edge),
        rows.where(F.col("decision_at") < edge),
        key=["decision_key"],
        rules=RULES,
        maximum=3,
    )
    return rounded(
        made.select(
            "decision_key", "reason_rank", "feature", "value", "development_percentile", "severity"
        ),
        "value", "development_percentile", "severity",
    )


# --- ensembles ---------------------------------------------------------------------------------


def _fold(column: str = "decision_key") -> Column:
    return F.concat(F.lit("fold_"), (F.col(column) % 3).cast("string"))


ENSEMBLE = f"""{LB}, en AS (SELECT *, 'fold_' || decision_key % 3 AS fold_id FROM lb)"""


@query(
    "ensemble_blend_rank_average",
    f"""WITH {ENSEMBLE},
r AS (SELECT decision_key, fold_id, model, (rank() OVER (PARTITION BY fold_id, model ORDER BY probability)
    + (count(*) OVER (PARTITION BY fold_id, model, probability) - 1) / 2.0) / count(*) OVER (PARTITION BY fold_id, model) AS pr FROM en)
SELECT decision_key, 'ensemble_simple_average' AS model, round(avg(probability), 10) AS probability FROM en GROUP BY 1
UNION ALL SELECT decision_key, 'ensemble_rank_average', round(avg(pr), 10) FROM r GROUP BY 1
UNION ALL SELECT decision_key, 'ensemble_fixed_blend', round(sum(CASE model WHEN 'strong' THEN 0.7 ELSE 0.3 END * probability), 10)
  FROM en GROUP BY 1""",
)
def blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_documents(spark, sf_dir).withColumn("fold_id", _fold())
    keys = ["decision_key"]
    made = (
        ensembles.average(rows, keys)
        .unionByName(ensembles.rank_average(rows, keys))
        .unionByName(
            ensembles.fixed_blend(
                rows, {"strong": 0.7, "weak": 0.3}, keys, "ensemble_fixed_blend"
            )
        )
    )
    return rounded(made.select("decision_key", "model", "probability"), "probability")


@query(
    "ensemble_weighted",
    f"""WITH {ENSEMBLE}, {ranking_sql("en", "fold_id, model")},
e AS (SELECT fold_id, model, "ROC_AUC" AS roc, greatest("ROC_AUC" - 0.5, 0.001) AS ev FROM rk),
st AS (SELECT fold_id, model, 0.5 * ev / sum(ev) OVER (PARTITION BY fold_id) + 0.5 / count(*) OVER (PARTITION BY fold_id) AS weight FROM e),
pa AS (SELECT 'fold_' || f AS fold_id, model, sum(roc * pow(0.8, f - 1 - CAST(right(e.fold_id, 1) AS INTEGER)))
      / sum(pow(0.8, f - 1 - CAST(right(e.fold_id, 1) AS INTEGER))) AS roc
  FROM (SELECT unnest([1, 2]) AS f), e WHERE CAST(right(e.fold_id, 1) AS INTEGER) < f GROUP BY f, model),
pe AS (SELECT *, greatest(roc - 0.5, 0.001) AS ev FROM pa),
ad AS (SELECT fold_id, model, 0.5 * ev / sum(ev) OVER (PARTITION BY fold_id) + 0.5 / count(*) OVER (PARTITION BY fold_id) AS weight FROM pe),
tp AS (SELECT fold_id, model, 1.0 AS weight FROM e QUALIFY row_number() OVER (PARTITION BY fold_id ORDER BY roc DESC, model) = 1)
SELECT decision_key, 'ensemble_static_weighted' AS model, round(sum(probability * weight) / sum(weight), 10) AS probability
  FROM en JOIN st USING (fold_id, model) GROUP BY 1
UNION ALL SELECT decision_key, 'ensemble_adaptive_weighted', round(sum(probability * weight) / sum(weight), 10)
  FROM en JOIN ad USING (fold_id, model) GROUP BY 1
UNION ALL SELECT decision_key, 'ensemble_inner_winner', round(sum(probability * weight) / sum(weight), 10)
  FROM en JOIN tp USING (fold_id, model) GROUP BY 1""",
)
def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_documents(spark, sf_dir).withColumn("fold_id", _fold())
    scores = scoring.ranking_metrics(rows, ["fold_id", "model"]).select(
        "fold_id", "model", "ROC_AUC"
    )
    number = F.substring("fold_id", 6, 1).cast("int")
    start = F.lit("2000-01-01").cast("date")
    folds = rows.select("fold_id").distinct().select(
        "fold_id",
        F.date_add(start, number * 10).alias("origin"),
        F.date_add(start, number * 10 + 5).alias("validation_end"),
    )
    past = ensembles.adaptive_scores(scores, folds)
    keys = ["decision_key"]
    made = (
        ensembles.weighted(
            rows, ensembles.weight_table(scores, 0.5), keys, "ensemble_static_weighted"
        )
        .unionByName(
            ensembles.weighted(
                rows, ensembles.weight_table(past, 0.5), keys, "ensemble_adaptive_weighted"
            )
        )
        .unionByName(
            ensembles.weighted(
                rows, ensembles.top_models(scores, 1), keys, "ensemble_inner_winner"
            )
        )
    )
    return rounded(made.select("decision_key", "model", "probability"), "probability")


# --- resampling --------------------------------------------------------------------------------

REPS = 500


def draws_sql(source: str, cluster: str, seed: int, within: str = "") -> str:
    key = f"({within} || ':' || rep || ':' || c.i)" if within else "(rep || ':' || c.i)"
    u = HASH.format(seed=seed, id=key)
    group, same = (f"{within}, ", f"cl.{within} = dr.{within} AND ") if within else ("", "")
    by = f"PARTITION BY {within}" if within else ""
    return f"""
cl AS (SELECT {group}{cluster} AS c, row_number() OVER ({by} ORDER BY {cluster}) AS i, count(*) OVER ({by}) AS size
  FROM (SELECT DISTINCT {group}{cluster} FROM {source})),
dr AS (SELECT {group}rep, CAST(least(floor({u} * size) + 1, size) AS BIGINT) AS pick FROM cl c,
    (SELECT unnest(range(1, {REPS + 1})) AS rep)),
dm AS (SELECT {"cl." if within else ""}{group}rep, cl.c AS c, count(*) AS times FROM dr JOIN cl ON {same}cl.i = dr.pick GROUP BY ALL)"""


INTERVAL = """round(avg(v), 10) AS {c}, round(quantile_cont(v, 0.025), 10) AS {lo}, round(quantile_cont(v, 0.975), 10) AS {hi}"""


@query(
    "clustered_bootstrap_ci",
    f"""WITH {PB}, {draws_sql("pb", "cik", 20260805)},
bx AS (SELECT rep, probability, deterioration_label FROM pb JOIN dm ON dm.c = pb.cik, range(times)),
{ranking_sql("bx", "rep")},
ml AS (SELECT 'PR_AUC' AS metric, "PR_AUC" AS v FROM rk UNION ALL SELECT 'ROC_AUC', "ROC_AUC" FROM rk
  UNION ALL SELECT 'Brier_score', "Brier_score" FROM rk)
SELECT metric, {INTERVAL.format(c="estimate", lo="lower", hi="upper")}, 0.95::DOUBLE AS confidence_level,
  CAST(count(v) AS BIGINT) AS valid_repetitions FROM ml WHERE v IS NOT NULL GROUP BY metric""",
)
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = resample.clustered_bootstrap(panel_scores(spark, sf_dir), repetitions=REPS)
    return rounded(made, "estimate", "lower", "upper")


PAIR = f"""{LB}, wd AS (SELECT decision_key, max(cik) AS cik, max(deterioration_label) AS deterioration_label,
    max(probability) FILTER (model = 'weak') AS b, max(probability) FILTER (model = 'strong') AS c FROM lb GROUP BY decision_key),
sd AS (SELECT cik, deterioration_label, 'b' AS side, b AS probability FROM wd
  UNION ALL SELECT cik, deterioration_label, 'c', c FROM wd)"""


@query(
    "paired_bootstrap",
    f"""WITH {PAIR}, {draws_sql("sd", "cik", 20260805)},
bx AS (SELECT side, rep, probability, deterioration_label FROM sd JOIN dm ON dm.c = sd.cik, range(times)),
{ranking_sql("bx", "side, rep")},
ml AS (SELECT rep, side, 'PR_AUC' AS metric, "PR_AUC" AS v FROM rk UNION ALL SELECT rep, side, 'ROC_AUC', "ROC_AUC" FROM rk
  UNION ALL SELECT rep, side, 'Brier_score', "Brier_score" FROM rk),
df AS (SELECT rep, metric, max(v) FILTER (side = 'c') - max(v) FILTER (side = 'b') AS v FROM ml GROUP BY ALL)
SELECT metric, {INTERVAL.format(c="challenger_minus_baseline", lo="lower_95", hi="upper_95")},
  round(avg(CASE WHEN metric = 'Brier_score' THEN CAST(v < 0 AS DOUBLE) ELSE CAST(v > 0 AS DOUBLE) END), 10)
    AS probability_challenger_better, CAST(count(v) AS BIGINT) AS valid_repetitions
FROM df WHERE v IS NOT NULL GROUP BY metric""",
)
def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = resample.paired_comparison(
        scored_documents(spark, sf_dir), baseline="weak", challenger="strong", repetitions=REPS
    )
    return rounded(
        made, "challenger_minus_baseline", "lower_95", "upper_95", "probability_challenger_better"
    )


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(spark, sf_dir).withColumn(
        "decision_at",
        F.date_add(F.lit("2000-01-01").cast("date"), (F.col("decision_key") % 900).cast("int")),
    )


@query(
    "development_evidence_uncertainty",
    f"""WITH {LB}, {draws_sql("lb", "cik", 20260805, "model")},
bx AS (SELECT lb.model, rep, probability, deterioration_label FROM lb JOIN dm ON dm.c = lb.cik AND dm.model = lb.model, range(times)),
{ranking_sql("bx", "model, rep")},
ml AS (SELECT model, 'PR_AUC' AS metric, "PR_AUC" AS v FROM rk UNION ALL SELECT model, 'ROC_AUC', "ROC_AUC" FROM rk
  UNION ALL SELECT model, 'Brier_score', "Brier_score" FROM rk)
SELECT model, metric, {INTERVAL.format(c="estimate", lo="lower", hi="upper")}, 0.95::DOUBLE AS confidence_level,
  CAST(count(v) AS BIGINT) AS valid_repetitions FROM ml WHERE v IS NOT NULL GROUP BY model, metric""",
)
def evidence_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = development_evidence(_dated(spark, sf_dir), repetitions=REPS)["clustered_uncertainty"]()
    return rounded(made, "estimate", "lower", "upper")


@query(
    "development_evidence_value",
    f"""WITH {LB}, ct AS (SELECT model, unnest({FR}) AS f, unnest(quantile_cont(probability, [0.95, 0.9, 0.8])) AS cut FROM lb GROUP BY model),
vj AS (SELECT lb.*, f, cut FROM lb JOIN ct USING (model)),
{confusion_sql("vj", "model, f, cut", "probability >= cut")}
SELECT model, f AS review_fraction, round(cut, 10) AS threshold, CAST(tp AS BIGINT) AS true_positive, CAST(fp AS BIGINT) AS false_positive,
  CAST(fn AS BIGINT) AS false_negative, CAST(0.0 * tp - 1.0 * fp - 5.0 * fn AS DOUBLE) AS net_value,
  round((0.0 * tp - 1.0 * fp - 5.0 * fn) / n, 10) AS value_per_observation FROM cf""",
)
def evidence_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = development_evidence(_dated(spark, sf_dir), repetitions=REPS)["decision_value"]()
    return rounded(made, "threshold", "value_per_observation")


@query(
    "horizon_differences",
    f"""WITH {LB}, hv AS (SELECT cik, decision_key, deterioration_label, CASE model WHEN 'weak' THEN 2 ELSE 4 END AS horizon, probability,
    probability >= 0.4 AS alert, CAST(decision_key % 4 + 1 AS DOUBLE) AS lead FROM lb),
{draws_sql("hv", "cik", 20260805)},
bx AS (SELECT rep, horizon, probability, deterioration_label, alert, lead FROM hv JOIN dm ON dm.c = hv.cik, range(times)
  UNION ALL SELECT 0, horizon, probability, deterioration_label, alert, lead FROM hv),
{ranking_sql("bx", "horizon, rep")},
om AS (SELECT horizon, rep, count(*) FILTER (alert AND deterioration_label = 1) / sum(deterioration_label) AS recall,
    count(*) FILTER (alert AND deterioration_label = 1) / count(*) FILTER (alert) AS precision,
    count(*) FILTER (alert) / count(*) AS alert_rate, median(lead) FILTER (alert AND deterioration_label = 1) AS med FROM bx GROUP BY ALL),
al AS (SELECT rk.rep, rk.horizon, event_prevalence, "PR_AUC", "Brier_score", recall, precision, alert_rate, med
  FROM rk JOIN om ON om.horizon = rk.horizon AND om.rep = rk.rep),
ln AS (SELECT rep, horizon, unnest(['event_prevalence', 'PR_AUC', 'Brier_score', 'recall', 'precision', 'alert_rate', 'median_warning_lead_quarters'])
    AS metric, unnest([event_prevalence, "PR_AUC", "Brier_score", recall, precision, alert_rate, med]) AS v FROM al),
df AS (SELECT rep, metric, max(v) FILTER (horizon = 2) - max(v) FILTER (horizon = 4) AS v FROM ln GROUP BY ALL)
SELECT metric, round(max(v) FILTER (rep = 0), 10) AS difference, round(quantile_cont(v, 0.025) FILTER (rep > 0), 10) AS clustered_95pct_lower,
  round(quantile_cont(v, 0.975) FILTER (rep > 0), 10) AS clustered_95pct_upper, CAST(count(v) FILTER (rep > 0) AS BIGINT) AS bootstrap_repetitions
FROM df GROUP BY metric""",
)
def horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_documents(spark, sf_dir).withColumns(
        {
            "horizon": F.when(F.col("model") == "weak", 2).otherwise(4),
            "alert": F.col("probability") >= 0.4,
            "warning_lead_quarters": (F.col("decision_key") % 4 + 1).cast("double"),
        }
    )
    made = resample.operating_differences(
        rows, variant="horizon", first=2, second=4, repetitions=REPS
    )
    return rounded(made, "difference", "clustered_95pct_lower", "clustered_95pct_upper")
