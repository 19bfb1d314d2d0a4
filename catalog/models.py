"""Full panel plan, document flattening and the learners (rows-only where seeds decide)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.knowledge import FX, PICK_ORDER, _standalone_sql
from catalog.metrics import panel_scores
from catalog.outcomes import FOLD_ARGS
from catalog.registry import query
from catalog.roles import (
    CONCEPTS,
    SQ,
    filings,
    geography,
    rounded,
    supplier_panel,
    table,
    vintages,
)
from knownat.functions import round_half_away
from knownat.operators import calibration, ensembles, modelling
from knownat.operators.asof import vintage_window_aggregate
from knownat.operators.filings import filing_decisions, point_in_time_rows
from knownat.operators.folds import expanding_window_splits
from knownat.operators.history import entity_rows, rolling_std
from knownat.operators.labels import deterioration_diagnostics
from knownat.operators.peers import peer_context
from knownat.scale import stable
from knownat.sources.documents import company_facts, concept_table, series_observations

# --- documents ---------------------------------------------------------------------------------

TAGS = {
    "revenue": {"preferred_tags": ["tag_A0", "tag_A1"], "statement": "is", "period_type": "duration"},
    "interest_expense": {"preferred_tags": ["tag_N0", "tag_A0"], "statement": "is",
                         "period_type": "duration"},
}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested JSON document per line item, as filers deliver them."""
    rows = filings(spark, sf_dir)
    letter = F.lit(None).cast("string")
    for code, name in CONCEPTS.items():
        letter = F.when(F.col("concept") == name, code).otherwise(letter)
    tag = F.concat(F.lit("tag_"), letter, (F.col("tag_priority") % 2).cast("string"))
    unit = F.when(F.col("tag_priority") == 2, "shares").otherwise("USD")
    seen = F.struct(
        F.date_sub("end_date", F.col("duration_days") - 1).cast("string").alias("start"),
        F.when(F.col("value") > 90000, "not a date").otherwise(F.col("end_date").cast("string")).alias(
            "end"
        ),
        F.col("value").alias("val"),
        F.col("accession_number").alias("accn"),
        F.col("fiscal_year").alias("fy"),
        F.col("fiscal_period").alias("fp"),
        F.when(F.col("value") < 5000, "8-K").otherwise(F.col("form")).alias("form"),
        F.col("filed_at").cast("string").alias("filed"),
    )
    facts = F.create_map(
        F.lit("us-gaap"),
        F.create_map(tag, F.struct(F.create_map(unit, F.array(seen)).alias("units"))),
    )
    payload = F.to_json(
        F.struct(
            F.col("cik").cast("long").alias("cik"),
            F.concat(F.lit("Supplier "), F.col("cik")).alias("entityName"),
            facts.alias("facts"),
        )
    )
    broken = F.when(F.col("value") > 104000, F.lit("{broken")).otherwise(payload)
    return rows.select(broken.alias("payload"))


@query(
    "company_facts_flatten",
    f"""WITH {FX},
c AS (SELECT *, 'tag_' || CASE concept WHEN 'revenue' THEN 'A' WHEN 'interest_expense' THEN 'N' ELSE 'R' END || (tag_priority % 2) AS tag
  FROM fx WHERE tag_priority <> 2 AND value <= 90000 AND value >= 5000 AND form <> '8-K'),
d AS (SELECT * FROM (VALUES ('tag_A0', 'revenue', 0), ('tag_A1', 'revenue', 1), ('tag_N0', 'interest_expense', 0),
    ('tag_A0', 'interest_expense', 1)) t(tag, concept, pr))
SELECT lpad(cik, 10, '0') AS cik, 'Supplier ' || cik AS entity_name, d.concept, d.tag AS taxonomy_tag, CAST(pr AS INTEGER) AS tag_priority,
  CAST(end_date - CAST(duration_days - 1 AS INTEGER) AS DATE) AS start_date, end_date, value, accession_number, fiscal_year,
  CASE q WHEN 4 THEN 'FY' ELSE 'Q' || q END AS fiscal_period, form, filed_at, duration_days
FROM c JOIN d USING (tag)""",
)
def facts_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = company_facts(_documents(spark, sf_dir), concept_table(spark, TAGS))
    return made.select(
        "cik", "entity_name", "concept", "taxonomy_tag", "tag_priority", "start_date", "end_date",
        "value", "accession_number", "fiscal_year", "fiscal_period", "form", "filed_at",
        "duration_days",
    )


@query(
    "series_observations",
    """SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS observation_date,
  CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) AS DATE) AS realtime_start,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS value FROM orders""",
)
def series_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    seen = F.struct(
        F.date_add(day, (F.col("o_orderkey") % 40).cast("int")).cast("string").alias(
            "realtime_start"
        ),
        F.lit("9999-12-31").alias("realtime_end"),
        day.cast("string").alias("date"),
        F.when(F.col("o_orderstatus") == "P", ".")
        .otherwise(F.format_string("%.2f", "o_totalprice"))
        .alias("value"),
    )
    documents = orders.select(
        "o_orderpriority", F.to_json(F.struct(F.array(seen).alias("observations"))).alias("payload")
    )
    made = series_observations(documents, F.col("o_orderpriority"))
    return made.select("series_id", "observation_date", "realtime_start", "value")


# --- the whole panel ---------------------------------------------------------------------------

CUTOFF = "2001-06-30"


@query(
    "point_in_time_panel",
    f"""WITH {FX},
vx AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS observation_date,
    CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) AS DATE) AS available_at,
    CAST(floor(round(sum(o_totalprice), 2) / count(*)) AS DOUBLE) AS value FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1, 2, 3),
dc AS (SELECT cik, fiscal_year AS dfy, q AS dq, min(filed_at) AS decision_at, max(end_date) AS period_end,
    cik || '|' || fiscal_year || '|FQ' || q AS decision_key
  FROM fx WHERE filed_at <= DATE '{CUTOFF}' AND fiscal_year BETWEEN 1996 AND {CUTOFF[:4]}
    AND end_date <= DATE '{CUTOFF}'
    AND starts_with(form, CASE q WHEN 4 THEN '10-K' ELSE '10-Q' END) GROUP BY cik, fiscal_year, q),
known AS (SELECT dc.decision_key, fx.* FROM dc JOIN fx ON fx.cik = dc.cik AND fx.filed_at <= dc.decision_at
    AND year(fx.end_date) <= year(dc.decision_at) AND fx.fiscal_year <= dc.dfy),
pk AS (SELECT * FROM known QUALIFY row_number() OVER (
    PARTITION BY decision_key, cik, concept, fiscal_year, q ORDER BY {PICK_ORDER}) = 1),
{_standalone_sql("pk", "decision_key")},
x AS (SELECT st.*, st.fiscal_year * 4 + st.q AS idx, dfy * 4 + dq AS cur FROM st JOIN dc USING (decision_key)),
y AS (SELECT *, dense_rank() OVER (PARTITION BY decision_key ORDER BY idx DESC) AS back,
    max(idx) OVER (PARTITION BY decision_key) AS newest FROM x WHERE idx <= cur),
g AS (SELECT decision_key,
    max(value) FILTER (idx = cur AND concept = 'total_assets') AS total_assets,
    CASE WHEN count(*) FILTER (back <= 4 AND concept = 'revenue') = 4
      THEN sum(value) FILTER (back <= 4 AND concept = 'revenue') END AS revenue_ttm,
    CASE WHEN count(*) FILTER (back <= 4 AND concept = 'interest_expense') = 4
      THEN sum(value) FILTER (back <= 4 AND concept = 'interest_expense') END AS interest_ttm,
    max(available_at) FILTER (idx BETWEEN cur - 3 AND cur) AS maximum_source_available_at
  FROM y WHERE newest = cur GROUP BY decision_key),
k AS (SELECT g.*, dc.decision_at, dc.period_end, r_name AS sector,
    CASE WHEN abs(interest_ttm) >= 50000 THEN round(revenue_ttm / abs(interest_ttm), 8) END AS cov
  FROM g JOIN dc USING (decision_key) JOIN supplier ON CAST(s_suppkey AS VARCHAR) = dc.cik
  JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
m AS (SELECT p.period_end, p.decision_at, series_id, observation_date, available_at, value,
    row_number() OVER (PARTITION BY p.period_end, p.decision_at, series_id, observation_date ORDER BY available_at DESC) AS rn
  FROM (SELECT DISTINCT period_end, decision_at FROM k) p JOIN vx ON observation_date BETWEEN p.period_end - 92 AND p.period_end
    AND available_at <= p.decision_at),
a AS (SELECT period_end, decision_at, avg(CASE WHEN series_id = '1-URGENT' THEN value END) AS u,
    sum(CASE WHEN series_id = '5-LOW' THEN value END) AS l, max(available_at) AS macro_available_at_max
  FROM m WHERE rn = 1 GROUP BY 1, 2),
z AS (SELECT k.*, u, l, macro_available_at_max, year(k.period_end) || 'Q' || quarter(k.period_end) AS calendar_quarter
  FROM k LEFT JOIN a USING (period_end, decision_at))
SELECT decision_key, decision_at, calendar_quarter, sector, round(revenue_ttm, 2) AS revenue_ttm, round(total_assets, 2) AS total_assets,
  maximum_source_available_at, round(cov, 6) AS coverage, round(u, 6) AS "1-URGENT", round(l, 2) AS "5-LOW", macro_available_at_max,
  round(CASE WHEN cov IS NOT NULL THEN (rank() OVER (PARTITION BY calendar_quarter, sector ORDER BY cov NULLS LAST)
    + (count(*) OVER (PARTITION BY calendar_quarter, sector, cov) - 1) / 2.0) / count(cov) OVER (PARTITION BY calendar_quarter, sector) END, 6)
    AS coverage_sector_percentile FROM z""",
)
def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = filings(spark, sf_dir)
    asked = filing_decisions(facts, cutoff=CUTOFF, first_year=1996)
    known = point_in_time_rows(
        facts, asked, flows=("revenue", "interest_expense"), balances=("total_assets",),
        first_end_year=1990,
    )
    rows = stable(known)  # read for its dates and for its rows
    interest = F.abs(F.col("interest_expense_ttm"))
    rows = rows.withColumn(
        "coverage",
        F.when(interest >= 50000, round_half_away(F.col("revenue_ttm") / interest, 8)),
    )
    places = table(spark, sf_dir, "supplier").join(
        geography(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(F.col("s_suppkey").cast("string").alias("cik"), "sector", "industry")
    rows = vintage_window_aggregate(
        rows.join(places, "cik"), vintages(spark, sf_dir), {"1-URGENT": "mean", "5-LOW": "sum"}
    )
    made = peer_context(rows, kpis=["coverage"])
    return made.select(
        "decision_key",
        "decision_at",
        "calendar_quarter",
        "sector",
        round_half_away("revenue_ttm", 2).alias("revenue_ttm"),
        round_half_away("total_assets", 2).alias("total_assets"),
        "maximum_source_available_at",
        round_half_away("coverage", 6).alias("coverage"),
        round_half_away("1-URGENT", 6).alias("1-URGENT"),
        round_half_away("5-LOW", 2).alias("5-LOW"),
        "macro_available_at_max",
        round_half_away("coverage_sector_percentile", 6).alias("coverage_sector_percentile"),
    )


# --- learners ----------------------------------------------------------------------------------

NUMERIC = ("coverage", "cash_margin", "leverage", "coverage_volatility")
CATEGORICAL = ("sector",)


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deterioration_diagnostics(
        supplier_panel(spark, sf_dir), entity="entity", coverage="coverage"
    )
    line = entity_rows("entity", "qpos")
    return rows.select(
        "decision_key",
        F.col("entity").cast("string").alias("cik"),
        "decision_at",
        "label_available_at",
        "sector",
        "deterioration_label",
        "coverage",
        "cash_margin",
        "leverage",
        rolling_std("coverage", line, 4, 3).alias("coverage_volatility"),
    )


def _out_of_fold(spark: SparkSession, sf_dir: str, name: str, fit) -> DataFrame:
    """Every accepted fold; the labelled feature table is reused by each fit."""
    rows = model_rows(spark, sf_dir).persist()
    args = {**FOLD_ARGS, "minimum_training_quarters": 8}
    assignments, _, summary = expanding_window_splits(rows, **args)
    folds = [r[0] for r in summary.select("fold_id").orderBy("fold_id").collect()]
    return modelling.out_of_fold(rows, assignments.persist(), folds, fit, name=name)


@query("calibrated_logistic_oof")
def logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fit(training: DataFrame):
        return modelling.fit_model(
            "logistic", training, NUMERIC, CATEGORICAL, {"C": 0.1, "positive_weight": 2.0}
        )

    raw = _out_of_fold(spark, sf_dir, "pooled_logistic", fit).persist()
    return calibration.cross_fitted_calibration(raw, ["none", "intercept", "platt", "isotonic"])


@query("boosted_oof")
def boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fit(training: DataFrame):
        return modelling.fit_model(
            "boosting", training, NUMERIC, CATEGORICAL, {"n_estimators": 10, "max_depth": 2}
        )

    return _out_of_fold(spark, sf_dir, "pooled_gradient_boosting", fit)


@query("forest_oof")
def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fit(training: DataFrame):
        return modelling.fit_model(
            "random_forest", training, NUMERIC, CATEGORICAL, {"n_estimators": 20, "max_depth": 4}
        )

    return _out_of_fold(spark, sf_dir, "random_forest", fit)


@query("sector_routed_oof")
def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sectors = [
        r[0] for r in table(spark, sf_dir, "region").select("r_name").orderBy("r_name").collect()
    ]

    def fit(training: DataFrame):
        return modelling.fit_by_sector(
            "logistic", training, NUMERIC, (), {"C": 0.1}, sectors=sectors
        )

    return _out_of_fold(spark, sf_dir, "sector_specific_logistic", fit)


@query("permutation_importance")
def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(spark, sf_dir).where(F.col("deterioration_label").isNotNull()).persist()
    edge = F.lit("1999-07-01").cast("date")
    fit = modelling.fit_model(
        "logistic", rows.where(F.col("label_available_at") < edge), NUMERIC, CATEGORICAL,
        {"C": 0.1, "positive_weight": 2.0},
    )
    losses = modelling.permutation_importance(
        fit, rows.where(F.col("decision_at") >= edge), NUMERIC, repeats=5
    )
    return rounded(
        modelling.importance_summary(losses), "mean_permutation_PR_AUC_loss",
        "positive_permutation_share",
    )


@query(
    "equal_sector_weights",
    f"""WITH {SQ}, c AS (SELECT sector, count(*) AS k FROM sq GROUP BY sector)
SELECT decision_key, round((SELECT sum(k) FROM c) / (SELECT count(*) FROM c) / c.k, 8) AS weight FROM sq JOIN c USING (sector)""",
)
def sector_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = modelling.equal_sector_weight(supplier_panel(spark, sf_dir))
    return made.select("decision_key", round_half_away(modelling.WEIGHT, 8).alias("weight"))


@query("stacked_ensemble")
def stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic stack of two scores, trained on earlier quarters than it is applied to."""
    base = panel_scores(spark, sf_dir)
    rows = base.select(
        "decision_key", "decision_at", "deterioration_label",
        F.explode(
            F.array(
                F.struct(F.lit("a").alias("model"), F.col("probability").alias("probability")),
                F.struct(
                    F.lit("b").alias("model"), (F.col("probability") ** 2).alias("probability")
                ),
            )
        ).alias("m"),
    ).select("decision_key", "decision_at", "deterioration_label", "m.*")
    edge = F.lit("1999-01-01").cast("date")
    return ensembles.stacking(
        rows.where(F.col("decision_at") < edge), rows.where(F.col("decision_at") >= edge),
        ["a", "b"], ["decision_key"],
    )
