"""What was known when: as-of joins, vintages, filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.roles import (
    FX,
    LB,
    SQ,
    VX,
    filings,
    rounded,
    scored_documents,
    supplier_panel,
    table,
    vintages,
)
from knownat.functions import round_half_away
from knownat.operators.asof import (
    asof_join,
    latest_per_key,
    prior_event_rate,
    prior_event_rate_at_origin,
    vintage_window_aggregate,
)
from knownat.operators.filings import (
    filing_decisions,
    normalize_fiscal_quarters,
    pick_fact,
    point_in_time_rows,
    quarterly_wide,
)
from knownat.operators.labels import deterioration_diagnostics
from knownat.scale import percent_rank_average

CUTOFF = "2001-06-30"
FLOWS = ("revenue", "interest_expense")
BALANCES = ("total_assets",)


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    decisions = events.where("event_type = 'purchase'").select(
        "user_id", "event_id", F.col("ts").alias("decision_at")
    )
    observations = events.where("event_type = 'click'").select(
        "user_id",
        F.col("ts").alias("available_at"),
        F.col("event_id").alias("observed_id"),
        F.col("value").alias("observed_value"),
    )
    return decisions, observations


ASOF = """WITH d AS (SELECT user_id, event_id, ts AS decision_at FROM events WHERE event_type = 'purchase'),
o AS (SELECT user_id, ts AS available_at, event_id AS observed_id, value AS observed_value
  FROM events WHERE event_type = 'click')"""


@query(
    "asof_backward_join",
    ASOF + """
SELECT d.user_id, d.event_id, d.decision_at, o.available_at, o.observed_id, o.observed_value
FROM d ASOF LEFT JOIN o ON d.user_id = o.user_id AND d.decision_at >= o.available_at""",
)
def asof_backward_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions, observations = _sides(spark, sf_dir)
    return asof_join(
        decisions,
        observations,
        by=["user_id"],
        decision_id=["event_id"],
        tie_break=["observed_id"],
    )


MACRO_PRIORITIES = {
    "1-URGENT": "mean",
    "2-HIGH": "mean",
    "3-MEDIUM": "sum",
    "5-LOW": "sum",
}


def _macro_sql(priority: str, how: str) -> str:
    chosen = f"CASE WHEN series_id = '{priority}' THEN value END"
    if how == "mean":
        return f'round(avg({chosen}), 6) AS "{priority}"'
    return (
        f"CASE WHEN max(series_id = '{priority}') THEN "
        f'round(coalesce(sum({chosen}), 0), 2) END AS "{priority}"'
    )


@query(
    "vintage_window_aggregate",
    f"""WITH {SQ}, {VX},
w AS (SELECT *, CASE WHEN value > 220000 THEN NULL ELSE value END AS v FROM vx),
p AS (SELECT DISTINCT period_end, decision_at FROM sq),
m AS (SELECT p.period_end, p.decision_at, series_id, observation_date, available_at, v AS value,
    row_number() OVER (PARTITION BY p.period_end, p.decision_at, series_id, observation_date
      ORDER BY available_at DESC) AS rn
  FROM p JOIN w ON observation_date BETWEEN p.period_end - 92 AND p.period_end
    AND available_at <= p.decision_at
  WHERE series_id IN ({", ".join(f"'{s}'" for s in MACRO_PRIORITIES)})),
a AS (SELECT period_end, decision_at, {", ".join(_macro_sql(s, h) for s, h in MACRO_PRIORITIES.items())},
    max(available_at) AS macro_available_at_max
  FROM m WHERE rn = 1 GROUP BY 1, 2)
SELECT sq.decision_key, sq.period_end, sq.decision_at,
  {", ".join(f'a."{s}"' for s in MACRO_PRIORITIES)}, a.macro_available_at_max
FROM sq LEFT JOIN a USING (period_end, decision_at)""",
)
def vintage_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = vintages(spark, sf_dir).withColumn(
        "value", F.when(F.col("value") <= 220000, F.col("value"))
    )
    rows = supplier_panel(spark, sf_dir).select("decision_key", "period_end", "decision_at")
    made = vintage_window_aggregate(rows, known, MACRO_PRIORITIES)
    return made.withColumns(
        {s: round_half_away(F.col(s), 6 if how == "mean" else 2) for s, how in MACRO_PRIORITIES.items()}
    )


PICK_ORDER = """CASE WHEN period_type = 'duration' AND q < 4 AND duration_days BETWEEN 60 AND 130 THEN 0 ELSE 1 END,
      tag_priority, filed_at DESC, duration_days, accession_number DESC, value DESC"""


@query(
    "priority_pick",
    f"""WITH {FX}, r AS (SELECT *, row_number() OVER (PARTITION BY cik, concept, fiscal_year, q
    ORDER BY {PICK_ORDER}) AS rn FROM fx)
SELECT cik, concept, fiscal_year, CASE q WHEN 4 THEN 'FY' ELSE 'Q' || q END AS fiscal_period,
  tag_priority, filed_at, duration_days, accession_number, value FROM r WHERE rn = 1""",
)
def priority_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = pick_fact(
        filings(spark, sf_dir), ["cik", "concept", "fiscal_year", "fiscal_period"]
    )
    return picked.select(
        "cik", "concept", "fiscal_year", "fiscal_period", "tag_priority", "filed_at",
        "duration_days", "accession_number", "value",
    )


def _standalone_sql(source: str, keys: str) -> str:
    """Standalone quarters from picked facts ``source`` with the given extra keys."""
    k = keys
    return f"""
pv AS (SELECT {k}, cik, concept, period_type, fiscal_year,
    max(value) FILTER (q = 1) AS v1, max(value) FILTER (q = 2) AS p2,
    max(value) FILTER (q = 3) AS p3, max(value) FILTER (q = 4) AS p4,
    max(filed_at) FILTER (q = 1) AS f1, max(filed_at) FILTER (q = 2) AS f2,
    max(filed_at) FILTER (q = 3) AS f3, max(filed_at) FILTER (q = 4) AS f4,
    max(duration_days) FILTER (q = 2) AS d2, max(duration_days) FILTER (q = 3) AS d3,
    max(accession_number) FILTER (q = 1) AS a1, max(accession_number) FILTER (q = 2) AS a2,
    max(accession_number) FILTER (q = 3) AS a3, max(accession_number) FILTER (q = 4) AS a4,
    max(tag_priority) FILTER (q = 1) AS t1, max(tag_priority) FILTER (q = 2) AS t2,
    max(tag_priority) FILTER (q = 3) AS t3, max(tag_priority) FILTER (q = 4) AS t4
  FROM {source} GROUP BY ALL),
s2 AS (SELECT *, period_type = 'duration' AS flow,
    period_type = 'duration' AND coalesce(d2 > 130, false) AS c2,
    period_type = 'duration' AND coalesce(d3 > 130, false) AS c3,
    v1 IS NOT NULL AS h1 FROM pv),
s3 AS (SELECT *, p2 IS NOT NULL AND (NOT c2 OR h1) AS h2,
    CASE WHEN c2 THEN p2 - v1 ELSE p2 END AS v2,
    CASE WHEN c2 THEN greatest(f2, f1) ELSE f2 END AS m2 FROM s2),
s4 AS (SELECT *, p3 IS NOT NULL AND (NOT c3 OR (h1 AND h2)) AS h3,
    CASE WHEN c3 THEN p3 - (v1 + v2) ELSE p3 END AS v3,
    CASE WHEN c3 THEN greatest(f3, f1, f2) ELSE f3 END AS m3 FROM s3),
s5 AS (SELECT *, p4 IS NOT NULL AND (NOT flow OR (h1 AND h2 AND h3)) AS h4,
    CASE WHEN flow THEN p4 - (v1 + v2 + v3) ELSE p4 END AS v4,
    CASE WHEN flow THEN greatest(f4, f1, m2, m3) ELSE f4 END AS m4 FROM s4),
st AS (
  SELECT {k}, cik, concept, period_type, fiscal_year, 1 AS q, v1 AS value, f1 AS available_at,
    false AS is_derived, a1 AS accession_number, t1 AS tag_priority FROM s5 WHERE h1
  UNION ALL SELECT {k}, cik, concept, period_type, fiscal_year, 2, v2, m2, c2, a2, t2 FROM s5 WHERE h2
  UNION ALL SELECT {k}, cik, concept, period_type, fiscal_year, 3, v3, m3, c3, a3, t3 FROM s5 WHERE h3
  UNION ALL SELECT {k}, cik, concept, period_type, fiscal_year, 4, v4, m4, flow, a4, t4 FROM s5 WHERE h4)"""


CUT = f"""{FX},
known AS (SELECT * FROM fx WHERE filed_at <= DATE '{CUTOFF}' AND year(end_date) <= {CUTOFF[:4]}),
pk AS (SELECT *, 1 AS one FROM known QUALIFY row_number() OVER (
    PARTITION BY cik, concept, fiscal_year, q ORDER BY {PICK_ORDER}) = 1),
{_standalone_sql("pk", "one")}"""


@query(
    "standalone_quarters_from_cumulative",
    f"""WITH {CUT}
SELECT cik, concept, fiscal_year, 'FQ' || q AS fiscal_quarter, round(value, 2) AS value, available_at,
  is_derived, accession_number FROM st""",
)
def standalone_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = normalize_fiscal_quarters(filings(spark, sf_dir), cutoff=CUTOFF, first_end_year=1990)
    return made.select(
        "cik",
        "concept",
        "fiscal_year",
        "fiscal_quarter",
        round_half_away("value", 2).alias("value"),
        "available_at",
        "is_derived",
        "accession_number",
    )


@query(
    "pivot_long_wide_fallback",
    f"""WITH {CUT},
w AS (SELECT cik, fiscal_year, q, max(available_at) AS quarter_available_at,
    max(value) FILTER (concept = 'revenue') AS short_term_debt,
    max(value) FILTER (concept = 'interest_expense') AS long_term_debt,
    max(value) FILTER (concept = 'total_assets') AS total_debt FROM st GROUP BY ALL)
SELECT cik, fiscal_year, 'FQ' || q AS fiscal_quarter, q AS fiscal_quarter_number, quarter_available_at,
  round(short_term_debt, 2) AS short_term_debt, round(long_term_debt, 2) AS long_term_debt,
  round(coalesce(total_debt, CASE WHEN short_term_debt IS NULL AND long_term_debt IS NULL THEN NULL
    ELSE coalesce(short_term_debt, 0) + coalesce(long_term_debt, 0) END), 2) AS total_debt
FROM w""",
)
def pivot_long_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarters = normalize_fiscal_quarters(
        filings(spark, sf_dir), cutoff=CUTOFF, first_end_year=1990
    )
    names = {"revenue": "short_term_debt", "interest_expense": "long_term_debt",
             "total_assets": "total_debt"}
    renamed = F.lit(None).cast("string")
    for old, new in names.items():
        renamed = F.when(F.col("concept") == old, new).otherwise(renamed)
    wide = quarterly_wide(quarters.withColumn("concept", renamed), list(names.values()))
    return wide.withColumns({c: round_half_away(c, 2) for c in names.values()})


@query(
    "filing_decisions",
    f"""WITH {FX}
SELECT cik, fiscal_year, 'FQ' || q AS fiscal_quarter, min(filed_at) AS decision_at,
  max(end_date) AS period_end, q AS fiscal_quarter_number,
  cik || '|' || fiscal_year || '|FQ' || q AS decision_key
FROM fx WHERE filed_at <= DATE '{CUTOFF}' AND fiscal_year BETWEEN 1996 AND {CUTOFF[:4]}
  AND end_date <= DATE '{CUTOFF}'
    AND starts_with(form, CASE q WHEN 4 THEN '10-K' ELSE '10-Q' END) GROUP BY cik, fiscal_year, q""",
)
def decisions_from_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filing_decisions(filings(spark, sf_dir), cutoff=CUTOFF, first_year=1996)


@query(
    "vintage_panel_latest_known",
    f"""WITH {FX},
dc AS (SELECT cik, fiscal_year AS dfy, q AS dq, min(filed_at) AS decision_at,
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
    CAST(count(DISTINCT idx) FILTER (back <= 4) AS INTEGER) AS ttm_quarters_present,
    max(value) FILTER (idx = cur AND concept = 'revenue') AS revenue,
    max(value) FILTER (idx = cur AND concept = 'interest_expense') AS interest_expense,
    max(value) FILTER (idx = cur AND concept = 'total_assets') AS total_assets,
    CASE WHEN count(*) FILTER (back <= 4 AND concept = 'revenue') = 4
      THEN sum(value) FILTER (back <= 4 AND concept = 'revenue') END AS revenue_ttm,
    CASE WHEN count(*) FILTER (back <= 4 AND concept = 'interest_expense') = 4
      THEN sum(value) FILTER (back <= 4 AND concept = 'interest_expense') END AS interest_expense_ttm,
    array_to_string(list_sort(list(DISTINCT accession_number) FILTER (idx BETWEEN cur - 3 AND cur)), ',') AS accessions,
    max(available_at) FILTER (idx BETWEEN cur - 3 AND cur) AS maximum_source_available_at,
    avg(CASE WHEN tag_priority = 0 THEN 1.0 ELSE 0.0 END) FILTER (idx BETWEEN cur - 3 AND cur) AS preferred_tag_share,
    avg(CASE WHEN is_derived THEN 1.0 ELSE 0.0 END) FILTER (idx BETWEEN cur - 3 AND cur) AS derived_fact_share
  FROM y WHERE newest = cur GROUP BY decision_key)
SELECT g.decision_key, dc.decision_at, ttm_quarters_present, round(revenue, 2) AS revenue,
  round(interest_expense, 2) AS interest_expense, round(total_assets, 2) AS total_assets,
  round(revenue_ttm, 2) AS revenue_ttm, round(interest_expense_ttm, 2) AS interest_expense_ttm,
  accessions, maximum_source_available_at, round(preferred_tag_share, 6) AS preferred_tag_share,
  round(derived_fact_share, 6) AS derived_fact_share
FROM g JOIN dc USING (decision_key)""",
)
def vintage_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = filings(spark, sf_dir)
    asked = filing_decisions(facts, cutoff=CUTOFF, first_year=1996)
    rows = point_in_time_rows(
        facts, asked, flows=FLOWS, balances=BALANCES, first_end_year=1990
    )
    return rows.select(
        "decision_key",
        "decision_at",
        "ttm_quarters_present",
        *[
            round_half_away(c, 2).alias(c)
            for c in ("revenue", "interest_expense", "total_assets", "revenue_ttm",
                      "interest_expense_ttm")
        ],
        F.array_join(F.from_json("accession_numbers_json", "array<string>"), ",").alias(
            "accessions"
        ),
        "maximum_source_available_at",
        round_half_away("preferred_tag_share", 6).alias("preferred_tag_share"),
        round_half_away("derived_fact_share", 6).alias("derived_fact_share"),
    )


LABELLED = f"""{SQ}, d0 AS (SELECT *, qpos - lag(qpos) OVER (PARTITION BY entity ORDER BY qpos) AS step FROM sq),
d1 AS (SELECT *, min(coverage) OVER f AS fmin, count(coverage) OVER f AS fk, count(*) OVER f AS fn,
    min(step) OVER f AS smin, max(step) OVER f AS smax,
    lead(decision_at, 4) OVER (PARTITION BY entity ORDER BY qpos) AS at4
  FROM d0 WINDOW f AS (PARTITION BY entity ORDER BY qpos ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)),
d2 AS (SELECT *, coalesce(fn = 4 AND smin = 1 AND smax = 1, false) AS cont FROM d1),
lq AS (SELECT * EXCLUDE (step, fk, fn, smin, smax, at4, fmin, cont),
    CASE WHEN cont AND fk = 4 AND coverage IS NOT NULL AND coverage <> 0 THEN
      CAST(fmin < 1.5 AND (coverage - fmin) / greatest(abs(coverage), 2.220446049250313e-16) >= 0.4 AS INTEGER) END
      AS deterioration_label,
    CASE WHEN cont THEN at4 END AS label_available_at,
    CASE WHEN cont AND fk = 4 AND coverage IS NOT NULL THEN fmin END AS future_minimum,
    CASE WHEN cont AND fk = 4 AND coverage IS NOT NULL THEN
      (coverage - fmin) / greatest(abs(coverage), 2.220446049250313e-16) END AS decline
  FROM d2)"""


def labelled_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deterioration_diagnostics(
        supplier_panel(spark, sf_dir), entity="entity", coverage="coverage"
    )


@query(
    "prior_event_rate_asof",
    f"""WITH {LABELLED}
SELECT a.decision_key,
  round((coalesce(sum(b.deterioration_label), 0) + 1.0) / (count(b.deterioration_label) + 5.0), 6)
    AS prior_deterioration_rate,
  round(ln(1 + count(b.deterioration_label)), 6) AS prior_deterioration_evidence
FROM lq a LEFT JOIN lq b ON a.entity = b.entity AND b.label_available_at < a.decision_at
  AND b.deterioration_label IS NOT NULL
GROUP BY a.decision_key""",
)
def prior_event_rate_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = prior_event_rate(labelled_panel(spark, sf_dir), entity="entity")
    return rounded(
        made.select("decision_key", "prior_deterioration_rate", "prior_deterioration_evidence"),
        "prior_deterioration_rate",
        "prior_deterioration_evidence",
    )


@query(
    "prior_event_rate_at_origin",
    f"""WITH {LABELLED},
k AS (SELECT entity, count(*) AS n, sum(deterioration_label) AS pos FROM lq
  WHERE deterioration_label IS NOT NULL AND label_available_at < DATE '1999-01-01' GROUP BY entity)
SELECT decision_key, round((coalesce(pos, 0) + 1.0) / (coalesce(n, 0) + 5.0), 6) AS prior_deterioration_rate,
  round(ln(1 + coalesce(n, 0)), 6) AS prior_deterioration_evidence
FROM lq LEFT JOIN k USING (entity) WHERE decision_at >= DATE '1999-01-01'""",
)
def prior_rate_at_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_panel(spark, sf_dir)
    made = prior_event_rate_at_origin(
        rows,
        rows.where(F.col("decision_at") >= F.lit("1999-01-01").cast("date")),
        "1999-01-01",
        entity="entity",
    )
    return rounded(
        made.select("decision_key", "prior_deterioration_rate", "prior_deterioration_evidence"),
        "prior_deterioration_rate",
        "prior_deterioration_evidence",
    )


@query(
    "latest_prediction_per_key",
    f"""WITH {LB}, o AS (SELECT *, unnest([1, 2, 3]) AS k FROM lb),
p AS (SELECT decision_key, model, CAST(DATE '2020-01-01' + CAST(k * 90 + decision_key % 60 AS INTEGER) AS DATE) AS origin,
    round(probability / k, 4) AS probability FROM o WHERE (decision_key + k) % 4 <> 0)
SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY decision_key, model ORDER BY origin DESC) = 1""",
)
def latest_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scored_documents(spark, sf_dir).select(
        "decision_key",
        "model",
        "probability",
        F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"),
    ).where((F.col("decision_key") + F.col("k")) % 4 != 0)
    dated = made.select(
        "decision_key",
        "model",
        F.date_add(
            F.lit("2020-01-01").cast("date"),
            (F.col("k") * 90 + F.col("decision_key") % 60).cast("int"),
        ).alias("origin"),
        round_half_away(F.col("probability") / F.col("k"), 4).alias("probability"),
    )
    return latest_per_key(dated, ["decision_key", "model"], "origin")


@query(
    "json_flatten_rank",
    """WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, event_type, k,
  round((rank() OVER (PARTITION BY event_type ORDER BY k)
    + (count(*) OVER (PARTITION BY event_type, k) - 1) / 2.0::DOUBLE) / count(k) OVER (PARTITION BY event_type), 6) AS k_percentile
FROM e""",
)
def json_flatten_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.from_json("props", "k int")["k"].alias("k")
    )
    return rounded(percent_rank_average(events, ["event_type"], "k", "k_percentile"),
                   "k_percentile")

