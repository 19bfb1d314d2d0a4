"""Calibration, ensembles and champions over the supplier panel's scores, next to their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.audits import AVG_RANK
from catalog.knowledge import LABELLED, labelled_panel
from catalog.metrics import PB, panel_scores, ranking_sql
from catalog.registry import query
from catalog.roles import SQ, rounded, supplier_panel
from knownat.functions import round_half_away
from knownat.operators import (
    calibration, ensembles, folds, history, modelling, profile, ratios, scoring,
)
from knownat.scale import stable

FOLDED = f"""{PB}, f AS (SELECT *, 'fold_' || year(decision_at) AS fold_id FROM pb),
fo AS (SELECT fold_id, CAST(row_number() OVER (ORDER BY min(decision_at), fold_id) - 1 AS INTEGER) AS k FROM f GROUP BY fold_id)"""


def folded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel's scores, a fold per decision year."""
    fold = F.concat(F.lit("fold_"), F.year("decision_at"))
    return panel_scores(spark, sf_dir).withColumn("fold_id", fold)


_CLIP = "greatest(-4.0::DOUBLE, least(4.0::DOUBLE, {}))"
_DET = "(w * (wzz + 1e-6) - wz * wz)"


@query(
    "cross_fitted_lines",
    f"""WITH RECURSIVE {FOLDED},
ce AS (SELECT t.fold_id, f.sector, f.probability AS s, count(*)::DOUBLE AS n, sum(deterioration_label)::DOUBLE AS pos
  FROM f JOIN fo p USING (fold_id) JOIN fo t ON p.k < t.k GROUP BY ALL),
so AS (SELECT fold_id, sector FROM ce GROUP BY ALL HAVING sum(pos) > 0 AND sum(pos) < sum(n)),
z AS (SELECT fold_id, sector, n, pos, ln(c / (1 - c)) AS z FROM (
  SELECT *, least(greatest(s, 1e-6), 1 - 1e-6) AS c FROM ce SEMI JOIN so USING (fold_id, sector))),
nw(m, fold_id, sector, it, a, b) AS (
  SELECT m, fold_id, sector, 0, 1.0::DOUBLE, 0.0::DOUBLE FROM so, (VALUES ('intercept'), ('platt')) v(m)
  UNION ALL
  SELECT m, fold_id, sector, it + 1,
    CASE m WHEN 'platt' THEN a + {_CLIP.format(f"(w * (gz - 1e-6 * a) - wz * g) / {_DET}")} ELSE a END,
    b + CASE m WHEN 'platt' THEN {_CLIP.format(f"((wzz + 1e-6) * g - wz * (gz - 1e-6 * a)) / {_DET}")}
      ELSE {_CLIP.format("g / w")} END
  FROM (SELECT m, fold_id, sector, it, a, b, sum(pos - n * p) AS g, sum((pos - n * p) * z) AS gz,
      sum(n * p * (1 - p)) AS w, sum(n * p * (1 - p) * z) AS wz, sum(n * p * (1 - p) * z * z) AS wzz
    FROM (SELECT nw.*, z.z, z.n, z.pos, 1 / (1 + exp(-(nw.a * z.z + nw.b))) AS p
      FROM nw JOIN z USING (fold_id, sector) WHERE nw.it < 40)
    GROUP BY m, fold_id, sector, it, a, b)),
li AS (SELECT m, fold_id, sector, a, b FROM nw WHERE it = 40
  UNION ALL SELECT 'none', fold_id, sector, 1.0, 0.0 FROM so)
SELECT decision_key, fold_id, sector AS calibration_scope, m AS calibration_method, fo.k AS calibration_training_folds,
  probability AS raw_probability, round(1 / (1 + exp(-(a * ln(c / (1 - c)) + b))), 6) AS probability
FROM (SELECT *, least(greatest(probability, 1e-6), 1 - 1e-6) AS c FROM f) f
JOIN fo USING (fold_id) JOIN li USING (fold_id, sector)""",
)
def cross_fitted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No, intercept and Platt calibration by sector, each fold by all earlier ones."""
    made = calibration.cross_fitted_calibration(
        folded_scores(spark, sf_dir), ["none", "intercept", "platt"], sector_specific=True
    )
    columns = ["decision_key", "fold_id", "calibration_scope", "calibration_method",
               "calibration_training_folds", "raw_probability", "probability"]
    return rounded(made.select(*columns), "probability", digits=6)


@query(
    "cross_fitted_isotonic",
    f"""WITH {FOLDED}, r AS (SELECT * REPLACE (floor(round(probability * 1000) / 10) / 100 AS probability) FROM f),
ce AS (SELECT t.fold_id, r.probability AS s, count(*) AS n, sum(deterioration_label) AS pos
  FROM r JOIN fo p USING (fold_id) JOIN fo t ON p.k < t.k GROUP BY ALL),
so AS (SELECT fold_id FROM ce GROUP BY ALL HAVING sum(pos) > 0 AND sum(pos) < sum(n)),
cu AS (SELECT fold_id, s, row_number() OVER o AS i, sum(n) OVER o AS cn, sum(pos) OVER o AS cp, n, pos
  FROM ce SEMI JOIN so USING (fold_id) WINDOW o AS (PARTITION BY fold_id ORDER BY s)),
ab AS (SELECT a.fold_id, a.i AS a, b.i AS b, (b.cp - a.cp + a.pos)::DOUBLE / (b.cn - a.cn + a.n) AS mean
  FROM cu a JOIN cu b ON a.fold_id = b.fold_id AND a.i <= b.i),
lo AS (SELECT fold_id, a, b, min(mean) OVER (PARTITION BY fold_id, a ORDER BY b DESC) AS low FROM ab),
iso AS (SELECT fold_id, b AS i, max(low) AS v FROM lo GROUP BY ALL),
pt AS (SELECT fold_id, s, v FROM cu JOIN iso USING (fold_id, i)),
q AS (SELECT DISTINCT fold_id, probability AS x FROM r SEMI JOIN so USING (fold_id)),
nb AS (SELECT q.fold_id, x, max(s) FILTER (WHERE s <= x) AS l, min(s) FILTER (WHERE s >= x) AS h
  FROM q JOIN pt USING (fold_id) GROUP BY ALL),
va AS (SELECT nb.fold_id, x, CASE WHEN l IS NULL THEN ph.v WHEN h IS NULL OR l = h THEN pl.v
    ELSE pl.v + (ph.v - pl.v) * (x - l) / (h - l) END AS v
  FROM nb LEFT JOIN pt pl ON pl.fold_id = nb.fold_id AND pl.s = l LEFT JOIN pt ph ON ph.fold_id = nb.fold_id AND ph.s = h)
SELECT decision_key, fold_id, 'isotonic' AS calibration_method, fo.k AS calibration_training_folds,
  probability AS raw_probability, round(v, 8) AS probability
FROM r JOIN fo USING (fold_id) JOIN va ON va.fold_id = r.fold_id AND va.x = r.probability""",
)
def cross_fitted_isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isotonic calibration by pooled blocks; the SQL is the max-min formula of averages."""
    coarse = F.floor(F.round(F.col("probability") * 1000) / 10) / 100
    rows = folded_scores(spark, sf_dir).withColumn("probability", coarse)
    made = calibration.cross_fitted_calibration(rows, ["isotonic"])
    columns = ["decision_key", "fold_id", "calibration_method", "calibration_training_folds",
               "raw_probability", "probability"]
    return rounded(made.select(*columns), "probability", digits=8)


# --- ensembles and champions -------------------------------------------------------------------

#: Three base models; the forest has no score for every fifth quarter of an entity.
BASE = f"""{FOLDED}, ba AS (
  SELECT decision_key, fold_id, deterioration_label, 'xgboost' AS model, probability FROM f
  UNION ALL SELECT decision_key, fold_id, deterioration_label, 'sector_specific_xgboost', sqrt(probability) FROM f
  UNION ALL SELECT decision_key, fold_id, deterioration_label, 'random_forest', 1 - probability * probability FROM f WHERE qpos % 5 <> 0)"""
SHRUNK = "0.5 * {ev} / sum({ev}) OVER ({by}) + 0.5 / count(*) OVER ({by})"


def base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("probability")
    models = F.array_compact(
        F.array(
            F.struct(F.lit("xgboost").alias("model"), p.alias("probability")),
            F.struct(F.lit("sector_specific_xgboost").alias("model"), F.sqrt(p).alias("probability")),
            F.when(
                F.col("qpos") % 5 != 0,
                F.struct(F.lit("random_forest").alias("model"), (1 - p * p).alias("probability")),
            ),
        )
    )
    rows = folded_scores(spark, sf_dir).select(
        "decision_key", "fold_id", "deterioration_label", F.explode(models).alias("m")
    )
    return rows.select("decision_key", "fold_id", "deterioration_label", "m.*")


def _folds(base: DataFrame) -> DataFrame:
    year = F.substring("fold_id", 6, 4).cast("int")
    return base.select("fold_id").distinct().select(
        "fold_id",
        F.make_date(year, F.lit(1), F.lit(1)).alias("origin"),
        F.make_date(year, F.lit(12), F.lit(31)).alias("validation_end"),
    )


_BLEND = "round(sum(probability * weight) / sum(weight), 8)"


@query(
    "rolling_ensembles",
    f"""WITH {BASE}, {ranking_sql("ba", "fold_id, model")},
e AS (SELECT fold_id, k, model, "ROC_AUC" AS roc, greatest("ROC_AUC" - 0.5, 0.001) AS ev FROM rk JOIN fo USING (fold_id)
  WHERE "ROC_AUC" IS NOT NULL),
st AS (SELECT fold_id, model, {SHRUNK.format(ev="ev", by="PARTITION BY fold_id")} AS weight FROM e),
pa AS (SELECT t.fold_id, e.model, e.roc, pow(0.8, row_number() OVER (PARTITION BY t.fold_id, e.model ORDER BY e.k DESC) - 1) AS w
  FROM fo t JOIN e ON e.k < t.k),
pe AS (SELECT fold_id, model, greatest(sum(roc * w) / sum(w) - 0.5, 0.001) AS ev FROM pa GROUP BY ALL),
ap AS (SELECT fold_id, model, {SHRUNK.format(ev="ev", by="PARTITION BY fold_id")} AS weight FROM pe),
ad AS (SELECT * FROM ap UNION ALL SELECT * FROM st WHERE fold_id NOT IN (SELECT fold_id FROM ap)),
tp AS (SELECT fold_id, model, row_number() OVER (PARTITION BY fold_id ORDER BY roc DESC, model) AS place FROM e),
r AS (SELECT decision_key, fold_id, (rank() OVER (PARTITION BY fold_id, model ORDER BY probability)
    + (count(*) OVER (PARTITION BY fold_id, model, probability) - 1) / 2.0) / count(*) OVER (PARTITION BY fold_id, model) AS pr FROM ba)
SELECT decision_key, fold_id, 'ensemble_simple_average' AS model, round(avg(probability), 8) AS probability FROM ba GROUP BY ALL
UNION ALL SELECT decision_key, fold_id, 'ensemble_rank_average', round(avg(pr), 8) FROM r GROUP BY ALL
UNION ALL SELECT decision_key, fold_id, 'ensemble_top3_average', round(avg(probability), 8) FROM ba JOIN tp USING (fold_id, model) WHERE place <= 3 GROUP BY ALL
UNION ALL SELECT decision_key, fold_id, 'ensemble_inner_winner', round(avg(probability), 8) FROM ba JOIN tp USING (fold_id, model) WHERE place = 1 GROUP BY ALL
UNION ALL SELECT decision_key, fold_id, 'ensemble_static_weighted', {_BLEND} FROM ba JOIN st USING (fold_id, model) GROUP BY ALL
UNION ALL SELECT decision_key, fold_id, 'ensemble_adaptive_weighted', {_BLEND} FROM ba JOIN ad USING (fold_id, model) GROUP BY ALL
UNION ALL SELECT decision_key, fold_id, 'ensemble_xgb_sector_blend', round(sum(probability * weight) / sum(weight), 8)
  FROM ba JOIN (VALUES ('xgboost', 0.6::DOUBLE), ('sector_specific_xgboost', 0.4::DOUBLE)) v(model, weight) USING (model) GROUP BY ALL
UNION ALL SELECT decision_key, fold_id, 'ensemble_xgb_rf_blend', round(sum(probability * weight) / sum(weight), 8)
  FROM ba JOIN (VALUES ('xgboost', 0.7::DOUBLE), ('random_forest', 0.3::DOUBLE)) v(model, weight) USING (model) GROUP BY ALL""",
)
def rolling_ensembles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight ensembles of each fold over base scores with gaps; the ninth, stacking, below."""
    made = _ensembles(spark, sf_dir)
    return rounded(made.select("decision_key", "fold_id", "model", "probability"), "probability", digits=8)


def _ensembles(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = stable(base_scores(spark, sf_dir))  # every ensemble reads it
    folds = _folds(base)
    ranked = scoring.ranking_metrics(base, ["fold_id", "model"])
    outer = stable(ranked.where("ROC_AUC IS NOT NULL").select("fold_id", "model", "ROC_AUC"))
    static = ensembles.weight_table(outer, 0.5)
    past = ensembles.weight_table(ensembles.adaptive_scores(outer, folds, decay=0.8), 0.5)
    adaptive = past.unionByName(static.join(past, "fold_id", "left_anti"))
    return ensembles.rolling_ensembles(
        base, folds, ["decision_key", "fold_id"], inner=outer, static=static, adaptive=adaptive,
        stacked=False,
    )


@query(
    "rolling_stacking",
    f"""WITH {BASE},
wi AS (SELECT decision_key, fold_id, deterioration_label, count(*) AS scores, avg(probability) AS mean FROM ba GROUP BY ALL),
hi AS (SELECT t.fold_id, count(DISTINCT deterioration_label) AS classes FROM fo t JOIN fo p ON p.k < t.k
  JOIN wi ON wi.fold_id = p.fold_id AND scores = 3 GROUP BY t.fold_id)
SELECT decision_key, fold_id,
  CASE WHEN scores < 3 THEN 'average_of_present_scores' WHEN classes = 2 THEN 'meta_model' ELSE 'average_without_history' END AS stacking_source,
  CASE WHEN scores = 3 AND classes = 2 THEN NULL ELSE round(mean, 8) END AS fallback,
  TRUE AS in_range
FROM wi LEFT JOIN hi USING (fold_id)""",
)
def rolling_stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every decision: stacked where base scores and history allow, else the average.

    The fitted values themselves are tested against a plain solver.
    """
    base = stable(base_scores(spark, sf_dir))
    made = ensembles.rolling_stacking(base, _folds(base), ["decision_key", "fold_id"])
    p = F.col("probability")
    return made.select(
        "decision_key", "fold_id", "stacking_source",
        F.when(F.col("stacking_source") != "meta_model", round_half_away(p, 8)).alias("fallback"),
        ((p > 0) & (p < 1) | (F.col("stacking_source") != "meta_model")).alias("in_range"),
    )


CHAMPIONS = (
    "xgboost", "ensemble_simple_average", "ensemble_rank_average", "ensemble_top3_average",
    "ensemble_inner_winner", "ensemble_xgb_sector_blend", "ensemble_xgb_rf_blend",
    "ensemble_static_weighted", "ensemble_adaptive_weighted",
)


@query(
    "frozen_champion_scores",
    f"""WITH {BASE}, pa AS (SELECT * FROM ba WHERE fold_id < 'fold_1997'), la AS (SELECT * EXCLUDE (fold_id) FROM ba WHERE fold_id >= 'fold_1997'),
pw AS (SELECT *, 0 AS one FROM pa),
{ranking_sql("pa", "fold_id, model")}, ix AS (SELECT model, "ROC_AUC" AS roc FROM rk WHERE fold_id = 'fold_1996'),
st AS (SELECT model, roc, {SHRUNK.format(ev="greatest(roc - 0.5, 0.001)", by="")} AS weight FROM ix),
am AS (SELECT model, avg("ROC_AUC") AS roc FROM rk WHERE "ROC_AUC" IS NOT NULL GROUP BY model),
ad AS (SELECT model, {SHRUNK.format(ev="greatest(roc - 0.5, 0.001)", by="")} AS weight FROM am),
tp AS (SELECT model, row_number() OVER (ORDER BY roc DESC, model) AS place FROM ix),
r AS (SELECT decision_key, (rank() OVER (PARTITION BY model ORDER BY probability)
    + (count(*) OVER (PARTITION BY model, probability) - 1) / 2.0) / count(*) OVER (PARTITION BY model) AS pr FROM la)
SELECT decision_key, 'xgboost' AS model, round(probability, 8) AS probability FROM la WHERE model = 'xgboost'
UNION ALL SELECT decision_key, 'ensemble_simple_average', round(avg(probability), 8) FROM la GROUP BY ALL
UNION ALL SELECT decision_key, 'ensemble_rank_average', round(avg(pr), 8) FROM r GROUP BY ALL
UNION ALL SELECT decision_key, 'ensemble_top3_average', round(avg(probability), 8) FROM la JOIN tp USING (model) WHERE place <= 3 GROUP BY ALL
UNION ALL SELECT decision_key, 'ensemble_inner_winner', round(avg(probability), 8) FROM la JOIN tp USING (model) WHERE place = 1 GROUP BY ALL
UNION ALL SELECT decision_key, 'ensemble_xgb_sector_blend', round(sum(probability * weight) / sum(weight), 8)
  FROM la JOIN (VALUES ('xgboost', 0.6::DOUBLE), ('sector_specific_xgboost', 0.4::DOUBLE)) v(model, weight) USING (model) GROUP BY ALL
UNION ALL SELECT decision_key, 'ensemble_xgb_rf_blend', round(sum(probability * weight) / sum(weight), 8)
  FROM la JOIN (VALUES ('xgboost', 0.7::DOUBLE), ('random_forest', 0.3::DOUBLE)) v(model, weight) USING (model) GROUP BY ALL
UNION ALL SELECT decision_key, 'ensemble_static_weighted', {_BLEND} FROM la JOIN st USING (model) GROUP BY ALL
UNION ALL SELECT decision_key, 'ensemble_adaptive_weighted', {_BLEND} FROM la JOIN ad USING (model) GROUP BY ALL""",
)
def frozen_champions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each possible champion, frozen on the folds before 1997, on the rows since."""
    base = stable(base_scores(spark, sf_dir))  # every champion reads it
    history = base.where("fold_id < 'fold_1997'")
    scored = base.where("fold_id >= 'fold_1997'").drop("fold_id", "deterioration_label")
    ranked = scoring.ranking_metrics(history.where("fold_id = 'fold_1996'"), ["model"])
    inner = stable(ranked.select("model", "ROC_AUC"))
    whole = None
    for champion in CHAMPIONS:
        made = ensembles.champion_scores(
            champion, scored, ["decision_key"], history=history, inner=inner
        ).select("decision_key", F.lit(champion).alias("model"), "probability")
        whole = made if whole is None else whole.unionByName(made)
    return rounded(whole, "probability", digits=8)


# --- preprocessing and screens -----------------------------------------------------------------

FEATURES = ("coverage", "cash_margin", "leverage")
_FIT = ", ".join(
    f"quantile_cont({f}, 0.01) AS {f}_lo, quantile_cont({f}, 0.5) AS {f}_mid, "
    f"quantile_cont({f}, 0.99) AS {f}_hi, count(*) > count({f}) AS {f}_gap" for f in FEATURES
)
_FILL = "CASE WHEN {f} IS NULL THEN {f}_mid ELSE least(greatest({f}, {f}_lo), {f}_hi) END"
_FILLED = ", ".join(f"{_FILL.format(f=f)} AS {f}" for f in FEATURES)
_MOMENTS = ", ".join(
    f"avg({f}) AS {f}_m, CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END AS {f}_s"
    for f in FEATURES
)
_MADE = ", ".join(
    f"round(({_FILL.format(f='p.' + f).replace('p.' + f + '_', 't.' + f + '_')} - {f}_m) / {f}_s, 6) AS {f}, "
    f"CASE WHEN {f}_gap THEN p.{f} IS NULL END AS {f}_missing" for f in FEATURES
)


@query(
    "fold_preprocessing",
    f"""WITH {SQ}, p AS (SELECT decision_key, 'fold_' || year(decision_at) AS fold_id, year(decision_at) AS y,
  CASE WHEN lines % 5 <> 0 THEN coverage END AS coverage, cash_margin, leverage,
  CASE WHEN qpos % 4 <> 0 THEN industry END AS industry FROM sq WHERE entity % 3 <> 0 OR year(decision_at) > 1994),
tr AS (SELECT v.y AS target, p.* FROM p JOIN (SELECT DISTINCT y FROM p) v ON p.y < v.y),
t AS (SELECT target, {_FIT}, list(DISTINCT industry) AS seen FROM tr GROUP BY target),
mo AS (SELECT target, industry FROM (SELECT target, industry, count(*) AS n FROM tr WHERE industry IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY target ORDER BY n DESC, industry) = 1),
fi AS (SELECT target, {_FILLED} FROM tr JOIN t USING (target)),
ce AS (SELECT target, {_MOMENTS} FROM fi GROUP BY target)
SELECT decision_key, fold_id, {_MADE}, coalesce(p.industry, mo.industry) AS industry,
  list_contains(seen, coalesce(p.industry, mo.industry)) AS industry_seen
FROM p JOIN t ON p.y = t.target JOIN ce ON p.y = ce.target JOIN mo ON p.y = mo.target""",
)
def fold_preprocessing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each year's rows by clips, medians, means and modes of all earlier years."""
    year = F.year("decision_at")
    rows = supplier_panel(spark, sf_dir).where((F.col("entity") % 3 != 0) | (year > 1994)).select(
        "decision_key",
        F.concat(F.lit("fold_"), year).alias("fold_id"),
        F.when(F.col("lines") % 5 != 0, F.col("coverage")).alias("coverage"),
        "cash_margin",
        "leverage",
        F.when(F.col("qpos") % 4 != 0, F.col("industry")).alias("industry"),
    )
    folds = [r[0] for r in rows.select("fold_id").distinct().orderBy("fold_id").collect()]
    names = F.array(*[F.lit(f) for f in folds])
    later = F.filter(names, lambda f: f > F.col("fold_id"))
    training = rows.withColumn("fold_id", F.explode(later))
    fitted = modelling.fold_statistics(training, "fold_id", FEATURES, ["industry"])
    made = modelling.apply_fold_statistics(rows, fitted, "fold_id", FEATURES, ["industry"])
    return rounded(made, *FEATURES)


SCREENED = ("income", "revenue", "assets", "interest", "debt", "coverage", "cash_margin", "leverage", "sparse", "flat")
PROTECTED = ("assets", "coverage")
_LISTED = ", ".join(f"({i}, '{f}')" for i, f in enumerate(SCREENED))
_LONG = " UNION ALL ".join(
    f"SELECT decision_key, '{f}' AS f, CAST({f} AS DOUBLE) AS v FROM sc" for f in SCREENED
)


@query(
    "feature_screens",
    f"""WITH RECURSIVE {SQ}, sc AS (SELECT *, CASE WHEN lines % 2 = 0 THEN revenue END AS sparse, 1.0 AS flat FROM sq),
fe(i, f) AS (VALUES {_LISTED}), lo AS ({_LONG}),
ok AS (SELECT fe.i, fe.f, row_number() OVER (ORDER BY fe.i) AS k FROM fe JOIN (SELECT f, count(v) / count(*)::DOUBLE AS share,
    min(v) AS lo, max(v) AS hi FROM lo GROUP BY f) q USING (f) WHERE 1 - share <= 0.35 AND lo <> hi),
pr AS (SELECT a.f AS feature_a, b.f AS feature_b, a.v AS x, b.v AS y FROM lo a JOIN lo b USING (decision_key)
  JOIN ok oa ON oa.f = a.f JOIN ok ob ON ob.f = b.f WHERE oa.i < ob.i AND a.v IS NOT NULL AND b.v IS NOT NULL),
r AS (SELECT feature_a, feature_b, {AVG_RANK.format(v="x")} AS rx, {AVG_RANK.format(v="y")} AS ry FROM pr),
cl AS (SELECT feature_a, feature_b FROM r GROUP BY ALL HAVING abs(corr(rx, ry)) >= 0.8),
ne AS (SELECT k, f, f IN {PROTECTED} AS core,
    (SELECT coalesce(list(feature_a), []) FROM cl WHERE feature_b = f) || (SELECT coalesce(list(feature_b), []) FROM cl WHERE feature_a = f) AS near FROM ok),
st(k, kept, gone, winner) AS (
  SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[]
  UNION ALL
  SELECT k2,
    CASE WHEN rival IS NULL THEN list_append(kept, f) WHEN NOT core THEN kept
      WHEN rival IN {PROTECTED} THEN list_append(kept, f) ELSE list_append(list_filter(kept, lambda x: x <> rival), f) END,
    CASE WHEN rival IS NULL OR (core AND rival IN {PROTECTED}) THEN gone WHEN core THEN list_append(gone, rival) ELSE list_append(gone, f) END,
    CASE WHEN rival IS NULL OR (core AND rival IN {PROTECTED}) THEN winner WHEN core THEN list_append(winner, f) ELSE list_append(winner, rival) END
  FROM (SELECT st.kept, st.gone, st.winner, ne.k AS k2, ne.f, ne.core, list_filter(st.kept, lambda x: list_contains(ne.near, x))[1] AS rival
    FROM st JOIN ne ON ne.k = st.k + 1) s),
la AS (SELECT * FROM st ORDER BY k DESC LIMIT 1)
SELECT fe.f AS feature, CAST(fe.i AS INTEGER) AS position, fe.f IN {PROTECTED} AS protected_core, ok.f IS NOT NULL AS sound,
  list_contains(kept, fe.f) AS kept, CASE WHEN list_contains(gone, fe.f) THEN winner[list_position(gone, fe.f)] END AS stands_for
FROM fe LEFT JOIN ok USING (f), la""",
)
def feature_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten candidate features through the quality screen and the correlation pruning."""
    rows = supplier_panel(spark, sf_dir).withColumns(
        {"sparse": F.when(F.col("lines") % 2 == 0, F.col("revenue")), "flat": F.lit(1.0)}
    )
    return modelling.feature_screens(
        stable(rows.select(*SCREENED)), SCREENED, protected=PROTECTED, maximum_correlation=0.8
    )


# --- indicators, features, windows of one training fold ----------------------------------------

_KPIS = ("interest_coverage_ttm", "free_cash_flow_margin_ttm", "total_debt_to_assets")


@query(
    "financial_kpis",
    f"""WITH {SQ}, i AS (SELECT decision_key, abs(interest) AS interest, income AS op, cash, debt, assets,
    CASE WHEN lines % 7 = 0 THEN 0 ELSE revenue END AS revenue, CASE WHEN lines % 3 = 0 THEN debt END AS liabilities FROM sq),
k AS (SELECT *, coalesce(interest < 2000, TRUE) AS bi, coalesce(revenue <= 0, TRUE) AS br, coalesce(assets <= 0, TRUE) AS ba,
    cash - 0.1::DOUBLE * assets AS fcf FROM i)
SELECT decision_key, bi AS interest_denominator_invalid, br AS revenue_denominator_invalid, coalesce(op < 0, FALSE) AS negative_operating_income,
  round(CASE WHEN NOT bi AND interest > 0 THEN op / interest END, 6) AS interest_coverage_ttm,
  round(CASE WHEN NOT br THEN fcf / revenue END, 6) AS free_cash_flow_margin_ttm,
  round(CASE WHEN NOT ba THEN debt / assets END, 6) AS total_debt_to_assets,
  round(CASE WHEN NOT br THEN op / revenue END, 6) AS operating_margin_ttm,
  round(CASE WHEN abs(liabilities) > 0 THEN assets / liabilities END, 6) AS current_ratio,
  (bi OR NOT interest > 0) AS interest_coverage_ttm_missing, br AS free_cash_flow_margin_ttm_missing, (ba OR debt IS NULL) AS total_debt_to_assets_missing
FROM k""",
)
def financial_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing-year indicators with the denominators that make them missing."""
    rows = supplier_panel(spark, sf_dir).select(
        "decision_key",
        F.col("interest").alias("interest_expense_ttm"),
        F.when(F.col("lines") % 7 == 0, 0.0).otherwise(F.col("revenue")).alias("revenue_ttm"),
        F.col("assets").alias("total_assets"),
        F.col("income").alias("operating_income_ttm"),
        F.col("cash").alias("operating_cash_flow_ttm"),
        (0.1 * F.col("assets")).alias("capital_expenditures_ttm"),
        F.col("debt").alias("total_debt"),
        F.col("assets").alias("current_assets"),
        F.when(F.col("lines") % 3 == 0, F.col("debt")).alias("current_liabilities"),
    )
    made = ratios.financial_kpis(rows, minimum_interest_expense=2000)
    values = [*_KPIS, "operating_margin_ttm", "current_ratio"]
    return rounded(
        made.select(
            "decision_key", "interest_denominator_invalid", "revenue_denominator_invalid",
            "negative_operating_income", *values, *[f"{k}_missing" for k in _KPIS],
        ),
        *values,
    )


@query(
    "historical_features",
    f"""WITH {SQ}, p AS (SELECT decision_key, entity, decision_at, coverage, revenue, sector, leverage,
    period_end AS a, decision_at - CAST(entity % 9 AS INTEGER) AS m FROM sq)
SELECT decision_key, round(lag(coverage, 1) OVER w, 6) AS coverage_lag1, round(lag(coverage, 2) OVER w, 6) AS coverage_lag2,
  round(lag(coverage, 4) OVER w, 6) AS coverage_lag4, round(coverage - lag(coverage, 4) OVER w, 6) AS coverage_yoy_change,
  round(CASE WHEN count(coverage) OVER f >= 3 THEN stddev_samp(coverage) OVER f END, 5) AS coverage_volatility_4q,
  round(CASE WHEN abs(lag(revenue, 4) OVER w) > 0 THEN revenue / lag(revenue, 4) OVER w - 1 END, 6) AS revenue_yoy_change,
  round(CASE WHEN leverage IS NULL THEN NULL WHEN sector = 'ASIA' THEN leverage ELSE 0 END, 6) AS asia_x_leverage,
  lag(coverage, 4) OVER w IS NULL AS coverage_lag4_missing, coverage IS NULL AS coverage_missing,
  CAST(greatest(a, m) AS DATE) AS feature_available_at
FROM p WINDOW w AS (PARTITION BY entity ORDER BY decision_at), f AS (PARTITION BY entity ORDER BY decision_at ROWS 3 PRECEDING)""",
)
def historical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags, changes, volatility, macro growth, an interaction and gaps of each supplier."""
    panel = supplier_panel(spark, sf_dir).select(
        "decision_key", "entity", "decision_at", "coverage", "revenue", "sector", "leverage",
        F.col("period_end").alias("maximum_source_available_at"),
        F.date_sub("decision_at", (F.col("entity") % 9).cast("int")).alias("macro_available_at_max"),
    )
    made = history.historical_features(
        panel, entity="entity", kpis=("coverage",), macros=("revenue",),
        interactions=(("ASIA", "leverage", "asia_x_leverage"),),
    )
    values = ["coverage_lag1", "coverage_lag2", "coverage_lag4", "coverage_yoy_change",
              "revenue_yoy_change", "asia_x_leverage"]
    return rounded(
        rounded(
            made.select(
                "decision_key", *values, "coverage_volatility_4q", "coverage_lag4_missing",
                "coverage_missing", "feature_available_at",
            ),
            *values,
        ),
        "coverage_volatility_4q", digits=5,
    )


@query(
    "feature_stability",
    f"""WITH {SQ}, lo AS (SELECT year(decision_at) AS y, 'coverage' AS feature, coverage AS v FROM sq
  UNION ALL SELECT year(decision_at), 'cash_margin', cash_margin FROM sq UNION ALL SELECT year(decision_at), 'leverage', leverage FROM sq),
e AS (SELECT y, feature, round(avg(v), 6) AS loss, round(count(*) FILTER (WHERE v > 0.5) / count(*)::DOUBLE, 6) AS share FROM lo GROUP BY ALL)
SELECT feature, CAST(count(*) FILTER (WHERE share >= 0.3) AS BIGINT) AS selected_folds, CAST(count(*) AS BIGINT) AS evaluated_folds,
  round(avg(loss), 9) AS mean_permutation_PR_AUC_loss, round(avg(share), 9) AS mean_positive_permutation_share,
  count(*) FILTER (WHERE share >= 0.3) = count(*) AS selected_in_every_outer_training_fold
FROM e GROUP BY feature""",
)
def feature_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over years as folds: how often a feature passes and what it scores on average."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in FEATURES])
    rows = supplier_panel(spark, sf_dir).select(
        F.year("decision_at").alias("fold_id"), F.explode(pairs).alias("p")
    ).select("fold_id", "p.*")
    share = round_half_away(F.count_if(F.col("v") > 0.5) / F.count(F.lit(1)), 6)
    evidence = rows.groupBy("fold_id", "feature").agg(
        round_half_away(F.avg("v"), 6).alias("mean_permutation_PR_AUC_loss"),
        share.alias("positive_permutation_share"),
    ).withColumn("selected", F.col("positive_permutation_share") >= 0.3)
    made = profile.feature_stability(evidence)
    return rounded(made, "mean_permutation_PR_AUC_loss", "mean_positive_permutation_share", digits=9)


_TRAINING = f"""{LABELLED}, tr AS (SELECT decision_key, decision_at, label_available_at AS av, deterioration_label AS y,
    CAST(year(decision_at) * 4 + quarter(decision_at) - 1 AS INTEGER) AS q FROM lq
  WHERE deterioration_label IS NOT NULL AND decision_at < DATE '2000-01-01'),
oq AS (SELECT q, CAST(row_number() OVER (ORDER BY q) - 1 AS INTEGER) AS i FROM (SELECT DISTINCT q FROM tr)),
nq AS (SELECT count(*) AS n FROM oq)"""
_SPAN = """sp AS (SELECT s.s, oq.q, min(oq.q) OVER (PARTITION BY s.s) AS q0 FROM st s JOIN oq ON oq.i >= s.s AND oq.i < s.s + 4),
me AS (SELECT DISTINCT s, 'fit' AS role, decision_key, y FROM sp JOIN tr ON decision_at < make_date(CAST(q0 // 4 AS INTEGER), CAST(q0 % 4 * 3 + 1 AS INTEGER), 1)
      AND av < make_date(CAST(q0 // 4 AS INTEGER), CAST(q0 % 4 * 3 + 1 AS INTEGER), 1)
  UNION ALL SELECT s, 'validation', decision_key, y FROM sp JOIN tr USING (q))"""


@query(
    "inner_windows",
    f"""WITH {_TRAINING},
al AS (SELECT unnest(range(8, greatest(n - 4 + 1, 8), 4)) AS s FROM nq),
st AS (SELECT s FROM (SELECT s, row_number() OVER (ORDER BY s DESC) AS r FROM al) WHERE r <= 3),
{_SPAN},
ok AS (SELECT s FROM (SELECT s, role FROM me GROUP BY ALL HAVING min(y) <> max(y)) GROUP BY s HAVING count(*) = 2)
SELECT CAST(dense_rank() OVER (ORDER BY s) - 1 AS INTEGER) AS window_number, role, decision_key FROM me SEMI JOIN ok USING (s)""",
)
def inner_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last inner windows of observed quarters, for fitting and for validation."""
    windows = folds.inner_windows(
        _training_fold(spark, sf_dir), minimum_training_quarters=8, validation_quarters=4,
        maximum_windows=3,
    )
    parts = [
        rows.select(F.lit(n).alias("window_number"), F.lit(role).alias("role"), "decision_key")
        for n, window in enumerate(windows)
        for role, rows in zip(("fit", "validation"), window, strict=True)
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "inner_split",
    f"""WITH {_TRAINING}, st AS (SELECT n - 4 AS s FROM nq), {_SPAN} SELECT role, decision_key FROM me""",
)
def inner_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last observed year for validation, labels known before it for fitting."""
    fit, held = folds.inner_split(_training_fold(spark, sf_dir), minimum_quarters=8)
    return fit.select(F.lit("fit").alias("role"), "decision_key").unionByName(
        held.select(F.lit("validation").alias("role"), "decision_key")
    )


def _training_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_panel(spark, sf_dir).where(
        F.col("deterioration_label").isNotNull() & (F.col("decision_at") < "2000-01-01")
    )
