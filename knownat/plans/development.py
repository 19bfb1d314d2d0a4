"""Model development over temporal folds: nested selection, bundles and rolling ensembles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.operators import ensembles
from knownat.operators.asof import prior_event_rate, prior_event_rate_at_origin
from knownat.operators.folds import calibration_split, inner_split, rolling_training_rows
from knownat.operators.calibration import calibrator
from knownat.operators.modelling import (
    FittedModel,
    fit_model,
    nested_select,
    out_of_fold,
    screen_features,
)
from knownat.operators.ratios import category_interactions
from knownat.operators.scoring import LABEL, SCORE, f2_threshold, ranking_metrics, score_cells
from knownat.scale import stable


def classifier_bundle(
    training: DataFrame,
    family: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    parameters: Mapping[str, Any],
    *,
    calibration_quarters: int = 4,
    maximum_alert_rate: float = 0.35,
    label: str = LABEL,
) -> tuple[FittedModel, Any, float]:
    """(model, calibrate, threshold): fitted early, calibrated and thresholded on the last quarters."""
    early, late = calibration_split(training, calibration_quarters, label=label)
    model = fit_model(family, early, numeric, categorical, parameters, label=label)
    raw = stable(model.score(late).select(label, SCORE))
    low, high = raw.agg(F.min(label), F.max(label)).first()
    calibrate = calibrator(raw, "platt", label) if low != high else (lambda df: df)
    cells = score_cells(calibrate(raw), [], label)
    threshold = f2_threshold(cells, [], maximum_alert_rate=maximum_alert_rate).first()
    return model, calibrate, float(threshold["threshold"]) if threshold else 0.5


def temporal_classification(
    features: DataFrame,
    assignments: DataFrame,
    folds: Sequence[str],
    increments: Mapping[str, tuple[Sequence[str], Sequence[str]]],
    families: Mapping[str, Mapping[str, Any]],
    *,
    key: str = "decision_key",
    label: str = LABEL,
    **options,
) -> DataFrame:
    """Calibrated, thresholded validation predictions per fold, feature increment and family."""
    whole: DataFrame | None = None
    for fold in folds:
        keys = assignments.where(F.col("fold_id") == fold).select(key, "split")
        rows = features.where(F.col(label).isNotNull()).join(keys, key)
        training = rows.where("split = 'TRAIN'").drop("split")
        validation = rows.where("split = 'VALIDATION'").drop("split")
        for increment, (numeric, categorical) in increments.items():
            for family, parameters in families.items():
                model, calibrate, threshold = classifier_bundle(
                    training, family, numeric, categorical, parameters, label=label, **options
                )
                made = calibrate(model.score(validation)).select(
                    key,
                    "cik",
                    "decision_at",
                    "sector",
                    label,
                    F.lit(fold).alias("fold_id"),
                    F.lit(family).alias("model"),
                    F.lit(increment).alias("feature_increment"),
                    SCORE,
                    F.lit(threshold).alias("threshold"),
                    (F.col(SCORE) >= threshold).alias("alert"),
                )
                whole = made if whole is None else whole.unionByName(made)
    if whole is None:
        raise ValueError("no folds to run")
    return whole


def nested_architectures(
    features: DataFrame,
    assignments: DataFrame,
    folds: Sequence[str],
    numeric: Sequence[str],
    categorical: Sequence[str],
    *,
    logistic_grid: Sequence[Mapping[str, Any]],
    boosting_grid: Sequence[Mapping[str, Any]],
    interaction_sector: str = "Utilities",
    interaction_features: Sequence[str] = (),
    minimum_training_quarters: int = 12,
    validation_quarters: int = 4,
    maximum_windows: int = 3,
    label: str = LABEL,
) -> tuple[DataFrame, list[dict]]:
    """Pooled logistic, partially pooled logistic and boosting, each tuned inside its fold."""
    inner = {
        "minimum_training_quarters": minimum_training_quarters,
        "validation_quarters": validation_quarters,
        "maximum_windows": maximum_windows,
        "label": label,
    }
    pairs = [
        (interaction_sector, f, f"utility_x_{f}") for f in interaction_features if f in numeric
    ]
    shared = category_interactions(features, "sector", pairs) if pairs else features
    plans = {
        "pooled_logistic": ("logistic", list(numeric), logistic_grid, ("C", "positive_weight")),
        "partially_pooled_logistic": (
            "logistic",
            [*numeric, *[name for _, _, name in pairs]],
            logistic_grid,
            ("C", "positive_weight"),
        ),
        "pooled_gradient_boosting": (
            "boosting", list(numeric), boosting_grid, ("n_estimators", "max_depth"),
        ),
    }
    chosen: list[dict] = []
    whole: DataFrame | None = None
    for name, (family, columns, grid, ties) in plans.items():

        def fit(training: DataFrame, family=family, columns=columns, grid=grid, ties=ties, name=name):
            best = nested_select(
                family, training, columns, categorical, grid, tie_break=ties, **inner
            )
            chosen.append(
                {"architecture": name, **best.parameters, "mean_inner_pr_auc": best.score,
                 "inner_folds": best.windows}
            )
            return fit_model(
                family, training, columns, categorical, best.parameters, label=label
            )

        made = out_of_fold(shared, assignments, folds, fit, name=name, label=label)
        whole = made if whole is None else whole.unionByName(made)
    return whole, chosen


def rolling_development(
    features: DataFrame,
    folds: DataFrame,
    candidates: Sequence[str],
    *,
    protected: Sequence[str],
    categorical: Sequence[str] = ("sector",),
    grids: Mapping[str, Sequence[Mapping[str, Any]]],
    embargo_quarters: int = 4,
    shrinkage: float = 0.5,
    decay: float = 0.8,
    screen: Mapping[str, Any] | None = None,
    label: str = LABEL,
    key: str = "decision_key",
) -> tuple[DataFrame, DataFrame]:
    """(base and ensemble predictions, inner scores) over rolling origins.

    Every origin sees only rows decided before the embargo cut with labels known by then; prior
    event rates, screens, tuning and weights are recomputed from those rows.  The fold list is a
    short table of dates, and one row per fold and model carries the scores.
    """
    spark = features.sparkSession
    lines = folds.orderBy("origin").collect()
    history = ["prior_deterioration_rate", "prior_deterioration_evidence"]
    base: DataFrame | None = None
    inner_rows: list[tuple] = []
    for line in lines:
        training = rolling_training_rows(
            features, line["origin"], embargo_quarters=embargo_quarters, label=label
        )
        validation = features.where(
            (F.col("decision_at") >= F.lit(line["origin"]).cast("timestamp"))
            & (F.col("decision_at") < F.date_add(F.lit(line["validation_end"]), 1))
            & F.col(label).isNotNull()
        )
        scored = prior_event_rate_at_origin(training, validation, str(line["origin"]), label=label)
        training = prior_event_rate(training, label=label)
        numeric = screen_features(
            training, [*candidates, *history], protected=protected, categorical=categorical,
            label=label, key=key, **(screen or {}),
        )
        fit_rows, held = inner_split(training, label=label)
        for family, grid in grids.items():
            tried = []
            for parameters in grid:
                model = fit_model(
                    family, fit_rows, numeric, categorical, parameters, sector=None, label=label
                )
                m = ranking_metrics(model.score(held), [], label).first()
                tried.append((-m["ROC_AUC"], -m["PR_AUC"], len(tried), parameters))
            best = min(tried, key=lambda t: t[:3])
            inner_rows.append((line["fold_id"], family, -best[0], -best[1]))
            final = fit_model(
                family, training, numeric, categorical, best[3], sector=None, label=label
            )
            made = final.score(scored).select(
                key,
                "cik",
                "decision_at",
                "sector",
                label,
                F.lit(line["fold_id"]).alias("fold_id"),
                F.lit(line["origin"]).alias("origin"),
                F.lit(family).alias("model"),
                SCORE,
            )
            base = made if base is None else base.unionByName(made)
    if base is None:
        raise ValueError("no rolling origin to run")
    base = stable(base)
    inner = spark.createDataFrame(
        inner_rows, "fold_id string, model string, ROC_AUC double, PR_AUC double"
    )
    keys = [key, "fold_id"]
    outer = ranking_metrics(base, ["fold_id", "model"], label).select(
        "fold_id", "model", "ROC_AUC"
    )
    static = ensembles.weight_table(inner, shrinkage)
    past = ensembles.weight_table(
        ensembles.adaptive_scores(
            outer, folds.select("fold_id", "origin", "validation_end"), decay=decay
        ),
        shrinkage,
    )
    # Folds without completed predecessors fall back to the static weights.
    adaptive = past.unionByName(static.join(past, "fold_id", "left_anti"))
    whole = base.unionByName(
        ensembles.rolling_ensembles(
            base, folds, keys, inner=inner, static=static, adaptive=adaptive, label=label
        )
    )
    return whole, inner
