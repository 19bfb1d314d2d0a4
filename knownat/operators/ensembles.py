"""Model averaging on a long prediction table (fold, decision, model, probability)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knownat.operators.scoring import ranking_metrics
from knownat.scale import percent_rank_average, stable

MINIMUM_EVIDENCE = 0.001


def shrunk_weights(scores: Mapping[str, float], shrinkage: float) -> dict[str, float]:
    """Nonnegative weights from ROC evidence above one half, shrunk toward equal weights."""
    evidence = {m: max(s - 0.5, MINIMUM_EVIDENCE) for m, s in sorted(scores.items())}
    total, equal = sum(evidence.values()), 1 / len(evidence)
    return {m: (1 - shrinkage) * e / total + shrinkage * equal for m, e in evidence.items()}


def weight_table(
    scores: DataFrame, shrinkage: float, *, groups: Sequence[str] = ("fold_id",),
    score: str = "ROC_AUC", model: str = "model",
) -> DataFrame:
    """The same weights for every group of a (group, model, score) table (a few rows each)."""
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    evidence = F.greatest(F.col(score) - 0.5, F.lit(MINIMUM_EVIDENCE))
    return scores.withColumn("__e", evidence).select(
        *groups,
        model,
        (
            (1 - shrinkage) * F.col("__e") / F.sum("__e").over(whole)
            + shrinkage / F.count(F.lit(1)).over(whole)
        ).alias("weight"),
    )


def adaptive_scores(
    fold_scores: DataFrame,
    folds: DataFrame,
    *,
    decay: float = 0.8,
    score: str = "ROC_AUC",
    model: str = "model",
) -> DataFrame:
    """Decayed mean of a model's scores on folds completed before each origin.

    ``folds`` (fold_id, origin, validation_end) and ``fold_scores`` are one row per fold (and
    model), so the fold pairing is a few hundred rows.
    """
    ends = folds.select(
        F.col("fold_id").alias("__past"), F.col("validation_end").alias("__ended")
    )
    past = folds.join(F.broadcast(ends), F.col("__ended") < F.col("origin"))
    scored = past.join(
        fold_scores.select(F.col("fold_id").alias("__past"), model, score), "__past"
    )
    recent = Window.partitionBy("fold_id", model).orderBy(F.col("__ended").desc())
    aged = scored.withColumn("__w", F.pow(F.lit(decay), F.row_number().over(recent) - 1))
    return aged.groupBy("fold_id", model).agg(
        (F.sum(F.col(score) * F.col("__w")) / F.sum("__w")).alias(score),
        F.count(F.lit(1)).alias("past_outer_windows_used"),
    )


def _rest(df: DataFrame, keys: Sequence[str], model: str, score: str) -> list:
    other = [c for c in df.columns if c not in {*keys, model, score}]
    return [F.max(c).alias(c) for c in other]


def average(
    df: DataFrame, keys: Sequence[str], name: str = "ensemble_simple_average", *,
    model: str = "model", score: str = "probability",
) -> DataFrame:
    blended = df.groupBy(*keys).agg(*_rest(df, keys, model, score), F.avg(score).alias(score))
    return blended.withColumn(model, F.lit(name))


def rank_average(
    df: DataFrame, keys: Sequence[str], *, fold: str = "fold_id", model: str = "model",
    score: str = "probability",
) -> DataFrame:
    """Mean over models of the decision's percentile rank inside its fold."""
    ranked = percent_rank_average(df, [fold, model], score, "__rank")
    replaced = ranked.drop(score).withColumnRenamed("__rank", score)
    return average(replaced, keys, "ensemble_rank_average", model=model, score=score)


def weighted(
    df: DataFrame, weights: DataFrame, keys: Sequence[str], name: str, *,
    groups: Sequence[str] = ("fold_id",), model: str = "model", score: str = "probability",
) -> DataFrame:
    """Weighted mean with a small (groups, model, weight) table; unlisted models drop out."""
    joined = df.join(weights, [*groups, model])  # a row per group and model
    blended = joined.groupBy(*keys).agg(
        *_rest(df, keys, model, score),
        (F.sum(F.col(score) * F.col("weight")) / F.sum("weight")).alias(score),
    )
    return blended.withColumn(model, F.lit(name))


def top_models(
    scores: DataFrame, k: int, *, groups: Sequence[str] = ("fold_id",), score: str = "ROC_AUC",
    model: str = "model",
) -> DataFrame:
    """Equal weights on the k best models of each group."""
    within = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    order = within.orderBy(F.col(score).desc(), F.col(model))
    return (
        scores.withColumn("__r", F.row_number().over(order))
        .where(F.col("__r") <= k)
        .select(*groups, model, F.lit(1.0).alias("weight"))
    )


def fixed_blend(
    df: DataFrame, shares: Mapping[str, float], keys: Sequence[str], name: str, *,
    model: str = "model", score: str = "probability",
) -> DataFrame:
    """Registered blend of a few models; where a member is missing, of those that are there."""
    weight = F.lit(None).cast("double")
    for member, share in shares.items():
        weight = F.when(F.col(model) == member, float(share)).otherwise(weight)
    chosen = df.withColumn("__w", weight).where("__w IS NOT NULL")
    blended = chosen.groupBy(*keys).agg(
        *_rest(df, keys, model, score),
        (F.sum(F.col(score) * F.col("__w")) / F.sum("__w")).alias(score),
    )
    return blended.withColumn(model, F.lit(name))


def _wide(df: DataFrame, models: Sequence[str], keys: Sequence[str], model: str, score: str) -> DataFrame:
    """One row per key: the other columns, ``__x`` (a score per model, in order) and the mean."""
    return df.groupBy(*keys).agg(
        *_rest(df, keys, model, score),
        F.array(*[F.max(F.when(F.col(model) == m, F.col(score))) for m in models]).alias("__x"),
        F.avg(F.when(F.col(model).isin(*models), F.col(score))).alias("__mean"),
    )


def _complete(x: str = "__x"):
    return ~F.exists(x, lambda v: v.isNull())


def fit_stacks(
    rows: DataFrame, groups: Sequence[str], size: int, label: str, c: float
) -> dict[tuple, list[float]]:
    """Ridge logistic weights (intercept last) on ``__x`` for each group, by Newton steps.

    The rows are (groups, ``__x``, label) without nulls.  All groups take a step in one
    aggregate; the driver solves one system of ``size`` + 1 unknowns per group.
    """
    groups, width = list(groups), size + 1
    known = stable(rows.select(*groups, "__x", F.col(label).cast("double").alias("y")))
    fits = {tuple(r): np.zeros(width) for r in known.select(*groups).distinct().collect()}
    settled: dict[tuple, list[float]] = {}
    types = ", ".join(f"{g} {known.schema[g].dataType.simpleString()}" for g in groups)
    ridge = np.diag([1 / c] * size + [0.0])
    for _ in range(60):
        if not fits:
            return settled
        table = known.sparkSession.createDataFrame(
            [(*g, w.tolist()) for g, w in fits.items()], f"{types}, w array<double>"
        )
        x = [F.col("__x")[i] for i in range(size)] + [F.lit(1.0)]
        score = sum((v * F.col("w")[i] for i, v in enumerate(x)), F.lit(0.0))
        p = 1 / (1 + F.exp(-score))
        spread = p * (1 - p)
        pairs = [(i, j) for i in range(width) for j in range(i, width)]
        sums = known.join(F.broadcast(table), groups).groupBy(*groups).agg(  # a row per group
            F.array(*[F.sum((F.col("y") - p) * v) for v in x]).alias("slope"),
            F.array(*[F.sum(spread * x[i] * x[j]) for i, j in pairs]).alias("bend"),
        )
        for row in sums.collect():
            group = tuple(row[g] for g in groups)
            bend = np.zeros((width, width))
            for (i, j), value in zip(pairs, row.bend, strict=True):
                bend[i, j] = bend[j, i] = value
            now = fits[group]
            step = np.linalg.solve(bend + ridge + 1e-12 * np.eye(width), np.array(row.slope) - ridge @ now)
            step *= min(1.0, 8.0 / max(1e-300, float(np.abs(step).max())))
            fits[group] = now + step
            if np.abs(step).max() < 1e-9:
                settled[group] = fits.pop(group).tolist()
    raise ValueError(f"stacking of {sorted(fits, key=repr)} does not settle")


def _stacked(wide: DataFrame, keys: Sequence[str], model: str, score: str, name: str) -> DataFrame:
    """Rows with ``w`` (null: no fit) to the stack's score, or the mean of what is there."""
    size = F.size("__x")
    dot = F.aggregate(
        F.zip_with("__x", F.slice("w", F.lit(1), size), lambda v, w: v * w),
        F.element_at("w", -1), lambda total, v: total + v,
    )
    usable = _complete() & F.col("w").isNotNull()
    source = (
        F.when(usable, "meta_model").when(~_complete(), "average_of_present_scores")
        .otherwise("average_without_history")
    )
    rest = [c for c in wide.columns if c not in {*keys, "__x", "__mean", "w"}]
    return wide.select(
        *keys, *rest,
        F.when(usable, 1 / (1 + F.exp(-dot))).otherwise(F.col("__mean")).alias(score),
        F.lit(name).alias(model),
        source.alias("stacking_source"),
    )


def stacking(
    training: DataFrame,
    scoring: DataFrame,
    models: Sequence[str],
    keys: Sequence[str],
    *,
    c: float = 0.10,
    label: str = "deterioration_label",
    model: str = "model",
    score: str = "probability",
) -> DataFrame:
    """Ridge logistic on base probabilities of completed folds, applied to ``scoring``.

    Every decision gets a row: one that lacks a base score, or has no training rows of both
    classes behind it, takes the mean of the scores it has; ``stacking_source`` says which.
    """
    names = sorted(models)
    meta = _wide(training, names, keys, model, score).where(_complete() & F.col(label).isNotNull())
    both = meta.select(F.lit(0).alias("__g"), "__x", label)
    low, high = both.agg(F.min(label), F.max(label)).first()
    fitted = fit_stacks(both, ["__g"], len(names), label, c) if low != high else {}
    weights = fitted.get((0,))
    w = F.array(*map(F.lit, weights)) if weights else F.lit(None).cast("array<double>")
    wide = _wide(scoring, names, keys, model, score).withColumn("w", w)
    return _stacked(wide, keys, model, score, "ensemble_stacking")


def rolling_stacking(
    df: DataFrame, folds: DataFrame, keys: Sequence[str], *, c: float = 0.10,
    fold: str = "fold_id", label: str = "deterioration_label", model: str = "model",
    score: str = "probability",
) -> DataFrame:
    """Stacking of each fold on the folds completed before its origin, all fits together.

    ``folds`` is (fold_id, origin, validation_end), a few rows.  Fallbacks as in
    :func:`stacking`; ``keys`` must contain the fold.
    """
    names = sorted(r[0] for r in df.select(model).distinct().collect())  # the base models
    wide = stable(_wide(df, names, keys, model, score))
    ends = folds.select(F.col(fold).alias("__past"), "validation_end")
    past = folds.select(F.col(fold).alias("__target"), "origin").join(
        F.broadcast(ends), F.col("validation_end") < F.col("origin")
    ).select("__target", "__past")
    known = wide.where(_complete() & F.col(label).isNotNull()).select(
        F.col(fold).alias("__past"), "__x", label
    )
    rows = known.join(F.broadcast(past), "__past")  # pairs of folds
    sound = rows.groupBy("__target").agg(
        F.min(label).alias("low"), F.max(label).alias("high")
    ).where("low < high").select("__target")
    fits = fit_stacks(rows.join(F.broadcast(sound), "__target"), ["__target"], len(names), label, c)
    table = df.sparkSession.createDataFrame(
        [(g[0], w) for g, w in fits.items()], f"{fold} string, w array<double>"
    )
    return _stacked(
        wide.join(F.broadcast(table), fold, "left"), keys, model, score, "ensemble_stacking"
    )



def registered_blends(sector_share: float = 0.40) -> dict[str, dict[str, float]]:
    """The two-model blends and the share of each member."""
    return {
        "ensemble_xgb_sector_blend": {
            "xgboost": 1.0 - sector_share, "sector_specific_xgboost": sector_share,
        },
        "ensemble_xgb_rf_blend": {"xgboost": 0.70, "random_forest": 0.30},
    }


def rolling_ensembles(
    base: DataFrame, folds: DataFrame, keys: Sequence[str], *, inner: DataFrame,
    static: DataFrame, adaptive: DataFrame, blends: Mapping[str, Mapping[str, float]] | None = None,
    label: str = "deterioration_label", model: str = "model", score: str = "probability",
    stacked: bool = True,
) -> DataFrame:
    """All ensembles of each fold: averages, leaders, weights, fixed blends and stacking.

    A blend whose members are not all among the base models is left out, as are the stacks, which
    are fitted when they are asked for, without ``stacked``.  Every ensemble reads ``base``: hand
    it over checkpointed if it is costly to make.
    """
    blends = registered_blends() if blends is None else blends
    present = {r[0] for r in base.select(model).distinct().collect()}
    names = {"model": model, "score": score}
    columns = base.columns
    parts = [
        average(base, keys, **names),
        rank_average(base, keys, **names),
        weighted(base, top_models(inner, 3), keys, "ensemble_top3_average", **names),
        weighted(base, top_models(inner, 1), keys, "ensemble_inner_winner", **names),
        weighted(base, static, keys, "ensemble_static_weighted", **names),
        weighted(base, adaptive, keys, "ensemble_adaptive_weighted", **names),
        *([rolling_stacking(base, folds, keys, label=label, **names)] if stacked else []),
        *[
            fixed_blend(base, shares, keys, name, **names)
            for name, shares in blends.items() if set(shares) <= present
        ],
    ]
    whole = parts[0].select(*columns)
    for part in parts[1:]:
        whole = whole.unionByName(part.select(*columns))
    return whole


def champion_scores(
    champion: str, scoring: DataFrame, keys: Sequence[str], *, history: DataFrame,
    inner: DataFrame, shrinkage: tuple[float, float] = (0.5, 0.5),
    blends: Mapping[str, Mapping[str, float]] | None = None, c: float = 0.10,
    label: str = "deterioration_label", model: str = "model", score: str = "probability",
) -> DataFrame:
    """Scores of a frozen champion on later rows, from base scores of models refitted once.

    ``scoring`` is (keys, model, probability) of all base models; ``inner`` (model, ROC_AUC) the
    scores that chose them; ``history`` the out-of-fold base predictions of completed folds, whose
    mean ROC area over folds with both classes weighs the adaptive champion and whose rows train
    the stack.  ``shrinkage`` is that of the static and of the adaptive weights.
    """
    names = {"model": model, "score": score}
    blends = registered_blends() if blends is None else blends
    present = sorted(r[0] for r in scoring.select(model).distinct().collect())
    ungrouped = {"groups": (), **names}
    if champion in present:
        return scoring.where(F.col(model) == champion)
    if champion == "ensemble_simple_average":
        return average(scoring, keys, **names)
    if champion == "ensemble_rank_average":
        one = rank_average(scoring.withColumn("__all", F.lit(0)), keys, fold="__all", **names)
        return one.drop("__all")
    if champion in ("ensemble_top3_average", "ensemble_inner_winner"):
        best = top_models(inner, 3 if champion.endswith("average") else 1, groups=(), model=model)
        return weighted(scoring, best, keys, champion, **ungrouped)
    if champion == "ensemble_static_weighted":
        weights = weight_table(inner, shrinkage[0], groups=(), model=model)
        return weighted(scoring, weights, keys, champion, **ungrouped)
    if champion == "ensemble_adaptive_weighted":
        of_folds = ranking_metrics(
            history.where(F.col(model).isin(*present)), ["fold_id", model], label, score
        )
        mean = of_folds.where("ROC_AUC IS NOT NULL").groupBy(model).agg(
            F.avg("ROC_AUC").alias("ROC_AUC")
        )
        weights = weight_table(mean, shrinkage[1], groups=(), model=model)
        return weighted(scoring, weights, keys, champion, **ungrouped)
    if champion == "ensemble_stacking":
        past = history.where(F.col(model).isin(*present))
        unlabelled = scoring.drop(label) if label in scoring.columns else scoring
        return stacking(past, unlabelled, present, keys, c=c, label=label, **names)
    if champion in blends:
        return fixed_blend(scoring, blends[champion], keys, champion, **names)
    raise ValueError(f"{champion!r} is neither a base model nor a registered ensemble")
