"""Descriptive tables behind exploratory reports."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knownat.operators.forecasting import long_series
from knownat.scale import exact_quantiles, same_keys, stable, with_average_rank

EPSILON = 2.220446049250313e-16  # fixed value: spacing of doubles at one


def describe_groups(df: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per group and value column."""
    groups = list(groups)
    keys = [*groups, "variable"]
    long = long_series(df, values, groups, "variable")
    stats = long.groupBy(*keys).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, keys, "value", [0.25, 0.5, 0.75])
    joined = same_keys(stats, quartiles, keys, "left")
    return joined.select(
        *keys,
        "count",
        "mean",
        "std",
        "min",
        F.col("quantiles")[0].alias("p25"),
        F.col("quantiles")[1].alias("p50"),
        F.col("quantiles")[2].alias("p75"),
        "max",
    )


def missing_shares(df: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Missing and covered share per group and column; one aggregate, unpivoted afterwards."""
    counted = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("__n"), *[F.count(v).alias(f"__{v}") for v in values]
    )
    return counted.select(
        *groups,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(v).alias("variable"),
                        (1 - F.col(f"__{v}") / F.col("__n")).alias("missing_share"),
                        (F.col(f"__{v}") / F.col("__n")).alias("coverage_share"),
                    )
                    for v in values
                ]
            )
        ).alias("m"),
    ).select(*groups, "m.*")


def value_mix(df: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """Counts and shares of each category; the total is taken over the counted categories."""
    keys = list(groups)
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(
        F.count(F.lit(1)).alias("rows")
    )
    totals = counts.groupBy(*keys).agg(F.sum("rows").alias("__all"))
    if keys:
        placed = same_keys(counts, totals, keys, "inner")
    else:
        one = F.lit(1).alias("__one")
        placed = counts.select("*", one).join(
            F.broadcast(totals.select("*", one)), "__one"  # a single row
        )
    return placed.select(*keys, column, "rows", (F.col("rows") / F.col("__all")).alias("share"))


def display_rows(
    df: DataFrame, value: str, low: float = 0.01, high: float = 0.99
) -> DataFrame:
    """Rows whose value lies between two quantiles of the whole column."""
    bounds = exact_quantiles(df, [], value, [low, high])
    one = F.lit(1).alias("__one")
    placed = df.withColumn("__one", F.lit(1)).join(
        F.broadcast(bounds.select("quantiles", one)), "__one"  # a single row
    )
    return placed.where(
        F.col(value).between(F.col("quantiles")[0], F.col("quantiles")[1])
    ).drop("__one", "quantiles")


def cross_tab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    counted = [
        F.sum((F.col(column) == v).cast("long")).alias(f"{v}") for v in values
    ]
    return df.groupBy(row).agg(*counted)


def feature_stability(evidence: DataFrame) -> DataFrame:
    """How often each feature was selected over folds, and its mean importance."""
    return evidence.groupBy("feature").agg(
        F.sum(F.col("selected").cast("long")).alias("selected_folds"),
        F.countDistinct("fold_id").alias("evaluated_folds"),
        F.avg("mean_permutation_PR_AUC_loss").alias("mean_permutation_PR_AUC_loss"),
        F.avg("positive_permutation_share").alias("mean_positive_permutation_share"),
    ).withColumn(
        "selected_in_every_outer_training_fold",
        F.col("selected_folds") == F.col("evaluated_folds"),
    )


def time_series_diagnostics(
    panel: DataFrame,
    kpis: Sequence[str],
    *,
    entity: str = "cik",
    sector: str = "sector",
    time: str = "decision_at",
    minimum: int = 8,
) -> DataFrame:
    """Persistence, signal to noise, shape and half-to-half shift of each entity's KPI."""
    keys = [entity, sector, "kpi"]
    series = long_series(panel, kpis, [entity, sector, time]).where("value IS NOT NULL")
    line = Window.partitionBy(*keys).orderBy(time)
    whole = Window.partitionBy(*keys)
    short = line.rowsBetween(-3, 0)
    rows = series.withColumns(
        {
            "__prior": F.lag("value").over(line),
            "__trend": F.when(
                F.count("value").over(short) >= 2, F.avg("value").over(short)
            ),
            "__i": F.row_number().over(line),
            "__n": F.count("value").over(whole),
            "__mean": F.avg("value").over(whole),
        }
    ).where(F.col("__n") >= minimum)
    gap = F.col("value") - F.col("__mean")
    late = F.col("__i") > F.floor(F.col("__n") / 2)
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.corr("value", "__prior").alias("lag1"),
        F.var_samp("__trend").alias("signal"),
        F.var_samp(F.col("value") - F.col("__trend")).alias("noise"),
        F.stddev_samp("value").alias("std"),
        F.sum(gap * gap).alias("m2"),
        F.sum(gap * gap * gap).alias("m3"),
        F.sum(gap * gap * gap * gap).alias("m4"),
        F.avg(F.when(late, F.col("value"))).alias("late"),
        F.avg(F.when(~late, F.col("value"))).alias("early"),
    )
    n = F.col("n").cast("double")
    varies = F.col("m2") > 0
    spread = F.col("m2") / n
    skew = F.sqrt(n * (n - 1)) / (n - 2) * (F.col("m3") / n) / F.pow(spread, 1.5)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * (
        (n + 1) * (F.col("m4") / n) / (spread * spread) - 3 * (n - 1)
    )
    return sums.select(
        *keys,
        F.col("n").alias("observations"),
        F.when(varies & ~F.isnan("lag1"), F.col("lag1")).alias("lag1_autocorrelation"),
        (F.col("signal") / F.greatest(F.col("noise"), F.lit(EPSILON))).alias(
            "signal_to_noise_ratio"
        ),
        F.when(varies, skew).otherwise(0.0).alias("skewness"),
        F.when(varies, kurt).otherwise(0.0).alias("excess_kurtosis"),
        (
            (F.col("late") - F.col("early")) / F.greatest(F.col("std"), F.lit(EPSILON))
        ).alias("mean_shift_standardized"),
    )


def spearman_pairs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rank correlation of every feature pair over the rows where both are present.

    Pairwise-complete correlation ranks a feature among the rows that have the other.  Where the
    other has no gap of its own, that is the feature's one ranking, made once for all such pairs.
    """
    pairs = list(combinations(features, 2))
    rows = stable(
        df.select(
            F.monotonically_increasing_id().alias("__row"),
            *[F.col(f).cast("double").alias(f"__v{i}") for i, f in enumerate(features)],
        )
    )
    known = {f: F.col(f"__v{i}") for i, f in enumerate(features)}
    counts = rows.agg(
        F.array(*[F.count(known[f]) for f in features]).alias("one"),
        F.array(*[F.count(F.when(known[b].isNotNull(), known[a])) for a, b in pairs]).alias("two"),
    ).first()
    of_one = dict(zip(features, counts.one, strict=True))
    alike = {f: f for f in features}  # the first feature that is present in the same rows
    for (a, b), both in zip(pairs, counts.two, strict=True):
        if both == of_one[a] == of_one[b]:
            alike[b] = min(alike[a], alike[b], key=list(features).index)
    rankings: dict[tuple[str, str | None], int] = {}
    wanted = []  # places of the two rankings of each pair
    for (a, b), both in zip(pairs, counts.two, strict=True):
        asked = [(x, None if both == of_one[x] else alike[y]) for x, y in ((a, b), (b, a))]
        wanted.append([rankings.setdefault(k, len(rankings)) for k in asked])
    if not pairs:
        return df.sparkSession.createDataFrame(
            [], "feature_a string, feature_b string, spearman double, complete_rows long"
        )
    values = F.array(
        *[
            F.struct(
                F.lit(i).alias("__k"),
                (known[f] if among is None else F.when(known[among].isNotNull(), known[f])).alias("v"),
            )
            for (f, among), i in rankings.items()
        ]
    )
    present = F.filter(values, lambda p: p["v"].isNotNull())
    long = rows.select("__row", F.explode(present).alias("p")).select("__row", "p.*")
    ranked = with_average_rank(long, ["__k"], "v", rank="__r", size="__n")
    wide = ranked.groupBy("__row").agg(
        *[F.max(F.when(F.col("__k") == i, F.col("__r"))).alias(f"__r{i}") for i in rankings.values()]
    )
    met: Column = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("n"), F.col(f"__r{i}").alias("x"), F.col(f"__r{j}").alias("y")
                )
                for n, (i, j) in enumerate(wanted)
            ]
        ),
        lambda p: p["x"].isNotNull() & p["y"].isNotNull(),
    )
    found = wide.select(F.explode(met).alias("p")).groupBy("p.n").agg(
        F.corr("p.x", "p.y").alias("rho"), F.count(F.lit(1)).alias("complete_rows")
    )
    names = F.array(
        *[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b")) for a, b in pairs]
    )
    return found.withColumn("f", names[F.col("n")]).select(
        "f.*",
        F.when(~F.isnan("rho"), F.col("rho")).alias("spearman"),
        "complete_rows",
    )
