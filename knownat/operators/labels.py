"""Forward-window outcome labels and the events they form.

Panels hold one row per entity and quarter, so entity windows are bounded by the calendar.
Positions are integers (fiscal ``year*4+quarter`` or calendar quarters); only labels care about
continuity, lags elsewhere count rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knownat.functions import fiscal_position, flag, quarter_position
from knownat.operators.checks import require_columns

EPSILON = 2.220446049250313e-16  # fixed value: spacing of doubles at one
COVERAGE = "interest_coverage_ttm"


def panel_position(df: DataFrame, time: str) -> Column:
    """Fiscal position when the panel carries it, else the calendar quarter of ``time``."""
    if {"fiscal_year", "fiscal_quarter_number"} <= set(df.columns):
        return fiscal_position("fiscal_year", "fiscal_quarter_number")
    return quarter_position(time)


def relative_decline(current: Column, future: Column) -> Column:
    return (current - future) / F.greatest(F.abs(current), F.lit(EPSILON))


def _with_continuity(df: DataFrame, entity: str, time: str, horizons: Sequence[int]) -> DataFrame:
    """``__cont<h>``: the next h rows exist and each is exactly one quarter later."""
    line = Window.partitionBy(entity).orderBy(time)
    position = panel_position(df, time)
    stepped = df.withColumn("__step", position - F.lag(position).over(line))
    added = {}
    for h in sorted(set(horizons)):
        ahead = line.rowsBetween(1, h)
        added[f"__cont{h}"] = F.coalesce(
            (F.count(F.lit(1)).over(ahead) == h)
            & (F.min("__step").over(ahead) == 1)
            & (F.max("__step").over(ahead) == 1),
            F.lit(False),
        )
    return stepped.withColumns(added).drop("__step")


def _future_minimum(entity: str, time: str, value: str, horizon: int) -> tuple[Column, Column]:
    ahead = Window.partitionBy(entity).orderBy(time).rowsBetween(1, horizon)
    return F.min(value).over(ahead), F.count(value).over(ahead) == horizon


def deterioration_labels(
    df: DataFrame,
    grid: Mapping[str, tuple],
    *,
    entity: str = "cik",
    time: str = "period_end",
    coverage: str = COVERAGE,
    relative: float = 0.40,
) -> DataFrame:
    """One 0/1/NULL label column per ``{name: (horizon, threshold[, decline])}`` entry.

    All horizons share one sort of the panel; thresholds are columns, so a grid costs no rows.
    """
    require_columns(df, [entity, time, coverage], "label input")
    cells = {name: (*spec, relative)[:3] for name, spec in grid.items()}
    if any(h < 1 or not 0 < d < 1 for h, _, d in cells.values()):
        raise ValueError("horizon must be positive and the decline between 0 and 1")
    rows = _with_continuity(df, entity, time, [h for h, _, _ in cells.values()])
    current = F.col(coverage).cast("double")
    added = {}
    for name, (horizon, threshold, decline) in cells.items():
        lowest, known = _future_minimum(entity, time, coverage, horizon)
        valid = F.col(f"__cont{horizon}") & known & current.isNotNull() & (current != 0)
        breach = (lowest < threshold) & (relative_decline(current, lowest) >= decline)
        added[name] = F.when(valid, breach.cast("int"))
    rows = rows.withColumns(added)
    return rows.drop(*[c for c in rows.columns if c.startswith("__cont")])


def deterioration_label(
    df: DataFrame,
    *,
    entity: str = "cik",
    time: str = "period_end",
    coverage: str = COVERAGE,
    horizon: int = 4,
    threshold: float = 1.5,
    relative: float = 0.40,
    name: str = "deterioration_label",
) -> DataFrame:
    return deterioration_labels(
        df,
        {name: (horizon, threshold)},
        entity=entity,
        time=time,
        coverage=coverage,
        relative=relative,
    )


def deterioration_diagnostics(
    df: DataFrame,
    *,
    entity: str = "cik",
    time: str = "period_end",
    coverage: str = COVERAGE,
    decision_time: str = "decision_at",
    horizon: int = 4,
    threshold: float = 1.5,
    relative: float = 0.40,
    cooldown: int = 4,
) -> DataFrame:
    """Label, its evidence and availability date, and greedy cooldown episode starts."""
    rows = deterioration_label(
        df,
        entity=entity,
        time=time,
        coverage=coverage,
        horizon=horizon,
        threshold=threshold,
        relative=relative,
    )
    rows = _with_continuity(rows, entity, time, [horizon])
    line = Window.partitionBy(entity).orderBy(time)
    lowest, known = _future_minimum(entity, time, coverage, horizon)
    current = F.col(coverage).cast("double")
    evident = F.col(f"__cont{horizon}") & known & current.isNotNull()
    rows = rows.withColumns(
        {
            "future_minimum_interest_coverage": F.when(evident, lowest),
            "future_interest_coverage_relative_decline": F.when(
                evident, relative_decline(current, lowest)
            ),
            "label_available_at": F.when(
                F.col(f"__cont{horizon}"), F.lead(decision_time, horizon).over(line)
            ),
            "already_below_coverage_threshold": flag(current < threshold),
        }
    ).drop(f"__cont{horizon}")
    return cooldown_starts(
        rows, entity=entity, time=time, label="deterioration_label", cooldown=cooldown
    )


def cooldown_starts(
    df: DataFrame,
    *,
    entity: str,
    time: str,
    label: str,
    cooldown: int = 4,
    name: str = "deterioration_episode_start",
) -> DataFrame:
    """A positive starts an episode when ``cooldown`` quarters have passed since the last start.

    The state feeds back, so it is folded over each entity's positive positions (an array no
    longer than the calendar) carried by a window instead of a join.
    """
    position = panel_position(df, time)
    positives = F.sort_array(
        F.collect_set(F.when(F.col(label) == 1, position)).over(Window.partitionBy(entity))
    )
    starts = _greedy_starts(positives, cooldown)
    staged = df.withColumn("__starts", starts)
    return staged.withColumn(
        name, flag(F.col(label) == 1) & F.array_contains("__starts", position)
    ).drop("__starts")


def episode_runs(
    df: DataFrame,
    *,
    entity: str = "cik",
    time: str = "decision_at",
    label: str = "deterioration_label",
) -> DataFrame:
    """Runs of positive quarters; a gap in the calendar starts a new run."""
    line = Window.partitionBy(entity).orderBy(time)
    quarter = quarter_position(time)
    positive = flag(F.col(label) == 1)
    follows = flag(F.lag(F.col(label)).over(line) == 1) & flag(
        quarter - F.lag(quarter).over(line) == 1
    )
    rows = df.withColumn("deterioration_episode_start", positive & ~follows)
    number = F.sum(F.col("deterioration_episode_start").cast("int")).over(
        line.rowsBetween(Window.unboundedPreceding, 0)
    )
    return rows.withColumn(
        "deterioration_episode_id",
        F.when(
            positive,
            F.concat(
                F.col(entity).cast("string"), F.lit("|episode_"), number.cast("int").cast("string")
            ),
        ),
    )


def first_breach_lead(
    df: DataFrame,
    *,
    entity: str = "cik",
    time: str = "period_end",
    coverage: str = COVERAGE,
    horizon: int = 4,
    threshold: float = 1.5,
    relative: float = 0.40,
    name: str = "first_breach_lead_quarters",
) -> DataFrame:
    """Rows until the first breach; the search stops at the first missing value."""
    line = Window.partitionBy(entity).orderBy(time)
    current = F.col(coverage).cast("double")
    ahead = F.array(*[F.lead(current, i).over(line) for i in range(1, horizon + 1)])
    staged = df.withColumn("__ahead", ahead)
    outcome = F.transform(
        "__ahead",
        lambda v: F.when(v.isNull(), "stop")
        .when((v < threshold) & (relative_decline(current, v) >= relative), "hit")
        .otherwise("on"),
    )
    first = F.array_position(F.transform(outcome, lambda o: o != "on"), True)
    found = F.try_element_at(outcome, F.when(first > 0, first.cast("int")).otherwise(horizon + 1))
    return staged.withColumn(
        name, F.when(current.isNotNull() & (found == "hit"), first.cast("int"))
    ).drop("__ahead")


def coverage_label_grid(
    horizons: Sequence[int], thresholds: Sequence[float]
) -> dict[str, tuple[int, float]]:
    return {
        f"coverage_h{int(h)}_threshold_{float(t):.1f}": (int(h), float(t))
        for h, t in product(horizons, thresholds)
    }


def multi_component_label(
    df: DataFrame,
    *,
    entity: str = "cik",
    time: str = "period_end",
    coverage: str = COVERAGE,
    cash_margin: str = "free_cash_flow_margin_ttm",
    leverage: str = "total_debt_to_assets",
    horizon: int = 4,
    threshold: float = 1.5,
    relative: float = 0.40,
    negative_cash_threshold: float = 0.0,
    leverage_increase: float = 0.10,
    components_required: int = 2,
    name: str = "multi_kpi_two_of_three",
) -> DataFrame:
    """At least ``components_required`` of: coverage label, cash margin below, leverage up."""
    rows = deterioration_label(
        df,
        entity=entity,
        time=time,
        coverage=coverage,
        horizon=horizon,
        threshold=threshold,
        relative=relative,
        name="__coverage_label",
    )
    ahead = Window.partitionBy(entity).orderBy(time).rowsBetween(1, horizon)
    ready = (
        F.col("__coverage_label").isNotNull()
        & F.col(leverage).isNotNull()
        & (F.count(cash_margin).over(ahead) == horizon)
        & (F.count(leverage).over(ahead) == horizon)
    )
    cash = F.min(cash_margin).over(ahead) < negative_cash_threshold
    rise = F.max(leverage).over(ahead) - F.col(leverage) >= leverage_increase
    score = F.col("__coverage_label") + cash.cast("int") + rise.cast("int")
    return rows.withColumn(
        name, F.when(ready, (score >= components_required).cast("int"))
    ).drop("__coverage_label")


def label_sensitivity_summary(
    df: DataFrame,
    labels: Sequence[str],
    *,
    entity: str = "cik",
    time: str = "decision_at",
    sector: str = "sector",
) -> DataFrame:
    """Rows, positives, prevalence and distinct runs per label: overall and by sector.

    Runs are found among the labelled rows of an entity and sector.  The labels are unpivoted
    once; the overall lines are rolled up from the sector lines, which carry every sum.
    """
    long = df.select(
        entity,
        time,
        sector,
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"`{n}`").alias("y")) for n in labels])
        ).alias("l"),
    ).select(entity, time, sector, "l.label", F.col("l.y").alias("y")).where("y IS NOT NULL")

    def starts(keys: list[str]) -> Column:
        line = Window.partitionBy(*keys).orderBy(time)
        quarter = quarter_position(time)
        follows = flag(F.lag("y").over(line) == 1) & flag(
            quarter - F.lag(quarter).over(line) == 1
        )
        return ((F.col("y") == 1) & ~follows).cast("long")

    marked = long.select(
        "*",
        starts(["label", entity]).alias("__whole"),
        starts(["label", entity, sector]).alias("__part"),
    )
    by_sector = marked.groupBy("label", sector).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("y").alias("pos"),
        F.sum("__whole").alias("whole"),
        F.sum("__part").alias("part"),
    )
    overall = by_sector.groupBy("label").agg(
        F.lit("Overall").alias("sector"),
        F.sum("n").alias("n"),
        F.sum("pos").alias("pos"),
        F.sum("whole").alias("episodes"),
    )
    named = by_sector.where(F.col(sector).isNotNull()).select(
        "label", F.col(sector).alias("sector"), "n", "pos", F.col("part").alias("episodes")
    )
    return overall.unionByName(named).select(
        "label",
        "sector",
        F.col("n").alias("mature_company_quarters"),
        F.col("pos").cast("long").alias("positive_company_quarters"),
        (F.col("pos") / F.col("n")).alias("prevalence"),
        F.col("episodes").alias("distinct_episodes"),
        F.lit(False).alias("selected_using_model_performance"),
    )


def event_counts(
    df: DataFrame,
    slices: Sequence[str] = (),
    *,
    entity: str = "cik",
    label: str = "deterioration_label",
    start: str = "deterioration_episode_start",
) -> DataFrame:
    """Labelled and positive rows, episode starts, affected entities and prevalence per slice."""
    y = F.col(label)
    labelled, positive = F.count(y), F.count(F.when(y == 1, 1))
    return df.groupBy(*slices).agg(
        labelled.alias("labeled_rows"),
        positive.alias("positive_rows"),
        F.count(F.when(F.col(start), 1)).alias("distinct_episodes"),
        F.countDistinct(F.when(F.col(start), F.col(entity))).alias("affected_companies"),
        (positive / F.greatest(labelled, F.lit(1))).alias("row_prevalence"),
    )


def threshold_sensitivity(
    df: DataFrame,
    thresholds: Sequence[float] = (1.0, 1.5, 2.0),
    declines: Sequence[float] = (0.30, 0.40, 0.50),
    *,
    entity: str = "cik",
    time: str = "period_end",
    coverage: str = COVERAGE,
    horizon: int = 4,
    cooldown: int = 4,
) -> DataFrame:
    """Event counts of every (threshold, decline) rule with greedy cooldown episodes."""
    cells = {
        f"__c{i}": (horizon, t, d) for i, (t, d) in enumerate(product(thresholds, declines))
    }
    wide = deterioration_labels(df, cells, entity=entity, time=time, coverage=coverage)
    position = panel_position(wide, time)
    long = wide.select(
        entity,
        time,
        position.alias("__position"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(float(t)).alias("absolute_threshold"),
                        F.lit(float(d)).alias("relative_decline"),
                        F.col(name).alias("y"),
                    )
                    for name, (_, t, d) in cells.items()
                ]
            )
        ).alias("r"),
    ).select(entity, "__position", "r.*")
    rules = ["absolute_threshold", "relative_decline"]
    # One row per rule and entity: its labels folded over positions no longer than the calendar.
    folded = long.groupBy(*rules, entity).agg(
        F.count("y").alias("labeled"),
        F.count(F.when(F.col("y") == 1, 1)).alias("positive"),
        F.sort_array(F.collect_set(F.when(F.col("y") == 1, F.col("__position")))).alias("at"),
    )
    starts = F.size(_greedy_starts("at", cooldown))
    return folded.withColumn("starts", starts).groupBy(*rules).agg(
        F.sum("labeled").alias("labeled_rows"),
        F.sum("positive").alias("positive_rows"),
        F.sum(F.col("starts").cast("long")).alias("distinct_episodes"),
        F.count(F.when(F.col("starts") > 0, 1)).alias("affected_companies"),
        (F.sum("positive") / F.greatest(F.sum("labeled"), F.lit(1))).alias("row_prevalence"),
    )


def _greedy_starts(positions: str | Column, cooldown: int) -> Column:
    """Sorted positions thinned so that kept ones are at least ``cooldown`` apart."""
    return F.aggregate(
        positions,
        F.array().cast("array<int>"),
        lambda kept, p: F.when(
            (F.size(kept) == 0)
            | (p - F.coalesce(F.try_element_at(kept, F.lit(-1)), p) >= cooldown),
            F.concat(kept, F.array(p)),
        ).otherwise(kept),
    )


def label_edge_cases(
    df: DataFrame,
    *,
    operating_income: str = "operating_income_ttm",
    invalid: str = "interest_denominator_invalid",
    below: str = "already_below_coverage_threshold",
    label: str = "deterioration_label",
) -> DataFrame:
    """One line counting the rows a reviewer of the label should know about."""
    y = F.col(label)

    def tally(test: Column) -> Column:
        return F.count(F.when(test, 1))

    return df.agg(
        tally(F.col(operating_income) < 0).alias("negative_operating_income_rows"),
        tally(F.col(invalid)).alias("invalid_interest_denominator_rows"),
        tally(F.col(below) & y.isNotNull()).alias("already_below_threshold_labeled_rows"),
        tally(y.isNull()).alias("missing_future_window_rows"),
    )
