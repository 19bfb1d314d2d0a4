"""Reproducible stratified selection, reserves and replacements."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knownat.functions import hash_score
from knownat.operators.checks import fail_if_any, require_columns
from knownat.scale import row_rank, same_keys

TIERS = ("small", "medium", "large")
ELIGIBLE_EXCHANGES = ("NYSE", "NASDAQ", "NYSE American")


def range_rule_lookup(
    df: DataFrame, code: str, rules: Sequence[Mapping], *, outputs: Sequence[str]
) -> DataFrame:
    """First rule whose code list or ranges hold ``code``; rows matching none are dropped.

    The rule list is configuration of fixed size, so it becomes one CASE expression: no join.
    """
    value = F.col(code)
    chosen = F.lit(None).cast("int")
    for position in range(len(rules) - 1, -1, -1):
        rule = rules[position]
        hit = F.lit(False)
        if rule.get("codes"):
            hit = hit | value.isin(*rule["codes"])
        for low, high in rule.get("ranges", ()):
            hit = hit | value.between(low, high)
        chosen = F.when(hit, position).otherwise(chosen)
    staged = df.withColumn("__rule", chosen).where("__rule IS NOT NULL")
    literals = {
        name: F.element_at(
            F.array(*[F.lit(str(rule[name])) for rule in rules]), F.col("__rule") + 1
        )
        for name in outputs
    }
    return staged.withColumns(literals).drop("__rule")


def current_listing(tickers: str, exchanges: str, eligible=ELIGIBLE_EXCHANGES) -> Column:
    """First (ticker, exchange) pair on an eligible exchange, as a struct or NULL."""
    pairs = F.zip_with(
        tickers, exchanges, lambda t, e: F.struct(t.alias("ticker"), e.alias("exchange"))
    )
    return F.try_element_at(F.filter(pairs, lambda p: p["exchange"].isin(*eligible)), F.lit(1))


def excluded_name(name: Column | str, patterns: Sequence[str]) -> Column:
    column = F.col(name) if isinstance(name, str) else name
    padded = F.concat(F.lit(" "), F.upper(column), F.lit(" "))
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | F.contains(padded, F.lit(pattern.upper()))
    return hit


def domestic_filer(forms: str) -> Column:
    def has(form: str) -> Column:
        return F.array_contains(forms, form)

    return F.coalesce(has("10-K") & has("10-Q") & ~has("20-F") & ~has("40-F"), F.lit(False))


def filing_history(forms: str, report_dates: str, filing_dates: str, cutoff: str) -> Column:
    """Struct of distinct quarterly and annual report periods and the earliest filing date."""
    rows = F.arrays_zip(
        F.col(forms).alias("form"),
        F.col(report_dates).alias("report"),
        F.col(filing_dates).alias("filed"),
    )

    def kept(*names: str) -> Column:
        return F.filter(
            rows,
            lambda r: r["form"].isin(*names)
            & (F.coalesce(r["report"], F.lit("")) != "")
            & (F.coalesce(r["filed"], F.lit("")) != "")
            & (r["filed"] <= cutoff),
        )

    def periods(*names: str) -> Column:
        found = F.array_distinct(F.transform(kept(*names), lambda r: r["report"]))
        return F.coalesce(F.size(found), F.lit(0))

    quarterly, annual = ("10-Q", "10-Q/A"), ("10-K", "10-K/A")
    return F.struct(
        periods(*quarterly).alias("distinct_10q_periods"),
        periods(*annual).alias("distinct_10k_periods"),
        F.array_min(F.transform(kept(*quarterly, *annual), lambda r: r["filed"])).alias(
            "earliest_periodic_filing"
        ),
    )


def screening_reason(
    overridden: Column, entity_excluded: Column, too_short: Column
) -> Column:
    """One reason with precedence override, entity type, history, candidate."""
    return (
        F.when(overridden.isNotNull(), overridden)
        .when(entity_excluded, "EXCLUDED_ENTITY_TYPE")
        .when(too_short, "INSUFFICIENT_PRELIMINARY_FILING_HISTORY")
        .otherwise("CANDIDATE")
    )


def balanced_sample(
    df: DataFrame,
    target: int | Mapping[str, int],
    *,
    within: Sequence[str] = (),
    strata: Sequence[str],
    identity: str = "cik",
    seed: int,
    strict: bool = True,
) -> DataFrame:
    """Round-robin draw over strata in hash order; ``random_rank`` is the order of drawing.

    Drawing one row per stratum and round equals ranking by (place in stratum, stratum).  Only
    the first ``target`` rows of a stratum can be drawn, which trims rows before the second rank.
    """
    within, strata = list(within), list(strata)
    require_columns(df, [*within, *strata, identity], "sampling frame")
    goal = _goal(target, within)
    scored = df.withColumn("random_score", hash_score(identity, seed))
    if strict:
        sizes = df.groupBy(*within).agg(F.count(F.lit(1)).alias("__have"))
        fail_if_any(sizes, F.col("__have") < goal, "cannot select more rows than the frame holds")
    placed = row_rank(
        scored, [*within, *strata], [F.col("random_score"), F.col(identity)], "__place"
    ).where(F.col("__place") <= goal)
    ordered = row_rank(
        placed,
        within,
        [F.col("__place"), *[F.col(s).asc_nulls_first() for s in strata], F.col(identity)],
        "random_rank",
    )
    return ordered.where(F.col("random_rank") <= goal).drop("__place")


def _goal(target: int | Mapping[str, int], within: Sequence[str]) -> Column:
    if not isinstance(target, Mapping):
        return F.lit(int(target))
    goal = F.lit(None).cast("int")
    for value, count in target.items():
        goal = F.when(F.col(within[0]) == value, int(count)).otherwise(goal)
    return goal


def candidate_pool(
    df: DataFrame, per_sector: int, *, sector: str = "sector", industry: str = "industry",
    identity: str = "cik", seed: int,
) -> DataFrame:
    """Up to ``per_sector`` eligible rows per sector, balanced over industries."""
    drawn = balanced_sample(
        df, per_sector, within=[sector], strata=[industry], identity=identity, seed=seed,
        strict=False,
    )
    return drawn.withColumn("candidate_pool_status", F.lit("INCLUDED"))


def size_tiers(
    df: DataFrame, *, size: str, identity: str, within: Sequence[str], name: str = "size_tier"
) -> DataFrame:
    """Tercile of first-come rank per group, cut at evenly spaced ranks."""
    within = list(within)
    known = df.where(F.col(size).isNotNull())
    ranked = row_rank(known, within, [F.col(size), F.col(identity)], "__r")
    counts = known.groupBy(*within).agg(F.count(F.lit(1)).alias("__n"))
    placed = same_keys(ranked, counts, within, "inner")
    third = F.when(F.col("__n") == 1, F.lit(1)).otherwise(
        # a rank exactly on an edge 1 + k (n - 1) / 3 opens the next tier
        F.least(F.floor(3 * (F.col("__r") - 1) / (F.col("__n") - 1)) + 1, F.lit(3))
    )
    labelled = F.element_at(F.array(*[F.lit(t) for t in TIERS]), third.cast("int"))
    unsized = df.where(F.col(size).isNull()).withColumn(name, F.lit(None).cast("string"))
    return placed.select(*df.columns, labelled.alias(name)).unionByName(unsized)


def select_universe(
    df: DataFrame,
    target: int | Mapping[str, int],
    *,
    sector: str = "sector",
    strata: Sequence[str] = ("industry", "size_tier"),
    identity: str = "cik",
    seed: int,
) -> DataFrame:
    """Exact sector targets plus every other row as an ordered reserve.

    One chain of rankings marks every row, so the frame is read once and never joined to itself.
    """
    goal = _goal(target, [sector])
    sizes = df.groupBy(sector).agg(F.count(F.lit(1)).alias("__have"))
    fail_if_any(sizes, F.col("__have") < goal, "a sector has fewer rows than its target")
    by_hash = [F.col("random_score"), F.col(identity)]
    scored = df.withColumn("random_score", hash_score(identity, seed))
    placed = row_rank(scored, [sector, *strata], by_hash, "__place")
    turn = [F.col("__place"), *[F.col(s).asc_nulls_first() for s in strata], F.col(identity)]
    drawn = row_rank(placed, [sector], turn, "random_rank")
    status = F.when(F.col("random_rank") <= goal, "SELECTED").otherwise("RESERVE")
    marked = drawn.withColumn("selection_status", status)
    waiting = row_rank(marked, [sector, "selection_status"], by_hash, "__wait")
    rank = F.when(F.col("selection_status") == "SELECTED", F.col("random_rank")).otherwise(
        F.col("__wait") + goal
    )
    return waiting.withColumn("random_rank", rank).drop("__place", "__wait")


#: Fixed result values: quality tiers, and names of (reserve, pool, no replacement).
QUALITY_TIERS = ("CERTIFIED", "FLAGGED_INSUFFICIENT_CERTIFIED_RESERVE")
REPLACEMENT_SOURCES = {
    "expanded_pool": (
        "frozen_reserve",
        "deterministic_expanded_candidate_pool",
        "retained_with_quality_flag",
    ),
    "same_sector": (
        "frozen_same_sector_reserve",
        "deterministic_expanded_candidate_pool",
        "retained_with_quality_flag",
    ),
}


def replace_failures(
    universe: DataFrame,
    certification: DataFrame,
    *,
    pool: DataFrame | None = None,
    sector: str = "sector",
    identity: str = "cik",
    retain_flagged_shortfall: bool = False,
    vocabulary: str = "expanded_pool",
) -> tuple[DataFrame, DataFrame]:
    """Replace failed selections by the next certified reserve (then pool) of their sector.

    ``vocabulary`` chooses how the audit names the sources of replacements.

    The i-th failed selection meets the i-th certified option of its sector: both are ranked in
    one pass and brought together by one aggregate on (sector, i).
    Returns (final selection with ``quality_tier``, audit lines).
    """
    from_reserve, from_pool, unfilled = REPLACEMENT_SOURCES[vocabulary]
    rows = universe.withColumn("__source", F.lit(0))
    if pool is not None:
        spare = pool.join(universe.select(identity), identity, "left_anti")
        rows = rows.unionByName(
            spare.withColumns({"__source": F.lit(1), "selection_status": F.lit("RESERVE")}),
            allowMissingColumns=True,
        )
    passed = F.coalesce(F.col("certified"), F.lit(False))
    chosen = F.col("selection_status") == "SELECTED"
    role = (
        F.when(chosen & passed, "kept").when(chosen, "failed").when(passed, "option")
    )
    judged = (
        rows.join(certification.select(identity, "certified"), identity, "left")
        .withColumn("__role", role)
        .where("__role IS NOT NULL")
        .drop("certified")
    )
    order = [
        F.col("__source"),
        F.col("random_rank").asc_nulls_last(),
        F.col("random_score"),
        F.col(identity),
    ]
    ranked = row_rank(judged, [sector, "__role"], order, "__i")
    columns = [c for c in judged.columns if c not in (sector, "__role")]

    def of(name: str) -> Column:
        return F.max(F.when(F.col("__role") == name, F.struct(*columns))).alias(name)

    pairs = ranked.groupBy(sector, "__i").agg(of("kept"), of("failed"), of("option"))
    short = F.col("failed").isNotNull() & F.col("option").isNull()
    if not retain_flagged_shortfall:
        fail_if_any(pairs, short, "insufficient certified replacements")
    audit = pairs.where("failed IS NOT NULL").select(
        F.col("failed")[identity].alias("removed_id"),
        F.col("option")[identity].alias("replacement_id"),
        sector,
        F.col("failed.random_rank").alias("replacement_rank"),
        F.when(F.col("option").isNull(), unfilled)
        .when(F.col("option.__source") == 0, from_reserve)
        .otherwise(from_pool)
        .alias("replacement_source"),
    )

    def entry(who: str, when: Column, tier: str) -> Column:
        slot = F.col("failed.random_rank") if who == "option" else F.col(who)["random_rank"]
        fields = [
            (slot if c == "random_rank" else F.col(who)[c]).alias(c)
            for c in columns
            if c not in ("__source", "selection_status")
        ]
        return F.when(
            when,
            F.struct(
                *fields,
                F.lit("SELECTED").alias("selection_status"),
                F.lit(tier).alias("quality_tier"),
            ),
        )

    certified, flagged = QUALITY_TIERS
    replaced = F.col("failed").isNotNull() & F.col("option").isNotNull()
    entries = F.array_compact(
        F.array(
            entry("kept", F.col("kept").isNotNull(), certified),
            entry("option", replaced, certified),
            entry("failed", short, flagged),
        )
    )
    final = pairs.select(sector, F.explode(entries).alias("e")).select(sector, "e.*")
    return final, audit


def top_cases(
    df: DataFrame, groups: Sequence[str], score: str, k: int, *, key: str
) -> DataFrame:
    """The k highest rows per group; Spark trims each task to k rows before the shuffle."""
    order = Window.partitionBy(*groups).orderBy(F.col(score).desc_nulls_last(), F.col(key))
    return df.withColumn("case_rank", F.row_number().over(order)).where(
        F.col("case_rank") <= k
    )


def priority_review_cases(
    cases: DataFrame, *, k: int = 5, key: str = "decision_key", probability: str = "probability",
    disagreement: str = "model_probability_std",
) -> DataFrame:
    """Five cases of each error type and the five least stable, each decision once."""
    kinds = F.col("case_type").isin("true_positive", "false_positive", "false_negative")
    ranked_by = F.when(
        F.col("case_type") == "false_negative", F.col(disagreement)
    ).otherwise(F.col(probability))
    typed = top_cases(
        cases.where(kinds).withColumn("__by", ranked_by), ["case_type"], "__by", k, key=key
    ).drop("__by")
    unstable = top_cases(
        cases.withColumn("case_type", F.lit("unstable")), ["case_type"], disagreement, k, key=key
    )
    order = F.array_position(
        F.array(*[F.lit(n) for n in ("false_negative", "false_positive", "true_positive")]),
        F.col("case_type"),
    )
    priority = F.when(F.col("case_type") == "unstable", 9).otherwise(order).cast("int")
    # At most 4k rows reach this point.
    rest = [c for c in typed.columns if c != key]
    both = typed.unionByName(unstable).select("*", priority.alias("__p"))
    first = both.groupBy(key).agg(F.min(F.struct("__p", *rest)).alias("r"))
    return first.select(key, *[F.col("r")[c].alias(c) for c in rest])


def selection_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """sha256 over the sorted canonical rows of a selection (a list of bounded, chosen size).

    Each row is hashed where it lies; only 64-byte digests are brought together.
    """
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return df.select(row.alias("d")).agg(
        F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("d"))), 256).alias("selection_sha256"),
        F.count(F.lit(1)).alias("rows"),
    )
