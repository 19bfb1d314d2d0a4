"""Contracts, leakage checks, eligibility, certification and readiness, as Spark jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knownat.functions import fiscal_position, flag, pad_id
from knownat.operators.checks import fail_if_duplicated, require_columns
from knownat.operators.labels import episode_runs, event_counts
from knownat.operators.ratios import KPI_COLUMNS
from knownat.scale import exact_quantiles

# Fields every eligible history must carry.
CORE_FIELDS = (
    "revenue",
    "operating_income",
    "interest_expense",
    "operating_cash_flow",
    "capital_expenditures",
    "total_assets",
    "total_debt",
)
ESSENTIAL_FIELDS = ("operating_income", "interest_expense", "total_assets", "total_debt")
KNOWN_YEARS = (2012, 2025)
DEVELOPMENT_YEAR = 2023


def longest_runs(
    df: DataFrame, entity: Sequence[str], position: Column, valid: Column, name: str
) -> DataFrame:
    """Longest run of consecutive valid positions per entity (entities without one: 0).

    Duplicates collapse in the first aggregate, so the window sees one row per quarter.
    """
    entity = list(entity)
    points = (
        df.where(flag(valid)).select(*entity, position.cast("int").alias("__pos")).distinct()
    )
    line = Window.partitionBy(*entity).orderBy("__pos")
    islands = points.withColumn("__island", F.col("__pos") - F.row_number().over(line))
    runs = islands.groupBy(*entity, "__island").agg(F.count(F.lit(1)).alias("__run"))
    return runs.groupBy(*entity).agg(F.max("__run").alias(name))


def eligibility_audit(
    metadata: DataFrame,
    quarterly: DataFrame,
    *,
    mode: str = "strict_company",
    minimum_usable_quarters: int = 24,
    minimum_consecutive_quarters: int = 16,
    minimum_coverage: float = 0.8,
    minimum_entity_coverage: float | None = None,
    minimum_interest_expense: float = 1_000_000,
    minimum_interest_quarters: int = 12,
    minimum_interest_coverage_quarters: int = 16,
    minimum_consecutive_interest_coverage_quarters: int = 8,
    minimum_total_assets_quarters: int = 12,
    years: tuple[int, int] = KNOWN_YEARS,
    development_year: int = DEVELOPMENT_YEAR,
    core: Sequence[str] = CORE_FIELDS,
    essential: Sequence[str] = ESSENTIAL_FIELDS,
) -> DataFrame:
    """History rules per entity with reason codes; entities without history count zero.

    ``minimum_coverage`` applies to each quarter and, unless ``minimum_entity_coverage`` is
    given, to the entity's whole history.
    """
    if minimum_entity_coverage is None:
        minimum_entity_coverage = minimum_coverage
    if mode not in ("strict_company", "company_quarter"):
        raise ValueError(f"unknown eligibility mode: {mode}")
    absent = [F.lit(None).cast("double").alias(c) for c in core if c not in quarterly.columns]
    rows = quarterly.select("*", *absent).where(F.col("fiscal_year").between(*years))
    rows = rows.withColumn("cik", pad_id("cik"))
    filled = sum((F.col(c).isNotNull().cast("int") for c in core[1:]),
                 F.col(core[0]).isNotNull().cast("int"))
    whole = F.lit(True)
    for c in essential:
        whole = whole & F.col(c).isNotNull()
    meaningful = flag(F.abs(F.col("interest_expense")) >= minimum_interest_expense)
    interest_valid = (
        F.col("operating_income").isNotNull() & F.col("interest_expense").isNotNull() & meaningful
    )
    rows = rows.withColumns(
        {
            "__share": filled / float(len(core)),
            "__filled": filled,
            "__usable": (filled / float(len(core)) >= minimum_coverage) & whole,
            "__interest": interest_valid if mode == "company_quarter" else meaningful,
        }
    )
    position = fiscal_position("fiscal_year", "fiscal_quarter_number")
    in_development = F.col("fiscal_year") <= development_year

    def tally(test: Column) -> Column:
        return F.sum(test.cast("long"))

    counted = rows.groupBy("cik").agg(
        tally(F.col("__usable")).alias("usable_quarters"),
        (F.sum("__filled") / (F.count(F.lit(1)) * len(core))).alias("core_field_coverage"),
        tally(F.col("__interest")).alias("meaningful_interest_expense_quarters"),
        tally(F.col("total_assets").isNotNull()).alias("__asset_quarters"),
        F.median(F.when(in_development, F.col("total_assets"))).alias("median_total_assets"),
        F.median(F.when(in_development, F.col("revenue"))).alias("median_revenue"),
    )
    usable_run = longest_runs(
        rows, ["cik"], position, F.col("__usable"), "maximum_consecutive_usable_quarters"
    )
    joined = (
        metadata.withColumn("cik", pad_id("cik"))
        .join(counted, "cik", "left")
        .join(usable_run, "cik", "left")
    )
    run = "maximum_consecutive_interest_coverage_quarters"
    if mode == "company_quarter":
        joined = joined.join(
            longest_runs(rows, ["cik"], position, F.col("__interest"), run), "cik", "left"
        ).na.fill(0, [run])
    else:
        joined = joined.withColumn(run, F.lit(None).cast("long"))
    joined = joined.na.fill(
        0,
        [
            "usable_quarters",
            "core_field_coverage",
            "meaningful_interest_expense_quarters",
            "__asset_quarters",
            "maximum_consecutive_usable_quarters",
        ],
    )
    if mode == "strict_company":
        rules = {
            "INSUFFICIENT_USABLE_QUARTERS": F.col("usable_quarters") < minimum_usable_quarters,
            "INSUFFICIENT_CONSECUTIVE_QUARTERS": F.col("maximum_consecutive_usable_quarters")
            < minimum_consecutive_quarters,
            "INSUFFICIENT_CORE_FIELD_COVERAGE": F.col("core_field_coverage")
            < minimum_entity_coverage,
            "INSUFFICIENT_INTEREST_EXPENSE_HISTORY": F.col("meaningful_interest_expense_quarters")
            < minimum_interest_quarters,
        }
    else:
        rules = {
            "INSUFFICIENT_INTEREST_COVERAGE_QUARTERS": F.col(
                "meaningful_interest_expense_quarters"
            )
            < minimum_interest_coverage_quarters,
            "INSUFFICIENT_INTEREST_COVERAGE_CONTINUITY": F.col(run)
            < minimum_consecutive_interest_coverage_quarters,
            "INSUFFICIENT_TOTAL_ASSETS_HISTORY": F.col("__asset_quarters")
            < minimum_total_assets_quarters,
        }
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules.items()]))
    return (
        joined.withColumn("reason_codes", reasons)
        .withColumn("eligible", F.size("reason_codes") == 0)
        .withColumn("eligibility_mode", F.lit(mode))
        .withColumn(
            "reason_codes",
            F.when(F.col("eligible"), F.array(F.lit("ELIGIBLE"))).otherwise(F.col("reason_codes")),
        )
        .drop("__asset_quarters")
    )


def certify_panel(
    panel: DataFrame,
    *,
    universe_version: str,
    minimum_observed: int = 24,
    minimum_consecutive: int = 16,
    minimum_coverage: float = 0.80,
    kpis: Sequence[str] = KPI_COLUMNS,
    entity: str = "cik",
) -> tuple[DataFrame, DataFrame]:
    """Rule evidence per entity (three rules per KPI, four lineage rules) and a summary."""
    position = fiscal_position("fiscal_year", "fiscal_quarter_number")
    long = panel.select(
        entity,
        position.alias("__pos"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(k.upper()).alias("kpi"), F.col(k).cast("double").alias("v"))
                    for k in kpis
                ]
            )
        ).alias("k"),
    ).select(entity, "__pos", "k.kpi", F.col("k.v").alias("v"))
    valid = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs(F.col("v")) != float("inf"))
    observed = long.groupBy(entity, "kpi").agg(
        F.sum(flag(valid).cast("long")).alias("observed"),
        F.max("__pos").alias("last"),
        F.min(F.when(flag(valid), F.col("__pos"))).alias("first"),
    )
    runs = longest_runs(long, [entity, "kpi"], F.col("__pos"), valid, "run")
    expected = F.greatest(F.col("last") - F.col("first") + 1, F.lit(0))
    evidence = observed.join(runs, [entity, "kpi"], "left").select(
        entity,
        "kpi",
        F.col("observed").cast("double").alias("observed"),
        F.coalesce("run", F.lit(0)).cast("double").alias("run"),
        F.coalesce(F.col("observed") / expected, F.lit(0.0)).alias("coverage"),
    )

    def rule(suffix: str, value: str, needed: float) -> Column:
        return F.struct(
            F.concat(F.lit("KPI_"), "kpi", F.lit(f"_{suffix}")).alias("rule_code"),
            (F.col(value) >= needed).alias("passed"),
            F.col(value).alias("observed_value"),
            F.lit(float(needed)).alias("required_value"),
        )

    kpi_rules = evidence.select(
        entity,
        F.inline(
            F.array(
                rule("OBSERVATIONS", "observed", minimum_observed),
                rule("CONTINUITY", "run", minimum_consecutive),
                rule("COVERAGE", "coverage", minimum_coverage),
            )
        ),
    )
    per_key = panel.groupBy(entity, "decision_key").agg(
        F.count(F.lit(1)).alias("__n"),
        F.max(flag(F.col("maximum_source_available_at") > F.col("decision_at"))).alias("__src"),
        F.max(flag(F.col("macro_available_at_max") > F.col("decision_at"))).alias("__mac"),
        F.max(F.col("accession_numbers_json").isNull()).alias("__lost"),
        F.max("decision_at").alias("__at"),
        F.min(F.struct(position.alias("p"), "sector", "company_name", "ticker")).alias("__meta"),
    )
    lineage = per_key.groupBy(entity).agg(
        (F.max("__n") == 1).alias("DUPLICATE_DECISION_KEY"),
        (~F.max("__src")).alias("POINT_IN_TIME_LEAKAGE"),
        (~F.max("__mac")).alias("MACRO_VINTAGE_LEAKAGE"),
        (~F.max("__lost")).alias("MATERIAL_LINEAGE_BREAK"),
        F.max("__at").alias("evidence_as_of"),
        F.min("__meta").alias("__meta"),
    )
    names = (
        "DUPLICATE_DECISION_KEY",
        "POINT_IN_TIME_LEAKAGE",
        "MACRO_VINTAGE_LEAKAGE",
        "MATERIAL_LINEAGE_BREAK",
    )
    lineage_rules = lineage.select(
        entity,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("rule_code"),
                        F.col(n).alias("passed"),
                        F.col(n).cast("double").alias("observed_value"),
                        F.lit(1.0).alias("required_value"),
                    )
                    for n in names
                ]
            )
        ),
    )
    about = lineage.select(
        entity, "evidence_as_of", "__meta.sector", "__meta.company_name", "__meta.ticker"
    )
    rules = (
        kpi_rules.unionByName(lineage_rules)
        .join(about, entity)
        .withColumn("universe_version", F.lit(universe_version))
    )
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("rule_code"))))
    summary = rules.groupBy(entity).agg(
        F.max("company_name").alias("company_name"),
        F.max("ticker").alias("ticker"),
        F.max("sector").alias("sector"),
        F.min("passed").alias("certified"),
        failed.alias("failed_rules"),
    )
    return rules.drop("company_name", "ticker"), summary


def contract_evidence(
    tables: Mapping[str, DataFrame], contracts: Mapping[str, Mapping[str, Sequence[str]]]
) -> DataFrame:
    """Per table: missing required columns, rows, duplicate and null primary keys, passed.

    ``contracts[name]`` gives ``required`` columns and the ``key``.  Each table is one
    counted aggregate; only one line per table is brought together.
    """
    lines: DataFrame | None = None
    for name, table in tables.items():
        contract = contracts[name]
        missing = sorted(set(contract["required"]) - set(table.columns))
        keys = [k for k in contract["key"] if k in table.columns]
        lacking = F.array(*[F.lit(m) for m in missing]).cast("array<string>")
        if len(keys) < len(contract["key"]):
            counted = table.agg(
                F.count(F.lit(1)).alias("rows"),
                F.lit(None).cast("long").alias("duplicate_keys"),
                F.lit(None).cast("long").alias("null_keys"),
            )
        else:
            empty = F.lit(False)
            for k in keys:
                empty = empty | F.col(k).isNull()
            groups = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
            counted = groups.agg(
                F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"),
                F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_keys"),
                F.coalesce(F.sum(F.when(empty, F.col("__n"))), F.lit(0)).alias("null_keys"),
            )
        passed = (F.size(lacking) == 0) & flag(F.col("duplicate_keys") == 0) & flag(
            F.col("null_keys") == 0
        )
        line = counted.select(
            F.lit(name).alias("table_name"),
            F.concat_ws(",", lacking).alias("missing_columns"),
            "rows",
            "duplicate_keys",
            "null_keys",
            passed.alias("passed"),
        )
        lines = line if lines is None else lines.unionByName(line)
    if lines is None:
        raise ValueError("no tables to check")
    return lines


def grain_check(
    df: DataFrame, keys: Sequence[str], *, period_end: str, available: str
) -> DataFrame:
    """Rows, duplicated keys and rows available before their period ended; one line."""
    early = flag(F.to_date(available) < F.to_date(period_end))
    groups = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(early.cast("long")).alias("__early")
    )
    return groups.agg(
        F.sum("__n").alias("rows"),
        F.sum((F.col("__n") > 1).cast("long")).alias("duplicate_keys"),
        F.sum("__early").alias("available_before_period_end"),
    )


def cardinality_violations(
    left: DataFrame, right: DataFrame, keys: Sequence[str], *, one_to_one: bool = False
) -> DataFrame:
    """Keys that a many-to-one (or one-to-one) lookup may not have: (keys, side, rows, partners).

    ``side`` is ``right`` for a key that the lookup side repeats, ``left`` for one that the left
    side repeats where it may not, ``unmatched`` for a left key without a partner; a key may have
    several lines.  Each side is counted by key before they meet, so no rows are multiplied.
    """
    keys = list(keys)
    n, m = F.coalesce("__left", F.lit(0)), F.coalesce("__right", F.lit(0))
    sides = [
        table.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
        for table, name in ((left, "__left"), (right, "__right"))
    ]
    both = sides[0].join(sides[1], keys, "full")
    found = [F.when(m > 1, "right"), F.when((n > 0) & (m == 0), "unmatched")]
    if one_to_one:
        found.append(F.when(n > 1, "left"))
    return both.select(
        *keys,
        F.explode(F.array_compact(F.array(*found))).alias("side"),
        n.alias("rows"),
        m.alias("partners"),
    )


def checked_lookup(
    left: DataFrame, right: DataFrame, keys: Sequence[str], *, one_to_one: bool = False
) -> DataFrame:
    """Left join that refuses to multiply rows."""
    fail_if_duplicated(right, list(keys), f"lookup side repeats {list(keys)}")
    if one_to_one:
        fail_if_duplicated(left, list(keys), f"left side repeats {list(keys)}")
    return left.join(right, list(keys), "left")


def leakage_audit(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``{check: (available, decision)}``: checked and violating rows, in one pass."""
    counts = []
    for name, (available, decision) in pairs.items():
        known = F.col(available).isNotNull() & F.col(decision).isNotNull()
        counts += [
            F.sum(known.cast("long")).alias(f"{name}__n"),
            F.sum(flag(F.col(available) > F.col(decision)).cast("long")).alias(f"{name}__bad"),
        ]
    return df.agg(*counts).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("check_name"),
                        F.coalesce(F.col(f"{n}__n"), F.lit(0)).alias("checked_rows"),
                        F.coalesce(F.col(f"{n}__bad"), F.lit(0)).alias("violations"),
                        (F.coalesce(F.col(f"{n}__bad"), F.lit(0)) == 0).alias("passed"),
                    )
                    for n in pairs
                ]
            )
        )
    )


def artifact_checks(
    name: str,
    df: DataFrame,
    *,
    key: Sequence[str],
    finite: Sequence[str] = (),
    bounded: Sequence[str] = (),
    ordered: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """Nonempty, unique key, finite, bounded and chronological checks as long evidence rows."""

    def broken_number(c: str) -> Column:
        v = F.col(c).cast("double")
        return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))

    tests: dict[str, Column] = {}
    for c in finite:
        tests[f"finite_{c}"] = broken_number(c)
    for c in bounded:
        tests[f"bounded_{c}"] = broken_number(c) | (F.col(c) < 0) | (F.col(c) > 1)
    for early, late in ordered:
        tests[f"chronology_{early}_{late}"] = F.col(early) > F.col(late)
    groups = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(flag(bad).cast("long")).alias(n) for n, bad in tests.items()],
    )
    total = groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("__rows"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("unique_key"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in tests],
    )

    def line(check: str, passed: Column, evidence: Column) -> Column:
        return F.struct(
            F.lit(name).alias("asset"),
            F.lit(check).alias("check_name"),
            passed.alias("passed"),
            evidence.cast("long").alias("evidence"),
        )

    return total.select(
        F.inline(
            F.array(
                line("nonempty", F.col("__rows") > 0, F.col("__rows")),
                *[line(n, F.col(n) == 0, F.col(n)) for n in ["unique_key", *tests]],
            )
        )
    )


def readiness(
    panel: DataFrame,
    *,
    minimum_issuers: int,
    minimum_episodes: int,
    consumed_start: str,
    untouched_start: str | None,
    entity: str = "cik",
    sector: str = "sector",
    time: str = "decision_at",
    label: str = "deterioration_label",
) -> tuple[DataFrame, DataFrame]:
    """(sector evidence, one-line gates with status ready / not_ready)."""
    require_columns(panel, [entity, sector, time, label], "panel")
    marked = episode_runs(panel, entity=entity, time=time, label=label)
    sectors = marked.where(F.col(sector).isNotNull()).groupBy(sector).agg(
        F.countDistinct(entity).alias("issuers"),
        F.sum(F.col("deterioration_episode_start").cast("long")).alias("episodes"),
        F.to_date(F.min(time)).alias("first_decision_at"),
        F.to_date(F.max(time)).alias("last_decision_at"),
    )
    sectors = sectors.withColumns(
        {
            "issuer_gate_passed": F.col("issuers") >= minimum_issuers,
            "episode_gate_passed": F.col("episodes") >= minimum_episodes,
        }
    )
    boundary = untouched_start is not None and untouched_start > consumed_start
    lineage = {"exchange", "selection_as_of"} <= set(panel.columns)
    gates = sectors.agg(
        (F.count(F.lit(1)) > 0).alias("real_panel_present"),
        F.coalesce(
            F.min(F.col("issuer_gate_passed") & F.col("episode_gate_passed")), F.lit(False)
        ).alias("sector_sample_sizes_pass"),
    ).withColumns(
        {
            "active_population_lineage_present": F.lit(lineage),
            "new_untouched_test_boundary_registered": F.lit(boundary),
        }
    )
    everything = F.lit(True)
    for gate in gates.columns:
        everything = everything & F.col(gate)
    return sectors, gates.withColumn(
        "status", F.when(everything, "ready").otherwise("not_ready")
    ).withColumn("final_test_may_be_opened", everything)


def label_audit_by_year(df: DataFrame, *, time: str = "decision_at", sector: str = "sector"):
    """Year x sector event counts of a labelled panel."""
    return event_counts(df.withColumn("decision_year", F.year(time)), ["decision_year", sector])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def group_medians(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return exact_quantiles(df, keys, value, [0.5]).select(
        *keys, F.col("quantiles")[0].alias(name)
    )
