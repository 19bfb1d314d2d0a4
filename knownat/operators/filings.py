"""Filed facts to standalone fiscal quarters, at one cutoff or at every decision date.

A *fact* is one reported observation: entity, concept, fiscal year and period, dates, value, the
filing it came from and the day it was filed.  Later filings restate earlier ones, so the value
of a quarter depends on the day one asks.

The pick among competing facts is the maximum of one ordering struct.  The facts of a filer are
gathered once, and "the pick as known on day d" is the maximum of those in a short list that count
by then, instead of a join of facts with every vintage.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knownat.functions import composite_key, null_aware_sum
from knownat.operators.checks import fail_if_any, fail_if_duplicated, require_columns
from knownat.scale import dealt, stable

# Fixed values of the filing domain.
QUARTER_OF_PERIOD = {"Q1": 1, "Q2": 2, "Q3": 3, "FY": 4}
PERIODIC_FORMS = ("10-Q", "10-Q/A", "10-K", "10-K/A")
DURATION_CONCEPTS = (
    "revenue",
    "operating_income",
    "interest_expense",
    "operating_cash_flow",
    "capital_expenditures",
    "net_income",
)
BALANCE_CONCEPTS = (
    "total_assets",
    "total_debt",
    "short_term_debt",
    "long_term_debt",
    "cash_and_equivalents",
    "current_assets",
    "current_liabilities",
)
EARLIEST_END_YEAR = 2011
EARLIEST_FISCAL_YEAR = 2012
QUARTERLY_DAYS = (60, 130)
MAPPING_VERSION = "us-gaap-v1"
# A filer of more facts collapses to one a day before its facts are gathered.
CROWDED_FACTS = 100_000

FACT_COLUMNS = (
    "cik",
    "concept",
    "period_type",
    "tag_priority",
    "fiscal_year",
    "fiscal_period",
    "start_date",
    "end_date",
    "value",
    "accession_number",
    "form",
    "filed_at",
    "duration_days",
)
_LAST_DURATION = 2**31 - 1


def _period_number(period: str = "fiscal_period") -> Column:
    number = F.lit(None).cast("int")
    for name, value in QUARTER_OF_PERIOD.items():
        number = F.when(F.col(period) == name, value).otherwise(number)
    return number


def filing_decisions(
    facts: DataFrame, *, cutoff: str, first_year: int = EARLIEST_FISCAL_YEAR
) -> DataFrame:
    """One decision per entity and fiscal quarter: first filing day, last period end."""
    require_columns(facts, FACT_COLUMNS, "facts")
    number = _period_number()
    expected = F.when(number == 4, "10-K").otherwise("10-Q")
    end = F.lit(cutoff).cast("date")
    timely = facts.where(
        number.isNotNull()
        & (F.to_date("filed_at") <= end)
        & F.col("fiscal_year").isNotNull()
        & F.col("form").startswith(expected)
    )
    grouped = timely.groupBy("cik", "fiscal_year", number.alias("fiscal_quarter_number")).agg(
        F.min("filed_at").alias("decision_at"), F.max("end_date").alias("period_end")
    )
    quarter = F.concat(F.lit("FQ"), F.col("fiscal_quarter_number").cast("string"))
    return grouped.where(
        F.col("fiscal_year").between(F.lit(first_year), F.year(end))
        & (F.to_date("period_end") <= end)
    ).select(
        "cik",
        F.col("fiscal_year").cast("int").alias("fiscal_year"),
        quarter.alias("fiscal_quarter"),
        "decision_at",
        "period_end",
        "fiscal_quarter_number",
        composite_key("cik", F.col("fiscal_year").cast("int"), quarter).alias("decision_key"),
    )


def _pick(payload: Sequence[str], has_ordinal: bool) -> Column:
    """Ordering struct whose maximum is the selected fact."""
    quarterly = (
        (F.col("period_type") == "duration")
        & F.col("fiscal_period").isin("Q1", "Q2", "Q3")
        & F.col("duration_days").between(*QUARTERLY_DAYS)
    )
    ordinal = F.col("ordinal") if has_ordinal else F.lit(0)
    return F.struct(
        F.coalesce(quarterly, F.lit(False)).alias("quarterly"),
        (-F.col("tag_priority")).alias("preference"),
        F.col("filed_at"),
        (-F.coalesce(F.col("duration_days"), F.lit(_LAST_DURATION))).alias("brevity"),
        F.col("accession_number"),
        (-ordinal).alias("earliness"),
        F.col("value"),
        F.col("duration_days"),
        F.col("tag_priority"),
        *[F.col(c) for c in payload],
    )


def pick_fact(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The preferred fact per key: best tag, newest filing, shortest duration, last accession."""
    require_columns(facts, [*keys, *FACT_COLUMNS], "facts")
    fixed = {
        "tag_priority", "filed_at", "accession_number", "value", "duration_days", "ordinal",
    }
    payload = [c for c in facts.columns if c not in fixed and c not in keys]
    pick = _pick(payload, "ordinal" in facts.columns)
    picked = facts.groupBy(*keys).agg(F.max(pick).alias("p"))
    chosen = [c for c in facts.columns if c not in keys and c != "ordinal"]
    return picked.select(*keys, *[F.col("p")[c].alias(c) for c in chosen])


def _scoped(facts: DataFrame, first_end_year: int) -> DataFrame:
    return facts.where(_period_number().isNotNull() & (F.year("end_date") >= first_end_year))


def _per_period(pick: Column) -> list[Column]:
    number = _period_number()
    return [F.max(F.when(number == n, pick)).alias(f"q{n}") for n in (1, 2, 3, 4)]


def _standalone(column: Callable[[str], Column] = F.col) -> Column:
    """Array of up to four standalone quarters from the picked Q1, Q2, Q3 and FY facts.

    Balance items stand alone.  A cumulative Q2 or Q3 flow (longer than a quarter) gives up the
    standalone quarters before it; the fourth quarter is the year less the first three.
    """
    long = QUARTERLY_DAYS[1]
    flow = column("period_type") == "duration"
    q = {n: column(f"q{n}") for n in (1, 2, 3, 4)}
    value = {n: q[n]["value"].cast("double") for n in q}
    filed = {n: q[n]["filed_at"] for n in q}

    def cumulative(n: int) -> Column:
        return flow & F.coalesce(q[n]["duration_days"] > long, F.lit(False))

    has1 = q[1].isNotNull()
    has2 = q[2].isNotNull() & (~cumulative(2) | has1)
    v2 = F.when(cumulative(2), value[2] - value[1]).otherwise(value[2])
    at2 = F.when(cumulative(2), F.greatest(filed[2], filed[1])).otherwise(filed[2])
    has3 = q[3].isNotNull() & (~cumulative(3) | (has1 & has2))
    v3 = F.when(cumulative(3), value[3] - (value[1] + v2)).otherwise(value[3])
    at3 = F.when(cumulative(3), F.greatest(filed[3], filed[1], filed[2])).otherwise(filed[3])
    has4 = q[4].isNotNull() & (~flow | (has1 & has2 & has3))
    v4 = F.when(flow, value[4] - (value[1] + v2 + v3)).otherwise(value[4])
    at4 = F.when(flow, F.greatest(filed[4], filed[1], at2, at3)).otherwise(filed[4])

    def quarter(n: int, exists: Column, v: Column, at: Column, derived: Column) -> Column:
        return F.when(
            exists,
            F.struct(
                F.lit(n).alias("fiscal_quarter_number"),
                v.alias("value"),
                at.alias("available_at"),
                derived.alias("is_derived"),
                q[n].alias("fact"),
            ),
        )

    no = F.lit(False)
    return F.array_compact(
        F.array(
            quarter(1, has1, value[1], filed[1], no),
            quarter(2, has2, v2, at2, cumulative(2)),
            quarter(3, has3, v3, at3, cumulative(3)),
            quarter(4, has4, v4, at4, flow),
        )
    )


def normalize_fiscal_quarters(
    facts: DataFrame, *, cutoff: str, first_end_year: int = EARLIEST_END_YEAR
) -> DataFrame:
    """Standalone quarters per entity, concept and fiscal year as known at ``cutoff``."""
    require_columns(facts, FACT_COLUMNS, "facts")
    keys = ["cik", "concept", "period_type", "fiscal_year"]
    end = F.lit(cutoff).cast("date")
    known = _scoped(facts, first_end_year).where(
        (F.to_date("filed_at") <= end) & (F.year("end_date") <= F.year(end))
    )
    fixed = {
        *keys, "tag_priority", "filed_at", "accession_number", "value", "duration_days", "ordinal",
    }
    payload = [c for c in facts.columns if c not in fixed]
    pick = _pick(payload, "ordinal" in facts.columns)
    states = known.groupBy(*keys).agg(*_per_period(pick))
    rows = states.select(*keys, F.explode(_standalone()).alias("s"))
    carried = ["tag_priority", "filed_at", "accession_number", "duration_days", *payload]
    return rows.select(
        *[F.col(k).cast("int") if k == "fiscal_year" else F.col(k) for k in keys],
        F.concat(F.lit("FQ"), F.col("s.fiscal_quarter_number").cast("string")).alias(
            "fiscal_quarter"
        ),
        F.col("s.fiscal_quarter_number").alias("fiscal_quarter_number"),
        F.col("s.value").alias("value"),
        F.col("s.available_at").alias("available_at"),
        F.col("s.is_derived").alias("is_derived"),
        *[F.col("s.fact")[c].alias(c) for c in carried],
        F.lit(MAPPING_VERSION).alias("mapping_version"),
    )


def quarterly_wide(quarters: DataFrame, concepts: Sequence[str]) -> DataFrame:
    """One row per entity-quarter with a column per concept and the debt total filled in."""
    keys = ["cik", "fiscal_year", "fiscal_quarter", "fiscal_quarter_number"]
    wide = quarters.groupBy(*keys).agg(
        *[F.max(F.when(F.col("concept") == c, F.col("value"))).alias(c) for c in concepts],
        F.max("available_at").alias("quarter_available_at"),
    )
    return _fill_debt(wide, concepts)


def _fill_debt(wide: DataFrame, concepts: Sequence[str]) -> DataFrame:
    parts = [c for c in ("short_term_debt", "long_term_debt") if c in concepts]
    total = F.col("total_debt") if "total_debt" in concepts else F.lit(None).cast("double")
    if parts:
        total = F.coalesce(total, null_aware_sum(*parts))
    return wide.withColumn("total_debt", total)


def filer_histories(
    facts: DataFrame, *, first_end_year: int = EARLIEST_END_YEAR
) -> DataFrame:
    """One row per filer: its facts by concept and fiscal year, with the day each counts from.

    An entry of ``held`` is one (concept, period type, fiscal year) with the competing facts of Q1
    to FY, ``q1`` to ``q4``, and the first days of the standalone quarters they make, ``from1`` to
    ``from4``.

    Facts move once, by filer.  A filer of more than ``CROWDED_FACTS`` facts first collapses
    map-side to one fact per period and day, so what a task holds of it is bounded by the calendar.
    """
    keys = ["cik", "concept", "period_type", "fiscal_year"]
    numbers = (1, 2, 3, 4)
    # A fact dated past its filing year counts only once the decision year has caught up.
    known_from = F.greatest(F.to_date("filed_at"), F.trunc("end_date", "year"))
    rows = (
        _scoped(facts.where(F.col("cik").isNotNull()), first_end_year)
        .withColumn("known_from", known_from)
        .select(
            *keys,
            _period_number().alias("period"),
            _pick(["known_from"], "ordinal" in facts.columns).alias("fact"),
        )
    )
    counts = stable(facts.groupBy("cik").count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    crowded = counts.where(F.col("count") > CROWDED_FACTS).select("cik")
    if not crowded.isEmpty():
        few = F.broadcast(crowded)  # at most one filer for CROWDED_FACTS facts
        daily = (
            rows.join(few, "cik", "left_semi")
            .groupBy(*keys, "period", F.col("fact.known_from").alias("known_from"))
            .agg(F.max("fact").alias("fact"))
        )
        rows = rows.join(few, "cik", "left_anti").unionByName(daily.drop("known_from"))
    years = dealt(rows, ["cik"], total).groupBy(*keys).agg(
        *[F.collect_list(F.when(F.col("period") == n, F.col("fact"))).alias(f"q{n}") for n in numbers]
    )
    return _with_presence(years).groupBy("cik").agg(
        F.collect_list(
            F.struct(
                "concept",
                "period_type",
                F.col("fiscal_year").cast("int").alias("year"),
                *[F.col(f"q{n}") for n in numbers],
                *[F.col(f"from{n}") for n in numbers],
            )
        ).alias("held")
    )


def _with_presence(years: DataFrame) -> DataFrame:
    """Add ``from1`` to ``from4``: first days of the standalone quarters that the lists make.

    Follows ``_standalone``: a quarter whose pick is cumulative waits for the quarters before it,
    the fourth quarter of a flow for the other three.
    """
    flow = F.col("period_type") == "duration"

    def long(fact: Column) -> Column:
        return F.coalesce(fact["duration_days"] > QUARTERLY_DAYS[1], F.lit(False))

    def first(facts: Column) -> Column:
        return F.array_min(F.transform(facts, lambda f: f["known_from"]))

    def single(n: int) -> Column:
        """First day on which the pick is not cumulative."""
        cumulative = F.filter(f"q{n}", long)
        return first(
            F.filter(
                f"q{n}",
                lambda f: f["quarterly"]
                | (
                    ~long(f)
                    & ~F.exists(
                        cumulative, lambda c: (c["known_from"] <= f["known_from"]) & (c > f)
                    )
                ),
            )
        )

    def latest(*days: str) -> Column:
        known = F.lit(True)
        for day in days:
            known = known & F.col(day).isNotNull()
        return F.when(known, F.greatest(*days))

    def of_flow(n: int, day: Column) -> Column:
        return F.when(flow, day).otherwise(F.col(f"__filed{n}"))

    filed = years.withColumns(
        {f"__filed{n}": first(F.col(f"q{n}")) for n in (1, 2, 3, 4)}
        | {f"__single{n}": F.when(flow, single(n)) for n in (2, 3)}
    ).withColumn("from1", F.col("__filed1"))
    second = F.least(latest("__filed1", "__filed2"), F.col("__single2"))
    third = F.least(latest("__filed3", "from1", "from2"), F.col("__single3"))
    fourth = latest("__filed4", "from1", "from2", "from3")
    return (
        filed.withColumn("from2", of_flow(2, second))
        .withColumn("from3", of_flow(3, third))
        .withColumn("from4", of_flow(4, fourth))
    )


def point_in_time_rows(
    facts: DataFrame,
    decisions: DataFrame,
    *,
    flows: Sequence[str] = DURATION_CONCEPTS,
    balances: Sequence[str] = BALANCE_CONCEPTS,
    first_end_year: int = EARLIEST_END_YEAR,
) -> DataFrame:
    """Panel rows rebuilt from only the facts filed by each decision.

    Trailing sums use the last four *present* quarters, lineage the last four *calendar*
    positions.  A quarter never disappears once known (picks only improve), so its presence is
    one date, and which quarters a decision needs is settled before any value is fetched.
    """
    require_columns(facts, FACT_COLUMNS, "facts")
    numbers = (1, 2, 3, 4)
    current = F.col("fiscal_year") * 4 + F.col("fiscal_quarter_number")
    asked = decisions.withColumn("quarter_index", current.cast("int"))
    day = F.to_date("decision_at")

    def present(held: Column) -> Column:
        positions = {n: held["year"] * 4 + n for n in numbers}
        return F.filter(
            F.array(
                *[F.when(held[f"from{n}"] <= day, positions[n]) for n in numbers]
            ),
            lambda p: p <= F.col("quarter_index"),
        )

    # Both sides are dealt by filer; from there a decision's row is made of its filer's lists and
    # nothing moves again.  The decisions are the side to be held in memory: the histories are wide
    # and pass through unsorted.
    filers = filer_histories(facts, first_end_year=first_end_year)
    own = F.exists(
        "held",
        lambda h: (h["year"] == F.col("fiscal_year"))
        & (
            F.get(F.array(*[h[f"from{n}"] for n in numbers]), F.col("fiscal_quarter_number") - 1)
            <= day
        ),
    )
    placed = asked.hint("shuffle_hash").join(filers, "cik").where(own).withColumn(
        "__present",
        F.slice(
            F.sort_array(
                F.array_distinct(F.flatten(F.transform("held", present))),
                asc=False,
            ),
            1,
            4,
        ),
    )
    # The years of the trailing and of the calendar quarters.
    first = F.least(F.array_min("__present"), F.col("quarter_index") - 3)
    first_year = F.floor((first - 1) / 4).cast("int")

    def picks(held: Column) -> Column:
        return F.struct(
            *[held[c].alias(c) for c in ("concept", "period_type", "year")],
            *[
                F.array_max(F.filter(held[f"q{n}"], lambda f: f["known_from"] <= day)).alias(f"q{n}")
                for n in numbers
            ],
        )

    def quarters(picked: Column) -> Column:
        return F.transform(
            _standalone(lambda c: picked[c]),
            lambda s: F.struct(
                picked["concept"].alias("concept"),
                (picked["year"] * 4 + s["fiscal_quarter_number"]).alias("position"),
                s["value"].alias("value"),
                s["available_at"].alias("available_at"),
                s["is_derived"].alias("is_derived"),
                s["fact"]["accession_number"].alias("accession_number"),
                s["fact"]["tag_priority"].alias("tag_priority"),
            ),
        )

    entries = F.filter("held", lambda h: h["year"].between(first_year, F.col("fiscal_year")))
    known = placed.select(
        *asked.columns,
        "__present",
        F.flatten(F.transform(F.transform(entries, picks), quarters)).alias("__quarters"),
    )
    index = F.col("quarter_index")
    told = known.select(
        *asked.columns,
        F.size("__present").alias("ttm_quarters_present"),
        F.filter("__quarters", lambda s: s["position"] == index).alias("__now"),
        F.filter(
            "__quarters", lambda s: F.array_contains("__present", s["position"])
        ).alias("__trailing"),
        F.filter(
            "__quarters", lambda s: s["position"].between(index - 3, index)
        ).alias("__recent"),
    )

    def of(rows: str, field: str, concept: str | None = None) -> Column:
        chosen = F.col(rows)
        if concept is not None:
            chosen = F.filter(chosen, lambda s: s["concept"] == concept)
        return F.array_compact(F.transform(chosen, lambda s: s[field]))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)

    def share(values: Column) -> Column:
        held = F.transform(values, lambda v: v.cast("double"))
        return F.when(F.size(values) > 0, total(held) / F.size(values))

    concepts = [*flows, *balances]
    rows = told.select(
        *asked.columns,
        "ttm_quarters_present",
        *[F.array_max(of("__now", "value", c)).alias(c) for c in concepts],
        *[
            F.array_max(of("__now", "available_at", c)).alias(f"{c}_available_at")
            for c in concepts
        ],
        F.array_max(of("__now", "available_at")).alias("quarter_available_at"),
        *[
            F.when(
                F.size(of("__trailing", "value", c)) == 4, total(of("__trailing", "value", c))
            ).alias(f"{c}_ttm")
            for c in flows
        ],
        F.to_json(
            F.array_sort(F.array_distinct(of("__recent", "accession_number")))
        ).alias("accession_numbers_json"),
        F.array_max(of("__recent", "available_at")).alias("maximum_source_available_at"),
        share(F.transform(of("__recent", "tag_priority"), lambda t: t == 0)).alias(
            "preferred_tag_share"
        ),
        share(of("__recent", "is_derived")).alias("derived_fact_share"),
    )
    return _fill_debt(rows, concepts)


def validate_fiscal_index(frame: DataFrame) -> None:
    """Raise unless the quarters are well labelled, dated and filed after they ended."""
    require_columns(
        frame,
        ["cik", "fiscal_year", "fiscal_quarter", "period_end", "filed_at", "accession_number"],
        "fiscal index",
    )
    fail_if_any(
        frame,
        ~F.coalesce(F.col("fiscal_quarter").isin("FQ1", "FQ2", "FQ3", "FQ4"), F.lit(False)),
        "fiscal quarters must be FQ1 to FQ4",
    )
    fail_if_any(
        frame,
        F.col("period_end").isNull() | F.col("filed_at").isNull(),
        "fiscal index holds unreadable dates",
    )
    fail_if_any(
        frame,
        F.to_date("filed_at") < F.to_date("period_end"),
        "a filing cannot be available before its fiscal period ends",
    )


def derive_fourth_quarter(annual: str, first: str, second: str, third: str) -> Column:
    return F.col(annual) - (F.col(first) + F.col(second) + F.col(third))


def assert_unique_decisions(decisions: DataFrame) -> None:
    fail_if_duplicated(decisions, ["decision_key"], "duplicate decision keys")
