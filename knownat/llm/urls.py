"""URL filter by path templates: a tree per host, wildcards, merged branches, smoothed purity.

Rules decide the pages they fit and thereby label them; the tree judges the rest.  Digit runs
become wildcards, pages are counted by host and path shape, and the shapes form a tree of path
segments.  From the root down, a segment value that is one of many and rare under its parent is a
variable and joins the wildcard branch, and so does a branch whose labelled share of allowed pages
does not differ from its siblings' beyond chance.  A template is rejected when its share of
allowed pages, smoothed towards its host's and that towards the whole table's, is too low.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knownat.llm.common import prepare, settled

#: Levels of the tree; what lies deeper is one wildcard tail.
DEPTH = 3
MANY_VALUES, RARE_SHARE = 16, 0.01
#: Standard errors between a branch and its siblings that keep it apart.
APART = 2.58
SMOOTHING = 10.0
LEAST_PURITY = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits a host and all its subdomains if the path starts with ``path``."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", True),
    Rule("example.org", "/es/", False),
    Rule("example.org", "/en/1", False),
    Rule("com", "/fr/", True),
    Rule("com", "/de/", False),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(after, r"^[^/?#]*", 0), F.lit(""))
    rest = F.substring(after, F.length(host) + 1, F.length(url))
    path = F.coalesce(F.regexp_extract(rest, r"^[^?#]*", 0), F.lit(""))
    return F.translate(host, _UPPER, _LOWER), path


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = (
            (host == rule.host) | host.endswith(f".{rule.host}")
        ) & path.startswith(rule.path)
        name = F.when(fits, rule.name).otherwise(name)
        allow = F.when(fits, rule.allow).otherwise(allow)
    return name, allow


def _templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, n, allow, block, template): the tree, grown level by level."""
    grown = shapes.withColumn("template", F.lit(""))
    for level in range(1, DEPTH + 1):
        here = grown.withColumn("value", F.get("segments", level - 1))
        branches = (
            here.where("value IS NOT NULL")
            .groupBy("host", "template", "value")
            .agg(*[F.sum(c).alias(c) for c in ("n", "allow", "block")])
        )
        branches = settled(branches)
        parents = branches.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("values"),
            *[F.sum(c).alias(f"all_{c}") for c in ("n", "allow", "block")],
        )
        own = F.col("allow") + F.col("block")
        others = F.col("all_allow") + F.col("all_block") - own
        own_share = F.try_divide("allow", own)
        rest_share = F.try_divide(F.col("all_allow") - F.col("allow"), others)
        pooled = F.try_divide("all_allow", own + others)
        each = F.try_divide(F.lit(1.0), own) + F.try_divide(F.lit(1.0), others)
        error = F.sqrt(pooled * (1 - pooled) * each)
        variable = (F.col("values") > MANY_VALUES) & (F.col("n") < RARE_SHARE * F.col("all_n"))
        apart = (
            (own > 0) & (others > 0) & (F.abs(own_share - rest_share) > APART * error)
        )
        judged = branches.join(parents, ["host", "template"]).select(
            "host", "template", "value",
            (F.coalesce(apart, F.lit(False)) & ~variable).alias("stays"),
        )
        grown = here.join(judged, ["host", "template", "value"], "left").select(
            *shapes.columns,
            F.when(F.col("value").isNull(), F.col("template"))
            .otherwise(
                F.concat("template", F.lit("/"), F.when(F.col("stays"), F.col("value")).otherwise("*"))
            )
            .alias("template"),
        )
    tail = F.when(F.size("segments") > DEPTH, F.concat("template", F.lit("/**")))
    return grown.withColumn("template", F.coalesce(tail, "template"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    *,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity), one row per row of ``pages``.

    A url without host and path is judged by the template of the empty host.  Repeated rows are
    judged each and count each.  Without any labelled page every purity is one half, which
    allows.  An empty table gives no rows; other columns are not read.
    """
    prepare(pages.sparkSession)
    host, path = host_and_path(F.col(url_column))
    parsed = pages.select(
        F.col(id_column).cast("long").alias("page_id"), host.alias("host"), path.alias("path")
    )
    rule, allow = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = parsed.select(
        "*", rule.alias("rule"), allow.alias("allowed"),
        F.regexp_replace("path", "[0-9]+", "*").alias("shape"),
    )
    shapes = settled(
        ruled.groupBy("host", "shape").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("allowed").alias("allow"),
            F.count_if(~F.col("allowed")).alias("block"),
        ).withColumn("segments", F.filter(F.split("shape", "/"), lambda s: s != ""))
    )
    tree = settled(_templates(shapes))
    hosts = shapes.groupBy("host").agg(
        F.sum("allow").alias("host_allow"), F.sum("block").alias("host_block")
    )
    table = shapes.agg(
        ((F.coalesce(F.sum("allow"), F.lit(0)) + 1.0)
         / (F.coalesce(F.sum("allow") + F.sum("block"), F.lit(0)) + 2.0)).alias("base")
    )
    based = hosts.join(F.broadcast(table)).select(  # a single row
        "host",
        ((F.col("host_allow") + SMOOTHING * F.col("base"))
         / (F.col("host_allow") + F.col("host_block") + SMOOTHING)).alias("host_purity"),
    )
    pure = (
        tree.groupBy("host", "template")
        .agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        .join(based, "host")
        .select(
            "host", "template",
            ((F.col("allow") + SMOOTHING * F.col("host_purity"))
             / (F.col("allow") + F.col("block") + SMOOTHING)).alias("purity"),
        )
    )
    verdicts = tree.select("host", "shape", "template").join(pure, ["host", "template"])
    judged = ruled.join(verdicts, ["host", "shape"])
    passes = F.coalesce("allowed", F.col("purity") >= LEAST_PURITY)
    return judged.select(
        "page_id", "host", "path", "rule",
        F.when(passes, "allow").otherwise("block").alias("verdict"),
        "template", "purity",
    )


#: The same tree in SQL, for the default rules and constants.
_LEVEL = """
here{k} AS (
    SELECT *, segments[{k}] AS value FROM grown{j}
), branches{k} AS (
    SELECT host, template, value, sum(n) AS n, sum(allow) AS allow, sum(block) AS block
    FROM here{k} WHERE value IS NOT NULL GROUP BY ALL
), judged{k} AS (
    SELECT *, allow + block AS own, all_allow + all_block - allow - block AS others
    FROM (SELECT *, count(*) OVER w AS vals, sum(n) OVER w AS all_n,
                 sum(allow) OVER w AS all_allow, sum(block) OVER w AS all_block
          FROM branches{k} WINDOW w AS (PARTITION BY host, template))
), grown{k} AS (
    SELECT h.host, h.shape, h.n, h.allow, h.block, h.segments,
           CASE WHEN h.value IS NULL THEN h.template
                ELSE h.template || '/' || CASE WHEN
                    own > 0 AND others > 0 AND NOT (vals > 16 AND j.n < 0.01 * all_n)
                    AND abs(j.allow::DOUBLE / own - (all_allow - j.allow)::DOUBLE / others)
                        > 2.58 * sqrt(all_allow::DOUBLE / (own + others)
                            * (1 - all_allow::DOUBLE / (own + others))
                            * (1 / own::DOUBLE + 1 / others::DOUBLE))
                    THEN h.value ELSE '*' END END AS template
    FROM here{k} h LEFT JOIN judged{k} j
      ON h.host = j.host AND h.template = j.template AND h.value = j.value
)"""

SQL = (
    r"""
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0
                         THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after
    FROM pages
), parsed AS (
    SELECT page_id,
           translate(regexp_extract(after, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substr(after, length(regexp_extract(after, '^[^/?#]*')) + 1),
                          '^[^?#]*') AS path
    FROM cut
), fitted AS (
    SELECT *,
           host = 'example.org' OR ends_with(host, '.example.org') AS in_example,
           host = 'org' OR ends_with(host, '.org') AS in_org,
           host = 'com' OR ends_with(host, '.com') AS in_com
    FROM parsed
), ruled AS (
    SELECT page_id, host, path, regexp_replace(path, '[0-9]+', '*', 'g') AS shape,
           CASE WHEN in_example AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                WHEN in_example AND starts_with(path, '/es/') THEN 'example.org/es/'
                WHEN in_com AND starts_with(path, '/fr/') THEN 'com/fr/'
                WHEN in_com AND starts_with(path, '/de/') THEN 'com/de/'
                WHEN in_org AND starts_with(path, '/') THEN 'org/' END AS rule
    FROM fitted
), allowed AS (
    SELECT *, rule IN ('org/', 'com/fr/') AS allowed FROM ruled
), grown0 AS (
    SELECT host, shape, count(*) AS n, count(*) FILTER (allowed) AS allow,
           count(*) FILTER (NOT allowed) AS block,
           list_filter(string_split(shape, '/'), lambda s: s <> '') AS segments, '' AS template
    FROM allowed GROUP BY host, shape
),"""
    + ",".join(_LEVEL.format(k=k, j=k - 1) for k in range(1, DEPTH + 1))
    + """,
tree AS (
    SELECT host, shape, allow, block,
           CASE WHEN len(segments) > 3 THEN template || '/**' ELSE template END AS template
    FROM grown3
), hosts AS (
    SELECT host, (sum(allow) + 10.0::DOUBLE * any_value(base))
                 / (sum(allow) + sum(block) + 10.0::DOUBLE) AS host_purity
    FROM tree, (SELECT (sum(allow) + 1.0::DOUBLE) / (sum(allow) + sum(block) + 2.0::DOUBLE) AS base
                FROM tree) GROUP BY host
), pure AS (
    SELECT t.host, template, (sum(allow) + 10.0::DOUBLE * any_value(host_purity))
                             / (sum(allow) + sum(block) + 10.0::DOUBLE) AS purity
    FROM tree t JOIN hosts h ON t.host = h.host GROUP BY t.host, template
)
SELECT a.page_id, a.host, a.path, a.rule,
       CASE WHEN coalesce(a.allowed, p.purity >= 0.5) THEN 'allow' ELSE 'block' END AS verdict,
       t.template, p.purity
FROM allowed a
JOIN tree t ON a.host = t.host AND a.shape = t.shape
JOIN pure p ON t.host = p.host AND t.template = p.template
"""
)
