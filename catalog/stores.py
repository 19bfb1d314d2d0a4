"""Archives, partitioned and named tables, metadata appends and file digests, written and read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.roles import table
from knownat.operators.audit import cardinality_violations, checked_lookup
from knownat.session import ensure_checkpoint_dir
from knownat.sources import archives, documents, tables


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "archive_document_scan",
    """SELECT doc_id, lang, source, n_chars, length(text)::INTEGER AS text_length,
    sha256(text) AS text_sha256 FROM documents WHERE doc_id % 7 <> 0""",
)
def archive_document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON members of three archives, the matching ones read back and parsed."""
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("note-"), "doc_id")).otherwise(
        F.format_string("CIK%010d.json", "doc_id")
    )
    folder = _folder(spark, "documents")
    pieces = docs.select(
        F.concat(F.lit("bulk-"), F.pmod("doc_id", F.lit(3))).alias("archive"),
        kind.alias("member"),
        F.lit(0).alias("place"),
        F.to_json(F.struct(*docs.columns)).alias("text"),
    )
    archives.write_archives(pieces, folder).agg(F.sum("members")).first()
    found = documents.read_archive(spark, f"{folder}/*.zip", documents.FILER_MEMBER)
    row = F.from_json("payload", docs.schema)
    return found.select(row.alias("d")).select(
        "d.doc_id", "d.lang", "d.source", "d.n_chars",
        F.length("d.text").alias("text_length"), F.sha2("d.text", 256).alias("text_sha256"),
    )


@query(
    "archive_table_scan",
    """SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
    o_custkey FROM orders""",
)
def archive_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a tab separated member of one archive a year, streamed back with types."""
    orders = table(spark, sf_dir, "orders")
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_custkey"]
    types = [
        orders.schema[c].dataType.simpleString() if c != "o_orderdate" else "date" for c in columns
    ]
    typed = orders.select(
        *[F.col(c).cast(t).cast("string").alias(c) for c, t in zip(columns, types, strict=True)],
        F.concat(F.lit("orders-"), F.year("o_orderdate")).alias("archive"),
    )
    lines = typed.select(
        "archive", F.lit("sub.txt").alias("member"), F.col("o_orderkey").cast("long").alias("place"),
        F.concat(F.concat_ws("\t", *columns), F.lit("\n")).alias("text"),
    )
    heads = lines.select("archive").distinct().select(
        "archive",
        F.explode(
            F.array(
                F.struct(F.lit("sub.txt").alias("member"), F.lit("\t".join(columns) + "\n").alias("text")),
                F.struct(F.lit("num.txt").alias("member"), F.lit("tag\tvalue\nx\t1\n").alias("text")),
            )
        ).alias("h"),
    ).select("archive", "h.member", F.lit(-1).cast("long").alias("place"), "h.text")
    folder = _folder(spark, "orders")
    archives.write_archives(lines.union(heads), folder).agg(F.sum("members")).first()
    schema = ", ".join(f"{c} {t}" for c, t in zip(columns, types, strict=True))
    return documents.read_archived_table(spark, f"{folder}/*.zip", "sub.txt", schema)


@query(
    "partition_overwrite",
    """WITH w AS (SELECT o_orderkey, o_totalprice AS amount,
    'fold_' || CAST(year(o_orderdate) AS VARCHAR) AS fold_id, CAST(o_custkey % 2 AS INTEGER) AS horizon FROM orders)
SELECT o_orderkey, CASE WHEN fold_id = 'fold_1995' AND horizon = 0 THEN 2 * amount ELSE amount END AS amount,
    fold_id, horizon
FROM w WHERE fold_id IN ('fold_1995', 'fold_1996')
    AND (fold_id <> 'fold_1995' OR horizon <> 0 OR amount > 100000)""",
)
def partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All folds written, one partition replaced, two folds read back under pruning."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").alias("amount"),
        F.concat(F.lit("fold_"), F.year("o_orderdate")).alias("fold_id"),
        (F.col("o_custkey") % 2).cast("int").alias("horizon"),
    )
    path = _folder(spark, "folds")
    tables.write_partitioned(rows, path)
    one = rows.where("fold_id = 'fold_1995' AND horizon = 0 AND amount > 100000")
    tables.write_partitioned(one.withColumn("amount", 2 * F.col("amount")), path, only=True)
    read = spark.read.schema(rows.schema).parquet(path)
    return read.where(F.col("fold_id").isin("fold_1995", "fold_1996")).select(*rows.columns)


@query(
    "published_table_swap",
    """SELECT c_nationkey, count(*) AS customers,
    count(*) FILTER (WHERE c_custkey % 2 = 0) AS even_customers
FROM customer GROUP BY c_nationkey HAVING count(*) FILTER (WHERE c_custkey % 2 = 0) > 0""",
)
def published_table_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table published twice, the second time from what it held itself."""
    database = f"marts_{uuid.uuid4().hex}"
    tables.create_schemas(spark, [database], location=_folder(spark, "marts"))
    name = f"{database}.nation_customers"
    even = (F.col("c_custkey") % 2 == 0).cast("long")
    tables.publish(table(spark, sf_dir, "customer").select("c_nationkey", even.alias("even")), name)
    held = spark.table(name)
    counted = held.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("even").alias("even_customers")
    )
    tables.publish(counted.where("even_customers > 0"), name)
    return spark.table(name)


@query(
    "metadata_append_report",
    """WITH o AS (
  SELECT c_custkey, CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE c_name END AS company_name
  FROM customer WHERE c_custkey % 2 = 0
  UNION ALL
  SELECT c_custkey, CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE c_name END FROM customer WHERE c_custkey % 10 = 0)
SELECT CAST('2025-12-31' AS DATE) AS selection_as_of, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik,
  CASE WHEN company_name IS NULL THEN 'required_column_empty' WHEN c_custkey % 3 = 0 THEN 'key_present'
       WHEN c_custkey % 10 = 0 THEN 'key_repeated' ELSE 'appended' END AS outcome,
  CASE WHEN company_name IS NULL THEN 'company_name' ELSE '' END AS detail
FROM o""",
)
def metadata_append_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two offers of universe decisions; what became of each row of the second."""
    database = f"metadata_{uuid.uuid4().hex}"
    tables.create_schemas(
        spark, [database], location=_folder(spark, "metadata"), metadata=database
    )
    customers = table(spark, sf_dir, "customer")
    decisions = customers.select(
        "c_custkey",
        F.lit("2025-12-31").alias("selection_as_of"),
        F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"),
        F.lit(None).cast("string").alias("ticker"),
        F.col("c_name").alias("company_name"),
        F.col("c_mktsegment").alias("sector"),
        F.lit(None).cast("string").alias("industry"),
        (F.col("c_acctbal") > 0).alias("included"),
        F.lit("screened").alias("reason_code"),
        F.lit(None).cast("string").alias("evidence_json"),
    )
    tables.record(decisions.where("c_custkey % 3 = 0"), "universe_decisions", metadata=database)
    unnamed = F.when(F.col("c_custkey") % 14 != 0, F.col("company_name"))
    second = decisions.withColumn("company_name", unnamed)
    offered = second.where("c_custkey % 2 = 0").unionAll(second.where("c_custkey % 10 = 0"))
    return tables.append_new(offered, "universe_decisions", metadata=database)


@query(
    "artifact_verification",
    """WITH f AS (
  SELECT coalesce(lang, 'none') || '.txt' AS file, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS body
  FROM documents GROUP BY lang
), m AS (SELECT file, sha256(body) AS sha256, strlen(body) AS bytes FROM f),
r AS (
  SELECT file, CASE WHEN file = (SELECT min(file) FROM m) THEN upper(sha256) ELSE sha256 END AS sha256, bytes
  FROM m WHERE file <> (SELECT max(file) FROM m)
  UNION ALL SELECT 'gone.txt', sha256(''), 0
)
SELECT coalesce(r.file, m.file) AS file, r.sha256, r.bytes::BIGINT AS bytes,
  CASE WHEN r.file IS NULL THEN 'artifact_unrecorded' WHEN m.file IS NULL THEN 'artifact_missing'
       WHEN r.sha256 <> m.sha256 THEN 'checksum_or_size_mismatch' END AS reason,
  r.file IS NOT NULL AND m.file IS NOT NULL AND r.sha256 = m.sha256 AS valid
FROM r FULL JOIN m ON r.file = m.file""",
)
def artifact_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file per language against a manifest with a wrong, a lost and a missing record."""
    docs = table(spark, sf_dir, "documents")
    folder = _folder(spark, "files")
    pieces = docs.select(
        F.concat(F.coalesce("lang", F.lit("none")), F.lit(".txt")).alias("file"),
        F.col("doc_id").alias("place"),
        F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("text"),
    )
    archives.write_files(pieces, folder).agg(F.sum("bytes")).first()
    files = archives.list_files(spark, folder)
    digests = archives.file_digests(files)
    ends = digests.agg(F.min("path").alias("low"), F.max("path").alias("high"))
    wrong = F.when(F.col("path") == F.col("low"), F.upper("sha256")).otherwise(F.col("sha256"))
    gone = spark.range(1).select(
        F.lit("gone.txt").alias("path"), F.sha2(F.lit(""), 256).alias("sha256"),
        F.lit(0).cast("long").alias("bytes"),
    )
    manifest = (
        digests.crossJoin(F.broadcast(ends))  # one row
        .where("path <> high").select("path", wrong.alias("sha256"), "bytes").union(gone)
    )
    report = tables.verify_files(files, manifest)
    return report.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "sha256", "bytes", "reason", "valid"
    )


@query(
    "lookup_cardinality",
    """WITH l AS (SELECT o_custkey AS custkey, count(*) AS n FROM orders GROUP BY o_custkey),
r AS (SELECT custkey, count(*) AS m FROM (
    SELECT c_custkey AS custkey FROM customer WHERE c_custkey % 5 <> 0
    UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0) GROUP BY custkey),
b AS (SELECT coalesce(l.custkey, r.custkey) AS custkey, coalesce(n, 0) AS n, coalesce(m, 0) AS m
    FROM l FULL JOIN r ON l.custkey = r.custkey)
SELECT custkey, 'right' AS side, n AS rows, m AS partners FROM b WHERE m > 1
UNION ALL SELECT custkey, 'unmatched', n, m FROM b WHERE n > 0 AND m = 0
UNION ALL SELECT custkey, 'left', n, m FROM b WHERE n > 1""",
)
def lookup_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of orders against a customer list with repeats and gaps."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"))
    listed = customers.where("custkey % 5 <> 0").unionAll(customers.where("custkey % 4 = 0"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"))
    return cardinality_violations(orders, listed, ["custkey"], one_to_one=True)


@query(
    "checked_lookup_rows",
    """SELECT o_orderkey, o_custkey AS custkey, c_nationkey, c_mktsegment
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 5 <> 0""",
)
def checked_lookup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with what the customer list says, each order once."""
    listed = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0")
    customers = listed.select(F.col("c_custkey").alias("custkey"), "c_nationkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"))
    return checked_lookup(orders, customers, ["custkey"])
