"""Named tables, partitioned output, entity filters and checksum verification."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knownat.functions import pad_id
from knownat.operators.checks import require_columns
from knownat.scale import same_keys, stable
from knownat.sources.archives import file_digests

SCHEMAS = ("metadata", "raw", "staging", "intermediate", "marts")
#: Fixed formats: columns of the metadata tables and the keys that must be unique in them.
METADATA_TABLES = {
    "pipeline_runs": "run_id STRING NOT NULL, started_at_utc TIMESTAMP NOT NULL, "
    "completed_at_utc TIMESTAMP, status STRING NOT NULL, git_commit STRING, "
    "config_version STRING NOT NULL",
    "source_manifests": "source STRING NOT NULL, source_url STRING NOT NULL, "
    "retrieved_at_utc TIMESTAMP NOT NULL, output_path STRING NOT NULL, sha256 STRING NOT NULL, "
    "byte_count BIGINT NOT NULL, parameters_json STRING NOT NULL",
    "universe_decisions": "selection_as_of DATE NOT NULL, cik STRING NOT NULL, ticker STRING, "
    "company_name STRING NOT NULL, sector STRING, industry STRING, included BOOLEAN NOT NULL, "
    "reason_code STRING NOT NULL, evidence_json STRING",
}
METADATA_KEYS = {
    "pipeline_runs": ("run_id",),
    "source_manifests": ("source", "sha256"),
    "universe_decisions": ("selection_as_of", "cik"),
}


def create_schemas(
    spark: SparkSession, names: Sequence[str] = SCHEMAS, *, location: str | None = None,
    metadata: str = "metadata",
) -> None:
    """The layer databases and the metadata tables, if they do not exist yet.

    ``location`` is a folder for the databases instead of the session's warehouse.
    """
    for name in names:
        place = f" LOCATION '{location}/{name}'" if location else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}{place}")
    for name, columns in METADATA_TABLES.items() if metadata in names else ():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {metadata}.{name} ({columns}) USING parquet")


#: Rows, about, that one task writes into a partition value's folder.
FILE_ROWS = 4_000_000


def record(df: DataFrame, name: str, *, metadata: str = "metadata") -> None:
    """Append rows to a metadata table; required columns must be filled and keys new.

    If a row does not qualify nothing is written and the error names the first such row.
    """
    judged, columns = _offered(df, name, metadata)
    refused = judged.where("outcome <> 'appended'").select("outcome", *METADATA_KEYS[name]).first()
    if refused:
        empty = refused.outcome == "required_column_empty"
        problem = "a required column is empty" if empty else "a key is present already"
        keys = {k: refused[k] for k in METADATA_KEYS[name]}
        raise ValueError(f"{metadata}.{name}: {problem}, {keys}")
    judged.select(*columns).write.mode("append").insertInto(f"{metadata}.{name}")


def append_new(df: DataFrame, name: str, *, metadata: str = "metadata") -> DataFrame:
    """Append the rows of a metadata table that qualify and report on all that were offered.

    A row is refused, never changed or merged, when a required column is empty, when its key is
    in the table already, or when rows of this offer share the key.  One row per offered row:
    the keys, ``outcome`` and ``detail`` (the empty columns, if any).
    """
    judged, columns = _offered(df, name, metadata)
    fit = judged.where("outcome = 'appended'").select(*columns)
    fit.write.mode("append").insertInto(f"{metadata}.{name}")
    return judged.select(*METADATA_KEYS[name], "outcome", "detail")


def _offered(df: DataFrame, name: str, metadata: str) -> tuple[DataFrame, list[str]]:
    table = f"{metadata}.{name}"
    parts = [c.strip().split(" ", 1) for c in METADATA_TABLES[name].split(",")]
    columns = [c for c, _ in parts]
    require_columns(df, columns, table)
    rows = df.select(*[F.col(c).cast(kind.split(" ")[0]).alias(c) for c, kind in parts])
    needed = [c for c, kind in parts if kind.endswith("NOT NULL")]
    empty = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in needed]))
    present = df.sparkSession.table(table)
    return _judged(rows.withColumn("__empty", empty), present, METADATA_KEYS[name]), columns


def _judged(rows: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Offered rows with ``outcome`` and ``detail``; counts and the table meet them by key."""
    keys = list(keys)
    offered = stable(rows)
    counts = offered.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    held = present.select(*keys).distinct().withColumn("__held", F.lit(True))
    known = same_keys(counts, held, keys, "left")
    outcome = (
        F.when(F.size("__empty") > 0, "required_column_empty")
        .when(F.col("__held"), "key_present")
        .when(F.col("__n") > 1, "key_repeated")
        .otherwise("appended")
    )
    judged = same_keys(offered, known, keys, "left").withColumns(
        {"outcome": outcome, "detail": F.concat_ws(",", "__empty")}
    )
    return stable(judged.drop("__empty", "__n", "__held"))


def publish(df: DataFrame, table: str) -> None:
    """Replace a named table with the rows of a frame, which may read that table itself.

    The rows are written whole under another name first; only then do the names change, so
    readers see the old table or the new one, and a failed write leaves the old one.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex[:8]
    staged, former = f"{table}__staged_{mark}", f"{table}__former_{mark}"
    df.write.format("parquet").saveAsTable(staged)
    replaced = spark.catalog.tableExists(table)
    if replaced:
        spark.sql(f"ALTER TABLE {table} RENAME TO {former}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {table}")
    if replaced:
        spark.sql(f"DROP TABLE {former}")


def write_partitioned(
    df: DataFrame, path: str, by: Sequence[str] = ("fold_id", "horizon"), *, only: bool = False
) -> None:
    """Hive-partitioned Parquet; readers filtering on ``by`` open only matching folders.

    ``only`` replaces just the partitions that the rows belong to and leaves the others.

    The keys have few values, so rows are also spread inside each of them by a hash of the other
    columns: a fold with most of the rows is written by as many tasks as its rows call for.
    """
    require_columns(df, by, "partitioned output")
    others = [c for c in df.columns if c not in by]
    salts = max(1, math.ceil(df.count() / FILE_ROWS))
    (
        df.repartition(*by, F.pmod(F.xxhash64(*(others or by)), F.lit(salts)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if only else "static")
        .partitionBy(*by)
        .parquet(path)
    )


def write_report(df: DataFrame, path: str) -> None:
    """CSV with a header for report-sized tables."""
    df.write.mode("overwrite").csv(path, header=True)


def restrict_to_entities(
    df: DataFrame, ids: DataFrame, *, entity: str = "cik"
) -> tuple[DataFrame, DataFrame]:
    """(rows of the selected entities with padded ids, one-line row and entity counts).

    Raises when a selected entity has no rows.  No broadcast is forced: Spark chooses it when
    the id list is small.
    """
    padded = df.withColumn(entity, pad_id(entity))
    wanted = ids.select(pad_id(entity).alias(entity)).distinct()
    absent = wanted.join(padded.select(entity), entity, "left_anti")
    if not absent.limit(1).isEmpty():
        raise ValueError("selected entities are missing from the store")
    kept = padded.join(wanted, entity, "left_semi")
    per_entity = padded.groupBy(entity).agg(F.count(F.lit(1)).alias("__n"))
    chosen = wanted.withColumn("__in", F.lit(True))
    report = per_entity.join(chosen, entity, "left").agg(
        F.sum("__n").alias("rows_before"),
        F.sum(F.when(F.col("__in"), F.col("__n"))).alias("rows_after"),
        F.count(F.when(F.col("__in"), 1)).alias("entities"),
    )
    return kept, report


def verify_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Compare listed files (path) with recorded (path, sha256, bytes); one row per path.

    Digests are computed where a file is read, as a stream.  A file that nobody recorded and a
    record without a file each give a row.
    """
    measured = file_digests(files).select(
        "path", F.col("sha256").alias("__sha"), F.col("bytes").alias("__bytes")
    )
    recorded = manifest.select("path", "sha256", "bytes", F.lit(True).alias("__recorded"))
    joined = recorded.join(measured, "path", "full")
    same = (F.col("__sha") == F.col("sha256")) & (F.col("__bytes") == F.col("bytes"))
    reason = (
        F.when(F.col("__recorded").isNull(), "artifact_unrecorded")
        .when(F.col("__sha").isNull(), "artifact_missing")
        .when(same, F.lit(None))
        .otherwise("checksum_or_size_mismatch")
    )
    return joined.select(
        "path", "sha256", "bytes", reason.alias("reason"), reason.isNull().alias("valid")
    )


def reconcile_accessions(
    bulk: DataFrame, facts: DataFrame, *, accession: str = "accession_number", period: str = "period"
) -> DataFrame:
    """Per period: distinct filings in the bulk set and how many the facts also carry."""
    filings = bulk.select(period, accession).distinct()
    known = facts.select(accession).distinct().withColumn("__known", F.lit(1))
    return filings.join(known, accession, "left").groupBy(period).agg(
        F.count(F.lit(1)).alias("filings"), F.count("__known").alias("matched")
    )
