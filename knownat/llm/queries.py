"""The registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knownat.llm import (
    centroids, decontam, mixing, partenum, pii, prefixes, quality, rules, simhash, suffixes,
    tokens, toxicity, urls,
)
from knownat.llm.common import prepare

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = tokens.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
    return tokens.with_starts(tokens.read_tokens(folder, index)).select(
        "doc_id", "start", "n_tokens", "ids_crc32"
    )


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixture of all documents; ``position`` is the training time of a row's first words."""
    plan = mixing.plan_mixture(table(spark, sf_dir, "documents"))
    position = mixing.position_of(
        F.col("before").cast("double"), F.col("slot"), F.floor("target").cast("double")
    )
    return plan.select(
        "doc_id", "size", "source_size", "target", "taken",
        F.when(F.col("taken") > 0, position).alias("position"),
    ).orderBy("position", "doc_id")


OP2_SQL = r"""
WITH sized AS (
    SELECT doc_id, source,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
    SELECT source, source_size,
           ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INTEGER AS slot
    FROM sources
), limited AS (
    SELECT *, CASE slot WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END
                  AS weight,
           source_size * 3 AS most
    FROM ranked
), levels AS (
    SELECT *,
           (sum(source_size) OVER ())::BIGINT - coalesce((sum(most) OVER (
               ORDER BY most / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS remaining,
           sum(weight) OVER (
               ORDER BY most / weight, source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
    FROM limited
), stopped AS (
    SELECT *, weight * remaining / rest >= most AS stops FROM levels
), free AS (
    SELECT *,
           max(CASE WHEN NOT stops THEN remaining END) OVER () AS shared,
           max(CASE WHEN NOT stops THEN rest END) OVER () AS by_weight
    FROM stopped
), targets AS (
    SELECT source, source_size, slot,
           CASE WHEN stops THEN most::DOUBLE ELSE weight * shared / by_weight END AS target
    FROM free
), placed AS (
    SELECT *, (sum(size) OVER (
               PARTITION BY source
               ORDER BY md5('mix' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size
               ROWS UNBOUNDED PRECEDING))::BIGINT - size AS before
    FROM sized
), aimed AS (
    SELECT p.doc_id, p.size, p.before, t.source_size, t.slot, t.target,
           floor(t.target)::BIGINT AS whole
    FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
), mixture AS (
    SELECT *,
           CASE WHEN source_size > 0 THEN
               (whole // source_size) * size
               + greatest(0, least(size, whole - (whole // source_size) * source_size - before))
           ELSE 0 END::BIGINT AS taken
    FROM aimed
)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN
           0.0::DOUBLE + 2.0::DOUBLE * (before::DOUBLE / whole::DOUBLE)
           / ((CASE slot WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 ELSE 0.5 END)::DOUBLE
              + sqrt(greatest(0.0::DOUBLE,
                    (CASE slot WHEN 0 THEN 2.25 WHEN 1 THEN 1.0 ELSE 0.25 END)::DOUBLE
                    + (CASE slot WHEN 0 THEN -2.0 WHEN 1 THEN 0.0 ELSE 2.0 END)::DOUBLE
                      * (before::DOUBLE / whole::DOUBLE))))
       END AS position
FROM mixture
"""


def op3_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items whose shingles they contain at 0.8 or more."""
    found = decontam.find_contained(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def op4_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words, network = quality.learn_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, words, network)


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word spans of at least 50 words that another document's text holds as well."""
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def op7_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


#: A stand-in secret for the registered query; a real one comes from a key store.
PSEUDONYM_KEY = b"corpus pseudonyms"


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with personal data, their texts with format-preserving pseudonyms."""
    return pii.pseudonymise_documents(
        table(spark, sf_dir, "documents"), PSEUDONYM_KEY, only_found=True
    )


def op9_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge_documents(table(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations."""
    return prefixes.prefix_trie(prefixes.rebuilt_paths(table(spark, sf_dir, "conversations")))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the size of their shingle set and their group of similar documents."""
    return partenum.similar_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_token_files": op1_token_files,
    "op2_mixture": op2_mixture,
    "op3_benchmark_passages": op3_benchmark_passages,
    "op4_quality_scores": op4_quality_scores,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_simhash_groups": op6_simhash_groups,
    "op7_toxicity_scores": op7_toxicity_scores,
    "op8_pseudonyms": op8_pseudonyms,
    "op9_url_verdicts": op9_url_verdicts,
    "op10_quality_rules": op10_quality_rules,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_ngram_jaccard": op13_ngram_jaccard,
}
ORACLE_SQL: dict[str, str] = {
    "op2_mixture": OP2_SQL,
    "op9_url_verdicts": urls.SQL,
    "op11_centroid_clusters": centroids.sql(),
    "op12_prefix_trie": prefixes.SQL,
}


def queries() -> dict[str, Query]:
    def prepared(run: Query) -> Query:
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(prepare(spark), sf_dir)

        return call

    return {name: prepared(run) for name, run in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
