"""Every registered corpus query by its name, over awkward tables and over empty ones."""

import pytest
from compare import TABLES, differences

from knownat.llm import queries

#: Fixed formats: the columns that each query returns at least.
COLUMNS = {
    "op1_token_files": "doc_id start n_tokens ids_crc32",
    "op2_mixture": "doc_id size source_size target taken",
    "op3_benchmark_passages": "doc_id item_id",
    "op4_quality_scores": "doc_id held_out score predicted",
    "op5_repeated_passages": "doc_id start_word n_words first_doc_id parts",
    "op6_simhash_groups": "doc_id fingerprint component_id",
    "op7_toxicity_scores": "doc_id held_out score predicted",
    "op8_pseudonyms": "doc_id text n_found kinds",
    "op9_url_verdicts": "page_id host path rule verdict",
    "op10_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op11_centroid_clusters": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    "op12_prefix_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op13_ngram_jaccard": "doc_id n_shingles component_id",
}
ONE_ROW_PER_DOCUMENT = [f"op{n}_" for n in (1, 2, 4, 6, 7, 10, 13)]
SCHEMAS = {
    "embeddings": "vec_id long, embedding array<float>, label int, cluster int, id long, vector int",
    "pages": "page_id long, url string, html string, host string, rule int",
    "benchmark": "item_id long, text string, doc_id int",
    "labels": "doc_id long, quality int, toxic int, text string",
    "conversations": "conv_id long, turn long, role string, text string, path int, chars int, base int",
}
ROWS = {
    "embeddings": [(i, [(-1.0) ** i * i / 7, float(i % 5)] * 32, 0, 1, 2, 3) for i in range(30)]
    + [(None, [0.5] * 64, 0, 1, 2, 3), (3, None, 0, 1, 2, 3), (4, [1.0], 0, 1, 2, 3)],
    "pages": [(1, "https://a.Example.org/en/1", None, "h", 1), (2, None, "", "h", 1), (2, "x", "", "h", 1),
              (None, "http://b.com/fr/x/y/z/w", "", "h", 1)],
    "benchmark": [(1, "one two three four five six", 5), (1, None, 5), (None, "", 5)],
    "labels": [(i, i % 2, i % 3 == 0, "x") for i in range(17)] + [(None, 1, 1, "x"), (1, None, None, "x")],
    "conversations": [(c, t, "user", f"{t} {c % 3}", 1, 2, 3) for c in range(105) for t in range(c % 4)]
    + [(None, 1, "user", "x", 1, 2, 3), (7, None, None, None, 1, 2, 3), (7, None, None, None, 1, 2, 3)],
}


def folder(spark, path, documents, rows):
    documents.write.parquet(f"{path}/documents.parquet")
    for name, schema in SCHEMAS.items():
        made = [tuple(int(v) if isinstance(v, bool) else v for v in r) for r in rows.get(name, [])]
        spark.createDataFrame(made, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def awkward(spark, odd, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("awkward"), odd, ROWS)


@pytest.fixture(scope="module")
def empty(spark, nothing, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("empty"), nothing, {})


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_awkward_and_empty_tables(spark, odd, awkward, empty, name):
    run = queries.queries()[name]
    made = run(spark, awkward)
    assert set(COLUMNS[name].split()) <= set(made.columns)
    rows = made.toArrow()
    if name.split("_")[0] + "_" in ONE_ROW_PER_DOCUMENT:
        assert rows.num_rows == odd.count()
    if name == "op6_simhash_groups":
        assert all(len(f) == 16 and f == f.lower() for f in rows["fingerprint"].to_pylist())
    assert run(spark, empty).count() == 0


@pytest.mark.parametrize("name", ["op11_centroid_clusters", "op12_prefix_trie"])
def test_new_queries_agree_with_sql_on_awkward_tables(spark, awkward, name):
    con = connection_of(awkward)
    made = queries.queries()[name](spark, awkward).toArrow()
    assert differences(made, con.execute(queries.oracle_sql()[name]).to_arrow_table()) == []


def connection_of(path):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", *SCHEMAS):
        assert name in TABLES
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    return con
