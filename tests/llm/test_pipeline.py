from pathlib import Path

import pytest
from compare import connection, differences

import corpus_pipeline
from knownat.llm import mixing, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no benchmark tables here")


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    for step, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SF)
        if step < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == columns
        path = str(tmp_path / str(step))
        made.write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] <= counts[2]
    assert counts[5] == counts[4]
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(whole.collect()) == sorted(docs.collect())


def test_token_files_follow_the_training_order(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    path = str(tmp_path / "mixed")
    corpus_pipeline.mix_sources(spark, docs, SF).write.parquet(path)
    placed = mixing.with_positions(mixing.plan_mixture(docs)).select("doc_id", "position")
    planned = [r.doc_id for r in placed.orderBy("position").collect()]
    assert planned != sorted(planned)
    made = corpus_pipeline.write_token_files(spark, spark.read.parquet(path), SF).collect()
    written = [r.doc_id for r in sorted(made, key=lambda r: r.start)]
    place = {}
    for r in placed.collect():
        place.setdefault(r.doc_id, []).append(r.position)
    place = {d: iter(sorted(found)) for d, found in place.items()}
    positions = [next(place[d]) for d in written]
    assert sorted(written) == sorted(planned)
    assert positions == sorted(positions)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    made = queries.queries()[name](spark, SF).toArrow()
    sql = connection(SF).sql(queries.oracle_sql()[name])
    assert differences(made, sql.to_arrow_table()) == []
