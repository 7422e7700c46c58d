import pytest

from tessera.plans import queries
from tests.oracle import TABLES, compare, connection


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, data, con, name):
    compare(queries.QUERIES[name](spark, data), con, queries.SQL[name])


def test_the_whole_batch_asks_every_vector_and_item(spark, data):
    ids = {r[0] for name, key in (("embeddings", "vec_id"), ("benchmark", "item_id")) for r in spark.read.parquet(f"{data}/{name}.parquet").select(key).collect()}
    assert {r[0] for r in queries.QUERIES["hybrid_batch"](spark, data).select("query_id").distinct().collect()} == ids


def test_keywords_find_documents_without_a_vector(spark, data, tmp_path):
    for name in TABLES:
        if name != "embeddings":
            (tmp_path / f"{name}.parquet").symlink_to(f"{data}/{name}.parquet")
    spark.read.parquet(f"{data}/embeddings.parquet").where("vec_id < 50").write.parquet(str(tmp_path / "embeddings.parquet"))
    few = connection(str(tmp_path))
    for name in ("rrf_fusion", "hybrid_filtered", "kw_only_similarity_one", "search_end_to_end"):
        compare(queries.QUERIES[name](spark, str(tmp_path)), few, queries.SQL[name])
    assert queries.QUERIES["rrf_fusion"](spark, str(tmp_path)).where("chunk_id >= 50").count() > 0


def test_whole_texts_are_read(spark, data):
    assert queries.QUERIES["sanitize_names"](spark, data).where("length(name) > 25").count() > 0
    assert queries.QUERIES["page_text_choice"](spark, data).where("length(text) > 89").count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_stay_above_the_limits(spark, data):
    text = plan(queries.QUERIES["hybrid_filtered"](spark, data))
    assert "CartesianProduct" not in text
    assert text.count("TakeOrderedAndProject") == 2


def test_scans_read_what_they_need(spark, data):
    text = plan(queries.QUERIES["page_range_filter"](spark, data))
    assert "ReadSchema: struct<doc_id:bigint>" in text
