import pytest

from tests.llm.brute import components, contamination, suffix_spans
from tests.oracle import compare, connection


@pytest.fixture(scope="module")
def queries():
    from tessera.llm import queries as q

    return q.queries()


@pytest.mark.parametrize("name", ["op6_source_mixing", "op7_chat_formatting", "op12_vector_codes"])
def test_against_sql(spark, data, queries, name):
    from tessera.llm.oracles import SQL

    assert compare(queries[name](spark, data), connection(data), SQL[name]) > 0


def test_all_are_registered(queries):
    import __spark_entry__ as entry

    assert set(queries) <= set(entry.queries())
    assert [sum(q.startswith(f"op{n}_") for q in queries) for n in range(1, 13)] == [1] * 12 and "pipeline" in queries


def test_stages_against_brute_force(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    stages = dict(p.STAGES)
    assert list(stages) == ["language_id", "jaccard_join", "suffix_array_dedup", "decontamination", "source_mixing"]
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    told = stages["language_id"](spark, docs, data)
    assert told.columns == docs.columns and told.count() > 0.9 * docs.count()
    alone = stages["jaccard_join"](spark, docs, data)
    want = {d for d, _, c in components(pairs(docs)) if c == d}
    assert {d for d, _ in pairs(alone)} == want and alone.columns == docs.columns
    cut = stages["suffix_array_dedup"](spark, docs, data)
    removed = {r[0]: r for r in suffix_spans(pairs(docs))}
    assert cut.columns == docs.columns
    assert {d for d in removed if removed[d][2] == 0} <= {d for d, _ in pairs(cut)}
    for r in cut.collect():
        assert r["n_chars"] == len(r["text"]) and abs(len(r["text"].encode()) - (removed[r["doc_id"]][1] - removed[r["doc_id"]][2])) <= 6
    clean = stages["decontamination"](spark, docs, data)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert {d for d, _ in pairs(clean)} == {r[0] for r in contamination(pairs(docs), items) if not r[5]}
    mixed = stages["source_mixing"](spark, docs, data)
    assert set(docs.columns) < set(mixed.columns) and mixed.where("copies < 1").count() == 0


def test_run(spark, data):
    import corpus_pipeline as p

    out = p.run(spark, data)
    assert 0 < out.count() <= spark.read.parquet(f"{data}/documents.parquet").count()
