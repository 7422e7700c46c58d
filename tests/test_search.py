import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bm25, fusion, knn, rerank


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")


@pytest.mark.parametrize("query", ["heat tion É", "the the of", "que_de la", "in_the of", "?!", "zzz nothing", "und Und"])
def test_bm25_as_in_sqlite(spark, docs, query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", [(r[0] + 1, r[1]) for r in docs.collect()])
    import re

    match = " OR ".join(f'"{w}"' for w in re.findall(r"\w+", query)) or '""'
    want = {r[0] - 1: r[1] for r in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
    got = {r["chunk_id"]: r["bm25"] for r in bm25.search(bm25.postings(docs), bm25.lengths(docs), query, 100_000).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_knn_and_batch_agree(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[3]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, embedding array<float>").repartition(5)
    one = [tuple(r) for r in knn.search(rows, v[3].astype(np.float32).tolist(), 5).select("chunk_id", "rank").collect()]
    many = [tuple(r) for r in knn.batch_search(rows, [(3, v[3].astype(np.float32).tolist()), (4, v[4].tolist())], 5).where("query_id = 3").orderBy("rank").select("chunk_id", "rank").collect()]
    assert one == many and one[:2] == [(3, 1), (7, 2)]
    assert knn.batch_search(rows.limit(2), [(0, v[0].tolist())], 5).count() == 2


def test_fusion_order_is_stable(spark):
    v = spark.createDataFrame([(10, 1, 0.1), (11, 2, 0.2)], "chunk_id long, rank int, distance double")
    w = spark.createDataFrame([(11, 1), (12, 2)], "chunk_id long, rank int")
    rows = fusion.fuse(v, w).orderBy(*fusion.rrf_order()).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(fusion.fuse_lists([(10, 0.1), (11, 0.2)], [11, 12]), key=repr)
    assert [r["chunk_id"] for r in rows] == [11, 10, 12]
    assert rows[2]["distance"] == 0.0 and abs(rows[0]["rrf"] - 1 / 62 - 1 / 61) < 1e-12


def test_ties_go_to_the_vector_side(spark):
    v = spark.createDataFrame([(1, 1, 0.5)], "chunk_id long, rank int, distance double")
    w = spark.createDataFrame([(2, 1)], "chunk_id long, rank int")
    assert [r[0] for r in fusion.fuse(v, w).orderBy(*fusion.rrf_order()).select("chunk_id").collect()] == [1, 2]


class Backwards:
    def score(self, query, passages):
        return [-len(p) for p in passages]


def test_reranker_model_and_projection(spark):
    rows = spark.createDataFrame([("a" * n, "/f", "f", None, n, 0.0, 1.0, 1, None) for n in (3, 1, 2)], "text string, source_file string, display_name string, page int, chunk_index int, distance double, rrf double, vec_rank int, kw_rank int")
    out = fusion.project_results(rerank.with_model(rows, "q", Backwards), 2)
    assert out.columns == fusion.RESULT and [r["text"] for r in out.collect()] == ["a", "aa"]
    with pytest.raises(ValueError):
        fusion.project_results(rows, -1)


def test_phrase_counts(spark):
    random.seed(3)
    rows = [(i, " ".join(random.choice("abc") for _ in range(30))) for i in range(20)]
    df = spark.createDataFrame(rows, "chunk_id long, text string")
    got = {r["chunk_id"]: r["tf"] for r in bm25._occurrences(bm25.postings(df), bm25.query_phrases(spark.createDataFrame([(0, "a_a_b")], "query_id int, query string"))).collect()}
    want = {i: n for i, t in rows if (n := sum(t.split()[k : k + 3] == ["a", "a", "b"] for k in range(28)))}
    assert got == want


def test_models_of_the_library(monkeypatch):
    import sys
    import types

    class Sentence:
        def __init__(self, name):
            pass

        def get_sentence_embedding_dimension(self):
            return 2

        def encode(self, texts, batch_size, normalize_embeddings):
            return [[len(t), batch_size] for t in texts]

    class Cross:
        def __init__(self, name):
            pass

        def predict(self, pairs, batch_size):
            return [len(p) - len(q) for q, p in pairs]

    monkeypatch.setitem(sys.modules, "sentence_transformers", types.SimpleNamespace(SentenceTransformer=Sentence, CrossEncoder=Cross))
    from tessera.operators import embed

    model = embed.SentenceModel("x/BGE-small")
    assert model.query("ab").tolist() == [len(embed.QUERY_PROMPT) + 2, 32] and model.passages([]).shape == (0, 2)
    assert embed.SentenceModel("other").query("ab").tolist() == [2, 32]
    assert rerank.CrossModel("c").score("q", ["abc", "a"]) == [2.0, 0.0] and rerank.CrossModel("c").score("q", []) == []


def test_groups_that_cannot_hold_a_neighbour_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(knn, "FEW", 100)
    rng = np.random.default_rng(8)
    heads = rng.normal(size=(12, 16)) * 4
    rows = [(k, (heads[k % 12] + rng.normal(size=16) * 0.2).astype(np.float32).tolist()) for k in range(900)]
    rows += [(1000, None), (1001, [1.0]), (1002, [None] * 16), (1003, [float("nan")] * 16), (1004, [float("inf")] * 16), (1005, rows[5][1]), (1006, rows[5][1])]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(3)
    found = knn.centres(df, each=60)
    grouped = df.withColumn("g", knn.group_of(F.col("embedding"), found)).select("chunk_id", "embedding", "g.grp", "g.far")
    groups = knn.Groups.of(grouped, found)
    take = lambda d: [(r["chunk_id"], r["rank"], round(r["distance"], 9)) for r in d.orderBy("rank").collect()]
    shares = []
    for query, k in ((rows[5][1], 5), (rows[17][1], 70), ([0.0] * 16, 20), (rows[3][1], 2000), (rows[5][1], 3)):
        near, read = knn.near(grouped, groups, query, k)
        assert take(near) == take(knn.search(df, query, k))
        shares.append(groups.count[np.isin(groups.ids, read)].sum() / groups.count.sum())
    assert shares[0] < 0.2 and shares[4] < 0.2 and shares[3] == 1.0
    for query in (rows[5][1], [1.0], [float("inf")] * 16):
        assert take(knn.search(df, query, 9, few=True)) == take(knn.search(df, query, 9))
    assert take(knn.near(grouped, groups, [1.0], 3)[0]) == [(1001, 1, 0.0)]
    none = df.where("chunk_id < 0")
    empty = none.withColumn("g", knn.group_of(F.col("embedding"), knn.centres(none))).select("chunk_id", "embedding", "g.grp")
    assert knn.near(empty, knn.Groups.of(empty.withColumn("far", F.lit(0.0)), knn.centres(none)), rows[0][1], 3)[0].count() == 0


def test_texts_without_an_index_score_as_postings_do(spark):
    rng = random.Random(9)
    words = ["red", "green", "blue", "Réd", "red_blue", "x1", "and", "the"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for k in range(200)] + [(300, None), (301, ""), (302, "?!"), (303, "red red red red")]
    docs = spark.createDataFrame(rows, "chunk_id long, text string").repartition(3)
    asked = [(1, "red"), (2, "red red_blue the"), (3, "nothing"), (4, "red_red"), (5, "blue green green and_the_red"), (6, ""), (7, " ".join(f"x{k}" for k in range(60)))]
    table = spark.createDataFrame(asked, "query_id long, query string")
    want = bm25.top(bm25.scores(bm25.postings(docs), bm25.lengths(docs), table), 12)
    take = lambda d: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["bm25"], 8)) for r in d.collect())
    assert take(bm25.best_of_texts(docs, bm25.asked_by(table), 12)) == take(want)
    for i, q in asked:
        assert take(bm25.search_texts(docs, q, 12).withColumn("query_id", F.lit(i))) == [r for r in take(want) if r[0] == i]
    many = bm25.asked_by(spark.createDataFrame([(k, q) for k in range(150) for _, q in asked[:2]], "query_id long, query string"))
    assert bm25.best_of_texts(docs, many, 3).groupBy("query_id").count().where("count = 3").count() == 150
    assert bm25.best_of_texts(docs, [], 3).count() == 0 and bm25.best_of_texts(docs.where("chunk_id < 0"), many, 3).count() == 0


def test_many_queries_find_what_each_alone_finds(spark, monkeypatch):
    """Equal distances, copies, infinite and huge vectors, fewer vectors than k; and the distance is taken of few pairs only."""
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(900, 8)), rng.integers(0, 2, (300, 8)), np.full((3, 8), 1e200), rng.normal(size=(4, 8)) * 1e8])
    v[5, 2], v[6, 0], v[7] = np.inf, np.nan, v[8]
    rows = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "chunk_id long, embedding array<double>").repartition(3)
    asked = [(i, v[i].tolist()) for i in range(0, len(v), 9) if i != 6] + [(2000, v[1204].tolist())]
    for table, k in ((rows, 7), (rows.where("chunk_id < 5"), 7)):
        many = {(r["query_id"], r["rank"]): (r["chunk_id"], r["distance"]) for r in knn.batch_search(table, asked, k).collect()}
        with monkeypatch.context() as m:
            m.setattr(knn, "MANY", 1 << 30)
            alone = {(r["query_id"], r["rank"]): (r["chunk_id"], r["distance"]) for r in knn.batch_search(table, asked, k).collect()}
        assert len(alone) == len(asked) * min(k, 5 if k > 5 and table is not rows else k)
        assert repr(sorted(many.items())) == repr(sorted(alone.items()))


def test_many_queries_take_few_distances():
    rng = np.random.default_rng(6)
    v = rng.normal(size=(6000, 64))
    taken = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.dtype.kind == "i":
                taken.append(len(at))
            return np.asarray(super().__getitem__(at))

    ids, d = knn._nearest(np.arange(200), v[:200].view(Counted), iter([(np.arange(a, a + 1000), v[a : a + 1000]) for a in range(0, 6000, 1000)]), 10)
    assert (ids[:, 0] == np.arange(200)).all() and (d[:, 0] == 0).all()
    assert 0 < sum(taken) < 200 * 6000 // 50


def test_postings_are_made_without_a_shuffle(spark):
    texts = ["b a b Ä", None, "", "...", "a", "b b b c"]
    df = spark.createDataFrame([(7 * k, t) for k, t in enumerate(texts)], "chunk_id long, text string").repartition(3).localCheckpoint()
    made = bm25.postings(df)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, made.collect())) == [(0, "a", 2, [1, 3], 4), (0, "b", 2, [0, 2], 4), (28, "a", 1, [0], 1), (35, "b", 3, [0, 1, 2], 4), (35, "c", 1, [3], 4)]
    assert bm25.postings(df.limit(0)).count() == 0
