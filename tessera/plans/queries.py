"""Registered queries of the library's operators over the test tables, each with the same thing in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.vectors import similarity
from tessera.operators import bm25, chunker, files, fusion, knn
from tessera.plans import jobs, search
from tessera.plans.catalog import Project
from tessera.session import shared_folder
from tessera.streaming.watch import with_rates

QUERY = "the tion und of the reat é de"
PHRASES = "in_the of_the und"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks: pages for two of three, file names that repeat in a folder and across folders."""
    name = F.concat(F.lit("note_"), (F.col("doc_id") % 37).cast("string"), F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".txt"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.concat(F.lit("/corpus/"), "source", F.lit("/"), name).alias("source_file"), name.alias("display_name"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 10).cast("int").alias("page"), F.lit(0).alias("chunk_index"))


_CORPUS = """corpus AS (
  SELECT doc_id AS chunk_id, text, '/corpus/' || source || '/note_' || (doc_id % 37) || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.txt' END AS source_file,
         'note_' || (doc_id % 37) || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.txt' END AS display_name,
         CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id % 10 AS INT) END AS page, CAST(0 AS INT) AS chunk_index
  FROM documents)"""
_SENTENCES = r"""sent AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS sent_no
  FROM (SELECT doc_id, regexp_replace(x, '^\s+|\s+$', '', 'g') AS s, k
        FROM (SELECT doc_id, unnest(parts) AS x, unnest(range(len(parts))) AS k
              FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+|\n{2,}', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents)))
  WHERE s <> '')"""
_TERMS = r"""terms AS (
  SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\pL\pN\p{Co}]+')) AS term FROM documents),
post AS (SELECT chunk_id, term, count(*) AS tf FROM terms GROUP BY ALL),
len AS (SELECT doc_id AS chunk_id, len(regexp_extract_all(lower(strip_accents(text)), '[\pL\pN\p{Co}]+')) AS dl FROM documents)"""


def _bm25(tokens: list[str]) -> str:
    """Scores, for tokens of one term each."""
    rows = ", ".join(f"('{t}')" for t in tokens) or "(NULL)"
    return f"""{_TERMS},
q AS (SELECT t AS term, count(*) AS times FROM (VALUES {rows}) v(t) WHERE t IS NOT NULL GROUP BY t),
df AS (SELECT term, count(*) AS n FROM post GROUP BY term),
fact AS (SELECT count(*) AS total, sum(dl) / count(*) AS mean FROM len),
bm AS (
  SELECT p.chunk_id, sum(-q.times * CASE WHEN ln((f.total - d.n + 0.5) / (d.n + 0.5)) <= 0 THEN 1e-6 ELSE ln((f.total - d.n + 0.5) / (d.n + 0.5)) END
    * p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.dl / f.mean))) AS bm25
  FROM post p JOIN q USING (term) JOIN df d USING (term) JOIN len l USING (chunk_id) CROSS JOIN fact f GROUP BY p.chunk_id)"""


_TOKENS = ["the", "tion", "und", "of", "the", "reat", "e", "de"]


@query(f"WITH {_SENTENCES} SELECT doc_id, CAST(sent_no AS INT) AS sent_no, s AS sentence FROM sent")
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_no", "sentence"))


@query(rf"WITH {_SENTENCES} SELECT lang, count(*) AS n_sentences, CAST(sum(len(regexp_extract_all(s, '\S+'))) AS BIGINT) AS n_tokens FROM sent JOIN documents USING (doc_id) GROUP BY lang")
def sentence_stats(spark, d):
    return table(spark, d, "documents").select("lang", F.explode(T.sentences(F.col("text"))).alias("s")).groupBy("lang").agg(F.count("*").alias("n_sentences"), F.sum(T.token_count(F.col("s"))).alias("n_tokens"))


@query(f"WITH {_TERMS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM post GROUP BY term")
def token_vocab(spark, d):
    return bm25.vocabulary(bm25.postings(table(spark, d, "documents"), "doc_id"))


@query(f"WITH {_TERMS} SELECT count(*) AS n_chunks, CAST(sum(dl) AS BIGINT) AS n_terms, CAST(min(dl) AS INT) AS shortest, CAST(max(dl) AS INT) AS longest, round(sum(dl) / count(*), 6) AS mean FROM len")
def doc_length_stats(spark, d):
    return bm25.lengths(table(spark, d, "documents"), "doc_id").agg(F.count("*").alias("n_chunks"), F.sum("dl").alias("n_terms"), F.min("dl").alias("shortest"), F.max("dl").alias("longest"), F.round(F.sum("dl") / F.count("*"), 6).alias("mean"))


def _keyword(spark, d, q, n):
    docs = table(spark, d, "documents")
    return bm25.search_texts(docs, q, n, "doc_id").select("chunk_id", F.round("bm25", 9).alias("bm25"), "rank")


_TOP = "SELECT chunk_id, round(bm25, 9) AS bm25, CAST(row_number() OVER (ORDER BY round(bm25, 9), chunk_id) AS INT) AS rank FROM bm ORDER BY round(bm.bm25, 9), chunk_id LIMIT {n}"


@query(f"WITH {_bm25(['heat', 'tion', 'e'])} {_TOP.format(n=75)}")
def bm25_topk(spark, d):
    return _keyword(spark, d, "heat tion É", 75)


@query(f"WITH {_bm25(_TOKENS)} {_TOP.format(n=75)}")
def bm25_dup_tokens(spark, d):
    return _keyword(spark, d, QUERY, 75)


@query(f"WITH {_bm25([])} {_TOP.format(n=10)}")
def bm25_no_match(spark, d):
    return _keyword(spark, d, "?! ...", 10)


@query(f"""WITH {_TERMS},
seq AS (SELECT chunk_id, t, k FROM (SELECT doc_id AS chunk_id, unnest(x) AS t, unnest(range(len(x))) AS k FROM (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\\pL\\pN\\p{{Co}}]+') AS x FROM documents))),
occ AS (
  SELECT 'in the' AS phrase, a.chunk_id, count(*) AS tf FROM seq a JOIN seq b ON a.chunk_id = b.chunk_id AND b.k = a.k + 1 WHERE a.t = 'in' AND b.t = 'the' GROUP BY a.chunk_id
  UNION ALL SELECT 'of the', a.chunk_id, count(*) FROM seq a JOIN seq b ON a.chunk_id = b.chunk_id AND b.k = a.k + 1 WHERE a.t = 'of' AND b.t = 'the' GROUP BY a.chunk_id
  UNION ALL SELECT 'und', chunk_id, tf FROM post WHERE term = 'und'),
df AS (SELECT phrase, count(*) AS n FROM occ GROUP BY phrase),
fact AS (SELECT count(*) AS total, sum(dl) / count(*) AS mean FROM len),
bm AS (
  SELECT o.chunk_id, sum(-CASE WHEN ln((f.total - d.n + 0.5) / (d.n + 0.5)) <= 0 THEN 1e-6 ELSE ln((f.total - d.n + 0.5) / (d.n + 0.5)) END
    * o.tf * 2.2::DOUBLE / (o.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.dl / f.mean))) AS bm25
  FROM occ o JOIN df d USING (phrase) JOIN len l USING (chunk_id) CROSS JOIN fact f GROUP BY o.chunk_id)
{_TOP.format(n=75)}""")
def bm25_phrase(spark, d):
    return _keyword(spark, d, PHRASES, 75)


@query(f"""WITH {_TERMS},
q AS (SELECT item_id AS query_id, x AS term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\\pL\\pN\\p{{Co}}]+')) AS x FROM benchmark) GROUP BY ALL),
df AS (SELECT term, count(*) AS n FROM post GROUP BY term),
fact AS (SELECT count(*) AS total, sum(dl) / count(*) AS mean FROM len),
bm AS (
  SELECT q.query_id, p.chunk_id, sum(-q.times * CASE WHEN ln((f.total - d.n + 0.5) / (d.n + 0.5)) <= 0 THEN 1e-6 ELSE ln((f.total - d.n + 0.5) / (d.n + 0.5)) END
    * p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.dl / f.mean))) AS bm25
  FROM post p JOIN q USING (term) JOIN df d USING (term) JOIN len l USING (chunk_id) CROSS JOIN fact f GROUP BY ALL)
SELECT query_id, chunk_id, round(bm25, 8) AS bm25, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 8), chunk_id) AS rank FROM bm) WHERE rank <= 5""")
def bm25_batch(spark, d):
    docs = table(spark, d, "documents")
    found = bm25.best_of_texts(docs, bm25.asked_by(table(spark, d, "benchmark"), "item_id", "text"), 5, "doc_id", digits=8)
    return found.withColumn("bm25", F.round("bm25", 8))


def _vector(spark, d, vec_id):
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


_DISTANCE = "list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query(f"""SELECT vec_id, round(dist, 9) AS distance, CAST(row_number() OVER (ORDER BY dist, vec_id) AS INT) AS rank, round(greatest(0, least(1, 1 - dist * dist / 2)), 9) AS score
FROM (SELECT e.vec_id, {_DISTANCE} AS dist FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q) ORDER BY dist, vec_id LIMIT 20""")
def knn_topk(spark, d):
    found = knn.search(table(spark, d, "embeddings"), _vector(spark, d, 7), 20, "vec_id")
    return found.select("vec_id", F.round("distance", 9).alias("distance"), "rank", F.round("score", 9).alias("score"))


@query(f"SELECT e.label, count(*) AS n, round(max(greatest(0, least(1, 1 - power({_DISTANCE}, 2) / 2))), 8) AS best, round(avg(greatest(0, least(1, 1 - power({_DISTANCE}, 2) / 2))), 8) AS mean FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q GROUP BY e.label")
def knn_similarity(spark, d):
    from tessera.functions.vectors import l2_distance, literal

    score = similarity(l2_distance(F.col("embedding"), literal(_vector(spark, d, 3))))
    return table(spark, d, "embeddings").select("label", score.alias("s")).groupBy("label").agg(F.count("*").alias("n"), F.round(F.max("s"), 8).alias("best"), F.round(F.avg("s"), 8).alias("mean"))


@query(f"""SELECT query_id, vec_id, round(dist, 9) AS distance, CAST(rank AS INT) AS rank, round(greatest(0, least(1, 1 - dist * dist / 2)), 9) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {_DISTANCE} AS dist FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= 10""")
def knn_batch(spark, d):
    vectors = table(spark, d, "embeddings")
    asked = [(r[0], r[1]) for r in vectors.where("vec_id % 50 = 0").select("vec_id", "embedding").orderBy("vec_id").collect()]
    found = knn.batch_search(vectors, asked, 10, "vec_id")
    return found.select("query_id", "vec_id", F.round("distance", 9).alias("distance"), "rank", F.round("score", 9).alias("score"))


def chunk_table(spark, d) -> DataFrame:
    """All documents as chunks, with their vectors where they have one."""
    return corpus(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left")


def hybrid(spark, d, pool: int = 75) -> DataFrame:
    """Fused candidates of one query over all documents."""
    chunks = chunk_table(spark, d)
    v = knn.search(chunks, _vector(spark, d, 5), pool)
    w = bm25.search_texts(chunks, QUERY, pool)
    return fusion.fuse(v, w).join(chunks.drop("embedding"), "chunk_id")


def _hybrid_sql(pool: int = 75) -> str:
    return f"""{_CORPUS}, {_bm25(_TOKENS)},
v AS (SELECT e.vec_id AS chunk_id, {_DISTANCE} AS dist FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 5) q WHERE e.vec_id IN (SELECT doc_id FROM documents)),
vr AS (SELECT chunk_id, dist, row_number() OVER (ORDER BY dist, chunk_id) AS vec_rank FROM v QUALIFY vec_rank <= {pool}),
kr AS (SELECT chunk_id, row_number() OVER (ORDER BY round(bm25, 9), chunk_id) AS kw_rank FROM bm QUALIFY kw_rank <= {pool}),
fused AS (
  SELECT chunk_id, CAST(vec_rank AS INT) AS vec_rank, CAST(kw_rank AS INT) AS kw_rank, coalesce(dist, 0.0::DOUBLE) AS distance,
         coalesce(1.0::DOUBLE / (60 + vec_rank), 0) + coalesce(1.0::DOUBLE / (60 + kw_rank), 0) AS rrf
  FROM vr FULL OUTER JOIN kr USING (chunk_id)),
rows AS (SELECT * FROM fused JOIN corpus USING (chunk_id))"""


@query(f"WITH {_hybrid_sql()} SELECT chunk_id, vec_rank, kw_rank, round(distance, 9) AS distance, round(rrf, 9) AS rrf, CAST(row_number() OVER (ORDER BY rrf DESC, vec_rank NULLS LAST, kw_rank NULLS LAST) AS INT) AS pos FROM rows")
def rrf_fusion(spark, d):
    order = Window.orderBy(*fusion.rrf_order())
    return hybrid(spark, d).select("chunk_id", "vec_rank", "kw_rank", F.round("distance", 9).alias("distance"), F.round("rrf", 9).alias("rrf"), F.row_number().over(order).alias("pos"))


@query(f"""WITH {_hybrid_sql()} SELECT chunk_id, display_name, source_file, page, round(rrf, 9) AS rrf FROM rows
WHERE (regexp_matches(display_name, '^note_[0-9]*[.]md$') OR regexp_matches(source_file, '/note_[0-9]*[.]md$')) AND contains(source_file, 'src') AND page >= 0 AND page <= 6
  AND greatest(0, least(1, 1 - distance * distance / 2)) >= 0.05""")
def hybrid_filtered(spark, d):
    keep = fusion.SearchFilter(file_glob="note_*.md", subdirectory="src", page_min=0, page_max=6, min_similarity=0.05)
    return keep.apply(hybrid(spark, d)).select("chunk_id", "display_name", "source_file", "page", F.round("rrf", 9).alias("rrf"))


@query(f"WITH {_hybrid_sql(20)} SELECT chunk_id, kw_rank, 1.0::DOUBLE AS vector_similarity FROM rows WHERE vec_rank IS NULL")
def kw_only_similarity_one(spark, d):
    rows = fusion.SearchFilter(min_similarity=0.999999).apply(hybrid(spark, d, 20)).where("vec_rank is null")
    return rows.select("chunk_id", "kw_rank", similarity(F.col("distance")).alias("vector_similarity"))


@query(f"WITH {_CORPUS} SELECT chunk_id, display_name FROM corpus WHERE regexp_matches(display_name, '^note_[12][^5].*[.]t.t$')")
def glob_filter(spark, d):
    return fusion.SearchFilter(file_glob="note_[12][!5]*.t?t").apply(corpus(spark, d)).select("chunk_id", "display_name")


@query(f"WITH {_CORPUS} SELECT chunk_id, source_file FROM corpus WHERE contains(source_file, 'src1')")
def subdir_filter(spark, d):
    return fusion.SearchFilter(subdirectory="src1").apply(corpus(spark, d)).select("chunk_id", "source_file")


@query(f"WITH {_CORPUS} SELECT page, count(*) AS n FROM corpus WHERE page >= 2 AND page <= 7 GROUP BY page")
def page_range_filter(spark, d):
    return fusion.SearchFilter(page_min=2, page_max=7).apply(corpus(spark, d)).groupBy("page").agg(F.count("*").alias("n"))


def listing(spark, d, *more: str) -> DataFrame:
    """Documents as files, with the hash of their text, and more of their columns."""
    return table(spark, d, "documents").select(F.concat(F.lit("/corpus/"), "source", F.lit("/d"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".txt")).alias("path"), F.sha1("text").alias("sha1"), F.octet_length("text").cast("long").alias("size"), "doc_id", *more)


def tracked(spark, d) -> DataFrame:
    """What an index knew of them: three of four files, some with other content."""
    return listing(spark, d).where("doc_id % 4 > 0").select("path", F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("old"), "sha1")).otherwise(F.col("sha1")).alias("sha1"))


_FILES = """listing AS (SELECT '/corpus/' || source || '/d' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.txt' AS path, sha1(text) AS sha1, CAST(strlen(text) AS BIGINT) AS size, doc_id FROM documents),
tracked AS (SELECT path, CASE WHEN doc_id % 10 = 3 THEN 'old' || sha1 ELSE sha1 END AS sha1 FROM listing WHERE doc_id % 4 > 0)"""
_CLASSIFIED = """own AS (
  SELECT t.sha1, bool_or(l.sha1 IS NULL OR l.sha1 = t.sha1) AS stays, max(string_split(t.path, '/')) FILTER (l.sha1 <> t.sha1) AS last FROM tracked t LEFT JOIN listing l USING (path) GROUP BY t.sha1),
held AS (
  SELECT l.path, l.sha1, t.sha1 AS old, string_split(l.path, '/') AS place, t.sha1 IS NULL AND coalesce(o.stays OR o.last > string_split(l.path, '/'), false) AS held
  FROM listing l LEFT JOIN tracked t USING (path) LEFT JOIN own o ON l.sha1 = o.sha1),
firsts AS (SELECT sha1, min(place) AS first FROM held WHERE (old IS NULL AND NOT held) OR old <> sha1 GROUP BY sha1),
action AS (
  SELECT path, h.sha1, CASE WHEN old = h.sha1 THEN 'unchanged' WHEN old IS NOT NULL THEN 'update' WHEN held OR place > first THEN 'duplicate' ELSE 'new' END AS action
  FROM held h LEFT JOIN firsts f ON h.sha1 = f.sha1)"""


@query(f"WITH {_FILES} SELECT path, sha1, doc_id FROM listing QUALIFY row_number() OVER (PARTITION BY sha1 ORDER BY string_split(path, '/')) = 1")
def content_dedup(spark, d):
    return files.content_dedup(listing(spark, d)).select("path", "sha1", "doc_id")


@query(f"WITH {_FILES}, {_CLASSIFIED} SELECT path, sha1, action FROM action")
def classify_files(spark, d):
    return files.classify(listing(spark, d), tracked(spark, d)).select("path", "sha1", "action")


@query(f"""WITH {_FILES}, now AS (SELECT * FROM listing WHERE doc_id % 7 > 0)
SELECT coalesce(n.path, t.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN t.path IS NULL THEN 'added' WHEN n.sha1 = t.sha1 THEN 'unchanged' ELSE 'changed' END AS change
FROM now n FULL OUTER JOIN tracked t USING (path)""")
def reindex_diff(spark, d):
    return files.changes(listing(spark, d).where("doc_id % 7 > 0"), tracked(spark, d))


@query(f"WITH {_FILES} SELECT path FROM listing WHERE starts_with(path, '/corpus/src1/') OR starts_with(path, '/corpus/src4/')")
def under_sources(spark, d):
    return files.under_sources(listing(spark, d), ["/corpus/src1", "/corpus/src4/"]).select("path")


@query("""WITH f AS (SELECT '/corpus/' || source || '/' || doc_id || '/r' || (doc_id % 11) || '.txt' AS path FROM documents),
n AS (SELECT path, regexp_extract(path, '[^/]*$') AS name, row_number() OVER (PARTITION BY regexp_extract(path, '[^/]*$') ORDER BY string_split(path, '/')) AS n FROM f)
SELECT path, CASE WHEN n = 1 THEN name ELSE replace(name, '.txt', '') || '_' || n || '.txt' END AS display_name FROM n""")
def name_collisions(spark, d):
    rows = table(spark, d, "documents").select(F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/r"), (F.col("doc_id") % 11).cast("string"), F.lit(".txt")).alias("path"))
    return files.first_level_names(rows)


@query(r"""WITH RECURSIVE f AS (
  SELECT path, name, family, row_number() OVER (PARTITION BY family ORDER BY string_split(path, '/')) AS n
  FROM (SELECT path, regexp_extract(path, '[^/]*$') AS name, regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '[.]txt$', ''), '(_[0-9]+)+$', '') AS family
        FROM (SELECT '/corpus/' || source || '/' || doc_id || '/r' || (doc_id % 97) || CASE doc_id % 7 WHEN 3 THEN '_2' WHEN 4 THEN '_2_2' WHEN 5 THEN '_3' ELSE '' END || '.txt' AS path FROM documents))),
step AS (
  SELECT family, n, path, name AS got, [name] AS used FROM f WHERE n = 1
  UNION ALL
  SELECT s.family, f.n, f.path, x.got, list_append(s.used, x.got) FROM step s JOIN f ON f.family = s.family AND f.n = s.n + 1,
    LATERAL (SELECT CASE WHEN NOT list_contains(s.used, f.name) THEN f.name ELSE
      list_filter(list_transform(range(2, len(s.used) + 3), lambda k: replace(f.name, '.txt', '') || '_' || k || '.txt'), lambda c: NOT list_contains(s.used, c))[1] END AS got) x)
SELECT path, got AS display_name FROM step""")
def name_families(spark, d):
    """Files of which some are named as others would be renamed."""
    n, end = F.col("doc_id"), F.when(F.col("doc_id") % 7 == 3, "_2").when(F.col("doc_id") % 7 == 4, "_2_2").when(F.col("doc_id") % 7 == 5, "_3").otherwise("")
    return files.display_names(table(spark, d, "documents").select(F.concat(F.lit("/corpus/"), "source", F.lit("/"), n.cast("string"), F.lit("/r"), (n % 97).cast("string"), end, F.lit(".txt")).alias("path")))


@query(r"""SELECT doc_id, CAST(w AS INT) AS window_no, array_to_string(list_slice(t, s + 1, s + 384), ' ') AS text
FROM (SELECT doc_id, t, unnest(range(0, len(t), 288)) AS s, unnest(range(len(range(0, len(t), 288)))) AS w FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS t FROM documents))""")
def hard_split_windows(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.hard_windows(T.word_tokens(F.col("text")), 384, 288)).alias("window_no", "text"))


@query(rf"""WITH RECURSIVE {_SENTENCES},
doc AS (SELECT doc_id, list(s ORDER BY sent_no) AS ss, list(CAST(len(regexp_extract_all(s, '\S+')) AS BIGINT) ORDER BY sent_no) AS ns FROM sent GROUP BY doc_id),
step AS (
  SELECT doc_id, 0::BIGINT AS i, []::BIGINT[] AS buf, 0::BIGINT AS cnt, []::BIGINT[] AS out, false AS wide FROM doc
  UNION ALL
  SELECT doc_id, i + 1,
    CASE WHEN n > 384 THEN tail WHEN cnt + n <= 384 THEN list_append(buf, i + 1) WHEN tc + n <= 384 THEN list_append(tail, i + 1) ELSE [i + 1] END,
    CASE WHEN n > 384 THEN tc WHEN cnt + n <= 384 THEN cnt + n WHEN tc + n <= 384 THEN tc + n ELSE n END,
    CASE WHEN n > 384 OR cnt + n > 384 THEN buf ELSE []::BIGINT[] END,
    n > 384
  FROM (SELECT *, coalesce(list_sum(list_transform(tail, lambda x: ns[x])), 0)::BIGINT AS tc FROM (
    SELECT s.doc_id, s.i, s.buf, s.cnt, d.ns, d.ns[s.i + 1] AS n,
      list_slice(s.buf, len(s.buf) - list_max(list_filter(range(0, len(s.buf) + 1), lambda k: coalesce(list_sum(list_transform(list_slice(s.buf, len(s.buf) - k + 1, len(s.buf)), lambda x: d.ns[x])), 0) <= 96)) + 1, len(s.buf)) AS tail
    FROM step s JOIN doc d USING (doc_id) WHERE s.i < len(d.ns)))),
emitted AS (
  SELECT doc_id, i, 0 AS kind, 0::BIGINT AS w, array_to_string(list_transform(out, lambda x: ss[x]), ' ') AS text FROM step JOIN doc USING (doc_id) WHERE len(out) > 0
  UNION ALL
  SELECT doc_id, i, 1, w, array_to_string(list_slice(t, w + 1, w + 384), ' ') FROM (SELECT doc_id, i, t, unnest(range(0, len(t), 288)) AS w FROM (SELECT doc_id, i, regexp_extract_all(ss[i], '\S+') AS t FROM step JOIN doc USING (doc_id) WHERE wide))
  UNION ALL
  SELECT doc_id, i + 1, 2, 0, array_to_string(list_transform(buf, lambda x: ss[x]), ' ') FROM step JOIN doc USING (doc_id) WHERE i = len(ns) AND len(buf) > 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, kind, w) - 1 AS INT) AS chunk_index, text FROM emitted""")
def greedy_chunks(spark, d):
    blocks = table(spark, d, "documents").withColumn("block_no", F.lit(0))
    chunks = chunker.number_chunks(chunker.chunk_blocks(blocks, ["doc_id", "block_no"]), "doc_id", "block_no")
    return chunks.select("doc_id", "chunk_index", "text")


_ETA = """p AS (
  SELECT user_id, event_id, CAST(sum(event_id % 40 + 1) OVER w AS BIGINT) AS done,
    greatest(0, 2000 - sum(event_id % 40 + 1) OVER w)::DOUBLE / greatest(avg((event_id % 40 + 1)::DOUBLE / (event_id % 17 + 1)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 1.0::DOUBLE) AS eta
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


@query(f"WITH {_ETA} SELECT user_id, event_id, done, round(eta, 6) AS eta FROM p")
def eta_moving_avg(spark, d):
    """Events as finished files of a job (user)."""
    n = F.col("event_id")
    rows = table(spark, d, "events").select("user_id", "event_id", (n % 40 + 1).alias("made"), (n % 17 + 1).alias("seconds"), F.lit(2000).alias("total"))
    return with_rates(rows, "user_id", "event_id").select("user_id", "event_id", F.col("done_so_far").alias("done"), F.round("eta", 6).alias("eta"))


@query("""WITH s AS (SELECT event_id, CASE WHEN event_id % 101 = 0 THEN -1.0::DOUBLE ELSE (event_id * 7 % 20011) + 0.5::DOUBLE END AS x FROM events)
SELECT event_id, CASE WHEN x < 0 THEN '?' WHEN x < 60 THEN CAST(floor(x) AS BIGINT) || 's' WHEN x < 3600 THEN CAST(floor(x) AS BIGINT) // 60 || 'm ' || CAST(floor(x) AS BIGINT) % 60 || 's'
  ELSE CAST(floor(x) AS BIGINT) // 3600 || 'h ' || CAST(floor(x) AS BIGINT) % 3600 // 60 || 'm' END AS eta FROM s""")
def format_eta(spark, d):
    x = F.when(F.col("event_id") % 101 == 0, F.lit(-1.0)).otherwise(F.col("event_id") * 7 % 20011 + F.lit(0.5))
    return table(spark, d, "events").select("event_id", T.format_eta(x).alias("eta"))


@query(f"""WITH {_FILES}, {_CLASSIFIED}
SELECT count(*) FILTER (action IN ('new', 'update')) AS indexed, count(*) FILTER (action = 'duplicate') AS skipped, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action IN ('new', 'update') AND n > 1) AS renamed, count(*) FILTER (action = 'unchanged') AS unchanged
FROM (SELECT path, action, row_number() OVER (PARTITION BY CAST(regexp_extract(path, '([0-9]+)[.]txt$', 1) AS BIGINT) % 97 ORDER BY string_split(path, '/')) AS n FROM action)""")
def index_counters(spark, d):
    """Files of the same name modulo 97 are renamed but for the first."""
    found = files.classify(listing(spark, d), tracked(spark, d))
    named = found.withColumn("path", F.concat("path", F.lit("/f"), (F.col("doc_id") % 97).cast("string")))
    return files.counters(named.join(files.first_level_names(named), "path"))


@query(f"WITH {_FILES} SELECT regexp_extract(path, '^/corpus/([^/]*)/', 1) AS project, count(*) AS doc_count, CAST(sum(greatest(1, size // 3072)) AS BIGINT) AS chunk_count FROM listing GROUP BY ALL")
def project_stats(spark, d):
    rows = listing(spark, d).select("path", F.regexp_extract("path", "^/corpus/([^/]*)/", 1).alias("project"), T.estimated_chunks(F.col("size")).alias("chunk_count"))
    return files.file_counts(rows, "project")


@query(f"WITH {_FILES} SELECT regexp_extract(path, '^/corpus/([^/]*)/', 1) AS source, greatest(1, CAST(sum(size) AS BIGINT) // 3072) AS chunks FROM listing GROUP BY ALL")
def estimate_chunks(spark, d):
    return listing(spark, d).groupBy(F.regexp_extract("path", "^/corpus/([^/]*)/", 1).alias("source")).agg(T.estimated_chunks(F.sum("size")).alias("chunks"))


@query(r"""SELECT DISTINCT text AS name, coalesce(nullif(trim(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[^A-Za-z0-9_-]', '_', 'g'), '_'), ''), 'project') AS project FROM documents""")
def sanitize_names(spark, d):
    return table(spark, d, "documents").select(F.col("text").alias("name")).distinct().withColumn("project", T.project_name(F.col("name")))


@query(r"""WITH p AS (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '/a.PDF' WHEN 1 THEN '/.md' WHEN 2 THEN '/x.tar.gz' ELSE '\b.Txt' END AS path FROM pages), n AS (SELECT page_id, path, regexp_extract(path, '[^/\\]*$') AS name FROM p)
SELECT page_id, name, lower(regexp_extract(name, '^.+(\.[^.]+)$', 1)) AS suffix, CASE WHEN regexp_extract(name, '^.+(\.[^.]+)$', 1) = '' THEN name ELSE regexp_extract(name, '^(.+)\.[^.]+$', 1) END AS stem FROM n""")
def basename_suffix(spark, d):
    end = F.when(F.col("page_id") % 4 == 0, "/a.PDF").when(F.col("page_id") % 4 == 1, "/.md").when(F.col("page_id") % 4 == 2, "/x.tar.gz").otherwise("\\b.Txt")
    name = T.basename(F.concat("url", end))
    return table(spark, d, "pages").select("page_id", name.alias("name"), T.suffix(name).alias("suffix"), T.stem(name).alias("stem"))


@query(r"""SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS recognised FROM conversations WHERE coalesce(TRY_CAST(CASE WHEN turn % 5 = 4 THEN 'n/a' ELSE CAST((conv_id + turn) % 10 / 10.0 AS VARCHAR) END AS DOUBLE), 0) >= 0.5 AND text <> '' GROUP BY conv_id""")
def ocr_line_filter(spark, d):
    conf = F.when(F.col("turn") % 5 == 4, "n/a").otherwise((((F.col("conv_id") + F.col("turn")) % 10) / 10.0).cast("string"))
    lines = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", conf.alias("conf")))).alias("lines"))
    return lines.select("conv_id", T.recognised_lines(F.col("lines")).alias("recognised")).where("recognised <> ''")


@query("SELECT page_id, len(regexp_extract_all(html, '[A-Za-z]')) AS letters, len(regexp_extract_all(html, '[A-Za-z]')) < 50 AS needs_ocr FROM pages")
def page_letters(spark, d):
    n = T.letter_count(F.col("html"))
    return table(spark, d, "pages").select("page_id", n.cast("long").alias("letters"), (n < 50).alias("needs_ocr"))


@query(f"""WITH {_hybrid_sql()},
w AS (SELECT list_distinct(['the', 'tion', 'und', 'of', 'reat', 'e', 'de']) AS want),
r AS (SELECT rows.*, len(list_intersect((SELECT want FROM w), regexp_extract_all(lower(strip_accents(text)), '[\\pL\\pN\\p{{Co}}]+')))::DOUBLE / 7 + 0.1::DOUBLE / (1.0::DOUBLE + len(regexp_extract_all(lower(strip_accents(text)), '[\\pL\\pN\\p{{Co}}]+'))) AS s FROM rows)
SELECT text, source_file, display_name, page, chunk_index, round(s, 4) AS rerank_score, round(greatest(0, least(1, 1 - distance * distance / 2)), 4) AS vector_similarity
FROM r WHERE contains(source_file, 'src') ORDER BY s DESC, rrf DESC, vec_rank NULLS LAST, kw_rank NULLS LAST LIMIT 10""")
def search_end_to_end(spark, d):
    """What Engine.search runs."""
    chunks = chunk_table(spark, d)
    vector = _vector(spark, d, 5)
    return search.hybrid(chunks, lambda: knn.search(chunks, vector, 75), lambda: bm25.search_texts(chunks, QUERY, 75), QUERY, 10, fusion.SearchFilter(subdirectory="src"))


def stored(spark, d, *tables: str) -> Project:
    """Documents in a new project, a chunk each: even ones, then odd ones, then an update of every tenth and the deletion of every seventh."""
    p = Project(spark, shared_folder(spark), f"store-{uuid.uuid4().hex}").create(64)
    rows = listing(spark, d, "text")

    def batch(rows: DataFrame, base: int) -> dict[str, DataFrame]:
        stamp = F.current_timestamp().alias("indexed_at")
        chunks = rows.select((F.col("doc_id") + base).alias("chunk_id"), F.col("path").alias("file_path"), F.col("sha1").alias("file_hash"), T.basename(F.col("path")).alias("display_name"), F.lit(None).cast("int").alias("page"), F.lit(0).alias("chunk_index"), "text", stamp)
        known = rows.select("path", "sha1", F.lit(0.0).alias("mtime"), F.lit(1).alias("chunk_count"), T.basename(F.col("path")).alias("display_name"), (F.col("doc_id") + base).alias("first_chunk"), stamp)
        made = {"chunks": lambda: chunks, "files": lambda: known, "postings": lambda: bm25.postings(chunks), "lengths": lambda: bm25.lengths(chunks)}
        return {name: made[name]() for name in tables}

    p.commit(batch(rows.where("doc_id % 2 = 0"), 0), 0)
    p.commit(batch(rows.where("doc_id % 2 = 1"), 0), 0)
    new = rows.where("doc_id % 10 = 3").withColumn("text", F.concat(F.lit("the new heat "), "text"))
    p.commit({"tombstones": new.select("path")} | batch(new, 1_000_000_000), 0)
    p.commit({"tombstones": rows.where("doc_id % 7 = 0").select("path")}, 0)
    return p


_LIVE = "live AS (SELECT CASE WHEN doc_id % 10 = 3 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 10 = 3 THEN 'the new heat ' ELSE '' END || text AS text, '/corpus/' || source || '/d' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.txt' AS path FROM documents WHERE doc_id % 7 <> 0)"


@query(f"WITH {_LIVE} SELECT doc_id AS chunk_id, path AS file_path, text FROM live")
def store_live_chunks(spark, d):
    """What lives after batches, updates and deletions."""
    return stored(spark, d, "chunks", "files").chunks().select("chunk_id", "file_path", "text")


@query(f"WITH {_LIVE}, {_bm25(['the', 'heat', 'new', 'und', 'the']).replace('FROM documents', 'FROM live')} {_TOP.format(n=75)}")
def store_search(spark, d):
    """What Engine.search asks of stored postings, with counts and bounds kept through updates and deletions."""
    p = stored(spark, d, "chunks", "files", "postings", "lengths")
    m, asked = p.manifest(), "the heat new und the"
    found = bm25.search(*p.index(m), asked, 75, p.facts(m), p.term_bounds(bm25.literal_terms(spark, asked), m))
    return found.select("chunk_id", F.round("bm25", 9).alias("bm25"), "rank")


@query("SELECT user_id, event_id, event_type AS status FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 ORDER BY 1 LIMIT 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def newest_active_jobs(spark, d):
    """Events as jobs of a user; the first two types are the active states."""
    events = table(spark, d, "events")
    active = events.groupBy("event_type").agg(F.lit(1)).orderBy("event_type").limit(2).select("event_type")
    return jobs.newest(events, active, "user_id", "ts", "event_id", "event_type").select("user_id", "event_id", F.col("event_type").alias("status"))


@query("""SELECT page_id, CASE WHEN len(regexp_extract_all(a, '[A-Za-z]')) < 50 AND len(regexp_extract_all(b, '[A-Za-z]')) > len(regexp_extract_all(a, '[A-Za-z]')) THEN b ELSE a END AS text
FROM (SELECT page_id, regexp_replace(html, '^\\s+|\\s+$', '', 'g') AS a, regexp_replace(url, '^\\s+|\\s+$', '', 'g') AS b FROM pages)""")
def page_text_choice(spark, d):
    from tessera.sources.ocr import better_text

    return table(spark, d, "pages").select("page_id", better_text(F.col("html"), F.col("url")).alias("text"))


@query(f"WITH {_FILES} SELECT path, CAST(row_number() OVER (PARTITION BY doc_id % 16 ORDER BY string_split(replace(path, '/d', '/d/'), '/')) AS INT) AS place FROM listing")
def path_order(spark, d):
    rows = listing(spark, d).withColumn("deep", F.replace("path", F.lit("/d"), F.lit("/d/")))
    order = Window.partitionBy(F.col("doc_id") % 16).orderBy(files.path_order("deep"))
    return rows.select("path", F.row_number().over(order).alias("place"))


@query(f"WITH {_FILES} SELECT path FROM listing WHERE doc_id % 2 = 0 UNION SELECT path FROM listing WHERE doc_id % 3 = 0")
def folder_union(spark, d):
    """Every second and every third document: folders that share files."""
    rows = listing(spark, d)
    return files.union([rows.where("doc_id % 2 = 0").select("path"), rows.where("doc_id % 3 = 0").select("path")])


@query(f"""WITH {_FILES} SELECT l.path, t.path IS NOT NULL AS known, l.sha1 IN (SELECT sha1 FROM tracked) AS known_content,
  EXISTS (SELECT 1 FROM listing o WHERE regexp_extract(o.path, '[^/]*$') = regexp_extract(l.path, '[^/]*$') AND o.path <> l.path) AS name_taken
FROM listing l LEFT JOIN tracked t USING (path)""")
def file_lookups(spark, d):
    return files.lookups(listing(spark, d), tracked(spark, d))


@query(f"""WITH {_TERMS},
q AS (SELECT item_id AS query_id, x AS term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\\pL\\pN\\p{{Co}}]+')) AS x FROM benchmark) GROUP BY ALL),
df AS (SELECT term, count(*) AS n FROM post GROUP BY term),
fact AS (SELECT count(*) AS total, sum(dl) / count(*) AS mean FROM len),
bm AS (
  SELECT q.query_id, p.chunk_id, sum(-q.times * CASE WHEN ln((f.total - d.n + 0.5) / (d.n + 0.5)) <= 0 THEN 1e-6 ELSE ln((f.total - d.n + 0.5) / (d.n + 0.5)) END
    * p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.dl / f.mean))) AS bm25
  FROM post p JOIN q USING (term) JOIN df d USING (term) JOIN len l USING (chunk_id) CROSS JOIN fact f GROUP BY ALL),
kr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9), chunk_id) AS kw_rank FROM bm QUALIFY kw_rank <= 25),
vr AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DISTANCE}, e.vec_id) AS vec_rank FROM embeddings e, embeddings q QUALIFY vec_rank <= 25),
f AS (SELECT query_id, chunk_id, coalesce(1.0::DOUBLE / (60 + vec_rank), 0) + coalesce(1.0::DOUBLE / (60 + kw_rank), 0) AS rrf, vec_rank FROM vr FULL OUTER JOIN kr USING (query_id, chunk_id))
SELECT query_id, chunk_id, round(rrf, 9) AS rrf, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, vec_rank NULLS LAST, chunk_id) AS INT) AS rank FROM f QUALIFY rank <= 5""")
def hybrid_batch(spark, d):
    """All vectors and all items are asked; vectors and items of one number are one query."""
    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings")
    asked = [(r[0], np.array(r[1], np.float64)) for r in vectors.select("vec_id", "embedding").orderBy("vec_id").toLocalIterator()]
    v = knn.batch_search(vectors.withColumnRenamed("vec_id", "chunk_id"), asked, 25)
    w = bm25.best_of_texts(docs, bm25.asked_by(table(spark, d, "benchmark"), "item_id", "text"), 25, "doc_id")
    return fusion.fuse_many(v, w, 5).select("query_id", "chunk_id", F.round("rrf", 9).alias("rrf"), "rank")


def odd_vectors(spark, d) -> DataFrame:
    """Embeddings of which every fifth is null, every seventh is cut short and every eleventh holds a null."""
    v, n = F.col("embedding"), F.col("vec_id")
    return table(spark, d, "embeddings").select("vec_id", F.when(n % 5 == 1, F.lit(None)).when(n % 7 == 2, F.slice(v, 1, 60)).when(n % 11 == 3, F.transform(v, lambda x, i: F.when(i != 9, x))).otherwise(v).alias("embedding"))


_NEAREST = f"""SELECT vec_id, round(dist, 9) AS distance, CAST(row_number() OVER (ORDER BY dist, vec_id) AS INT) AS rank, round(greatest(0, least(1, 1 - dist * dist / 2)), 9) AS score
FROM (SELECT e.vec_id, {_DISTANCE} AS dist FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 11) q) ORDER BY dist, vec_id LIMIT 20"""


@query(_NEAREST)
def knn_groups(spark, d):
    """Groups that the triangle inequality rules out aren't read."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    found = knn.centres(vectors, each=50)
    grouped = vectors.withColumn("g", knn.group_of(F.col("embedding"), found)).select("vec_id", "embedding", "g.grp", "g.far")
    near, _ = knn.near(grouped, knn.Groups.of(grouped, found), _vector(spark, d, 11), 20, "vec_id", always=True)
    return near.select("vec_id", F.round("distance", 9).alias("distance"), "rank", F.round("score", 9).alias("score"))


@query(f"""WITH e AS (SELECT * FROM embeddings WHERE vec_id % 5 <> 1 AND vec_id % 7 <> 2 AND vec_id % 11 <> 3)
SELECT vec_id, round(dist, 9) AS distance, CAST(row_number() OVER (ORDER BY dist, vec_id) AS INT) AS rank, round(greatest(0, least(1, 1 - dist * dist / 2)), 9) AS score
FROM (SELECT e.vec_id, {_DISTANCE} AS dist FROM e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q) ORDER BY dist, vec_id LIMIT 20""")
def knn_odd_vectors(spark, d):
    found = knn.search(odd_vectors(spark, d), _vector(spark, d, 7), 20, "vec_id")
    return found.select("vec_id", F.round("distance", 9).alias("distance"), "rank", F.round("score", 9).alias("score"))


@query(f"""WITH e AS (SELECT * FROM embeddings WHERE vec_id % 5 <> 1 AND vec_id % 7 <> 2 AND vec_id % 11 <> 3)
SELECT query_id, vec_id, round(dist, 9) AS distance, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {_DISTANCE} AS dist FROM e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= 10""")
def knn_batch_odd_vectors(spark, d):
    """The stated queries, every hundredth vector, against all that have a distance."""
    asked = [(r[0], r[1]) for r in table(spark, d, "embeddings").where("vec_id % 100 = 0").select("vec_id", "embedding").orderBy("vec_id").collect()]
    return knn.batch_search(odd_vectors(spark, d), asked, 10, "vec_id").select("query_id", "vec_id", F.round("distance", 9).alias("distance"), "rank")
