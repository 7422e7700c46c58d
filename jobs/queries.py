"""The jobs as registered queries: run twice over the whole tables into one new folder; the output as it stands then."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import answer_sheet, refresh_store
from tessera.plans.queries import SQL as LIBRARY
from tessera.plans.queries import _TERMS
from tessera.session import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_refresh_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "job1")
    for _ in range(2):
        out = refresh_store.refresh(spark, f"{sf_dir}/documents.parquet", f"{at}/store", f"{at}/checkpoint")
    return out


def job2_answer_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "job2")
    for _ in range(2):
        out = answer_sheet.answer(spark, f"{sf_dir}/benchmark.parquet", f"{sf_dir}/documents.parquet", f"{at}/sheet")
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_refresh_store, job2_answer_sheet)}

SQL = {
    "job1_refresh_store": rf"""WITH g AS ({LIBRARY["greedy_chunks"]}),
owner AS (SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY sha1(text))
SELECT doc_id, source, copies, chunk_index, CAST(len(regexp_extract_all(text, '\S+')) AS INT) AS n_tokens, text FROM g JOIN owner USING (doc_id)""",
    "job2_answer_sheet": rf"""WITH {_TERMS},
asked AS (SELECT item_id, regexp_extract_all(lower(strip_accents(text)), '[\pL\pN\p{{Co}}]+') AS x FROM benchmark),
q AS (SELECT item_id, x AS term, count(*) AS times FROM (SELECT item_id, unnest(x) AS x FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS n FROM post GROUP BY term),
fact AS (SELECT count(*) AS total, sum(dl) / count(*) AS mean FROM len),
bm AS (
  SELECT q.item_id, p.chunk_id, sum(-q.times * CASE WHEN ln((f.total - d.n + 0.5) / (d.n + 0.5)) <= 0 THEN 1e-6 ELSE ln((f.total - d.n + 0.5) / (d.n + 0.5)) END
    * p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.dl / f.mean))) AS bm25
  FROM post p JOIN q USING (term) JOIN df d USING (term) JOIN len l USING (chunk_id) CROSS JOIN fact f GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 9), chunk_id) AS rank FROM bm QUALIFY rank <= 10)
SELECT a.item_id AS question_id, CAST(b.rank AS INT) AS rank, b.chunk_id AS doc_id, d.source, d.lang, round(b.bm25, 8) AS bm25,
  CASE WHEN b.chunk_id IS NOT NULL THEN CAST(len(list_intersect(list_distinct(a.x), regexp_extract_all(lower(strip_accents(d.text)), '[\pL\pN\p{{Co}}]+'))) AS INT) END AS known_terms,
  CAST(len(list_distinct(a.x)) AS INT) AS asked_terms, CAST(a.item_id % 8 AS INT) AS shard
FROM asked a LEFT JOIN best b USING (item_id) LEFT JOIN documents d ON b.chunk_id = d.doc_id""",
}
