import json
import logging
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import answer_sheet, queries, refresh_store
from jobs.common import settings
from tessera.operators import chunker
from tests.oracle import compare, connection

ROOT = Path(__file__).resolve().parents[2]
KIND = "doc_id long, text string, source string, lang string, n_chars long, batch int, sha1 string"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, data, name):
    assert compare(queries.QUERIES[name](spark, data), connection(data), queries.SQL[name]) > 0


def add(spark, folder, rows):
    """Files more in a table, with columns that the jobs use themselves."""
    spark.createDataFrame([(i, t, s, "en", 0, 7, "x") for i, t, s in rows], KIND).coalesce(1).write.mode("append").parquet(folder)


def expected(versions):
    """The store's current chunks, from (doc_id, text, source) of each document's newest version."""
    owners, out = {}, []
    for i, t, s in sorted(versions.values()):
        if t is not None:
            owners.setdefault(t, []).append((i, s))
    for t, who in owners.items():
        for k, c in enumerate(chunker.pack(chunker.split_sentences(t), None, 12, 4)):
            out.append((*who[0], len(who), k, len(c.split()), c))
    return sorted(out, key=repr)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "source", "copies", "chunk_index", "n_tokens", "text").collect()], key=repr)


CONFIG = {"chunk_tokens": 12, "overlap_tokens": 4}
LONG = " ".join(f"Sentence {k} has some words." for k in range(40))
FIRST = [(1, "A b. C d.", "s1"), (2, "A b. C d.", "s2"), (3, None, "s1"), (4, "", "s1"), (5, LONG, None), (None, "nobody", "s1"), (6, "word " * 30, "s1"), (7, " \n ", "s1")]
SECOND = [(8, LONG, "s3"), (1, "New words.", "s1"), (9, "Only nine.", "s1"), (9, "Only nine.", "s0")]
THIRD = [(5, None, None), (10, "A b. C d.", "s9"), (2, "Other.", "s2")]


@pytest.mark.parametrize("per_batch", [None, 1])
def test_store_over_growing_input(spark, tmp_path, caplog, per_batch):
    docs, store, mark = (str(tmp_path / n) for n in ("documents.parquet", "store", "mark"))
    config = CONFIG | {"files_per_batch": per_batch}
    newest, chunks = {}, []
    caplog.set_level(logging.INFO, "jobs")
    for rows in (FIRST, SECOND, THIRD):
        add(spark, docs, rows)
        out = refresh_store.refresh(spark, docs, store, mark, config)
        assert f"read {len(rows)} rows" in caplog.messages[-1]  # only what is new
        for r in sorted(rows, key=lambda r: (r[1] or "", r[2] or ""), reverse=True):
            if r[0] is not None:
                newest[r[0]] = r
        assert got(out) == expected(newest)
        chunks.append(spark.read.parquet(f"{store}/chunks").count())
    again = refresh_store.refresh(spark, docs, store, mark, config)
    assert got(again) == expected(newest) and spark.read.parquet(f"{store}/chunks").count() == chunks[-1]
    assert "read 0 rows" in caplog.messages[-1] and "in 0 batches" in caplog.messages[-1]
    # a content is chunked once, whoever brings it
    each = spark.read.parquet(f"{store}/chunks").groupBy("sha1", "chunk_index").count()
    assert each.where("count > 1").count() == 0


def test_a_batch_that_is_taken_again_replaces_itself(spark, tmp_path):
    docs, store, mark = (str(tmp_path / n) for n in ("documents.parquet", "store", "mark"))
    add(spark, docs, FIRST)
    want = got(refresh_store.refresh(spark, docs, store, mark, CONFIG))
    for _ in range(2):  # as after a crash between the writes and the stream's commit
        refresh_store.take(spark.read.parquet(docs), 0, store, refresh_store.DEFAULTS | CONFIG)
        assert got(refresh_store.current(spark, store)) == want


def test_empty_tables(spark, tmp_path):
    docs, items = str(tmp_path / "documents.parquet"), str(tmp_path / "benchmark.parquet")
    spark.createDataFrame([], KIND).write.parquet(docs)
    spark.createDataFrame([(1, "a b"), (2, None), (3, "?!")], "item_id int, text string").write.parquet(items)
    assert refresh_store.refresh(spark, docs, str(tmp_path / "s"), str(tmp_path / "m")).count() == 0
    out = answer_sheet.answer(spark, items, docs, str(tmp_path / "sheet"))
    assert sorted((r["question_id"], r["rank"], r["doc_id"], r["asked_terms"]) for r in out.collect()) == [(1, None, None, 2), (2, None, None, 0), (3, None, None, 0)]


def test_sheet_of_odd_rows(spark, tmp_path):
    docs, items, sheet = (str(tmp_path / n) for n in ("documents.parquet", "benchmark.parquet", "sheet"))
    add(spark, docs, FIRST + [(11, "Réd green red_blue", None), (12, "red blue", "s1"), (12, "red blue", "s0")])
    spark.createDataFrame([(1, "RED", 0), (1, "green", 1), (None, "red", 2), (2, "red_blue", 3), (-3, "unknown", 4)], "item_id int, text string, rank int").write.parquet(items)
    for _ in range(2):
        out = answer_sheet.answer(spark, items, docs, sheet, {"k": 2, "shards": 4})
        rows = sorted(((r["question_id"], r["rank"], r["doc_id"], r["source"], r["known_terms"], r["asked_terms"], r["shard"]) for r in out.collect()), key=repr)
        assert rows == sorted([(1, 1, 11, None, 2, 2, 1), (1, 2, 12, "s0", 1, 2, 1), (2, 1, 12, "s0", 2, 2, 2), (2, 2, 12, "s0", 2, 2, 2), (-3, None, None, None, None, 1, 1)], key=repr)


def test_settings(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"k": 3}))
    assert settings(spark, str(path), answer_sheet.DEFAULTS) == {"k": 3, "shards": 8} and settings(spark, None, {"a": 1}) == {"a": 1}
    path.write_text(json.dumps({"q": 3}))
    with pytest.raises(ValueError, match="unknown settings q"):
        settings(spark, str(path), answer_sheet.DEFAULTS)
    for name in ("refresh_store", "answer_sheet"):
        settings(spark, str(ROOT / f"jobs/{name}.json"), {"refresh_store": refresh_store, "answer_sheet": answer_sheet}[name].DEFAULTS)


def test_command_lines(tmp_path, data):
    run = lambda *a: subprocess.run([sys.executable, *a], capture_output=True, text=True, timeout=300, cwd=tmp_path)
    done = run(str(ROOT / "jobs/refresh_store.py"), f"{data}/documents.parquet", str(tmp_path / "store"), str(tmp_path / "mark"), "--config", str(ROOT / "jobs/refresh_store.json"))
    assert done.returncode == 0, done.stderr[-2000:]
    assert "new contents" in done.stderr and list((tmp_path / "store/chunks").glob("batch=0/source=*"))
    done = run(str(ROOT / "jobs/answer_sheet.py"), f"{data}/benchmark.parquet", f"{data}/documents.parquet", str(tmp_path / "sheet"))
    assert done.returncode == 0 and list((tmp_path / "sheet").glob("shard=*")), done.stderr[-2000:]
