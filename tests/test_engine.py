import io
import json
import os
import shutil
import threading
import time

import pytest
from pyspark.sql import functions as F

from tessera.cli import serve
from tessera.operators import bm25
from tessera.operators.embed import HashingEmbedder, embed
from tessera.plans.catalog import Project, safe_name
from tessera.plans.engine import Engine
from tessera.plans.indexer import Models
from tessera.plans.jobs import KEPT, Jobs
from tessera.streaming.watch import watch, with_rates


def write(folder, **texts):
    folder.mkdir(exist_ok=True)
    for name, text in texts.items():
        (folder / name.replace("__", ".")).write_text(text)
    return str(folder)


def run(engine, job):
    for _ in range(20):
        state = engine.await_index(job["job_id"], 30)
        if state["status"] not in ("pending", "running"):
            break
    assert state["status"] == "completed", state
    return state["result"]


def test_life_of_a_project(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "home"))
    engine.warm_up()
    a = write(tmp_path / "a", report__txt="Revenue rose in the first quarter. Costs fell.", manual__txt="Press the red button to start the machine.")
    r = run(engine, engine.index_project(a, "docs"))
    assert (r["files_indexed"], r["doc_count"], r["source_paths"]) == (2, 2, [a])
    r = run(engine, engine.index_project(a, "docs"))  # auto: a known folder is reindexed
    assert (r["files_indexed"], r["files_unchanged"]) == (0, 2)
    b = write(tmp_path / "b", report__txt="A report about black holes and stars.", extra__txt="Cookies need butter and sugar.")
    with pytest.raises(ValueError):
        engine.index_project(b, "docs")
    with pytest.raises(ValueError):
        engine.index_project(b, "docs", "fail")
    with pytest.raises(ValueError):
        engine.index_project(b, "docs", "other")
    with pytest.raises(FileNotFoundError):
        engine.index_project(str(tmp_path / "none"))
    r = run(engine, engine.index_project(b, "docs", "append"))
    assert (r["files_indexed"], r["files_renamed"]) == (2, 1)
    p = engine.project("docs")
    assert {f["display_name"] for f in p.files().collect()} == {"report.txt", "manual.txt", "report_2.txt", "extra.txt"}
    c = write(tmp_path / "c", copy__txt="Revenue rose in the first quarter. Costs fell.", unique__md="The buyback was large.")
    r = run(engine, engine.index_project(c, "docs", "append"))
    assert (r["files_indexed"], r["files_skipped_same"]) == (1, 1)
    top = lambda q, **f: [x["display_name"] for x in engine.search("docs", q, **f).collect()]
    assert top("black holes")[0] == "report_2.txt" and top("cookies butter")[0] == "extra.txt" and top("red button")[0] == "manual.txt"
    assert top("buyback", file_glob="*.md") == ["unique.md"] and top("buyback", page_min=1) == []
    assert set(top("report", subdirectory="/b/", prefilter=True)) == {"report_2.txt", "extra.txt"}
    rows = engine.search("docs", "black holes", candidate_pool=1, strict_similarity=True).collect()
    assert rows[0]["vector_similarity"] <= 1.0
    many = engine.search_many("docs", [(1, "black holes"), (2, "red button")], 1).collect()
    names = {r["chunk_id"]: r["display_name"] for r in p.chunks().collect()}
    assert {r["query_id"]: names[r["chunk_id"]] for r in many} == {1: "report_2.txt", 2: "manual.txt"}
    # changed, new and gone files; a folder that is missing keeps its files
    (tmp_path / "a" / "manual.txt").write_text("Press the green button instead.")
    (tmp_path / "a" / "report.txt").unlink()
    write(tmp_path / "a", new__txt="Something new.")
    shutil.rmtree(tmp_path / "b")
    r = run(engine, engine.reindex_project("docs"))
    # the copy of a file that has gone is no copy any more
    assert (r["files_deleted"], r["files_updated"], r["files_indexed"], r["missing_sources"]) == (1, 1, 2, [b])
    assert top("button")[0] == "manual.txt" and "green" in engine.search("docs", "button").first()["text"]
    assert {f["display_name"] for f in p.files().collect()} == {"manual.txt", "report_2.txt", "extra.txt", "unique.md", "new.txt", "copy.txt"}
    ids = [x["chunk_id"] for x in p.chunks().collect()]
    assert len(ids) == len(set(ids))
    before = sorted(map(tuple, p.chunks().select("chunk_id", "text").collect()))
    p.compact()
    assert sorted(map(tuple, p.chunks().select("chunk_id", "text").collect())) == before and top("black holes")[0] == "report_2.txt"
    assert [x["name"] for x in engine.list_projects().collect()] == ["docs"]
    r = run(engine, engine.index_project(c, "docs", "replace"))
    assert (r["files_indexed"], r["source_paths"]) == (2, [c])
    assert engine.delete_project("docs")["deleted"] and not engine.delete_project("docs")["deleted"]
    with pytest.raises(ValueError):
        engine.search("docs", "x")
    assert len(engine.list_jobs()) == 6 and engine.list_jobs(active_only=True) == []
    assert engine.jobs.table(spark).count() == 6 and "error" in engine.index_status("none")


def test_failures_claim_nothing(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "home"))
    folder = tmp_path / "f"
    folder.mkdir()
    (folder / "a.docx").write_bytes(b"broken")
    (folder / "b.txt").write_text("   ")
    (folder / "c.txt").write_text("Some text.")
    (folder / "d.txt").write_text("Some text.")
    (folder / "old.doc").write_text("x")
    (folder / "old.ppt").write_text("x")
    r = run(engine, engine.index_project(str(folder)))
    assert (r["files_indexed"], r["files_skipped_same"], r["files_failed"], r["files_empty"], len(r["legacy_files"])) == (1, 1, 1, 1, 2)


def test_an_uncommitted_batch_is_not_seen(spark, tmp_path):
    p = Project(spark, str(tmp_path), "p").create(4)
    spark.createDataFrame([("x",)], "path string").write.parquet(f"{p.store.root}/tombstones/batch=1")
    assert p.table("tombstones").count() == 0 and p.chunks().count() == 0
    assert safe_name(" a b/") == "a_b" and safe_name("??") == "project"


def test_broken_project_is_listed_with_its_error(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    p = Project(spark, str(tmp_path), "p").create(4)
    p.store.replace("manifest.json", "{")
    row = engine.list_projects().first()
    assert row["name"] == "p" and row["error"]


def test_jobs_end_and_are_forgotten(spark):
    told = []
    jobs = Jobs(lambda t, m: told.append((t, m)))
    bad = jobs.start("index", "p", lambda progress: 1 / 0)
    assert jobs.wait(bad.id)["status"] == "failed" and told[0][0] == "index failed"
    for k in range(KEPT + 5):
        last = jobs.start("index", "p", lambda progress, k=k: progress(k, 9, "m") or {"k": k})
        jobs.wait(last.id)
    assert len(jobs.list()) <= KEPT + 1 and jobs.get(last.id)["result"] == {"k": KEPT + 4}


def test_a_cancelled_job_leaves_the_old_state(spark, tmp_path):
    started = threading.Event()

    class Slow(HashingEmbedder):
        def passages(self, texts):
            (tmp_path / "at_work").touch()
            time.sleep(30 * bool(texts) if (tmp_path / "slow").exists() else 0)
            return super().passages(texts)

    engine = Engine(spark, str(tmp_path / "home"), Models(make_embedder=Slow))
    a = write(tmp_path / "a", one__txt="Alpha beta.")
    run(engine, engine.index_project(a, "docs"))
    (tmp_path / "slow").touch()
    (tmp_path / "at_work").unlink()
    write(tmp_path / "a", two__txt="Gamma delta.")
    job = engine.reindex_project("docs")
    waiting = engine.reindex_project("docs")
    for _ in range(600):
        if (tmp_path / "at_work").exists():
            break
        started.wait(0.1)
    engine.cancel_index(waiting["job_id"])
    engine.cancel_index(job["job_id"])
    began = time.monotonic()
    states = [engine.await_index(j["job_id"], 60)["status"] for j in (job, waiting)]
    assert states == ["cancelled", "cancelled"] and time.monotonic() - began < 25
    assert [f["path"] for f in engine.project("docs").files().collect()] == [f"{a}/one.txt"]
    assert not [n for n in engine.project("docs").store.names() if n.startswith("_stage")]
    (tmp_path / "slow").unlink()
    assert run(engine, engine.reindex_project("docs"))["files_indexed"] == 1
    assert engine.cancel_index(job["job_id"])["status"] == "cancelled" and "error" in engine.cancel_index("none")
    assert engine.delete_project("docs")["deleted"]


def test_blocks_that_cannot_reach_the_best_are_left_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bm25, "BLOCK_CHUNKS", 16)
    monkeypatch.setattr(bm25, "FIRST_BLOCKS", 2)
    engine = Engine(spark, str(tmp_path / "home"))
    folder = tmp_path / "a"
    folder.mkdir()
    for k in range(400):
        (folder / f"{k:03}.txt").write_text("alpha " * (9 if k in (100, 101, 102) else 1) + ("beta " * (k % 3)) + f"filler words here {k} " * (1 if k in (100, 101, 102) else 4))
    run(engine, engine.index_project(str(folder), "docs"))
    p = engine.project("docs")
    for _ in range(2):
        m = p.manifest()
        postings, lengths = p.index(m)
        assert p.facts(m) == bm25.corpus_facts(lengths)
        counted = {r["term"]: r["n"] for r in postings.groupBy("term").agg(F.count("*").alias("n")).collect()}
        for query, n in (("alpha", 3), ("alpha beta", 2), ("beta", 500), ("alpha alpha filler", 3), ("nothing", 3)):
            terms = bm25.literal_terms(spark, query)
            known = p.term_bounds(terms, m)
            used = {}
            for t, _, df, _, _ in known:
                used[t] = used.get(t, 0) + df
            assert {t: c for t, c in used.items() if c} == {t: counted[t] for t in set(terms) if t in counted}
            want = [(r["chunk_id"], round(r["bm25"], 9), r["rank"]) for r in bm25.search(postings, lengths, query, n).orderBy("rank").collect()]
            assert [(r["chunk_id"], round(r["bm25"], 9), r["rank"]) for r in bm25.search(postings, lengths, query, n, p.facts(m), known).orderBy("rank").collect()] == want
        weights = bm25._weights({"alpha": 1}, {"alpha": counted["alpha"]}, p.facts(m)[0])
        read, all_ = bm25.blocks_to_read(postings.where("term = 'alpha'"), [(t, b, tf, dl) for t, b, _, tf, dl in p.term_bounds(["alpha"], m)], weights, p.facts(m)[1] / p.facts(m)[0], 3)
        assert 0 < len(read) < all_ / 2
        # after an update and a deletion counts are of what lives
        (folder / "005.txt").write_text("alpha epsilon")
        (folder / "007.txt").unlink(missing_ok=True)
        run(engine, engine.reindex_project("docs"))
    assert p.manifest().tables["tombstones"]


def test_stream_indexes_new_files(spark, tmp_path):
    folder = write(tmp_path / "in", a__txt="Alpha beta.", b__md="Gamma delta.")
    p = Project(spark, str(tmp_path / "home"), "s")
    watch(spark, folder, p, str(tmp_path / "cp"), files_per_batch=1, once=True).awaitTermination(120)
    assert p.stats()["doc_count"] == 2 and len(p.manifest().batches) == 2
    write(tmp_path / "in", c__txt="Epsilon.")
    watch(spark, folder, p, str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert p.stats()["doc_count"] == 3


def test_rates(spark):
    rows = spark.createDataFrame([("j", k, 10, 2.0, 100) for k in range(12)], "job_id string, seq int, made int, seconds double, total int")
    out = with_rates(rows).orderBy("seq").collect()
    assert out[0]["eta"] == 18.0 and out[11]["done_so_far"] == 120 and out[11]["eta"] == 0.0


def test_command_line(spark, tmp_path, capsys):
    from tessera.cli import main

    folder = write(tmp_path / "in", a__txt="Alpha beta.")
    home = str(tmp_path / "home")
    assert main(["--home", home, "index", "p", folder]) == 0
    assert main(["--home", home, "search", "p", "alpha"]) == 0
    assert '"display_name":"a.txt"' in capsys.readouterr().out
    assert main(["version"]) == 0


def test_serving(spark, tmp_path, monkeypatch, capsys):
    from tessera.cli import main

    folder = write(tmp_path / "in", a__txt="Alpha beta.")
    ask = lambda n, tool, **a: json.dumps({"id": n, "tool": tool, "arguments": a})
    lines = ["", ask(1, "index_project", folder_path=folder, project="p"), "no json", ask(2, "drop_all"), ask(3, "search", project="none", query="x")]
    monkeypatch.setattr("sys.stdin", io.StringIO("\n".join(lines)))
    assert main(["--home", str(tmp_path / "home"), "serve"]) == 0
    told = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert told[0]["result"]["project"] == "p" and [t["id"] for t in told] == [1, None, 2, 3] and all("error" in t for t in told[1:])
    engine = Engine(spark, str(tmp_path / "home2"))
    run(engine, engine.index_project(folder, "p"))
    out = io.StringIO()
    serve(engine, [ask(1, "search", project="p", query="alpha", k=1), ask(2, "list_projects"), ask(3, "list_jobs")], out)
    told = [json.loads(x)["result"] for x in out.getvalue().splitlines()]
    assert told[0][0]["display_name"] == "a.txt" and told[1][0]["name"] == "p" and told[2][0]["status"] == "completed"
    assert main(["--home", str(tmp_path / "home"), "setup"]) == 0


def test_workers_keep_their_models(spark, tmp_path):
    made = tmp_path / "made"
    made.mkdir()

    class Counting(HashingEmbedder):
        def __init__(self):
            super().__init__(4)
            (made / f"{os.getpid()}-{time.time_ns()}").touch()

    rows = spark.range(40).repartition(4).select(F.concat(F.lit("w"), F.repeat(F.lit(" x"), F.col("id").cast("int"))).alias("text"))
    first = None
    for _ in range(10):
        got = sorted((r["text"], tuple(r["v"])) for r in rows.select("text", embed(F.col("text"), Counting).alias("v")).collect())
        first = first or got
        assert got == first and all(v == tuple(HashingEmbedder(4).query(t)) for t, v in got)
    names = [p.name.split("-")[0] for p in made.iterdir()]
    assert len(names) == len(set(names))


def test_point_lookups(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "home"))
    a = write(tmp_path / "a", one__txt="Alpha beta gamma.", two__txt="Delta epsilon.")
    run(engine, engine.index_project(a, "docs"))
    p = engine.project("docs")
    one = p.file_by_path(f"{a}/one.txt")
    assert one["display_name"] == "one.txt" and p.file_by_hash(one["sha1"])["path"] == one["path"]
    assert p.file_by_path(f"{a}/three.txt") is None and p.file_by_hash("none") is None
    assert p.name_in_use("one.txt") and p.name_in_use("one.txt", f"{a}/two.txt") and not p.name_in_use("one.txt", one["path"])
    assert p.has_source(a) and not p.has_source(str(tmp_path))
    p.set_setting("model", "hash")
    assert p.setting("model") == "hash" and p.setting("none", "x") == "x"
