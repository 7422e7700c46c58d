import fnmatch
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.vectors import l2_distance, literal, similarity
from tessera.operators import chunker
from tessera.operators.files import classify, display_names, free_name
from tessera.operators.fusion import SearchFilter, matches_glob


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_sentences_as_in_python(spark):
    texts = ["A b. C d!  E?\n\nF", "", "one\n\n\ntwo\nthree", " lead. \x1c tail ", "Ä. Ö ! Ü", "no break.here"]
    assert one(spark, texts, T.sentences) == [chunker.split_sentences(t) for t in texts]


def test_terms_fold_accents_and_marks(spark):
    assert one(spark, ["Café déjà_vu Straße, 12", "éte", None], T.index_terms) == [["cafe", "deja", "vu", "straße", "12"], ["ete"], None]
    assert one(spark, ["foo_bar Éa-b"], T.query_tokens) == [["foo_bar", "Éa", "b"]]


def test_names(spark):
    assert one(spark, [" a b ", "__", "x/y.z", "ok-1", ""], T.project_name) == ["a_b", "project", "x_y_z", "ok-1", "project"]
    assert one(spark, ["/a/b.TXT", "c\\d.md", ".md", "x.tar.gz", "e"], lambda c: T.suffix(T.basename(c))) == [".txt", ".md", "", ".gz", ""]
    assert one(spark, ["b.TXT", ".md", "x.tar.gz"], T.stem) == ["b", ".md", "x.tar"]


def test_eta_and_estimates(spark):
    assert one(spark, [-1.0, float("nan"), None, 0.0, 59.9, 60.0, 3599.0, 3600.0, 7325.0], T.format_eta, "double") == ["?", "?", "?", "0s", "59s", "1m 0s", "59m 59s", "1h 0m", "2h 2m"]
    assert one(spark, [None, 0, 3071, 6144], T.estimated_chunks, "long") == [1, 1, 1, 2]


def test_ocr_lines(spark):
    df = spark.createDataFrame([([("a", "0.9"), ("b", "x"), ("", "0.9"), ("c", "0.5"), (None, "1")],)], "v array<struct<text:string,conf:string>>")
    assert df.select(T.recognised_lines(F.col("v"))).first()[0] == "a\nc"


def test_vectors(spark):
    df = spark.createDataFrame([([0.6, 0.8],), ([-0.6, -0.8],), (None,)], "v array<float>")
    d = [r[0] for r in df.select(l2_distance(F.col("v"), literal([0.6, 0.8]))).collect()]
    assert abs(d[0]) < 1e-6 and abs(d[1] - 2) < 1e-6 and d[2] is None
    assert df.limit(1).select(similarity(F.lit(3.0))).first()[0] == 0.0


def test_hard_windows(spark):
    tokens = [str(i) for i in range(10)]
    assert one(spark, [" ".join(tokens), ""], lambda c: T.hard_windows(T.word_tokens(c), 4, 3)) == [[" ".join(tokens[s : s + 4]) for s in range(0, 10, 3)], []]


def test_globs(spark):
    names = ["a.md", "A.md", "x/b.md", "note1.txt", "note[1].txt", "", "a\n.md"]
    for pattern in ["*.md", "note[0-9].txt", "note[!0-9]*", "?.md", "*"]:
        assert one(spark, names, lambda c, p=pattern: matches_glob(c, p)) == [fnmatch.fnmatchcase(n, pattern) for n in names]


def test_filter_conditions(spark):
    rows = spark.createDataFrame([("f.md", "/s/f.md", 3, 0.0), ("g.txt", "/t/g.txt", None, 1.2)], "display_name string, source_file string, page int, distance double")
    names = lambda f: [r[0] for r in f.apply(rows).collect()]
    assert names(SearchFilter(page_min=0)) == ["f.md"]
    assert names(SearchFilter(subdirectory="/t")) == ["g.txt"]
    assert names(SearchFilter(min_similarity=0.5)) == ["f.md"]
    assert names(SearchFilter(file_glob="")) == ["f.md", "g.txt"] and not SearchFilter().is_active()


def in_order(paths, taken=()):
    used, out = set(taken), {}
    for p in sorted(paths, key=lambda p: p.split("/")):
        out[p] = free_name(p.rsplit("/", 1)[-1], used)
        used.add(out[p])
    return out


def test_display_names_see_those_before(spark):
    named = lambda paths, taken=(): {r[0]: r[1] for r in display_names(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(t,) for t in taken], "display_name string") if taken else None).collect()}
    paths = ["/a/r.txt", "/b/r.txt", "/c/r_2.txt", "/d/r.txt", "/e/x", "/f/x"]
    assert [named(paths)[p] for p in paths] == ["r.txt", "r_2.txt", "r_2_2.txt", "r_3.txt", "x", "x_2"]
    rng = random.Random(4)
    ends = ["", "_2", "_3", "_2_2", "_x", "_2_x", "_02", "__2", "_"]
    paths = sorted({f"/{rng.randrange(30)}/{rng.randrange(9)}/{rng.choice(['a', 'b', '_2', '.a', 'ü'])}{rng.choice(ends)}{rng.choice(ends[:4])}{rng.choice(['.txt', '', '.', '.tar.gz'])}" for _ in range(400)} - {"/"})
    paths = [p for p in paths if not p.endswith("/")]
    taken = {f"{a}{e}.txt" for a in "ab" for e in rng.sample(ends, 5)}
    assert named(paths) == in_order(paths) and named(paths, taken) == in_order(paths, taken)


def test_classification_follows_the_order_of_paths(spark):
    """Against a fold that takes one file after another, with files that fail or have no text."""
    rng = random.Random(5)
    for _ in range(4):
        known = {f"/{k:02}": rng.choice("abcdefg") for k in range(0, 24, 2)}
        rows = [(f"/{k:02}", rng.choice("abcdefgh"), rng.choice(["ok", "ok", "ok", "failed", "empty"])) for k in range(24) if rng.random() < 0.8]
        owned, want = dict(known), {}
        for path, sha1, state in rows:
            old = owned.get(path)
            if old == sha1:
                want[path] = "unchanged"
            elif old is None and sha1 in owned.values():
                want[path] = "duplicate"
            elif state == "failed":
                want[path] = "failed"
            elif state == "empty":
                want[path] = "empty"
                owned.pop(path, None)
            else:
                want[path] = "new" if old is None else "update"
                owned[path] = sha1
        found = classify(spark.createDataFrame(rows, "path string, sha1 string, state string"), spark.createDataFrame(list(known.items()), "path string, sha1 string"))
        assert {r["path"]: r["action"] for r in found.collect()} == want


def fold(sizes, limit, overlap):
    """Another writing of the packing, on sizes: each chunk as ('p', places) or ('w', place, start)."""
    out, buf = [], []
    for i, n in enumerate(sizes):
        tail = []
        for j in reversed(buf):
            if sum(sizes[x] for x in tail) + sizes[j] > overlap:
                break
            tail = [j, *tail]
        if n > limit:
            out += [("p", tuple(buf))] * bool(buf) + [("w", i, s) for s in range(0, n, max(1, limit - overlap))]
            buf = tail
        elif sum(sizes[x] for x in buf) + n <= limit:
            buf = [*buf, i]
        else:
            out.append(("p", tuple(buf)))
            buf = [*tail, i] if sum(sizes[x] for x in tail) + n <= limit else [i]
    return out + [("p", tuple(buf))] * bool(buf)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 14), max_size=25), st.integers(4, 9), st.integers(0, 4))
def test_packing(sizes, limit, overlap):
    parts = [" ".join(f"w{i}x{k}" for k in range(n)) for i, n in enumerate(sizes)]
    want = [" ".join(parts[i] for i in c[1]) if c[0] == "p" else " ".join(parts[c[1]].split()[c[2] : c[2] + limit]) for c in fold(sizes, limit, overlap)]
    got = chunker.pack(parts, None, limit, overlap)
    assert got == want
    assert all(len(c.split()) <= limit for c in got)


def test_long_sentence_keeps_the_tail():
    parts = ["a a", "b b", "L " * 20, "c"]
    got = chunker.pack([p.strip() for p in parts], None, 6, 2)
    assert got[0] == "a a b b" and got[-1] == "b b c"
    assert chunker.pack(["a a", ("L " * 9).strip()], None, 6, 2)[-1] == "a a"


def test_six_long_sentences_end():
    text = ". ".join((f"phrase number {k} with some ten words in it here " * 35).strip() for k in range(6))
    chunks = chunker.pack(chunker.split_sentences(text))
    assert chunks and all(len(c.split()) <= 384 for c in chunks)


def test_numbering_goes_on_over_blocks(spark):
    blocks = spark.createDataFrame([("f", 0, "A b. C d."), ("f", 1, ""), ("f", 2, "E f."), ("g", 0, None)], "path string, block_no int, text string")
    chunks = chunker.number_chunks(chunker.chunk_blocks(blocks, ["path", "block_no"], limit=2, overlap=0), "path", "block_no")
    assert [tuple(r) for r in chunks.orderBy("path", "chunk_index").select("path", "chunk_index", "text").collect()] == [("f", 0, "A b."), ("f", 1, "C d."), ("f", 2, "E f.")]


def test_suffix_rule_is_the_parsers(spark):
    from tessera.sources.parsers import suffix_of

    names = ["a.b", ".b", "x.", "noext", "a.B.C", "/d.e/f"]
    assert one(spark, names, lambda c: T.suffix(T.basename(c))) == [suffix_of(n) for n in names]
