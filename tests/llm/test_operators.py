import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, chat, common, decontaminate, jaccard, langid, line_dedup, minhash, mixing, suffix_dedup, token_count, toxicity, vector_codes
from tests.llm import brute

WORDS = [a + b for a in ("ra", "to", "mi", "que", "ñe", "lo", "Sa") for b in ("n", "ti", "ro", "la", "ks", "ü", "po", "der", "gh")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.12 else "") + ("\n" if rng.random() < 0.05 else "") for _ in range(n)).replace("\n ", "\n")


def corpus(seed=1, n=60):
    """Copies, near copies, shared passages, short, empty, null and long texts, repeated rows and a null id."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 160)) for _ in range(n)]
    passage = prose(rng, 60)
    for k in range(0, n, 4):
        w = texts[k].split(" ")
        texts[k] = " ".join(w[: len(w) // 2] + [passage] + w[len(w) // 2 :])
    for k in range(10):
        w = texts[k].split(" ")
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    texts += [texts[3], texts[3], texts[5], "", None, "a", "A b", "a  B", "a b c d", "é" * 60, "é" * 80, "x" * 200, prose(rng, 3000), "...", " \n\t "]
    rows = [(k * 3 % 101 + 1000 * (k // 101), t) for k, t in enumerate(texts)]
    return rows + [rows[7], (None, texts[3]), (None, texts[9]), (None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    """With columns whose names the operators use themselves."""
    full = [(d, t, 1, "b", 2, 3.0) for d, t in rows]
    return stored(spark.createDataFrame(full, "doc_id long, text string, size int, batch string, n int, score double").repartition(5), tmp_path_factory)


def stored(df, factory):
    """As a table whose size is known."""
    path = str(factory.mktemp("t") / "t.parquet")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def same(df, want, columns):
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted(want, key=repr)


DIGEST = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_op1_units(docs, rows):
    same(line_dedup.repeated_units(docs, batch_bytes=2000), brute.units(rows), DIGEST)


def test_op1_short_lines_of_many_places_go_and_chance_repeats_stay(spark):
    rng = random.Random(12)
    rows = []
    for k in range(300):
        body = [" ".join(rng.choice(WORDS[:8]) for _ in range(20)) + f" {k} {j} " + rng.choice(["and.", "to."]) for j in range(6)]
        body.insert(rng.randint(1, 5), rng.choice(["and.", "to."]))  # as likely as at the end of a longer line
        rows.append((k, "\n".join((["menu" if k % 3 else "Menu"] if k % 2 else []) + body + (["All  rights reserved."] if k % 5 == 0 else []))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in line_dedup.repeated_units(docs, batch_bytes=1 << 16).collect():
        text = rows[r["doc_id"]][1]
        gone = [text.encode()[a:b].decode() for a, b in zip(r["spans"][::2], r["spans"][1::2], strict=True)]
        k = r["doc_id"]
        want = (["menu" if k % 3 else "Menu"] if k % 2 and k > 1 else []) + (["All  rights reserved."] if k % 5 == 0 and k else [])
        assert gone == want, (k, gone)


@pytest.mark.parametrize("limit", [decontaminate.LIMIT, 1])
def test_op2_contamination(spark, docs, rows, limit):
    rng = random.Random(2)
    items = [(k, " ".join(rows[k][1].split()[a : a + n])) for k, a, n in [(0, 0, 12), (1, 2, 10), (4, 10, 40), (2, 0, 3), (3, 5, 9)]] + [(7, None), (8, "?"), (9, prose(rng, 20)), (None, "a b"), (4, "a b"), (0, " ".join(rows[0][1].split()[:12]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs, bench, limit=limit)
    same(found, brute.contamination(rows, items), ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
    kept = decontaminate.keep_clean(docs, bench, limit=limit)
    assert kept.columns == docs.columns and kept.count() == sum(not r[5] for r in brute.contamination(rows, items))
    assert decontaminate.contamination(docs, bench.limit(0), limit=limit).where("contaminated").count() == 0


def test_op2_every_shared_span_is_found():
    """Winnowing's promise, on random words of a tiny vocabulary."""
    rng = random.Random(3)
    for _ in range(30):
        docs = [(k, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for k in range(8)]
        items = [(k, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))) for k in range(6)]
        import pyarrow as pa

        got = decontaminate.judge(decontaminate.Index((str(i), t) for i, t in items), pa.array([t for _, t in docs], pa.string()))
        assert [(a, b, len(c)) for a, b, c in got] == [r[1:4] for r in brute.contamination(docs, items)]


def test_op3_spans(docs, rows):
    same(suffix_dedup.removed_spans(docs, batch_bytes=2000), brute.suffix_spans(rows), DIGEST)


def test_op3_repetitive_bytes(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(k, "".join(rng.choice("ab") for _ in range(rng.choice([0, 49, 50, 51, 120]))) + "a" * rng.choice([0, 55, 90]) + "xyz" * rng.choice([0, 30])) for k in range(60)]
    df = stored(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path_factory)
    same(suffix_dedup.removed_spans(df, batch_bytes=300), brute.suffix_spans(rows), DIGEST)


@pytest.mark.parametrize("own", [suffix_dedup.OWN_CONTEXTS, 2, 1])
def test_op3_contexts_by_window(rows, monkeypatch, own):
    """The path of anchors with very many contexts, taken for all that have several, and for those that a batch has more of."""
    monkeypatch.setattr(suffix_dedup, "OWN_CONTEXTS", own)
    import numpy as np
    import pyarrow as pa

    table = pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string()), "batch": pa.array([k % 3 if d is not None else 2 for k, (d, _) in enumerate(rows)], pa.int64())})
    # batches by ranges of ids, null last
    edges = [0, 40, 80, 10**9]
    batch = [2 if d is None else next(k for k in range(3) if edges[k] <= d < edges[k + 1]) for d, _ in rows]
    table = table.set_column(2, "batch", pa.array(batch, pa.int64()))
    parts = [table.filter(pa.array([x == k for x in batch])) for k in range(3)]
    k = 16

    def grouped(tables, key):
        whole = pa.concat_tables(tables)
        return {v: whole.filter(pa.array([x == v for x in whole.column(key).to_pylist()])) for v in set(whole.column(key).to_pylist())}

    codes = [suffix_dedup.code(t) for t in grouped([suffix_dedup._send_hashes(k)(p) for p in parts], "bucket").values()]
    hot = []
    for t in codes:
        raised = [bytes(c | 4 if c & 2 else c for c in x.as_py()) for x in t.column("codes")]
        hot.append(t.set_column(2, "codes", pa.array(raised, pa.binary())))
    for coded in (codes, hot):
        by = grouped(coded, "batch")
        sent = [suffix_dedup._send_contexts(k)(p, by.get(i, coded[0].slice(0, 0))) for i, p in enumerate(parts)]
        spans = grouped([suffix_dedup._settle(t) for t in grouped(sent, "bucket").values()], "batch")
        out = pa.concat_tables([suffix_dedup._cut(suffix_dedup.digest)(p, spans.get(i, pa.table({c: [] for c in ("rows", "starts", "ends")}))) for i, p in enumerate(parts)])
        got = sorted((tuple(r[c] for c in DIGEST) for r in out.to_pylist()), key=repr)
        assert got == sorted(brute.suffix_spans(rows), key=repr)
    assert np.any([c & 4 for t in hot for x in t.column("codes") for c in x.as_py()])


def test_op3_cut_documents(docs, rows):
    left = suffix_dedup.cut_documents(docs)
    assert left.columns == docs.columns
    whole = [(r[0], t) for r, (_, t) in zip(brute.suffix_spans(rows), rows, strict=True) if not r[2]]
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert all(w in got for w in whole)
    shas = {(r[0], r[4]) for r in brute.suffix_spans(rows)}
    assert sum((d, brute.sha((t or "").encode())) in shas for d, t in got) >= len(got) - 6  # but for halves of characters


def test_op3_longest_previous_factors():
    rng = random.Random(15)
    assert suffix_dedup.previous_smaller(np.array([], np.int64)).tolist() == []
    for _ in range(60):
        x = np.array([rng.randrange(rng.choice([2, 9, 50])) for _ in range(rng.randint(1, 60))])
        want = [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(len(x))]
        assert suffix_dedup.previous_smaller(x).tolist() == want
        n, near = suffix_dedup.LENGTH, rng.choice(["ab", "aab", "abcdefgh"])
        texts = ["".join(rng.choice(near) for _ in range(n + rng.randint(0, 30))) for _ in range(rng.randint(1, 5))]
        texts += [t[3 : 3 + n - rng.randint(0, 2)] + "".join(rng.choice(near) for _ in range(n)) for t in texts if len(t) > n + 3]
        owner = [rng.randrange(4) for _ in texts]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        begin = np.cumsum([0, *map(len, texts)])
        starts = [(int(b) + k, o) for b, t, o in zip(begin, texts, owner) for k in range(len(t) - n + 1)]
        raw = data.tobytes()

        def common(p, q):
            return next((k for k in range(n) if raw[p + k] != raw[q + k]), n)

        want = [max((common(p, q) for q, o in starts if o < own), default=0) for p, own in starts]
        got = suffix_dedup.longest_previous(data, np.array([p for p, _ in starts]), np.array([o for _, o in starts]))
        assert got.tolist() == want


def test_op3_ids_that_fill_several_batches(spark, tmp_path_factory):
    """A third of null ids and a third of one id: several batches, which don't remove each other's bytes."""
    rng = random.Random(16)
    passages = [prose(rng, 12) for _ in range(4)]
    rows = [(rng.choice([None, 5, rng.randrange(40)]), prose(rng, rng.randint(0, 40)) + rng.choice(["", *passages]) + prose(rng, 5)) for _ in range(150)]
    df = stored(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path_factory)
    batches = suffix_dedup.dealt(df, 1500)[0].groupBy("doc_id").agg(F.countDistinct("batch").alias("n"))
    many = {r["doc_id"]: r["n"] for r in batches.collect()}
    assert many[None] > 2 and many[5] > 2 and max(n for d, n in many.items() if d not in (None, 5)) <= 2
    same(suffix_dedup.removed_spans(df, batch_bytes=1500), brute.suffix_spans(rows), DIGEST)


def test_op3_a_batch_sends_a_row_a_bucket_at_most():
    import pyarrow as pa

    rng = random.Random(17)
    passage, k = prose(rng, 80), 8
    rows = [(i, prose(rng, 30) + (passage if i % 3 else "") + prose(rng, 30)) for i in range(120)]
    table = pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": [t for _, t in rows], "batch": pa.array([0] * len(rows), pa.int64())})
    b = suffix_dedup.Batch(table)
    b.scan()
    codes = pa.table({"batch": [0], "bucket": [0], "codes": [bytes([6]) * int(b.sent.sum())]})
    sent = suffix_dedup._send_contexts(k)(table, codes)
    assert sent.num_rows <= 2 * k + 1 and all(x < k for x in sent.column("bucket").to_pylist())


def test_op3_contexts_that_can_share_no_window_are_not_sent():
    """Anchors stand in several contexts by chance in a large corpus; 17 more bytes on a side tell those that may match."""
    import pyarrow as pa

    rng = random.Random(18)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    phrases = [letters(20) for _ in range(100)]
    rows = [(i, "".join(letters(rng.randint(40, 90)) + rng.choice(phrases) for _ in range(20))) for i in range(60)]
    shared = [letters(n) for n in (49, 50, 50, 51, 60, 80)]
    both = [(i + 100, t[:500] + x + t[500:]) for x in shared for i, t in enumerate([letters(900), letters(900), letters(900)], 3 * shared.index(x))]

    def sent(docs):
        parts = [pa.table({"doc_id": pa.array([d for d, _ in docs[k::2]], pa.int64()), "text": [t for _, t in docs[k::2]], "batch": pa.array([k << suffix_dedup.SHIFT] * len(docs[k::2]), pa.int64())}) for k in range(2)]
        codes = suffix_dedup.code_by_range(pa.concat_tables([suffix_dedup._send_hashes(1)(p) for p in parts]))
        by = [codes.filter(pa.array([x == k << suffix_dedup.SHIFT for x in codes.column("batch").to_pylist()])) for k in range(2)]
        out = pa.concat_tables([suffix_dedup._send_contexts(1)(p, c) for p, c in zip(parts, by)])
        return b"".join(x for b, x in zip(out.column("bucket").to_pylist(), out.column("bytes").to_pylist()) if b >= 0).decode()

    assert len(sent(rows)) < 300  # but for 16-bit hashes that agree
    text = sent(sorted(rows + both))
    assert all(x[k : k + 50] in text for x in shared[1:4] for k in range(len(x) - 49)) and len(text) < 50 * sum(map(len, shared))


def test_op3_shared_windows_at_every_offset(spark, tmp_path_factory):
    rng = random.Random(19)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = []
    for k in range(400):
        x = letters(rng.choice([49, 50, 50, 51, 66, 90]))
        rows += [(2 * k + j, letters(rng.randint(0, 60)) + x + letters(rng.randint(0, 60))) for j in range(2)]
    rng.shuffle(rows)
    df = stored(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path_factory)
    same(suffix_dedup.removed_spans(df, batch_bytes=4000), brute.suffix_spans(rows), DIGEST)


def test_op3_hashes_are_brought_together():
    rng = np.random.default_rng(20)
    for bits in (0, 1, 16, 40):
        h, c = rng.integers(0, 9, 500).astype(np.uint64) << np.uint64(40), rng.integers(0, 3, 500).astype(np.uint64) << np.uint64(bits)
        order = suffix_dedup.by_hash(h, c)
        pairs = list(zip(h[order].tolist(), c[order].tolist()))
        assert h[order].tolist() == sorted(h.tolist())
        assert 1 + sum(a != b for a, b in zip(pairs, pairs[1:])) == len(set(pairs))
        assert all(order[i] < order[i + 1] for i in range(499) if pairs[i] == pairs[i + 1])


def test_op4_counts_as_the_library(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(5)
    pool = [" ", "  ", "\n", "\t", "\r\n", "a", "The", "é", "'s", "'LL", "12", "<|endoftext|>", "<|endof", " ", "\x1c", "\x85", "　", "漢字", "😀", "!!", "don't", "é"]
    odd = spark.createDataFrame([(k, "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for k in range(800)], "doc_id long, text string")
    for df in (docs, odd):
        texts = df.select("doc_id", "text").collect()
        want = [(r[0], len((r[1] or "").encode()), n, n > 100) for r in texts for n in [len(lib.encode(r[1] or "", add_special_tokens=False).ids)]]
        same(token_count.count_tokens(df, path, 100), want, ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def test_op5_languages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "123 ?!", "en"), (None, "the thing of heat and the other", None)], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(extra)
    model = langid.fit(both)
    found = langid.classify(both, model)
    assert found.count() == docs.count() + 3
    und = {r["doc_id"]: r["score"] for r in found.where("lang_pred = 'und'").collect()}
    assert und == {10**6: 0.0, 10**6 + 1: 0.0}
    right = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.9
    assert found.where("score < 0 or score > 1 or lang_pred is null").count() == 0
    for r in found.where("doc_id < 50").collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() > 0.9 * docs.count()
    assert langid.classify(docs, langid.fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def plain_classifier(model):
    """A second writing of the classification by a fitted sample: (language, score, accepted) of a text."""
    import zstandard

    langs = sorted(model)

    def size(lang, piece):
        d = zstandard.ZstdCompressionDict(model[lang][langid.SAMPLES * langid.SAMPLE_BYTES :], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(piece))

    def classify(text):
        plain = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()).encode()
        if not plain:
            return "und", 0.0, False
        if len(plain) < langid.SHORT:
            cuts = {k: [model[k][a : a + langid.SAMPLE_BYTES] for a in range(0, langid.SAMPLES * langid.SAMPLE_BYTES, langid.SAMPLE_BYTES)] for k in langs}
            sizes = [max(1, sum(size(k, x + b" " + plain) - size(k, x) for x in cuts[k])) for k in langs]
        else:
            sizes = [sum(size(k, plain[a : a + langid.PIECE]) for a in range(0, len(plain), langid.PIECE)) for k in langs]
        ranked = sorted(zip(sizes, langs))
        margin = (ranked[1][0] - ranked[0][0]) / ranked[1][0]
        return ranked[0][1], min(1.0, 0.5 + 5 * margin), margin > langid.MARGIN

    return classify


def test_op5_against_a_second_writing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(docs)
    assert all(len(v) <= langid.ROOM for v in model.values())
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    classify = plain_classifier(model)
    picked = sorted(texts, key=lambda d: (len(texts[d] or ""), d))
    picked = picked[:10] + picked[-2:] + picked[len(picked) // 2 :][:8]
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["accepted"]) for r in langid.classify(docs, model).collect()}
    for d in picked:
        assert got[d] == classify(texts[d]), d
    kept = {r["doc_id"] for r in langid.keep_identified(docs, model).collect()}
    assert kept == {d for d, x in got.items() if x[2]}


def test_op5_letters_ties_long_texts_and_repeated_rows(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the thing of that and the other one " * 8, "en"), ("la cosa de que los otros y las unas " * 8, "es")] * 9)]
    odd = [(100, "½ ²", None), (101, "Ⅷ", None), (102, "①② 12", None), (103, "the thing ① of that", None), (104, "la cosa de los otros " * 60_000, None), (104, "la cosa de los otros " * 60_000, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    out = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.classify(docs, model).where("doc_id >= 100").orderBy("doc_id").collect()]
    assert [o[1] for o in out] == ["und", "und", "und", "en", "es", "es"] and out[4] == out[5] and all(o[2] == 0 for o in out[:3])
    tie = langid.Classifier({"b": b"one two three four five", "a": b"one two three four five"})("one two three")
    assert tie == ("a", 0.5, False)
    assert langid.Classifier({"x": b"ab", "y": b"some more words here"})("ab ab")[0] in ("x", "y")


def test_op5_the_fit_reads_whole_texts():
    text = " ".join(["opening"] * 2000 + ["middle"] * 2000 + ["ending"] * 2000)
    assert all(w in langid.excerpts([text], 2048) for w in (b"opening", b"middle", b"ending"))
    assert len(langid.excerpts([text, "short", text], 4096)) <= 4096 + 8 and b"short" in langid.excerpts([text, "short", text], 4096)


def water_fill(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what is over the cap is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
            left -= most * sizes[s]
        open_ -= over
    return target


def test_op6_mix(spark):
    rng = random.Random(6)
    rows = [(k, " ".join("w" for _ in range(rng.randint(0, 30))), rng.choice(["a", "a", "a", "a", "b", "c", "é", None])) for k in range(3000)] + [(1, None, "empty"), (None, "x y", "a"), (5, "z z z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df.repartition(7)).collect()))
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = water_fill(sizes)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) and 0 <= r["taken"] <= 3 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 30
    assert mixing.mix(df.limit(0)).count() == 0
    taken = mixing.mixed_documents(df.withColumn("size", F.lit("x")))
    assert taken.count() == sum(r["copies"] > 0 for r in got)


def test_op6_larger_budgets_take_supersets(spark):
    df = spark.createDataFrame([(k, "w " * (k % 7 + 1), "a" if k % 2 else "b") for k in range(600)], "doc_id long, text string, source string")
    small, large = ({r["doc_id"] for r in mixing.mix(df, w).where("source = 'b' and taken > 0").collect()} for w in ((7, 1), (2, 1)))
    assert small < large


def test_op7_conversations(spark):
    def conv(i, turns):
        return [(i, k, r, t) for k, (r, t) in enumerate(turns)]

    base = [("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", None)]
    rows = conv(1, base[:2]) + conv(2, base) + conv(3, base) + conv(4, base[:1]) + conv(5, [("user", "hi"), ("assistant", "no")]) + conv(None, [("user", "alone")]) + [(6, None, "system", "s"), (6, 7, "user", "u"), (6, 7, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.render(df).collect()}
    assert set(out) == {2, 5, None, 6}
    assert out[2]["n_copies"] == 2 and out[2]["n_turns"] == 4 and out[2]["rendered"].endswith("<|assistant|>\n<|end|>\n")
    assert out[6]["rendered"] == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|user|>\nu<|end|>\n"
    assert chat.render(df.limit(0)).count() == 0


def test_op7_long_conversations_come_in_parts(spark):
    n = 2 * chat.BLOCK + 5
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    both = df.unionByName(df.where(F.col("turn") < chat.BLOCK + 1).withColumn("conv_id", F.lit(2)))
    out = chat.render(both).orderBy("part").collect()
    assert [r["conv_id"] for r in out] == [1, 1, 1] and {r["n_parts"] for r in out} == {3}
    assert "".join(r["rendered"] for r in out) == "".join(f"<|user|>\n{k}<|end|>\n" for k in range(n))


def test_op8_repeated_rows_several_vectors_and_a_longer_one(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 8))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    other = (x[7] * 3).tolist()
    df = spark.createDataFrame([*rows, *rows, (7, other), (20, (-x[20]).tolist()), (99, [1.0] * 9)], "vec_id long, embedding array<double>")
    own = {k: [v] for k, v in enumerate(x)}
    own[7], own[20] = [x[7], np.array(other)], [x[20], -x[20]]
    want = {}
    for q in (0, 20, 40):
        best = sorted((-max(float(a @ b) for a in own[q] for b in own[i]), i) for i in own if i != q)
        want[q] = [i for _, i in best[:20]]
    got = {}
    for r in ann.search(df, lambda i: i % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == want


def test_op8_recall_and_ties(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, size=(3000, 1))
    x[100:700] = x[100]  # a third of one vector
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [None] * 16), (3080, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, lambda i: i % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 3000, 20):
        s = (x * x[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:20]
        assert all(score == s[i] for i, score in got[q]) and got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        hits += len({i for i, _ in got[q]} & set(order))
    assert hits / (150 * 20) >= 0.95 and set(got) == set(range(0, 3000, 20))
    assert [i for i, _ in got[100]] == list(range(101, 121)) or x[100] @ x[100] < max((x @ x[100])[:100].max(), (x @ x[100])[700:].max())
    few = ann.search(df.where("vec_id in (0, 1, 2)"), lambda i: i % 20 == 0)
    assert few.count() == 2 and ann.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_op8_overflow_null_ids_and_clashing_names(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 6)) * 1e200
    df = spark.createDataFrame([(k, v.tolist(), 1, "x", 2.0, 3) for k, v in enumerate(x)] + [(None, [1.0] * 6, 1, "x", 2.0, 3)], "vec_id long, embedding array<double>, rank int, query_id string, score double, b int")
    got = {}
    for r in ann.search(df, lambda i: i % 20 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 120, 20)) and None not in {i for v in got.values() for i, _ in v}
    for q, found in got.items():
        with np.errstate(all="ignore"):
            s = {i: float((x[i] * x[q]).sum()) for i in range(120) if i != q}
        best = sorted(s, key=lambda i: (math.isnan(s[i]), -s[i] if not math.isnan(s[i]) else 0, i))[:5]
        assert [i for i, _ in found] == best
    small = spark.createDataFrame([(k, (v * 1e-400 if k else v * 1e-300).tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert ann.search(small, lambda i: i % 20 == 0, 5).count() == 0  # zero vectors take no part, and a query has no other row


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_op9_automaton_is_the_edit_distance():
    rng = random.Random(9)
    words = ["clown", "scum", "worthless", "moron", "disgusting", "clowns"]
    automaton = toxicity.Automaton(words, ["idio"], ["achl"])
    allowed = {w: 2 if len(w) >= 9 else 1 if len(w) >= 5 else 0 for w in words}
    tries = ["idiotic", "idot", "achlich", "", "x"]
    for _ in range(3000):
        w = list(rng.choice(words))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "o", "z", "s", "n"])
        tries.append("".join(w))
    for t in tries:
        near = [edits(t, w) for w in words if edits(t, w) <= allowed[w]]
        want = 0 if t.startswith("idio") else toxicity.FAINT if t.startswith("achl") else min(near, default=None)
        assert automaton.walk(t) == want, t


def test_op9_quotations_and_scores(spark):
    automaton = toxicity.Automaton(["clown"], [])
    get = lambda t: dict(zip(toxicity.FEATURES, toxicity.features(automaton, t)))
    assert get('He said "you clown" to me.')["quoted"] > 0 and get('He said "you clown" to me.')["abuse"] == 0
    assert get("You clown, you cl0wn.")["abuse"] > 0 and get("You clown, you cl0wn.")["misspelled"] > 0
    rng = random.Random(10)
    rows, labels = [], []
    for k in range(600):
        bad = k % 5 == 0
        w = prose(rng, 60).split(" ")
        if bad:
            w.insert(5, "zworgel")
            w.insert(20, "grumph" + rng.choice(["", "ed", "ish"]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    docs = spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id long, text string")
    table = spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, table)
    out = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(out) == 602 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out.values())
    held = [(out[k]["predicted"], y) for k, y in labels if out[k]["held_out"]]
    assert sum(p == y for p, y in held) / len(held) > 0.97 and out[1000]["predicted"] == out[1001]["predicted"] == 0
    empty = toxicity.fit(docs, table.limit(0))
    assert toxicity.score(docs, empty).where("predicted = 1").count() == 0


def plain_features(words, text):
    """A second writing: edit distances to whole words, and marks told one by one."""
    low = (text or "").lower()
    found = [(m.group(), m.start()) for m in re.finditer(r"[^\W_]+", low)]
    limit = {w: 2 if len(w) >= 9 else 1 if len(w) >= 5 else 0 for w in words}
    hits = [(i, at, min(d)) for i, (w, at) in enumerate(found) if (d := [n for x in words if (n := edits(w, x)) <= limit[x]])]
    abuse = wrong = quoted = near = 0
    for i, at, e in hits:
        a = low.rfind("\n", 0, at) + 1
        line = low[a:].split("\n")[0]
        left, right = line[: at - a], line[at - a :]
        inside = left.count('"') % 2 == 1 and '"' in right or left.count("“") > left.count("”") and "”" in right or left.count("«") > left.count("»") and "»" in right
        quoted += inside
        wrong += not inside and e > 0
        abuse += not inside and e == 0
        near += any(j != i and abs(j - i) <= toxicity.WINDOW for j, _, _ in hits)
    log = math.log1p
    return [log(abuse), log(wrong), log(quoted), log(100 * (abuse + wrong) / max(1, len(found))), log(near), 0.0, 0.0]


def test_op9_against_a_second_writing(spark):
    rng = random.Random(19)
    words = ["clown", "scum", "worthless", "disgusting"]
    odd = [*words, "clownn", "c1own", "worthles", "wrthless", "disgustin", "the", "don't", "it's", "a", "and"]
    texts = []
    for _ in range(200):
        parts = []
        for _ in range(rng.randint(0, 14)):
            run = " ".join(rng.choice(odd) for _ in range(rng.randint(1, 6)))
            parts.append(rng.choice(["{}", "{}", "{}", '"{}"', "“{}”", "«{}»", "{}\n", "{},"]).format(run))
        texts.append(" ".join(parts))
    texts += [None, "", "the " * 20_000 + "you clown", "the " * 20_000 + "you clown", "\n" * 50 + "scum"]
    weights = [-2.0, 2.0, 1.0, -0.5, 0.7, 0.3, 0.2, 0.1]
    docs = spark.createDataFrame([(k, t, 1.0, 2) for k, t in enumerate(texts)], "doc_id long, text string, score double, quoted int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, (words, [], [], weights)).collect()}
    for k, t in enumerate(texts):
        f = plain_features(words, t)
        p = 1 / (1 + math.exp(-(weights[0] + sum(w * x for w, x in zip(weights[1:], f)))))
        assert abs(got[k]["score"] - p) < 1e-9 and got[k]["predicted"] == int(p >= 0.7), (k, t)


def test_op9_marks_of_quotations():
    automaton = toxicity.Automaton(["clown"], [])
    quoted = lambda t: dict(zip(toxicity.FEATURES, toxicity.features(automaton, t)))["quoted"] > 0
    for t in ("I don't like you clown, and it's over.", '"Go," she said. You clown, "go".', 'You "clown', 'the boys\' clown and the girls\' hat', '"a\nclown"', "rock 'n roll, clown, isn't it", "“go” clown “go”", 'clown "'):
        assert not quoted(t), t
    for t in ('He said "you clown" to me.', "he said 'you clown' to me", "she said ‘you clown’ then", "»du clown« und", "„du clown“ und", "« le clown » et", '"It\'s a clown," he said', '"Go," she said. "You clown."'):
        assert quoted(t), t


def test_op9_states_are_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "STATES", 50)
    rng = random.Random(20)
    words = ["worthless", "disgusting", "miserable"]
    automaton, free = toxicity.Automaton(words, []), toxicity.Automaton(words, [])
    for _ in range(2000):
        w = "".join(rng.choice("worthlesdigunmab") for _ in range(rng.randint(5, 11))) if rng.random() < 0.5 else rng.choice(words)[rng.randint(0, 2) :]
        assert automaton.find(w) == free.walk(w)
        assert len(automaton.sets) < 50 + 12


def test_op9_sampling_keeps_the_share_of_toxic_documents(spark, monkeypatch):
    rng = random.Random(11)
    rows = []
    for k in range(3000):
        bad = k % 10 == 0
        w = prose(rng, 30).split(" ")
        if bad:
            w.insert(3, "zworgel")
        if rng.random() < (0.4 if bad else 0.1):  # three of ten of its documents are toxic
            w.insert(9, "blimkin")
        rows.append((k, " ".join(w), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE", 100)
    words, begin, weak, _ = toxicity.fit(docs, docs)
    assert "zworgel" in words and not any(w.startswith("blim") for w in words + begin + weak)


def test_op9_entries_of_the_most_documents_stay(monkeypatch):
    monkeypatch.setattr(toxicity, "ENTRIES", 1)
    counts = [("aaaa", True, 30, 10, 30, 10), ("zzzz", True, 90, 20, 90, 20), ("bbbb", True, 30, 0, 30, 0), ("yyyy", True, 90, 0, 90, 0)]
    assert toxicity.lexicon(counts, 4) == ([], ["yyyy"], ["zzzz"])


def test_op10_components(docs, rows):
    same(jaccard.jaccard_components(docs), brute.components(rows), ["doc_id", "n_shingles", "component_id"])


def test_op10_small_and_chained_sets(spark):
    """Sizes about every boundary of bands, edits about the limit, and chains."""
    rng = random.Random(11)
    rows, k = [], 0
    for size in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 17, 20, 24, 30, 38, 45, 58, 70, 90, 120]:
        base = [str(rng.randrange(10**6)) for _ in range(size)]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                p = rng.randrange(len(w))
                w[p : p + rng.randint(0, 1)] = [str(rng.randrange(10**6))] * rng.randint(0, 2)
            base = w or base
            rows.append((k, " ".join(base)))
            k += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(jaccard.jaccard_components(df), brute.components(rows), ["doc_id", "n_shingles", "component_id"])


def test_op10_crowds(spark):
    """More sets of one signature than a batch sends."""
    rng = random.Random(14)
    base = [str(rng.randrange(10**6)) for _ in range(60)]
    rows = []
    for k in range(260):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            w[rng.randrange(len(w))] = str(rng.randrange(10**6))
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, " ".join(base[:20] + [str(rng.randrange(10**6)) for _ in range(40)])) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    tokens, text, size = jaccard.shingle_sets(*_bytes([t for _, t in rows]))
    sig, own, _ = jaccard.signatures(tokens, text, size, False, 0, np.empty(0, np.uint64), np.ones(len(size), bool))
    assert jaccard._crowds(16, np.arange(len(rows)), sig, own)[2]
    same(jaccard.jaccard_components(df), brute.components(rows), ["doc_id", "n_shingles", "component_id"])


def test_op10_sets_that_cannot_allocate_ask_again(monkeypatch):
    """With as few segments as there can be, some sets fall into too few of them, other sets under another seed."""
    rng = random.Random(12)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(rng.randint(70, 90))) for _ in range(200)]
    last = jaccard.bands()[1:] - 1
    few = np.where(last < jaccard.SMALL, jaccard.segments(), 2 * last // 9 + 1)
    tokens, text, size = jaccard.shingle_sets(*_bytes(texts))
    monkeypatch.setattr(jaccard, "segments", lambda: few)
    every = np.ones(len(size), bool)
    bad = [jaccard.signatures(tokens, text, size, False, seed, np.empty(0, np.uint64), every)[2] for seed in range(6)]
    assert bad[0].any() and not np.all(bad, axis=0).any()
    asked = jaccard.signatures(tokens, text, size, False, 1, np.empty(0, np.uint64), bad[0])
    assert set(asked[1][asked[0] & np.uint64(1) == 1]) <= set(np.flatnonzero(bad[0]))


def _bytes(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_op10_signatures_meet_for_every_linked_pair():
    """The pigeonhole's promise: linked sets share a signature that one of them asks for."""
    rng = random.Random(13)
    for size in (4, 7, 12, 25, 60, 75, 150):
        base = [str(rng.randrange(10**6)) for _ in range(size + 4)]
        texts = []
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, 1 + size // 40)):
                w[rng.randrange(len(w))] = str(rng.randrange(10**6))
            cut = rng.randint(0, size // 8)
            texts.append(" ".join(w[cut:]))
        tokens, text, n = jaccard.shingle_sets(*_bytes(texts))
        own = [set() for _ in texts]
        for upper in (False, True):
            sig, at, failed = jaccard.signatures(tokens, text, n, upper, 0, np.empty(0, np.uint64), np.ones(len(n), bool))
            assert not failed.any()
            for s, t in zip(sig.tolist(), at.tolist()):
                own[t].add((s >> 3, s & 1, s & 2))
        sets = [brute.shingles(t) for t in texts]
        for i in range(40):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    a, b = own[i], own[j]
                    keys = {k for k, _, _ in a} & {k for k, _, _ in b}
                    assert any(ask for k, ask, _ in a | b if k in keys)


def kept(rows):
    return [(*r, r[2] is None or r[0] == r[2]) for r in brute.components(rows, 85)]


KEPT = ["doc_id", "n_shingles", "component_id", "kept"]


def test_sketches_differ_at_most_as_sets_do():
    rng = np.random.default_rng(3)
    for n in (1, 5, 31, 32, 33, 64, 400, 3000):
        for other in (n, n * 5 // 4):
            shared = rng.integers(0, n + 1)
            a, b = (np.unique(rng.integers(0, 1 << 52, k, dtype=np.uint64)) for k in (n, other))
            b = np.unique(np.concatenate([a[:shared], b[: other - shared]]))
            p, q = jaccard.sketch(a), jaccard.sketch(b)
            assert len(p) * 64 >= 2 * len(a)
            assert jaccard.differing(p, q) == jaccard.differing(q, p) <= len(np.setxor1d(a, b))
    apart = [np.unique(rng.integers(0, 1 << 52, 4000, dtype=np.uint64)) for _ in range(2)]
    assert 9 * jaccard.differing(*map(jaccard.sketch, apart)) > 8000  # long sets too are told apart before they are compared


def test_tokens_of_the_same_sets_are_met_once(spark):
    lists = [(1, 2)] * 100 + [(1, 2, 3)] * 50 + [(2, 3)] * 7 + [(4,)] * 30 + [(5, 6)]
    rows = [(d, t) for t, ids in enumerate(lists) for d in ids]
    met = [(r[0], r[1]) for r in jaccard._spared(spark.createDataFrame(rows, "doc_id long, token long")).collect()]
    assert sorted(d for d, _ in met) == [1, 1, 2, 2, 2, 3, 3, 5, 6]
    assert {(a, b) for a, t in met for b, u in met if t == u and a < b} == {(1, 2), (1, 3), (2, 3), (5, 6)}


def test_near_copies_come_up_few_times(spark):
    """Sets that have most tokens in common, but don't link, met once for each of these tokens."""
    rng = random.Random(7)
    base = range(1000)
    sets = [rng.sample(base, 800) for _ in range(30)] + [[k, 5000 + k % 5] for k in range(40)]
    rows = [(d, t * 7919 % 100_003) for d, s in enumerate(sets) for t in s]
    met = spark.createDataFrame(rows, "doc_id long, token long")
    a, b = (spark.range(len(sets)).select(F.col("id").alias(k)) for k in "ab")
    found = [(r["a"], r["b"]) for r in jaccard._meeting(jaccard._with_before(met), a, b, F.lit(True)).select("a", "b").collect()]
    have = [{t for e, t in rows if e == d} for d in range(len(sets))]
    assert set(found) == {(d, e) for e in range(len(sets)) for d in range(e) if have[d] & have[e]}  # none is lost
    assert len(found) < 2 * len(set(found))


def test_texts_of_wanted_ids_are_found_without_a_shuffle(spark):
    rows = spark.range(-500, 5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    ids = spark.range(-500, 5000, 7).select(F.col("id").alias("doc_id"))
    found = jaccard._wanted(rows, ids)
    got, want = {r[0] for r in found.collect()}, set(range(-500, 5000, 7))
    assert want <= got and len(got) < len(want) + 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in plan and "SortMergeJoin" not in plan
    assert jaccard._wanted(rows, ids.limit(0)).count() == 0


def test_op11_components(docs, rows):
    same(minhash.minhash_components(docs), kept(rows), KEPT)
    left = minhash.keep_one(docs)
    assert left.columns == docs.columns and sorted(r[0] or -1 for r in left.select("doc_id").collect()) == sorted(r[0] or -1 for r in kept(rows) if r[3])


def test_op11_small_and_chained_sets(spark):
    rng = random.Random(15)
    rows, k = [], 0
    for size in (1, 3, 5, 6, 8, 10, 14, 30, 80, 400):
        base = [str(rng.randrange(10**6)) for _ in range(size)]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 30))):
                p = rng.randrange(len(w))
                w[p : p + rng.randint(0, 1)] = [str(rng.randrange(10**6))] * rng.randint(0, 2)
            base = w or base
            rows.append((k, " ".join(base)))
            k += 1
    same(minhash.minhash_components(spark.createDataFrame(rows, "doc_id long, text string")), kept(rows), KEPT)


def test_op11_crowds_that_share_a_passage(spark):
    """Of many that have most of their text in common few link, whichever way they are dealt."""
    rng = random.Random(16)
    passage = [str(rng.randrange(10**6)) for _ in range(60)]
    rows = [(k, " ".join(passage + [str(rng.randrange(10**6)) for _ in range(rng.randint(8, 25))])) for k in range(300)]
    for k in range(0, 300, 10):
        w = rows[k][1].split()
        w[-1] = "end"
        rows.append((1000 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(minhash.minhash_components(df), kept(rows), KEPT)
    same(jaccard.jaccard_components(df), brute.components(rows), KEPT[:3])


def test_op11_prefixes_of_linked_sets_meet():
    """Whatever is called frequent, linked sets share a token of their prefixes."""
    rng = random.Random(17)
    for num, den in ((4, 5), (17, 20)):
        for n in (1, 2, 6, 7, 20, 101):
            base = [rng.randrange(1 << 52) for _ in range(n)]
            sets = [np.unique(np.array([rng.randrange(1 << 52) if rng.random() < 0.08 else t for t in base], np.uint64)) for _ in range(30)]
            known = np.array(sorted(base[: n // 2]), np.uint64)

            class Common:
                value = np.stack([known, np.full(len(known), 3, np.uint64)]) if len(known) else np.empty(0, np.uint64)

            import pyarrow as pa

            batch = pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in sets], pa.binary())], ["tokens"])
            found = [set(x) for b in jaccard._prefixes(num, den, Common)([batch]) for x in b.column(0).to_pylist()]
            for i in range(30):
                for j in range(i):
                    both = len(np.intersect1d(sets[i], sets[j]))
                    if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                        assert found[i] & found[j]


def test_op11_coordinates_are_one_shifted_permutation():
    rng = np.random.default_rng(18)
    tokens = rng.integers(0, 1 << 52, 1500).astype(np.uint64)
    ranks = minhash.circle()[:, 0]
    assert len(np.unique(ranks)) == minhash.PLACES
    at = minhash.places(tokens)
    for k in (0, 1, 200, minhash.WIDTH - 1):
        assert minhash.coordinates(tokens)[k] == ranks[(at + k) % minhash.PLACES].min()
    # the share of equal coordinates is the similarity
    near = np.concatenate([tokens[:1200], rng.integers(0, 1 << 52, 300).astype(np.uint64)])
    assert abs((minhash.coordinates(tokens) == minhash.coordinates(near)).mean() - 1200 / 1800) < 0.08


CODES = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize("d,kind,size", [(16, "float", 1.0), (20, "double", 1.0), (5, "float", 3.0), (16, "double", 1e7), (8, "double", 1e301)])
def test_op12_codes(spark, d, kind, size):
    rng = np.random.default_rng(d)
    made = rng.normal(size=(120, d)) * size
    made[40:60] = made[5]  # copies: entries that nothing is nearest to stay as they are
    made[60:70] = np.round(made[60:70])
    if kind == "float":
        made = made.astype(np.float32)
    rows = [(int(i) * 7 % 131, v.tolist(), [None, 1, 2][i % 3]) for i, v in enumerate(made)]
    rows += [rows[3], (None, rows[4][1], 1), (200, None, 1), (201, [None] * d, 1), (202, [float("nan")] * d, 2), (203, [float("inf")] + [0.0] * (d - 1), 2), (204, [0.0] * d, None)]
    odd = [(300, [1.0], 1), (301, [], None)]
    full = [(i, v, x, "c", 1, 2, "s") for i, v, x in rows + odd]
    df = spark.createDataFrame(full, f"vec_id long, embedding array<{kind}>, label int, code string, error int, d int, v string").repartition(5)
    same(vector_codes.compress(df), brute.vector_codes(rows), CODES)


def test_op12_few_rows_and_none(spark):
    kinds = "vec_id long, embedding array<float>, label int"
    rows = [(3, [0.5] * 8, None), (1, [0.25] * 8, 4)]
    same(vector_codes.compress(spark.createDataFrame(rows, kinds)), brute.vector_codes(rows), CODES)
    empty = vector_codes.compress(spark.createDataFrame([], kinds))
    assert empty.count() == 0 and empty.columns == CODES
    assert vector_codes.compress(spark.createDataFrame([(1, None, 2)], kinds)).count() == 0


def test_op12_partial_distances_and_limbs():
    rng = np.random.default_rng(3)
    for exact in (False, True):
        x, book = rng.integers(-3, 4, (300, 5)), rng.integers(-3, 4, (16, 5))
        if exact:
            x, book = x.astype(object) * 10**30, book.astype(object) * 10**30
        code, error = vector_codes.nearest(x, book)
        all_ = ((x[:, None] - book[None]) ** 2).sum(2)
        assert code.tolist() == [min(range(16), key=lambda e: (r[e], e)) for r in all_.tolist()] and error.tolist() == all_.min(1).tolist()
    assert vector_codes.by_variance(np.array([[0, 5, 1], [0, -5, 2]])).tolist() == [1, 2, 0]
    for n in (0, 1, -1, 2**31, -(2**31) - 1, 2**63, -(10**40), 10**320):
        assert sum(v << 32 * k for _, k, v in vector_codes._limbs(np.array([0]), np.array([n], object))) == n


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert line_dedup.repeated_units(none).count() == suffix_dedup.removed_spans(none).count() == jaccard.jaccard_components(none).count() == 0


def test_shared_folder_comes_from_the_session(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
