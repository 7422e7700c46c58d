"""Language identification by compression.

A text is compressed once per language by zstandard, primed with a raw-content dictionary of that language; the language
whose dictionary gives the fewest bytes wins. Before that, letters are lower-cased and all else becomes single spaces, and
the text is cut into pieces, so that a long text keeps leaning on the dictionary instead of on its own beginning. A short
text alone would hardly compress; it is measured by what it adds to each of a few samples of the language instead.

Letters are what Unicode has as letters: digits, numerals and marks in circles are none.

Defined results: a null text and one without a letter give ``und`` with score 0 and are rejected; equal sizes go to the
language whose name sorts first and are rejected; with no training rows every text is ``und``; a language with training text of any
length is among the answers. Repeated rows give repeated results and count again in the fit. Whole texts are used, also in the fit: of
the texts sampled for it, runs of words at places chosen by hash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fold_is_train

UND = "und"
#: Per language: bytes of dictionary, and texts read at most. A documented bound of the fit.
DICT_BYTES, TEXTS = 112 << 10, 600
LEVEL, PIECE = 6, 2048
#: Texts under so many bytes are measured behind samples of so many bytes each.
SHORT, SAMPLE_BYTES, SAMPLES = 400, 600, 8
#: All that is kept of a language, and bytes of a run of words.
ROOM, RUN = SAMPLES * SAMPLE_BYTES + DICT_BYTES, 256
#: Smallest share by which the best size must undercut the second.
MARGIN = 0.005
#: What is no letter, but for numerals and numbers, which \W and \d leave and normalised() takes out.
_REST = re.compile(r"[\W\d_]+")


def normalised(text: str) -> bytes:
    low = text.lower()
    if not low.isascii():
        # characters of words that str.isalpha() denies: numerals such as those in circles
        odd = {c for c in set(low) if not c.isalpha() and not c.isspace()}
        low = low.translate({ord(c): " " for c in odd})
    return _REST.sub(" ", low).strip().encode("utf-8", "replace")


def excerpts(texts: list[str], room: int) -> bytes:
    """About ``room`` bytes of some texts, each giving an equal share: the whole if it is short, else runs of words that begin at places chosen by hash."""
    plain = [normalised(t) for t in texts]
    left, out = max(0, room - len(texts)), []  # spaces between them
    for rank, i in enumerate(sorted(range(len(plain)), key=lambda i: (len(plain[i]), plain[i]))):
        share, x = left // (len(plain) - rank), plain[i]
        if len(x) > share:
            runs = max(1, share // RUN)
            size = (share - runs + 1) // runs
            cells = [(len(x) * k // runs, len(x) * (k + 1) // runs) for k in range(runs)]
            begin = [a + zlib.crc32(x[a:b]) % max(1, b - a - size) for a, b in cells]
            # from the next word on
            x = b" ".join(x[(a if not a else x.find(b" ", a) + 1 or a) :][:size] for a in begin)
        out.append((i, x))
        left -= min(len(x), left)
    return b" ".join(x for _, x in sorted(out) if x)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> dict[str, bytes]:
    """Text of each non-null lang, from at most TEXTS training rows of it chosen by hash: short samples, then the dictionary.

    Excerpts are taken where the rows are, so that only bytes of samples and dictionaries come to the driver.
    """
    rows = docs.where(fold_is_train(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("h"), F.col(text).alias("text"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return {}
    # a hash threshold first, so that the ranking below sees a few thousand rows of a language at any size of corpus
    bound = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, 3.0 * TEXTS / n) * (1 << 30)))]), F.col("lang"))
    near = rows.where(F.pmod("h", F.lit(1 << 30)) < bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # twice the share of a text, since some are short
            cut = [excerpts([t], 2 * ROOM // min(TEXTS, counts[k])) for k, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cut, pa.binary())], ["lang", "h", "text"])

    order = Window.partitionBy("lang").orderBy("h", "text")
    best = near.mapInArrow(run, "lang string, h long, text binary").withColumn("n", F.row_number().over(order)).where(F.col("n") <= TEXTS)
    parts: dict[str, list[tuple[int, bytes]]] = {}
    for r in best.select("lang", "n", "text").collect():
        parts.setdefault(r["lang"], []).append((r["n"], bytes(r["text"])))
    return {k: excerpts([x.decode("utf-8", "ignore") for _, x in sorted(v)], ROOM) for k, v in sorted(parts.items())}


class Classifier:
    def __init__(self, model: dict[str, bytes]):
        import zstandard

        # a raw dictionary needs eight bytes: the little there is, again
        model = {k: v if len(v) >= 8 else (v + b" ") * (8 // (len(v) + 1) + 1) for k, v in model.items() if v}
        self.langs = sorted(model)
        # of little text half is for samples
        width = {k: min(SAMPLE_BYTES, len(model[k]) // (2 * SAMPLES)) for k in self.langs}
        self.samples = [[model[k][a * width[k] : (a + 1) * width[k]] for a in range(SAMPLES)] for k in self.langs]
        self.coders = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(model[k][SAMPLES * width[k] :], dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for k in self.langs]
        self.bare = [sum(len(c.compress(x)) for x in xs) for c, xs in zip(self.coders, self.samples, strict=True)]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score 0 to 1, whether the margin is wide enough)."""
        plain = normalised(text) if text else b""
        if not plain or not self.langs:
            return UND, 0.0, False
        sizes = [0] * len(self.langs)
        if len(plain) < SHORT:
            sizes = [max(1, sum(len(c.compress(x + b" " + plain)) for x in xs) - bare) for c, xs, bare in zip(self.coders, self.samples, self.bare, strict=True)]
        for at in range(0, len(plain) if len(plain) >= SHORT else 0, PIECE):
            piece = plain[at : at + PIECE]
            for k, coder in enumerate(self.coders):
                sizes[k] += len(coder.compress(piece))
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        if len(order) == 1:
            return self.langs[0], 1.0, True
        best, second = sizes[order[0]], sizes[order[1]]
        margin = (second - best) / second
        return self.langs[order[0]], min(1.0, 0.5 + 5 * margin), margin > MARGIN


def classify(docs: DataFrame, model: dict[str, bytes], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: DICT_BYTES a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for b in batches:
            found = [classifier(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), (~fold_is_train(doc_id)).alias("held_out"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean")


def keep_identified(docs: DataFrame, model: dict[str, bytes], text: str = "text") -> DataFrame:
    """The rows of docs, unchanged, whose language is found with a wide enough margin."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for b in batches:
            yield b.filter(pa.array([classifier(x.as_py())[2] for x in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
