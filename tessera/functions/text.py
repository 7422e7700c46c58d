"""Column functions on text: names, sentences, terms and small formats. All are built-in expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip sees it.
SPACE = r"[\s\x1c-\x1f]"
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+|\n{2,}"
TERM = r"[\p{L}\p{N}\p{Co}]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


@lru_cache(1)
def _accents() -> tuple[str, str]:
    """Letters that are a base letter with marks, and their base letters; then single marks, which have no counterpart."""
    pairs = []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isalpha() and all(unicodedata.category(x) == "Mn" for x in parts[1:]):
            pairs.append((chr(code), parts[0]))
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


def fold_accents(c: Column) -> Column:
    """Without accents; text of one byte a character has none and is left as it is."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(c, *_accents()))


def index_terms(text: Column) -> Column:
    """Terms of the inverted index, in order: runs of letters and digits, lower-cased, without accents."""
    return F.regexp_extract_all(F.lower(fold_accents(text)), F.lit(TERM), F.lit(0))


def query_tokens(query: Column) -> Column:
    """Tokens of a query: runs of word characters. A token may hold several terms, which then form a phrase."""
    return F.regexp_extract_all(query, F.lit(r"(?U)\w+"), F.lit(0))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_BREAK, -1), strip), lambda s: s != "")


def word_tokens(text: Column) -> Column:
    """The default tokenizer: runs of anything but white space."""
    return F.filter(F.split(text, rf"(?U){SPACE}+", -1), lambda t: t != "")


def token_count(text: Column) -> Column:
    return F.size(word_tokens(text))


def hard_windows(tokens: Column, size: int, stride: int) -> Column:
    """Texts of token windows: starts 0, stride, 2 * stride, ... below the number of tokens."""
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.array_join(F.slice(tokens, s + 1, F.lit(size)), " "))


def project_name(name: Column) -> Column:
    """Letters, digits, _ and - only, without _ at the ends; 'project' if nothing is left."""
    safe = F.regexp_replace(F.regexp_replace(strip(name), r"[^A-Za-z0-9_-]", "_"), r"\A_+|_+\z", "")
    return F.when(safe == "", F.lit("project")).otherwise(safe)


def basename(path: Column) -> Column:
    """The part after the last / or \\."""
    return F.regexp_extract(path, r"[^/\\]*\z", 0)


def suffix(name: Column) -> Column:
    """With its dot, lower-cased; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(name, r"(?s)\A.+(\.[^.]+)\z", 1))


def stem(name: Column) -> Column:
    return F.when(suffix(name) == "", name).otherwise(F.regexp_extract(name, r"(?s)\A(.+)\.[^.]+\z", 1))


def letter_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z]"))


def format_eta(seconds: Column) -> Column:
    """'?' for less than 0, NaN and null, else Ns, Nm Ns or Nh Nm, cut to whole seconds."""
    s = F.floor(F.when(F.isnan(seconds), F.lit(-1.0)).otherwise(seconds)).cast("long")
    return (
        F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0), F.lit("?"))
        .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor((s % 3600) / 60).cast("string"), F.lit("m")))
    )


def eta_words(seconds: float) -> str:
    """format_eta() of one number, for messages."""
    if not seconds >= 0:
        return "?"
    minutes, s = divmod(int(seconds), 60)
    hours, m = divmod(minutes, 60)
    return f"{hours}h {m}m" if hours else f"{m}m {s}s" if m else f"{s}s"


def estimated_chunks(total_bytes: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.coalesce(total_bytes, F.lit(0)) / 3072)).cast("long")


def recognised_lines(lines: Column, least: float = 0.5) -> Column:
    """Text of OCR lines (text, conf as a string) whose confidence, 0 if it can't be read, is high enough."""
    good = F.filter(lines, lambda x: x["text"].isNotNull() & (x["text"] != "") & (F.coalesce(x["conf"].try_cast("double"), F.lit(0.0)) >= least))
    return F.array_join(F.transform(good, lambda x: x["text"]), "\n")
