"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

A lexicon is learned from training labels: words, and beginnings of words, that stand in more toxic documents than chance
allows and in hardly any others; beginnings that are much more frequent
in toxic documents than in others are weak entries. Its trie is walked together with the Levenshtein automata of its words: a state is a set of (trie node, edits)
pairs, made when first met and kept; a word that leaves all of them is given up at once. So a misspelled word (one edit
from five letters, two from nine) is found by one walk, whatever the lexicon's size; a beginning must match exactly.

Each hit is then judged in its context: between the marks of a quotation on its line it is quoted, else abuse, and other
hits in a window of words around it strengthen it. Marks count in pairs over the whole line, opening and closing kinds apart; an
apostrophe within or at the end of a word is none, and a mark without its other half quotes nothing. A logistic model of these sums gives the score; its weights are fitted to training labels, drawn
to plausible values where the labels say nothing.

Defined results: a null or empty text has no hits and the score of such texts; without training labels the lexicon is
empty and every score is low; repeated rows repeat their result, and copies of a document are one in the fit; equal evidence gives
equal scores; whole texts are read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fold_is_train

WORD = re.compile(r"[^\W_]+")
#: Bounds of the fit: about so many labelled training documents of the rarer label, and entries of each kind in the lexicon.
SAMPLE, ENTRIES = 6000, 5000
#: The others come at the same rate, as shares and scores are those of the labels; about so many times SAMPLE documents in all.
MOST = 20
#: Least and most letters of a beginning; toxic documents that an entry needs, and how unlikely so many would be by chance.
BEGINNING, LONGEST, LEAST, CHANCE = 4, 9, 4, 1e-6
#: Share of a strong entry's documents that are toxic, and of a weak beginning's occurrences that are in toxic documents.
PRECISION, WEAK = 0.98, 0.7
WINDOW = 12
#: Closing marks of each opening one; the straight ones open and close.
CLOSING = {'"': '"', "'": "'", "“": "”", "„": "“”", "”": "”", "‘": "’", "‚": "‘’", "«": "»", "»": "«", "‹": "›", "›": "‹"}
MARK = re.compile("[" + "".join(CLOSING) + "’]")
#: States of the automata that a worker keeps.
STATES = 100_000
FEATURES = ("abuse", "misspelled", "quoted", "density", "near", "weak", "weak_density")
PRIOR = np.array([-3.0, 3.0, 1.5, 0.5, 1.0, 1.0, 0.5, 0.5])
#: What a weak beginning counts as among the edits of a hit.
FAINT = 9


class Automaton:
    """Lexicon trie and Levenshtein automata in one walk. find(word) gives the least edits of an entry, or None."""

    def __init__(self, words: list[str], beginnings: list[str], weak: list[str] = ()):
        self.child: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]  # edits allowed where an entry ends
        self.begin: list[int | None] = [None]
        self.reach: list[int] = [-1]  # most edits allowed below
        for entries, whole, found in ((words, True, 0), (beginnings, False, 0), (weak, False, FAINT)):
            for w in entries:
                allowed = (2 if len(w) >= 9 else 1 if len(w) >= 5 else 0) if whole else 0
                node = 0
                self.reach[0] = max(self.reach[0], allowed)
                for ch in w:
                    if ch not in self.child[node]:
                        self.child[node][ch] = len(self.child)
                        self.child.append({})
                        self.word.append(-1)
                        self.begin.append(None)
                        self.reach.append(-1)
                    node = self.child[node][ch]
                    self.reach[node] = max(self.reach[node], allowed)
                if whole:
                    self.word[node] = max(self.word[node], allowed)
                else:
                    self.begin[node] = found
        self.letters = {ch for c in self.child for ch in c}
        self.kept: dict[str, int | None] = {}
        self._forget()

    def _forget(self) -> None:
        """No states but the first; they are made again when met."""
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.accept: list[int | None] = []
        self.done: list[int | None] = []
        self.dead = self._state(frozenset())
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With letters of entries left out, and without pairs that another of the same node betters."""
        todo, best = list(pairs), {}
        while todo:
            node, e = todo.pop()
            if best.get(node, 99) <= e:
                continue
            best[node] = e
            if e < self.reach[node]:
                todo += [(c, e + 1) for c in self.child[node].values() if e + 1 <= self.reach[c]]
        return frozenset(best.items())

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.states:
            self.states[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.next.append({})
            ends = [e for n, e in pairs if self.word[n] >= e]
            self.done.append(min((self.begin[n] for n, e in pairs if self.begin[n] is not None and e == 0), default=None))
            self.accept.append(min(ends, default=None))
        return self.states[pairs]

    def _step(self, state: int, ch: str) -> int:
        pairs = set()
        for node, e in self.sets[state]:
            c = self.child[node].get(ch)
            if c is not None and e <= max(0, self.reach[c]):
                pairs.add((c, e))
            if e < self.reach[node]:
                pairs.add((node, e + 1))
                pairs.update((x, e + 1) for x in self.child[node].values() if e + 1 <= self.reach[x])
        to = self._state(self._closed(pairs))
        self.next[state][ch] = to
        return to

    def walk(self, word: str) -> int | None:
        state, faint = self.start, None
        for ch in word:
            if ch not in self.letters:
                ch = ""  # all letters that no entry has are one
            to = self.next[state].get(ch)
            state = self._step(state, ch) if to is None else to
            if self.done[state] == 0:
                return 0  # also where a weak beginning came before
            faint = faint or self.done[state]
            if state == self.dead:
                return faint
        return faint or self.accept[state]

    def find(self, word: str) -> int | None:
        if word not in self.kept:
            if len(self.kept) >= 200_000:
                self.kept.clear()
            if len(self.sets) >= STATES:
                self._forget()
            self.kept[word] = self.walk(word)
        return self.kept[word]


def quotations(line: str) -> list[tuple[int, int]]:
    """Places between the marks of each quotation of a line, inner ones too."""
    open_: list[tuple[str, int]] = []
    out = []
    for m in MARK.finditer(line):
        mark, at = m.group(), m.start()
        before, after = line[at - 1 : at], line[at + 1 : at + 2]
        if mark in "'’" and before.isalnum() and after.isalnum():
            continue  # don't
        close = next((k for k in range(len(open_) - 1, -1, -1) if mark in CLOSING[open_[k][0]]), None)
        # a straight mark closes only after something other than white space, or else opens
        if close is not None and not (mark in "\"'" and before.isspace() and after.isalnum()):
            out.append((open_[close][1] + 1, at))
            del open_[close:]
        elif mark in CLOSING and not (mark == "'" and before.isalnum()):
            open_.append((mark, at))
    return out


def features(automaton: Automaton, text: str | None) -> list[float]:
    low = (text or "").lower()
    words = WORD.findall(low)
    kept, find = automaton.kept, automaton.find
    hits = [(i, e) for i, w in enumerate(words) if (e := kept[w] if w in kept else find(w)) is not None]
    if not hits:
        return [0.0] * len(FEATURES)
    weak = sum(e == FAINT for _, e in hits)
    hits = [(i, e) for i, e in hits if e != FAINT]
    spans = [m.span() for m in WORD.finditer(low)] if hits else []
    places = [i for i, _ in hits]
    abuse = misspelled = quoted = near = 0.0
    line, end, said = 0, -1, []
    for i, e in hits:
        begin = spans[i][0]
        if begin > end:
            line = low.rfind("\n", 0, begin) + 1
            end = low.find("\n", begin)
            end = len(low) if end < 0 else end
            said = quotations(low[line:end])
        if any(a <= begin - line < b for a, b in said):
            quoted += 1
        elif e:
            misspelled += 1
        else:
            abuse += 1
        near += bisect_left(places, i + WINDOW + 1) - bisect_left(places, i - WINDOW) > 1
    return [math.log1p(abuse), math.log1p(misspelled), math.log1p(quoted), math.log1p(100 * (abuse + misspelled) / len(words)), math.log1p(near), math.log1p(weak), math.log1p(100 * weak / len(words))]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, pull: float = 2.0) -> np.ndarray:
    """Weights by Newton's method, drawn to PRIOR."""
    x = np.column_stack([np.ones(len(x)), x])
    w = PRIOR.copy()
    for _ in range(25):
        p = sigmoid(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pull * np.eye(len(w)), x.T @ (y - p) - pull * (w - PRIOR))
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def support(toxic: int, others: int) -> float:
    """Toxic documents that an entry needs: fewer could all be toxic by chance."""
    return max(LEAST, math.log(CHANCE) / math.log(max(1, toxic) / max(2, toxic + others)))


def lexicon(counts: list[tuple[str, bool, int, int, int, int]], need: float) -> tuple[list[str], list[str], list[str]]:
    """(words, beginnings, weak beginnings) of (text, is a beginning, toxic documents, others, occurrences in toxic ones, in others).

    A beginning stands for longer ones, and is taken as long as it can be without losing occurrences.
    """
    seen = {r[0]: r for r in counts if r[1] and r[2] >= need and r[4] >= WEAK * (r[4] + r[5])}
    short: set[str] = set()
    begin, weak = [], []
    for w in sorted(seen, key=lambda w: (len(w), w)):
        if any(w[:k] in short for k in range(BEGINNING, len(w) + 1)):
            continue
        long, least = w, 0.95 * seen[w][4]
        while more := [x for x in seen if len(x) == len(long) + 1 and x.startswith(long) and seen[x][4] >= least]:
            long = more[0]
        short.add(w)
        toxic, others = seen[long][2:4]
        (begin if toxic >= PRECISION * (toxic + others) else weak).append(long)
    faint = tuple(weak)
    # where there are more entries than the bound, those of the most toxic documents stay
    begin, weak = (sorted(x, key=lambda w: (-seen[w][2], w)) for x in (begin, weak))
    words = [r[0] for r in sorted(counts, key=lambda r: (-r[2], r[0])) if not r[1] and r[2] >= need and r[2] >= PRECISION * (r[2] + r[3]) and not r[0].startswith(faint)]
    return words[:ENTRIES], begin[:ENTRIES], weak[:ENTRIES]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[list[str], list[str], list[str], list[float]]:
    """Lexicon and weights, from training labels only."""
    spark = docs.sparkSession
    own = labels.where(fold_is_train() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    total = {int(r[0] > 0): r[1] for r in own.groupBy("y").count().collect()}
    part = min(1.0, SAMPLE / max(1, min(total.values(), default=0)), MOST * SAMPLE / max(1, sum(total.values())))
    chosen = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < part * (1 << 30)).select(F.col("doc_id").cast("long").alias("__d"), (F.col("y") > 0).alias("y"))
    # about MOST * SAMPLE rows at most, so this side is small at any size of corpus
    sample = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("d") == F.col("__d")).select("text", "y").where("text is not null")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[tuple[str, bool], list[int]] = {}
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own: dict[tuple[str, bool], int] = {}
                for w in WORD.findall(t.lower()):
                    for key in [(w, False), *((w[:k], True) for k in range(BEGINNING, min(len(w), LONGEST) + 1))]:
                        own[key] = own.get(key, 0) + 1
                for key, n in own.items():
                    got = out.setdefault(key, [0, 0, 0, 0])
                    got[not y] += 1
                    got[3 - y] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.bool_()), *[pa.array([v[j] for v in out.values()], pa.int64()) for j in range(4)]], ["w", "b", "t", "f", "to", "fo"])

    # copies of a document are no further evidence
    once = sample.groupBy(F.xxhash64("text"), F.md5("text")).agg(F.any_value("text").alias("text"), F.max("y").alias("y")).select("text", "y")
    sizes = {r[0]: r[1] for r in once.groupBy("y").count().collect()}
    need = support(sizes.get(True, 0), sizes.get(False, 0))
    counted = once.mapInArrow(terms, "w string, b boolean, t long, f long, to long, fo long").groupBy("w", "b").agg(*[F.sum(c).alias(c) for c in ("t", "f", "to", "fo")])
    found = counted.where((F.col("t") >= need) & ((F.col("to") >= WEAK * (F.col("to") + F.col("fo"))) | (F.col("t") >= PRECISION * (F.col("t") + F.col("f")))))
    entries = lexicon([tuple(r) for r in found.orderBy(F.desc("t"), "w", "b").limit(50 * ENTRIES).collect()], need)
    shared = spark.sparkContext.broadcast(entries)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(*shared.value)
        for b in batches:
            rows = [features(automaton, t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*rows, strict=True)] + [b.column(1)], [*FEATURES, "y"])

    if not total:
        return *entries, PRIOR.tolist()
    got = np.array([list(map(float, r)) for r in once.mapInArrow(measured, ", ".join(f"{f} double" for f in FEATURES) + ", y boolean").collect()]).reshape(-1, len(FEATURES) + 1)
    got = got[np.lexsort(got.T)]
    return *entries, logistic(got[:, :-1], got[:, -1]).tolist()


def score(docs: DataFrame, model: tuple[list[str], list[str], list[str], list[float]], doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, and the model's features, of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *entries, weights = shared.value
        automaton, w = Automaton(*entries), np.array(weights)
        for b in batches:
            x = np.array([features(automaton, t.as_py()) for t in b.column(2)]).reshape(b.num_rows, len(FEATURES))
            p = sigmoid(w[0] + (x * w[1:]).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32)), *[pa.array(c) for c in x.T.copy()]], ["doc_id", "held_out", "score", "predicted", *FEATURES])

    rows = docs.select(F.col(doc_id).alias("doc_id"), (~fold_is_train(doc_id)).alias("held_out"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, " + ", ".join(f"{f} double" for f in FEATURES))
