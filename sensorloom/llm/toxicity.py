"""Toxicity: a lexicon learned from labels, matched with misspellings, and a score that tells quotation from abuse.

The lexicon holds whole words and stems (a stem stands for all longer words
that begin with it), chosen from a bounded sample of labelled rows.  Its trie
is intersected with the Levenshtein automata of its terms: a state is the set
of trie nodes that can be reached with so many errors, made when first needed,
so that a word is read once, letter by letter, whatever the number of terms.
Each hit is weighed by a window of words and quotation marks around it, and a
logistic model over the sums of a document's hits gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm import common

#: Most labelled rows that a fit looks at.  Those with the smallest MD5 of their id are taken.
FIT_ROWS = 20_000
#: Most candidates for terms that reach the driver: those of the most toxic rows.
CANDIDATES = 20_000
#: Most terms of a lexicon.
TERMS = 500
SHORTEST, LONGEST = 4, 12  # letters of a stem
#: How much oftener a term must occur among toxic rows than among others.
LIFT = 8.0
#: States of the automaton, and words whose verdict is remembered, in a task at one time.
STATES, WORDS = 100_000, 500_000

_WORD = re.compile(r"[^\W_]+(?:[*@$!'’][^\W_]+)*")
_MARKS = re.compile("[“„«‹‘”»›’]")
_CLOSING = re.compile("[“”»›’]")
#: Characters looked at on each side of a hit, and words on each side for those that report or address.
WINDOW, NEAR = 120, 5
_REPORT = frozenset("said says say wrote writes called calls calling quoted quote quotes word words term insult insults slur slurs sagte schrieb nannte wort dit écrit mot appelé dijo escribió palabra llamó".split())
_ADDRESS = frozenset("you your yours youre you're u ur du dich dein deine dir euch ihr tu te toi ton vous votre tú ti tus usted ustedes vosotros".split())

WHOLE, STEM, FUZZY = 0, 1, 2


def budget(term: str, stem: bool) -> int:
    """How many letters of a term may be wrong, missing or too many."""
    return int(len(term) >= 8) if stem else 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The lexicon's trie and its terms' Levenshtein automata, determinised as words need it.

    match(word) is (kind, term) or None: a term itself, a word that begins
    with a stem and goes on, or a word within budget() of a term.  The least
    number of errors counts, then whole words before stems, then the longer
    term, then the smaller one.
    """

    def __init__(self, words: Iterable[str], stems: Iterable[str]):
        self.child: list[dict[str, int]] = [{}]
        self.most = [0]
        self.whole: dict[int, str] = {}
        self.stem: dict[int, str] = {}
        for terms, ends, is_stem in ((words, self.whole, False), (stems, self.stem, True)):
            for term in terms:
                at, allowed = 0, budget(term, is_stem)
                self.most[0] = max(self.most[0], allowed)
                for c in term:
                    if c not in self.child[at]:
                        self.child[at][c] = len(self.child)
                        self.child.append({})
                        self.most.append(0)
                    at = self.child[at][c]
                    self.most[at] = max(self.most[at], allowed)
                ends[at] = term
        self.letters = {c for below in self.child for c in below}
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.next: list[dict[str, int]] = []
        self.ends: list[tuple | None] = []  # the best whole word that ends here, as (errors, order of kinds, -length, term)
        self.stems: list[tuple | None] = []
        self.dead = self._state({})
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of a set of nodes, each with its least errors; letters left out of the word are errors, too."""
        closed = dict(nodes)
        queue = list(nodes)
        while queue:
            node = queue.pop()
            e = closed[node] + 1
            for below in self.child[node].values():
                if e <= self.most[below] and e < closed.get(below, 9):
                    closed[below] = e
                    queue.append(below)
        key = frozenset(closed.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(closed)
            self.next.append({})
            whole = [(e, 0, -len(self.whole[n]), self.whole[n]) for n, e in closed.items() if n in self.whole and e <= budget(self.whole[n], False)]
            stem = [(e, 1, -len(self.stem[n]), self.stem[n]) for n, e in closed.items() if n in self.stem and e <= budget(self.stem[n], True)]
            self.ends.append(min(whole, default=None))
            self.stems.append(min(stem, default=None))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}
        for node, e in self.sets[state].items():
            if e < self.most[node]:  # a letter too many
                nodes[node] = min(e + 1, nodes.get(node, 9))
            for letter, below in self.child[node].items():
                cost = e + (letter != c)
                if cost <= self.most[below]:
                    nodes[below] = min(cost, nodes.get(below, 9))
        return self._state(nodes)

    def match(self, word: str) -> tuple[int, str] | None:
        if len(self.sets) > STATES:
            self._clear()
        state, best = self.start, None
        for c in word:
            found = self.stems[state]
            if found and (best is None or found < best):
                best = found
            c = c if c in self.letters else ""
            to = self.next[state].get(c)
            if to is None:
                to = self.next[state][c] = self._step(state, c)
            state = to
            if state == self.dead:
                break
        else:
            found = self.ends[state]
            if found and (best is None or found < best):
                best = found
        if best is None:
            return None
        errors, order, _, term = best
        return (FUZZY if errors else STEM if order else WHOLE), term


def weight(text: str, start: int, end: int) -> float:
    """What a hit at text[start:end] counts by its window: 0.2 in quotation marks, 0.5 after words that report, 1.5 near words that address, else 1."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    before, after = before[before.rfind("\n") + 1 :], after.partition("\n")[0]
    marks = _MARKS.findall(before)
    # “ opens a quotation, but closes one that „ has opened
    opened = marks and (marks[-1] in "„«‹‘" or marks[-1] == "“" and "„" not in marks)
    if opened and _CLOSING.search(after) or before.count('"') % 2 and '"' in after:
        return 0.2
    near = _WORD.findall(before.lower())[-NEAR:]
    if _REPORT.intersection(near):
        return 0.5
    near += _WORD.findall(after.lower())[:NEAR]
    return 1.5 if _ADDRESS.intersection(near) else 1.0


@dataclass
class Matcher:
    """Finds a lexicon's hits in texts: its terms with their strengths; `fine` are words near a term that are words of their own."""

    words: dict[str, float]
    stems: dict[str, float]
    fine: frozenset[str] = frozenset()

    def __post_init__(self):
        self.automaton = Automaton(self.words, self.stems)
        self.seen: dict[str, tuple[int, float] | None] = {}

    def __reduce__(self):
        return Matcher, (self.words, self.stems, self.fine)

    def verdict(self, word: str) -> tuple[int, float] | None:
        """(kind, strength) of a word's term, or None."""
        if word not in self.seen:
            if len(self.seen) >= WORDS:
                self.seen.clear()
            got = self.automaton.match(word)
            self.seen[word] = None if got and got[0] == FUZZY and word in self.fine else got and (got[0], max(self.words.get(got[1], 0.0), self.stems.get(got[1], 0.0)))
        return self.seen[word]

    def hits(self, text: str | None) -> list[tuple[int, float, str]]:
        """(kind, weight, word) of every hit in a whole text, in order."""
        if not text:
            return []
        lower = text.lower()
        found = {w: got for w in set(_WORD.findall(lower)) if (got := self.verdict(w))}
        if not found:
            return []
        whole = text if len(text) == len(lower) else lower  # some letters change their length in lower case
        return [(found[m[0]][0], found[m[0]][1] * weight(whole, m.start(), m.end()), m[0]) for m in _WORD.finditer(lower) if m[0] in found]


FEATURES = ["whole", "stem", "stem_forms", "fuzzy", "any"]
#: Where the fit starts and is drawn back to, the constant last: what labels don't show keeps these weights.
PRIOR = np.array([2.0, 2.0, 1.0, 1.5, 1.0, -3.0])


def features(hits: list[tuple[int, float, str]]) -> list[float]:
    sums = [0.0, 0.0, 0.0]
    forms = {}
    for kind, by, word in hits:
        sums[kind] += by
        if kind == STEM:
            forms[word] = max(by, forms.get(word, 0.0))
    firm = [by for kind, by, _ in hits if kind != FUZZY]
    return [np.log1p(sums[WHOLE]), np.log1p(sums[STEM]), np.log1p(sum(forms.values())), np.log1p(sums[FUZZY]), min(1.0, max(firm, default=0.0))]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Logistic weights by Newton's method, drawn to PRIOR; without rows they are PRIOR."""
    x = np.column_stack([x.reshape(-1, len(FEATURES)), np.ones(len(y))])
    w = PRIOR.copy()
    pull = np.full(len(w), ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + pull * (w - PRIOR)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(pull), slope)
        w -= step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    matcher: Matcher
    w: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(self.matcher.hits(t)) for t in texts]).reshape(-1, len(FEATURES))
        return 1 / (1 + np.exp(-np.clip(x @ self.w[:-1] + self.w[-1], -30, 30)))


def held_out(id_col):
    """Whether a row's label is held out of every fit: CRC-32 of the id's text, modulo 5, is 0.  A null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0


def terms_of(text: str) -> set[str]:
    """A text's words, and with a `*` the stems of its words."""
    words = set(_WORD.findall(text.lower()))
    return words | {f"{w[:k]}*" for w in words for k in range(SHORTEST, min(LONGEST, len(w) - 1) + 1)}


_TERM = T.StructType([T.StructField("term", T.StringType()), T.StructField("toxic", T.LongType()), T.StructField("clean", T.LongType())])
_HELD = T.StructType([T.StructField("row", T.LongType()), T.StructField("held", T.ArrayType(T.IntegerType()))])
_HITS = T.StructType([T.StructField("row", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("kind", T.ArrayType(T.IntegerType())), T.StructField("by", T.ArrayType(T.DoubleType())), T.StructField("word", T.ArrayType(T.StringType()))])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.rows(batches, "text"):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
            counts[y].update(terms_of(text or ""))
        terms = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())], names=_TERM.names)


def _hold(batches: Iterator[pa.RecordBatch], numbers: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for batch in common.rows(batches, "text"):
        held = [sorted(numbers[t] for t in terms_of(text or "") if t in numbers) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(held, pa.list_(pa.int32()))], names=_HELD.names)


def _find(batches: Iterator[pa.RecordBatch], matcher: Matcher) -> Iterator[pa.RecordBatch]:
    for batch in common.rows(batches, "text"):
        hits = [matcher.hits(t) for t in batch.column("text").to_pylist()]
        columns = [pa.array([[h[k] for h in row] for row in hits], pa.list_(t)) for k, t in enumerate((pa.int32(), pa.float64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("y"), *columns], names=_HITS.names)


def choose(terms: list[str], clean: np.ndarray, held: list[np.ndarray], least: float) -> list[int]:
    """Terms for the lexicon, best first: each covers toxic rows that those before it cover little.

    A row counts 0.3 as much for each chosen term that it holds, so words that
    only accompany a term aren't chosen; of equal terms a whole word goes
    first, then the longest stem, then the smaller one.
    """
    rows = [np.array(r) for r in held]
    by_term: list[list[int]] = [[] for _ in terms]
    for d, own in enumerate(rows):
        for t in own:
            by_term[t].append(d)
    by = np.ones(len(rows))
    gain = np.array([float(len(d)) for d in by_term])
    tie = np.argsort(sorted(range(len(terms)), key=lambda t: (terms[t].endswith("*"), -len(terms[t]), terms[t])))
    chosen: list[int] = []
    open_ = np.ones(len(terms), dtype=bool)
    while len(chosen) < TERMS and open_.any():
        value = np.where(open_, np.round(gain - 0.5 * clean, 6), -np.inf)
        best = value.max()
        if best < least:
            break
        t = min(np.flatnonzero(value == best), key=lambda k: tie[k])
        chosen.append(int(t))
        open_[t] = False
        for d in by_term[t]:
            np.subtract.at(gain, rows[d], 0.7 * by[d])
            by[d] *= 0.3
    return chosen


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on at most `rows` labelled documents that aren't held out, of several texts under one id on the least; what
    reaches the driver is bounded by that sample."""
    spark = docs.sparkSession
    key = F.md5(F.col(id_col).cast("string"))
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).select(F.col(id_col).cast("long").alias("row"), F.col(label_col).cast("int").alias("y"), key.alias("key")).orderBy("key", "y").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text")).join(F.broadcast(chosen.select("row", "y")), "row")
    sample = common.cut(texts.groupBy("row", "y").agg(F.min("text").alias("text")), "fit")  # one text for each of at most `rows` labels
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    counted = sample.mapInArrow(_count_terms, _TERM).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    lift = (F.col("toxic") + 0.5) * (clean + 1.0) / ((F.col("clean") + 0.5) * (toxic + 1.0))
    found = counted.where((F.col("toxic") >= 3) & (lift >= LIFT)).orderBy(F.desc("toxic"), "clean", "term").limit(CANDIDATES).toArrow()
    terms, others = found.column("term").to_pylist(), np.array(found.column("clean").to_pylist(), dtype=float)
    numbers = {t: k for k, t in enumerate(terms)}
    held = [r.held for r in sample.where("y = 1").mapInArrow(partial(_hold, numbers=numbers), _HELD).orderBy("row").collect()] if terms else []
    lexicon = [terms[t] for t in choose(terms, others, held, max(2.0, 0.004 * toxic))]
    # a term that clean rows hold, too, counts less
    strength = {t: log((n + 0.5) * (clean + 1.0) / ((m + 0.5) * (toxic + 1.0))) / log(1000) for t, n, m in zip(terms, found.column("toxic").to_pylist(), others.tolist())}
    words, stems = {t: strength[t] for t in lexicon if not t.endswith("*")}, {t[:-1]: strength[t] for t in lexicon if t.endswith("*")}
    matcher = Matcher(words, stems)
    hits = sorted(sample.mapInArrow(partial(_find, matcher=matcher), _HITS).collect(), key=lambda r: (r.row, r.y, r.word))
    # a word near a term that clean rows use is a word of its own
    near: tuple[Counter, Counter] = (Counter(), Counter())
    for r in hits:
        near[r.y].update({w for k, w in zip(r.kind, r.word) if k == FUZZY})
    fine = frozenset(w for w, n in near[0].items() if (near[1][w] + 0.5) * (clean + 1) < LIFT * (n + 0.5) * (toxic + 1))
    x = np.array([features([h for h in zip(r.kind, r.by, r.word) if h[0] != FUZZY or h[2] not in fine]) for r in hits]).reshape(-1, len(FEATURES))
    common.remove(spark, sample)
    return Model(Matcher(words, stems, fine), fit(x, np.array([r.y for r in hits], dtype=float)))


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in common.rows(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(batch.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])


def predictions(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from a score of one half).

    Null and empty texts are scored like texts without hits; so is every text
    where no label or but one kind of label is given.  Labels other than 0 and
    1 aren't used; repeated rows are scored each; an empty table gives no
    rows; other columns are not read.
    """
    model = train(docs, labels, rows)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_score, model=model), schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents by a lexicon and weights fitted to `labels.toxic`."""
    return predictions(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
