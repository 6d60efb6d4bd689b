"""Toxicity: a lexicon trie met with Levenshtein automata, and context windows that tell quotation from abuse.

The lexicon is learned: terms, and stems of inflected terms, that labelled training texts use in toxic documents in
many different contexts and hardly anywhere else. Matching runs the product of the trie with the Levenshtein automata of all terms, made
deterministic as it goes, so a word costs a table lookup for each of its letters and most words die early.
Misspellings count unless clean training texts use that very word. Each hit is weighed by its edits and by its
window, hits of stems less their number expected by chance; the sum is a document's severity, which is calibrated on
the training rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import need, small_batches, stage
from .training import TRAIN_ROWS, held_out, labelled_sample

#: A term needs this many contexts in toxic texts, whatever the sample's size, this share of its contexts in toxic
#: texts, and that many standard deviations over the share of all words (a stem, which stands for several words,
#: needs more contexts).
SUPPORT, STEM_SUPPORT, PRECISION, STEM_PRECISION, DEVIATIONS = 3, 6, 0.8, 0.6, 8.0
#: Lengths of stems, and the weight of a word that begins with one.
STEM_LENGTHS, STEM_WEIGHT = (3, 8), 0.35
#: Words around a hit that are its window.
WINDOW = 6
#: Weight of a hit by its edits, and the factor for a quoted or reported hit.
EDIT_WEIGHT, QUOTED = (1.0, 0.5, 0.3), 0.25
#: Lower borders of the severity classes that are calibrated.
CLASSES = (0.0, 0.01, 0.6, 0.9, 1.3, 1.9, 3.9)
_PRIOR_ROWS = 2.0
_WORD = re.compile(r"\w+")
_WORDS_KEPT = 500_000
#: States of the automaton that a process keeps before it begins again.
STATES_KEPT = 200_000
#: Quotation marks, and words that report what another one said.
QUOTES = "\"“”„«»‹›"
REPORTING = frozenset("said says saying called calls quote quoted quotes wrote writes term word dijo llamó escribió palabra dit disait appelé écrit mot sagte sagt nannte schrieb wort".split())


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class LexiconAutomaton:
    """Deterministic automaton of all words within each term's allowed edits, or that begin with a stem."""

    def __init__(self, terms: list[str], stems: list[str] = ()) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.limit = [0]
        self.stem: dict[int, str] = {}
        for t, whole in sorted({(t, True) for t in terms} | {(t, False) for t in stems}):
            at, most = 0, edits_allowed(t) if whole else 0
            self.limit[0] = max(self.limit[0], most)
            for ch in t:
                if ch not in self.children[at]:
                    self.children[at][ch] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.limit.append(0)
                at = self.children[at][ch]
                self.limit[at] = max(self.limit[at], most)
            if whole:
                self.term[at] = t
            else:
                self.stem[at] = t
        self.letters = {ch for c in self.children for ch in c}
        self._forget()

    def _forget(self) -> None:
        """Begin again with the start state alone: states are made as words need them."""
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.number: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, str] | None] = []
        self.begins: list[str | None] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """Number of the state that holds trie nodes with their least edits; -1 if none can still match."""
        todo = list(nodes)
        while todo:  # terms may lack letters of the word's place: move down the trie at the cost of one edit
            node = todo.pop()
            for child in self.children[node].values():
                if nodes[node] + 1 <= self.limit[child] and nodes[node] + 1 < nodes.get(child, 99):
                    nodes[child] = nodes[node] + 1
                    todo.append(child)
        key = tuple(sorted((n, e) for n, e in nodes.items() if e <= self.limit[n]))
        if not key:
            return -1
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] and e <= edits_allowed(self.term[n])]
            self.accepts.append(min(ends, default=None))
            self.begins.append(next((self.stem[n] for n, e in key if e == 0 and n in self.stem), None))
        return self.number[key]

    def _move(self, state: int, ch: str) -> int:
        after: dict[int, int] = {}
        for node, e in self.states[state]:
            after[node] = min(after.get(node, 99), e + 1)  # an extra letter
            for letter, child in self.children[node].items():
                after[child] = min(after.get(child, 99), e + (letter != ch))
        to = self.moves[state][ch] = self._state({n: e for n, e in after.items() if e <= self.limit[n]})
        return to

    def match(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term within its allowed edits, ties to the first in order; (0, stem) if the
        word begins with a stem; else None."""
        if len(self.states) > STATES_KEPT:
            self._forget()
        state = self.start
        for ch in word:
            if ch not in self.letters:
                ch = "\0"
            to = self.moves[state].get(ch)
            state = self._move(state, ch) if to is None else to
            if state < 0:
                return None
            if self.begins[state] is not None:
                return 0, self.begins[state]
        return self.accepts[state]


@dataclass
class ToxicityModel:
    """Learned lexicon, near-spellings that clean texts use, and the calibrated rate of each severity class."""

    terms: list[str]
    clean_words: set[str]
    stems: list[str] = field(default_factory=list)
    #: share of the clean sample's words that begin with a stem
    chance: float = 0.0
    rates: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.automaton = LexiconAutomaton(self.terms, self.stems)
        self.whole = set(self.terms)
        self.known: dict[str, tuple[float, bool]] = {}

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("terms", "clean_words", "stems", "chance", "rates")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def weight(self, word: str) -> tuple[float, bool]:
        """(weight, whether a stem gave it) of a lower-case word; weight 0 without a match."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > _WORDS_KEPT:
                self.known.clear()
            hit = self.automaton.match(word)
            if hit is None or (hit[0] and word in self.clean_words):
                found = 0.0, False
            else:
                found = (EDIT_WEIGHT[hit[0]], False) if hit[1] in self.whole else (STEM_WEIGHT, True)
            self.known[word] = found
        return found

    def hits(self, text: str | None) -> tuple[list[tuple[int, int, float, bool, bool]], int]:
        """(start, end, weight, quoted, by a stem) of every hit in the whole text, and the number of words if there is one."""
        low = (text or "").lower()
        if len(low) != len(text or ""):  # a letter whose lower case is longer would move the offsets
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found = {w for w in set(_WORD.findall(low)) if self.weight(w)[0]}
        if not found:
            return [], 0
        marks = np.cumsum(np.fromiter((c in QUOTES for c in low), bool, len(low)))
        words = list(_WORD.finditer(low))
        out = []
        for k, m in enumerate(words):
            if m.group() in found:
                left, right = words[max(0, k - WINDOW)], words[min(len(words) - 1, k + WINDOW)]
                opened, before_window = int(marks[m.start() - 1]) if m.start() else 0, int(marks[left.start() - 1]) if left.start() else 0
                closes = int(marks[right.end() - 1]) > opened
                quoted = opened > before_window and closes and opened % 2 == 1  # a mark opens before the hit and closes after it
                reported = any(w.group() in REPORTING for w in words[max(0, k - WINDOW // 2) : k])
                weight, stem = self.weight(m.group())
                out.append((m.start(), m.end(), weight, quoted or reported, stem))
        return out, len(words)

    def severity(self, text: str | None) -> tuple[float, int]:
        """Severity of a whole text and its number of hits."""
        hits, words = self.hits(text)
        terms, stems = (sum(w * (QUOTED if quoted else 1.0) for _, _, w, quoted, by_stem in hits if by_stem is kind) for kind in (False, True))
        return float(terms + max(0.0, stems - STEM_WEIGHT * self.chance * words)), len(hits)

    def score(self, severity: float) -> float:
        return self.rates[int(np.searchsorted(CLASSES, severity, side="right")) - 1]


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, toxic, clean): in how many different contexts (word and the one before it) texts of either label use it.

    Time is linear in the length of the texts: repeats fall out in the grouping."""
    words = sample.select("label", F.expr(r"regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+', 0)").alias("w"))
    pairs = words.select("label", F.explode(F.transform("w", lambda x, i: F.struct(x.alias("term"), F.when(i > 0, F.xxhash64(F.get("w", i - 1))).otherwise(F.lit(0)).alias("before")))).alias("p"))
    seen = pairs.groupBy("p.term", "p.before").agg(F.max("label").alias("toxic"), F.max(1 - F.col("label")).alias("clean"))
    return seen.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn(sample: DataFrame) -> ToxicityModel:
    """Model from a bounded ``sample(id, text, label)``, which bounds the lexicon too: no term or stem is cut."""
    spark = sample.sparkSession
    small_batches(spark)
    sample = stage(sample, "toxic")
    counts = stage(term_counts(sample), "terms")
    totals = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    share = (totals[0] or 0) / max(1, (totals[0] or 0) + (totals[1] or 0))

    def chosen(table: DataFrame, least: int, precision: float) -> DataFrame:
        n = F.col("toxic") + F.col("clean")
        far = (F.col("toxic") - share * n) >= DEVIATIONS * F.sqrt(n * share * (1 - share))
        return table.where((F.length("term") >= STEM_LENGTHS[0]) & (F.col("toxic") >= least) & (F.col("toxic") >= precision * n) & far)

    low, high = STEM_LENGTHS
    begins = counts.where(F.length("term") > low).select(F.explode(F.expr(f"transform(sequence({low}, least({high}, length(term) - 1)), k -> left(term, k))")).alias("stem"), "term", "toxic", "clean")
    # a stem stands for several words
    begins = begins.groupBy(F.col("stem").alias("term")).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count("*").alias("words"), F.max("toxic").alias("most"))
    found = chosen(begins, STEM_SUPPORT, STEM_PRECISION).where("words >= 4 and most <= 0.5 * toxic").collect()
    stems: list[str] = []
    for term in sorted((r.term for r in found), key=lambda t: (len(t), t)):
        if not any(term.startswith(x) for x in stems):
            stems.append(term)
    terms = [r.term for r in chosen(counts, SUPPORT, PRECISION).orderBy(F.desc("toxic"), "term").collect() if not any(r.term.startswith(x) for x in stems)]
    shared = spark.sparkContext.broadcast(ToxicityModel(terms, set()))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[(shared.value.automaton.match(t) or (0,))[0] > 0 for t in pdf["term"]]]

    # within a few edits of a bounded lexicon there are boundedly many words
    clean = {r.term for r in counts.where("clean > toxic").select("term").mapInPandas(near, "term string").collect()} if terms else set()
    by_chance = sum(r.clean for r in found if r.term in stems) / max(1, totals[1] or 0)
    model = ToxicityModel(terms, clean - set(terms), stems, by_chance)
    fitted = spark.sparkContext.broadcast(model)

    def classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.searchsorted(CLASSES, [fitted.value.severity(t)[0] for t in pdf["text"]], side="right") - 1
            yield pd.DataFrame({"class": at, "label": pdf["label"]})

    seen = {r["class"]: (r.n, r.toxic) for r in sample.select("text", "label").mapInPandas(classes, "class int, label int").groupBy("class").agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).collect()}
    model.rates = calibrate([seen.get(k, (0, 0)) for k in range(len(CLASSES))])
    return model


def calibrate(seen: list[tuple[int, int]]) -> list[float]:
    """Rate of each class from (rows, toxic rows), drawn to a prior that rises with severity, and never falling."""
    prior = [0.02, *(c / (c + 0.35) for c in CLASSES[1:])]
    blocks = [[(toxic + _PRIOR_ROWS * p) / (n + _PRIOR_ROWS), n + _PRIOR_ROWS, 1] for (n, toxic), p in zip(seen, prior, strict=True)]
    merged: list[list[float]] = []
    for b in blocks:
        merged.append(b)
        while len(merged) > 1 and merged[-2][0] > merged[-1][0]:
            r, n, k = merged.pop()
            r0, n0, k0 = merged[-1]
            merged[-1] = [(r * n + r0 * n0) / (n + n0), n + n0, k + k0]
    return [float(r) for r, _, k in merged for _ in range(int(k))]


def score_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, held_out, score, predicted, severity, hits) for every row of ``docs``, from its whole text.

    Null and empty texts have no hits and get the lowest score; a text of any length is scored whole; repeated rows
    stay repeated; extra columns are left behind; an empty table gives an empty result; without labels the lexicon is
    empty and every score is the lowest prior.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(labelled_sample(docs, labels, label_col, id_col, text_col, rows)))

    @F.pandas_udf("score double, severity double, hits int")
    def score(texts: pd.Series) -> pd.DataFrame:
        m, out = model.value, []
        for t in texts:
            severity, hits = m.severity(t)
            out.append((m.score(severity), severity, hits))
        return pd.DataFrame(out, columns=["score", "severity", "hits"])

    found = need(docs, id_col, text_col)
    found = found.select(F.col(f"`{id_col}`"), held_out(F.col(f"`{id_col}`")).alias("held_out"), score(F.col(f"`{text_col}`").cast("string")).alias("_s"))
    return found.select(f"`{id_col}`", "held_out", "_s.score", (F.col("_s.score") >= threshold).cast("int").alias("predicted"), "_s.severity", "_s.hits")
