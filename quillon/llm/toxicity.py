"""Toxicity: Levenshtein automata intersected with a trie of a learned lexicon.

The lexicon holds whole words and stems that tell toxic documents from others; it is learned
from counts over a bounded sample of labelled rows, chosen greedily by the toxic documents that
each entry explains. All entries lie in one trie. The product of the trie and the entries'
Levenshtein automata is made deterministic state by state as the text needs it, and each
distinct word of a block runs through it once, all words at a time. So misspelled terms are
found at the cost of a table lookup for each letter.

A misspelling counts only where it tells something: terms that clean texts of the sample hold
near misses of are matched exactly, and words that clean texts hold are no misspellings. What is
left counts as MISSPELT of an exact hit.

Each hit gets a context score: hits inside quotation marks, or close to a word of reporting,
count as quotation, others as abuse; hits that stand close together strengthen each other. A
logistic regression over these sums gives the document's score.

Edits are of characters: a missing accent is one. The lexicon holds ENTRIES words at most, those
that explain most toxic documents; the model's size is bounded, whatever the corpus.

Defined results: null and empty texts have no hits and get the score of those; without labels
of both classes every score is the labels' smoothed mean; a null doc_id is scored and never
held out; repeated rows are scored alike and learned once; an empty table gives no rows; other
columns pass unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, Words, blocks, labelled_rows, must_be_new, text_buffers, written
from quillon.llm.linear import ridge_logistic, sigmoid

#: Labelled rows to learn from, entries of the lexicon, and candidates for it, at most.
SAMPLE, ENTRIES, CANDIDATES = 20_000, 400, 4000
#: Near misses of clean texts that the model knows, at most.
KNOWN = 20_000
#: Characters of a stem.
STEM = (4, 8)
#: What a misspelt hit counts, and clean texts that may hold a near miss of a term.
MISSPELT, MISSES = 0.7, 1
#: Words on either side that make up a hit's context.
WINDOW = 6

#: Words that report what someone else said.
REPORTING = "said says quote quoted called calls wrote word words dijo llamó palabra sagte nannte wort a dit appelé mot".split()


def edits_allowed(term: str) -> int:
    """Edits that a misspelling of this term may have."""
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


def fold(raw: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the Latin-1 capitals; Latin-1 and general punctuation as blanks."""
    text = LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) + 1
    text[lead[(raw[lead] <= 0x9E) & (raw[lead] != 0x97)]] += 32
    lead = np.flatnonzero(raw[:-1] == 0xC2)
    lead = lead[raw[lead + 1] >= 0xA0]
    text[lead] = text[lead + 1] = 0x20
    lead = np.flatnonzero(raw[:-2] == 0xE2)
    lead = lead[(raw[lead + 1] == 0x80) | (raw[lead + 1] == 0x81)]
    text[lead] = text[lead + 1] = text[lead + 2] = 0x20
    return text


def code_points(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words text[start:end] of UTF-8 as (code points in a row, each word's start, its end)."""
    size = ends - starts
    cut = np.cumsum(size) - size
    raw = text[np.repeat(starts - cut, size) + np.arange(int(size.sum()))].astype(np.int64)
    lead = (raw & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    points, raw = raw[at], np.append(raw, [0, 0, 0])
    more = (points >= 0xC0).astype(np.int64) + (points >= 0xE0) + (points >= 0xF0)
    points = np.where(more > 0, points & (0x3F >> more), points)
    for k in (1, 2, 3):
        use = more >= k
        points[use] = points[use] << 6 | (raw[at[use] + k] & 0x3F)
    before = np.concatenate([[0], np.cumsum(lead)])
    return points, before[cut], before[cut + size]


class Automaton:
    """Deterministic product of a trie and Levenshtein automata, built as it is used.

    A state is a set of (trie node, edits left); MISS has none. Stems accept all that follows.
    """

    MISS = 0
    EXACT, STEMMED, FUZZY = 3, 2, 1

    def __init__(self, words: list[str], stems: list[str], exact: frozenset[str] = frozenset()):
        """exact: words and stems that are matched as they are."""
        self.child: list[dict[int, int]] = []
        self.ends: list[tuple[bool, bool]] = []  # a word, a stem ends at this node
        roots: dict[int, int] = {}
        for term, stem in [(w, False) for w in words] + [(s, True) for s in stems]:
            # Fuzzy stems would match too much by chance, as they accept any ending.
            budget = 0 if stem and len(term) < 7 or term in exact else edits_allowed(term)
            node = roots.setdefault(budget, self._node()) if budget not in roots else roots[budget]
            for c in map(ord, term):
                if c not in self.child[node]:
                    self.child[node][c] = self._node()
                node = self.child[node][c]
            word, stemmed = self.ends[node]
            self.ends[node] = (word or not stem, stemmed or stem)
        letters = sorted({c for x in self.child for c in x})
        self.letters = np.array(letters, np.int64)  # code points; letter 0 occurs in no term
        self.alphabet = [-1, *letters]
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.table = np.zeros((0, len(self.alphabet)), np.int64)
        self.accept = np.zeros(0, np.int64)
        self._state(frozenset())
        self.start = self._state(self._closure({(node, budget, budget) for budget, node in roots.items()}))

    def _node(self) -> int:
        self.child.append({})
        self.ends.append((False, False))
        return len(self.child) - 1

    def _closure(self, items: set) -> frozenset:
        """With the letters that the text may lack; of equal nodes the one with most edits left."""
        todo, best = list(items), {}
        while todo:
            node, left, budget = todo.pop()
            if best.get((node, budget), -1) >= left:
                continue
            best[node, budget] = left
            if left and node >= 0:
                todo += [(n, left - 1, budget) for n in self.child[node].values()]
        return frozenset((node, left, budget) for (node, budget), left in best.items())

    def _state(self, items: frozenset) -> int:
        if items not in self.states:
            self.states[items] = len(self.members)
            self.members.append(items)
            grade = 0
            for node, left, budget in items:
                if node < 0:  # a stem is behind
                    grade = max(grade, self.STEMMED if left == budget else self.FUZZY)
                    continue
                word, stem = self.ends[node]
                if word:
                    grade = max(grade, self.EXACT if left == budget else self.FUZZY)
                if stem:
                    grade = max(grade, self.STEMMED if left == budget else self.FUZZY)
            self.accept = np.append(self.accept, grade)
            self.table = np.vstack([self.table, np.full((1, len(self.alphabet)), -1 if items else 0)])
        return self.states[items]

    def _step(self, state: int, letter: int) -> int:
        c, out = self.alphabet[letter], set()
        for node, left, budget in self.members[state]:
            if node < 0:
                out.add((node, left, budget))
                continue
            if self.ends[node][1]:
                out.add((-1, left, budget))
            for label, to in self.child[node].items():
                if label == c:
                    out.add((to, left, budget))
                elif left:
                    out.add((to, left - 1, budget))
            if left:
                out.add((node, left - 1, budget))
        return self._state(self._closure(out))

    def run(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Grade of each word: EXACT, STEMMED, FUZZY, or 0."""
        points, starts, ends = code_points(text, starts, ends)
        place = np.searchsorted(self.letters, points)
        letters = np.where(np.append(self.letters, -1)[place] == points, place + 1, 0)
        state = np.full(len(starts), self.start)
        alive, at = np.arange(len(starts)), 0
        while len(alive):
            alive = alive[starts[alive] + at < ends[alive]]
            now, letter = state[alive], letters[starts[alive] + at]
            to = self.table[now, letter]
            if (new := to < 0).any():
                width = len(self.alphabet)
                for pair in np.unique(now[new] * width + letter[new]).tolist():
                    target = self._step(*divmod(pair, width))
                    self.table[divmod(pair, width)] = target
                to = self.table[now, letter]
            state[alive] = to
            # A state that maps to itself whatever follows needs no more letters.
            alive = alive[to != self.MISS]
            at += 1
            if at > 64:  # longer than any term with its edits: only stems could go on
                alive = alive[self.accept[state[alive]] == 0]
        return self.accept[state]


FEATURES = ("abuse", "abuse_many", "stem", "stem_many", "quoted", "close", "length")


@dataclass(frozen=True)
class Lexicon:
    """Whole words and stems, those of them that are matched as they are, and words that are no
    misspellings of any."""

    words: tuple[str, ...]
    stems: tuple[str, ...] = ()
    exact: frozenset[str] = frozenset()
    known: frozenset[str] = frozenset()


@dataclass
class ToxicModel:
    lexicon: Lexicon
    weights: np.ndarray
    intercept: float


_AUTOMATA: dict[Lexicon, tuple[Automaton, np.ndarray]] = {}


def automaton(lexicon: Lexicon) -> tuple[Automaton, np.ndarray]:
    """The worker's automaton for this lexicon and the hashes of the known words; what it has
    built serves later batches."""
    if lexicon not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[lexicon] = Automaton(list(lexicon.words), list(lexicon.stems), lexicon.exact), _hash_of(sorted(lexicon.known))
    return _AUTOMATA[lexicon]


def _hash_of(terms: list[str]) -> np.ndarray:
    raw, offsets = text_buffers(pa.array(terms, pa.string()))
    return Words(raw, offsets).hash


def _quote_depth(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True at each byte that stands between a pair of quotation marks on one line."""
    size = len(text)
    straight = text == 0x22
    # Typographic marks: E2 80 9C/9D/9E, and C2 AB/BB.
    mark = straight.copy()
    if size > 2:
        mark[:-2] |= (text[:-2] == 0xE2) & (text[1:-1] == 0x80) & (text[2:] >= 0x9C) & (text[2:] <= 0x9F)
        mark[:-1] |= (text[:-1] == 0xC2) & ((text[1:] == 0xAB) | (text[1:] == 0xBB))
    if not mark.any():
        return np.zeros(size, bool)
    begin = np.zeros(size + 1, bool)
    begin[offsets] = True
    begin[1:] |= text == 0x0A
    line = np.cumsum(begin[:size])
    seen = np.cumsum(mark)
    first = np.searchsorted(line, line, side="left")
    before = seen - np.where(first > 0, seen[np.maximum(first - 1, 0)], 0)
    last = np.searchsorted(line, line, side="right") - 1
    total = seen[last] - np.where(first > 0, seen[np.maximum(first - 1, 0)], 0)
    return (before % 2 == 1) & (before < total)


def graded(found: Words, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, the distinct word of each word, grade of each distinct word)."""
    distinct, first, inverse = np.unique(found.hash, return_index=True, return_inverse=True)
    machine, known = automaton(lexicon)
    grades = machine.run(found.text, found.starts[first], found.ends[first])
    if len(known):
        grades[(grades == Automaton.FUZZY) & np.isin(distinct, known)] = 0
    return distinct, inverse, grades


def features(raw: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(offsets) - 1
    found = Words(fold(raw), offsets)
    distinct, inverse, grades = graded(found, lexicon)
    hit = np.flatnonzero(grades[inverse] > 0)
    grade = grades[inverse[hit]]
    doc = np.searchsorted(found.cuts, hit, side="right") - 1
    quoted = _quote_depth(raw, offsets)[found.starts[hit]] if len(hit) else np.zeros(0, bool)
    if len(hit):
        reporting = np.concatenate([[0], np.cumsum(np.isin(distinct, _hash_of(REPORTING))[inverse])])
        low = np.maximum(hit - WINDOW // 2, found.cuts[doc])
        told = reporting[hit] > reporting[low]
        # A word of reporting makes a quotation only together with a colon.
        colons = np.concatenate([[0], np.cumsum(raw == 0x3A)])
        quoted |= told & (colons[found.starts[hit]] > colons[found.ends[low] - 1])
    plain = ~quoted
    close = np.zeros(len(hit), bool)
    close[1:] = (hit[1:] - hit[:-1] <= WINDOW) & (doc[1:] == doc[:-1])
    weight = np.where(grade == Automaton.FUZZY, MISSPELT, 1.0)
    total = lambda which: np.bincount(doc[which], weight[which], n)
    abuse, stem = total(plain & (grade != Automaton.STEMMED)), total(plain & (grade == Automaton.STEMMED))
    return np.column_stack([np.minimum(abuse, 1), np.log1p(abuse), np.minimum(stem, 1), np.log1p(stem), np.log1p(total(quoted)), np.log1p(total(close & plain)), np.log1p(found.count) / 10])


def _evidence(sample: DataFrame) -> DataFrame:
    """term, stem, toxic, clean: distinct texts of either label that hold the word or stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, bool], list[int]] = {}

        def out() -> pa.RecordBatch:
            keys, values = list(sums), list(sums.values())
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([v[1] for v in values], pa.int64()), pa.array([v[0] for v in values], pa.int64())], ["term", "stem", "toxic", "clean"])

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                for key in terms_of(text):
                    sums.setdefault(key, [0, 0])[label] += 1
                if len(sums) > 200_000:
                    yield out()
                    sums.clear()
        yield out()

    parts = sample.mapInArrow(run, "term string, stem boolean, toxic long, clean long")
    return parts.groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def terms_of(text: str | None) -> set[tuple[str, bool]]:
    raw, offsets = text_buffers(pa.array([text], pa.string()))
    found = Words(fold(raw), offsets)
    out: set[tuple[str, bool]] = set()
    for word in {w.decode("utf-8") for w in (found.phrase(0, len(found.hash)) if len(found.hash) else [])}:
        out.add((word, False))
        for k in range(STEM[0], min(STEM[1], len(word) - 1) + 1):
            out.add((word[:k], True))
    return out


def near_misses(sample: DataFrame, lexicon: Lexicon) -> dict[str, int]:
    """Words of clean texts within a term's edits, and the texts that hold each: a few for each
    entry of the lexicon, whatever the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            for i, j in blocks(offsets):
                found = Words(fold(raw[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i])
                _, inverse, grades = graded(found, lexicon)
                hit = np.flatnonzero(grades[inverse] == Automaton.FUZZY)
                doc = np.searchsorted(found.cuts, hit, side="right") - 1
                once = {(d, found.phrase(h, 1)[0].decode("utf-8", "replace")) for d, h in zip(doc.tolist(), hit.tolist())}
                words = sorted(w for _, w in once)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], ["word"])

    rows = sample.filter("label = 0").select("text").mapInArrow(run, "word string").groupBy("word").agg(F.count("*").alias("n"))
    return {r["word"]: r["n"] for r in rows.orderBy(F.desc("n"), "word").limit(KNOWN).collect()}


def within(a: str, b: str, most: int) -> bool:
    """At most so many edits turn a into b."""
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        below = [i]
        for j, d in enumerate(b, 1):
            below.append(min(row[j] + 1, below[-1] + 1, row[j - 1] + (c != d)))
        row = below
    return row[-1] <= most


def with_misspellings(sample: DataFrame, words: list[str], stems: list[str]) -> Lexicon:
    """The lexicon, with the terms whose near misses are common matched as they are."""
    draft = Lexicon(tuple(words), tuple(stems))
    misses = near_misses(sample, draft)
    exact = set()
    for term in (*words, *stems):
        near = [n for w, n in misses.items() if abs(len(w) - len(term)) <= 2 and within(w, term, edits_allowed(term)) or term in stems and w.startswith(term[:3])]
        if sum(near) > MISSES:
            exact.add(term)
    return Lexicon(draft.words, draft.stems, frozenset(exact), frozenset(misses))


def learn_lexicon(sample: DataFrame) -> tuple[list[str], list[str]]:
    """Whole words and stems, greedily by the toxic texts that each explains alone."""
    pure = (F.col("toxic") >= 3) & ((F.col("toxic") + 0.1) / (F.col("toxic") + F.col("clean") + 0.2) >= 0.95)
    rows = _evidence(sample).filter(pure).orderBy(F.desc("toxic"), F.length("term"), "term", "stem").limit(CANDIDATES).collect()
    known = {(r["term"], r["stem"]): r["toxic"] for r in rows}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {k: i for i, k in enumerate(known)}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(number[k] for k in terms_of(t) if k in number) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], ["has"])

    # At most SAMPLE rows, and only those with the rarer label.
    texts = [set(r["has"]) for r in sample.filter("label = 1").mapInArrow(run, "has array<int>").collect()]
    entries, chosen, left = list(known), [], [t for t in texts if t]
    while left and len(chosen) < ENTRIES:
        gain = np.bincount(np.fromiter((i for t in left for i in t), np.int64), minlength=len(entries))
        # Whole words before stems before rarer entries, where they explain as many.
        best = max(range(len(entries)), key=lambda i: (gain[i], not entries[i][1], known[entries[i]], len(entries[i][0])))
        if gain[best] < 2:
            break
        chosen.append(entries[best])
        left = [t for t in left if best not in t]
    # Words that are nearly always toxic and frequent belong to it even if others explain their texts.
    frequent = [e for e in entries if not e[1] and known[e] >= max(20, len(texts) // 50) and not any(e[0].startswith(s) for s, stem in chosen if stem)]
    # In the order of what they explain; the bound takes the last.
    words = list(dict.fromkeys(t for t, stem in [*chosen, *sorted(frequent, key=lambda e: (-known[e], e))] if not stem))
    return sorted(words[:ENTRIES]), sorted({t for t, stem in chosen if stem})


def fit(docs: DataFrame, labels: DataFrame, mod: int = 4, held_out: int = 2, sample: int = SAMPLE) -> ToxicModel:
    rows = written(labelled_rows(docs, labels, "toxic", mod, held_out, sample))
    # Copies of a text are one witness, or their rare words would look toxic.
    single = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.max("label").alias("label"), F.min("doc_id").alias("doc_id"))
    once = written(rows.select("doc_id", "text").join(single.select("doc_id", "label"), "doc_id"))
    lexicon = with_misspellings(once, *learn_lexicon(once))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            for i, j in blocks(offsets):
                x = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lexicon)
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(i, j - i), *(pa.array(c) for c in x.T)], ["label", *FEATURES])

    got = once.select("label", "text").mapInArrow(run, "label int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    x, y = got[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), got["label"].to_numpy(float)
    if len(np.unique(y)) < 2:
        mean = (y.sum() + 1) / (len(y) + 2)
        return ToxicModel(lexicon, np.zeros(len(FEATURES)), float(np.log(mean / (1 - mean))))
    order = np.lexsort((*x.T, y))  # sums don't depend on how rows arrive
    weights, intercept = ridge_logistic(x[order], y[order], l2=1e-4)
    return ToxicModel(lexicon, weights, intercept)


def scored(docs: DataFrame, model: ToxicModel, column: str = "score") -> DataFrame:
    """docs with the score as a further column, whose name must be new."""
    must_be_new([column], docs.columns)
    schema = docs.select("*", F.lit(0.0).alias(column)).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)  # ENTRIES bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            raw, offsets = text_buffers(batch.column(batch.schema.names.index("text")))
            for i, j in blocks(offsets):
                x = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], m.lexicon)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sigmoid(x @ m.weights + m.intercept))], [*part.schema.names, column])

    return docs.mapInArrow(run, schema)
