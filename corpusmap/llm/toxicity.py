"""Toxicity: a learned lexicon, found with Levenshtein automata over its trie, and scores of the context of each hit.

Learning takes a bounded sample of labelled rows. Words and stems that are far more frequent in toxic than in other
texts form the lexicon (at most `max_terms`). A Levenshtein automaton walks the trie of the lexicon, determinised as
words need it, and finds misspelled terms; near words that clean training texts use as well do not count. A hit in
quotation marks or behind a reporting verb counts as quoted, one near a second-person pronoun as aimed at somebody.
A ridge logistic regression over these counts gives the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.llm import work
from corpusmap.llm.texts import one_array, slices, words

PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’…¡¿–—"
OPEN, CLOSE = tuple("\"“„«‘"), tuple("\"”“»’")
LEET = str.maketrans("013457@$!", "oieastasi")
REPORTING = frozenset(
    "said says say called calls calling wrote writes quoted quotes quote quoting word words term sagte schrieb nannte "
    "dit écrit appelé dijo escribió llamó".split()
)
SECOND_PERSON = frozenset("you your you're youre yourself u ur du dich dir dein tu toi vous te tú usted".split())
FEATURES = ("direct", "quoted", "aimed", "misspelled", "distinct", "density", "peak")
CONTEXT = 5


@dataclass(frozen=True)
class Sample:
    """Bounds of what learning takes; scoring has none."""

    max_rows: int = 20_000  # labelled rows, chosen by a hash of their id
    max_terms: int = 400
    max_near_words: int = 20_000
    min_docs: int = 8
    min_lift: float = 6.0
    stem_sizes: tuple[int, ...] = (4, 5, 6, 7, 8)


@dataclass
class Node:
    children: dict[str, "Node"] = field(default_factory=dict)
    term: int = -1
    stem: int = -1


class Automaton:
    """The Levenshtein automaton of a trie: states are sets of (node, edits so far), made when a word first needs one."""

    def __init__(self, terms: list[tuple[int, str, bool]], max_edits: int):
        self.max_edits, self.nodes = max_edits, [Node()]
        for number, word, is_stem in terms:
            at = self.nodes[0]
            for c in word:
                if c not in at.children:
                    at.children[c] = Node()
                at = at.children[c]
            if is_stem:
                at.stem = number
            else:
                at.term = number
        self.ids: dict[frozenset, int] = {}
        self.sets: list[dict] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple[int, int, bool] | None] = []
        self.start = self._state({id(self.nodes[0]): (self.nodes[0], 0)})

    def _state(self, states: dict[int, tuple[Node, int]]) -> int:
        """States hold the fewest edits per node. Skipped letters of a term are taken in at once."""
        todo = list(states.values())
        while todo:
            node, edits = todo.pop()
            if edits < self.max_edits:
                for child in node.children.values():
                    if states.get(id(child), (child, 99))[1] > edits + 1:
                        states[id(child)] = (child, edits + 1)
                        todo.append((child, edits + 1))
        key = frozenset((k, e) for k, (_, e) in states.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(states)
            self.steps.append({})
            ends = [(e, n.term, n.stem) for n, e in states.values() if n.term >= 0 or n.stem >= 0]
            best = min(ends, default=None)
            self.found.append(None if best is None else (best[0], best[1] if best[1] >= 0 else best[2], best[2] >= 0))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        after: dict[int, tuple[Node, int]] = {}

        def reach(node: Node, edits: int) -> None:
            if edits <= self.max_edits and after.get(id(node), (node, 99))[1] > edits:
                after[id(node)] = (node, edits)

        for node, edits in self.sets[state].values():
            reach(node, edits + 1)
            for letter, child in node.children.items():
                reach(child, edits + (letter != c))
        return self._state(after) if after else -1

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, number of the term) of the nearest term; a stem accepts every word that begins with it."""
        state, stem = self.start, None
        for c in word:
            steps = self.steps[state]
            nxt = steps.get(c)
            if nxt is None:
                nxt = steps[c] = self._step(state, c)
            if nxt < 0:
                return stem
            state = nxt
            if (got := self.found[state]) and got[2] and got[0] == 0 and stem is None:
                stem = (0, got[1])
        got = self.found[state]
        return got[:2] if got and (stem is None or got[0] == 0) else stem


class Lexicon:
    """Terms are words; one ending in `*` is a stem. Words of 5 letters may have one edit, of 9 letters two."""

    def __init__(self, terms: list[str], weights: list[float], near_words: frozenset[str] = frozenset()):
        self.terms, self.weights, self.near_words = terms, weights, near_words
        plain = [(i, t.rstrip("*"), t.endswith("*")) for i, t in enumerate(terms)]
        self.automata = [Automaton(plain, 0)]
        for edits, least, most in ((1, 5, 8), (2, 9, 99)):
            if group := [x for x in plain if not x[2] and least <= len(x[1]) <= most]:
                self.automata.append(Automaton(group, edits))

    def find(self, word: str) -> tuple[int, int] | None:
        """(edits, number of the term) of a lower-cased word without punctuation at its ends."""
        if got := self.automata[0].match(word):
            return got
        if len(word) >= 4 and word not in self.near_words:
            for automaton in self.automata[1:]:
                if got := automaton.match(word):
                    return max(1, got[0]), got[1]
            if not word.isalpha():
                plain = word.translate(LEET)
                if plain != word and (got := self.automata[0].match(plain)):
                    return 1, got[1]
        return None


def _clean(flat: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(flat), PUNCTUATION)


def _quoted(window: list[str], at: int, clean: list[str]) -> bool:
    opened = any(w.startswith(OPEN) for w in window[:at + 1])
    closed = any(w.rstrip(".,;:!?").endswith(CLOSE) for w in window[at:])
    return opened and closed or any(w in REPORTING for w in clean[:at])


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """A row of FEATURES for each text."""
    flat, counts = words(texts)
    coded = flat.dictionary_encode()
    cleaned = _clean(coded.dictionary)
    hit_of = [lexicon.find(w) if w else None for w in cleaned.to_pylist()]
    is_hit = np.array([h is not None for h in hit_of], bool)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    hits = np.flatnonzero(is_hit[codes]) if len(codes) else np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    text_of = np.searchsorted(ends, hits, side="right")
    out = np.zeros((len(counts), len(FEATURES)))
    terms: dict[int, set] = {}
    recent: dict[int, list[tuple[int, float]]] = {}
    for at, text in zip(hits.tolist(), text_of.tolist()):
        edits, term = hit_of[codes[at]]
        begin, end = int(ends[text] - counts[text]), int(ends[text])
        a, b = max(begin, at - CONTEXT), min(end, at + CONTEXT + 1)
        window = flat.slice(a, b - a).to_pylist()
        near = [cleaned[int(k)].as_py() for k in codes[a:b]]
        weight = lexicon.weights[term]
        quoted = _quoted(window, at - a, near)
        out[text, 1 if quoted else 0] += weight
        out[text, 2] += not quoted and any(w in SECOND_PERSON for w in near)
        out[text, 3] += edits > 0
        terms.setdefault(text, set()).add(term)
        last = [(p, w) for p, w in recent.get(text, []) if at - p <= 2 * CONTEXT] + [(at, 0.3 if quoted else 1.0)]
        recent[text] = last
        out[text, 6] = max(out[text, 6], sum(w for _, w in last))
    for text, found in terms.items():
        out[text, 4] = len(found)
    out[:, 5] = 100 * (out[:, 0] + out[:, 1]) / np.maximum(counts, 1)
    return np.log1p(out)


def feature_column(text: Column, lexicon: Lexicon) -> Column:
    terms, weights, near_words = lexicon.terms, lexicon.weights, lexicon.near_words

    @F.arrow_udf("array<double>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Lexicon(terms, weights, near_words)
        for texts in batches:
            texts = one_array(texts)
            rows = [features(texts.slice(a, b - a), own) for a, b in slices(texts)]
            flat = np.concatenate(rows).reshape(-1) if rows else np.zeros(0)
            offsets = np.arange(len(texts) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return found(text)


def _term_counts(rows: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """In how many toxic and other texts each word and stem is found."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = (Counter(), Counter())
            for text, toxic in zip(one_array(batch.column("text")), batch.column("toxic").to_pylist()):
                flat, _ = words(pa.array([text.as_py()]))
                seen = {w for w in set(_clean(flat.unique()).to_pylist()) if w}
                seen |= {w[:k] + "*" for w in seen for k in sizes if len(w) > k}
                sums[toxic].update(seen)
            names = list(sums[0].keys() | sums[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *[pa.array([s[w] for w in names], pa.int64()) for s in sums]],
                names=["term", "clean", "toxic"],
            )

    partial = rows.mapInArrow(count, "term string, clean bigint, toxic bigint")
    return partial.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _choose(rows: DataFrame, sample: Sample) -> tuple[list[str], list[float]]:
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return [], []
    lift = ((F.col("toxic") + 0.5) / (n1 + 1)) / ((F.col("clean") + 0.5) / (n0 + 1))
    counts = _term_counts(rows, sample.stem_sizes).where((F.col("toxic") >= sample.min_docs) & (lift >= sample.min_lift))
    # Twice as many as needed, since stems replace the words that they begin.
    top = counts.select("term", "clean", "toxic", F.log(lift).alias("weight")).orderBy(
        F.desc(F.col("weight") * F.col("toxic")), "term").limit(4 * sample.max_terms).collect()
    words_, stems = [r for r in top if not r["term"].endswith("*")], [r for r in top if r["term"].endswith("*")]
    chosen: list = []
    # A stem stands for its words if it is found in more toxic texts than each of them; the shortest such stem stays.
    for stem in sorted(stems, key=lambda r: (len(r["term"]), r["term"])):
        head = stem["term"][:-1]
        longest = max((w["toxic"] for w in words_ if w["term"].startswith(head)), default=0)
        if not any(head.startswith(c["term"][:-1]) for c in chosen) and stem["toxic"] > 1.2 * longest:
            chosen.append(stem)
    heads = tuple(c["term"][:-1] for c in chosen)
    chosen += [w for w in words_ if not (heads and w["term"].startswith(heads))]
    chosen = sorted(chosen, key=lambda r: (-r["weight"] * r["toxic"], r["term"]))[:sample.max_terms]
    best = max((r["weight"] for r in chosen), default=1.0)
    return [r["term"] for r in chosen], [r["weight"] / best for r in chosen]


def _near_words(rows: DataFrame, lexicon: Lexicon, sample: Sample) -> frozenset[str]:
    """Words of clean texts that the automata take for misspelled terms."""
    terms, weights = lexicon.terms, lexicon.weights

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(terms, weights)
        for batch in batches:
            flat, _ = words(one_array(batch.column("text")))
            seen = [w for w in set(_clean(flat.unique()).to_pylist()) if w and (h := own.find(w)) and h[0]]
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string())], names=["word"])

    found = rows.where("toxic = 0").select("text").mapInArrow(near, "word string").distinct()
    return frozenset(r["word"] for r in found.orderBy(F.length("word"), "word").limit(sample.max_near_words).collect())


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights, the constant last, by Newton steps. Without both classes the score is the constant rate."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    w[-1] = math.log(rate / (1 - rate))
    if not len(y) or y.min() == y.max():
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w)),
                               x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: list[float]

    def score(self, text: Column) -> Column:
        found = feature_column(text, self.lexicon)
        z = F.aggregate(F.zip_with(found, F.array(*map(F.lit, self.weights[:-1])), lambda a, b: a * b),
                        F.lit(float(self.weights[-1])), lambda s, v: s + v)
        return 1 / (1 + F.exp(-z))


def learn(docs: DataFrame, labels: DataFrame, sample: Sample = Sample(), id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on the given labelled rows, at most `sample.max_rows` of them.

    Rows of `labels` with a null id or label take no part; of repeated ids the largest label counts.
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(
        F.max(label_col).cast("int").alias("toxic")).select(F.col(id_col).alias("_id"), "toxic")
    some = marked.where(work.hash_share(F.col("_id"), sample.max_rows, marked.count()))
    few = some.orderBy(F.xxhash64("_id"), "_id").limit(sample.max_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # At most max_rows short rows: a bounded broadcast.
    rows = work.save(texts.join(F.broadcast(few), "_id").select("text", "toxic"), "labelled")
    terms, weights = _choose(rows, sample)
    lexicon = Lexicon(terms, weights)
    lexicon = Lexicon(terms, weights, _near_words(rows, lexicon, sample))
    # Repeated documents make no difference to the bound: rows of one id share its label.
    fitted = rows.select(feature_column(F.col("text"), lexicon).alias("x"), "toxic").limit(4 * sample.max_rows).collect()
    x = np.array([r["x"] for r in fitted]).reshape(-1, len(FEATURES))
    return ToxicityModel(lexicon, [float(w) for w in fit_logistic(x, np.array([r["toxic"] for r in fitted], float))])


def toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", into: str = "toxicity") -> DataFrame:
    """Every row with its score from 0 to 1 in the column `into`, which replaces one of that name.

    A null or empty text has no hits and gets the score of a text without any. Rows are scored one by one, so equal
    rows score the same, an empty table stays empty, and other columns stay as they are. Whole texts are read.
    """
    return docs.withColumn(into, model.score(F.col(text_col)))
