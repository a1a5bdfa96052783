"""Toxicity: a lexicon matched with edit distance, weighed by the context of each match.

The lexicon is a trie. A Levenshtein automaton over it (sets of trie nodes with the
edits spent; swapped neighbours are one edit) is made deterministic as words are
read, and its transitions are kept: a word is judged by one table step a character.
A match's context window decides whether it is quoted (within quotation marks, near
verbs of saying, or mentioned as a word) or addressed to somebody. A document's sums
over its matches give the score by a logistic model; what is quoted counts for less.

The lexicon's fixed part is a list of common insults. The training rows add whole
words that are much more frequent in the toxic documents of a bounded sample
(``sample`` rows a class). The automaton matches these with edits too: a word has
the largest allowance, up to that of its length, with which its matches in the sample
still mark toxic documents. The logistic model is fitted on the same sample.

Defined cases: a null or empty text has no match and the score of such texts; a text
of any length is read whole; null labels and null ids of labels are ignored, and
repeated labels of a document count as their largest; without labels of both classes
the model keeps its default weights; of equally near terms the one that is first in
order is the match, and of equally good words of the sample that with the lower
letters is chosen; repeated documents each give a row; an empty table gives an empty
result; other columns are passed on by ``judge``, and replaced if they have its
result's name; ``digest`` reads ``doc_id`` and ``text`` only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm._base import fold, materialize, release

# Common insults in four languages.
LEXICON = (
    "idiot idiots idiotic moron moronic stupid stupidity dumb imbecile loser losers pathetic worthless disgusting trash "
    "garbage scum clown retard bastard bitch asshole fool jerk creep freak vermin filth "
    "dummkopf trottel abschaum versager arschloch schwachkopf widerlich wertlos "
    "imbécile abruti crétin ordure minable dégoûtant connard salaud "
    "imbécil estúpido estúpida basura asqueroso patético escoria perdedor cabrón pendejo"
).split()
# Words near an entry which aren't misspellings of it.
INNOCENT = frozenset("closer looser loose lower loses lose losing crash thrash brash trashy clowns crown clone blown down fools food tool cool pool feel free freaky creek crepe jerky berserk idiom idioms dump dumber numb thumb bastards parch patch moon morons macron retire regard reward scrum".split())
# Characters that stand for letters.
LOOKS = str.maketrans("013457@$!", "oieastasi")
# Words of a context.
SAYING = frozenset("said says say wrote writes called calls quoted quote quotes word words term insult slur sagte schrieb nannte wort dit écrit appelé mot dijo escribió llamó palabra".split())
ADDRESS = frozenset("you your youre u ur du dein ihr euch tu vous toi tes tú eres usted".split())
QUOTES = re.compile("[\"“”„«»]")
TOKEN = re.compile(r"[^\W_](?:[\w@$!*]*[^\W_])?")
WINDOW = 8
#: Of learned words: the least letters, the number of candidates and their least log ratio of
#: toxic to other documents, and the least such ratio of what the automaton matches with them.
LETTERS, TERMS, RATIO, MATCHED = 4, 400, 1.8, 2.3


def allowance(term: str) -> int:
    """The edits that a term of the fixed lexicon allows."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The words within an edit distance of a lexicon: ``find(word)`` gives (term, edits) or None.

    Edits are letters that are missing, added, replaced, or swapped with the next one.
    A state is a set of (node, edits); besides the trie's nodes, a negative number
    stands for a node of which the first of two swapped letters is still to come.
    """

    def __init__(self, terms, edits=allowance, most: int = 300_000):
        self.next: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for term in sorted(set(terms)):
            node = 0
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.term.append(None)
                node = self.next[node][c]
            self.term[node] = term
        self.alphabet = {c for n in self.next for c in n}
        self.edits = edits
        # a node can only be reached with as many edits as the longest allowance below it
        self.allow = [0] * len(self.next)
        for node in range(len(self.next) - 1, -1, -1):
            own = edits(self.term[node]) if self.term[node] else 0
            self.allow[node] = max([own, *(self.allow[c] for c in self.next[node].values())])
        self.swaps: dict[tuple[int, str], int] = {}
        self.swap_of: list[tuple[int, str]] = []
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.accept: list[tuple[str, int] | None] = []
        self.start = self._state({0: 0})
        self.known: dict[str, tuple[str, int] | None] = {}
        self.most = most

    def _state(self, nodes: dict[int, int]) -> int:
        """The state of the nodes with their edits, and of those that missing letters lead to; -1 if there is none."""
        nodes = {n: e for n, e in nodes.items() if e <= self.allow[n if n >= 0 else self.swap_of[-1 - n][0]]}
        queue = [(n, e) for n, e in nodes.items() if n >= 0]
        while queue:
            node, e = queue.pop()
            for child in self.next[node].values():
                if e + 1 <= self.allow[child] and nodes.get(child, 99) > e + 1:
                    nodes[child] = e + 1
                    queue.append((child, e + 1))
        if not nodes:
            return -1
        key = tuple(sorted(nodes.items()))
        if key not in self.states:
            ends = [(e, self.term[n]) for n, e in key if n >= 0 and self.term[n] and e <= self.edits(self.term[n])]
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.accept.append((min(ends)[1], min(ends)[0]) if ends else None)
        return self.states[key]

    def _swapped(self, node: int, c: str) -> int:
        """The number of ``node`` of which ``c`` is still to come."""
        if (node, c) not in self.swaps:
            self.swap_of.append((node, c))
            self.swaps[node, c] = -len(self.swap_of)
        return self.swaps[node, c]

    def _step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if out.get(node, 99) > e:
                out[node] = e

        for node, e in self.sets[state]:
            if node < 0:
                to, wanted = self.swap_of[-1 - node]
                if c == wanted:
                    reach(to, e)
                continue
            reach(node, e + 1)
            for x, child in self.next[node].items():
                reach(child, e + (c != x))
                if c != x and c in self.next[child] and e + 1 <= self.allow[self.next[child][c]]:
                    reach(self._swapped(self.next[child][c], x), e + 1)
        to = self.steps[state][c] = self._state(out)
        return to

    def find(self, word: str) -> tuple[str, int] | None:
        try:
            return self.known[word]
        except KeyError:
            pass
        found = None
        if word not in INNOCENT:
            state = self.start
            for c in word:
                c = c if c in self.alphabet else "\0"
                to = self.steps[state].get(c)
                state = self._step(state, c) if to is None else to
                if state < 0:
                    break
            found = self.accept[state] if state >= 0 else None
        if len(self.known) >= self.most:
            self.known.clear()
        self.known[word] = found
        return found


@dataclass
class Match:
    start: int
    end: int
    term: str
    edits: int
    quoted: float
    addressed: float


@dataclass
class Scorer:
    """A lexicon with weights, and the logistic model over a document's features."""

    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(LEXICON, 1.0))
    model: tuple[float, ...] = (-2.5, 2.0, 0.3, 0.5, 0.5, 0.5)
    #: Edits of terms that don't have the allowance of their length.
    edits: dict[str, int] = field(default_factory=dict)
    _automaton: Automaton | None = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def matches(self, text: str | None) -> list[Match]:
        text = (text or "").lower()
        if self._automaton is None:
            self._automaton = Automaton(list(self.weights), lambda t: self.edits.get(t, allowance(t)))
        find = self._automaton.find
        tokens = TOKEN.findall(text)
        plain = {t: find(t.translate(LOOKS) if not t.isalpha() and not t.isdigit() else t) for t in set(tokens)}
        if not any(plain.values()):
            return []
        out, where = [], [m.span() for m in TOKEN.finditer(text)]
        for k, t in enumerate(tokens):
            if plain[t]:
                term, edits = plain[t]
                a, b = where[k]
                first, last = max(0, k - WINDOW), min(len(tokens), k + WINDOW + 1)
                before, after = text[where[first][0] - 1 if where[first][0] else 0 : a], text[b : where[last - 1][1] + 2]
                marks = len(QUOTES.findall(before)) % 2 == 1 and QUOTES.search(after) is not None
                quoted = min(1.0, 0.7 * marks + 0.4 * any(w in SAYING for w in tokens[first:last]))
                out.append(Match(a, b, term, edits, quoted, float(any(w in ADDRESS for w in tokens[max(0, k - 4) : k + 5]))))
        return out

    def features(self, text: str | None, found: list[Match] | None = None) -> list[float]:
        """1, abuse, quotation, address, distinct terms, density; of the text's matches, if they are at hand."""
        found = self.matches(text) if found is None else found
        abuse = quoted = address = 0.0
        terms: dict[str, float] = {}
        for m in found:
            w = self.weights[m.term] * (1 - 0.2 * m.edits)
            abuse, quoted, address = abuse + w * (1 - m.quoted), quoted + w * m.quoted, address + w * m.addressed * (1 - m.quoted)
            terms[m.term] = max(terms.get(m.term, 0.0), 1 - m.quoted)
        words = 1 + text.count(" ") if text else 1
        return [1.0, *(float(np.log1p(v)) for v in (abuse, quoted, address, sum(terms.values()), 100 * abuse / words))]

    def score(self, x: list[float]) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.model, x), -40, 40))))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.1, steps: int = 40) -> np.ndarray:
    """Weights by Newton's method, with a ridge on all but the first; features of evidence keep weights of 0 or more."""
    free, w = np.ones(x.shape[1], bool), np.zeros(x.shape[1])
    while True:
        w = np.zeros(x.shape[1])
        own, ridge = x[:, free], np.diag(l2 * (np.flatnonzero(free) > 0))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(own @ w[free], -30, 30)))
            h = (own * (p * (1 - p))[:, None]).T @ own + ridge + 1e-6 * np.eye(own.shape[1])
            step = np.linalg.solve(h, own.T @ (p - y) + ridge @ w[free])
            w[free] -= step
            if np.abs(step).max() < 1e-8:
                break
        bad = free & (w < 0) & (np.arange(len(w)) != 0) & (np.arange(len(w)) != 2)
        if not bad.any():
            return w
        free &= ~bad


def chosen(counts: dict[tuple[str, int], tuple[int, int]], n_toxic: int, n_clean: int) -> tuple[dict[str, float], dict[str, int]]:
    """(weights, edits) of learned words, from the toxic and the other documents in which each was met with so many edits at the nearest."""
    weights, edits = {}, {}
    for word in sorted({w for w, _ in counts}):
        for most in range(allowance(word), -1, -1):
            toxic, clean = (sum(counts.get((word, e), (0, 0))[k] for e in range(most + 1)) for k in (0, 1))
            ratio = np.log(max(toxic, 0.1) / n_toxic / ((clean + 1) / n_clean))
            if ratio >= MATCHED and toxic >= max(3, n_toxic / 100):
                weights[word], edits[word] = min(1.0, ratio / 4), most
                break
    return weights, edits


def learn(docs: DataFrame, labels: DataFrame, column: str = "toxic", sample: int = 3000) -> Scorer:
    """Lexicon and model from ``docs`` (doc_id, text) with a label, of which ``sample`` rows a class are read."""
    known = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    known = known.withColumn("u", F.xxhash64("doc_id", F.lit(5)))
    ids = known.filter("y = 1").orderBy("u", "doc_id").limit(sample).unionByName(known.filter("y = 0").orderBy("u", "doc_id").limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id", "y")), "doc_id")  # 2 * sample rows of two numbers
    rows = materialize(rows.dropDuplicates(["doc_id"]), "labelled")
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        return Scorer()
    toxic, clean = F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")

    @F.pandas_udf("array<string>")
    def words(batch: pd.Series) -> pd.Series:
        return pd.Series([sorted(set(TOKEN.findall((t or "").lower()))) for t in batch], dtype=object)

    spread = rows.select("y", F.explode(words("text")).alias("w")).groupBy("w").agg(toxic, clean)
    ratio = F.log((F.col("toxic") / n[1]) / ((F.col("clean") + 1) / n[0]))
    found = spread.filter((F.length("w") >= LETTERS) & ~F.col("w").isin(*LEXICON) & (F.col("toxic") >= max(3, n[1] / 100)) & (ratio >= RATIO))
    candidates = [r["w"] for r in found.orderBy((F.col("toxic") * ratio).desc(), "w").limit(TERMS).collect()]
    probe = Scorer(dict.fromkeys([*LEXICON, *candidates], 1.0))

    @F.pandas_udf("array<struct<w:string,edits:int>>")
    def met(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for t in batch:
                near: dict[str, int] = {}
                for m in probe.matches(t):
                    near[m.term] = min(m.edits, near.get(m.term, m.edits))
                out.append([{"w": w, "edits": e} for w, e in sorted(near.items())])
            yield pd.Series(out, dtype=object)

    meetings = rows.select("y", F.explode(met("text")).alias("m")).filter(~F.col("m.w").isin(*LEXICON)).groupBy("m.w", "m.edits").agg(toxic, clean)
    weights, edits = chosen({(r["w"], r["edits"]): (r["toxic"], r["clean"]) for r in meetings.collect()}, n[1], n[0])
    scorer = Scorer(dict.fromkeys(LEXICON, 1.0) | weights, edits=edits)

    @F.pandas_udf("array<double>")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([scorer.features(t) for t in batch], dtype=object)

    got = rows.select("y", measure("text").alias("x")).collect()
    y = np.array([r["y"] for r in got], float)
    w = logistic(np.array([r["x"] for r in got]), y)
    # a class is sampled at its own rate: the constant allows for it
    whole = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    w[0] += np.log((whole[1] / n[1]) / (whole[0] / n[0]))
    return Scorer(scorer.weights, tuple(w), edits)


def judge(docs: DataFrame, scorer: Scorer, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with the struct ``into``: score, and the matches with their spans, terms, edits and contexts."""

    @F.pandas_udf("score double, matches array<struct<start:int,end:int,term:string,edits:int,quoted:double,addressed:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [scorer.matches(t) for t in batch]
            yield pd.DataFrame({"score": [scorer.score(scorer.features(t, m)) for t, m in zip(batch, found, strict=True)], "matches": [[vars(x) for x in m] for m in found]})
        release()

    return docs.withColumn(into, run(F.col(text)))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document; learned from the folds 1 to 4 of five."""
    held = fold(F.col("doc_id"), 5) == 0
    scorer = learn(docs.filter(~held), labels.filter(fold(F.col("doc_id"), 5) != 0))
    out = judge(docs.select("doc_id", "text"), scorer).select("doc_id", held.alias("held_out"), "toxicity.score", F.size("toxicity.matches").cast("long").alias("n_matches"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select("doc_id", "held_out", "score", "predicted", "n_matches")
