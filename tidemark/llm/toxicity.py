"""Toxicity: a lexicon trie, walked by a Levenshtein automaton, finds terms and their misspellings; windows around each hit
tell quotation from abuse; a logistic model on the counts gives the score.

The lexicon has fixed words (`WORDS`) and word beginnings learned from labelled rows: those that hardly occur but in texts
labelled toxic. Both stand in one trie; a beginning fits as soon as it ends, whatever letters follow. Learning reads at most `sample` labelled rows (a documented bound: the smallest hashes of their id). Each
task remembers what it has found for a word, within a bound. Texts are scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.quality_classifier import sampled
from tidemark.llm.shared import grouped, mapped, without

#: Terms of abuse that are sought with misspellings.
WORDS = (
    "idiot", "moron", "stupid", "trash", "scum", "loser", "clown", "worthless", "pathetic", "disgusting", "imbecile", "bastard", "asshole", "bitch", "fuck", "shit", "retard", "slut", "whore", "vermin", "filth", "dumbass",
    "imbécile", "connard", "salope", "ordure", "crétin", "abruti", "trottel", "arschloch", "schwein", "dummkopf", "idioten", "abschaum", "estúpido", "imbécil", "cabrón", "basura", "pendejo", "gilipollas",
)
SAMPLE = 12_000
#: A learned beginning has so many letters, starts a word in so many toxic texts at least, and in others at most this share of them.
STEM_LENGTHS, STEM_TEXTS, STEM_OTHERS = (5, 10), 4, 0.12
#: A doubtful beginning may start a word in so many other texts for each toxic one.
DOUBTFUL_OTHERS = 0.7
#: Letters from which a term may be off by one edit, and by two; letters from which a beginning may be off by one.
ONE_EDIT, TWO_EDITS, BEGINNING_EDIT = 5, 9, 5
#: Words on either side of a hit that form its window.
WINDOW = 6
REMEMBERED = 400_000
#: Letters and digits, with what stands for letters among them.
WORD = re.compile(r"[@$]?[^\W_]+(?:[@$!]+[^\W_]+)*")
PART = re.compile(r"[^\W_]+")
QUOTES = frozenset("\"“”«»„‟‘’‹›")
REPORTING = frozenset("said says wrote called quote quoted quotes word term insult slur means meaning a-dit dit mot terme sagte wort dijo palabra".split())
ADDRESS = frozenset("you your yours u ur youre he she they him her them tu toi vous ton du dich dein ihr euch ustedes usted tú eres".split())
FOLD = str.maketrans("013457@$!", "oieastasi")
FEATURES = 10
#: What a row labelled toxic counts in the fit: such rows are few, and missing one is worse than a false alarm.
TOXIC_WEIGHT = 1.5
ADDED = {"toxic_score": T.DoubleType(), "toxic_predicted": T.IntegerType(), "toxic_terms": T.ArrayType(T.StringType())}


def allowed(length: int) -> int:
    return (length >= ONE_EDIT) + (length >= TWO_EDITS)


class Trie:
    """Words and beginnings by letter. `ends` and `begins` have the edits that the word or the beginning which ends at a node may
    have, or -1; `budget` the most that one through the node may have."""

    def __init__(self, words: Iterable[str], beginnings: Iterable[str] = ()):
        self.next: list[dict[str, int]] = [{}]
        self.ends, self.begins, self.budget = [-1], [-1], [-1]
        for w in words:
            self._add(w, self.ends, allowed(len(w)))
        for w in beginnings:
            self._add(w, self.begins, int(len(w) >= BEGINNING_EDIT))

    def _add(self, word: str, kind: list[int], edits: int) -> None:
        node = 0
        self.budget[0] = max(self.budget[0], edits)
        for c in word:
            if c not in self.next[node]:
                self.next[node][c] = len(self.next)
                self.next.append({})
                for figures in (self.ends, self.begins, self.budget):
                    figures.append(-1)
            node = self.next[node][c]
            self.budget[node] = max(self.budget[node], edits)
        kind[node] = max(kind[node], edits)


class Automaton:
    """The Levenshtein automata of all terms, run over the trie at once and made deterministic as letters come.

    A state is a set of (node, edits): the terms below the node are that many edits from what was read so far. Whether a
    term may have so many is known at its end only, so a branch is dropped when none of its terms may.
    """

    def __init__(self, words: Iterable[str], beginnings: Iterable[str] = (), most_states: int = 50_000):
        self.trie, self.most = Trie(words, beginnings), most_states
        self.clear()

    def clear(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.word_edits: list[int | None] = []
        self.beginning_edits: list[int | None] = []
        self.first = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:  # letters of the term that the text lacks
            node, e = todo.pop()
            if e > self.trie.budget[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            todo += [(n, e + 1) for n in self.trie.next[node].values()]
        key = frozenset(best.items())
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.word_edits.append(min((e for node, e in key if e <= self.trie.ends[node]), default=None))
            self.beginning_edits.append(min((e for node, e in key if e <= self.trie.begins[node]), default=None))
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        pairs = set()
        for node, e in self.sets[state]:
            follow = self.trie.next[node]
            if c in follow:
                pairs.add((follow[c], e))
            pairs |= {(n, e + 1) for n in follow.values()}  # another letter
            pairs.add((node, e + 1))  # a letter too many
        return self._state(pairs)

    def edits(self, word: str) -> int | None:
        """The fewest edits to a word of the lexicon, or None beyond what its length allows."""
        return self.both(word)[0]

    def both(self, word: str) -> tuple[int | None, int | None]:
        """The fewest edits from word to a word of the lexicon, and from a beginning of word to one of the lexicon; None beyond what
        the term's length allows."""
        if len(self.sets) > self.most:
            self.clear()
        state, beginning = self.first, None
        for c in word:
            following = self.moves[state].get(c)
            if following is None:
                following = self.moves[state][c] = self._move(state, c)
            state = following
            e = self.beginning_edits[state]
            if e is not None and (beginning is None or e < beginning):
                beginning = e
            if not self.sets[state]:
                return None, beginning
        return self.word_edits[state], beginning


class Model(NamedTuple):
    words: tuple[str, ...]
    stems: tuple[str, ...]
    doubtful: tuple[str, ...]
    weights: tuple[float, ...]


class Finder:
    """Hits of texts: words with what kind they are (0 exact, 1 misspelled, 2 learned beginning, 3 misspelled beginning, 4 doubtful
    beginning as it stands), remembered by word."""

    def __init__(self, words: tuple[str, ...], stems: tuple[str, ...], doubtful: tuple[str, ...] = ()):
        self.automaton, self.doubtful, self.known = Automaton(words, stems), frozenset(doubtful), {}

    def kind(self, word: str) -> int | None:
        found = self.whole(word)
        if found is None and not word.isalnum():
            found = min((k for x in PART.findall(word) if (k := self.whole(x)) is not None), default=None)
        return found

    def whole(self, word: str) -> int | None:
        plain = word.translate(FOLD) if not word.isalpha() else word
        edits, beginning = self.automaton.both(plain)
        if edits is None and len(plain) > 3 and plain != (single := re.sub(r"(.)\1+", r"\1", plain)):
            edits = 1 if self.automaton.edits(single) == 0 else None  # drawn out letters
        if edits is not None:
            return 0 if edits == 0 and plain == word else 1
        if beginning is not None and self.automaton.both(word)[1] == 0:
            return 2  # as it stands, with digits that were learned
        low, high = STEM_LENGTHS
        if self.doubtful and any(word[:n] in self.doubtful for n in range(low, min(high, len(word)) + 1)):
            return 4
        return None if beginning is None else 3

    def features(self, text: str | None) -> tuple[list[float], list[str]]:
        words = WORD.findall(text.lower()) if text else []
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.kind(w)
        counts, quoted, addressed, terms = [0, 0, 0, 0, 0], 0, 0, []
        if any(known[w] is not None for w in set(words)):
            spans = [m.span() for m in WORD.finditer(text.lower())]
            low = text.lower()
            for i, w in enumerate(words):
                k = known[w]
                if k is None:
                    continue
                counts[k] += 1
                terms.append(w)
                window = words[max(0, i - WINDOW) : i + WINDOW + 1]
                a, b = spans[i]
                quoted += low[max(0, a - 1) : a] in QUOTES and low[b : b + 1] in QUOTES or not REPORTING.isdisjoint(window)
                addressed += not ADDRESS.isdisjoint(window)
        total = sum(counts)
        share = total / max(1, len(words))
        return [float(counts[0] > 0), np.log1p(counts[0]), float(counts[1] > 0), float(counts[2] > 0), np.log1p(counts[2]), quoted / max(1, total), float(addressed > 0) + min(1.0, 20 * share), float(counts[3] > 0), np.log1p(counts[4]), min(1.0, 20 * counts[4] / max(1, len(words)))], terms


def _prefixes(docs: DataFrame) -> DataFrame:
    """Beginnings of a text's distinct words, once a text, as (stem, toxic, texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = STEM_LENGTHS
        for batch in batches:
            for part in grouped(batch, 1):
                stems, ys = [], []
                for y, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = {w[:n] for w in set(WORD.findall((t or "").lower())) for n in range(low, min(high, len(w)) + 1)}
                    stems += found
                    ys += [y] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array(ys, pa.int32())], names=["stem", "y"])

    return mapped(docs, run, "stem string, y int").groupBy("stem").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("others"))


def learned_stems(docs: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """docs: y and text of the sample. Beginnings, and doubtful ones: of each kind one that a shorter one begins is left out."""
    found = _prefixes(docs).where((F.col("toxic") >= STEM_TEXTS) & (F.col("others") <= DOUBTFUL_OTHERS * F.col("toxic")))
    rows = found.collect()  # of a bounded sample

    def shortest(stems: set[str]) -> tuple[str, ...]:
        return tuple(sorted(x for x in stems if not any(x[:n] in stems for n in range(1, len(x)))))

    sure = {r["stem"] for r in rows if r["others"] <= STEM_OTHERS * r["toxic"]}
    return shortest(sure), shortest({r["stem"] for r in rows} - sure)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 25, ridge: float = 0.5, toxic: float = TOXIC_WEIGHT) -> np.ndarray:
    """Weights of a regularised logistic model by Newton's method, the constant last (it isn't regularised). A row of class 1 counts `toxic`
    times."""
    n = np.where(y > 0, toxic, 1.0)
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (n * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Learned from the labelled rows given (leave held-out ones out beforehand). Without rows every text scores 0.5."""
    few = F.broadcast(sampled(labels, label, key, sample))  # at most `sample` rows
    rows = docs.select(key, text).join(few, key).select(F.col(label).cast("int").alias("y"), F.col(text).alias("t"))
    # Three quarters of the sample teach the beginnings, the last one what a hit is worth: else learned beginnings would look surer than they are.
    quarter = F.pmod(F.xxhash64("t"), F.lit(4))
    stems, doubtful = learned_stems(rows.where(quarter > 0))
    words = tuple(sorted(set(WORDS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(words, stems, doubtful)
        for batch in batches:
            for part in grouped(batch, 1):
                got = [finder.features(t)[0] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.list_(pa.float64()))], names=["y", "x"])

    got = mapped(rows.where(quarter == 0), run, "y int, x array<double>").toArrow()
    pairs = sorted(zip(got.column("x").to_pylist(), got.column("y").to_pylist(), strict=True))
    x, y = np.array([p[0] for p in pairs]).reshape(-1, FEATURES), np.array([p[1] for p in pairs], float)
    return Model(words, stems, doubtful, tuple(logistic(x, y)) if len(y) else (0.0,) * (FEATURES + 1))


def scored(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with toxic_score (0 to 1), toxic_predicted (1 from 0.5) and toxic_terms (the words hit, in order, repeated).

    A row out for each row in; null and empty texts get the score of a text without hits; columns of those names are replaced.
    """
    df = without(df, ADDED)
    schema, at = T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in ADDED.items())]), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, w = Finder(model.words, model.stems, model.doubtful), np.array(model.weights)
        for batch in batches:
            for part in grouped(batch, at):
                got = [finder.features(t) for t in part.column(at).to_pylist()]
                z = np.array([g[0] for g in got]).reshape(-1, FEATURES) @ w[:-1] + w[-1]
                scores = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
                new = [pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32()), pa.array([g[1] for g in got], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *ADDED])

    return mapped(df, run, schema)
