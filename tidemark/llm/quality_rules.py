"""Quality rules: statistics of each text, and an isolation forest on them whose cut is calibrated on labelled rows.

Fixed rules reject on their own (`base_failed`). The forest is grown on the statistics of the labelled rows; a text that few
random splits isolate is odd. Each tree draws its few rows, as isolation forests do, from all labelled ones. Which path length is too short is
taken from all of them too: the cut that rejects most bad ones while it rejects at most `SPARED` of the good ones that pass the fixed rules,
by their exact order. Statistics cover whole texts, and every row gets a verdict.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.quality_classifier import labelled
from tidemark.llm.shared import grouped, mapped, settled, without
from tidemark.tables import numbered

TREES, TREE_ROWS = 100, 256
#: Rows of a tree's that are labelled bad. Isolation takes odd rows to be few; where they are a tenth, they hide each other.
ODD_ROWS = 4
#: The largest share of good labelled rows that the forest's cut may reject.
SPARED = 0.002
#: Words, characters and lines that each text is taken to have besides its own, so that short texts aren't odd by chance.
MORE_WORDS, MORE_CHARS, MORE_LINES = 30, 150, 10
SYMBOLS = re.compile(r"[#*$%&|<>]")
SPACE = re.compile(r"[\x20\x09-\x0D]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
N_STATS = 10
ADDED = {
    "n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(), "n_repeat_words": T.LongType(),
    "base_failed": T.BooleanType(), "path_length": T.DoubleType(), "kept": T.BooleanType(),
}


def repeated_words(words: list[str], n: int = 5) -> int:
    """Words in windows of n that are found twice or more, the first time included."""
    if len(words) <= n:
        return 0
    windows = list(zip(*(words[i:] for i in range(n)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    edge = np.zeros(len(words) + 1, np.int32)
    starts = np.array([i for i, w in enumerate(windows) if counts[w] > 1])
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts that the rules name, and the figures that the forest looks at. No text counts as the empty one."""
    text = text or ""
    words = WORDS.findall(text)
    lines = text.split("\n")
    seen: set[str] = set()
    full = dups = 0
    for line in lines:
        if SPACE.sub("", line):
            full += 1
            dups += line in seen
            seen.add(line)
    n, chars = len(words), sum(map(len, words))
    symbols = len(SYMBOLS.findall(text))
    repeats = repeated_words(words)
    per_word, per_char = 1 / (n + MORE_WORDS), 1 / (chars + MORE_CHARS)
    distinct = len(set(words))
    twice = sum(a == b for a, b in zip(words, words[1:], strict=False))
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    shape = [
        min((chars + MORE_CHARS) * per_word, 20.0), symbols * per_char, dups / (full + MORE_LINES), repeats * per_word, twice * per_word, upper * per_word, text.count("!") * per_word,
        text.count("|") * per_word, sum(c.isdigit() for c in text) * per_char if any(c in text for c in "0123456789") else 0.0, distinct / n if n > 200 else 0.8,
    ]
    return [n, chars, symbols, dups, repeats], shape


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


class Forest(NamedTuple):
    """Trees as arrays, one row a tree: the split figure of a node (-1: leaf), its value, its left child (right: the next one),
    and the depth that a leaf stands for. `cut`: texts with a shorter mean path are odd."""

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray
    depth: np.ndarray
    cut: float

    def paths(self, x: np.ndarray) -> np.ndarray:
        """Mean depth of each row over the trees."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, v, c, d in zip(self.feature, self.value, self.child, self.depth, strict=True):
            node = np.zeros(len(x), np.int32)
            while True:
                split = f[node]
                inner = split >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(split, 0)] >= v[node]
                node = np.where(inner, c[node] + right, node)
            total += d[node]
        return total / max(1, len(self.feature))


def expected_depth(n: int) -> float:
    """Mean depth of an unsuccessful search among n keys of a random binary tree."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def tails(part: np.ndarray) -> np.ndarray:
    """Kurtosis of each column, 0 where all its values are equal: large where a few rows lie far from all others."""
    width = part.max(0) - part.min(0)
    off = (part - part.mean(0)) / np.where(width > 0, width, 1.0)
    spread = (off**2).mean(0)
    return np.where(width > 0, (off**4).mean(0) / np.where(width > 0, spread, 1.0) ** 2, 0.0)


def grown(x: np.ndarray, odd: np.ndarray | None = None, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 0) -> Forest:
    """A forest of random splits; each tree's rows are drawn from x, and ODD_ROWS of them from odd, where there are any. A split takes
    a figure with a chance in proportion to its kurtosis among the node's rows, and any value in its range: figures that spread
    evenly isolate no one, and taken as often as the others they would only blur the depths."""
    odd = x[:0] if odd is None else odd
    few = min(ODD_ROWS, len(odd))

    def draw(_: int, rng: np.random.Generator) -> np.ndarray:
        return np.concatenate([x[rng.choice(len(x), min(rows - few, len(x)), replace=False)], odd[rng.choice(len(odd), few, replace=False)] if few else odd])

    return planted(draw, trees if len(x) else 0, min(rows, len(x) + few), seed)


def planted(draw: Callable[[int, np.random.Generator], np.ndarray], trees: int, rows: int, seed: int = 0) -> Forest:
    """A forest of trees that are each grown on the rows that `draw` gives for its number."""
    rng = np.random.default_rng(seed)
    most, size = int(np.ceil(np.log2(max(2, rows)))), 1
    built = []
    for tree in range(trees):
        nodes: list[list[float]] = [[-1, 0.0, 0, 0.0]]
        todo = [(0, draw(tree, rng), 0)]
        while todo:
            at, part, depth = todo.pop()
            low, high = part.min(0), part.max(0)
            open_ = np.flatnonzero(high > low)
            if depth >= most or not len(open_):
                nodes[at] = [-1, 0.0, 0, depth + expected_depth(len(part))]
                continue
            heavy = tails(part[:, open_])
            f = int(rng.choice(open_, p=heavy / heavy.sum()))
            v = rng.uniform(low[f], high[f])
            v = v if v > low[f] else high[f]
            nodes[at] = [f, v, len(nodes), 0.0]
            go = part[:, f] >= v
            todo += [(len(nodes), part[~go], depth + 1), (len(nodes) + 1, part[go], depth + 1)]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
        built.append(nodes)
        size = max(size, len(nodes))
    table = np.array([n + [[-1, 0.0, 0, 0.0]] * (size - len(n)) for n in built]).reshape(len(built), size, 4)
    return Forest(table[:, :, 0].astype(np.int32), table[:, :, 1], table[:, :, 2].astype(np.int32), table[:, :, 3], -1.0)


def calibrated(forest: Forest, x: np.ndarray, good: np.ndarray, spared: float = SPARED) -> Forest:
    """The forest with its cut: no more than the share `spared` of the good rows has shorter paths. Without good rows nothing
    is odd."""
    paths = np.sort(forest.paths(x[good]))
    return forest._replace(cut=float(paths[int(spared * len(paths))]) if len(paths) else -1.0)


def mixed(h: np.ndarray, tree: int) -> np.ndarray:
    """Numbers that a tree's draw goes by, from a row's own (unsigned, 64 bits): as good as random ones, and the same in every run."""
    z = h + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def drawn(rows: DataFrame, n_good: int, n_odd: int, trees: int = TREES, size: int = TREE_ROWS) -> list[np.ndarray]:
    """The rows of each tree, drawn from all rows (h, x, good): those with the least `mixed` number. Tasks send what lies below a bound
    that twice as many and some more are expected to, so the driver gets a number of rows that doesn't grow with the table."""
    few = min(ODD_ROWS, n_odd)
    wanted = {True: size - few, False: few}
    least = {k: np.uint64(min(2**64 - 1, int((2 * wanted[k] + 60) / max(1, n) * 2**64))) for k, n in ((True, n_good), (False, n_odd))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, good = batch.column("h").to_numpy().view(np.uint64), batch.column("good").to_numpy(zero_copy_only=False)
            bound = np.where(good, least[True], least[False])
            for tree in range(trees):
                number = mixed(h, tree)
                at = np.flatnonzero(number <= bound)
                if len(at):
                    part = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tree, np.int32)), pa.array(number[at].view(np.int64)), part.column("x"), part.column("good")], names=["tree", "number", "x", "good"])

    got = rows.select("h", "x", "good").mapInArrow(run, "tree int, number long, x array<double>, good boolean").toArrow()
    tree, number, good = got.column("tree").to_numpy(), got.column("number").to_numpy().view(np.uint64), got.column("good").to_numpy()
    x = np.array(got.column("x").to_pylist()).reshape(-1, N_STATS)
    out = []
    for t in range(trees):
        kinds = []
        for kind, most in wanted.items():
            at = np.flatnonzero((tree == t) & (good == kind))
            kinds.append(x[at[np.lexsort([*x[at].T, number[at]])[:most]]])  # any order of rows gives one forest
        out.append(np.concatenate(kinds))
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> Forest:
    """Grown on draws from the statistics of all labelled rows that pass the fixed rules, and calibrated on all good ones among them. Of
    an id that docs have several times, each row counts; null texts count as empty ones. Without labelled rows no text is odd.

    Texts are not shuffled: statistics are made first, of all rows, and those meet the labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in grouped(batch, 1):
                got = [statistics(t) for t in part.column(1).to_pylist()]
                passing = pa.array([not base_failed(c[0], c[4]) for c, _ in got], pa.bool_()) if got else pa.array([], pa.bool_())
                new = pa.RecordBatch.from_arrays([part.column(0), pa.array([g[1] for g in got], pa.list_(pa.float64()))], names=["key", "x"])
                yield new.filter(passing)

    kind = dict(docs.dtypes)[key]
    known = labelled(labels, label, key).select(F.col(key).alias("key"), (F.col(label) == 1).alias("good"))
    made = mapped(docs.select(key, text).where(F.col(key).isNotNull()), run, f"key {kind}, x array<double>")
    rows = settled(made.join(known, "key").select(F.xxhash64("key", "x").alias("h"), "x", "good"), "statistics")
    n_good, n = rows.agg(F.count_if("good"), F.count(F.lit(1))).first()  # one row
    trees = drawn(rows, n_good, n - n_good) if n_good else []
    forest = planted(lambda tree, _: trees[tree], len(trees), len(trees[0]) if trees else 0)
    if not n_good:
        return forest

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(forest.paths(batch.column("x").flatten().to_numpy().reshape(-1, N_STATS)))], names=["path"])

    lengths = rows.where("good").select("x").mapInArrow(paths, "path double")
    cut = numbered(lengths, "path", name="place").where(F.col("place") == int(SPARED * n_good)).select("path").first()
    return forest._replace(cut=float(cut["path"]))


def judged(df: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """df with the counts, base_failed, path_length and kept. A row out for each row in; null and empty texts fail the fixed
    rules; columns of those names are replaced."""
    df = without(df, ADDED)
    schema, at = T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in ADDED.items())]), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in grouped(batch, at):
                got = [statistics(t) for t in part.column(at).to_pylist()]
                paths = forest.paths(np.array([g[1] for g in got]).reshape(-1, N_STATS))
                failed = [base_failed(g[0][0], g[0][4]) for g in got]
                counts = [pa.array([g[0][i] for g in got], pa.int64()) for i in range(5)]
                kept = [not f and bool(p >= forest.cut) for f, p in zip(failed, paths, strict=True)]
                new = [*counts, pa.array(failed, pa.bool_()), pa.array(paths, pa.float64()), pa.array(kept, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *ADDED])

    return mapped(df, run, schema)
