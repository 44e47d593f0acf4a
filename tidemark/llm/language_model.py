"""Scores of texts by a log-bilinear language model, trained by noise-contrastive estimation.

Words of all training texts are counted exactly. The model's vocabulary is the end of a text, one class for all words that it doesn't
name, and the most frequent words. A word is predicted from the two before it (`b`, and `a` before that):

    s(w | a, b) = q[w] . (R1[b] + R2[a]) + bias[w],    P(w | a, b) = exp s(w | a, b) / sum over v of exp s(v | a, b).

As s is a sum of a part by b and a part by a, the sums of all contexts are one product of two matrices, exp(R1 q' + bias) and
exp(R2 q')': probabilities are normalised exactly, and a token costs three look-ups. A word that the vocabulary doesn't name has the
class's probability times its own share of the class by counts (c + 0.5), where all words never seen share one half.

Training reads the whole of all training texts, `rounds` times. Each task takes its texts in batches through numpy, from the parameters
of the round before; what tasks have learned is averaged, weighted by their tokens, in tasks by blocks of parameters. The driver holds
the parameters, (2 * vocabulary + 1) rows, whose number is fixed. Counts that the driver or a broadcast sees are those of the `known`
most frequent words; a rarer word's count is joined by word, and no such word is in more rows than the least frequent known one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import dealt_join, grouped, mapped, settled, without

#: Words of the model's vocabulary, with the end and the class of others, and numbers in each of their vectors.
VOCABULARY, SIZE = 1024, 24
#: Words whose counts every task holds, and the most bytes of one of them.
KNOWN, KNOWN_BYTES = 131_072, 40
#: Passes over the training texts, tokens of a batch, noise words drawn for each batch and counted as so many for each token.
ROUNDS, BATCH, DRAWN, NOISE = 2, 4096, 32, 8
STEP, SEED = 0.2, 13
END, OTHER = 0, 1
ADDED = {"lm_tokens": T.LongType(), "lm_known": T.LongType(), "lm_base_score": T.DoubleType(), "lm_score": T.DoubleType(), "lm_train_tokens": T.LongType()}
#: Distinct words of a task that are counted before they are sent on.
HELD = 200_000


def words(text: bytes | None) -> list[bytes]:
    """A-Z to a-z, and nothing else, cut at spaces and the five control characters from tab to carriage return: what bytes do."""
    return text.lower().split() if text else []


class Counts(NamedTuple):
    """known: word, count in training texts; falling by how often it is anywhere, words of one number by themselves."""

    known: list[tuple[bytes, int]]
    tokens: int
    distinct: int
    texts: int
    table: DataFrame  # word (binary), c: of training texts, n: of all


def counted(docs: DataFrame, known: int = KNOWN) -> Counts:
    """docs: text, train. Every word of every text is counted; the end of a text isn't in the table but in the figures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())
        texts = [0, 0]

        def flush() -> pa.RecordBatch:
            both = list(held[0].keys() | held[1].keys())
            out = [pa.array([*both, None], pa.binary()), pa.array([*(held[1][w] for w in both), texts[1]], pa.int64()), pa.array([*(held[0][w] + held[1][w] for w in both), sum(texts)], pa.int64())]
            for x in held:
                x.clear()
            texts[:] = 0, 0
            return pa.RecordBatch.from_arrays(out, names=["word", "c", "n"])

        for batch in batches:
            for part in grouped(batch, 0):
                for text, train in zip(part.column(0).cast(pa.binary()).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held[bool(train)].update(words(text))
                    texts[bool(train)] += 1
                if len(held[0]) + len(held[1]) > HELD:
                    yield flush()
        yield flush()

    table = settled(mapped(docs.select("text", "train"), run, "word binary, c bigint, n bigint").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "words")
    each = F.col("word").isNotNull()
    size = table.agg(F.sum("c").alias("tokens"), F.count(F.when(each & (F.col("c") > 0), 1)).alias("distinct"), F.max(F.when(~each, F.col("c"))).alias("texts")).first()  # one row
    top = sorted(frequent(table.where(each & (F.octet_length("word") <= KNOWN_BYTES)), known).collect(), key=lambda r: (-r["n"], bytes(r["word"])))  # `known` rows at most
    texts = size["texts"] or 0
    return Counts([(bytes(r["word"]), r["c"]) for r in top], size["tokens"] or 0, size["distinct"] + (texts > 0), texts, table.where(each))


def frequent(table: DataFrame, most: int) -> DataFrame:
    """The most frequent words, `most` at most: all whose number is above a bound that leaves so many. It is found on how many words there are
    of each size (32 sizes an octave), so no task sends more than what is kept."""
    size = F.floor(32 * F.log2("n"))
    held, bound = 0, None
    for row in sorted(table.where("n > 0").groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"]):  # 2,016 rows at most
        if (held := held + row["count"]) > most:
            break
        bound = row["size"]
    return table.where((F.col("n") > 0) & (size >= bound)) if bound is not None else table.limit(0)


class Model(NamedTuple):
    """names: words of the vocabulary from 2 on. left, before: R1 and R2; out: q. other_total: c + 0.5 summed over the words that
    the vocabulary doesn't name, with one half for those never seen."""

    names: list[bytes]
    out: np.ndarray
    left: np.ndarray
    before: np.ndarray
    bias: np.ndarray
    other_total: float


def started(counts: Counts, vocabulary: int = VOCABULARY, size: int = SIZE) -> tuple[Model, np.ndarray]:
    """A model that knows how frequent words are and nothing else, and how often each of its words is in training texts."""
    top = sorted((x for x in counts.known if x[1] > 0), key=lambda x: (-x[1], x[0]))[: vocabulary - 2]
    seen = np.array([counts.texts, counts.tokens - counts.texts - sum(c for _, c in top), *(c for _, c in top)], float)
    kinds = counts.distinct - (counts.texts > 0) - len(top)
    p = (seen + 0.5) / (seen + 0.5).sum()
    rng = np.random.default_rng(SEED)
    n = len(p)
    vectors = [(rng.normal(size=(n, size)) * 0.1).astype(np.float32) for _ in range(3)]
    return Model([w for w, _ in top], *vectors, np.log(p).astype(np.float32), max(seen[OTHER], 0.0) + 0.5 * kinds + 0.5), seen


def contexts(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the tokens of texts, one behind another and each with its end (ends: where), the one before each and the one before that;
    beyond a text's beginning there are ends."""
    a, b = np.full(len(ids), END, ids.dtype), np.full(len(ids), END, ids.dtype)
    a[2:], b[1:] = ids[:-2], ids[:-1]
    a[ends[:-1] + 1] = END  # the first tokens of the texts after the first
    return a, b


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers that occur, each once, and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    return rows[begins], np.add.reduceat(values[order], begins, axis=0)


class Trainer:
    """Steps of noise-contrastive estimation from given parameters, sized by the sums of squares of what each number has seen
    (AdaGrad). The noise is how frequent words are; a batch draws one set of words that all its tokens share."""

    def __init__(self, model: Model, seen: np.ndarray, seed: int, step: float = STEP):
        self.p = [np.array(x, np.float32) for x in (model.out, model.left, model.before, model.bias[:, None])]
        self.squares = [np.full(x.shape, 0.1, np.float32) for x in self.p]
        noise = (seen + 0.5) / (seen + 0.5).sum()
        self.noise_logs, self.cumulated = np.log(NOISE * noise).astype(np.float32), np.cumsum(noise)
        self.rng, self.step, self.tokens = np.random.default_rng(seed), step, 0

    def batch(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        out, left, before, bias = self.p
        n = len(out)
        drawn = np.minimum(np.searchsorted(self.cumulated, self.rng.random(DRAWN)), n - 1)
        context, outs, noise = left.take(b, 0), out.take(w, 0), out[drawn]
        context += before.take(a, 0)
        own = np.einsum("ij,ij->i", context, outs) + bias.take(w) - self.noise_logs.take(w)
        other = context @ noise.T
        other += bias[drawn, 0] - self.noise_logs[drawn]
        # The gradient of log P(data) by s: 1 - sigmoid for a token, minus sigmoid for each noise word, which stands for NOISE / DRAWN.
        with np.errstate(over="ignore"):  # beyond what exp can hold the sigmoid is 0
            plus = 1 / (1 + np.exp(own))
            minus = np.exp(np.negative(other, out=other), out=other)
        minus += 1
        np.divide(np.float32(-NOISE / DRAWN), minus, out=minus)
        by_context = minus @ noise
        outs *= plus[:, None]
        by_context += outs
        every = np.concatenate([w, drawn])
        grads = [(every, np.concatenate([plus[:, None] * context, minus.T @ context])), (b, by_context), (a, by_context), (every, np.concatenate([plus, minus.sum(0)])[:, None])]
        for p, s, (rows, values) in zip(self.p, self.squares, grads, strict=True):
            rows, g = summed(rows, values)
            g /= np.float32(math.sqrt(len(w)))
            seen = s.take(rows, 0) + g * g
            s[rows] = seen
            g *= np.float32(self.step)
            p[rows] += g / np.sqrt(seen)
        self.tokens += len(w)


def flat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in parts])


#: Numbers of a block in which parameters are averaged.
BLOCK = 4096


def averaged(parts: DataFrame) -> DataFrame:
    """(block, x): means of x (float64 numbers as bytes) weighted by w. Blocks are dealt to tasks, and added up as they come: a task holds
    one sum for each of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for block, w, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                at = sums.setdefault(block, [0.0, 0.0])
                at[0], at[1] = at[0] + w, at[1] + w * np.frombuffer(x)
        got = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(got, pa.int32()), pa.array([(sums[b][1] / sums[b][0]).tobytes() for b in got], pa.binary())], names=["block", "x"])

    return mapped(parts.repartition("block"), run, "block int, x binary")


def trained(ids: DataFrame, model: Model, seen: np.ndarray, rounds: int = ROUNDS) -> Model:
    """ids: tokens (unsigned 16-bit numbers as bytes, each text with its end), of training texts only. Without texts, or where only
    ends are known, nothing is learned."""
    n, size = model.out.shape
    for number in range(rounds if n > 2 else 0):

        def run(batches: Iterator[pa.RecordBatch], model: Model = model, number: int = number) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            trainer = Trainer(model, seen, (SEED, number, TaskContext.get().partitionId()), STEP / (1 + number))
            for batch in batches:
                for part in grouped(batch, 0, 2_000_000):
                    texts = [np.frombuffer(x, np.uint16) for x in part.column(0).to_pylist()]
                    every = np.concatenate(texts)
                    a, b = contexts(every, np.cumsum([len(x) for x in texts]) - 1)
                    order = trainer.rng.permutation(len(every))
                    for at in range(0, len(every), BATCH):
                        i = order[at : at + BATCH]
                        trainer.batch(a[i], b[i], every[i])
            if trainer.tokens:
                x = flat(trainer.p).astype(np.float64)
                blocks = [x[i : i + BLOCK].tobytes() for i in range(0, len(x), BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([float(trainer.tokens)] * len(blocks)), pa.array(blocks, pa.binary())], names=["block", "w", "x"])

        got = averaged(mapped(ids.select("ids"), run, "block int, w double, x binary")).collect()  # the parameters: a fixed number
        if got:
            x = np.concatenate([np.frombuffer(r["x"]) for r in sorted(got, key=lambda r: r["block"])]).astype(np.float32)
            parts = [x[: n * size], x[n * size : 2 * n * size], x[2 * n * size : 3 * n * size]]
            model = model._replace(out=parts[0].reshape(n, size), left=parts[1].reshape(n, size), before=parts[2].reshape(n, size), bias=x[3 * n * size :])
    return model


class Tables(NamedTuple):
    """Natural logs: by_b[b, w], by_a[a, w] and whole[b, a] with P(w | a, b) = exp(by_b + by_a - whole)."""

    by_b: np.ndarray
    by_a: np.ndarray
    whole: np.ndarray

    @staticmethod
    def of(model: Model) -> Tables:
        by_b = (model.left @ model.out.T + model.bias).astype(np.float64)
        by_a = (model.before @ model.out.T).astype(np.float64)
        top_b, top_a = by_b.max(1, keepdims=True), by_a.max(1, keepdims=True)
        whole = np.log(np.maximum(np.exp(by_b - top_b) @ np.exp(by_a - top_a).T, 1e-300)) + top_b + top_a.T
        return Tables(by_b.astype(np.float32), by_a.astype(np.float32), whole)

    def logs(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
        return self.by_b[b, w].astype(np.float64) + self.by_a[a, w] - self.whole[b, a]


def encoded(docs: DataFrame, counts: Counts, model: Model) -> DataFrame:
    """docs with `train` and, last, `text`; in place of text there are ids, n, known, base, other, words and times.

    ids: tokens as numbers of the vocabulary; n: how many; of those whose counts a task holds: how many were seen (known), the sum of
    their base scores (base), and of those of them that the vocabulary doesn't name the sum of log10(c + 0.5) (other). words, times:
    the others, whose counts have to be joined."""
    total = counts.tokens + 0.5 * (counts.distinct + 1)
    number = {w: i for i, w in enumerate(model.names, 2)}
    held = {w: (number.get(w, OTHER), c) for w, c in counts.known}
    end = (math.log10((counts.texts + 0.5) / total), int(counts.texts > 0))
    added = {"ids": T.BinaryType(), "n": T.LongType(), "known": T.LongType(), "base": T.DoubleType(), "other": T.DoubleType(), "words": T.ArrayType(T.BinaryType()), "times": T.ArrayType(T.LongType())}
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
    names, at = docs.columns[:-1], len(docs.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, last = {w: i for i, w in enumerate(held)}, len(held)
        of = np.array([*(x for x, _ in held.values()), OTHER], np.uint16)  # the last is any word that isn't held
        c = np.array([*(x for _, x in held.values()), 0], float)
        base, own, seen = np.log10((c + 0.5) / total), np.where(of == OTHER, np.log10(c + 0.5), 0.0), c > 0
        base[last] = own[last] = 0.0
        for batch in batches:
            for part in grouped(batch, at):
                out: list[tuple] = []
                for text in part.column(at).cast(pa.binary()).to_pylist():
                    w = words(text)
                    x = np.fromiter((place.get(v, last) for v in w), np.int64, len(w))
                    rest = Counter(w[i] for i in np.flatnonzero(x == last))
                    out.append((np.append(of[x], np.uint16(END)).tobytes(), len(w) + 1, int(seen[x].sum()) + end[1], base[x].sum() + end[0], own[x].sum(), list(rest), list(rest.values())))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], names=[*names, *added])

    return mapped(docs, run, T.StructType([*docs.schema.fields[:-1], *(T.StructField(k, v) for k, v in added.items())]))


def with_model_scores(done: DataFrame, model: Model) -> DataFrame:
    """done (its last column: ids) with, in place of ids, model: log10 probabilities of texts, where a word that the vocabulary doesn't
    name has its class's over all of the class."""
    names, at = done.columns[:-1], len(done.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables.of(model)
        for batch in batches:
            for part in grouped(batch, at, 2_000_000):
                texts = [np.frombuffer(x, np.uint16).astype(np.int64) for x in part.column(at).to_pylist()]
                ends, every = np.cumsum([len(x) for x in texts]) - 1, np.concatenate(texts)
                begins = np.concatenate([[0], ends[:-1] + 1])
                logs = np.add.reduceat(tables.logs(*contexts(every, ends), every), begins) / math.log(10)
                others = np.add.reduceat((every == OTHER).astype(np.int64), begins)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(logs - others * math.log10(model.other_total))], names=[*names, "model"])

    return mapped(done, run, T.StructType([*done.schema.fields[:-1], T.StructField("model", T.DoubleType())]))


def scored(df: DataFrame, train: Column, text: str = "text", keep_text: bool = True, vocabulary: int = VOCABULARY, known: int = KNOWN, rounds: int = ROUNDS) -> DataFrame:
    """df with lm_tokens (words and the end), lm_known (those that training texts have), lm_base_score (log10 probability by smoothed
    counts), lm_score (by the model) and lm_train_tokens. train: which rows are learned from; null counts as no.

    A row out for each row in; a null text counts as empty and is its end alone; repeated rows count as often as they are there. Without
    training rows all words are unseen ones. Columns named like the added ones are replaced. keep_text: whether the text comes out too;
    what comes out is written to the shared folder on the way.
    """
    if not 3 <= vocabulary < 1 << 16:
        raise ValueError("a vocabulary has 3 to 65,535 words")
    names = [c for c in without(df, ADDED).columns if keep_text or c != text]
    # The caller's columns go by other names on the way, so none can clash.
    docs = df.select(*(df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)), F.coalesce(train, F.lit(False)).alias("train"), df[f"`{text}`"].cast("string").alias("text"))
    counts = counted(docs, known)
    model, seen = started(counts, vocabulary)
    done = settled(encoded(docs.select(*docs.columns[:-1], F.monotonically_increasing_id().alias("row"), "text"), counts, model), "encoded")
    model = trained(done.where("train"), model, seen, rounds)

    total = counts.tokens + 0.5 * (counts.distinct + 1)
    rest = done.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    # A word that isn't held is rare, or too long to be held: of the latter one may be hot.
    long = counts.table.where(F.octet_length("word") > KNOWN_BYTES).select("word", F.col("n").alias("c"))
    met = dealt_join(rest, counts.table.select("word", F.col("c").alias("count")), "word", "row", "left", counts=long)
    c = F.coalesce("count", F.lit(0))
    sums = met.groupBy("row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10((c + 0.5) / F.lit(total))).alias("more_base"), F.sum(F.col("times") * F.log10(c + 0.5)).alias("more_other"))
    own = [f"c{i}" for i in range(len(names))]
    out = with_model_scores(done.select(*own, "row", "n", "known", "base", "other", "ids"), model).join(sums, "row", "left")
    zero = F.lit(0.0)
    return out.select(
        *(F.col(c).alias(n) for c, n in zip(own, names, strict=True)), F.col("n").alias("lm_tokens"), (F.col("known") + F.coalesce("more", F.lit(0).cast("long"))).alias("lm_known"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("lm_base_score"), (F.col("model") + F.col("other") + F.coalesce("more_other", zero)).alias("lm_score"), F.lit(counts.tokens).cast("long").alias("lm_train_tokens"),
    )
