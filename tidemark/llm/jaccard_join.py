"""Similarity join of texts on word n-grams, and the components of its links.

Texts with equal sets of n-grams are one node. Nodes are joined by rare-first prefix filtering: a node's n-grams are put
in one global order, rare ones first, and two nodes that are similar enough share one of the first few (the prefix). Of a
prefix n-gram's nodes, pairs are left out by length, by the place of the n-gram (what can still follow on both sides) and
by the suffix filter: n-grams are dealt into buckets by hash, and the buckets whose counts differ in parity (for long nodes,
also by how much they differ) are a lower bound of how many n-grams only one of the two has. What is left is verified once per pair on whole sets.

Components come first, and for them not every pair of a large group is made. First each node of a prefix n-gram is paired with
the first one, which joins most of what is similar; n-grams that very many nodes have are dealt out to salted blocks, whose
first nodes are paired in turn. Then the nodes of each n-gram whose nodes are in different components are dealt at random into
small blocks, anew for each n-gram, and the pairs inside a block are tried, and last every pair that passes the filters, inside the join, and whose nodes are still in different components: of a frequent n-gram, block
against block and only lengths that can match. So no link between components is missed.

Then links. Each lies inside one component, so all pairs of a component's nodes are verified, each once: a large component
is dealt into parts, and each two parts are one tile, a product of two incidence matrices. `links` gives every link;
`linked` only counts them, inside the tiles, so what it passes on is a row for each node and tile.

Rare-first order: the n-grams that would be first by hash are counted over all nodes. The `FREQUENT` most frequent of them come
last in the order, by their counts, and the rest first, by hash. The order decides how many candidates there are, never which
links are found.

Hashes of n-grams have 64 bits, nodes' names 128; nodes are numbered, and joins are by number.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.shared import dealt_join, dropped, freed, grouped, mapped, settled

#: N-grams that go to all tasks with their counts: 16 bytes each.
FREQUENT = 1_000_000
#: N-grams of a task that are counted at a time, and how many of a node's are, as multiples of its prefix.
COUNTED, AHEAD = 1_000_000, 1.25
#: Nodes in a block of a very frequent n-gram, on average.
BLOCK = 500
#: Nodes in a random block, on average, and rounds of them before all remaining pairs are made.
TRIED, TRIED_ROUNDS = 16, 1
#: Bits of the filter that says which nodes' sets a pass over the texts has to return. It may say yes too often.
FILTER_BITS = 1 << 24
#: 64-bit words of a node's parities, and of a second, wide set that longer nodes have besides, for so many parities say little of
#: them. Of long nodes counts of hashes by range are kept too.
PARITIES, WIDE, WIDE_FROM, LONG, RANGES = 16, 64, 2_000, 1_000, 512
#: Bytes of an n-gram's hash in a set that is compared.
PACKED = 6
#: Names of nodes that a task remembers so as not to repeat them.
REMEMBERED = 100_000
#: Bytes of text whose words are hashed at a time, one text at least.
GROUP = 1_000_000
#: Nodes, and n-grams, in a part of a large component, on average. Columns of a tile's matrices at a time.
TILE_NODES, TILE_GRAMS, TILE_COLUMNS = 500, 1_000_000, 4096
#: Keys of rows that go to all tasks, at most; beyond it rows are shuffled.
BROADCAST_KEYS = 500_000


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Shingler:
    """The sorted hashes of texts' distinct word n-grams, from the bytes of an Arrow column, without a Python object a word.

    A text of fewer words has one n-gram, of all its words; one without words has none. Words are split at ASCII white space
    and A-Z count as a-z. A word's hash is a polynomial over random values of its bytes, taken from a running sum; a text's
    bytes are worked on in blocks that end between words, so a very long text takes no more memory for it than its words' hashes.
    """

    BLOCK, BASE = 1 << 18, 0x9E3779B97F4A7C15 | 1

    def __init__(self, n: int):
        self.n = n
        letters = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        letters[65:91] = letters[97:123]
        self.letters, self.white = letters, np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
        self.up = _powers(self.BASE, self.BLOCK + 1)
        self.down = _powers(pow(self.BASE, -1, 1 << 64), self.BLOCK + 1)

    def _grow(self, n: int) -> None:
        if n >= len(self.up):
            self.up, self.down = _powers(self.BASE, 2 * n), _powers(pow(self.BASE, -1, 1 << 64), 2 * n)

    def words(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words and where each begins. starts: offsets of texts, at which a word ends too."""
        hashes, places = [], []
        at = 0
        while at < len(data):
            end = min(at + self.BLOCK, len(data))
            if end < len(data):
                cut = np.flatnonzero(self.white[data[at:end]])
                texts = starts[np.searchsorted(starts, at, "right") : np.searchsorted(starts, end, "right")]
                last = max(cut[-1] + 1 + at if len(cut) else at, texts[-1] if len(texts) else at)
                while last == at and end < len(data):  # one word is longer than a block
                    more = min(end + self.BLOCK, len(data))
                    cut = np.flatnonzero(self.white[data[end:more]])
                    texts = starts[np.searchsorted(starts, end, "left") : np.searchsorted(starts, more, "right")]
                    found = [c for c in ([cut[0] + 1 + end] if len(cut) else []) + ([texts[0]] if len(texts) else [])]
                    last = min(found) if found else at
                    end = more
                end = last if last > at else end
            part = data[at:end]
            self._grow(len(part))
            inside = ~self.white[part]
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            edges = starts[np.searchsorted(starts, at, "left") : np.searchsorted(starts, end, "left")] - at
            first[edges[inside[edges]]] = True
            begin = np.flatnonzero(first)
            if len(begin):
                stop = inside.copy()
                stop[:-1] &= ~inside[1:]
                before = edges[(edges > 0)] - 1
                stop[before[inside[before]]] = True
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(np.where(inside, self.letters[part] * self.up[: len(part)], np.uint64(0)), out=sums[1:])
                h = (sums[np.flatnonzero(stop) + 1] - sums[begin]) * self.down[begin]
                h ^= h >> np.uint64(31)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
                hashes.append(h)
                places.append(begin + at)
            at = end
        empty = np.empty(0, np.uint64)
        return np.concatenate(hashes or [empty]), np.concatenate(places or [np.empty(0, np.int64)])

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        column = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        whole = column.buffers()[2]
        data = np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]] if whole is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        ids, places = self.words(data, np.unique(offsets[:-1]))
        edges = np.searchsorted(places, offsets, "left")  # first word of each text

        def grams(first: np.ndarray | slice, size: int, m: int) -> np.ndarray:
            h = np.full(m, size, np.uint64)
            for j in range(size):
                h = (h ^ (ids[j : j + m] if isinstance(first, slice) else ids[first + j])) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            return (h * np.uint64(0xBF58476D1CE4E5B9)) ^ (h >> np.uint64(32))

        m = max(0, len(ids) - self.n + 1)
        full = grams(slice(0, m), self.n, m)
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a >= self.n:
                h = np.sort(full[a : b - self.n + 1])
                new = h[1:] != h[:-1]
                out.append(h if new.all() else h[np.append(True, new)])
            else:
                out.append(grams(np.array([a]), b - a, 1) if b > a else full[:0])
        return out


def node_name(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def parity(grams: np.ndarray, words: int = PARITIES) -> np.ndarray:
    """A bit for each of 64 times `words` buckets of hashes: whether an odd number of n-grams falls into it. Where the bits of two nodes
    differ, so do their sets: the number of such bits is at most that of n-grams which only one of the two has."""
    odd = np.bincount((grams & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def ranges(grams: np.ndarray) -> bytes:
    """How many hashes fall into each of RANGES ranges; a count ends at 255."""
    return np.minimum(np.bincount((grams >> np.uint64(64 - RANGES.bit_length() + 1)).astype(np.int64), minlength=RANGES), 255).astype(np.uint8).tobytes()


def least_common(n, num: int, den: int):
    """The fewest common n-grams of a node of n with a similar one."""
    return -(-num * n // den)


def _profiles(df: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """df: key, digest, text. A row (key, digest, node, n) for each row, and rows (gram, count): how many of some nodes of a task have
    the n-gram among their first by hash. A node that several tasks have, or that a task has forgotten, counts more than once."""
    schema = T.StructType([*df.schema.fields[:2], T.StructField("node", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("gram", T.LongType()), T.StructField("count", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen, held, size = Shingler(n), set(), [], 0
        kind = None

        def counted() -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            m = len(grams)
            return pa.RecordBatch.from_arrays([pa.nulls(m, kind), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int32()), pa.array(grams.view(np.int64)), pa.array(counts.astype(np.int64))], names=schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for part in grouped(batch, 2, GROUP):
                names, sizes = [], []
                for grams in shingle(part.column(2)):
                    name, m = node_name(grams) if len(grams) else None, len(grams)
                    names.append(name)
                    sizes.append(m)
                    if name and name not in seen:
                        seen.add(name)
                        held.append(grams[: math.ceil(AHEAD * (m - least_common(m, num, den) + 1))].copy())
                        size += len(held[-1])
                m = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=schema.names)
                if len(seen) > REMEMBERED:
                    seen.clear()
                if size >= COUNTED:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return mapped(df, run, schema)


def _prefixes(df: DataFrame, n: int, num: int, den: int, order: tuple) -> DataFrame:
    """df: text. (name, n, parity, wide, ranges, prefix) of each distinct node; prefix: the first n-grams in the global order."""
    shared = df.sparkSession.sparkContext.broadcast(order)
    schema = "name binary, n int, parity array<bigint>, wide array<bigint>, ranges binary, prefix array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen = Shingler(n), set()
        common, rank = (np.frombuffer(b, t) for b, t in zip(shared.value, (np.uint64, np.int64), strict=True))
        for batch in batches:
            for part in grouped(batch, 0, GROUP):
                rows: list[tuple] = []
                for grams in shingle(part.column(0)):
                    if not len(grams) or (name := node_name(grams)) in seen:
                        continue
                    seen.add(name)
                    m = len(grams)
                    first = m - int(least_common(m, num, den)) + 1
                    if len(common):
                        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
                        place = np.where(common[at] == grams, rank[at], -1)
                        chosen = grams[np.argsort(place, kind="stable")[:first]]
                    else:
                        chosen = grams[:first]
                    rows.append((name, m, parity(grams), parity(grams, WIDE) if m > WIDE_FROM else None, ranges(grams) if m > LONG else None, chosen.view(np.int64)))
                if len(seen) > REMEMBERED:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.int64())), pa.array([r[4] for r in rows], pa.binary()), pa.array([r[5] for r in rows], pa.list_(pa.int64()))], names=["name", "n", "parity", "wide", "ranges", "prefix"])

    return mapped(df, run, schema).dropDuplicates(["name"])


def _bits(digests: pa.Array) -> np.ndarray:
    """Two places in the filter for each MD5."""
    return (np.frombuffer(b"".join(digests.to_pylist()), "<u4").reshape(-1, 4)[:, :2] % FILTER_BITS).astype(np.int64)


def packed(grams: np.ndarray) -> bytes:
    """The upper bits of each hash, in order."""
    return np.ascontiguousarray(grams.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :PACKED]).tobytes()


def values(x: bytes) -> np.ndarray:
    wide = np.zeros((len(x) // PACKED, 8), np.uint8)
    wide[:, 8 - PACKED :] = np.frombuffer(x, np.uint8).reshape(-1, PACKED)
    return wide.view(">u8").ravel().astype(np.uint64)


def common(a: bytes, b: bytes) -> int:
    """How many hashes two packed sets share. (For two hashes of two sets to agree by chance in 48 bits takes some 10^7 words.)"""
    x, y = values(a), values(b)
    both = np.sort(np.concatenate([x, y]))
    return int((both[1:] == both[:-1]).sum() - (x[1:] == x[:-1]).sum() - (y[1:] == y[:-1]).sum())


def _sets(df: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """(node, grams) of wanted nodes, from the texts again. wanted: node, name, digest: the MD5 of one text of the node's. df: text. A
    filter of fixed size goes out with the tasks: only texts in it are hashed, and only wanted ones are kept."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.unique(_bits(batch.column(0)))
                word, start = np.unique(at >> 6, return_index=True)
                bits = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)), start)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    made = mapped(wanted.select("digest"), places, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
    words = np.zeros(FILTER_BITS >> 6, np.uint64)
    words[made.column("word").to_numpy()] = made.column("bits").to_numpy().view(np.uint64)
    shared = df.sparkSession.sparkContext.broadcast(words.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, asked, seen = Shingler(n), np.frombuffer(shared.value, np.uint64), set()
        for batch in batches:
            if not batch.num_rows:
                continue
            at = _bits(batch.column(1))
            hit = ((asked[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(1)
            for part in grouped(batch.filter(pa.array(hit)), 0, GROUP):
                new = [(node_name(g), g) for g in shingle(part.column(0)) if len(g)]
                new = [(k, g) for k, g in new if k not in seen]
                seen.update(k for k, _ in new)
                if len(seen) > REMEMBERED:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in new], pa.binary()), pa.array([packed(g) for _, g in new], pa.binary())], names=["name", "grams"])

    texts = df.where(F.col("text").isNotNull()).select("text", digest_of("text").alias("digest"))
    made = mapped(texts, run, "name binary, grams binary")
    sets = settled(made.join(wanted.select("node", "name"), "name").select("node", "grams").dropDuplicates(["node"]), "sets")
    freed(df.sparkSession)
    shared.destroy()
    return sets


def digest_of(text: str) -> Column:
    return F.unhex(F.md5(F.encode(text, "utf-8")))


def _possible(a_n: Column, b_n: Column, a_pos: Column, b_pos: Column, num: int, den: int) -> Column:
    """Length and positional filters: the shorter one is long enough, and after an n-gram at these places enough may follow."""
    need = F.ceil((num * (a_n + b_n)) / F.lit(num + den))
    return (den * F.least(a_n, b_n) >= num * F.greatest(a_n, b_n)) & (1 + F.least(a_n - a_pos - 1, b_n - b_pos - 1) + F.least(a_pos, b_pos) >= need)


def _differing(a: str, b: str, wide: bool = False) -> Column:
    """In how many places two nodes' parities differ. Sixteen words are written out, so that a join stays compiled; the many of wide
    ones would make a method that the JVM no longer compiles."""
    if wide:
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(PARITIES)), F.lit(0))


def _alike(a_n: Column, b_n: Column, apart: Column, num: int, den: int) -> Column:
    """The suffix filter: n-grams that only one of two sets has are at least as many as the places in which their parities differ."""
    return (den + num) * apart <= (den - num) * (a_n + b_n)


def _verified(pairs: DataFrame, small: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """pairs: distinct (a, b). The suffix filter, then whole sets: (a, b, linked) of all of them."""
    spark, own = small.sparkSession, small.select("node", "n", "parity")
    named = pairs.join(own.toDF("a", "an", "ap"), "a").join(own.toDF("b", "bn", "bp"), "b")
    named = settled(named.select("a", "b", "an", "bn", _alike(F.col("an"), F.col("bn"), _differing("ap", "bp"), num, den).alias("may")), "pairs")
    long, columns = small.where(F.col("n") > LONG).select("node", "ranges"), ["a", "b", "an", "bn"]

    def suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, RANGES).astype(np.int16) for c in ("ar", "br"))
                both = batch.column("an").to_numpy().astype(np.int64) + batch.column("bn").to_numpy()
                may = (num + den) * np.abs(x - y).sum(1, dtype=np.int64) <= (den - num) * both
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(may)], names=[*columns, "may"])

    both_long = named.where(F.col("may") & (F.least("an", "bn") > LONG)).drop("may")
    if both_long.limit(1).count():
        both_long = both_long.join(long.toDF("a", "ar"), "a").join(long.toDF("b", "br"), "b").select(*columns, "ar", "br")
        before = named
        named = settled(mapped(both_long, suffix, "a long, b long, an int, bn int, may boolean").union(named.where(~F.col("may") | (F.least("an", "bn") <= LONG))), "pairs")
        dropped(spark, before)
    near = named.where("may").drop("may")
    asked = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    sets = _sets(texts, n, small.join(asked, "node", "left_semi").select("node", "name", "digest"))
    both = near.join(sets.toDF("b", "bg"), "b").join(sets.toDF("a", "ag"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, an, bn, ag, bg = batch.columns
            yes = [den * (c := common(x, y)) >= num * (p + q - c) for x, y, p, q in zip((x.as_py() for x in ag), (x.as_py() for x in bg), an.to_pylist(), bn.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([a, b, pa.array(yes, pa.bool_())], names=["a", "b", "linked"])

    said = mapped(both.select("a", "b", "an", "bn", "ag", "bg"), run, "a long, b long, linked boolean")
    done = settled(said.union(named.where("NOT may").select("a", "b", F.lit(False))), "links")
    for t in (sets, named):
        dropped(spark, t)
    freed(spark)
    return done


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes in edges (a, b): root is the least node of the component. Large and small stars in turn, each
    round written out, until a round changes nothing: then the edges are a forest of stars. Nodes with very many neighbours are
    split between tasks."""
    spark = edges.sparkSession

    def starred(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """df (u, v) with m, the least of u and its neighbours, and what can be dropped afterwards."""
        least = settled(df.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("c")), "least")
        return dealt_join(df, least.select("u", "m"), "u", "v", counts=least), least

    now = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    before = None
    while (state := now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != before:
        before = state
        both, a = starred(now.union(now.select("v", "u")))
        large = settled(both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        near, b = starred(large)
        small = near.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        following = settled(small, "stars")
        for t in (now, a, b, large):
            dropped(spark, t)
        now = following
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


class Found(NamedTuple):
    """rows: key, digest, name, n of each row. roots: node, root of components of several nodes, but for the roots' own rows.
    small: node, name, n, digest, best (the least key's struct), copies of each node. texts: text."""

    rows: DataFrame
    roots: DataFrame
    small: DataFrame
    texts: DataFrame


def rank() -> Column:
    """What is least for the row that names a component, or stays: a null key comes last, then the digest decides."""
    return F.struct(F.col("key").isNull().alias("none"), "key", "digest")


def _found(docs: DataFrame, key: str, text: str, n: int, num: int, den: int) -> Found:
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("key"), digest_of(text).alias("digest"), F.col(text).alias("text"))
    texts = docs.select("text")
    profiles = settled(_profiles(docs, n, num, den), "profiles")
    rows = settled(profiles.where("gram IS NULL").select("key", "digest", F.col("node").alias("name"), "n"), "rows")
    counts = settled(profiles.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("count").alias("count")).where("count > 1"), "counts")
    dropped(spark, profiles)
    # The least count of which, with all above it, there are at most FREQUENT.
    least, held = 2, 0
    for times, grams in counts.groupBy("count").agg(F.count(F.lit(1)).alias("grams")).orderBy(F.desc("count")).limit(FREQUENT).collect():  # a row a count: few
        held += grams
        if held > FREQUENT:
            least = times + 1
            break
    found = counts.where(F.col("count") >= least).toArrow()  # FREQUENT rows at most
    dropped(spark, counts)
    freed(spark)
    grams, times = found.column("gram").to_numpy().view(np.uint64), found.column("count").to_numpy()
    by = np.argsort(grams)
    del found
    # Numbers are given where nodes are written, once, so they don't change afterwards.
    nodes = settled(_prefixes(texts, n, num, den, (grams[by].tobytes(), times[by].astype(np.int64).tobytes())).withColumn("node", F.monotonically_increasing_id()), "nodes")
    freed(spark)

    frequent = [(int(g), int(c) // BLOCK + 1) for g, c in zip(grams.view(np.int64), times, strict=True) if c > 2 * BLOCK]  # of FREQUENT
    entries = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "gram")).join(F.broadcast(spark.createDataFrame(frequent, "gram long, dealt int")), "gram", "left").withColumn("dealt", F.coalesce("dealt", F.lit(1)))
    entries = entries.withColumn("salt", F.when(F.col("dealt") > 1, F.pmod(F.xxhash64("node"), F.col("dealt"))).otherwise(F.lit(0)).cast("int"))
    entries = entries.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("gram", "salt"))).where("held > 1 OR dealt > 1").drop("held")
    entries = settled(entries, "entries")
    of_rows = rows.where("name IS NOT NULL").groupBy("name").agg(F.min("digest").alias("digest"), F.min(rank()).alias("best"), F.count(F.lit(1)).alias("copies"))
    small = settled(nodes.select("node", "name", "n", "parity", "wide", "ranges").join(of_rows, "name"), "small")
    dropped(spark, nodes)
    freed(spark)

    def pairs_of(df: DataFrame) -> DataFrame:
        """df: node, n, pos, other. Distinct pairs that pass the filters."""
        near = df.where("other IS NOT NULL").where(_possible(F.col("n"), F.col("other.n"), F.col("pos"), F.col("other.pos"), num, den))
        return near.select(F.least("node", "other.node").alias("a"), F.greatest("node", "other.node").alias("b")).where("a <> b").distinct()

    # Each node of a block with the block's first, and first nodes of the blocks of one n-gram with each other.
    one = F.struct("node", "n", "pos")
    ordered = Window.partitionBy("gram", "salt").orderBy("n", "node")
    headed = entries.withColumn("other", F.first(one).over(ordered))
    heads = entries.where("dealt > 1").groupBy("gram", "salt").agg(F.min(F.struct("n", "node", "pos")).alias("h")).select("gram", "h.node", "h.n", "h.pos")
    heads = heads.withColumn("other", F.lag(one).over(Window.partitionBy("gram").orderBy("n", "node")))
    tested = [_verified(pairs_of(headed.select("node", "n", "pos", "other").union(heads.select("node", "n", "pos", "other"))), small, texts, n, num, den)]
    roots = components(tested[0].where("linked"))

    def still_mixed() -> DataFrame:
        """Entries of n-grams whose nodes are in more than one component, with their component, how many nodes their n-gram has, and
        their parities."""
        placed = entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = placed.groupBy("gram").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("held")).where("r0 <> r1").select("gram", "held")
        return placed.join(mixed, "gram").join(small.select("node", "parity", "wide"), "node")

    def more_of(pairs: DataFrame) -> bool:
        """Verify pairs that weren't yet; True if there were any."""
        nonlocal roots
        for t in tested:
            pairs = pairs.join(t.select("a", "b"), ["a", "b"], "left_anti")
        new = settled(pairs, "more")
        if not new.limit(1).count():
            return False
        tested.append(_verified(new, small, texts, n, num, den))
        dropped(spark, new)
        if tested[-1].where("linked").limit(1).count():
            # The stars so far stand for the links so far.
            before, linked_now = roots, tested[-1].where("linked").select("a", "b")
            roots = components(linked_now.union(before.select("node", "root")))
            dropped(spark, before)
        return True

    def meeting(df: DataFrame, *by: str, other: DataFrame | None = None, same: Column = F.lit(True)) -> DataFrame:
        """Pairs of a row of df and one of other (or df) that have equal values in the columns `by`, and `same`, pass the filters and
        are in different components. Longer nodes meet each other by their wide parities."""
        out = []
        for parities, some in (("parity", F.lit(True)), ("wide", F.col("n") > WIDE_FROM)):
            x, y = ((t.where(some).drop({"parity": "wide", "wide": "parity"}[parities])).alias(a) for t, a in ((df, "x"), (df if other is None else other, "y")))
            on = (F.col("x.node") < F.col("y.node")) & same if other is None else same
            for c in by:
                on &= F.col(f"x.{c}") == F.col(f"y.{c}")
            able = (F.col("x.root") != F.col("y.root")) & _possible(F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos"), num, den)
            if parities == "parity":
                able &= F.least("x.n", "y.n") <= WIDE_FROM
            able &= _alike(F.col("x.n"), F.col("y.n"), _differing(f"x.{parities}", f"y.{parities}", parities == "wide"), num, den)
            out.append(x.join(y, on).where(able).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")))
        return out[0].union(out[1])

    # Nodes of an n-gram meet a few others, drawn anew for each n-gram: as many pairs as there are entries, times a constant. They
    # join nearly all of a group of near copies, whose pairs would otherwise all come up below.
    for turn in range(TRIED_ROUNDS):
        mixed = settled(still_mixed(), "mixed")
        drawn = mixed.withColumn("block", F.pmod(F.xxhash64("node", "gram", F.lit(turn)), F.ceil(F.col("held") / TRIED)))
        more = more_of(meeting(drawn, "gram", "block").distinct())
        dropped(spark, mixed)
        freed(spark)
        if not more:
            break

    # All that may still join two components. Entries of a frequent n-gram stand in bands by length, of which only equal and next
    # ones can match, and meet block by block.
    mixed = settled(still_mixed(), "mixed")
    band = F.floor(F.log("n") / (1.0001 * math.log(den / num))).cast("int") if den > num else F.col("n")
    dealt = mixed.where("dealt > 1").withColumn("band", band).withColumn("meets", F.col("band"))
    spread = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("dealt") - 1))).withColumn("meets", F.explode(F.array("band", F.col("band") - 1)))
    once = (F.col("x.band") != F.col("y.band")) | (F.col("x.node") < F.col("y.node"))
    more_of(meeting(mixed.where("dealt = 1"), "gram").union(meeting(dealt, "gram", "salt", "meets", other=spread, same=once)).distinct())
    for t in (entries, mixed, *tested):
        dropped(spark, t)
    freed(spark)
    return Found(rows, roots, small, texts)


def unpacked(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of packed sets, and for each the place of its set."""
    return values(b"".join(sets)), np.repeat(np.arange(len(sets)), [len(s) // PACKED for s in sets])


def common_of_all(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """`common` of each of a with each of b."""
    (x, at), (y, bt) = unpacked(a), unpacked(b)
    shared = np.intersect1d(x, y)
    out = np.zeros((len(a), len(b)), np.float32)

    def columns(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(shared, values), max(0, len(shared) - 1))
        has = shared[place] == values if len(shared) else np.zeros(len(values), bool)
        by = np.argsort(place[has], kind="stable")
        return place[has][by], rows[has][by]

    (xc, xr), (yc, yr) = columns(x, at), columns(y, bt)
    for first in range(0, len(shared), TILE_COLUMNS):
        width = min(TILE_COLUMNS, len(shared) - first)
        sides = []
        for c, r, m in ((xc, xr, len(a)), (yc, yr, len(b))):
            i, j = np.searchsorted(c, [first, first + width])
            side = np.zeros((m, width), np.float32)
            side[r[i:j], c[i:j] - first] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)  # sums under 2**24 are whole


def _placed(found: Found) -> DataFrame:
    """Every node of a component of several, and its root; the root's own row too."""
    return found.roots.union(found.roots.select("root", "root").distinct())


def _tiles(found: Found, n: int, num: int, den: int, counted: bool) -> DataFrame:
    """All links between nodes, as (a, b, common), or if counted as (node, linked): in each tile, how many rows have the nodes that
    one links with. Nodes of one component meet in one tile, whatever their place in it."""
    spark = found.rows.sparkSession
    members = _placed(found).join(found.small.select("node", "name", "n", "digest", "copies"), "node")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("g"))
    parts = sizes.select("root", F.greatest(F.ceil(F.col("c") / TILE_NODES), F.ceil(F.col("g") / TILE_GRAMS)).cast("int").alias("parts")).where("parts > 1")
    few = F.broadcast if parts.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else (lambda x: x)
    dealt = members.join(few(parts), "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    sets = _sets(found.texts, n, members.select("node", "name", "digest"))
    each = dealt.drop("name", "digest").join(sets, "node").select("root", "node", "n", "copies", "grams", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    each = each.select("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "n", "copies", "grams")
    each = each.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")

    def tile(rows: list[tuple]) -> pa.RecordBatch | None:
        """rows: root, i, j, part, node, n, copies, grams."""
        one = [r for r in rows if r[3] == r[1]]
        two = one if rows[0][1] == rows[0][2] else [r for r in rows if r[3] != r[1]]
        if not two or not one:
            return None
        both = common_of_all([r[7] for r in one], [r[7] for r in two])
        p, q = np.array([r[5] for r in one], np.int64), np.array([r[5] for r in two], np.int64)
        yes = den * both >= num * (p[:, None] + q[None, :] - both)
        if two is one:
            np.fill_diagonal(yes, False)
        if counted:
            sides = [(one, yes @ np.array([r[6] for r in two], np.int64))]
            if two is not one:
                sides.append((two, np.array([r[6] for r in one], np.int64) @ yes))
            return pa.RecordBatch.from_arrays([pa.array([r[4] for side, _ in sides for r in side], pa.int64()), pa.array(np.concatenate([c for _, c in sides]), pa.int64())], names=["node", "linked"])
        x, y = np.nonzero(np.triu(yes) if two is one else yes)
        pairs = [sorted((one[i][4], two[j][4])) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64()), pa.array(both[x, y], pa.int64())], names=["a", "b", "common"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key:
                    if held and (made := tile(held)):
                        yield made
                    held, key = [], row[:3]
                held.append(row)
        if held and (made := tile(held)):
            yield made

    done = settled(mapped(each, run, "node long, linked long" if counted else "a long, b long, common long"), "tiles")
    dropped(spark, sets)
    freed(spark)
    return done


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, num: int = 90, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets of n-grams as (a, b, common), once, a < b, and (key, node) of each row (node null without
    n-grams). Rows of one node link too. The first has as many rows as there are links: a group of near copies gives its square."""
    found = _found(docs, key, text, n, num, den)
    members = dealt_join(found.rows, found.small.select("name", "node"), "name", "digest", "left")
    return _tiles(found, n, num, den, counted=False), members.select(F.col("key").alias(key), "node")


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(key, n_shingles, component, n_links): a row for each row of docs. Two texts link when den * common >= num * union of their
    distinct word n-grams; component is the least key that links lead to, the row's own included; n_links is the number of other
    rows that the row links with, copies of a text each counted.

    Null and empty texts have no n-grams and link with nothing: their component is their own key. Rows with a null key take
    part, and never give a component its name. Repeated rows each come out. An empty table gives an empty result.
    """
    found = _found(docs, key, text, n, num, den)
    others = _tiles(found, n, num, den, counted=True).groupBy("node").agg(F.sum("linked").alias("linked"))
    nodes = found.small.select("node", "name", F.col("best.key").alias("own"), "copies").join(others, "node", "left")
    placed = settled(_placed(found).join(found.small.select("node", F.col("best.key").alias("own")), "node"), "placed")
    named = placed.groupBy("root").agg(F.min("own").alias("component"))
    named = dealt_join(placed.select("node", "root"), settled(named, "names"), "root", "node").select("node", "component")
    nodes = settled(nodes.join(named, "node", "left").select("name", F.coalesce("component", "own").alias("component"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "named")
    done = dealt_join(found.rows, nodes, "name", "digest", "left")
    return done.select(F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("name").isNull(), F.col("key")).otherwise(F.col("component")).alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs, with one row of each component: the one with the least key (a null key comes last, then the digest of the text
    decides). Rows without n-grams, null and empty texts among them, all stay; of repeated rows, one. An empty table stays empty.
    Texts aren't shuffled while the keys of rows that go, and of rows that are repeated, number at most BROADCAST_KEYS."""
    found = _found(docs, key, text, n, num, den)
    placed = settled(_placed(found).join(found.small.select("node", "name", "best"), "node"), "placed")
    stays = dealt_join(placed.select("name", "root"), settled(placed.groupBy("root").agg(F.min("best").alias("best")), "names"), "root", "name").select("name", "best")
    alone = found.small.where("copies > 1").join(_placed(found), "node", "left_anti").select("name", "best")
    each = dealt_join(found.rows, settled(stays.union(alone), "stays"), "name", "digest").withColumn("stays", rank() == F.col("best"))
    each = settled(each.groupBy("key", "digest", "stays").agg(F.count(F.lit(1)).alias("c")).where("NOT stays OR c > 1"), "goes")
    few = F.broadcast if each.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else (lambda x: x)
    again = each.where("stays").select("key", "digest")
    own = [docs[f"`{key}`"], F.unhex(F.md5(F.encode(docs[f"`{text}`"], "utf-8")))]

    def met(t: DataFrame):
        return own[0].eqNullSafe(t["key"]) & (own[1] == t["digest"])

    either = each.select("key", "digest")
    left = docs.join(few(either), met(either), "left_anti")
    if again.limit(1).count():
        left = left.union(docs.join(few(again), met(again), "left_semi").dropDuplicates([key, text]))
    return left


#: The same as `linked` with its defaults, by all pairs of texts that share an n-gram.
SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN generate_series(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
h AS MATERIALIZED (SELECT r, g, n FROM s JOIN n USING (r)),
p AS (SELECT a.r AS a, b.r AS b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS c FROM h a JOIN h b ON a.g = b.g AND a.r < b.r AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= 90 * (an + bn - c) UNION ALL SELECT b, a FROM p WHERE 100 * c >= 90 * (an + bn - c)),
t AS (SELECT r, r AS o FROM d UNION SELECT t.r, l.b FROM t JOIN l ON l.a = t.o),
k AS (SELECT t.r, min(o.doc_id) AS least FROM t JOIN d o ON o.r = t.o GROUP BY t.r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE least END AS component_id FROM d JOIN k USING (r) LEFT JOIN n USING (r)
"""
