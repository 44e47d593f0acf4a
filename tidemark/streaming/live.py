"""Streams: landmarks that arrive late, live matches, and the adaptive channel, with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.operators import graph
from tidemark.operators.matching import clip_pairs, group_cap, guarded, winners
from tidemark.operators.signal import mono_channel
from tidemark.tables import settled


def windowed_landmarks(stream: DataFrame, late: str = "10 minutes", length: str = "5 minutes") -> DataFrame:
    """Landmarks (ts, clip, hash, frame) counted by event-time window and clip; what comes later than `late` is dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", length), "clip").agg(F.count(F.lit(1)).alias("landmarks"), F.approx_count_distinct("hash").alias("hashes"))


class LiveVotes:
    """Votes kept up as landmarks arrive in batches: each batch is joined with all landmarks so far and with itself, and its votes
    are added as a delta, so no batch repeats the work of those before. Both tables are Parquet folders; use as
    `stream.writeStream.foreachBatch(LiveVotes(path)).start()`. A batch that runs twice writes the same folders again."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def __call__(self, batch: DataFrame, number: int) -> None:
        new = batch.select("clip", "hash", "frame").dropDuplicates()
        new.write.mode("overwrite").parquet(f"{self.path}/landmarks/batch={number}")
        spark = batch.sparkSession
        every = spark.read.parquet(f"{self.path}/landmarks").where(F.col("batch") <= number)
        new = every.where(F.col("batch") == number).drop("batch")
        old = every.where(F.col("batch") < number).drop("batch")
        l, r = new.select("hash", F.col("clip").alias("a"), F.col("frame").alias("af")), old.select("hash", F.col("clip").alias("b"), F.col("frame").alias("bf"))
        cross = l.join(r, "hash").where("a <> b").select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"), F.when(F.col("a") < F.col("b"), F.col("bf") - F.col("af")).otherwise(F.col("af") - F.col("bf")).alias("d"))
        own = clip_pairs(new).select("left", "right", (F.col("rf") - F.col("lf")).alias("d"))
        delta = cross.union(own).groupBy("left", "right", F.floor(F.col("d") / S.BUCKET).alias("bucket")).agg(F.count(F.lit(1)).alias("votes"))
        delta.write.mode("overwrite").parquet(f"{self.path}/votes/batch={number}")

    def best(self, spark) -> DataFrame:
        """Clear winners by now. (Votes of hashes that have become too frequent are not taken back, as the cap of the batch version
        would: compare on inputs below it.)"""
        votes = spark.read.parquet(f"{self.path}/votes").groupBy("left", "right", "bucket").agg(F.sum("votes").alias("votes"))
        return guarded(winners(votes)).where("clear").drop("clear")


def over_cap(landmarks: DataFrame, n_clips: int) -> DataFrame:
    """Hashes that occur more often than the cap of so many clips."""
    return landmarks.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > group_cap(F.lit(n_clips)))


def live_matches(events: DataFrame) -> DataFrame:
    """The state of each unordered pair after its events (seq, left, right, kind, offset, confidence): candidates and refined
    ones replace what was there, rejected ones delete it. In a batch: the last event decides."""
    low = events.select(F.least("left", "right").alias("low"), F.greatest("left", "right").alias("high"), F.when(F.col("left") <= F.col("right"), F.col("offset")).otherwise(-F.col("offset")).alias("offset"), "seq", "kind", "confidence")
    last = low.groupBy("low", "high").agg(F.max_by(F.struct("kind", "offset", "confidence"), "seq").alias("e"))
    return last.where(F.col("e.kind") != "rejected").select("low", "high", F.col("e.kind").alias("kind"), F.col("e.offset").alias("offset"), F.col("e.confidence").alias("confidence"))


def live_matches_stream(events: DataFrame) -> DataFrame:
    """The same of a stream: a row (low, high, kind, offset, confidence) whenever a pair changes; `deleted` ends it. State is one
    event a pair."""
    low = events.select(F.least("left", "right").alias("low"), F.greatest("left", "right").alias("high"), F.when(F.col("left") <= F.col("right"), F.col("offset")).otherwise(-F.col("offset")).alias("offset"), "seq", "kind", "confidence")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seq, kind = state.get if state.exists else (-1, "none")
        latest = None
        for pdf in batches:
            row = pdf.loc[pdf.seq.idxmax()]
            if row.seq > seq:
                seq, kind, latest = int(row.seq), row.kind, row
        state.update((seq, kind))
        if latest is not None:
            yield pd.DataFrame([{"low": key[0], "high": key[1], "kind": "deleted" if kind == "rejected" else kind, "offset": float(latest.offset), "confidence": float(latest.confidence)}])

    return low.groupBy("low", "high").applyInPandasWithState(step, "low bigint, high bigint, kind string, offset double, confidence double", "seq bigint, kind string", "update", "NoTimeout")


def adaptive_channel_stream(blocks: DataFrame) -> DataFrame:
    """B12 on a stream of blocks (clip, block, energies): (clip, block, channel). State is the last choice of each clip."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches)).sort_values("block")
        energies = np.stack(pdf.energies.to_numpy())
        picks = []
        for row in energies:
            loudest = int(mono_channel(row[None])[0])
            before = before if before is not None and before < len(row) and row[before] >= 0.9 * row[loudest] else loudest
            picks.append(before)
        state.update((before,))
        yield pd.DataFrame({"clip": key[0], "block": pdf.block.to_numpy(), "channel": picks})

    kind = dict(blocks.dtypes)["clip"]
    return blocks.groupBy("clip").applyInPandasWithState(step, f"clip {kind}, block bigint, channel int", "channel int", "append", "NoTimeout")


class LiveGroups:
    """E10 of a stream: provisional groups kept up as matches come, change and go. Use as `events.writeStream.foreachBatch(LiveGroups(path)).start()`.

    events: seq, left, right, kind (candidate, refined, rejected), offset, confidence. State are two tables in folders, each batch a part
    of its own: pairs (their last event by seq, rejected ones as marks) and clips (root, start). A batch reads the groups that its pairs
    touch, walks those anew with what has changed, and writes those: a match that comes joins two groups, one that goes takes its
    group apart, and other groups are neither read nor written. What a clip or pair is now is its row of the last part. Every
    `merge_every` batches parts become one. A batch that runs twice writes the same part again.
    """

    EDGES = "low bigint, high bigint, seq bigint, kind string, offset double, confidence double"
    CLIPS = "clip bigint, root bigint, start double"

    def __init__(self, path: str, merge_every: int = 20):
        self.path, self.merge_every = path.rstrip("/"), merge_every

    def _now(self, spark: SparkSession, what: str, keys: list[str], before: int) -> DataFrame:
        """Of each key the row of its last part before batch number `before`."""
        kind = self.EDGES if what == "pairs" else self.CLIPS
        base = max((n for n in self._parts(spark, f"{what}-merged") if n < before), default=-1)
        parts = [f"{self.path}/{what}-merged/{base}"] * (base >= 0) + [f"{self.path}/{what}/{n}" for n in self._parts(spark, what) if base < n < before]
        if not parts:
            return spark.createDataFrame([], kind)
        rows = spark.read.schema(f"{kind}, part bigint").parquet(*parts)
        values = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "part").alias("v")).select(*keys, "v.*").drop("part")

    def _parts(self, spark: SparkSession, what: str) -> list[int]:
        """Numbers of the parts that are whole: a writer leaves its mark last."""
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = [s.getPath() for s in fs.listStatus(folder)]
        return sorted(int(p.getName()) for p in found if p.getName().isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _write(self, df: DataFrame, what: str, number: int) -> None:
        df.withColumn("part", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.path}/{what}/{number}")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        pairs, clips = self._now(spark, "pairs", ["low", "high"], number), self._now(spark, "clips", ["clip"], number)
        turned = F.col("left") > F.col("right")
        came = batch.where("left <> right").select(F.least("left", "right").alias("low"), F.greatest("left", "right").alias("high"), "seq", "kind", F.when(turned, -F.col("offset")).otherwise(F.col("offset")).alias("offset"), "confidence")
        last = came.groupBy("low", "high").agg(F.max_by(F.struct("seq", "kind", "offset", "confidence"), "seq").alias("e")).select("low", "high", "e.*")
        new = last.join(pairs.select("low", "high", F.col("seq").alias("had")), ["low", "high"], "left").where(F.col("had").isNull() | (F.col("seq") > F.col("had"))).drop("had")
        new = settled(new.select(*(c.split()[0] for c in self.EDGES.split(", "))), "changed")

        touched = new.select(F.explode(F.array("low", "high")).alias("clip")).distinct()
        roots = clips.join(touched, "clip", "left_semi").select("root").distinct()
        members = settled(clips.join(roots, "root", "left_semi").select("clip").union(touched).distinct(), "members")
        held = pairs.join(members.select(F.col("clip").alias("low")), "low", "left_semi").join(new, ["low", "high"], "left_anti")
        edges = held.select(*new.columns).unionByName(new).where("kind <> 'rejected'").select(F.col("low").alias("left"), F.col("high").alias("right"), "offset")
        self._write(graph.provisional(members, edges), "clips", number)
        self._write(new, "pairs", number)
        if number and number % self.merge_every == 0:
            for what, keys in (("clips", ["clip"]), ("pairs", ["low", "high"])):
                self._write(self._now(spark, what, keys, number + 1), f"{what}-merged", number)

    def groups(self, spark: SparkSession) -> DataFrame:
        """All clips that a match has touched, with root and start, as of the last whole batch."""
        return self._now(spark, "clips", ["clip"], self._last(spark))

    def matches(self, spark: SparkSession) -> DataFrame:
        """All pairs that are matches now (left, right, kind, offset, confidence)."""
        return self._now(spark, "pairs", ["low", "high"], self._last(spark)).where("kind <> 'rejected'").select(F.col("low").alias("left"), F.col("high").alias("right"), "kind", "offset", "confidence")

    def _last(self, spark: SparkSession) -> int:
        """One more than the number of the last batch that has written both of its parts."""
        return 1 + max((set(self._parts(spark, "clips")) & set(self._parts(spark, "pairs"))), default=-1)
