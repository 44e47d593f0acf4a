"""The engine's tables made from the general test tables: documents as recordings, orders as intervals, and so on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.tables import table

SPLIT = "[ \t\r\n]+"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, SPLIT), "")


def doc_landmarks(spark: SparkSession, sf_dir: str, named: bool = False) -> DataFrame:
    """clip: document, frame: place of a word, hash: of three words in a row. named: a hash that any engine can repeat."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip"), tokens(F.col("text")).alias("w")).where(F.size("w") >= 3)

    def of(i: Column) -> Column:
        w = [F.get("w", i + k) for k in range(3)]
        return F.conv(F.substring(F.md5(F.concat_ws(" ", *w)), 1, 15), 16, 10).cast("bigint") if named else F.xxhash64(*w)

    return docs.select("clip", F.posexplode_outer(F.transform(F.sequence(F.lit(0), F.size("w") - 3), of)).alias("frame", "hash"))


def doc_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))


def order_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, start, end in days: from an order's date to its last shipment, and a day."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source"), F.unix_date(F.to_date("o_orderdate")).cast("bigint").alias("start"), (F.unix_date(F.greatest(F.to_date("last"), F.to_date("o_orderdate"))) + 1).cast("bigint").alias("end"))


def line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between parts and suppliers with made-up figures, all exact in both engines."""
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy(F.col("l_partkey").alias("left"), (F.col("l_suppkey") + 10_000_000).alias("right")).agg(F.count(F.lit(1)).alias("anchors"), F.max("l_quantity").alias("q"), F.min("l_discount").alias("d"), F.max("l_tax").alias("t")).select(
        "left", "right", (F.col("q") / 50).alias("confidence"), "anchors", F.col("q").alias("covered"), F.col("t").alias("residual"), F.when(F.col("left") % 7 == 0, "span").when(F.col("left") % 5 == 0, "timecode").otherwise("waveform").alias("evidence"))


#: Documents of a tape, the bytes that it has at least, where its takes begin, and samples of a block.
PER_TAPE, LEAST_TAPE, SHIFTS, TAPE_BLOCK = 250, 480_000, (0, 65_596, 131_196), 1 << 17


def tapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound (clip, first, samples) of which each sample is a byte of a text: the documents of a tape (250 numbers in a row) one behind another,
    in three takes that begin at SHIFTS. Takes are numbered tape * 10 + k. A byte stands for a fixed random amplitude."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.floor(F.col("doc_id") / PER_TAPE).alias("scene"), "doc_id", F.encode("text", "utf-8").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loud = np.random.default_rng(1).normal(size=256).astype(np.float32)
        scene, held, begin, blocks = None, bytearray(), 0, [0] * len(SHIFTS)  # held: the tape from byte `begin` on; blocks: the next of each take

        def cut(least: int) -> Iterator[pa.RecordBatch]:
            for k, shift in enumerate(SHIFTS):
                while len(part := held[(at := shift + blocks[k] * TAPE_BLOCK - begin) : at + TAPE_BLOCK]) >= least:
                    yield pa.RecordBatch.from_arrays([pa.array([scene * 10 + k], pa.int64()), pa.array([blocks[k] * TAPE_BLOCK], pa.int64()), pa.array([loud[np.frombuffer(part, np.uint8)]], pa.list_(pa.float32()))], names=["clip", "first", "samples"])
                    blocks[k] += 1

        for batch in batches:
            for own, text in zip(batch.column("scene").to_pylist(), batch.column("b"), strict=True):
                if own != scene:
                    yield from cut(1)
                    scene, held, begin, blocks = own, bytearray(), 0, [0] * len(SHIFTS)
                held += text.as_buffer()
                yield from cut(TAPE_BLOCK)
                done = min(len(held), min(shift + n * TAPE_BLOCK for shift, n in zip(SHIFTS, blocks, strict=True)) - begin)
                del held[:done]
                begin += done
        yield from cut(1)

    # Texts are shuffled once, and a task reads a tape as it comes, a block or so in hand.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartition(tasks, "scene").sortWithinPartitions("scene", "doc_id", "b").mapInArrow(run, "clip bigint, first bigint, samples array<float>")


def tape_edges(spark: SparkSession, sf_dir: str, off: float) -> DataFrame:
    """Edges between the takes of each tape of LEAST_TAPE bytes or more, `off` seconds beside the truth: sure ones from the first take,
    a weak one between the others."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy(F.floor(F.col("doc_id") / PER_TAPE).alias("scene")).agg(F.sum(F.octet_length(F.encode("text", "utf-8"))).alias("n")).where(F.col("n") >= LEAST_TAPE)
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit((SHIFTS[a] - SHIFTS[b]) / 16_000).alias("o"), F.lit(c).alias("c")) for a, b, c in ((0, 1, 0.9), (0, 2, 0.88), (1, 2, 0.7))))
    e = docs.withColumn("e", F.explode(pairs))
    start = -F.col("e.o")
    return e.select(
        (F.col("scene") * 10 + F.col("e.a")).alias("left"), (F.col("scene") * 10 + F.col("e.b")).alias("right"), F.lit(1.0).alias("rate"), (F.col("e.o") + off).alias("offset"), F.col("e.c").alias("confidence"), F.lit(100).cast("bigint").alias("anchors"),
        (start + 2.0).alias("left_start"), (start + 20.0).alias("left_end"), F.lit(18.0).alias("covered"), F.lit(0.02).alias("residual"), F.array().cast("array<struct<left:double,right:double>>").alias("points"), F.lit("waveform").alias("evidence"),
    )
