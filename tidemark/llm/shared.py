"""Small helpers that every operator of this subpackage uses."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, and nothing else: `lower` would also change other letters."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column) -> Column:
    """Runs of letters, digits of ASCII and all characters beyond it; null has none. (`split` is some fifteen times faster than
    `regexp_extract_all`, which makes a result object, with the text in it, of every match.)"""
    return F.coalesce(F.array_remove(F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), ""), F.array().cast("array<string>"))


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df less the columns that an operator is about to add; names compare without case, as Spark resolves them."""
    added = {n.lower() for n in names}
    kept = [c for c in df.columns if c.lower() not in added]
    return df.select(*(df[f"`{c}`"] for c in kept)) if len(kept) < len(df.columns) else df


def aside(df: DataFrame, names: Iterable[str]) -> list[Column]:
    """Columns of df under names (c0, c1, ...) that no other column of an operator has; `back` gives them their own again."""
    return [df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)]


def back(names: Iterable[str]) -> list[Column]:
    return [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session without it a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/tidemark/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def settled(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, and a lost executor costs no recomputation."""
    spark, path = df.sparkSession, scratch(df.sparkSession, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a settled frame that nothing will read again."""
    jvm = spark._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def freed(spark: SparkSession) -> None:
    """Have shuffle files of finished jobs deleted now. Spark does so when the driver's garbage collector finds that nothing refers
    to them, which on an idle driver may be never."""
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.3)


#: Rows of one key from which `dealt_join` splits it, and the share of all rows from which it does.
HOT_ROWS, HOT_SHARE = 500, 1 / 1000


def dealt_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """left joined with right, which has one row for each key. Keys with more than HOT_SHARE of left's rows, of which there can be
    no more than 1 / HOT_SHARE, are split between tasks by a hash of left's column `by`, and their rows of right repeated.
    counts: left's keys and how many rows of left have them, where that is known."""
    counts = counts or left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    size = counts.agg(F.sum("c").alias("all"), F.max("c").alias("most")).first()
    most = max(HOT_ROWS, math.ceil((size["all"] or 0) * HOT_SHARE))
    if (size["most"] or 0) <= most:
        return left.join(right, key, how)
    hot = [(r[0], math.ceil(r[1] / most)) for r in counts.select(key, "c").where(F.col("c") > most).collect()]  # 1 / HOT_SHARE rows at most
    dealt = F.broadcast(left.sparkSession.createDataFrame(hot, T.StructType([T.StructField(key, left.schema[key].dataType), T.StructField("__d", T.IntegerType())])))
    split = left.join(dealt, key, "left").withColumn("__salt", F.when(F.col("__d").isNotNull(), F.pmod(F.xxhash64(by), F.col("__d")).cast("int")).otherwise(0)).drop("__d")
    again = right.join(dealt, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__d", F.lit(1)) - 1))).drop("__d")
    return split.join(again, [key, "__salt"], how).drop("__salt")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function over Arrow batches, without passes of Python's collector while it lasts (tables of many small objects hold no
    cycles). Afterwards the worker, which Spark keeps for later tasks, gives back the memory that it no longer uses."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied


#: Rows of a batch of texts. Spark's default of 10,000 takes tens of megabytes for each side of each Python task.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Have Arrow batches of this session hold no more than BATCH_ROWS rows: with texts, memory is what rows cost."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow for texts: batches are small, and `run` is tidied."""
    small_batches(df.sparkSession)
    return df.mapInArrow(tidy(run), schema)


def grouped(batch: pa.RecordBatch, at: int, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text in column `at` each, one row at least: long texts don't add up."""
    first, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(at)).to_pylist()):
        if held and held + (n or 0) > chars:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n or 0
    if batch.num_rows:
        yield batch.slice(first)
