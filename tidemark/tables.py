"""Reading tables, and writing intermediate ones where driver and executors both see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in a local session without it a temporary folder, which is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settled(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, *keys) -> DataFrame:
    """df settled in ranges of its order by keys; `range` numbers them in that order. Equal keys are in one range."""
    return settled(df.repartitionByRange(*keys).withColumn("range", F.spark_partition_id()), "ranged")


def numbered(df: DataFrame, *keys, name: str = "n", first: int = 0) -> DataFrame:
    """df with `name`: its place in the order by keys, from `first`. Rows are counted inside ranges, and offset by the ranges before;
    what is broadcast has a row for each range."""
    parts = ranged(df, *keys)
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = parts.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*keys))
    return parts.join(F.broadcast(offsets), "range").withColumn(name, F.col("__before") + place + (first - 1)).drop("range", "__before")


#: A hub is a key with more than one in so many of all rows: there can't be more hubs than that. Below LEAST_HUB rows a key is none.
HUBS, LEAST_HUB = 4096, 10_000


def hub_join(left: DataFrame, right: DataFrame, key: str, rows: str = "rows") -> DataFrame:
    """left joined with right, which has one row a key and in `rows` how many rows of left have it; right's `rows` doesn't come out.

    Hubs' rows of right, HUBS at most, go to all tasks, so a hub's rows of left stay where they are; no other key is hot. Both are read
    several times: settle them."""
    size = right.agg(F.sum(rows).alias("all"), F.max(rows).alias("most")).first()  # one row
    if (size["most"] or 0) * HUBS <= (size["all"] or 0) or size["most"] < LEAST_HUB:
        return left.join(right.drop(rows), key)
    is_hub = (F.col(rows) * HUBS > size["all"]) & (F.col(rows) >= LEAST_HUB)
    hubs = F.broadcast(right.where(is_hub).drop(rows))
    rest = left.join(F.broadcast(hubs.select(key)), key, "left_anti").join(right.where(~is_hub).drop(rows), key)
    return left.join(hubs, key).select(*rest.columns).unionByName(rest)
