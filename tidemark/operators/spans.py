"""Recordings in several files: consecutive parts, and what is wrong with a set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S


def compatible(a: str = "a", b: str = "b") -> Column:
    """Both are sound alone, with the same streams and the same number of parts."""
    return (F.col(f"{a}.kind") == "audio") & (F.col(f"{b}.kind") == "audio") & F.col(f"{a}.layout").eqNullSafe(F.col(f"{b}.layout")) & F.col(f"{a}.part_count").eqNullSafe(F.col(f"{b}.part_count"))


def single_parts(parts: DataFrame) -> DataFrame:
    """parts: set_id, part, part_count, clip, kind, layout, duration. Those whose number no other part of the set has."""
    alone = parts.groupBy("set_id", "part").agg(F.count(F.lit(1)).alias("c")).where("c = 1").select("set_id", "part")
    return parts.join(alone, ["set_id", "part"], "left_semi")


def span_edges(parts: DataFrame) -> DataFrame:
    """An edge from each part to the next one where both are single and compatible: the right part begins where the left ends."""
    one = single_parts(parts)
    a, b = one.alias("a"), one.withColumn("after", F.col("part") - 1).alias("b")
    met = a.join(b, (F.col("a.set_id") == F.col("b.set_id")) & (F.col("a.part") == F.col("b.after"))).where(compatible())
    d = F.col("a.duration")
    return met.select(
        F.col("a.clip").alias("left"), F.col("b.clip").alias("right"), F.lit(1.0).alias("rate"), (-d).alias("offset"), F.lit(S.SPAN_CONFIDENCE).alias("confidence"), F.lit(S.SPAN_ANCHORS).cast("bigint").alias("anchors"),
        F.lit(0.0).alias("left_start"), d.alias("left_end"), d.alias("covered"), F.lit(0.0).alias("residual"), F.array().cast("array<struct<left:double,right:double>>").alias("points"), F.lit("span").alias("evidence"),
    )


def diagnostics(parts: DataFrame) -> DataFrame:
    """For each set with something wrong: conflict (part counts differ), missing, duplicate and incompatible numbers, in order.

    A number is incompatible with the next one if either is not single or they don't fit. Missing ones are known only where all
    files agree on the count."""
    sets = parts.groupBy("set_id").agg(F.count_distinct("part_count").alias("declared"), F.max("part_count").alias("expected"), F.sort_array(F.collect_set("part")).alias("present"))
    twice = parts.groupBy("set_id", "part").agg(F.count(F.lit(1)).alias("c")).where("c > 1").groupBy("set_id").agg(F.sort_array(F.collect_list("part")).alias("duplicate"))
    edges = single_parts(parts)
    a, b = edges.alias("a"), edges.withColumn("after", F.col("part") - 1).alias("b")
    good = a.join(b, (F.col("a.set_id") == F.col("b.set_id")) & (F.col("a.part") == F.col("b.after"))).where(compatible()).groupBy(F.col("a.set_id").alias("set_id")).agg(F.collect_set("a.part").alias("good"))
    out = sets.join(twice, "set_id", "left").join(good, "set_id", "left")
    none = F.array().cast(parts.select(F.array("part")).dtypes[0][1])
    pairs = F.filter("present", lambda p: F.array_contains("present", p + 1))
    out = out.select(
        "set_id", (F.col("declared") != 1).alias("conflict"),
        F.when((F.col("declared") == 1) & (F.col("expected") > 0), F.array_except(F.sequence(F.lit(1).cast(parts.schema["part"].dataType), F.col("expected").cast(parts.schema["part"].dataType)), F.col("present"))).otherwise(none).alias("missing"),
        F.coalesce("duplicate", none).alias("duplicate"), F.array_except(pairs, F.coalesce("good", none)).alias("incompatible"),
    )
    return out.where(F.col("conflict") | (F.size("missing") > 0) | (F.size("duplicate") > 0) | (F.size("incompatible") > 0))


def message(missing: Column, duplicate: Column, incompatible: Column, conflict: Column) -> Column:
    """The diagnostics of a set as one sentence."""
    def listed(name: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(name), F.array_join(items.cast("array<string>"), ", ")))

    pairs = F.transform(incompatible, lambda n: F.concat_ws("-", n, n + 1))
    details = F.concat_ws("; ", F.when(conflict, F.lit("conflicting part counts")), listed("missing ", missing), listed("duplicate ", duplicate), listed("incompatible parts ", pairs))
    return F.concat(F.lit("Incomplete linked BWF file-set: "), details, F.lit("."))
