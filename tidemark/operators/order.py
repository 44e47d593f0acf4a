"""Order of clips on their tracks, and edges that would break it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def order_context(clips: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """(clip, track, as_imported, by_date, by_name, imported), ranks from 0.

    clips: clip, kind, source, position, recorded, name. edits: clip, media, track_index, start, edit. A clip on an imported
    track takes the rank of its first edit there (the first track in order of name); others are grouped by kind and source and
    take their position. Clips without a date come last.
    """
    own = clips.select("clip", F.concat_ws(":", "kind", "source").alias("track"), F.col("position").cast("bigint").alias("as_imported"), "recorded", F.lower("name").alias("key"))
    if edits is not None:
        on = edits.select("clip", F.concat_ws(":", "media", "track_index").alias("track"), "start", "edit")
        first = on.groupBy("clip", "track").agg(F.min(F.struct("start", "edit")).alias("f"))
        once = first.withColumn("rn", F.row_number().over(Window.partitionBy("clip").orderBy("track"))).where("rn = 1")
        ranked = once.select("clip", F.col("track").alias("t"), (F.row_number().over(Window.partitionBy("track").orderBy("f.start", "f.edit")) - 1).cast("bigint").alias("r"))
        own = own.join(ranked, "clip", "left").select("clip", F.coalesce("t", "track").alias("track"), F.coalesce("r", "as_imported").alias("as_imported"), "recorded", "key", F.col("t").isNotNull().alias("imported"))
    else:
        own = own.withColumn("imported", F.lit(False))

    def rank(*by):
        return (F.row_number().over(Window.partitionBy("track").orderBy(*by)) - 1).cast("bigint")

    return own.select("clip", "track", "as_imported", rank(F.col("recorded").asc_nulls_last(), F.col("clip")).alias("by_date"), rank(F.col("key"), F.col("clip")).alias("by_name"), "imported")


def ordered_edges(edges: DataFrame, context: DataFrame, modes: DataFrame | None = None, default: str = "auto") -> DataFrame:
    """C20: edges with the lower and higher track and the ranks there; all four null where order says nothing: one track, an end
    without a place, an end that ignores order, or both on auto. modes: clip, mode (auto, ignore, imported, date, name)."""
    c = context if modes is None else context.join(modes, "clip", "left")
    mode = F.lit(default) if modes is None else F.coalesce("mode", F.lit(default))
    rank = F.when(mode == "date", F.col("by_date")).when(mode == "name", F.col("by_name")).otherwise(F.col("as_imported"))
    c = c.select("clip", "track", mode.alias("mode"), rank.alias("rank"))
    both = edges.join(c.toDF("left", "lt", "lm", "lr"), "left", "left").join(c.toDF("right", "rt", "rm", "rr"), "right", "left")
    says = (F.col("lt") != F.col("rt")) & (F.col("lm") != "ignore") & (F.col("rm") != "ignore") & ~((F.col("lm") == "auto") & (F.col("rm") == "auto"))
    low = F.col("lt") < F.col("rt")

    def pick(a: str, b: str):
        return F.when(says, F.when(low, F.col(a)).otherwise(F.col(b)))

    return both.select(*(F.col(x) for x in edges.columns), pick("lt", "rt").alias("low_track"), pick("rt", "lt").alias("high_track"), pick("lr", "rr").alias("low_rank"), pick("rr", "lr").alias("high_rank"))


def uncrossed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges between two tracks, strongest first: one that crosses an accepted one goes. Accepted ranks are monotone, so only the
    neighbours of a rank have to be asked."""
    import bisect

    lows: list[int] = []
    span: dict[int, tuple[int, int]] = {}
    keep = []
    for row in pdf.sort_values(["confidence", "position"], ascending=[False, True]).itertuples():
        i = bisect.bisect_left(lows, row.low_rank)
        j = i + 1 if i < len(lows) and lows[i] == row.low_rank else i
        fits = (i == 0 or span[lows[i - 1]][1] <= row.high_rank) and (j == len(lows) or span[lows[j]][0] >= row.high_rank)
        if fits:
            if j == i:
                lows.insert(i, row.low_rank)
                span[row.low_rank] = (row.high_rank, row.high_rank)
            else:
                a, b = span[row.low_rank]
                span[row.low_rank] = (min(a, row.high_rank), max(b, row.high_rank))
            keep.append(row.Index)
    return pdf.loc[sorted(keep)]


def enforce_clip_order(edges: DataFrame, context: DataFrame, modes: DataFrame | None = None, default: str = "auto") -> DataFrame:
    """Of edges (with `position`) between each pair of ordered tracks the strongest set that doesn't cross. Edges of file
    parts, and those on which order says nothing, stay."""
    e = ordered_edges(edges, context, modes, default)
    free = (F.col("evidence") == "span") | F.col("low_track").isNull()
    kept = e.where(~free).groupBy("low_track", "high_track").applyInPandas(uncrossed, e.schema)
    return e.where(free).unionByName(kept).select(*edges.columns)


def enforce_track_content(edges: DataFrame, context: DataFrame, modes: DataFrame | None = None, default: str = "auto") -> DataFrame:
    """Edges inside one track go if an end says linear; they stay if one says takes; on auto they go for imported tracks."""
    c = context if modes is None else context.join(modes, "clip", "left")
    mode = F.lit(default) if modes is None else F.coalesce("mode", F.lit(default))
    c = c.select("clip", "track", mode.alias("mode"), "imported")
    both = edges.join(c.toDF("left", "lt", "lm", "li"), "left", "left").join(c.toDF("right", "rt", "rm", "ri"), "right", "left")
    other = (F.col("evidence") == "span") | F.col("lt").isNull() | F.col("rt").isNull() | (F.col("lt") != F.col("rt"))
    linear, takes = (F.col("lm") == "linear") | (F.col("rm") == "linear"), (F.col("lm") == "takes") | (F.col("rm") == "takes")
    return both.where(F.when(other, True).when(linear, False).when(takes, True).otherwise(~F.col("li"))).select(*edges.columns)
