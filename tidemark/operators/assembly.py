"""Timelines: imported edits moved to where their media lies, islands put one after another."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import schema as S
from tidemark.functions.mapping import value_at
from tidemark.functions.names import track_key
from tidemark.tables import numbered, settled


def consistent_median(column: str):
    """Aggregate: the median in the middle of two, null if values are more than two seconds apart."""
    c = F.col(column)
    return F.when((F.count(c) == 1) | (F.max(c) - F.min(c) <= 2.0), F.percentile(c, 0.5))


def upper_median(column: str) -> Column:
    """Aggregate: the value in the middle, the upper one of two. It merges: tasks send their distinct values with their counts."""
    return F.expr(f"percentile_disc(0.5 + 1e-9) WITHIN GROUP (ORDER BY `{column}`)")


def line_fit(x: str, y: str) -> Column:
    """Aggregate: slope and intercept of the line of least squares, and the root mean square of what it leaves."""
    slope = F.regr_slope(y, x)
    left = F.greatest(F.lit(0.0), F.regr_syy(y, x) - slope * F.regr_sxy(y, x)) / F.regr_count(y, x)
    return F.struct(slope.alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.sqrt(left).alias("residual"))


def chronology(items: DataFrame) -> DataFrame:
    """(island, kind, origin): 0 by recording dates, 1 by timecodes, else 2 by number. items: island, start, recorded, tc."""
    d = items.withColumns({"r": F.col("recorded") - F.col("start"), "t": F.col("tc") - F.col("start")}).groupBy("island").agg(consistent_median("r").alias("r"), consistent_median("t").alias("t"))
    return d.select("island", F.when(F.col("r").isNotNull(), 0).when(F.col("t").isNotNull(), 1).otherwise(2).alias("kind"), F.coalesce("r", "t", F.col("island").cast("double")).alias("origin"))


def positions(islands: pd.DataFrame, gap: float = 1.0, prevent_overlaps: bool = False) -> pd.DataFrame:
    """Shifts of a project's islands (island, kind, origin, low, high, sources), in order of kind, origin and number.

    Islands placed by a clock keep their distances inside a group; a recorded one ends a group when it is 16 hours or more after
    the group's first. Then long gaps shrink to `gap`, and islands that share a source don't overlap.
    """
    rows = islands.sort_values(["kind", "origin", "island"]).to_dict("records")
    placed, cursor, i = [], 0.0, 0
    while i < len(rows):
        first = rows[i]
        j = i + 1
        if first["kind"] < 2:
            while j < len(rows) and rows[j]["kind"] == first["kind"] and not (first["kind"] == 0 and abs(rows[j]["origin"] - first["origin"]) >= S.DAY_GATE):
                j += 1
        group = rows[i:j]
        zero = min(r["origin"] + r["low"] for r in group) if first["kind"] < 2 else None
        end = cursor
        for r in group:
            shift = cursor - r["low"] if zero is None else cursor + r["origin"] - zero
            if prevent_overlaps:
                shift = max(shift, end - r["low"])
            placed.append((r, shift))
            end = max(end, r["high"] + shift)
        cursor, i = end + gap, j
    out, ends, last = [], {}, None
    for r, shift in placed:
        start = r["low"] + shift
        if last is not None:
            start = min(start, last + gap)
        start = max([start, *(ends[s] + gap for s in r["sources"] if s in ends)])
        if prevent_overlaps and last is not None:
            start = max(start, last + gap)
        shift = start - r["low"]
        end = r["high"] + shift
        ends |= {s: max(end, ends.get(s, end)) for s in r["sources"]}
        last = end if last is None else max(last, end)
        out.append({"island": r["island"], "shift": shift})
    return pd.DataFrame(out, columns=["island", "shift"])


def positioned(items: DataFrame, gap: float = 1.0, prevent_overlaps: bool = False, project: str = "project") -> DataFrame:
    """Shifts of all islands of all projects. items: project, island, start, end, source, recorded, tc.

    Projects run in parallel; inside one, positions follow one from another, so they are a fold over its islands."""
    d = items.withColumns({"r": F.col("recorded") - F.col("start"), "t": F.col("tc") - F.col("start")})
    each = d.groupBy(project, "island").agg(consistent_median("r").alias("r"), consistent_median("t").alias("t"), F.min("start").alias("low"), F.max("end").alias("high"), F.sort_array(F.collect_set("source")).alias("sources"))
    rows = each.select(project, "island", F.when(F.col("r").isNotNull(), 0).when(F.col("t").isNotNull(), 1).otherwise(2).alias("kind"), F.coalesce("r", "t", F.col("island").cast("double")).alias("origin"), "low", "high", "sources")
    kinds = dict(items.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return positions(pdf, gap, prevent_overlaps).assign(**{project: pdf[project].iloc[0]})[[project, "island", "shift"]]

    return rows.groupBy(project).applyInPandas(one, f"`{project}` {kinds[project]}, island {kinds['island']}, shift double")


def combined(items: DataFrame, shifts: DataFrame, project: str = "project") -> DataFrame:
    """K4: items moved by their island's shift."""
    return items.join(shifts, [project, "island"]).withColumns({"start": F.col("start") + F.col("shift"), "end": F.col("end") + F.col("shift")}).drop("shift")


def track_shifts(edits: DataFrame, placements: DataFrame, preserved: tuple[str, ...] = ()) -> DataFrame:
    """(track, shift) of imported tracks: the median by which edits move, less the median over preserved tracks, which stay.

    edits: clip, media, track_index, source_in, timeline_start. placements: clip, points."""
    moved = edits.join(placements.select("clip", "points"), "clip").select(track_key(F.col("media"), F.col("track_index")).alias("track"), (value_at(F.col("points"), F.col("source_in")) - F.col("timeline_start")).alias("d"))
    medians = moved.groupBy("track").agg(F.percentile("d", 0.5).alias("median"))
    fixed = F.col("track").isin(*preserved) if preserved else F.lit(False)
    anchor = medians.where(fixed).agg(F.percentile("median", 0.5).alias("anchor"))  # one row
    return medians.join(F.broadcast(anchor)).select("track", F.when(fixed, 0.0).otherwise(F.col("median") - F.coalesce("anchor", F.lit(0.0))).alias("shift"))


def placed_edits(edits: DataFrame, shifts: DataFrame, clips: DataFrame) -> DataFrame:
    """Edits on the new timeline. Without a placed clip or a shift an edit goes; its source ends with the clip. Linked
    sound moves with its own track, else with the picture. clips: clip, duration."""
    s = shifts.select(F.col("track").alias("t"), "shift")
    e = edits.withColumn("track", track_key(F.col("media"), F.col("track_index"))).join(s, F.col("track") == F.col("t")).drop("t").join(clips.select("clip", "duration"), "clip")
    a = shifts.select(F.col("track").alias("at"), F.col("shift").alias("audio_shift"))
    e = e.withColumn("linked_track", F.when(F.col("linked_index").isNotNull(), track_key(F.lit("audio"), F.col("linked_index")))).join(a, F.col("linked_track") == F.col("at"), "left").drop("at")
    return e.select(
        F.concat(F.lit("imported-"), "media", F.lit("-"), F.col("edit").cast("string")).alias("instance"), "clip", "track", (F.col("timeline_start") + F.col("shift")).alias("start"),
        F.greatest(F.lit(0.0), F.col("source_in")).alias("source_in"), F.least("source_out", "duration").alias("source_out"), F.greatest(F.lit(0.0), F.col("timeline_end") - F.col("timeline_start")).alias("length"),
        F.when(F.col("linked_index").isNotNull(), F.col("timeline_start") + F.coalesce("audio_shift", "shift")).alias("linked_start"),
    )


def assembled(placements: DataFrame, clips: DataFrame) -> DataFrame:
    """K3, K7: items of all islands, and of unmatched clips as islands of their own behind them, as flat rows.

    placements: clip, island (null: unmatched), offset, rate; clips: clip, kind, duration, source."""
    rows = settled(clips.join(placements.select("clip", "island", "offset", "rate", "confidence"), "clip", "left"), "placed")
    last = rows.agg(F.coalesce(F.max("island") + 1, F.lit(0)).alias("n"))  # one row
    alone = numbered(rows.where("island IS NULL"), "clip", name="k").join(F.broadcast(last)).withColumn("island", F.col("n") + F.col("k")).drop("n", "k").withColumns({"offset": F.lit(0.0), "rate": F.lit(1.0), "confidence": F.lit(0.0)})
    out = rows.where("island IS NOT NULL").withColumn("synced", F.lit(True)).unionByName(alone.withColumn("synced", F.lit(False)))
    return out.select("clip", "island", "kind", "source", F.col("offset").alias("start"), (F.col("offset") + F.col("duration") * F.col("rate")).alias("end"), "confidence", "synced")


def digest(columns: list[str]) -> Column:
    """Aggregate: a digest of the rows as a multiset, whatever their order. It merges: how many there are, and sums of the
    eight 32-bit parts of a hash of each row. Sums of equal multisets are equal; different ones agree by accident with a
    chance of about 2 ** -128. A task holds one row of sums."""
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    hashed = F.sha2(row, 256)
    parts = [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    return F.struct(F.count(F.lit(1)).alias("rows"), *(F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)))


def best_stage(stages: DataFrame) -> DataFrame:
    """Of stages (stage, clip, island) the one that places most clips, the later of equals; one that equals the stage before
    it doesn't count. Each stage's rows are summed up in a digest where they are; what is compared has a row a stage."""
    each = stages.groupBy("stage").agg(F.count("island").alias("placed"), digest(["clip", "island"]).alias("digest"))
    new = each.withColumn("before", F.lag("digest").over(Window.partitionBy(F.lit(0)).orderBy("stage"))).where(F.col("before").isNull() | (F.col("digest") != F.col("before")))  # a row for each stage
    return new.agg(F.max_by("stage", F.struct("placed", "stage")).alias("stage"), F.max("placed").alias("placed"))


def select_stage(stages: DataFrame, stage: int) -> DataFrame:
    """K8: the rows of one stored stage."""
    return stages.where(F.col("stage") == stage)


def summary(placements: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """Islands, placed and unmatched clips, the greatest drift, warnings: one row."""
    n = warnings.count() if warnings is not None else 0
    return placements.agg(F.count_distinct("island").alias("islands"), F.count("island").alias("placed"), F.sum(F.col("island").isNull().cast("bigint")).alias("unmatched"), F.max(F.abs("drift_ppm")).alias("drift_ppm"), F.lit(n).cast("bigint").alias("warnings"))
