"""A cache of landmarks as a table.

An entry (key, media, variant, version, kind, modified, bytes, waveform_bytes, payload) belongs to one file in one revision under one
way of analysis. kind: bin, timing or ltc; other rows aren't entries. waveform_bytes: of the waveform kept beside an entry, or null.
Functions return what stays, so a cache is changed by writing their result as its next version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes taken of a file's beginning and end, versions of entries, and kinds of entries.
SAMPLED = 1 << 20
VERSION, LEGACY_VERSION = 6, 5
KINDS = ("bin", "timing", "ltc")


def revision(size: Column, modified: Column) -> Column:
    """A cheap mark of a file's state: length and time of change in microseconds, which is what file listings have."""
    return F.concat_ws(":", size.cast("string"), F.unix_micros(modified).cast("string"))


def sampled(content: Column) -> Column:
    """The first and last MiB of a file, or all of one that is no longer than both."""
    n = F.octet_length(content)
    return F.when(n <= 2 * SAMPLED, content).otherwise(F.concat(F.substring(content, 1, SAMPLED), F.substring(content, n - SAMPLED + 1, F.lit(SAMPLED))))


def key(backend: str, variant: Column, path: Column, size: Column, modified_seconds: Column, sample: Column, version: int = VERSION) -> Column:
    """Name of an entry. Keys of the legacy version leave the path out."""
    parts = [F.lit(f"fingerprints-{version}"), F.lit(backend), variant] + ([] if version == LEGACY_VERSION else [path])
    text = F.concat_ws("\0", *parts, size.cast("string"), modified_seconds.cast("string"))
    return F.sha2(F.concat(F.encode(text, "UTF-8"), sample), 256)


def entries(cache: DataFrame) -> DataFrame:
    return cache.where(F.col("kind").isin(*KINDS))


def load(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Wanted (media, key, legacy_key) with the payload of their entry; `promoted` where only the legacy version has one, which is to be
    written anew under `key`. What the cache lacks doesn't come out. A key is met once a version."""
    held = entries(cache).where("kind = 'bin'")
    new = held.where(F.col("version") == VERSION).select("key", F.col("payload").alias("new"))
    old = held.where(F.col("version") == LEGACY_VERSION).select(F.col("key").alias("legacy_key"), F.col("payload").alias("old"))
    met = wanted.join(new, "key", "left").join(old, "legacy_key", "left").where("new IS NOT NULL OR old IS NOT NULL")
    return met.select("media", "key", F.coalesce("new", "old").alias("payload"), F.col("new").isNull().alias("promoted"))


def pruned(cache: DataFrame, now: Column, seconds: float) -> DataFrame:
    """The cache without entries that are `seconds` old or older. Rows that aren't entries stay, and entries of an unknown age."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("modified"))) / 1e6
    old = F.col("kind").isin(*KINDS) & (age >= seconds) & (age >= 0)
    return cache.where(~F.coalesce(old, F.lit(False)))


def normalised(path: Column) -> Column:
    """A path without empty and `.` steps, in which `x/..` is nothing."""
    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("..")) != "..")
        return F.when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.concat_ws("/", F.aggregate(parts, F.array().cast("array<string>"), step)))


def without_media(cache: DataFrame, media: DataFrame) -> DataFrame:
    """The cache without the entries of media (path), whatever their variant. Paths are compared in their normal form; landmarks of
    older versions, which don't tell their media for sure, stay."""
    gone = media.select(normalised(F.col("path")).alias("gone")).distinct()
    is_entry = F.col("kind").isin(*KINDS) & ((F.col("kind") != "bin") | (F.col("version") == VERSION))
    return cache.join(gone, is_entry & (normalised(F.col("media")) == F.col("gone")), "left_anti")


def statistics(cache: DataFrame) -> DataFrame:
    """One row: how many entries there are, and bytes with those of their waveforms."""
    size = F.coalesce("bytes", F.lit(0)) + F.coalesce("waveform_bytes", F.lit(0))
    return entries(cache).agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"))
