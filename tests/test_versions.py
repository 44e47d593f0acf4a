"""The cache as a table of versions: promotion, pruning, writers that die or meet; timecode labels of tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import timecode
from tidemark.sources import versions

AT = datetime.datetime(2024, 1, 1)


def entries(spark, rows):
    full = [(k, m, "v", v, kind, AT + datetime.timedelta(seconds=t), 10, None, p) for k, m, v, kind, t, p in rows]
    return spark.createDataFrame(full, versions.ENTRY)


def test_changes_are_seen_whole(spark, tmp_path):
    cache = versions.Cache(spark, f"file://{tmp_path}/cache")
    assert cache.number() == 0 and cache.read().collect() == []
    assert cache.stored(entries(spark, [("new", "/m/a", 6, "bin", 0, "A"), ("old", "/m/b", 5, "bin", 50, "B"), ("t", "/m/a", 6, "timing", 90, "T")])) == 1
    wanted = spark.createDataFrame([("/m/a", "new", "x"), ("/m/b", "b6", "old"), ("/m/c", "c6", "c5")], "media string, key string, legacy_key string")
    assert {tuple(r) for r in cache.loaded(wanted).collect()} == {("/m/a", "new", "A"), ("/m/b", "b6", "B")}
    assert cache.number() == 2 and {(r.key, r.version) for r in cache.read().collect()} == {("new", 6), ("old", 5), ("t", 6), ("b6", 6)}
    cache.loaded(wanted)
    assert cache.number() == 2  # nothing was left to promote
    cache.stored(entries(spark, [("new", "/m/a", 6, "bin", 60, "A2")]))
    assert {r.payload for r in cache.loaded(wanted).collect()} == {"A2", "B"}
    now = F.lit(AT + datetime.timedelta(seconds=100))
    cache.pruned(now, 45.0)
    assert {r.key for r in cache.read().collect()} == {"new", "t"}
    cache.cleared(spark.createDataFrame([("/m/./a",)], "path string"))
    assert cache.number() == 5 and cache.read().collect() == [] and cache.read(1).count() == 3
    cache.swept(keep=2)
    assert cache.number() == 5 and cache.read(4).count() == 2 and len(cache._names("data")) == 2


def test_a_writer_that_dies_changes_nothing(spark, tmp_path):
    cache = versions.Cache(spark, f"file://{tmp_path}/cache")
    cache.stored(entries(spark, [("a", "/m", 6, "bin", 0, "A")]))
    cache.prepared(entries(spark, [("b", "/m", 6, "bin", 0, "B")]))  # it dies before its manifest
    assert [r.key for r in cache.read().collect()] == ["a"] and cache.number() == 1
    cache._fs.create(cache._at("manifests/000000000002"), False).close()  # or while it writes that
    assert cache.number() == 1 and [r.key for r in cache.read().collect()] == ["a"]
    cache.swept()
    assert len(cache._names("data")) == 1 and cache.read().count() == 1 and cache.stored(entries(spark, [])) == 2


def test_of_two_writers_the_second_begins_anew(spark, tmp_path):
    cache = versions.Cache(spark, f"file://{tmp_path}/cache")
    cache.stored(entries(spark, [("a", "/m", 6, "bin", 0, "A")]))
    late = cache.prepared(entries(spark, []))
    cache.stored(entries(spark, [("b", "/m", 6, "bin", 0, "B")]))
    with pytest.raises(versions.Changed):
        cache.swapped(late, 1)
    met = []

    def how(held):
        if not met:  # another writer comes between reading and swapping
            met.append(cache.number())
            versions.Cache(spark, cache.path).stored(entries(spark, [("c", "/m", 6, "bin", 0, "C")]))
        return held.where("key <> 'a'")

    assert cache.change(how) == 4 and {r.key for r in cache.read().collect()} == {"b", "c"}


def test_labels_of_tables_are_those_of_expressions(spark):
    rows = [(f, n, d) for n, d in ((25, False), (30, True), (30, False), (60, True), (24, True)) for f in (-1, 0, 1799, 1800, 17_981, 17_982, 107_892, 2_589_407, 2_589_408, 5_184_000, 9_999_999)] + [(5, None, True), (None, 25, True)]
    df = spark.createDataFrame(rows, "f bigint, n bigint, d boolean").withColumn("want", timecode.label_of(F.col("f"), F.col("n"), F.col("d")))
    got = timecode.labelled(df, "f", "n", "d")
    assert got.columns == ["f", "n", "d", "want", "label"] and got.where("NOT label <=> want").collect() == []
    back = timecode.counted(got, "label", "n", "back").withColumn("old", timecode.frames_of_text(F.col("label"), F.col("n")))
    assert back.where("NOT back <=> old").collect() == [] and back.where("back IS NOT NULL").count() > 40
    bad = spark.createDataFrame([("1:00:00:00",), ("01:00:60:00",), ("ab:00:00:00",), ("01:00:00:00\n",)], "t string").withColumn("n", F.lit(25).cast("long"))
    assert timecode.counted(bad, "t", "n").where("frame IS NOT NULL").count() == 0
