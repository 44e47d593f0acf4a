"""Column functions against literal cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import mapping, names, timecode


def one(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_labels_of_drop_frame(spark):
    n, df = F.lit(30).cast("long"), F.lit(True)
    texts = ["00:01:00;02", "00:00:59;29", "00:10:00;00", "23:59:59;29"]
    got = one(spark, *(timecode.frames_of_text(F.lit(t), n) for t in texts), *(timecode.label_of(F.lit(x).cast("long"), n, df) for x in (1800, 1799, 17982, 2589407, 2589408)))
    assert got == [1800, 1799, 17982, 2589407, "00:01:00;02", "00:00:59;29", "00:10:00;00", "23:59:59;29", "00:00:00;00"]


def test_labels_that_are_none(spark):
    n30, n25 = F.lit(30).cast("long"), F.lit(25).cast("long")
    bad = [("00:01:00;00", n30), ("00:01:00;01", n30), ("24:00:00:00", n25), ("00:60:00:00", n25), ("00:00:00:25", n25), ("00:00:00;01", n25), ("0:00:00:00", n25), ("00.00.00.00", n25), ("00:00:00:0x", n25), ("00:00:00:00\n", n25)]
    assert one(spark, *(timecode.frames_of_text(F.lit(t), n) for t, n in bad)) == [None] * len(bad)
    assert one(spark, timecode.label_of(F.lit(-1).cast("long"), n25, F.lit(False)), timecode.label_of(F.lit(26).cast("long"), n25, F.lit(True))) == [None, "00:00:01:01"]


def test_rates_and_times(spark):
    got = one(spark, timecode.nominal_fps(F.lit(1001), F.lit(30000)), timecode.nominal_fps(F.lit(1), F.lit(121)), timecode.standard_frame(F.lit(29.97)), timecode.standard_frame(F.lit(31.0)), timecode.fraction_seconds(F.lit("1001/30000s")), timecode.fraction_seconds(F.lit("")), timecode.fraction_seconds(F.lit("5s")))
    assert got[0] == 30 and got[1] is None and tuple(got[2]) == (1001, 30000) and got[3] is None and got[4:] == [pytest.approx(1001 / 30000), 0.0, 5.0]
    a = one(spark, timecode.added(F.lit(1), F.lit(24), F.lit(1), F.lit(30)), timecode.added(F.lit(1), F.lit(2**31 - 1), F.lit(1), F.lit(2**31 - 3)), timecode.grid_time(F.lit(1.04), F.lit(1), F.lit(25)), timecode.grid_time(F.lit(1.0001), F.lit(1), F.lit(25)))
    assert [tuple(x) for x in a] == [(9, 120), (0, 1_000_000), (26, 25), (1_000_100, 1_000_000)]
    assert one(spark, timecode.micros_of(F.lit(-2.5e-6)), timecode.micros_of(F.lit(2.5e-6)), *timecode.snapped(F.lit(3.9999), F.lit(2000.0)), timecode.frames_of_samples(F.lit(2**62), F.lit(48000.0), F.lit(1001), F.lit(30000))) == [-3, 3, 4, 0.0, 2**62 * 30000 // (48000 * 1001)]


def test_names(spark):
    got = one(
        spark, names.is_media(F.lit("/a/B.WAV")), names.is_media(F.lit("/a/.wav")), names.file_url(F.lit("/a b/ü+~*.mov")), names.percent_decoded(F.lit("a%20b+c")), names.card_root(F.lit("/m/CARD/PRIVATE/M4ROOT/CLIP")),
        names.common_parents(F.lit("/x/Day1/Cam/a.mov"), F.lit("/y/day1/cam/b.mov")), names.track_of_flag(F.lit("v2")), names.track_of_flag(F.lit("V0")), names.source_key(F.lit("/a/b.wav"), F.lit(None).cast("string"), F.lit("s")), names.source_name(F.lit("device:Sony:FX3:12")),
    )
    assert got == [True, False, "file:///a%20b/%C3%BC%2B~%2A.mov", "a b+c", "/m/CARD", 2, "imported-video-000001", None, "span:s", "FX3"]
    assert tuple(one(spark, names.key_and_value(F.lit("a=b=c")))[0]) == ("a", "b=c") and one(spark, names.key_and_value(F.lit("=b"))) == [None]
    assert names.folder_names(["/a/x", "/b/X", "/c/y"]) == ["a/x", "b/X", "y"] and names.unique_names(["A", "a", "b", "a"]) == ["A", "a 2", "b", "a 3"]


def test_mappings(spark):
    def knots(*p):
        return F.array(*(F.struct(F.lit(float(a)).alias("source"), F.lit(float(b)).alias("island")) for a, b in p)) if p else F.array().cast(mapping.KNOTS)

    k = knots((0, 0), (10, 12), (20, 22))
    assert one(spark, *(mapping.value_at(k, F.lit(float(x))) for x in (-5, 5, 10, 15, 30)), mapping.value_at(knots((3, 7)), F.lit(9.0)), mapping.value_at(knots(), F.lit(9.0))) == [-6.0, 6.0, 12.0, 17.0, 32.0, 7.0, 9.0]
    got = one(spark, mapping.normalised(knots((5, 5), (0, 0), (5.0000001, 6), (7, 6), (9, 9))), mapping.inverted(k), mapping.segments(k), mapping.segments(knots((0, 0), (1, 0))), mapping.slips_at(k), mapping.slips_at(knots((0, 1), (10, 11.015))), mapping.contains(k, F.lit(20.0)))
    assert [tuple(x) for x in got[0]] == [(0, 0), (5.0000001, 6), (9, 9)] and [tuple(x) for x in got[1]] == [(0, 0), (12, 10), (22, 20)]
    assert [tuple(x) for x in got[2]] == [(0, 10, 12), (10, 10, 10)] and got[3:] == [None, True, False, True]


def test_simplified_keeps_kinks():
    p = np.array([[0, 0], [1, 1.0001], [2, 2], [3, 4], [4, 6]], float)
    assert mapping.simplified(p).tolist() == [[0, 0], [2, 2], [4, 6]]
    rng = random.Random(0)
    q = np.cumsum([[rng.random() + 0.01, rng.random() + 0.01] for _ in range(200)], axis=0)
    s = mapping.simplified(q, 0.05)
    assert np.abs(np.interp(q[:, 0], s[:, 0], s[:, 1]) - q[:, 1]).max() <= 0.05 + 1e-9
