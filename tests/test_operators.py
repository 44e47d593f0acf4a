"""Operators against literal cases, plain loops and signals whose truth is known."""

import io
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.operators import assembly, graph, intervals, lanes, library, matching, order, signal, spans
from tidemark.sinks import documents
from tidemark.sources import timelines, wav
from tidemark.streaming import live

# Matching --------------------------------------------------------------------------------------------------------------


def test_robust_fit_of_drift_and_outliers():
    rng = np.random.default_rng(0)
    x = np.sort(rng.uniform(0, 900, 200))
    y = 1.0008 * x + 3.2
    y[::10] += rng.uniform(1, 5, 20)
    fit = matching.fit_line(x, y)
    assert fit["rate"] == pytest.approx(1.0008, abs=1e-6) and fit["offset"] == pytest.approx(3.2, abs=1e-4) and fit["anchors"] == 180
    assert matching.fit_line(x[:2], y[:2]) is None and matching.fit_line(np.array([0, 1, 2.9]), np.array([0, 1, 2.9])) is None
    assert matching.upper_median(np.array([4.0, 1, 3, 2])) == 3


def test_pairs_of_landmarks_to_edges(spark):
    rows = [(c, ((k + 1) << 32) | 7, 40 * k + (25 if c else 0)) for k in range(60) for c in (0, 1)]
    rows += [(2, (k + 1000) << 32, 40 * k) for k in range(60)]
    e = matching.matched(spark.createDataFrame(rows, S.LANDMARKS), spark.createDataFrame([(3,)], "n bigint")).collect()
    assert len(e) == 1 and (e[0].left, e[0].right, e[0].rate) == (0, 1, 1.0) and e[0].offset == pytest.approx(25 * S.FRAME_SECONDS) and e[0].anchors == 60
    assert matching.usable(spark.createDataFrame(e)).count() == 1
    no = spark.createDataFrame([(1, 0, -25 * S.FRAME_SECONDS + 1)], "left bigint, right bigint, offset double")
    assert matching.without_rejected_alignments(spark.createDataFrame(e), no).count() == 0


def test_long_drift_needs_a_ridge():
    cells = np.arange(0, 40_000 // S.ANCHOR_BUCKET)
    x = cells * S.ANCHOR_BUCKET * S.FRAME_SECONDS + 0.1
    y = 1.004 * x + 5
    bucket = np.floor((y - x) / S.FRAME_SECONDS / S.BUCKET)
    fit, margin = matching.ridge_line(x, y, cells, bucket)
    assert fit["rate"] == pytest.approx(1.004, abs=1e-6) and margin >= S.MARGIN
    assert matching.ridge_line(x[:100], y[:100], cells[:100], bucket[:100]) is None


def test_ridges_of_many_pairs_are_those_of_each(spark):
    """Pairs with and without a line, over several batches, behind joins that are broadcast and shuffled ones."""
    rows = []
    for pair in range(6):
        lf = 8 * np.arange(1500 + 150 * pair)
        rf = np.round((1.01 if pair % 3 else 1.05) * lf).astype(int) + 100
        rows += [(pair, pair + 50, i * 7 % 11, int(a), int(b)) for i, (a, b) in enumerate(zip(lf, rf, strict=True))]
    pairs = spark.createDataFrame(rows, "left bigint, right bigint, hash bigint, lf bigint, rf bigint")
    points = matching.ridge_points(pairs, matching.histogram(pairs))
    last = {}
    for left, _, h, a, b in rows:
        key = (left, a // S.ANCHOR_BUCKET, (b - a) // S.BUCKET)
        last[key] = max(last.get(key, (-1,)), (h, a, b))
    strong = {tuple(r) for r in matching.histogram(pairs).where(F.col("votes") >= S.VOTES).select("left", "bucket").collect()}
    want = {(k[0], k[1], k[2], v[1] * S.FRAME_SECONDS, v[2] * S.FRAME_SECONDS) for k, v in last.items() if (k[0], k[2]) in strong}
    found = points.toPandas()
    assert {tuple(r) for r in found.drop(columns="right").itertuples(index=False)} == want
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": "100", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    held = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = matching.ridge_fits(matching.ridge_points(pairs, matching.histogram(pairs))).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    got = {r.left: r for r in rows}
    assert len(got) == len(rows)
    for left, pdf in found.groupby("left"):
        line = matching.ridge_line(pdf.x.to_numpy(), pdf.y.to_numpy(), pdf.cell.to_numpy(), pdf.bucket.to_numpy())
        assert (line is None) == (left % 3 == 0)
        if line is None:
            continue
        fit, margin = line
        r = got.pop(left)
        assert all(r[k] == v for k, v in fit.items() if k not in "xy") and (r.right, r.margin) == (left + 50, margin)
        assert [(p.left, p.right) for p in r.points] == list(zip(fit["x"], fit["y"], strict=True))
    assert not got


# Graph -----------------------------------------------------------------------------------------------------------------


def edges(rows):
    names = ["left", "right", "rate", "offset", "confidence", "anchors", "covered", "residual"]
    return pd.DataFrame(rows, columns=names).assign(points=[()] * len(rows))


def test_a_chain_is_solved_exactly():
    got = graph.solve_component(edges([(1, 2, 1.0, -5.0, 0.9, 100, 60, 0.01), (2, 3, 1.0, -7.0, 0.8, 100, 60, 0.01), (1, 3, 1.0, -12.0, 0.7, 80, 60, 0.01)])).set_index("clip")
    assert got.offset.to_dict() == pytest.approx({1: 0.0, 2: 5.0, 3: 12.0}, abs=1e-6) and got.rate.tolist() == pytest.approx([1, 1, 1])


def test_a_wrong_edge_is_outweighed():
    got = graph.solve_component(edges([(1, 2, 1.0, -5.0, 0.9, 100, 60, 0.01), (2, 3, 1.0, -7.0, 0.9, 100, 60, 0.01), (1, 3, 1.0, -12.0, 0.9, 100, 60, 0.01), (1, 3, 1.0, -90.0, 0.56, 5, 4, 0.09)])).set_index("clip")
    assert got.offset[3] == pytest.approx(12.0, abs=0.01)


def test_bent_mappings_reach_the_clip():
    e = edges([(1, 2, 1.0, -5.0, 0.9, 100, 60, 0.01)])
    e["points"] = [[{"left": 5.0, "right": 0.0}, {"left": 15.0, "right": 10.5}, {"left": 25.0, "right": 20.0}]]
    got = graph.solve_component(e).set_index("clip")
    assert len(got.points[2]) == 3 and got.points[2][1]["source"] == 10.5


def test_components_of_long_paths(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (200, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 200: 200}


def test_forest_gate_keeps_strong_cycles():
    c = pd.DataFrame({"left": [1, 2, 1, 1], "right": [2, 3, 3, 3], "confidence": [0.9, 0.6, 0.84, 0.86]})
    assert graph.forest_gate(c).index.tolist() == [0, 1, 3]


def test_gate_over_tables_is_that_of_a_fold(spark):
    rng = np.random.default_rng(3)
    n = 400
    c = pd.DataFrame({"left": rng.integers(0, 90, n), "right": rng.integers(0, 90, n), "confidence": np.round(rng.uniform(0.4, 1, n), 2), "position": rng.permutation(n)})
    want = graph.forest_gate(c.sort_values("position").reset_index(drop=True))
    got = graph.gated(spark.createDataFrame(c)).toPandas()
    assert sorted(got.position) == sorted(want.position) and 90 < len(got) < n
    assert graph.gated(spark.createDataFrame(c).limit(0)).count() == 0


# Intervals, lanes, order -----------------------------------------------------------------------------------------------


def test_timecode_edges_are_those_of_a_plain_loop(spark):
    rng = random.Random(1)
    clips = [(i, i, float(rng.randint(0, 3000)) if rng.random() < 0.9 else None, float(rng.randint(1, 60)), float(rng.choice([0, 100_000])) if rng.random() < 0.5 else None) for i in range(150)]
    placed = {i for i in range(150) if i % 10 == 0}
    no_pair, no_at = {(3, 4), (11, 2)}, []
    pool = [c for c in clips if c[2] is not None and c[0] in placed] + [c for c in clips if c[2] is not None and c[0] not in placed]
    used, want = set(), set()
    for a in (c for c in clips if c[2] is not None and c[0] not in placed):
        best = None
        for b in pool:
            if a[0] == b[0] or frozenset((a[0], b[0])) in used or (a[0], b[0]) in no_pair or (b[0], a[0]) in no_pair or (a[4] is not None and b[4] is not None and abs(a[4] - b[4]) >= 57_600):
                continue
            shared = min(a[2] + a[3], b[2] + b[3]) - max(a[2], b[2])
            if shared > 0 and (best is None or (b[0] in placed, shared) > (best[0], best[1])):
                best = (b[0] in placed, shared, b)
        if best:
            used.add(frozenset((a[0], best[2][0])))
            b = best[2]
            l, r = (b, a) if best[0] or b[0] < a[0] else (a, b)
            want.add((l[0], r[0], l[2] - r[2]))
    c = spark.createDataFrame(clips, "id bigint, position bigint, tc double, duration double, recorded double")
    got = intervals.timecode_edges(c, c.where("id % 10 = 0"), spark.createDataFrame(list(no_pair), "left bigint, right bigint"), spark.createDataFrame(no_at, "left bigint, right bigint, offset double"), 30.0)
    assert {(r.left, r.right, r.offset) for r in got.collect()} == want


def plain_tracks(rows):
    """First fit by a fold over everything: clips (id, source, start, duration) to tracks."""
    pdf = pd.DataFrame(rows, columns=["id", "source_key", "start", "duration"])
    own = pd.concat([lanes.source_lanes(g) for _, g in pdf.groupby("source_key")])
    tracks, out = [], {}
    held = sorted(((g.start.min(), s, lane), sorted(zip(g.start, g.start + g.duration.clip(lower=0), g.id, strict=True))) for (s, lane), g in own.groupby(["source_key", "lane"]))

    def meet(x, y):
        one, other = sorted([x[:2], y[:2]])
        return other[0] < one[1] - lanes.DUST and other[1] > other[0]

    for _, clips in held:
        at = next((i for i, t in enumerate(tracks) if not any(meet(x, y) for x in clips for y in t)), len(tracks))
        if at == len(tracks):
            tracks.append([])
        tracks[at] += clips
        out |= {c[2]: at for c in clips}
    return out


@pytest.mark.parametrize("chunk", [1000, 3])
def test_lanes_are_those_of_a_fold(spark, chunk):
    rng = random.Random(2)
    rows = [(str(i), str(rng.randint(0, 9) if i % 3 else 7), float(rng.randint(0, 400)) / 4, float(rng.choice([0, 1, 2, 2.25, 20]))) for i in range(300)]
    got = {r.id: r.track for r in lanes.allocated(spark.createDataFrame(rows, S.INTERVALS).repartition(3), chunk=chunk).collect()}
    assert got == plain_tracks(rows)
    two = [(f"{p}{i}", s, t, d, p) for p in "ab" for i, s, t, d in rows[:60]]
    got = {r.id: r.track for r in lanes.allocated(spark.createDataFrame(two, S.INTERVALS + ", project string"), "project", chunk).collect()}
    want = plain_tracks(rows[:60])
    assert got == {f"{p}{i}": t for p in "ab" for i, t in want.items()}
    assert lanes.allocated(spark.createDataFrame([], S.INTERVALS)).collect() == []


def test_a_source_that_is_never_idle_is_swept_range_by_range(spark):
    rng = random.Random(5)
    rows = [(str(i), "s", i / 8, rng.choice([2.0, 9.0, 30.0])) for i in range(400)]  # some clip is always open
    frame = spark.createDataFrame(rows, "id string, source_key string, start double, d double")
    got = {r.id: r.lane for r in lanes.in_source(frame, ["source_key"]).collect()}
    want = lanes.source_lanes(pd.DataFrame(rows, columns=["id", "source_key", "start", "duration"])).set_index("id").lane
    assert got == want.to_dict()
    one = lanes.source_lanes(pd.DataFrame({"id": ["a", "b", "c"], "start": [0.0, 0.0, 9.8], "duration": [10.0, 5.0, 4.0]})).set_index("id").lane
    assert one.to_dict() == {"a": 0, "b": 1, "c": 0}


def test_uncrossed_is_greedy_by_strength():
    rng = random.Random(3)
    pdf = pd.DataFrame([(rng.randint(0, 12), rng.randint(0, 12), rng.random(), i) for i in range(60)], columns=["low_rank", "high_rank", "confidence", "position"])
    kept = []
    for i, r in pdf.sort_values(["confidence", "position"], ascending=[False, True]).iterrows():
        if all((r.low_rank - pdf.low_rank[k]) * (r.high_rank - pdf.high_rank[k]) >= 0 for k in kept):
            kept.append(i)
    assert order.uncrossed(pdf).index.tolist() == sorted(kept)


def test_island_positions():
    rows = [(0, 0, 1000.0, 0.0, 10.0, ["a"]), (1, 0, 1005.0, 0.0, 10.0, ["b"]), (2, 0, 200_000.0, 0.0, 5.0, ["a"]), (3, 2, 3.0, 2.0, 6.0, ["c"])]
    got = assembly.positions(pd.DataFrame(rows, columns=["island", "kind", "origin", "low", "high", "sources"])).set_index("island")["shift"].to_dict()
    assert got == {0: 0.0, 1: 5.0, 2: 16.0, 3: 20.0}


def test_span_messages(spark):
    parts = [("s", 1, 3, 1, "audio", 1, 2.0), ("s", 2, 3, 2, "audio", 1, 2.0), ("t", 1, 3, 3, "audio", 1, 2.0), ("t", 3, 3, 4, "audio", 1, 2.0), ("t", 3, 3, 5, "audio", 1, 2.0), ("u", 1, 2, 6, "audio", 1, 1.0), ("u", 2, 2, 7, "audio", 2, 1.0), ("v", 1, 2, 8, "audio", 1, 1.0), ("v", 2, 2, 9, "audio", 1, 1.0)]
    df = spark.createDataFrame(parts, "set_id string, part int, part_count int, clip bigint, kind string, layout int, duration double")
    said = {r.set_id: r.m for r in spans.diagnostics(df).select("set_id", spans.message(F.col("missing"), F.col("duplicate"), F.col("incompatible"), F.col("conflict")).alias("m")).collect()}
    assert said == {"s": "Incomplete linked BWF file-set: missing 3.", "t": "Incomplete linked BWF file-set: missing 2; duplicate 3.", "u": "Incomplete linked BWF file-set: incompatible parts 1-2."}
    assert {(r.left, r.right, r.offset) for r in spans.span_edges(df).collect()} == {(1, 2, -2.0), (8, 9, -1.0)}


def test_relinking(spark):
    def paths(*p):
        return spark.createDataFrame([(x,) for x in p], "path string")

    got = library.relinked(paths("/here.wav", "/old/a.wav", "/old/day1/b.wav", "/m.wav", "/q/one.wav", "/gone.wav"), paths("/here.wav", "/new/a.wav"), spark.createDataFrame([("/m.wav", "/nowhere.wav")], "path string, new string"), spark.createDataFrame([("/old", "/new"), ("/ol", "/bad")], "`from` string, `to` string"), paths("/x/day1/B.wav", "/x/day2/b.wav", "/z/One.wav"))
    assert {r.path: (r.new, r.how) for r in got.collect()} == {"/here.wav": ("/here.wav", "unchanged"), "/old/a.wav": ("/new/a.wav", "redirect"), "/old/day1/b.wav": ("/x/day1/B.wav", "name"), "/m.wav": ("/nowhere.wav", "manual"), "/q/one.wav": ("/z/One.wav", "name"), "/gone.wav": (None, "missing")}


# Signals ---------------------------------------------------------------------------------------------------------------


def test_delays_to_a_part_of_a_sample():
    rng = np.random.default_rng(4)
    x = rng.normal(size=40_000)
    assert signal.gcc_phat(x[500:], x[:-500], 4000)[0] == pytest.approx(500, abs=0.05)
    assert signal.gcc_phat(x[:-500], x[500:], 4000)[0] == pytest.approx(-500, abs=0.05)
    smooth = np.convolve(x, np.hanning(9), "same")
    late = signal.sinc_at(smooth, np.arange(40_000) - 10.5)
    assert signal.gcc_phat(smooth, late, 400)[0] == pytest.approx(10.5, abs=0.2)
    assert signal.gcc_phat(x[:1000], x[:1000], 100) is None and signal.gcc_phat(0 * x, x, 400) is None
    unrelated = signal.gcc_phat(x, rng.normal(size=40_000), 4000)
    assert unrelated is None or unrelated[1] < 0.1


def test_refined_delay_and_landmarks():
    rng = np.random.default_rng(5)
    left = rng.normal(size=16_000 * 60)
    right = np.concatenate([np.zeros(800), left])[: len(left)]
    e = {"rate": 1.0, "offset": 0.06, "confidence": 0.8, "anchors": 60, "left_start": 1.0, "left_end": 55.0, "covered": 54.0}
    assert signal.refine_pair(left, right, e)["offset"] == pytest.approx(0.05, abs=1e-4)
    assert signal.refine_pair(left, np.zeros(len(left)), e) is None
    t = np.arange(8000) / 8000
    got = signal.band_peaks(signal.frame_powers(np.sin(2 * np.pi * 440 * t)), 1)
    assert set(got[:, 1]) == {round(440 / (8000 / 1024)) // 2} and len(signal.band_peaks(signal.frame_powers(np.zeros(8000)), 3)) == 0


def test_landmarks_are_those_of_a_plain_loop(spark):
    peaks = [(0, 10), (0, 11), (8, 20), (8, 21), (20, 30), (36, 40), (44, 50)]
    want = sorted((f, (b << 32) | (t << 16) | d) for f, b in peaks for g, t in peaks for d in (8, 20, 36) if g == f + d)
    got = signal.landmarks(spark.createDataFrame([("c", f, b) for f, b in peaks], "clip string, frame int, bin int"))
    assert sorted((r.frame, r.hash) for r in got.collect()) == want


def test_channel_choice_and_rendering():
    e = np.array([[1.0, 0.95], [0.9, 1.0], [0.5, 1.0], [0.95, 1.0]])
    assert signal.mono_channel(e).tolist() == [0, 0, 1, 1]
    x = np.sin(np.arange(4000) / 7)
    y = signal.drift_rendered(x, 1000.0, np.array([[0.0, 0.0], [4.0, 4.004]]))
    assert len(y) == 4004 and np.abs(y[500:3500] - np.sin(np.arange(500, 3500) / 1.001 / 7)).max() < 0.02
    assert len(signal.at_rate(x, 1000, -1, 5, 800)) == 4000 and not signal.at_rate(x, 1000, 3.5, 1, 800)[401:].any()
    assert signal.theil_sen(np.arange(9.0), 1.001 * np.arange(9.0) + 2, True)[:2] == pytest.approx((1.001, 2))
    assert signal.theil_sen(np.array([0.0, 10, 20]), np.array([0.0, 10.02, 20]), True)[:2] == pytest.approx((1.0, 0.02 / 3))
    assert signal.theil_sen(np.array([0.0, 10, 20]), np.array([0.0, 10.02, 20]), False)[:2] == (1.0, 0.0)
    line = [(x, 1.001 * x, 0.9) for x in (0.0, 30, 60, 90, 120, 150)]
    assert signal.step_probes(line, 1.001, lambda c: 1 / 0) == [] and signal.step_probes(line[:3], 1.0, lambda c: 1 / 0) == []

    def step(c):  # 50 ms at 70 s
        return c, c + 0.05 * (c > 70), 0.9

    stepped = [step(x) for x in (0.0, 30, 60, 90, 120, 150)]
    probes = signal.step_probes(stepped, 1.0, step)
    assert len(probes) == 5 and min(abs(p[0] - 70) for p in probes) < 1.0
    assert signal.step_probes(stepped, 1.0, lambda c: (c, c, 0.1)) == []
    near = np.array([0.0, 1, 2, 2.05, 3, 4, 5, 6])
    bent = np.where(near < 3, near, near + 0.05)
    assert signal.piecewise(near, bent + np.where(near == 2.05, 0.5, 0), np.where(near == 2.05, 0.1, 0.9)) is not None
    assert signal.piecewise(near, bent[::-1]) is None and signal.piecewise(np.arange(6.0), np.array([0.0, 1, 2, 3.5, 4.5, 5.5])) is None
    sound = np.random.default_rng(3).normal(size=16_000 * 6)
    x, y, q = signal.observe(sound, sound, 1.0, 0.0, 5.9, 2.1)  # a window that would end behind the recordings
    assert abs(x - y) < 1e-4 and x < 6 and q > 0.6
    knots, residual = signal.piecewise(np.arange(10.0), np.concatenate([np.arange(5.0), np.arange(5.0, 10) + 0.05]))
    assert residual <= 0.006 and 3 <= len(knots) <= 8


# Files and documents ---------------------------------------------------------------------------------------------------


def test_wave_round_trip(spark):
    x = np.vstack([np.linspace(-0.9, 0.9, 1000), np.zeros(1000)])
    for bits, close in ((16, 1e-4), (24, 1e-6), (32, 1e-7)):
        f = io.BytesIO(wav.write_wave(x, 48_000, bits))
        fmt = wav.open_format(f)
        assert (fmt.channels, fmt.rate, fmt.bits, fmt.frames) == (2, 48_000, bits, 1000)
        assert np.abs(wav.read_floats(f, fmt, 100, 50) - x[:, 100:150]).max() < close and wav.read_floats(f, fmt, 990, 50).shape == (2, 10)
    bext = b"\0" * 320 + b"2024-02-0310:11:12" + (96_000).to_bytes(8, "little") + b"\0" * 256
    link = b"<LINK><ID>k</ID><FILE type='actual'><FILENUMBER>1</FILENUMBER><FILENAME>A.wav</FILENAME></FILE><FILE type='other'><FILENUMBER>2</FILENUMBER><FILENAME>b.wav</FILENAME></FILE></LINK>"
    data = wav.write_wave(x, 48_000, 16, [(b"bext", bext), (b"link", link)])
    df = spark.createDataFrame([("/m/a.wav", bytearray(data)), ("/m/bad.wav", bytearray(b"RIFFxxxx"))], "path string, content binary")
    good, bad = sorted(wav.inspected(df).collect(), key=lambda r: r.path)
    assert (good.frames, good.time_reference, good.set_id, good.part, good.part_count, good.error) == (1000, 96_000, "bwf:k", 1, 2, None)
    assert good.recorded == wav.iso_seconds("2024-02-03T10:11:12Z") and bad.error and bad.frames is None


def test_dates_and_camera_metadata():
    assert wav.iso_seconds("1970-01-01T01:00:00.9+01:00") == 0 and wav.iso_seconds("2024-02-30T00:00:00Z") is None and wav.iso_seconds("2024-01-01T00:00:00") is None
    xml = '<NonRealTimeMeta xmlns="u"><LtcChangeTable tcFps="25"><LtcChange frameCount="0" value="12345601"/></LtcChangeTable><CreationDate value="2024-01-01T00:00:00Z"/><Device manufacturer="M" modelName="X" serialNo="FFFF"/></NonRealTimeMeta>'
    got = wav.sony_metadata(wav.sony_tail(b"\0" * 99 + xml.encode() + b"\0"))
    assert got["timecode"] == (1, 56, 34, 12, 25.0) and got["device"] is None and got["recorded"] == wav.iso_seconds("2024-01-01T00:00:00Z")
    assert wav.audio_timecode(48_000, 48_000, None, "10-00-00") == (1.0, "bext") and wav.audio_timecode(None, None, None, "01:00:00") == (3600.0, "label")
    assert wav.ixml_speed("<BWFXML><SPEED><TIMECODE_RATE>30000/1001</TIMECODE_RATE><TIMECODE_FLAG>DF</TIMECODE_FLAG></SPEED></BWFXML>") == {"rate": (30000, 1001), "drop": True, "samples": None}


def test_timecode_in_sound():
    rate, fps, level, out = 48_000, 25, 1.0, []
    for n in range(12):
        s, f = divmod(36_000 * fps + n, fps)
        bits = [0] * 80

        def put(at, value, width, bits=bits):
            for k in range(width):
                bits[at + k] = value >> k & 1

        for at, v, w in ((0, f % 10, 4), (8, f // 10, 2), (16, s % 60 % 10, 4), (24, s % 60 // 10, 3), (32, s // 60 % 60 % 10, 4), (40, s // 60 % 60 // 10, 3), (48, s // 3600 % 10, 4), (56, s // 3600 // 10, 2)):
            put(at, v, w)
        bits[64:80] = [0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 1]
        cell = rate // fps // 80
        for b in bits:
            level = -level
            half = cell // 2
            out += [level] * half
            level = -level if b else level
            out += [level] * (cell - half)
    start, got_fps = wav.ltc_start(np.array([0.0] * 10 + out) + 0.001, rate)
    assert got_fps == fps and start == pytest.approx(36_000, abs=0.05)
    assert wav.ltc_start(np.random.default_rng(0).normal(size=rate), rate) is None


ITEMS = [
    {"id": "1", "name": "a", "path": "/m/a b.mov", "kind": "video", "track": 0, "start": 1.0, "duration": 4.0, "source_in": 0.4, "source_duration": 10.0, "rate": 1.0},
    {"id": "1", "name": "a", "path": "/m/a b.mov", "kind": "audio", "track": 0, "start": 1.0, "duration": 4.0, "source_in": 0.4, "source_duration": 10.0, "rate": 1.0},
    {"id": "2", "name": "r", "path": "/m/r.wav", "kind": "audio", "track": 1, "start": 0.0, "duration": 8.0, "source_in": 0.0, "source_duration": 8.0, "rate": 1.001},
]


@pytest.mark.parametrize("write", [documents.fcp7, documents.fcpxml])
def test_timeline_round_trip(write):
    text = write("p & q", ITEMS)
    doc = timelines.parse(text)
    want = sorted((i["kind"], i["path"], i["start"], i["start"] + i["duration"], i["source_in"]) for i in ITEMS)
    assert sorted((e["media"], e["path"], e["start"], e["end"], e["source_in"]) for e in doc.edits) == want
    assert doc.frame == (1, 25) and timelines.listing(text) == [(0, "p & q", 3)]
    assert timelines.path_of("file://localhost/a%20b+c") == "/a b+c" and timelines.sniff("<?xml?><NonRealTimeMeta>") is None
    moved = timelines.parse(documents.relinked_copy(text, {"/m/r.wav": "/n/r 2.wav"}))
    assert {e["path"] for e in moved.edits} == {"/m/a b.mov", "/n/r 2.wav"}


def test_retimes_and_windows():
    assert timelines.graph_retime([(0, 0), (50, 100)], 0, 25, None) == (2.0, False, 0.0, 50.0)
    assert timelines.graph_retime([(0, 100), (100, 0)], 0, 50, -1.0) == (1.0, True, 49.0, 99.0)
    assert timelines.graph_retime([(0, 0), (10, 30), (20, 20)], 0, 20, None) is None
    # 25 frames a second on a sequence of 30: a slope of 5 to 6 is the usual speed.
    assert timelines.graph_retime([(0, 0), (60, 50)], 0, 30, 1.0, 30, 25) == pytest.approx((1.0, False, 0.0, 25.0))
    assert timelines.graph_retime([(0, 0), (60, 100)], 0, 30, None, 30, 25) == pytest.approx((2.0, False, 0.0, 50.0))
    e = {"start": 0.0, "end": 10.0, "source_in": 0.0, "source_out": 20.0, "reverse": True}
    assert timelines.clip_to_window(e, 2, 9) | {} == {**e, "start": 2, "end": 9, "source_in": 2.0, "source_out": 16.0} and timelines.clip_to_window(e, 10, 12) is None


def test_live_matches_stream(spark, tmp_path):
    rows = [(0, 1, 2, "candidate", 1.0, 0.5), (1, 2, 1, "refined", -2.0, 0.9), (2, 3, 4, "candidate", 1.0, 0.5), (3, 4, 3, "rejected", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "seq bigint, left bigint, right bigint, kind string, offset double, confidence double")
    batch = {(r.low, r.high): (r.kind, r.offset) for r in live.live_matches(df).collect()}
    assert batch == {(1, 2): ("refined", 2.0)}
    for part in (rows[:1], rows[1:]):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = live.live_matches_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")).writeStream.outputMode("update").format("memory").queryName("live_matches").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    state = {}
    for r in spark.table("live_matches").collect():
        state[r.low, r.high] = (r.kind, r.offset)
    assert {k: v for k, v in state.items() if v[0] != "deleted"} == batch


def test_lanes_of_chunks_take_no_rows_for_their_conflicts(spark, monkeypatch):
    """Five times as many intervals, all at one time: the rows written for them grow as they do, not with the square."""
    from tidemark import tables

    def written(n):
        frame = spark.range(n).select(F.col("id").cast("string").alias("id"), (F.col("id") % (n // 2)).cast("string").alias("source_key"), (F.col("id") % 7).cast("double").alias("start"), F.lit(50.0).alias("duration"))
        sizes = []

        def counting(df, what):
            out = tables.settled(df, what)
            sizes.append(out.count())
            return out

        monkeypatch.setattr(lanes, "settled", counting)
        got = lanes.allocated(frame, chunk=300).select("track").distinct().count()
        assert got == n
        return max(sizes)

    assert written(1000) <= 6 * written(200)
