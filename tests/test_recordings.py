"""Recordings as a data source: headers alone, ranges of bytes, files beyond two gigabytes."""

import io
import struct

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import signal, sound
from tidemark.sources import recordings, wav


def noise(n, channels=1, seed=0):
    return np.random.default_rng(seed).uniform(-0.9, 0.9, size=(channels, n)).astype(np.float32)


class Counting(io.BytesIO):
    got = 0

    def read(self, n=-1):
        out = super().read(n)
        self.got += len(out)
        return out


def test_files_are_read_by_ranges(spark, tmp_path):
    (tmp_path / "a" / ".hidden").mkdir(parents=True)
    tapes = {"a/one.wav": (noise(5000), 8000, 32), "a/two.WAV": (noise(3333, 2, 1), 48_000, 24), "b.rf64": (noise(100, 3, 2), 16_000, 16)}
    for name, (x, rate, bits) in tapes.items():
        (tmp_path / name).write_bytes(wav.write_wave(x, rate, bits, [(b"junk", b"x" * 77)]))
    (tmp_path / "a" / ".hidden" / "no.wav").write_bytes(wav.write_wave(noise(5), 8000))
    (tmp_path / "bad.wav").write_bytes(b"RIFF\0\0\0\0WAVEnothing")
    (tmp_path / "note.txt").write_bytes(b"x")
    got = {r.path.removeprefix(f"{tmp_path}/"): r for r in recordings.headers(spark, str(tmp_path)).collect()}
    assert {k: (r.frames, r.rate, r.bits, r.channels) for k, r in got.items() if not r.error} == {k: (x.shape[1], rate, bits, len(x)) for k, (x, rate, bits) in tapes.items()}
    assert set(got) == {*tapes, "bad.wav"} and got["bad.wav"].error and got["bad.wav"].frames is None
    for size, step in ((1000, 900), (512, 1 << 20), (7000, 64)):
        found = {}
        for r in recordings.sound(spark, f"file://{tmp_path}", size, rangeBytes=str(step)).orderBy("clip", "first").collect():
            held = found.setdefault(r.clip.removeprefix(f"{tmp_path}/"), [])
            assert r.first == len(held) and (r.first % size == 0)
            held.extend(r.samples)
        assert set(found) == set(tapes)
        for k, (x, _, bits) in tapes.items():
            assert np.abs(np.array(found[k]) - x.mean(0)).max() < 2.0 ** -(min(bits, 24) - 2), k
    slow = recordings.headers(spark, str(tmp_path)).where("rate = 8000 AND frames > 10")
    assert [r.frames for r in slow.collect()] == [5000]
    (tmp_path / "none").mkdir()
    assert recordings.headers(spark, f"{tmp_path}/none").collect() == [] and recordings.sound(spark, f"{tmp_path}/none").collect() == []


def test_headers_read_no_samples():
    data = wav.write_wave(noise(200_000), 48_000, 24)
    part = recordings.Range("x.wav", len(data), 0, len(data))

    def read(names, *tests):
        f = Counting(data)
        reader = recordings.WaveReader(type("S", (), {"fields": [type("N", (), {"name": n}) for n in names]}), {"path": "x", "blockframes": "1000"})
        reader.tests = list(tests)
        return f, [b.to_pylist()[0] for b in reader.rows(f, part)]

    f, rows = read(["path", "frames"])
    assert rows == [{"path": "x.wav", "frames": 200_000}] and f.got < 200
    f, rows = read(["first", "samples"], ("first", recordings.GreaterThanOrEqual, 199_000))
    assert [r["first"] for r in rows] == [199_000] and f.got < 200 + 3 * 1000
    f, rows = read(["first", "samples"], ("rate", recordings.EqualTo, 8000))
    assert rows == [] and f.got < 200


def test_files_beyond_two_gigabytes(spark, tmp_path):
    """A sparse RF64 of three gigabytes with sound at its end."""
    frames, tail = 3 * (1 << 29), noise(2000)[0]
    head = b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + b"ds64" + struct.pack("<IQQQI", 28, 2 * frames + 72, 2 * frames, frames, 0)
    head += b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16_000, 32_000, 2, 16) + b"data" + struct.pack("<I", 0xFFFFFFFF)
    with (tmp_path / "long.wav").open("wb") as f:
        f.write(head)
        f.seek(len(head) + 2 * (frames - len(tail)))
        f.write(np.round(tail * 32768).astype("<i2").tobytes())
    h = recordings.headers(spark, str(tmp_path)).first()
    assert (h.frames, h.rate, h.bytes) == (frames, 16_000, len(head) + 2 * frames)
    last = frames // sound.BLOCK * sound.BLOCK
    last = last if last < frames else last - sound.BLOCK
    end = recordings.sound(spark, str(tmp_path)).where(F.col("first") >= last).collect()
    assert len(end) == 1 and end[0].first == last and np.abs(np.array(end[0].samples[-2000:]) - tail).max() < 1e-4


def test_from_files_to_landmarks(spark, tmp_path):
    t = np.arange(48_000 * 3) / 48_000
    x = np.sin(2 * np.pi * 700 * t)[None] * 0.5
    (tmp_path / "tone.wav").write_bytes(wav.write_wave(x, 48_000, 16))
    found = recordings.sound(spark, str(tmp_path), 10_000).drop("rate")
    peaks = signal.peaks(sound.at_rate(found, 48_000, size=10_000), "exhaustive").groupBy("frame").agg(F.collect_set("bin").alias("bins")).collect()
    assert len(peaks) > 40 and all(round(700 / (8000 / 1024)) // 2 in p.bins for p in peaks)
