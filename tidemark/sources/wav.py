"""WAV, RF64 and BW64 files: headers, samples, broadcast metadata, part links, timecode in sound; and a Spark source of them."""

from __future__ import annotations

import io
import re
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema as S


class Format(NamedTuple):
    channels: int
    rate: int
    bits: int
    floating: bool
    data_at: int
    data_bytes: int

    @property
    def frames(self) -> int:
        return self.data_bytes // (self.channels * self.bits // 8)


def chunks(f) -> Iterator[tuple[bytes, int, int]]:
    """(name, offset, size) of chunks; sizes of RF64 and BW64 come from their ds64 chunk."""
    head = f.read(12)
    if head[:4] not in (b"RIFF", b"RF64", b"BW64") or head[8:12] != b"WAVE":
        return
    big: dict[bytes, int] = {}
    while len(h := f.read(8)) == 8:
        name, size = h[:4], struct.unpack("<I", h[4:])[0]
        at = f.tell()
        if name == b"ds64":
            big[b"data"] = struct.unpack("<Q", f.read(24)[8:16])[0]
        size = big.get(name, size) if size == 0xFFFFFFFF else size
        yield name, at, size
        f.seek(at + size + size % 2)


def open_format(f) -> Format | None:
    """16, 24 or 32-bit whole numbers, 32 or 64-bit floats, extensible headers too; None for anything else."""
    kind = data = None
    for name, at, size in chunks(f):
        if name == b"fmt ":
            f.seek(at)
            raw = f.read(min(size, 40))
            tag, ch, rate, _, _, bits = struct.unpack("<HHIIHH", raw[:16])
            tag = struct.unpack("<H", raw[24:26])[0] if tag == 0xFFFE and len(raw) >= 26 else tag
            kind = (ch, rate, bits, tag == 3) if (tag, bits) in {(1, 16), (1, 24), (1, 32), (3, 32), (3, 64)} and ch and rate else None
        elif name == b"data":
            data = (at, size)
    return Format(*kind, *data) if kind and data else None


def read_ints(f, fmt: Format, start: int, count: int) -> np.ndarray:
    """A10: channels by frames of whole numbers, bit by bit as stored."""
    width = fmt.bits // 8 * fmt.channels
    start = min(max(start, 0), fmt.frames)
    f.seek(fmt.data_at + start * width)
    raw = f.read(max(0, min(count, fmt.frames - start)) * width)
    if fmt.bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8
    else:
        x = np.frombuffer(raw, f"<i{fmt.bits // 8}")
    return x.reshape(-1, fmt.channels).T


def read_floats(f, fmt: Format, start: int, count: int) -> np.ndarray:
    """Channels by frames, whole numbers scaled to -1..1."""
    if fmt.floating:
        width = fmt.bits // 8 * fmt.channels
        start = min(max(start, 0), fmt.frames)
        f.seek(fmt.data_at + start * width)
        raw = f.read(max(0, min(count, fmt.frames - start)) * width)
        return np.frombuffer(raw, f"<f{fmt.bits // 8}").reshape(-1, fmt.channels).T.astype(np.float32)
    return (read_ints(f, fmt, start, count) / float(1 << (fmt.bits - 1))).astype(np.float32)


def write_wave(channels: np.ndarray, rate: int, bits: int = 16, extra: list[tuple[bytes, bytes]] | None = None) -> bytes:
    """A file of channels (rows), whole numbers, or 32-bit floats for bits 32; chunks of `extra` stand before the samples."""
    x = np.atleast_2d(channels).T
    if bits == 32:
        body, tag = x.astype("<f4").tobytes(), 3
    elif bits == 24:
        v = np.clip(np.round(x * (1 << 23)), -(1 << 23), (1 << 23) - 1).astype("<i4")
        body, tag = v.reshape(-1, 1).view(np.uint8).reshape(-1, 4)[:, :3].tobytes(), 1
    else:
        body, tag = np.clip(np.round(x * 32768), -32768, 32767).astype("<i2").tobytes(), 1
    n = x.shape[1]
    parts = [(b"fmt ", struct.pack("<HHIIHH", tag, n, rate, rate * n * bits // 8, n * bits // 8, bits)), *(extra or []), (b"data", body)]
    out = b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in parts)
    return b"RIFF" + struct.pack("<I", 4 + len(out)) + b"WAVE" + out


def iso_seconds(text: str | None) -> int | None:
    """Unix seconds of a date with a stated zone; fractions are cut off; None for anything else."""
    m = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.\d+)?(Z|[+-]\d\d:?\d\d)", text or "", re.A)
    if not m:
        return None
    y, mo, d, h, mi, s = map(int, m.groups()[:6])
    if s > 60 or h > 23 or mi > 59:
        return None
    try:
        day = datetime(y, mo, d, tzinfo=UTC)
    except ValueError:
        return None
    zone = m[7].replace(":", "")
    shift = 0 if zone == "Z" else (1 if zone[0] == "+" else -1) * (int(zone[1:3]) * 3600 + int(zone[3:]) * 60)
    return int(day.timestamp()) + h * 3600 + mi * 60 + s - shift


def bext(raw: bytes) -> dict:
    """Origination date and time (as UTC) and samples since midnight."""
    text = raw[320:338].decode("ascii", "replace")
    found = iso_seconds(f"{text[:10].replace('_', '-').replace(':', '-')}T{text[10:18].replace('-', ':').replace('.', ':')}Z")
    label = text[10:18] if re.fullmatch(r"\d\d[:.-]\d\d[:.-]\d\d", text[10:18]) else None
    reference = struct.unpack("<Q", raw[338:346])[0] if len(raw) >= 346 else None
    return {"recorded": found, "time_reference": reference, "origination": label}


def ixml_speed(xml: str) -> dict:
    """Frame rate (num, den), drop flag and samples since midnight, as stated; nothing is assumed."""
    try:
        root = ET.fromstring(xml.strip("\0 \r\n\t"))
    except ET.ParseError:
        return {}
    speed = root.find("SPEED")
    if speed is None:
        return {}
    m = re.fullmatch(r"(\d+)/(\d+)", (speed.findtext("TIMECODE_RATE") or "").strip())
    high, low = (speed.findtext(f"TIMESTAMP_SAMPLES_SINCE_MIDNIGHT_{k}") for k in ("HI", "LO"))
    ok = high is not None and low is not None and high.strip().isdigit() and low.strip().isdigit()
    return {"rate": (int(m[1]), int(m[2])) if m and int(m[2]) else None, "drop": {"DF": True, "NDF": False}.get((speed.findtext("TIMECODE_FLAG") or "").strip().upper()), "samples": (int(high) << 32) + int(low) if ok else None}


def media_span(xml: bytes, file_name: str) -> tuple[str, int, int] | None:
    """(set, number, count) of a linked file: two files or more, numbered 1 to n, exactly one marked as this one, by its name."""
    try:
        root = ET.fromstring(xml.strip(b"\0 \r\n\t"))
    except ET.ParseError:
        return None
    files = list(root.iter("FILE"))
    try:
        numbers = [int(x.findtext("FILENUMBER")) for x in files]
    except (TypeError, ValueError):
        return None
    own = [(n, x) for n, x in zip(numbers, files, strict=True) if x.get("type") == "actual"]
    name = (own[0][1].findtext("FILENAME") or "").strip().casefold() if len(own) == 1 else ""
    if len(files) < 2 or sorted(numbers) != list(range(1, len(files) + 1)) or name != file_name.casefold():
        return None
    key = (root.findtext("ID") or "").strip()
    return (f"bwf:{key}", own[0][0], len(files)) if key else None


def audio_timecode(reference: int | None, rate: int | None, ixml_samples: int | None, origination: str | None) -> tuple[float, str] | None:
    """Seconds since midnight and where they are from: the bext reference, the iXML stamp, the time of origination."""
    if reference is not None and rate:
        return reference / rate, "bext"
    if ixml_samples is not None and rate:
        return ixml_samples / rate, "ixml"
    if origination:
        h, m, s = map(int, re.split("[:.-]", origination))
        return float(h * 3600 + m * 60 + s), "label"
    return None


def sony_tail(content: bytes) -> str | None:
    """The camera's XML in the last MiB of a file."""
    tail = content[-(1 << 20) :]
    a, b = tail.rfind(b"<NonRealTimeMeta"), tail.rfind(b"</NonRealTimeMeta>")
    return tail[a : b + 18].decode("utf-8", "replace") if 0 <= a < b else None


def sony_metadata(xml: str | None) -> dict:
    """Timecode (h, m, s, f, fps) at the first change with frame 0, date, device."""
    if not xml:
        return {}
    root = ET.fromstring(re.sub(r'\sxmlns="[^"]*"', "", xml, count=1))
    out: dict = {"recorded": iso_seconds(d.get("value")) if (d := root.find("CreationDate")) is not None else None, "device": None, "timecode": None}
    dev = root.find("Device")
    if dev is not None:
        serial = (dev.get("serialNo") or "").strip()
        if serial and serial not in ("0", "4294967295") and set(serial.upper()) != {"F"} and dev.get("manufacturer") and dev.get("modelName"):
            out["device"] = f"device:{dev.get('manufacturer')}:{dev.get('modelName')}:{serial}"
    table = root.find("LtcChangeTable")
    if table is not None:
        change = next((c for c in table.findall("LtcChange") if c.get("frameCount") == "0"), None)
        value = change.get("value") if change is not None else ""
        if re.fullmatch(r"\d{8}", value or "", re.A):
            f, s, m, h = (int(value[i : i + 2]) for i in (0, 2, 4, 6))
            out["timecode"] = (h, m, s, f, float(table.get("tcFps")) if table.get("tcFps") else None)
    return out


def ltc_frames(x: np.ndarray, rate: float) -> list[tuple[int, int, float]]:
    """Frames of timecode in sound, as (first sample, frame number within the day at 40 frames a second or fewer by its digits, length).

    Biphase marks: a long interval between crossings is a 0, two short ones a 1; eighty bits end with the sync word."""
    sign = np.signbit(x - np.mean(x)) if len(x) else np.empty(0, bool)
    at = np.flatnonzero(sign[1:] != sign[:-1])
    gaps = np.diff(at)
    if len(gaps) < 160:
        return []
    half = np.median(gaps[gaps <= np.median(gaps) * 1.5]) if len(gaps) else 0
    bits, where, i = [], [], 0
    long_ = np.percentile(gaps, 90)
    cut = long_ * 0.75 if long_ > 1.5 * gaps.min() else half * 1.5
    while i < len(gaps):
        if gaps[i] > cut:
            bits.append(0)
            where.append(at[i])
            i += 1
        elif i + 1 < len(gaps) and gaps[i + 1] <= cut:
            bits.append(1)
            where.append(at[i])
            i += 2
        else:
            i += 1
    sync = (0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 1)
    out = []
    for end in range(80, len(bits) + 1):
        if tuple(bits[end - 16 : end]) == sync:
            b = bits[end - 80 : end]

            def digit(a: int, n: int, b=b) -> int:
                return sum(b[a + k] << k for k in range(n))

            f, s, m, h = digit(0, 4) + 10 * digit(8, 2), digit(16, 4) + 10 * digit(24, 3), digit(32, 4) + 10 * digit(40, 3), digit(48, 4) + 10 * digit(56, 2)
            stop = where[end] if end < len(where) else where[-1]
            out.append((int(where[end - 80]), (h * 3600 + m * 60 + s, f), float(stop - where[end - 80])))
    return out


def ltc_start(x: np.ndarray, rate: float, least: int = 8) -> tuple[float, int] | None:
    """(seconds of day at sample 0, frames a second) from the first eight frames in a row or more, each one more than the last."""
    found = ltc_frames(np.asarray(x, float), rate)
    if len(found) < least:
        return None
    fps = int(round(rate / np.median([f[2] for f in found[: 40]])))
    if not 1 <= fps <= 40:
        return None
    numbers = [s * fps + f for _, (s, f), _ in found]
    run = 0
    for i in range(1, len(numbers) + 1):
        if i == len(numbers) or numbers[i] != numbers[i - 1] + 1:
            if i - run >= least:
                return numbers[run] / fps - found[run][0] / rate, fps
            run = i
    return None


INSPECTED = "path string, channels int, rate int, bits int, floating boolean, frames bigint, recorded bigint, time_reference bigint, device string, set_id string, part int, part_count int, error string"


def inspected(files: DataFrame) -> DataFrame:
    """A row for each file (path, content) in any order; one that can't be read has an `error` and no figures. A date is
    taken from the camera's XML, else from the broadcast chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                row = dict.fromkeys(c.split()[0] for c in INSPECTED.split(", ")) | {"path": path}
                try:
                    f = io.BytesIO(content)
                    fmt = open_format(f)
                    if fmt is None or fmt.frames <= 0:
                        raise ValueError("no sound that can be read")
                    row |= {"channels": fmt.channels, "rate": fmt.rate, "bits": fmt.bits, "floating": fmt.floating, "frames": fmt.frames}
                    f.seek(0)
                    for name, at, size in list(chunks(f)):
                        f.seek(at)
                        raw = f.read(size) if name in (b"bext", b"link", b"iXML") else b""
                        if name == b"bext":
                            row |= {k: v for k, v in bext(raw).items() if k in row}
                        elif name == b"link" and (span := media_span(raw, path.rpartition("/")[2])):
                            row |= dict(zip(("set_id", "part", "part_count"), span, strict=True))
                    camera = sony_metadata(sony_tail(content))
                    row |= {k: camera[k] for k in ("recorded", "device") if camera.get(k) is not None}
                except (ValueError, struct.error, IndexError) as e:
                    row["error"] = str(e)
                rows.append(row)
            yield pd.DataFrame(rows).astype(object).where(lambda d: d.notna(), None)

    return files.select("path", "content").mapInPandas(run, INSPECTED)


def files(spark: SparkSession, folder: str, pattern: str = "*.{wav,WAV,wave,rf64}") -> DataFrame:
    """A2: files below a folder, less hidden ones and those in hidden folders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return found.where(~F.col("path").rlike(r"/\.[^/]+"))


BLOCK_SECONDS = 16.384  # a whole number of hops at 8 kHz


def blocks(found: DataFrame) -> DataFrame:
    """Sound of files (path, content) at 8 kHz, one channel, in pieces that begin on a frame and overlap by what a frame needs:
    (clip, first_frame, samples)."""
    from tidemark.operators.signal import mixed_mono, resampled

    hops = int(BLOCK_SECONDS * S.SAMPLE_RATE) // S.HOP

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                f = io.BytesIO(content)
                fmt = open_format(f)
                if fmt is None:
                    continue
                x = mixed_mono(read_floats(f, fmt, 0, fmt.frames))
                x = resampled(x, int(round(len(x) * S.SAMPLE_RATE / fmt.rate))).astype(np.float32)
                for first in range(0, max(1, len(x) // S.HOP), hops):
                    yield pd.DataFrame({"clip": [path], "first_frame": [first], "samples": [x[first * S.HOP : (first + hops) * S.HOP + S.FRAME - S.HOP]]})

    return found.select("path", "content").mapInPandas(run, "clip string, first_frame int, samples array<float>")


def window(samples: DataFrame, start: float, duration: float, rate: int) -> DataFrame:
    """Samples (clip, at, x) of a window, by their number."""
    first = int(round(max(0.0, start) * rate))
    return samples.where((F.col("at") >= first) & (F.col("at") < first + int(round(duration * rate))))
