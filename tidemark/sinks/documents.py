"""Documents for editors from the items of one project: FCP 7 XML, FCPXML, OTIO, AAF manifests; results as JSON.

Items: id, name, path, kind, track, start, duration, source_in, source_duration, rate. A document holds one project and is put
together from its collected rows; the tables behind it stay distributed.
"""

from __future__ import annotations

import json
import math
import os
import re
import uuid
import xml.etree.ElementTree as ET
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame

COLUMNS = ("id", "name", "path", "kind", "track", "start", "duration", "source_in", "source_duration", "rate")


def rows_of(items: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in items.select(*COLUMNS).orderBy("kind", "track", "start", "id").collect()]


def url_of(path: str) -> str:
    return "file://" + quote(path, safe="/:-._~")


def half_away(x: float) -> int:
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def start_frame(kind: str, seconds: float, fps: float, sample_rate: float = 48_000) -> int:
    """Pictures on the nearest frame; sound on the frame it begins in, or the next from half on."""
    frames = round(seconds, 5) * fps
    if kind == "video":
        return half_away(frames)
    near = half_away(frames)
    if abs(frames - near) * sample_rate / fps <= 0.5:
        return near
    return math.floor(frames) + (frames - math.floor(frames) >= 0.5)


def fcp7(name: str, items: list[dict], frame: tuple[int, int] = (1, 25)) -> str:
    """A sequence with tracks, items, files once each, and links between items of one clip."""
    fps = frame[1] / frame[0]
    base, ntsc = round(fps), frame[0] == 1001
    root = ET.Element("xmeml", version="5")
    seq = ET.SubElement(root, "sequence", id="sequence-1")

    def put(node: ET.Element, tag: str, text) -> ET.Element:
        child = ET.SubElement(node, tag)
        child.text = str(text)
        return child

    def rate(node: ET.Element) -> None:
        r = ET.SubElement(node, "rate")
        put(r, "timebase", base)
        put(r, "ntsc", "TRUE" if ntsc else "FALSE")

    put(seq, "name", name)
    put(seq, "duration", half_away(max([0.0, *(i["start"] + i["duration"] for i in items)]) * fps))
    rate(seq)
    media = ET.SubElement(seq, "media")
    files: dict[str, str] = {}
    same: dict[str, list[dict]] = {}
    for i in items:
        same.setdefault(i["id"], []).append(i)
    place = {}
    for kind in ("video", "audio"):
        for t, track in enumerate(sorted({i["track"] for i in items if i["kind"] == kind})):
            for n, i in enumerate(x for x in items if x["kind"] == kind and x["track"] == track):
                place[kind, i["id"]] = (t + 1, n + 1)
    for kind in ("video", "audio"):
        node = ET.SubElement(media, kind)
        for track in sorted({i["track"] for i in items if i["kind"] == kind}):
            row = ET.SubElement(node, "track")
            for i in (x for x in items if x["kind"] == kind and x["track"] == track):
                c = ET.SubElement(row, "clipitem", id=f"{kind}-{i['id']}")
                put(c, "name", i["name"])
                put(c, "enabled", "TRUE")
                rate(c)
                start = start_frame(kind, i["start"], fps)
                length = max(1, half_away(i["duration"] * fps))
                first = half_away(i["source_in"] * fps)
                for tag, v in (("start", start), ("end", start + length), ("in", first), ("out", first + length)):
                    put(c, tag, v)
                if i["path"] in files:
                    ET.SubElement(c, "file", id=files[i["path"]])
                else:
                    files[i["path"]] = f"file-{len(files) + 1}"
                    f = ET.SubElement(c, "file", id=files[i["path"]])
                    put(f, "name", i["path"].rpartition("/")[2])
                    put(f, "pathurl", url_of(i["path"]))
                    rate(f)
                    put(f, "duration", half_away(i["source_duration"] * fps))
                if len(same[i["id"]]) > 1:
                    for other in same[i["id"]]:
                        link = ET.SubElement(c, "link")
                        put(link, "linkclipref", f"{other['kind']}-{other['id']}")
                        put(link, "mediatype", other["kind"])
                        t, n = place[other["kind"], other["id"]]
                        put(link, "trackindex", t)
                        put(link, "clipindex", n)
    ET.indent(root)
    return '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE xmeml>\n' + ET.tostring(root, encoding="unicode") + "\n"


def rational(seconds: float, frame: tuple[int, int]) -> str:
    """A time on the frame grid, or in microseconds where it is off it."""
    value, scale = frame
    n = half_away(seconds * scale / value)
    if abs(seconds - n * value / scale) <= 1e-6:
        return f"{n * value}/{scale}s" if n else "0s"
    return f"{half_away(seconds * 1e6)}/1000000s"


def fcpxml(name: str, items: list[dict], frame: tuple[int, int] = (1, 25)) -> str:
    """A project whose story is a gap that all clips are connected to, on lanes."""
    root = ET.Element("fcpxml", version="1.10")
    res = ET.SubElement(root, "resources")
    ET.SubElement(res, "format", id="r1", frameDuration=f"{frame[0]}/{frame[1]}s")
    assets: dict[str, str] = {}
    kinds: dict[str, set[str]] = {}
    for i in items:
        kinds.setdefault(i["path"], set()).add(i["kind"])
    for i in items:
        if i["path"] not in assets:
            assets[i["path"]] = f"r{len(assets) + 2}"
            own = {"hasVideo": "1"} if "video" in kinds[i["path"]] else {}
            own |= {"hasAudio": "1"} if "audio" in kinds[i["path"]] else {}
            a = ET.SubElement(res, "asset", id=assets[i["path"]], name=i["path"].rpartition("/")[2], start="0s", duration=rational(i["source_duration"], frame), **own)
            ET.SubElement(a, "media-rep", kind="original-media", src=url_of(i["path"]))
    seq = ET.SubElement(ET.SubElement(ET.SubElement(ET.SubElement(root, "library"), "event", name=name), "project", name=name), "sequence", format="r1", tcStart="0s")
    end = max([0.0, *(i["start"] + i["duration"] for i in items)])
    gap = ET.SubElement(ET.SubElement(seq, "spine"), "gap", name="Gap", offset="0s", start="0s", duration=rational(math.ceil(end * frame[1] / frame[0] - 1e-6) * frame[0] / frame[1], frame))
    for i in items:
        lane = i["track"] + 1 if i["kind"] == "video" else -(i["track"] + 1)
        ET.SubElement(gap, "asset-clip", ref=assets[i["path"]], name=i["name"], lane=str(lane), srcEnable=i["kind"], offset=rational(i["start"], frame), start=rational(i["source_in"], frame), duration=rational(i["duration"], frame))
    ET.indent(root)
    return '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE fcpxml>\n' + ET.tostring(root, encoding="unicode") + "\n"


def combined_fcpxml(documents: list[str]) -> str:
    """Several documents as one; resource ids get the number of their document in front."""
    out = ET.Element("fcpxml", version="1.10")
    res, lib = ET.SubElement(out, "resources"), ET.SubElement(out, "library")
    for n, text in enumerate(documents, 1):
        root = ET.fromstring(text)
        for x in root.iter():
            for k in ("id", "ref", "format"):
                if x.get(k):
                    x.set(k, f"s{n}-{x.get(k)}")
        res.extend(root.find("resources"))
        lib.extend(root.find("library"))
    return '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE fcpxml>\n' + ET.tostring(out, encoding="unicode") + "\n"


def combined_fcp7(documents: list[tuple[str, str]]) -> str:
    """Sequences of several documents in one project; ids get their document's name in front."""
    out = ET.Element("xmeml", version="5")
    kids = ET.SubElement(ET.SubElement(out, "project"), "children")
    for name, text in documents:
        root = ET.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", text))
        for x in root.iter():
            if x.get("id"):
                x.set("id", f"{name}-{x.get('id')}")
            if x.tag == "linkclipref":
                x.text = f"{name}-{x.text}"
        kids.extend(root.findall("sequence"))
    return '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE xmeml>\n' + ET.tostring(out, encoding="unicode") + "\n"


def rational_time(seconds: float, rate: float) -> dict:
    """L23."""
    return {"OTIO_SCHEMA": "RationalTime.1", "value": round(seconds * rate, 6), "rate": rate}


def time_range(start: float, duration: float, rate: float) -> dict:
    return {"OTIO_SCHEMA": "TimeRange.1", "start_time": rational_time(start, rate), "duration": rational_time(duration, rate)}


def otio(name: str, items: list[dict], rate: float = 25.0) -> str:
    """A timeline with gaps between clips and a time warp where the rate isn't 1."""
    tracks = []
    for kind in ("video", "audio"):
        for track in sorted({i["track"] for i in items if i["kind"] == kind}):
            kids, cursor = [], 0.0
            for i in sorted((x for x in items if x["kind"] == kind and x["track"] == track), key=lambda x: x["start"]):
                if i["start"] - cursor > 0.5 / 48_000:
                    kids.append({"OTIO_SCHEMA": "Gap.1", "source_range": time_range(0, i["start"] - cursor, rate)})
                warp = [{"OTIO_SCHEMA": "LinearTimeWarp.1", "time_scalar": i["rate"]}] if abs(i["rate"] - 1) > 1e-9 else []
                ref = {"OTIO_SCHEMA": "ExternalReference.1", "target_url": url_of(i["path"]), "available_range": time_range(0, i["source_duration"], rate)}
                kids.append({"OTIO_SCHEMA": "Clip.1", "name": i["name"], "source_range": time_range(i["source_in"], i["duration"], rate), "media_reference": ref, "effects": warp})
                cursor = max(cursor, i["start"] + i["duration"])
            tracks.append({"OTIO_SCHEMA": "Track.1", "kind": kind.capitalize(), "children": kids})
    return json.dumps({"OTIO_SCHEMA": "Timeline.1", "name": name, "tracks": {"OTIO_SCHEMA": "Stack.1", "children": tracks}}, ensure_ascii=False, indent=1)


def aaf_manifest(name: str, items: list[dict], rate: float = 48_000.0) -> str:
    """Tracks and clips in whole units of the composition's rate, for a writer of AAF files."""
    tracks = []
    for kind in ("video", "audio"):
        for track in sorted({i["track"] for i in items if i["kind"] == kind}):
            clips = [{"path": i["path"], "name": i["name"], "start": half_away(i["start"] * rate), "length": half_away(i["duration"] * rate), "sourceStart": half_away(i["source_in"] * rate), "sourceRate": rate} for i in items if i["kind"] == kind and i["track"] == track]
            tracks.append({"kind": kind, "clips": clips})
    return json.dumps({"version": 2, "name": name, "frameRate": rate, "tracks": tracks}, ensure_ascii=False)


def result_json(placements: DataFrame, clips: DataFrame, stage: int = 0) -> str:
    """One project's result: clips, islands with placements, unmatched clips."""
    rows = placements.select("clip", "island", "offset", "rate", "drift_ppm", "confidence").orderBy("island", "clip").collect()
    islands: dict[int, list[dict]] = {}
    for r in rows:
        if r.island is not None:
            islands.setdefault(r.island, []).append({"clipID": str(r.clip), "offset": r.offset, "rate": r.rate, "driftPPM": r.drift_ppm, "confidence": r.confidence})
    media = [{"id": str(c.clip), "url": c.url, "kind": c.kind} for c in clips.select("clip", "url", "kind").orderBy("clip").collect()]
    return json.dumps({"clips": media, "islands": [{"id": k, "placements": v} for k, v in sorted(islands.items())], "unmatched": sorted(str(r.clip) for r in rows if r.island is None), "stage": stage}, ensure_ascii=False)


def save(path: str, text: str) -> None:
    """Written beside its place and then moved there, so a reader finds the old or the new file whole."""
    place = Path(path)
    beside = place.with_name(f".{place.name}.{uuid.uuid4().hex}")
    try:
        beside.write_text(text, encoding="utf-8")
        os.replace(beside, place)
    finally:
        beside.unlink(missing_ok=True)


def relinked_copy(text: str, moved: dict[str, str]) -> str:
    """The document with locations of media rewritten, and nothing else."""
    def turn(m: re.Match) -> str:
        from tidemark.sources.timelines import path_of

        new = moved.get(path_of(m[2]))
        return m[1] + url_of(new) + m[3] if new else m[0]

    text = re.sub(r"(<pathurl>)([^<]*)(</pathurl>)", turn, text)
    return re.sub(r'(<(?:media-rep|asset)\b[^>]*\bsrc=")([^"]*)(")', turn, text)


def export(items: DataFrame, name: str, folder: str, formats: tuple[str, ...] = ("fcp7", "fcpxml", "otio", "aaf")) -> list[str]:
    """A project in several formats, in one folder."""
    rows = rows_of(items)
    made = {"fcp7": (".xml", fcp7), "fcpxml": (".fcpxml", fcpxml), "otio": (".otio", otio), "aaf": (".aaf.json", aaf_manifest)}
    out = []
    for f in formats:
        end, write = made[f]
        out.append(f"{folder}/{name}{end}")
        save(out[-1], write(name, rows))
    return out
