"""Timeline documents as tables of edits: FCP 7 XML, FCPXML, AAF as JSON, and saved results.

A document is one project's, small and a tree, so it is parsed where it is read: on the driver for one (`read`), or in tasks,
a document each, for a folder of them (`edits_of`).
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEPTH = 8
EDITS = (
    "edit int, item string, name string, media string, track_index int, path string, source_in double, source_out double, start double, end double, "
    "speed double, reverse boolean, enabled boolean, channel int"
)
FIELDS = [c.split()[0] for c in EDITS.split(", ")]


class Document(NamedTuple):
    kind: str
    name: str
    frame: tuple[int, int]
    edits: list[dict]
    transitions: list[dict]
    warnings: list[str]


def sniff(head: str) -> str | None:
    """What kind of timeline a document is, by its root element; camera metadata and other XML are none."""
    m = re.search(r"<(?![?!])([A-Za-z:]+)", head)
    return {"xmeml": "fcp7", "fcpxml": "fcpxml"}.get(m[1]) if m else None


def path_of(url: str | None) -> str | None:
    """The path of a file URL; a plus stays a plus."""
    return unquote(re.sub(r"^file://(localhost)?", "", url)) if url else None


def number(node: ET.Element | None, name: str, default: float | None = None) -> float | None:
    text = node.findtext(name) if node is not None else None
    try:
        return float(text) if text is not None else default
    except ValueError:
        return default


def frame_of(node: ET.Element | None, default: tuple[int, int]) -> tuple[int, int]:
    """Frame duration (value, timescale) of a rate element; NTSC rates are a thousandth slower."""
    base = number(node.find("rate"), "timebase") if node is not None and node.find("rate") is not None else None
    if not base:
        return default
    ntsc = (node.find("rate").findtext("ntsc") or "").strip().upper() == "TRUE"
    return (1001, int(base) * 1000) if ntsc else (1, int(base))


def stated_speed(effect: ET.Element) -> float | None:
    """The speed an effect states, unless it varies."""
    values = {p.findtext("parameterid"): p.findtext("value") for p in effect.findall("parameter")}
    try:
        speed = float(values.get("speed") or "nan") / 100
    except ValueError:
        return None
    varies = (values.get("variablespeed") or "0").strip() not in ("0", "")
    return None if varies or speed != speed or speed in (0, float("inf")) else speed


def graph_retime(keys: list[tuple[float, float]], graph_in: float, graph_out: float, stated: float | None, item_fps: float = 1.0, file_fps: float = 1.0) -> tuple[float, bool, float, float] | None:
    """(speed, reverse, source in, source out) of a key-frame graph that is a line from frames of the item to frames of the file,
    which is what in and out are in; None if it bends, runs out of its source, or is empty. A stated speed within a hundredth stands
    for the slope."""
    keys = sorted(keys)
    if len(keys) < 2 or keys[-1][0] <= keys[0][0] or graph_out <= graph_in:
        return None
    (x0, y0), (x1, y1) = keys[0], keys[-1]
    slope = (y1 - y0) / (x1 - x0)
    if not slope or any(abs(y - (y0 + slope * (x - x0))) > max(0.05, abs(y1 - y0) * 1e-6) for x, y in keys):
        return None
    back, wanted = slope < 0, abs(stated or 0.0) * file_fps / item_fps
    if stated and abs(wanted - abs(slope)) <= 0.01 * wanted:
        slope = -wanted if back else wanted
    a, b = (y0 + slope * (x - x0) - back for x in (graph_in, graph_out))
    low, high = min(a, b), max(a, b)
    return (abs(slope) * item_fps / file_fps, back, low, high) if low >= -1e-9 and high > low else None


def clip_to_window(edit: dict, low: float, high: float) -> dict | None:
    """The part of an edit in [low, high); its source moves with it, from the other end if it runs backwards."""
    length = edit["end"] - edit["start"]
    start, end = max(edit["start"], low), min(edit["end"], high)
    if end <= start or length <= 0:
        return None
    per = (edit["source_out"] - edit["source_in"]) / length
    head, tail = (start - edit["start"]) * per, (edit["end"] - end) * per
    head, tail = (tail, head) if edit["reverse"] else (head, tail)
    return {**edit, "start": start, "end": end, "source_in": edit["source_in"] + head, "source_out": edit["source_out"] - tail}


class Fcp7:
    """Edits of an FCP 7 document."""

    def __init__(self, root: ET.Element):
        self.root, self.warnings, self.transitions = root, [], []
        self.files = {f.get("id"): f for f in root.iter("file") if f.find("pathurl") is not None}
        self.sequences = {s.get("id"): s for s in root.iter("sequence") if s.get("id") and s.find("media") is not None}
        nested = {id(s) for c in root.iter("clipitem") for s in c.iter("sequence")}
        self.top = [s for s in root.iter("sequence") if id(s) not in nested and s.find("media") is not None]

    def neighbour(self, items: list[ET.Element], i: int, name: str) -> float | None:
        """An edge of -1 is the matching edge of the transition beside it."""
        at = i - 1 if name == "start" else i + 1
        if 0 <= at < len(items) and items[at].tag == "transitionitem":
            return number(items[at], name)
        return None

    def track(self, track: ET.Element, media: str, index: int, frame: tuple[int, int], depth: int) -> Iterator[dict]:
        seconds = frame[0] / frame[1]
        items = [x for x in track if x.tag in ("clipitem", "transitionitem", "generatoritem")]
        seen: set[str] = set()
        for i, item in enumerate(items):
            if item.tag == "transitionitem":
                self.transitions.append({"media": media, "track_index": index, "start": (number(item, "start", 0) or 0) * seconds, "end": (number(item, "end", 0) or 0) * seconds, "alignment": item.findtext("alignment")})
                continue
            if item.tag == "generatoritem":
                continue
            key = item.get("id") or f"{media}-{index}-{i}"
            key = key if key not in seen else f"{key}-{i}"
            seen.add(key)
            start, end, a, b = (number(item, n) for n in ("start", "end", "in", "out"))
            start = self.neighbour(items, i, "start") if start == -1 else start
            end = self.neighbour(items, i, "end") if end == -1 else end
            if None in (start, end, a, b) or end <= start:
                self.warnings.append(f"{key}: its place can't be read")
                continue
            own = frame_of(item, frame)
            s = own[0] / own[1]
            edit = {
                "item": key, "name": item.findtext("name"), "media": media, "track_index": index, "path": None, "source_in": a * s, "source_out": b * s, "start": start * seconds, "end": end * seconds,
                "speed": 1.0, "reverse": False, "enabled": (item.findtext("enabled") or "TRUE").strip().upper() != "FALSE", "channel": None,
            }
            if (channel := number(item.find("sourcetrack"), "trackindex")) and media == "audio":
                edit["channel"] = int(channel) - 1
            for effect in item.iter("effect"):
                if (effect.findtext("effectid") or "").lower() == "timeremap":
                    graph = next((p for p in effect.findall("parameter") if p.findtext("parameterid") == "graphdict"), None)
                    keys = [(number(k, "when"), number(k, "value")) for k in graph.findall("keyframe")] if graph is not None else []
                    source = frame_of(self.file_of(item), own)
                    got = graph_retime([k for k in keys if None not in k], a, b, stated_speed(effect), own[1] / own[0], source[1] / source[0])
                    if got:
                        in_file = source[0] / source[1]
                        edit |= {"speed": got[0], "reverse": got[1], "source_in": got[2] * in_file, "source_out": got[3] * in_file}
                    elif (v := stated_speed(effect)) is not None:
                        edit |= {"speed": abs(v), "reverse": v < 0}
                    else:
                        self.warnings.append(f"{key}: its speed varies")
            yield from self.media(item, edit, depth)

    def file_of(self, item: ET.Element) -> ET.Element | None:
        ref = item.find("file")
        return self.files.get(ref.get("id"), ref) if ref is not None else None

    def media(self, item: ET.Element, edit: dict, depth: int) -> Iterator[dict]:
        nested = item.find("sequence")
        multi = item.find("multiclip")
        if multi is not None:
            angles = multi.findall("angle")
            active = [x for x in angles if (x.findtext("isactive") or x.findtext("activevideoangle") or "").strip().upper() == "TRUE"]
            if not active:
                self.warnings.append(f"{edit['item']}: no angle is marked, the first one is taken")
            angle = (active or angles or [None])[0]
            item = angle.find("clip") if angle is not None and angle.find("clip") is not None else angle if angle is not None else item
            nested = item.find("sequence")
        if nested is not None:
            inner = self.sequences.get(nested.get("id"), nested)
            if depth >= DEPTH:
                self.warnings.append(f"{edit['item']}: sequences are nested too deep")
                return
            per = (edit["end"] - edit["start"]) / (edit["source_out"] - edit["source_in"]) if edit["source_out"] > edit["source_in"] else 1.0
            for e in self.sequence(inner, depth + 1):
                if e["media"] != edit["media"]:
                    continue
                part = clip_to_window(e, edit["source_in"], edit["source_out"])
                if part:
                    yield part | {"item": f"{edit['item']}/{part['item']}", "track_index": edit["track_index"], "enabled": edit["enabled"] and part["enabled"], "start": edit["start"] + (part["start"] - edit["source_in"]) * per, "end": edit["start"] + (part["end"] - edit["source_in"]) * per}
            return
        found = self.file_of(item)
        path = path_of(found.findtext("pathurl")) if found is not None else None
        if path is None:
            self.warnings.append(f"{edit['item']}: it names no file")
            return
        yield edit | {"path": path}

    def sequence(self, seq: ET.Element, depth: int = 0) -> list[dict]:
        frame = frame_of(seq, (1, 25))
        out = []
        for media in ("video", "audio"):
            node = seq.find(f"media/{media}")
            for i, track in enumerate(node.findall("track") if node is not None else []):
                out += self.track(track, media, i, frame, depth)
        return out


def fraction(text: str | None) -> float:
    """Seconds of `n/ds` or `ns`; 0 for what can't be read."""
    m = re.fullmatch(r"\s*(-?[0-9.]+)(?:/([0-9.]+))?s?\s*", text or "")
    try:
        return float(m[1]) / float(m[2] or 1) if m else 0.0
    except (ValueError, ZeroDivisionError):
        return 0.0


def frame_duration(text: str | None) -> tuple[int, int]:
    """Of `n/ds` as it stands, of seconds by the nearest whole rate, else a twenty-fifth."""
    if m := re.fullmatch(r"(\d+)/(\d+)s", text or ""):
        return int(m[1]), int(m[2])
    s = fraction(text)
    return (1, round(1 / s)) if s > 0 else (1, 25)


class Fcpxml:
    """Edits of an FCPXML document."""

    STORY = ("asset-clip", "clip", "video", "audio", "ref-clip", "mc-clip", "sync-clip", "gap", "audition", "title", "spine")

    def __init__(self, root: ET.Element, prefer_proxies: bool = False):
        self.warnings: list[str] = []
        self.assets = {a.get("id"): a for a in root.iter("asset")}
        self.media = {m.get("id"): m for m in root.iter("media")}
        self.formats = {f.get("id"): f for f in root.iter("format")}
        self.proxies = prefer_proxies
        self.top = list(root.iter("project")) or [s for s in root.iter("sequence")]

    def path(self, asset: ET.Element) -> str | None:
        reps = {r.get("kind"): r.get("src") for r in asset.findall("media-rep")}
        kinds = ("proxy-media", "original-media") if self.proxies else ("original-media", "proxy-media")
        return path_of(next((reps[k] for k in kinds if reps.get(k)), asset.get("src")))

    def origin(self, seq: ET.Element) -> float:
        """The timecode at which the sequence begins, if its story keeps to it."""
        start = fraction(seq.get("tcStart"))
        spine = seq.find("spine")
        offsets = [fraction(x.get("offset")) for x in spine if x.get("offset")] if spine is not None else []
        return start if offsets and min(offsets) >= start - 1e-6 else 0.0

    def story(self, node: ET.Element, base: float, zero: float, lane: int, depth: int, seen: tuple[str, ...], window: tuple[float, float] | None) -> Iterator[dict]:
        """Edits of an element. base - zero: what its parent's time is on the timeline."""
        if depth > DEPTH:
            self.warnings.append("stories are nested too deep")
            return
        if node.tag == "audition":
            first = next((x for x in node if x.tag in self.STORY), None)
            if first is not None:
                yield from self.story(first, base, zero, lane, depth + 1, seen, window)
            return
        lane = lane + int(node.get("lane") or 0)
        at = base + fraction(node.get("offset")) - zero if node.get("offset") else base
        if node.tag == "spine":
            cursor = at
            for x in node:
                if x.tag in self.STORY:
                    place = base + fraction(x.get("offset")) - zero if x.get("offset") else cursor
                    yield from self.story(x, base if x.get("offset") else cursor, zero if x.get("offset") else 0.0, lane, depth + 1, seen, window)
                    cursor = place + fraction(x.get("duration"))
            return
        length, start = fraction(node.get("duration")), fraction(node.get("start"))
        ref = node.get("ref")
        edit = {"item": node.get("name") or ref, "name": node.get("name"), "track_index": lane, "start": at, "end": at + length, "speed": 1.0, "reverse": False, "enabled": node.get("enabled") != "0", "channel": None}
        if ref in self.assets and node.tag in ("asset-clip", "video", "audio"):
            asset = self.assets[ref]
            own = fraction(asset.get("start"))
            source = start - own if start >= own - 1e-6 else start
            kinds = [node.tag] if node.tag in ("video", "audio") else [k for k, f in (("video", "hasVideo"), ("audio", "hasAudio")) if asset.get(f) == "1"]
            kinds = [k for k in kinds if node.get("srcEnable", "all") in ("all", k)]
            for k in kinds:
                yield edit | {"media": k, "path": self.path(asset), "source_in": source, "source_out": source + length}
        elif ref in self.media and node.tag in ("ref-clip", "mc-clip"):
            if ref in seen:
                self.warnings.append(f"{ref}: it holds itself")
                return
            inner = self.media[ref].find("sequence")
            multi = self.media[ref].find("multicam")
            if inner is not None and inner.find("spine") is not None:
                yield from self.inside(self.story(inner.find("spine"), 0.0, self.origin(inner), 0, depth + 1, (*seen, ref), None), edit, start, lane)
            elif multi is not None:
                chosen = {s.get("angleID"): s.get("srcEnable") for s in node.findall("mc-source")}
                for angle in multi.findall("mc-angle"):
                    if chosen.get(angle.get("angleID"), "none" if chosen else "all") == "none":
                        continue
                    wanted = chosen.get(angle.get("angleID"), "all")
                    cursor, parts = 0.0, []
                    for x in angle:
                        if x.tag in self.STORY:
                            parts += self.story(x, cursor if not x.get("offset") else 0.0, fraction(multi.get("tcStart")) if x.get("offset") else 0.0, 0, depth + 1, (*seen, ref), None)
                            cursor = (fraction(x.get("offset")) - fraction(multi.get("tcStart")) if x.get("offset") else cursor) + fraction(x.get("duration"))
                    yield from self.inside((p for p in parts if wanted in ("all", p["media"])), edit, start, lane)
        for x in node:
            if x.tag in self.STORY and (node.tag in ("clip", "sync-clip", "gap", "asset-clip", "ref-clip", "mc-clip", "title", "video") ):
                yield from self.story(x, at, start if node.tag != "gap" else fraction(node.get("start")), lane, depth + 1, seen, window)

    def inside(self, parts, edit: dict, start: float, lane: int) -> Iterator[dict]:
        for p in parts:
            part = clip_to_window(p, start, start + edit["end"] - edit["start"])
            if part:
                yield part | {"start": edit["start"] + part["start"] - start, "end": edit["start"] + part["end"] - start, "track_index": lane + part["track_index"], "enabled": edit["enabled"] and part["enabled"]}

    def sequence(self, node: ET.Element) -> list[dict]:
        seq = node if node.tag == "sequence" else node.find("sequence")
        spine = seq.find("spine") if seq is not None else None
        return list(self.story(spine, 0.0, self.origin(seq), 0, 0, (), None)) if spine is not None else []


def parse(text: str, sequence: int = 0, prefer_proxies: bool = False) -> Document:
    """One sequence of a document. Raises ValueError for anything else."""
    kind = sniff(text[:4096])
    if kind is None:
        raise ValueError("not a timeline document")
    root = ET.fromstring(text)
    reader = Fcp7(root) if kind == "fcp7" else Fcpxml(root, prefer_proxies)
    if sequence >= len(reader.top):
        raise ValueError(f"it has {len(reader.top)} sequences")
    node = reader.top[sequence]
    edits = [e | {"edit": i} for i, e in enumerate(reader.sequence(node))]
    if kind == "fcp7":
        frame = frame_of(node, (1, 25))
    else:
        seq = node if node.tag == "sequence" else node.find("sequence")
        form = reader.formats.get(seq.get("format")) if seq is not None else None
        frame = frame_duration(form.get("frameDuration") if form is not None else None)
    return Document(kind, node.findtext("name") or node.get("name") or "", frame, edits, getattr(reader, "transitions", []), list(dict.fromkeys(reader.warnings)))


def listing(text: str) -> list[tuple[int, str, int]]:
    """(number, name, edits) of all sequences."""
    root = ET.fromstring(text)
    n = len((Fcp7(root) if sniff(text[:4096]) == "fcp7" else Fcpxml(root)).top)
    found = [parse(text, i) for i in range(n)]
    return [(i, d.name, len(d.edits)) for i, d in enumerate(found)]


def edits_of(documents: DataFrame) -> DataFrame:
    """Edits of all first sequences of documents (path, content), a document in a task at a time, with the document's path and an
    error where it can't be read."""
    schema = f"document string, {EDITS}, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    rows = [{**{f: e.get(f) for f in FIELDS}, "error": None} for e in parse(bytes(content).decode("utf-8")).edits]
                except (ValueError, ET.ParseError) as e:
                    rows = [dict.fromkeys(FIELDS) | {"error": str(e)}]
                if rows:
                    out = pd.DataFrame(rows).assign(document=path)[["document", *FIELDS, "error"]]
                    yield out.astype(object).where(out.notna(), None)

    return documents.select("path", "content").mapInPandas(run, schema)


AAF = "struct<frameRate:double,tracks:array<struct<kind:string,clips:array<struct<path:string,start:double,length:double,sourceStart:double,sourceRate:double>>>>>"


def aaf_edits(documents: DataFrame) -> DataFrame:
    """Documents (path, text) with tracks and clips as JSON, in their track's clock, as edits in seconds."""
    doc = documents.select("path", F.from_json("text", AAF).alias("d")).select(F.col("path").alias("document"), F.col("d.frameRate").alias("rate"), F.posexplode("d.tracks").alias("track_index", "t"))
    one = doc.select("document", "rate", "track_index", F.col("t.kind").alias("media"), F.posexplode("t.clips").alias("edit", "c"))
    return one.select("document", "edit", "media", "track_index", F.col("c.path").alias("path"), (F.col("c.sourceStart") / F.coalesce("c.sourceRate", "rate")).alias("source_in"), (F.col("c.start") / F.col("rate")).alias("start"), ((F.col("c.start") + F.col("c.length")) / F.col("rate")).alias("end"))


RESULT = "clips array<struct<id:string,url:string,kind:string>>, islands array<struct<id:int,placements:array<struct<clipID:string,offset:double,rate:double,driftPPM:double,confidence:double>>>>, unmatched array<string>, stage int"


def saved_results(spark: SparkSession, path: str) -> DataFrame:
    """Saved results: one object or a list of them in a file."""
    return spark.read.schema(RESULT).json(path, multiLine=True)


def probes(rows: DataFrame, column: str = "json") -> DataFrame:
    """Headers that a media prober reports as JSON: a row for each stream."""
    shape = "struct<format:struct<duration:string,format_name:string>,streams:array<struct<index:int,codec_type:string,sample_rate:string,channels:int,width:int,height:int,r_frame_rate:string,avg_frame_rate:string,tags:map<string,string>>>>"
    p = rows.withColumn("p", F.from_json(column, shape))
    kept = [c for c in rows.columns if c != column]

    def rate(c: str):
        parts = F.split(F.col(c), "/")
        return F.when(F.try_element_at(parts, F.lit(2)).try_cast("double") != 0, F.try_element_at(parts, F.lit(1)).try_cast("double") / F.try_element_at(parts, F.lit(2)).try_cast("double"))

    s = p.select(*kept, F.col("p.format.duration").try_cast("double").alias("duration"), F.explode("p.streams").alias("s"))
    return s.select(*kept, "duration", F.col("s.index").alias("stream"), F.col("s.codec_type").alias("kind"), F.col("s.sample_rate").try_cast("double").alias("sample_rate"), "s.channels", "s.width", "s.height", rate("s.avg_frame_rate").alias("fps"), F.try_element_at("s.tags", F.lit("timecode")).alias("timecode"))


def expand(inputs: list[str]) -> tuple[list[str], str | None]:
    """A1: media paths in order, once each, and the timeline among them; a second one is an error."""
    timelines = sorted({p for p in inputs if p.lower().endswith((".xml", ".fcpxml", ".aaf"))})
    if len(timelines) > 1:
        raise ValueError("two timelines were given")
    return sorted(set(inputs) - set(timelines)), timelines[0] if timelines else None


def dumps(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
