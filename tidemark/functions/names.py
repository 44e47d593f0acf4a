"""Paths, names, keys and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of media and timeline files that are read.
MEDIA_EXTENSIONS = ("wav", "wave", "rf64", "bw64", "aif", "aiff", "mp3", "m4a", "aac", "flac", "mov", "mp4", "m4v", "mxf", "mts", "avi", "mkv")
#: Folder layouts of camera cards, from the card's root down.
CARD_LAYOUTS = ("PRIVATE/M4ROOT/CLIP", "PRIVATE/AVCHD/BDMV/STREAM", "PRIVATE/XDROOT/CLIP", "XDROOT/CLIP", "CONTENTS/CLIPS001", "CONTENTS/VIDEO", "DCIM/[0-9]{3}[A-Z0-9_]{5}", "BPAV/CLPR")


def file_name(path: Column) -> Column:
    """What stands after the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"[^.]\.([^.]+)$", 1))


def is_media(path: Column) -> Column:
    """A3: whether the extension is one that is read, in any case."""
    return extension(path).isin(*MEDIA_EXTENSIONS)


def folder(path: Column) -> Column:
    """The folder of a file."""
    return F.regexp_replace(path, "/[^/]*$", "")


def clip_id(path: Column, micros: Column) -> Column:
    """A4: the first 24 hex digits of SHA-256 over path, a zero byte and the duration in microseconds."""
    return F.substring(F.sha2(F.concat(F.encode(path, "utf-8"), F.lit(b"\x00"), F.encode(micros.cast("string"), "utf-8")), 256), 1, 24)


def file_url(path: Column) -> Column:
    """A file URL; letters, digits, `-._~/:` stay, other bytes are escaped. (`url_encode` writes a space as +.)"""
    quoted = F.replace(F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%3A"), F.lit(":"))
    return F.concat(F.lit("file://"), F.replace(F.replace(quoted, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))


def percent_decoded(text: Column) -> Column:
    """Escapes undone; a plus stays a plus."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def source_key(path: Column, device: Column, span: Column) -> Column:
    """The device, else the span's name, else the folder."""
    return F.coalesce(device, F.concat(F.lit("span:"), span), folder(path))


def source_name(key: Column) -> Column:
    """What a source is called: the model of a device, the name of a span, the last part of a folder."""
    return F.when(F.startswith(key, F.lit("device:")), F.element_at(F.split(key, ":"), 3)).when(F.startswith(key, F.lit("span:")), F.substring(key, 6, 10_000)).otherwise(file_name(key))


def card_root(path: Column) -> Column:
    """The folder less the longest camera-card layout at its end, if something is left."""
    upper, best = F.upper(path), F.lit(None).cast("int")
    for layout in CARD_LAYOUTS:
        tail = F.length(F.regexp_extract(upper, f"(/{layout})$", 1))
        best = F.greatest(best, F.when((tail > 0) & (tail < F.length(path)), tail))
    return F.when(best.isNotNull(), F.substring(path, F.lit(1), F.length(path) - best)).otherwise(path)


def layout_matches(name: Column, kind: str, value: str = "") -> Column:
    """Whether a folder's upper-cased name fits: named, numbered (prefix and digits), extension, any."""
    upper = F.upper(name)
    return {"named": upper == value.upper(), "numbered": upper.rlike(f"^{value.upper()}[0-9]+$"), "extension": F.endswith(upper, F.lit("." + value.upper())), "any": F.lit(True)}[kind]


def common_parents(left: Column, right: Column) -> Column:
    """How many folders from the end up are the same on both paths, in any case; the file's own name doesn't count."""
    def parts(p: Column) -> Column:
        return F.reverse(F.split(F.lower(folder(p)), "/"))

    same = F.zip_with(parts(left), parts(right), lambda a, b: F.coalesce(a == b, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s.n + (s.on & x).cast("int")).alias("n"), (s.on & x).alias("on")))["n"]


def assigned(label: Column, enabled: Column, symbol: Column, at_end: Column, usual: str = "*") -> Column:
    """A label with a mark before or after it; an empty mark adds nothing."""
    mark = F.coalesce(symbol, F.lit(usual))
    return F.when(~enabled | (mark == ""), label).when(at_end, F.concat_ws(" ", label, mark)).otherwise(F.concat_ws(" ", mark, label))


def xml_escaped(text: Column) -> Column:
    """Text for XML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def track_key(kind: Column, index: Column) -> Column:
    """Key of an imported track."""
    return F.format_string("imported-%s-%06d", kind, index)


def track_of_flag(flag: Column) -> Column:
    """Key of `V1` or `A2`; tracks are counted from 1; null for anything else."""
    kind, n = F.upper(F.regexp_extract(flag, r"^([vVaA])([0-9]+)$", 1)), F.regexp_extract(flag, r"^([vVaA])([0-9]+)$", 2).try_cast("int")
    return F.when(n >= 1, track_key(F.when(kind == "V", F.lit("video")).otherwise(F.lit("audio")), n - 1))


def key_and_value(flag: Column) -> Column:
    """What stands before and after the first `=`; null without one, or with nothing on a side."""
    at = F.instr(flag, "=")
    return F.when((at > 1) & (at < F.length(flag)), F.struct(F.substring(flag, F.lit(1), at - 1).alias("from"), F.substring(flag, at + 1, F.length(flag)).alias("to")))


def sidecar_name(stem: Column, label: Column, *identity: Column) -> Column:
    """A file name with the first 16 hex digits of a hash over the parts, each with its length in front."""
    parts = F.concat_ws("", *(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in identity))
    return F.concat(stem, F.lit("."), label, F.lit("."), F.substring(F.sha2(parts, 256), 1, 16), F.lit(".wav"))


def unique_names(names: list[str]) -> list[str]:
    """Names made unique in any case by numbers from 2 on, in order. For the small lists of folders in one project."""
    taken: set[str] = set()
    out = []
    for name in names:
        n, new = 2, name
        while new.casefold() in taken:
            new, n = f"{name} {n}", n + 1
        taken.add(new.casefold())
        out.append(new)
    return out


def folder_names(folders: list[str]) -> list[str]:
    """Each folder by its last part; those that share a name, in any case, take one parent more, until all differ or end."""
    parts = [[p for p in f.split("/") if p] or ["/"] for f in folders]
    depth = [1] * len(parts)
    while True:
        now = ["/".join(p[-d:]) for p, d in zip(parts, depth, strict=True)]
        seen: dict[str, list[int]] = {}
        for i, n in enumerate(now):
            seen.setdefault(n.casefold(), []).append(i)
        grow = [i for same in seen.values() if len(same) > 1 for i in same if depth[i] < len(parts[i])]
        if not grow:
            return now
        for i in grow:
            depth[i] += 1
