"""Recordings as a Python data source: WAVE, RF64 and BW64 files of any size, read by ranges of bytes.

`spark.read.format("wave").load(folder)` gives a row for each block of samples; `headers` asks for the columns of a file's header alone and
reads nothing else. The driver lists files and cuts them by their sizes into ranges; it opens none. A task reads the header of its
file, some hundred bytes, and of the samples only the blocks that begin in its range and pass the filters on `first`. So a file of
many gigabytes is dealt to many tasks, and none holds more than a block. Files that can't be read have an `error` and nothing else.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tidemark.operators.sound import BLOCK
from tidemark.sources.wav import Format, open_format, read_floats

HEADER = "path string, bytes bigint, channels int, rate int, bits int, floating boolean, frames bigint, error string"
SCHEMA = f"{HEADER}, first bigint, samples array<float>"
#: Endings of files that are read, and bytes of a task's range.
ENDINGS, RANGE_BYTES = (".wav", ".wave", ".rf64", ".bw64"), 256 << 20
ARROW = {"path": pa.string(), "bytes": pa.int64(), "channels": pa.int32(), "rate": pa.int32(), "bits": pa.int32(), "floating": pa.bool_(), "frames": pa.int64(), "error": pa.string(), "first": pa.int64(), "samples": pa.list_(pa.float32())}
OF_HEADER = ("channels", "rate", "bits", "frames")
COMPARE = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, local or of a URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    path: str
    size: int
    begin: int
    end: int


class WaveReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = [f.name for f in schema.fields]
        self.path, self.size = options["path"], int(options.get("blockframes", BLOCK))
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):
        """Comparisons of numbers of the header and of `first` with a value decide what is read."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in (*OF_HEADER, "first") and (type(f) in COMPARE or isinstance(f, In)):
                self.tests.append((name, type(f), f.value))
            else:
                yield f

    def passes(self, name: str, value: int) -> bool:
        return all(value in v if kind is In else COMPARE[kind](value, v) for n, kind, v in self.tests if n == name)

    def partitions(self):
        """Ranges of all files below the folder but hidden ones, by their sizes. Without samples a file is one range."""
        fs, path = opened(self.path)
        top = fs.get_file_info(path)
        found = [top] if top.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        inside = len(path.rstrip("/"))
        out = []
        for f in sorted(found, key=lambda f: f.path):
            hidden = any(p.startswith(".") for p in f.path[inside:].split("/"))
            if f.type == pafs.FileType.File and not hidden and f.path.lower().endswith(ENDINGS):
                step = self.range_bytes if "samples" in self.names or "first" in self.names else max(1, f.size)
                out += [Range(f.path, f.size, at, at + step) for at in range(0, max(1, f.size), step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = opened(self.path)
        with fs.open_input_file(partition.path) as f:
            yield from self.rows(f, partition)

    def rows(self, f, part: Range) -> Iterator[pa.RecordBatch]:
        """Rows of one range of an open file."""
        row = dict.fromkeys(ARROW) | {"path": part.path, "bytes": part.size}
        try:
            fmt = open_format(f)
            if fmt is None or fmt.frames <= 0:
                raise ValueError("no sound that can be read")
        except (ValueError, struct.error, IndexError, OSError) as e:
            if part.begin == 0 and not self.tests:
                yield self.batch(row | {"error": str(e)})
            return
        row |= {"channels": fmt.channels, "rate": fmt.rate, "bits": fmt.bits, "floating": fmt.floating, "frames": fmt.frames}
        if not all(self.passes(n, row[n]) for n in OF_HEADER):
            return
        if "samples" not in self.names and "first" not in self.names:
            yield self.batch(row)
            return
        for first in self.blocks(fmt, part):
            if self.passes("first", first):
                samples = read_floats(f, fmt, first, self.size).mean(0, dtype=np.float32) if "samples" in self.names else None
                yield self.batch(row | {"first": first, "samples": samples})

    def blocks(self, fmt: Format, part: Range) -> range:
        """First frames of the blocks whose first byte is in the range; the first range has those of a header that is longer than it."""
        width = fmt.channels * fmt.bits // 8 * self.size

        def number(byte: int) -> int:
            return max(0, -(-(byte - fmt.data_at) // width))

        low, high = (0 if part.begin == 0 else number(part.begin)), number(part.end)
        return range(low * self.size, min(high * self.size, fmt.frames), self.size)

    def batch(self, row: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row[n]], ARROW[n]) for n in self.names], names=self.names)


class WaveSource(DataSource):
    """Options: blockFrames (samples of a block), rangeBytes (bytes of a task). A schema given by the user names the columns that are wanted."""

    @classmethod
    def name(cls):
        return "wave"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WaveReader(schema, {k.lower(): v for k, v in self.options.items()})


def _reader(spark: SparkSession):
    spark.dataSource.register(WaveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("wave")


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each file below a folder: what its header says, or why it can't be read. No samples are read."""
    return _reader(spark).schema(HEADER).load(folder)


def sound(spark: SparkSession, folder: str, size: int = BLOCK, **options: str) -> DataFrame:
    """Files as sound for `operators.sound`, at their own rate: clip, rate, first, samples, in blocks of `size` samples; the mean of
    the channels."""
    found = _reader(spark).schema("path string, rate int, error string, first bigint, samples array<float>").options(blockFrames=str(size), **options).load(folder)
    return found.where("error IS NULL").select(F.col("path").alias("clip"), "rate", "first", "samples")
