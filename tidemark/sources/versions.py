"""A table whose changes are seen whole: versions in folders, and manifests that name them.

A version's rows are written to a folder that nobody knows of yet. Then a manifest, a small file with the folder's name, is created
under the next number, and that is the change: readers take the manifest with the greatest number. A writer that dies before
leaves the table as it was and a folder that `swept` removes. Of two writers who start from one version the second finds the number
taken and has to begin anew, so no change is lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import fingerprints

ENTRY = "key string, media string, variant string, version int, kind string, modified timestamp, bytes bigint, waveform_bytes bigint, payload string"


class Changed(RuntimeError):
    """Another writer has made the next version in the meantime."""


class Versions:
    """path: a folder that driver and executors share; schema: of the table (DDL)."""

    def __init__(self, spark: SparkSession, path: str, schema: str = ENTRY):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _named(self, number: int) -> str | None:
        """The folder that a manifest names; None while it isn't whole: a name ends with a line's end."""
        at = self._at(f"manifests/{number:012}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return text[:-1] if text.endswith("\n") else None

    def number(self) -> int:
        """The version that readers see; 0: none."""
        numbers = [int(n) for n in self._names("manifests") if n.isdigit()]
        return next((n for n in sorted(numbers, reverse=True) if self._named(n)), 0)

    def read(self, number: int | None = None) -> DataFrame:
        number = self.number() if number is None else number
        if not number:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{self._named(number)}")

    def prepared(self, df: DataFrame) -> str:
        """Rows written to a folder that no manifest names."""
        name = uuid.uuid4().hex
        fields = self.spark.createDataFrame([], self.schema).schema
        df.select(*(F.col(f.name).cast(f.dataType) for f in fields)).write.parquet(f"{self.path}/data/{name}")
        return name

    def swapped(self, name: str, number: int) -> int:
        """Make a prepared folder the version after `number`; raises Changed if there is one already."""
        at = self._at(f"manifests/{number + 1:012}")
        try:
            stream = self._fs.create(at, False)
        except Exception as e:
            if self._fs.exists(at):
                raise Changed(f"version {number + 1} is there already") from e
            raise
        try:
            stream.write(bytearray(f"{name}\n".encode()))
        finally:
            stream.close()
        return number + 1

    def change(self, how: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
        """The table as `how` makes it of the version that is read; begun anew, up to `tries` times, where another writer was first."""
        for left in reversed(range(tries)):
            number = self.number()
            try:
                return self.swapped(self.prepared(how(self.read(number))), number)
            except Changed:
                if not left:
                    raise
        raise AssertionError

    def swept(self, keep: int = 2) -> None:
        """Remove versions but for the last `keep`, and what writers left that died: folders, and a number that one had taken. Not while
        others write."""
        taken = [int(n) for n in self._names("manifests") if n.isdigit()]
        numbers = [n for n in taken if self._named(n)]
        for n in set(taken) - set(numbers):
            self._fs.delete(self._at(f"manifests/{n:012}"), False)
        last = numbers[-keep:]
        held = {self._named(n) for n in last}
        for n in numbers[:-keep]:
            self._fs.delete(self._at(f"manifests/{n:012}"), False)
        for name in self._names("data"):
            if name not in held:
                self._fs.delete(self._at(f"data/{name}"), True)


class Cache(Versions):
    """The cache of landmarks as such a table: every change is one swap."""

    def stored(self, entries: DataFrame) -> int:
        """Entries written over those of their key, kind and version."""
        own = ["key", "kind", "version"]
        return self.change(lambda held: held.join(entries.select(*own), own, "left_anti").unionByName(entries.select(*held.columns)))

    def loaded(self, wanted: DataFrame) -> DataFrame:
        """Payloads (media, key, payload) of wanted (media, key, legacy_key). What only the legacy version has is written anew under its key, with
        the legacy entry left as it was, before anything is returned: it is found at once from then on."""
        found = fingerprints.load(wanted, self.read())
        if not found.where("promoted").isEmpty():
            self.change(lambda held: self._promoted(wanted, held))
            found = fingerprints.load(wanted, self.read())
        return found.select("media", "key", "payload")

    @staticmethod
    def _promoted(wanted: DataFrame, held: DataFrame) -> DataFrame:
        new = fingerprints.load(wanted, held).where("promoted").select("key").distinct()
        old = held.where((F.col("kind") == "bin") & (F.col("version") == fingerprints.LEGACY_VERSION))
        named = wanted.join(new, "key", "left_semi").groupBy("key").agg(F.first("legacy_key").alias("legacy"), F.first("media").cast("string").alias("of"))
        made = old.join(named.withColumnRenamed("key", "new"), old["key"] == F.col("legacy")).withColumns({"key": F.col("new"), "media": F.col("of"), "version": F.lit(fingerprints.VERSION)})
        return held.unionByName(made.select(*held.columns))

    def pruned(self, now: Column, seconds: float) -> int:
        """J3."""
        return self.change(lambda held: fingerprints.pruned(held, now, seconds))

    def cleared(self, media: DataFrame) -> int:
        """J4."""
        return self.change(lambda held: fingerprints.without_media(held, media))
