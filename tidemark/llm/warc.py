"""WARC archives as a Spark data source in Python.

Reading: a partition is a file. Of each record the headers are read first; record types and header values that the query
asks for (pushed down, or given as options) decide whether the rest is read; what isn't wanted is skipped by its length,
without decoding it (in compressed archives it is inflated, as nothing else tells where it ends). A schema without
`payload` leaves out all payloads.

Writing: each task writes files of its own, rolled at `maxFileBytes`, and names them to the driver, which lists them in a
manifest at the end. Files of failed or repeated tasks are in no manifest and are never read, so a lost executor does no
harm. Files are reached through pyarrow's file systems, so a path may be in any store those know.

Revisits: `with_revisits` marks records whose payload another one holds.
"""

from __future__ import annotations

import base64
import gzip
import io
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.llm.shared import aside, back, without

SCHEMA = "record_id string, record_type string, target_uri string, date string, content_type string, payload_digest string, payload_length long, refers_to string, payload binary"
WRITTEN = "record_id string, record_type string, target_uri string, payload_digest string, payload_length long, refers_to string, payload binary"
MANIFEST, DATE = "_manifest.json", "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header names of the columns that filters are pushed down to. (content_type isn't one: of a response it is in the HTTP head.)
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "date": "warc-date"}
#: Payloads of at least so many bytes are stored once, and digests of payloads that go to all tasks, at most.
REVISIT_BYTES, BROADCAST_ROWS = 1000, 200_000
BATCH_BYTES, FILE_BYTES = 8 << 20, 256 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def digest_header(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def digest_hex(header: str | None) -> str | None:
    kind, _, value = (header or "").partition(":")
    if kind != "sha1":
        return None
    return base64.b32decode(value).hex() if len(value) == 32 else value.lower()


def record(row: dict, date: str = DATE) -> bytes:
    """One record. A revisit holds the response's HTTP head, which has the payload's length, and no payload."""
    payload = row["payload"] or b""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    block = head if row["record_type"] == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {date}"]
    if row["target_uri"] is not None:
        lines.append("WARC-Target-URI: " + row["target_uri"].replace("\r", "%0D").replace("\n", "%0A"))
    if row["payload_digest"]:
        lines.append(f"WARC-Payload-Digest: {digest_header(row['payload_digest'])}")
    if row["record_type"] == "revisit":
        lines += [f"WARC-Refers-To: <{row['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def head_of(stream) -> dict[str, str] | None:
    """Headers up to the empty line, names in lower case; None at the end of the stream."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith((b"WARC/", b"HTTP/")):
        raise ValueError(f"no record begins with {line[:40]!r}")
    out = {"": line.decode("latin-1").strip()}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def bare(header: str | None) -> str | None:
    return header[1:-1] if header and header[0] == "<" and header[-1] == ">" else header


def records(stream, wanted, payloads: bool, seekable: bool) -> Iterator[dict]:
    """Records whose headers `wanted` accepts. Others, and payloads that nobody asked for, are skipped by their length."""

    def skip(n: int) -> None:
        if seekable:
            stream.seek(n, io.SEEK_CUR)
        else:
            while n > 0 and (got := stream.read(min(n, 1 << 20))):
                n -= len(got)

    while (h := head_of(stream)) is not None:
        left = int(h["content-length"])
        if not wanted(h):
            skip(left)
            continue
        http = {}
        if h.get("content-type", "").startswith("application/http"):
            head = io.BytesIO()
            while left > 0 and (line := stream.readline(left)):
                left -= len(line)
                head.write(line)
                if line in (b"\r\n", b"\n"):
                    break
            head.seek(0)
            http = head_of(head) or {}
        stored = h["warc-type"] != "revisit"
        length = left if stored else int(http.get("content-length", 0))
        payload = stream.read(left) if payloads and stored else None
        if payload is None:
            skip(left)
        yield {
            "record_id": bare(h.get("warc-record-id")), "record_type": h["warc-type"], "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "content_type": http.get("content-type", h.get("content-type")),
            "payload_digest": digest_hex(h.get("warc-payload-digest")), "payload_length": length, "refers_to": bare(h.get("warc-refers-to")), "payload": payload,
        }


class OneFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.checks = schema, options["path"], []
        if types := options.get("recordtypes"):
            self.checks.append(("record_type", "in", tuple(types.split(","))))
        if prefix := options.get("uriprefix"):
            self.checks.append(("target_uri", "starts", prefix))

    def pushFilters(self, filters):
        """Equality, IN and beginnings on header columns are answered here; the rest goes back to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind = {EqualTo: "is", In: "in", StringStartsWith: "starts"}.get(type(f))
            if column in HEADERS and kind:
                self.checks.append((column, kind, tuple(f.value) if kind == "in" else f.value))
            else:
                yield f

    def partitions(self):
        fs, path = opened(self.path)
        if fs.get_file_info(f"{path}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{path}/{MANIFEST}") as f:
                names = json.loads(f.read())
            files = [f"{path}/{n}" for n in names]
        else:
            info = fs.get_file_info(path)
            files = [path] if info.type == pafs.FileType.File else [x.path for x in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if x.path.endswith((".warc", ".warc.gz"))]
        return [OneFile(f) for f in sorted(files)]

    def wanted(self, h: dict[str, str]) -> bool:
        for column, kind, value in self.checks:
            got = h.get(HEADERS[column])
            got = bare(got) if column in ("record_id", "refers_to") else got
            if got is None or not (got == value if kind == "is" else got in value if kind == "in" else got.startswith(value)):
                return False
        return True

    def read(self, partition):
        if partition is None or not getattr(partition, "path", None):
            return
        fs, _ = opened(self.path)
        names = self.schema.fieldNames()
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        rows, held = [], 0
        with fs.open_input_file(partition.path) as raw:
            packed = raw.read(2) == b"\x1f\x8b"
            raw.seek(0)
            stream = gzip.GzipFile(fileobj=raw) if packed else io.BufferedReader(raw, 1 << 18)
            for r in records(stream, self.wanted, "payload" in names, not packed):
                rows.append({n: r.get(n) for n in names})
                held += len(r["payload"] or b"") + 400
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class Files(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.packed, self.most = options.get("compression") == "gzip", int(options.get("maxfilebytes", FILE_BYTES))

    def write(self, iterator):
        fs, path = opened(self.path)
        fs.create_dir(path, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= self.most:
                    if out:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.packed)
                    out, size = fs.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                data = record(row)
                data = gzip.compress(data, 1, mtime=0) if self.packed else data
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Files(names)

    def commit(self, messages):
        fs, path = opened(self.path)
        fs.create_dir(path, recursive=True)
        names = sorted(n for m in messages if m for n in m.names)
        manifest = f"{path}/{MANIFEST}"
        if not self.overwrite and fs.get_file_info(manifest).type == pafs.FileType.File:
            with fs.open_input_stream(manifest) as f:
                names = sorted({*json.loads(f.read()), *names})
        with fs.open_output_stream(manifest, compression=None) as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages):
        fs, path = opened(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{path}/{name}")


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder). Options: recordTypes (comma-separated), uriPrefix; of writing: compression
    (gzip), maxFileBytes. A schema given by the user names the columns that are wanted."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite):
        return WarcWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_revisits(rows: DataFrame, order: str) -> DataFrame:
    """rows (record_id, target_uri, payload and the column `order`) with payload_digest, payload_length, record_type and
    refers_to. Of rows with equal payloads of REVISIT_BYTES or more, that with the largest `order` is the response and the
    others revisit it; if several share it, each is a response. Without a non-null `order` among them all are responses.
    A null payload is the empty one. Columns of the added names are replaced; an empty table gives an empty one."""
    names = [c for c in without(rows, ("payload_digest", "payload_length", "record_type", "refers_to")).columns if c != "payload"]
    payload = F.coalesce(rows["payload"], F.lit(b""))
    rows = rows.select(*aside(rows, names), rows[f"`{order}`"].alias("o"), rows["record_id"].alias("id"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")})
    same = rows.where(F.col("payload_length") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.max(F.struct("o", "id")).alias("kept"), F.count(F.lit(1)).alias("c")).where("c > 1 AND kept.o IS NOT NULL").select("payload_digest", "kept")
    if same.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        same = F.broadcast(same)
    rows = rows.join(same, "payload_digest", "left")
    again = F.col("kept").isNotNull() & ~F.col("o").eqNullSafe(F.col("kept.o"))
    return rows.select(*back(names), F.when(~again, F.col("payload")).alias("payload"), "payload_digest", "payload_length", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("kept.id")).alias("refers_to"))


def archived(rows: DataFrame, path: str, **options: str) -> None:
    """Write records (with the columns of WRITTEN) to a folder of archives."""
    register(rows.sparkSession)
    rows.select("record_id", "record_type", "target_uri", "payload_digest", "payload_length", "refers_to", "payload").write.format("warc").mode("append").options(**options).save(path)


def read(spark: SparkSession, path: str, columns: str = SCHEMA, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(columns).options(**options).load(path)
