"""WARC archives as a Python data source: spark.read.format("warc"), frame.write.format("warc").

Reading. `path` names files (comma-separated) or a folder whose _manifest*.json files list the files of finished
writes. A file that is longer than `partition_bytes` is cut at its members' places, which an index file beside it
(.idx) holds: a task reads its own range of the index. Other files, gzip members of one or more records each or plain
text, are one partition and are streamed. Headers are read first; if the pushed filters on record_type, record_id or
target_uri reject a record, its block is skipped: undecoded in a file with index and in a plain one, inflated and
dropped piece by piece else. With option payload=false no payload is kept.

Writing. Each record is its own gzip member. Each task writes one file per 64 MB under a name of its own attempt, and
the commit, which Spark does once with the files of the successful attempts, lists them in a manifest of its own:
what was written before stays, unless the write overwrites. A record id or URI that holds blanks, control characters
or code points above ASCII is percent-encoded, which a header of its own says, and is read as it was written.

Null urls have no WARC-Target-URI. A null id is written as no id and read as null. A null payload is an empty one.
Rows that repeat are records of their own. Payloads of any length that memory holds are written and read whole. Other
columns of the pages are not read. An empty table makes an archive without files, which reads as no rows.
"""

from __future__ import annotations

import base64
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from bomdrift.llm.store import filesystem, folder

#: Of records to write: the HTTP block's payload; a revisit has none and names the record it refers to.
WRITE_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload binary, payload_bytes long, payload_sha1 string"
#: Of records read: payload_bytes as the HTTP header states it, payload_sha1 as the WARC header states it (hex).
READ_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_sha1 string, payload binary"
FILE_BYTES = 64 << 20
PARTITION_BYTES = 16 << 20
_PUSHED = ("record_type", "record_id", "target_uri")
#: Names the headers of a record that are percent-encoded.
ESCAPED = "X-Percent-Encoded"
_ESCAPED = {"warc-record-id": "record_id", "warc-target-uri": "target_uri", "warc-refers-to": "refers_to"}
_CHUNK = 1 << 20
_DATE = "2024-01-01T00:00:00Z"


def _field(value: str) -> str:
    """A header value in printable ASCII: as it is, or percent-encoded."""
    return value if _plain(value) else quote(value, safe="")


def _plain(value: str) -> bool:
    return all("!" <= c <= "~" for c in value)


def record(row: dict) -> bytes:
    """One WARC/1.1 record of an HTTP response."""
    payload, size = row["payload"] or b"", row["payload_bytes"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Date: {_DATE}"]
    if row["record_id"] is not None:
        head.append(f"WARC-Record-ID: <{_field(row['record_id'])}>")
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_field(row['target_uri'])}")
    if row["refers_to"] is not None:
        head.append(f"WARC-Refers-To: <{_field(row['refers_to'])}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    escaped = [name for name, key in _ESCAPED.items() if row[key] is not None and not _plain(row[key])]
    if escaped:
        head.append(f"{ESCAPED}: {', '.join(escaped)}")
    digest = base64.b32encode(bytes.fromhex(row["payload_sha1"])).decode()
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    """Header lines after the first, by lower-case name."""
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


class _Stream:
    """The bytes of a file or a part of one, gzip members one after another or plain, with bounded memory."""

    def __init__(self, file):
        self.file, self.data = file, b""
        self.raw = file.read(_CHUNK)
        self.inflate = zlib.decompressobj(31) if self.raw[:2] == b"\x1f\x8b" else None
        if self.inflate is None:
            self.data, self.raw = self.raw, b""

    def _more(self, most: int = _CHUNK) -> bool:
        """Take in more bytes; False at the end."""
        if self.inflate is None:
            got = self.file.read(_CHUNK)
            self.data += got
            return bool(got)
        while True:
            if self.inflate.eof:
                self.raw = self.inflate.unused_data or self.file.read(_CHUNK)
                if not self.raw.strip(b"\0"):
                    return False
                self.inflate = zlib.decompressobj(31)
            source = self.inflate.unconsumed_tail or self.raw or self.file.read(_CHUNK)
            self.raw = b""
            if not source:
                return False
            got = self.inflate.decompress(source, most)
            if got:
                self.data += got
                return True

    def next_record(self) -> bytes | None:
        """The headers of the record that follows, past the empty lines before it; None at the end of the stream."""
        while True:
            self.data = self.data.lstrip(b"\r\n")
            if self.data:
                return self.head()
            if not self._more(1024):
                return None

    def head(self) -> bytes:
        """Up to an empty line."""
        while (at := self.data.find(b"\r\n\r\n")) < 0:
            if not self._more(1024):
                raise ValueError("a record ends within its headers")
        out, self.data = self.data[:at], self.data[at + 4 :]
        return out

    def take(self, size: int) -> bytes:
        parts = [self.data[:size]]
        have, self.data = len(parts[0]), self.data[size:]
        while have < size and self._more():
            parts.append(self.data[: size - have])
            self.data = self.data[len(parts[-1]) :]
            have += len(parts[-1])
        if have < size:
            raise ValueError("a record ends within its block")
        return b"".join(parts)

    def skip(self, size: int) -> None:
        if self.inflate is None and size > len(self.data):
            self.file.seek(self.file.tell() + size - len(self.data))
            self.data = b""
            return
        while size:
            if not self.data and not self._more():
                raise ValueError("a record ends within its block")
            gone = min(size, len(self.data))
            self.data, size = self.data[gone:], size - gone


@dataclass
class Cut(InputPartition):
    """Members first..last - 1 of a file, by its index; last None: the whole file, without index."""

    file: str
    first: int = 0
    last: int | None = None


def manifests(fs, root: str) -> list[str]:
    """The lists of files of finished writes, in order of their names."""
    from pyarrow import fs as arrow

    found = fs.get_file_info(arrow.FileSelector(root, allow_not_found=True))
    return sorted(i.path for i in found if i.base_name.startswith("_manifest") and i.base_name.endswith(".json"))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.size = options["path"], int(options.get("partition_bytes", PARTITION_BYTES))
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if name in _PUSHED and values is not None:
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self):
        cuts = []
        for path in self.paths.split(","):
            fs, root = filesystem(path)
            names = [path]
            if fs.get_file_info(root).type.name == "Directory":
                names = [f"{path.rstrip('/')}/{n}" for m in manifests(fs, root) for n in json.loads(fs.open_input_file(m).read())]
            for name in names:
                _, own = filesystem(name)
                whole, index = fs.get_file_info([own, f"{own}.idx"])
                if index.type.name != "File":
                    cuts.append(Cut(name))
                    continue
                members = index.size // 8 - 1
                step = max(1, members * self.size // max(whole.size, 1))  # members of about a partition's bytes
                cuts += [Cut(name, at, min(at + step, members)) for at in range(0, members, step)]
        return cuts or [Cut("")]

    def _records(self, cut: Cut) -> Iterator[tuple[_Stream, bool]]:
        """Streams that begin with a record, and whether they hold that one only."""
        if not cut.file:
            return
        fs, name = filesystem(cut.file)
        with fs.open_input_file(name) as f:
            if cut.last is None:
                yield _Stream(f), False
                return
            with fs.open_input_file(f"{name}.idx") as index:
                index.seek(8 * cut.first)
                places = struct.unpack(f"<{cut.last - cut.first + 1}Q", index.read(8 * (cut.last - cut.first + 1)))
            f.seek(places[0])
            raw = f.read(places[-1] - places[0])
            for at, end in zip(places, places[1:]):
                yield _Stream(io.BytesIO(raw[at - places[0] : end - places[0]])), True

    def read(self, partition):
        rows: list[tuple] = []
        for stream, alone in self._records(partition):
            while (head := stream.next_record()) is not None:
                own = headers(head)
                coded = own.get(ESCAPED.lower(), "")
                bare = {k: own[k] if k == "warc-target-uri" else own[k].strip("<>") for k in _ESCAPED if k in own}
                value = {k: unquote(v) if k in coded else v for k, v in bare.items()}
                found = {"record_type": own.get("warc-type"), "record_id": value.get("warc-record-id"), "target_uri": value.get("warc-target-uri")}
                left = int(own.get("content-length", 0))
                if any(found[k] not in v for k, v in self.wanted.items()):
                    if alone:
                        break
                    stream.skip(left)
                    continue
                size, payload = None, None
                if own.get("content-type", "").startswith("application/http"):
                    http = stream.head()
                    left -= len(http) + 4
                    size = headers(http).get("content-length")
                if self.payload:
                    payload = stream.take(left)
                elif not alone:
                    stream.skip(left)
                kind, _, text = own.get("warc-payload-digest", "").partition(":")
                digest = base64.b32decode(text).hex() if kind == "sha1" and len(text) == 32 else text.lower() or None
                rows.append((found["record_id"], found["record_type"], found["target_uri"], value.get("warc-refers-to"), int(size) if size else None, digest, payload))
                if len(rows) >= 1000:
                    yield _batch(rows)
                    rows = []
                if alone:
                    break
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
    names = ["record_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_sha1", "payload"]
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)


@dataclass
class Files(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.level, self.overwrite = options["path"], int(options.get("level", 3)), overwrite

    def write(self, iterator):
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        names, out, sizes, total = [], None, [], 0

        def close() -> None:
            out.close()
            with fs.open_output_stream(f"{root}/{names[-1]}.idx") as f:
                f.write(struct.pack(f"<{len(sizes) + 1}Q", 0, *accumulate(sizes)))

        for batch in iterator:
            columns = batch.schema.names
            for at in range(batch.num_rows):
                if out is None or total >= FILE_BYTES:
                    if out is not None:
                        close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, sizes, total = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), [], 0
                z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                row = {c: batch.column(i)[at].as_py() for i, c in enumerate(columns)}
                member = z.compress(record(row)) + z.flush()
                out.write(member)
                sizes.append(len(member))
                total += len(member)
        if out is not None:
            close()
        return Files(names)

    def commit(self, messages):
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        before = manifests(fs, root) if self.overwrite else []
        with fs.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())
        for old in before:
            fs.delete_file(old)

    def abort(self, messages):
        """Files of a failed write are in no manifest."""


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let filters be pushed to it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """WRITE_SCHEMA for rows (page_id, url, html): of equal payloads of at least `least` bytes the largest page_id responds.

    Rows that repeat that page_id respond as well; rows without id revisit, or respond where no equal row has an id.
    """
    body = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", body.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_sha1": F.sha1("payload")})
    light = pages.select("page_id", body.alias("payload"))
    heads = (
        light.where(F.octet_length("payload") >= least).groupBy(F.sha1("payload").alias("payload_sha1"))
        .agg(F.max("page_id").alias("head"), F.count("*").alias("times")).where("times > 1 AND head IS NOT NULL").drop("times")
    )
    urn = lambda c: F.concat(F.lit("urn:x-page:"), F.col(c).cast("string"))
    again = F.col("head").isNotNull() & ~F.col("head").eqNullSafe(F.col("page_id"))
    return rows.join(heads, "payload_sha1", "left").select(
        urn("page_id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        F.when(again, urn("head")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "payload_sha1",
    )


def archived(pages: DataFrame) -> DataFrame:
    """Write an archive of the pages and read it back: READ_SCHEMA."""
    spark = pages.sparkSession
    register(spark)
    to = folder(spark, "warc")
    page_records(pages).write.format("warc").mode("append").save(to)
    return spark.read.format("warc").load(to)
