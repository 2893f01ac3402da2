"""Web archives (WARC 1.1) as a Spark data source, `spark.read.format("warc")` and `df.write.format("warc")`.

Reading. Partitions are files, small ones together, up to `partitionBytes` each. Of every record the header is parsed first;
predicates on the record's type and on its header fields are pushed down to there, and a record that they reject, or whose
payload the asked schema leaves out, is passed over: its bytes are skipped without being decoded. In a plain file the length
in the header tells where the next record is; in a compressed one, whose records are gzip members, the member's own extra
field `sl` (skip lengths) does, and only the first bytes of the member are inflated. Members without that field, from other
writers, are inflated to their end and thrown away.

Writing. Each task writes files of about `fileBytes`, under names that no other attempt uses; the driver commits them by
writing the list of files, `_files`, which readers go by. Files of failed or repeated attempts are not in the list.

Pages become `response` records with their HTTP header; of equal payloads of at least 100 bytes all but the first page's
become `revisit` records, which have that header only, and refer to the first page's record.

The source opens files by pyarrow's filesystems (local, HDFS, S3, GCS, ABFS), from the path's scheme.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from ._spark import discard, shared_dir, staged

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What the source can return; a schema given by the user picks from it.
COLUMNS = {
    "record_id": "string", "record_type": "string", "date": "string", "target_uri": "string", "content_type": "string", "content_length": "bigint", "payload_digest": "string", "refers_to": "string",
    "headers": "map<string,string>", "http_headers": "map<string,string>", "payload_length": "bigint", "payload": "binary", "file": "string", "offset": "bigint",
}
#: Header field of each column that predicates can be pushed down on.
FIELDS = {"record_id": "warc-record-id", "record_type": "warc-type", "date": "warc-date", "target_uri": "warc-target-uri", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
FILE_BYTES, PARTITION_BYTES = 128 << 20, 32 << 20
#: Bytes read from a file at once, bytes taken on at once while a header is sought, and bytes of payload and rows in a batch.
READ_BYTES, STEP, BATCH_BYTES, BATCH_ROWS = 1 << 18, 1 << 12, 8 << 20, 2000
#: A header larger than this is no header.
MOST_HEADER = 1 << 20
#: Least payload that may be a revisit, and the digests of repeated payloads that are broadcast (some 80 bytes each).
LEAST_REVISIT, FEW = 100, 100_000
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")


# Records


def header_lines(fields: Sequence[tuple[str, str]]) -> bytes:
    """Named fields as lines; white space at the ends is dropped, control characters inside a value are percent-encoded."""
    line = lambda v: re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", v.strip())
    return b"".join(f"{k}: {line(v)}\r\n".encode() for k, v in fields)


def record(fields: Sequence[tuple[str, str]], block: bytes) -> bytes:
    return VERSION + b"\r\n" + header_lines([*fields, ("Content-Length", str(len(block)))]) + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """One gzip member that tells its own length (subfield `sl`: compressed and plain length) where 32 bits can."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    tail = zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")
    total = 10 + 14 + len(body) + 8
    if total >> 32 or len(data) >> 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\0\xff" + body + tail
    extra = b"sl" + (8).to_bytes(2, "little") + total.to_bytes(4, "little") + len(data).to_bytes(4, "little")
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + len(extra).to_bytes(2, "little") + extra + body + tail


def member_length(head: bytes) -> int | None:
    """The length of the gzip member that begins so, if it says so."""
    if len(head) < 12 or not head[3] & 4:
        return None
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= min(end, len(head)):
        size = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"sl" and size == 8:
            return int.from_bytes(head[at + 4 : at + 8], "little")
        at += 4 + size
    return None


def parse_fields(raw: bytes) -> dict[str, str]:
    """Named fields, names in lower case; lines that begin with white space continue the line before."""
    out: dict[str, str] = {}
    name = None
    for line in raw.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and name:
            out[name] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            key, _, value = line.partition(b":")
            name = key.strip().decode("utf-8", "replace").lower()
            out[name] = value.strip().decode("utf-8", "replace")
    return out


class _Window:
    """A file read in stretches, of which the last is kept: small records cost no read of their own, skipped ones none at all.

    What is read is cut short by the file's end only, never by a stretch's: a member's first bytes tell what it is.
    """

    def __init__(self, file: pa.NativeFile):
        self.file, self.begin, self.held, self.size = file, 0, b"", file.size()

    def read(self, at: int, size: int) -> bytes:
        if at < self.begin or min(at + size, self.size) > self.begin + len(self.held):
            self.file.seek(at)
            self.begin, self.held = at, self.file.read(max(size, READ_BYTES))
        return self.held[at - self.begin : at - self.begin + size]


class _Member:
    """A record's bytes from its start, plain or inflated as far as asked."""

    def __init__(self, window: _Window, start: int):
        self.window, self.start, self.at, self.data = window, start, start, bytearray()
        head = window.read(start, STEP)
        self.inflate = zlib.decompressobj(31) if head[:2] == b"\x1f\x8b" else None
        self.length = member_length(head) if self.inflate else None
        self.over = False
        self._go_on(STEP)

    def _go_on(self, size: int) -> None:
        found = self.window.read(self.at, size)
        self.at += len(found)
        if self.inflate is None:
            self.data += found
            self.over = not found
            return
        self.data += self.inflate.decompress(found)
        self.over = self.inflate.eof or not found
        if self.inflate.eof:
            self.at -= len(self.inflate.unused_data)

    def want(self, size: int) -> None:
        """Goes on until there are `size` bytes, or no more."""
        while len(self.data) < size and not self.over:
            self._go_on(STEP if size - len(self.data) < STEP else READ_BYTES if self.inflate else size - len(self.data))

    def upto(self, mark: bytes, begin: int, most: int) -> int:
        """Where mark begins, from `begin` on; -1 if it is not within `most` bytes."""
        seen = begin
        while (at := self.data.find(mark, seen)) < 0 and len(self.data) - begin < most and not self.over:
            seen = max(begin, len(self.data) - len(mark) + 1)
            self.want(len(self.data) + 1)
        return at

    def next_start(self, size: int) -> int:
        """Where the next record begins; size: this record's plain bytes."""
        if self.inflate is None:
            return self.start + size
        if self.length:
            return self.start + self.length
        while not self.over:
            self.data.clear()
            self._go_on(READ_BYTES)
        if not self.inflate.eof:
            raise ValueError(f"a record at byte {self.start} is cut off")
        return self.at


@dataclass
class Wanted:
    """What a scan returns: columns, and predicates on header fields."""

    columns: list[str]
    tests: list[tuple[str, Callable[[str | None], bool]]]

    def accepts(self, fields: dict[str, str]) -> bool:
        return all(test(_value(fields, field)) for field, test in self.tests)


def _value(fields: dict[str, str], field: str) -> str | None:
    value = fields.get(field)
    return value[1:-1] if value and field in ("warc-record-id", "warc-refers-to") and value[0] == "<" and value[-1] == ">" else value


def scan(file: pa.NativeFile, name: str, wanted: Wanted, decoded: list[int] | None = None) -> Iterator[dict]:
    """The wanted records of one file, in order. decoded: gets the plain bytes of each record that were looked at."""
    start, size, window = 0, file.size(), _Window(file)
    http = {"http_headers", "payload_length", "payload"} & set(wanted.columns)
    while start < size:
        member = _Member(window, start)
        end = member.upto(b"\r\n\r\n", 0, MOST_HEADER)
        if end < 0 or not member.data.startswith(b"WARC/"):
            raise ValueError(f"{name}: no record at byte {start}")
        fields = parse_fields(bytes(member.data[member.data.index(b"\r\n") + 2 : end]))
        length, begin = int(fields["content-length"]), end + 4
        row = None
        if wanted.accepts(fields):
            row = {c: _value(fields, f) for c, f in FIELDS.items()} | {"content_length": length, "headers": [*fields.items()], "file": name, "offset": start}
            if http and fields.get("content-type", "").startswith("application/http"):
                mark = member.upto(b"\r\n\r\n", begin, length)
                head = mark + 4 - begin if 0 <= mark <= begin + length - 4 else length
                said = parse_fields(bytes(member.data[begin : begin + head]))
                revisit = fields.get("warc-type") == "revisit"
                told = said.get("content-length", "")
                row |= {"http_headers": [*said.items()], "payload_length": (int(told) if told.isdigit() else None) if revisit else length - head}
            else:
                head, revisit = 0, fields.get("warc-type") == "revisit"
                row |= {"http_headers": None, "payload_length": None if revisit else length}
            if "payload" in wanted.columns and not revisit:
                member.want(begin + length)
                if len(member.data) < begin + length:
                    raise ValueError(f"{name}: the record at byte {start} is cut off")
                row["payload"] = bytes(member.data[begin + head : begin + length])
            else:
                row["payload"] = None
        if decoded is not None:
            decoded.append(len(member.data))
        if start + (0 if member.inflate else begin + length) > size:
            raise ValueError(f"{name}: the record at byte {start} is cut off")
        start = member.next_start(begin + length + 4)
        if row:
            yield row


# The data source


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


LISTED = "_files"


def archive_files(path: str) -> list[tuple[str, int]]:
    """Archives below a path (or the one that it names) and their sizes: those that a writer has committed, if one has."""
    fs, at = filesystem(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [(at, info.size)]
    found = {x.path: x.size for x in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if x.is_file and re.search(r"\.warc(\.gz)?$", x.path)}
    if fs.get_file_info(f"{at}/{LISTED}").is_file:
        with fs.open_input_stream(f"{at}/{LISTED}") as f:
            committed = json.loads(f.read())
        return [(f"{at}/{x}", found[f"{at}/{x}"]) for x in committed]
    return sorted(found.items())


class Files(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        unknown = [f.name for f in schema if COLUMNS.get(f.name) != f.dataType.simpleString()]
        if unknown:
            raise ValueError(f"no such columns in an archive: {unknown}; there are {COLUMNS}")
        self.path, self.columns = options["path"], [f.name for f in schema]
        self.size = int(options.get("partitionBytes", PARTITION_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else ()
            if len(column) == 1 and column[0] in FIELDS and isinstance(f, (EqualTo, EqualNullSafe, In, StringStartsWith, IsNotNull, IsNull)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        groups: list[list[str]] = []
        room = 0
        for file, size in archive_files(self.path):
            if size > room or not groups:
                groups.append([])
                room = self.size
            groups[-1].append(file)
            room -= size
        return [Files(g) for g in groups] or [Files([])]

    def wanted(self) -> Wanted:
        def test(f: Filter) -> Callable[[str | None], bool]:
            if isinstance(f, IsNotNull):
                return lambda x: x is not None
            if isinstance(f, IsNull):
                return lambda x: x is None
            if isinstance(f, EqualNullSafe):
                return lambda x: x == f.value
            if isinstance(f, In):
                return lambda x: x is not None and x in f.value
            if isinstance(f, StringStartsWith):
                return lambda x: x is not None and x.startswith(f.value)
            return lambda x: x is not None and x == f.value

        return Wanted(self.columns, [(FIELDS[f.attribute[0]], test(f)) for f in self.filters])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, wanted = filesystem(self.path)[0], self.wanted()
        kinds = [_ARROW[COLUMNS[c]] for c in self.columns]
        held: list[dict] = []
        size = 0

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[c] for r in held], k) for c, k in zip(self.columns, kinds)], names=self.columns)
            held.clear()
            return out

        for name in partition.value:
            with fs.open_input_file(name) as file:
                for row in scan(file, name, wanted):
                    held.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size > BATCH_BYTES or len(held) >= BATCH_ROWS:
                        yield batch()
                        size = 0
        if held:
            yield batch()


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Rows of record_id, record_type, date, target_uri, payload_digest, refers_to, extra (a map of further header fields), payload (null for an empty one), payload_length."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.size, self.level, self.packed = int(options.get("fileBytes", FILE_BYTES)), int(options.get("level", 6)), options.get("compression", "gzip") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, at = filesystem(self.path)
        fs.create_dir(at, recursive=True)
        part, files, out = TaskContext.get().partitionId(), [], None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or out.tell() >= self.size:
                    if out:
                        out.close()
                    files.append(f"part-{part:06d}-{len(files):04d}-{uuid.uuid4().hex}.warc" + ".gz" * self.packed)
                    out = fs.open_output_stream(f"{at}/{files[-1]}", compression=None)
                data = page_record(row)
                out.write(gzip_member(data, self.level) if self.packed else data)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = filesystem(self.path)
        fs.create_dir(at, recursive=True)
        names = [x for m in messages if m for x in m.files]
        old = [] if self.overwrite else [f[0].removeprefix(f"{at}/") for f in archive_files(self.path)] if fs.get_file_info(f"{at}/{LISTED}").is_file else []
        with fs.open_output_stream(f"{at}/{LISTED}", compression=None) as f:
            f.write(json.dumps([*old, *names]).encode())
        if self.overwrite:
            for x in fs.get_file_info(pafs.FileSelector(at)):
                if x.is_file and re.search(r"\.warc(\.gz)?$", x.path) and x.base_name not in names:
                    fs.delete_file(x.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = filesystem(self.path)
        for x in (x for m in messages if m for x in m.files):
            if fs.get_file_info(f"{at}/{x}").is_file:
                fs.delete_file(f"{at}/{x}")


def page_record(row: dict) -> bytes:
    """A response with its payload, or a revisit, whose block is the HTTP header alone."""
    payload, revisit = row.get("payload") or b"", row["record_type"] == "revisit"
    size = row.get("payload_length")
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", row["date"])]
    if row.get("target_uri") is not None:
        fields.append(("WARC-Target-URI", _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], row["target_uri"].encode()).decode()))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{row['refers_to']}>")]
    if row.get("payload_digest"):
        fields.append(("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"))
    fields += [*(row.get("extra") or []), ("Content-Type", "application/http;msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\n" + header_lines([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload) if size is None else size))]) + b"\r\n"
    return record(fields, head if revisit else head + payload)


class WarcSource(DataSource):
    """Options: path; reading: partitionBytes; writing: fileBytes, compression (gzip or none), level."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in COLUMNS.items())

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets it take predicates."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_archives(spark: SparkSession, path: str, columns: Sequence[str] = tuple(COLUMNS)) -> DataFrame:
    """Records with the given columns; without `payload` among them no payload is decoded."""
    register(spark)
    return spark.read.format("warc").schema(", ".join(f"{c} {COLUMNS[c]}" for c in columns)).load(path)


# Pages


def page_records(pages: DataFrame, date: str) -> DataFrame:
    """The records of pages (page_id, url, html), as WarcWriter takes them.

    Of equal payloads of at least 100 bytes the rows with the smallest page_id are responses (rows that repeat it too), the
    others revisit it. A null page_id counts as larger than any; where all are null, all are responses. A null html is an
    empty payload, a null url gives no target.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = rows.filter(F.length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    repeated = staged(large.filter("copies > 1 AND first IS NOT NULL").select("digest", "first"), "repeated-payloads")
    few = repeated.count() <= FEW
    both = rows.join(F.broadcast(repeated) if few else repeated, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(":"), F.left("digest", F.lit(16)))
    own = F.when(F.col("page_id").isNotNull(), F.create_map(F.lit("X-Page-Id"), F.col("page_id").cast("string")))
    return both.select(
        name("page_id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.lit(date).alias("date"), F.col("url").alias("target_uri"),
        F.col("digest").alias("payload_digest"), F.when(revisit, name("first")).alias("refers_to"), own.alias("extra"), F.when(~revisit, F.col("payload")).alias("payload"), F.length("payload").cast("long").alias("payload_length"),
    )


def write_pages(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", **options: str) -> None:
    register(pages.sparkSession)
    page_records(pages, date).write.format("warc").mode("append").options(**options).save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of page records read back.

    Responses are measured and hashed anew from the payload that was read; of revisits only headers are decoded, which tell
    both. refers_to is the page_id of the record referred to.
    """
    page = F.col("headers")["x-page-id"].cast("long").alias("page_id")
    responses = read_archives(spark, path, ["record_type", "headers", "payload"]).filter("record_type = 'response'")
    responses = responses.select(page, F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = read_archives(spark, path, ["record_type", "headers", "payload_length", "payload_digest", "refers_to"]).filter("record_type = 'revisit'")
    told = F.regexp_extract("refers_to", r"^urn:page:(-?\d+):", 1).cast("long").alias("refers_to")
    revisits = revisits.select(page, F.col("payload_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", told)
    return responses.unionByName(revisits)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """read_pages of pages written to archives in the shared folder, which are deleted then. An empty table gives no rows; columns other than page_id, url and html are not looked at."""
    spark = pages.sparkSession
    at = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_pages(pages, at)
    out = staged(read_pages(spark, at), "pages-read")
    archives = spark.range(0)
    archives._staged_at = at
    discard(archives)
    return out
