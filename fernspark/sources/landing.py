"""Feeds where they land: payload files in numbered lots, as a data source `landed_feed` to write, to read and to stream.

Under a folder, `lots/<n>/` holds the payload files of a lot and `_landed/<n>.json` its marker. Small payloads share a file
of some FILE_BYTES, a larger one has its own. Each task that writes has an index beside its files, with a line for each: the
sources, lengths and completeness of its payloads. The marker tells when the lot ran and where the lines are, so what the
driver holds of a lot grows with its bytes over FILE_BYTES, not with its payloads or sources. A lot is there once its marker
is; files of failed or repeated attempts are in no marker. Lots are numbered from 0 without a gap, so a stream's offset is a
number of lots. One writer lands at a time.

Rows: lot, source, run_at, complete (the source's whole feed is in this lot), file, body, error. A payload that cannot be
read, is not UTF-8 or is longer than MAX_PAYLOAD is a row with an error, whose body is kept with escapes where that is
possible. A payload that is alone in its file is the whole file. A complete source without any payload is a row without a
file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone
from itertools import groupby, repeat

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "landed_feed"
SCHEMA = "lot int, source string, run_at timestamp, complete boolean, file string, body string, error string"
_ARROW = pa.schema([("lot", pa.int32()), ("source", pa.string()), ("run_at", pa.timestamp("us", "UTC")), ("complete", pa.bool_()), ("file", pa.string()), ("body", pa.string()), ("error", pa.string())])
#: Bytes of payloads that one task reads, unless a single payload is larger: to parse them takes far longer than to read them.
PARTITION_BYTES = 8 << 20
#: Bytes of a payload that becomes a row.
MAX_PAYLOAD = 512 << 20
BATCH_BYTES = 16 << 20
#: Bytes and payloads from which on a file takes no more, and what a payload's row counts besides its body.
FILE_BYTES, FILE_PAYLOADS, ROW_BYTES = 1 << 20, 4096, 200


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def lots_landed(path: str) -> int:
    """How many lots are there: the first number without a marker."""
    fs, at = _filesystem(path)
    found = {x.base_name for x in fs.get_file_info(pafs.FileSelector(f"{at}/_landed", allow_not_found=True)) if x.is_file}
    n = 0
    while f"{n:08d}.json" in found:
        n += 1
    return n


class Payloads(InputPartition):
    """Files of one lot, by their lines (index, offset, length) in the indexes of the tasks that wrote them."""

    def __init__(self, lot: int, run_at: str, lines: list[tuple[str, int, int]]):
        super().__init__((lot, run_at, lines))


def _partitions(path: str, start: int, end: int, size: int) -> list[Payloads]:
    fs, at = _filesystem(path)
    out = []
    for lot in range(start, end):
        with fs.open_input_stream(f"{at}/_landed/{lot:08d}.json") as f:
            marker = json.loads(f.read())
        groups: list[list] = []
        room = 0
        for index, offset, length, weight in marker["lines"]:
            if weight > room or not groups:
                groups.append([])
                room = size
            groups[-1].append((index, offset, length))
            room -= weight
        out += [Payloads(lot, marker["run_at"], lines) for lines in groups]
    return out


def _bodies(fs: pafs.FileSystem, at: str, lengths: list[int]) -> Iterator[tuple[str | None, str | None]]:
    """The body of each payload of a file and what is wrong with it."""
    fault, raw = None, b""
    try:
        size = fs.get_file_info(at).size
        if size is None:
            fault = "payload missing"
        elif len(lengths) == 1 and size > MAX_PAYLOAD:
            fault = "payload too long"
        else:
            with fs.open_input_stream(at, compression=None) as f:
                raw = f.read()
    except OSError as error:
        fault = f"payload unreadable: {type(error).__name__}"
    end = 0
    for length in lengths:
        start, end = end, len(raw) if len(lengths) == 1 else end + length
        if fault or end > len(raw):
            yield None, fault or "payload cut short"
            continue
        try:
            yield raw[start:end].decode(), None
        except UnicodeDecodeError:
            yield raw[start:end].decode(errors="backslashreplace"), "payload not UTF-8"


def _read(path: str, partition: Payloads) -> Iterator[pa.RecordBatch]:
    fs, at = _filesystem(path)
    lot, run_at, lines = partition.value
    when = datetime.fromisoformat(run_at)
    held, size = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), _ARROW.types)], schema=_ARROW)
    for index, group in groupby(lines, key=lambda x: x[0]):
        with fs.open_input_file(f"{at}/{index}") as told:
            for _, offset, length in group:
                told.seek(offset)
                file, payloads = json.loads(told.read(length))
                bodies = repeat((None, None)) if file is None else _bodies(fs, f"{at}/{file}", [n for _, _, n in payloads])
                for (source, complete, _), (body, error) in zip(payloads, bodies):
                    held.append((lot, source, when, complete, file, body, error))
                    size += len(body or "") + ROW_BYTES
                    if size > BATCH_BYTES:
                        yield batch()
                        held, size = [], 0
    if held:
        yield batch()


class LotReader(DataSourceReader):
    """All lots, or those from option `from` on and before option `to`."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("partitionBytes", PARTITION_BYTES))
        self.start, self.end = int(options.get("from", 0)), options.get("to")

    def partitions(self) -> Sequence[InputPartition]:
        there = lots_landed(self.path)
        return _partitions(self.path, self.start, there if self.end is None else min(there, int(self.end)), self.size) or [Payloads(0, "1970-01-01T00:00:00+00:00", [])]

    def read(self, partition: Payloads) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


class LotStream(DataSourceStreamReader):
    """Lots as they land; an offset is how many lots have been read."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("partitionBytes", PARTITION_BYTES))
        self.start = int(options.get("from", 0))

    def initialOffset(self) -> dict:
        return {"lots": self.start}

    def latestOffset(self) -> dict:
        return {"lots": max(lots_landed(self.path), self.start)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return _partitions(self.path, start["lots"], end["lots"], self.size)

    def read(self, partition: Payloads) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)

    def commit(self, end: dict) -> None:
        """Landed lots are kept: other readers may stream them too."""


class Landed(WriterCommitMessage):
    def __init__(self, lines: list[tuple[str, int, int, int]]):
        self.lines = lines


def _files(rows: Iterator) -> Iterator[list]:
    """Rows as they share a file: payloads in files of a bounded size, rows without a body apart from them."""
    held: dict[bool, list] = {True: [], False: []}
    size = 0
    for row in rows:
        there = row["body"] is not None
        entry = (row["source"], bool(row["complete"]), row["body"].encode() if there else None)
        if there and len(entry[2]) >= FILE_BYTES:
            yield [entry]
            continue
        held[there].append(entry)
        size += len(entry[2] or b"")
        if len(held[there]) >= FILE_PAYLOADS or there and size >= FILE_BYTES:
            yield held[there]
            held[there], size = [], 0 if there else size
    yield from (x for x in held.values() if x)


class LotWriter(DataSourceWriter):
    """Rows of source, body (null: none) and complete as one lot. Option: runAt (ISO)."""

    def __init__(self, options: dict, names: list[str]):
        if set(names) != {"source", "body", "complete"}:
            raise ValueError(f"a lot has the columns source, body and complete, not {names}")
        when = datetime.fromisoformat(options["runAt"])
        self.path = options["path"]
        self.run_at = (when if when.tzinfo else when.replace(tzinfo=timezone.utc)).isoformat()
        self.lot = lots_landed(self.path)

    def write(self, rows: Iterator) -> Landed:
        fs, at = _filesystem(self.path)
        attempt, lines, offset = f"lots/{self.lot:08d}/{uuid.uuid4().hex}", [], 0
        fs.create_dir(f"{at}/lots/{self.lot:08d}", recursive=True)
        with fs.open_output_stream(f"{at}/{attempt}.index", compression=None) as told:
            for k, held in enumerate(_files(rows)):
                file = None if held[0][2] is None else f"{attempt}-{k}"
                if file:
                    with fs.open_output_stream(f"{at}/{file}", compression=None) as f:
                        f.write(b"".join(raw for _, _, raw in held))
                line = json.dumps([file, [(source, complete, len(raw or b"")) for source, complete, raw in held]]).encode()
                told.write(line + b"\n")
                lines.append((f"{attempt}.index", offset, len(line), sum(len(raw or b"") + ROW_BYTES for _, _, raw in held)))
                offset += len(line) + 1
        return Landed(lines)

    def commit(self, messages: list[Landed | None]) -> None:
        fs, at = _filesystem(self.path)
        lines = sorted(x for m in messages if m for x in m.lines)
        fs.create_dir(f"{at}/_landed", recursive=True)
        marker, draft = f"{at}/_landed/{self.lot:08d}.json", f"{at}/_landed/.{uuid.uuid4().hex}"
        with fs.open_output_stream(draft, compression=None) as f:
            f.write(json.dumps({"run_at": self.run_at, "lines": lines}).encode())
        fs.move(draft, marker)  # so that no reader sees half a marker

    def abort(self, messages: list[Landed | None]) -> None:
        """Files without a marker are not read."""


class LandedFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LotReader:
        return LotReader(self.options)

    def streamReader(self, schema) -> LotStream:
        return LotStream(self.options)

    def writer(self, schema, overwrite: bool) -> LotWriter:
        if overwrite:
            raise ValueError("lots are appended")
        return LotWriter(self.options, schema.names)


def land(payloads: DataFrame, path: str, run_at: str, complete: list[str] | DataFrame) -> None:
    """Lands payloads (source, body) as the next lot. complete: sources whose whole feed this is, those without a payload too; where they are many, a table (source)."""
    spark = payloads.sparkSession
    spark.dataSource.register(LandedFeed)
    if isinstance(complete, DataFrame):
        whole = complete.select(F.col("source").alias("_whole")).filter("_whole IS NOT NULL").distinct()
    else:
        whole = F.broadcast(spark.createDataFrame([(s,) for s in sorted(set(complete))], "_whole string"))
    sent = payloads.select("source", F.coalesce("body", F.lit("")).alias("body")).join(whole, F.col("source") == F.col("_whole"), "left")
    silent = whole.join(payloads.select(F.col("source").alias("_sent")), F.col("_whole") == F.col("_sent"), "left_anti")
    rows = sent.select("source", "body", F.col("_whole").isNotNull().alias("complete")).unionByName(silent.select(F.col("_whole").alias("source"), F.lit(None).cast("string").alias("body"), F.lit(True).alias("complete")))
    rows.write.format(FORMAT).mode("append").option("path", path).option("runAt", run_at).save()


def landed(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Lots from `start` on, before `end`."""
    spark.dataSource.register(LandedFeed)
    reader = spark.read.format(FORMAT).option("from", start)
    return (reader if end is None else reader.option("to", end)).load(path)


def landed_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of all lots."""
    spark.dataSource.register(LandedFeed)
    return spark.readStream.format(FORMAT).load(path)
