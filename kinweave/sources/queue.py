"""A message queue on the shared file system: ordered segments, read in batches bounded by count and bytes.

A segment is what one write added: a manifest `<number>.json`, which names the segment's parts in order with the rows and bytes
of each, and the parts, JSON lines with `arrival_seq` and `raw`.  Parts are written by tasks; nothing is visible before the
manifest, which is one small file.  Messages are taken by segment number, part and line, so a queue has one producer at a
time, which numbers its segments upwards.

Both directions are a Spark data source, `spark.dataSource.register(MessageQueue)`:

* `readStream.format("message_queue").option("max_messages", 500).option("max_bytes", 50_000_000).load(folder)` admits whole
  messages, at most so many and at most so many bytes of lines, but always at least one.  Bounds are found from the rows and bytes in the
  manifests; only the part in which a batch ends is read for it, line by line.  An offset is a place in the queue, so a
  restarted query goes on behind the last batch it planned.
* `write.format("message_queue").mode("append")` and `writeStream.format("message_queue")` add one segment for each write or batch.
  A batch of a stream, or a write with the option `segment`, that is run again finds its segment and adds nothing; a failed
  one leaves nothing visible.

A line that is no JSON object with the two fields comes as a row of nulls, as Spark's own JSON reader gives it.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceStreamReader,
    DataSourceStreamWriter,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

NAME = "message_queue"
LAYOUT = "arrival_seq long, raw string"
PARTS = "parts"
#: Bytes of a part that one task reads.
SPLIT = 8_000_000
START = {"segment": -1, "part": 0, "byte": 0}
_MANIFEST = re.compile(r"^(\d{12})\.json$")


class _Folder:
    """The files of a queue."""

    def __init__(self, path: str):
        self.files, self.root = fs.FileSystem.from_uri(path)

    def numbers(self, above: int = -1) -> list[int]:
        """Numbers of the visible segments above a number, in order."""
        listed = self.files.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        found = (_MANIFEST.match(info.base_name) for info in listed)
        return sorted(int(m[1]) for m in found if m and int(m[1]) > above)

    def manifest(self, number: int) -> list[dict]:
        with self.files.open_input_stream(self._manifest(number)) as stream:
            return json.loads(stream.read())

    def has(self, number: int) -> bool:
        return self.files.get_file_info(self._manifest(number)).type == fs.FileType.File

    def seal(self, number: int, parts: list[dict]) -> None:
        """Make a segment visible: its manifest is moved to its name when it is complete."""
        draft = f"{self.root}/{PARTS}/{uuid.uuid4().hex}.draft"
        self.files.create_dir(f"{self.root}/{PARTS}", recursive=True)
        with self.files.open_output_stream(draft) as stream:
            stream.write(json.dumps(parts).encode())
        self.files.move(draft, self._manifest(number))

    def add_part(self, lines: Iterator[bytes]) -> dict | None:
        """Write lines as a new part; none, no part."""
        name, rows, size, stream = f"{uuid.uuid4().hex}.jsonl", 0, 0, None
        try:
            for line in lines:
                if stream is None:
                    self.files.create_dir(f"{self.root}/{PARTS}", recursive=True)
                    stream = self.files.open_output_stream(f"{self.root}/{PARTS}/{name}")
                stream.write(line)
                rows, size = rows + 1, size + len(line)
        finally:
            if stream is not None:
                stream.close()
        return {"name": name, "rows": rows, "bytes": size} if rows else None

    def drop_parts(self, parts: list[dict]) -> None:
        for part in parts:
            self.files.delete_file(f"{self.root}/{PARTS}/{part['name']}")

    def lines(self, part: str, start: int) -> Iterator[bytes]:
        """Lines of a part from a byte on, with their ends."""
        with self.files.open_input_file(f"{self.root}/{PARTS}/{part}") as stream:
            stream.seek(start)
            rest = b""
            while block := stream.read(1 << 20):
                *whole, rest = (rest + block).split(b"\n")
                yield from (line + b"\n" for line in whole)

    def _manifest(self, number: int) -> str:
        return f"{self.root}/{number:012d}.json"


@dataclass
class Span(InputPartition):
    """Lines of a part that begin in a range of bytes."""

    part: str
    start: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    part: dict | None


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str, max_messages: int, max_bytes: int):
        self.folder, self.max_messages, self.max_bytes = folder, max_messages, max_bytes
        self.last: dict | None = None

    def initialOffset(self) -> dict:
        return dict(START)

    def latestOffset(self) -> dict:
        """The end of the next batch, behind the last one planned."""
        self.last = self._admit(self.last or self.initialOffset())
        return self.last

    def _admit(self, start: dict) -> dict:
        queue, end = _Folder(self.folder), dict(start)
        rows, size = self.max_messages, self.max_bytes
        for number in queue.numbers(start["segment"] - 1):
            if number != end["segment"]:
                end = {"segment": number, "part": 0, "byte": 0}
            parts = queue.manifest(number)
            while end["part"] < len(parts):
                part = parts[end["part"]]
                whole = end["byte"] == 0 and part["rows"] <= rows and part["bytes"] <= size
                if whole:
                    rows, size = rows - part["rows"], size - part["bytes"]
                else:
                    for line in queue.lines(part["name"], end["byte"]):
                        alone = rows == self.max_messages
                        if rows == 0 or (len(line) > size and not alone):
                            return end
                        rows, size, end["byte"] = rows - 1, size - len(line), end["byte"] + len(line)
                end["part"], end["byte"] = end["part"] + 1, 0
        return end

    def partitions(self, start: dict, end: dict) -> list[Span]:
        # A restarted query plans an empty range at its last offset before it asks for the latest one.
        self.last = end
        queue, spans = _Folder(self.folder), []
        for number in queue.numbers(start["segment"] - 1):
            if number > end["segment"]:
                break
            for at, part in enumerate(queue.manifest(number)):
                first = start["byte"] if (number, at) == (start["segment"], start["part"]) else 0
                stop = end["byte"] if (number, at) == (end["segment"], end["part"]) else part["bytes"]
                if (number, at) < (start["segment"], start["part"]) or (number, at) > (end["segment"], end["part"]):
                    continue
                spans += [Span(part["name"], a, min(a + SPLIT, stop)) for a in range(first, stop, SPLIT)]
        return spans

    def read(self, partition: Span) -> Iterator[tuple]:
        # From the byte before, so that a line that begins exactly at the start is told from one that began earlier.
        at = max(partition.start - 1, 0)
        for line in _Folder(self.folder).lines(partition.part, at):
            if at >= partition.stop:
                break
            if at >= partition.start:
                yield _message(line)
            at += len(line)


def _message(line: bytes) -> tuple:
    try:
        found = json.loads(line)
        raw = found["raw"]
        return int(found["arrival_seq"]), raw if raw is None else str(raw)
    except (ValueError, KeyError, TypeError):
        return None, None


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, number: int | None):
        self.folder, self.number = folder, number

    def write(self, iterator: Iterator) -> Written:
        lines = (json.dumps({"arrival_seq": r["arrival_seq"], "raw": r["raw"]}).encode() + b"\n" for r in iterator)
        return Written(_Folder(self.folder).add_part(lines))

    def commit(self, messages: list) -> None:
        queue = _Folder(self.folder)
        number = self.number if self.number is not None else max(queue.numbers(), default=-1) + 1
        _seal(queue, number, messages)

    def abort(self, messages: list) -> None:
        _Folder(self.folder).drop_parts(_parts(messages))


class _StreamWriter(DataSourceStreamWriter):
    """As for a write; the batch is the segment."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator) -> Written:
        return _Writer(self.folder, None).write(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        _seal(_Folder(self.folder), batchId, messages)

    def abort(self, messages: list, batchId: int) -> None:
        _Folder(self.folder).drop_parts(_parts(messages))


def _parts(messages: list) -> list[dict]:
    """Parts in the order of their tasks."""
    return [m.part for m in messages if m is not None and m.part is not None]


def _seal(queue: _Folder, number: int, messages: list) -> None:
    if queue.has(number):
        queue.drop_parts(_parts(messages))
    else:
        queue.seal(number, _parts(messages))


class MessageQueue(DataSource):
    """The queue as a data source, see the module."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LAYOUT

    def _folder(self) -> str:
        if not self.options.get("path"):
            raise ValueError("Name the folder of the queue, load(folder) or save(folder)")
        return self.options["path"]

    def _bound(self, option: str, default: int) -> int:
        value = int(self.options.get(option, default))
        if value < 1:
            raise ValueError(f"{option} has to be above 0, got {value}")
        return value

    def streamReader(self, schema: StructType) -> _Reader:
        return _Reader(self._folder(), self._bound("max_messages", 500), self._bound("max_bytes", 50_000_000))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("A queue is only appended to")
        number = self.options.get("segment")
        return _Writer(self._folder(), None if number is None else int(number))

    def streamWriter(self, schema: StructType, overwrite: bool) -> _StreamWriter:
        return _StreamWriter(self._folder())


def read_queue(spark: SparkSession, folder: str, max_messages: int, max_bytes: int) -> DataFrame:
    """Messages of a queue as a stream; a batch holds at most `max_messages` messages and `max_bytes` bytes."""
    spark.dataSource.register(MessageQueue)
    bounds = {"max_messages": str(max_messages), "max_bytes": str(max_bytes)}
    return spark.readStream.format(NAME).options(**bounds).load(folder)


def push(messages: DataFrame, folder: str, segment: int | None = None) -> None:
    """Add messages (arrival_seq, raw) in arrival order, visible all at once; a segment that is there already stays as it is."""
    messages.sparkSession.dataSource.register(MessageQueue)
    ordered = messages.select("arrival_seq", "raw").repartitionByRange("arrival_seq").sortWithinPartitions("arrival_seq")
    writer = ordered.write.format(NAME).mode("append")
    (writer if segment is None else writer.option("segment", str(segment))).save(folder)
