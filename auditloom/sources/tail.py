"""Text files that grow, rotate or shrink, as a source of lines: every read starts at the byte where the last one ended.

``spark.readStream.format("text_tail").load(folder)`` gives file, pos (byte offset of the line) and value. The engine's own
offset log holds, for every file, the end of its last whole line and a digest of the bytes at its beginning and before that end.
A file is known again by this digest, wherever it lies: one that was renamed goes on from its end, one that was
replaced, even by a longer file, or cut below its end starts anew. A last line without a line end waits for the rest.

Only names, lengths and times of all files are listed; files that changed give two blocks of ``BLOCK`` bytes and what lies
behind their last line end. The new bytes are cut into ranges of ``rangeBytes`` that tasks read side by side; a line
belongs to the range in which it starts, so a very long file, or one long line, is no special case.

Defined results: names that begin with a dot or an underscore are left out, as are names that do not match the option
``pattern``; a line end is ``\\n`` or ``\\r\\n``; bytes that are no UTF-8 become the replacement character; an empty folder and an empty
file give no line. Lines that were overwritten before any poll saw them are lost. A copy that lies beside its original is
a file of its own, with all its lines. Tasks open files with Arrow's file systems (local, HDFS, object stores).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

BLOCK = 4096
CHUNK = 1 << 20
RANGE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
LINES = "file string, pos long, value string"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    scheme, _, rest = path.partition(":/")
    return pafs.FileSystem.from_uri("/" + rest.lstrip("/") if scheme == "file" else path)


def digest(f: pa.NativeFile, end: int) -> str:
    """What tells a file by its bytes up to ``end``: its first block and the block before the end."""
    f.seek(0)
    first = f.read(min(BLOCK, end))
    f.seek(max(0, end - BLOCK))
    return hashlib.sha256(first + f.read(min(BLOCK, end))).hexdigest()


def last_line_end(f: pa.NativeFile, size: int) -> int:
    """The byte behind the last line end, found from the end of the file."""
    at = size
    while at > 0:
        start = max(0, at - CHUNK)
        f.seek(start)
        cut = f.read(at - start).rfind(b"\n")
        if cut >= 0:
            return start + cut + 1
        at = start
    return 0


@dataclass
class Range(InputPartition):
    """Lines of a file that start in [start, stop); ``first``: where this poll's part of the file begins."""

    path: str
    first: int
    start: int
    stop: int


def lines(f: pa.NativeFile, r: Range) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the lines of a range."""
    skip = r.start != r.first  # the line that reaches into the range belongs to the range before
    at = r.start - skip
    f.seek(at)
    open_line: list[bytes] = []
    while chunk := f.read(CHUNK):
        *whole, rest = chunk.split(b"\n")
        for piece in whole:
            line = b"".join((*open_line, piece))
            open_line = []
            if not skip:
                yield at, line
            at, skip = at + len(line) + 1, False
            if at >= r.stop:
                return
        if rest:
            open_line.append(rest)


class Tail:
    """The files of a folder: where their lines end now, and what lies between two such states."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.seen: dict[str, tuple[tuple, dict]] = {}

    def state(self) -> dict:
        """For every file the end of its last whole line and the digest up to there."""
        fs, base = file_system(self.path)
        found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True, recursive=True))
        out = {}
        for info in sorted(found, key=lambda i: i.path):
            if info.type != pafs.FileType.File or info.base_name[0] in "._" or not fnmatch(info.base_name, self.pattern):
                continue
            stamp = (info.size, info.mtime_ns)
            if info.path not in self.seen or self.seen[info.path][0] != stamp:
                with fs.open_input_file(info.path) as f:
                    end = last_line_end(f, info.size)
                    self.seen[info.path] = stamp, {"end": end, "digest": digest(f, end)}
            out[info.path] = self.seen[info.path][1]
        self.seen = {p: self.seen[p] for p in out}
        return out

    def ranges(self, start: dict, end: dict) -> list[Range]:
        """What is new from one state to a later one."""
        fs, _ = file_system(self.path)
        changed = {p: e for p, e in end.items() if start.get(p) != e}

        def same(path: str, old: dict) -> bool:
            if fs.get_file_info(path).type != pafs.FileType.File:
                return False
            with fs.open_input_file(path) as f:
                return f.size() >= old["end"] and digest(f, old["end"]) == old["digest"]

        went_on = {p: start[p]["end"] for p, e in changed.items() if p in start and start[p]["end"] <= e["end"] and same(p, start[p])}
        moved = [o for p, o in start.items() if o["end"] and (p not in end or (p in changed and p not in went_on))]
        out = []
        for p, e in changed.items():
            first = went_on.get(p)
            if first is None:
                first = max((o["end"] for o in moved if o["end"] <= e["end"] and same(p, o)), default=0)
            out += [Range(p, first, at, min(at + self.range_bytes, e["end"])) for at in range(first, e["end"], self.range_bytes)]
        return out

    def read(self, r: Range) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(self.path)[0], r.path
        pos: list[int] = []
        value: list[str] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path] * len(pos), pa.string()), pa.array(pos, pa.int64()), pa.array(value, pa.string())],
                                              ["file", "pos", "value"])

        with fs.open_input_file(path) as f:
            for at, line in lines(f, r):
                pos.append(at)
                value.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                size += len(line) + len(path)
                if size >= BATCH_BYTES:
                    yield batch()
                    pos, value, size = [], [], 0
        if pos:
            yield batch()


class TailStream(Tail, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.state()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.ranges(start, end)


class TailBatch(Tail, DataSourceReader):
    """Lines between two states given as JSON (options ``start`` and ``end``); without them all whole lines."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.start, self.end = (json.loads(options[k]) if k in options else None for k in ("start", "end"))

    def partitions(self) -> list[Range]:
        return self.ranges(self.start or {}, self.state() if self.end is None else self.end)

    def read(self, r: Range | None) -> Iterator[pa.RecordBatch]:
        return super().read(r) if r is not None else iter(())  # without ranges Spark asks for one empty partition


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_tail"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> TailBatch:
        return TailBatch(self.options)

    def streamReader(self, schema: StructType) -> TailStream:
        return TailStream(self.options)


def stream_lines(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """New lines of a folder's files as a stream."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("text_tail").options(**options).load(path)


@dataclass
class TextTail:
    """The same without a running stream: lines that were added since the last poll.

    Each poll owns the state that it writes, so a repeated poll reads the same lines again as long as files have only grown.
    """

    path: str
    state: str

    def poll(self, spark: SparkSession, poll_id: int, **options: object) -> DataFrame:
        """file, pos, value of the new lines."""
        spark.dataSource.register(TailSource)
        known = {k: spark.read.text(f"{self.state}/poll={k}").first() for k in self._kept(spark) if k in (poll_id - 1, poll_id)}
        if poll_id in known:
            now = known[poll_id].value
        else:
            now = json.dumps(Tail({"path": self.path, **{k: str(v) for k, v in options.items()}}).state())
            spark.createDataFrame([(now,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.state}/poll={poll_id}")
        before = known[poll_id - 1].value if poll_id - 1 in known else "{}"
        return spark.read.format("text_tail").options(start=before, end=now, **options).load(self.path)

    def _kept(self, spark: SparkSession) -> set[int]:
        """Polls whose state is complete."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.state}/poll=*/_SUCCESS")
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return {int(st.getPath().getParent().getName().split("=")[1]) for st in found}
