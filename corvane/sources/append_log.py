"""Append-only logs as a streaming source: lines of the files of a folder, each once, from where the last run ended.

Offsets are bytes by file and end at a line's end, so a line that is still being written waits for the next batch. Files are read
in ranges of bounded size. The folder is any that Arrow's file systems reach from driver and executors (a shared mount, hdfs://,
s3://); a folder of one machine is not enough on a cluster.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at bigint, value string"
RANGE, LOOK_BACK = 16 << 20, 1 << 20


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _line_end(files, path: str, size: int) -> int:
    """Just after the last line feed in the first `size` bytes; 0 if there is none. The end is looked at in steps backwards."""
    with files.open_input_file(path) as f:
        high = size
        while high > 0:
            low = max(0, high - LOOK_BACK)
            f.seek(low)
            cut = f.read(high - low).rfind(b"\n")
            if cut >= 0:
                return low + cut + 1
            high = low
    return 0


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("range", RANGE))

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        files, root = _files(self.path)
        found = [i for i in files.get_file_info(fs.FileSelector(root)) if i.is_file and not i.base_name.startswith((".", "_"))]
        return {"files": json.dumps({i.base_name: _line_end(files, i.path, i.size) for i in found}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        return [Range(name, at, min(at + self.range, to)) for name, to in sorted(now.items()) for at in range(before.get(name, 0), to, self.range)]

    def read(self, part: Range) -> Iterator[tuple]:
        """The lines that begin in the range: the first begins after a line feed, the last may end beyond."""
        files, root = _files(self.path)
        with files.open_input_file(f"{root}/{part.path}") as f:
            at = part.start
            if at:
                f.seek(at - 1)
                at += len(self._line(f)) - 1
            f.seek(at)
            while at < part.end:
                line = self._line(f)
                if not line:
                    return
                yield part.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)

    @staticmethod
    def _line(f) -> bytes:
        parts = []
        while piece := f.read(1 << 16):
            cut = piece.find(b"\n")
            if cut >= 0:
                f.seek(f.tell() - len(piece) + cut + 1)
                return b"".join([*parts, piece[: cut + 1]])
            parts.append(piece)
        return b"".join(parts)

    def commit(self, end: dict) -> None:
        pass


class AppendLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "append_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options)


def read(spark: SparkSession, path: str, *, range_bytes: int = RANGE) -> DataFrame:
    """(file, at, value) of each line as a stream; a restart from a checkpoint goes on after the last line taken."""
    spark.dataSource.register(AppendLog)
    return spark.readStream.format("append_log").option("path", path).option("range", str(range_bytes)).load()
