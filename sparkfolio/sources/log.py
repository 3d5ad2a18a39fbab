"""An event log of growing segments as a streaming source: offsets are bytes, a stream can start at the tail."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a segment that one task reads, and bytes that are read at a time.
PIECE, BLOCK = 32 << 20, 1 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a path as Spark names it, and the path there."""
    scheme, found, rest = path.partition(":")
    if not found or path.startswith("/"):
        return pafs.LocalFileSystem(), path
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else path)


class Piece(InputPartition):
    """Lines of a segment that begin in [start, end); ``whole`` is where a line begins for sure."""

    def __init__(self, segment: str, start: int, end: int, whole: bool, last: int) -> None:
        self.segment, self.start, self.end, self.whole, self.last = segment, start, end, whole, last


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, begin: str, piece: int) -> None:
        self.path, self.begin, self.piece = path, begin, piece
        self.known: dict[str, int] = {}

    def _ends(self) -> dict[str, int]:
        """End of the last whole line of each segment; a line that is still being written does not count."""
        store, path = file_system(self.path)
        out = {}
        for info in store.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            if info.type != pafs.FileType.File or info.base_name.startswith((".", "_")):
                continue
            known = self.known.get(info.base_name, 0)
            end = info.size
            if end > known:
                with store.open_input_file(info.path) as file:
                    while end > known:
                        start = max(known, end - 65_536)
                        file.seek(start)
                        at = file.read(end - start).rfind(b"\n")
                        if at >= 0:
                            end = start + at + 1
                            break
                        end = start
            out[info.base_name] = self.known[info.base_name] = max(known, end)
        return out

    def initialOffset(self) -> dict:  # noqa: N802
        return self._ends() if self.begin == "tail" else {}

    def latestOffset(self) -> dict:  # noqa: N802
        return self._ends()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for segment in sorted(end):
            first, last = start.get(segment, 0), end[segment]
            self.known[segment] = max(self.known.get(segment, 0), last)
            out += [Piece(segment, a, min(a + self.piece, last), a == first, last) for a in range(first, last, self.piece)]
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        store, path = file_system(self.path)
        with store.open_input_file(f"{path}/{piece.segment}") as file:
            at = piece.start if piece.whole else piece.start - 1  # a line that begins at the start has its end before it
            file.seek(at)
            held, skip = b"", not piece.whole
            while at < piece.last:
                block = held + file.read(min(BLOCK, piece.last - at - len(held)))
                lines, offsets, begin = [], [], 0
                while (stop := block.find(b"\n", begin)) >= 0:
                    if skip:
                        skip = False
                    elif at + begin >= piece.end:
                        break
                    else:
                        lines.append(block[begin:stop].removesuffix(b"\r"))
                        offsets.append(at + begin)
                    begin = stop + 1
                if lines:
                    values = pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([piece.segment] * len(lines)), pa.array(offsets, pa.int64()), values], ["segment", "offset", "value"])
                if not skip and at + begin >= piece.end or len(block) <= len(held):
                    return
                at, held = at + begin, block[begin:]

    def commit(self, end: dict) -> None:
        pass


class EventLog(DataSource):
    """``spark.readStream.format("event_log")``: rows (segment, offset, value), a line of a file each.

    Options: ``path``, a folder of segments to which lines are appended; ``begin``, "earliest" or "tail" (only lines that
    come after the stream was first started, also those of segments that were there); ``piece``, bytes a task reads. The
    checkpoint keeps the byte that each segment is read up to, so a stream that starts again loses and repeats nothing.
    A line counts once it has its end. Segments are not to be shortened. Files whose name begins with . or _ are no
    segments.
    """

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return "segment string, offset long, value string"

    def streamReader(self, schema) -> _Reader:  # noqa: N802
        begin = self.options.get("begin", "earliest")
        if begin not in ("earliest", "tail"):
            raise ValueError(f"begin is earliest or tail, not {begin!r}")
        return _Reader(self.options["path"], begin, int(self.options.get("piece", PIECE)))


def log_stream(spark: SparkSession, path: str, begin: str = "earliest", piece: int = PIECE) -> DataFrame:
    """Rows (segment, offset, value) of an event log; sources.events() makes events of them."""
    spark.dataSource.register(EventLog)
    return spark.readStream.format("event_log").option("begin", begin).option("piece", piece).option("path", path).load()
