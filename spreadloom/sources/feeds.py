"""Python data sources over files that play a vendor: pages behind cursors, and a message feed in numbered segments.

Files are reached by the file systems of Arrow, so a path may be local or name a store. A page or segment is read by the
task that needs it, when it needs it.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith(("/", "file:")) else f"/{path}")


def entries(path: str) -> list[str]:
    """Names in a folder that are neither hidden nor marks of a writer."""
    store, where = opened(path)
    found = store.get_file_info(fs.FileSelector(where, allow_not_found=True))
    return sorted(f.base_name for f in found if not f.base_name.startswith(("_", ".")))


def text_of(path: str) -> str:
    """All text of the files in a folder."""
    store, where = opened(path)
    return "".join(store.open_input_stream(f"{where}/{name}").read().decode() for name in entries(path))


def lines_of(path: str, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Lines of the files in a folder, those of about `size` bytes at a time; a line ends at a line feed or with its file."""
    store, where = opened(path)
    for name in entries(path):
        with store.open_input_stream(f"{where}/{name}") as stream:
            rest = b""
            while part := stream.read(size):
                first, *more = part.split(b"\n")
                rest += first
                if more:
                    yield [rest, *more[:-1]]
                    rest = more[-1]
            if rest:
                yield [rest]


class Instrument(InputPartition):
    def __init__(self, name: str):
        self.name = name


class PageReader(DataSourceReader):
    """One partition per instrument. From the first cursor on, pages are fetched one after the other, until one has no
    next cursor or names one that was there already."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.first = options.get("first", "0")
        self.names = [n for n in options.get("instruments", "").split(",") if n]

    def partitions(self) -> list[Instrument]:
        names = self.names or [n.partition("=")[2] for n in entries(self.path) if n.startswith("instr=")]
        return [Instrument(n) for n in names]

    def read(self, partition: Instrument) -> Iterator[tuple]:
        cursor, seen = self.first, set()
        while cursor and cursor not in seen:
            seen.add(cursor)
            text = text_of(f"{self.path}/instr={partition.name}/cursor={cursor}")
            if not text.strip():
                return
            page = json.loads(text)
            for r in page["rows"]:
                yield (partition.name, dt.datetime.fromisoformat(r["t"]), *(float(r[c]) for c in ("open", "high", "low", "close", "volume")))
            cursor = page.get("next") or ""


class PagedBars(DataSource):
    """Bars behind cursors, in folders instr=<name>/cursor=<cursor> of one JSON object each: rows and next.

    Options: path, instruments (names with commas between; all folders by default), first (cursor to begin with).
    """

    @classmethod
    def name(cls) -> str:
        return "paged_bars"

    def schema(self) -> str:
        return "instr string, t timestamp_ntz, open double, high double, low double, close double, volume double"

    def reader(self, schema: object) -> PageReader:
        return PageReader(dict(self.options))


class Segment(InputPartition):
    def __init__(self, number: int):
        self.number = number


class FeedReader(DataSourceStreamReader):
    """Offsets count segments; what lies between two offsets is the same whenever it is read, so a batch can be replayed."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")

    def initialOffset(self) -> dict[str, int]:  # noqa: N802
        return {"segments": 0}

    def latestOffset(self) -> dict[str, int]:  # noqa: N802
        there = {int(n.partition("=")[2]) for n in entries(self.path) if n.startswith("segment=")}
        n = 0
        # a segment counts once all before it are there
        while n in there:
            n += 1
        return {"segments": n}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Segment]:
        return [Segment(k) for k in range(start["segments"], end["segments"])]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        n = 0
        for lines in lines_of(f"{self.path}/segment={partition.number}"):
            said = [(k, v) for k, v in enumerate(lines, n) if v]
            n += len(lines)
            yield pa.RecordBatch.from_pydict({
                "segment": pa.array([partition.number] * len(said), pa.int64()), "line": pa.array([k for k, _ in said], pa.int64()), "value": pa.array([v for _, v in said], pa.string())})

    def commit(self, end: dict[str, int]) -> None:
        pass


class Feed(DataSource):
    """A stream of messages (segment, line, value) from folders segment=0, segment=1 ... of JSON lines. Option: path.

    Segment and line (from 0, empty ones count) are the place of a message, the same whenever it is read."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "segment long, line long, value string"

    def streamReader(self, schema: object) -> FeedReader:  # noqa: N802
        return FeedReader(dict(self.options))
