"""EDF recordings as a data source: partitions are ranges of records, and only the wanted channels are read.

A file begins with a header of fixed width and one of fixed columns for each signal; then come records, each with a stretch of every
signal as 16-bit samples.  So the place of any record is known, a recording of any size is read by many tasks, and where few of a
record's bytes are wanted these alone are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

NAME = "edf_recording"
SCHEMA = "path string, channel_index int, channel string, fs double, start_idx long, v array<double>, digital_min double, digital_max double"
#: Bytes of records in a partition, and those read at once.
PARTITION_BYTES, BLOCK_BYTES = 64 << 20, 16 << 20
#: Channels are read one by one where they are less than this share of a record.
SPARSE = 0.25


@dataclass
class Signal:
    index: int
    label: str
    low: float
    scale: float
    digital_low: float
    high: float
    samples: int
    offset: int  # of its bytes in a record


@dataclass
class Header:
    """What the head of a file says: where records begin, how many there are, their seconds, and the signals in them."""

    start: int
    records: int
    seconds: float
    width: int
    signals: list[Signal]

    @classmethod
    def read(cls, head: bytes, size: int) -> Header:
        """From the first bytes of a file of that size; ValueError if it is none. A count of -1 is what the size allows."""

        def text(a: int, b: int) -> str:
            return head[a:b].decode("latin-1").strip()

        start, records, seconds, n = int(text(184, 192)), int(text(236, 244)), float(text(244, 252)), int(text(252, 256))
        if len(head) < 256 * (n + 1) or start < 256 * (n + 1):
            raise ValueError("the header is cut off")
        columns, at = [], 256
        for wide in (16, 80, 8, 8, 8, 8, 8, 80, 8, 32):
            columns.append([text(at + i * wide, at + (i + 1) * wide) for i in range(n)])
            at += n * wide
        labels, _, _, low, high, d0, d1, _, samples, _ = columns
        signals, offset = [], 0
        for i in range(n):
            span = float(d1[i]) - float(d0[i])
            scale = (float(high[i]) - float(low[i])) / span if span else 1.0
            signals.append(Signal(i, labels[i], float(low[i]), scale, float(d0[i]), float(high[i]), int(samples[i]), offset))
            offset += 2 * int(samples[i])
        whole = (size - start) // offset if offset else 0
        return cls(start, max(0, whole if records < 0 else min(records, whole)), seconds, offset, signals)

    def chosen(self, channels: list[str] | None, primary: int | None) -> list[Signal]:
        """The named signals, or the primary one (the first if there is none of that number), or all."""
        some = self.signals if primary is None else self.signals[primary : primary + 1] or self.signals[:1]
        return [s for s in some if not channels or s.label in channels]


@dataclass
class Records(InputPartition):
    path: str
    header: Header
    first: int
    count: int


def open_at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class EdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        names, primary = options.get("channels"), options.get("primary")
        self.path = options["path"]
        self.channels = names.split("\n") if names else None
        self.primary = int(primary) if primary is not None else None
        self.chunk = int(options.get("chunk", 1 << 16))
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """A choice of channels is made here; all other conditions are Spark's."""
        for f in filters:
            match f:
                case EqualTo(("channel",), str(name)):
                    self._only([name])
                case In(("channel",), tuple(names)) if all(isinstance(n, str) for n in names):
                    self._only(list(names))
                case _:
                    yield f

    def _only(self, names: list[str]) -> None:
        self.channels = names if self.channels is None else [n for n in names if n in self.channels] or ["\0"]

    def partitions(self) -> list[Records]:
        """Ranges of records of all files below the path; what is no EDF file gives none."""
        store, root = open_at(self.path)
        found = store.get_file_info(root)
        files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for f in files:
            if f.type != fs.FileType.File or not f.base_name.endswith(".edf"):
                continue
            try:
                with store.open_input_file(f.path) as file:
                    fixed = file.read(256)
                    head = fixed + file.read(256 * max(0, min(int(fixed[252:256]), 4096)))
                header = Header.read(head, f.size)
            except ValueError:
                continue
            name = f.path if "://" not in self.path else self.path.split("://")[0] + "://" + f.path
            each = max(1, self.bytes // max(1, header.width))
            out += [Records(name, header, at, min(each, header.records - at)) for at in range(0, header.records, each)]
        return out or [Records("", Header(0, 0, 1.0, 0, []), 0, 0)]

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        """Rows of up to chunk samples of a signal."""
        signals = part.header.chosen(self.channels, self.primary)
        if not part.count or not signals:
            return
        store, path = open_at(part.path)
        with store.open_input_file(path) as file:
            for s in signals if sum(2 * s.samples for s in signals) < SPARSE * part.header.width else [None]:
                yield from self._rows(part, [s] if s else signals, self._stretches(file, part, s))

    def _stretches(self, file: pa.NativeFile, part: Records, only: Signal | None) -> Iterator[np.ndarray]:
        """Records as rows of a matrix, of all signals or of one."""
        h = part.header
        each = max(1, BLOCK_BYTES // max(1, 2 * only.samples if only else h.width))
        for at in range(part.first, part.first + part.count, each):
            n = min(each, part.first + part.count - at)
            if only is None:
                file.seek(h.start + at * h.width)
                yield np.frombuffer(file.read(n * h.width), "<i2").reshape(n, -1)
                continue
            got = []
            for r in range(at, at + n):
                file.seek(h.start + r * h.width + only.offset)
                got.append(file.read(2 * only.samples))
            yield np.frombuffer(b"".join(got), "<i2").reshape(n, -1)

    def _rows(self, part: Records, signals: list[Signal], stretches: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        held = {s.index: [np.zeros(0)] for s in signals}
        start = {s.index: part.first * s.samples for s in signals}
        for block in stretches:
            for s in signals:
                raw = block if len(signals) == 1 and block.shape[1] == s.samples else block[:, s.offset // 2 : s.offset // 2 + s.samples]
                x = np.concatenate([*held[s.index], (raw.ravel() - s.digital_low) * s.scale + s.low])
                full = len(x) // self.chunk * self.chunk
                for a in range(0, full, self.chunk):
                    yield self._row(part, s, start[s.index] + a, x[a : a + self.chunk])
                held[s.index], start[s.index] = [x[full:]], start[s.index] + full
        for s in signals:
            if len(held[s.index][0]):
                yield self._row(part, s, start[s.index], held[s.index][0])

    @staticmethod
    def _row(part: Records, s: Signal, start: int, x: np.ndarray) -> pa.RecordBatch:
        rate = s.samples / part.header.seconds if part.header.seconds else None
        values = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.float64()))
        columns = [pa.array([part.path]), pa.array([s.index], pa.int32()), pa.array([s.label]), pa.array([rate], pa.float64()), pa.array([start], pa.int64()), values, pa.array([s.low]), pa.array([s.high])]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


class EdfSource(DataSource):
    """spark.read.format(NAME): options path, channels (a line each), primary, chunk, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return EdfReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with conditions on channels handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EdfSource)
