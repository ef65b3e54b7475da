"""WAV files as a splittable source: one partition per range of a file, which seeks to its samples and streams them.

``wav`` has options ``path`` (a folder, a pattern or files, separated by commas), ``range_s`` (seconds a partition),
``block_s`` (seconds read at once) and ``as``: ``samples`` (path, start, rate, samples) with a row a block, or ``mfcc`` (path,
frame, c) with a row a cepstral frame.  Frames lie on the grid of the whole file: a range reads on until its last frame is whole, and
the sample before its first one, so the features of any split are those of the file.  A task holds one block, however
long the file is.  Files are opened wherever pyarrow can; others than 16-bit PCM are refused.
"""

from __future__ import annotations

import fnmatch
import posixpath
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from jatoba.operators.speakers import RATE, Cepstrum

RANGE_S, BLOCK_S = 600, 30
SCHEMAS = {"samples": "path string, start bigint, rate int, samples array<float>", "mfcc": "path string, frame bigint, c array<double>"}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def expand(paths: list[str], extensions: tuple[str, ...]) -> list[str]:
    """Files named by folders (their own media files), patterns in the last part, or names; each once, in order.  A name that
    is no folder stands for itself, whatever its ending; patterns and folders give files of the extensions only."""
    out: list[str] = []
    for path in paths:
        store, inner = _open(path)
        prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        head, tail = posixpath.split(inner.rstrip("/"))
        pattern = tail if any(c in tail for c in "*?[") else None
        folder = head if pattern else inner
        if pattern or store.get_file_info(inner).type == fs.FileType.Directory:
            found = [i.path for i in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.type == fs.FileType.File and i.path.rsplit(".", 1)[-1].lower() in extensions and (not pattern or fnmatch.fnmatchcase(i.base_name, pattern))]
            out += [prefix + p for p in sorted(found)]
        else:
            out.append(path)
    return list(dict.fromkeys(out))


@dataclass
class WavFile:
    """Where the samples of a file are."""

    path: str
    rate: int
    channels: int
    at: int
    frames: int

    @classmethod
    def of(cls, path: str) -> WavFile:
        """From the chunks before the samples; nothing else is read.  A size that a stream left open ends with the file."""
        store, inner = _open(path)
        with store.open_input_file(inner) as f:
            if f.read(4) != b"RIFF" or f.read(8)[4:] != b"WAVE":
                raise ValueError(f"{path} is no WAV file")
            kind = None
            while len(head := f.read(8)) == 8:
                name, size = struct.unpack("<4sI", head)
                if name == b"fmt ":
                    kind = struct.unpack("<HHIIHH", f.read(16))
                    f.seek(f.tell() + size - 16 + size % 2)
                elif name == b"data":
                    if kind is None or kind[0] not in (1, 0xFFFE) or kind[5] != 16:
                        raise ValueError(f"{path}: only 16-bit samples")
                    there = f.size() - f.tell()
                    return cls(path, kind[2], kind[1], f.tell(), min(size or there, there) // (2 * kind[1]))
                else:
                    f.seek(f.tell() + size + size % 2)
        raise ValueError(f"{path} has no samples")

    def blocks(self, start: int, stop: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
        """Mono samples in [-1, 1] from ``start`` to ``stop``, at most ``size`` at once, with where they begin."""
        store, inner = _open(self.path)
        width = 2 * self.channels
        with store.open_input_file(inner) as f:
            f.seek(self.at + start * width)
            while start < stop:
                raw = f.read(min(size, stop - start) * width)
                x = np.frombuffer(raw, "<i2", len(raw) // width * self.channels).astype(np.float32) / 32768
                if not len(x):
                    return
                yield start, x.reshape(-1, self.channels).mean(1)
                start += len(x) // self.channels


@dataclass
class Range(InputPartition):
    file: WavFile
    start: int
    stop: int


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind = options.get("as", "samples")
        self.paths = [p.strip() for p in options["path"].split(",") if p.strip()]
        self.range_s, self.block_s = float(options.get("range_s", RANGE_S)), float(options.get("block_s", BLOCK_S))
        if self.kind not in SCHEMAS:
            raise ValueError(f"as is one of {sorted(SCHEMAS)}")

    def partitions(self) -> list[Range]:
        """Ranges of samples, or of cepstral frames."""
        out = []
        for path in expand(self.paths, ("wav",)):
            w = WavFile.of(path)
            n, step = w.frames, max(1, round(self.range_s * w.rate))
            if self.kind == "mfcc":
                if w.rate != RATE:
                    raise ValueError(f"{path}: features need {RATE} samples a second")
                c = Cepstrum()
                n, step = max(0, (w.frames - c.size) // c.hop + 1), max(1, step // c.hop)
            out += [Range(w, at, min(n, at + step)) for at in range(0, n, step)]
        return out or [Range(WavFile("", RATE, 1, 0, 0), 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        w, block = partition.file, max(1, round(self.block_s * partition.file.rate))
        if partition.start >= partition.stop:
            return
        if self.kind == "samples":
            for at, x in w.blocks(partition.start, partition.stop, block):
                yield pa.RecordBatch.from_arrays([pa.array([w.path]), pa.array([at]), pa.array([w.rate], pa.int32()), pa.array([x], pa.list_(pa.float32()))], names=["path", "start", "rate", "samples"])
            return
        c, frame = Cepstrum(), partition.start
        first, last = frame * c.hop, (partition.stop - 1) * c.hop + c.size
        if first:
            (_, before), = w.blocks(first - 1, first, 1)
            c.before = before[0]
        for _, x in w.blocks(first, last, block):
            rows = c.push(x)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array([w.path] * len(rows)), pa.array(np.arange(frame, frame + len(rows))), pa.array(list(rows), pa.list_(pa.float64()))], names=["path", "frame", "c"])
                frame += len(rows)


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("as", "samples")]

    def reader(self, schema) -> WavReader:
        return WavReader(dict(self.options))


def read(spark: SparkSession, path: str | list[str], kind: str = "samples", range_s: float = RANGE_S, block_s: float = BLOCK_S) -> DataFrame:
    spark.dataSource.register(WavSource)
    names = path if isinstance(path, str) else ",".join(path)
    return spark.read.format("wav").option("as", kind).option("range_s", range_s).option("block_s", block_s).load(names)
