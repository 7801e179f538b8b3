"""Pixel segments: a Spark data source over byte ranges of raw record files, and file discovery.

A segment is a run of little-endian records of ``num_channels + 3`` values (x, y, one unused,
the channels) of 2, 4 or 8 bytes. ``format("pixel_segments")`` takes ``path`` and ``segments``, a JSON list
of {roi_id, path?, data_start, data_end, value_bytes, num_channels, name}, and splits each into
ranges of whole records, which are read in parallel. ``mode`` FAILFAST raises on a partial record
or a short file, PERMISSIVE reads the whole records there are. Filters on roi_id prune
segments before any byte is read (with spark.sql.python.filterPushdown.enabled).
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from pixelloom.operators import mosaic

TYPES = {2: "<f2", 4: "<f4", 8: "<f8"}
BATCH_RECORDS = 50_000
SPLIT_BYTES = 64 << 20
SCHEMA = "roi_id int, rec_ord bigint, x double, y double, values array<double>"


#: Messages that callers match on.
WIDTH = "Unsupported ValueBytes={value_bytes} for '{name}' (expected 2, 4, or 8)"
SIZE = "Acquisition data size mismatch for '{name}'"
ENDED = "The file ends before the segment of '{name}'"
RECOVERED = "Warning: strict read failed for {name}. Retrying in recovery mode."


class SegmentError(OSError):
    """A segment whose size, width or file does not fit its description."""


def resolve_inputs(path: str | Path, suffix: str = ".mcd") -> list[Path]:
    """A file of the suffix in any case, or the sorted files of it right in a folder."""
    p = Path(path)
    if p.is_file() and p.suffix.lower() == suffix:
        return [p]
    if p.is_dir():
        if found := sorted(p.glob(f"*{suffix}")):
            return found
        raise ValueError(f"No {suffix} files found in folder")
    raise ValueError(f"Input must be a {suffix} file or a folder of {suffix} files")


def resolve_tiffs(path: str | Path) -> list[Path]:
    """A .tiff file, or all below a folder; .tif is not taken."""
    p = Path(path)
    if p.is_file() and p.suffix.lower() == ".tiff":
        return [p]
    found = sorted(p.rglob("*.tiff")) if p.is_dir() else []
    if not found:
        raise ValueError("No .tiff files found")
    return found


def count_records(segment: dict, strict: bool, file_size: int | None = None) -> int:
    """Whole records of a segment."""
    width = int(segment.get("value_bytes") or 4)
    name = segment.get("name")
    if width not in TYPES:
        raise SegmentError(WIDTH.format(value_bytes=width, name=name))
    record = (int(segment["num_channels"]) + 3) * width
    size = int(segment["data_end"]) - int(segment["data_start"])
    if file_size is not None and file_size < int(segment["data_end"]):
        if strict:
            raise SegmentError(ENDED.format(name=name))
        size = max(0, file_size - int(segment["data_start"]))
    if size % record and strict:
        raise SegmentError(SIZE.format(name=name))
    return size // record


@dataclass
class Range(InputPartition):
    segment: dict
    path: str
    first: int
    count: int


class SegmentReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path", "")
        self.segments = json.loads(options["segments"])
        self.strict = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.wanted: set | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and tuple(f.attribute) == ("roi_id",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = own if self.wanted is None else self.wanted & own
            else:
                yield f

    def partitions(self):
        out = []
        for s in self.segments:
            if self.wanted is not None and s["roi_id"] not in self.wanted:
                continue
            path = s.get("path") or self.path
            n = s["n_records"] if "n_records" in s else count_records(s, self.strict, os.path.getsize(path))
            record = (int(s["num_channels"]) + 3) * int(s.get("value_bytes") or 4)
            step = max(1, SPLIT_BYTES // record)
            out += [Range(s, path, k, min(step, n - k)) for k in range(0, n, step)]
        return out

    def read(self, part):
        if part is None:  # no segment is left
            return
        s, width = part.segment, int(part.segment.get("value_bytes") or 4)
        values = int(s["num_channels"]) + 3
        with open(part.path, "rb") as f:
            f.seek(int(s["data_start"]) + part.first * values * width)
            done = 0
            while done < part.count:
                n = min(BATCH_RECORDS, part.count - done)
                # Half precision is widened here, before anything is clipped.
                rows = np.frombuffer(f.read(n * values * width), TYPES[width]).reshape(n, values).astype(np.float64)
                channels = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (values - 3)), pa.array(np.ascontiguousarray(rows[:, 3:]).ravel()))
                ids, order = np.full(n, s["roi_id"], np.int32), np.arange(done, done + n, dtype=np.int64) + part.first
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(order), pa.array(rows[:, 0]), pa.array(rows[:, 1]), channels], ["roi_id", "rec_ord", "x", "y", "values"])
                done += n


class PixelSegments(DataSource):
    @classmethod
    def name(cls):
        return "pixel_segments"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return SegmentReader(self.options)


def read_segments(spark: SparkSession, path: str, segments: list[dict], strict: bool = False) -> DataFrame:
    """Wide records of the segments. Without any, an empty table."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PixelSegments)
    if not segments:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.format("pixel_segments").option("segments", json.dumps(segments)).option("mode", "FAILFAST" if strict else "PERMISSIVE").load(path)


def read_segments_safely(spark: SparkSession, path: str, segments: list[dict]) -> tuple[DataFrame, list[str]]:
    """Whole records of every segment, with a warning for each that is not whole; a width that is not supported raises.

    What each comes to is told by ``mosaic.isolate`` over a table of a row a segment.
    """
    rows = [(k, int(s["data_start"]), int(s["data_end"]), int(s.get("value_bytes") or 4), int(s["num_channels"]), os.path.getsize(s.get("path") or path)) for k, s in enumerate(segments)]
    table = spark.createDataFrame(rows, "k int, data_start long, data_end long, value_bytes int, num_channels int, file_size long")
    told = {r.k: r for r in mosaic.isolate(table).collect()} if rows else {}
    for k, r in told.items():
        if r.status == "skipped":
            raise SegmentError(WIDTH.format(value_bytes=r.value_bytes, name=segments[k].get("name")))
    warnings = [RECOVERED.format(name=segments[k].get("name")) for k, r in sorted(told.items()) if r.status == "recovered"]
    return read_segments(spark, path, [s | {"n_records": told[k].n_records} for k, s in enumerate(segments)]), warnings
