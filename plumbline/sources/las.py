"""LAS point files (formats 0 to 10, not compressed) as a Spark data source: format("las").

A header gives the layout; partitions are ordinal ranges of whole records, read by offset, so a file of any size is read by
many tasks. Fields are decoded from a numpy structure with bit operations. Compressed files are refused by name.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from plumbline.model import PlumblineError, SpatialReference, Transform


class UnsupportedFormat(PlumblineError):
    pass


#: Fixed values of the format: record lengths by point format.
RECORD_BYTES = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}


def _fields(fmt: int) -> list[tuple[str, str]]:
    out = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("bits", "u1")]
    if fmt < 6:
        out += [("classes", "u1"), ("scan_angle", "i1"), ("user_data", "u1"), ("point_source_id", "<u2")]
        out += [("gps_time", "<f8")] if fmt in (1, 3, 4, 5) else []
        colours = fmt in (2, 3, 5)
    else:
        out += [("flags", "u1"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle", "<i2"), ("point_source_id", "<u2"), ("gps_time", "<f8")]
        colours = fmt in (7, 8, 10)
    out += [(c, "<u2") for c in ("red", "green", "blue")] if colours else []
    out += [("nir", "<u2")] if fmt in (8, 10) else []
    if fmt in (4, 5, 9, 10):
        out += [("wave_descriptor", "u1"), ("wave_offset", "<u8"), ("wave_size", "<u4"), ("wave_location", "<f4"), ("wave_dx", "<f4"), ("wave_dy", "<f4"), ("wave_dz", "<f4")]
    return out


@dataclass(frozen=True)
class Header:
    version: tuple[int, int]
    point_format: int
    record_bytes: int
    point_offset: int
    point_count: int
    transform: Transform
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    records: tuple[tuple[str, int, bytes], ...]  # user, record id, payload

    @property
    def extra_bytes(self) -> int:
        return self.record_bytes - RECORD_BYTES[self.point_format]


#: Bytes of extended records that a file may have; more is an error.
MAX_EXTENDED = 64 << 20


def read_header(data: bytes, tail=None) -> Header:
    """Parses a header and its records, extended ones included (tail: the bytes from a place on); the two point counts must
    agree."""
    if data[:4] != b"LASF":
        raise UnsupportedFormat("not a LAS file")
    major, minor = data[24], data[25]
    header_bytes, offset, n_records, fmt, length, count = struct.unpack_from("<HIIBHI", data, 94)
    scale, off, ranges = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155), struct.unpack_from("<6d", data, 179)
    if fmt & 0xC0:
        raise UnsupportedFormat("compressed LAS (LAZ) needs an entropy decoder and is not supported")
    if fmt not in RECORD_BYTES or length < RECORD_BYTES[fmt]:
        raise UnsupportedFormat(f"point format {fmt} with records of {length} bytes")
    if (major, minor) >= (1, 4):
        wide = struct.unpack_from("<Q", data, 247)[0]
        if count and count != wide:
            raise PlumblineError(f"the header's counts differ: {count} and {wide}")
        count = wide
    records, at = [], header_bytes
    for _ in range(n_records):
        user, rid, size = struct.unpack_from("<2x16sHH", data, at)
        records.append((user.rstrip(b"\0").decode("latin-1"), rid, data[at + 54 : at + 54 + size]))
        at += 54 + size
    if (major, minor) >= (1, 4):  # extended records lie after the points
        start, n_extended = struct.unpack_from("<QI", data, 235)
        if n_extended:
            if tail is None or start < offset + count * length:
                raise PlumblineError("the extended records can't be read")
            rest = tail(start)
            at = 0
            for _ in range(n_extended):
                if at + 60 > len(rest):
                    raise PlumblineError("an extended record is cut off")
                user, rid, size = struct.unpack_from("<2x16sHQ", rest, at)
                if at + 60 + size > len(rest):
                    raise PlumblineError("an extended record is cut off")
                records.append((user.rstrip(b"\0").decode("latin-1"), rid, rest[at + 60 : at + 60 + size]))
                at += 60 + size
    return Header((major, minor), fmt, length, offset, count, Transform(off, scale), (ranges[1], ranges[3], ranges[5]), (ranges[0], ranges[2], ranges[4]), tuple(records))


def spatial_reference(header: Header) -> SpatialReference | str | None:
    """The text of the only WKT record, else the profile of the only GeoTIFF directory, else unknown; never a guess."""
    wkt = [p for u, r, p in header.records if r == 2112]
    if wkt:
        return wkt[0].rstrip(b"\0").decode("utf-8", "replace") if len(wkt) == 1 else None
    keys = [p for u, r, p in header.records if u == "LASF_Projection" and r == 34735]
    if len(keys) != 1 or len(keys[0]) < 8:
        return None
    shorts = struct.unpack(f"<{len(keys[0]) // 2}H", keys[0][: len(keys[0]) // 2 * 2])
    found: dict[int, int] = {}
    seen: set[int] = set()
    if len(shorts) < 4 + 4 * shorts[3]:
        return None
    for i in range(4, min(len(shorts), 4 + 4 * shorts[3]) - 3, 4):
        key, where, n, value = shorts[i : i + 4]
        if key in seen or where != 0 or n != 1:
            return None  # any key that is there twice, or points elsewhere, leaves the whole unknown
        seen.add(key)
        if key in (1024, 3072, 3076, 4096, 4099):
            found[key] = value
    units = {9001: "metre", 9002: "foot", 9003: "us_survey_foot"}
    if len(found) < 5 or found[1024] != 1 or found[3076] not in units or found[4099] not in units:
        return None
    return SpatialReference(found[3072], found[4096], horizontal_unit=units[found[3076]], vertical_unit=units[found[4099]], provenance="sourceMetadata")


def decode(header: Header, first: int, data: bytes) -> dict[str, np.ndarray]:
    """Columns of whole records."""
    kind = np.dtype({"names": [n for n, _ in _fields(header.point_format)], "formats": [f for _, f in _fields(header.point_format)], "offsets": np.cumsum([0] + [np.dtype(f).itemsize for _, f in _fields(header.point_format)])[:-1].tolist(), "itemsize": header.record_bytes})
    r = np.frombuffer(data, kind)
    out = {"ordinal": np.arange(first, first + len(r), dtype=np.int64)} | {f"t{a}": r[a].astype(np.int64) for a in "xyz"} | {"intensity": r["intensity"].astype(np.int32)}
    bits = r["bits"]
    if header.point_format < 6:
        c = r["classes"]
        out |= {"return_number": bits & 7, "number_of_returns": bits >> 3 & 7, "scan_direction": bits >> 6 & 1, "edge_of_flight_line": bits >> 7, "classification": c & 31, "synthetic": c >> 5 & 1, "key_point": c >> 6 & 1, "withheld": c >> 7}
    else:
        f = r["flags"]
        out |= {"return_number": bits & 15, "number_of_returns": bits >> 4, "synthetic": f & 1, "key_point": f >> 1 & 1, "withheld": f >> 2 & 1, "overlap": f >> 3 & 1, "scanner_channel": f >> 4 & 3, "scan_direction": f >> 6 & 1, "edge_of_flight_line": f >> 7, "classification": r["classification"]}
    out["scan_angle"], out["user_data"], out["point_source_id"] = r["scan_angle"].astype(np.int16), r["user_data"], r["point_source_id"].astype(np.int32)
    for n in kind.names:
        if n == "gps_time":
            out[n] = r[n].astype(np.float64)
        elif n in ("red", "green", "blue", "nir"):
            out[n] = r[n].astype(np.int32)
        elif n == "wave_offset":
            out[n] = r[n]
        elif n == "wave_size":
            out[n] = r[n].astype(np.int64)
        elif n.startswith("wave_"):
            out[n] = r[n] if n == "wave_descriptor" else r[n].astype(np.float32)
    out = {k: v.astype(np.int16) if v.dtype == np.uint8 else v for k, v in out.items()}
    if header.extra_bytes:
        raw = np.frombuffer(data, np.uint8).reshape(-1, header.record_bytes)[:, -header.extra_bytes :]
        out["extra_bytes"] = np.array([bytes(x) for x in raw], object)
    return out


_KINDS = {"int64": "long", "int32": "int", "int16": "short", "float64": "double", "float32": "float", "uint64": "decimal(20,0)", "object": "binary"}


def _head(path: str) -> Header:
    with open(path.removeprefix("file://"), "rb") as f:
        data = f.read(375)
        offset = struct.unpack_from("<I", data, 96)[0] if len(data) >= 100 else 0
        data += f.read(max(0, offset - len(data)))

        def tail(start: int) -> bytes:
            f.seek(start)
            rest = f.read(MAX_EXTENDED + 1)
            if len(rest) > MAX_EXTENDED:
                raise PlumblineError(f"extended records of more than {MAX_EXTENDED} bytes")
            return rest

        return read_header(data, tail)


@dataclass
class _Range(InputPartition):
    first: int
    count: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, points: int):
        self.path, self.names, self.points, self.head = path, schema.fieldNames(), points, _head(path)

    def partitions(self):
        n = self.head.point_count
        return [_Range(a, min(self.points, n - a)) for a in range(0, n, self.points)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        h, at, end = self.head, partition.first, partition.first + partition.count
        with open(self.path.removeprefix("file://"), "rb") as f:
            f.seek(h.point_offset + at * h.record_bytes)
            while at < end:
                n = min(65_536, end - at)
                data = f.read(n * h.record_bytes)
                if len(data) < n * h.record_bytes:
                    raise PlumblineError("the file ends before its last record")
                columns = decode(h, at, data)
                arrays = [pa.array(columns[c].astype(object) if columns[c].dtype == np.uint64 else columns[c], pa.decimal128(20, 0) if columns[c].dtype == np.uint64 else None) for c in self.names]
                yield pa.RecordBatch.from_arrays(arrays, names=self.names)
                at += n


class LasSource(DataSource):
    """spark.read.format("las").load(path); option points: points of a partition."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        h = _head(self.options["path"])
        empty = decode(h, 0, b"")
        return ", ".join(f"{n} {_KINDS[v.dtype.name]}" for n, v in empty.items())

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], schema, int(self.options.get("points", 1 << 20)))


def register(spark: SparkSession) -> None:
    from plumbline.runtime import ship

    ship(spark)
    spark.dataSource.register(LasSource)
