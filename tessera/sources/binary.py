"""Headerless record files: velodyne, ouster, imu, radar. Read through Spark's binaryFile source, so any file system works.

A file of a capture is one scan or one short log; files are the partitions, and each is decoded in one
NumPy call to Arrow columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.errors import SensorError

# Record layouts, little-endian.
VELODYNE = [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("intensity", "<f4")]
OUSTER = {4: VELODYNE, 8: [*VELODYNE, ("t", "<f4"), ("reflectivity", "<f4"), ("ring", "<f4"), ("ambient", "<f4")]}
IMU = [("timestamp", "<f8"), ("ax", "<f4"), ("ay", "<f4"), ("az", "<f4"), ("wx", "<f4"), ("wy", "<f4"), ("wz", "<f4")]
IMU_ORIENTED = [*IMU, ("qw", "<f4"), ("qx", "<f4"), ("qy", "<f4"), ("qz", "<f4")]
RADAR = [("range", "<f4"), ("azimuth", "<f4"), ("elevation", "<f4"), ("velocity", "<f4"), ("snr", "<f4")]


def decode(data: bytes, layout) -> np.ndarray:
    """Records of a layout; a size that is no multiple of the record raises."""
    dtype = np.dtype(layout)
    if len(data) % dtype.itemsize:
        raise SensorError(f"{len(data)} bytes are no whole number of {dtype.itemsize}-byte records")
    return np.frombuffer(data, dtype)


def velodyne(data: bytes) -> np.ndarray:
    return decode(data, VELODYNE)


def ouster(data: bytes, columns: str | int = "auto") -> np.ndarray:
    """With auto the 8-column layout is tried first, so an even number of 4-column points is read as 8-column ones."""
    if columns == "auto":
        columns = 8 if len(data) % 32 == 0 else 4
    return decode(data, OUSTER[int(columns)])


def imu(data: bytes, orientation: bool | None = None) -> np.ndarray:
    """Without a choice the 32-byte layout wins where both fit."""
    if orientation is None:
        orientation = bool(len(data) % 32)
    return decode(data, IMU_ORIENTED if orientation else IMU)


def radar(data: bytes) -> np.ndarray:
    return decode(data, RADAR)


_KIND = {"<f4": ("float", pa.float32()), "<f8": ("double", pa.float64())}


def parse(files: DataFrame, layout, decoder) -> DataFrame:
    """path, idx and the fields of the layout, of rows of (path, content) from any source; fields that a file's own layout lacks are null."""
    names = [n for n, _ in layout]
    schema = pa.schema([("path", pa.string()), ("idx", pa.int64()), *[(n, _KIND[k][1]) for n, k in layout]])
    ddl = ", ".join(["path string", "idx long", *[f"`{n}` {_KIND[k][0]}" for n, k in layout]])

    def run(batches):
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                r = decoder(c.as_py())
                have = r.dtype.names
                cols = [pa.array([p] * len(r), pa.string()), pa.array(np.arange(len(r)))]
                cols += [pa.array(np.ascontiguousarray(r[n])) if n in have else pa.nulls(len(r), schema.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return files.select("path", "content").mapInArrow(run, ddl)


def read(spark: SparkSession, path: str, layout, decoder) -> DataFrame:
    return parse(spark.read.format("binaryFile").load(path), layout, decoder)


def read_velodyne(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, VELODYNE, velodyne)


def read_ouster(spark: SparkSession, path: str, columns: str | int = "auto") -> DataFrame:
    return read(spark, path, OUSTER[8], lambda d: ouster(d, columns))


def read_imu(spark: SparkSession, path: str, orientation: bool | None = None) -> DataFrame:
    return read(spark, path, IMU_ORIENTED, lambda d: imu(d, orientation))


def read_radar(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, RADAR, radar)
