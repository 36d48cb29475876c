"""LVX recordings: a header, a table of devices, then frames of packages of points."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.errors import SensorError
from tessera.shared import file_system

# Signature and sizes of the format.
SIGNATURE = b"livox_tech"
HEADER, DEVICE_V1, DEVICE_V2, FRAME, PACKAGE_V1, PACKAGE_V2 = 24, 59, 63, 24, 19, 22
#: Bytes of a point of each kind.
SIZES = {0: 16, 1: 16, 2: 14}
#: Bytes of frames that one task decodes.
SPLIT = 32 << 20
#: Bytes of frames that are decoded at once, and points that are handed on at once.
TOGETHER, ROWS = 1 << 20, 20_000


def points(data: bytes, kind: int) -> np.ndarray:
    """[n, 4] of x, y, z in metres and intensity in 0..1; a partial last point is dropped, an unknown kind has none."""
    if kind == 0:
        r = np.frombuffer(data[: len(data) // 16 * 16], "<f4").reshape(-1, 4).astype(float)
        return np.c_[r[:, :3] / 1000, r[:, 3] / 255]
    if kind == 1:
        r = np.frombuffer(data[: len(data) // 16 * 16], "<f4").reshape(-1, 4).astype(float)
        d, zen, az = r[:, 0] / 1000, np.radians(r[:, 1] / 100), np.radians(r[:, 2] / 100)
        return np.c_[d * np.sin(zen) * np.cos(az), d * np.sin(zen) * np.sin(az), d * np.cos(zen), r[:, 3] / 255]
    if kind == 2:
        r = np.frombuffer(data[: len(data) // 14 * 14], np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("i", "u1"), ("tag", "u1")]))
        return np.c_[r["x"] / 1000.0, r["y"] / 1000.0, r["z"] / 1000.0, r["i"] / 255.0]
    return np.zeros((0, 4))


def _begin(head: bytes) -> tuple[int, int]:
    """Of a recording's first bytes: where its frames begin, and the size of a package's head."""
    if len(head) < HEADER or head[:10] != SIGNATURE:
        raise SensorError("no LVX signature")
    first, devices = head[10] < 2, head[22]
    return HEADER + devices * (DEVICE_V1 if first else DEVICE_V2), PACKAGE_V1 if first else PACKAGE_V2


def frame_bounds(get, size: int):
    """(begin, end) of the packages of each frame; get(at, n) reads bytes. Only heads are read, so frames are walked by seeks."""
    at, _ = _begin(get(0, HEADER))
    while at + FRAME <= size:
        here, nxt, _ = struct.unpack("<QQQ", get(at, FRAME))
        end = at + FRAME + max(0, nxt - here - FRAME)
        yield at + FRAME, min(end, size)
        at = end


def frames(data: bytes, bounds: list[tuple[int, int]], head: int) -> tuple[np.ndarray, np.ndarray]:
    """([n, 4] points, the number of points of each frame) of frames whose packages lie in data at bounds. Points of a kind are decoded together, whatever packages they are in."""
    raw: dict[int, list[bytes]] = {}
    kinds, counts, of = [], [], []
    for k, (at, end) in enumerate(bounds):
        while at + head <= end:
            (n,) = struct.unpack_from("<I", data, at + head - 4)  # of the package, its head included
            if n == 0 or at + n > end:
                break
            kind = data[at + 1]
            size = SIZES.get(kind)
            if size and n >= head + size:
                m = (n - head) // size
                raw.setdefault(kind, []).append(data[at + head : at + head + m * size])
                kinds.append(kind)
                counts.append(m)
                of.append(k)
            at += n
    if len(raw) < 2:
        out = np.concatenate([np.zeros((0, 4)), *[points(b"".join(parts), kind) for kind, parts in raw.items()]])
    else:
        kind_of = np.repeat(kinds, counts)
        out = np.empty((len(kind_of), 4))
        for kind, parts in raw.items():
            out[kind_of == kind] = points(b"".join(parts), kind)
    return out, np.bincount(np.array(of, int), counts, len(bounds)).astype(int)


def packages(data: bytes, head: int) -> np.ndarray:
    """[n, 4] points of a frame's packages."""
    return frames(data, [(0, len(data))], head)[0]


def _all_bounds(data: bytes) -> list[tuple[int, int]]:
    return list(frame_bounds(lambda at, n: data[at : at + n], len(data)))


def decode(data: bytes) -> np.ndarray:
    """All points of a recording."""
    return frames(data, _all_bounds(data), _begin(data)[1])[0]


def _together(bounds: list[tuple[int, int]]):
    """bounds in runs of about TOGETHER bytes."""
    run = []
    for s, e in bounds:
        if run and e - run[0][0] > TOGETHER:
            yield run
            run = []
        run.append((s, e))
    if run:
        yield run


def read(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """path, frame, idx, x, y, z, intensity; frames are numbered in a file and points in a frame.

    A first pass follows the chain of frames by their heads alone and cuts a file of more than ``split`` bytes into runs of frames of about that size; then each run, or smaller file, is read and decoded by a task. Frames are decoded, and points of runs and files handed on, many at once.
    """
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    # only names and lengths are listed here, at 32 small files a partition: 100,000 files would be 3,000 tasks
    files = spark.read.format("binaryFile").load(path).select("path", "length").coalesce(tasks)
    runs = pa.schema([("path", pa.string()), ("first", pa.int64()), ("bounds", pa.list_(pa.int64()))])

    def walk(batches):
        for b in batches:
            rows = []
            for p, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if size <= split:
                    rows.append((p, 0, None))  # read whole, and walked then
                    continue
                system, name = file_system(p)
                with system.open_input_file(name) as f:
                    first, bounds, number = 0, [], 0

                    def get(at, n, f=f):
                        f.seek(at)
                        return f.read(n)

                    for s, e in frame_bounds(get, size):
                        if bounds and e - bounds[0] > split:
                            rows.append((p, first, bounds))
                            first, bounds = number, []
                        bounds += [s, e]
                        number += 1
                    if bounds:
                        rows.append((p, first, bounds))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], runs.field(k).type) for k in range(3)], schema=runs)

    schema = pa.schema([("path", pa.string()), ("frame", pa.int64()), ("idx", pa.int64()), *[(c, pa.float32()) for c in ("x", "y", "z", "intensity")]])

    def batch(held):
        """One batch of decoded (path, number of the first frame, points, points of each frame)."""
        counts = np.concatenate([c for *_, c in held])
        numbers = np.concatenate([first + np.arange(len(c)) for _, first, _, c in held])
        paths = pa.array([p for p, *_ in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), [len(r) for _, _, r, _ in held])))
        idx = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        xyzi = np.concatenate([r for _, _, r, _ in held]).astype(np.float32)
        return pa.RecordBatch.from_arrays([paths, pa.array(np.repeat(numbers, counts)), pa.array(idx), *map(pa.array, np.ascontiguousarray(xyzi.T))], schema=schema)

    def decoded(batches):
        for b in batches:
            for p, first, bounds in zip(*[c.to_pylist() for c in b.columns], strict=True):
                system, name = file_system(p)
                with system.open_input_file(name) as f:
                    if bounds is None:
                        data = f.read()
                        head, bounds = _begin(data)[1], _all_bounds(data)
                    else:
                        data, head, bounds = None, _begin(f.read(HEADER))[1], list(zip(bounds[::2], bounds[1::2], strict=True))
                    for some in _together(bounds):
                        if data is None:
                            at = some[0][0]
                            f.seek(at)
                            found = frames(f.read(some[-1][1] - at), [(s - at, e - at) for s, e in some], head)
                        else:
                            found = frames(data, some, head)
                        yield (p, first, *found)
                        first += len(some)

    def run(batches):
        held, rows = [], 0
        for d in decoded(batches):
            held.append(d)
            rows += len(d[2])
            if rows >= ROWS:
                yield batch(held)
                held, rows = [], 0
        if held:
            yield batch(held)

    found = files.mapInArrow(walk, "path string, first long, bounds array<long>")
    # by a fixed number: runs are small rows, which adaptive execution would put into a few tasks
    return found.repartition(tasks, "path", "first").mapInArrow(run, "path string, frame long, idx long, x float, y float, z float, intensity float")
