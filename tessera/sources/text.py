"""Text formats: PCD and PLY clouds, pose files, NMEA logs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.errors import SensorError
from tessera.functions.nmea import parse_nmea
from tessera.shared import file_system, kept

POSE = "timestamp double, x double, y double, z double, qw double, qx double, qy double, qz double"


#: Headers of so many files are broadcast; those of more are joined by path.
SMALL = 100_000


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line, value: lines numbered from 0 in each file, which is read in splits. A split's own rows are counted, and counts of the splits before are added."""
    t = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_id"), F.rtrim("value", F.lit("\r")).alias("value"))
    t = t.withColumnsRenamed({"file_path": "path", "file_block_start": "_block"})
    counts = t.groupBy("path", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("path", "_block", "_first", before.alias("_before"))
    return t.join(F.broadcast(counts), ["path", "_block"]).select("path", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line"), "value")  # a row a split


def _pcd_layout(head: list[str]) -> tuple[list[str] | None, int | None]:
    """(names of columns, None for a binary file; rows, if the header says)."""
    if head[-1].split()[1:2] != ["ascii"]:
        return None, None
    return next((h.split()[1:] for h in head if h.startswith("fields")), []), None


def _ply_layout(head: list[str]) -> tuple[list[str] | None, int | None]:
    if not any(h.startswith("format ascii") for h in head):
        return None, None
    names, count, vertex = [], 0, False
    for h in head:
        w = h.split()
        if w[:1] == ["element"]:
            vertex = w[1] == "vertex"
            count = int(w[2]) if vertex else count
        elif w[:1] == ["property"] and vertex:
            names.append({"red": "r", "green": "g", "blue": "b"}.get(w[-1], w[-1]))
    return names, count


def _read(spark: SparkSession, path: str, end: str, layout, with_path: bool) -> DataFrame:
    """The points of text clouds. Each file's header, of any length, says how its lines are read."""
    lines = _lines(spark, path)
    last = lines.where(F.lower(F.trim("value")).startswith(end)).groupBy("path").agg(F.min("line").alias("_end"))
    heads = lines.join(last, "path").where("line <= _end").groupBy("path").agg(F.max("line").alias("_end"), F.array_sort(F.collect_list(F.struct("line", F.lower(F.trim("value")).alias("value")))).alias("_head"))

    def run(batches):
        for b in batches:
            found = [layout([r["value"] for r in head]) for head in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([n for n, _ in found], pa.list_(pa.string())), pa.array([c for _, c in found], pa.int64())], names=["path", "_end", "_names", "_count"])

    found = kept(heads.mapInArrow(run, "path string, _end long, _names array<string>, _count long"))
    coloured = F.forall(F.array(*map(F.lit, "rgb")), lambda c: F.array_contains("_names", c))
    files, (headed, read, colours) = lines.select("path").distinct().count(), found.agg(F.count("*"), F.count("_names"), F.coalesce(F.every(coloured), F.lit(False))).first()
    if headed < files:
        raise SensorError("no end of the header")
    if read < headed:
        raise SensorError("only ASCII clouds are read")
    if files > 1 and not with_path:
        raise SensorError("several files: with_path keeps them apart")
    found = F.broadcast(found) if headed <= SMALL else found
    body = lines.join(found, "path").withColumn("seq", F.col("line") - F.col("_end") - 1).where((F.col("seq") >= 0) & (F.trim("value") != "") & (F.col("_count").isNull() | (F.col("seq") < F.col("_count"))))
    words = F.split(F.trim("value"), r"\s+")
    number = lambda c: F.get(words, (F.array_position("_names", c) - 1).cast("int")).cast("double")
    columns = [number(c).alias(c) for c in "xyz"] + [number(c).cast("short").alias(c) for c in "rgb" if colours]
    return body.select(*["path"] * with_path, "seq", *columns)


def read_pcd(spark: SparkSession, path: str, with_path: bool = False) -> DataFrame:
    """[path,] seq, x, y, z [, r, g, b if all files have them] of ASCII files; a binary one raises. Blank lines count, but give no point."""
    return _read(spark, path, "data", _pcd_layout, with_path)


def read_ply(spark: SparkSession, path: str, with_path: bool = False) -> DataFrame:
    """[path,] seq, x, y, z [, r, g, b if all files have them] of the vertices of ASCII files."""
    return _read(spark, path, "end_header", _ply_layout, with_path)


def _body(cloud: DataFrame) -> DataFrame:
    colours = all(c in cloud.columns for c in "rgb")
    fmt = "%.6f %.6f %.6f" + (" %d %d %d" if colours else "")
    cols = ["x", "y", "z", *("rgb" if colours else "")]
    return cloud.orderBy("seq").select(F.format_string(fmt, *cols).alias("value"))


def _write(path: str, head: list[str], body: DataFrame) -> None:
    system, name = file_system(path)
    with system.open_output_stream(name) as f:  # one file for exchange: its rows stream through the driver
        f.write(("\n".join(head) + "\n").encode())
        for r in body.toLocalIterator():
            f.write((r.value + "\n").encode())


def write_pcd(cloud: DataFrame, path: str) -> None:
    n, c = cloud.count(), all(k in cloud.columns for k in "rgb")
    f = "x y z r g b" if c else "x y z"
    k = 6 if c else 3
    head = ["# .PCD v0.7 - Point Cloud Data file format", "VERSION 0.7", f"FIELDS {f}", "SIZE 4 4 4" + " 1 1 1" * c, "TYPE F F F" + " U U U" * c, "COUNT" + " 1" * k, f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", "DATA ascii"]
    _write(path, head, _body(cloud))


def write_ply(cloud: DataFrame, path: str) -> None:
    n, c = cloud.count(), all(k in cloud.columns for k in "rgb")
    head = ["ply", "format ascii 1.0", f"element vertex {n}", *[f"property float {k}" for k in "xyz"], *([f"property uchar {k}" for k in ("red", "green", "blue")] if c else []), "end_header"]
    _write(path, head, _body(cloud))


def read_poses_csv(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    """(poses with seq, frame duration); the duration stands in a comment line, 0.1 without one."""
    note = spark.read.text(path).where(F.startswith("value", F.lit("# frame_duration="))).first()
    poses = spark.read.csv(path, schema=POSE, header=True, comment="#")
    return poses, float(note.value.split("=")[1]) if note else 0.1


def write_poses_csv(poses: DataFrame, path: str, duration: float = 0.1) -> None:
    cols = [c.split()[0] for c in POSE.split(", ")]
    with open(path, "w") as f:
        f.write(f"# frame_duration={duration}\n" + ",".join(cols) + "\n")
        for r in poses.orderBy("timestamp").select(*cols).toLocalIterator():
            f.write(",".join(repr(float(v)) for v in r) + "\n")


def read_poses_yaml(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    import yaml

    with open(path) as f:
        d = yaml.safe_load(f) or {}
    rows = [(float(p["timestamp"]), *map(float, p["translation"]), *map(float, p.get("rotation", (1, 0, 0, 0)))) for p in d.get("poses", [])]
    return spark.createDataFrame(rows, POSE), float(d.get("frame_duration", 0.1))


def write_poses_yaml(poses: DataFrame, path: str, duration: float = 0.1) -> None:
    import yaml

    rows = [{"timestamp": r.timestamp, "translation": [r.x, r.y, r.z], "rotation": [r.qw, r.qx, r.qy, r.qz]} for r in poses.orderBy("timestamp").toLocalIterator()]
    with open(path, "w") as f:
        yaml.safe_dump({"frame_duration": duration, "poses": rows}, f)


def read_nmea(spark: SparkSession, path: str) -> DataFrame:
    return parse_nmea(spark.read.text(path))
