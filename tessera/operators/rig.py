"""A sensor rig: a small table of sensors, kept on the driver and broadcast."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import kernels
from tessera.errors import CalibrationError, SensorNotFoundError
from tessera.functions import camera, se3

SENSOR = "name string, type string, coordinate_system string, transform array<double>, time_offset double, fx double, fy double, cx double, cy double, width int, height int, distortion array<double>"
KNOWN = ("type", "coordinate_system", "extrinsics", "intrinsics")


@dataclass
class Sensor:
    name: str
    type: str
    coordinate_system: str = "FLU"
    translation: tuple = (0.0, 0.0, 0.0)
    rotation: tuple = (1.0, 0.0, 0.0, 0.0)
    time_offset: float = 0.0
    intrinsics: dict = field(default_factory=dict)
    parameters: dict = field(default_factory=dict)  # blocks of other kinds of sensor, by name

    @property
    def transform(self) -> np.ndarray:
        return kernels.rigid(kernels.quat_to_matrix(self.rotation), self.translation)


class Rig:
    def __init__(self, sensors=()):
        self.sensors = {s.name: s for s in sensors}

    @classmethod
    def from_yaml(cls, path: str) -> Rig:
        import yaml

        with open(path) as f:
            data = (yaml.safe_load(f) or {}).get("sensors", {})
        out = cls()
        for name, s in data.items():
            x = s.get("extrinsics", {})
            r = x.get("rotation", {})
            q = r.get("quaternion", (1.0, 0.0, 0.0, 0.0)) if isinstance(r, dict) else r
            out.sensors[name] = Sensor(name, s.get("type", ""), s.get("coordinate_system", "FLU"), tuple(x.get("translation", (0.0, 0.0, 0.0))), tuple(q), float(x.get("time_offset_sec", 0.0)), dict(s.get("intrinsics") or {}), {k: v for k, v in s.items() if k not in KNOWN})
        out.validate()
        return out

    def to_yaml(self, path: str) -> None:
        import yaml

        data = {}
        for s in self.sensors.values():
            data[s.name] = {"type": s.type, "coordinate_system": s.coordinate_system, "extrinsics": {"translation": list(map(float, s.translation)), "rotation": {"quaternion": list(map(float, s.rotation))}}}
            if s.time_offset:
                data[s.name]["extrinsics"]["time_offset_sec"] = float(s.time_offset)
            if s.intrinsics:
                data[s.name]["intrinsics"] = s.intrinsics
            data[s.name] |= s.parameters
        with open(path, "w") as f:
            yaml.safe_dump({"sensors": data}, f, sort_keys=False)

    def __getitem__(self, name: str) -> Sensor:
        if name not in self.sensors:
            raise SensorNotFoundError(name)
        return self.sensors[name]

    def names(self) -> list[str]:
        return sorted(self.sensors)

    def validate(self) -> None:
        """A camera needs intrinsics with a positive fx, fy, width and height."""
        for s in self.sensors.values():
            if s.type == "camera" and not all(float(s.intrinsics.get(k, 0) or 0) > 0 for k in ("fx", "fy", "width", "height")):
                raise CalibrationError(f"camera {s.name!r} lacks sound intrinsics")

    def transform_between(self, source: str, target: str) -> np.ndarray:
        return np.linalg.inv(self[target].transform) @ self[source].transform

    def time_offset_between(self, source: str, target: str) -> float:
        return self[target].time_offset - self[source].time_offset

    def table(self, spark: SparkSession) -> DataFrame:
        rows = []
        for s in self.sensors.values():
            k = s.intrinsics
            rows.append((s.name, s.type, s.coordinate_system, s.transform.ravel().tolist(), float(s.time_offset), *[float(k[c]) if c in k else None for c in ("fx", "fy", "cx", "cy")], *[int(k[c]) if c in k else None for c in ("width", "height")], [float(v) for v in k.get("distortion_coefficients", [])] or None))
        return spark.createDataFrame(rows, SENSOR)

    def project(self, points: DataFrame, lidar: str, cam: str) -> DataFrame:
        """points with u, v, valid and depth in the named camera's image."""
        k = self[cam].intrinsics
        if not k:
            raise CalibrationError(f"camera {cam!r} has no intrinsics")
        m = se3.matrix(self.transform_between(lidar, cam).tolist())
        return project(points, m, camera.camera_matrix(k["fx"], k["fy"], k["cx"], k["cy"]), int(k["width"]), int(k["height"]))

    def colour(self, points: DataFrame, lidar: str, cam: str, pixels: DataFrame) -> DataFrame:
        from tessera.operators.rasters import colour_points

        k = self[cam].intrinsics
        return colour_points(self.project(points, lidar, cam), pixels, int(k["width"]), int(k["height"]))


def project(points: DataFrame, lidar_to_camera: Column, k: list[float], width: int, height: int) -> DataFrame:
    """points with u, v, valid, depth: strictly before the camera and inside the image, or (0, 0, false)."""
    p = points.withColumn("_c", se3.apply_to_point(lidar_to_camera, F.col("x"), F.col("y"), F.col("z")))
    p = p.withColumn("_i", camera.in_image(k, F.col("_c.x"), F.col("_c.y"), F.col("_c.z"), width, height))
    return p.select(*points.columns, "_i.u", "_i.v", "_i.valid", F.col("_c.z").alias("depth"))


def pair_matrices(sensors: DataFrame) -> DataFrame:
    """source, target, transform (16), time_offset for every ordered pair of a small sensor table."""
    a = sensors.select(F.col("name").alias("source"), F.col("transform").alias("_s"), F.col("time_offset").alias("_so"))
    b = sensors.select(F.col("name").alias("target"), F.col("transform").alias("_t"), F.col("time_offset").alias("_to"))
    return F.broadcast(a).crossJoin(b).where("source <> target").select("source", "target", se3.sensor_to_sensor(F.col("_s"), F.col("_t")).alias("transform"), (F.col("_to") - F.col("_so")).alias("time_offset"))
