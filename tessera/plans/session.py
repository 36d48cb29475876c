"""A mapping session: bag messages to trajectory, graph, descriptors and map, as named tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import SensorError
from tessera.functions import se3
from tessera.operators import clouds, descriptors, estimation, graphs, odometry
from tessera.operators.scans import number_rows, prefix_products

XYZ = "array<array<double>>"


def _place(bag: DataFrame) -> list[str]:
    """What orders the messages of a bag: offsets count from the beginning of each file."""
    return [c for c in ("path", "offset") if c in bag.columns]


def _information(strength) -> Column:
    return F.array(*[strength if i == j else F.lit(0.0) for i in range(6) for j in range(6)])


class Session:
    """tables: scans (frame, seq, x, y, z), nodes (id, transform), edges, descriptors, points and trajectory.

    Options for matching (max_iterations, max_distance) hold for every match; loops are matched without the distance.
    """

    def __init__(self, spark: SparkSession, voxel: float | None = None, rotation: bool = False, num_rings: int = 20, num_sectors: int = 60, max_range: float = 80.0, loop_threshold: float = 0.15, loop_gap: int = 5, exclusion: int = 50, pool: int = 25, **icp):
        self.spark, self.voxel, self.rotation, self.icp = spark, voxel, rotation, icp
        self.context = {"num_rings": num_rings, "num_sectors": num_sectors}
        self.loops = {"max_range": max_range, "loop_threshold": loop_threshold, "loop_gap": loop_gap, "exclusion": exclusion, "pool": pool}
        self.tables: dict[str, DataFrame] = {}
        self.callbacks: dict[str, list[Callable]] = {}

    def on_topic(self, topic: str):
        """Registers a function of the DataFrame of a topic's messages, called before the scans are processed."""

        def add(f):
            self.callbacks.setdefault(topic, []).append(f)
            return f

        return add

    def scans_of(self, bag: DataFrame, topic: str, key: str) -> DataFrame:
        """frame, timestamp, seq, x, y, z of a topic's messages, in order of file and offset. Frames are numbered by counts of partitions, without their payload."""
        m, at = bag.where(F.col("topic") == topic), _place(bag)
        frame = number_rows(m.select(*at), *at, name="frame")
        p = m.join(frame, at).select("frame", "timestamp", F.from_json(F.get_json_object("data", f"$.{key}"), XYZ).alias("_p"))
        return p.select("frame", "timestamp", F.posexplode("_p").alias("seq", "_q")).select("frame", "timestamp", "seq", *[F.col("_q")[i].alias(c) for i, c in enumerate("xyz")])

    def run(self, bag: DataFrame, topic: str = "/lidar/points", key: str = "xyz", imu_topic: str | None = None, imu_information: float = 10.0, local_map: int | None = None, local_voxel: float = 0.1) -> Session:
        """Odometry over the bag: each scan is matched to the one before, or with local_map to so many before, each reduced by local_voxel.

        The pose is transform @ pose. Edges hold the matched transforms (information 100, or 1 where the match did not converge), inertial factors
        between frames if a topic is named, and loop closures (information 50).
        """
        for name, fs in self.callbacks.items():
            for f in fs:
                f(bag.where(F.col("topic") == name))
        scans = self.scans_of(bag, topic, key)
        one = scans.withColumn("session", F.lit(0))
        path = estimation.scan_odometry(one.select("session", "frame", "seq", "x", "y", "z"), forward=False, world=True, window=local_map or 1, voxel=local_voxel if local_map else None, **self.icp).drop("session").persist()
        self.tables["scans"] = scans
        self.tables["nodes"] = path.select(F.col("frame").alias("id"), F.col("pose").alias("transform"))
        self.tables["trajectory"] = path.select("frame", *[F.col("pose")[i].alias(c) for i, c in ((3, "x"), (7, "y"), (11, "z"))])
        strength = F.when(F.col("converged"), 100.0).otherwise(1.0)
        self.tables["edges"] = path.where("transform is not null").select((F.col("frame") - 1).alias("a"), F.col("frame").alias("b"), "transform", _information(strength).alias("information"))
        if imu_topic:
            self.tables["edges"] = self.tables["edges"].unionByName(self._imu(bag, topic, imu_topic, imu_information))
        self.tables["descriptors"] = descriptors.scan_context(scans, max_range=self.loops["max_range"], **self.context)
        self.tables["edges"] = self.tables["edges"].unionByName(self._loops(scans))
        self._map()
        return self

    def _loops(self, scans: DataFrame) -> DataFrame:
        """An edge for each scan whose nearest earlier place is near enough, old enough and can be matched."""
        inserted = scans.select("frame").distinct().withColumn("position", F.col("frame"))
        near = descriptors.nearest_places(self.tables["descriptors"], inserted, exclusion_window=self.loops["exclusion"], candidate_pool=self.loops["pool"], **self.context)
        near = near.where((F.col("distance") < self.loops["loop_threshold"]) & (F.col("a") - F.col("b") > self.loops["loop_gap"])).select("a", "b").persist()
        xyz = ("seq", "x", "y", "z")
        source = scans.join(near.select(F.col("a").alias("frame"), "b"), "frame").select(F.struct("frame", "b").cast("string").alias("_k"), *xyz)
        target = scans.join(near.select("a", F.col("b").alias("frame")), "frame").select(F.struct("a", "frame").cast("string").alias("_k"), *xyz)
        free = {k: v for k, v in self.icp.items() if k != "max_distance"}
        got = estimation.icp_frames(source, target, by="_k", **free).where("converged")
        named = near.withColumn("_k", F.struct("a", "b").cast("string")).join(got, "_k")
        return named.select(F.col("b").alias("a"), F.col("a").alias("b"), "transform", _information(F.lit(50.0)).alias("information"))

    def _imu(self, bag: DataFrame, topic: str, imu_topic: str, information: float) -> DataFrame:
        rows, at = bag.where(F.col("topic").isin(topic, imu_topic)), _place(bag)
        # an interval is the number of scans up to here, less one: their prefix sum over places and topics alone
        scan = (F.col("topic") == topic).cast("double")
        sums = prefix_products(rows.select(*at, F.array(F.lit(1.0), scan, F.lit(0.0), F.lit(1.0)).alias("_m")), "_m", (), tuple(at), size=2, name="_sum")
        rows, i = rows.join(sums.select(*at, (F.col("_sum")[1] - 1).cast("long").alias("_i")), at), F.col("_i")
        v = lambda k: F.from_json(F.get_json_object("data", f"$.{k}"), "array<double>")
        d = rows.withColumn("interval", F.greatest(i, F.lit(0))).where(F.col("topic") == imu_topic).select("interval", F.col("timestamp").alias("t"), v("accel").alias("_a"), v("gyro").alias("_g"))
        d = d.select("interval", "t", *[F.col("_a")[k].alias(f"a{c}") for k, c in enumerate("xyz")], *[F.col("_g")[k].alias(f"w{c}") for k, c in enumerate("xyz")])
        # the last sample of an interval also begins the next one
        last = d.groupBy("interval").agg(F.max_by(F.struct(*d.columns[1:]), "t").alias("_l")).select((F.col("interval") + 1).alias("interval"), "_l.*").where("interval > 0")
        f = odometry.preintegrate(d.unionByName(last))
        frames = self.tables["nodes"].select((F.col("id") - 1).alias("interval")).where("interval >= 0")
        e = graphs.imu_edges(f.join(frames, "interval").select(F.lit(0).alias("graph"), F.col("interval").alias("a"), (F.col("interval") + 1).alias("b"), "rotation", "position"), information)
        return e.select("a", "b", "transform", "information")

    def _map(self) -> None:
        """The map takes the poses' translation only, unless rotation is asked for."""
        eye = se3.matrix([1, 0, 0, 0, 1, 0, 0, 0, 1])
        t = F.col("transform")
        pose = t if self.rotation else se3.rigid(eye, t[3], t[7], t[11])
        poses = self.tables["nodes"].select(F.col("id").alias("frame"), pose.alias("transform"))
        points = clouds.add_scans(self.tables["scans"].drop("timestamp"), poses)
        self.tables["points"] = points if self.voxel is None else clouds.voxel_downsample(points.drop("frame"), self.voxel).select("x", "y", "z")

    def optimise(self, **options) -> Session:
        nodes = self.tables["nodes"].select(F.lit(0).alias("graph"), "id", F.col("id").alias("seq"), "transform")
        edges = self.tables["edges"].select(F.lit(0).alias("graph"), "a", "b", "transform", "information")
        solved = graphs.optimise(nodes, edges, **options).select("id", "transform").persist()
        self.tables["nodes"] = solved
        self.tables["trajectory"] = solved.select(F.col("id").alias("frame"), *[F.col("transform")[i].alias(c) for i, c in ((3, "x"), (7, "y"), (11, "z"))])
        self._map()
        return self

    def localise(self, bag: DataFrame, map_points: DataFrame, topic: str = "/lidar/points", key: str = "xyz") -> DataFrame:
        """frame and transform of each scan against a fixed map, from the identity."""
        if not map_points.limit(1).count():
            raise SensorError("the map is empty")
        scans = self.scans_of(bag, topic, key)
        return estimation.icp_to_map(scans.select("frame", "seq", "x", "y", "z"), map_points, **self.icp)

    def load_map(self, path: str) -> DataFrame:
        from tessera.sources import text

        return (text.read_pcd if path.endswith(".pcd") else text.read_ply)(self.spark, path)

    def save(self, path: str) -> None:
        """A folder of Parquet tables and one of settings."""
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        meta = json.dumps({"voxel": self.voxel, "rotation": self.rotation, "context": self.context, "loops": self.loops, "icp": self.icp, "tables": sorted(self.tables)})
        self.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Session:
        meta = json.loads(spark.read.text(f"{path}/metadata").first().value)
        out = cls(spark, meta["voxel"], rotation=meta["rotation"], **meta["context"], **meta["loops"], **meta["icp"])
        out.tables = {n: spark.read.parquet(f"{path}/{n}") for n in meta["tables"]}
        return out

    def merge(self, other: Session, loop: tuple) -> Session:
        out = Session(self.spark, self.voxel, rotation=self.rotation, **self.context, **self.loops, **self.icp)
        out.tables = graphs.merge_sessions(self.tables, other.tables, loop)
        return out
