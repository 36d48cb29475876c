"""Place descriptors and retrieval: Scan Context, M2DP densities, image gradients, feature matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera import kernels

TWO_PI = 2 * np.pi


def scan_context(cloud: DataFrame, num_rings: int = 20, num_sectors: int = 60, max_range: float = 80.0, min_z: float | None = None, max_z: float | None = None, frame: str = "frame") -> DataFrame:
    """frame, ring, sector, h: the greatest height of each polar bin; heights below 0 do not show, and bins of height 0 are absent."""
    p = cloud
    if min_z is not None:
        p = p.where(F.col("z") >= min_z)
    if max_z is not None:
        p = p.where(F.col("z") <= max_z)
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    angle = F.atan2("y", "x")
    angle = F.when(angle < 0, angle + TWO_PI).otherwise(angle)
    bin_of = lambda share, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(share * n).cast("int")))
    p = p.withColumn("_r", r).where((F.col("_r") > 0) & (F.col("_r") <= max_range))
    return p.groupBy(frame, bin_of(F.col("_r") / max_range, num_rings).alias("ring"), bin_of(angle / TWO_PI, num_sectors).alias("sector")).agg(F.greatest(F.lit(0.0), F.max("z")).alias("h")).where("h > 0")


def ring_key(context: DataFrame, num_sectors: int = 60, frame: str = "frame") -> DataFrame:
    """frame, ring, mean height over the ring's sectors."""
    return context.groupBy(frame, "ring").agg((F.sum("h") / num_sectors).alias("key"))


def scan_context_distance(context: DataFrame, pairs: DataFrame, num_rings: int = 20, num_sectors: int = 60, frame: str = "frame") -> DataFrame:
    """a, b, distance, shift: the least mean over rings of the cosine distance, over circular shifts of b; the first best shift.

    A ring that is empty on both sides counts 0, one that is empty on one side 1.
    """
    packed = context.groupBy(frame).agg(F.collect_list(F.struct((F.col("ring") * num_sectors + F.col("sector")).cast("int").alias("cell"), F.col("h").cast("double").alias("h"))).alias("bins"))
    side = lambda k: packed.select(F.col(frame).alias(k), F.col("bins.cell").alias(f"_cells_{k}"), F.col("bins.h").alias(f"_heights_{k}"))
    kind = dict(pairs.dtypes)
    # a pair travels once, with the bins of b; those of a meet it where it arrives
    both = pairs.select("a", "b").distinct().join(side("b"), "b", "left").join(side("a"), "a", "left").select("a", "b", *[f"_{c}_{k}" for k in "ab" for c in ("cells", "heights")])

    def dense(cells, heights) -> np.ndarray:
        out = np.zeros((len(cells), num_rings * num_sectors))
        at = np.repeat(np.arange(len(cells)), cells.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        out[at, cells.flatten().to_numpy(zero_copy_only=False)] = heights.flatten().to_numpy(zero_copy_only=False)
        return out.reshape(-1, num_rings, num_sectors)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, PAIRS_HELD):
                t = whole.slice(at, PAIRS_HELD)
                found = kernels.ring_distances(dense(t.column(2), t.column(3)), dense(t.column(4), t.column(5)))
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), *map(pa.array, found)], names=["a", "b", "distance", "shift"])

    return both.mapInArrow(run, f"a {kind['a']}, b {kind['b']}, distance double, shift int")


#: Pairs of scan contexts held as dense arrays at once.
PAIRS_HELD = 64


#: Scans on a side of a block of ring-key comparisons; a key is copied once a block.
KEY_BLOCK = 8000


def nearest_places(context: DataFrame, inserted: DataFrame, num_rings: int = 20, num_sectors: int = 60, exclusion_window: int = 50, candidate_pool: int = 25, frame: str = "frame") -> DataFrame:
    """a, b, distance, shift: of each scan a the nearest b of those inserted more than exclusion_window before it.

    inserted: frame, position (order of insertion from 0). Ring keys are compared in blocks and choose a pool for each scan, whose exact distances decide.
    """
    keys = ring_key(context, num_sectors, frame).groupBy(frame).agg(F.map_from_entries(F.collect_list(F.struct("ring", "key"))).alias("m"))
    every = F.array(*[F.lit(i) for i in range(num_rings)])
    vector = F.transform(every, lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)))
    keys = inserted.join(keys, frame, "left").select(F.col(frame).alias("id"), F.col("position").cast("long").alias("position"), F.coalesce(vector, F.array_repeat(F.lit(0.0), num_rings)).alias("key"), F.floor(F.col("position") / KEY_BLOCK).alias("own"))
    last = keys.agg(F.max("own").alias("top"))
    at = F.concat(F.transform(F.sequence(F.lit(0), F.col("own")), lambda q: F.struct(F.col("own").alias("p"), q.alias("q"))), F.transform(F.sequence(F.col("own"), F.col("top")), lambda p: F.struct(p.alias("p"), F.col("own").alias("q"))))
    blocks = keys.crossJoin(F.broadcast(last)).withColumn("at", F.explode(F.array_distinct(at))).select("at.p", "at.q", "own", "id", "position", "key")
    kind = dict(inserted.dtypes)[frame]

    def pool(t: pd.DataFrame) -> pd.DataFrame:
        p, q = t["p"].iloc[0], t["q"].iloc[0]
        one, two = t[t["own"] == p].sort_values("position"), t[t["own"] == q].sort_values("position")
        if not len(one) or not len(two):
            return pd.DataFrame([], columns=["a", "b", "position", "l1"])
        x, y = np.stack(one["key"]), np.ascontiguousarray(np.stack(two["key"]).T)
        ids, places = two["id"].to_numpy(), two["position"].to_numpy()  # in order, so what is far enough before a scan comes first
        ends = np.searchsorted(places, one["position"].to_numpy() - exclusion_window)
        far, off, out = np.empty(len(two)), np.empty(len(two)), []
        for i, (a, end) in enumerate(zip(one["id"], ends, strict=True)):
            if not end:
                continue
            total, part = far[:end], off[:end]
            total[:] = 0
            for d in range(num_rings):
                np.subtract(y[d, :end], x[i, d], out=part)
                np.abs(part, out=part)
                total += part
            near = np.flatnonzero(total <= np.partition(total, candidate_pool - 1)[candidate_pool - 1] + 1e-8) if end > candidate_pool else np.arange(end)
            l1 = np.round(total[near], 9)  # ties in the order of insertion, whatever the order of the sum
            best = np.lexsort((near, l1))[:candidate_pool]
            out += zip([a] * len(best), ids[near[best]], places[near[best]], l1[best], strict=True)
        return pd.DataFrame(out, columns=["a", "b", "position", "l1"])

    found = blocks.groupBy("p", "q").applyInPandas(pool, f"a {kind}, b {kind}, position long, l1 double")
    turn = F.row_number().over(Window.partitionBy("a").orderBy("l1", "position"))
    pairs = found.withColumn("turn", turn).where(F.col("turn") <= candidate_pool).select("a", "b", "position")
    exact = scan_context_distance(context, pairs, num_rings, num_sectors, frame).join(pairs, ["a", "b"])
    return exact.groupBy("a").agg(F.min(F.struct("distance", "position", "b", "shift")).alias("m")).select("a", "m.b", "m.distance", "m.shift")


def scan_context_query(context: DataFrame, query_frame, inserted: DataFrame, num_rings: int = 20, num_sectors: int = 60, exclusion_window: int = 50, candidate_pool: int = 10, top_k: int = 1, frame: str = "frame") -> DataFrame:
    """b, distance, shift of the top_k nearest earlier scans.

    inserted: frame, position (order of insertion). The last exclusion_window are left out; ring keys choose a pool, whose exact distances decide.
    """
    last = inserted.agg(F.max("position")).first()[0]
    eligible = inserted.where((F.col("position") <= (last if last is not None else -1) - exclusion_window) & (F.col(frame) != query_frame))
    keys = ring_key(context, num_sectors, frame)
    own = keys.where(F.col(frame) == query_frame).select("ring", F.col("key").alias("own"))
    full = eligible.select(frame, "position").withColumn("ring", F.explode(F.sequence(F.lit(0), F.lit(num_rings - 1)))).join(keys, [frame, "ring"], "left").join(F.broadcast(own), "ring", "left")
    near = full.groupBy(frame, "position").agg(F.sum(F.abs(F.coalesce("key", F.lit(0.0)) - F.coalesce("own", F.lit(0.0)))).alias("l1")).orderBy("l1", "position").limit(candidate_pool)
    d = scan_context_distance(context, near.select(F.lit(query_frame).alias("a"), F.col(frame).alias("b")), num_rings, num_sectors, frame)
    return d.join(near.select(F.col(frame).alias("b"), "position"), "b").orderBy("distance", "position").limit(top_k).select("b", "distance", "shift")


def cosine_distance(a: Column, b: Column) -> Column:
    """Of two arrays: 0 if both are zero, 1 if one is."""
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na == 0) & (nb == 0), 0.0).when((na == 0) | (nb == 0), 1.0).otherwise(1 - F.try_divide(dot(a, b), na * nb))


#: Descriptors of each side in a block of pairs; numbers of differences of pairs that are held at once.
BLOCK_ROWS, HELD = 2000, 1_000_000


def _in_blocks(left: DataFrame, right: DataFrame, compare, schema: StructType) -> DataFrame:
    """compare(left rows, right rows) -> rows, for all blocks of BLOCK_ROWS of either side, dealt by id: every pair meets in one block, and no side is broadcast or held whole."""
    sizes = [max(1, -(-d.count() // BLOCK_ROWS)) for d in (left, right)]
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = left.withColumn("_p", part(sizes[0])).withColumn("_q", every(sizes[1]))
    two = right.withColumn("_q", part(sizes[1])).withColumn("_p", every(sizes[0]))
    two = two.toDF(*[f"r_{c}" for c in two.columns])  # the sides may share an ancestor, and so share no name

    arrow = left.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        return pa.table(compare(x, y.rename_columns([c[2:] for c in y.column_names])), schema=arrow) if x.num_rows and y.num_rows else arrow.empty_table()

    return one.groupBy("_p", "_q").cogroup(two.groupBy("r__p", "r__q")).applyInArrow(run, schema)


def _matrix(t: pa.Table) -> np.ndarray:
    return t.column("descriptor").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)


def _pieces(rows: int, others: int, width: int):
    """Slices of rows so that HELD numbers, pairs times the width of a descriptor, or one row are held."""
    step = max(1, HELD // max(others * width, 1))
    return [slice(at, at + step) for at in range(0, rows, step)]


def nearest_descriptors(database: DataFrame, queries: DataFrame, exclusion_window: int = 0, top_k: int = 1) -> DataFrame:
    """query, id, distance, rank. database, queries: id, position, descriptor of one length.

    Exhaustive, in blocks, over the rows inserted more than exclusion_window before the query; ties to the earlier. Rows without a descriptor take no part.
    """
    kinds = {f.name: f.dataType for f in database.schema.fields} | {"query": queries.schema["id"].dataType}
    schema = StructType([StructField(c, kinds[c]) for c in ("query", "id", "position")] + [StructField("distance", DoubleType())])

    def compare(x: pa.Table, y: pa.Table):
        base, asked = _matrix(x), _matrix(y)
        at, own = x.column("position").to_numpy(), y.column("position").to_numpy()
        size, names = np.sqrt((base * base).sum(axis=1)), [[], [], []]
        for part in _pieces(len(asked), len(base), base.shape[1]):
            q = asked[part]
            norm = np.sqrt((q * q).sum(axis=1))
            dot = (q[:, None, :] * base[None, :, :]).sum(axis=2)
            with np.errstate(divide="ignore", invalid="ignore"):
                d = np.where((norm == 0)[:, None] & (size == 0), 0.0, np.where((norm == 0)[:, None] | (size == 0), 1.0, 1 - dot / (norm[:, None] * size)))
            for i, row in enumerate(d):
                good = np.flatnonzero(at < own[part.start + i] - exclusion_window)
                best = good[np.lexsort((at[good], row[good]))[:top_k]]
                names[0] += [part.start + i] * len(best)
                names[1] += best.tolist()
                names[2] += row[best].tolist()
        there = pa.array(names[1], pa.int64())
        return [y.column("id").take(pa.array(names[0], pa.int64())), x.column("id").take(there), x.column("position").take(there), pa.array(names[2], pa.float64())]

    there = lambda d: d.where(F.col("descriptor").isNotNull()).select("id", "position", "descriptor")
    found = _in_blocks(there(database), there(queries), compare, schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "position"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top_k).select("query", "id", "distance", "rank")


def match_features(left: DataFrame, right: DataFrame, ratio: float = 0.75) -> DataFrame:
    """a, b, distance: Lowe's ratio test over Euclidean distances; zero descriptors and lone candidates do not match. Not mutual.

    left, right: id, descriptor, the keypoints of one image each. A block gives each left row its nearest and the nearest of another id; blocks are put together by row.
    """
    kinds = {"a": left.schema["id"].dataType, "b": right.schema["id"].dataType}
    schema = StructType([StructField("a", kinds["a"]), StructField("d", DoubleType()), StructField("b", kinds["b"])])

    def compare(x: pa.Table, y: pa.Table):
        one, two = _matrix(x), _matrix(y)
        order = np.argsort(np.array(y.column("id").to_pylist(), dtype=object), kind="stable")
        code = np.unique(np.array(y.column("id").to_pylist(), dtype=object), return_inverse=True)[1]
        two, code, rows = two[order], code[order], [[], [], []]
        for part in _pieces(len(one), len(two), two.shape[1]):
            gap = one[part][:, None, :] - two[None, :, :]
            for i, row in enumerate(np.sqrt((gap * gap).sum(axis=2))):
                first = int(np.argmin(row))
                others = np.where(code == code[first], np.inf, row)
                for k in (first, int(np.argmin(others))):
                    if k == first or np.isfinite(others[k]):
                        rows[0].append(part.start + i)
                        rows[1].append(float(row[k]))
                        rows[2].append(int(order[k]))
        return [x.column("id").take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.float64()), y.column("id").take(pa.array(rows[2], pa.int64()))]

    solid = lambda d: d.where(F.exists("descriptor", lambda v: v != 0)).select("id", "descriptor")
    near = _in_blocks(solid(left), solid(right), compare, schema).select("a", F.struct("d", "b").alias("s"))
    both = near.groupBy("a").agg(F.min("s").alias("m"), F.collect_set("s").alias("_all"))  # two rows a block of the right side
    second = both.select("a", "m", F.array_min(F.transform(F.filter("_all", lambda s: s.b != F.col("m.b")), lambda s: s.d)).alias("d2")).where("d2 is not null")
    ok = F.when(F.col("d2") <= 1e-12, F.lit(1.0)).otherwise(F.try_divide(F.col("m.d"), F.col("d2"))) < ratio
    return second.where(ok).select("a", F.col("m.b").alias("b"), F.col("m.d").alias("distance"))


def m2dp(cloud: DataFrame, num_azimuth: int = 4, num_elevation: int = 16, num_rings: int = 4, num_sectors: int = 16, frame: str = "frame") -> DataFrame:
    """frame, descriptor: first left and right singular vectors of the polar point densities on planes of many directions. Signs are free."""
    from tessera.kernels import m2dp_descriptor

    def run(t: pd.DataFrame) -> pd.DataFrame:
        d = m2dp_descriptor(t[["x", "y", "z"]].to_numpy(float), num_azimuth, num_elevation, num_rings, num_sectors)
        return pd.DataFrame({frame: [t[frame].iloc[0]], "descriptor": [d.tolist()]})

    return cloud.select(frame, "x", "y", "z").groupBy(frame).applyInPandas(run, f"{frame} {dict(cloud.dtypes)[frame]}, descriptor array<double>")


def image_descriptors(pixels: DataFrame, grid=(4, 4), bins: int = 8, image: str = "img") -> DataFrame:
    """image, descriptor: gradient histograms of grid cells, weighted by magnitude, with norm 1. pixels: img, row, col, v."""
    from tessera.kernels import image_descriptor, to_image

    def run(t: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({image: [t[image].iloc[0]], "descriptor": [image_descriptor(to_image(t), grid, bins).tolist()]})

    return pixels.select(image, "row", "col", "v").groupBy(image).applyInPandas(run, f"{image} {dict(pixels.dtypes)[image]}, descriptor array<double>")
