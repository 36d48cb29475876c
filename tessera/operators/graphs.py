"""Pose graphs: cost as joins, optimisation graph by graph, sliding windows, session merge."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera import kernels
from tessera.errors import SensorError
from tessera.functions import se3
from tessera.operators.large_graphs import optimise_large
from tessera.shared import kept


def check_graph(nodes: DataFrame, edges: DataFrame, by: str = "graph") -> None:
    """Raises on repeated node ids and on edges whose ends are no nodes."""
    if nodes.groupBy(by, "id").count().where("count > 1").limit(1).count():
        raise SensorError("a node id is repeated")
    ends = edges.select(by, F.explode(F.array("a", "b")).alias("id"))
    if ends.join(nodes.select(by, "id"), [by, "id"], "left_anti").limit(1).count():
        raise SensorError("an edge ends at no node")


def imu_edges(factors: DataFrame, weight: float = 10.0) -> DataFrame:
    """Edges of preintegrated factors (graph, a, b, rotation, position): the relative pose with information weight * I; the velocity is not used."""
    info = F.array(*[F.lit(weight if i == j else 0.0) for i in range(6) for j in range(6)])
    return factors.select("graph", "a", "b", se3.rigid(F.col("rotation"), F.col("position")[0], F.col("position")[1], F.col("position")[2]).alias("transform"), info.alias("information"))


def graph_errors(nodes: DataFrame, edges: DataFrame, by: str = "graph") -> DataFrame:
    """by, a, b, e (6), cost: half e' W e of every edge, in Arrow batches. nodes: by, id, transform (16); edges: by, a, b, transform, information (36)."""
    one = nodes.select(by, F.col("id").alias("a"), F.col("transform").alias("_ta"))
    two = nodes.select(by, F.col("id").alias("b"), F.col("transform").alias("_tb"))
    rel = edges.join(one, [by, "a"]).join(two, [by, "b"]).select(by, "a", "b", "transform", "_ta", "_tb", "information")
    kinds = {f.name: f.dataType.simpleString() for f in rel.schema}

    def run(batches):
        for t in batches:
            if not t.num_rows:
                continue
            square = lambda c, n, t=t: t.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n, n)
            m = np.linalg.inv(square("transform", 4)) @ np.linalg.inv(square("_ta", 4)) @ square("_tb", 4)
            e = np.concatenate((m[:, :3, 3], kernels.log_so3_many(m[:, :3, :3])), axis=1)
            cost = 0.5 * np.einsum("mi,mij,mj->m", e, square("information", 6), e)
            lists = pa.ListArray.from_arrays(np.arange(len(e) + 1, dtype=np.int32) * 6, e.ravel())
            yield pa.RecordBatch.from_arrays([t.column(by), t.column("a"), t.column("b"), lists, pa.array(cost)], names=[by, "a", "b", "e", "cost"])

    return rel.mapInArrow(run, f"{by} {kinds[by]}, a {kinds['a']}, b {kinds['b']}, e array<double>, cost double")


def graph_cost(nodes: DataFrame, edges: DataFrame, by: str = "graph") -> DataFrame:
    return graph_errors(nodes, edges, by).groupBy(by).agg(F.sum("cost").alias("cost"), F.count("*").alias("edges"))


#: Poses of a graph that one task solves; poses of the graphs that are solved side by side; poses of a graph among them.
TASK_POSES, BUCKET_POSES, SIDE_POSES = 20_000, 5_000, 60


def _side_by_side(nodes: DataFrame, edges: DataFrame, by: str, poses: int, solve, schema: str) -> DataFrame:
    """solve(_Bucket) -> table, for graphs dealt over buckets of about BUCKET_POSES poses, not one call a graph."""
    bucket = F.pmod(F.xxhash64(by), F.lit(max(1, -(-poses // BUCKET_POSES)))).alias("_bucket")
    one = nodes.select(bucket, F.col(by).alias("_g"), "id", "seq", "transform")
    two = edges.select(bucket, F.col(by).alias("_g"), "a", "b", "transform", "information")
    two = two.toDF(*[f"_e{c}" for c in two.columns])  # the sides may share an ancestor, and so share no name
    arrow = to_arrow_schema(nodes.sparkSession.createDataFrame([], schema).schema)

    def run(n: pa.Table, e: pa.Table) -> pa.Table:
        return solve(_Bucket(n, e.rename_columns([c[2:] for c in e.column_names]), arrow)) if n.num_rows else arrow.empty_table()

    return one.groupBy("_bucket").cogroup(two.groupBy("_e_bucket")).applyInArrow(run, schema)


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Numbers from 0 of the values of columns of one type; nulls are a value."""
    values = [v for c in columns for v in c.chunks]
    whole = pa.chunked_array([v.cast(columns[0].type) for v in values], columns[0].type)
    if pa.types.is_nested(whole.type):
        whole = pa.chunked_array([[repr(v) for v in whole.to_pylist()]], pa.string())
    codes = whole.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() if len(whole) else np.zeros(0, int)
    return np.split(codes.astype(np.int64), np.cumsum([len(c) for c in columns])[:-1])


def _square(c: pa.ChunkedArray, n: int) -> np.ndarray:
    return c.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n, n)


class _Bucket:
    """Graphs of a task, rows ordered by graph, seq and id: g, at (places in the graph), x; edges: eg, i, j (places, -1 where there is no such pose), measured, weight."""

    def __init__(self, nodes: pa.Table, edges: pa.Table, schema: pa.Schema):
        self.schema = schema
        g, self.eg = _codes(nodes.column("_g"), edges.column("_g"))
        ids, a, b = _codes(nodes.column("id"), edges.column("a"), edges.column("b"))
        order = pd.DataFrame({"g": g, "seq": nodes.column("seq").to_pandas(), "id": nodes.column("id").to_pandas()}).sort_values(["g", "seq", "id"]).index.to_numpy()
        self.nodes, self.g, self.x = nodes.take(pa.array(order)), g[order], _square(nodes.column("transform"), 4)[order]
        self.measured, self.weight = _square(edges.column("transform"), 4), _square(edges.column("information"), 6)
        self.graphs = int(max(g.max(), self.eg.max(initial=-1))) + 1
        self.count = np.bincount(self.g, minlength=self.graphs)
        self.starts = np.concatenate(([0], np.cumsum(self.count)[:-1]))
        self.at = np.arange(len(self.g)) - self.starts[self.g]
        span = int(max(ids.max(), a.max(initial=-1), b.max(initial=-1))) + 1
        keys = self.g * span + ids[order]
        sort = np.argsort(keys, kind="stable")
        self.repeated = np.zeros(self.graphs, bool)
        self.repeated[self.g[sort[1:]][np.diff(keys[sort]) == 0]] = True

        def places(ends):
            k = self.eg * span + ends
            found = sort[np.minimum(np.searchsorted(keys[sort], k), len(sort) - 1)]
            return np.where(keys[found] == k, self.at[found], -1)

        self.i, self.j = places(a), places(b)

    def padded(self, graphs: np.ndarray) -> np.ndarray:
        out = np.tile(np.eye(4), (len(graphs), int(self.count[graphs].max(initial=1)), 1, 1))
        for k, g in enumerate(graphs):
            out[k, : self.count[g]] = self.x[self.starts[g] : self.starts[g] + self.count[g]]
        return out

    def table(self, rows: np.ndarray, x: np.ndarray, *columns) -> pa.Table:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * 16), pa.array(np.ascontiguousarray(x).ravel()))
        own = self.nodes.take(pa.array(rows))
        return pa.table([own.column("_g"), own.column("id"), lists, *columns], schema=self.schema)


def optimise(nodes: DataFrame, edges: DataFrame, by: str = "graph", **options) -> DataFrame:
    """by, id, transform, cost, converged. The node with the least seq is fixed; of equal seq the least id.

    Graphs of up to SIDE_POSES poses are solved many at a time, those of up to TASK_POSES one after the other, in tasks side by side; larger ones block by block, see large_graphs.
    """
    kinds = dict(nodes.dtypes)

    def solve(t: _Bucket) -> pa.Table:
        x, cost, ok, keep = t.x.copy(), np.zeros(t.graphs), np.zeros(t.graphs, bool), np.ones(len(t.g), bool)
        if ((t.i < 0) | (t.j < 0))[t.count[t.eg] > 0].any():
            raise KeyError("an edge ends at no node")
        edges_of = np.argsort(t.eg, kind="stable")
        bounds = np.searchsorted(t.eg[edges_of], np.arange(t.graphs + 1))
        plain = ~t.repeated & (t.count <= SIDE_POSES) & (t.count > 0)
        for g in np.flatnonzero(~plain & (t.count > 0)):
            own, e = np.arange(t.starts[g], t.starts[g] + t.count[g]), edges_of[bounds[g] : bounds[g + 1]]
            names = np.arange(t.count[g])
            if t.repeated[g]:  # a name's first place, its last pose
                named = pd.Series(t.nodes.column("id").take(pa.array(own)).to_pylist(), dtype=object)
                first = named.map(dict(reversed(list(zip(named, names, strict=True))))).to_numpy().astype(int)
                keep[own[first != names]] = False
                names = first
            poses: dict = {}
            for k, m in zip(names, t.x[own], strict=True):
                poses[int(k)] = m
            links = [(int(names[a]), int(names[b]), m, w) for a, b, m, w in zip(t.i[e], t.j[e], t.measured[e], t.weight[e], strict=True)]
            found, cost[g], _, ok[g] = kernels.optimise_graph(poses, links, **options)
            x[own[list(found)]] = list(found.values())
        sized = np.flatnonzero(plain)[np.argsort(t.count[plain], kind="stable")]
        for at in range(0, len(sized), 200):  # of much the same size
            some = sized[at : at + 200]
            of = np.full(t.graphs, -1)
            of[some] = np.arange(len(some))
            e = np.flatnonzero(of[t.eg] >= 0)
            found, cost[some], ok[some] = kernels.optimise_many(t.padded(some), t.count[some], t.i[e], t.j[e], t.measured[e], t.weight[e], of[t.eg[e]], np.zeros(len(e), bool), **options)
            rows = np.flatnonzero(of[t.g] >= 0)
            x[rows] = found[of[t.g[rows]], t.at[rows]]
        rows = np.flatnonzero(keep)
        return t.table(rows, x[rows], cost[t.g[rows]], ok[t.g[rows]])

    sizes = kept(nodes.groupBy(F.col(by).alias("_by")).count())
    large = kept(sizes.where(F.col("count") > TASK_POSES).select("_by"))  # poses / TASK_POSES rows at most
    some = large.limit(1).count() > 0
    split = (lambda df, how: df.join(F.broadcast(large), F.col(by).eqNullSafe(F.col("_by")), how)) if some else lambda df, how: df
    poses = sizes.agg(F.sum("count")).first()[0] or 0
    out = _side_by_side(split(nodes, "left_anti"), split(edges, "left_anti"), by, poses, solve, f"{by} {kinds[by]}, id {kinds['id']}, transform array<double>, cost double, converged boolean")
    return out.unionByName(optimise_large(split(nodes, "left_semi"), split(edges, "left_semi"), by, **options)) if some else out


class Smoother:
    """A sliding window over one chain: the oldest node leaves by turning its edges into priors on its neighbours."""

    def __init__(self, window: int, **options):
        self.window, self.options = window, options
        self.poses: dict = {}
        self.edges: list = []
        self.priors: list = []
        self.frozen: dict = {}

    def add(self, node, pose, edges=()):
        self.poses[node] = np.array(pose, float)
        self.edges += list(edges)
        while len(self.poses) > self.window:
            self._leave(next(iter(self.poses)))

    def _leave(self, old) -> None:
        pose = self.poses.pop(old)
        self.frozen[old] = pose
        self.priors = [p for p in self.priors if p[0] != old]
        stay = []
        for i, j, m, w in self.edges:
            if i == old and j in self.poses:
                self.priors.append((j, pose @ m, w))
            elif j == old and i in self.poses:
                self.priors.append((i, pose @ np.linalg.inv(m), w))
            elif old not in (i, j):
                stay.append((i, j, m, w))
        self.edges = stay

    def optimise(self):
        self.poses, cost, n, ok = kernels.optimise_graph(self.poses, self.edges, self.priors, **self.options)
        return cost, n, ok


def smooth(nodes: DataFrame, edges: DataFrame, window: int, by: str = "graph", **options) -> DataFrame:
    """by, id, transform: nodes in order of seq through a sliding window, optimised after each.

    Graphs of a task step together; a window beyond SIDE_POSES poses, repeated ids and edges that reach beyond the window go through a Smoother each.
    """
    kinds = dict(nodes.dtypes)

    def alone(t: _Bucket, g: int) -> dict:
        """Poses by their places."""
        own = np.arange(t.starts[g], t.starts[g] + t.count[g])
        named = pd.Series(t.nodes.column("id").take(pa.array(own)).to_pylist(), dtype=object)
        first = named.map(dict(reversed(list(zip(named, range(len(own)), strict=True))))).to_numpy().astype(int)
        s, seen, at = Smoother(window, **options), set(), {}
        for e in np.flatnonzero((t.eg == g) & (t.i >= 0) & (t.j >= 0)):
            x = (int(first[t.i[e]]), int(first[t.j[e]]), t.measured[e], t.weight[e])
            for k in {x[0], x[1]}:
                at.setdefault(k, []).append(x)
        for k, m in zip(first.tolist(), t.x[own], strict=True):
            seen.add(k)
            s.add(k, m, [x for x in at.get(k, ()) if seen.issuperset(x[:2])])
            s.optimise()
        return {**s.frozen, **s.poses}

    def solve(t: _Bucket) -> pa.Table:
        x, keep = t.x.copy(), np.ones(len(t.g), bool)
        there = (t.i >= 0) & (t.j >= 0)
        plain = ~t.repeated & (window <= SIDE_POSES) & (t.count > 0)
        plain[t.eg[there & ((t.i == t.j) | (np.abs(t.i - t.j) >= window))]] = False
        for g in np.flatnonzero(~plain & (t.count > 0)):
            own, found = np.arange(t.starts[g], t.starts[g] + t.count[g]), alone(t, g)
            keep[own] = False
            keep[own[list(found)]] = True
            x[own[list(found)]] = list(found.values())
        ours = np.flatnonzero(there & plain[t.eg])
        ours = ours[np.argsort(np.maximum(t.i[ours], t.j[ours]), kind="stable")]
        low, high = np.minimum(t.i[ours], t.j[ours]), np.maximum(t.i[ours], t.j[ours])
        for now in range(int(t.count[plain].max(initial=0))):
            first = max(0, now - window + 1)
            graphs = np.flatnonzero(plain & (t.count > now))
            of = np.full(t.graphs, -1)
            of[graphs] = np.arange(len(graphs))
            k = slice(*np.searchsorted(high, [first, now + 1]))  # edges whose later end is in the window
            e, lo, hi = ours[k], low[k], high[k]
            going = of[t.eg[e]] >= 0
            e, lo, hi = e[going], lo[going], hi[going]
            if not len(e):
                continue
            prior = lo < first  # its earlier end has left, and stays where it was
            i, j, measured = t.i[e] - first, t.j[e] - first, t.measured[e]
            ahead = prior & (t.i[e] < t.j[e])
            back = prior & ~ahead
            frozen = x[t.starts[t.eg[e]] + lo]
            measured[ahead] = frozen[ahead] @ measured[ahead]
            measured[back] = frozen[back] @ np.linalg.inv(measured[back])
            i, j = np.where(prior, 0, i), np.where(prior, hi - first, j)
            rows = t.starts[graphs][:, None] + np.arange(first, now + 1)
            x[rows] = kernels.optimise_many(x[rows], np.full(len(graphs), now + 1 - first), i, j, measured, t.weight[e], of[t.eg[e]], prior, **options)[0]
        rows = np.flatnonzero(keep)
        return t.table(rows, x[rows])

    return _side_by_side(nodes, edges, by, nodes.count(), solve, f"{by} {kinds[by]}, id {kinds['id']}, transform array<double>")


def merge_sessions(a: dict[str, DataFrame], b: dict[str, DataFrame], loop: tuple) -> dict[str, DataFrame]:
    """Two sessions' tables as one: b's ids follow a's, and one loop edge (a_id, b_id, transform, information) joins them. Poses of b stay as they are."""
    shift = (a["nodes"].agg(F.max("id")).first()[0] or 0) + 1
    move = lambda df, *cols: df.select(*[(F.col(c) + shift).alias(c) if c in cols else F.col(c) for c in df.columns])
    out = {}
    for name, df in a.items():
        keys = {"nodes": ("id",), "edges": ("a", "b")}.get(name, ("frame",))
        out[name] = df.unionByName(move(b[name], *keys)) if name in b else df
    spark = a["nodes"].sparkSession
    i, j, m, w = loop
    out["edges"] = out["edges"].unionByName(spark.createDataFrame([(i, j + shift, list(map(float, np.ravel(m))), list(map(float, np.ravel(w))))], "a long, b long, transform array<double>, information array<double>"))
    return out
