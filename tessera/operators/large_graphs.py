"""Pose graphs that no task could hold: Gauss-Newton with the chain eliminated block by block.

Poses lie in blocks of consecutive ones. Edges between neighbours in a block are its chain; all others are links. In each step a block's task linearises its chain and
eliminates the poses between those that links or borders touch; what is left of the whole graph is a small one, of factors between kept poses. That is solved by one task
while it has few factors, and by conjugate gradients over tables of factors and poses, preconditioned by the inverse blocks of the diagonal, beyond. Then every block fills in its poses.
So a pass over poses and edges is one shuffle by block, and only kept poses and links are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import kernels
from tessera.operators.scans import number_rows
from tessera.shared import kept

#: Poses of a block; factors of a reduced graph that one task solves.
BLOCK, SOLVE_FACTORS = 10_000, 100_000
#: Conjugate gradient steps on tables, at most, and the relative size of the residual that ends them.
STEPS, RESIDUAL = 2000, 1e-10
_FACTOR = pa.schema([("_g", pa.int32()), ("i", pa.int64()), ("j", pa.int64()), ("h", pa.list_(pa.float64())), ("g", pa.list_(pa.float64()))])
_FACTOR_SQL = "_g int, i long, j long, h array<double>, g array<double>"


def _array(column, *shape: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, *shape)


def _lists(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m).reshape(len(m), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def _turned(h: np.ndarray, g: np.ndarray, flip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors with their ends exchanged where flip says so."""
    swap = [*range(6, 12), *range(6)]
    h, g = h.copy(), g.copy()
    h[flip] = h[flip][:, swap][:, :, swap]
    g[flip] = g[flip][:, swap]
    return h, g


def _stretches(poses: pa.Table, chain: pa.Table, damping: float):
    """(places, poses, held, elimination) of a block's rows and edges."""
    order = np.argsort(poses.column("at").to_numpy())
    at, x = poses.column("at").to_numpy()[order], _array(poses.column("transform"), 4, 4)[order]
    held = poses.column("held").to_numpy(zero_copy_only=False)[order].astype(bool)
    held[0] = held[-1] = True
    held[:: kernels.STRETCH] = True
    h, g = np.zeros((len(at) - 1, 12, 12)), np.zeros((len(at) - 1, 12))
    if chain.num_rows:
        i, j = chain.column("i").to_numpy() - at[0], chain.column("j").to_numpy() - at[0]
        e, ja, jb = kernels.linearise(x[i], x[j], np.linalg.inv(_array(chain.column("transform"), 4, 4)))
        hh, gg = _turned(*kernels.factors(e, ja, jb, _array(chain.column("information"), 6, 6)), i > j)
        np.add.at(h, np.minimum(i, j), hh)
        np.add.at(g, np.minimum(i, j), gg)
    return at, x, held, kernels.Stretches(h, g, held, damping) if len(at) > 1 else None


def _solve_in_task(factors: DataFrame, damping: float) -> DataFrame:
    """_g, at, step of kept poses; the first pose of each graph is held."""
    out = pa.schema([("_g", pa.int32()), ("at", pa.int64()), ("step", pa.list_(pa.float64()))])

    def run(t: pa.Table) -> pa.Table:
        i, j, h, g = t.column("i").to_numpy(), t.column("j").to_numpy(), _array(t.column("h"), 12, 12), _array(t.column("g"), 12)
        names = np.unique(np.concatenate((i, j)))
        a, b = np.searchsorted(names, i), np.searchsorted(names, j)
        h, g = _turned(h, g, a > b)
        a, b = np.minimum(a, b), np.maximum(a, b)
        near = b == a + 1
        ch, cg = np.zeros((len(names) - 1, 12, 12)), np.zeros((len(names) - 1, 12))
        np.add.at(ch, a[near], h[near])
        np.add.at(cg, a[near], g[near])
        x = kernels.solve_chain(ch, cg, a[~near], b[~near], h[~near], g[~near], damping)
        return pa.table([np.full(len(names), t.column("_g")[0].as_py(), np.int32), names, _lists(x)], schema=out)

    return factors.groupBy("_g").applyInArrow(run, "_g int, at long, step array<double>")


def _solve_by_tables(factors: DataFrame, damping: float) -> DataFrame:
    """The same by conjugate gradients whose vectors are tables: a step joins the factors with the direction at both ends and adds up by pose."""
    zip_ = lambda f, *c: F.zip_with(*c, f)
    dot = lambda a, b: F.aggregate(zip_(lambda p, q: p * q, a, b), F.lit(0.0), lambda s, v: s + v)
    parts = pa.schema([("_g", pa.int32()), ("at", pa.int64()), *[(f"w{k}", pa.float64()) for k in range(42)]])

    def diagonal(batches):
        """Of each factor's ends the right side and the block of the diagonal."""
        for b in batches:
            i, j, h, g = b.column(1).to_numpy(), b.column(2).to_numpy(), _array(b.column(3), 12, 12), _array(b.column(4), 12)
            same = i == j
            one, two = h[:, :6, :6].copy(), h[:, 6:, 6:]
            one[same] += h[same][:, :6, 6:] + h[same][:, 6:, :6]
            w = np.concatenate((np.concatenate((-g[:, :6], -g[:, 6:])), np.concatenate((one, two)).reshape(-1, 36)), axis=1)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(0)] * 2), pa.array(np.concatenate((i, j))), *[pa.array(c) for c in w.T]], schema=parts)

    def begin(batches):
        for b in batches:
            w = np.stack([b.column(k + 2).to_numpy() for k in range(42)], axis=1)
            first = b.column(1).to_numpy() == 0
            r, own = w[:, :6], w[:, 6:].reshape(-1, 6, 6) + damping * np.eye(6)
            r[first], own[first] = 0, np.eye(6)
            inverse = np.linalg.inv(own)
            z = np.einsum("nij,nj->ni", inverse, r)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(np.zeros_like(r)), _lists(r), _lists(inverse), _lists(z), _lists(z)], names=["_g", "at", "x", "r", "inverse", "z", "p"])

    def times(batches):
        for b in batches:
            v = np.concatenate((_array(b.column(4), 6), _array(b.column(5), 6)), axis=1)
            w = np.einsum("mij,mj->mi", _array(b.column(3), 12, 12), v)
            w = np.concatenate((w[:, :6], w[:, 6:]))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(0)] * 2), pa.concat_arrays([b.column(1), b.column(2)]), *[pa.array(c) for c in w.T]], names=["_g", "at", *[f"w{k}" for k in range(6)]])

    def residual(batches):
        """r and z after a step along q."""
        for b in batches:
            r, q, step = _array(b.column(3), 6), _array(b.column(6), 6).copy(), b.column(7).to_numpy()[:, None]
            first = b.column(1).to_numpy() == 0
            q[first] = 0
            r = r - step * q
            z = np.einsum("nij,nj->ni", _array(b.column(4), 6, 6), r)
            x = _array(b.column(2), 6) + step * _array(b.column(5), 6)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(x), _lists(r), b.column(4), _lists(z), b.column(5)], names=["_g", "at", "x", "r", "inverse", "z", "p"])

    state_sql = "_g int, at long, x array<double>, r array<double>, inverse array<double>, z array<double>, p array<double>"
    sums = lambda df, n: df.groupBy("_g", "at").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in range(n)])
    whole = sums(factors.mapInArrow(diagonal, "_g int, at long, " + ", ".join(f"w{k} double" for k in range(42))), 42)
    state = kept(whole.mapInArrow(begin, state_sql))
    rz = state.agg(F.sum(dot("r", "z"))).first()[0] or 0.0
    goal = RESIDUAL * RESIDUAL * rz
    for _ in range(STEPS):
        if rz <= goal:
            break
        p = state.select("_g", "at", "p")
        there = factors.join(p.select("_g", F.col("at").alias("i"), F.col("p").alias("_pi")), ["_g", "i"]).join(p.select("_g", F.col("at").alias("j"), F.col("p").alias("_pj")), ["_g", "j"]).select("_g", "i", "j", "h", "_pi", "_pj")
        w = sums(there.mapInArrow(times, "_g int, at long, " + ", ".join(f"w{k} double" for k in range(6))), 6)
        q = w.select("_g", "at", F.array(*[F.col(f"w{k}") for k in range(6)]).alias("_w"))
        moving = kept(state.join(q, ["_g", "at"]).withColumn("q", zip_(lambda a, b: a + F.lit(damping) * b, "_w", "p")).drop("_w", "z"))
        pq = moving.where("at <> 0").agg(F.sum(dot("p", "q"))).first()[0]
        state = moving.select("_g", "at", "x", "r", "inverse", "p", "q").withColumn("step", F.lit(rz / pq))
        state = kept(state.mapInArrow(residual, state_sql))
        old, rz = rz, state.agg(F.sum(dot("r", "z"))).first()[0]
        state = state.withColumn("p", zip_(lambda a, b: a + F.lit(rz / old) * b, "z", "p"))
    return state.select("_g", "at", F.col("x").alias("step"))


def optimise_large(nodes: DataFrame, edges: DataFrame, by: str = "graph", max_iterations: int = 20, tolerance: float = 1e-6, damping: float = 1e-6) -> DataFrame:
    """by, id, transform, cost, converged, as graphs.optimise gives them; nodes: by, id, seq, transform; edges: by, a, b, transform, information.

    Poses that are equal in seq are ordered by id. Steps end graph by graph, when the norm of a graph's step is below the tolerance.
    """
    graphs = number_rows(nodes.select(F.col(by).alias("_by")).distinct(), "_by", name="_n")
    names = kept(graphs.select("_by", F.col("_n").cast("int").alias("_g")))  # a row a large graph
    named = lambda df: df.join(names, F.col(by).eqNullSafe(F.col("_by"))).drop("_by", by)
    placed = number_rows(named(nodes.select(by, "id", "seq", "transform")), "_g", "seq", "id", name="_at")
    began = placed.groupBy("_g").agg(F.min("_at").alias("_from"))
    placed = kept(placed.join(began, "_g").select("_g", "id", (F.col("_at") - F.col("_from")).alias("at"), "transform"))
    end = lambda c, k: placed.select("_g", F.col("id").alias(c), F.col("at").alias(k))
    own = kept(named(edges.select(by, "a", "b", "transform", "information")).join(end("a", "i"), ["_g", "a"]).join(end("b", "j"), ["_g", "b"]).drop("a", "b"))
    block = lambda c: F.floor(F.col(c) / BLOCK)
    near = (F.abs(F.col("i") - F.col("j")) == 1) & (block("i") == block("j"))
    chain, links = own.where(near).withColumn("_b", block("i")), own.where(~near)
    touched = links.select("_g", F.explode(F.array("i", "j")).alias("at")).distinct().withColumn("held", F.lit(True))
    poses = kept(placed.join(touched, ["_g", "at"], "left").select("_g", "at", "transform", F.coalesce("held", F.lit(False)).alias("held"), block("at").alias("_b")))

    def linearised(batches):
        for b in batches:
            if b.num_rows:
                e, ja, jb = kernels.linearise(_array(b.column(5), 4, 4), _array(b.column(6), 4, 4), np.linalg.inv(_array(b.column(3), 4, 4)))
                h, g = kernels.factors(e, ja, jb, _array(b.column(4), 6, 6))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _lists(h), _lists(g)], schema=_FACTOR)

    def reduced(p: pa.Table, c: pa.Table) -> pa.Table:
        at, _, _, s = _stretches(p, c, damping)
        g = np.full(0 if s is None else len(s.starts), p.column("_g")[0].as_py(), np.int32)
        return pa.table([g, at[s.starts], at[s.ends], _lists(s.h), _lists(s.g)] if s is not None else [[], [], [], [], []], schema=_FACTOR)

    def filled(p: pa.Table, c: pa.Table) -> pa.Table:
        at, x, _, s = _stretches(p.drop_columns("step"), c, damping)
        order, steps = np.argsort(p.column("at").to_numpy()), np.zeros((len(at), 6))
        given = p.column("step").combine_chunks()
        there = given.is_valid().to_numpy(zero_copy_only=False)
        if there.any():
            steps[np.searchsorted(at, p.column("at").to_numpy()[there])] = _array(given.drop_null(), 6)
        steps = s.fill(steps) if s is not None else steps
        back = np.argsort(order)
        x, steps = kernels.moved(x, steps)[back], steps[back]
        return pa.table([p.column("_g"), p.column("at"), _lists(x), p.column("held"), p.column("_b"), (steps * steps).sum(axis=1)], names=["_g", "at", "transform", "held", "_b", "moved"])

    def sides(p: DataFrame):
        edges_of = chain.select(F.col("_g").alias("_cg"), F.col("_b").alias("_cb"), "i", "j", "transform", "information")
        return p.groupBy("_g", "_b").cogroup(edges_of.groupBy("_cg", "_cb"))

    resting, converged = None, set()
    for _ in range(max_iterations):
        ends = [poses.select("_g", F.col("at").alias(k), F.col("transform").alias(f"_t{k}")) for k in "ij"]
        of_links = links.join(ends[0], ["_g", "i"]).join(ends[1], ["_g", "j"]).select("_g", "i", "j", "transform", "information", "_ti", "_tj").mapInArrow(linearised, _FACTOR_SQL)
        all_ = kept(sides(poses).applyInArrow(reduced, _FACTOR_SQL).unionByName(of_links))
        many = {r._g: r["count"] for r in all_.groupBy("_g").count().collect()}  # a row a large graph
        big = [g for g, n in many.items() if n > SOLVE_FACTORS]
        steps = _solve_in_task(all_.where(~F.col("_g").isin(big)), damping)
        if big:
            steps = steps.unionByName(_solve_by_tables(all_.where(F.col("_g").isin(big)), damping))
        new = kept(sides(poses.join(steps, ["_g", "at"], "left")).applyInArrow(filled, "_g int, at long, transform array<double>, held boolean, _b long, moved double"))
        poses = new.drop("moved")
        done = [r._g for r in new.groupBy("_g").agg(F.sqrt(F.sum("moved")).alias("d")).where(F.col("d") < tolerance).collect()]
        if done:
            converged |= set(done)
            over = poses.where(F.col("_g").isin(done))
            resting = over if resting is None else resting.unionByName(over)
            poses, chain, links = (d.where(~F.col("_g").isin(done)) for d in (poses, chain, links))
            if len(done) == len(many):
                break
    final = poses if resting is None else resting.unionByName(poses)
    from tessera.operators.graphs import graph_cost

    cost = graph_cost(final.select("_g", F.col("at").alias("id"), "transform"), own.select("_g", F.col("i").alias("a"), F.col("j").alias("b"), "transform", "information"), "_g").select("_g", "cost")
    out = placed.select("_g", "id", "at").join(final.select("_g", "at", "transform"), ["_g", "at"]).join(names, "_g").join(cost, "_g", "left")
    return out.select(F.col("_by").alias(by), "id", "transform", F.coalesce("cost", F.lit(0.0)).alias("cost"), F.col("_g").isin(sorted(converged)).alias("converged"))
