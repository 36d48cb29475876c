"""Nearest neighbours by collision counting.

Inner-product search becomes Euclidean search by one more coordinate: with M the largest norm, x gets
sqrt(M^2 - |x|^2), a query is scaled to norm M and gets 0. Every vector is projected on ``projections`` random lines, and a block
of vectors keeps the sorted array of each line. A query's windows on these arrays are centred
at its own projections and grow by virtual rehashing, each radius ``growth`` times the one before. A vector
that lies in the windows of ``threshold`` lines is verified by its exact inner product, in double precision. The search in a block ends when
the k-th best lies within the radius, or at the query's last radius.

The last radius and the index's ranges come from SAMPLE vectors with the smallest hashes: of a sample that holds a share f of the
vectors, about k*f are among a query's k nearest, so the distance of a somewhat later one in the sample bounds that of the k-th. Blocks
are ranges of the first line, split by a hash where a range is crowded, and a query goes only to ranges that its
widest window on that line reaches (twice and a bit wider than on the counted lines, since here a miss would be final). Blocks
depend on the vectors alone. Every row is indexed. The recall of AUDIT queries is measured against brute force in each search; where it is short, the threshold
falls, in the end to nothing, when all vectors of the blocks are verified.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import batch_from, cut
from tessera.llm.vectors import dimension, matrix, usable

log = logging.getLogger(__name__)
BLOCK_ROWS, QUERY_ROWS, RANGES = 4000, 8000, 256
SAMPLE, AUDIT = 4096, 64
#: P(|N(0,1)| <= 1), the chance that a vector at distance R collides on one line.
_P = 0.6826894921370859
#: The window on the first line in radii: a vector at the last radius lies within it with a chance of 0.988.
WIDE = 2.5
BATCH = 128
RADII = 2


def lines(dim: int, projections: int, seed: int = 3) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim + 1, projections))


def project(x: np.ndarray, top: float, w: np.ndarray) -> np.ndarray:
    """Projections of vectors with their additional coordinate."""
    extra = np.sqrt(np.maximum(0, top * top - (x * x).sum(axis=1)))
    return x @ w[:-1] + extra[:, None] * w[-1]


def project_queries(q: np.ndarray, top: float, w: np.ndarray) -> np.ndarray:
    return (q * (top / np.linalg.norm(q, axis=1))[:, None]) @ w[:-1]


def distance(scores: np.ndarray, norm: np.ndarray, top: float) -> np.ndarray:
    """Euclidean distance in the larger space of an inner product with a query of that norm."""
    return np.sqrt(np.maximum(0.0, 2 * top * (top - scores / norm)))


class Block:
    """Sorted projections of a block of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, top: float, projections: int = 64, slack: float | None = 1.6):
        self.ids, self.x, self.top = ids, np.ascontiguousarray(x), top
        self.w = lines(x.shape[1], projections)
        p = project(x, top, self.w)
        order = np.argsort(p, axis=0, kind="stable")
        self.sorted = np.take_along_axis(p, order, axis=0).T.copy()
        kind = np.uint16 if len(x) < 1 << 16 else np.uint32
        self.place = np.empty(p.shape[::-1], kind)  # where each vector stands in a line's array
        np.put_along_axis(self.place, order.T, np.broadcast_to(np.arange(len(x), dtype=kind), order.T.shape), axis=1)
        self.threshold = 0 if slack is None else max(1, int(np.floor(projections * _P - slack * np.sqrt(projections * _P * (1 - _P)))))

    def collisions(self, at: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """[queries, vectors]: in how many lines a vector lies in the query's window."""
        count = np.zeros((len(at), len(self.ids)), np.uint8 if len(self.sorted) < 256 else np.uint16)
        for j, (line, place) in enumerate(zip(self.sorted, self.place, strict=True)):
            low = np.searchsorted(line, at[:, j] - radius).astype(place.dtype)
            wide = np.searchsorted(line, at[:, j] + radius, side="right").astype(place.dtype) - low
            count += (place[None, :] - low[:, None]) < wide[:, None]  # unsigned: what stands before the window is far behind it
        return count

    def search(self, own: np.ndarray, q: np.ndarray, last: np.ndarray, k: int, growth: float = 1.5) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query the ids and inner products of the k best found, best first, ties to the smaller id; rows with the query's own id are left out."""
        out: list = [None] * len(q)
        norm = np.linalg.norm(q, axis=1)
        at = project_queries(q, self.top, self.w)
        for low in range(0, len(q), BATCH):
            live = np.arange(low, min(low + BATCH, len(q)))
            for turn in range(RADII - 1, -1, -1):
                radius = last[live] / growth**turn
                full = self.collisions(at[live], radius) >= self.threshold
                more = []
                for i, hits, r in zip(live, full, radius, strict=True):
                    rows = np.flatnonzero(hits)
                    rows = rows[self.ids[rows] != own[i]]
                    scores = np.einsum("ij,j->i", self.x[rows], q[i])
                    if len(rows) > k:
                        least = np.partition(-scores, k - 1)[k - 1]
                        near = -scores <= least
                        rows, scores = rows[near], scores[near]
                    best = np.lexsort((self.ids[rows], -scores))[:k]
                    out[i] = self.ids[rows[best]], scores[best]
                    if turn and (len(best) < k or distance(scores[best[-1]], norm[i], self.top) > r):
                        more.append(i)
                live = np.array(more, int)
                if not len(live):
                    break
        return out


_HITS, _HITS_SQL = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]), "query_id long, vec_id long, score double"


def _hits(names, found) -> dict:
    cat = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
    return {"query_id": np.repeat(np.asarray(names, np.int64), [len(i) for i, _ in found]), "vec_id": cat([i for i, _ in found], np.int64), "score": cat([s for _, s in found], float)}


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _brute(data: DataFrame, asked: list, k: int) -> DataFrame:
    """The k nearest of a bounded list of queries (vec_id, v), over all vectors."""
    names, q = np.array([r.vec_id for r in asked]), np.array([r.v for r in asked])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, s = b.column(0).to_numpy(), q @ matrix(b.column(1)).T
            found = []
            for name, row in zip(names, s, strict=True):
                rows = np.flatnonzero(ids != name)
                best = rows[np.lexsort((ids[rows], -row[rows]))[:k]]
                found.append((ids[best], row[best]))
            yield batch_from(_hits(names, found), _HITS)

    return _ranked(data.mapInArrow(run, _HITS_SQL), k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, projections: int = 64, slack: float = 1.6, recall: float = 0.95) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query (rows of vec_id, embedding) its k nearest of all other vectors.

    Vectors that are null, zero, of another length than most of vectors or with null or non-finite components take no part, on either
    side. Rows with the query's id are the query's own. Of rows of queries with one id the least vector asks; rows of vectors with one id are
    candidates each. Null ids take no part. Fewer than k candidates are all returned, and empty tables give an empty result. Ties go to
    the smaller vec_id. Other columns may have any names.
    """
    dim = dimension(vectors)
    data = cut(usable(vectors, dim))
    ask = cut(usable(queries, dim).groupBy("vec_id").agg(F.min("v").alias("v")))
    stats = data.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("top")).first()
    n, top = int(stats.n), float(stats.top or 1.0) * (1 + 1e-12)
    sample = data.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(SAMPLE).collect()
    names, some = np.array([r.vec_id for r in sample], np.int64), np.array([r.v for r in sample]).reshape(len(sample), max(dim, 1))
    w = lines(max(dim, 1), projections)[:, :1]
    expected = k * len(sample) / max(n, 1)
    rank = int(np.ceil(expected + 3 * np.sqrt(expected) + 1))
    count = max(1, min(RANGES, -(-n // BLOCK_ROWS)))
    edges = np.quantile(project(some, top, w)[:, 0], np.arange(1, count) / count) if len(sample) else np.zeros(0)
    placed = pa.schema([("range", pa.int32()), ("vec_id", pa.int64()), ("v", pa.list_(pa.float64()))])

    def place(batches):
        for b in batches:
            if b.num_rows:
                yield batch_from({"range": np.searchsorted(edges, project(matrix(b.column(1)), top, w)[:, 0]), "vec_id": b.column(0), "v": b.column(1)}, placed)

    routed = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("last", pa.float64()), ("from", pa.int32()), ("to", pa.int32())])

    def route(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q = matrix(b.column(1))
            last = np.full(len(q), 2 * top)
            norm = np.linalg.norm(q, axis=1)
            for at in range(0, len(q), 512):
                s = q[at : at + 512] @ some.T
                s[b.column(0).to_numpy()[at : at + 512, None] == names[None, :]] = -np.inf
                if rank < s.shape[1]:
                    last[at : at + 512] = distance(-np.partition(-s, rank - 1, axis=1)[:, rank - 1], norm[at : at + 512], top)
            last = np.maximum(np.minimum(last, 2 * top), 1e-9 * top)
            p = project_queries(q, top, w)[:, 0]
            yield batch_from({"vec_id": b.column(0), "v": b.column(1), "last": last, "from": np.searchsorted(edges, p - WIDE * last), "to": np.searchsorted(edges, p + WIDE * last)}, routed)

    ranged = data.mapInArrow(place, "range int, vec_id long, v array<double>")
    per_range = cut(ranged.groupBy("range").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("splits")))  # RANGES rows at most
    sides = max(1, -(-ask.count() // QUERY_ROWS))
    each = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    left = ranged.join(F.broadcast(per_range), "range").select("range", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("splits")).cast("int").alias("split"), each(F.lit(sides)).alias("side"), "vec_id", "v")
    sent = ask.mapInArrow(route, "vec_id long, v array<double>, last double, `from` int, `to` int")
    sent = sent.select("vec_id", "v", "last", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(sides)).cast("int").alias("side"), F.explode(F.sequence("from", "to")).alias("range"))
    split = lambda rows: rows.join(F.broadcast(per_range), "range").select("range", each(F.col("splits")).alias("split"), "side", "vec_id", "v", "last")
    right = split(sent)
    asked = ask.orderBy(F.xxhash64("vec_id", F.lit(6)), "vec_id").limit(AUDIT).collect()
    truth = cut(_brute(data, asked, k)) if asked else None

    def searching(slack_now: float | None):
        def run(x: pa.Table, q: pa.Table) -> pa.Table:
            if not x.num_rows or not q.num_rows:
                return pa.table([pa.array([], f.type) for f in _HITS], schema=_HITS)
            block = Block(x.column("vec_id").to_numpy(), matrix(x.column("v")), top, projections, slack_now)
            own = q.column("vec_id").to_numpy()
            found = block.search(own, matrix(q.column("v")), q.column("last").to_numpy(), k)
            return pa.Table.from_batches([batch_from(_hits(own, found), _HITS)])

        return run

    # the last way is exact: every query goes to all ranges, and all their vectors are verified
    whole = ask.select("vec_id", "v", F.lit(2 * top).alias("last"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(sides)).cast("int").alias("side"), F.explode(F.sequence(F.lit(0), F.lit(len(edges)))).alias("range"))
    for slack_now, rows in ((slack, right), (slack + 2, right), (None, right), (None, split(whole))):
        out = cut(_ranked(left.groupBy("range", "split", "side").cogroup(rows.groupBy("range", "split", "side")).applyInArrow(searching(slack_now), _HITS_SQL), k))
        if truth is None:
            return out
        hit = truth.join(out.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
        log.info("audited recall of the search %s", hit)
        if hit is None or hit >= recall:
            return out
        log.warning("audited recall %s is short of %s: the threshold falls, in the end all vectors are compared", hit, recall)
    return out
