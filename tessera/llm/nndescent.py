"""Near-duplicate embeddings by NN-descent.

Copies of one vector are one node. Dense groups are covered first: a tight cluster's members lie within half the
threshold's angle of its representative, so all of them link with each other and no pair of them has to be made. In many dimensions the members of a noisy group are about as far from
each other as any two of them, and none is so near to the others; such a group becomes a loose cluster, whose members all link with its representative, and whose members' links with
each other are counted in blocks. NN-descent then runs over representatives.
A first graph comes from leaves of random orderings; then every node looks at the neighbours of some of its
neighbours, again and again. A list holds the ``k`` nearest, but a list that is saturated, with its k-th
neighbour still within reach of a link, is enlarged to hold all neighbours within reach: those whose clusters' radii allow
a link between members. Candidates are fetched once for a block of nearby nodes and compared there, in double precision. When
a round finds nothing more within reach of any node, or no list changes any more, the recall is audited on nodes drawn without regard to their lists, against all nodes; if it falls short, further
orderings are added, and after SEEDS sets all pairs of representatives are compared in blocks.

Pairs of clusters that link as a whole count by their sizes; pairs of which only some members may link, and loose clusters within themselves, are compared in blocks, which return
a count a member. So no list of pairs grows with the square of a group of near copies; the products of a loose cluster do, as its counts need them, and so do the copies of its vectors, divided by a block's members.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.common import batch_from, cut
from tessera.llm.components import components
from tessera.llm.vectors import flagged, matrix

log = logging.getLogger(__name__)
LEAF, TREES, LEAVES_A_BLOCK = 128, 3, 16
#: Sets of orderings before all pairs of representatives are compared; nodes in a part of that comparison, and of the comparison of two clusters.
SEEDS, PART, SIDE = 8, 6000, 1000
#: Passes that cover tight groups and loose ones; nodes of a leaf that a leader of a loose one leads at least; tight clusters of fewer nodes may become part of a loose one.
COVERS, LOOSE_COVERS, CROWD, FEW = 3, 2, 24, 8
#: Members in a block of a loose cluster.
INSIDE = 8000
#: An audit draws twice as many nodes until so many of them have links. Where more than AUDIT_MOST would be drawn nothing is known, and all pairs are compared.
ENOUGH, AUDIT_MOST = 50, 16_000
_ROUNDING = 1e-6


def _ordered(units: DataFrame, seed: int, trees: int, rows: int) -> DataFrame:
    """(tree, code, along, id, x, rad) in the order of each tree's codes: the signs of random projections, then another projection."""
    planes = max(4, min(40, int(np.log2(max(rows, 2) / 32)) if rows > 64 else 4))
    keyed = pa.schema([("tree", pa.int32()), ("code", pa.int64()), ("along", pa.float64()), ("id", pa.int64()), ("x", pa.list_(pa.float64())), ("rad", pa.float64())])

    def keys(batches):
        for b in batches:
            x = matrix(b.column(1))
            if not len(x):
                continue
            for t in range(trees):
                rng = np.random.default_rng([seed, t, x.shape[1]])
                side = x @ rng.normal(size=(x.shape[1], planes)) > 0
                gray = side.astype(np.int64)
                for j in range(1, planes):  # neighbouring codes differ in few planes
                    gray[:, j] ^= gray[:, j - 1]
                code = gray @ (1 << np.arange(planes)[::-1])
                yield batch_from({"tree": np.full(len(x), t), "code": code, "along": x @ rng.normal(size=x.shape[1]), "id": b.column(0), "x": b.column(1), "rad": b.column(2)}, keyed)

    spread = units.select("id", "x", "rad").mapInArrow(keys, "tree int, code long, along double, id long, x array<double>, rad double")
    return spread.repartitionByRange("tree", "code", "along").sortWithinPartitions("tree", "code", "along", "id")


def _leaves(batches):
    """(tree, ids, x, rad) of each leaf: LEAF neighbours in a tree's order, or what is left of a batch."""
    for b in batches:
        tree, ids, x, rad = b.column(0).to_numpy(), b.column(3).to_numpy(), matrix(b.column(4)), b.column(5).to_numpy()
        for t in np.unique(tree):
            whole = np.flatnonzero(tree == t)
            for at in range(0, len(whole), LEAF):
                own = whole[at : at + LEAF]
                yield t, ids[own], x[own], rad[own]


def _reach(theta: float, a, b) -> np.ndarray:
    """The least similarity of two representatives some of whose members may link."""
    return np.cos(np.minimum(theta + a + b + (_ROUNDING if np.any(a) or np.any(b) else 0), np.pi)) - 1e-15


def _leaders(units: DataFrame, radius: float, seed: int, rows: int, crowd: int = 1) -> DataFrame:
    """(id, leader): within leaves of one ordering, nodes taken by a hash of the id lead all free ones within the radius, if these are crowd or more."""
    out = pa.schema([("id", pa.int64()), ("leader", pa.int64())])
    least = np.cos(radius - _ROUNDING)

    def run(batches):
        for _, ids, x, _ in _leaves(batches):
            near = x @ x.T >= least
            leader = np.full(len(ids), -1)
            for i in np.argsort(K.mix(ids.astype(np.uint64) + np.uint64(seed))):
                if leader[i] < 0:
                    led = (leader < 0) & near[i]
                    if led.sum() >= crowd:
                        leader[led] = i
                    leader[i] = i
            yield batch_from({"id": ids, "leader": ids[leader]}, out)

    return _ordered(units, seed, 1, rows).mapInArrow(run, "id long, leader long")


def _covered(units: DataFrame, radius: float, seed: int, passes: int, crowd: int) -> DataFrame:
    """(id, x, n, rep, angle) of those units (id, x, n) that are within the radius of a representative, itself a unit, and not its only member.

    Leaders of leaves are led by leaders of leaders; members that are too far from the last of these are tried once more among themselves.
    """
    dot = F.aggregate(F.zip_with("x", "_x", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    todo, done, rows = units.select("id", "x", "n", F.lit(0.0).alias("rad")), None, units.count()
    for turn in range(passes):
        if rows < 2:
            break
        chain = cut(_leaders(todo, radius, seed + 10 * turn, rows, crowd))
        for step in range(1, 10):
            hubs = chain.groupBy("leader").count().where("count > 1").select(F.col("leader").alias("id"))
            found = cut(hubs.join(todo, "id"))
            if (many := found.count()) < 2:
                break
            over = _leaders(found, radius, seed + 10 * turn + step, many).select(F.col("id").alias("leader"), F.col("leader").alias("over"))
            chain = cut(chain.join(over, "leader", "left").select("id", F.coalesce("over", "leader").alias("leader")))
            if many <= LEAF:
                break
        # whoever is led by another one is tried against that leader, if it still leads itself
        led = chain.where("id <> leader")
        lead = chain.where("id = leader").join(led.select("leader").distinct(), "leader").join(todo.select("id", F.col("x").alias("_x")), "id").select("leader", "_x")
        tried = led.join(todo, "id").join(lead, "leader", "left").withColumn("angle", F.acos(F.least(dot, F.lit(1.0))))
        near = cut(tried.where(F.col("angle") <= radius - _ROUNDING).select("id", "x", "n", F.col("leader").alias("rep"), "angle"))
        reps = near.select(F.col("rep").alias("id")).distinct().join(todo, "id").select("id", "x", "n", F.col("id").alias("rep"), F.lit(0.0).alias("angle"))
        got = near.union(reps)
        done = cut(got if done is None else done.union(got))
        todo = cut(todo.join(done.select("id"), "id", "left_anti"))
        if crowd == 1:  # who leads nobody is alone; who was too far from its leader is tried again
            todo = cut(todo.join(led.select("id"), "id", "left_semi"))
        rows = todo.count()
    return done if done is not None else units.select("id", "x", "n", F.col("id").alias("rep"), F.lit(0.0).alias("angle")).limit(0)


def cover(units: DataFrame, theta: float) -> DataFrame:
    """(id, x, n, rep, angle) of all units (id, x, n): tight clusters, loose ones, and who is nobody's member by itself.

    Members are within half of theta of the representative of a tight cluster, and within theta of that of a loose one.
    """
    tight = _covered(units, theta / 2, 1000, COVERS, 1)
    sizes = tight.groupBy("rep").agg(F.count("*").alias("members")).where(F.col("members") >= FEW)
    tight = cut(tight.join(sizes.select("rep"), "rep").select("id", "x", "n", "rep", "angle"))
    loose = _covered(units.join(tight.select("id"), "id", "left_anti"), theta, 2000, LOOSE_COVERS, CROWD)
    done = cut(tight.union(loose))
    alone = units.join(done.select("id"), "id", "left_anti").select("id", "x", "n", F.col("id").alias("rep"), F.lit(0.0).alias("angle"))
    return cut(done.union(alone))


def _orderings(units: DataFrame, theta: float, k: int, seed: int, rows: int) -> DataFrame:
    """(u, v, s, link, block): nearest neighbours and those within reach in leaves of random orderings; u = v rows tell u's block."""
    out = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("s", pa.float64()), ("link", pa.bool_()), ("block", pa.int64())])

    def leaves(batches):
        from pyspark import TaskContext

        part, leaf = TaskContext.get().partitionId(), 0
        for t, ids, x, rad in _leaves(batches):
            s = x @ x.T
            np.fill_diagonal(s, -2)
            link = s >= _reach(theta, rad[:, None], rad)
            keep = link.copy()
            if len(ids) > 1:
                near = np.argpartition(-s, min(k, len(ids) - 1) - 1, axis=1)[:, :k]
                np.put_along_axis(keep, near, True, axis=1)
            np.fill_diagonal(keep, False)
            i, j = np.nonzero(keep)
            u, v, c, l = np.append(ids[i], ids[j]), np.append(ids[j], ids[i]), np.tile(s[i, j], 2), np.tile(link[i, j], 2)
            block = np.full(len(u), -1)
            if t == 0:
                u, v, c, l = np.concatenate((u, ids)), np.concatenate((v, ids)), np.concatenate((c, np.ones(len(ids)))), np.concatenate((l, np.zeros(len(ids), bool)))
                block = np.concatenate((block, np.full(len(ids), part * 1_000_000 + leaf // LEAVES_A_BLOCK)))
            leaf += 1
            yield batch_from({"u": u, "v": v, "s": c, "link": l, "block": block}, out)

    return _ordered(units, seed, TREES, rows).mapInArrow(leaves, "u long, v long, s double, link boolean, block long")


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """(id, near array<struct<d, v, link>>): the k nearest, and all within reach; d is the negative similarity."""
    near = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("d"), F.col("v").alias("v"), F.col("link").alias("link"))))
    return edges.groupBy("u", "v").agg(F.max("s").alias("s"), F.max("link").alias("link")).groupBy(F.col("u").alias("id")).agg(near.alias("near")).withColumn("near", F.filter("near", lambda x, i: (i < k) | x.link))


def _round(units: DataFrame, lists: DataFrame, blocks: DataFrame, active: DataFrame, theta: float, k: int, turn: int) -> DataFrame:
    """(u, v, s, link): better neighbours and links that the active nodes find among neighbours of neighbours."""
    draw = lambda x: F.struct(F.xxhash64(x.v, "id", F.lit(turn)).alias("h"), x.v.alias("v"))
    rest = F.slice(F.array_sort(F.transform(F.slice("near", 7, 1 << 30), draw)), 1, 12)
    ask = F.concat(F.transform(F.slice("near", 1, 6), lambda x: x.v), F.transform(rest, lambda x: x.v))
    own = lists.join(active, "id", "left_semi").join(blocks, "id").select("block", "id", F.transform("near", lambda x: x.v).alias("near"), F.when(F.size("near") >= k, -F.element_at("near", k).d).otherwise(F.lit(-2.0)).alias("worst"), ask.alias("ask"))
    own = cut(own)
    wanted = own.select("block", F.explode("ask").alias("w")).distinct()
    seen = cut(wanted.join(lists.withColumnRenamed("id", "w"), "w").select("block", "w", F.concat(F.array("w"), F.transform("near", lambda x: x.v)).alias("vs")))
    need = seen.select("block", F.explode("vs").alias("c")).union(own.select("block", F.col("id").alias("c"))).distinct()
    x = need.join(units.withColumnRenamed("id", "c"), "c").select("block", F.col("c").alias("w"), F.lit(None).cast("array<long>").alias("vs"), "x", "rad")
    side = seen.withColumn("x", F.lit(None).cast("array<double>")).withColumn("rad", F.lit(0.0)).union(x)
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("s", pa.float64()), ("link", pa.bool_())])

    def compare(own: pa.Table, side: pa.Table) -> pa.Table:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))]
        if own.num_rows and side.num_rows:
            is_x = side.column("x").is_valid().to_numpy()
            with_x = side.filter(pa.array(is_x))
            ids = with_x.column("w").to_numpy()
            order = np.argsort(ids)
            ids, x, rad = ids[order], matrix(with_x.column("x"))[order], with_x.column("rad").to_numpy()[order]
            lists = side.filter(pa.array(~is_x))
            of = dict(zip(lists.column("w").to_pylist(), lists.column("vs").combine_chunks(), strict=True)) if lists.num_rows else {}
            for u, near, worst, ask in zip(own.column("id").to_pylist(), own.column("near"), own.column("worst").to_pylist(), own.column("ask").to_pylist(), strict=True):
                got = [of[w].values.to_numpy() for w in ask if w in of]
                if not got:
                    continue
                c = np.setdiff1d(np.concatenate(got), np.append(near.values.to_numpy(), u))
                if not len(c):
                    continue
                at, me = np.searchsorted(ids, c), np.searchsorted(ids, u)
                s = x[at] @ x[me]
                link = s >= _reach(theta, rad[at], rad[me])
                good = np.flatnonzero(link | (s > worst))
                if len(good) > k:
                    cut_at = np.partition(-s[good], k - 1)[k - 1]
                    good = good[link[good] | (-s[good] <= cut_at)]
                me = np.full(len(good), u)
                parts += [(me, c[good], s[good], link[good]), (c[good], me, s[good], link[good])]
        return pa.table([np.concatenate(p) for p in zip(*parts, strict=True)], schema=schema)

    side = side.withColumnRenamed("block", "at")  # the two sides share an ancestor, and so may not share a name
    return own.groupBy("block").cogroup(side.groupBy("at")).applyInArrow(compare, "u long, v long, s double, link boolean")


_PAIR, _PAIR_SQL = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("s", pa.float64())]), "u long, v long, s double"


def _audit(units: DataFrame, lists: DataFrame, theta: float, sample: int) -> tuple[float | None, DataFrame]:
    """(mean share of what is within reach of a node that its list has, those true pairs (u, v, s)) of the nodes with the smallest hashes.

    The share is None where too few drawn nodes have anything within reach, so that nothing is known. With all nodes drawn it is exact.
    """
    while True:
        asked = units.orderBy(F.xxhash64("id", F.lit(77)), "id").limit(sample).collect()
        names, q, own = np.array([r.id for r in asked], np.int64), np.array([r.x for r in asked]), np.array([r.rad for r in asked])

        def brute(batches, names=names, q=q, own=own):
            for b in batches:
                if not b.num_rows:
                    continue
                s = q @ matrix(b.column(1)).T
                i, j = np.nonzero(s >= _reach(theta, own[:, None], b.column(2).to_numpy()))
                u, v = names[i], b.column(0).to_numpy()[j]
                other = u != v
                yield batch_from({"u": u[other], "v": v[other], "s": s[i, j][other]}, _PAIR)

        true = cut(units.select("id", "x", "rad").mapInArrow(brute, _PAIR_SQL)) if len(asked) else units.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(0.0).alias("s")).limit(0)
        have = lists.select(F.col("id").alias("u"), F.explode(F.filter("near", lambda x: x.link)).alias("x")).select("u", F.col("x.v").alias("v"), F.lit(1).alias("found"))
        r = true.join(have, ["u", "v"], "left").groupBy("u").agg(F.avg(F.coalesce("found", F.lit(0))).alias("share")).agg(F.count("*").alias("n"), F.avg("share").alias("share")).first()
        if r.n >= ENOUGH or len(asked) < sample:
            return (1.0 if r.share is None else r.share), true
        sample *= 2
        if sample > AUDIT_MOST:
            return None, true


def _all_pairs(units: DataFrame, theta: float) -> DataFrame:
    """(u, v, s), u > v, of all pairs within reach, by comparing everything in blocks of two parts."""
    parts = max(1, -(-units.count() // PART))
    part = F.pmod(F.xxhash64("id", F.lit(79)), F.lit(parts))
    at = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda o: F.struct(F.least(o, "part").alias("p"), F.greatest(o, "part").alias("q")))
    blocks = units.withColumn("part", part).withColumn("at", F.explode(at)).select("at.p", "at.q", "part", "id", "x", "rad")

    def compare(t: pa.Table) -> pa.Table:
        ids, x, rad, part = t.column("id").to_numpy(), matrix(t.column("x")), t.column("rad").to_numpy(), t.column("part").to_numpy()
        left, right = np.flatnonzero(part == t.column("p")[0].as_py()), np.flatnonzero(part == t.column("q")[0].as_py())
        out, other = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], x[right].T
        for low in range(0, len(left), 500):
            own = left[low : low + 500]
            s = x[own] @ other
            i, j = np.nonzero(s >= _reach(theta, rad[own][:, None], rad[right]))
            out.append((ids[own][i], ids[right][j], s[i, j]))
        u, v, s = (np.concatenate(p) for p in zip(*out, strict=True))
        return pa.table([np.maximum(u, v)[u != v], np.minimum(u, v)[u != v], s[u != v]], schema=_PAIR)

    return blocks.groupBy("p", "q").applyInArrow(compare, _PAIR_SQL).groupBy("u", "v").agg(F.max("s").alias("s"))


def links(units: DataFrame, theta: float, k: int = 10, recall: float = 0.995, sample: int = 2000) -> tuple[DataFrame, float | None]:
    """((u, v, s) with u > v, audited recall): pairs of units (id, x, rad) within reach of each other; the recall is 1 where all pairs were compared."""
    edges, blocks = None, None
    rows = units.count()
    flat = lambda lists: lists.select(F.col("id").alias("u"), F.explode("near").alias("x")).select("u", F.col("x.v").alias("v"), (-F.col("x.d")).alias("s"), F.col("x.link").alias("link"))
    names = lambda near: F.array_sort(F.transform(near, lambda x: x.v))
    for seed in range(SEEDS):
        start = cut(_orderings(units, theta, k, seed, rows))
        if blocks is None:
            blocks = start.where("u = v").select(F.col("u").alias("id"), "block")
        fresh = start.where("u <> v").select("u", "v", "s", "link")
        edges = fresh if edges is None else edges.union(fresh)
        old = None if seed == 0 else lists  # noqa: F821
        lists = cut(_lists(edges, k))
        active, turn = lists.select("id"), 0
        if old is not None:  # only lists that the new orderings changed are searched again
            active = cut(lists.join(old.select("id", F.col("near").alias("old")), "id", "left").where(~names("near").eqNullSafe(names("old"))).select("id"))
        while active.limit(1).count():
            new = cut(_round(units, lists, blocks, active, theta, k, 100 * seed + turn))
            before = lists.select("id", F.col("near").alias("old"))
            lists = cut(_lists(flat(lists).union(new), k))
            active = cut(lists.join(before, "id", "left").where(~names("near").eqNullSafe(names("old"))).select("id"))
            turn += 1
            if turn > 1 and not new.where("link").limit(1).count():
                break
        got, true = _audit(units, lists, theta, sample)
        log.info("audited recall %s after %d orderings and %d rounds", got, TREES * (seed + 1), turn)
        if got is None:  # so few links that an audit tells nothing
            break
        if got >= recall:
            one = flat(lists).where("link").select("u", "v", "s").union(true)
            return cut(one.groupBy(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).agg(F.max("s").alias("s"))), got
        edges = flat(lists)
    log.warning("audited recall %s is unknown or short of %s: all pairs of representatives are compared", got, recall)
    return cut(_all_pairs(units, theta)), 1.0


def _partial(members: DataFrame, pairs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """For pairs (u, v) of clusters of which only some members may link: ((id, others) links of each member, (a, b) pairs with a link)."""
    parts = members.groupBy("rep").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("parts"))
    m = members.join(parts, "rep").select("rep", F.pmod(F.xxhash64("id", F.lit(81)), F.col("parts")).cast("int").alias("part"), "id", "x", "n")
    of = lambda c: parts.select(F.col("rep").alias(c), F.col("parts").alias(f"n{c}"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(f"n{c}") - 1)).alias(f"p{c}")
    blocks = pairs.select("u", "v").join(of("u"), "u").join(of("v"), "v").select("u", "v", each("u"), "nv").select("u", "v", "pu", each("v"))
    blocks = cut(blocks)
    side = lambda c, k: blocks.join(m, (F.col(c) == F.col("rep")) & (F.col(f"p{c}") == F.col("part"))).select("u", "v", "pu", "pv", F.lit(k).alias("side"), "id", "x", "n")
    schema = pa.schema([("id", pa.int64()), ("others", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def compare(t: pa.Table) -> pa.Table:
        ids, x, n, of = t.column("id").to_numpy(), matrix(t.column("x")), t.column("n").to_numpy(), t.column("side").to_numpy()
        left, right = np.flatnonzero(of == 0), np.flatnonzero(of == 1)
        link = x[left] @ x[right].T >= threshold
        others = np.concatenate((link @ n[right], n[left] @ link))
        who, some = np.concatenate((ids[left], ids[right])), others > 0
        u, v = t.column("u")[0].as_py(), t.column("v")[0].as_py()
        return pa.table([who[some], others[some], np.full(some.sum(), u), np.full(some.sum(), v)], schema=schema)

    got = cut(side("u", 0).union(side("v", 1)).groupBy("u", "v", "pu", "pv").applyInArrow(compare, "id long, others long, a long, b long"))
    return got.groupBy("id").agg(F.sum("others").alias("others")), got.select("a", "b").distinct()


def _inside(members: DataFrame, loose: DataFrame, threshold: float) -> DataFrame:
    """(id, others): the members of its own loose cluster (rep) that each one links with, counted with their copies, in blocks of two parts."""
    parts = loose.select("rep", F.ceil(F.col("members") / INSIDE).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id", F.lit(83)), F.col("parts")).cast("int")
    at = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, "part").alias("p"), F.greatest(o, "part").alias("q")))
    blocks = members.join(parts, "rep").withColumn("part", part).withColumn("at", F.explode(at)).select("rep", "at.p", "at.q", "part", "id", "x", "n")
    schema = pa.schema([("id", pa.int64()), ("others", pa.int64())])

    def compare(t: pa.Table) -> pa.Table:
        ids, x, n, of = t.column("id").to_numpy(), matrix(t.column("x")), t.column("n").to_numpy(), t.column("part").to_numpy()
        p, q = t.column("p")[0].as_py(), t.column("q")[0].as_py()
        left, right, others = np.flatnonzero(of == p), np.flatnonzero(of == q), np.zeros(len(ids), np.int64)
        for low in range(0, len(left), 1000):
            own = left[low : low + 1000]
            link = x[own] @ x[right].T >= threshold
            if p == q:  # both sides are the same rows
                link[np.arange(len(own)), np.arange(low, low + len(own))] = False
            others[own] += link @ n[right]
            if p != q:
                others[right] += n[own] @ link
        return pa.table([ids, others], schema=schema)

    return blocks.groupBy("rep", "p", "q").applyInArrow(compare, "id long, others long").groupBy("id").agg(F.sum("others").alias("others"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, **options) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    A vector is an id with its components: rows with one id and different vectors are all compared, rows that repeat both count once and each get the result. A vector that is null, zero, of another
    length than most or has null or non-finite components links with nothing. Copies of one vector link with each other and with the same others. A row with a null id
    has no links and a null component, and is kept. A similarity of exactly the threshold links. An empty table gives an empty result; other columns may have any names.
    """
    theta = float(np.arccos(threshold))
    rows = cut(flagged(vectors))
    v = rows.where("v is not null")
    groups = cut(v.distinct().groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("n")))
    groups = cut(groups.withColumn("id", F.monotonically_increasing_id()))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    nodes = cut(groups.withColumn("norm", norm).select("id", F.transform("v", lambda x: x / F.col("norm")).alias("x"), "n"))
    members = cover(nodes, theta)
    clusters = cut(members.groupBy("rep").agg(F.max("angle").alias("rad"), F.sum("n").alias("total"), F.count("*").alias("members")))
    units = cut(clusters.join(nodes, F.col("rep") == F.col("id")).select("id", "x", "rad"))
    pairs, _ = links(units, theta, **options)
    of = lambda c: clusters.select(F.col("rep").alias(c), F.col("rad").alias(f"r{c}"), F.col("total").alias(f"t{c}"))
    known = pairs.join(of("u"), "u").join(of("v"), "v").withColumn("angle", F.acos(F.least("s", F.lit(1.0))))
    lone = F.col("ru") + F.col("rv") == 0
    whole = F.when(lone, F.col("s") >= threshold).otherwise(F.col("angle") + F.col("ru") + F.col("rv") <= theta - _ROUNDING)
    known = cut(known.withColumn("whole", whole).where(~lone | F.col("whole")))
    sure = known.where("whole")
    by_size = sure.select(F.col("u").alias("rep"), F.col("tv").alias("all")).union(sure.select(F.col("v").alias("rep"), F.col("tu").alias("all"))).groupBy("rep").agg(F.sum("all").alias("all"))
    some, touching = _partial(members, known.where("not whole"), threshold)
    loose = clusters.where(F.col("rad") > theta / 2 - _ROUNDING)
    inside = _inside(members, loose, threshold).withColumnRenamed("others", "inside")
    comp = components(sure.select(F.col("u").alias("a"), F.col("v").alias("b")).union(touching))
    # the smallest id of a component is that of its smallest row, not of its smallest representative
    label = members.select("id", "rep", "n").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("id", "rep", "n", F.coalesce("comp", "rep").alias("comp"))
    label = cut(label.join(groups.select("id", "low"), "id"))
    least = label.groupBy("comp").agg(F.min("low").alias("component_id"))
    own = F.when(F.col("rad") > theta / 2 - _ROUNDING, F.col("n") - 1 + F.coalesce("inside", F.lit(0))).otherwise(F.col("total") - 1)
    node = (
        label.join(least, "comp")
        .join(clusters.select("rep", "total", "rad"), "rep")
        .join(by_size, "rep", "left")
        .join(some, "id", "left")
        .join(inside, "id", "left")
        .select("id", (own + F.coalesce("all", F.lit(0)) + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    )
    found = v.join(groups.select("v", "id"), "v").join(node, "id").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    out = found.union(rows.where("v is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
