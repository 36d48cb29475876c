"""The prefix trie of conversations, by distributed MSD radix partitioning and multikey quicksort.

Turns are dictionary-encoded: each distinct (role, text) gets a number, and from there on only slim rows (conversation, position, turn number, bytes) move.

A bucket holds conversations that share all turns up to a depth. One of more than LOCAL_TURNS rows is partitioned again: a member drawn by a hash is the pivot, and every
other member is dealt by its digit, (where it leaves the pivot's turns, the turn that it takes there). So one round passes through all positions that the bucket has in
common, copies of the pivot and members that end on its way are done with, and a bucket shrinks as in quicksort: the number of rounds grows with the logarithm of the
conversations, not with their length. The pivot's own nodes, the trunk, are emitted on the way. Smaller buckets go to one task each, which finishes them by multikey quicksort.
Sums over subtrees come from below: buckets hand the totals of their top node to the trunk they hang on, where they are summed from the deep end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, new_path

#: Rows of a bucket that one task finishes.
LOCAL_TURNS = 50_000
#: Turns that are more than 1 / COMMON of all, and more than COMMON rows, meet the dictionary by a broadcast of at most COMMON rows.
COMMON = 10_000
#: Tables of so many slim rows are broadcast; larger ones are joined by their keys.
SMALL = 100_000
#: Positions of a trunk that are summed in one window.
BLOCK = 10_000
EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("up", pa.string()), ("base", pa.int64())])


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def borrowed_turns(conv_id: Column) -> Column:
    """How many turns of its group's first conversation a conversation begins with."""
    return (F.crc32(conv_id.cast("string")) % 9).cast("long")


def _numbered(turns: DataFrame) -> DataFrame:
    """conv_id, p (place from 0), tid, bytes, of which no text is moved.

    Places come from a sort by ranges: a range numbers its own rows of a conversation, and a small table of (conversation, range) counts adds what stands before, so
    a conversation of any length is spread over ranges.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    dealt = slim.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange("conv_id", *order, "_salt").drop("_salt")
    rows = cut(dealt.withColumn("block", F.spark_partition_id()))
    names = cut(rows.groupBy("digest").agg(F.count("*").alias("_n")).withColumn("tid", F.monotonically_increasing_id()))
    total = names.agg(F.sum("_n")).first()[0] or 0
    often = F.col("_n") > max(COMMON, total // COMMON)
    known = rows.join(F.broadcast(names.where(often).select("digest", "tid")), "digest", "left")
    rare = known.where("tid is null").drop("tid").join(names.where(~often).select("digest", "tid"), "digest")
    coded = known.where("tid is not null").unionByName(rare)
    counts = cut(rows.groupBy("conv_id", "block").agg(F.count("*").alias("n")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(*order)) - 1
    placed = coded.withColumn("_i", own).join(counts.select("conv_id", "block", before.alias("_before")), ["conv_id", "block"])
    return placed.select("conv_id", (F.col("_before") + F.col("_i")).alias("p"), "tid", "bytes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, tid, bytes) of rebuilt conversations; pos 0, with turn number -1, is the root that all share."""
    rows = cut(_numbered(turns))
    length = rows.groupBy("conv_id").agg((F.max("p") + 1).alias("len"))
    convs = cut(length.select("conv_id", "len", (F.col("conv_id") - F.col("conv_id") % 5).alias("first"), borrowed_turns(F.col("conv_id")).alias("h")))
    heads = convs.select(F.col("conv_id").alias("first"), F.col("len").alias("_len"))
    convs = cut(convs.join(heads, "first", "left").select("conv_id", "first", "h", F.least("h", F.coalesce("_len", F.lit(0))).alias("m")))
    # the borrowed turns of each conversation; nine at most share a first one
    lent = rows.where("conv_id % 5 = 0 and p < 8").select(F.col("conv_id").alias("first"), "p", "tid", "bytes").join(convs, "first").where("p < h")
    own = rows.where(F.col("p") >= borrowed_turns(F.col("conv_id"))).join(convs.select("conv_id", "h", "m"), "conv_id")
    parts = [
        lent.select("conv_id", (F.col("p") + 1).alias("pos"), "tid", "bytes"),
        own.select("conv_id", (F.col("m") + F.col("p") - F.col("h") + 1).alias("pos"), "tid", "bytes"),
        convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(-1).cast("long").alias("tid"), F.lit(0).cast("long").alias("bytes")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _from_below(rows: DataFrame, sums: tuple[str, ...], least: tuple[str, ...] = ()) -> DataFrame:
    """rows (bucket, pos, ..) with each named column summed, or its least taken, over the bucket's rows from pos on. BLOCK positions are one window, and blocks another."""
    rows = rows.withColumn("_b", F.floor(F.col("pos") / BLOCK))
    each = rows.groupBy("bucket", "_b").agg(*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in least])
    deeper = Window.partitionBy("bucket").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("bucket", "_b", *[F.sum(c).over(deeper).alias(f"_{c}") for c in sums], *[F.min(c).over(deeper).alias(f"_{c}") for c in least])
    inside = Window.partitionBy("bucket", "_b").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    found = {c: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.coalesce(f"_{c}", F.lit(0)) for c in sums} | {c: F.least(F.min(c).over(inside), f"_{c}") for c in least}
    return rows.join(each, ["bucket", "_b"]).withColumns(found).drop("_b", *[f"_{c}" for c in (*sums, *least)])


def _partition(rows: DataFrame, buckets: DataFrame, turn: int, local: int):
    """One round over buckets (conv_id, bucket, base, above, up): (trunk nodes, members that end on them, next: members with their new bucket and whether it is large).

    base is the depth of the node that a bucket hangs on, above that node's conv_id, up its bucket.
    """
    pivots = buckets.groupBy("bucket", "base", "above", "up").agg(F.min_by("conv_id", F.struct(F.xxhash64(F.lit(turn), "conv_id"), "conv_id")).alias("conv_id"))
    trunk = cut(rows.join(_small(cut(pivots)), "conv_id").where("pos > base").select("bucket", "base", "above", "up", "pos", F.col("tid").alias("_tid"), "bytes"))
    there = rows.join(buckets.select("conv_id", "bucket", "base"), "conv_id").where("pos > base").join(_small(trunk.select("bucket", "pos", "_tid")), ["bucket", "pos"], "left")
    leaves = F.min(F.when(F.col("_tid").isNull() | (F.col("_tid") != F.col("tid")), F.struct("pos", "tid"))).alias("off")
    found = there.groupBy("bucket", "conv_id").agg(leaves, F.max("pos").alias("last"))
    found = cut(found.select("bucket", "conv_id", "off", "last", F.coalesce(F.col("off.pos") - 1, F.col("last")).alias("pos")))
    stay = found.groupBy("bucket", "pos").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    trunk = cut(_from_below(trunk.drop("_tid").join(stay, ["bucket", "pos"], "left"), ("n_convs",), ("conv_id",)))
    off = found.where("off is not null").select("conv_id", F.concat_ws("/", "bucket", F.concat(F.col("off.pos"), F.lit(":"), F.col("off.tid"))).alias("next"), F.col("bucket").alias("up"), "pos", (F.col("last") - F.col("pos")).alias("rows"))
    large = cut(off.groupBy("next").agg(F.sum("rows").alias("rows")).where(F.col("rows") > local).select("next", F.lit(True).alias("large")))
    hangs = trunk.select(F.col("bucket").alias("up"), "pos", F.col("conv_id").alias("above"))
    dealt = off.join(_small(hangs), ["up", "pos"]).join(_small(large), "next", "left")
    following = cut(dealt.select("conv_id", F.col("next").alias("bucket"), F.col("pos").alias("base"), "above", "up", F.coalesce("large", F.lit(False)).alias("large")))
    return trunk, found.where("off is null").select("bucket", "pos", "conv_id"), following


class _Bucket:
    """The nodes of one bucket, by multikey quicksort: members are split around a turn into less, same and more, and the same go on at the next turn."""

    def __init__(self, base: int, above: int | None, up: str | None):
        self.base, self.above, self.up = base, above, up
        self.convs: list[int] = []
        self.turns: list[list[int]] = []
        self.sizes: list[list[int]] = []

    def nodes(self) -> list[list]:
        convs, turns, sizes = self.convs, self.turns, self.sizes
        low, depth, above, n, size, ends, kids = [], [], [], [], [], [], []

        def node(members: list[int], k: int, parent: int, ended: list[int]) -> int:
            low.append(min(convs[i] for i in members))
            depth.append(k)
            above.append(parent)
            n.append(len(members))
            size.append(sizes[members[0]][k])
            ends.append(hashlib.sha256(",".join(map(str, sorted(convs[i] for i in ended))).encode()).hexdigest() if ended else EMPTY)
            kids.append(0)
            if parent >= 0:
                kids[parent] += 1
            return len(low) - 1

        work = [(list(range(len(convs))), 0, -1)]
        while work:
            members, k, parent = work.pop()
            if len(members) == 1:
                last = len(turns[members[0]]) - 1
                for at in range(k, last + 1):
                    parent = node(members, at, parent, members if at == last else [])
                continue
            middle = turns[members[len(members) // 2]][k]
            same = [i for i in members if turns[i][k] == middle]
            if len(same) < len(members):
                for side in ([i for i in members if turns[i][k] > middle], [i for i in members if turns[i][k] < middle]):
                    if side:
                        work.append((side, k, parent))
            ended = [i for i in same if len(turns[i]) == k + 1]
            at = node(same, k, parent, ended)
            if len(ended) < len(same):
                work.append(([i for i in same if len(turns[i]) > k + 1], k + 1, at))
        leaves = [int(c == 0) for c in kids]
        saved = [(c - 1) * s for c, s in zip(n, size, strict=True)]
        for i in range(len(low) - 1, -1, -1):  # a node stands after the one above it
            if above[i] >= 0:
                leaves[above[i]] += leaves[i]
                saved[above[i]] += saved[i]
        top = [a < 0 for a in above]
        return [low, [self.base + 1 + d for d in depth], [self.above if a < 0 else low[a] for a in above], n, kids, leaves, saved, ends, [self.up if t else None for t in top], [self.base if t else None for t in top]]


def _finish(batches):
    """Nodes of buckets whose rows (conv_id, bucket, base, above, up, pos, tid, bytes) come in order of bucket, conversation and position."""
    name, now, out, count = None, None, [[] for _ in _NODE], 0

    def flush():
        nonlocal out, count
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _NODE, strict=True)], schema=_NODE)
        out, count = [[] for _ in _NODE], 0
        return batch

    def close():
        nonlocal count
        if now is not None:
            for column, more in zip(out, now.nodes(), strict=True):
                column.extend(more)
            count = len(out[0])

    for b in batches:
        conv, bucket, base, above, up, _, tid, size = (b.column(i) for i in range(8))
        ids = conv.to_numpy()
        bounds = np.concatenate(([0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)])) if len(ids) else [0]
        tids, sizes, firsts = tid.to_pylist(), size.to_pylist(), pa.array(bounds[:-1], pa.int64())
        names, bases, aboves, ups = (c.take(firsts).to_pylist() for c in (bucket, base, above, up))
        for k in range(len(bounds) - 1):
            s, e = int(bounds[k]), int(bounds[k + 1])
            if names[k] != name:
                close()
                if count >= 10_000:
                    yield flush()
                name, now = names[k], _Bucket(bases[k], aboves[k], ups[k])
            if not now.convs or now.convs[-1] != ids[s]:
                now.convs.append(int(ids[s]))
                now.turns.append([])
                now.sizes.append([])
            now.turns[-1] += tids[s:e]
            now.sizes[-1] += sizes[s:e]
    close()
    if count:
        yield flush()


def _hashes(ends: DataFrame) -> DataFrame:
    """bucket, pos, ends_sha256 of (bucket, pos, conv_id). Ids stream in order through one hash a node and are never held; the hash itself has no parallel form."""
    schema = pa.schema([("bucket", pa.string()), ("pos", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches):
        key, h = None, None
        for b in batches:
            keys, ids = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), b.column(2).to_pylist()
            done, s = [], 0
            while s < len(keys):
                e = s + 1
                while e < len(keys) and keys[e] == keys[s]:
                    e += 1
                if keys[s] != key:
                    if h is not None:
                        done.append((*key, h.hexdigest()))
                    key, h = keys[s], hashlib.sha256()
                else:
                    h.update(b",")
                h.update(",".join(map(str, ids[s:e])).encode())
                s = e
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], schema.field(i).type) for i in range(3)], schema=schema)
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], schema.field(i).type) for i, v in enumerate((*key, h.hexdigest()))], schema=schema)

    return ends.repartition("bucket", "pos").sortWithinPartitions("bucket", "pos", "conv_id").mapInArrow(run, "bucket string, pos long, ends_sha256 string")


def _sums(tops: DataFrame) -> DataFrame:
    return tops.groupBy("bucket", "pos").agg(*[F.sum(c).alias(c) for c in ("kids", "leaves", "saved")])


def trie(turns: DataFrame, local: int = LOCAL_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    turns: conv_id, turn, role, text; other columns are not read. A null role or text is empty; a null turn comes first; turns of one number are ordered by a digest of role
    and text, and repeated rows each count. Rows without a conv_id belong to no conversation. A conversation may be as long as it likes. No conversation, no node.
    """
    spark = turns.sparkSession
    path = new_path(spark, "turns")
    rebuilt(turns).write.parquet(path)
    rows = spark.read.parquet(path)
    nowhere = [F.lit("").alias("bucket"), F.lit(-1).cast("long").alias("base"), F.lit(None).cast("long").alias("above"), F.lit(None).cast("string").alias("up")]
    everyone = rows.where("pos = 0").select("conv_id", *nowhere)
    dealt, trunks, ends, finished = everyone.withColumn("large", F.lit(rows.count() > local)), [], [], []
    while True:
        finished.append(dealt.where("not large").drop("large"))
        large = dealt.where("large").drop("large")
        if not large.limit(1).count():
            break
        trunk, ended, dealt = _partition(rows, large, len(trunks), local)
        trunks.append(trunk)
        ends.append(ended)
    small = finished[0]
    for more in finished[1:]:
        small = small.unionByName(more)
    there = rows.join(small, "conv_id").where("pos > base").select("conv_id", "bucket", "base", "above", "up", "pos", "tid", "bytes")
    kinds = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, up string, base long"
    found = new_path(spark, "nodes")
    there.repartition("bucket").sortWithinPartitions("bucket", "conv_id", "pos").mapInArrow(_finish, kinds).write.parquet(found)
    nodes = spark.read.schema(kinds).parquet(found)
    out = nodes.drop("up", "base")
    if not trunks:
        return out
    hung = nodes.where("base is not null").select(F.col("up").alias("bucket"), F.col("base").alias("pos"), F.lit(1).cast("long").alias("kids"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    tops, all_ends = cut(_sums(hung)), ends[0]
    for more in ends[1:]:
        all_ends = all_ends.unionByName(more)
    hashes = cut(_hashes(all_ends))
    for trunk in reversed(trunks):
        last = trunk.groupBy("bucket").agg(F.max("pos").alias("_last"))
        above = trunk.select("bucket", (F.col("pos") + 1).alias("pos"), F.col("conv_id").alias("_parent"))
        t = trunk.join(tops, ["bucket", "pos"], "left").join(last, "bucket").join(above, ["bucket", "pos"], "left").join(hashes, ["bucket", "pos"], "left")
        t = t.withColumn("n_children", F.coalesce("kids", F.lit(0)) + (F.col("pos") < F.col("_last")).cast("long"))
        t = t.withColumns({"leaves": F.coalesce("leaves", F.lit(0)) + (F.col("n_children") == 0).cast("long"), "saved": F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("bytes")})
        t = cut(_from_below(t, ("leaves", "saved")))
        out = out.unionByName(t.select("conv_id", F.col("pos").alias("depth"), F.coalesce("_parent", "above").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")))
        mine = t.where("pos = base + 1").select(F.col("up").alias("bucket"), F.col("base").alias("pos"), F.lit(1).cast("long").alias("kids"), "leaves", "saved")
        tops = cut(_sums(tops.unionByName(mine)))
    return out
