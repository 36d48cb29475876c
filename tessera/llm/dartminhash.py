"""Near-duplicate documents by DartMinHash over weighted shingles.

A document is a weighted set: its five-word shingles, each as heavy as it occurs often.
Over each element's line of weights hashed darts fall with ranks that arrive as a Poisson process; a document
sees the darts that lie under its weights and below the rank limit at which so many darts in all
are expected. Each dart has a coordinate; the earliest one of each coordinate is the signature.
Two signatures agree in a coordinate with the weighted Jaccard similarity. The work is one
draw an element plus about k*ln(k) darts, whatever the weights.

Signatures are cut into bands. Documents with one band in common are compared with
the centre of their bucket, its smallest document, exactly, on whole texts; those of large buckets then with a second centre. Tests run in rounds,
and one whose two are in one class by then is left out, so a document has no more than two tests a band and classes grow as a contracted graph. That joins
most groups. Then all pairs of a bucket that are not in one class yet are compared too, in blocks of bounded size; only pairs
within the bucket's largest class are left out, as they change nothing. So every similar pair that meets in a band is linked,
at a cost that grows with the square of what a bucket holds beside its largest class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm import kernels as K
from tessera.llm.common import cut, text_column, whole_row
from tessera.llm.components import components

BANDS, ROWS = 24, 5
#: The bands whose centres are asked first; they join most of a large group, whose further tests are then left out.
EARLY = 4
SHINGLE = 5
#: Documents on a side of a block of pairs, and columns of a block's dense product.
SIDE, COLUMNS = 128, 4096


def shingles(words: np.ndarray, first: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of the distinct shingles; a text of fewer words has itself as its one shingle."""
    n = np.diff(first)
    h = K.window_hashes(words, width)
    at = np.arange(len(h))
    doc = np.repeat(np.arange(len(n)), n)
    inside = at + width <= first[doc[: len(h)] + 1] if len(h) else np.zeros(0, bool)
    small = np.flatnonzero((n > 0) & (n < width))
    doc = np.concatenate((doc[: len(h)][inside], small))
    short = words[first[small]] if len(small) else np.zeros(0, np.uint64)
    for j in range(1, width - 1):
        more = n[small] > j
        short[more] = K.join_hashes(short[more], words[first[small[more]] + j])
    h = np.concatenate((h[inside], K.mix(short + n[small].astype(np.uint64))))
    if not len(h):
        return doc, h, np.zeros(0, np.int64)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    return doc[start], h[start], np.diff(np.append(start, len(h)))


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int = BANDS * ROWS) -> np.ndarray:
    """uint64 [docs, k]; rows of documents without elements are 0.

    An element's weights are cut into the regions [0,1), [1,2), [2,4), [4,8) and so on. In a region of width o darts arrive
    at rate o; each has a coordinate and a place in the region, and counts if that lies below the weight.
    """
    sig = np.zeros((docs, k), np.uint64)
    total = np.bincount(doc, weight, minlength=docs)
    todo = total > 0
    darts = k * (np.log(k) + 2.0)
    while todo.any():
        limit = darts / np.maximum(total, 1e-300)
        use = todo[doc]
        d, e, w = doc[use], element[use], weight[use].astype(np.float64)
        best = np.full(docs * k, np.inf)
        keys, ranks, names = [], [], []
        region, low = 0, 0.0
        while len(d):
            high = 1.0 if region == 0 else low * 2 if low else 2.0
            width = high - low
            dd, ee, ww, r = d, e, w, np.zeros(len(d))
            turn = 0
            while len(dd):
                h = K.mix(ee + np.uint64((region * 0x9E3779B97F4A7C15 + turn * 0xC2B2AE3D27D4EB4F + 0x165667B1) & (2**64 - 1)))
                r = r - np.log(_unit(h)) / width
                live = r <= limit[dd]
                dd, ee, ww, r, h = dd[live], ee[live], ww[live], r[live], h[live]
                name = K.mix(h ^ np.uint64(0x5851F42D4C957F2D))
                place = low + width * ((name & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
                under = place < ww
                key = dd[under] * k + ((name[under] >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
                np.minimum.at(best, key, r[under])
                keys.append(key)
                ranks.append(r[under])
                names.append(name[under])
                turn += 1
            more = w > high
            d, e, w = d[more], e[more], w[more]
            low, region = high, region + 1
        key, rank, name = np.concatenate(keys), np.concatenate(ranks), np.concatenate(names)
        win = rank == best[key]
        sig.reshape(-1)[key[win]] = name[win]
        todo = todo & ~np.isfinite(best.reshape(docs, k)).all(axis=1)  # a coordinate without a dart: look further out
        darts *= 2
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros((len(sig), bands), np.uint64)
        rows = sig.shape[1] // bands
        for j in range(rows):
            out = K.mix(out * np.uint64(31) + sig[:, j::rows][:, :bands])
        return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets given as sorted elements and weights."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][at] == a[0]
    both = int(np.minimum(a[1][hit], b[1][at[hit]]).sum())
    return both / float(a[1].sum() + b[1].sum() - both)


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, f1, f2 (the 128 bits of a digest of the whole word sequence), words, bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("words", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            for row, data, off in K.chunks(b.column(1)):
                s, e, first = K.word_bounds(data, off)
                words = K.span_hashes(data, s, e)
                n = len(off) - 1
                keys = K.signed(band_keys(signatures(*shingles(words, first), n)))
                count = np.diff(first)
                lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BANDS, keys.ravel())
                digest = K.signed(K.text_digests(data, off))
                cols = [b.column(0).slice(row, n), digest[:, 0].copy(), digest[:, 1].copy(), count.astype(np.int64), lists]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], schema=schema)

    return text_column(docs).mapInArrow(run, "doc_id long, f1 long, f2 long, words long, bands array<long>")


def _verify(texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose whole texts have weighted Jaccard similarity of threshold or more."""
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def sets(column) -> list:
        out = []
        for _, data, off in K.chunks(column):
            s, e, first = K.word_bounds(data, off)
            doc, h, w = shingles(K.span_hashes(data, s, e), first)
            at = np.searchsorted(doc, np.arange(len(off)))
            out += [(h[at[i] : at[i + 1]], w[at[i] : at[i + 1]]) for i in range(len(off) - 1)]
        return out

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                same = [weighted_jaccard(x, y) >= threshold for x, y in zip(sets(b.column(2)), sets(b.column(3)), strict=True)]
                keep = pa.array(same, pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], schema=schema)

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return joined.mapInArrow(run, "a long, b long")


def common_weights(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """[rows, cols]: summed smaller weights of the documents of ``rows`` and of ``cols`` (as by shingles), exactly. A document with itself is not asked."""
    # an element of weight w is w elements, numbered; the smaller weight is then the number of those in common
    turn = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
    with np.errstate(over="ignore"):
        name = K.mix(np.repeat(element, weight) + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    doc = np.repeat(doc, weight)
    row, col = np.full(docs, -1), np.full(docs, -1)
    row[rows], col[cols] = np.arange(len(rows)), np.arange(len(cols))
    _, code = np.unique(name, return_inverse=True)
    n = int(code.max(initial=-1)) + 1
    both = (np.bincount(code[row[doc] >= 0], minlength=n) > 0) & (np.bincount(code[col[doc] >= 0], minlength=n) > 0)
    both &= np.bincount(code, minlength=n) > 1
    keep = both[code]
    code, doc = (np.cumsum(both) - 1)[code[keep]], doc[keep]
    order = np.argsort(code, kind="stable")
    code, doc = code[order], doc[order]
    out = np.zeros((len(rows), len(cols)))
    for low in range(0, int(both.sum()), COLUMNS):
        a, b = np.searchsorted(code, (low, low + COLUMNS))
        c, d = code[a:b] - low, doc[a:b]
        left, right = np.zeros((len(rows), COLUMNS), np.float32), np.zeros((len(cols), COLUMNS), np.float32)
        of = row[d] >= 0
        left[row[d[of]], c[of]] = 1
        of = col[d] >= 0
        right[col[d[of]], c[of]] = 1
        out += left @ right.T
    return out


def _open(comp: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs (rep, centre) that are in different classes, each once."""
    p = pairs.where("rep <> centre").distinct().join(comp.withColumnRenamed("comp", "_c"), "rep")
    p = p.join(comp.select(F.col("rep").alias("centre"), F.col("comp").alias("_d")), "centre").where("_c <> _d")
    return p.select(F.greatest("rep", "centre").alias("a"), F.least("rep", "centre").alias("b")).distinct()


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (rep, comp) after further links (a, b), which may be repeated: classes are the nodes, so only those that a link touches are walked."""
    of = lambda end: comp.select(F.col("rep").alias(end), F.col("comp").alias(f"_{end}"))
    e = links.join(of("a"), "a").join(of("b"), "b").where("_a <> _b")
    top = components(e.select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b")).distinct())
    return cut(comp.join(top.select(F.col("id").alias("comp"), F.col("comp").alias("_top")), "comp", "left").select("rep", F.coalesce("_top", "comp").alias("comp")))


def spanning(ends: np.ndarray, nodes: int) -> list[int]:
    """Those rows of ends [n, 2] that join two parts which no earlier row has joined."""
    up, out = list(range(nodes)), []
    for k, pair in enumerate(ends.tolist()):
        for e in (0, 1):
            while up[pair[e]] != pair[e]:
                up[pair[e]] = up[up[pair[e]]]
                pair[e] = up[pair[e]]
        if pair[0] != pair[1]:
            up[pair[0]] = pair[1]
            out.append(k)
    return out


def _rest(texts: DataFrame, members: DataFrame, comp: DataFrame, threshold: float) -> DataFrame:
    """(a, b): of the similar pairs of different classes within one bucket so many that they join the same classes; those with its centres are decided.

    A bucket's largest class is one side, all others the other side. Large buckets with one largest class, whatever their bands, are
    taken as one, so that a pair that meets in many bands is compared once; of small ones those with the same members are one. Both sides are dealt at random
    into parts of about SIDE; a block is two parts that have to be compared. A block gives a forest of its classes, no more links than it has members.
    """
    undecided = f"n > 2 and rep <> first and (n <= {SIDE} or rep <> drawn)"
    m = cut(members.where(undecided).join(comp, "rep").select("band", "key", "n", "rep", F.col("comp").alias("label")))
    small = m.where(f"n <= {SIDE}").groupBy("band", "key").agg(F.sort_array(F.collect_list("rep")).alias("reps"), F.min("label").alias("low"), F.max("label").alias("high"))
    small = small.where("low <> high").groupBy("reps").agg(F.min(F.struct("band", "key")).alias("at")).select("at.band", "at.key")
    m = m.join(small, ["band", "key"], "left_semi").union(m.where(f"n > {SIDE}")).drop("n")
    sizes = m.groupBy("band", "key", "label").count().groupBy("band", "key")
    sizes = sizes.agg(F.max(F.struct("count", "label")).alias("top"), F.sum("count").alias("all"), F.count("*").alias("labels")).where("labels > 1")
    large = F.col("all") > SIDE
    sizes = sizes.select("band", "key", F.col("top.label").alias("top"), F.when(large, -1).otherwise(F.col("band")).alias("b"), F.when(large, F.col("top.label")).otherwise(F.col("key")).alias("k"))
    m = m.join(sizes, ["band", "key"]).select(F.col("b").alias("band"), F.col("k").alias("key"), "rep", "label", "top")
    m = cut(m.distinct().withColumn("main", F.col("label") == F.col("top")))
    parts = lambda main: F.ceil(F.count_if(F.col("main") == main) / SIDE).cast("long")
    m = m.join(m.groupBy("band", "key").agg(parts(False).alias("others"), parts(True).alias("same")), ["band", "key"])
    m = m.withColumn("part", F.pmod(F.xxhash64("rep", "band"), F.when(F.col("main"), F.col("same")).otherwise(F.col("others"))))
    # blocks (p, q): q is a part of the others from 0 on, or of the largest class as -1, -2, ..
    own = lambda p, q, side: F.struct(p.cast("long").alias("p"), q.cast("long").alias("q"), F.lit(side).alias("side"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    with_others = F.transform(upto(F.col("others")), lambda o: own(F.least(o, F.col("part")), F.greatest(o, F.col("part")), 0))
    with_main = F.transform(upto(F.col("same")), lambda o: own(F.col("part"), -1 - o, 0))
    of_main = F.transform(upto(F.col("others")), lambda o: own(o, -1 - F.col("part"), 1))
    blocks = m.withColumn("at", F.explode(F.when(F.col("main"), of_main).otherwise(F.concat(with_others, with_main))))
    blocks = blocks.select("band", "key", "at.p", "at.q", "at.side", "rep", "label", "part")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        ids, label, side = t.column("rep").to_numpy(), t.column("label").to_numpy(), t.column("side").to_numpy()
        p, q, part = t.column("p")[0].as_py(), t.column("q")[0].as_py(), t.column("part").to_numpy()
        left = np.flatnonzero((side == 0) & (part == p))
        right = np.flatnonzero(side == 1) if q < 0 else np.flatnonzero(part == q)
        if not len(left) or not len(right) or len(np.unique(label[np.append(left, right)])) < 2:
            return pa.table([np.zeros(0, np.int64)] * 2, schema=schema)
        docs, elements, weights, at = [], [], [], 0
        for _, data, off in K.chunks(t.column("text")):
            s, e, first = K.word_bounds(data, off)
            d, h, w = shingles(K.span_hashes(data, s, e), first)
            docs.append(d + at)
            elements.append(h)
            weights.append(w)
            at += len(off) - 1
        doc, element, weight = np.concatenate(docs), np.concatenate(elements), np.concatenate(weights)
        total = np.bincount(doc, weight, minlength=len(ids))
        both = common_weights(doc, element, weight, len(ids), left, right)
        good = both / (total[left][:, None] + total[right] - both) >= threshold
        i, j = np.nonzero(good & (label[left][:, None] != label[right]))
        # one link of each pair of classes, and of those a spanning forest
        _, at = np.unique(label, return_inverse=True)
        ends, one = np.unique(np.sort(np.stack((at[left[i]], at[right[j]]), axis=1), axis=1), axis=0, return_index=True)
        keep = one[spanning(ends, len(ids))]
        x, y = ids[left[i[keep]]], ids[right[j[keep]]]
        return pa.table([np.maximum(x, y), np.minimum(x, y)], schema=schema)

    return blocks.join(texts, "rep").groupBy("band", "key", "p", "q").applyInArrow(run, "a long, b long").distinct()


def _tagged(rows: DataFrame) -> DataFrame:
    """rows (.., text) with f1, f2: the digest of the words of text, which must be the last column."""
    def run(batches):
        for b in batches:
            digest = np.concatenate([K.signed(K.text_digests(data, off)) for _, data, off in K.chunks(b.column(b.num_columns - 1))] or [np.zeros((0, 2), np.int64)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy())], names=[*b.schema.names, "f1", "f2"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("f1", LongType()), StructField("f2", LongType())]))


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, f1, f2, class_id, comp) of every row. Nodes are the distinct word sequences, whatever ids they have; comp is a node of the class, null without words or id."""
    sketch = cut(_sketches(docs))
    ids = sketch.where("doc_id is not null")
    nodes = ids.where("words > 0").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "bands")).alias("m"))
    nodes = cut(nodes.select("f1", "f2", F.col("m.doc_id").alias("doc_id"), F.monotonically_increasing_id().alias("rep"), F.col("m.bands").alias("bands")))
    flat = nodes.select(F.posexplode("bands").alias("band", "key"), "rep")
    # every bucket has two centres: its smallest node, and the smallest by a hash. Both orders are those of all bands, so that a pair that meets in many is tested once
    draw = F.struct(F.xxhash64("rep").alias("h"), "rep")
    shared = cut(flat.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("rep").alias("first"), F.min(draw).alias("d")).where("n > 1").select("band", "key", "n", "first", F.col("d.rep").alias("drawn")))
    members = cut(flat.join(shared, ["band", "key"]).select("band", "key", "rep", "n", "first", "drawn"))
    asked = nodes.join(members.select("rep").distinct(), "rep").select("doc_id", "f1", "f2", "rep")
    # an id may have several texts: the one with the node's digest is meant, and of texts with the same words the least
    found = _tagged(text_column(docs).join(asked.select("doc_id").distinct(), "doc_id").select("doc_id", "text"))
    texts = cut(found.join(asked, ["doc_id", "f1", "f2"]).groupBy("doc_id", "f1", "f2", "rep").agg(F.min("text").alias("text")).select("rep", "text"))
    # a test is left out where its two are in one class by then, and a class stays one node: what is joined grows with members, not with links
    comp = cut(asked.select("rep", F.col("rep").alias("comp")))
    for centre, some in (("first", F.col("band") < EARLY), ("first", F.col("band") >= EARLY), ("drawn", F.col("n") > SIDE)):
        comp = _joined(comp, cut(_verify(texts, _open(comp, members.where(some).select("rep", F.col(centre).alias("centre"))), threshold)))
    comp = _joined(comp, cut(_rest(texts, members, comp, threshold)))
    label = cut(nodes.select("f1", "f2", "doc_id", "rep").join(comp, "rep", "left").select("f1", "f2", "doc_id", F.coalesce("comp", "rep").alias("comp")))
    # the smallest id of a class by all its members
    named = label.join(label.groupBy("comp").agg(F.min("doc_id").alias("class_id")), "comp").select("f1", "f2", "class_id", "comp")
    rest = sketch.where("doc_id is null or words = 0").select("doc_id", "f1", "f2", F.col("doc_id").alias("class_id"), F.lit(None).cast("long").alias("comp"))
    return ids.where("words > 0").select("doc_id", "f1", "f2").join(named, ["f1", "f2"]).select("doc_id", "f1", "f2", "class_id", "comp").union(rest)


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id, kept for every row: the class is the smallest id that links of similar texts reach.

    Texts of equal words are one class whatever their white space. A null text or one without words is a class of
    its own. A null doc_id has a null class and is kept; it links nothing. Rows that share an id and differ in words are decided each by their own words;
    rows that share both are decided alike. An empty table gives an empty result, very long texts are read whole, and other columns may have any names.
    """
    out = _classes(docs, threshold)
    return out.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, one of each class, with docs' columns, whatever their names.

    The row with the smallest id stays; of several texts of that id in one class the one with the smallest digest; of rows with the same id and words
    the least as text. Rows without an id stay.
    """
    texts = _classes(docs, threshold).where("doc_id = class_id").groupBy("comp", "doc_id", "f1", "f2").agg(F.count("*").alias("n"))
    one = texts.where("comp is not null").groupBy("comp").agg(F.min(F.struct("f1", "f2", "doc_id", "n")).alias("m")).select("m.doc_id", "m.f1", "m.f2", "m.n")
    keep = cut(one.union(texts.where("comp is null").select("doc_id", "f1", "f2", "n")))
    rows = _tagged(docs.where(F.col("doc_id").isNotNull()).select(whole_row(docs).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).drop("text")
    out = rows.join(keep, ["doc_id", "f1", "f2"])
    kept = out.where("n = 1").select("_row")
    if keep.where("n > 1").limit(1).count():
        kept = kept.union(out.where("n > 1").groupBy("doc_id", "f1", "f2").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row"))
    return kept.select("_row.*").union(docs.where(F.col("doc_id").isNull()))
