"""Substring deduplication by prefix-partitioned suffix trees.

Every word of a document begins a suffix. Suffixes are split into groups by a prefix of variable
length, each group small enough for one task, which builds the group's part of the generalised suffix tree: its suffixes are sorted by
their words, and what neighbours share (their longest common prefix) gives the internal nodes. Words
under an internal node at a depth of ``window`` words or more occur elsewhere and go.

The prefix of a suffix runs to the end of its anchor: the 8-word sequence with the smallest hash
among those that begin in its first window. It therefore has 8 to ``window`` words, equal windows have equal
prefixes, and only about one position in 14 is an anchor of anything. A first pass counts anchors, and drops
all suffixes whose anchor occurs once in the corpus, whose subtree would be a single leaf. Where an anchor
is so frequent that its subtree would not fit a task, the prefix is lengthened to the
full window. Neighbouring suffixes with one anchor travel together, as one run of words; equal runs of a bucket of documents travel once.

Sorting, common prefixes and nodes are of the words themselves; hashes only choose groups. What comes back to the
documents are the 128-bit hashes of the deep windows, and copies of whole texts are known by a 128-bit digest.

Passes over documents are bucketed by a hash of the row, so one bucket's documents, its part of the
anchor table and its part of the deep nodes meet in one task of bounded size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.common import cut

ANCHOR = 8
#: Anchors with more occurrences than this get full-window prefixes.
HEAVY = 20_000
#: Records of repeated anchors that a task holds before it hands them on.
HELD = 500_000
BUCKET_BYTES = 12_000_000

_CENSUS = np.dtype([("key", "<u8"), ("text", "<u8"), ("other", "<u8"), ("bucket", "<i4"), ("kind", "<i4")])
ONE, MANY, WHOLE = 0, 1, 2  # an anchor that a text has once, one that it has more often, a whole text


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over x[i:i+width]."""
    n = len(x) - width + 1
    y, have = x, 1
    while have * 2 <= width:
        y = f(y[:-have], y[have:])
        have *= 2
    return f(y[:n], y[width - have : width - have + n])


class Words:
    """Words, anchors and windows of a chunk of documents."""

    def __init__(self, data: np.ndarray, off: np.ndarray, window: int):
        self.starts, self.ends, self.first = K.word_bounds(data, off)
        self.hash = K.span_hashes(data, self.starts, self.ends)
        self.window = window
        n = np.diff(self.first)
        digest = K.text_digests(data, off)
        self.text1, self.text2 = digest[:, 0], digest[:, 1]
        self.data = data
        w = max(0, len(self.hash) - window + 1)
        self.doc = np.repeat(np.arange(len(n)), n)
        #: the windows that lie in one document
        self.at = np.flatnonzero(np.arange(w) + window <= self.first[self.doc[:w] + 1]) if w else np.zeros(0, np.int64)
        span = window - ANCHOR + 1
        if len(self.at):
            self.gram = K.window_hashes(self.hash, ANCHOR)
            self.low = _sliding(self.gram, span, np.minimum)[self.at]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions that are some window's anchor (all of them, where the least hash occurs again), and their hashes."""
        if not len(self.at):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        span = self.window - ANCHOR + 1
        least = np.zeros(len(self.gram) + span - 1, np.uint64)  # of window i, shifted so that those holding p are p .. p+span-1
        least[self.at + span - 1] = self.low
        top = _sliding(least, span, np.maximum)[: len(self.gram)]
        at = np.flatnonzero(top == self.gram)
        return at, self.gram[at]

    def paths(self) -> np.ndarray:
        """[windows, 2]: 128 bits of hash of each window."""
        return window_names(self.data, self.starts, self.ends, self.hash, self.window, self.at)


def window_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, window: int, at: np.ndarray) -> np.ndarray:
    if not len(at):
        return np.zeros((0, 2), np.uint64)
    other = K.span_hashes(data, starts, ends, seed=1)
    return np.stack([K.window_hashes(w, window)[at] for w in (words, other)], axis=1)


def _packed(rows: np.ndarray, part: np.ndarray, schema: pa.Schema):
    """One row for each part that rows go to, with its records as bytes."""
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(part))[: len(cut)]
    return pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), pa.array([rows[s:e].tobytes() for s, e in zip(cut, ends, strict=True)], pa.binary())], schema=schema)


_PART = pa.schema([("part", pa.int32()), ("data", pa.binary())])
_PART_SQL = "part int, data binary"


def _records(column, dtype: np.dtype) -> np.ndarray:
    parts = [np.frombuffer(x.as_py(), dtype) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _census(docs: DataFrame, window: int, n: int) -> DataFrame:
    """(part, data): for each bucket the texts that occur again and the anchors that occur again, with their weight."""

    def summed(parts: list[np.ndarray]) -> np.ndarray:
        """One record for each repeated key and bucket, with the number of texts in ``text``."""
        r = np.concatenate(parts)
        r = r[np.lexsort((r["bucket"], r["key"]))]
        new = np.ones(len(r), bool)
        new[1:] = (r["key"][1:] != r["key"][:-1]) | (r["bucket"][1:] != r["bucket"][:-1])
        first = np.flatnonzero(new)
        out = r[first]
        if len(first):
            out["text"] = np.add.reduceat(r["text"], first)
        return out

    def count(batches):
        held, waiting = [np.zeros(0, _CENSUS)], 0  # what a task knows to be repeated is told once to each bucket, however many of its texts have it
        for b in batches:
            out = []
            bucket = b.column(2).to_numpy(zero_copy_only=False).astype(np.int32)
            for row, data, off in K.chunks(b.column(1)):
                w = Words(data, off, window)
                own = bucket[row : row + len(off) - 1]
                at, key = w.anchors()
                d = w.doc[at]
                order = np.lexsort((key, d))
                d, key = d[order], key[order]
                new = np.concatenate(([True], (d[1:] != d[:-1]) | (key[1:] != key[:-1]))) if len(d) else np.zeros(0, bool)
                i = np.flatnonzero(new)
                size = np.diff(np.append(i, len(d)))
                rec = np.zeros(len(i), _CENSUS)
                rec["key"], rec["text"], rec["other"], rec["bucket"], rec["kind"] = key[i], w.text1[d[i]], w.text2[d[i]], own[d[i]], np.where(size > 1, MANY, ONE)
                long = np.flatnonzero(np.diff(w.first) >= window)
                who = np.zeros(len(long), _CENSUS)
                who["key"], who["text"], who["bucket"], who["kind"] = w.text1[long], w.text2[long], own[long], WHOLE
                out += [rec, who]
            out = np.concatenate(out) if out else np.zeros(0, _CENSUS)
            # a key that this batch already shows to be repeated need only be told once to each bucket
            many = np.zeros(len(out), bool)
            order = np.lexsort((out["other"], out["text"], out["key"]))
            k, t, o = out["key"][order], out["text"][order], out["other"][order]
            differ = np.flatnonzero((k[1:] == k[:-1]) & ((t[1:] != t[:-1]) | (o[1:] != o[:-1])))
            many[order] = np.isin(k, k[differ])
            many &= out["kind"] != WHOLE
            rest = out[many]
            if len(rest):
                rest["kind"], rest["text"], rest["other"] = MANY, 1, 0  # a repeated key's texts no longer matter, only how many there are
                held.append(summed([rest]))
                waiting += len(held[-1])
                if waiting > HELD:
                    held = [summed(held)]
                    waiting = 0
                out = out[~many]
            yield _packed(out, (out["key"] % np.uint64(n)).astype(np.int32), _PART)
            if len(held[0]) > HELD:
                yield _packed(held[0], (held[0]["key"] % np.uint64(n)).astype(np.int32), _PART)
                held[0] = held[0][:0]
        out = summed(held)
        yield _packed(out, (out["key"] % np.uint64(n)).astype(np.int32), _PART)

    def repeated(table: pa.Table) -> pa.Table:
        r = _records(table.column("data"), _CENSUS)
        r = r[np.lexsort((r["text"], r["kind"], r["key"]))]
        out = []
        whole = r[r["kind"] == WHOLE]
        same = (whole["key"][1:] == whole["key"][:-1]) & (whole["text"][1:] == whole["text"][:-1])
        again = np.zeros(len(whole), bool)
        again[1:] |= same
        again[:-1] |= same
        out.append(whole[again])
        r = r[r["kind"] != WHOLE]
        new = np.concatenate(([True], r["key"][1:] != r["key"][:-1])) if len(r) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        groups = int(group[-1]) + 1 if len(r) else 0
        many = np.bincount(group, r["kind"] == MANY, groups) > 0
        first = np.flatnonzero(new)
        differ = np.bincount(group, (r["text"] != r["text"][first][group]) | (r["other"] != r["other"][first][group]) if len(r) else None, groups) > 0
        weight = np.bincount(group, np.where(r["kind"] != MANY, 1, np.where(r["text"] < (1 << 30), r["text"], 2)).astype(float), groups)
        keep = r[(many | differ)[group]] if len(r) else r
        keep["text"] = (weight[group] > HEAVY)[(many | differ)[group]] if len(r) else 0
        out.append(keep)
        out = np.concatenate(out)
        return pa.Table.from_batches([_packed(out, out["bucket"].astype(np.int32), _PART)])

    counted = docs.mapInArrow(count, _PART_SQL)
    return counted.groupBy("part").applyInArrow(repeated, _PART_SQL)


_RUNS = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("starts", pa.binary()), ("count", pa.binary()), ("body", pa.binary())])
_RUNS_SQL = "part int, bucket int, starts binary, count binary, body binary"


def _runs(w: Words, raw: bytes, keep: np.ndarray, heavy: np.ndarray, reach: int, context: bool):
    """(prefix, body, suffixes in it) of each run of neighbouring kept suffixes with one anchor.

    body: its words joined by one space, ``reach`` of the last suffix (as far as the document goes), with context after the word before it or a lone CR.
    Suffixes of heavy anchors are runs of their own, and the prefix is their window.
    """
    at, low = w.at[keep], w.low[keep]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1]) | heavy[1:] | heavy[:-1]
    first = np.flatnonzero(new)
    starts = np.diff(np.append(first, len(at)))
    prefix = low[first].copy()
    own = heavy[first]
    if own.any():
        prefix[own] = K.window_hashes(w.hash, w.window)[at[first[own]]]
    begin = at[first]
    doc = w.doc[begin]
    end = np.minimum(begin + starts - 1 + reach, w.first[doc + 1])
    lead = begin > w.first[doc]
    left = w.starts[begin - (lead & context)]
    for p, n, s, e, l in zip(prefix.tolist(), starts.tolist(), left.tolist(), w.ends[end - 1].tolist(), lead.tolist(), strict=True):
        body = b" ".join(raw[s:e].split())
        yield p, (b"\r " + body if context and not l else body), n


class Subtree:
    """The suffixes of some runs in order of their words, and what each shares with the one before it."""

    def __init__(self, lines: list[bytes], starts: np.ndarray, count: np.ndarray, context: bool = False):
        """lines: the words of each run, joined by one space; starts: suffixes in it; with context a run's first word stands before its first suffix."""
        self.words = b" ".join(lines).split(b" ") if lines else []
        size = np.array([x.count(b" ") + 1 for x in lines], np.int64)
        names = sorted(set(self.words))
        place = {x: i for i, x in enumerate(names)}
        first = np.cumsum(size) - size
        self.end = np.repeat(first + size, size)
        self.rank = [np.array(list(map(place.__getitem__, self.words)), np.int64)]
        while (1 << len(self.rank) - 1) < int(size.max(initial=0)):
            self.rank.append(self._doubled(self.rank[-1], 1 << len(self.rank) - 1))
        run = np.repeat(np.arange(len(lines)), starts)
        leaf = first[run] + context + np.arange(len(run)) - np.repeat(np.cumsum(starts) - starts, starts)
        order = np.argsort(self.rank[-1][leaf], kind="stable") if len(leaf) else np.zeros(0, np.int64)
        self.leaf, self.run, self.weight = leaf[order], run[order], count[run[order]]
        self.shared = np.zeros(len(order), np.int64)  # longest common prefix with the suffix before it
        if len(order):
            self.shared[1:] = self._common(self.leaf[:-1], self.leaf[1:])

    def _doubled(self, rank: np.ndarray, step: int) -> np.ndarray:
        """Ranks of twice as many words from ranks of ``step`` words; what a run's end cuts short comes first."""
        at = np.arange(len(rank)) + step
        after = np.where(at < self.end, rank[np.minimum(at, len(rank) - 1)] + 1, 0)
        return np.unique(rank * (int(after.max()) + 1) + after, return_inverse=True)[1]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        end_a, end_b, last, out = self.end[a], self.end[b], len(self.end) - 1, np.zeros(len(a), np.int64)
        for k in range(len(self.rank) - 1, -1, -1):
            i, j = np.minimum(a, last), np.minimum(b, last)
            same = (a < end_a) & (b < end_b) & (self.rank[k][i] == self.rank[k][j])
            step = np.where(same, np.minimum(1 << k, end_a - a), 0)
            a, b, out = a + step, b + step, out + step
        return out

    def deep(self, depth: int) -> np.ndarray:
        """For each suffix the number of the internal node of this depth that it is under, or -1."""
        node = np.cumsum(self.shared < depth)
        if not len(node):
            return node
        full = np.bincount(node, self.weight) > 1
        return np.where(full[node], node, -1)

    def maximal(self, window: int, reach: int):
        """(words, depth, occurrences) of the internal nodes of depth window to reach whose suffixes don't all follow the same word."""
        shared = np.minimum(self.shared, reach)
        left = np.array([self.words[i - 1] for i in self.leaf], object)
        open_: list[list[int]] = []  # depth and first suffix of nodes that may go on
        for i, d in enumerate([*shared[1:].tolist(), 0]):  # d: what suffix i shares with the next
            # a suffix that stands for several occurrences is a node by itself
            own = min(reach, int(self.end[self.leaf[i]] - self.leaf[i]))
            if self.weight[i] > 1 and own >= window and own > max(d, int(shared[i]) if i else 0):
                open_.append([own, i])
            begin = i
            while open_ and open_[-1][0] > d:
                depth, begin = open_.pop()
                before = left[begin : i + 1]
                if depth >= window and (len(set(before)) > 1 or before[0] == b"\r"):
                    yield b" ".join(self.words[self.leaf[i] : self.leaf[i] + depth]), depth, int(self.weight[begin : i + 1].sum())
            if d >= window and (not open_ or open_[-1][0] < d):
                open_.append([d, begin])


def _read_runs(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Lines, starts, counts and buckets of all runs of a group."""
    lines, bucket = [], []
    for body, b in zip(table.column("body").to_pylist(), table.column("bucket").to_pylist(), strict=True):
        own = body.split(b"\n")
        lines += own
        bucket.append(np.full(len(own), b))
    get = lambda c: np.concatenate([np.frombuffer(x, "<i4") for x in table.column(c).to_pylist()] or [np.zeros(0, "<i4")]).astype(np.int64)
    return lines, get("starts"), get("count"), np.concatenate(bucket) if bucket else np.zeros(0, np.int64)


def _suffixes(docs: DataFrame, census: DataFrame, window: int, n: int, reach: int, context: bool) -> DataFrame:
    """The runs of suffixes whose anchor occurs again, packed by the group (part) and the bucket that they come from."""

    def leaves(texts: pa.Table, known: pa.Table) -> pa.Table:
        r = _records(known.column("data"), _CENSUS)
        r = r[r["kind"] != WHOLE]
        order = np.argsort(r["key"], kind="stable")
        key, heavy = r["key"][order], r["text"][order] > 0
        found: dict[tuple, int] = {}
        if len(key) and texts.num_rows:
            for _, data, off in K.chunks(texts.column("text")):
                w = Words(data, off, window)
                if not len(w.at):
                    continue
                i = np.minimum(np.searchsorted(key, w.low), len(key) - 1)
                keep = np.flatnonzero(key[i] == w.low)
                for run in _runs(w, data.tobytes(), keep, heavy[i[keep]], reach, context):
                    found[run] = found.get(run, 0) + 1
        groups: dict[int, list] = {}
        for (prefix, body, starts), count in found.items():
            groups.setdefault(prefix % n, []).append((body, starts, count))
        bucket = texts.column("bucket")[0].as_py() if texts.num_rows else 0
        pack = lambda rows, k: np.array([x[k] for x in rows], "<i4").tobytes()
        cols = [list(groups), [bucket] * len(groups), [pack(v, 1) for v in groups.values()], [pack(v, 2) for v in groups.values()], [b"\n".join(x[0] for x in v) for v in groups.values()]]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, _RUNS, strict=True)], schema=_RUNS)

    return docs.groupBy("bucket").cogroup(census.groupBy("part")).applyInArrow(leaves, _RUNS_SQL)


def _deep_windows(runs: DataFrame, window: int) -> DataFrame:
    """(part, data): for each bucket the 128-bit hashes of those of its windows that are under deep internal nodes."""

    def deep(table: pa.Table) -> pa.Table:
        lines, starts, count, bucket = _read_runs(table)
        tree = Subtree(lines, starts, count)
        node = tree.deep(window)
        at = np.flatnonzero(node >= 0)
        _, one = np.unique(node[at] * (int(bucket.max(initial=0)) + 1) + bucket[tree.run[at]], return_index=True)
        at = at[one]
        data = np.frombuffer(b" ".join(lines), np.uint8)
        s, e, _ = K.word_bounds(data, np.array([0, len(data)]))
        names = window_names(data, s, e, K.span_hashes(data, s, e), window, tree.leaf[at])
        return pa.Table.from_batches([_packed(names, bucket[tree.run[at]].astype(np.int32), _PART)])

    return runs.groupBy("part").applyInArrow(deep, _PART_SQL)


def _bucketed(docs: DataFrame) -> tuple[DataFrame, int]:
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size) // BUCKET_BYTES + 1)
    return text.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), n


def maximal_repeats(docs: DataFrame, window: int = 35, reach: int = 1000) -> DataFrame:
    """words, depth, occurrences of every maximal repeat of window words or more among the distinct texts of docs.

    A repeat is a word sequence that occurs at two places or more, of one text or of several; it is maximal if its occurrences neither
    all follow the same word nor all precede the same word. It is an internal node of the suffix tree. Repeats of more than ``reach`` words are
    given by their parts of that length that begin at a maximal repeat's start. Each occurrence counts, but copies of one text count once.
    """
    if window < ANCHOR or reach < window:
        raise ValueError(f"a window has {ANCHOR} words or more, and reach is no less")
    # one row a text, known by its digest, without shuffling texts more than once
    one = docs.where(F.col("text").isNotNull()).select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).dropDuplicates(["text"])
    text, n = _bucketed(one)
    runs = _suffixes(text, cut(_census(text, window, n)), window, n, reach, context=True)
    schema = pa.schema([("words", pa.string()), ("depth", pa.int64()), ("occurrences", pa.int64())])

    def nodes(table: pa.Table) -> pa.Table:
        lines, starts, count, _ = _read_runs(table)
        rows = list(Subtree(lines, starts, count, context=True).maximal(window, reach))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 3, schema, strict=True)], schema=schema) if not rows else pa.table([pa.array([r[0].decode("utf-8", "replace") for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], schema=schema)

    return runs.groupBy("part").applyInArrow(nodes, "words string, depth long, occurrences long")


def remove_repeats(docs: DataFrame, window: int = 35, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space; with digest kept_sha256) for every row.

    A word goes if a window of so many consecutive words of its document that covers it has a word
    sequence that also starts elsewhere, in this or another document. Null texts have no words. Rows with the same id, or a
    null one, are documents of their own. Only doc_id and text are read, so other columns may have any names. An
    empty table gives an empty result; very long texts are handled by megabytes of words, a document being in one task.
    """
    if window < ANCHOR:
        raise ValueError(f"a window has {ANCHOR} words or more")
    text, n = _bucketed(docs)
    census = cut(_census(text, window, n))
    nodes = _deep_windows(_suffixes(text, census, window, n, window, context=False), window)
    copies = census.select("part", "data", F.lit(0).alias("what"))
    marks = copies.union(nodes.select("part", "data", F.lit(1).alias("what")))
    last = ("kept_sha256" if digest else "kept", pa.string())
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), last])

    def strip(texts: pa.Table, marks: pa.Table) -> pa.Table:
        what = marks.column("what").to_numpy()
        data = marks.column("data")
        whole = [np.frombuffer(data[i].as_py(), _CENSUS) for i in np.flatnonzero(what == 0)]
        whole = np.concatenate([x[x["kind"] == WHOLE] for x in whole]) if whole else np.zeros(0, _CENSUS)
        whole = set(zip(whole["key"].tolist(), whole["text"].tolist(), strict=True))
        path = [np.frombuffer(data[i].as_py(), "<u8").reshape(-1, 2) for i in np.flatnonzero(what == 1)]
        path = np.concatenate(path) if path else np.zeros((0, 2), "<u8")
        path = path[np.lexsort((path[:, 1], path[:, 0]))]
        columns: list = [[], [], [], []]
        for row, data, off in K.chunks(texts.column("text")):
            w = Words(data, off, window)
            n = np.diff(w.first)
            gone = np.zeros(len(w.hash) + 1, np.int64)
            if len(w.at) and len(path):
                p = w.paths()
                i = np.searchsorted(path[:, 0], p[:, 0])
                hit = np.zeros(len(p), bool)
                while len(live := np.flatnonzero(~hit & (i < len(path)) & (path[np.minimum(i, len(path) - 1), 0] == p[:, 0]))):
                    hit[live] = path[i[live], 1] == p[live, 1]
                    i[live] += 1
                hit = w.at[hit]
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + window, -1)
            gone = np.cumsum(gone[:-1]) > 0
            if whole:
                for d, pair in enumerate(zip(w.text1.tolist(), w.text2.tolist(), strict=True)):
                    if n[d] >= window and pair in whole:
                        gone[w.first[d] : w.first[d + 1]] = True
            raw = data.tobytes()
            removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[w.first])
            for d in range(len(off) - 1):
                words = raw[off[d] : off[d + 1]].split()
                if removed[d]:
                    words = [x for x, g in zip(words, gone[w.first[d] : w.first[d + 1]].tolist(), strict=True) if not g]
                kept = b" ".join(words)
                columns[3].append(hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "replace"))
            columns[0] += texts.column("doc_id")[row : row + len(n)].to_pylist()
            columns[1] += n.tolist()
            columns[2] += removed.tolist()
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return text.groupBy("bucket").cogroup(marks.groupBy("part")).applyInArrow(strip, f"doc_id long, n_words long, n_removed long, {last[0]} string")
