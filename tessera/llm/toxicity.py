"""Toxicity by a factorisation machine over hashed terms.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) over the set of hashed terms
of the whole text (x_i = 1 if the term occurs). Terms are words in lower case and pairs of an
occurring term come in through their factors, so an insult next to a group mention can weigh
more than the two apart. Hashed terms that a bounded labelled sample does not tie to the label
get no weight at all, so long clean texts gather no noise.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.common import batch_from, text_column

BITS = 22
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every run of letters and digits, in order; ASCII and Latin-1 in lower case."""
    low = _LOWER[data]
    if len(low) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][capital] += 0x20
    solid = np.where(_TERM[low], np.uint8(0x61), np.uint8(0x20))
    starts, ends, first = K.word_bounds(solid, off)
    h = K.span_hashes(low, starts, ends)
    return np.repeat(np.arange(len(off) - 1), np.diff(first)), (h >> np.uint64(64 - BITS)).astype(np.int64)


class Model:
    def __init__(self, index: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.index, self.w0, self.w, self.v = index, w0, w, v

    def score(self, texts: pa.Array) -> np.ndarray:
        slot = np.full(1 << BITS, -1, np.int32)
        slot[self.index] = np.arange(len(self.index))
        z = np.full(len(texts), self.w0)
        for row, data, off in K.chunks(texts):
            doc, bucket = terms(data, off)
            f = slot[bucket]
            hit = f >= 0
            key = np.unique(doc[hit].astype(np.int64) << 32 | f[hit])
            doc, f = key >> 32, (key & 0xFFFFFFFF).astype(np.int64)
            n = len(off) - 1
            lin = np.bincount(doc, self.w[f], minlength=n)
            pair = np.zeros(n)
            for k in range(self.v.shape[1]):
                s = np.bincount(doc, self.v[f, k], minlength=n)
                q = np.bincount(doc, self.v[f, k] ** 2, minlength=n)
                pair += 0.5 * (s * s - q)
            z[row : row + n] += lin + pair
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


#: Log-likelihood ratio of a term's presence against the label, and texts that hold it, at least.
LEAST_GAIN, LEAST_TEXTS = 20.0, 3


def train(docs: list[np.ndarray], y: np.ndarray, factors: int = 6, keep: int = 8192, epochs: int = 40, seed: int = 5) -> Model:
    """docs: the distinct buckets of each sampled text. Logistic loss, Adagrad, L2 on w and v."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.01
        return Model(np.zeros(0, np.int64), float(np.log(p / (1 - p))), np.zeros(0), np.zeros((0, factors)))
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    all_terms, f = np.unique(np.concatenate(docs), return_inverse=True)
    pos, neg = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    in_pos = np.bincount(f, y[doc], minlength=len(all_terms))
    in_neg = np.bincount(f, 1 - y[doc], minlength=len(all_terms))
    a, b = in_pos / pos, in_neg / neg
    # log-likelihood ratio of presence against the label
    p = (in_pos + in_neg) / (pos + neg)
    xlog = lambda k, n, q: k * np.log(np.maximum(q, 1e-12)) + (n - k) * np.log(np.maximum(1 - q, 1e-12))
    gain = 2 * (xlog(in_pos, pos, a) + xlog(in_neg, neg, b) - xlog(in_pos, pos, p) - xlog(in_neg, neg, p))
    best = np.lexsort((all_terms, -gain))[:keep]
    # a few labels cannot tie any term so closely: then most of what a perfect one would have must do
    most = -2 * (xlog(pos, pos + neg, pos / (pos + neg)))
    best = np.sort(best[(gain[best] > min(LEAST_GAIN, 0.8 * most)) & (in_pos[best] + in_neg[best] >= min(LEAST_TEXTS, pos, neg))])
    slot = np.full(len(all_terms), -1)
    slot[best] = np.arange(len(best))
    rng = np.random.default_rng(seed)
    m = len(best)
    rows = [r[r >= 0] for r in np.split(slot[f], np.cumsum([len(d) for d in docs])[:-1])]
    w0, w, v = float(np.log(pos / neg)), np.zeros(m), rng.normal(0, 0.02, (m, factors))
    gw, gv, g0 = np.full(m, 1e-2), np.full((m, factors), 1e-2), 1e-2
    weight = np.where(y > 0, 0.5 * len(y) / pos, 0.5 * len(y) / neg)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 128):
            i = order[at : at + 128]
            lens = np.array([len(rows[j]) for j in i])
            ff = np.concatenate([rows[j] for j in i]) if lens.sum() else np.zeros(0, np.int64)
            dd = np.repeat(np.arange(len(i)), lens)
            # some texts show only a part of their terms, so that few terms suffice for a short text
            first = np.flatnonzero(np.diff(dd, prepend=-1))
            stay = rng.random(len(ff)) < rng.choice([1.0, 0.5, 0.2], len(i))[dd]
            stay[(first + (rng.random(len(first)) * lens[lens > 0]).astype(int))] = True
            ff, dd = ff[stay], dd[stay]
            s = np.zeros((len(i), factors))
            np.add.at(s, dd, v[ff])
            q = np.zeros(len(i))
            np.add.at(q, dd, (v[ff] ** 2).sum(axis=1))
            z = w0 + np.bincount(dd, w[ff], minlength=len(i)) + 0.5 * ((s * s).sum(axis=1) - q)
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[i]) * weight[i] / len(i)
            dw = np.bincount(ff, g[dd], minlength=m) + 1e-5 * w
            dv = np.zeros_like(v)
            np.add.at(dv, ff, g[dd][:, None] * (s[dd] - v[ff]))
            dv += 1e-4 * v
            g0 += g.sum() ** 2
            gw += dw * dw
            gv += dv * dv
            w0 -= 0.1 * g.sum() / np.sqrt(g0)
            w -= 0.3 * dw / np.sqrt(gw)
            v -= 0.03 * dv / np.sqrt(gv)
    return Model(all_terms[best], w0, w, v)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, held_out=None) -> Model:
    """Learns from at most about per_class labelled rows of either class, drawn by a hash of the id. The model has at most ``keep`` terms, those tied
    closest to the label, each with a log-likelihood ratio above LEAST_GAIN and in LEAST_TEXTS texts or more, less where the labels are too few for that (see train); other terms weigh nothing.

    Labels other than 0 and 1, null texts and ids for which held_out is true are not used. A
    repeated label row counts once; contradicting ones count as toxic.
    """
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where(F.col("y").isin(0, 1))
    if held_out is not None:
        lab = lab.where(~held_out(F.col("doc_id").cast("string")))
    lab = lab.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = {r.y: r["count"] for r in lab.groupBy("y").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = F.lit(False)
    for y, k in n.items():
        chosen = chosen | ((F.col("y") == y) & (draw < min(1.0, per_class / k)))
    # the sample is at most about 2 * per_class ids, so it may be broadcast; of several texts of one id the least is read
    rows = text_column(docs).where(F.col("text").isNotNull()).join(F.broadcast(lab.where(chosen)), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y")
    schema = pa.schema([("y", pa.int32()), ("t", pa.binary())])

    def featurise(batches):
        for b in batches:
            out = [None] * b.num_rows
            for row, data, off in K.chunks(b.column(0)):
                doc, bucket = terms(data, off)
                key = np.unique(doc << BITS | bucket)
                first = np.searchsorted(key >> BITS, np.arange(len(off)))
                bucket = (key & ((1 << BITS) - 1)).astype(np.uint32)
                for j in range(len(off) - 1):
                    out[row + j] = bucket[first[j] : first[j + 1]].tobytes()
            yield batch_from({"y": b.column(1), "t": out}, schema)

    got = sorted(rows.mapInArrow(featurise, "y int, t binary").collect(), key=lambda r: (r.y, r.t))
    return train([np.frombuffer(r.t, np.uint32).astype(np.int64) for r in got], np.array([r.y for r in got], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for every row; a null or empty text gets the score of a text without known terms.

    Repeated rows score alike, null ids stay null, very long texts are read whole, an empty table gives an empty result, and only doc_id
    and text are read, so other columns may have any names.
    """
    blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        model = pickle.loads(blob.value)
        for b in batches:
            yield batch_from({"doc_id": b.column(0), "score": model.score(b.column(1))}, schema)

    return text_column(docs).mapInArrow(run, "doc_id long, score double")
