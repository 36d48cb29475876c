"""Language identification by hierarchical discrimination.

The family is predicted first by one-versus-one linear support vector machines over
families, then one-versus-one machines separate the languages inside the predicted
family; a text never meets the machines of other families. Every machine is linear in the relative frequencies of hashed letter n-grams, so a text of any
length is one gather and one sum. Training rows are a bounded sample (``per_lang`` distinct texts a language, TRAINING_ROWS in all);
prediction reads whole texts of all rows.
"""

from __future__ import annotations

import itertools
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.common import batch_from, text_column
from tessera.shared import map_in_arrow

# Language families by ISO 639-1 code. Codes that are not listed form the family "other".
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indic": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv ms tl",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
    "hellenic": "el",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: Rows that the driver learns from, of all languages together; with more languages than that, one of each.
TRAINING_ROWS = 8000
#: Bytes of texts that are predicted at a time.
PIECE = 250_000
#: Languages of a family; a larger one is cut into parts.
GROUP = 12
#: Tables of so many languages are broadcast, larger ones joined by their key.
BROADCAST_LANGS = 100_000
BITS = 13
GRAMS = (1, 2, 3)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[: 0x41] = 0x20
_FOLD[0x41:0x5B] += 0x20
_FOLD[0x5B:0x61] = 0x20
_FOLD[0x7B:0x80] = 0x20


def _folded(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case, Latin-1 letters too, everything else in ASCII as a space."""
    out = _FOLD[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def gram_codes(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order n: (positions, bucket) of the byte n-grams that have a letter and lie in one document."""
    b = _folded(data).astype(np.uint32)
    n = len(b)
    letter = b != 0x20
    out = []
    for k in GRAMS:
        if n < k:
            continue
        m = n - k + 1
        code = np.full(m, k * 0x51ED270B & 0xFFFFFFFF, np.uint32)
        ok = np.zeros(m, bool)
        for j in range(k):
            code = (code ^ b[j : j + m]) * np.uint32(0x01000193)
            ok |= letter[j : j + m]
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        code >>= np.uint32(32 - BITS)
        cuts = off[1:-1]
        for j in range(1, k):
            at = cuts - j
            ok[at[(at >= 0) & (at < m)]] = False
        if k > 1:  # two spaces in a row say nothing
            space = ~letter
            pair = space[:-1] & space[1:]
            for j in range(k - 1):
                ok &= ~pair[j : j + m]
        at = np.flatnonzero(ok)
        out.append((at, code[at]))
    return out


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


class Grams:
    """The n-grams of a batch of texts, reduced to sums over weights that hang on their buckets."""

    def __init__(self, texts: pa.Array):
        self.rows, self.parts = len(texts), []
        self.count = np.zeros(self.rows)
        for row, data, off in K.chunks(texts):
            for at, code in gram_codes(data, off):
                n = np.diff(np.searchsorted(at, off))
                self.count[row : row + len(n)] += n
                self.parts.append((np.repeat(np.arange(row, row + len(n)), n), code))

    def sums(self, table: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
        """[texts] sums of table[bucket], for wanted texts only (a mask), others 0."""
        out = np.zeros(self.rows)
        for doc, code in self.parts:
            if wanted is not None:
                use = wanted[doc]
                doc, code = doc[use], code[use]
            if len(doc):
                out += np.bincount(doc, table[code], minlength=self.rows)
        return out

    def means(self, table: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
        return self.sums(table, wanted) / np.maximum(self.count, 1)


def pieces(batch: pa.RecordBatch, i: int):
    """Slices of a batch with about PIECE bytes of texts in column i, one row at least: an n-gram takes some fifty bytes while a text is predicted."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, relative frequencies) of each text."""
    g = Grams(texts)
    key = np.concatenate([doc << BITS | code for doc, code in g.parts] or [np.zeros(0, np.int64)])
    key, n = np.unique(key, return_counts=True)
    first = np.searchsorted(key >> BITS, np.arange(len(texts) + 1))
    bucket, share = (key & ((1 << BITS) - 1)).astype(np.uint16), (n / np.maximum(g.count, 1)[key >> BITS]).astype(np.float32)
    return [(bucket[a:b], share[a:b]) for a, b in itertools.pairwise(first)]


class Rows:
    """Sparse training rows: those of bags, one after another."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.size = np.array([len(b) for b, _ in rows], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.bucket = np.concatenate([b for b, _ in rows] or [np.zeros(0, np.uint16)]).astype(np.int64)
        self.share = np.concatenate([s for _, s in rows] or [np.zeros(0, np.float32)])

    def take(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in i, bucket, share) of all entries of rows i."""
        n = self.size[i]
        at = np.repeat(self.first[i] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return np.repeat(np.arange(len(i)), n), self.bucket[at], self.share[at]


def train_svm(rows: Rows, use: np.ndarray, y: np.ndarray, epochs: int = 30, reg: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, float, float]:
    """A linear machine with squared hinge loss by averaged mini-batch descent on rows use; weights, bias, scale of its margin."""
    width = 1 << BITS
    _, bucket, share = rows.take(use)
    square = np.bincount(bucket, share.astype(float) ** 2, minlength=width)
    scale = 1.0 / np.maximum(np.sqrt(square / len(use)), 1e-3)
    rng = np.random.default_rng(seed)
    w, b = np.zeros(width), 0.0
    avg, avg_b, seen = np.zeros_like(w), 0.0, 0
    sw = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    norm = float((square * scale**2).sum() / len(use)) + 1
    for epoch in range(epochs):
        rate = 1.0 / norm / (1 + 0.05 * epoch)
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            i = order[at : at + 64]
            row, bucket, share = rows.take(use[i])
            x = share * scale[bucket]
            slack = np.maximum(0, 1 - y[i] * (np.bincount(row, x * w[bucket], minlength=len(i)) + b)) * sw[i] * y[i]
            w = w * (1 - rate * reg) + rate / 4 * np.bincount(bucket, slack[row] * x, minlength=width)
            b += rate * float(slack.sum()) / 4
            if epoch >= epochs // 2:
                avg, avg_b, seen = avg + w, avg_b + b, seen + 1
    w, b = (avg / seen, avg_b / seen) if seen else (w, b)
    row, bucket, share = rows.take(use)
    margin = y * (np.bincount(row, share * scale[bucket] * w[bucket], minlength=len(use)) + b)
    spread = float(np.quantile(margin, 0.05)) if len(margin) else 1.0
    return w * scale, b, 4.0 / max(spread, 0.25)


def families(langs: list[str], rows: Rows, lang: np.ndarray) -> dict[str, str]:
    """The family of each language. One of more than GROUP is cut into parts along a chain of languages whose n-grams are alike, so that duels grow with the languages, not with their square."""
    family = {x: FAMILY_OF.get(x, "other") for x in langs}
    for name in sorted(set(family.values())):
        own = [x for x in langs if family[x] == name]
        if len(own) <= GROUP:
            continue
        mean = np.zeros((len(own), 1 << BITS), np.float32)
        for i, x in enumerate(own):
            _, bucket, share = rows.take(np.flatnonzero(lang == x))
            mean[i] = np.bincount(bucket, share, minlength=1 << BITS)
        mean /= np.maximum(np.linalg.norm(mean, axis=1), 1e-9)[:, None]
        left, at, chain = set(range(1, len(own))), 0, [0]
        while left:
            rest = np.array(sorted(left))
            at = int(rest[np.argmax(mean[rest] @ mean[at])])
            left.remove(at)
            chain.append(at)
        for place, i in enumerate(chain):
            family[own[i]] = f"{name} {place // GROUP}"
    return family


class Model:
    """machines: (level, one, other) -> column of weights. Level None is the family level."""

    def __init__(self, langs: list[str], family: dict[str, str] | None = None):
        self.langs = langs
        self.family = family or {x: FAMILY_OF.get(x, "other") for x in langs}
        self.families = sorted(set(self.family.values()))
        self.members = {f: [x for x in langs if self.family[x] == f] for f in self.families}
        self.pairs = [(None, a, b) for a, b in itertools.combinations(self.families, 2)]
        self.pairs += [(f, a, b) for f in self.families for a, b in itertools.combinations(self.members[f], 2)]
        self.w = np.zeros((len(self.pairs), 1 << BITS), np.float32)
        self.b, self.scale = np.zeros(len(self.pairs)), np.ones(len(self.pairs))
        #: log of how much likelier a bucket is in a language than at random
        self.usual = np.zeros((len(langs), 1 << BITS), np.float32)

    def fit(self, rows: Rows, lang: np.ndarray) -> Model:
        of = np.array([self.family[v] for v in lang])
        for k, (level, a, b) in enumerate(self.pairs):
            key = lang if level else of
            use = np.flatnonzero((key == a) | (key == b))
            if len(use):
                self.w[k], self.b[k], self.scale[k] = train_svm(rows, use, np.where(key[use] == a, 1.0, -1.0))
        for i, name in enumerate(self.langs):
            _, bucket, share = rows.take(np.flatnonzero(lang == name))
            own = np.bincount(bucket, share, minlength=1 << BITS) + 1e-3
            self.usual[i] = np.log(own / own.sum() * (1 << BITS))
        return self

    def margins(self, grams: Grams, level, wanted: np.ndarray) -> dict[int, np.ndarray]:
        """Chances of the first of each pair of a level, for the wanted texts."""
        out = {}
        for k, (at, _, _) in enumerate(self.pairs):
            if at == level:
                z = (grams.means(self.w[k], wanted) + self.b[k]) * self.scale[k]
                out[k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out

    def _vote(self, p: dict[int, np.ndarray], names: list[str], rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Winner by votes, then by summed confidence, then by name; and the winner's weakest duel."""
        votes, weakest = np.zeros((rows, len(names))), np.ones((rows, len(names)))
        for k, chance in p.items():
            i, j = names.index(self.pairs[k][1]), names.index(self.pairs[k][2])
            votes[:, i] += (chance >= 0.5) + 1e-3 * chance
            votes[:, j] += (chance < 0.5) + 1e-3 * (1 - chance)
            weakest[:, i] = np.minimum(weakest[:, i], chance)
            weakest[:, j] = np.minimum(weakest[:, j], 1 - chance)
        best = votes.argmax(axis=1)
        return best, weakest[np.arange(rows), best]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of each text its language, score, and how much likelier (log, a mean over its n-grams) its n-grams are in that language than at random."""
        rows = len(texts)
        lang, usual = np.full(rows, "und", dtype=object), np.full(rows, -np.inf)
        if not self.langs:
            return list(lang), np.zeros(rows), usual
        grams, everything = Grams(texts), np.ones(rows, bool)
        fam, score = self._vote(self.margins(grams, None, everything), self.families, rows)
        for i, f in enumerate(self.families):
            own = fam == i
            if own.any():
                best, s = self._vote(self.margins(grams, f, own), self.members[f], rows)
                lang[own] = np.array(self.members[f], dtype=object)[best[own]]
                score[own] = score[own] * s[own]
        for i, name in enumerate(self.langs):
            own = lang == name
            if own.any():
                usual[own] = grams.means(self.usual[i], own)[own]
        for i, t in enumerate(texts.to_pylist()):
            if t is None or not (t[:64].isalpha() or has_letter(t)):
                lang[i], score[i], usual[i] = "und", 0.0, -np.inf
        return list(lang), score, usual


def fit(docs: DataFrame, per_lang: int = 500, held_out=None) -> Model:
    """Learns from per_lang distinct texts of each language (all, if it has fewer), those with the smallest hashes of the text.

    The sample's bound is per_lang, less where all languages together would pass TRAINING_ROWS; each sampled text is read whole, and copies of a text count once.
    Every language is learned. Rows with null language or text or for which held_out is true are never used. docs: doc_id, text, lang;
    other columns may have any names. Without labelled rows, or of an empty table, the model knows no language.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if held_out is not None:
        rows = rows.where(~held_out(F.coalesce(F.col("id"), F.lit(""))))
    rows = rows.select("lang", F.xxhash64("text", F.lit("langid")).alias("h"), "text")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h", 0.02).alias("texts")).collect()  # a row a language
    langs = sorted(r.lang for r in counts)
    if not langs:
        return Model([])
    per_lang = max(1, min(per_lang, TRAINING_ROWS // len(langs)))
    # a generous share of the hashes first, so that the ranking below is over few rows even of a hot language
    shares = docs.sparkSession.createDataFrame([(r.lang, min(1.0, (2 * per_lang + 50) / max(r.texts, 1))) for r in counts], "lang string, share double")
    draw = F.col("h") / F.lit(float(1 << 64)) + 0.5
    chosen = rows.join(F.broadcast(shares) if len(langs) <= BROADCAST_LANGS else shares, "lang").where(draw < F.col("share"))
    one = chosen.groupBy("lang", "h").agg(F.min("text").alias("text"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.binary()), ("share", pa.binary())])

    def featurise(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = bags(part.column(0))
                yield batch_from({"lang": part.column(1).to_pylist(), "bucket": [x.tobytes() for x, _ in got], "share": [x.tobytes() for _, x in got]}, schema)

    got = one.withColumn("turn", turn).where(F.col("turn") <= per_lang).select("text", "lang").mapInArrow(featurise, "lang string, bucket binary, share binary").collect()
    got.sort(key=lambda r: (r.lang, r.bucket, r.share))
    sample, lang = Rows([(np.frombuffer(r.bucket, np.uint16), np.frombuffer(r.share, np.float32)) for r in got]), np.array([r.lang for r in got])
    return Model(langs, families(langs, sample, lang)).fit(sample, lang)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row: 'und' and 0 for a null text or one without a letter, and for all under a model without languages.

    Repeated rows are predicted alike, null ids stay null, very long texts are read whole, an empty table gives an empty result, and only doc_id
    and text are read, so other columns may have any names.
    """
    spark = docs.sparkSession
    blob = spark.sparkContext.broadcast(pickle.dumps(model))
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        model = pickle.loads(blob.value)
        for b in (p for whole in batches for p in pieces(whole, 1)):
            lang, score, _ = model.predict(b.column(1))
            yield batch_from({"doc_id": b.column(0), "lang_pred": lang, "score": score}, schema)

    return text_column(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs with a language whose n-grams are at least so much likelier in it than at random, as they were; no row is shuffled."""
    blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    i = docs.columns.index("text")

    def run(batches):
        model = pickle.loads(blob.value)
        for b in (p for whole in batches for p in pieces(whole, i)):
            lang, _, usual = model.predict(b.column(i))
            yield b.filter(pa.array([x != "und" and u >= least for x, u in zip(lang, usual.tolist(), strict=True)], pa.bool_()))

    return map_in_arrow(docs, run, docs.schema)
