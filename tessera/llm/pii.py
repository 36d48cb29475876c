"""Personal data: base patterns plus a linear-chain conditional random field.

The base patterns find e-mail addresses, IP addresses, payment cards and phone numbers by
their strict form. The field reads each text as a chain of words, sees only their shapes (some cue words, such as "call" or "dot", are shapes of their own) and
those of two neighbours on either side, and adds spans that the strict forms miss (an address
spelled "name at host dot org", a phone number without its plus). It is trained on a small
labelled table, phrases times formats, and decoded by Viterbi for many texts at once in numpy. A chain of marked words is a span if the
field prefers it to no span by SURE in log odds. Base spans are never removed;
a field's span that meets a base span or another is dropped.

Spans are in code points, end exclusive. A null text has no spans.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import kernels as K
from tessera.llm.common import batch_from, text_column
from tessera.shared import map_in_arrow

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits begins, so the look-behind loses nothing and a long run is read once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The strict forms: leftmost, non-overlapping per kind, failing matches dropped without another try."""
    out: list[tuple[str, int, int]] = []
    at, end = text.find("@"), 0
    while at >= 0:
        s = at
        while s > end and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at) if s < at else None
        if m:
            out.append(("email", s, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# ---- the field -------------------------------------------------------------------------------

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

# Words that are shapes of their own, by what they announce.
CUES = {
    "phone": "call phone tel telephone fax mobile cell ring dial hotline anruf telefon handy telefonnummer appelez téléphone portable llame llámame teléfono móvil",
    "card": "card visa mastercard amex karte kreditkarte carte tarjeta",
    "email": "mail email e-mail address adresse write contact reach correo courriel",
    "ip": "ip host server ping router",
}
AT, DOT, FIRST_CUE = 5, 6, 7

# The labelled table. d is a digit, n a digit from 1 to 9, l a letter, h a hexadecimal digit, c the cue words of the kind; other characters stand for themselves.
FORMATS = {
    "phone": ["nnd-ddd-dddd", "(nnd) ddd-dddd", "nnd ddd dddd", "nnd.ddd.dddd", "nddddddddd", "0dddddddddd", "1-ndd-ddd-dddd", "1 ndd ddd dddd", "0dd/ddddddd", "0dd/ddd dddd", "0dd ddddddd", "0dd dddd dddd", "0d dd dd dd dd", "0ddd ddddddd", "0ddd/dddddd", "(0dd) ddd-dddd", "(0dd) ddddddd", "+nd dd dddd dddd", "+n (ddd) ddd-dddd", "+nd ddd ddddddd", "ndd-dddd", "nnd-ddd dddd"],
    "card": ["dddd dddd dddd dddd", "dddd-dddd-dddd-dddd", "dddddddddddddddd", "dddd dddddd ddddd", "dddd.dddd.dddd.dddd"],
    "ip": ["ndd.ndd.d.dd", "nd.d.d.ndd:8080", "nd . d . d . ndd", "[ndd.nd.d.nd]"],
    "email": ["lllll at llll dot lll", "l.lllll at llll dot lll", "llllll [at] lllll [dot] ll", "lll_l (at) lll (dot) lll", "lllll@llll.lll", "lll at llll dot lllll dot ll", "llll.lllll@llll.llll.lll", "lllll at lllll.lll", "llll(at)llllll.ll"],
}
PHRASES = {
    "phone": ["c {} after six", "please c {} now", "c me at {} or later", "my c is {} at home", "c: {}", "his c number {} is new", "c {}", "you can c us on {} daily", "und der c {} ist da", "le c {} est bon", "por favor c al {} hoy", "c. {} in the evening"],
    "card": ["c {} valid", "my c number is {} today", "c: {}", "the c {} was lost", "paid by c {} in may", "die c {} ist da"],
    "ip": ["from c {} at night", "the c {} is down", "c: {}", "c {} answered"],
    "email": ["please c to {} before friday", "my c is {} thanks", "c: {}", "c him under {} or by post", "send it to {} today", "he wrote to {} twice", "{} is where we are", "und {} ist da"],
}
#: Formats that need no cue word.
ALONE = {"phone": ["nnd-ddd-dddd", "(nnd) ddd-dddd", "+nd dd dddd dddd", "+n (ddd) ddd-dddd", "(0dd) ddd-dddd", "1-ndd-ddd-dddd"], "card": ["dddd dddd dddd dddd", "dddd-dddd-dddd-dddd"], "ip": ["ndd.ndd.d.dd"], "email": FORMATS["email"]}
PLAIN_PHRASES = ["the house is at {} they say", "or {} instead", "{}", "we saw {} there on the way", "und {} ist das", "et {} sont ici", "| {} |"]
#: Rows without personal data.
CLEAN = """
we met at noon and the dot on the map was red
look at the house at the end of the road
the year nddd and the year nddd were good
in nddd there were dd of ddd left
in nddd and nddd they had ddd of ddd
version d.d.d of the tool came out
version dd.d of the c phone came out
section d.d and figure d.dd show it
he paid d,ddd.dd for d of them
the ratio is d.dd or d/d of it
key LLLLdLLLdLLdLdLLLdLL is secret
password=hhhhhhhhhhhhhhhhhhhh was set
api_key=hhhhhhhhhhhhhhhhhhhh was set
token = "hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh" expired
id dddddddddddddddd in the table
order ddddddd from dd.dd.dddd shipped
order number dddddddd was sent
invoice dddddd of dd.dd.dddd
account dddddddddd was closed
on dddd-dd-dd at dd:dd it began
since dddd-dd-dd it is so
call on dddd-dd-dd for it
call me at dd:dd or later
call it d.d or d
phone d of d is new
phone dd of the series from nddd
ring at dd.dd.dddd again
ring ddd times before dd
dial d for help and dd for more
number dd-dd-dddd is old
tel aviv in nddd had ddd
the card dd of ddd is lost
card dddd of the game
visa for nddd and nddd
host dd of ddd is down
server d.d.d came out
address dd main road
address ddd of the book
write ddd words in dd days
contact dd of ddd people
isbn ddd-d-dd-dddddd-d of the book
page dd to dd and ddd to ddd
| dd | ddd | dddd | total
| dddd | dddd | dddd | dddd |
dd dd dd dd dd dd
ddd ddd ddd ddd ddd
dddd dddd
ddd dddd
d d d d
the score was d - d in the end
room ddd on floor d of block d
d. first d. second d. third
(nddd) and (nddd) in the list
(d) one (dd) two (ddd) three
the and of to in is was for that with
haus und der die das ist nicht ein
la maison et le chat sont ici
el perro y la casa son de ana
THE!! AND!! OF!! IS!! END!!
word*** other### more$$$ text%%%
http://llllll.lll/path?id=dd is a link
https://www.lllll.lll/llll/lll here
see www.lllll.lll for more
a b c d e f g h
twenty people at the dot com office spoke
the word at is short and dot is too
@llll said so to @lllll
licensed under the gnu general public license, version d.
copyright (c) nddd lllll lllll. all rights reserved.
licensed under the apache license, version d.d (the "license")
-----BEGIN LLL LLLLLLL KEY-----
lllll LLLL_hhhhhhhhhhhhhhhhhhhhhhhh lll
ll.llll ll.llll ll.llll ll.llll ll.llll ll.llll ll.llll ll.llll
lllll.lll lllll.lll lllll lllll.ll lllll lll.llll lll
lll'l lll-lll lllll-ll l'lll lll lll-lll-lll lll
"""

PLAIN = 0
_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 letter, 2 digit, 3 '@', 4 '.', 5 '+', 6 bracket, 7 '-', 8 ':' '/' '=' '_'
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[0x30:0x3A] = 2
for _c, _k in (("@", 3), (".", 4), ("+", 5), ("(", 6), (")", 6), ("[", 6), ("]", 6), ("-", 7), (":", 8), ("/", 8), ("=", 8), ("_", 8)):
    _CLASS[ord(_c)] = _k
SHAPES = 1 << 15
#: What stands at the end of a word and is no part of it.
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".,;:!?"]] = True
#: Least log odds of a span against none.
SURE = 1.0
AROUND = (0, -1, 1, -2, 2)


def trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The ends of words without up to three closing marks; one character stays."""
    e = ends.copy()
    for _ in range(3):
        e -= (e - starts > 1) & _END[data[e - 1]]
    return e


def _cue_table() -> tuple[np.ndarray, np.ndarray]:
    words = [(w, FIRST_CUE + i) for i, k in enumerate(CUES) for w in CUES[k].split()] + [("at", AT), ("dot", DOT)]
    raw = [w.encode() for w, _ in words]
    size = np.array([len(w) for w in raw])
    ends = np.cumsum(size)
    h = K.span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - size, ends)
    order = np.argsort(h)
    return h[order], np.array([c for _, c in words])[order]


def shape_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A small integer per word that depends only on its shape: which kinds of characters, how many digits, dots and so on, or which cue it is."""
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = trimmed(data, starts, ends)
    cls = _CLASS[data]
    length = ends - starts
    sums = {}

    def count(k: int) -> np.ndarray:
        if k not in sums:
            sums[k] = np.concatenate(([0], np.cumsum(cls == k, dtype=np.int32)))
        return sums[k][ends] - sums[k][starts]

    letters, digits = count(1), count(2)
    # words of letters alone: their length up to 3
    code = np.minimum(length, 4)
    low = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)
    names, cue = _cue_table()
    may = np.flatnonzero((length <= 14) & (letters >= length - 1) & (letters > 1))
    h = K.span_hashes(low, starts[may], ends[may])
    i = np.minimum(np.searchsorted(names, h), len(names) - 1)
    is_cue = np.zeros(len(starts), bool)
    is_cue[may] = names[i] == h
    code[may] = np.where(names[i] == h, cue[i], code[may])
    special = np.flatnonzero((letters < length) & ~is_cue)
    if len(special):
        s, e, n = starts[special], ends[special], digits[special]
        bucket = np.searchsorted([*range(14), 20], n, side="right") - 1  # 0..14
        dots = np.minimum(count(4)[special], 3)
        has = lambda k: count(k)[special] > 0
        mask = has(1) * 1 + has(3) * 2 + has(5) * 4 + has(6) * 8 + has(7) * 16 + has(8) * 32
        spelled = (cls[s] == 6) & (cls[e - 1] == 6) & (n == 0)  # "(at)", "[dot]"
        code[special] = 16 + (((mask * 15 + bucket) * 4 + dots) * 2 + spelled) * 2 + (data[s] == 0x30)
    return code


class Field:
    """Emission of a word = the sum over AROUND of a table of the shape that stands so far from it; trans[a, b]."""

    def __init__(self):
        n = len(LABELS)
        self.tables = [np.zeros((SHAPES + 1, n), np.float32) for _ in AROUND]
        self.trans, self.start = np.zeros((n, n), np.float32), np.zeros(n, np.float32)
        for j, b in enumerate(LABELS):
            if b[0] == "I":
                self.start[j] = -1e4
                for i, a in enumerate(LABELS):
                    if a[2:] != b[2:]:
                        self.trans[i, j] = -1e4

    def emissions(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        size = np.diff(first)
        place = np.arange(len(codes)) - np.repeat(first[:-1], size)
        left = np.repeat(size, size) - place - 1
        out = np.zeros((len(codes), len(LABELS)), np.float32)
        for d, table in zip(AROUND, self.tables, strict=True):
            shape = codes
            if d:
                shape = np.full(len(codes), SHAPES)
                inside = np.flatnonzero(place >= -d if d < 0 else left >= d)
                shape[inside] = codes[inside + d]
            out += table[shape]
        return out

    def decode(self, codes: np.ndarray, first: np.ndarray, batch_words: int = 400_000) -> np.ndarray:
        """Best label of every word. Texts are padded to the longest of a batch; batches hold texts of like length."""
        out = np.zeros(len(codes), np.int8)
        if not len(codes):
            return out
        emit = self.emissions(codes, first)
        length = np.diff(first)
        order = np.argsort(-length, kind="stable")
        order = order[length[order] > 0]
        at = 0
        while at < len(order):
            t = int(length[order[at]])
            docs = order[at : at + max(1, batch_words // t)]
            at += len(docs)
            begin, n = first[docs], length[docs]
            best = emit[begin] + self.start
            back = np.zeros((t, len(docs), len(LABELS)), np.int8)
            live = len(docs)
            for step in range(1, t):
                while n[live - 1] <= step:
                    live -= 1
                s = best[:live, :, None] + self.trans
                k = s.argmax(axis=1)
                back[step, :live] = k
                best[:live] = np.take_along_axis(s, k[:, None, :], axis=1)[:, 0] + emit[begin[:live] + step]
            label = best.argmax(axis=1)
            alive = 0
            for step in range(t - 1, -1, -1):
                while alive < len(docs) and n[alive] > step:
                    alive += 1
                i = np.arange(alive)
                out[begin[:alive] + step] = label[:alive]
                if step:
                    label[:alive] = back[step, i, label[:alive]]
        return out


def labelled_rows(seed: int = 17, formats: dict | None = None) -> list[tuple[str, list[int]]]:
    """The labelled table: texts and the label of each word. Digits and letters are drawn by a generator with a fixed seed."""
    rng = np.random.default_rng(seed)
    kinds = {"d": "0123456789", "n": "123456789", "l": "abcdefghijklmnopqrstuvwxyz", "L": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "h": "0123456789abcdef"}

    def filled(pattern: str) -> str:
        return "".join(kinds[c][rng.integers(len(kinds[c]))] if c in kinds else c for c in pattern)

    rows: list[tuple[str, list[int]]] = []

    def add(phrase: str, kind: str, pattern: str) -> None:
        cue = CUES[kind].split()
        words, labels = [], []
        for w in phrase.split():
            if w.strip(":.") == "{}":
                value = filled(pattern).replace(" dot ", " dot ").split()
                words += value
                labels += [LABELS.index(("B-" if i == 0 else "I-") + kind) for i in range(len(value))]
            else:
                words.append(w.replace("c", cue[rng.integers(len(cue))]) if w.strip(":.") == "c" else w)
                labels.append(0)
        rows.append((" ".join(words), labels))

    spelled = lambda p: p.replace(" at ", " \x00t ").replace(" dot ", " \x00o ").replace("[at]", "[\x00t]").replace("[dot]", "[\x00o]").replace("(at)", "(\x00t)").replace("(dot)", "(\x00o)")  # noqa: E731  these words are no patterns
    given = formats or FORMATS
    for kind, patterns in given.items():
        for pattern in patterns:
            for phrase in PHRASES[kind]:
                add(phrase, kind, spelled(pattern))
            if pattern in ALONE[kind]:
                for phrase in PLAIN_PHRASES:
                    add(phrase, kind, spelled(pattern))
    rows = [(t.replace("\x00t", "at").replace("\x00o", "dot"), y) for t, y in rows]
    for line in CLEAN.strip().splitlines():
        for _ in range(6):
            text = " ".join(filled(w) if sum(c in "dnhL" for c in w) >= 0.5 * sum(c.isalnum() for c in w) and not w.strip("|-").islower() or set(w.strip(".,:;|()-/#*\"")) <= set("dn") or "lll" in w or "hhh" in w else w for w in line.split())
            rows.append((text, [0] * len(text.split())))
    # words of letters alone in every mixture of lengths, runs of one word, and the cue words out of place
    cues = [w for k in CUES for w in CUES[k].split()] + ["at", "dot"]
    for i in range(240):
        lengths = rng.integers(1, 10, 1 if i % 3 == 0 else 24)
        words = ["".join(kinds["l"][j] for j in rng.integers(0, 26, n)) for n in lengths]
        words = words * 24 if i % 3 == 0 else [("at", "dot", cues[rng.integers(len(cues))])[int(rng.choice(3, p=[0.5, 0.1, 0.4]))] if i % 3 == 1 and rng.random() < 0.12 else w for w in words]
        rows.append((" ".join(words[:24]), [0] * 24))
    for w in ("at", "dot", "at the", "the dot"):
        words = (w.split() * 24)[:24]
        rows.append((" ".join(words), [0] * 24))
    return rows


def train(rows: list[tuple[str, list[int]]] | None = None, epochs: int = 200, rate: float = 0.3, reg: float = 1e-3) -> Field:
    """Maximum likelihood by gradient ascent; marginals by the forward-backward recursion, over all rows side by side."""
    rows = labelled_rows() if rows is None else rows
    f, n = Field(), len(LABELS)
    size = np.array([len(y) for _, y in rows])
    rows = [rows[i] for i in np.argsort(-size, kind="stable")]
    size = -np.sort(-size)
    first = np.concatenate(([0], np.cumsum(size)))
    y = np.concatenate([np.array(labels) for _, labels in rows])
    codes = []
    for _, data, off in K.chunks(pa.array([t for t, _ in rows], pa.string())):
        s, e, _ = K.word_bounds(data, off)
        codes.append(shape_codes(data, s, e))
    codes = np.concatenate(codes)
    place = np.arange(len(codes)) - np.repeat(first[:-1], size)
    left = np.repeat(size, size) - place - 1
    shapes = []
    for d in AROUND:
        shape = np.full(len(codes), SHAPES)
        inside = np.flatnonzero((place >= -d) & (left >= d))
        shape[inside] = codes[inside + d]
        shapes.append(shape)
    used = [np.unique(shape, return_inverse=True) for shape in shapes]
    inner = np.flatnonzero(place > 0)
    free = f.trans > -1e3
    live = [int((size > t).sum()) for t in range(int(size.max()))]
    lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
    tables = [np.zeros((len(u), n)) for u, _ in used]
    trans = f.trans.astype(float)
    acc, acc_t = [np.full(t.shape, 1e-3) for t in tables], np.full(trans.shape, 1e-3)
    for _ in range(epochs):
        emit = sum(t[inv] for t, (_, inv) in zip(tables, used, strict=True))
        fwd, bwd = np.zeros(emit.shape), np.zeros(emit.shape)
        for t, k in enumerate(live):  # texts are sorted by length, so the live ones come first
            at = first[:k] + t
            fwd[at] = emit[at] + (f.start if t == 0 else lse(fwd[at - 1][:, :, None] + trans, 1))
        for t in range(len(live) - 2, -1, -1):
            at = first[: live[t + 1]] + t
            bwd[at] = lse(trans[None] + (emit[at + 1] + bwd[at + 1])[:, None, :], 2)
        z = np.repeat(lse(fwd[first[1:] - 1], 1), size)
        p = -np.exp(fwd + bwd - z[:, None])
        p[np.arange(len(y)), y] += 1
        pair = np.exp(fwd[inner - 1][:, :, None] + trans + (emit[inner] + bwd[inner])[:, None, :] - z[inner][:, None, None]).sum(axis=0)
        seen = np.zeros((n, n))
        np.add.at(seen, (y[inner - 1], y[inner]), 1)
        for table, a, (_, inv) in zip(tables, acc, used, strict=True):
            g = np.stack([np.bincount(inv, p[:, c], minlength=len(table)) for c in range(n)], axis=1) - reg * table
            a += g * g
            table += rate * g / np.sqrt(a)
        g = np.where(free, seen - pair - reg * trans, 0)
        acc_t += g * g
        trans += rate * g / np.sqrt(acc_t)
    for full, t, (u, _) in zip(f.tables, tables, used, strict=True):
        full[u] = t
    # a shape that the table lacks says nothing for any kind, and here, where it is the word itself, speaks for none
    known = np.zeros(SHAPES + 1, bool)
    known[used[0][0]] = True
    f.tables[0][~known, 0] = UNKNOWN
    f.trans = trans.astype(np.float32)
    return f


#: How much a word of a shape that the table lacks speaks against any span.
UNKNOWN = 4.0


def find_spans(texts: pa.Array, field: Field) -> list[tuple[list, list]]:
    """(base spans, spans that the field adds) of each text, each as (kind, start, end) in order of kind, then start."""
    rank = {k: i for i, k in enumerate(KINDS)}
    out: list = [None] * len(texts)
    for row, data, off in K.chunks(texts):
        s, e, first = K.word_bounds(data, off)
        codes = shape_codes(data, s, e)
        label = field.decode(codes, first)
        marked = np.flatnonzero(label)
        raw = data.tobytes()
        e = trimmed(data, s, e)
        more: dict[int, list] = {}
        if len(marked):
            for kind, i, j in _sure(field, codes, first, label, marked):
                more.setdefault(int(np.searchsorted(first, i, side="right")) - 1, []).append((kind, i, j))
        for d in range(len(off) - 1):
            body = raw[off[d] : off[d + 1]]
            text = body.decode("utf-8", "replace")
            base = sorted(base_spans(text), key=lambda x: (rank[x[0]], x[1]))
            added = []
            for kind, i, j in more.get(d, ()):
                a, b = int(s[i] - off[d]), int(e[j] - off[d])
                at, size = len(body[:a].decode("utf-8", "replace")), len(body[a:b].decode("utf-8", "replace"))
                if not any(x[1] < at + size and at < x[2] for x in base + added):
                    added.append((kind, at, at + size))
            out[row + d] = (base, added)
    return out


def _sure(field: Field, codes: np.ndarray, first: np.ndarray, label: np.ndarray, marked: np.ndarray):
    """(kind, first word, last word) of each chain of marked words that the field prefers to no span by SURE."""
    begins = [i for i in marked.tolist() if LABELS[label[i]][0] == "B" or i == 0 or not label[i - 1]]
    starts = set(first.tolist())
    for i in begins:
        j = i
        while j + 1 < len(label) and j + 1 not in starts and label[j + 1] and LABELS[label[j + 1]][0] == "I":
            j += 1
        d = int(np.searchsorted(first, i, side="right")) - 1
        low, high = max(int(first[d]), i - 3), min(int(first[d + 1]), j + 4)
        emit = field.emissions(codes[low:high], np.array([0, high - low]))[i - low : j + 1 - low]
        own = label[i : j + 1].astype(int)
        path = [int(label[i - 1]) if i > first[d] else -1, *own, int(label[j + 1]) if j + 1 < first[d + 1] else -1]
        none = [path[0], *[0] * len(own), path[-1]]
        odds = float(emit[np.arange(len(own)), own].sum() - emit[:, 0].sum())
        for p, sign in ((path, 1), (none, -1)):
            odds += sign * float(sum(field.start[b] if a < 0 else 0.0 if b < 0 else field.trans[a, b] for a, b in zip(p, p[1:], strict=False)))
        if odds >= SURE:
            yield LABELS[own[0]][2:], i, j


def joined(spans) -> str:
    rank = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (rank[x[0]], x[1])))


SPAN = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def detect(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id and its spans, a row for every input row.

    A null or empty text has none; repeated rows have the same; null ids stay; very long texts are read whole; an empty table gives an
    empty result; only doc_id and text are read, so other columns may have any names. Texts that are not valid UTF-8 are read with replacement characters.
    """
    blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(field or train()))
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])))])

    def run(batches):
        field = pickle.loads(blob.value)
        for b in batches:
            got = [[{"kind": k, "start": s, "end": e, "base": base} for part, base in ((own, True), (added, False)) for k, s, e in part] for own, added in find_spans(b.column(1), field)]
            yield batch_from({"doc_id": b.column(0), "spans": got}, schema)

    return text_column(docs).mapInArrow(run, f"doc_id long, spans {SPAN}")


def redact(text: str | None, spans) -> str | None:
    """The text with every span replaced by its kind in capitals, in brackets; of spans that meet, the first wins."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s < at:
            at = max(at, e)
            continue
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with personal data replaced in text and n_chars counted anew; every other column as it was."""
    blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(field or train()))
    i = docs.columns.index("text")

    def run(batches):
        field = pickle.loads(blob.value)
        for b in batches:
            texts = b.column(i).to_pylist()
            done = [redact(t, [*own, *more]) for t, (own, more) in zip(texts, find_spans(b.column(i), field), strict=True)]
            cols = [pa.array(done, b.schema.field(i).type) if k == i else pa.array([None if t is None else len(t) for t in done], b.schema.field(k).type) if b.schema.field(k).name == "n_chars" else b.column(k) for k in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return map_in_arrow(docs, run, docs.schema)
