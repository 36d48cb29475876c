"""SentencePiece encoding that keeps offsets, and decoding.

The normaliser is our own: at each place it takes the longest prefix that the model's compiled
character map knows (a double-array trie), writes what the map says, and notes for every byte of the result where in
the source it came from. The normalised text is cut where no piece of the vocabulary can cross, each new
segment is encoded once by the library (through a copy of the model whose own normaliser does nothing), and each
piece is projected through the alignment to a byte span of the original text.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import batch_from, executor_file, text_column
from tessera.llm.segments import SegmentCache, groups, once

SPACE = "▁"
_SPACE_BYTES = SPACE.encode()
_CUT = re.compile("(?<=[^▁])(?=▁)")
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(b: bytes):
    """(field number, wire type, value) of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        v = s = 0
        while True:
            c = b[i]
            i += 1
            v |= (c & 127) << s
            s += 7
            if c < 128:
                return v

    while i < len(b):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, kind, b[i : i + n]
            i += n


def _varint(v: int) -> bytes:
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes([*out, v])


def _message(fields) -> bytes:
    out = b""
    for f, kind, v in fields:
        out += _varint(f << 3 | kind) + (_varint(v) if kind == 0 else (_varint(len(v)) if kind == 2 else b"") + v)
    return out


class Normalizer:
    """The spec of a model: character map and white-space rules."""

    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, squeeze: bool = True, escape: bool = True):
        self.dummy_prefix, self.squeeze, self.escape = dummy_prefix, squeeze, escape
        self.units, self.blob = None, b""
        if charsmap:
            (size,) = struct.unpack_from("<I", charsmap)
            self.units = struct.unpack_from(f"<{size // 4}I", charsmap, 4)
            self.blob = charsmap[4 + size :]
        self.memo: dict[bytes, tuple[bytes, int]] = {}

    @property
    def plain(self) -> bool:
        return self.units is None and not self.squeeze and self.escape and self.dummy_prefix

    def prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        """What the longest known prefix of data[at:] becomes, and its length in bytes."""
        if self.units is not None:
            u = self.units
            node = (u[0] >> 10) << ((u[0] & 0x200) >> 6)
            found = None
            for i in range(at, len(data)):
                c = data[i]
                node ^= c
                if node >= len(u):
                    break
                unit = u[node]
                if unit & 0x800000FF != c:
                    break
                node ^= (unit >> 10) << ((unit & 0x200) >> 6)
                if unit >> 8 & 1:
                    found = (u[node] & 0x7FFFFFFF, i + 1 - at)
            if found:
                return self.blob[found[0] : self.blob.index(b"\0", found[0])], found[1]
        c = data[at]
        n = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
        return data[at : at + n], n

    def normalize(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes the source offset (one more: the end)."""
        out, origin = bytearray(), []
        at = 0
        if self.squeeze:
            while at < len(data):
                s, n = self.prefix(data, at)
                if s != b" ":
                    break
                at += n
        if at >= len(data):
            return b"", np.zeros(1, np.int64)
        space = _SPACE_BYTES if self.escape else b" "
        if self.dummy_prefix:
            out += space
            origin += [at] * len(space)
        after_space = self.squeeze
        while at < len(data):
            s, n = self.prefix(data, at)
            while after_space and s[:1] == b" ":
                s = s[1:]
            for c in s:
                if c == 0x20 and self.escape:
                    out += _SPACE_BYTES
                    origin += [at] * 3
                else:
                    out.append(c)
                    origin.append(at)
            if s:
                after_space = s[-1:] == b" "
            at += n
            if not self.squeeze:
                after_space = False
        if self.squeeze:
            while out.endswith(space):
                at = origin[len(out) - len(space)]
                del out[len(out) - len(space) :]
                del origin[len(out) :]
        return bytes(out), np.array([*origin, at], np.int64)


class Processor:
    def __init__(self, path: str):
        import sentencepiece

        raw = open(executor_file(path), "rb").read()
        fields = list(_fields(raw))
        spec = {f: v for f, _, v in _fields(next((v for f, _, v in fields if f == 3), b""))}
        self.norm = Normalizer(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))
        quiet = _message([(1, 2, b"identity"), (2, 2, b""), (3, 0, 0), (4, 0, 0), (5, 0, 1)])
        bare = _message([(f, w, quiet if f == 3 else v) for f, w, v in fields if f != 4])
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=bare)
        self.full = sentencepiece.SentencePieceProcessor(model_proto=raw)
        pieces = [({a: b for a, _, b in _fields(v)}) for f, _, v in fields if f == 1]
        names, kinds = [p.get(1, b"") for p in pieces], [p.get(3, NORMAL) for p in pieces]
        text = [n.decode() for n, k in zip(names, kinds, strict=True) if k in (NORMAL, USER_DEFINED)]
        train = {f: v for f, _, v in _fields(next((v for f, _, v in fields if f == 2), b""))}
        #: Cutting is exact for BPE without symbols of the user's and without pieces that run over a space.
        self.cuts = train.get(3, 1) == 2 and USER_DEFINED not in kinds and not any(SPACE in t.lstrip(SPACE) for t in text)
        self.line_cuts = self.cuts and not any("\n" in t for t in text)
        # bytes of each piece in the normalised text, and the same with an escaped space as one byte
        self.width = np.array([1 if k == BYTE else len(n) for n, k in zip(names, kinds, strict=True)], np.uint16)
        self.narrow = np.array([1 if k == BYTE else len(n) - 2 * n.count(_SPACE_BYTES) for n, k in zip(names, kinds, strict=True)], np.uint16)
        self.cache = SegmentCache(self._encode_new)

    def _split(self, norm: str) -> list[str]:
        if not self.cuts or "\x01" in norm:
            return [norm]
        if SPACE + SPACE not in norm:
            norm = norm[1:].replace(SPACE, "\x01" + SPACE)  # the first stays at the front
            return ((SPACE + norm).replace("\n", "\x01\n\x01") if self.line_cuts else SPACE + norm).split("\x01")
        return _CUT.split(norm)

    def _encode_new(self, segments: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(ids)}i", *ids) for ids in self.bare.encode(segments, num_threads=1)]

    def _ids(self, norms: list[str]) -> list[bytes]:
        return self.cache.encode([self._split(t) if t[:1] == SPACE else [t] for t in norms])

    def encode(self, texts: list[str], spans: bool = True) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """Per text its ids, and with spans an array [pieces, 2] of begin and end bytes in the source.

        A piece made only of an added prefix has an empty span. Spans are in order and together cover what the normaliser kept.
        """
        norms, align = [], []
        for t in texts:
            if self.norm.plain and SPACE not in t:
                norms.append(SPACE + t.replace(" ", SPACE) if t else "")
                align.append(None)
            else:
                b, origin = self.norm.normalize(t.encode("utf-8", "replace"))
                norms.append(b.decode())
                align.append(origin)
        out = []
        for raw, a, norm in zip(self._ids(norms), align, norms, strict=True):
            ids = np.frombuffer(raw, np.int32)
            if not spans:
                out.append((ids, None))
                continue
            if a is None:
                ends = np.cumsum(self.narrow[ids], dtype=np.int64) - 1  # the prefix takes no source byte
                out.append((ids, np.stack((np.concatenate(([0], ends[:-1])), ends), axis=1) if len(ids) else np.zeros((0, 2), np.int64)))
            else:
                width = self.width[ids].astype(np.int64)
                if (ids == self.bare.unk_id()).any():  # an unknown piece is as wide as what it stands for
                    width = np.array([len(p.surface.encode()) for p in self.bare.encode(norm, return_type="proto").pieces], np.int64)
                at = np.concatenate(([0], np.cumsum(width)))
                out.append((ids, np.stack((a[at[:-1]], a[at[1:]]), axis=1) if len(ids) else np.zeros((0, 2), np.int64)))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.full.decode(ids) if ids else ""


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, begins, ends of every whole text: the general form. Null is empty."""
    executor_file(model)
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.list_(pa.int32())) for n in ("ids", "begins", "ends"))])

    def run(batches):
        sp = once(Processor, model)
        for b in batches:
            texts, names = texts_of(b.column(1)), b.column(0)
            for s, e in groups(texts, 4_000_000):
                got = sp.encode(texts[s:e])
                yield batch_from({"doc_id": names[s:e], "ids": [i for i, _ in got], "begins": [x[:, 0].astype(np.int32) for _, x in got], "ends": [x[:, 1].astype(np.int32) for _, x in got]}, schema)

    return text_column(docs).mapInArrow(run, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of encoded rows (doc_id, ids); null ids decode to an empty text."""
    executor_file(model)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        sp = once(Processor, model)
        for b in batches:
            yield batch_from({"doc_id": b.column(0), "text": [sp.decode(x or []) for x in b.column(1).to_pylist()]}, schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """encode, project and decode in one pass, returning counts and digests only.

    doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 (of the decimal begin and end byte of every piece in the source, as begin:end joined by commas).
    A null text is empty; repeated rows are encoded alike; null ids stay; very long texts are encoded whole; an empty table gives an empty result; only
    doc_id and text are read, so other columns may have any names. Bytes that are not valid UTF-8 are read as replacement characters.
    """
    import hashlib

    executor_file(model)
    kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_sha256", pa.string())]
    schema = pa.schema(kinds)

    def run(batches):
        sp = once(Processor, model)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        decimal = np.array([str(i) for i in range(len(sp.width))], object)
        numbers = [str(i) for i in range(1 << 16)]
        for b in batches:
            texts, names = texts_of(b.column(1)), b.column(0)
            for s, e in groups(texts):
                rows = {k: [] for k, _ in kinds}
                for ids, spans in sp.encode(texts[s:e]):
                    rows["n_tokens"].append(len(ids))
                    rows["ids_sha256"].append(sha(",".join(decimal[ids]).encode()))
                    rows["decoded_sha256"].append(sha(sp.decode(ids.tolist()).encode()))
                    rows["spans_sha256"].append(sha(spans_text(spans, numbers).encode()))
                rows["doc_id"] = names[s:e]
                yield batch_from(rows, schema)

    return text_column(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def spans_text(spans: np.ndarray, numbers: list[str]) -> str:
    """begin:end of each span, joined by commas; numbers: decimals that are at hand."""
    flat = spans.ravel().tolist()
    text = [numbers[i] if i < len(numbers) else str(i) for i in flat]
    return ",".join(map(":".join, zip(text[::2], text[1::2], strict=True)))


def texts_of(column: pa.Array) -> list[str]:
    """Null as the empty text; bytes that are not valid UTF-8 as replacement characters."""
    try:
        return [t or "" for t in column.to_pylist()]
    except UnicodeDecodeError:
        return [b"".decode() if t is None else t.decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]
