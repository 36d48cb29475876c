"""Exact tokenisation through a cache of segments.

Both tokenisers cut a text at places that no token crosses. Segments between such
places repeat far more often than texts do, so each worker encodes a new segment once with the
library and looks up the rest. The cache is bounded by a count and started anew when full; it never changes a result.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np

from tessera.llm import kernels as K

CACHE_SEGMENTS = 250_000


class SegmentCache:
    """segment -> packed ids; encode_new(list of segments) gives the packed ids of new ones."""

    def __init__(self, encode_new):
        self.encode_new, self.known = encode_new, {}

    def encode(self, parts: list[list[str]]) -> list[bytes]:
        for again in (False, True):
            get = self.known.get
            found = [list(map(get, p)) for p in parts]
            lacking = [i for i, v in enumerate(found) if None in v]
            if not lacking:
                break
            new = {s for i in lacking for s, v in zip(parts[i], found[i], strict=True) if v is None}
            if len(self.known) + len(new) > CACHE_SEGMENTS and self.known and not again:
                self.known = {}
                continue
            break
        if lacking:
            todo = list(new)
            self.known.update(zip(todo, self.encode_new(todo), strict=True))
            get = self.known.__getitem__
            for i in lacking:
                found[i] = list(map(get, parts[i]))
        return list(map(b"".join, found))


_loaded: dict = {}


def once(kind, path: str):
    """One object of a kind for each file and worker process; workers serve many tasks and keep their caches."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


class ByteLevel:
    """A byte-level BPE file of the tokenizers library, over the bytes of an Arrow column.

    Texts are cut before every space, line feed, comma and stop, and after a line feed: the pre-tokeniser's
    tokens take at most one leading space, a lone line feed is a token of its own, and letters and
    digits end before a comma or stop. Where that is not so (white space in a row or outside ASCII, a comma or
    stop after anything but a letter or digit, added tokens) the whole text goes to the library.

    Cut segments of up to sixteen bytes are looked up in a table of fixed size, where a hit agrees in length and in all
    its bytes (the first eight and the last eight). Longer ones are known by a digest of 128 bits. Segments not
    found are encoded by the library, many at a time with line feeds between.
    """

    SLOTS = 1 << 20
    POOL_IDS = 1 << 23
    LONG_KNOWN = 200_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.kind = np.uint16 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.feed = self._ids("\n")
        self._forget()

    def _forget(self) -> None:
        self.head, self.tail = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.uint64)
        self.size = np.zeros(self.SLOTS, np.uint8)  # bytes of the segment; 0: an empty slot
        self.at, self.len = np.zeros(self.SLOTS, np.int64), np.zeros(self.SLOTS, np.int64)
        self.pool, self.used = np.zeros(self.POOL_IDS, self.kind), 0
        self.long: dict[bytes, tuple[int, int]] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _uneven(self, data: np.ndarray, off: np.ndarray, raw: bytes) -> np.ndarray:
        """Documents that may not be cut."""
        prev = np.zeros(len(data), np.uint8)
        prev[1:] = data[:-1]
        prev[off[:-1][off[:-1] < len(data)]] = 0x41
        odd = _WHITE[data] & _WHITE[prev]
        odd |= _ODD_SPACE[data]
        lead = np.zeros(len(data), np.uint8)
        lead[2:] = data[:-2]
        stop = (data == 0x2C) | (data == 0x2E)
        at = np.flatnonzero(stop)
        p, q = prev[at], lead[at]
        odd[at] |= ~(_ALNUM[p] | ((p >= 0x80) & (q == 0xC3) & (p != 0x97) & (p != 0xB7)))
        # white space outside ASCII: U+0085, U+00A0, U+1680, U+2000-U+206F, U+3000
        at = np.flatnonzero((prev == 0xC2) & ((data == 0x85) | (data == 0xA0)) | (lead == 0xE1) & (prev == 0x9A) | (prev == 0xE2) & ((data == 0x80) | (data == 0x81)) | (lead == 0xE3) & (prev == 0x80) & (data == 0x80))
        odd[at] = True
        for s in self.special:
            i = raw.find(s)
            while i >= 0:
                odd[i] = True
                i = raw.find(s, i + 1)
        bad = np.zeros(len(off) - 1, bool)
        bad[np.searchsorted(off, np.flatnonzero(odd), side="right") - 1] = True
        return bad

    def encode_new(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments without inner white space, one after another, and their counts."""
        ids = np.array(self.tok.encode_batch_fast(["\n".join(segments)], add_special_tokens=False)[0].ids, self.kind)
        feeds = np.flatnonzero(ids == self.feed[0])
        if len(self.feed) != 1 or len(feeds) != len(segments) - 1:
            each = [np.array(self._ids(s), self.kind) for s in segments]
            return np.concatenate(each), np.array([len(e) for e in each])
        return np.delete(ids, feeds), np.diff(np.concatenate(([-1], feeds, [len(ids)]))) - 1

    def _encode_all(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all given segments in some order, and of each where its ids begin there and how many it has."""
        text = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids, count = [np.zeros(0, self.kind)], np.zeros(len(text), np.int64)
        simple = np.flatnonzero(~whole)
        order = np.concatenate((simple, np.flatnonzero(whole)))
        for i in range(0, len(simple), 16384):
            got, counts = self.encode_new([text[k] for k in simple[i : i + 16384]])
            ids.append(got)
            count[simple[i : i + 16384]] = counts
        for k in np.flatnonzero(whole):
            got = self._ids(text[k])
            ids.append(np.array(got, self.kind))
            count[k] = len(got)
        place = np.zeros(len(text), np.int64)
        place[order] = np.cumsum(count[order]) - count[order]
        return np.concatenate(ids), place, count

    def encode_chunk(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk's documents one after another, and the number of each document."""
        docs, n = len(off) - 1, len(data)
        if not n:
            return np.zeros(0, self.kind), np.zeros(docs, np.int64)
        raw = data.tobytes()
        bad = self._uneven(data, off, raw)
        cut = _CUT_BEFORE[data]
        feed = np.flatnonzero(data == 0x0A) + 1
        cut[feed[feed < n]] = True
        cut[off[:-1][off[:-1] < n]] = True
        for d in np.flatnonzero(bad):
            cut[off[d] + 1 : off[d + 1]] = False
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        length = ends - starts
        eight = K.eights(data)
        head = eight[starts] & _HEAD_MASK[np.minimum(length, 8)]
        tail = np.where(length > 8, eight[np.maximum(ends - 8, 0)], 0)
        short = length <= 16
        with np.errstate(over="ignore"):
            slot = (K.mix(head ^ K.mix(tail + length.astype(np.uint64))) % np.uint64(self.SLOTS)).astype(np.int64)
        hit = short & (self.size[slot] == np.minimum(length, 255)) & (self.head[slot] == head) & (self.tail[slot] == tail)
        at, size = self.at[slot], self.len[slot]
        # one representative of each segment that is not known
        miss = np.flatnonzero(short & ~hit)
        order = miss[np.lexsort((tail[miss], head[miss], length[miss]))]
        differ = (np.diff(length[order]) != 0) | (np.diff(head[order].view(np.int64)) != 0) | (np.diff(tail[order].view(np.int64)) != 0)
        first = np.concatenate(([True], differ)) if len(order) else np.zeros(0, bool)
        which = np.cumsum(first) - 1
        new, names, waits = order[first].tolist(), {}, []
        for i in np.flatnonzero(~short).tolist():
            name = hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=16).digest()
            known = self.long.get(name)
            if known:
                at[i], size[i] = known
            else:
                if name not in names:
                    names[name] = len(new)
                    new.append(i)
                waits.append((i, names[name]))
        table = self.pool
        if new:
            new = np.array(new)
            whole = bad[np.searchsorted(off, starts[new], side="right") - 1] | (data[starts[new]] == 0x0A)
            ids, place, count = self._encode_all(raw, starts[new], ends[new], whole)
            fits = self.used + len(ids) <= len(self.pool) and len(self.long) + len(names) <= self.LONG_KNOWN
            if fits:
                self.pool[self.used : self.used + len(ids)] = ids
                place += self.used
                self.used += len(ids)
            else:
                place += self.used
                table = np.concatenate((self.pool[: self.used], ids))
            at[order], size[order] = place[which], count[which]
            for i, k in waits:
                at[i], size[i] = place[k], count[k]
            if fits:
                kept = np.arange(len(order[first]))
                spots, last = np.unique(slot[new[kept]][::-1], return_index=True)  # of new segments that meet in a slot one is kept
                last = len(kept) - 1 - last
                own = new[last]
                self.head[spots], self.tail[spots], self.size[spots] = head[own], tail[own], length[own]
                self.at[spots], self.len[spots] = place[last], count[last]
                self.long |= {name: (int(place[k]), int(count[k])) for name, k in names.items()}
            else:
                self._forget()
        ends_of = np.cumsum(size)
        total = int(ends_of[-1])
        out = table[np.repeat(at - ends_of + size, size) + np.arange(total)]
        per = np.concatenate(([0], ends_of))[np.searchsorted(starts, off)]
        return out, np.diff(per)


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x0A]] = True
_ODD_SPACE = np.zeros(256, bool)
_ODD_SPACE[[0x09, 0x0B, 0x0C, 0x0D, *range(0x1C, 0x20)]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_CUT_BEFORE = np.zeros(256, bool)
_CUT_BEFORE[[0x20, 0x0A, 0x2C, 0x2E]] = True
_HEAD_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def groups(texts: list[str], chars: int = 1_000_000):
    """(first, end) of runs of texts of about so many characters, one text at least."""
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (end == at or n + len(texts[end]) <= chars):
            n += len(texts[end])
            end += 1
        yield at, end
        at = end
