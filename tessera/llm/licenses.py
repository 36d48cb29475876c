"""License scans by a positional index of rare words.

A notice is a known passage of words with phrases that it must hold. The document frequency of every notice word is counted over all documents. In a
file, a notice is looked up by the words of it that the file holds and that are rarest in the corpus (of highest IDF): each place of such a word, less the word's places in the notice, is
a relative position, and the relative positions of the words are intersected. Where enough of them agree, the notice's words are compared in place and the
mandatory phrases are verified. A notice that is its own mandatory phrase is found at every place where it stands, since all its words agree there.

Words are runs of digits, letters a to z (A-Z are lower-cased) and characters outside ASCII.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.common import text_column


class Notice(NamedTuple):
    label: str
    words: str
    phrases: tuple[str, ...]
    base: bool = False


# Phrases that alone name a license, and passages of well-known license notices with the phrases that each must hold.
NOTICES = (
    Notice("mit", "under the mit license", ("under the mit license",), True),
    Notice("apache-2", "apache license version 2", ("apache license version 2",), True),
    Notice("cc-by-nc", "cc by nc", ("cc by nc",), True),
    Notice("agpl-3", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license", "version 3")),
    Notice("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("the apache license version 2",)),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "the following conditions are met")),
    Notice("cc-by", "licensed under the creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Notice("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Notice("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", ("dedicated the work to the public domain",)),
    Notice("gpl-2", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2")),
    Notice("gpl-3", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    Notice("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    Notice("lgpl-3", "it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license", ("gnu lesser general public license", "version 3")),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Notice("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
#: Words of a notice that are looked up in a file: the rarest that the file holds.
RAREST = 4
#: Share of a notice's words that must stand in place.
SHARE = 0.5
#: Words beside a notice's place in which its mandatory phrases may begin or end.
SLACK = 12

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_APART = np.zeros(256, bool)
_APART[:0x80] = True
_APART[0x30:0x3A], _APART[0x61:0x7B] = False, False
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def _names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, first and last eight bytes of words: equal for words of up to sixteen bytes only if these are equal."""
    eight, length = K.eights(data), ends - starts
    return length, eight[starts] & _MASK[np.minimum(length, 8)], np.where(length > 8, eight[np.maximum(ends - 8, 0)], 0)


class Vocabulary:
    """The words of notices, of sixteen bytes at most each, by number, in order of the alphabet."""

    def __init__(self, notices):
        self.words = sorted({w for n in notices for part in (n.words, *n.phrases) for w in part.split()})
        raw = [w.encode() for w in self.words]
        if any(len(w) > 16 for w in raw):
            raise ValueError("words of notices have sixteen bytes at most")
        data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(w) for w in raw])
        self.length, self.head, self.tail = _names(data, ends - [len(w) for w in raw], ends)
        key = self._key(self.length, self.head, self.tail)
        self.order = np.argsort(key)
        self.keys = key[self.order]
        number = {w: i for i, w in enumerate(self.words)}
        self.numbers = lambda text: np.array([number[w] for w in text.split()])

    @staticmethod
    def _key(length, head, tail) -> np.ndarray:
        with np.errstate(over="ignore"):
            return K.mix(head ^ K.mix(tail + length.astype(np.uint64)))

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for others."""
        length, head, tail = _names(data, starts, ends)
        at = self.order[np.minimum(np.searchsorted(self.keys, self._key(length, head, tail)), len(self.keys) - 1)]
        return np.where((self.length[at] == length) & (self.head[at] == head) & (self.tail[at] == tail), at, -1)


def _documents(column: pa.Array, vocabulary: Vocabulary):
    """(first document, words before each document, number of each word) of runs of documents."""
    for at, data, off in K.chunks(column):
        data = _LOWER[data]
        starts, ends, first = K.word_bounds(data, off, _APART)
        yield at, first, vocabulary.look_up(data, starts, ends)


def _present(first: np.ndarray, numbers: np.ndarray, size: int) -> np.ndarray:
    """bool [documents, size]: which words a document holds."""
    held, hit = np.zeros((len(first) - 1, size), bool), np.flatnonzero(numbers >= 0)
    held[np.searchsorted(first, hit, side="right") - 1, numbers[hit]] = True
    return held


def frequencies(docs: DataFrame, notices=NOTICES) -> dict[str, int]:
    """In how many documents each notice word occurs: a count a partition and word, summed."""

    def count(batches):
        vocabulary = Vocabulary(notices)
        total = np.zeros(len(vocabulary.words), np.int64)
        for b in batches:
            for _, first, numbers in _documents(b.column(0), vocabulary):
                total += _present(first, numbers, len(total)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary.words, pa.string()), pa.array(total)], names=["word", "n"])

    found = text_column(docs).select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {w: 0 for w in Vocabulary(notices).words} | {r.word: r.n for r in found.collect()}  # a row a notice word


class Index:
    """Postings of notices, their words ranked by rarity."""

    def __init__(self, notices, frequency: dict[str, int]):
        self.notices, self.vocabulary = notices, Vocabulary(notices)
        order = sorted(range(len(self.vocabulary.words)), key=lambda i: (frequency[self.vocabulary.words[i]], self.vocabulary.words[i]))
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.words = [self.vocabulary.numbers(n.words) for n in notices]
        self.postings = [{int(w): np.flatnonzero(words == w) for w in np.unique(words)} for words in self.words]
        self.phrases = [[self.vocabulary.numbers(p) for p in n.phrases] for n in notices]
        self.needs = np.zeros((len(notices), len(order)), bool)
        for i, phrases in enumerate(self.phrases):
            self.needs[i, np.concatenate(phrases)] = True

    def candidates(self, held: np.ndarray) -> list[list[int]]:
        """For each document the notices of whose mandatory phrases it holds all words."""
        lacks = (~held).astype(np.float32) @ self.needs.T.astype(np.float32) > 0
        return [np.flatnonzero(~row).tolist() for row in lacks]

    def places(self, numbers: np.ndarray, held: np.ndarray, notice: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the notice begins in a document, and the share of its words in place there."""
        words, postings = self.words[notice], self.postings[notice]
        keys = sorted((w for w in postings if held[w]), key=lambda w: self.rank[w])[:RAREST]
        found = [np.unique(np.flatnonzero(numbers == w)[:, None] - postings[w]) for w in keys]
        starts, agree = np.unique(np.concatenate(found), return_counts=True)
        starts = starts[2 * agree >= len(keys)]
        share = np.zeros(len(starts))
        for q, w in enumerate(words):
            at = starts + q
            inside = (at >= 0) & (at < len(numbers))
            share[inside] += numbers[at[inside]] == w
        share /= len(words)
        good = share >= (1.0 if self.notices[notice].base else SHARE)
        starts, share = starts[good], share[good]
        for phrase in self.phrases[notice]:
            begins = np.flatnonzero(numbers == phrase[0])
            begins = begins[begins + len(phrase) <= len(numbers)]
            for k, w in enumerate(phrase[1:], 1):
                begins = begins[numbers[begins + k] == w]
            slack = 0 if self.notices[notice].base else SLACK
            nearest = np.searchsorted(begins, starts - slack)
            stands = nearest < len(begins)
            stands[stands] = begins[nearest[stands]] + len(phrase) <= starts[stands] + len(words) + slack
            starts, share = starts[stands], share[stands]
        return starts, share


def scan(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """doc_id, n_words, places: array of (label, start, words, share, base), in order of start and notice.

    Null texts are empty; empty texts have no word and no place. Texts of any length are read whole. Repeated rows and rows without an id are scanned like any other; an
    empty table gives an empty result. Other columns are not read. Notices may overlap and are all reported.
    """
    given = docs.sparkSession.sparkContext.broadcast((notices, frequencies(docs, notices)))
    place = pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int32()), ("share", pa.float64()), ("base", pa.bool_())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(place))])

    def run(batches):
        index = Index(*given.value)
        size = len(index.rank)
        for b in batches:
            for at, first, numbers in _documents(b.column(1), index.vocabulary):
                held = _present(first, numbers, size)
                out = []
                for d, notices in enumerate(index.candidates(held)):
                    own, found = numbers[first[d] : first[d + 1]], []
                    for i in notices:
                        n = index.notices[i]
                        found += [(int(s), i, n.label, len(index.words[i]), float(f), n.base) for s, f in zip(*index.places(own, held[d], i), strict=True)]
                    out.append([{"label": label, "start": s, "words": k, "share": f, "base": base} for s, _, label, k, f, base in sorted(found)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(out)), pa.array(np.diff(first)), pa.array(out, schema.field(2).type)], schema=schema)

    return text_column(docs).mapInArrow(run, "doc_id long, n_words long, places array<struct<label:string,start:long,words:int,share:double,base:boolean>>")
