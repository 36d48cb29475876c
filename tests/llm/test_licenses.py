"""op13 against regular expressions and a plain search."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    ws = words(text)
    return sorted((i, label) for p, label in BASE.items() for k in [p.split()] for i in range(len(ws) - len(k) + 1) if ws[i : i + len(k)] == k)


def plain(texts):
    """The definition with loops: for each text, its (start, label, share, base)."""
    split = [words(t) for t in texts]
    df = {}
    for ws in split:
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    out = []
    for ws in split:
        found = []
        for n in licenses.NOTICES:
            own, slack = n.words.split(), 0 if n.base else licenses.SLACK
            keys = sorted({w for w in own if w in ws}, key=lambda w: (df[w], w))[: licenses.RAREST]
            on = {}
            for k in keys:
                for p in [i for i, w in enumerate(ws) if w == k]:
                    for q in [i for i, w in enumerate(own) if w == k]:
                        on.setdefault(p - q, set()).add(k)
            for s, agree in on.items():
                share = sum(0 <= s + q < len(ws) and ws[s + q] == w for q, w in enumerate(own)) / len(own)
                if 2 * len(agree) < len(keys) or share < (1 if n.base else licenses.SHARE):
                    continue
                near = [range(max(0, s - slack), s + len(own) + slack - len(p.split()) + 1) for p in n.phrases]
                if all(any(ws[i : i + len(p.split())] == p.split() for i in r) for p, r in zip(n.phrases, near, strict=True)):
                    found.append((s, n.label, share, n.base))
        out.append(sorted(found))
    return out


def ours(frame):
    return {r.doc_id: (r.n_words, sorted((p.start, p.label, p.share, p.base) for p in r.places)) for r in licenses.scan(frame).collect()}


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    local, got = docs.toPandas(), queries.op13_licenses(spark, data).toPandas().set_index("doc_id")
    assert len(got) == len(local)
    for r in local.itertuples():
        want, row = base(r.text), got.loc[r.doc_id]
        assert (row.n_words, row.n_base, row.base_labels) == (len(words(r.text)), len(want), ",".join(sorted({label for _, label in want})))
        if want:
            assert (row.first_word, row.last_word, row.score) == (want[0][0], want[-1][0], 1.0)
        else:
            assert np.isnan(row.first_word) and np.isnan(row.last_word)
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(",")) and 0 <= row.score <= 1
        named = "gnu general public license" in " ".join(words(r.text))
        assert ("gpl-3" in row.labels.split(",")) == named


def test_notices_and_near_notices(spark):
    """Whole, changed and cut-off notices, phrases without their notice, overlaps, repeats; and the plain search gives the same."""
    texts = [n.words for n in licenses.NOTICES] + [n.words.upper().replace(" ", " * ") + "é" for n in licenses.NOTICES]
    texts += [
        "Permission is hereby granted, free of charge, to any company obtaining a copy of this program and any files",
        "permission is hereby granted free of charge",
        "gnu general public license " + "x " * 40 + "version 3",
        "cc-by-nc cc by-NC, cc by nc/4.0; under the mit licenses; under the mit license under the MIT License",
        "under the the mit license. apache license, version 20; apache license version 2.0",
        "the of to and license is free " * 300 + "released under the mit license",
        "mit license " * 2000,
        "Redistribution and use in source and binary forms, with or without changes, are permitted if the following conditions are met:",
        "\x00under\x00the\x7fmit`license",
        "under the mit licensé",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = ours(frame)
    assert [got[i] for i in range(len(texts))] == [(len(words(t)), p) for t, p in zip(texts, plain(texts), strict=True)]
    for i, n in enumerate(licenses.NOTICES):
        assert n.label in {p[1] for p in got[i][1]}, n
    at = 2 * len(licenses.NOTICES)
    assert {p[1] for p in got[at][1]} == {"mit"} and got[at + 1][1] == [] and got[at + 2][1] == []


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \x00 "), (4, "under the mit license " + "y " * 100_000 + "cc by nc"), (None, "cc by nc"), (5, "CC BY NC"), (5, "CC BY NC")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("places", F.lit(1)).withColumn("word", F.lit("w")).withColumn("a.b", F.lit(1))
    got = licenses.scan(frame).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and sum(r.doc_id == 5 for r in got) == 2
    assert [(by[i].n_words, by[i].places) for i in (1, 2, 3)] == [(0, [])] * 3
    assert by[4].n_words == 100_007 and [(p.label, p.start) for p in by[4].places if p.base] == [("mit", 0), ("cc-by-nc", 100_004)]
    assert [p.label for p in by[None].places] == [p.label for p in by[5].places] == ["cc-by-nc"]
    assert licenses.scan(frame.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_frequencies_cover_all_documents(spark, data, parts):
    docs = spark.read.parquet(f"{data}/documents.parquet").repartition(parts)
    texts = [set(words(r.text)) for r in docs.select("text").collect()]
    got = licenses.frequencies(docs)
    assert got == {w: sum(w in t for t in texts) for w in got} and got["license"] > 0
