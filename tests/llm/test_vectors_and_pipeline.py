"""Vector operators and the pipeline against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collisions, nndescent, queries

pytest.importorskip("public_tokenizers")
BAD = [(900, None), (901, [0.0] * 8), (902, [1.0] * 7 + [None]), (903, [float("nan")] * 8), (904, [float("inf")] + [0.0] * 7), (905, [1.0] * 3)]


def vectors(spark, seed=0, n=400):
    """Groups of near copies, exact copies, scaled copies, loners and unusable rows."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8))
    x[100:160] = x[0] + 0.05 * rng.normal(size=(60, 8))
    x[160:200] = x[1]
    x[200] = 3 * x[2]
    rows = [(i, list(map(float, v)), 0, "x") for i, v in enumerate(x)] + [(i, v, 0, "y") for i, v in BAD]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, block string"), x


def test_links_are_those_of_brute_force(spark):
    d, x = vectors(spark)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    got = {r.vec_id: r for r in nndescent.near_duplicates(d).collect()}
    assert len(got) == len(x) + len(BAD)
    assert [got[i].n_links for i in range(len(x))] == link.sum(axis=1).tolist()
    comp = np.arange(len(x))
    while True:
        new = np.minimum(comp, np.where(link, comp[None, :], len(x)).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    assert [got[i].component_id for i in range(len(x))] == comp.tolist()
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i, _ in BAD)
    assert nndescent.near_duplicates(d.limit(0)).count() == 0


def brute_links(x, threshold=0.95):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= threshold
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    while True:
        new = np.minimum(comp, np.where(link, comp[None, :], len(x)).min(axis=1))
        if (new == comp).all():
            return link.sum(axis=1).tolist(), comp.tolist()
        comp = new


@pytest.mark.parametrize("side", [nndescent.SIDE, 7])
def test_dense_groups_of_all_widths(spark, monkeypatch, side):
    """Groups whose pairs all link, partly link, or link in chains; ids in no order; groups near each other."""
    monkeypatch.setattr(nndescent, "SIDE", side)
    rng = np.random.default_rng(11)
    centre = rng.normal(size=(6, 16))
    centre[1] = centre[0] + 0.3 * rng.normal(size=16)
    x = np.concatenate([centre[i] + w * rng.normal(size=(n, 16)) for i, w, n in ((0, 0.05, 150), (1, 0.1, 80), (2, 0.2, 60), (3, 0.28, 60), (4, 0.0, 40), (5, 1.0, 60))])
    t = np.linspace(0, 2, 40)[:, None]  # a chain along a circle
    x = np.concatenate((x, np.cos(t) * centre[2] / np.linalg.norm(centre[2]) + np.sin(t) * centre[3] / np.linalg.norm(centre[3])))
    x = x[rng.permutation(len(x))]
    n, comp = brute_links(x)
    d = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in nndescent.near_duplicates(d).collect()}
    assert [got[i].n_links for i in range(len(x))] == n and [got[i].component_id for i in range(len(x))] == comp
    assert max(n) > 150 and len(set(n)) > 20


def test_search_and_its_audit_without_the_exact_comparison(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "_all_pairs", None)
    d, x = vectors(spark, seed=4)
    got = {r.vec_id: r.n_links for r in nndescent.near_duplicates(d).collect()}
    assert [got[i] for i in range(len(x))] == brute_links(x)[0]


def test_links_of_odd_rows(spark):
    """Repeated rows and null ids, rows of one id that differ (all are compared), a similarity of exactly the threshold, copies that are scaled."""
    e = lambda *v: [*map(float, v), *[0.0] * (4 - len(v))]
    rows = [(1, e(1)), (1, e(1)), (2, e(0.5, 0.75**0.5)), (3, e(0, 0, 1)), (4, e(0, 0, 5)), (None, e(1)), (7, e(0, 0, 0, 1)), (7, e(0, 1))]
    got = nndescent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), threshold=0.5).collect()
    found = {}
    for r in got:
        found.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert len(got) == len(rows) and found[None] == [(0, None, True)]
    assert found[1] == [(1, 1, True)] * 2 and found[2] == [(2, 1, False)] and found[3] == [(1, 3, True)] and found[4] == [(1, 3, False)] and sorted(found[7]) == [(0, 7, True), (1, 1, False)]
    plain = nndescent.near_duplicates(spark.createDataFrame(rows[:6], "vec_id long, embedding array<double>"), threshold=0.5).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in plain} == {(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (None, 0, None)}


@pytest.mark.parametrize("n", [300, 1500])
def test_a_shell_whose_members_are_equally_far_from_each_other(spark, monkeypatch, n):
    """No member is near enough to the others to vouch for them: one loose cluster, whose links are counted in blocks."""
    monkeypatch.setattr(nndescent, "INSIDE", 200)
    rng = np.random.default_rng(9)
    base = rng.normal(size=64)
    x = np.concatenate((base / np.linalg.norm(base) + 0.16 / 8 * rng.normal(size=(n, 64)), rng.normal(size=(200, 64))))
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    rows = []
    one = nndescent.links
    monkeypatch.setattr(nndescent, "links", lambda units, *a, **b: rows.append(units.count()) or one(units, *a, **b))
    got = {r.vec_id: (r.n_links, r.component_id) for r in nndescent.near_duplicates(frame).collect()}
    links, comp = brute_links(x)
    assert [got[i] for i in range(len(x))] == list(zip(links, comp, strict=True)) and max(links) > 0.9 * n
    assert rows[0] < 200 + 0.1 * n


def test_few_links_are_not_taken_on_trust(spark, monkeypatch):
    """Where an audit finds too few links to know its recall, all pairs are compared."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(3000, 16))
    x[1] = x[0] + 1e-3
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    monkeypatch.setattr(nndescent, "AUDIT_MOST", 200)
    compared = []
    every = nndescent._all_pairs
    monkeypatch.setattr(nndescent, "_all_pairs", lambda *a: compared.append(1) or every(*a))
    got = {r.vec_id: r.n_links for r in nndescent.near_duplicates(frame, sample=100).collect()}
    assert compared and [got[i] for i in range(len(x))] == brute_links(x)[0]


def test_rare_links_of_single_pairs_are_found(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[3800:] = x[:200] + 0.3 * x[3800:]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    assert 100 < link.sum() / 2 <= 200
    d = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in nndescent.near_duplicates(d).collect()}
    assert [got[i] for i in range(len(x))] == link.sum(axis=1).tolist()


def test_search_is_near_brute_force(spark, data):
    d, x = vectors(spark)
    for t, v, ids in ((d, x, np.arange(len(x))), (spark.read.parquet(f"{data}/embeddings.parquet"), None, None)):
        if v is None:
            p = t.toPandas()
            v, ids = np.stack(p.embedding).astype(float), p.vec_id.to_numpy()
        got = {}
        for r in collisions.nearest(t, t.where("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        hit = 0
        for q in ids[ids % 20 == 0]:
            s = v @ v[ids == q][0]
            order = [i for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != q][:20]
            hit += len({ids[i] for i in order} & {i for i, _ in got[q]})
            assert all(abs(sc - s[ids == i][0]) < 1e-9 for i, sc in got[q])
            assert [sc for _, sc in got[q]] == sorted((sc for _, sc in got[q]), reverse=True)
        assert hit / 20 / (ids % 20 == 0).sum() >= 0.95


def test_search_of_few_and_none(spark):
    d, _ = vectors(spark)
    few = d.where("vec_id < 5 or vec_id >= 900")
    got = collisions.nearest(few, few, k=20)
    assert got.count() == 5 * 4 and got.where("query_id = vec_id").count() == 0
    assert collisions.nearest(d.limit(0), d, k=5).count() == 0 and collisions.nearest(d, d.limit(0), k=5).count() == 0


def test_search_in_many_ranges(spark, monkeypatch):
    """Several ranges, split where they are crowded, and sides: recall against brute force, and the same result however the rows are dealt."""
    for name, value in (("BLOCK_ROWS", 300), ("QUERY_ROWS", 40), ("SAMPLE", 200)):
        monkeypatch.setattr(collisions, name, value)
    rng = np.random.default_rng(21)
    x = np.concatenate((rng.normal(size=(1500, 16)) * rng.uniform(0.2, 3, (1500, 1)), np.ones((600, 16)) + 0.01 * rng.normal(size=(600, 16))))
    d = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    first = None
    for parts in (3, 5):
        got = collisions.nearest(d.repartition(parts), d.where("vec_id % 20 = 0"), k=20).collect()
        first = first or sorted(map(tuple, got))
        assert sorted(map(tuple, got)) == first
    hit = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        want = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:20]
        hit += len(set(want) & {r[2] for r in first if r[0] == q})
    assert hit / 20 / len(range(0, len(x), 20)) >= 0.95


def test_search_falls_back_to_all_vectors(spark):
    d, x = vectors(spark, seed=7)
    got = collisions.nearest(d, d.where("vec_id % 20 = 0"), k=5, slack=-9.0, recall=1.0).collect()
    for q in range(0, len(x), 20):
        s = np.round(x @ x[q], 9)
        want = [s[i] for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:5]
        assert [round(r.score, 9) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == pytest.approx(want)


def test_search_with_a_useless_line_is_exact_in_the_end(spark, monkeypatch):
    """Windows so narrow that queries miss the ranges of their neighbours: the audit is short every time, and all vectors are compared."""
    monkeypatch.setattr(collisions, "WIDE", 0.0)
    monkeypatch.setattr(collisions, "BLOCK_ROWS", 40)
    d, x = vectors(spark, seed=6)
    got = {}
    for r in collisions.nearest(d, d.where("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.score)
    for q in range(0, len(x), 20):
        s = np.delete(x @ x[q], q)
        assert np.allclose(got[q], np.sort(s)[::-1][:20])


def test_search_of_odd_rows(spark):
    """Ties, repeated ids on either side, null ids, queries of other lengths than the vectors."""
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (None, [9.0, 9.0]), (5, [3.0]), (6, [0.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (7, [1.0, 1.0, 1.0]), (8, [1.0, 1.0, 1.0]), (9, [5.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, collisions.nearest(d, ask, k=3).collect()))
    assert got == [(1, 1, 4, 1.0), (1, 2, 2, 0.0), (1, 3, 3, 0.0), (9, 1, 2, 10.0), (9, 2, 3, 10.0), (9, 3, 3, 10.0)]


def test_pipeline_against_brute_force(spark, data):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import public_tokenizers
    import sentencepiece

    from tessera.llm import langid, mixing, pii
    from tests.llm.test_text_operators import classes_by_brute_force

    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(docs, held_out=lambda c: queries.remainder(c, 5) == 0)
    local = docs.toPandas()
    import pyarrow as pa

    lang, _, usual = model.predict(pa.array(local.text))
    local = local[[g != "und" and u >= corpus_pipeline.LEAST_USUAL for g, u in zip(lang, usual, strict=True)]]
    assert len(local) > 0.95 * docs.count()
    classes = classes_by_brute_force(dict(zip(local.doc_id, local.text, strict=True)))
    local = local[[classes[i] == i for i in local.doc_id]]
    field = pii.train()
    texts = [pii.redact(t, [*b, *a]) for t, (b, a) in zip(local.text, pii.find_spans(pa.array(local.text), field), strict=True)]
    clean = spark.createDataFrame(list(zip(local.doc_id.tolist(), texts, local.source.tolist(), strict=True)), "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in mixing.mix_documents(clean).collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, t in zip(local.doc_id.tolist(), texts, strict=True):
        ids = lib.encode(t)
        want += [(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())] * copies[i]
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).collect())) == sorted(want)


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm.test_text_operators import ODD

    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None) for i, t in enumerate(ODD + ["plain words in a row", "plain words in a row"])]
    rows += [rows[-1], (None, "no id", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as rows_of_id", "2 as class_id", "'x' as kept", "3 as bands", "4 as size", "5 as part").withColumns({"a.b": F.lit("dot"), "c`d": F.lit(1)})
    for d in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, d, "")
            assert got.columns == docs.columns, name
            got.collect()
        corpus_pipeline.STAGES[-1][1](spark, d, "").collect()
    kept = corpus_pipeline.near_duplicates(spark, docs, "").where(F.col("text") == "plain words in a row")
    assert kept.count() == 1


def test_rows_of_one_id_with_different_texts_are_decided_each(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c = (" ".join(f"{p}{i}" for i in range(100)) for p in "abc")
    rows = [(5, a), (5, b), (5, b), (3, b + " z"), (7, c), (7, c.replace("c9 ", "")), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert [r[0] for r in got].count(None) == 2
    assert sorted(r for r in got if r[0] is not None)[:2] == [(3, b + " z"), (5, a)]
    assert [r[0] for r in got if r[0] is not None and r[0] > 5] == [7]
