"""The registered queries: each applies its operator to its whole table and derives the asked columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import collisions, dartminhash, langid, licenses, mixing, nndescent, pii, prefix_trie, rans, spm, suffixes, toxicity, whitening
from tessera.llm.common import new_path, small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


def op1_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    rans.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return rans.read_tokens(spark, path)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken", "copies")


OP2_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 15) AS BIGINT) AS ord
  FROM documents),
cells AS (SELECT source, size, count(*) AS n FROM sized GROUP BY ALL),
src AS (SELECT source, CAST(sum(size * n) AS BIGINT) AS source_size, sum(n) AS docs FROM cells GROUP BY source),
weighted AS (
  SELECT *, CAST([5, 2, 1][1 + CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS INT)] AS DOUBLE) AS weight,
         2.0::DOUBLE * source_size AS stop, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM src),
levels AS (
  SELECT *, stop / weight AS ratio,
         coalesce(sum(stop) OVER (ORDER BY stop / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
         sum(weight) OVER (ORDER BY stop / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM weighted),
theta AS (SELECT arg_min((total - stopped) / open_weight, ratio) FILTER ((total - stopped) / open_weight <= ratio) AS level FROM levels),
targets AS (
  SELECT source, source_size, CAST(source_size AS DOUBLE) / docs AS scale,
         CASE WHEN level IS NULL OR level * weight >= stop THEN stop ELSE level * weight END AS target FROM weighted, theta),
-- the multiplier of each source by halving: the words of rates exp(lambda * size / scale), 2 at most, grow with it
solve(step, source, lo, hi) AS (
  SELECT 0, source, -1e6::DOUBLE, 1e6::DOUBLE FROM targets WHERE target > 0 AND target < 2 * source_size * (1 - 1e-12)
  UNION ALL
  SELECT step + 1, s.source,
         CASE WHEN sum(n * size * least(2, exp(least(1, (lo + hi) / 2 * size / scale)))) < target THEN (lo + hi) / 2 ELSE lo END,
         CASE WHEN sum(n * size * least(2, exp(least(1, (lo + hi) / 2 * size / scale)))) < target THEN hi ELSE (lo + hi) / 2 END
  FROM solve s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source JOIN cells c ON c.source IS NOT DISTINCT FROM t.source
  WHERE step < 110 GROUP BY step, s.source, lo, hi, target),
multiplier AS (SELECT source, (lo + hi) / 2 AS lam FROM solve WHERE step = 110),
tilted AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN target <= 0 THEN 0 WHEN lam IS NULL THEN 2 ELSE least(2, exp(least(1, lam * size / scale))) END AS raw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN multiplier m ON m.source IS NOT DISTINCT FROM s.source),
rated AS (SELECT *, CASE WHEN abs(raw - round(raw)) < 1e-9 THEN round(raw) ELSE raw END AS rate FROM tilted),
turned AS (
  SELECT *, floor(rate) AS base, CASE WHEN rate > floor(rate) THEN (ord + 0.5::DOUBLE) / 1152921504606846976.0::DOUBLE / (rate - floor(rate)) END AS turn FROM rated),
needed AS (SELECT source, any_value(target) - sum(base * size) AS need FROM turned GROUP BY source),
steps AS (SELECT source, turn, sum(size) AS size FROM turned WHERE turn IS NOT NULL GROUP BY ALL),
running AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY turn) AS upto FROM steps),
passing AS (
  SELECT r.source, min(turn) AS factor, arg_min(upto - need < need - upto + size, turn) AS closed
  FROM running r JOIN needed n ON r.source IS NOT DISTINCT FROM n.source WHERE upto > need GROUP BY r.source),
counted AS (
  SELECT t.*, CAST(base + CASE WHEN turn IS NULL THEN 0 WHEN factor IS NULL OR turn < factor OR (turn = factor AND closed) THEN 1 ELSE 0 END AS BIGINT) AS copies
  FROM turned t LEFT JOIN passing p ON t.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, round(target, 4) AS target, CAST(copies * size AS BIGINT) AS taken, copies FROM counted
"""


def op3_nndescent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = lambda c: remainder(c, 5) == 0
    model = langid.fit(docs, held_out=held)
    out = langid.predict(docs, model)
    return out.select("doc_id", held(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = lambda c: remainder(c, 3) == 1
    out = toxicity.score(docs, toxicity.fit(docs, labels, held_out=held))
    return out.select("doc_id", held(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.base)
    rank = lambda s: F.array_position(F.array(*map(F.lit, pii.KINDS)), s.kind)
    ordered = F.transform(F.array_sort(F.transform("spans", lambda s: F.struct(rank(s).alias("r"), s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")))
    count = lambda kind: F.size(F.filter(base, lambda s: s.kind == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(ordered).alias("spans"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), window=35, digest=True)


def op9_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return collisions.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p.base)
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p.label))), ",")
    starts = F.transform(base, lambda p: p.start)
    score = F.coalesce(F.array_max(F.transform("places", lambda p: p.share)), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), score.alias("score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_rans, op2_mixing, op3_nndescent, op4_language, op5_toxicity, op6_dartminhash, op7_pii, op8_suffixes, op9_collisions, op10_sentencepiece, op11_whitening, op12_prefix_trie, op13_licenses)}


_CLOSURE = """
pairs2 AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
walk(id, goal) AS (SELECT x, y FROM pairs2 UNION SELECT w.id, b.y FROM walk w JOIN pairs2 b ON w.goal = b.x)
"""

OP3_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
{_CLOSURE},
deg AS (SELECT x AS id, count(*) AS n FROM pairs2 GROUP BY x), comp AS (SELECT id, least(id, min(goal)) AS c FROM walk GROUP BY id)
SELECT vec_id, CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN deg ON deg.id = vec_id LEFT JOIN comp ON comp.id = vec_id
"""

OP6_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
place AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0),
sh AS (SELECT doc_id, array_to_string(ws[i:i+4], ' ') AS s, count(*) AS n FROM place GROUP BY ALL),
tot AS (SELECT doc_id, sum(n) AS t FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN tot a ON a.doc_id = x JOIN tot b ON b.doc_id = y WHERE m >= 0.8 * (a.t + b.t - m)),
{_CLOSURE},
comp AS (SELECT id, least(id, min(goal)) AS c FROM walk GROUP BY id)
SELECT doc_id, coalesce(c, doc_id) AS class_id, coalesce(c, doc_id) = doc_id AS kept FROM documents LEFT JOIN comp ON id = doc_id
"""

OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
place AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+34], ' ') AS s FROM place),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT doc_id, i, unnest(range(0, 35)) AS k FROM win JOIN rep USING (s)),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hit),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(cut.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id LEFT JOIN cut ON cut.doc_id = w.doc_id
"""


OP12_SQL = r"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
names AS (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM own),
-- crc32, bit by bit
convs AS (
  SELECT c, c - c % 5 AS first,
         xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(s) + 1), lambda i: CAST(unicode(s[i]) AS BIGINT))),
             lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) % 9 AS h
  FROM names),
parts AS (
  SELECT c, 0 AS part, p, id, text FROM convs JOIN own ON own.conv_id = first AND p < h
  UNION ALL SELECT c, 1, p, id, text FROM convs JOIN own ON own.conv_id = c AND p >= h),
seq AS (SELECT c, row_number() OVER w AS d, strlen(text) AS bytes, list(id) OVER (w ROWS UNBOUNDED PRECEDING) AS path FROM parts WINDOW w AS (PARTITION BY c ORDER BY part, p)),
steps AS (SELECT c, d, bytes, path FROM seq UNION ALL SELECT c, 0, 0, CAST([] AS VARCHAR[]) FROM convs),
ends AS (SELECT c, max(d) AS last FROM steps GROUP BY c),
node AS (
  SELECT d, path, any_value(bytes) AS bytes, min(c) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = last), '')) AS ends_sha256
  FROM steps JOIN ends USING (c) GROUP BY d, path),
child AS (SELECT d - 1 AS d, path[1:d-1] AS path, count(*) AS kids FROM node WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN child USING (d, path)),
below AS (SELECT d, path, unnest(range(0, d + 1)) AS top, kids, (n - 1) * bytes AS saved FROM full_),
total AS (SELECT top AS d, path[1:top] AS path, count(*) FILTER (kids = 0) AS leaves, sum(saved) AS saved FROM below GROUP BY ALL)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, b.conv_id AS parent_conv_id, CAST(a.n AS BIGINT) AS n_convs, CAST(a.kids AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, a.ends_sha256
FROM full_ a JOIN total USING (d, path) LEFT JOIN node b ON b.d = a.d - 1 AND b.path = a.path[1:a.d-1]
"""


def _values(rows) -> str:
    text = lambda v: "'" + v + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


OP13_SQL = rf"""
WITH notice(i, label, words, base) AS (VALUES {_values((i, n.label, n.words, n.base) for i, n in enumerate(licenses.NOTICES))}),
phrase(i, j, words) AS (VALUES {_values((i, j, p) for i, n in enumerate(licenses.NOTICES) for j, p in enumerate(n.phrases))}),
nw AS (SELECT i, unnest(string_split(words, ' ')) AS x, unnest(range(0, len(string_split(words, ' ')))) AS q FROM notice),
pw AS (SELECT i, j, len(string_split(words, ' ')) AS n, unnest(string_split(words, ' ')) AS x, unnest(range(0, len(string_split(words, ' ')))) AS q FROM phrase),
doc AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
word AS (SELECT row, x, p FROM (SELECT row, unnest(ws) AS x, unnest(range(0, len(ws))) AS p FROM doc) WHERE x IN (SELECT x FROM nw UNION SELECT x FROM pw)),
df AS (SELECT x, count(DISTINCT row) AS n FROM word GROUP BY x),
stands AS (SELECT row, i, j, n, p - q AS s FROM word JOIN pw USING (x) GROUP BY row, i, j, n, p - q HAVING count(*) = n),
-- the rarest words of a notice that a file holds, and where their places agree
held AS (SELECT DISTINCT row, i, x FROM word JOIN nw USING (x) WHERE (row, i) IN (SELECT (row, i) FROM stands)),
key_ AS (SELECT row, i, x FROM held JOIN df USING (x) QUALIFY row_number() OVER (PARTITION BY row, i ORDER BY n, encode(x)) <= {licenses.RAREST}),
many AS (SELECT row, i, count(*) AS n FROM key_ GROUP BY row, i),
agree AS (SELECT k.row, k.i, p - q AS s, count(DISTINCT x) AS c FROM key_ k JOIN word w USING (row, x) JOIN nw USING (i, x) GROUP BY k.row, k.i, p - q),
share AS (
  SELECT a.row, a.i, a.s, any_value(base) AS base, any_value(label) AS label, any_value(len(string_split(words, ' '))) AS len,
         CAST(count(w.x) AS DOUBLE) / any_value(len(string_split(words, ' '))) AS f
  FROM agree a JOIN many m ON m.row = a.row AND m.i = a.i AND 2 * c >= m.n JOIN notice ON notice.i = a.i
  JOIN nw ON nw.i = a.i LEFT JOIN word w ON w.row = a.row AND w.p = a.s + nw.q AND w.x = nw.x GROUP BY a.row, a.i, a.s),
good AS (SELECT * FROM share WHERE f >= CASE WHEN base THEN 1 ELSE {licenses.SHARE} END),
place AS (
  SELECT g.row, g.i, g.s, any_value(base) AS base, any_value(label) AS label, any_value(f) AS f
  FROM good g JOIN stands t ON t.row = g.row AND t.i = g.i AND t.s >= g.s - CASE WHEN base THEN 0 ELSE {licenses.SLACK} END AND t.s + t.n <= g.s + g.len + CASE WHEN base THEN 0 ELSE {licenses.SLACK} END
  GROUP BY g.row, g.i, g.s HAVING count(DISTINCT j) = (SELECT count(*) FROM phrase WHERE phrase.i = g.i)),
found AS (
  SELECT row, count(*) FILTER (base) AS n, min(s) FILTER (base) AS lo, max(s) FILTER (base) AS hi, max(f) AS f,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY row)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(f, 0)::DOUBLE AS score
FROM doc LEFT JOIN found USING (row)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2_SQL, "op3_nndescent": OP3_SQL, "op6_dartminhash": OP6_SQL, "op8_suffixes": OP8_SQL, "op12_prefix_trie": OP12_SQL, "op13_licenses": OP13_SQL}
