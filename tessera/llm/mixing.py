"""Mixing sources to target weights by entropy balancing.

Every document gets a real-valued rate r. The rates stay as near as possible to 1 in relative entropy, sum(r*log(r) - r + 1), subject to
one token constraint per source, sum(size * r) = target, and to r <= cap. The convex dual has one multiplier a constraint, and
its solution tilts documents exponentially by their size: r = min(cap, exp(lambda * size / scale)), with the source's mean size as scale.

Newton's iterations on the dual read the tilted token sums and their slopes from a distributed aggregation; documents of one source
and size have one rate, so it runs over (source, size) cells and moves no document. Sums are exact decimals, so reruns agree to the last bit.
A step that leaves the bracket known so far is replaced by its middle.

Rates are then rounded to copies: everybody gets floor(r); the rest of r is the chance of one more, taken up by a number that a hash of the
id draws. One factor a source on these chances makes the source's words meet the target as nearly as its documents allow. The factor is
found by two histograms and the rows of one of their cells, so no task orders a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, whole_row

WORD = r"[^\x20\x09-\x0D]+"
#: The table of sources is broadcast up to so many rows and joined by its key beyond.
BROADCAST_SOURCES = 100_000
#: Newton steps at most; ten or so are usual, and halving the bracket ends far below this.
STEPS = 200
EXACT = "decimal(38,6)"


def mixture_targets(sources: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources (source, source_size, ..) with target: weights by code-point order (null last), repeating; stops at cap times the size.

    What a source cannot take is shared again by weight among the others until none is above its stop. Empty sources
    get 0; with cap * (sum of sizes) below the total every source ends at its stop. One task orders the sources, not their documents.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("_weight", F.element_at(kinds, F.pmod(turn, F.lit(len(weights))) + 1)).withColumn("_stop", F.lit(float(cap)) * F.col("source_size"))
    s = s.withColumn("_ratio", F.col("_stop") / F.col("_weight"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    all_ = Window.partitionBy()
    before = F.coalesce(F.sum("_stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("_weight").over(all_) - F.coalesce(F.sum("_weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.lit(float(share)) * F.sum("source_size").over(all_) - before) / open_weight
    s = s.withColumn("_level", F.when(level <= F.col("_ratio"), F.struct("_ratio", level.alias("level"))))
    s = s.withColumn("_level", F.min("_level").over(all_)["level"])
    target = F.when(F.col("_level").isNull() | (F.col("_level") * F.col("_weight") >= F.col("_stop")), F.col("_stop")).otherwise(F.col("_level") * F.col("_weight"))
    return s.withColumn("target", target).drop("_weight", "_stop", "_ratio", "_level")


def _with_source(left: DataFrame, right: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """Joins a table of sources; a null source meets the null source."""
    right = right.withColumnRenamed("source", "_s")
    return left.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("_s")), how).drop("_s")


def _tilted(cap: float) -> Column:
    """The rate of a size under a source's multiplier; at the ends of the range it is 0 or cap."""
    r = F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.col("size") / F.col("scale")))
    r = F.when(F.abs(r - F.round(r)) < 1e-9, F.round(r)).otherwise(r)
    return F.when(F.col("target") <= 0, 0.0).when(F.col("target") >= cap * F.col("source_size") * (1 - 1e-12), float(cap)).otherwise(r)


def newton_multipliers(cells: DataFrame, sources: DataFrame, cap: float, small: bool, tol: float = 1e-9) -> DataFrame:
    """sources with lam and scale. cells: source, size, n; sources: source, source_size, docs, target.

    All sources take a step at a time; those that have converged rest. The derivative of a constraint's token sum is the sum of size^2 * r / scale
    over rates below the cap.
    """
    inner = (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12))
    state = sources.select("*", (F.col("source_size") / F.greatest("docs", F.lit(1))).cast("double").alias("scale"), F.lit(0.0).alias("lam"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), (~inner).alias("done"))
    state = cut(state)
    keys = state.columns
    for _ in range(STEPS):
        if not state.where("not done").limit(1).count():
            break
        r = F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.col("size") / F.col("scale")))
        words = F.col("n") * F.col("size") * r
        own = _with_source(cells, state.where("not done"), small).withColumn("_words", words).withColumn("_slope", F.when(r < cap, words * F.col("size") / F.col("scale")).otherwise(0.0))
        got = own.groupBy(*keys).agg(F.sum(F.col("_words").cast(EXACT)).cast("double").alias("_f"), F.sum(F.col("_slope").cast(EXACT)).cast("double").alias("_h"))
        gap, lam = F.col("target") - F.col("_f"), F.col("lam")
        lo, hi = F.when(gap > 0, lam).otherwise(F.col("lo")), F.when(gap < 0, lam).otherwise(F.col("hi"))
        reach = 2 * (F.abs(lam) + 1)
        step = F.when(F.col("_h") > 0, gap / F.col("_h")).otherwise(F.signum(gap) * reach)
        moved = lam + F.greatest(-reach, F.least(reach, step))
        middle = F.when((lo > float("-inf")) & (hi < float("inf")), (lo + hi) / 2).otherwise(lam + F.signum(gap) * reach)
        new = F.when((moved > lo) & (moved < hi), moved).otherwise(middle)
        over = (F.abs(gap) <= tol * F.col("target") + 1e-5) | (hi - lo <= 1e-14 * (1 + F.abs(lam)))
        columns = {"lam": F.when(over, lam).otherwise(new), "lo": lo, "hi": hi, "done": over}
        moved_rows = got.select(*[columns.get(k, F.col(k)).alias(k) for k in keys])
        state = cut(moved_rows.union(state.where("done")).coalesce(8))
    return state.drop("lo", "hi", "done")


def _order(doc_id: Column, seed: str) -> Column:
    """60 bits of a hash of the id."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 15), 16, 10).cast("long")


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _rounded(rows: DataFrame, cap: float) -> DataFrame:
    """rows (size, ord and the plan's columns) with rate, base and turn: the factor from which on one more copy is taken."""
    out = rows.withColumn("rate", _tilted(cap)).withColumn("base", F.floor("rate").cast("long"))
    rest = F.col("rate") - F.col("base")
    return out.withColumn("turn", F.when(rest > 0, (F.col("ord") + 0.5) / float(1 << 60) / rest))


def _copies() -> Column:
    more = (F.col("turn") < F.col("factor")) | (F.col("closed") & (F.col("turn") == F.col("factor")))
    return (F.col("base") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)).cast("long")


def mix_plan(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> tuple[DataFrame, DataFrame, bool]:
    """(sized, plan, small): doc_id, source, size, ord of every row; the table of sources with multiplier and factor; and if that may be broadcast."""
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size(F.col("text")).alias("size")).withColumn("ord", _order(F.col("doc_id"), seed)))
    cells = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n"))).coalesce(8)
    sources = cut(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs")))
    small = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    plan = newton_multipliers(cells, mixture_targets(sources, weights, share, cap), cap, small)
    base = _with_source(cells, plan, small).withColumn("_base", F.floor(_tilted(cap)) * F.col("size") * F.col("n"))
    base = base.groupBy(F.col("source").alias("_b")).agg(F.sum("_base").alias("_base"))
    plan = plan.join(F.broadcast(base) if small else base, F.col("source").eqNullSafe(F.col("_b"))).withColumn("need", F.col("target") - F.col("_base")).drop("_b", "_base")
    plan = cut(plan)
    # the first cell of a histogram in which the words taken pass what is needed, and what remains for it
    fine = F.floor(F.least(F.col("turn") * 64, F.lit(2048.0))).cast("int")
    finer = F.floor(F.least((F.col("turn") * 64 - F.col("b1")) * 4096, F.lit(4095.0))).cast("int")
    open_ = _rounded(_with_source(sized, plan, small), cap).where("turn is not null").select("source", "size", "turn", "need", fine.alias("b1"))

    def crossing(cells: DataFrame, key: str) -> DataFrame:
        run = cells.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy(key)))
        first = F.min(F.struct(key, (F.col("need") - F.col("upto") + F.col("size")).alias("rest"))).alias("c")
        return run.where(F.col("upto") > F.col("need")).groupBy("source").agg(first).select("source", F.col(f"c.{key}").alias(f"at_{key}"), F.col("c.rest").alias("rest"))

    first = crossing(open_.groupBy("source", "need", "b1").agg(F.sum("size").alias("size")), "b1")
    edge = _with_source(open_, first, small).where("b1 = at_b1").select("source", "size", "turn", F.col("rest").alias("need"), finer.alias("b2"))
    edge = cut(edge)
    second = crossing(edge.groupBy("source", "need", "b2").agg(F.sum("size").alias("size")), "b2")
    inside = _with_source(edge.drop("need"), second, small).where("b2 = at_b2").groupBy("source", "turn", "rest").agg(F.sum("size").alias("size"))
    run = inside.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("turn"))).where("upto > rest")
    # the row that passes the target is taken where that comes nearer to it
    last = run.groupBy("source").agg(F.min(F.struct(F.col("turn").alias("factor"), (F.col("upto") - F.col("rest") < F.col("rest") - F.col("upto") + F.col("size")).alias("closed"))).alias("c"))
    last = last.select("source", "c.factor", "c.closed")
    plan = _with_source(plan, last, small, "left").withColumns({"factor": F.coalesce("factor", F.lit(float("inf"))), "closed": F.coalesce("closed", F.lit(False))})
    return sized, cut(plan), small


def mix_documents(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for every row of docs.

    Null or empty texts have size 0; a null source is a source of its own, last in order; null ids share one hash.
    Repeated rows are rounded alike and each counts. An empty table gives an empty result. Very long texts have a size like any other, and other
    columns may have any names. Same rows give the same copies whatever their order or partitioning.
    """
    sized, plan, small = mix_plan(docs, weights, share, cap, seed)
    rows = _rounded(_with_source(sized, plan, small), cap).withColumn("copies", _copies())
    return rows.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, plan: DataFrame, small: bool, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """The rows of docs, each as often as the plan takes it, with docs' columns, whatever their names. No text is shuffled for a small plan."""
    own = docs.select(whole_row(docs).alias("_row"), F.col("source").cast("string").alias("source"), _size(F.col("text")).alias("size"), _order(F.col("doc_id"), seed).alias("ord"))
    copies = _rounded(_with_source(own, plan, small), cap).select("_row", _copies().cast("int").alias("copies")).where("copies > 0")
    return copies.select("_row", F.explode(F.sequence(F.lit(1), "copies"))).select("_row.*")
