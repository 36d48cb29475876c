"""Every registered query against its SQL."""

import pytest

from tessera import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def text(v):
    return "nan" if v is None or v != v else str(float(v)) if isinstance(v, float) else str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(map(text, r)) for r in frame[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, data, name):
    ours, theirs = QUERIES[name](spark, data).toPandas(), duck.sql(SQL[name]).to_arrow_table().to_pandas()
    assert rows(ours) == rows(theirs)


def test_every_query_without_sql_is_checked_elsewhere():
    """tests/test_definitions.py holds a plain loop, or a property with a known answer, for each of them."""
    import os

    text = open(os.path.join(os.path.dirname(__file__), "test_definitions.py"), encoding="utf-8").read()
    assert [n for n in sorted(set(QUERIES) - set(SQL)) if f'"{n}"' not in text] == []


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert catalog.FLAGSHIP in e.queries()


def test_values_next_to_a_tie_round_as_in_sql(spark):
    """sync_linear, and all that rounds: neighbours of k + 1/2 millionths, where the product may be a tie and the shortest decimal none."""
    import duckdb
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    from tessera.queries.adapters import r

    ties = (np.random.default_rng(4).integers(0, 560_000_000, 3000) + 0.5) / 1e6
    v = np.concatenate([np.nextafter(ties, 0), ties, np.nextafter(ties, 1e9), -ties, -np.nextafter(ties, 0), [0.0, -0.0, 1e-9, -1e-9, 1e12, np.nan]])
    values = pa.table({"i": np.arange(len(v)), "v": v})
    want = duckdb.connect().register("values_", values).sql("SELECT round(v, 6) + 0.0 AS w FROM values_ ORDER BY i").to_arrow_table().column("w").to_numpy()
    got = spark.createDataFrame(values).select("i", r(F.col("v"), 6).alias("w")).orderBy("i").toPandas()["w"].to_numpy()
    off = [(float(a), float(b), float(c)) for a, b, c in zip(v, got, want, strict=True) if a == a and b != c]
    assert off == [] and np.isnan(got[-1])
