"""Cuts of long streams in parallel against the walk."""

import random

import pytest
from pyspark.sql import functions as F

from engramlake.operators import cuts
from engramlake.operators.steps import cut


@pytest.mark.parametrize("width,fan,count,mark", [(1, 2, None, None), (2, 2, 7, "m"), (16, 64, 5, None), (1, 3, None, "m")])
def test_cuts_of_long_streams_equal_the_walk(spark, width, fan, count, mark):
    r = random.Random(width * 10 + fan)
    rows = []
    for s, n in (("hot", 900), ("b", 40), ("c", 1), (None, 60)):
        for k in range(n):
            size = r.choice([0.0, 1.3, 2.6, 3.9, 10.1, 25.0]) if r.random() < 0.95 else r.choice([None, 60.0, 30.0])
            rows.append((s, k, size, r.choice(["x", "y", None]) if r.random() < 0.2 else "x"))
    d = spark.createDataFrame(rows, "s string, k int, size double, m string").repartition(5)
    want = cut(d, ["s"], [F.asc("k")], "size", 30.0, count, mark)
    got = cuts.cut_long(d, "s", ["k"], "size", 30.0, count, mark, width=width, fan=fan)
    key = lambda x: {(y.s, y.k): y.block for y in x.collect()}
    assert key(got) == key(want) and got.columns == want.columns
    assert cuts.cut_long(d.limit(0), "s", ["k"], "size", 30.0).count() == 0


@pytest.mark.parametrize("one,other", [("segments", "segments_long"), ("blocks_full", "blocks_long")])
def test_long_forms_of_queries_equal_the_walks(spark, one, other):
    from engramlake import queries as own

    a, b = (own.queries()[n](spark, "/root/testdata/sf0.001") for n in (one, other))
    assert sorted(a.columns) == sorted(b.columns)
    assert sorted(map(repr, map(tuple, a.select(*b.columns).collect()))) == sorted(map(repr, map(tuple, b.collect())))
