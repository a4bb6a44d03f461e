"""Percentiles of a span of days from stored sketches, against whole sorted lists."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quarrywork.operators import monitoring, quantiles
from quarrywork.session import shared_path

DAYS = [datetime.date(2024, 1, d) for d in range(1, 11)]


def exclusive(values):
    xs, n = sorted(values), len(values)
    if n < 20:
        return xs[-1]
    j = max(1, min(19 * (n + 1) // 20, n - 1))
    delta = 19 * (n + 1) - j * 20
    return (xs[j - 1] * (20 - delta) + xs[j] * delta) / 20


@pytest.fixture(scope="module")
def data():
    deal = random.Random(11)
    sizes = {"one": 1, "few": 19, "twenty": 20, "some": 39, "more": 500, "hot": 30_000, None: 90}
    rows = [(deal.choice(DAYS), k, deal.lognormvariate(0, 2)) for k, n in sizes.items() for _ in range(n)]
    rows += [(deal.choice(DAYS), "tied", float(deal.randint(1, 3))) for _ in range(3000)]
    return rows + [(DAYS[4], "hot", None), (DAYS[4], "none", None), (DAYS[4], "hot", float("nan")), (DAYS[5], "top", float("inf"))]


def wanted(data, first, last):
    groups = {}
    for day, key, value in data:
        if value is not None and value == value and first <= day <= last:
            groups.setdefault(key, []).append(value)
    return {k: (len(v), pytest.approx(exclusive(v), rel=1e-12)) for k, v in groups.items()}


@pytest.mark.parametrize("size, margin", [(quantiles.SKETCH, quantiles.MARGIN), (8, 0)])
def test_span(spark, data, size, margin):
    """The small sketch without margin errs, so its keys take the exact way."""
    frame = spark.createDataFrame(data, "day date, kind string, v double")
    path = shared_path(spark, "test-values")
    frame.write.partitionBy("day").parquet(path)
    rows = spark.read.parquet(path)
    sketches = quantiles.daily_sketches(rows, "day", ["kind"], "v", size)
    for a, b in ((0, 9), (2, 5)):
        first, last = F.lit(DAYS[a]), F.lit(DAYS[b])
        found = quantiles.p95_of_span(rows, sketches, "day", ["kind"], "v", first, last, margin)
        want = wanted(data, DAYS[a], DAYS[b])
        assert {r.kind: (r.n, r.p95) for r in found.collect()} == want
        if size == 8:
            kept = quantiles.brackets(sketches, "day", ["kind"], first, last, margin).collect()
            p95 = {k: exclusive([v for d, kind, v in data if kind == k and v is not None and v == v and DAYS[a] <= d <= DAYS[b]]) for k in want}
            assert any(not r._lo <= p95[r.kind] <= r._hi for r in kept)


def test_values_below_the_bracket_are_not_read(spark, data):
    big = [r for r in data if r[1] in ("hot", "more") and r[2] is not None and r[2] == r[2]]
    path = shared_path(spark, "test-values")
    spark.createDataFrame(big, "day date, kind string, v double").write.partitionBy("day").parquet(path)
    rows = spark.read.parquet(path)
    sketches = quantiles.daily_sketches(rows, "day", ["kind"], "v")
    kept = quantiles.brackets(sketches, "day", ["kind"], F.lit(DAYS[2]), F.lit(DAYS[5]))
    inside = rows.filter(F.col("day").between(DAYS[2], DAYS[5]))
    share = inside.join(kept, "kind").filter("v >= _lo").count() / inside.count()
    assert share < 0.1


def test_empty_span(spark, data):
    rows = spark.createDataFrame(data, "day date, kind string, v double")
    sketches = quantiles.daily_sketches(rows, "day", ["kind"], "v")
    late = F.lit(datetime.date(2030, 1, 1))
    assert quantiles.p95_of_span(rows, sketches, "day", ["kind"], "v", late, late).count() == 0


def test_batch_form_has_one_rule_for_all_sizes(spark, data):
    clean = [r for r in data if r[2] is None or r[2] == r[2]]
    found = monitoring.p95_exclusive(spark.createDataFrame(clean, "day date, kind string, v double"), ["kind"], "v")
    want = {k: v for k, (_, v) in wanted(clean, DAYS[0], DAYS[-1]).items()}
    assert {r.kind: r.p95 for r in found.collect()} == want
