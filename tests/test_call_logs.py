"""Exact quantiles next to sorting."""

import math
import random

import pytest

from clausemill.operators import call_logs as O


@pytest.mark.parametrize("bins", [4, 128])
def test_exact_quantiles(spark, bins):
    rng = random.Random(9)
    groups = {
        "wide": [rng.choice([1, -1]) * 10 ** rng.uniform(-300, 300) for _ in range(300)],
        "close": [1.0 + rng.randrange(50) * 2.0**-52 for _ in range(200)],
        "ties": [5.0] * 90 + [7.0] * 10,
        "one": [3.25],
        None: [float(i) for i in range(101)],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("ties", None), ("ties", math.nan), ("none", None)]
    rng.shuffle(rows)
    shares = {"low": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "high": 1.0}
    found = O.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", shares, bins).collect()
    assert len(found) == 6
    for r in found:
        values = sorted(groups.get(r.g, []))
        want = [values[max(1, len(values) - math.floor(len(values) - p * len(values))) - 1] if values else None for p in shares.values()]
        assert [r[k] for k in shares] == want


def test_quantiles_of_nothing(spark):
    assert O.exact_quantiles(spark.createDataFrame([], "g string, v double"), "g", "v", {"p": 0.5}).collect() == []
