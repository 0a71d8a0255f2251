"""Reports over call and cache logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clausemill.functions.coding_base import literal_map
from clausemill.session import cut_lineage

SECOND = 1_000_000
# Prices per 1000 tokens, looked up by exact name, then by first contained name.
PRICES = {"gpt-4": (0.03, 0.06), "gpt-3.5-turbo": (0.0015, 0.002), "moonshot": (0.012, 0.012)}
DEFAULT_PRICE = (0.01, 0.03)
LIMITS = {"second": 200, "minute": 2000}


def rolling_rate(log: DataFrame, key: str, ts: str, spans: dict[str, int], chunk: int = 3600 * SECOND) -> DataFrame:
    """Calls of the key in the trailing spans (microseconds, both ends included) at each call.

    The time line of a key is cut into chunks, and each chunk also gets the rows of
    the longest span before it, so a busy key is many tasks' work. A span's calls are the
    difference of two running counts, up to the call and to the span's begin, so a chunk
    costs one sort however many calls a span holds.
    """
    longest = max(spans.values())
    if chunk < longest:
        raise ValueError("a chunk must be at least as long as the longest span")
    at = F.col("_ts")
    own = F.floor(at / chunk)
    times = log.filter(F.col(ts).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(ts).alias("_ts")).agg(F.count(F.lit(1)).alias("_n"))
    # Per time: its calls, in its chunk and the next if a span there may reach back to it, and a mark at the begin of each span.
    calls = F.when(at >= (own + 1) * chunk - longest, F.array(own, own + 1)).otherwise(F.array(own))
    marks = [F.struct(own.alias("chunk"), (at - span).alias("at"), F.lit(i).alias("mark"), F.lit(0).cast("long").alias("n")) for i, span in enumerate(spans.values())]
    seen = F.transform(calls, lambda c: F.struct(c.alias("chunk"), at.alias("at"), F.lit(len(spans)).alias("mark"), F.col("_n").alias("n")))
    points = times.select("_key", "_ts", own.alias("_own"), F.inline(F.concat(F.array(*marks), seen)))
    # Marks come before the calls of their time, as a span holds its begin.
    upto = F.sum("n").over(Window.partitionBy("_key", "chunk").orderBy("at", "mark").rowsBetween(Window.unboundedPreceding, 0))
    mine = points.withColumn("_upto", upto).filter("chunk = _own")
    counts = mine.groupBy("_key", "chunk", "_ts").agg(*[F.max(F.when(F.col("mark") == i, F.col("_upto"))).alias(f"_{i}") for i in range(len(spans) + 1)])
    rates = counts.select("_key", "_ts", *[(F.col(f"_{len(spans)}") - F.col(f"_{i}")).alias(name) for i, name in enumerate(spans)])
    return log.join(rates, F.col(key).eqNullSafe(F.col("_key")) & (F.col(ts) == F.col("_ts"))).drop("_key", "_ts")


def breaches(rates: DataFrame, limits: dict[str, int]) -> DataFrame:
    test = F.lit(False)
    for name, limit in limits.items():
        test = test | (F.col(name) > limit)
    return rates.filter(test)


def price(model: Column, side: int, prices: dict = PRICES, default: tuple = DEFAULT_PRICE) -> Column:
    name = F.lower(model)
    exact = F.try_element_at(literal_map({k: str(v[side]) for k, v in prices.items()}), name).cast("double")
    contained = F.coalesce(*[F.when(F.contains(name, F.lit(k)), F.lit(v[side])) for k, v in prices.items()])
    return F.coalesce(exact, contained, F.lit(default[side]))


def call_cost(log: DataFrame, model: str, prices: dict = PRICES, default: tuple = DEFAULT_PRICE) -> DataFrame:
    asked = F.coalesce("prompt_tokens", F.lit(0)) / 1000.0 * price(F.col(model), 0, prices, default)
    told = F.coalesce("completion_tokens", F.lit(0)) / 1000.0 * price(F.col(model), 1, prices, default)
    return log.withColumns({"input_cost": asked, "output_cost": told, "total_cost": asked + told})


def exact_quantiles(rows: DataFrame, group: str, value: str, shares: dict[str, float], bins: int = 128) -> DataFrame:
    """``(group, <name>..)``: for each share the smallest value that at least that part of the group's values don't exceed.

    Each round cuts the values between the bounds of every asked rank at a sketch's quantiles, counts
    the bins, keeps the one of the rank, and takes the least and greatest value there as new bounds,
    until they are equal. The sketch only places the cuts; the lower bound is a cut of its own, so
    every round narrows. A task sends on only its sketch and its counts. Null values and NaN are left
    out; a group without others has nulls.
    """
    values = rows.select(F.struct(F.col(group).alias("g")).alias("_group"), F.col(value).cast("double").alias("_v"))
    known = values.filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    key, n = ["_group", "_name"], F.col("_n")
    names = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(p)).alias("p")) for k, p in shares.items()])).alias("_s")
    bounds = F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    rank = F.greatest(F.lit(1).cast("long"), n - F.floor(n - F.col("_s.p") * n))
    asked = known.groupBy("_group").agg(*bounds).select("*", names).select("_group", F.col("_s.name").alias("_name"), rank.alias("_rank"), "_lo", "_hi")
    asked = cut_lineage(asked)
    grid = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    while not asked.filter("_lo < _hi").isEmpty():
        met = known.join(asked.filter("_lo < _hi"), "_group").filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        cuts = met.groupBy(*key).agg(F.array_append(F.percentile_approx("_v", grid, F.lit(8 * bins)), F.min("_lo")).alias("_cuts"))
        place = F.size(F.filter(F.array_distinct("_cuts"), lambda c: c < F.col("_v")))
        counted = met.join(cuts, key).groupBy(*key, "_rank", place.alias("_bin")).agg(*bounds)
        upto = F.sum("_n").over(Window.partitionBy(*key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
        found = counted.withColumn("_upto", upto).filter((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - n))
        closer = found.select(*key, (F.col("_rank") - F.col("_upto") + n).alias("_rank"), "_lo", "_hi")
        asked = cut_lineage(asked.filter("_lo >= _hi").unionByName(closer))
    wide = asked.groupBy("_group").agg(*[F.max(F.when(F.col("_name") == k, F.col("_lo"))).alias(k) for k in shares])
    return values.select("_group").distinct().join(wide, "_group", "left").select(F.col("_group.g").alias(group), *shares)


def latency_report(log: DataFrame, model: str, latency: str, slow: float = 120.0) -> DataFrame:
    """Calls, slow calls, and exact quantiles per model."""
    counted = log.groupBy(F.col(model).alias("_m")).agg(F.count("*").alias("n"), F.sum((F.col(latency) > slow).cast("int")).alias("n_slow"))
    quantiles = exact_quantiles(log, model, latency, {"p50": 0.5, "p95": 0.95})
    return counted.join(quantiles, F.col("_m").eqNullSafe(F.col(model))).select(model, "n", "n_slow", "p50", "p95")


def recall_report(arms: DataFrame, fused: DataFrame) -> DataFrame:
    """Hits per query and arm, distinct chunks after fusion, and how many were found more than once."""
    per_arm = arms.groupBy("query_id").agg(
        *[F.sum((F.col("arm") == a).cast("int")).alias(a) for a in ("vector", "bm25", "string_match")], F.count("*").alias("n_hits")
    )
    merged = fused.groupBy("query_id").agg(F.count("*").alias("n_chunks"), F.sum((F.size("sources") > 1).cast("int")).alias("n_shared"))
    return per_arm.join(merged, "query_id").withColumn("n_dropped", F.col("n_hits") - F.col("n_chunks"))


def cache_report(answers: DataFrame, plan: str, cached: Column) -> DataFrame:
    return answers.groupBy(plan).agg(
        F.sum(cached.cast("int")).alias("hits"), F.sum((~cached).cast("int")).alias("misses")
    )
