"""Code tables, run logs and stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clausemill.operators.matching import contains_pairs


def load_code_table(rows: DataFrame, category: str | None = None) -> DataFrame:
    """Codes that are not deleted and have a name, as strings; one category or all."""
    live = rows.filter((F.coalesce(F.col("is_deleted").cast("string"), F.lit("N")) == "N") & F.col("key_name").isNotNull())
    if category is not None:
        live = live.filter(F.col("code_category") == category)
    return live.select("code_category", F.col("key_code").cast("string").alias("key_code"), "key_name")


def latest_containing(stored: DataFrame, needles: DataFrame, needle: str) -> DataFrame:
    """For each needle the stored row ``(id, body)`` of highest id whose body contains it."""
    return (
        contains_pairs(stored.select("id", "body"), "id", "body", needles, needle)
        .groupBy(needle)
        .agg(F.max_by("body", "id").alias("body"), F.max("id").alias("id"))
    )


def append_rows(rows: DataFrame, path: str) -> None:
    """Add rows to a table of files; a task that is retried leaves no half file behind."""
    rows.write.mode("append").parquet(path)


def run_record(rows: DataFrame, created_at: Column) -> DataFrame:
    """``(input_json, prompts_json, output_json, created_at)`` of runs given as structs."""
    return rows.select(
        F.to_json("input").alias("input_json"),
        F.to_json("prompts").alias("prompts_json"),
        F.to_json("output").alias("output_json"),
        created_at.alias("created_at"),
    )


def enabled_mapping(config: DataFrame, tenants: DataFrame, tenant: str) -> DataFrame:
    """Config rows of tenants that are enabled and not deleted: one join, one row per entry."""
    live = tenants.filter((F.col("enabled") == "Y") & (F.col("is_deleted") == "N")).select(tenant)
    return config.join(live, tenant, "left_semi")


def enabled_mapping_nested(config: DataFrame, tenants: DataFrame, tenant: str, key: str, value: str) -> DataFrame:
    """The same as one map per tenant, for configurations of a tenant's own size."""
    return (
        enabled_mapping(config, tenants, tenant)
        .groupBy(tenant)
        .agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(key, value)))).alias("mapping"))
    )
