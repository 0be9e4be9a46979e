"""What should be there, what is, and what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(members: DataFrame, periods: DataFrame, variables: DataFrame, *, base_url: str = "") -> DataFrame:
    """One row per expected chunk: member, period and variable with scenario, file and url.

    The scenario depends on the period, its suffix on the member's group. The
    three inputs are small catalogues; their product is the manifest itself.
    """
    out = members.join(periods).join(F.broadcast(variables))
    scenario = F.concat("scenario", F.lit("_"), "member_group")
    out = out.withColumn("file", F.format_string("%s.%s.%s.%s.%d01-%d12.parquet", F.lit("ens"), scenario, F.col("member_code"), F.col("variable"), F.col("start_year"), F.col("end_year")))
    return out.withColumn("url", F.concat_ws("/", F.lit(base_url), "component", "variable", "file"))


def missing_files(expected: DataFrame, existing: DataFrame) -> DataFrame:
    """Expected files that don't exist yet: what a re-run has to fetch."""
    return expected.join(existing.select("file"), "file", "left_anti")


def present_files(expected: DataFrame, existing: DataFrame) -> DataFrame:
    return expected.join(existing.select("file"), "file", "left_semi")


def require(expected: DataFrame, loaded: DataFrame) -> None:
    """Raise if an expected file is missing, naming some."""
    lost = [r.file for r in missing_files(expected, loaded).limit(5).collect()]
    if lost:
        raise FileNotFoundError(f"missing, among others: {lost}")


def upsert(registry: DataFrame, changes: DataFrame, key: str = "variable") -> DataFrame:
    """Registry with rows replaced or added by key."""
    return registry.join(changes.select(key), key, "left_anti").unionByName(changes)


def resolved(expected: DataFrame, existing: DataFrame) -> DataFrame:
    """Each expected file as it exists, by its name or the lower-case one; NULL if neither does."""
    e = existing.select(F.col("file").alias("__exact"))
    low = existing.select(F.col("file").alias("__low"))
    out = expected.join(e, F.col("file") == F.col("__exact"), "left").join(low, F.lower("file") == F.col("__low"), "left")
    return out.withColumn("found", F.coalesce("__exact", "__low")).drop("__exact", "__low")
