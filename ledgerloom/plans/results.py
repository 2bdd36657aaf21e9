"""From compiled rows to results: refusals, exclusions and status rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RULE, WARNING = "exclude_missing.v1", "MISSING_VALUE_EXCLUDED"


def refuse_duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows; reading them fails with RETURNED_DUPLICATE_ROW where several share a key (results are bounded, a key's rows few)."""
    n = F.count("*").over(Window.partitionBy(*keys))
    name = F.concat(F.lit("RETURNED_DUPLICATE_ROW "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
    return rows.withColumn("_n", F.when(n > 1, F.raise_error(name).cast("long")).otherwise(n)).where("_n = 1").drop("_n")


def once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key no other row has: count(*) over the key is 1."""
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")


def exclusions(rows: DataFrame, concepts: tuple[str, ...]) -> DataFrame:
    """subject_id, concept, rule_id, reason_code, warning of every value that a lookup's rows lack; a missing value is never a zero."""
    each = [rows.where(F.col(c).isNull()).select(
        F.col("entity_id").alias("subject_id"), F.lit(c).alias("concept"), F.lit(RULE).alias("rule_id"), F.coalesce(f"{c}_reason", F.upper(f"{c}_status")).alias("reason_code"), F.lit(WARNING).alias("warning")) for c in dict.fromkeys(concepts)]
    return reduce(lambda a, b: a.unionByName(b), each)


def with_status(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One status row (READY or EMPTY, with the number of rows) united with the rows: kind, n, and the columns, null in the status row."""
    status = rows.agg(F.count("*").alias("n")).select(F.when(F.col("n") > 0, "READY").otherwise("EMPTY").alias("kind"), "n", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns])
    return status.unionAll(rows.select(F.lit("ROW").alias("kind"), F.lit(None).cast("long").alias("n"), *columns))
