"""What a ledger's tables must agree on, each rule as a table of the rows that break it; empty tables pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.errors import Refused
from ..sources.ledger import sorted_by_key


def subtype_mismatches(entities: DataFrame, subtypes: dict[str, DataFrame]) -> DataFrame:
    """entity_id, subtype, entity_type: rows of a subtype's table whose entity is missing or of another type."""
    each = [t.select("entity_id", F.lit(name).alias("subtype")) for name, t in subtypes.items()]
    rows = reduce(lambda a, b: a.unionByName(b), each).join(entities.select("entity_id", "entity_type"), "entity_id", "left")
    return rows.where(~F.col("subtype").eqNullSafe(F.col("entity_type")))


def hydrate_subtypes(entities: DataFrame, subtypes: dict[str, DataFrame]) -> DataFrame:
    """Entities beside the one row that each subtype's table may have for them, its columns as subtype_column."""
    out = entities
    for name, t in subtypes.items():
        out = out.join(t.select("entity_id", *[F.col(c).alias(f"{name}_{c}") for c in t.columns if c != "entity_id"]), "entity_id", "left")
    return out


def value_kind_mismatches(observations: DataFrame, definitions: DataFrame) -> DataFrame:
    """observation_id, stored_kind, value_kind: values that are not of their metric's registered kind; without a value none is.

    definitions: metric_id, metric_definition_version, value_kind.
    """
    kinds = [(c, k) for c, k in (("numeric_value", "numeric"), ("text_value", "text"), ("boolean_value", "boolean"), ("date_value", "date"), ("timestamp_value", "timestamp")) if c in observations.columns]
    stored = F.when(F.col("value_status") == "zero", "numeric")
    for c, k in kinds:
        stored = stored.when(F.col(c).isNotNull(), k)
    joined = observations.withColumn("stored_kind", stored).where("stored_kind is not null").join(F.broadcast(definitions), ["metric_id", "metric_definition_version"], "left")
    return joined.where(~F.col("stored_kind").eqNullSafe(F.col("value_kind"))).select("observation_id", "stored_kind", "value_kind")


def foreign_publishers(sources: DataFrame, entities: DataFrame) -> DataFrame:
    """source_id of sources whose publisher is no institution."""
    return sources.join(entities.where("entity_type = 'institution'").select(F.col("entity_id").alias("publisher")), "publisher", "left_anti").select("source_id")


def dimension_mismatches(embeddings: DataFrame, models: DataFrame) -> DataFrame:
    """embedding_id of vectors whose stated dimension is not their own or their model's; models are few."""
    joined = embeddings.join(F.broadcast(models.withColumnRenamed("dimension", "registered")), ["model_id", "model_version"], "left")
    return joined.where(~F.col("dimension").eqNullSafe(F.size("embedding")) | ~F.col("dimension").eqNullSafe(F.col("registered"))).select("embedding_id")


def unequal_keys(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """key and missing_in: keys that some of the tables lack, every table against the union of all."""
    every = reduce(lambda a, b: a.unionByName(b), [t.select(key, F.lit(n).alias("t")) for n, t in tables.items()])
    per = every.groupBy(key).agg(F.collect_set("t").alias("have"))  # as many as there are tables
    lacking = F.filter(F.array(*[F.lit(n) for n in sorted(tables)]), lambda n: ~F.array_contains(F.col("have"), n))
    return per.withColumn("missing_in", F.array_join(lacking, ",")).where("missing_in != ''").select(key, "missing_in")


def with_condition(left: DataFrame, right: DataFrame, on: str, condition: Column, proof: DataFrame) -> DataFrame:
    """left beside the right rows that meet a condition and have proof, others null: the right side is cut before the join."""
    return left.join(right.where(condition).join(proof.select(on).distinct(), on, "left_semi"), on, "left")


def release_audit(tables: dict[str, DataFrame], expected: dict[str, int], links: list[tuple[str, str, str]]) -> DataFrame:
    """check, n, expected, ok: the number of rows of each table, and of the rows of one whose key another lacks (0 expected).

    links: table, key, table that must hold the key.
    """
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(f"count:{n}").alias("check"), "n", F.lit(expected.get(n)).cast("long").alias("expected")) for n, t in tables.items()]
    orphans = [tables[a].join(tables[b].select(k), k, "left_anti").agg(F.count("*").alias("n")).select(F.lit(f"orphans:{a}.{k}->{b}").alias("check"), "n", F.lit(0).cast("long").alias("expected")) for a, k, b in links]
    return reduce(lambda a, b: a.unionByName(b), [*counts, *orphans]).withColumn("ok", F.col("n").eqNullSafe(F.col("expected")))


def acceptance(documents: DataFrame, group: str, title: str, observed: DataFrame, key: str) -> DataFrame:
    """Per group: documents, distinct titles, titles that several documents have, and documents that `observed` holds too."""
    titles = documents.groupBy(group, title).agg(F.count("*").alias("n")).groupBy(group).agg(F.sum("n").alias("n_documents"), F.count("*").alias("n_titles"), F.count_if(F.col("n") > 1).alias("n_repeated"))
    both = documents.join(observed.select(key).distinct(), key, "left_semi").groupBy(group).agg(F.count("*").alias("n_observed"))
    return titles.join(both, group, "left").fillna(0, ["n_observed"])


def check_contract(rows: DataFrame, columns: dict[str, str], pins: dict[str, str]) -> DataFrame:
    """Rows whose pinned columns hold the pinned values; another set of columns, type or pin is refused."""
    have = {f.name: f.dataType.simpleString() for f in rows.schema}
    if have != columns:
        raise Refused("RETURNED_COLUMN_SET_MISMATCH", f"{sorted(set(have.items()) ^ set(columns.items()))}")
    for name, value in pins.items():
        if not rows.where(~F.col(name).eqNullSafe(F.lit(value))).isEmpty():
            raise Refused("RESULT_PIN_MISMATCH", name)
    return rows


def row_violations(rows: DataFrame, facts: DataFrame, cutoff: Column) -> DataFrame:
    """entity_id, concept, reason of shown values that the ledger's facts do not bear out.

    rows: entity_id, product_name, concept, value; facts: entity_id, canonical_name, concept, value, evidence_id,
    cutoff_status, applicable_date.  A value stands if some fact of the same product and concept has it, with evidence
    that is eligible and a day that is not after the cutoff, under the same name.
    """
    fine = (F.col("cutoff_status") == "eligible") & F.col("evidence_id").isNotNull() & (F.col("applicable_date").isNull() | (F.col("applicable_date") <= cutoff))
    near = rows.alias("r").join(sorted_by_key(facts).alias("f"), ["entity_id", "concept"], "left")
    same_name, same_value = F.col("r.product_name").eqNullSafe(F.col("f.canonical_name")), F.col("r.value").eqNullSafe(F.col("f.value"))
    # how far the best fact comes: 4 holds in all, less breaks at the name, the value, the evidence
    rank = F.when(F.col("f.canonical_name").isNull(), 0).when(~same_name, 1).when(~same_value, 2).when(~F.coalesce(fine, F.lit(False)), 3).otherwise(4)
    best = near.groupBy("entity_id", "concept", F.col("r.value").alias("value")).agg(F.max(rank).alias("rank")).where("rank < 4")
    return best.select("entity_id", "concept", F.element_at(F.array(*[F.lit(x) for x in ("FACT_MISSING", "NAME_MISMATCH", "VALUE_MISMATCH", "EVIDENCE_INELIGIBLE")]), F.col("rank") + 1).alias("reason"))
