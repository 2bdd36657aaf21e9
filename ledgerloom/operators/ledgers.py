"""Building and checking a ledger: master rows to observations, bindings, calculations, claims, promotion, versions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.errors import Refused

_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)$"


@dataclass(frozen=True)
class Field:
    """A master column and the metric it becomes; kind is decimal, text or date (yyyyMMdd)."""

    column: str
    metric_id: str
    kind: str = "decimal"
    unit: str | None = None
    currency: str | None = None
    date_column: str | None = None
    missing: tuple[str, ...] = ("", "-")
    placeholder: tuple[str, ...] = ("N/A",)

    def cell(self) -> Column:
        """metric_id, raw and typed value, status, reason, unit, currency and date of one cell."""
        raw = F.col(self.column).cast("string")
        t = F.trim(raw)
        number = F.when(t.rlike(_NUMBER), t.try_cast("decimal(38,12)")) if self.kind == "decimal" else F.lit(None).cast("decimal(38,12)")
        day = _day(t) if self.kind == "date" else F.lit(None).cast("date")
        typed = {"decimal": number, "date": day, "text": t}[self.kind]
        blank, held = raw.isNull() | t.isin(*self.missing), t.isin(*self.placeholder)
        status = F.when(blank, "missing").when(held, "placeholder").when(typed.isNull(), "unknown").when(number == 0, "zero").otherwise("present")
        reason = F.when(blank, "NOT_REPORTED").when(held, "PLACEHOLDER").when(typed.isNull(), "UNPARSEABLE")
        valued = ~(blank | held)
        return F.struct(
            F.lit(self.metric_id).alias("metric_id"), raw.alias("raw_value"), F.when(valued, number).alias("numeric_value"), F.when(valued, t if self.kind == "text" else F.lit(None).cast("string")).alias("text_value"),
            F.when(valued, day).alias("date_value"), status.alias("value_status"), reason.alias("reason_code"), F.lit(self.unit).cast("string").alias("unit"), F.lit(self.currency).cast("string").alias("currency"),
            (_day(F.trim(F.col(self.date_column))) if self.date_column else F.lit(None).cast("date")).alias("applicable_date"))


@dataclass(frozen=True)
class MasterSpec:
    """What a master file's rows become."""

    family: str
    key: str
    name: str
    fields: tuple[Field, ...]


def _day(t: Column) -> Column:
    return F.when(t.rlike(r"^\d{8}$"), F.call_function("try_to_date", t, F.lit("yyyyMMdd")))


def map_master(rows: DataFrame, spec: MasterSpec) -> DataFrame:
    """entity_key, entity_name, product_family, disposition and cells (an array, one item a field) of every row.

    quarantined: the key is blank or several rows hold it; limited: some cell cannot be read; else accepted.
    """
    key = F.trim(F.col(spec.key).cast("string"))
    cells = rows.select(key.alias("entity_key"), F.col(spec.name).alias("entity_name"), F.array(*[f.cell() for f in spec.fields]).alias("cells"))
    usable = F.coalesce(F.col("entity_key") != "", F.lit(False))
    # the count per key is combined map-side; blank keys, which may be many, are kept out of the join
    again = cells.where(usable).groupBy("entity_key").agg(F.count("*").alias("n")).where("n > 1").select("entity_key", F.lit(True).alias("again"))
    known = cells.where(usable).join(again, "entity_key", "left")
    united = known.unionByName(cells.where(~usable).withColumn("again", F.lit(True)))
    state = F.when(F.col("again"), "quarantined").when(F.exists("cells", lambda c: c["value_status"] == "unknown"), "limited").otherwise("accepted")
    return united.select("entity_key", "entity_name", F.lit(spec.family).alias("product_family"), state.alias("disposition"), "cells")


def master_observations(mapped: DataFrame) -> DataFrame:
    """One row per cell of rows that are not quarantined."""
    return mapped.where("disposition != 'quarantined'").select("entity_key", "product_family", "disposition", F.explode("cells").alias("c")).select("entity_key", "product_family", "disposition", "c.*")


def bind_products(master: DataFrame, daily: DataFrame) -> DataFrame:
    """code, binding (BOUND, AMBIGUOUS, UNMATCHED) and name_drift of each master row by its code in the daily list."""
    per = daily.groupBy("code").agg(F.count("*").alias("n"), F.min("name").alias("daily_name"))
    binding = F.when(F.col("n").isNull(), "UNMATCHED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("BOUND")
    return master.join(per, "code", "left").select("code", "name", binding.alias("binding"), F.when(F.col("n") == 1, ~F.col("name").eqNullSafe(F.col("daily_name"))).alias("name_drift"))


def current_documents(documents: DataFrame, key: str = "document_id", amends: str = "amends_document_id") -> DataFrame:
    """Documents that no other one amends."""
    return documents.join(documents.select(F.col(amends).alias(key)).where(F.col(key).isNotNull()), key, "left_anti")


def representatives(products: DataFrame, edges: DataFrame, key: str = "entity_id") -> DataFrame:
    """Each product's representative once: a share class counts as the product its edge names, others as themselves.

    edges: subject_id, object_id, one a subject; a subject with several is refused as the rows are read.
    """
    one = edges.groupBy(F.col("subject_id").alias(key)).agg(F.min("object_id").alias("to"), F.max("object_id").alias("most"))
    to = F.when(F.col("to") != F.col("most"), F.raise_error(F.concat(F.lit("REPRESENTATIVE_AMBIGUOUS "), F.col(key).cast("string"))).cast(edges.schema["object_id"].dataType)).otherwise(F.col("to"))
    return products.join(one.hint("merge"), key, "left").withColumn(key, F.coalesce(to, F.col(key))).select(products.columns).distinct()


def check_calculations(calculations: DataFrame, inputs: DataFrame) -> DataFrame:
    """calculation_id, computed, verdict (MATCH, MISMATCH, NO_INPUTS, UNKNOWN_OPERATION): the claimed value against its inputs.

    calculations: calculation_id, operation (sum, count, min, max, avg), claimed; inputs: calculation_id, value.
    """
    per = inputs.groupBy("calculation_id").agg(*[f("value").alias(n) for n, f in _OPERATIONS.items()], F.count("*").alias("rows"))
    joined = calculations.join(per, "calculation_id", "left")
    computed = reduce(lambda c, n: c.when(F.col("operation") == n, F.col(n)), list(_OPERATIONS)[1:], F.when(F.col("operation") == next(iter(_OPERATIONS)), F.col(next(iter(_OPERATIONS)))))
    known = F.col("operation").isin(*_OPERATIONS)
    verdict = F.when(~F.coalesce(known, F.lit(False)), "UNKNOWN_OPERATION").when(F.col("rows").isNull(), "NO_INPUTS").when(F.col("claimed").eqNullSafe(F.col("computed")), "MATCH").otherwise("MISMATCH")
    return joined.withColumn("computed", computed).select("calculation_id", "computed", verdict.alias("verdict"))


_OPERATIONS = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}


def verify_claims(claims: DataFrame, evidence: DataFrame, cutoff: Column) -> DataFrame:
    """claim_id, n_evidence and verdict: the first of NO_EVIDENCE, INELIGIBLE, AFTER_CUTOFF that holds, else VERIFIED.

    claims: claim_id; evidence: claim_id, eligible, available_on.  One ineligible or late row fails its claim; a row
    whose flag or day is unknown counts as failing.
    """
    per = evidence.groupBy("claim_id").agg(
        F.count("*").alias("n_evidence"), F.count_if(~F.coalesce("eligible", F.lit(False))).alias("bad"), F.count_if(~F.coalesce(F.col("available_on") <= cutoff, F.lit(False))).alias("late"))
    verdict = F.when(F.col("n_evidence").isNull(), "NO_EVIDENCE").when(F.col("bad") > 0, "INELIGIBLE").when(F.col("late") > 0, "AFTER_CUTOFF").otherwise("VERIFIED")
    return claims.join(per, "claim_id", "left").select("claim_id", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), verdict.alias("verdict"))


def promote_hits(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Evidence rows of retrieval hits that still hold: the chunk is there with the same hash and its document is eligible.

    hits: chunk_id, content_hash, rank; chunks: chunk_id, doc_id, content_hash; documents: doc_id of eligible documents.
    """
    same = hits.join(chunks, ["chunk_id", "content_hash"]).join(documents.select("doc_id"), "doc_id", "left_semi")
    return same.select(F.concat_ws(":", F.lit("E"), F.col("doc_id").cast("string"), F.col("chunk_id").cast("string"), F.substring("content_hash", 1, 16)).alias("evidence_id"), "doc_id", "chunk_id", "content_hash", "rank")


def authorised(chunks: DataFrame, bindings: DataFrame, coverage: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Chunks that some rule (role, publisher) admits: its document has a binding of the role, coverage, and the publisher."""
    if not rules:
        raise Refused("AUTHORITY_RULES_EMPTY")
    covered = chunks.join(coverage.select("doc_id"), "doc_id", "left_semi")
    branches = [covered.where(F.col("publisher") == publisher).join(bindings.where(F.col("role") == role).select("doc_id"), "doc_id", "left_semi") for role, publisher in rules]
    return reduce(lambda a, b: a.unionByName(b), branches).distinct()


def carry_forward(rows: DataFrame, old: str, new: str, version: str = "dataset_version") -> DataFrame:
    """One version's rows under another version's name; refuses to write over itself."""
    if old == new:
        raise Refused("VERSION_SAME", old)
    return rows.where(F.col(version) == old).withColumn(version, F.lit(new))


def compare_versions(rows: DataFrame, old: str, new: str, version: str = "dataset_version") -> DataFrame:
    """One row: counts and order-free content hashes of two versions, and whether they agree."""
    content = F.xxhash64(*sorted(c for c in rows.columns if c != version)).cast("decimal(38,0)")
    of = lambda v: F.col(version) == v
    s = rows.where(F.col(version).isin(old, new)).agg(
        F.count_if(of(old)).alias("n_old"), F.count_if(of(new)).alias("n_new"), F.coalesce(F.sum(F.when(of(old), content)), F.lit(0)).alias("a"), F.coalesce(F.sum(F.when(of(new), content)), F.lit(0)).alias("b"))
    return s.select("n_old", "n_new", ((F.col("n_old") == F.col("n_new")) & (F.col("a") == F.col("b"))).alias("same"))
