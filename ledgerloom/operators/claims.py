"""From result rows to claims: each shown value with its evidence is one, and only verified ones are released."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.errors import Refused
from ..sources.ledger import sorted_by_key
from ..sources.sinks import record_hash


def claims_of(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim_id, task_id, entity_id, concept, value, evidence_ids of every value whose evidence is there.

    rows: task_id, entity_id, concept, value, evidence_ids; evidence: evidence_id.  A value without any evidence in the
    bundle is no claim.  claim_id is the content's hash, so that equal claims of two runs have one id.
    """
    each = rows.where("value is not null").select("task_id", "entity_id", "concept", "value", F.explode("evidence_ids").alias("evidence_id"))
    kept = each.join(sorted_by_key(evidence.select("evidence_id").distinct()), "evidence_id", "left_semi")
    grouped = kept.groupBy("task_id", "entity_id", "concept", "value").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    return grouped.withColumn("claim_id", F.concat(F.lit("claim-"), F.substring(record_hash(["task_id", "entity_id", "concept", "value", "evidence_ids"]), 1, 24)))


def bundle(tasks: DataFrame, claims: DataFrame) -> DataFrame:
    """task_id, n_claims, state of every task: ANSWERED, NO_RESULT_IN_BOUNDED_SCOPE (no rows) or NO_EXACT_FIELD_EVIDENCE.

    tasks: task_id, n_rows.
    """
    per = claims.groupBy("task_id").agg(F.count("*").alias("n_claims"))
    n = F.coalesce("n_claims", F.lit(0))
    return tasks.join(per, "task_id", "left").select("task_id", n.alias("n_claims"), F.when(n > 0, "ANSWERED").when(F.col("n_rows") == 0, "NO_RESULT_IN_BOUNDED_SCOPE").otherwise("NO_EXACT_FIELD_EVIDENCE").alias("state"))


def gate(planned: DataFrame, verdicts: DataFrame, claims: DataFrame) -> DataFrame:
    """The planned claims in their order, if they are just those that may be released; else refused.

    planned: position, claim_id; verdicts: claim_id, verdict.  Refused are a claim that is planned twice, one that is not
    verified, one that is verified and left out, and one that no bundle holds.
    """
    fine = verdicts.where("verdict = 'VERIFIED'").select("claim_id")
    for code, broken in (
        ("CLAIM_GATE_DUPLICATE_CLAIM", planned.groupBy("claim_id").count().where("count > 1")), ("CLAIM_GATE_CLAIM_NOT_RELEASEABLE", planned.join(fine, "claim_id", "left_anti")),
        ("CLAIM_GATE_RELEASEABLE_CLAIM_OMITTED", fine.join(planned, "claim_id", "left_anti")), ("CLAIM_GATE_CLAIM_NOT_IN_LEDGER", planned.join(claims, "claim_id", "left_anti"))):
        if not broken.isEmpty():
            raise Refused(code)
    return planned.join(claims, "claim_id").orderBy("position")


def render(released: DataFrame, names: DataFrame) -> DataFrame:
    """position and line of each released claim: name, concept, value, and the numbers of its evidence."""
    line = F.concat(F.col("name"), F.lit(" — "), F.col("concept"), F.lit(": "), F.col("value"), F.lit(" ["), F.array_join("evidence_ids", ", "), F.lit("]"))
    return released.join(names.select("entity_id", "name"), "entity_id", "left").select("position", line.alias("line")).orderBy("position")


def verify(claims: DataFrame, evidence: DataFrame, cutoff, calculations: DataFrame, coverage: DataFrame, classes: DataFrame, allowed: dict[str, str], zone: str = "Asia/Seoul") -> DataFrame:
    """claim_id and verdict: the first that holds of NO_EVIDENCE, INELIGIBLE, AFTER_CUTOFF, CALCULATION_MISMATCH, CLASS_NOT_ALLOWED, NOT_COVERED, else VERIFIED.

    claims: claim_id, entity_id, concept, absence (whether it says that there is none); evidence: claim_id, eligible,
    published_at; calculations: claim_id, verdict; coverage: entity_id, concept that are known to be complete, without which
    an absence is no fact; classes: entity_id, class; allowed: the class that a concept's entities must have.
    """
    late = ~F.coalesce(F.to_date(F.from_utc_timestamp("published_at", zone)) <= cutoff, F.lit(False))
    per = evidence.groupBy("claim_id").agg(F.count("*").alias("n"), F.count_if(~F.coalesce("eligible", F.lit(False))).alias("bad"), F.count_if(late).alias("late"))
    wrong = calculations.where("verdict != 'MATCH'").select("claim_id", F.lit(True).alias("wrong")).distinct()
    needed = F.create_map(*[F.lit(x) for pair in allowed.items() for x in pair]) if allowed else F.lit(None).cast("map<string,string>")
    fitting = classes.select("entity_id", F.col("class").alias("needed"), F.lit(True).alias("fits")).distinct()
    known = coverage.select("entity_id", "concept", F.lit(True).alias("covered")).distinct()
    rows = claims.withColumn("needed", needed[F.col("concept")]).join(per, "claim_id", "left").join(wrong, "claim_id", "left").join(fitting, ["entity_id", "needed"], "left").join(known, ["entity_id", "concept"], "left")
    verdict = (
        F.when(F.col("n").isNull(), "NO_EVIDENCE").when(F.col("bad") > 0, "INELIGIBLE").when(F.col("late") > 0, "AFTER_CUTOFF").when(F.col("wrong"), "CALCULATION_MISMATCH")
        .when(F.col("needed").isNotNull() & F.col("fits").isNull(), "CLASS_NOT_ALLOWED").when(F.col("absence") & F.col("covered").isNull(), "NOT_COVERED").otherwise("VERIFIED"))
    return rows.select("claim_id", verdict.alias("verdict"))
