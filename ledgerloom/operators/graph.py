"""A ledger as quads, and shapes over triples: each shape is one query for what breaks it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import iri

TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
_XSD = "http://www.w3.org/2001/XMLSchema#"


def literal(value: Column, kind: str | None = None) -> Column:
    """A quoted literal with the escapes of N-Quads."""
    text = value.cast("string")
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), text, F.lit('"' + (f"^^<{_XSD}{kind}>" if kind else "")))


def node(base: str, *parts: Column) -> Column:
    return F.concat(F.lit("<"), iri(base, *parts), F.lit(">"))


def project(entities: DataFrame, relations: DataFrame, evidence: DataFrame, version: str, base: str) -> tuple[DataFrame, DataFrame]:
    """Quads (s, p, o, graph) of the data and of its evidence, as columns; nothing is gathered.

    entities: entity_id, classes (array); relations: relation_id, subject_id, predicate_id, object_id, valid_from,
    valid_to; evidence: relation_id, evidence_id, source_id.  Each relation is an edge and an assertion about it.
    """
    term = lambda name: F.lit(f"<{base}ontology#{name}>")
    of = lambda kind, c: node(f"{base}{kind}/", F.lit(version), F.col(c))
    entity = lambda c: node(f"{base}entity/", F.col(c))
    quad = lambda df, s, p, o: df.select(s.alias("s"), p.alias("p"), o.alias("o"))
    predicate = F.concat(F.lit(f"<{base}ontology#"), F.col("predicate_id"), F.lit(">"))
    own, r = of("relation", "relation_id"), relations
    data = [
        quad(entities, entity("entity_id"), term("entityId"), literal(F.col("entity_id"))),
        quad(entities.withColumn("c", F.explode("classes")), entity("entity_id"), F.lit(TYPE), F.concat(F.lit(f"<{base}ontology#"), F.col("c"), F.lit(">"))),
        quad(r, entity("subject_id"), predicate, entity("object_id")), quad(r, own, F.lit(TYPE), term("RelationAssertion")), quad(r, own, term("subject"), entity("subject_id")),
        quad(r, own, term("predicate"), predicate), quad(r, own, term("object"), entity("object_id")), quad(r, own, term("relationId"), literal(F.col("relation_id"))), quad(r, own, term("datasetVersion"), literal(F.lit(version))),
        *[quad(r.where(F.col(c).isNotNull()), own, term(n), literal(F.col(c), "date")) for c, n in (("valid_from", "validFrom"), ("valid_to", "validTo"))],
    ]
    e = evidence.select("evidence_id", "source_id").distinct()
    proof, source = of("evidence", "evidence_id"), of("source", "source_id")
    sources = evidence.select("source_id").distinct()
    backing = [
        quad(sources, source, F.lit(TYPE), term("SourceRecord")), quad(sources, source, term("sourceId"), literal(F.col("source_id"))), quad(e, proof, F.lit(TYPE), term("EvidenceRecord")),
        quad(e, proof, term("evidenceId"), literal(F.col("evidence_id"))), quad(e, proof, term("sourceRecord"), source), quad(evidence, own, term("supportedBy"), proof),
    ]
    united = lambda parts, name: reduce(lambda a, b: a.unionByName(b), parts).withColumn("graph", node(f"{base}{name}/", F.lit(version)))
    return united(data, "data"), united(backing, "evidence")


def store(triples: DataFrame, path: str) -> DataFrame:
    """Triples written with a folder for each predicate and read again: a shape reads its path's folder and that of classes."""
    triples.select("s", "p", "o").write.partitionBy("p").parquet(path)
    return triples.sparkSession.read.schema("s string, o string, p string").parquet(path).select("s", "p", "o")


@dataclass(frozen=True)
class Shape:
    """What holds for every subject of a class, or of an edge: how often a path comes, and what its values are."""

    name: str
    target_class: str | None = None
    target_subjects_of: str | None = None
    path: str | None = None
    least: int = 0
    most: int | None = None
    value_class: str | None = None
    value_in: tuple[str, ...] = ()
    pattern: str | None = None
    disjoint: str | None = None  # a class that no target may have as well


def violations(triples: DataFrame, shapes: list[Shape]) -> DataFrame:
    """shape, node of each target that breaks a shape, once; triples: s, p, o.

    Counts and bad values of a path are summed per subject (partial sums first) and joined with the targets; the classes
    of values are a semi-join, so a value that very many subjects share is no burden.
    """
    has_class = lambda c: triples.where((F.col("p") == TYPE) & (F.col("o") == c)).select("s").distinct()
    out = []
    for s in shapes:
        targets = has_class(s.target_class) if s.target_class else triples.where(F.col("p") == s.target_subjects_of).select("s").distinct()
        if s.disjoint:
            out.append(targets.join(has_class(s.disjoint), "s", "left_semi").select(F.lit(s.name).alias("shape"), F.col("s").alias("node")))
        if not s.path:
            continue
        values = triples.where(F.col("p") == s.path).select("s", "o")
        bad = F.lit(False)
        if s.value_in:
            bad = bad | ~F.col("o").isin(*s.value_in)
        if s.pattern:
            bad = bad | ~F.col("o").rlike(s.pattern)
        if s.value_class:
            values = values.join(has_class(s.value_class).select(F.col("s").alias("o"), F.lit(True).alias("fits")), "o", "left")
            bad = bad | F.col("fits").isNull()
        per = values.groupBy("s").agg(F.count_distinct("o").alias("n"), F.count_if(bad).alias("bad"))
        n = F.coalesce("n", F.lit(0))
        wrong = (n < s.least) | (F.coalesce("bad", F.lit(0)) > 0)
        if s.most is not None:
            wrong = wrong | (n > s.most)
        out.append(targets.join(per, "s", "left").where(wrong).select(F.lit(s.name).alias("shape"), F.col("s").alias("node")))
    return reduce(lambda a, b: a.unionByName(b), out).distinct()


def unproven_edges(triples: DataFrame, evidence: DataFrame, base: str, predicates: list[str]) -> DataFrame:
    """s, p, o of direct edges that no assertion with evidence stands behind (FILTER NOT EXISTS as an anti-join)."""
    term = lambda name: f"<{base}ontology#{name}>"
    at = lambda name, column: triples.where(F.col("p") == term(name)).select(F.col("s").alias("a"), F.col("o").alias(column))
    said = at("subject", "s").join(at("predicate", "p"), "a").join(at("object", "o"), "a").join(evidence.where(F.col("p") == term("supportedBy")).select(F.col("s").alias("a")).distinct(), "a", "left_semi")
    return triples.where(F.col("p").isin(*[term(p) for p in predicates])).select("s", "p", "o").join(said.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
