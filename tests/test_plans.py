"""Predicates, plans and lineage over a hand-made ledger."""

from __future__ import annotations

import datetime as dt
import itertools
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans.compile import compile_plan
from ledgerloom.plans.errors import Refused
from ledgerloom.plans.model import Aggregate, AllOf, AnyOf, Atom, Compare, Lookup, Not, Qualifiers, Rank, RelationCondition, Scope, Screen
from ledgerloom.plans.predicate_check import evaluate
from ledgerloom.plans.predicates import lower
from ledgerloom.plans.registry import Binding, Registry
from ledgerloom.plans.scheduler import Task, run_tasks, waves
from ledgerloom.sources.ledger import Ledger, Pin, check_pin, status_violations

REGISTRY = Registry((
    Binding("fund", "aum", "m.aum", "decimal", "amount", ("sum", "avg", "min", "max")),
    Binding("fund", "name", "m.name", "text", contains=True),
    Binding("fund", "gone", "m.gone", "decimal", available=False),
))
DAY = dt.date(2026, 1, 1)


@pytest.fixture(scope="module")
def ledger(spark):
    """A: 10, B: 0, C: missing, D: 10 (a tie); A's value has two evidence rows, D's none; E is in another family."""
    products = spark.createDataFrame([(x, f"name {x}", "fund" if x != "E" else "bond") for x in "ABCDE"], "entity_id string, product_name string, product_family string")
    o = [("o1", "A", "m.aum", "present", Decimal(10), None, None), ("o2", "B", "m.aum", "zero", Decimal(0), None, None), ("o3", "C", "m.aum", "missing", None, None, "not_reported"), ("o4", "D", "m.aum", "present", Decimal(10), None, None),
         ("n1", "A", "m.name", "present", None, "alpha_1", None), ("n2", "B", "m.name", "present", None, "beta", None), ("n3", "C", "m.name", "placeholder", None, None, "blank"), ("n4", "D", "m.name", "present", None, "alpha", None)]
    observations = spark.createDataFrame([(i, e, m, "1", s, n, t, r, "amount" if m == "m.aum" else None, "KRW", DAY) for i, e, m, s, n, t, r in o], "observation_id string, entity_id string, metric_id string, metric_definition_version string, value_status string, numeric_value decimal(38,12), text_value string, reason_code string, unit string, currency string, applicable_date date")
    evidence = spark.createDataFrame([("o1", "e1", "s1"), ("o1", "e2", "s2"), ("o2", "e3", "s1"), ("o3", "e4", "s1"), ("n1", "e5", "s1"), ("n2", "e6", "s1"), ("n3", "e7", "s1"), ("n4", "e8", "s1")], "observation_id string, evidence_id string, source_id string")
    evidence = evidence.withColumn("eligible_for_claim", F.col("observation_id") != "o2").withColumn("cutoff_status", F.lit("eligible"))
    relations = spark.createDataFrame([("r1", "A", "heldBy", "X", dt.date(2025, 1, 1), None), ("r2", "B", "heldBy", "X", dt.date(2025, 1, 1), dt.date(2025, 6, 30)), ("r3", "D", "heldBy", "X", dt.date(2026, 5, 1), None), ("r4", "A", "heldBy", "Y", None, None)], "relation_id string, subject_id string, predicate_id string, object_id string, valid_from date, valid_to date")
    relation_evidence = relations.select("relation_id", F.concat(F.lit("e:"), "relation_id").alias("evidence_id"), F.lit("s").alias("source_id"), F.lit(True).alias("eligible_for_claim"), F.lit("eligible").alias("cutoff_status"))
    return Ledger(Pin("v", "h", "2026-01-01"), products, observations, evidence, relations, relation_evidence)


FUND = Scope("fund")


def ids(df):
    return [r.entity_id for r in df.collect()]


def test_lookup_keeps_missing_and_drops_what_has_no_evidence(ledger):
    rows = {r.entity_id: r for r in compile_plan(Lookup(FUND, ("aum",)), ledger, REGISTRY).collect()}
    assert set(rows) == {"A", "B", "C"}
    assert rows["C"].aum is None and (rows["C"].aum_status, rows["C"].aum_reason) == ("missing", "not_reported")
    assert rows["A"].aum_evidence_ids == ["e1", "e2"] and rows["A"].aum_source_ids == ["s1", "s2"]


def test_screen_guards(ledger):
    run = lambda p: ids(compile_plan(Screen(FUND, ("name",), p), ledger, REGISTRY))
    assert run(Atom("aum", "lt", (5,))) == ["B"]
    assert run(Not(Atom("aum", "lt", (5,)))) == ["A", "D"]
    assert run(Atom("aum", "is_missing")) == ["C"]
    assert run(Not(AnyOf((Atom("aum", "eq", (10,)), Atom("name", "eq", ("zzz",)))))) == ["B"]
    assert run(Atom("name", "contains", ("a_1",))) == ["A"]
    assert run(Atom("name", "contains", ("p%a",))) == ["A", "D"]


def test_rank_excludes_missing_and_breaks_ties_by_id(ledger, spark):
    assert ids(compile_plan(Rank(FUND, (("aum", "desc"),)), ledger, REGISTRY)) == ["A", "B"]
    with pytest.raises(Refused, match="MISSING_SORT_KEY"):
        Rank(FUND, (("aum", "desc"),), Atom("aum", "is_missing"))


def test_compare_drops_missing(ledger):
    assert ids(compile_plan(Compare(Scope("fund", ("A", "B", "C")), ("aum",)), ledger, REGISTRY)) == ["A", "B"]
    with pytest.raises(Refused, match="COMPARE_SUBJECTS"):
        Compare(Scope("fund", ("A",)), ("aum",))


def test_sum_is_not_multiplied_by_evidence(ledger):
    r = compile_plan(Aggregate(FUND, "sum", "aum"), ledger, REGISTRY).first()
    assert (r.value, r.n_entities, r.n_evidence) == (Decimal(20), 3, 3)
    c = compile_plan(Aggregate(FUND, "count", predicate=Atom("aum", "gt", (100,))), ledger, REGISTRY).first()
    assert (c.value, c.entity_ids) == (0, None)


def test_bounded_screen_counts_all_with_eligible_evidence(ledger):
    r = compile_plan(Screen(FUND, ("aum",), Atom("aum", "gte", (0,)), limit=1), ledger, REGISTRY).collect()
    assert [(x.entity_id, x.population) for x in r] == [("A", 1)]


def test_relations_with_and_without_date(ledger):
    held = Scope("fund", conditions=(RelationCondition("heldBy", ("X",)),))
    any_value = Atom("name", "is_present")
    assert ids(compile_plan(Screen(held, ("name",), any_value), ledger, REGISTRY)) == ["A", "D"]
    assert ids(compile_plan(Screen(held, ("name",), any_value, Qualifiers(as_of=dt.date(2025, 6, 30))), ledger, REGISTRY.__class__((*REGISTRY._by.values(),))) ) == []  # no observation is as of that day
    dated = Scope("fund", conditions=(RelationCondition("heldBy", ("X",), as_of_required=True),))
    with pytest.raises(Refused, match="AS_OF_REQUIRED"):
        compile_plan(Screen(dated, ("name",), any_value), ledger, REGISTRY)


def test_refusals(ledger):
    with pytest.raises(Refused, match="CONCEPT_UNAVAILABLE"):
        compile_plan(Lookup(FUND, ("gone",)), ledger, REGISTRY)
    with pytest.raises(Refused, match="CONCEPT_NOT_REGISTERED"):
        compile_plan(Lookup(FUND, ("nothing",)), ledger, REGISTRY)
    with pytest.raises(Refused, match="OPERATOR_NOT_ALLOWED"):
        compile_plan(Screen(FUND, ("name",), Atom("name", "lt", ("x",))), ledger, REGISTRY)
    with pytest.raises(Refused, match="UNIT_MISMATCH"):
        compile_plan(Screen(FUND, ("aum",), Atom("aum", "lt", (1,), "day")), ledger, REGISTRY)
    with pytest.raises(Refused, match="AGGREGATE_NOT_ALLOWED"):
        compile_plan(Aggregate(FUND, "sum", "name"), ledger, REGISTRY)
    with pytest.raises(Refused, match="BINARY_FLOAT"):
        Atom("aum", "lt", (0.5,))
    with pytest.raises(Refused, match="PREDICATE_TOO_LARGE"):
        Screen(FUND, (), AllOf(tuple(Atom("aum", "eq", (i,)) for i in range(9))))
    with pytest.raises(Refused, match="PREDICATE_TOO_DEEP"):
        Screen(FUND, (), Not(Not(Not(Atom("aum", "eq", (1,))))))


def test_lowering_agrees_with_plain_evaluation(spark):
    """Every operator, under no, one and two negations and mixed with AND and OR, over every status."""
    values = [(Decimal(1), "present"), (Decimal(0), "zero"), (Decimal(5), "present"), (None, "missing"), (None, "unknown")]
    rows = [(*a, *b) for a, b in itertools.product(values, values)]
    df = spark.createDataFrame(rows, "x decimal(38,12), xs string, y decimal(38,12), ys string")
    b = Binding("f", "x", "m", "decimal")
    field = lambda c: (F.col(c), F.col(c + "s"), b)
    bare = [Atom("x", op, tuple(range(1, 1 + n))) for op, n in (("eq", 1), ("neq", 1), ("lt", 1), ("lte", 1), ("gt", 1), ("gte", 1), ("between", 2), ("in", 3), ("not_in", 2), ("is_missing", 0), ("is_present", 0))]
    other = Atom("y", "gt", (0,))
    trees = [t for a in bare for t in (a, Not(a), AllOf((a, other)), AnyOf((a, other)), Not(AllOf((a, other))), Not(AnyOf((a, other))), Not(AnyOf((Not(a), other))))]
    got = df.select(*[F.coalesce(lower(t, field), F.lit(False)).alias(f"t{i}") for i, t in enumerate(trees)], "x", "xs", "y", "ys").collect()
    for r in got:
        at = {"x": (r.x, r.xs), "y": (r.y, r.ys)}
        for i, t in enumerate(trees):
            assert r[f"t{i}"] == (evaluate(t, at) is True), (t, at)


def test_pin(spark, ledger):
    datasets = spark.createDataFrame([("v", "h", "2026-01-01")], "dataset_version string, manifest_hash string, cutoff_date string")
    check_pin(datasets, ledger.pin)
    with pytest.raises(Refused, match="DATASET_PIN_CHANGED"):
        check_pin(datasets, Pin("v", "other", "2026-01-01"))


def test_status_violations(ledger, spark):
    assert status_violations(ledger.observations).isEmpty()
    bad = spark.createDataFrame([("present", None, None), ("zero", Decimal(1), None), ("missing", None, " "), ("missing", Decimal(1), "x"), ("odd", None, "x")], "value_status string, numeric_value decimal(38,12), reason_code string")
    assert status_violations(bad).count() == 5


def test_tasks(spark, ledger):
    build = lambda plan, prior: compile_plan(plan, ledger, REGISTRY, prior)
    first = Task("first", Rank(FUND, (("aum", "desc"),), limit=1))
    then = Task("then", Screen(Scope("fund", prior="first"), ("name",), Atom("name", "is_present")), needs_one=True)
    none = Task("none", Screen(FUND, ("aum",), Atom("aum", "gt", (1000,))))
    after = Task("after", Screen(Scope("fund", prior="none"), ("name",), Atom("name", "is_present")))
    refused = Task("refused", Lookup(FUND, ("gone",)))
    late = Task("late", Screen(Scope("fund", prior="refused"), ("name",), Atom("name", "is_present")))
    out = run_tasks(spark, [then, first, none, after, refused, late], build)
    assert [r.entity_id for r in out["then"][1]] == ["A"]
    assert {k: v[0] for k, v in out.items()} == {"first": "done", "then": "done", "none": "done", "after": "empty_upstream", "refused": "failed", "late": "upstream_failed"}
    with pytest.raises(Refused, match="TASK_CYCLE"):
        waves([after])
