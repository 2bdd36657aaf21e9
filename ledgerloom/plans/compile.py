"""Logical plans to lazy DataFrames over a ledger.

Evidence is summed per observation before anything is joined (once, where a ledger is stored), so a second evidence row
never multiplies a value.  Shown observations without evidence drop their rows out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ledgers import representatives
from ..sources.ledger import Ledger, dealt, sorted_by_key
from .errors import Refused
from .model import Aggregate, Compare, Lookup, Operation, Predicate, Qualifiers, Rank, Scope, Screen, atoms
from .predicates import PRESENT, lower
from .registry import Binding, Registry
from .results import refuse_duplicates

#: Arrays of ids in a result hold no more than a result may have rows.
CEILING = 10_000
_META = ("observation_id", "metric_id", "metric_definition_version", "unit", "currency", "applicable_date")


def compile_plan(plan: Operation, ledger: Ledger, registry: Registry, prior: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows a plan asks for; nothing runs until an action on the result."""
    check_bindings(plan, registry)
    run = {Lookup: _lookup, Screen: _screen, Rank: _rank, Compare: _compare, Aggregate: _aggregate}.get(type(plan))
    if run is None:
        raise Refused("ACTION_NOT_SUPPORTED", type(plan).__name__)
    return run(plan, ledger, registry, prior or {})


def check_bindings(plan: Operation, registry: Registry) -> None:
    """What a plan may not ask for: relations of a compared or summed scope, or barred for its family, or without the day
    that they need; and qualifiers of a count that no concept of it takes up."""
    scope = plan.scope
    if scope.conditions and isinstance(plan, Compare | Aggregate):
        raise Refused("RELATION_SCOPE_UNSUPPORTED", type(plan).__name__)
    for condition in scope.conditions:
        if (scope.family, condition.predicate) in registry.barred:
            raise Refused("RELATION_NOT_ALLOWED", f"{scope.family}/{condition.predicate}")
        if (condition.as_of_required or condition.predicate in registry.dated) and plan.qualifiers.as_of is None:
            raise Refused("AS_OF_REQUIRED", condition.predicate)
    if isinstance(plan, Aggregate) and plan.function in ("count", "count_distinct") and not plan.groups and plan.predicate is None:
        q = plan.qualifiers
        if q.currency or q.unit or q.period or (q.as_of and plan.representative is None):
            raise Refused("QUALIFIER_NOT_CONSUMED")


def population(scope: Scope, ledger: Ledger, prior: dict[str, DataFrame], qualifiers: Qualifiers, registry: Registry | None = None) -> DataFrame:
    """entity_id and name of the products in scope; where the registry says what makes a family's member, only proven ones."""
    base = ledger.products.where(F.col("product_family") == scope.family).select("entity_id", "product_name")
    base = base.where(F.col("entity_id").isin(*scope.entities)) if scope.entities else dealt(base, "entity_id")  # named ones are few
    member = registry.members.get(scope.family) if registry is not None else None
    if member is not None:
        said = ledger.hydrated([member.metric_id]).where((F.col("metric_definition_version") == member.version) & (F.col("value_status") == "present") & (F.col("text_value") == member.value) & F.col("proven"))
        base = base.join(sorted_by_key(said.select("entity_id")), "entity_id", "left_semi")
    if scope.prior is not None:
        if scope.prior not in prior:
            raise Refused("PRIOR_RESULT_MISSING", scope.prior)
        base = base.join(sorted_by_key(prior[scope.prior].select("entity_id")), "entity_id", "left_semi")
    for condition in scope.conditions:
        base = base.join(sorted_by_key(related(ledger, condition.predicate, condition.objects, qualifiers)), "entity_id")
    return base


def edges(ledger: Ledger, predicate: str, qualifiers: Qualifiers) -> DataFrame:
    """Edges of a predicate with eligible evidence; without as_of only open-ended ones, with it those in force."""
    r = ledger.proven_relations(predicate)
    if qualifiers.as_of is None:
        return r.where(F.col("valid_to").isNull())
    day = F.lit(qualifiers.as_of)
    return r.where((F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day)))


def related(ledger: Ledger, predicate: str, objects: tuple[str, ...], qualifiers: Qualifiers) -> DataFrame:
    """Subjects of eligible edges, one row each with the edges' lineage; without as_of only open-ended edges count."""
    r = edges(ledger, predicate, qualifiers)
    if objects:
        r = r.where(F.col("object_id").isin(*objects))
    return r.groupBy(F.col("subject_id").alias("entity_id")).agg(
        F.array_sort(F.collect_set("object_id")).alias(f"{predicate}_objects"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("eligible_ids")))).alias(f"{predicate}_evidence_ids"))


def observations(ledger: Ledger, bindings: list[Binding], qualifiers: Qualifiers) -> DataFrame:
    """Stored values of the bindings' metrics that fit the qualifiers."""
    pairs = reduce(lambda a, b: a | b, [(F.col("metric_id") == b.metric_id) & (F.col("metric_definition_version") == b.version) for b in bindings])
    o = _qualified(ledger.hydrated([b.metric_id for b in bindings]).where(pairs), qualifiers)
    if qualifiers.period is not None and any(b.period != qualifiers.period for b in bindings):
        raise Refused("PERIOD_MISMATCH", qualifiers.period)
    return o


def _qualified(o: DataFrame, qualifiers: Qualifiers) -> DataFrame:
    for name, column in (("currency", "currency"), ("unit", "unit"), ("as_of", "applicable_date")):
        value = getattr(qualifiers, name)
        if value is not None:
            o = o.where(F.col(column) == F.lit(value))
    return o


def _fields(base: DataFrame, concepts: tuple[str, ...], family: str, ledger: Ledger, registry: Registry, qualifiers: Qualifiers):
    """base joined with one observation per concept; and the function that finds a concept's columns."""
    bindings = {c: registry.binding(family, c) for c in dict.fromkeys(concepts)}
    for c, b in bindings.items():
        o = observations(ledger, [b], qualifiers)
        base = base.join(sorted_by_key(o).select("entity_id", F.col(b.column).alias(f"{c}__value"), F.col("value_status").alias(f"{c}__status"), F.col("reason_code").alias(f"{c}__reason"), *[F.col(m).alias(f"{c}__{m}") for m in (*_META, "evidence_ids", "source_ids", "proven")]), "entity_id")

    def field(concept: str):
        if concept not in bindings:
            raise Refused("CONCEPT_NOT_JOINED", concept)
        return F.col(f"{concept}__value"), F.col(f"{concept}__status"), bindings[concept]

    return base, field


def _evident(rows: DataFrame, concepts: tuple[str, ...]) -> DataFrame:
    """Rows whose shown observations all have evidence."""
    return rows.where(reduce(lambda a, b: a & b, [F.col(f"{c}__evidence_ids").isNotNull() for c in dict.fromkeys(concepts)], F.lit(True)))


def _single(rows: DataFrame) -> DataFrame:
    """Two observations that fit one product are no answer: reading its rows fails, none is chosen."""
    return refuse_duplicates(rows, ["entity_id"])


def _shown(concepts: tuple[str, ...], status: bool) -> list[Column]:
    out = [F.col("entity_id"), F.col("product_name")]
    for c in dict.fromkeys(concepts):
        out.append(F.col(f"{c}__value").alias(c))
        if status:
            out += [F.col(f"{c}__status").alias(f"{c}_status"), F.col(f"{c}__reason").alias(f"{c}_reason")]
        out += [F.col(f"{c}__{m}").alias(f"{c}_{m}") for m in (*_META, "evidence_ids", "source_ids")]
    return out


def _lookup(plan: Lookup, ledger, registry, prior) -> DataFrame:
    rows, _ = _fields(population(plan.scope, ledger, prior, plan.qualifiers, registry), plan.concepts, plan.scope.family, ledger, registry, plan.qualifiers)
    return _single(_evident(rows, plan.concepts).select(*_shown(plan.concepts, True))).orderBy("entity_id")


def _needed(concepts: tuple[str, ...], predicate: Predicate | None) -> tuple[str, ...]:
    return (*concepts, *(a.concept for a in (atoms(predicate) if predicate is not None else [])))


def _screen(plan: Screen, ledger, registry, prior) -> DataFrame:
    needed = _needed(plan.concepts, plan.predicate)
    rows, field = _fields(population(plan.scope, ledger, prior, plan.qualifiers, registry), needed, plan.scope.family, ledger, registry, plan.qualifiers)
    rows = rows.where(lower(plan.predicate, field))
    if plan.limit is None:
        return _single(_evident(rows, plan.concepts).select(*_shown(plan.concepts, False))).orderBy("entity_id")
    # bounded: count and cut the distinct products whose shown observations have eligible evidence
    for c in dict.fromkeys(plan.concepts):
        rows = rows.where(F.col(f"{c}__proven"))
    ids = rows.select("entity_id").distinct()
    total = ids.agg(F.count("*").alias("population"))
    display = ids.orderBy("entity_id").limit(plan.limit).crossJoin(F.broadcast(total))  # one row
    order = [F.col(f"{c}__observation_id") for c in dict.fromkeys(plan.concepts)]
    first = rows.join(display, "entity_id").withColumn("_k", F.row_number().over(Window.partitionBy("entity_id").orderBy(*order))).where("_k = 1")
    return first.select(*_shown(plan.concepts, False), "population").orderBy("entity_id")


def _rank(plan: Rank, ledger, registry, prior) -> DataFrame:
    keys = tuple(c for c, _ in plan.keys)
    shown = tuple(dict.fromkeys((*keys, *plan.concepts)))
    rows, field = _fields(population(plan.scope, ledger, prior, plan.qualifiers, registry), _needed(shown, plan.predicate), plan.scope.family, ledger, registry, plan.qualifiers)
    if plan.predicate is not None:
        rows = rows.where(lower(plan.predicate, field))
    for c in keys:
        rows = rows.where(field(c)[1].isin(*PRESENT))
    order = [F.col(c).asc() if way == "asc" else F.col(c).desc() for c, way in plan.keys]
    order.append(F.col("entity_id").asc())
    top = _evident(rows, shown).select(*_shown(shown, False)).orderBy(*order).limit(plan.limit)
    return _single(top).orderBy(*order)  # a hundred rows at most


def _compare(plan: Compare, ledger, registry, prior) -> DataFrame:
    rows, field = _fields(population(plan.scope, ledger, prior, plan.qualifiers, registry), plan.concepts, plan.scope.family, ledger, registry, plan.qualifiers)
    for c in plan.concepts:
        rows = rows.where(field(c)[1].isin(*PRESENT))
    return _evident(rows, plan.concepts).select(*_shown(plan.concepts, False)).orderBy("entity_id")


def edges_hash(ledger: Ledger, predicate: str) -> str:
    """Content of all eligible edges of a predicate, whatever their order: sums of two hashes of each, partial sums first."""
    r = ledger.proven_relations(predicate).select("relation_id", "subject_id", "object_id", "valid_from", "valid_to", F.array_join("eligible_ids", ",").alias("ids"))
    row = r.agg(F.count("*"), *[F.sum(F.xxhash64(F.lit(salt), *r.columns).cast("decimal(38,0)")) for salt in ("a", "b")]).first()
    return ":".join(str(int(x or 0)) for x in row)


def check_proof(plan: Aggregate, ledger: Ledger, registry: Registry) -> None:
    """A family with a registered proof takes its representatives from that very set of edges, version and predicate, or not at all."""
    proof = registry.proofs.get(plan.scope.family)
    if proof is None:
        return
    if (proof.predicate, proof.dataset_version) != (plan.representative, ledger.pin.dataset_version) or edges_hash(ledger, proof.predicate) != proof.edges_hash:
        raise Refused("POPULATION_PROOF_REQUIRED", plan.scope.family)


def _measured(plan: Aggregate, ledger, registry, prior):
    """Rows that an aggregate is over, the target's column name (None for counts), and the columns of its groups."""
    base = population(plan.scope, ledger, prior, plan.qualifiers, registry)
    family = plan.scope.family
    if plan.representative is not None:
        check_proof(plan, ledger, registry)
        base = representatives(base.select("entity_id"), edges(ledger, plan.representative, plan.qualifiers).select("subject_id", "object_id"))
    count = plan.function in ("count", "count_distinct")
    if not count:
        binding = registry.binding(family, plan.concept or "")
        if plan.function not in binding.aggregates:
            raise Refused("AGGREGATE_NOT_ALLOWED", f"{plan.function} of {plan.concept}")
    others = tuple(dict.fromkeys((*plan.groups, *_needed((), plan.predicate))))
    rows, field = _fields(base, tuple(c for c in others if count or c != plan.concept), family, ledger, registry, plan.qualifiers)
    t = None
    if not count:
        # the target joins by metric alone, whatever the definition's version
        o = _qualified(ledger.hydrated([binding.metric_id]), plan.qualifiers)
        t = "_target" if plan.concept not in others else plan.concept
        rows = rows.join(sorted_by_key(o).select("entity_id", F.col(binding.column).alias(f"{t}__value"), F.col("value_status").alias(f"{t}__status"), *[F.col(m).alias(f"{t}__{m}") for m in (*_META, "evidence_ids", "source_ids", "proven")]), "entity_id")
        target, status = F.col(f"{t}__value"), F.col(f"{t}__status")
        known = field
        field = lambda c: (target, status, binding) if c == plan.concept else known(c)
        rows = rows.where(status.isin(*PRESENT))
    for g in plan.groups:
        rows = rows.where(field(g)[1].isin(*PRESENT))
    if plan.predicate is not None:
        rows = rows.where(lower(plan.predicate, field))
    return rows, t, [field(g)[0].alias(g) for g in plan.groups]


def _aggregate(plan: Aggregate, ledger, registry, prior) -> DataFrame:
    rows, t, groups = _measured(plan, ledger, registry, prior)
    names = list(plan.groups)
    if t is None:
        # ids come as one array only where they are no more than a result may have; lineage_rows() has them as rows
        counts = rows.groupBy(*groups).agg(F.countDistinct("entity_id").alias("value"))
        few = counts.where(F.col("value") <= CEILING).select(*names)
        keyed = rows.select(*groups, "entity_id")
        keyed = keyed.join(few, names, "left_semi") if names else keyed.crossJoin(F.broadcast(few))  # no column, one row or none
        ids = keyed.groupBy(*names).agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))
        out = counts.join(ids, _same(counts, ids, names), "left").select(*[counts[n] for n in names], "value", "entity_ids") if names else counts.crossJoin(F.broadcast(ids))
        over = F.raise_error(F.concat(F.lit("ROW_CEILING "), F.col("value").cast("string"))).cast("array<string>")
        out = out.withColumn("entity_ids", F.when(F.col("value") > CEILING, over).when(F.size("entity_ids") > 0, F.col("entity_ids")))
    else:
        f = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[plan.function]
        of = lambda m: F.array_sort(F.collect_set(f"{t}__{m}"))  # noqa: E731  (few definitions, units, currencies and days)
        out = rows.groupBy(*groups).agg(
            f(F.col(f"{t}__value")).cast("decimal(38,12)").alias("value"), F.countDistinct("entity_id").alias("n_entities"), F.countDistinct(f"{t}__observation_id").alias("n_observations"),
            of("metric_id").alias("metric_ids"), of("metric_definition_version").alias("metric_definition_versions"), of("unit").alias("units"), of("currency").alias("currencies"), of("applicable_date").alias("applicable_dates"))
        proof = rows.where(F.col(f"{t}__evidence_ids").isNotNull()).select(*groups, F.explode(f"{t}__evidence_ids").alias("evidence_id"), F.col(f"{t}__source_ids").alias("sources"))
        proof = proof.groupBy(*names).agg(F.countDistinct("evidence_id").alias("n_evidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("source_ids"))
        if names:
            out = out.join(proof, names)
        else:
            out = out.crossJoin(F.broadcast(proof))  # one row each
    return out.orderBy(*names) if names else out


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names])


def lineage_rows(plan: Aggregate, ledger: Ledger, registry: Registry, prior: dict[str, DataFrame] | None = None, concepts: tuple[str, ...] = ()) -> DataFrame:
    """What an aggregate rests on, as rows: its groups, entity_id, observation_id, metric_id, evidence_id.

    For a sum and its like the target's observations; for a count those of `concepts` that the counted entities have, the
    metrics that are to say the entities are there, joined beside the count so that they change no number.  As rows, a
    group of any size is no burden; a plan without a target or concepts is refused.
    """
    check_bindings(plan, registry)
    rows, t, groups = _measured(plan, ledger, registry, prior or {})
    names = list(plan.groups)
    if t is not None:
        o = rows.select(*groups, "entity_id", *[F.col(f"{t}__{m}").alias(m) for m in ("observation_id", "metric_id", "evidence_ids")])
    else:
        if not concepts:
            raise Refused("COUNT_LINEAGE_REQUIRED")
        found = observations(ledger, [registry.binding(plan.scope.family, c) for c in concepts], plan.qualifiers)
        o = rows.select(*groups, "entity_id").distinct().join(sorted_by_key(found).select("entity_id", "observation_id", "metric_id", "evidence_ids"), "entity_id")
    return o.select(*names, "entity_id", "observation_id", "metric_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
