"""Typed logical plans: predicate trees and the five executable actions, with their bounds."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from decimal import Decimal

from .errors import Refused

MAX_ATOMS, MAX_DEPTH, MAX_SET_VALUES = 8, 3, 8
MAX_ENTITY_REFS, MAX_SORT_KEYS, MAX_GROUP_KEYS, MAX_CONDITIONS = 16, 4, 8, 8
RANK_LIMIT, SCREEN_LIMIT, DEFAULT_RANK = 100, 50, 5

ORDERED = ("lt", "lte", "gt", "gte", "between")
PLAIN = ("eq", "neq", "in", "not_in", "is_missing", "is_present")
OPERATORS = (*PLAIN, *ORDERED, "contains")

Literal = str | int | bool | Decimal | dt.date


@dataclass(frozen=True)
class Atom:
    """One comparison of a concept; values has one literal, two for between, up to MAX_SET_VALUES for in and not_in."""

    concept: str
    operator: str
    values: tuple[Literal, ...] = ()
    unit: str | None = None

    def __post_init__(self) -> None:
        need = {"between": 2, "is_missing": 0, "is_present": 0}.get(self.operator)
        if self.operator not in OPERATORS:
            raise Refused("OPERATOR_UNKNOWN", self.operator)
        if self.operator in ("in", "not_in"):
            if not 1 <= len(self.values) <= MAX_SET_VALUES:
                raise Refused("SET_SIZE", str(len(self.values)))
        elif len(self.values) != (1 if need is None else need):
            raise Refused("OPERATOR_ARITY", self.operator)
        if any(isinstance(v, float) for v in self.values):
            raise Refused("BINARY_FLOAT")


@dataclass(frozen=True)
class AllOf:
    children: tuple[Predicate, ...]


@dataclass(frozen=True)
class AnyOf:
    children: tuple[Predicate, ...]


@dataclass(frozen=True)
class Not:
    child: Predicate


Predicate = Atom | AllOf | AnyOf | Not


def atoms(p: Predicate) -> list[Atom]:
    if isinstance(p, Atom):
        return [p]
    return [a for c in ((p.child,) if isinstance(p, Not) else p.children) for a in atoms(c)]


def depth(p: Predicate) -> int:
    if isinstance(p, Atom):
        return 1
    return 1 + max((depth(c) for c in ((p.child,) if isinstance(p, Not) else p.children)), default=0)


def check_predicate(p: Predicate) -> None:
    if len(atoms(p)) > MAX_ATOMS:
        raise Refused("PREDICATE_TOO_LARGE")
    if depth(p) > MAX_DEPTH:
        raise Refused("PREDICATE_TOO_DEEP")


@dataclass(frozen=True)
class Qualifiers:
    """What an observation must say about itself; as_of also dates relations."""

    currency: str | None = None
    unit: str | None = None
    as_of: dt.date | None = None
    period: str | None = None


@dataclass(frozen=True)
class RelationCondition:
    """The entity is the subject of such an edge to one of the objects."""

    predicate: str
    objects: tuple[str, ...] = ()
    as_of_required: bool = False


@dataclass(frozen=True)
class Scope:
    """A family, and within it given entities or those of a prior task's result."""

    family: str
    entities: tuple[str, ...] = ()
    prior: str | None = None
    conditions: tuple[RelationCondition, ...] = ()

    def __post_init__(self) -> None:
        if len(self.entities) > MAX_ENTITY_REFS:
            raise Refused("TOO_MANY_ENTITIES")
        if len(self.conditions) > MAX_CONDITIONS:
            raise Refused("TOO_MANY_CONDITIONS")


@dataclass(frozen=True)
class Lookup:
    scope: Scope
    concepts: tuple[str, ...]
    qualifiers: Qualifiers = field(default_factory=Qualifiers)


@dataclass(frozen=True)
class Screen:
    scope: Scope
    concepts: tuple[str, ...]
    predicate: Predicate
    qualifiers: Qualifiers = field(default_factory=Qualifiers)
    limit: int | None = None

    def __post_init__(self) -> None:
        check_predicate(self.predicate)
        if self.limit is not None and not 1 <= self.limit <= SCREEN_LIMIT:
            raise Refused("SCREEN_LIMIT", str(self.limit))


@dataclass(frozen=True)
class Rank:
    scope: Scope
    keys: tuple[tuple[str, str], ...]  # (concept, "asc" or "desc")
    predicate: Predicate | None = None
    qualifiers: Qualifiers = field(default_factory=Qualifiers)
    limit: int = DEFAULT_RANK
    concepts: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not 1 <= len(self.keys) <= MAX_SORT_KEYS or not 1 <= self.limit <= RANK_LIMIT:
            raise Refused("RANK_BOUNDS")
        if self.predicate is not None:
            check_predicate(self.predicate)
            sorts = {c for c, _ in self.keys}
            if any(a.operator == "is_missing" and a.concept in sorts for a in atoms(self.predicate)):
                raise Refused("MISSING_SORT_KEY")


@dataclass(frozen=True)
class Compare:
    scope: Scope
    concepts: tuple[str, ...]
    qualifiers: Qualifiers = field(default_factory=Qualifiers)

    def __post_init__(self) -> None:
        if len(set(self.scope.entities)) < 2 and self.scope.prior is None:
            raise Refused("COMPARE_SUBJECTS")


@dataclass(frozen=True)
class Aggregate:
    """function: sum, avg, min or max of a concept's observations; count and count_distinct count entities."""

    scope: Scope
    function: str
    concept: str | None = None
    groups: tuple[str, ...] = ()
    predicate: Predicate | None = None
    qualifiers: Qualifiers = field(default_factory=Qualifiers)
    representative: str | None = None  # relation from share classes to what represents them

    def __post_init__(self) -> None:
        if len(self.groups) > MAX_GROUP_KEYS:
            raise Refused("TOO_MANY_GROUPS")
        if self.predicate is not None:
            check_predicate(self.predicate)


Operation = Lookup | Screen | Rank | Compare | Aggregate
