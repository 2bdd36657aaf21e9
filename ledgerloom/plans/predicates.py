"""Predicate trees to Columns: presence guards, and NOT that leaves its guards outside."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import Refused
from .model import AllOf, AnyOf, Atom, Literal, Not, Predicate, atoms
from .registry import Binding

MISSING = ("missing", "placeholder", "unavailable", "inapplicable", "unknown")
PRESENT = ("present", "zero")
#: Units that mean the same number.
SAME_UNITS = ({"percent", "percentage_point"},)

Field = Callable[[str], tuple[Column, Column, Binding]]  # concept -> value, status, binding


def typed(value: Literal, binding: Binding, unit: str | None) -> Column:
    """The literal as the binding's storage type; decimals stay exact."""
    if unit is not None and unit != binding.unit and not any({unit, binding.unit} <= same for same in SAME_UNITS):
        raise Refused("UNIT_MISMATCH", f"{unit} for {binding.unit}")
    if binding.kind in ("decimal", "integer"):
        if isinstance(value, bool) or not isinstance(value, int | Decimal):
            raise Refused("LITERAL_KIND", repr(value))
        return F.lit(Decimal(value)).cast("decimal(38,12)")
    if binding.kind == "date":
        if not isinstance(value, dt.date):
            raise Refused("LITERAL_KIND", repr(value))
        return F.lit(value)
    if not isinstance(value, bool if binding.kind == "boolean" else str):
        raise Refused("LITERAL_KIND", repr(value))
    return F.lit(value)


def _test(atom: Atom, field: Field) -> Column:
    """The bare comparison, without its guard."""
    value, status, binding = field(atom.concept)
    if atom.operator not in binding.operators:
        raise Refused("OPERATOR_NOT_ALLOWED", f"{atom.operator} on {binding.concept}")
    if atom.operator == "is_missing":
        return status.isin(*MISSING) & value.isNull()
    if atom.operator == "is_present":
        return status.isin(*PRESENT) & value.isNotNull()
    v = [typed(x, binding, atom.unit) for x in atom.values]
    if atom.operator == "between":
        return value.between(v[0], v[1])
    if atom.operator in ("in", "not_in"):
        inside = value.isin(*v)
        return inside if atom.operator == "in" else ~inside
    if atom.operator == "contains":  # a LIKE pattern: % and _ in the value are wildcards
        return F.like(value, F.concat(F.lit("%"), v[0], F.lit("%")))
    return {"eq": value == v[0], "neq": value != v[0], "lt": value < v[0], "lte": value <= v[0], "gt": value > v[0], "gte": value >= v[0]}[atom.operator]


def guard(atom: Atom, field: Field) -> Column | None:
    """A comparison holds for present values only; tests of presence themselves have no guard."""
    return None if atom.operator in ("is_missing", "is_present") else field(atom.concept)[1].isin(*PRESENT)


def _core(p: Predicate, field: Field) -> Column:
    if isinstance(p, Atom):
        return _test(p, field)
    if isinstance(p, Not):
        return ~_core(p.child, field)
    return _joined(p, [_core(c, field) for c in p.children])


def _joined(p: AllOf | AnyOf, parts: list[Column]) -> Column:
    if not parts:
        raise Refused("PREDICATE_EMPTY")
    return reduce((lambda a, b: a & b) if isinstance(p, AllOf) else (lambda a, b: a | b), parts)


def lower(p: Predicate, field: Field) -> Column:
    """NOT keeps the guards of all comparisons below it, AND-ed even where the child is an OR, outside the negation."""
    if isinstance(p, Atom):
        g = guard(p, field)
        return _test(p, field) if g is None else g & _test(p, field)
    if isinstance(p, Not):
        guards = [g for a in atoms(p.child) if (g := guard(a, field)) is not None]
        return reduce(lambda a, b: a & b, [*guards, ~_core(p.child, field)])
    return _joined(p, [lower(c, field) for c in p.children])


def evaluate(p: Predicate, values: dict[str, tuple[object, str]]) -> bool | None:
    """The same tree over one row's (value, status) in Python, None for unknown: an independent check of `lower`."""
    from .predicate_check import evaluate as run

    return run(p, values)
