"""Which concept of which family is which stored metric, and what may be asked of it."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from .errors import Refused
from .model import ORDERED, PLAIN

COLUMNS = {"decimal": "numeric_value", "integer": "numeric_value", "text": "text_value", "boolean": "boolean_value", "date": "date_value"}
FUNCTIONS = ("sum", "avg", "min", "max")


@dataclass(frozen=True)
class Binding:
    family: str
    concept: str
    metric_id: str
    kind: str
    unit: str | None = None
    aggregates: tuple[str, ...] = ()
    version: str = "1"
    available: bool = True
    contains: bool = False
    period: str | None = None

    @property
    def column(self) -> str:
        return COLUMNS[self.kind]

    @property
    def operators(self) -> tuple[str, ...]:
        return (*PLAIN, *(ORDERED if self.kind in ("decimal", "integer", "date") else ()), *(("contains",) if self.contains else ()))


@dataclass(frozen=True)
class Member:
    """What a product must be proven to say of itself to belong to a family whose source lists others as well."""

    family: str
    metric_id: str
    value: str
    version: str = "1"


@dataclass(frozen=True)
class Proof:
    """The checked set of representative edges of a family: aggregates over representatives are refused for any other set."""

    family: str
    predicate: str
    dataset_version: str
    edges_hash: str


class Registry:
    """Bindings by family and concept, members of families, predicates that need a day, proofs of populations, relations that a family has not; frozen, and hashed by content."""

    def __init__(self, bindings: tuple[Binding, ...], members: tuple[Member, ...] = (), dated: tuple[str, ...] = (), proofs: tuple[Proof, ...] = (), barred: tuple[tuple[str, str], ...] = ()) -> None:
        self.members = {m.family: m for m in members}
        self.dated = frozenset(dated)
        self.proofs = {p.family: p for p in proofs}
        self.barred = frozenset(barred)
        self._by = {(b.family, b.concept): b for b in bindings}
        if len(self._by) != len(bindings):
            raise Refused("BINDING_DUPLICATE")
        self.hash = hashlib.sha256(json.dumps([[asdict(b) for b in bindings], [asdict(m) for m in members], sorted(dated), [asdict(p) for p in proofs], sorted(barred)], sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def binding(self, family: str, concept: str) -> Binding:
        found = self._by.get((family, concept)) or self._by.get(("*", concept))
        if found is None:
            raise Refused("CONCEPT_NOT_REGISTERED", f"{family}/{concept}")
        if not found.available:
            raise Refused("CONCEPT_UNAVAILABLE", f"{family}/{concept}")
        return found

    def metrics(self, concept: str, families: tuple[str, ...]) -> list[tuple[str, str]]:
        """Metric ids and versions of one concept in several families, which must agree in kind and unit."""
        found = [self.binding(f, concept) for f in families]
        if len({(b.kind, b.unit) for b in found}) > 1:
            raise Refused("METRICS_NOT_COMPATIBLE", concept)
        return sorted({(b.metric_id, b.version) for b in found})


#: Bindings over the ledger that `sources.ledger` derives from the star schema; "*" stands for every product family.
DEFAULT = Registry((
    Binding("*", "price", "part.retail_price", "decimal", "amount", FUNCTIONS),
    Binding("*", "size", "part.size", "integer", "unit", ("avg", "min", "max")),
    Binding("*", "brand", "part.brand", "text", contains=True),
    Binding("*", "promo_size", "part.promo_size", "integer", "unit", ("avg", "min", "max")),
    Binding("*", "grade", "part.grade", "text"),
    Binding("*", "maturity", "part.maturity", "date"),
    Binding("*", "remaining_days", "part.remaining_days", "integer", "day", ("min", "max")),
    Binding("*", "margin", "part.margin", "decimal", "amount", available=False),
))
