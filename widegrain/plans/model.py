"""The manifest: entities, relationships, metrics, propagations and wide tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from widegrain.functions import names

#: Names a manifest may use (fixed values).
STRATEGIES = ("reserve", "elimination", "allocation", "sum_over_sum")
METRIC_TYPES = ("currency", "integer", "float", "rating", "percentage", "score")
GRANULARITIES = ("day", "week", "month", "quarter", "year")
WEIGHTINGS = ("days", "equal")
UNALLOCATED = "<Unallocated>"


@dataclass(frozen=True)
class Metric:
    name: str
    type: str = "float"
    nature: str = "additive"
    source_column: str | None = None
    stock: bool = False

    @property
    def additive(self) -> bool:
        return self.nature != "non-additive"

    @property
    def column(self) -> str:
        return self.source_column or self.name

    @property
    def counts(self) -> bool:
        """A metric made of ones, which counts the rows of its home."""
        return self.column == "1"


@dataclass(frozen=True)
class Entity:
    name: str
    role: str = "leaf"
    detail: bool = True
    estimated_rows: int = 1
    metrics: tuple[Metric, ...] = ()
    source_table: str | None = None
    id_column: str | None = None
    label_column: str | None = None

    @property
    def table(self) -> str:
        return self.source_table or names.default_table(self.name)

    @property
    def id(self) -> str:
        return self.id_column or names.default_id(self.name)

    @property
    def label(self) -> str:
        return self.label_column or "name"


@dataclass(frozen=True)
class Relationship:
    name: str
    between: tuple[str, ...]
    type: str = "many-to-many"
    estimated_links: int = 1
    weight_column: str | None = None
    metrics: tuple[Metric, ...] = ()
    source_table: str | None = None
    columns: dict[str, str] = field(default_factory=dict)

    @property
    def table(self) -> str:
        return self.source_table or names.default_table(self.name)

    def other(self, entity: str) -> str:
        return self.between[1] if self.between[0] == entity else self.between[0]


@dataclass(frozen=True)
class Hop:
    relationship: str
    target_entity: str
    strategy: str
    weight: str | None = None


@dataclass(frozen=True)
class Propagation:
    metric: str
    path: tuple[Hop, ...]


@dataclass(frozen=True)
class WideTable:
    name: str
    entities: tuple[str, ...]
    metrics: tuple[str, ...]


@dataclass(frozen=True)
class Time:
    entity: str
    column: str
    granularity: str
    weighting: str | None = None
    time_entities: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Home:
    """Where a metric lives: an entity, or a relationship with its two entities."""

    name: str
    grain: tuple[str, ...]
    metric: Metric
    relationship: str | None = None


@dataclass(frozen=True)
class Manifest:
    entities: tuple[Entity, ...] = ()
    relationships: tuple[Relationship, ...] = ()
    propagations: tuple[Propagation, ...] = ()
    tables: tuple[WideTable, ...] = ()
    labels: dict[str, str] | None = None
    time: Time | None = None

    def entity(self, name: str) -> Entity:
        return next(e for e in self.entities if e.name == name)

    def relationship(self, name: str) -> Relationship:
        return next(r for r in self.relationships if r.name == name)

    def table(self, name: str) -> WideTable:
        return next(t for t in self.tables if t.name == name)

    def link_column(self, rel: Relationship, entity: str) -> str:
        return rel.columns.get(entity) or self.entity(entity).id

    def homes(self) -> dict[str, Home]:
        """Home of each metric; a name that is declared again moves to the later place."""
        found = {m.name: Home(e.name, (e.name,), m) for e in self.entities for m in e.metrics}
        return found | {m.name: Home(r.name, tuple(r.between), m, r.name) for r in self.relationships for m in r.metrics}

    def path(self, metric: str) -> tuple[Hop, ...]:
        return next((p.path for p in self.propagations if p.metric == metric), ())

    @property
    def reserve_label(self) -> str:
        return (self.labels or {}).get("reserve", UNALLOCATED)

    @property
    def elimination_label(self) -> str:
        """Its own label only if one was given, else the reserve label."""
        return (self.labels or {}).get("elimination_set") or self.reserve_label
