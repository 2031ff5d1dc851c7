"""The strategy grid: how each metric relates to each entity, and the manifest it makes."""

from __future__ import annotations

from dataclasses import dataclass, field

from widegrain.functions.names import default_id, default_table
from widegrain.plans.graph import spanning_links
from widegrain.plans.model import Entity, Hop, Manifest, Metric, Propagation, Relationship, WideTable
from widegrain.sources.introspect import Model, TableInfo, derive

STEPS = ("data-model", "strategy-matrix", "weights", "tables")
CYCLE = ("reserve", "elimination", "allocation", "sum_over_sum")


@dataclass
class Cell:
    """home, unreachable or a strategy; how the entity is reached, and in which step."""

    strategy: str
    relationship: str | None = None
    depth: int = 0
    weight: str | None = None


@dataclass
class State:
    entities: list[Entity] = field(default_factory=list)
    relationships: list[Relationship] = field(default_factory=list)
    grid: dict[str, dict[str, Cell]] = field(default_factory=dict)
    tables: list[WideTable] = field(default_factory=list)
    step: str = STEPS[0]
    time: object | None = None
    labels: dict[str, str] | None = None

    @property
    def metrics(self) -> dict[str, tuple[Metric, tuple[str, ...]]]:
        """Every metric with its home's entities."""
        out = {m.name: (m, (e.name,)) for e in self.entities for m in e.metrics}
        return out | {m.name: (m, tuple(r.between)) for r in self.relationships for m in r.metrics}

    def move(self, by: int) -> None:
        self.step = STEPS[min(max(STEPS.index(self.step) + by, 0), len(STEPS) - 1)]


def reach(homes: tuple[str, ...], relationships: list[Relationship]) -> dict[str, tuple[str, int]]:
    """entity: (relationship that first reaches it, steps from the nearest home)."""
    out: dict[str, tuple[str, int]] = {}
    depth = dict.fromkeys(homes, 0)
    walks = [spanning_links(h, relationships) for h in homes]
    for links in walks:
        own = {links[0][0]: 0} if links else {}
        for at, to, rel in links:
            own[to] = own.get(at, 0) + 1
            if to not in depth or own[to] < depth[to]:
                depth[to] = own[to]
                out[to] = (rel.name, own[to])
    return {e: v for e, v in out.items() if e not in homes}


def init_grid(state: State) -> None:
    """Fill the grid; choices that were made before and are still possible stay."""
    old = state.grid
    state.grid = {}
    for name, (_, homes) in state.metrics.items():
        found = reach(homes, state.relationships)
        row = {}
        for e in state.entities:
            if e.name in homes:
                row[e.name] = Cell("home")
            elif e.name in found:
                row[e.name] = Cell("reserve", *found[e.name])
                kept = old.get(name, {}).get(e.name)
                if kept and kept.strategy in CYCLE and kept.strategy in legal(state, name):
                    row[e.name].strategy, row[e.name].weight = kept.strategy, kept.weight
            else:
                row[e.name] = Cell("unreachable")
        state.grid[name] = row


def legal(state: State, metric: str) -> tuple[str, ...]:
    """Strategies that the metric's nature allows."""
    additive = state.metrics[metric][0].additive
    return ("reserve", "elimination", "allocation") if additive else ("reserve", "sum_over_sum")


def cycle(state: State, metric: str, entity: str) -> str:
    """The next legal strategy of a cell; home and unreachable cells don't change."""
    cell = state.grid[metric][entity]
    if cell.strategy in CYCLE:
        options = legal(state, metric)
        cell.strategy = options[(options.index(cell.strategy) + 1) % len(options)] if cell.strategy in options else options[0]
    return cell.strategy


def cells_needing_weights(state: State) -> list[tuple[str, str]]:
    return [(m, e) for m, row in state.grid.items() for e, c in row.items() if c.strategy in ("allocation", "sum_over_sum") and not c.weight]


def extract_propagations(state: State) -> list[Propagation]:
    """A path for every metric with a strategy, hops in order of distance from its home."""
    out = []
    for metric, row in state.grid.items():
        chosen = sorted(((c.depth, i, e, c) for i, (e, c) in enumerate(row.items()) if c.strategy in CYCLE[1:]), key=lambda x: x[:2])
        if chosen:
            out.append(Propagation(metric, tuple(Hop(c.relationship or "", e, c.strategy, c.weight) for _, _, e, c in chosen)))
    return out


def build_manifest(state: State) -> Manifest:
    return Manifest(tuple(state.entities), tuple(state.relationships), tuple(extract_propagations(state)), tuple(state.tables), state.labels, state.time)  # type: ignore[arg-type]


def entity_name(table: str) -> str:
    """`OrderItem` of order_items."""
    word = table[:-3] + "y" if table.endswith("ies") else table[:-1] if table.endswith("s") and not table.endswith("ss") else table
    return "".join(p.capitalize() for p in word.split("_"))


def state_of(model: Model) -> State:
    """A state from a detected model, with all names and keys that differ from defaults."""
    state = State()
    name_of = {t.name: entity_name(t.name) for t in model.entities}
    for t in model.entities:
        name = name_of[t.name]
        label = next((c for c in t.columns if c.lower() == "name"), None) or next((c for c, kind in t.columns.items() if kind == "string"), None) or t.key
        state.entities.append(
            Entity(name, t.role, True, max(t.rows, 1), tuple(model.metrics.get(t.name, ())), t.name if t.name != default_table(name) else None, t.key if t.key != default_id(name) else None, label if label != "name" else None)
        )
    for link in model.links:
        if set(link.between) <= set(name_of):
            rel = entity_name(link.name)
            metrics = tuple(model.metrics.get(link.table, ())) if link.type == "many-to-many" else ()
            state.relationships.append(Relationship(rel, tuple(name_of[t] for t in link.between), link.type, max(link.rows, 1), None, metrics, link.table, {name_of[t]: c for t, c in link.columns.items()}))
    init_grid(state)
    return state


def set_role(table: TableInfo, column: str, role: str, target: str | None = None) -> None:
    """Make a column the key, a metric, a connection to another table, or an attribute."""
    table.foreign_keys.pop(column, None)
    if table.key == column:
        table.key = None
    if column in table.numeric and role != "metric":
        table.numeric.remove(column)
    if role == "key":
        table.key = column
    elif role == "connect" and target:
        table.foreign_keys[column] = target
    elif role == "metric" and column not in table.numeric:
        table.numeric.append(column)


def reclassify(model: Model, table: str, kind: str) -> Model:
    """Make a table an entity, a junction or excluded, and derive the rest again."""
    t = model.table(table)
    t.kind = kind if kind == "excluded" else "unclassified"
    if kind == "entity" and t.key is None:
        t.key = next(iter([*t.unique, *t.columns]), None)
    if kind == "junction":
        t.key = None
    return derive(model.tables)
