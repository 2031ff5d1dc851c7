"""Validation of manifests: every rule is checked and every finding reported."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from widegrain.functions.names import IDENTIFIER
from widegrain.plans.graph import coarser_entities, components
from widegrain.plans.model import GRANULARITIES, METRIC_TYPES, STRATEGIES, WEIGHTINGS, Manifest


@dataclass(frozen=True)
class Finding:
    rule: str
    message: str
    path: str = ""
    severity: str = "error"


Findings = Iterator[Finding]


def _owners(m: Manifest):
    yield from (("entities", e) for e in m.entities)
    yield from (("relationships", r) for r in m.relationships)


def _metrics(m: Manifest):
    for part, owner in _owners(m):
        for x in owner.metrics:
            yield f"{part}.{owner.name}.metrics.{x.name}", x


def identifiers(m: Manifest) -> Findings:
    named = [(f"{part}.{o.name}", o.name) for part, o in _owners(m)] + [(f"bft_tables.{t.name}", t.name) for t in m.tables]
    named += [(p, x.name) for p, x in _metrics(m)] + [(f"{p}.source_column", x.source_column) for p, x in _metrics(m) if not x.counts]
    for e in m.entities:
        named += [(f"entities.{e.name}.{k}", v) for k, v in (("source_table", e.source_table), ("id_column", e.id_column), ("label_column", e.label_column))]
    for r in m.relationships:
        named += [(f"relationships.{r.name}.source_table", r.source_table), (f"relationships.{r.name}.weight_column", r.weight_column)]
        named += [(f"relationships.{r.name}.columns.{k}", v) for k, v in r.columns.items()]
    for path, name in named:
        if name is not None and not IDENTIFIER.fullmatch(str(name)):
            yield Finding("valid-identifier", f'"{name}" is not a valid identifier', path)


def metric_types(m: Manifest) -> Findings:
    for path, x in _metrics(m):
        if x.type not in METRIC_TYPES:
            yield Finding("valid-metric-type", f'Metric "{x.name}" has invalid type "{x.type}"', path)


def duplicates(m: Manifest) -> Findings:
    kinds = {
        "entity": [e.name for e in m.entities], "metric": [x.name for _, x in _metrics(m)], "relationship": [r.name for r in m.relationships],
        "propagation": [p.metric for p in m.propagations], "table": [t.name for t in m.tables],
    }
    for kind, found in kinds.items():
        for i, name in enumerate(found):
            if name in found[:i]:
                yield Finding("no-duplicates", f'Duplicate {kind} "{name}"', kind)


def cardinalities(m: Manifest) -> Findings:
    for part, o in _owners(m):
        key = "estimated_rows" if part == "entities" else "estimated_links"
        n = getattr(o, key)
        if isinstance(n, bool) or not isinstance(n, int) or n <= 0:
            yield Finding("positive-cardinality", f'"{o.name}": {key} must be a positive integer', f"{part}.{o.name}.{key}")


def relationship_ends(m: Manifest) -> Findings:
    known = {e.name for e in m.entities}
    for r in m.relationships:
        path = f"relationships.{r.name}.between"
        if len(r.between) != 2:
            yield Finding("relationship-between-pair", f'Relationship "{r.name}" needs two entities between which it lies', path)
        for e in r.between:
            if e not in known:
                yield Finding("relationship-entity-exists", f'Relationship "{r.name}" references nonexistent entity "{e}"', path)


def propagations(m: Manifest) -> Findings:
    homes, known, rels = m.homes(), {e.name for e in m.entities}, {r.name: r for r in m.relationships}
    for p in m.propagations:
        path = f"propagations.{p.metric}"
        home = homes.get(p.metric)
        if home is None:
            yield Finding("propagation-metric-exists", f'No entity or relationship holds the propagated metric "{p.metric}"', path)
            continue
        if not p.path:
            yield Finding("propagation-path-nonempty", f'Propagation of "{p.metric}" has an empty path', path)
        reached = set(home.grain)
        for i, h in enumerate(p.path):
            at = f"{path}.path[{i}]"
            if h.relationship not in rels:
                yield Finding("propagation-relationship-exists", f'"{p.metric}" uses nonexistent relationship "{h.relationship}"', at)
                reached = {h.target_entity}
                continue
            if h.target_entity not in known:
                yield Finding("propagation-entity-exists", f'"{p.metric}" targets nonexistent entity "{h.target_entity}"', at)
                reached = {h.target_entity}
                continue
            ends = rels[h.relationship].between
            if h.target_entity not in ends or not any(e in reached for e in ends if e != h.target_entity):
                yield Finding("propagation-path-connected", f'"{p.metric}": no entity reached so far is connected to "{h.target_entity}" by "{h.relationship}"', at)
            if h.strategy not in STRATEGIES:
                yield Finding("valid-strategy", f'"{p.metric}" has invalid strategy "{h.strategy}"', at)
            if h.strategy == "reserve":
                yield Finding("propagation-no-reserve", f'"{p.metric}": reserve is the default and is not declared in a path', at)
            if h.strategy in ("allocation", "sum_over_sum") and not (isinstance(h.weight, str) and h.weight):
                yield Finding("strategy-weight-required", f'"{p.metric}": a hop by "{h.strategy}" names no weight', at)
            if h.target_entity in reached:
                yield Finding("propagation-no-cycle", f'"{p.metric}": path returns to "{h.target_entity}"', at)
            if not home.metric.additive and h.strategy in ("allocation", "elimination"):
                yield Finding("non-additive-strategy", f'Non-additive metric "{p.metric}" can\'t use "{h.strategy}"', at)
            if home.metric.additive and h.strategy == "sum_over_sum":
                yield Finding("additive-sum-over-sum", f'Additive metric "{p.metric}" uses sum_over_sum: its value repeats and its sum overcounts', at, "warning")
            reached.add(h.target_entity)


def table_entities(m: Manifest) -> Findings:
    known = {e.name for e in m.entities}
    for t in m.tables:
        path = f"bft_tables.{t.name}.entities"
        if not t.entities:
            yield Finding("table-entities-nonempty", f'Table "{t.name}" has no entities', path)
        for i, e in enumerate(t.entities):
            if e in t.entities[:i]:
                yield Finding("table-entity-unique", f'Table "{t.name}" names the entity "{e}" more than once', path)
            if e not in known:
                yield Finding("table-entity-exists", f'Table "{t.name}" references nonexistent entity "{e}"', path)
        linked = [e for e in dict.fromkeys(t.entities) if e in known]
        if len(components(linked, [r for r in m.relationships if len(r.between) == 2 and set(r.between) <= set(linked)])) > 1:
            yield Finding("table-grain-connected", f'Table "{t.name}": its entities are not all connected', path, "warning")


def table_metrics(m: Manifest) -> Findings:
    homes = m.homes()
    for t in m.tables:
        for i, x in enumerate(t.metrics):
            path = f"bft_tables.{t.name}.metrics.{x}"
            if x in t.metrics[:i]:
                yield Finding("table-metric-unique", f'Table "{t.name}" names the metric "{x}" more than once', path)
            if x not in homes:
                yield Finding("table-metric-exists", f'Table "{t.name}" references nonexistent metric "{x}"', path)
            elif not ({*homes[x].grain, *(h.target_entity for h in m.path(x))} & set(t.entities)):
                yield Finding("table-metric-unreachable", f'Table "{t.name}": metric "{x}" reaches none of its entities', path, "warning")


def time(m: Manifest) -> Findings:
    t = m.time
    if t is None:
        return
    known = {e.name for e in m.entities}
    if t.entity not in known:
        yield Finding("time-entity-exists", f'Time references nonexistent entity "{t.entity}"', "time.entity")
    if not t.column:
        yield Finding("time-column-required", "Time requires a column", "time.column")
    elif not IDENTIFIER.fullmatch(t.column):
        yield Finding("time-column-identifier", f'Time column "{t.column}" is not a valid identifier', "time.column", "warning")
    if t.granularity not in GRANULARITIES:
        yield Finding("time-granularity-valid", f'Invalid time granularity "{t.granularity}"', "time.granularity")
    if t.weighting and t.weighting not in WEIGHTINGS:
        yield Finding("time-weighting-valid", f'Invalid time weighting "{t.weighting}"', "time.weighting")
    if t.time_entities is None:
        return
    reach = set(coarser_entities(t.entity, m.relationships))
    if t.entity not in t.time_entities:
        yield Finding("time-entities-includes-time-entity", f'time_entities must include "{t.entity}"', "time.time_entities")
    for e in t.time_entities:
        if e not in known:
            yield Finding("time-entities-exist", f'time_entities references nonexistent entity "{e}"', "time.time_entities")
        if e != t.entity and e not in reach:
            yield Finding("time-entities-reachable", f'"{e}" is not reachable from "{t.entity}" over many-to-one relationships', "time.time_entities")


def stocks(m: Manifest) -> Findings:
    for path, x in _metrics(m):
        if x.stock and m.time is None:
            yield Finding("stock-requires-time", f'Stock metric "{x.name}" requires a time declaration', path)
        if x.stock and not x.additive:
            yield Finding("stock-not-non-additive", f'Metric "{x.name}" can\'t be both stock and non-additive', path)


def link_columns(m: Manifest) -> Findings:
    for r in m.relationships:
        for e in r.columns:
            if e not in r.between:
                yield Finding("link-column-endpoint", f'Relationship "{r.name}": columns names "{e}", which it doesn\'t connect', f"relationships.{r.name}.columns", "warning")


CHECKS: tuple[Callable[[Manifest], Findings], ...] = (
    identifiers, metric_types, duplicates, cardinalities, relationship_ends, propagations, table_entities, table_metrics, time, stocks, link_columns,
)


def validate(manifest: Manifest) -> list[Finding]:
    return [f for check in CHECKS for f in check(manifest)]


def errors(manifest: Manifest) -> list[Finding]:
    return [f for f in validate(manifest) if f.severity == "error"]
