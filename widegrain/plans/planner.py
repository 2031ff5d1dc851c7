"""From a manifest to a plan for each wide table: which rows exist and what they carry."""

from __future__ import annotations

from dataclasses import dataclass

from widegrain.plans.graph import spanning_links
from widegrain.plans.model import Home, Hop, Manifest, Metric, Relationship, WideTable


@dataclass(frozen=True)
class MetricPlan:
    """`grain` is where the value is defined: its home and the targets of its hops."""

    metric: Metric
    home: Home
    hops: tuple[Hop, ...]
    grain: tuple[str, ...]
    reserved: tuple[str, ...]
    summarized: tuple[str, ...]

    @property
    def name(self) -> str:
        return self.metric.name

    @property
    def additive(self) -> bool:
        return self.metric.additive

    def anchors(self, hop: int) -> tuple[str, ...]:
        """The entities that hop number `hop` starts from: the home and earlier targets."""
        return tuple(dict.fromkeys([*self.home.grain, *(h.target_entity for h in self.hops[:hop])]))

    def hops_by(self, strategy: str) -> list[int]:
        return [i for i, h in enumerate(self.hops) if h.strategy == strategy]


@dataclass(frozen=True)
class GrainGroup:
    """Metrics that share a grain; all of them are summarized or none is."""

    grain: tuple[str, ...]
    metrics: tuple[MetricPlan, ...]

    @property
    def summarizes(self) -> bool:
        return bool(self.metrics[0].summarized)


@dataclass(frozen=True)
class TablePlan:
    table: WideTable
    groups: tuple[GrainGroup, ...]

    @property
    def metrics(self) -> list[MetricPlan]:
        return [m for g in self.groups for m in g.metrics]

    @property
    def full_grain(self) -> list[GrainGroup]:
        return [g for g in self.groups if not g.summarizes]

    @property
    def summarizing(self) -> list[GrainGroup]:
        return [g for g in self.groups if g.summarizes]


def plan_metric(manifest: Manifest, name: str, entities: tuple[str, ...]) -> MetricPlan:
    home = manifest.homes().get(name)
    if home is None:
        raise ValueError(f'Metric "{name}" not found on any entity or relationship')
    path = manifest.path(name)
    # Hops beyond the last one that reaches the table's entities aren't needed.
    reach = [i for i, h in enumerate(path) if h.target_entity in entities]
    hops = path[: reach[-1] + 1] if reach else ()
    grain = tuple(dict.fromkeys([*home.grain, *(h.target_entity for h in hops)]))
    return MetricPlan(
        home.metric, home, hops, grain,
        tuple(e for e in entities if e not in grain),
        tuple(e for e in grain if e not in entities),
    )


def plan_table(manifest: Manifest, name: str) -> TablePlan:
    table = manifest.table(name)
    groups: dict[tuple[str, ...], list[MetricPlan]] = {}
    for m in table.metrics:
        plan = plan_metric(manifest, m, table.entities)
        groups.setdefault(tuple(sorted(plan.grain)), []).append(plan)
    return TablePlan(table, tuple(GrainGroup(ms[0].grain, tuple(ms)) for ms in groups.values()))


def plan_all(manifest: Manifest) -> list[TablePlan]:
    return [plan_table(manifest, t.name) for t in manifest.tables]


def join_links(manifest: Manifest, grain: tuple[str, ...]) -> list[tuple[str, str, Relationship]]:
    """The joins that connect a grain, from its first entity on."""
    links = spanning_links(grain[0], manifest.relationships, set(grain))
    missing = set(grain) - {grain[0], *(to for _, to, _ in links)}
    if missing:
        raise ValueError(f"Cannot connect entities: {', '.join(e for e in grain if e in missing)} unreachable from {grain[0]}")
    return links
