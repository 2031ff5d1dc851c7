"""Simpler tables: single changes to a manifest, ranked by what they save."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from widegrain.plans.estimate import estimate_table_rows
from widegrain.plans.model import Manifest, Propagation
from widegrain.plans.planner import plan_all
from widegrain.plans.rules import errors

#: Strategies whose hops need counts.
WEIGHTED = ("allocation", "sum_over_sum")


@dataclass(frozen=True)
class Size:
    """What all tables hold by estimate: rows, those of them with placeholders, columns, and hops with weights."""

    rows: int = 0
    placeholders: int = 0
    columns: int = 0
    weights: int = 0

    def parts(self) -> tuple[int, ...]:
        return self.rows, self.placeholders, self.columns, self.weights

    def __add__(self, other: Size) -> Size:
        return Size(*(a + b for a, b in zip(self.parts(), other.parts())))

    def __sub__(self, other: Size) -> Size:
        return Size(*(a - b for a, b in zip(self.parts(), other.parts())))


@dataclass(frozen=True)
class Suggestion:
    """One change, what it saves (below zero: costs) and gives up, and the manifest with it made."""

    change: str
    loses: str
    saves: Size
    impact: float
    manifest: Manifest


def size_of(manifest: Manifest) -> Size:
    total = Size()
    for plan in plan_all(manifest):
        rows = estimate_table_rows(manifest, plan.table.name)
        weights = sum(h.strategy in WEIGHTED for m in plan.metrics for h in m.hops)
        columns = 2 * len(plan.table.entities) + sum(1 if m.additive else 2 for m in plan.metrics)
        total += Size(rows["total"], rows["placeholder"], columns, weights)
    return total


def _with_path(manifest: Manifest, metric: str, path: tuple) -> Manifest:
    others = tuple(p for p in manifest.propagations if p.metric != metric)
    return replace(manifest, propagations=others + ((Propagation(metric, path),) if path else ()))


def _with_table(manifest: Manifest, name: str, **change: tuple[str, ...]) -> Manifest:
    return replace(manifest, tables=tuple(replace(t, **change) if t.name == name else t for t in manifest.tables))


def _changes(manifest: Manifest) -> Iterator[tuple[str, str, Manifest]]:
    for t in manifest.tables:
        for e in t.entities:
            if len(t.entities) > 1:
                rest = tuple(x for x in t.entities if x != e)
                yield f"drop {e} from {t.name}", f"{t.name} can't be grouped by {e}; its metrics become totals of what is left", _with_table(manifest, t.name, entities=rest)
        for m in t.metrics:
            if len(t.metrics) > 1:
                rest = tuple(x for x in t.metrics if x != m)
                yield f"remove {m} from {t.name}", f"{m} can't be seen beside {', '.join(rest)}", _with_table(manifest, t.name, metrics=rest)
    homes = manifest.homes()
    for p in manifest.propagations:
        home = homes.get(p.metric)
        if home is None or not home.metric.additive:
            continue
        yield f"reserve {p.metric}", f"{p.metric} stays with {home.name} and is no longer split or shown beyond it", _with_path(manifest, p.metric, ())
        if any(h.strategy == "allocation" for h in p.path):
            path = tuple(replace(h, strategy="elimination", weight=None) if h.strategy == "allocation" else h for h in p.path)
            yield f"eliminate {p.metric}", f"rows show all of {p.metric}, not their share; sums need the placeholder rows", _with_path(manifest, p.metric, path)


def suggest(manifest: Manifest, top: int = 5) -> list[Suggestion]:
    """The changes that save most, as the mean of the shares saved of each part of `Size`.

    Only changes that leave a valid manifest whose tables can be planned, and that save more
    than they cost. Ties keep the order of the manifest. An invalid manifest has none.
    """
    if errors(manifest):
        return []
    before, found = size_of(manifest), []
    for change, loses, changed in _changes(manifest):
        if errors(changed):
            continue
        after = size_of(changed)
        shares = [(b - a) / max(a, b, 1) for b, a in zip(before.parts(), after.parts())]
        impact = sum(shares) / len(shares)
        if impact > 0:
            found.append(Suggestion(change, loses, before - after, impact, changed))
    return sorted(found, key=lambda s: -s.impact)[:top]
