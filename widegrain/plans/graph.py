"""Walks over the entity graph."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

from widegrain.plans.model import Relationship


def neighbours(entity: str, rels: Iterable[Relationship]) -> list[tuple[str, Relationship]]:
    return [(r.other(entity), r) for r in rels if len(r.between) == 2 and entity in r.between]


def spanning_links(start: str, rels: Iterable[Relationship], within: set[str] | None = None) -> list[tuple[str, str, Relationship]]:
    """(known entity, new entity, relationship) in breadth-first order from `start`."""
    rels = [r for r in rels if within is None or within.issuperset(r.between)]
    seen, queue, out = {start}, deque([start]), []
    while queue:
        at = queue.popleft()
        for to, rel in neighbours(at, rels):
            if to not in seen:
                seen.add(to)
                queue.append(to)
                out.append((at, to, rel))
    return out


def components(entities: Iterable[str], rels: Iterable[Relationship]) -> list[list[str]]:
    """Connected groups of the entities, in order of their first member."""
    names, rels, done, out = list(entities), list(rels), set(), []
    for e in names:
        if e not in done:
            group = [e, *(to for _, to, _ in spanning_links(e, rels, set(names)))]
            done.update(group)
            out.append(group)
    return out


def coarser_entities(start: str, rels: Iterable[Relationship]) -> list[str]:
    """Entities that many-to-one relationships lead to, from the many side on."""
    rels = [r for r in rels if r.type == "many-to-one" and len(r.between) == 2]
    out, queue = [], deque([start])
    while queue:
        at = queue.popleft()
        for r in rels:
            if r.between[0] == at and r.between[1] not in (start, *out):
                out.append(r.between[1])
                queue.append(r.between[1])
    return out
