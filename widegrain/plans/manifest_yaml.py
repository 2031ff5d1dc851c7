"""Reading and writing manifests as YAML.

Only true and false are booleans and only decimal integers are integers, as in YAML 1.2.
"""

from __future__ import annotations

import re
from typing import Any

import yaml

from widegrain.plans.model import UNALLOCATED, Entity, Hop, Manifest, Metric, Propagation, Relationship, Time, WideTable


class _Loader(yaml.SafeLoader):
    pass


_Loader.yaml_implicit_resolvers = {
    first: [(tag, rx) for tag, rx in pairs if tag not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:int", "tag:yaml.org,2002:timestamp")]
    for first, pairs in yaml.SafeLoader.yaml_implicit_resolvers.items()
}
_Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
_Loader.add_implicit_resolver("tag:yaml.org,2002:int", re.compile(r"^[-+]?[0-9]+$"), list("-+0123456789"))
_Loader.add_constructor("tag:yaml.org,2002:int", lambda loader, node: int(loader.construct_scalar(node)))


def _column(raw) -> str | None:
    """A column's name; the number 1 is the column of ones."""
    return None if raw is None else str(raw)


def _metrics(raw: Any) -> tuple[Metric, ...]:
    return tuple(Metric(m["name"], m.get("type", "float"), m.get("nature", "additive"), _column(m.get("source_column")), bool(m.get("stock", False))) for m in raw or [])


def _hops(raw: Any) -> tuple[Hop, ...]:
    return tuple(Hop(h["relationship"], h["target_entity"], h["strategy"], h.get("weight")) for h in raw or [])


def parse_manifest(text: str) -> Manifest:
    raw = yaml.load(text, Loader=_Loader)  # noqa: S506 - a SafeLoader with fewer types
    if not isinstance(raw, dict):
        raise ValueError("Invalid manifest: expected a YAML object")
    time = None
    if raw.get("time") is not None:
        t = raw["time"]
        if not isinstance(t, dict):
            raise ValueError("Invalid manifest: time must be an object")
        for key in ("entity", "column", "granularity"):
            if not t.get(key):
                raise ValueError(f"Invalid manifest: time.{key} is required")
        listed = t.get("time_entities")
        time = Time(t["entity"], t["column"], t["granularity"], t.get("weighting"), tuple(listed) if listed is not None else None)
    labels = None
    if raw.get("placeholder_labels") is not None:
        given = raw["placeholder_labels"] or {}
        labels = {"reserve": given.get("reserve", UNALLOCATED), "elimination": given.get("elimination", UNALLOCATED)}
        if "elimination" in given:
            labels["elimination_set"] = given["elimination"]
    propagations = []
    for p in raw.get("propagations") or []:
        listed = p["metric"] if isinstance(p["metric"], list) else [p["metric"]]
        propagations += [Propagation(m, _hops(p.get("path"))) for m in listed]
    return Manifest(
        tuple(
            Entity(e["name"], e.get("role", "leaf"), bool(e.get("detail", True)), e.get("estimated_rows", 1), _metrics(e.get("metrics")), e.get("source_table"), e.get("id_column"), e.get("label_column"))
            for e in raw.get("entities") or []
        ),
        tuple(
            Relationship(r["name"], tuple(r.get("between") or ()), r.get("type", "many-to-many"), r.get("estimated_links", 1), r.get("weight_column"), _metrics(r.get("metrics")), r.get("source_table"), dict(r.get("columns") or {}))
            for r in raw.get("relationships") or []
        ),
        tuple(propagations),
        tuple(WideTable(t["name"], tuple(t.get("entities") or ()), tuple(t.get("metrics") or ())) for t in raw.get("bft_tables") or []),
        labels,
        time,
    )


def load_manifest(path: str) -> Manifest:
    with open(path, encoding="utf-8") as f:
        return parse_manifest(f.read())


def _plain(pairs: dict[str, Any]) -> dict[str, Any]:
    return {k: v for k, v in pairs.items() if v is not None}


def _metric_dict(m: Metric) -> dict[str, Any]:
    return _plain({"name": m.name, "type": m.type, "nature": m.nature, "source_column": m.source_column, "stock": m.stock or None})


def manifest_dict(m: Manifest) -> dict[str, Any]:
    out: dict[str, Any] = {
        "entities": [
            _plain({"name": e.name, "role": e.role, "detail": e.detail, "estimated_rows": e.estimated_rows, "metrics": [_metric_dict(x) for x in e.metrics], "source_table": e.source_table, "id_column": e.id_column, "label_column": e.label_column})
            for e in m.entities
        ],
        "relationships": [
            _plain({"name": r.name, "between": list(r.between), "type": r.type, "estimated_links": r.estimated_links, "weight_column": r.weight_column, "metrics": [_metric_dict(x) for x in r.metrics] or None, "source_table": r.source_table, "columns": dict(r.columns) or None})
            for r in m.relationships
        ],
        "propagations": [
            {"metric": p.metric, "path": [_plain({"relationship": h.relationship, "target_entity": h.target_entity, "strategy": h.strategy, "weight": h.weight}) for h in p.path]}
            for p in m.propagations
        ],
        "bft_tables": [{"name": t.name, "entities": list(t.entities), "metrics": list(t.metrics)} for t in m.tables],
    }
    if m.labels is not None:
        out["placeholder_labels"] = {"reserve": m.reserve_label} | ({"elimination": m.labels["elimination_set"]} if "elimination_set" in m.labels else {})
    if m.time is not None:
        t = m.time
        out["time"] = _plain({"entity": t.entity, "column": t.column, "granularity": t.granularity, "weighting": t.weighting, "time_entities": list(t.time_entities) if t.time_entities is not None else None})
    return out


def serialize_manifest(m: Manifest) -> str:
    class Plain(yaml.SafeDumper):
        def ignore_aliases(self, data: Any) -> bool:
            return True

    return yaml.dump(manifest_dict(m), Dumper=Plain, sort_keys=False, width=120, indent=2, allow_unicode=True)


def save_manifest(m: Manifest, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(serialize_manifest(m))
