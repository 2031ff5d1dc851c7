"""Drafts of a manifest in the making, beside the data they describe."""

from __future__ import annotations

import json
import os
from dataclasses import asdict

from widegrain.authoring.grid import Cell, State
from widegrain.plans.model import Entity, Metric, Relationship, Time, WideTable

SUFFIX = ".widegrain-draft.json"


def draft_path(source: str) -> str:
    return source.rstrip("/") + SUFFIX


def save_draft(state: State, source: str) -> str:
    path = draft_path(source)
    grid = {m: {e: asdict(c) for e, c in row.items()} for m, row in state.grid.items()}
    body = {"source": source, "step": state.step, "entities": [asdict(e) for e in state.entities], "relationships": [asdict(r) for r in state.relationships], "grid": grid, "tables": [asdict(t) for t in state.tables], "labels": state.labels, "time": asdict(state.time) if state.time else None}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(body, f, indent=1)
    return path


def load_draft(source: str) -> State | None:
    """The draft of the same source; None if there is none, or it can't be read."""
    try:
        with open(draft_path(source), encoding="utf-8") as f:
            raw = json.load(f)
        if raw["source"] != source:
            return None
        metrics = lambda x: tuple(Metric(**m) for m in x)
        entities = [Entity(**{**e, "metrics": metrics(e["metrics"])}) for e in raw["entities"]]
        rels = [Relationship(**{**r, "between": tuple(r["between"]), "metrics": metrics(r["metrics"])}) for r in raw["relationships"]]
        grid = {m: {e: Cell(**c) for e, c in row.items()} for m, row in raw["grid"].items()}
        tables = [WideTable(t["name"], tuple(t["entities"]), tuple(t["metrics"])) for t in raw["tables"]]
        t = raw.get("time")
        time = Time(**{**t, "time_entities": tuple(t["time_entities"]) if t["time_entities"] is not None else None}) if t else None
        return State(entities, rels, grid, tables, raw["step"], time, raw.get("labels"))
    except (OSError, ValueError, KeyError, TypeError):
        return None


def delete_draft(source: str) -> None:
    if os.path.exists(draft_path(source)):
        os.remove(draft_path(source))
