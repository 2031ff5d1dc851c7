"""The base rows of a grain: its entities joined along their relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widegrain.plans.model import Manifest, Relationship
from widegrain.plans.planner import join_links
from widegrain.sources.catalog import Catalog


def id_of(entity: str) -> str:
    return f"__id_{entity}"


def label_of(entity: str) -> str:
    return f"__lb_{entity}"


def value_of(metric: str) -> str:
    return f"__m_{metric}"


def base_rows(manifest: Manifest, catalog: Catalog, grain: tuple[str, ...]) -> DataFrame:
    """Inner join of a connected grain, every entity joined once.

    A relationship kept as a foreign key joins its two entities directly; others go
    through their table of links. Columns that nothing needs are pruned by the optimizer.
    """
    links = join_links(manifest, grain)
    keys: dict[str, dict[str, str]] = {}
    for at, to, rel in links:
        many = catalog.held_by(manifest, rel)
        if many is not None:
            one = rel.other(many)
            keys.setdefault(many, {})[f"__f_{rel.name}"] = manifest.link_column(rel, one)
    dates = {manifest.time.entity: {"__date": manifest.time.column}} if manifest.time and manifest.time.entity in grain else {}

    def rows(e: str) -> DataFrame:
        extra = {**keys.get(e, {}), **dates.get(e, {})}
        present = set(catalog.table(manifest.entity(e).table).columns)
        return catalog.entity(manifest.entity(e), {n: c for n, c in extra.items() if c in present})

    out = rows(grain[0])
    for at, to, rel in links:
        out = _join(manifest, catalog, out, at, to, rel, rows(to))
    return out


def _join(manifest: Manifest, catalog: Catalog, left: DataFrame, at: str, to: str, rel: Relationship, right: DataFrame) -> DataFrame:
    many = catalog.held_by(manifest, rel)
    if many is not None:
        return left.join(right, F.col(f"__f_{rel.name}") == F.col(id_of(rel.other(many))))
    links = catalog.links(manifest, rel)
    marked = links.select(*[F.col(c).alias(f"{c}__{rel.name}" if c.startswith("__l_") else c) for c in links.columns])
    joined = left.join(marked, F.col(id_of(at)) == F.col(f"__l_{at}__{rel.name}"))
    joined = joined.join(right, F.col(f"__l_{to}__{rel.name}") == F.col(id_of(to)))
    return joined.drop(*[c for c in joined.columns if c.endswith(f"__{rel.name}") and c.startswith("__l_")])


def home_rows(manifest: Manifest, catalog: Catalog, metric: str) -> DataFrame:
    """All rows of a metric's home, linked or not: the entity, or the links with both ends."""
    home = manifest.homes()[metric]
    if home.relationship is None:
        return catalog.entity(manifest.entity(home.grain[0]))
    rel = manifest.relationship(home.relationship)
    return _join(manifest, catalog, catalog.entity(manifest.entity(rel.between[0])), rel.between[0], rel.between[1], rel, catalog.entity(manifest.entity(rel.between[1])))
