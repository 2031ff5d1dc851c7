"""Named source tables: DataFrames, views, Parquet or CSV folders."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from widegrain.plans.model import Entity, Manifest, Metric, Relationship

Loader = Callable[[str], DataFrame]


def source_value(m: Metric) -> Column:
    return F.lit(1.0) if m.counts else F.col(m.column).cast("double")


class Catalog:
    """Looks a table up among given DataFrames first, then by a loader."""

    def __init__(self, given: Mapping[str, DataFrame] | None = None, loader: Loader | None = None):
        self.given = dict(given or {})
        self.loader = loader

    @classmethod
    def parquet(cls, spark: SparkSession, folder: str, given: Mapping[str, DataFrame] | None = None) -> Catalog:
        return cls(given, lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))

    @classmethod
    def csv(cls, spark: SparkSession, folder: str, schemas: Mapping[str, str] | None = None) -> Catalog:
        """CSV files with a header; a table without a given schema has it inferred."""

        def load(name: str) -> DataFrame:
            reader = spark.read.option("header", True)
            reader = reader.schema(schemas[name]) if schemas and name in schemas else reader.option("inferSchema", True)
            return reader.csv(f"{folder}/{name}.csv")

        return cls(None, load)

    @classmethod
    def tables(cls, spark: SparkSession) -> Catalog:
        return cls(None, spark.table)

    def table(self, name: str) -> DataFrame:
        if name not in self.given:
            if self.loader is None:
                raise KeyError(f"no source table {name}")
            self.given[name] = self.loader(name)
        return self.given[name]

    def entity(self, e: Entity, extra: dict[str, str] | None = None) -> DataFrame:
        """__id_E, __lb_E, __m_<metric> for each metric, and `extra` columns by name."""
        src = self.table(e.table)
        cols = [F.col(e.id).alias(f"__id_{e.name}"), F.col(e.label).cast("string").alias(f"__lb_{e.name}")]
        cols += [source_value(m).alias(f"__m_{m.name}") for m in e.metrics if m.counts or m.column in src.columns]
        return src.select(*cols, *[F.col(c).alias(n) for n, c in (extra or {}).items()])

    def held_by(self, manifest: Manifest, r: Relationship) -> str | None:
        """The many side of a relationship whose links are a column of its own table."""
        for e in r.between:
            if r.type == "many-to-one" and r.table == manifest.entity(e).table and manifest.link_column(r, e) == manifest.entity(e).id and not r.metrics:
                return e
        return None

    def links(self, manifest: Manifest, r: Relationship) -> DataFrame:
        """__l_E for both ends, __m_<metric> and __w_R: one row for each pair of ends.

        Parallel links are merged (additive metrics and weights add up, others are
        averaged), so that counts of distinct targets are counts of links.
        """
        src = self.table(r.table)
        keys = [F.col(manifest.link_column(r, e)).alias(f"__l_{e}") for e in r.between]
        values = [(F.sum if m.additive else F.avg)(source_value(m)).alias(f"__m_{m.name}") for m in r.metrics]
        if r.weight_column and r.weight_column in src.columns:
            values.append(F.sum(F.col(r.weight_column).cast("double")).alias(f"__w_{r.name}"))
        grouped = src.groupBy(*keys)
        return grouped.agg(*values) if values else src.select(*keys).distinct()
