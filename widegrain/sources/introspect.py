"""What tables tell about their model: keys, links, roles and metrics."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, NumericType

from widegrain.functions.names import guess_nature, id_stem, is_id_like, stem_fits_table
from widegrain.plans.model import Metric

SAMPLE_ROWS = 5


@dataclass
class TableInfo:
    name: str
    columns: dict[str, str]
    numeric: list[str]
    fractional: list[str]
    rows: int
    unique: list[str]
    key: str | None = None
    foreign_keys: dict[str, str] = field(default_factory=dict)
    kind: str = "unclassified"
    role: str = "leaf"
    sample: list[dict] = field(default_factory=list)


@dataclass
class Link:
    """A relationship found: a junction between two tables, or a foreign key."""

    name: str
    between: tuple[str, str]
    type: str
    table: str
    columns: dict[str, str]
    rows: int


@dataclass
class Model:
    tables: list[TableInfo]
    links: list[Link]
    metrics: dict[str, list[Metric]]

    def table(self, name: str) -> TableInfo:
        return next(t for t in self.tables if t.name == name)

    @property
    def entities(self) -> list[TableInfo]:
        return [t for t in self.tables if t.kind == "entity"]

    @property
    def junctions(self) -> list[TableInfo]:
        return [t for t in self.tables if t.kind == "junction"]


def probe(df: DataFrame, columns: list[str]) -> tuple[int, list[str]]:
    """Row count and which columns are unique and non-null, in one aggregation."""
    row = df.agg(F.count("*").alias("__rows"), *[F.countDistinct(c).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    return row["__rows"], [c for i, c in enumerate(columns) if row[f"d{i}"] == row["__rows"] and row["__rows"]]


def unique_columns(df: DataFrame, columns: list[str]) -> list[str]:
    return probe(df, columns)[1]


def distinct_values(df: DataFrame, column: str, limit: int) -> DataFrame:
    """The `limit` least distinct values of a column, in order."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(limit)


def sample_rows(df: DataFrame, n: int = SAMPLE_ROWS) -> list[dict]:
    return [r.asDict() for r in df.limit(n).collect()]


def scan(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """The catalog's tables by name."""
    return {t.name: spark.table(t.name) for t in sorted(spark.catalog.listTables(database), key=lambda t: t.name)}


def _key(t: TableInfo) -> str | None:
    """`id`, else the table's own id, else the first unique id, else a unique number."""
    if not t.rows:
        return None
    plain = [c for c in t.unique if c.lower() == "id"]
    own = [c for c in t.unique if (s := id_stem(c)) and stem_fits_table(s, t.name)]
    ids = [c for c in t.unique if is_id_like(c)]
    return next(iter([*plain, *own, *ids, *(c for c in t.unique if c in t.numeric)]), None)


def introspect(tables: Mapping[str, DataFrame], samples: bool = False) -> Model:
    """Read the model of a set of tables: one aggregation for each of them."""
    found: list[TableInfo] = []
    for name in sorted(tables):
        df = tables[name]
        numeric = [f.name for f in df.schema if isinstance(f.dataType, NumericType)]
        fractional = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType, DecimalType))]
        rows, unique = probe(df, [c for c in df.columns if is_id_like(c)])
        info = TableInfo(name, dict(df.dtypes), numeric, fractional, rows, unique, sample=sample_rows(df) if samples else [])
        info.key = _key(info)
        found.append(info)
    names = [t.name for t in found]
    for t in found:
        for c in t.columns:
            stem = id_stem(c)
            target = next((n for n in names if n != t.name and stem and stem_fits_table(stem, n)), None)
            if target:
                t.foreign_keys[c] = target
    return derive(found)


def derive(tables: list[TableInfo]) -> Model:
    """Kinds, links, roles and metrics from keys; tables that are excluded stay so."""
    for t in tables:
        if t.kind == "excluded":
            continue
        own = t.key if t.key not in t.foreign_keys else None
        if len(t.foreign_keys) >= 2 and own is None:
            t.kind, t.key = "junction", None
        else:
            t.kind = "entity" if t.key or not t.foreign_keys else "unclassified"
    links = []
    for t in tables:
        if t.kind == "junction":
            (a, ta), (b, tb) = list(t.foreign_keys.items())[:2]
            links.append(Link(t.name, (ta, tb), "many-to-many", t.name, {ta: a, tb: b}, t.rows))
        elif t.kind == "entity" and t.key:
            links += [Link(f"{t.name}_{c}", (t.name, to), "many-to-one", t.name, {t.name: t.key, to: c}, t.rows) for c, to in t.foreign_keys.items()]
    for t in tables:
        t.role = "bridge" if sum(t.name in link.between for link in links if link.type == "many-to-many") >= 2 else "leaf"
    metrics = {}
    for t in tables:
        if t.kind != "excluded":
            own = [c for c in t.numeric if c != t.key and c not in t.foreign_keys and not is_id_like(c)]
            if own:
                metrics[t.name] = [Metric(c, "float" if c in t.fractional else "integer", guess_nature(c)) for c in own]
    return Model(tables, links, metrics)
