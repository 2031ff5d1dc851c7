"""Branches of a wide table and their union.

Every branch is a select to one schema: an id and a label for each entity, then each
metric, a non-additive one followed by its weight.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from widegrain.functions.names import label_output
from widegrain.functions.periods import period_days
from widegrain.operators.grain import base_rows, home_rows, id_of, label_of, value_of
from widegrain.operators.weights import Weights
from widegrain.plans.model import Manifest
from widegrain.plans.planner import GrainGroup, MetricPlan, TablePlan
from widegrain.sources.catalog import Catalog

#: Metadata of a metric's column: sums of any rows hold, only sums that include the placeholder
#: rows do, or the column must be averaged by its weight. Parquet keeps it.
SUM_RULE = "sum_rule"
SUM_RULES = ("any_rows", "with_placeholder_rows", "by_weight")


@dataclass(frozen=True)
class Options:
    """weights: "equal" splits alike, "declared" by a relationship's weight column.
    independent_chains: "cross" joins all grains, "union" keeps unrelated chains apart.
    orphans: "drop" leaves unlinked home rows out, "reserve" keeps them on placeholder rows.
    stock: "rows" averages all summarized rows, "semi_additive" adds up other dimensions first.
    skip_zero_base leaves out combination rows on which every metric would be zero.
    counts: "join" or "window", see Weights.
    """

    weights: str = "equal"
    independent_chains: str = "cross"
    orphans: str = "drop"
    stock: str = "rows"
    skip_zero_base: bool = False
    counts: str = "join"


class Assembly:
    def __init__(self, manifest: Manifest, catalog: Catalog, plan: TablePlan, options: Options):
        self.manifest, self.catalog, self.plan, self.options = manifest, catalog, plan, options
        self.entities = plan.table.entities
        self.weights = Weights(manifest, options.counts, options.weights == "declared")
        self.reserve, self.eliminated = manifest.reserve_label, manifest.elimination_label
        outputs = [n for e in self.entities for n in (manifest.entity(e).id, label_output(e))] + [c for m in plan.metrics for c in (m.name, f"{m.name}_weight")]
        twice = sorted({n for n in outputs if outputs.count(n) > 1})
        if twice:
            raise ValueError(f"output columns collide: {', '.join(twice)}")
        for m in plan.metrics:
            table = manifest.relationship(m.home.name).table if m.home.relationship else manifest.entity(m.home.name).table
            if not m.metric.counts and m.metric.column not in catalog.table(table).columns:
                raise ValueError(f"metric {m.name}: source table {table} has no column {m.metric.column}")

    def build(self) -> DataFrame:
        branches: list[DataFrame] = []
        full = self.plan.full_grain
        if full and self.options.independent_chains == "union":
            for group in full:
                branches += self._pipeline(list(group.metrics), group.grain, apart=True)
        elif full:
            branches += self._pipeline([m for g in full for m in g.metrics], self.entities, apart=False)
        branches += [self._summary(g) for g in self.plan.summarizing]
        return self._flagged(reduce(DataFrame.unionByName, branches))

    def _flagged(self, built: DataFrame) -> DataFrame:
        """Each metric's column says in its metadata how it may be added up (see SUM_RULES)."""
        rules = {}
        for m in self.plan.metrics:
            placed = m.reserved or m.hops_by("elimination") or (m.hops and self.options.orphans == "reserve")
            rules[m.name] = SUM_RULES[2] if not m.additive else SUM_RULES[1] if placed else SUM_RULES[0]
        return built.select(*[F.col(c).alias(c, metadata={SUM_RULE: rules[c]}) if c in rules else F.col(c) for c in built.columns])

    # -- the output schema

    def _id_type(self, e: str) -> DataType:
        entity = self.manifest.entity(e)
        return self.catalog.table(entity.table).schema[entity.id].dataType

    def _select(self, rows: DataFrame, present: tuple[str, ...], values: dict[str, Column], weights: dict[str, Column], placeholder: str) -> DataFrame:
        cols = []
        for e in self.entities:
            name = self.manifest.entity(e).id
            if e in present:
                cols += [F.col(id_of(e)).alias(name), F.coalesce(F.col(label_of(e)), F.when(F.col(id_of(e)).isNull(), placeholder)).alias(label_output(e))]
            else:
                cols += [F.lit(None).cast(self._id_type(e)).alias(name), F.lit(placeholder).alias(label_output(e))]
        for m in self.plan.metrics:
            cols.append(values.get(m.name, F.lit(0.0)).cast("double").alias(m.name))
            if not m.additive:
                cols.append(weights.get(m.name, F.lit(0.0)).cast("double").alias(f"{m.name}_weight"))
        return rows.select(*cols)

    # -- rows at the table's own grain

    def _pipeline(self, plans: list[MetricPlan], grain: tuple[str, ...], apart: bool) -> list[DataFrame]:
        base = self.weights.add(base_rows(self.manifest, self.catalog, grain), plans, grain)
        values, weights, out = {}, {}, []
        for p in plans:
            if not p.additive:
                values[p.name], weights[p.name] = F.col(value_of(p.name)), self.weights.weight(p, grain)
            elif apart or not p.reserved:
                values[p.name] = self.weights.allocated(p)
        if values or not self.options.skip_zero_base:
            out.append(self._select(base, grain, values, weights, self.reserve))
        for p in plans:
            if not p.additive:
                continue
            if p.reserved and not apart:
                out.append(self._propagated(base, p) if p.hops_by("allocation") or p.hops_by("elimination") else self._reserved(p))
            out += [self._correction(base, p, i) for i in p.hops_by("elimination")]
            if self.options.orphans == "reserve" and p.hops:
                out.append(self._orphans(base, p))
        return out

    def _reserved(self, p: MetricPlan) -> DataFrame:
        """One row for every home row, which carries the whole value."""
        return self._select(home_rows(self.manifest, self.catalog, p.name), p.home.grain, {p.name: F.col(value_of(p.name))}, {}, self.reserve)

    def _propagated(self, base: DataFrame, p: MetricPlan) -> DataFrame:
        """One row for each combination of the metric's own grain."""
        rows = base.select(*[c for e in p.grain for c in (id_of(e), label_of(e))], self.weights.allocated(p).alias(value_of(p.name))).distinct()
        return self._select(rows, p.grain, {p.name: F.col(value_of(p.name))}, {}, self.reserve)

    def _corrected(self, base: DataFrame, p: MetricPlan, hop: int) -> tuple[DataFrame, tuple[str, ...]]:
        """A row for each anchor of an elimination hop: what its n targets repeat too often."""
        anchors = p.anchors(hop)
        scaled = base.withColumn("__v", self.weights.allocated(p, hop))
        per = scaled.groupBy(*[c for e in anchors for c in (id_of(e), label_of(e))], "__v").agg(F.countDistinct(id_of(p.hops[hop].target_entity)).alias("__n"))
        return per.withColumn(value_of(p.name), F.col("__v") * (1 - F.col("__n"))), anchors

    def _correction(self, base: DataFrame, p: MetricPlan, hop: int) -> DataFrame:
        rows, anchors = self._corrected(base, p, hop)
        return self._select(rows, anchors, {p.name: F.col(value_of(p.name))}, {}, self.eliminated)

    def _unlinked(self, base: DataFrame, p: MetricPlan) -> DataFrame:
        """Home rows that the base rows leave out."""
        home = home_rows(self.manifest, self.catalog, p.name)
        linked = base.select(*[F.col(id_of(e)).alias(f"__o_{e}") for e in p.home.grain]).distinct()
        return home.join(linked, [F.col(id_of(e)) == F.col(f"__o_{e}") for e in p.home.grain], "left_anti")

    def _orphans(self, base: DataFrame, p: MetricPlan) -> DataFrame:
        return self._select(self._unlinked(base, p), p.home.grain, {p.name: F.col(value_of(p.name))}, {}, self.reserve)

    # -- rows with entities summarized out

    def _summary(self, group: GrainGroup) -> DataFrame:
        plans, grain = list(group.metrics), group.grain
        keys = tuple(e for e in self.entities if e in grain)
        base = self.weights.add(base_rows(self.manifest, self.catalog, grain), plans, grain)
        time = self.manifest.time
        gone = set(plans[0].summarized)
        timed = time is not None and bool(gone & set(time.time_entities or (time.entity,)))
        days = time is not None and (time.weighting or "days") == "days" and "__date" in base.columns
        cols = [c for e in keys for c in (id_of(e), label_of(e))]
        values, weights = [], []
        for p in plans:
            v = F.col(value_of(p.name)) if not p.additive else self.weights.allocated(p)
            values.append(v.alias(f"__v_{p.name}"))
            weights.append((self.weights.weight(p, grain) if not p.additive else F.lit(0.0)).alias(f"__u_{p.name}"))
        length = period_days(F.col("__date"), time.granularity) if timed and days else F.lit(None).cast("long")
        source = F.col("__date") if "__date" in base.columns else F.lit(None)
        parts = [base.select(*cols, *values, *weights, length.alias("__days"), source.alias("__period"), F.lit(True).alias("__real"))]
        extra: list[tuple[DataFrame, tuple[str, ...], MetricPlan]] = []
        for p in plans:
            if p.additive and not (p.metric.stock and timed):
                extra += [(*self._corrected(base, p, hop), p) for hop in p.hops_by("elimination")]
                if self.options.orphans == "reserve" and p.hops:
                    extra.append((self._unlinked(base, p), p.home.grain, p))
        for rows, anchors, p in extra:
            at = [F.col(c) if e in anchors else F.lit(None).cast(base.schema[c].dataType).alias(c) for e in keys for c in (id_of(e), label_of(e))]
            fill = [(F.col(value_of(p.name)) if q is p else F.lit(None).cast("double")).alias(f"__v_{q.name}") for q in plans]
            zero = [F.lit(0.0).alias(f"__u_{q.name}") for q in plans]
            parts.append(rows.select(*at, *fill, *zero, F.lit(None).cast("long").alias("__days"), F.lit(None).cast(parts[0].schema["__period"].dataType).alias("__period"), F.lit(False).alias("__real")))
        rows = reduce(DataFrame.unionByName, parts)
        stocks = [p for p in plans if timed and p.metric.stock]
        result = rows.groupBy(*cols).agg(*[a for p in plans for a in self._totals(p, timed, days)])
        if stocks and self.options.stock == "semi_additive":
            result = self._semi_additive(rows, result, stocks, cols, days)
        return self._select(result, keys, {p.name: F.col(f"__t_{p.name}") for p in plans}, {p.name: F.col(f"__x_{p.name}") for p in plans}, self.reserve)

    def _totals(self, p: MetricPlan, timed: bool, days: bool) -> list[Column]:
        v, u = F.col(f"__v_{p.name}"), F.col(f"__u_{p.name}")
        if not p.additive:
            total = F.sum(u)
            return [(F.sum(v * u) / F.when(total != 0, total)).alias(f"__t_{p.name}"), total.alias(f"__x_{p.name}")]
        if timed and p.metric.stock:
            length = F.sum(F.when(F.col("__real"), F.col("__days")))
            value = F.sum(v * F.col("__days")) / F.when(length != 0, length) if days else F.avg(F.when(F.col("__real"), v))
        else:
            value = F.sum(v)
        return [value.alias(f"__t_{p.name}"), F.lit(0.0).alias(f"__x_{p.name}")]

    def _semi_additive(self, rows: DataFrame, result: DataFrame, stocks: list[MetricPlan], cols: list[str], days: bool) -> DataFrame:
        """Stocks added up within each period, then averaged over the periods."""
        per = rows.where("__real").groupBy(*cols, "__period").agg(F.first("__days").alias("__days"), *[F.sum(f"__v_{p.name}").alias(f"__v_{p.name}") for p in stocks])
        length = F.sum("__days")
        aggs = [((F.sum(F.col(f"__v_{p.name}") * F.col("__days")) / F.when(length != 0, length)) if days else F.avg(f"__v_{p.name}")).alias(f"__t_{p.name}") for p in stocks]
        per = per.groupBy(*[F.col(c).alias(f"{c}__k") for c in cols]).agg(*aggs)
        kept = result.drop(*[f"__t_{p.name}" for p in stocks])
        joined = kept.join(per, [F.col(c).eqNullSafe(F.col(f"{c}__k")) for c in cols], "left") if cols else kept.crossJoin(F.broadcast(per))
        return joined.drop(*[f"{c}__k" for c in cols])
