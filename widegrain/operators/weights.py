"""Hop counts and shares: how many targets a hop leads to from each of its anchors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from widegrain.operators.grain import id_of, value_of
from widegrain.plans.model import Manifest
from widegrain.plans.planner import MetricPlan


def count_name(plan: MetricPlan, hop: int) -> str:
    """One count for each (anchors, target), whichever metrics use it."""
    return "__n_" + "_".join([*sorted(plan.anchors(hop)), "to", plan.hops[hop].target_entity])


def share_name(plan: MetricPlan, hop: int) -> str:
    return count_name(plan, hop).replace("__n_", "__s_") + f"_{plan.hops[hop].relationship}"


def rows_name(plan: MetricPlan) -> str:
    return "__r_" + "_".join(sorted(plan.grain))


class Weights:
    """Adds the counts that a set of metrics needs to base rows.

    mode "join" counts distinct (anchors, target) pairs by partial aggregation and joins
    them back, which neither holds an anchor's targets in memory nor needs its rows in one
    task; "window" holds an anchor's targets in one row and all its rows in one task: only
    for anchors of small, bounded fan-out.
    """

    def __init__(self, manifest: Manifest, mode: str = "join", declared: bool = False):
        if mode not in ("join", "window"):
            raise ValueError("mode is join or window")
        self.manifest, self.mode, self.declared = manifest, mode, declared

    def uses_share(self, plan: MetricPlan, hop: int) -> bool:
        h = plan.hops[hop]
        return self.declared and h.strategy == "allocation" and self.manifest.relationship(h.relationship).weight_column is not None

    def add(self, rows: DataFrame, plans: list[MetricPlan], grain: tuple[str, ...]) -> DataFrame:
        counts: dict[str, tuple[tuple[str, ...], str]] = {}
        shares: dict[str, tuple[tuple[str, ...], str, str]] = {}
        repeats: dict[str, tuple[str, ...]] = {}
        for p in plans:
            for i, h in enumerate(p.hops):
                if self.uses_share(p, i):
                    shares[share_name(p, i)] = (p.anchors(i), h.target_entity, h.relationship)
                elif h.strategy != "elimination" or not p.additive:
                    counts[count_name(p, i)] = (p.anchors(i), h.target_entity)
            if not p.additive and set(grain) - set(p.grain):
                repeats[rows_name(p)] = p.grain
        out = rows
        for name, (anchors, target) in counts.items():
            keys = [id_of(a) for a in anchors]
            if self.mode == "window":
                out = out.withColumn(name, F.size(F.collect_set(id_of(target)).over(Window.partitionBy(*keys))).cast("long"))
            else:
                # Base rows are distinct, so where they hold nothing but the hop's pairs a plain count will do.
                n = F.count("*") if {*anchors, target} == set(grain) else F.countDistinct(id_of(target))
                out = _with(out, rows.groupBy(*keys).agg(n.alias(name)), keys)
        for name, grain_of in repeats.items():
            keys = [id_of(a) for a in grain_of]
            if self.mode == "window":
                out = out.withColumn(name, F.count("*").over(Window.partitionBy(*keys)))
            else:
                out = _with(out, rows.groupBy(*keys).agg(F.count("*").alias(name)), keys)
        for name, (anchors, target, rel) in shares.items():
            keys = [id_of(a) for a in anchors]
            pairs = rows.select(*keys, id_of(target), f"__w_{rel}").distinct()
            out = _with(out, pairs.groupBy(*keys).agg(F.sum(f"__w_{rel}").alias(name)), keys)
        return out

    def allocated(self, plan: MetricPlan, upto: int | None = None) -> Column:
        """The metric's value after the allocation hops before number `upto`."""
        value = F.col(value_of(plan.name))
        for i in plan.hops_by("allocation"):
            if upto is None or i < upto:
                if self.uses_share(plan, i):
                    total = F.col(share_name(plan, i))
                    value = value * F.col(f"__w_{plan.hops[i].relationship}") / F.when(total != 0, total)
                else:
                    value = value / F.col(count_name(plan, i))
        return value

    def weight(self, plan: MetricPlan, grain: tuple[str, ...]) -> Column:
        """Weight of a non-additive value on base rows; it adds up to 1 for each home row."""
        parts = [F.col(count_name(plan, i)).cast("double") for i in plan.hops_by("sum_over_sum")]
        if set(grain) - set(plan.grain):
            parts.append(F.col(rows_name(plan)).cast("double"))
        return reduce(lambda a, b: a / b, parts, F.lit(1.0))


def _with(rows: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """Join counts back on keys, which are never null in base rows."""
    renamed = counted.select(*[F.col(k).alias(f"{k}__k") if k in keys else F.col(k) for k in counted.columns])
    condition = [F.col(k) == F.col(f"{k}__k") for k in keys]
    return rows.join(renamed, condition).drop(*[f"{k}__k" for k in keys])
