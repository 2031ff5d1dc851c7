"""Checks of a built wide table against its sources: one row of (test, result) each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from widegrain.operators.grain import home_rows, id_of, value_of
from widegrain.plans.model import Manifest
from widegrain.plans.planner import MetricPlan, TablePlan
from widegrain.sources.catalog import Catalog

SUM_TOLERANCE, WEIGHT_TOLERANCE = 0.01, 0.001
#: How far the rows of a table may be from their estimate, either way.
ROW_FACTOR = 2


def _verdict(name: str, ok: Column, detail: Column) -> list[Column]:
    return [F.lit(name).alias("test"), F.when(ok, "PASS").otherwise(F.concat(F.lit("FAIL: "), F.coalesce(detail.cast("string"), F.lit("null")))).alias("result")]


def sum_check(manifest: Manifest, catalog: Catalog, built: DataFrame, p: MetricPlan) -> DataFrame:
    """The metric's total equals the source's."""
    source = home_rows(manifest, catalog, p.name).agg(F.sum(value_of(p.name)).alias("s"))
    both = built.agg(F.sum(p.name).alias("t")).crossJoin(source)
    gap = F.abs(F.coalesce("t", F.lit(0.0)) - F.coalesce("s", F.lit(0.0)))
    return both.select(*_verdict(f"sum_{p.name}", gap < SUM_TOLERANCE, gap))


def per_home_check(manifest: Manifest, catalog: Catalog, built: DataFrame, p: MetricPlan) -> DataFrame:
    """Every home row's share of an allocated metric adds up to its value."""
    e = p.home.grain[0]
    source = home_rows(manifest, catalog, p.name).select(id_of(e), F.col(value_of(p.name)).alias("s"))
    key = manifest.entity(e).id
    off = built.groupBy(key).agg(F.sum(p.name).alias("t")).join(source, F.col(key) == F.col(id_of(e))).where(F.abs(F.col("t") - F.col("s")) > SUM_TOLERANCE)
    return off.agg(F.count("*").alias("n")).select(*_verdict(f"per_home_{p.name}", F.col("n") == 0, F.col("n")))


def weight_check(manifest: Manifest, built: DataFrame, p: MetricPlan) -> DataFrame:
    """A non-additive metric's weights add up to 1 for each home row."""
    keys = [manifest.entity(e).id for e in p.home.grain]
    # Rows that name less than the metric's grain are placeholder rows of other metrics.
    rows = reduce(DataFrame.filter, [F.col(manifest.entity(e).id).isNotNull() for e in p.grain], built)
    off = rows.groupBy(*keys).agg(F.sum(f"{p.name}_weight").alias("w")).where(F.abs(F.coalesce("w", F.lit(0.0)) - 1) > WEIGHT_TOLERANCE)
    return off.agg(F.count("*").alias("n")).select(*_verdict(f"weights_{p.name}", F.col("n") == 0, F.col("n")))


def reserve_check(manifest: Manifest, built: DataFrame, p: MetricPlan) -> DataFrame:
    """A reserved metric is zero wherever an entity it doesn't reach is named."""
    named = reduce(lambda a, b: a | b, [F.col(manifest.entity(e).id).isNotNull() for e in p.reserved])
    off = built.where(named & (F.col(p.name) != 0))
    return off.agg(F.count("*").alias("n")).select(*_verdict(f"reserve_{p.name}", F.col("n") == 0, F.col("n")))


def row_check(built: DataFrame, expected: int | None) -> DataFrame:
    """There are rows; with an estimate, from half to twice as many."""
    n = F.col("n")
    ok = n > 0 if expected is None else (n * ROW_FACTOR >= expected) & (n <= expected * ROW_FACTOR)
    return built.agg(F.count("*").alias("n")).select(*_verdict("row_count", ok, n))


def check_table(manifest: Manifest, catalog: Catalog, plan: TablePlan, built: DataFrame, expected: int | None = None) -> DataFrame:
    """All checks that apply, as (test, result) with PASS or FAIL: and what is off."""
    time = manifest.time
    timed = set(time.time_entities or (time.entity,)) if time else set()
    rows = [row_check(built, expected)]
    summarizes = bool(plan.summarizing)
    for p in plan.metrics:
        if p.additive:
            if not (p.metric.stock and set(p.summarized) & timed):
                rows.append(sum_check(manifest, catalog, built, p))
            if not summarizes and not p.reserved and p.home.relationship is None and p.hops and len(p.hops_by("allocation")) == len(p.hops):
                rows.append(per_home_check(manifest, catalog, built, p))
            if p.reserved and not summarizes:
                rows.append(reserve_check(manifest, built, p))
        elif not p.summarized:
            rows.append(weight_check(manifest, built, p))
    return reduce(DataFrame.unionByName, rows)
