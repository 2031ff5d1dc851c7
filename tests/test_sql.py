"""The emitted SQL gives the engine's rows."""

import pytest
import university as U
from test_queries import rows
from test_queries import same as same_rows

from widegrain import queries as Q
from widegrain.authoring.sql import checks_sql, table_sql
from widegrain.engine import Engine
from widegrain.plans.planner import plan_table

CASES = {
    "alloc_elim": ("Customer Order Part", "customer_balance", {"customer_balance": [Q.CO_ALLOC, Q.ELIM_OP]}),
    "reserve_plus": ("Customer Order Part", "order_total part_size line_revenue", {"order_total": [Q.ALLOC_OP]}),
    "sum_over_sum": ("Order Part", "retail_price", {"retail_price": [("LineItem", "Order", "sum_over_sum")]}),
    "summarize": ("Part", "order_total retail_price", {"order_total": [Q.ELIM_OP]}),
    "mixed": ("Order Part", "order_total customer_balance", {"order_total": [Q.ALLOC_OP], "customer_balance": [Q.CO_ALLOC]}),
    "stock": ("Customer", "open_orders month_revenue", {}),
    "counts": ("Order Part", "order_count line_count", {"order_count": [Q.ALLOC_OP]}),
    "global": ("Region", "order_total", {}),
}


def same(spark, manifest, catalog, name):
    for table, df in catalog.given.items():
        df.createOrReplaceTempView(table)
    statement = table_sql(manifest, plan_table(manifest, name))
    found = spark.sql(statement[statement.index("WITH") :].rstrip(";\n"))
    want = Engine(spark, manifest, catalog).table(name)
    assert found.columns == want.columns
    assert same_rows(rows(found.collect(), found.columns), rows(want.collect(), want.columns))
    want.createOrReplaceTempView(name)
    plan = plan_table(manifest, name)
    checked = {r["test"].partition(".")[2]: r["result"] for r in spark.sql(checks_sql(manifest, plan)).collect()}
    assert checked == {r["test"]: r["result"].partition(":")[0] for r in Engine(spark, manifest, catalog).checks(name).collect()}


@pytest.mark.parametrize("name", ["department_financial", "student_experience", "class_summary"])
def test_school(spark, name):
    same(spark, U.manifest(), U.catalog(spark), name)


@pytest.mark.parametrize("case", sorted(CASES))
def test_star_schema(spark, case):
    entities, metrics, paths = CASES[case]
    m = Q.manifest("wide", tuple(entities.split()), tuple(metrics.split()), paths)
    c = Q.catalog(spark, "/root/testdata/sf0.001")
    for t in ("orders", "part", "supplier", "customer", "nation", "region", "lineitem"):
        c.table(t)
    same(spark, m, c, "wide")
