"""The wide-table queries over the star schema, with SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from widegrain.engine import Engine, validation_report
from widegrain.operators.assemble import Options
from widegrain.operators.grain import base_rows, id_of
from widegrain.operators.weights import Weights, count_name
from widegrain.plans.model import Entity, Hop, Manifest, Metric, Propagation, Relationship, Time, WideTable
from widegrain.plans.planner import plan_table
from widegrain.sources.catalog import Catalog
from widegrain.sources.introspect import distinct_values, introspect, unique_columns

ENTITIES = (
    Entity("Order", estimated_rows=15000, metrics=(Metric("order_total", "currency", source_column="o_totalprice"), Metric("order_count", "integer", source_column="1")), source_table="orders", id_column="o_orderkey", label_column="o_orderpriority"),
    Entity("Part", estimated_rows=2000, metrics=(Metric("retail_price", "currency", "non-additive", "p_retailprice"), Metric("part_size", "integer", source_column="p_size")), source_table="part", id_column="p_partkey", label_column="p_name"),
    Entity("Supplier", estimated_rows=100, metrics=(Metric("supplier_balance", "currency", source_column="s_acctbal"),), source_table="supplier", id_column="s_suppkey", label_column="s_name"),
    Entity("Customer", estimated_rows=1500, metrics=(Metric("customer_balance", "currency", source_column="c_acctbal"),), source_table="customer", id_column="c_custkey", label_column="c_name"),
    Entity("Nation", estimated_rows=25, source_table="nation", id_column="n_nationkey", label_column="n_name"),
    Entity("Region", estimated_rows=5, source_table="region", id_column="r_regionkey", label_column="r_name"),
    Entity("Month", estimated_rows=84, source_table="months"),
)
RELATIONSHIPS = (
    Relationship("LineItem", ("Order", "Part"), estimated_links=60000, weight_column="l_quantity", metrics=(Metric("line_revenue", "currency", source_column="l_extendedprice"), Metric("line_count", "integer", source_column="1")), source_table="lineitem", columns={"Order": "l_orderkey", "Part": "l_partkey"}),
    Relationship("Supply", ("Part", "Supplier"), estimated_links=52000, source_table="lineitem", columns={"Part": "l_partkey", "Supplier": "l_suppkey"}),
    Relationship("CustomerOrder", ("Order", "Customer"), "many-to-one", 15000, source_table="orders", columns={"Order": "o_orderkey", "Customer": "o_custkey"}),
    Relationship("CustomerNation", ("Customer", "Nation"), "many-to-one", 1500, source_table="customer", columns={"Customer": "c_custkey", "Nation": "c_nationkey"}),
    Relationship("NationRegion", ("Nation", "Region"), "many-to-one", 25, source_table="nation", columns={"Nation": "n_nationkey", "Region": "n_regionkey"}),
    Relationship("CustomerMonth", ("Customer", "Month"), estimated_links=14000, metrics=(Metric("month_revenue", "currency"), Metric("open_orders", "integer", stock=True)), source_table="customer_months", columns={"Customer": "o_custkey"}),
)

Paths = dict[str, list[tuple[str, str, str]]]


def manifest(name: str, entities: tuple[str, ...], metrics: tuple[str, ...], paths: Paths | None = None, labels: dict[str, str] | None = None, weighting: str = "days") -> Manifest:
    hops = tuple(Propagation(m, tuple(Hop(r, t, s, "share" if s != "elimination" else None) for r, t, s in path)) for m, path in (paths or {}).items())
    time = Time("Month", "month_date", "month", weighting, ("Month",))
    return Manifest(ENTITIES, RELATIONSHIPS, hops, (WideTable(name, entities, metrics),), labels, time)


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.trunc(F.col("o_orderdate").cast("date"), "month")
    dated = orders.withColumn("month_date", day).withColumn("month_id", F.year(day) * 100 + F.month(day))
    months = dated.select("month_id", F.date_format("month_date", "yyyy-MM").alias("name"), "month_date").distinct()
    linked = dated.groupBy("o_custkey", "month_id").agg(F.sum("o_totalprice").alias("month_revenue"), F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("open_orders"))
    return Catalog.parquet(spark, sf_dir, {"months": months, "customer_months": linked})


def unsigned_zero(df: DataFrame) -> DataFrame:
    """Doubles as they are, but no -0."""
    return df.select(*[(F.col(c) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def wide(entities: str, metrics: str, paths: Paths | None = None, options: Options | None = None, **more) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = manifest("wide", tuple(entities.split()), tuple(metrics.split()), paths, **more)
        return unsigned_zero(Engine(spark, m, catalog(spark, sf_dir), options).table("wide"))

    return run


def checks(entities: str, metrics: str, paths: Paths, prefix: str, loss: str) -> Callable[[SparkSession, str], DataFrame]:
    """The checks of a table as built, and of the same table without the rows of `loss`."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = manifest("wide", tuple(entities.split()), tuple(metrics.split()), paths)
        engine = Engine(spark, m, catalog(spark, sf_dir))
        built = engine.table("wide")
        damaged = engine.checks("wide", built.where(f"NOT coalesce({loss}, false)")).withColumn("test", F.concat("test", F.lit(" damaged")))
        # The gap of a failed sum is left out; the number of homes that fail stays.
        result = F.when(F.col("result").startswith("FAIL") & F.col("test").startswith("sum_"), "FAIL").otherwise(F.col("result"))
        return engine.checks("wide", built).unionByName(damaged).where(F.col("test").startswith(prefix)).select("test", result.alias("result"))

    return run


ALLOC_OP = ("LineItem", "Part", "allocation")
ELIM_OP = ("LineItem", "Part", "elimination")
CO_ALLOC, CO_ELIM = ("CustomerOrder", "Order", "allocation"), ("CustomerOrder", "Order", "elimination")


def load_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Catalog.parquet(spark, sf_dir).table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice").where("o_totalprice > 100000")


def base_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest("wide", ("Order", "Part"), ())
    return base_rows(m, catalog(spark, sf_dir), ("Order", "Part")).select(F.col("__id_Order").alias("o_orderkey"), F.col("__lb_Order").alias("order_name"), F.col("__id_Part").alias("p_partkey"), F.col("__lb_Part").alias("part_name"))


def base_join_m2o(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest("wide", ("Order", "Customer", "Nation", "Region"), ())
    rows = base_rows(m, catalog(spark, sf_dir), ("Order", "Customer", "Nation", "Region"))
    return rows.select(F.col("__id_Order").alias("o_orderkey"), F.col("__id_Customer").alias("c_custkey"), F.col("__lb_Nation").alias("n_name"), F.col("__lb_Region").alias("r_name"))


def _hop_counts(mode: str, metric: str, path: list[tuple[str, str, str]], grain: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = manifest("wide", grain, (metric,), {metric: path})
        p = plan_table(m, "wide").metrics[0]
        last = len(path) - 1
        rows = Weights(m, mode).add(base_rows(m, catalog(spark, sf_dir), grain), [p], grain)
        return rows.select(*[F.col(id_of(e)).alias(m.entity(e).id) for e in p.anchors(last)], F.col(count_name(p, last)).alias("n")).distinct()

    return run


def row_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates from the tables' own row counts as the declared cardinalities."""
    rows = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet").count() for n in ("orders", "part", "supplier", "customer", "lineitem")}
    a = manifest("order_part", ("Order", "Part"), ("order_total",), {"order_total": [ALLOC_OP]})
    a = replace(
        a,
        entities=tuple(replace(e, estimated_rows=rows.get(e.table, e.estimated_rows)) for e in a.entities),
        relationships=tuple(replace(r, estimated_links=rows.get(r.table, r.estimated_links)) for r in a.relationships),
    )
    tables = (*a.tables, WideTable("customers", ("Customer",), ("customer_balance",)), WideTable("chain", ("Order", "Part", "Supplier"), ("order_total", "supplier_balance")))
    return Engine(spark, Manifest(a.entities, a.relationships, a.propagations, tables, None, a.time), catalog(spark, sf_dir)).estimates()


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders through the CSV source: written once to the shared folder, then read with a schema."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="widegrain-csv-")
    folder = f"{folder.rstrip('/')}/widegrain-csv-{uuid.uuid4().hex}"
    cols = "o_orderkey long, o_orderstatus string, o_orderpriority string"
    spark.read.parquet(f"{sf_dir}/orders.parquet").select(*[c.split()[0] for c in cols.split(", ")]).write.option("header", True).csv(f"{folder}/orders.csv")
    orders = Catalog.csv(spark, folder, {"orders": cols}).table("orders")
    return orders.where("o_orderstatus = 'O'").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = manifest("wide", ("Order", "Ghost"), ("order_total", "nothing"), {"order_total": [("LineItem", "Part", "split")], "retail_price": [("LineItem", "Order", "allocation")]})
    return validation_report(spark, bad)


def _detected(spark: SparkSession, sf_dir: str):
    names = ["customer", "lineitem", "nation", "orders", "part", "region", "supplier"]
    given = {}
    for n in names:
        df = spark.read.parquet(f"{sf_dir}/{n}.parquet")
        # Prefixes of the columns go, and keys are named as ids, as the heuristics expect.
        given[n] = df.select(*[F.col(c).alias(c.split("_", 1)[1].replace("key", "_id").replace("cust_id", "customer_id").replace("supp_id", "supplier_id")) for c in df.columns])
    return introspect(given)


def pk_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name in ("customer", "lineitem", "orders", "part"):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        cols = [c for c in df.columns if c.endswith("key")]
        unique = unique_columns(df, cols)
        rows += [(name, c, c in unique) for c in cols]
    return spark.createDataFrame(rows, "table_name string, column_name string, is_unique boolean")


def fk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _detected(spark, sf_dir)
    return spark.createDataFrame([(t.name, c, r) for t in model.tables for c, r in t.foreign_keys.items()], "table_name string, column_name string, target string")


def detect_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _detected(spark, sf_dir)
    return spark.createDataFrame([(t, m.name, m.type, m.nature) for t, ms in model.metrics.items() for m in ms], "table_name string, metric string, metric_type string, nature string")


def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_values(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_type", 10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "load_scan": load_scan,
    "base_join": base_join,
    "base_join_m2o": base_join_m2o,
    "weight_hop1": _hop_counts("join", "order_total", [ALLOC_OP], ("Order", "Part")),
    "weight_hop1_window": _hop_counts("window", "order_total", [ALLOC_OP], ("Order", "Part")),
    "weight_hop2": _hop_counts("join", "customer_balance", [CO_ALLOC, ALLOC_OP], ("Customer", "Order", "Part")),
    "alloc_1hop": wide("Order Part", "order_total", {"order_total": [ALLOC_OP]}),
    "alloc_2hop": wide("Customer Order Part", "customer_balance", {"customer_balance": [CO_ALLOC, ALLOC_OP]}),
    "elim_1hop": wide("Order Part", "order_total", {"order_total": [ELIM_OP]}),
    "elim_2hop": wide("Customer Order Part", "customer_balance", {"customer_balance": [CO_ELIM, ELIM_OP]}),
    "elim_alloc": wide("Customer Order Part", "customer_balance", {"customer_balance": [CO_ELIM, ALLOC_OP]}),
    "alloc_elim": wide("Customer Order Part", "customer_balance", {"customer_balance": [CO_ALLOC, ELIM_OP]}),
    "reserve_only": wide("Order Part", "order_total part_size"),
    "reserve_plus_prop": wide("Customer Order Part", "order_total", {"order_total": [ALLOC_OP]}),
    "sum_over_sum": wide("Order Part", "retail_price", {"retail_price": [("LineItem", "Order", "sum_over_sum")]}),
    "sum_over_sum_2hop": wide("Part Order Customer", "retail_price", {"retail_price": [("LineItem", "Order", "sum_over_sum"), ("CustomerOrder", "Customer", "sum_over_sum")]}),
    "rel_metric_natural": wide("Order Part", "line_revenue"),
    "rel_metric_alloc": wide("Order Part Customer", "line_revenue", {"line_revenue": [("CustomerOrder", "Customer", "allocation")]}),
    "rel_metric_reserve": wide("Order Part Customer", "line_revenue"),
    "summarize_alloc": wide("Part", "order_total", {"order_total": [ALLOC_OP]}),
    "summarize_elim": wide("Part", "order_total", {"order_total": [ELIM_OP]}),
    "summarize_nonadd": wide("Order", "retail_price", {"retail_price": [("LineItem", "Order", "sum_over_sum")]}),
    "stock_days": wide("Customer", "open_orders"),
    "stock_equal": wide("Customer", "open_orders", weighting="equal"),
    "stock_with_flow": wide("Customer", "open_orders month_revenue"),
    "stock_semi_additive": wide("Region", "open_orders", {"open_orders": [("CustomerNation", "Nation", "allocation"), ("NationRegion", "Region", "allocation")]}, Options(stock="semi_additive")),
    "multi_group": wide("Part", "order_total supplier_balance", {"order_total": [ALLOC_OP], "supplier_balance": [("Supply", "Part", "allocation")]}),
    "mixed_groups": wide("Order Part", "order_total customer_balance", {"order_total": [ALLOC_OP], "customer_balance": [CO_ALLOC]}),
    "global_summary_row": wide("Region", "order_total"),
    "single_entity": wide("Part", "part_size"),
    "independent_chains": wide("Order Part Supplier", "order_total supplier_balance", {"order_total": [ALLOC_OP], "supplier_balance": [("Supply", "Part", "allocation")]}, Options(independent_chains="union")),
    "custom_label": wide("Order Part", "order_total", {"order_total": [ELIM_OP]}, labels={"reserve": "(none)", "elimination_set": "(correction)"}),
    "metric_rename": wide("Part", "retail_price part_size"),
    "weighted_alloc": wide("Order Part", "order_total", {"order_total": [ALLOC_OP]}, Options(weights="declared")),
    "orphan_reserve": wide("Order Part", "order_total", {"order_total": [ALLOC_OP]}, Options(orphans="reserve")),
    "orphan_summary": wide("Part", "order_total", {"order_total": [ALLOC_OP]}, Options(orphans="reserve")),
    "count_metric": wide("Order Part", "order_count", {"order_count": [ALLOC_OP]}),
    "count_links": wide("Part", "line_count"),
    "csv_scan": csv_scan,
    "skip_zero_base": wide("Order Part", "order_total part_size", None, Options(skip_zero_base=True)),
    "check_sum": checks("Order Part", "part_size line_revenue", {}, "sum_", "p_partkey % 5 = 0"),
    "check_per_home": checks("Customer Order", "customer_balance", {"customer_balance": [CO_ALLOC]}, "per_home_", "o_orderkey % 7 = 0"),
    "check_weights": checks("Order Part", "retail_price", {"retail_price": [("LineItem", "Order", "sum_over_sum")]}, "weights_", "o_orderkey % 7 = 0"),
    "distinct_values_topk": topk,
    "pk_probe": pk_probe,
    "fk_coverage": fk_coverage,
    "detect_metrics": detect_metrics,
    "row_estimates": row_estimates,
    "validation_report": report,
}

_LI = "li AS (SELECT l_orderkey, l_partkey, sum(l_quantity) AS q, sum(l_extendedprice) AS rev FROM lineitem GROUP BY 1, 2)"
_OP = f"""{_LI}, op AS (
  SELECT o_orderkey, o_orderpriority AS order_name, o_custkey, o_totalprice AS total, p_partkey, p_name AS part_name, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price, q, rev,
         CAST(count(*) OVER (PARTITION BY o_orderkey) AS DOUBLE) AS parts, CAST(count(*) OVER (PARTITION BY p_partkey) AS DOUBLE) AS orders_of
  FROM li JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
_COP = f"""{_OP}, cop AS (
  SELECT c_custkey, c_name AS customer_name, c_acctbal AS balance, op.* EXCLUDE (o_custkey), CAST(n_orders AS DOUBLE) AS n_orders
  FROM op JOIN customer ON o_custkey = c_custkey JOIN (SELECT o_custkey AS k, count(DISTINCT o_orderkey) AS n_orders FROM op GROUP BY 1) ON k = c_custkey)"""
_NONE = "'<Unallocated>'"
_O, _P, _C = "o_orderkey, order_name", "p_partkey, part_name", "c_custkey, customer_name"
_NO, _NP, _NC = f"NULL AS o_orderkey, {_NONE} AS order_name", f"NULL AS p_partkey, {_NONE} AS part_name", f"NULL AS c_custkey, {_NONE} AS customer_name"
_HOME_O = "o_orderkey, o_orderpriority AS order_name"
_HOME_P = "p_partkey, p_name AS part_name"
_MONTHS = """m AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS d, sum(o_totalprice) AS revenue, CAST(count(*) FILTER (o_orderstatus = 'O') AS DOUBLE) AS open,
  CAST(date_diff('day', date_trunc('month', o_orderdate), date_trunc('month', o_orderdate) + INTERVAL 1 MONTH) AS DOUBLE) AS days FROM orders GROUP BY ALL)"""


def _r(expr: str, name: str) -> str:
    return f"CAST({expr} AS DOUBLE) + CAST(0 AS DOUBLE) AS {name}"


def _verdicts(test: str, rows: str, home: str, off: str) -> str:
    """The check over all rows, and without every seventh order: how many homes are off."""
    one = "SELECT '{0}' AS test, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL: ' || n END AS result FROM (SELECT count(*) AS n FROM (SELECT {1} FROM {2}{3} GROUP BY 1 HAVING {4}))"
    return one.format(test, home, rows, "", off) + " UNION ALL " + one.format(f"{test} damaged", home, rows, " WHERE o_orderkey % 7 <> 0", off)


_KEYED = {"customer": "c_custkey c_nationkey", "lineitem": "l_orderkey l_partkey l_suppkey", "nation": "n_nationkey n_regionkey", "orders": "o_orderkey o_custkey", "part": "p_partkey", "region": "r_regionkey", "supplier": "s_suppkey s_nationkey"}
_NAMED = {"nationkey": ("nation_id", "nation", "n_nationkey"), "orderkey": ("order_id", "orders", "o_orderkey"), "partkey": ("part_id", "part", "p_partkey"), "suppkey": ("supplier_id", "supplier", "s_suppkey"), "regionkey": ("region_id", "region", "r_regionkey"), "custkey": ("customer_id", "customer", "c_custkey")}


def _coverage() -> str:
    """Key columns of other tables whose values all lie in the key they are named after."""
    out = []
    for t, cols in _KEYED.items():
        for c in cols.split():
            name, target, key = _NAMED[c.split("_", 1)[1]]
            if target != t:
                out.append(f"SELECT '{t}' AS table_name, '{name}' AS column_name, '{target}' AS target WHERE NOT EXISTS (SELECT {c} FROM {t} WHERE {c} IS NOT NULL EXCEPT SELECT {key} FROM {target})")
    return " UNION ALL ".join(out)


ORACLE_SQL: dict[str, str] = {
    "load_scan": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 100000",
    "base_join": f"WITH {_OP} SELECT {_O}, {_P} FROM op",
    "base_join_m2o": "SELECT o_orderkey, c_custkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "weight_hop1": f"WITH {_OP} SELECT DISTINCT o_orderkey, CAST(parts AS BIGINT) AS n FROM op",
    "weight_hop1_window": f"WITH {_OP} SELECT DISTINCT o_orderkey, CAST(parts AS BIGINT) AS n FROM op",
    "weight_hop2": f"WITH {_COP} SELECT DISTINCT c_custkey, o_orderkey, CAST(parts AS BIGINT) AS n FROM cop",
    "alloc_1hop": f"WITH {_OP} SELECT {_O}, {_P}, {_r('total / parts', 'order_total')} FROM op",
    "alloc_2hop": f"WITH {_COP} SELECT {_C}, {_O}, {_P}, {_r('balance / n_orders / parts', 'customer_balance')} FROM cop",
    "elim_1hop": f"WITH {_OP} SELECT {_O}, {_P}, {_r('total', 'order_total')} FROM op UNION ALL SELECT DISTINCT {_O}, {_NP}, {_r('total * (1 - parts)', 'order_total')} FROM op",
    "elim_2hop": f"""WITH {_COP} SELECT {_C}, {_O}, {_P}, {_r('balance', 'customer_balance')} FROM cop
      UNION ALL SELECT DISTINCT {_C}, {_NO}, {_NP}, {_r('balance * (1 - n_orders)', 'customer_balance')} FROM cop
      UNION ALL SELECT DISTINCT {_C}, {_O}, {_NP}, {_r('balance * (1 - parts)', 'customer_balance')} FROM cop""",
    "elim_alloc": f"""WITH {_COP} SELECT {_C}, {_O}, {_P}, {_r('balance / parts', 'customer_balance')} FROM cop
      UNION ALL SELECT DISTINCT {_C}, {_NO}, {_NP}, {_r('balance * (1 - n_orders)', 'customer_balance')} FROM cop""",
    "alloc_elim": f"""WITH {_COP} SELECT {_C}, {_O}, {_P}, {_r('balance / n_orders', 'customer_balance')} FROM cop
      UNION ALL SELECT DISTINCT {_C}, {_O}, {_NP}, {_r('balance / n_orders * (1 - parts)', 'customer_balance')} FROM cop""",
    "reserve_only": f"""WITH {_OP} SELECT {_O}, {_P}, CAST(0 AS DOUBLE) AS order_total, CAST(0 AS DOUBLE) AS part_size FROM op
      UNION ALL SELECT {_HOME_O}, {_NP}, {_r('o_totalprice', 'order_total')}, 0 FROM orders
      UNION ALL SELECT {_NO}, {_HOME_P}, 0, {_r('p_size', 'part_size')} FROM part""",
    "reserve_plus_prop": f"""WITH {_COP} SELECT {_C}, {_O}, {_P}, CAST(0 AS DOUBLE) AS order_total FROM cop
      UNION ALL SELECT DISTINCT {_NC}, {_O}, {_P}, {_r('total / parts', 'order_total')} FROM cop""",
    "sum_over_sum": f"WITH {_OP} SELECT {_O}, {_P}, {_r('price', 'retail_price')}, {_r('1 / orders_of', 'retail_price_weight')} FROM op",
    "sum_over_sum_2hop": f"WITH {_COP} SELECT {_P}, {_O}, {_C}, {_r('price', 'retail_price')}, {_r('1 / orders_of', 'retail_price_weight')} FROM cop",
    "rel_metric_natural": f"WITH {_OP} SELECT {_O}, {_P}, {_r('rev', 'line_revenue')} FROM op",
    "rel_metric_alloc": f"WITH {_COP} SELECT {_O}, {_P}, {_C}, {_r('rev', 'line_revenue')} FROM cop",
    "rel_metric_reserve": f"""WITH {_COP} SELECT {_O}, {_P}, {_C}, CAST(0 AS DOUBLE) AS line_revenue FROM cop
      UNION ALL SELECT {_O}, {_P}, {_NC}, {_r('rev', 'line_revenue')} FROM op""",
    "summarize_alloc": f"WITH {_OP} SELECT {_P}, {_r('sum(total / parts)', 'order_total')} FROM op GROUP BY ALL",
    "summarize_elim": f"""WITH {_OP} SELECT {_P}, {_r('sum(total)', 'order_total')} FROM op GROUP BY ALL
      UNION ALL SELECT {_NP}, {_r('sum(v)', 'order_total')} FROM (SELECT DISTINCT o_orderkey, total * (1 - parts) AS v FROM op)""",
    "summarize_nonadd": f"WITH {_OP} SELECT {_O}, {_r('sum(price / orders_of) / sum(1 / orders_of)', 'retail_price')}, {_r('sum(1 / orders_of)', 'retail_price_weight')} FROM op GROUP BY ALL",
    "stock_days": f"WITH {_MONTHS} SELECT c_custkey, c_name AS customer_name, {_r('sum(open * days) / sum(days)', 'open_orders')} FROM m JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "stock_equal": f"WITH {_MONTHS} SELECT c_custkey, c_name AS customer_name, {_r('avg(open)', 'open_orders')} FROM m JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "stock_with_flow": f"WITH {_MONTHS} SELECT c_custkey, c_name AS customer_name, {_r('sum(open * days) / sum(days)', 'open_orders')}, {_r('sum(revenue)', 'month_revenue')} FROM m JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "stock_semi_additive": f"""WITH {_MONTHS}, per AS (SELECT r_regionkey, r_name AS region_name, d, days, sum(open) AS open FROM m JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
      SELECT r_regionkey, region_name, {_r('sum(open * days) / sum(days)', 'open_orders')} FROM per GROUP BY ALL""",
    "multi_group": f"""WITH {_OP}, sp AS (SELECT s_acctbal, l_partkey, count(*) OVER (PARTITION BY l_suppkey) AS parts FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey)
      SELECT {_P}, {_r('sum(total / parts)', 'order_total')}, CAST(0 AS DOUBLE) AS supplier_balance FROM op GROUP BY ALL
      UNION ALL SELECT {_HOME_P}, 0, {_r('sum(s_acctbal / parts)', 'supplier_balance')} FROM sp JOIN part ON l_partkey = p_partkey GROUP BY p_partkey, p_name""",
    "mixed_groups": f"""WITH {_OP} SELECT {_O}, {_P}, {_r('total / parts', 'order_total')}, CAST(0 AS DOUBLE) AS customer_balance FROM op
      UNION ALL SELECT {_HOME_O}, {_NP}, 0, {_r('c_acctbal / n', 'customer_balance')} FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) ON k = c_custkey""",
    "global_summary_row": f"SELECT CAST(NULL AS INTEGER) AS r_regionkey, {_NONE} AS region_name, {_r('sum(o_totalprice)', 'order_total')} FROM orders",
    "single_entity": f"SELECT {_HOME_P}, {_r('p_size', 'part_size')} FROM part",
    "independent_chains": f"""WITH {_OP}, sp AS (SELECT s_suppkey, s_name, s_acctbal, l_partkey, count(*) OVER (PARTITION BY l_suppkey) AS parts FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey)
      SELECT {_O}, {_P}, NULL AS s_suppkey, {_NONE} AS supplier_name, {_r('total / parts', 'order_total')}, CAST(0 AS DOUBLE) AS supplier_balance FROM op
      UNION ALL SELECT {_NO}, {_HOME_P}, s_suppkey, s_name, 0, {_r('s_acctbal / parts', 'supplier_balance')} FROM sp JOIN part ON l_partkey = p_partkey""",
    "custom_label": f"WITH {_OP} SELECT {_O}, {_P}, {_r('total', 'order_total')} FROM op UNION ALL SELECT DISTINCT {_O}, NULL, '(correction)', {_r('total * (1 - parts)', 'order_total')} FROM op",
    "metric_rename": f"SELECT {_HOME_P}, {_r('p_retailprice', 'retail_price')}, CAST(1 AS DOUBLE) AS retail_price_weight, {_r('p_size', 'part_size')} FROM part",
    "weighted_alloc": f"WITH {_OP} SELECT {_O}, {_P}, {_r('total * q / sum(q) OVER (PARTITION BY o_orderkey)', 'order_total')} FROM op",
    "orphan_reserve": f"""WITH {_OP} SELECT {_O}, {_P}, {_r('total / parts', 'order_total')} FROM op
      UNION ALL SELECT {_HOME_O}, {_NP}, {_r('o_totalprice', 'order_total')} FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM op)""",
    "skip_zero_base": f"""SELECT {_HOME_O}, {_NP}, {_r('o_totalprice', 'order_total')}, CAST(0 AS DOUBLE) AS part_size FROM orders
      UNION ALL SELECT {_NO}, {_HOME_P}, 0, {_r('p_size', 'part_size')} FROM part""",
    "check_sum": f"""WITH {_OP}, t AS (
        SELECT 'sum_part_size' AS test, (SELECT sum(p_size) FROM part) AS built, (SELECT sum(p_size) FROM part) AS source
        UNION ALL SELECT 'sum_line_revenue', (SELECT sum(rev) FROM op), (SELECT sum(l_extendedprice) FROM lineitem)
        UNION ALL SELECT 'sum_part_size damaged', (SELECT sum(p_size) FROM part WHERE p_partkey % 5 <> 0), (SELECT sum(p_size) FROM part)
        UNION ALL SELECT 'sum_line_revenue damaged', (SELECT sum(rev) FROM op WHERE p_partkey % 5 <> 0), (SELECT sum(l_extendedprice) FROM lineitem))
      SELECT test, CASE WHEN abs(built - source) < 0.01 THEN 'PASS' ELSE 'FAIL' END AS result FROM t""",
    "check_per_home": f"""WITH co AS (SELECT c_custkey, o_orderkey, c_acctbal AS s, c_acctbal / count(*) OVER (PARTITION BY c_custkey) AS v FROM orders JOIN customer ON o_custkey = c_custkey)
      {_verdicts('per_home_customer_balance', 'co', 'c_custkey', 'abs(sum(v) - any_value(s)) > 0.01')}""",
    "check_weights": f"""WITH {_OP}, w AS (SELECT p_partkey, o_orderkey, 1 / orders_of AS u FROM op) {_verdicts('weights_retail_price', 'w', 'p_partkey', 'abs(sum(u) - 1) > 0.001')}""",
    "distinct_values_topk": "SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL ORDER BY p_type LIMIT 10",
    "pk_probe": " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(DISTINCT {c}) = count(*) AS is_unique FROM {t}" for t, c in (("customer", "c_custkey"), ("customer", "c_nationkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("lineitem", "l_suppkey"), ("orders", "o_orderkey"), ("orders", "o_custkey"), ("part", "p_partkey"))),
    "fk_coverage": _coverage(),
    "detect_metrics": """SELECT table_name, regexp_replace(column_name, '^[a-z]+_', '') AS metric, CASE WHEN data_type = 'DOUBLE' THEN 'float' ELSE 'integer' END AS metric_type, 'additive' AS nature
      FROM information_schema.columns WHERE table_name IN ('customer', 'lineitem', 'nation', 'orders', 'part', 'region', 'supplier') AND data_type IN ('DOUBLE', 'INTEGER', 'BIGINT') AND column_name NOT LIKE '%key'""",
    "validation_report": "SELECT * FROM (VALUES ('error', 'valid-strategy', 'propagations.order_total.path[0]'), ('error', 'non-additive-strategy', 'propagations.retail_price.path[0]'), ('error', 'table-entity-exists', 'bft_tables.wide.entities'), ('error', 'table-metric-exists', 'bft_tables.wide.metrics.nothing')) v(severity, rule, path)",
    "row_estimates": """WITH n AS (SELECT (SELECT count(*) FROM lineitem) AS items, (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM supplier) AS suppliers)
      SELECT 'order_part' AS table_name, items AS combination, CAST(0 AS BIGINT) AS placeholder, items AS total FROM n UNION ALL SELECT 'customers', customers, 0, customers FROM n
      UNION ALL SELECT 'chain', items + suppliers, suppliers, items + 2 * suppliers FROM n""",
    "orphan_summary": f"""WITH {_OP} SELECT {_P}, {_r('sum(total / parts)', 'order_total')} FROM op GROUP BY ALL
      UNION ALL SELECT {_NP}, {_r('sum(o_totalprice)', 'order_total')} FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM op)""",
    "count_metric": f"""WITH {_OP} SELECT {_O}, {_P}, {_r('1 / parts', 'order_count')} FROM op""",
    "count_links": "SELECT p_partkey, p_name AS part_name, CAST(count(*) AS DOUBLE) AS line_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "csv_scan": "SELECT o_orderpriority, count(*) AS n, sum(o_orderkey) AS keys FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL",
}
