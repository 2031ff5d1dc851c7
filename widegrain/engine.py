"""The engine: a manifest and its sources give wide tables, checks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from widegrain.operators.assemble import Assembly, Options
from widegrain.operators.checks import check_table
from widegrain.plans.estimate import estimate_table_rows
from widegrain.plans.model import Manifest
from widegrain.plans.planner import TablePlan, plan_table
from widegrain.plans.rules import errors, validate
from widegrain.sources.catalog import Catalog


class InvalidManifest(ValueError):
    pass


class ChecksFailed(AssertionError):
    pass


class Engine:
    """Tables are lazy DataFrames; nothing runs before an action on them."""

    def __init__(self, spark: SparkSession, manifest: Manifest, catalog: Catalog, options: Options | None = None):
        found = errors(manifest)
        if found:
            raise InvalidManifest("; ".join(f"{f.rule}: {f.message}" for f in found))
        self.spark, self.manifest, self.catalog, self.options = spark, manifest, catalog, options or Options()

    def plan(self, name: str) -> TablePlan:
        return plan_table(self.manifest, name)

    def table(self, name: str) -> DataFrame:
        return Assembly(self.manifest, self.catalog, self.plan(name), self.options).build()

    def checks(self, name: str, built: DataFrame | None = None, estimated: bool = False) -> DataFrame:
        """(test, result) rows; with `estimated`, the rows are held against the declared cardinalities too."""
        expected = estimate_table_rows(self.manifest, name)["total"] if estimated else None
        return check_table(self.manifest, self.catalog, self.plan(name), built if built is not None else self.table(name), expected)

    def combination_rows(self, name: str) -> DataFrame:
        """Rows on which every entity is named; dropping the others breaks reserve and elimination sums."""
        out = self.table(name)
        for e in self.plan(name).table.entities:
            out = out.where(F.col(self.manifest.entity(e).id).isNotNull())
        return out

    def write(self, name: str, path: str, mode: str = "overwrite") -> DataFrame:
        """Write a table as Parquet, check what was written, and return it."""
        self.table(name).write.mode(mode).parquet(path)
        built = self.spark.read.parquet(path)
        failed = self.checks(name, built).where(~F.col("result").startswith("PASS")).collect()
        if failed:
            raise ChecksFailed("; ".join(f"{r['test']}: {r['result']}" for r in failed))
        return built

    def estimates(self) -> DataFrame:
        rows = [(t.name, *(estimate_table_rows(self.manifest, t.name)[k] for k in ("combination", "placeholder", "total"))) for t in self.manifest.tables]
        return self.spark.createDataFrame(rows, "table_name string, combination long, placeholder long, total long")


def validation_report(spark: SparkSession, manifest: Manifest) -> DataFrame:
    return spark.createDataFrame([(f.severity, f.rule, f.path) for f in validate(manifest)], "severity string, rule string, path string")
