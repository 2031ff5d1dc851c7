import itertools

import pytest
import university as U
from pyspark.sql import functions as F

from widegrain.engine import Engine, InvalidManifest
from widegrain.operators.assemble import Options
from widegrain.plans.manifest_yaml import parse_manifest
from widegrain.sources.catalog import Catalog

TRIPLES = len([1 for (s, c, _), (d, p) in itertools.product(U.ENROLLMENTS, U.ASSIGNMENTS) if c == d])


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, U.manifest(), U.catalog(spark))


def total(df, column):
    return df.agg(F.sum(column)).first()[0]


def test_department_financial_counts_and_sums(engine):
    df = engine.table("department_financial").cache()
    # combinations, one row per enrollment for budget, ten corrections, five salaries
    assert df.count() == TRIPLES + 90 + 10 + 5
    assert total(df, "tuition_paid") == pytest.approx(sum(s[2] for s in U.STUDENTS))
    assert total(df, "class_budget") == pytest.approx(sum(c[2] for c in U.CLASSES))
    assert total(df, "salary") == pytest.approx(sum(p[2] for p in U.PROFESSORS))
    assert df.columns == ["student_id", "student_name", "class_id", "class_name", "professor_id", "professor_name", "tuition_paid", "class_budget", "salary"]


def test_student_experience(engine):
    df = engine.table("student_experience").cache()
    assert df.count() == 90 + 10
    assert total(df, "enrollment_grade") == pytest.approx(sum(e[2] for e in U.ENROLLMENTS))
    assert total(df, "satisfaction_score_weight") == pytest.approx(30)
    mean = df.agg((F.sum(F.col("satisfaction_score") * F.col("satisfaction_score_weight")) / F.sum("satisfaction_score_weight"))).first()[0]
    assert mean == pytest.approx(sum(s[3] for s in U.STUDENTS) / 30)


def test_class_summary(engine):
    df = engine.table("class_summary").cache()
    assert df.count() == 13
    assert total(df, "tuition_paid") == pytest.approx(sum(s[2] for s in U.STUDENTS))
    assert total(df, "enrollment_grade") == pytest.approx(sum(e[2] for e in U.ENROLLMENTS))


@pytest.mark.parametrize("name", ["department_financial", "student_experience", "class_summary"])
def test_checks_pass(engine, name):
    found = engine.checks(name).collect()
    assert found and all(r["result"] == "PASS" for r in found), found


def test_failing_check_says_what_is_off(engine):
    broken = engine.table("class_summary").withColumn("tuition_paid", F.col("tuition_paid") * 2)
    found = {r["test"]: r["result"] for r in engine.checks("class_summary", broken).collect()}
    assert found["sum_tuition_paid"].startswith("FAIL: ")


@pytest.mark.parametrize("first,second", list(itertools.product(["allocation", "elimination"], repeat=2)))
@pytest.mark.parametrize("entities", ["Student, Class, Professor", "Class, Student", "Student", "Professor", "Class"])
def test_every_pair_of_strategies_conserves_the_sum(spark, first, second, entities):
    text = U.HEAD + f"""
propagations:
  - metric: salary
    path:
      - {{relationship: Assignment, target_entity: Class, strategy: {first}, weight: w}}
      - {{relationship: Enrollment, target_entity: Student, strategy: {second}, weight: w}}
bft_tables: [{{name: t, entities: [{entities}], metrics: [salary]}}]
"""
    df = Engine(spark, U.manifest(text), U.catalog(spark)).table("t")
    assert total(df, "salary") == pytest.approx(sum(p[2] for p in U.PROFESSORS))


@pytest.mark.parametrize("mode", ["join", "window"])
def test_count_modes_agree(spark, mode):
    df = Engine(spark, U.manifest(), U.catalog(spark), Options(counts=mode)).table("department_financial")
    assert total(df.where("student_id = 7"), "tuition_paid") == pytest.approx(U.STUDENTS[6][2])


def test_parallel_links_and_orphans(spark):
    c = U.catalog(spark)
    twice = c.table("enrollments").where("student_id <> 30")
    doubled = Catalog({**c.given, "enrollments": twice.unionByName(twice)})
    df = Engine(spark, U.manifest(), doubled).table("student_experience")
    assert total(df, "tuition_paid") == pytest.approx(sum(s[2] for s in U.STUDENTS[:-1]))
    kept = Engine(spark, U.manifest(), doubled, Options(orphans="reserve")).table("student_experience")
    assert total(kept, "tuition_paid") == pytest.approx(sum(s[2] for s in U.STUDENTS))
    assert total(kept, "enrollment_grade") == pytest.approx(2 * sum(e[2] for e in U.ENROLLMENTS if e[0] != 30))


def test_independent_chains(spark):
    text = U.HEAD + "bft_tables: [{name: t, entities: [Student, Class, Professor], metrics: [enrollment_grade, salary]}]\n"
    df = Engine(spark, U.manifest(text), U.catalog(spark), Options(independent_chains="union")).table("t")
    assert df.count() == 90 + 5


STOCK = """
entities:
  - {name: Department, estimated_rows: 3}
  - {name: Month, estimated_rows: 6}
relationships:
  - {name: DepartmentMonth, between: [Department, Month], type: many-to-many, estimated_links: 18, source_table: department_months,
     metrics: [{name: revenue, type: currency, nature: additive}, {name: headcount, type: integer, nature: additive, stock: true}]}
time: {entity: Month, column: month_date, granularity: month, WEIGHT time_entities: [Month]}
bft_tables: [{name: monthly, entities: [Department, Month], metrics: [revenue, headcount]}, {name: summary, entities: [Department], metrics: [revenue, headcount]}]
"""
HEADS = {(d, m): 10 * d + m * m for d in (1, 2, 3) for m in range(1, 7)}
DAYS = [31, 29, 31, 30, 31, 30]


@pytest.mark.parametrize("weighting", ["days", "equal"])
def test_stock_is_averaged_and_flow_is_added(spark, weighting):
    make = spark.createDataFrame
    c = Catalog({
        "departments": make([(d, f"d{d}") for d in (1, 2, 3)], "department_id int, name string"),
        "months": make([(m, f"m{m}", f"2024-{m:02d}-01") for m in range(1, 7)], "month_id int, name string, month_date string").withColumn("month_date", F.to_date("month_date")),
        "department_months": make([(d, m, 100 * d, h) for (d, m), h in HEADS.items()], "department_id int, month_id int, revenue int, headcount int"),
    })
    e = Engine(spark, parse_manifest(STOCK.replace("WEIGHT", f"weighting: {weighting}," )), c)
    assert e.table("monthly").count() == 18
    days = DAYS if weighting == "days" else [1] * 6
    for r in e.table("summary").collect():
        d = r["department_id"]
        assert r["revenue"] == 600 * d
        assert r["headcount"] == pytest.approx(sum(HEADS[d, m] * days[m - 1] for m in range(1, 7)) / sum(days))
    assert all(r["result"] == "PASS" for r in e.checks("summary").collect())


def test_invalid_manifest_and_unconnected_grain(spark):
    with pytest.raises(InvalidManifest):
        Engine(spark, U.manifest(U.MAIN.replace("strategy: elimination", "strategy: split")), U.catalog(spark))
    text = U.HEAD + "bft_tables: [{name: t, entities: [Student, Professor], metrics: [salary]}]\n"
    with pytest.raises(ValueError, match="Cannot connect entities"):
        Engine(spark, U.manifest(text), U.catalog(spark)).table("t")


def test_write_checks_what_was_written(spark, tmp_path, engine):
    assert engine.write("class_summary", str(tmp_path / "t")).count() == 13


def test_metrics_say_how_they_add_up(spark, tmp_path, engine):
    rule = lambda df: {f.name: f.metadata["sum_rule"] for f in df.schema.fields if f.metadata}
    wide, seen = engine.table("department_financial"), engine.table("student_experience")
    assert rule(wide) == {"tuition_paid": "any_rows", "class_budget": "with_placeholder_rows", "salary": "with_placeholder_rows"}
    assert rule(seen)["satisfaction_score"] == "by_weight"
    wide.write.parquet(str(tmp_path / "t"))
    assert rule(spark.read.parquet(str(tmp_path / "t"))) == rule(wide)
    # What the rule says: without placeholder rows only the first metric keeps its sum.
    named = engine.combination_rows("department_financial")
    assert total(named, "tuition_paid") == pytest.approx(total(wide, "tuition_paid")) and total(named, "salary") == 0


def test_plan_has_no_python_and_prunes_columns(spark, engine):
    plan = engine.table("student_experience")._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
