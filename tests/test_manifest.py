import pytest
import university as U

from widegrain.plans.estimate import estimate_rows, estimate_table_rows, fan_out
from widegrain.plans.manifest_yaml import parse_manifest, serialize_manifest
from widegrain.plans.model import UNALLOCATED
from widegrain.plans.planner import plan_table
from widegrain.plans.rules import errors, validate
from widegrain.plans.suggest import Size, size_of, suggest


def rules(text):
    return {f.rule for f in validate(parse_manifest(text))}


def test_main_manifest_is_clean():
    assert rules(U.MAIN) == set()


@pytest.mark.parametrize("old,new,rule", [
    ("name: Student,", "name: 'Stu dent',", "valid-identifier"),
    ("type: rating", "type: stars", "valid-metric-type"),
    ("name: Professor,", "name: Class,", "no-duplicates"),
    ("estimated_rows: 30", "estimated_rows: 0", "positive-cardinality"),
    ("between: [Class, Professor]", "between: [Class]", "relationship-between-pair"),
    ("between: [Class, Professor]", "between: [Class, Ghost]", "relationship-entity-exists"),
    ("metric: class_budget", "metric: ghost", "propagation-metric-exists"),
    ("path: [{relationship: Enrollment, target_entity: Student, strategy: elimination}]", "path: []", "propagation-path-nonempty"),
    ("{relationship: Enrollment, target_entity: Student, strategy: elimination}", "{relationship: Ghost, target_entity: Student, strategy: elimination}", "propagation-relationship-exists"),
    ("{relationship: Enrollment, target_entity: Student, strategy: elimination}", "{relationship: Enrollment, target_entity: Ghost, strategy: elimination}", "propagation-entity-exists"),
    ("{relationship: Enrollment, target_entity: Student, strategy: elimination}", "{relationship: Assignment, target_entity: Student, strategy: elimination}", "propagation-path-connected"),
    ("strategy: elimination", "strategy: split", "valid-strategy"),
    ("strategy: elimination", "strategy: reserve", "propagation-no-reserve"),
    ("strategy: allocation, weight: w", "strategy: allocation", "strategy-weight-required"),
    ("{relationship: Assignment, target_entity: Professor, strategy: allocation, weight: w}", "{relationship: Enrollment, target_entity: Student, strategy: allocation, weight: w}", "propagation-no-cycle"),
    ("strategy: sum_over_sum", "strategy: allocation", "non-additive-strategy"),
    ("strategy: elimination", "strategy: sum_over_sum, weight: w", "additive-sum-over-sum"),
    ("entities: [Class, Professor]", "entities: []", "table-entities-nonempty"),
    ("entities: [Class, Professor]", "entities: [Class, Class]", "table-entity-unique"),
    ("entities: [Class, Professor]", "entities: [Class, Ghost]", "table-entity-exists"),
    ("metrics: [tuition_paid, enrollment_grade]", "metrics: [tuition_paid, tuition_paid]", "table-metric-unique"),
    ("metrics: [tuition_paid, enrollment_grade]", "metrics: [ghost]", "table-metric-exists"),
    ("entities: [Class, Professor], metrics: [tuition_paid, enrollment_grade]", "entities: [Student], metrics: [salary]", "table-metric-unreachable"),
    ("entities: [Class, Professor], metrics", "entities: [Student, Professor], metrics", "table-grain-connected"),
    ("nature: additive}, {name: satisfaction_score", "nature: additive, stock: true}, {name: satisfaction_score", "stock-requires-time"),
    ("type: rating, nature: non-additive", "type: rating, nature: non-additive, stock: true", "stock-not-non-additive"),
])
def test_each_rule(old, new, rule):
    assert old in U.MAIN
    assert rule in rules(U.MAIN.replace(old, new))


@pytest.mark.parametrize("time,rule", [
    ("{entity: Ghost, column: d, granularity: month}", "time-entity-exists"),
    ("{entity: Class, column: d, granularity: hour}", "time-granularity-valid"),
    ("{entity: Class, column: d, granularity: day, weighting: odd}", "time-weighting-valid"),
    ("{entity: Class, column: d, granularity: day, time_entities: [Student]}", "time-entities-includes-time-entity"),
    ("{entity: Class, column: d, granularity: day, time_entities: [Class, Ghost]}", "time-entities-exist"),
    ("{entity: Class, column: d, granularity: day, time_entities: [Class, Student]}", "time-entities-reachable"),
])
def test_time_rules(time, rule):
    assert rule in rules(U.MAIN + f"time: {time}\n")


def test_yaml_round_trip_lists_and_errors():
    m = parse_manifest(U.MAIN)
    assert parse_manifest(serialize_manifest(m)) == m
    listed = parse_manifest(U.HEAD + "propagations: [{metric: [tuition_paid, salary], path: [{relationship: Enrollment, target_entity: Class, strategy: elimination}]}]\n")
    assert [p.metric for p in listed.propagations] == ["tuition_paid", "salary"]
    assert parse_manifest("entities: [{name: yes, estimated_rows: 010}]").entities[0].name == "yes"
    assert parse_manifest("entities: [{name: a, estimated_rows: 010}]").entities[0].estimated_rows == 10
    assert parse_manifest("placeholder_labels: {}").reserve_label == UNALLOCATED
    for bad in ("- a", "time: 3", "time: {entity: a}"):
        with pytest.raises(ValueError, match="Invalid manifest"):
            parse_manifest(bad)


BIG = """
entities: [{name: Student, estimated_rows: 45000, metrics: [{name: tuition}]}, {name: Class, estimated_rows: 1200, metrics: [{name: budget}]}, {name: Professor, estimated_rows: 800, metrics: [{name: salary}]}]
relationships: [{name: Enrollment, between: [Student, Class], estimated_links: 120000}, {name: Assignment, between: [Class, Professor], estimated_links: 1800}]
propagations:
  - {metric: tuition, path: [{relationship: Enrollment, target_entity: Class, strategy: allocation, weight: w}, {relationship: Assignment, target_entity: Professor, strategy: allocation, weight: w}]}
bft_tables: [{name: all, entities: [Student, Class, Professor], metrics: [tuition, salary]}]
"""


def test_estimates():
    m = parse_manifest(BIG)
    assert estimate_rows(m, ["Student", "Class", "Professor"]) == 180000
    assert estimate_rows(m, ["Student", "Class"]) == 120000
    assert estimate_table_rows(m, "all") == {"combination": 180000, "placeholder": 800, "total": 180800}
    assert fan_out(m, "Enrollment", "Class") == 100 and fan_out(m, "Assignment", "Class") == 1.5
    assert estimate_table_rows(U.manifest(), "department_financial")["combination"] == 117


def test_suggestions_for_simpler_tables():
    m = parse_manifest(BIG)
    assert size_of(m) == Size(180800, 800, 8, 2)
    found = suggest(m, top=100)
    by = {s.change: s for s in found}
    # Without professors there is no fan-out by assignment, and one allocation less; salary becomes one row's total.
    assert by["drop Professor from all"].saves == Size(60000, 0, 2, 1)
    # Reserved tuition needs no weights but a row for each student; salary already has its rows.
    assert by["reserve tuition"].saves.weights == 2
    # Eliminated tuition would need correction rows for each student and saves no row.
    assert "eliminate tuition" not in by
    assert [s.impact for s in found] == sorted((s.impact for s in found), reverse=True) and all(s.impact > 0 for s in found)
    assert all(not errors(s.manifest) and size_of(m) == size_of(s.manifest) + s.saves for s in found)
    assert suggest(m) == found[:5] and by["reserve tuition"].manifest.path("tuition") == ()
    assert suggest(parse_manifest(BIG.replace("strategy: allocation", "strategy: split"))) == []
    # Non-additive metrics keep their weights: neither reserved nor eliminated.
    assert not any("satisfaction_score" in s.change and not s.change.startswith("remove") for s in suggest(U.manifest(), 100))


def test_unneeded_hops_are_pruned():
    plan = plan_table(U.manifest(), "student_experience")
    tuition = next(m for m in plan.metrics if m.name == "tuition_paid")
    assert [h.target_entity for h in tuition.hops] == ["Class"]
    assert len(plan.groups) == 1 or all(not g.summarizes for g in plan.groups)
    with pytest.raises(ValueError, match="not found on any"):
        plan_table(parse_manifest(U.HEAD + "bft_tables: [{name: t, entities: [Class], metrics: [ghost]}]"), "t")
