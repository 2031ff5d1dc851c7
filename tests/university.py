"""A small school: 30 students in 3 of 10 classes each, 5 professors over 13 assignments."""

from widegrain.plans.manifest_yaml import parse_manifest
from widegrain.sources.catalog import Catalog

STUDENTS = [(i, f"s{i}", 10000 + 137 * i, 2.0 + (i % 7) * 0.5) for i in range(1, 31)]
CLASSES = [(i, f"c{i}", 30000 + 1000 * i) for i in range(1, 11)]
PROFESSORS = [(i, f"p{i}", 70000 + 2000 * (i % 3)) for i in range(1, 6)]
ENROLLMENTS = [(s, (s + k * 3) % 10 + 1, 80.0 + (s * k) % 17) for s in range(1, 31) for k in range(3)]
ASSIGNMENTS = [(c, c % 5 + 1) for c in range(1, 11)] + [(1, 4), (2, 5), (3, 1)]

HEAD = """
entities:
  - {name: Student, estimated_rows: 30, metrics: [{name: tuition_paid, type: currency, nature: additive}, {name: satisfaction_score, type: rating, nature: non-additive}]}
  - {name: Class, role: bridge, estimated_rows: 10, metrics: [{name: class_budget, type: currency, nature: additive}]}
  - {name: Professor, estimated_rows: 5, metrics: [{name: salary, type: currency, nature: additive}]}
relationships:
  - {name: Enrollment, between: [Student, Class], type: many-to-many, estimated_links: 90, metrics: [{name: enrollment_grade, type: float, nature: additive}]}
  - {name: Assignment, between: [Class, Professor], type: many-to-many, estimated_links: 13}
"""

MAIN = HEAD + """
propagations:
  - metric: tuition_paid
    path:
      - {relationship: Enrollment, target_entity: Class, strategy: allocation, weight: w}
      - {relationship: Assignment, target_entity: Professor, strategy: allocation, weight: w}
  - metric: class_budget
    path: [{relationship: Enrollment, target_entity: Student, strategy: elimination}]
  - metric: satisfaction_score
    path: [{relationship: Enrollment, target_entity: Class, strategy: sum_over_sum, weight: w}]
  - metric: enrollment_grade
    path: [{relationship: Assignment, target_entity: Professor, strategy: allocation, weight: w}]
bft_tables:
  - {name: department_financial, entities: [Student, Class, Professor], metrics: [tuition_paid, class_budget, salary]}
  - {name: student_experience, entities: [Student, Class], metrics: [tuition_paid, satisfaction_score, class_budget, enrollment_grade]}
  - {name: class_summary, entities: [Class, Professor], metrics: [tuition_paid, enrollment_grade]}
"""


def manifest(text=MAIN):
    return parse_manifest(text)


def catalog(spark):
    make = spark.createDataFrame
    return Catalog({
        "students": make(STUDENTS, "student_id int, name string, tuition_paid int, satisfaction_score double"),
        "classes": make(CLASSES, "class_id int, name string, class_budget int"),
        "professors": make(PROFESSORS, "professor_id int, name string, salary int"),
        "enrollments": make(ENROLLMENTS, "student_id int, class_id int, enrollment_grade double"),
        "assignments": make(ASSIGNMENTS, "class_id int, professor_id int"),
    })
